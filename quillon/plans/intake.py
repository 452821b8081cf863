"""Imports, page signals, ownership and address rules, and what events tell."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import urls
from quillon.operators import commit_log, imports, mutations
from quillon.operators.cuts import shared_path
from quillon.operators.latest import latest
from quillon.operators.rate_limit import limited
from quillon.plans.oracle import sql
from quillon.plans.registry import query
from quillon.schemas import ACTIVITY_TYPES, BUSINESS, BUSINESS_SOURCES, DEMO_STATUSES, JOB_STATUSES, JOB_TYPES, PROPOSAL_STATUSES, SCAN_STATUSES, STAGES, USAGE_SERVICES
from quillon.sources import csv_import, pages
from quillon.sources import tables as t

# --- imports -------------------------------------------------------------------------------------


def raw_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows as a file would have them: odd headers, Spanish and English, blanks and wrong values."""
    i = F.col("c_custkey")
    text = lambda c: c.cast("string")
    return t.base(spark, d, "customer").select(
        (i + 1).alias(csv_import.ORDINAL),
        F.when(i % 13 == 0, "").when(i % 17 == 0, "  ").otherwise(F.concat(F.lit("Negocio "), text(F.expr("c_custkey div 2")))).alias(" Nombre "),
        F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("city "), text(i % 7))).alias("CITY"), F.concat(F.lit("ciudad "), text(i % 5)).alias("Ciudad"),
        F.when(i % 3 == 0, F.concat(F.lit("calle "), text(i % 11))).alias("Dirección"),
        F.when(i % 10 == 3, "not-a-url").when(i % 10 == 4, "").otherwise(F.concat(F.lit("http://n"), text(i), F.lit(".example"))).alias("web"),
        F.when(i % 9 == 4, "nobody@").otherwise(F.concat(F.lit("a"), text(i), F.lit("@mail.example"))).alias("Correo"),
        F.when(i % 5 != 0, F.concat(F.lit("p"), text(F.expr("c_custkey div 3")))).alias("place id"),
        F.when(i % 8 == 5, "7").when(i % 16 == 7, "abc").otherwise(F.concat(text(i % 5), F.lit(".5"))).alias("Rating"),
        F.when(i % 19 == 3, "-3").when(i % 19 == 4, "4.5").otherwise(text(i % 300)).alias("reviews"), text(i % 100).alias("lat"), text(i % 200).alias("lng"),
    )


_RAW = """
  SELECT c_custkey + 2 AS row, CASE WHEN c_custkey % 13 = 0 OR c_custkey % 17 = 0 THEN NULL ELSE 'Negocio ' || (c_custkey // 2) END AS name,
    CASE WHEN c_custkey % 4 = 0 THEN 'ciudad ' || (c_custkey % 5) ELSE 'city ' || (c_custkey % 7) END AS city,
    CASE WHEN c_custkey % 3 = 0 THEN 'calle ' || (c_custkey % 11) END AS address,
    CASE WHEN c_custkey % 10 = 3 THEN 'not-a-url' WHEN c_custkey % 10 = 4 THEN NULL ELSE 'http://n' || c_custkey || '.example' END AS website_url,
    CASE WHEN c_custkey % 9 = 4 THEN 'nobody@' ELSE 'a' || c_custkey || '@mail.example' END AS email,
    CASE WHEN c_custkey % 5 <> 0 THEN 'p' || (c_custkey // 3) END AS gbp_place_id,
    CASE WHEN c_custkey % 8 = 5 THEN '7' WHEN c_custkey % 16 = 7 THEN 'abc' ELSE (c_custkey % 5) || '.5' END AS rating,
    CASE WHEN c_custkey % 19 = 3 THEN '-3' WHEN c_custkey % 19 = 4 THEN '4.5' ELSE CAST(c_custkey % 300 AS VARCHAR) END AS review_count,
    CAST(c_custkey % 100 AS VARCHAR) AS latitude, CAST(c_custkey % 200 AS VARCHAR) AS longitude FROM customer"""
_JUDGED = """
  SELECT *, list_filter([CASE WHEN name IS NULL THEN 'El nombre del negocio es obligatorio' END, CASE WHEN website_url = 'not-a-url' THEN 'URL de web no válida' END,
    CASE WHEN email = 'nobody@' THEN 'Email no válido' END, CASE WHEN try_cast(rating AS DOUBLE) IS NULL OR try_cast(rating AS DOUBLE) NOT BETWEEN 0 AND 5 THEN 'rating: valor no válido' END,
    CASE WHEN review_count IN ('-3', '4.5') THEN 'review_count: valor no válido' END, CASE WHEN CAST(latitude AS INTEGER) > 90 THEN 'latitude: valor no válido' END,
    CASE WHEN CAST(longitude AS INTEGER) > 180 THEN 'longitude: valor no válido' END], lambda x: x IS NOT NULL) AS problems FROM raw"""
_VALID = """
  SELECT row, name, city, address, website_url, email, gbp_place_id, CAST(rating AS DOUBLE) AS rating, CAST(review_count AS INTEGER) AS review_count,
    CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude FROM judged WHERE len(problems) = 0"""
_FIELDS = ["row", "name", "city", "address", "website_url", "email", "gbp_place_id", "rating", "review_count", "latitude", "longitude"]


def _sql(body: str, *needs: str) -> str:
    return sql(body, *needs, raw=_RAW, judged=_JUDGED, valid=_VALID)


def _records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return csv_import.validated(csv_import.resolved(raw_rows(spark, d)))


@query(_sql("SELECT * FROM raw"))
def import_normalize(spark, d):
    return csv_import.resolved(raw_rows(spark, d)).select(*_FIELDS)


@query(_sql("SELECT * FROM valid"))
def import_validate(spark, d):
    return _records(spark, d)[0].select(*_FIELDS)


@query(_sql("SELECT row, array_to_string(problems, '; ') AS message FROM judged WHERE len(problems) > 0"))
def import_errors(spark, d):
    return _records(spark, d)[1]


def _existing(spark: SparkSession, d: str) -> DataFrame:
    """A store that holds some of what the file brings."""
    i = F.col("c_custkey")
    rows = t.base(spark, d, "customer").where(i % 6 == 0)
    return rows.select(F.concat(F.lit("negocio "), (i + 1).cast("string")).alias("name"), F.lit(None).cast("string").alias("address"), F.concat(F.lit("p"), i.cast("string")).alias("gbp_place_id"))


_STORE = """(SELECT 'negocio ' || (c_custkey + 1) AS name, NULL AS address, 'p' || c_custkey AS gbp_place_id FROM customer WHERE c_custkey % 6 = 0)"""


@query(_sql(f"SELECT row, gbp_place_id FROM valid v WHERE NOT EXISTS (SELECT 1 FROM {_STORE} s WHERE s.gbp_place_id = v.gbp_place_id)"))
def import_anti(spark, d):
    return imports.unseen(_records(spark, d)[0], _existing(spark, d)).select("row", "gbp_place_id")


#: The sequential rule: a step for each valid row, with the place ids and names kept so far.
_GREEDY = f"""
  SELECT v.*, row_number() OVER (ORDER BY row) AS n, lower(name) || '|' || coalesce('=' || address, '') AS who,
    EXISTS (SELECT 1 FROM {_STORE} s WHERE s.gbp_place_id = v.gbp_place_id OR (lower(s.name) = lower(v.name) AND s.address IS NOT DISTINCT FROM v.address)) AS stored FROM valid v"""
_STEPS = """
  SELECT 0::BIGINT AS n, FALSE AS kept, []::VARCHAR[] AS places, []::VARCHAR[] AS whos
  UNION ALL
  SELECT g.n, k.kept, CASE WHEN k.kept AND g.gbp_place_id IS NOT NULL THEN list_append(s.places, g.gbp_place_id) ELSE s.places END,
    CASE WHEN k.kept THEN list_append(s.whos, g.who) ELSE s.whos END
  FROM steps s JOIN greedy g ON g.n = s.n + 1,
    LATERAL (SELECT NOT g.stored AND NOT list_contains(s.whos, g.who) AND NOT coalesce(list_contains(s.places, g.gbp_place_id), FALSE) AS kept) k"""


def _greedy_sql(body: str) -> str:
    return sql(body, raw=_RAW, judged=_JUDGED, valid=_VALID, greedy=_GREEDY, steps=_STEPS).replace("WITH ", "WITH RECURSIVE ", 1)


@query(_greedy_sql("SELECT row, name, address, gbp_place_id FROM greedy JOIN steps USING (n) WHERE kept"))
def import_dedupe(spark, d):
    """Greedy: whether a record counts depends on those kept before it."""
    return imports.deduplicate(_records(spark, d)[0], _existing(spark, d)).select("row", "name", "address", "gbp_place_id")


def _written_csv(spark: SparkSession, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and errors of files that are written here; limits are those of one upload, and this is the bulk of a table."""
    folder = shared_path(spark, "import-csv")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = raw.repartitionByRange(parts, csv_import.ORDINAL).sortWithinPartitions(csv_import.ORDINAL).drop(csv_import.ORDINAL)
    rows.write.csv(folder, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return csv_import.validated(csv_import.resolved(csv_import.read_csv(spark, folder, most_bytes=None)))


def _import_run(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """From files to the rows of a new table."""
    table = shared_path(spark, "businesses")
    records, errors = _written_csv(spark, raw_rows(spark, d))
    return imports.import_batch(records, errors, _existing(spark, d), table, owner_id=1, job_id=77), table


@query(_greedy_sql("""SELECT row_number() OVER (ORDER BY row) AS id, 1::BIGINT AS owner_id, 77::BIGINT AS source_job_id, 'csv_import' AS source, name, city, website_url, rating, review_count, TRUE AS stamped
  FROM greedy JOIN steps USING (n) WHERE kept"""))  # fmt: skip
def import_written(spark, d):
    """What an import has written, read back: files, aliases, validation, greedy rule, ids, stamps."""
    _, table = _import_run(spark, d)
    stamped = (F.col("created_at").isNotNull() & (F.col("created_at") == F.col("updated_at"))).alias("stamped")
    return commit_log.read(spark, table, BUSINESS).select("id", "owner_id", "source_job_id", "source", "name", "city", "website_url", "rating", "review_count", stamped)


@query(_greedy_sql("""SELECT (SELECT count(*) FROM steps WHERE kept) AS inserted, (SELECT count(*) FROM steps WHERE n > 0 AND NOT kept) AS duplicates, (SELECT count(*) FROM judged WHERE len(problems) > 0) AS error_rows,
  'COMPLETED' AS status, (SELECT count(*) FROM valid) AS progress_current, (SELECT count(*) FROM valid) AS progress_total"""))  # fmt: skip
def import_summary(spark, d):
    """Counts of that import, and the state of its job."""
    return _import_run(spark, d)[0]


_QUOTED = """
  SELECT c_custkey + 2 AS row, 'Negocio ' || c_custkey || chr(10) || 'con "comillas", y comas' AS name, CASE WHEN c_custkey % 3 = 0 THEN 'calle; ' || c_custkey END AS address,
    CASE WHEN c_custkey % 2 = 0 THEN 'a' || chr(10) || chr(10) || '"b"' ELSE 'llano' END AS city FROM customer"""


@query(sql("SELECT row, name, address, city FROM quoted", quoted=_QUOTED))
def import_quoted(spark, d):
    """Files whose quoted fields hold line ends, quotes and separators, each read by several tasks."""
    i = F.col("c_custkey")
    n = i.cast("string")
    raw = t.base(spark, d, "customer").select(
        (i + 1).alias(csv_import.ORDINAL), F.concat(F.lit("Negocio "), n, F.lit('\ncon "comillas", y comas')).alias("nombre"), F.when(i % 3 == 0, F.concat(F.lit("calle; "), n)).alias("dirección"),
        F.when(i % 2 == 0, 'a\n\n"b"').otherwise("llano").alias("ciudad"),
    )
    return _written_csv(spark, raw)[0].select("row", "name", "address", "city")


#: Of the records with even rows and then all: in that order, with the place ids and names kept so far.
_TWICE = _GREEDY.replace("ORDER BY row)", "ORDER BY row % 2, row)")


@query(_greedy_sql("""SELECT row_number() OVER (ORDER BY n) AS id, CASE WHEN row % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS source_job_id, name, address, gbp_place_id
  FROM greedy JOIN steps USING (n) WHERE kept""").replace(_GREEDY, _TWICE))  # fmt: skip
def import_twice(spark, d):
    """Half of the records, then all of them, and then the first import again, which adds nothing."""
    table = shared_path(spark, "businesses")
    records, errors = _records(spark, d)
    half = records.where("row % 2 = 0")
    for job, rows in ((1, half), (2, records), (1, half)):
        imports.import_batch(rows, errors, _existing(spark, d), table, owner_id=1, job_id=job)
    return commit_log.read(spark, table, BUSINESS).select("id", "source_job_id", "name", "address", "gbp_place_id")


_CHAINS = """
  SELECT o_orderkey AS row, 'N' || (o_orderkey // 60) || '-' || (o_orderkey % 60 // 2) AS name, 'p' || (o_orderkey // 60) || '-' || ((o_orderkey % 60 + 1) // 2) AS gbp_place_id FROM orders"""
#: Along a chain a record goes if the one before it is there and stays; so every second stays, from where the chain begins or breaks.
_CHAINED = """
  SELECT row, name, gbp_place_id FROM (SELECT *, row - min(row) OVER (PARTITION BY row // 60, row - place) AS after FROM (SELECT *, row_number() OVER (PARTITION BY row // 60 ORDER BY row) AS place FROM chains))
  WHERE after % 2 = 0"""


@query(sql(_CHAINED, chains=_CHAINS))
def import_chains(spark, d):
    """Chains of records, each like the next by name or by place id in turn: components folded beside each other."""
    i = F.col("o_orderkey")
    part = lambda c: F.concat_ws("-", F.expr("o_orderkey div 60").cast("string"), c.cast("string"))
    rows = t.base(spark, d, "orders").select(
        i.alias("row"), F.concat(F.lit("N"), part(F.expr("o_orderkey % 60 div 2"))).alias("name"), F.lit(None).cast("string").alias("address"), F.concat(F.lit("p"), part(F.expr("(o_orderkey % 60 + 1) div 2"))).alias("gbp_place_id")
    )
    return imports.deduplicate(rows, rows.limit(0)).select("row", "name", "gbp_place_id")


# --- pages ---------------------------------------------------------------------------------------


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return t.base(spark, d, "pages")


def _signal(spark: SparkSession, d: str, **names: str) -> DataFrame:
    s = pages.signals(F.col("html"), F.col("url"))
    return _pages(spark, d).select("page_id", s.alias("s")).select("page_id", *[F.col(f"s.{n}").alias(name) for name, n in names.items()])


def _plain(text: str) -> str:
    """The characters that references in the pages stand for."""
    for name, c in (("lt", "'<'"), ("gt", "'>'"), ("quot", "chr(34)"), ("#39", "chr(39)"), ("nbsp", "chr(160)"), ("amp", "'&'")):
        text = f"replace({text}, '&{name};', {c})"
    return text


_TITLE = f"nullif(trim({_plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}), '')"


@query(f"SELECT page_id, {_TITLE} AS title, CAST(coalesce(length({_TITLE}), 0) AS INTEGER) AS units FROM pages")
def html_title(spark, d):
    return _signal(spark, d, title="title", units="title_length")


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<h1[\\s>]')) AS INTEGER) AS h1, CAST(len(regexp_extract_all(html, '(?i)<h2[\\s>]')) AS INTEGER) AS h2, CAST(len(regexp_extract_all(html, '(?i)<img[\\s>]')) AS INTEGER) AS images FROM pages")
def html_headings(spark, d):
    return _signal(spark, d, h1="h1_count", h2="h2_count", images="image_count")


@query(r"""SELECT page_id, CAST(len(list_filter(h, lambda x: NOT regexp_matches(x, '^(#|mailto:|tel:)') AND (NOT regexp_matches(x, '^[a-z]+:|^//')
  OR regexp_extract(x, '^(https?://[^/?#]+)', 1) = o))) AS INTEGER) AS internal, CAST(len(list_filter(h, lambda x: regexp_matches(x, '^[a-z]+:|^//') AND NOT regexp_matches(x, '^(mailto:|tel:)')
  AND regexp_extract(x, '^(https?://[^/?#]+)', 1) <> o)) AS INTEGER) AS external
  FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS h, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS o FROM pages)""")  # fmt: skip
def html_links(spark, d):
    s = pages.signals(F.col("html"), F.col("url"))
    return _pages(spark, d).select("page_id", s.alias("s")).select("page_id", F.col("s.internal_link_count").alias("internal"), F.col("s.external_link_count").alias("external"))


_BARE = r"""regexp_replace(regexp_replace(regexp_extract(html, '(?is)<body[^>]*>(.*)$', 1), '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')"""
_TEXT = rf"""trim(regexp_replace({_plain(_BARE)}, '[\s\x{{A0}}\x{{FEFF}}]+', ' ', 'g'))"""


@query(f"SELECT page_id, CAST(CASE WHEN b = '' THEN 0 ELSE len(string_split(b, ' ')) END AS INTEGER) AS words FROM (SELECT page_id, {_TEXT} AS b FROM pages)")
def html_words(spark, d):
    return _signal(spark, d, words="word_count_estimate")


@query("""SELECT page_id, contains(html, 'href="tel:') AS phone, contains(html, 'wa.me') OR contains(html, 'api.whatsapp.com') AS whatsapp, regexp_matches(html, '(?i)<form[\\s>]') AS form FROM pages""")
def html_contact(spark, d):
    s = pages.signals(F.col("html"), F.col("url"))
    return _pages(spark, d).select("page_id", s.alias("s")).select("page_id", F.col("s.has_phone_link").alias("phone"), F.col("s.has_whatsapp_link").alias("whatsapp"), F.col("s.has_contact_form").alias("form"))


@query("SELECT page_id, CAST(strlen(html) AS INTEGER) AS html_size_bytes, url LIKE 'https:%' AS https FROM pages")
def html_size(spark, d):
    return _pages(spark, d).select("page_id", F.octet_length("html").alias("html_size_bytes"), pages.https(F.col("url")).alias("https"))


#: A probe finds nothing if the digest of its address begins so.
_GONE = ["0", "1", "2", "3", "4"]
_any = lambda words, text: "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"
_probe = lambda path: f"substr(md5(o || '{path}'), 1, 1) NOT IN ({', '.join(repr(x) for x in _GONE)})"


@query(rf"""WITH p AS (
  SELECT *, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS o, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS h, lower({_TEXT}) AS b, {_TITLE} AS title,
    list_filter(regexp_extract_all(html, '(?is)<(?:a [^>]*href=|button)[^>]*>(.*?)</(?:a|button)>', 1), lambda x: {_any(pages.CTA_WORDS, "lower(regexp_replace(x, '<[^>]*>', '', 'g'))")}) AS calls FROM pages)
SELECT page_id, url, 'completed' AS status, NULL::VARCHAR AS error, url LIKE 'https:%' AS https, NULL::INTEGER AS http_status, CAST(strlen(html) AS INTEGER) AS html_size_bytes,
  {_probe('/robots.txt')} AS robots_txt_present, {_probe('/sitemap.xml')} AS sitemap_present, NULL::INTEGER AS server_response_time_ms, NULL::INTEGER AS lighthouse_performance_score,
  CAST(len(regexp_extract_all(html, '(?i)<img[\s>]')) AS INTEGER) AS image_count,
  CAST(len(list_filter(regexp_extract_all(html, '(?i)<img[^>]*>'), lambda x: NOT regexp_matches(x, '(?i) alt="[^"]*\S[^"]*"'))) AS INTEGER) AS images_missing_alt,
  CAST(len(list_filter(h, lambda x: NOT regexp_matches(x, '^(#|mailto:|tel:)') AND (NOT regexp_matches(x, '^[a-z]+:|^//') OR regexp_extract(x, '^(https?://[^/?#]+)', 1) = o))) AS INTEGER) AS internal_link_count,
  CAST(len(list_filter(h, lambda x: regexp_matches(x, '^[a-z]+:|^//') AND NOT regexp_matches(x, '^(mailto:|tel:)') AND regexp_extract(x, '^(https?://[^/?#]+)', 1) <> o)) AS INTEGER) AS external_link_count,
  CAST(CASE WHEN b = '' THEN 0 ELSE len(string_split(b, ' ')) END AS INTEGER) AS word_count_estimate, title, CAST(coalesce(length(title), 0) AS INTEGER) AS title_length,
  nullif(trim(regexp_extract(html, '(?is)<meta name="description" content="([^"]*)"', 1)), '') AS meta_description,
  CAST(length(trim(regexp_extract(html, '(?is)<meta name="description" content="([^"]*)"', 1))) AS INTEGER) AS meta_description_length,
  regexp_matches(html, '(?is)<link rel="canonical" href="[^"]') AS canonical_present, regexp_matches(html, '(?is)<meta name="viewport" content="[^"]') AS has_viewport_meta,
  contains(html, 'type="application/ld+json"') AS schema_markup_present, CAST(len(regexp_extract_all(html, '(?i)<h1[\s>]')) AS INTEGER) AS h1_count,
  CAST(len(regexp_extract_all(html, '(?i)<h2[\s>]')) AS INTEGER) AS h2_count, contains(html, 'href="tel:') AS has_phone_link,
  contains(html, 'wa.me') OR contains(html, 'api.whatsapp.com') AS has_whatsapp_link, regexp_matches(html, '(?i)<form[\s>]') AS has_contact_form,
  CAST(len(calls) AS INTEGER) AS cta_mentions_count, {_any(pages.TESTIMONIAL_WORDS, 'b')} AS has_testimonials_section,
  regexp_matches(html, '(?is)<meta name="viewport" content="[^"]') AS has_responsive_meta, '{','.join([*pages.UNAVAILABLE, pages.NOT_CALLED])}' AS unavailable_metrics
FROM p""")  # fmt: skip
def html_full(spark, d):
    """Every signal of every page, with probes derived from the pages' hosts."""
    own = _pages(spark, d)
    hosts = own.select(pages.origin(F.col("url")).alias("host")).distinct()
    probes = hosts.select("host", F.explode(F.array(F.lit("/robots.txt"), F.lit("/sitemap.xml"))).alias("path"))
    probes = probes.withColumn("status", F.when(F.substring(F.md5(F.concat("host", "path")), 1, 1).isin(_GONE), 404).otherwise(200))
    return pages.scan(own, probes).withColumn("unavailable_metrics", F.array_join("unavailable_metrics", ","))


# --- ownership and checks ------------------------------------------------------------------------


@query(sql("SELECT id, name FROM businesses WHERE owner_id = 1", "businesses"))
def owner_scoped(spark, d):
    return t.businesses(spark, d, owner=1).select("id", "name")


@query(sql("SELECT * FROM scores s WHERE EXISTS (SELECT 1 FROM businesses b WHERE b.id = s.business_id AND owner_id = 1)", "scores", "businesses"))
def child_semi_join(spark, d):
    return t.scores(spark, d, owner=1)


def _owned_query(name: str, where: str, *needs: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return getattr(t, name)(spark, d, owner=2).select("id")

    run.__name__ = f"owned_{name}"
    query(sql(f"SELECT c.id FROM {name} c WHERE {where}", *dict.fromkeys([name, *needs])))(run)


_OF_BUSINESS = "EXISTS (SELECT 1 FROM businesses b WHERE b.id = c.business_id AND b.owner_id = 2)"
for _n in ("websites", "website_scans", "seo_audits", "local_audits", "competitors", "ai_reports", "proposals", "demos", "leads", "api_usage"):
    _owned_query(_n, _OF_BUSINESS, "businesses")
_owned_query("lead_activities", f"EXISTS (SELECT 1 FROM leads l JOIN businesses b ON l.business_id = b.id WHERE l.id = c.lead_id AND b.owner_id = 2)", "leads", "businesses")
_owned_query("jobs", "c.owner_id = 2")


def outside(rows: DataFrame, column: str, allowed: list[str], name: str) -> DataFrame:
    """(source, value, n): values that a closed set lacks and how often they occur; null is in every set."""
    return rows.where(~F.col(column).isin(allowed)).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("source"), "value", "n")


@query(sql("""SELECT 'jobs' AS source, status AS value, count(*) AS n FROM jobs WHERE status NOT IN ('QUEUED', 'RUNNING', 'COMPLETED', 'CANCELLED') GROUP BY 2
  UNION ALL SELECT 'leads', stage, count(*) FROM leads WHERE stage NOT IN ('NEW', 'ANALYZING', 'QUALIFIED', 'WON') GROUP BY 2
  UNION ALL SELECT 'activities', type, count(*) FROM lead_activities WHERE type NOT IN ('note', 'call', 'email') GROUP BY 2
  UNION ALL SELECT 'proposals', status, count(*) FROM proposals WHERE status NOT IN ('draft', 'rejected') GROUP BY 2""", "jobs", "leads", "lead_activities", "proposals"))  # fmt: skip
def enum_violations(spark, d):
    """Values outside a closed set and how often; here of sets made narrower than the model's, so that some are."""

    less = lambda full, *gone: [x for x in full if x not in gone]
    out = outside(t.jobs(spark, d), "status", less(JOB_STATUSES, "FAILED"), "jobs")
    out = out.unionByName(outside(t.leads(spark, d), "stage", [*STAGES[:3], "WON"], "leads"))
    out = out.unionByName(outside(t.lead_activities(spark, d), "type", less(ACTIVITY_TYPES, "stage_change", "meeting", "whatsapp"), "activities"))
    return out.unionByName(outside(t.proposals(spark, d), "status", less(PROPOSAL_STATUSES, "sent", "accepted"), "proposals"))


def _odd(column, allowed: list[str], key: str):
    """A value of the set for most rows, one outside it for every eleventh."""
    n = len(allowed)
    return F.when(F.col(key) % 11 == 0, F.concat(F.lit("odd_"), (F.col(key) % 2).cast("string"))).otherwise(F.element_at(F.array(*map(F.lit, allowed)), (F.col(key) % n + 1).cast("int"))).alias(column)


_ODD = " UNION ALL ".join(
    f"SELECT '{name}' AS source, 'odd_' || ({key} % 2) AS value, count(*) AS n FROM {table} WHERE {key} % 11 = 0 GROUP BY 2"
    for name, table, key in (("job_types", "events", "event_id"), ("business_sources", "customer", "c_custkey"), ("scan_statuses", "orders", "o_orderkey"), ("demo_statuses", "orders", "o_orderkey"), ("usage_services", "events", "event_id"))
)


@query(_ODD)
def enum_violations_whole(spark, d):
    """The other five sets as they are, of columns with some values outside them."""
    sets = [("job_types", "events", "event_id", JOB_TYPES), ("business_sources", "customer", "c_custkey", BUSINESS_SOURCES), ("scan_statuses", "orders", "o_orderkey", SCAN_STATUSES),
            ("demo_statuses", "orders", "o_orderkey", DEMO_STATUSES), ("usage_services", "events", "event_id", USAGE_SERVICES)]
    parts = [outside(t.base(spark, d, table).select(_odd("v", allowed, key)), "v", allowed, name) for name, table, key, allowed in sets]
    return functools.reduce(DataFrame.unionByName, parts)


@query(sql("SELECT owner_id, gbp_place_id, min(id) AS id FROM (SELECT id, owner_id, 'place-' || (id % 50) AS gbp_place_id FROM businesses WHERE gbp_place_id IS NOT NULL) GROUP BY 1, 2", "businesses"))
def partial_unique(spark, d):
    """One row for each owner and place id, where there is one; the smallest id stays."""
    rows = t.businesses(spark, d).where("gbp_place_id is not null").withColumn("gbp_place_id", F.concat(F.lit("place-"), (F.col("id") % 50).cast("string")))
    return rows.groupBy("owner_id", "gbp_place_id").agg(F.min("id").alias("id"))


def _addresses(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("c_custkey")
    first = F.element_at(F.array(*map(F.lit, ["10", "172", "192", "127", "8", "169", "100", "224", "198", "0"])), (i % 10 + 1).cast("int"))
    second = F.element_at(F.array(*map(F.lit, ["16", "168", "31", "254", "64", "0", "18", "51", "32"])), (i % 9 + 1).cast("int"))
    return t.base(spark, d, "customer").select(i.alias("id"), F.concat_ws(".", first, second, (i % 101).cast("string"), (i % 250).cast("string")).alias("ip"))


_ADDRESSES = """
  SELECT c_custkey AS id, ['10', '172', '192', '127', '8', '169', '100', '224', '198', '0'][c_custkey % 10 + 1] || '.' || ['16', '168', '31', '254', '64', '0', '18', '51', '32'][c_custkey % 9 + 1]
    || '.' || (c_custkey % 101) || '.' || (c_custkey % 250) AS ip FROM customer"""
_NUMBER = "(split_part(ip, '.', 1)::BIGINT << 24) + (split_part(ip, '.', 2)::BIGINT << 16) + (split_part(ip, '.', 3)::BIGINT << 8) + split_part(ip, '.', 4)::BIGINT"
_RANGES = ", ".join(f"({a.split('.')[0]}::BIGINT * 16777216 + {a.split('.')[1]} * 65536 + {a.split('.')[2]} * 256, {p})" for a, p in urls.BLOCKED_RANGES)


@query(sql(f"SELECT id, ip, EXISTS (SELECT 1 FROM (VALUES {_RANGES}) AS r(base, prefix) WHERE n >> (32 - prefix) = base >> (32 - prefix)) AS blocked FROM (SELECT *, {_NUMBER} AS n FROM a)", a=_ADDRESSES))
def cidr_blocked(spark, d):
    return _addresses(spark, d).select("id", "ip", urls.blocked_ip(F.col("ip")).alias("blocked"))


@query(sql("""SELECT id, url, CASE WHEN id % 5 = 0 THEN 'scheme' WHEN id % 5 = 1 THEN 'credentials' WHEN id % 5 = 2 THEN 'address' WHEN id % 5 = 3 THEN 'invalid' END AS refusal FROM (
  SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'ftp://h' || c_custkey || '.example/' WHEN 1 THEN 'https://u:p@h' || c_custkey || '.example/' WHEN 2 THEN 'http://127.0.0.' || (c_custkey % 250) || ':8080/x'
    WHEN 3 THEN 'no scheme ' || c_custkey ELSE 'https://h' || c_custkey || '.example/a?b#c' END AS url FROM customer)"""))  # fmt: skip
def url_safety(spark, d):
    i = F.col("c_custkey")
    n = i.cast("string")
    url = (
        F.when(i % 5 == 0, F.concat(F.lit("ftp://h"), n, F.lit(".example/"))).when(i % 5 == 1, F.concat(F.lit("https://u:p@h"), n, F.lit(".example/")))
        .when(i % 5 == 2, F.concat(F.lit("http://127.0.0."), (i % 250).cast("string"), F.lit(":8080/x"))).when(i % 5 == 3, F.concat(F.lit("no scheme "), n))
        .otherwise(F.concat(F.lit("https://h"), n, F.lit(".example/a?b#c")))
    )
    return t.base(spark, d, "customer").select(i.alias("id"), url.alias("url")).withColumn("refusal", urls.refusal(F.col("url")))


# --- events --------------------------------------------------------------------------------------


@query(sql("""SELECT lead_id, id, created_at, from_stage, to_stage FROM (
  SELECT lead_id, id, created_at, description AS to_stage, lag(description) OVER (PARTITION BY lead_id ORDER BY created_at, id) AS from_stage FROM lead_activities)
  WHERE from_stage <> to_stage""", "lead_activities"))  # fmt: skip
def stage_changes(spark, d):
    return mutations.stage_changes(t.lead_activities(spark, d), stage="description")


@query(sql("SELECT b.id, max(scanned_at) AS last_analyzed_at FROM businesses b LEFT JOIN website_scans s ON b.id = s.business_id GROUP BY 1", "businesses", "website_scans"))
def last_analyzed(spark, d):
    done = mutations.last_touched(t.website_scans(spark, d), "business_id", "scanned_at", "last_analyzed_at")
    b = t.businesses(spark, d).select("id")
    return b.join(done, b["id"] == done["business_id"], "left").select("id", "last_analyzed_at")


@query(sql("SELECT job_id, status, created_at FROM jobs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, id DESC) = 1", "jobs"))
def job_status_latest(spark, d):
    return latest(t.jobs(spark, d), "job_id", "created_at").select("job_id", "status", "created_at")


@query(sql("SELECT status, count(*) AS n FROM (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, id DESC) = 1) GROUP BY 1", "jobs"))
def job_status_counts(spark, d):
    return latest(t.jobs(spark, d), "job_id", "created_at").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


LIMITED = """WITH RECURSIVE c AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) AS at_us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (
  SELECT key, id, at_us, n, 1 AS calls, at_us + 86400000000 AS ends, TRUE AS allowed FROM c WHERE n = 1
  UNION ALL
  SELECT c.key, c.id, c.at_us, c.n, CASE WHEN c.at_us >= s.ends THEN 1 WHEN s.calls >= 3 THEN s.calls ELSE s.calls + 1 END,
    CASE WHEN c.at_us >= s.ends THEN c.at_us + 86400000000 ELSE s.ends END, c.at_us >= s.ends OR s.calls < 3
  FROM s JOIN c ON c.key = s.key AND c.n = s.n + 1)
SELECT key, id, at_us, allowed, CASE WHEN NOT allowed THEN (ends - at_us + 999999) // 1000000 END AS retry_after_s FROM s"""


def calls(spark: SparkSession, d: str) -> DataFrame:
    """Each event as a call of its user."""
    return t.base(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))


@query(LIMITED)
def rate_limited(spark, d):
    """Three calls a day for each user; windows open at the first call, and a refused call learns how long to wait."""
    return limited(calls(spark, d), 3, 86_400_000_000)


@query("SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def event_props(spark, d):
    """A value out of a semi-structured column."""
    return t.base(spark, d, "events").select(F.col("event_id").alias("id"), F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))
