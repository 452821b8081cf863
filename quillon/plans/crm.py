"""Lists, pipeline, indicators and cost reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import labels
from quillon.operators.latest import latest, with_latest
from quillon.operators.scoring import bucket
from quillon.plans.oracle import sql
from quillon.plans.registry import query
from quillon.schemas import STAGE_LABELS, STAGES
from quillon.sources import tables as t

# --- building blocks -----------------------------------------------------------------------------


def with_score(businesses: DataFrame, scores: DataFrame) -> DataFrame:
    """Businesses with their latest score as a struct, null where there is none."""
    return with_latest(businesses, scores, "business_id", "computed_at", "score")


def prospects(businesses: DataFrame, scores: DataFrame, sector: str | None = None, city: str | None = None, search: str | None = None, min_lead_score: int | None = None) -> DataFrame:
    """Filters that are absent or empty don't apply. Those on the business are applied before the join; a search is literal and folds case."""
    if sector:
        businesses = businesses.where(F.col("sector") == sector)
    if city:
        businesses = businesses.where(F.col("city") == city)
    if search:
        businesses = businesses.where(F.contains(F.lower("name"), F.lower(F.lit(search))))
    rows = with_score(businesses, scores)
    if min_lead_score is not None:
        rows = rows.where(lead_score() >= min_lead_score)
    return rows


def lead_score() -> Column:
    return F.coalesce(F.col("score.lead_score"), F.lit(0))


def stages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(zip(STAGES, STAGE_LABELS, strict=True))], "ord int, stage string, label string")


def by_stage(spark: SparkSession, leads: DataFrame) -> DataFrame:
    """A row for each of the stages: number of leads and sum of their estimates, exact in cents. Twelve rows at most are joined."""
    sums = leads.groupBy(F.col("stage").alias("s")).agg(F.count(F.lit(1)).alias("n_leads"), F.sum(F.round(F.coalesce("value_estimate", F.lit(0.0)) * 100).cast("long")).alias("cents"))
    return stages(spark).join(sums, F.col("stage") == F.col("s"), "left").select("ord", "stage", "label", F.coalesce("n_leads", F.lit(0)).alias("n_leads"), F.coalesce("cents", F.lit(0)).alias("value_cents"))


def named(rows: DataFrame, businesses: DataFrame) -> DataFrame:
    """Rows with the name of their business, a dash where there is none."""
    names = businesses.select(F.col("id").alias("__b"), F.col("name").alias("__name"))
    return rows.join(names, F.col("business_id") == F.col("__b"), "left").withColumn("business_name", F.coalesce("__name", F.lit(labels.NONE))).drop("__b", "__name")


def kpis(businesses: DataFrame, scores: DataFrame, scans: DataFrame, leads: DataFrame, demos: DataFrame, proposals: DataFrame, reports: DataFrame) -> DataFrame:
    """Eleven indicators in one row: one pass over each table, and a join of single rows."""
    count = lambda df, name, where=F.lit(True): df.agg(F.count_if(where).alias(name))
    found = count(businesses, "businesses_found").crossJoin(scans.agg(F.count_distinct("business_id").alias("businesses_analyzed")))
    own = latest(scores, "business_id", "computed_at")
    hot = own.agg(F.count_if(F.col("opportunity_score") >= 71).alias("new_opportunities"), F.count_if(F.col("lead_score") >= 71).alias("hot_leads"))
    cents = lambda c: F.coalesce(F.sum(F.round(F.coalesce(c, F.lit(0.0)) * 100).cast("long")), F.lit(0))
    won, lost = F.count_if(F.col("stage") == "WON"), F.count_if(F.col("stage") == "LOST")
    money = leads.agg(
        won.alias("clients_won"), cents("value_estimate").alias("potential_value_cents"), cents("value_won").alias("won_value_cents"),
        F.when(won + lost > 0, F.round(won / (won + lost) * 100).cast("long")).otherwise(F.lit(0).cast("long")).alias("conversion_rate"),
    )
    made = count(reports, "audits_generated").crossJoin(count(demos, "demos_generated")).crossJoin(count(proposals, "proposals_sent", F.col("status") == "sent"))
    return found.crossJoin(hot).crossJoin(money).crossJoin(made)


def costs(usage: DataFrame) -> DataFrame:
    return usage.groupBy("service", "operation").agg(F.count(F.lit(1)).alias("n"), F.sum("cost_units").alias("cost_units"))


def call_cost(model: Column, tokens_in: Column, tokens_out: Column, rates: dict[str, tuple[float, float]]) -> Column:
    """Estimated cost of a call by a table of USD per million tokens in and out; an unknown model costs nothing. Prices change, so there is no default table."""
    rate = lambda i: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for m, r in rates.items() for x in (m, r[i])]), model), F.lit(0.0))
    return tokens_in / F.lit(1e6) * rate(0) + tokens_out / F.lit(1e6) * rate(1)


def price(services: Column, pricing: dict[str, float]) -> Column:
    """Sum of the services' prices; those without a price count 0, and a total of 0 is none."""
    table = F.create_map(*[F.lit(x) for k, v in pricing.items() for x in (k, float(v))])
    return F.nullif(F.aggregate(services, F.lit(0.0), lambda total, s: total + F.coalesce(F.try_element_at(table, s), F.lit(0.0))), F.lit(0.0))


# --- prospects -----------------------------------------------------------------------------------

LISTED = ["id", "name", "sector", "city", "lead_score", "opportunity_score"]


def _listed(rows: DataFrame) -> DataFrame:
    return rows.select("id", "name", "sector", "city", lead_score().alias("lead_score"), F.col("score.opportunity_score").alias("opportunity_score"))


def _list_sql(where: str) -> str:
    return sql(
        f"""SELECT b.id, name, sector, city, coalesce(lead_score, 0) AS lead_score, opportunity_score
        FROM businesses b LEFT JOIN latest_scores s ON b.id = s.business_id WHERE {where}""",
        "businesses", "latest_scores",
    )


@query(sql("""SELECT b.id, name, coalesce(lead_score, 0) AS lead_score,
  CASE WHEN coalesce(lead_score, 0) >= 86 THEN 'Prioridad máxima' WHEN coalesce(lead_score, 0) >= 71 THEN 'Muy alta' WHEN coalesce(lead_score, 0) >= 51 THEN 'Alta'
    WHEN coalesce(lead_score, 0) >= 31 THEN 'Moderada' ELSE 'Baja' END AS bucket
  FROM businesses b LEFT JOIN latest_scores s ON b.id = s.business_id ORDER BY coalesce(lead_score, 0) DESC, b.id LIMIT 6""", "businesses", "latest_scores"))  # fmt: skip
def prospects_top(spark: SparkSession, d: str) -> DataFrame:
    """The six best prospects and their priority."""
    rows = prospects(t.businesses(spark, d), t.scores(spark, d)).select("id", "name", lead_score().alias("lead_score"))
    return rows.orderBy(F.desc("lead_score"), "id").limit(6).withColumn("bucket", bucket(F.col("lead_score")))


@query(_list_sql("sector = 'Hoteles' AND city = 'NATION_3'"))
def list_sector_city(spark, d):
    return _listed(prospects(t.businesses(spark, d), t.scores(spark, d), sector="Hoteles", city="NATION_3"))


@query(_list_sql("contains(lower(name), '#00000012')"))
def list_search(spark, d):
    return _listed(prospects(t.businesses(spark, d), t.scores(spark, d), search="#00000012"))


@query(_list_sql("coalesce(lead_score, 0) >= 71"))
def list_min_score(spark, d):
    return _listed(prospects(t.businesses(spark, d), t.scores(spark, d), min_lead_score=71))


@query(_list_sql("b.id = 42"))
def get_business(spark, d):
    return _listed(with_score(t.businesses(spark, d).where("id = 42"), t.scores(spark, d).where("business_id = 42")))


# --- latest rows ---------------------------------------------------------------------------------


@query(sql("SELECT * FROM latest_scores", "latest_scores"))
def latest_score(spark, d):
    return latest(t.scores(spark, d), "business_id", "computed_at")


@query(sql("SELECT id, business_id, scanned_at, https, title_length, server_response_time_ms::INTEGER AS server_response_time_ms FROM latest_scans", "latest_scans"))
def latest_scan(spark, d):
    return latest(t.website_scans(spark, d), "business_id", "scanned_at").select("id", "business_id", "scanned_at", "https", F.col("title_length").cast("long").alias("title_length"), "server_response_time_ms")


@query(sql("SELECT * FROM latest_reports", "latest_reports"))
def latest_report(spark, d):
    return latest(t.ai_reports(spark, d), "business_id", "generated_at")


@query(sql("SELECT id, business_id, array_to_string(services, ',') AS services, status, created_at FROM latest_proposals", "latest_proposals"))
def latest_proposal(spark, d):
    return latest(t.proposals(spark, d), "business_id", "created_at").withColumn("services", F.array_join("services", ","))


@query(sql("SELECT * FROM latest_demos", "latest_demos"))
def latest_demo(spark, d):
    return latest(t.demos(spark, d), "business_id", "created_at")


# --- lists ---------------------------------------------------------------------------------------


@query(sql("SELECT * FROM jobs ORDER BY created_at DESC, id DESC LIMIT 10", "jobs"))
def recent_jobs(spark, d):
    return t.jobs(spark, d).orderBy(F.desc("created_at"), F.desc("id")).limit(10)


@query(sql("SELECT * FROM lead_activities ORDER BY lead_id, created_at DESC, id", "lead_activities"))
def activities_list(spark, d, lead_id=None):
    """The activities of every lead, or of one, latest first."""
    rows = t.lead_activities(spark, d)
    if lead_id is not None:
        rows = rows.where(F.col("lead_id") == lead_id)
    return rows.orderBy("lead_id", F.desc("created_at"), "id")


@query(sql("SELECT * FROM lead_activities WHERE lead_id = 42 ORDER BY created_at DESC, id DESC", "lead_activities"))
def activities_by_lead(spark, d):
    return activities_list(spark, d, lead_id=42).orderBy(F.desc("created_at"), F.desc("id"))


@query(sql("SELECT id, business_id, status, created_at FROM proposals ORDER BY created_at DESC, id DESC", "proposals"))
def proposals_list(spark, d):
    return t.proposals(spark, d).select("id", "business_id", "status", "created_at").orderBy(F.desc("created_at"), F.desc("id"))


@query(sql("SELECT * FROM demos ORDER BY created_at DESC, id DESC", "demos"))
def demos_list(spark, d):
    return t.demos(spark, d).orderBy(F.desc("created_at"), F.desc("id"))


@query(sql("SELECT * FROM api_usage ORDER BY created_at DESC, id DESC", "api_usage"))
def usage_list(spark, d):
    return t.api_usage(spark, d).orderBy(F.desc("created_at"), F.desc("id"))


@query(sql("SELECT l.id, l.stage, coalesce(b.name, '—') AS business_name FROM leads l LEFT JOIN (SELECT * FROM businesses WHERE owner_id <> 1) b ON l.business_id = b.id", "leads", "businesses"))
def leads_named(spark, d):
    return named(t.leads(spark, d), t.businesses(spark, d).where("owner_id <> 1")).select("id", "stage", "business_name")


@query(sql("SELECT p.id, p.status, coalesce(b.name, '—') AS business_name FROM proposals p LEFT JOIN (SELECT * FROM businesses WHERE owner_id <> 1) b ON p.business_id = b.id", "proposals", "businesses"))
def proposals_named(spark, d):
    return named(t.proposals(spark, d), t.businesses(spark, d).where("owner_id <> 1")).select("id", "status", "business_name")


@query(sql("SELECT d.id, d.status, coalesce(b.name, '—') AS business_name, json_extract_string(d.content, '$.copy.headline') AS headline FROM demos d LEFT JOIN (SELECT * FROM businesses WHERE owner_id <> 1) b ON d.business_id = b.id", "demos", "businesses"))
def demos_named(spark, d):
    rows = named(t.demos(spark, d), t.businesses(spark, d).where("owner_id <> 1"))
    return rows.select("id", "status", "business_name", F.get_json_object("content", "$.copy.headline").alias("headline"))


# --- pipeline ------------------------------------------------------------------------------------


@query(sql("SELECT s.ord, s.stage, l.id AS lead_id, l.business_id FROM stages s LEFT JOIN leads l ON s.stage = l.stage", "stages", "leads"))
def leads_by_stage(spark, d):
    """A row for each lead, and one without lead for each stage that has none.

    Groups may be of any size, so leads are never shuffled by stage: the twelve
    stages are broadcast to them, and those without a lead are added.
    """
    leads = t.leads(spark, d).select(F.col("id").alias("lead_id"), "business_id", F.col("stage").alias("s"))
    held = leads.join(F.broadcast(stages(spark)), F.col("stage") == F.col("s")).select("ord", "stage", "lead_id", "business_id")
    bare = stages(spark).join(F.broadcast(leads.where(F.col("s").isin(STAGES)).select("s").distinct()), F.col("stage") == F.col("s"), "left_anti")
    return held.unionByName(bare.select("ord", "stage"), allowMissingColumns=True)


_BY_STAGE = """SELECT s.ord, s.stage, s.label, count(l.id) AS n_leads, CAST(coalesce(sum(CAST(round(l.value_estimate * 100) AS BIGINT)), 0) AS BIGINT) AS value_cents
  FROM stages s LEFT JOIN leads l ON s.stage = l.stage GROUP BY 1, 2, 3"""


@query(sql(_BY_STAGE, "stages", "leads"))
def pipeline_totals(spark, d):
    return by_stage(spark, t.leads(spark, d)).orderBy("ord")


@query(sql("SELECT ord, stage, n_leads, n_leads / greatest(1, max(n_leads) OVER ()) * 100 AS share FROM g", "stages", "leads", g=_BY_STAGE))
def pipeline_share(spark, d):
    """Width of a bar in hundredths of the longest."""
    rows = by_stage(spark, t.leads(spark, d))
    most = rows.agg(F.greatest(F.lit(1), F.max("n_leads")).alias("most"))
    return rows.crossJoin(F.broadcast(most)).select("ord", "stage", "n_leads", (F.col("n_leads") / F.col("most") * 100).alias("share"))


@query(sql("""SELECT (SELECT count(*) FROM businesses) AS businesses_found, (SELECT count(DISTINCT business_id) FROM website_scans) AS businesses_analyzed,
  (SELECT count(*) FROM latest_scores WHERE opportunity_score >= 71) AS new_opportunities, (SELECT count(*) FROM latest_scores WHERE lead_score >= 71) AS hot_leads,
  (SELECT count(*) FROM leads WHERE stage = 'WON') AS clients_won,
  (SELECT CAST(sum(CAST(round(coalesce(value_estimate, 0) * 100) AS BIGINT)) AS BIGINT) FROM leads) AS potential_value_cents,
  (SELECT CAST(sum(CAST(round(coalesce(value_won, 0) * 100) AS BIGINT)) AS BIGINT) FROM leads) AS won_value_cents,
  (SELECT CASE WHEN count(*) = 0 THEN 0 ELSE CAST(round(count(*) FILTER (WHERE stage = 'WON') / count(*) * 100) AS BIGINT) END FROM leads WHERE stage IN ('WON', 'LOST')) AS conversion_rate,
  (SELECT count(*) FROM ai_reports) AS audits_generated, (SELECT count(*) FROM demos) AS demos_generated, (SELECT count(*) FROM proposals WHERE status = 'sent') AS proposals_sent
  """, "businesses", "website_scans", "latest_scores", "leads", "ai_reports", "demos", "proposals"))  # fmt: skip
def kpi_dashboard(spark, d):
    return kpis(t.businesses(spark, d), t.scores(spark, d), t.website_scans(spark, d), t.leads(spark, d), t.demos(spark, d), t.proposals(spark, d), t.ai_reports(spark, d))


# --- costs ---------------------------------------------------------------------------------------


@query(sql("SELECT service || ':' || operation AS key, count(*) AS n, CAST(sum(cost_units) AS BIGINT) AS cost_units FROM api_usage GROUP BY 1", "api_usage"))
def cost_by_operation(spark, d):
    return costs(t.api_usage(spark, d)).select(F.concat_ws(":", "service", "operation").alias("key"), "n", "cost_units")


@query(sql("""SELECT total AS total_units, n_leads, n_won, n_audits, CASE WHEN n_leads > 0 THEN total / n_leads ELSE 0 END AS per_lead,
  CASE WHEN n_audits > 0 THEN total / n_audits END AS per_audit, CASE WHEN n_won > 0 THEN total / n_won ELSE 0 END AS per_client FROM (
  SELECT (SELECT CAST(sum(cost_units) AS BIGINT) FROM api_usage) AS total, (SELECT count(*) FROM leads) AS n_leads,
    (SELECT count(*) FROM leads WHERE stage = 'WON') AS n_won, (SELECT count(*) FROM ai_reports) AS n_audits)""", "api_usage", "leads", "ai_reports"))  # fmt: skip
def cost_unit_economics(spark, d):
    total = t.api_usage(spark, d).agg(F.coalesce(F.sum("cost_units"), F.lit(0)).alias("total_units"))
    leads = t.leads(spark, d).agg(F.count(F.lit(1)).alias("n_leads"), F.count_if(F.col("stage") == "WON").alias("n_won"))
    one = total.crossJoin(leads).crossJoin(t.ai_reports(spark, d).agg(F.count(F.lit(1)).alias("n_audits")))
    per = lambda n: F.when(F.col(n) > 0, F.col("total_units") / F.col(n))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return one.select("*", zero(per("n_leads")).alias("per_lead"), per("n_audits").alias("per_audit"), zero(per("n_won")).alias("per_client"))


@query(sql("""SELECT r.id, input_tokens + output_tokens AS units, input_tokens / 1e6::DOUBLE * coalesce(i, 0) + output_tokens / 1e6::DOUBLE * coalesce(o, 0) AS cost_usd
  FROM ai_reports r LEFT JOIN (VALUES ('standard', 2::DOUBLE, 10::DOUBLE), ('large', 5::DOUBLE, 25::DOUBLE), ('small', 1::DOUBLE, 5::DOUBLE)) AS m(name, i, o) ON r.model = m.name""", "ai_reports"))  # fmt: skip
def cost_per_call(spark, d):
    rows = t.ai_reports(spark, d)
    return rows.select("id", (F.col("input_tokens") + F.col("output_tokens")).alias("units"), call_cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens"), t.TEST_RATES).alias("cost_usd"))


@query(sql("""SELECT p.id, CASE WHEN coalesce(sum(price), 0) = 0 THEN NULL ELSE CAST(sum(price) AS DOUBLE) END AS price_total
  FROM (SELECT id, unnest(services) AS s FROM proposals) p LEFT JOIN prices ON s = service GROUP BY 1""", "proposals", "prices"))  # fmt: skip
def proposal_price(spark, d):
    return t.proposals(spark, d).select("id", price(F.col("services"), t.TEST_PRICING).alias("price_total"))


# --- one business --------------------------------------------------------------------------------


@query(sql("""SELECT b.id, b.name, sc.id AS scan_id, r.id AS report_id, s.lead_score, l.stage, p.id AS proposal_id, d.id AS demo_id, coalesce(a.n, 0) AS n_activities, a.last_at AS last_activity_at
  FROM businesses b LEFT JOIN latest_scans sc ON b.id = sc.business_id LEFT JOIN latest_reports r ON b.id = r.business_id LEFT JOIN latest_scores s ON b.id = s.business_id
  LEFT JOIN leads l ON b.id = l.business_id LEFT JOIN latest_proposals p ON b.id = p.business_id LEFT JOIN latest_demos d ON b.id = d.business_id
  LEFT JOIN (SELECT lead_id, count(*) AS n, max(created_at) AS last_at FROM lead_activities GROUP BY 1) a ON l.id = a.lead_id""",
  "businesses", "latest_scans", "latest_reports", "latest_scores", "leads", "latest_proposals", "latest_demos", "lead_activities"))
def business_360(spark, d):
    """Each business with all that is latest about it. Activities, of which there may be any number, come as count and last; activities_list lists them."""
    rows = t.businesses(spark, d).select("id", "name")
    for name, history, at in (
        ("scan", t.website_scans(spark, d), "scanned_at"), ("report", t.ai_reports(spark, d), "generated_at"), ("score", t.scores(spark, d), "computed_at"),
        ("proposal", t.proposals(spark, d).drop("services"), "created_at"), ("demo", t.demos(spark, d), "created_at"),
    ):
        rows = with_latest(rows, history, "business_id", at, name)
    leads = t.leads(spark, d).select(F.col("id").alias("lead_id"), "business_id", "stage")
    rows = rows.join(leads, rows["id"] == leads["business_id"], "left")
    done = t.lead_activities(spark, d).groupBy(F.col("lead_id").alias("of")).agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last_activity_at"))
    rows = rows.join(done, F.col("lead_id") == F.col("of"), "left")
    return rows.select(
        "id", "name", F.col("scan.id").alias("scan_id"), F.col("report.id").alias("report_id"), F.col("score.lead_score").alias("lead_score"), "stage",
        F.col("proposal.id").alias("proposal_id"), F.col("demo.id").alias("demo_id"), F.coalesce("n", F.lit(0)).alias("n_activities"), "last_activity_at",
    )


# --- labels --------------------------------------------------------------------------------------


@query(sql("SELECT id, coalesce(nullif(concat_ws(' · ', nullif(category, ''), nullif(city, ''), nullif(CASE WHEN id % 4 <> 0 THEN country END, '')), ''), 'Sin datos de ubicación') AS location FROM businesses", "businesses"))
def labels_location(spark, d):
    return t.businesses(spark, d).select("id", labels.location(F.col("category"), F.col("city"), F.when(F.col("id") % 4 != 0, F.col("country"))).alias("location"))


@query(sql("""SELECT id, CASE WHEN coalesce(rating, 0) <> 0 THEN format('{:.1f}', rating) || ' (' || coalesce(review_count, 0) || ')' ELSE '—' END AS rating,
  CASE WHEN coalesce(website_url, '') <> '' THEN 'Sí' ELSE 'Sin web' END AS website FROM businesses""", "businesses"))  # fmt: skip
def labels_rating(spark, d):
    return t.businesses(spark, d).select("id", labels.rating(F.col("rating"), F.col("review_count")).alias("rating"), labels.website(F.col("website_url")).alias("website"))


@query(sql("SELECT id, progress_current || '/' || coalesce(CAST(nullif(progress_total, 0) AS VARCHAR), '?') AS progress FROM jobs", "jobs"))
def labels_progress(spark, d):
    return t.jobs(spark, d).select("id", labels.progress(F.col("progress_current"), F.col("progress_total")).alias("progress"))


@query(sql("""SELECT id, CASE WHEN t0 IS NULL THEN 'Sin analizar' WHEN h < 1 THEN 'Hace instantes' WHEN h < 24 THEN 'Hace ' || h || 'h' ELSE 'Hace ' || CAST(round(h / 24) AS BIGINT) || 'd' END AS age
  FROM (SELECT id, t0, CAST(round((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(t0)) / 3600000000) AS BIGINT) AS h
    FROM (SELECT id, CASE WHEN id % 10 <> 0 THEN created_at END AS t0 FROM jobs))""", "jobs"))  # fmt: skip
def relative_age(spark, d):
    at = F.when(F.col("id") % 10 != 0, F.col("created_at"))
    return t.jobs(spark, d).select("id", labels.relative_age(at, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).alias("age"))


@query(sql("""SELECT id, unnest(['server response time ms', 'lighthouse performance score']) AS label, unnest([CAST(server_response_time_ms AS VARCHAR), CAST(lighthouse_performance_score AS VARCHAR)]) AS value
  FROM website_scans""", "website_scans"))  # fmt: skip
def scan_entries(spark, d):
    """Entries of a scan's measures, without private ones, under readable names."""
    measures = F.create_map(
        F.lit("server_response_time_ms"), F.col("server_response_time_ms").cast("string"), F.lit("lighthouse_performance_score"), F.col("lighthouse_performance_score").cast("string"),
        F.lit("_note"), F.lit("proxy"),
    )
    shown = F.map_filter(measures, lambda k, _: ~k.startswith("_"))
    return t.website_scans(spark, d).select("id", F.explode(shown).alias("label", "value")).withColumn("label", F.replace("label", F.lit("_"), F.lit(" ")))


@query(sql("""SELECT d.id, b.name, b.city, b.website_url, b.rating, b.review_count, json_extract_string(d.content, '$.copy.headline') AS headline
  FROM latest_demos d JOIN businesses b ON d.business_id = b.id""", "latest_demos", "businesses"))  # fmt: skip
def demo_content(spark, d):
    """Content of demos: what the business says of itself, verbatim, around stored copy."""
    own = latest(t.demos(spark, d), "business_id", "created_at").select(F.col("id").alias("demo_id"), "business_id", "content")
    b = t.businesses(spark, d)
    rows = own.join(b, own["business_id"] == b["id"])
    built = rows.select("demo_id", demo_struct().alias("c"))
    return built.select(F.col("demo_id").alias("id"), "c.business.name", "c.business.city", "c.business.website_url", "c.reviews.rating", "c.reviews.review_count", "c.copy.headline")


def demo_struct() -> Column:
    return F.struct(
        F.struct(F.get_json_object("content", "$.copy.headline").alias("headline")).alias("copy"),
        F.struct("name", "category", "city", "phone", "website_url").alias("business"), F.struct("rating", "review_count").alias("reviews"),
        F.lit(True).alias("gallery_placeholder"), F.lit(True).alias("testimonials_placeholder"),
    )
