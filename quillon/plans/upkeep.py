"""Tables that change: updates, relations kept up to date, and what is written from and read out of records."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.config import PREFIX, source
from quillon.functions import payloads
from quillon.operators import commit_log, incremental, mutations, search
from quillon.operators.cuts import shared_path
from quillon.plans import crm, intake
from quillon.plans.oracle import sql
from quillon.plans.registry import query
from quillon.schemas import OUTREACH_OUTPUT
from quillon.sources import csv_import, pages
from quillon.sources import tables as t
from quillon.streaming import in_order

# --- updates -------------------------------------------------------------------------------------


@query(sql("""SELECT id, name, CASE WHEN id BETWEEN 100 AND 140 AND id % 3 <> 0 THEN CASE WHEN id % 2 = 0 THEN 'moved' END ELSE city END AS city,
  id BETWEEN 100 AND 140 AND id % 3 <> 0 AS touched FROM businesses""", "businesses"))  # fmt: skip
def rows_updated(spark: SparkSession, d: str) -> DataFrame:
    """Some businesses with another city or none: files without such rows stay as they are."""
    table = shared_path(spark, "businesses")
    rows = t.businesses(spark, d).select("id", "name", "city", F.lit("2001-01-01 00:00:00").cast("timestamp").alias("updated_at"))
    commit_log.commit(spark, table, "load", lambda was: (rows.repartitionByRange(20, "id"), [], dict))
    patches = rows.where("id between 100 and 140 and id % 3 <> 0").select("id", F.when(F.col("id") % 2 == 0, "moved").alias("city"))
    for _ in range(2):  # the second time it is done already
        commit_log.update(spark, table, rows.schema, "move", patches)
    return commit_log.read(spark, table, rows.schema).select("id", "name", "city", (F.col("updated_at") > "2001-01-02").alias("touched"))


# --- latest, kept up to date ---------------------------------------------------------------------


def _kept(spark: SparkSession, rows: DataFrame, at: str) -> DataFrame:
    """Half of the rows, then the other half, then the first half again, which counts once."""
    path = shared_path(spark, "latest")
    for job, part in (("even", 0), ("odd", 1), ("even", 0)):
        incremental.add(spark, path, job, rows.where(F.col("id") % 2 == part), "business_id", at)
    return incremental.current(spark, path)


@query(sql("SELECT * FROM latest_scores", "latest_scores"))
def latest_score_kept(spark, d):
    return _kept(spark, t.scores(spark, d), "computed_at")


@query(sql("SELECT id, business_id, scanned_at, https, title_length FROM latest_scans", "latest_scans"))
def latest_scan_kept(spark, d):
    return _kept(spark, t.website_scans(spark, d), "scanned_at").select("id", "business_id", "scanned_at", "https", F.col("title_length").cast("long").alias("title_length"))


@query(sql("SELECT id, business_id, model, generated_at FROM latest_reports", "latest_reports"))
def latest_report_kept(spark, d):
    return _kept(spark, t.ai_reports(spark, d), "generated_at").select("id", "business_id", "model", "generated_at")


@query(sql("SELECT id, business_id, array_to_string(services, ',') AS services, status, created_at FROM latest_proposals", "latest_proposals"))
def latest_proposal_kept(spark, d):
    return _kept(spark, t.proposals(spark, d), "created_at").select("id", "business_id", F.array_join("services", ",").alias("services"), "status", "created_at")


@query(sql("SELECT id, business_id, status, created_at FROM latest_demos", "latest_demos"))
def latest_demo_kept(spark, d):
    return _kept(spark, t.demos(spark, d), "created_at").select("id", "business_id", "status", "created_at")


# --- sources -------------------------------------------------------------------------------------


@query(sql("SELECT 'own' AS seen, id, name FROM businesses WHERE owner_id = 2 UNION ALL SELECT 'examples', id, name FROM businesses", "businesses"))
def source_chosen(spark, d):
    """The rows of the owner that a session names, and the examples where it names none."""
    out = []
    for seen, given in (("own", {"data": d, "owner": "2"}), ("examples", {"data": d, "owner": " ", "examples": d})):
        for k, v in given.items():
            spark.conf.set(PREFIX + k, v)
        try:
            out.append(source(spark).relation(spark, "businesses").select(F.lit(seen).alias("seen"), "id", "name"))
        finally:
            for k in given:
                spark.conf.unset(PREFIX + k)
    return out[0].unionByName(out[1])


@query("""SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN page_id % 7 = 0 THEN 'timeout' END AS error,
  CASE WHEN page_id % 7 <> 0 THEN CAST(page_id * 53 % 3000 AS INTEGER) END AS server_response_time_ms, CASE WHEN page_id % 7 <> 0 AND page_id % 4 < 2 THEN CAST(CASE WHEN page_id % 4 = 0 THEN page_id % 101 ELSE 0 END AS INTEGER) END AS lighthouse_performance_score,
  CASE WHEN page_id % 7 <> 0 THEN strlen(html)::INTEGER END AS html_size_bytes, CASE WHEN page_id % 7 = 0 OR page_id % 4 < 2 THEN '' WHEN page_id % 4 = 2 THEN 'pagespeed_lighthouse_score' ELSE 'lighthouse_performance_score' END AS unscored FROM pages""")
def html_times_and_failures(spark, d):
    """Scans with response times, pages that could not be fetched, and scores out of stored answers: some without a number, some calls failed, some pages not asked about."""
    i = F.col("page_id")
    own = t.base(spark, d, "pages").withColumn("error", F.when(i % 7 == 0, "timeout")).withColumn("server_response_time_ms", i * 53 % 3000)
    answer = F.when(i % 4 == 0, F.format_string('{"lighthouseResult":{"categories":{"performance":{"score":%.2f}}}}', i % 101 / 100)).when(i % 4 == 1, '{"lighthouseResult":{}}')
    rows = pages.scan(pages.with_answers(own, own.where(i % 4 != 3).select("page_id", answer.alias("answer"))))
    rest = F.array_join(F.array_except("unavailable_metrics", F.array(*map(F.lit, pages.UNAVAILABLE))), ",")
    return rows.select("page_id", "status", "error", "server_response_time_ms", "lighthouse_performance_score", "html_size_bytes", rest.alias("unscored"))


@query("""WITH l AS (SELECT c_custkey + 2 AS row, c_custkey % 6 AS kind FROM customer)
SELECT row, 'Número de campos no válido' AS message FROM l WHERE kind IN (1, 2) UNION ALL SELECT row, 'El nombre del negocio es obligatorio' FROM l WHERE kind IN (2, 3)""")
def import_all_errors(spark, d):
    """Rows with too few or too many fields next to those that fail a rule; a row may do both."""
    i = F.col("c_custkey")
    name = F.concat(F.lit("N"), i.cast("string"))
    line = F.when(i % 6 == 1, name).when(i % 6 == 2, F.concat(F.lit(",x,"), name)).when(i % 6 == 3, ",y").otherwise(F.concat(name, F.lit(",z")))
    folder, parts = shared_path(spark, "import-csv"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = t.base(spark, d, "customer").select(i, line.alias("name,city")).repartitionByRange(parts, "c_custkey").sortWithinPartitions("c_custkey")
    rows.select("name,city").write.csv(folder, header=True, sep="\x01")  # lines as they are
    return csv_import.validated(csv_import.resolved(csv_import.read_csv(spark, folder, most_bytes=None)))[1]


# --- texts for and from language models ----------------------------------------------------------


@query(sql("""SELECT id, CAST(json_object('name', name, 'category', category, 'city', city) AS VARCHAR) AS proposal, CAST(json_object('name', name, 'category', category, 'city', city) AS VARCHAR) AS outreach,
  CAST(json_object('name', name, 'category', category, 'sector', sector, 'city', city, 'address', NULL::VARCHAR, 'phone', phone, 'rating', rating, 'review_count', review_count) AS VARCHAR) AS demo FROM businesses""", "businesses"))  # fmt: skip
def text_payloads(spark, d):
    """What proposals, messages and demos are written from, as JSON."""
    rows = t.businesses(spark, d).withColumn("address", F.lit(None).cast("string"))
    return rows.select("id", payloads.payload(payloads.PROPOSAL).alias("proposal"), payloads.payload(payloads.OUTREACH).alias("outreach"), payloads.payload(payloads.DEMO).alias("demo"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'S' || o_orderkey END AS subject, CASE WHEN o_orderkey % 5 = 0 THEN 'B' || o_custkey END AS body FROM orders""")
def structured_outputs(spark, d):
    """Answers as records: whole ones only; some lack a field, have one too many, a null, or are no JSON."""
    i, n, m = F.col("o_orderkey"), F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    head = F.concat(F.lit('{"subject":"S'), n, F.lit('"'))
    whole = F.concat(head, F.lit(',"body":"B'), m, F.lit('"'))
    answer = F.when(i % 5 == 0, F.concat(whole, F.lit("}"))).when(i % 5 == 1, F.concat(head, F.lit("}"))).when(i % 5 == 2, F.concat(whole, F.lit(',"more":1}'))).when(i % 5 == 3, F.concat(head, F.lit(',"body":null}'))).otherwise(n)
    rows = t.base(spark, d, "orders").select(i.alias("id"), payloads.structured(answer, OUTREACH_OUTPUT).alias("o"))
    return rows.select("id", "o.subject", "o.body")


# --- references and next to each other -----------------------------------------------------------


@query(sql("SELECT id, business_id FROM competitors c WHERE business_id * 7 NOT IN (SELECT id FROM businesses)", "competitors", "businesses"))
def orphaned(spark, d):
    """Rows that refer to a business that isn't there."""
    rows = t.competitors(spark, d).select("id", "business_id", (F.col("business_id") * 7).alias("to"))
    return mutations.orphans(rows, t.businesses(spark, d), "to").select("id", "business_id")


@query(sql("""SELECT id, CASE WHEN id % 3 <> 0 THEN 'call ' || id END AS action, CASE WHEN id % 4 = 1 THEN DATE '2026-01-02' END AS due, id % 3 <> 0 AS noted FROM leads""", "leads"))
def follow_ups(spark, d):
    """What is to be done next for each lead, and whether that is noted: blanks are none, as are dates that are none."""
    i = F.col("id")
    action = F.when(i % 3 == 0, "  ").otherwise(F.concat(F.lit(" call "), i.cast("string"), F.lit(" ")))
    date = F.when(i % 4 == 1, "2026-01-02").when(i % 4 == 2, "soon").otherwise("")
    own, due, note = mutations.follow_up(i, action, date)
    return t.leads(spark, d).select("id", own.alias("action"), due.alias("due"), note.isNotNull().alias("noted"))


@query(sql("""SELECT b.id, b.name, s.lead_score, l.stage, a.id AS activity_id, a.type, a.created_at FROM businesses b LEFT JOIN latest_scores s ON b.id = s.business_id
  JOIN leads l ON b.id = l.business_id JOIN lead_activities a ON l.id = a.lead_id""", "businesses", "latest_scores", "leads", "lead_activities"))  # fmt: skip
def business_activities(spark, d):
    """Each activity next to the record of its business, however many a business has."""
    rows = crm.with_score(t.businesses(spark, d).select("id", "name"), t.scores(spark, d)).select(F.col("id").alias("of"), "name", F.col("score.lead_score").alias("lead_score"))
    leads = t.leads(spark, d).select(F.col("id").alias("lead"), "business_id", "stage").join(rows, F.col("business_id") == F.col("of"))
    done = t.lead_activities(spark, d).select(F.col("id").alias("activity_id"), "lead_id", "type", "created_at")
    return done.join(leads, F.col("lead_id") == F.col("lead")).select(F.col("of").alias("id"), "name", "lead_score", "stage", "activity_id", "type", "created_at")


# --- streams -------------------------------------------------------------------------------------

_FAR = 4_000 * 86_400_000_000


def _streamed(spark: SparkSession, rows: DataFrame, key: str, build) -> DataFrame:
    """What a stream makes of the rows when they arrive in no order, three files one after the other, and a last row lets all others pass."""
    folder, out, state = (shared_path(spark, n) for n in ("arrivals", "stream", "stream-state"))
    rows.repartition(3, F.xxhash64("id")).write.parquet(folder)
    # No row is later than the newest by so much; the last one is.
    last = rows.agg((F.max("at_us") + _FAR).alias("at_us"))
    end = last.select(*[F.col("at_us") if c == "at_us" else F.lit(-1 if c in ("id", key) else None).cast(kind).alias(c) for c, kind in rows.dtypes])
    end.write.mode("append").parquet(folder)
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", in_order.STORE)
    try:
        stream = build(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder))
        done = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        done.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    return spark.read.schema(stream.schema).parquet(out).where("id <> -1")


@query(intake.LIMITED.replace("SELECT user_id AS key", "SELECT CAST(user_id AS VARCHAR) AS key"))
def rate_limited_stream(spark, d):
    """The limiter on a stream says what it says of the batch."""
    rows = intake.calls(spark, d).withColumn("key", F.col("key").cast("string"))
    return _streamed(spark, rows, "key", lambda s: in_order.limited(s, 3, 86_400_000_000, late="2000 days"))


@query(sql("""SELECT lead_id, id, epoch_us(created_at) AS at_us, from_stage, to_stage FROM (
  SELECT lead_id, id, created_at, description AS to_stage, lag(description) OVER (PARTITION BY lead_id ORDER BY created_at, id) AS from_stage FROM lead_activities)
  WHERE from_stage <> to_stage""", "lead_activities"))  # fmt: skip
def stage_changes_stream(spark, d):
    """Changes of stage out of a stream."""
    rows = t.lead_activities(spark, d).select("lead_id", "id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at_us"), F.col("description").alias("stage"))
    return _streamed(spark, rows, "lead_id", lambda s: in_order.stage_changes(s, late="2000 days", idle_us=_FAR))


# --- search --------------------------------------------------------------------------------------


@query(sql("""SELECT 'r#0000001' AS term, id, name FROM businesses WHERE contains(lower(name), 'r#0000001') UNION ALL SELECT 'MER#%1_3', id, name FROM businesses WHERE name ILIKE '%MER#%1_3%'
  UNION ALL SELECT '7', id, name FROM businesses WHERE contains(lower(name), '7') UNION ALL SELECT '#%9', id, name FROM businesses WHERE contains(lower(name), '#%9')""", "businesses"))  # fmt: skip
def search_indexed(spark, d):
    """Names that contain a term, with and without wildcards, by the trigram index; a term of one letter looks through all."""
    path = shared_path(spark, "search")
    search.build(spark, path, t.businesses(spark, d).select("id", "name"))
    out = [search.search(spark, path, term, wild).select(F.lit(term).alias("term"), "id", "name") for term, wild in (("r#0000001", False), ("MER#%1_3", True), ("7", False), ("#%9", False))]
    return functools.reduce(DataFrame.unionByName, out)
