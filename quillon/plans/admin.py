"""Settings, websites, payloads and the cost report."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import labels, payloads
from quillon.operators import mutations, scoring
from quillon.operators.settings import ensured, weights, with_settings
from quillon.plans import crm, scores
from quillon.plans.oracle import sql
from quillon.plans.registry import query
from quillon.schemas import LEAD_WEIGHTS, OPPORTUNITY_WEIGHTS
from quillon.sources import tables as t

_PRICED = t.TEST_PRICING


def _settings(spark, d):
    return ensured(t.settings(spark, d), t.businesses(spark, d))


@query("""SELECT o AS owner_id, CASE WHEN o = 1 THEN 'First' ELSE 'My Agency' END AS agency_name, CAST(CASE WHEN o = 1 THEN 5 ELSE 0 END AS INTEGER) AS n_prices, CAST(0 AS INTEGER) AS n_sectors,
  CAST(CASE WHEN o = 1 THEN 0.25 ELSE 0.2 END AS DOUBLE) AS seo_weight, CAST(CASE WHEN o = 1 THEN 0.5 ELSE 0.35 END AS DOUBLE) AS opportunity_weight, TRUE AS stamped
  FROM (SELECT DISTINCT c_custkey % 3 AS o FROM customer)""")  # fmt: skip
def settings_ensured(spark, d):
    """A row for every owner: their own, or the defaults."""
    return _settings(spark, d).select(
        "owner_id", "agency_name", F.size("pricing").alias("n_prices"), F.size("sectors").alias("n_sectors"), F.col("scoring_weights.opportunity.seo").alias("seo_weight"),
        F.col("scoring_weights.lead_score.opportunity").alias("opportunity_weight"), (F.col("created_at").isNotNull() & F.col("updated_at").isNotNull()).alias("stamped"),
    )


@query(sql("""SELECT p.id, CASE WHEN max(owner_id) = 1 AND coalesce(sum(price), 0) > 0 THEN CAST(sum(price) * 2 AS DOUBLE) END AS price_total
  FROM (SELECT p.id, b.owner_id, unnest(services) AS s FROM proposals p JOIN businesses b ON p.business_id = b.id) p LEFT JOIN prices ON s = service GROUP BY 1""", "proposals", "businesses", "prices"))  # fmt: skip
def proposal_price_by_owner(spark, d):
    """Proposals at the prices in their owner's settings."""
    owners = t.businesses(spark, d).select(F.col("id").alias("b"), "owner_id")
    rows = t.proposals(spark, d).join(owners, F.col("business_id") == F.col("b"))
    rows = with_settings(rows, _settings(spark, d), "pricing")
    total = F.aggregate("services", F.lit(0.0), lambda a, s: a + F.coalesce(F.try_element_at(F.col("settings.pricing"), s), F.lit(0.0)))
    return rows.select("id", F.nullif(total, F.lit(0.0)).alias("price_total"))


def _weighed(part: str, names: dict[str, str]) -> str:
    own, default = t.TEST_WEIGHTS[part], OPPORTUNITY_WEIGHTS if part == "opportunity" else LEAD_WEIGHTS
    sums = [" + ".join(f"{w[n]}::DOUBLE * {names[n]}" for n in default) for w in (own, default)]
    return f"CAST(round(least(100, greatest(0, CASE WHEN owner_id = 1 THEN {sums[0]} ELSE {sums[1]} END))) AS BIGINT)"


@query(scores.with_led(f"""SELECT id, o AS opportunity_score, {_weighed('lead_score', {'opportunity': 'o', 'buying_intent': 'buying_intent_score', 'business_value': 'business_value', 'competitive_gap': '50.0'})} AS lead_score
  FROM (SELECT led.*, {_weighed('opportunity', {n: 'v_' + n for n in OPPORTUNITY_WEIGHTS})} AS o FROM led)"""))  # fmt: skip
def score_by_owner(spark, d):
    """Scores by the weights in each owner's settings."""
    rows = with_settings(scoring.scoring_input(t.businesses(spark, d), t.website_scans(spark, d)), _settings(spark, d), "scoring_weights")
    return scoring.score(rows, weights("opportunity"), weights("lead_score")).select("id", "opportunity_score", "lead_score")


@query(sql("""SELECT id AS business_id, website_url AS url, id % 4 <> 1 AS created FROM businesses WHERE website_url IS NOT NULL""", "businesses"))
def website_rows(spark, d):
    """The websites there are, and those that are created for businesses without one."""
    there = t.websites(spark, d)
    own = there.select(F.col("business_id").alias("b"))
    rows = mutations.website_rows(t.businesses(spark, d), there)
    return rows.join(own, F.col("business_id") == F.col("b"), "left").select("business_id", "url", F.col("b").isNull().alias("created"))


@query(sql("""SELECT key, n, cost_units, row_number() OVER (ORDER BY first) AS place FROM (
  SELECT service || ':' || operation AS key, count(*) AS n, CAST(sum(cost_units) AS BIGINT) AS cost_units, min(id) AS first FROM api_usage GROUP BY 1)""", "api_usage"))  # fmt: skip
def cost_report(spark, d):
    """Costs by operation in the order in which each was first seen; there are as few rows as kinds of operation."""
    first = t.api_usage(spark, d).groupBy("service", "operation").agg(F.min("id").alias("first"))
    rows = crm.costs(t.api_usage(spark, d)).join(first, ["service", "operation"])
    place = F.row_number().over(Window.orderBy("first")).cast("long").alias("place")
    return rows.select(F.concat_ws(":", "service", "operation").alias("key"), "n", "cost_units", place)


@query(sql("""SELECT id, CASE WHEN cost_units >= 100000000 THEN regexp_replace(CAST(cost_units // 10000 AS VARCHAR), '(\\d)(\\d{3})$', '\\1.\\2') ELSE CAST(cost_units // 10000 AS VARCHAR) END || ','
  || regexp_replace(lpad(CAST(cost_units % 10000 AS VARCHAR), 4, '0'), '0{1,2}$', '') || chr(160) || 'US$' AS cost, strftime(created_at, '%-d/%-m/%Y') AS day FROM api_usage""", "api_usage"))  # fmt: skip
def labels_costs(spark, d):
    """Dollars with two to four decimals, and days, as Spanish writes them."""
    return t.api_usage(spark, d).select("id", labels.dollars(F.col("cost_units") / 10_000.0).alias("cost"), labels.day(F.col("created_at")).alias("day"))


@query(sql("""SELECT b.id, b.name, b.category, b.city, b.review_count, 'name,category,sector,city,website_url,rating,review_count' AS keys, s.lead_score IS NOT NULL AS scored, s.opportunity_score
  FROM businesses b LEFT JOIN latest_scores s ON b.id = s.business_id""", "businesses", "latest_scores"))  # fmt: skip
def audit_payload(spark, d):
    """What an audit is written from, as JSON, read again field by field."""
    rows = crm.with_score(t.businesses(spark, d), t.scores(spark, d).withColumn("opportunity_breakdown", F.create_map(F.lit("seo"), F.col("opportunity_score"))))
    made = rows.select("id", payloads.payload(payloads.AUDIT).alias("b"), payloads.payload(payloads.SCORE, "score").alias("s"))
    field = lambda c, n: F.get_json_object(c, f"$.{n}")
    return made.select(
        "id", field("b", "name").alias("name"), field("b", "category").alias("category"), field("b", "city").alias("city"), field("b", "review_count").cast("int").alias("review_count"),
        F.array_join(F.json_object_keys("b"), ",").alias("keys"), F.col("s").isNotNull().alias("scored"), field("s", "opportunity_score").cast("long").alias("opportunity_score"),
    )
