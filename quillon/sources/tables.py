"""Base tables and the relations of the data model derived from them.

The model's own tables don't exist in the test data; each is derived from the
base tables by integer arithmetic, so that any SQL engine arrives at the same
rows. A deployment replaces these functions by readers of its own tables; the
operators and plans only see DataFrames.

Every function takes an owner. With one it gives the rows of that owner alone,
by the table's own column, its business, or its lead; without one, for reports
over all owners, it gives all.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.settings import default_rows
from quillon.schemas import SETTINGS, STAGES


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Reader = Callable[..., DataFrame]


def owned(by: str) -> Callable[[Reader], Reader]:
    """Gives a reader an ``owner``: by ``owner_id``, or by a reference to a business or a lead of that owner."""

    def wrap(read: Reader) -> Reader:
        @functools.wraps(read)
        def run(spark: SparkSession, sf_dir: str, owner: int | None = None) -> DataFrame:
            rows = read(spark, sf_dir)
            if owner is None:
                return rows
            if by == "owner_id":
                return rows.where(F.col("owner_id") == owner)
            parents = (businesses if by == "business_id" else leads)(spark, sf_dir, owner).select(F.col("id").alias("__parent"))
            return rows.join(parents, F.col(by) == F.col("__parent"), "left_semi")

        return run

    return wrap


def _unless(condition: Column, value: Column) -> Column:
    return F.when(~condition, value)


@owned("owner_id")
def businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One per customer, with its nation as city and its region."""
    places = base(spark, sf_dir, "nation").join(base(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = base(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    i = F.col("c_custkey")
    sector = F.create_map(*map(F.lit, ["FURNITURE", "Restaurantes", "MACHINERY", "Hoteles", "HOUSEHOLD", "Clínicas dentales", "BUILDING", "Peluquerías", "AUTOMOBILE", "Talleres"]))
    return rows.select(
        i.alias("id"), (i % 3).alias("owner_id"), F.col("c_name").alias("name"), F.try_element_at(sector, F.col("c_mktsegment")).alias("sector"),
        _unless(i % 6 == 0, F.lower("c_mktsegment")).alias("category"), F.col("n_name").alias("city"), F.col("r_name").alias("region"),
        F.lit("España").alias("country"), F.concat(F.lit("+34"), (i + 600000000).cast("string")).alias("phone"),
        _unless(i % 5 == 0, F.concat(F.lit("https://b"), i.cast("string"), F.lit(".example"))).alias("website_url"),
        _unless(i % 3 == 0, F.concat(F.lit("place-"), i.cast("string"))).alias("gbp_place_id"),
        _unless(i % 7 == 0, (i * 7 % 51) / 10.0).alias("rating"), _unless(i % 11 == 0, (i * 37 % 800).cast("int")).alias("review_count"),
    )


@owned("business_id")
def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of scores, one per order."""
    i = F.col("o_orderkey")
    return base(spark, sf_dir, "orders").select(
        i.alias("id"), F.col("o_custkey").alias("business_id"), F.col("o_orderdate").alias("computed_at"),
        (i * 31 % 101).alias("opportunity_score"), (i * 17 % 101).alias("buying_intent_score"), (F.floor("o_totalprice") % 101).alias("lead_score"),
    )


@owned("business_id")
def website_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of page scans, one per even order of customers that are scanned at all."""
    m = F.col("m")
    rows = base(spark, sf_dir, "orders").where("o_orderkey % 2 = 0 and o_custkey % 9 <> 0").withColumn("m", F.expr("o_orderkey div 2"))
    n = lambda c: c.cast("int")
    return rows.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("business_id"), F.col("o_orderdate").alias("scanned_at"),
        _unless(m % 13 == 0, m % 3 != 0).alias("https"), (m % 4 == 0).alias("schema_markup_present"), (m % 5 != 0).alias("robots_txt_present"),
        (m % 5 < 3).alias("sitemap_present"), (m % 7 < 3).alias("canonical_present"), (m % 6 != 0).alias("has_viewport_meta"),
        n(m % 23).alias("image_count"), n(F.expr("(m % 23) * (m % 10) div 10")).alias("images_missing_alt"), n(m * 7919 % 5000000).alias("html_size_bytes"),
        _unless(m % 17 == 0, F.repeat(F.lit("t"), n(m % 80 + 1))).alias("title"), F.when(m % 17 == 0, 0).otherwise(n(m % 80 + 1)).alias("title_length"),
        _unless(m % 6 == 1, F.repeat(F.lit("d"), n(m * 3 % 200 + 1))).alias("meta_description"),
        F.when(m % 6 == 1, 0).otherwise(n(m * 3 % 200 + 1)).alias("meta_description_length"),
        n(m % 3).alias("h1_count"), n(m * 37 % 900).alias("word_count_estimate"), n(m % 9).alias("internal_link_count"),
        (m % 2 == 0).alias("has_phone_link"), (m % 3 == 0).alias("has_whatsapp_link"), (m % 4 != 0).alias("has_contact_form"),
        n(m % 4).alias("cta_mentions_count"), (m % 5 == 0).alias("has_testimonials_section"),
        F.when(m % 2 == 0, n(m % 101)).alias("lighthouse_performance_score"), n(m * 53 % 3000).alias("server_response_time_ms"),
    )


@owned("business_id")
def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for every other business, under the same id."""
    i = F.col("c_custkey")
    stage = F.element_at(F.array(*map(F.lit, STAGES)), (F.expr("c_custkey div 2") % 12 + 1).cast("int"))
    return base(spark, sf_dir, "customer").where(i % 2 == 0).select(
        i.alias("id"), i.alias("business_id"), stage.alias("stage"), F.col("c_acctbal").alias("value_estimate"),
        F.when(stage == "WON", F.col("c_acctbal")).alias("value_won"),
    )


@owned("lead_id")
def lead_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*map(F.lit, ["signup", "stage_change", "click", "note", "view", "call", "purchase", "email", "error", "meeting"]))
    return base(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), (F.col("user_id") * 2).alias("lead_id"), F.try_element_at(kinds, F.col("event_type")).alias("type"),
        F.col("event_type").alias("description"), F.col("ts").alias("created_at"),
    )


@owned("business_id")
def api_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs are whole hundredths of a cent, so that sums are exact."""
    services = F.array(*map(F.lit, ["anthropic", "google_places", "google_pagespeed"]))
    return base(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.element_at(services, (F.col("user_id") % 3 + 1).cast("int")).alias("service"), F.col("event_type").alias("operation"),
        F.col("user_id").alias("business_id"), F.floor("value").cast("int").alias("units"),
        F.floor(F.col("value") * 100).cast("long").alias("cost_units"), F.col("ts").alias("created_at"),
    )


@owned("owner_id")
def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of jobs over time: four events in a row are those of one job."""
    status = F.create_map(*map(F.lit, ["signup", "QUEUED", "click", "RUNNING", "view", "RUNNING", "purchase", "COMPLETED", "error", "FAILED"]))
    return base(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.expr("event_id div 4").alias("job_id"), F.expr("event_id div 4 % 3").alias("owner_id"), F.try_element_at(status, F.col("event_type")).alias("status"),
        (F.col("event_id") % 7).cast("int").alias("progress_current"), (F.col("event_id") % 5).cast("int").alias("progress_total"), F.col("ts").alias("created_at"),
    )


@owned("business_id")
def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One per order with lines; its services are the kinds of parts ordered."""
    kinds = base(spark, sf_dir, "lineitem").join(base(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    kinds = kinds.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("p_type")).alias("services"))
    status = F.when(F.col("o_orderstatus") == "O", "draft").when(F.col("o_orderstatus") == "F", "sent").otherwise("accepted")
    return base(spark, sf_dir, "orders").join(kinds, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("business_id"), "services", status.alias("status"), F.col("o_orderdate").alias("created_at"),
    )


@owned("business_id")
def demos(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ["draft", "ready", "published"])), (i % 9 / 3 + 1).cast("int"))
    content = F.when(i % 2 == 0, F.concat(F.lit('{"copy":{"headline":"Demo '), i.cast("string"), F.lit('"}}'))).otherwise(F.lit("{}"))
    return base(spark, sf_dir, "orders").where(i % 3 == 0).select(
        i.alias("id"), F.col("o_custkey").alias("business_id"), status.alias("status"), content.alias("content"), F.col("o_orderdate").alias("created_at")
    )


@owned("business_id")
def ai_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    model = F.element_at(F.array(*map(F.lit, ["standard", "large", "small", "unlisted"])), (i % 4 + 1).cast("int"))
    return base(spark, sf_dir, "orders").where(i % 5 == 0).select(
        i.alias("id"), F.col("o_custkey").alias("business_id"), model.alias("model"), (i * 13 % 5000).alias("input_tokens"), (i * 7 % 3000).alias("output_tokens"),
        F.col("o_orderdate").alias("generated_at"),
    )


@owned("business_id")
def websites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every fourth business with an address; the others have no row yet."""
    rows = businesses(spark, sf_dir).where("website_url is not null and id % 4 = 1")
    return rows.select("id", F.col("id").alias("business_id"), F.col("website_url").alias("url"))


@owned("business_id")
def seo_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What scans say for search engines."""
    rows = website_scans(spark, sf_dir).where("id % 3 = 0")
    return rows.select("id", F.col("id").alias("website_scan_id"), "business_id", "title", "h1_count", F.col("schema_markup_present").alias("structured_data_present"), F.col("scanned_at").alias("created_at"))


@owned("business_id")
def local_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for each business that a place is known of."""
    return businesses(spark, sf_dir).where("gbp_place_id is not null").select("id", F.col("id").alias("business_id"), F.lit("google_places").alias("source"), "rating", "review_count")


@owned("business_id")
def competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 2 + 1).alias("business_id"), F.col("s_name").alias("competitor_name"), (F.col("s_acctbal") > 0).alias("is_better_positioned"))


@owned("owner_id")
def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one of the three owners; the others have the defaults."""
    rows = default_rows(spark.range(1, 2).select(F.col("id").alias("owner_id"))).drop("agency_name", "pricing", "scoring_weights")
    pricing = F.create_map(*[F.lit(x) for k, v in TEST_PRICING.items() for x in (k, v * 2.0)])
    weights = F.struct(
        F.struct(*[F.lit(v).alias(k) for k, v in TEST_WEIGHTS["opportunity"].items()]).alias("opportunity"), F.struct(*[F.lit(v).alias(k) for k, v in TEST_WEIGHTS["lead_score"].items()]).alias("lead_score")
    )
    return rows.select("*", F.lit("First").alias("agency_name"), pricing.alias("pricing"), weights.cast(SETTINGS["scoring_weights"].dataType).alias("scoring_weights")).select(*SETTINGS.names)


#: The relations that have an owner.
RELATIONS = frozenset(("businesses", "websites", "website_scans", "seo_audits", "local_audits", "competitors", "scores", "ai_reports", "proposals", "demos", "leads", "lead_activities", "api_usage", "jobs", "settings"))

#: Weights of the test settings: binary fractions, so that sums are exact in any order.
TEST_WEIGHTS = {
    "opportunity": {"website_quality": 0.25, "seo": 0.25, "local_seo": 0.125, "performance": 0.125, "mobile_ux": 0.125, "conversion": 0.125, "competitive_gap": 0.0},
    "lead_score": {"opportunity": 0.5, "buying_intent": 0.25, "business_value": 0.125, "competitive_gap": 0.125},
}

#: Rates of test calls: USD per million tokens in and out, by name of the model.
TEST_RATES = {"standard": (2.0, 10.0), "large": (5.0, 25.0), "small": (1.0, 5.0)}

#: What the price list of test proposals holds, in whole units; one kind is left out.
TEST_PRICING = {"ECONOMY": 100, "LARGE": 900, "MEDIUM": 450, "PROMO": 250, "SMALL": 150}
