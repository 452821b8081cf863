from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quillon.config import Source, source
from quillon.functions import labels, payloads
from quillon.operators import settings
from quillon.operators.cuts import shared_path
from quillon.schemas import AUDIT_OUTPUT, LEAD_WEIGHTS, OPPORTUNITY_WEIGHTS, OUTREACH_OUTPUT


def test_source_of_a_session(spark):
    def chosen(**given):
        for k in ("data", "owner", "examples"):
            spark.conf.set(f"spark.quillon.{k}", given.get(k, ""))
        try:
            return source(spark)
        finally:
            for k in ("data", "owner", "examples"):
                spark.conf.unset(f"spark.quillon.{k}")

    assert chosen(data="/d", owner=" 7 ", examples="/e") == Source("/d", 7)
    assert chosen(data="/d", owner=" ", examples="/e") == chosen(owner="7", examples="/e") == Source("/e", None)
    for bad, why in (({"data": "/d"}, "examples"), ({}, "examples"), ({"data": "/d", "owner": "me", "examples": "/e"}, "no number")):
        with pytest.raises(ValueError, match=why):
            chosen(**bad)
    with pytest.raises(ValueError, match="no relation"):
        Source("/e", None).relation(spark, "base")


def test_settings_of_very_many_owners(spark, monkeypatch):
    """Broadcast or in parts, rows get the same; an owner without settings, and none at all, get null."""
    rows = spark.range(500).select("id", F.when(F.col("id") % 10 != 0, 1).when(F.col("id") % 20 != 0, F.col("id")).alias("owner_id"))
    own = settings.default_rows(spark.createDataFrame([(1,), (10,), (30,)], "owner_id long"))
    got = settings.with_settings(rows, own, "agency_name")
    want = {r.id: r.settings for r in got.collect()}
    assert want[1].agency_name == "My Agency" and want[10].agency_name == "My Agency" and want[50] is None and want[20] is None
    assert "hashpartitioning(owner_id" not in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(settings, "MOST_OWNERS", 2)
    assert {r.id: r.settings for r in settings.with_settings(rows, own, "agency_name").collect()} == want


def test_no_folder_is_refused():
    none = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(ValueError, match="names no folder"):
        shared_path(SimpleNamespace(conf=none, sparkContext=SimpleNamespace(getConf=lambda: none)), "x")


def test_defaults_of_new_owners(spark):
    owners = spark.createDataFrame([(1,), (2,), (2,), (None,)], "owner_id long")
    rows = settings.ensured(settings.default_rows(owners.where("owner_id = 1")).withColumn("agency_name", F.lit("Own")), owners, "some-model").orderBy("owner_id").collect()
    assert [(r.owner_id, r.agency_name, r.ai_model) for r in rows] == [(1, "Own", None), (2, "My Agency", "some-model")]
    r = rows[1]
    assert r.scoring_weights.opportunity.asDict() == OPPORTUNITY_WEIGHTS and r.scoring_weights.lead_score.asDict() == LEAD_WEIGHTS
    assert (r.pricing, r.services, r.agency_identity) == ({}, [], {}) and r.created_at is not None
    assert settings.ensured(settings.default_rows(owners.where("false")), owners.where("false")).collect() == []


def test_payloads_keep_nulls(spark):
    df = spark.createDataFrame([("n", None, "c", {"technical": {"https": "true"}}), ("m", "k", None, None)], "name string, category string, city string, scan struct<technical:map<string,string>>")
    got = df.select(payloads.payload(payloads.PROPOSAL).alias("b"), payloads.payload(["technical"], "scan").alias("s")).collect()
    assert [(r.b, r.s) for r in got] == [('{"name":"n","category":null,"city":"c"}', '{"technical":{"https":"true"}}'), ('{"name":"m","category":"k","city":null}', None)]


def test_outputs_are_whole_or_nothing(spark):
    good = '{"subject":"s","body":"b"}'
    rows = [good, '{"subject":"s"}', '{"subject":"s","body":"b","more":1}', '{"subject":null,"body":"b"}', "[]", "no json", "", None]
    df = spark.createDataFrame([(r,) for r in rows], "a string")
    assert [r.o and tuple(r.o) for r in df.select(payloads.structured(F.col("a"), OUTREACH_OUTPUT).alias("o")).collect()] == [("s", "b"), *[None] * 7]
    audit = '{"summary":"s","problems":["p","q"],"opportunities":[],"commercial_impact":"i","recommendations":["r"],"priorities":["1"]}'
    r = spark.createDataFrame([(audit,)], "a string").select(payloads.structured(F.col("a"), AUDIT_OUTPUT).alias("o")).first().o
    assert r.problems == ["p", "q"] and r.opportunities == []


def test_dollars_and_days(spark):
    df = spark.createDataFrame([(0.0,), (1.5,), (0.1234,), (0.123,), (9999.99996,), (1234567.891,), (12.34567,)], "v double")
    got = [r.v for r in df.select(labels.dollars(F.col("v")).alias("v")).collect()]
    assert got == [x + "\u00a0US$" for x in ("0,00", "1,50", "0,1234", "0,123", "10.000,00", "1.234.567,891", "12,3457")]
    assert spark.range(1).select(labels.day(F.lit("2026-03-05").cast("date")).alias("d")).first().d == "5/3/2026"
