import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import commit_log, incremental
from quillon.operators.latest import latest

SCHEMA = "id long, k long, at long, v string"


def test_increments_equal_the_whole(spark, tmp_path):
    """Late rows, ties, repeated jobs, keys that come and stay, and an increment without rows."""
    rng = random.Random(4)
    rows = [(i, rng.choice([None, *range(30)]), rng.choice([None, *range(20)]), rng.choice(["a", "b", None])) for i in range(600)]
    path, done = str(tmp_path / "state"), []
    for n, part in enumerate([rows[:200], rows[200:210], [], rows[210:]]):
        df = spark.createDataFrame(part, SCHEMA)
        said = incremental.add(spark, path, f"day {n}", df, "k", "at", buckets=6)
        done += part
        want = latest(spark.createDataFrame(done, SCHEMA).where("k is not null"), "k", "at")
        assert sorted(map(tuple, incremental.current(spark, path).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
        assert incremental.add(spark, path, f"day {n}", df, "k", "at") == said and commit_log.snapshot(spark, path).version == n + 1
    assert not any(t.name.startswith("state_") for t in spark.catalog.listTables())


def test_the_state_is_not_shuffled(spark, tmp_path):
    rows = spark.range(1000).select("id", (F.col("id") % 100).alias("k"), F.col("id").alias("at"), F.lit("x").alias("v"))
    path = str(tmp_path / "state")
    incremental.add(spark, path, "1", rows, "k", "at", buckets=8)
    was = commit_log.snapshot(spark, path)
    (folder,) = was.files
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with incremental._bucketed(spark, folder, rows.schema, "k", 8) as state:
            out = incremental.merged(state, rows.limit(10), "k", "at", "id", 8)
            out.collect()
            plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and "SelectedBucketsCount: 8 out of 8" in plan
    scan = plan.index("Bucketed: true")
    # Between the scan of the state and the join there is a sort at most.
    assert "Exchange" not in plan[plan.index("SortMergeJoin") : scan]


def test_no_state(spark, tmp_path):
    with pytest.raises(ValueError, match="no state"):
        incremental.current(spark, str(tmp_path / "none"))


def test_one_publishes_at_a_time(spark, tmp_path, monkeypatch):
    path, publish, met = str(tmp_path / "s"), commit_log.publish, []
    df = lambda *rows: spark.createDataFrame(rows, SCHEMA)

    def late(*args):
        if not met:
            met.append(True)
            incremental.add(spark, path, "other", df((1, 1, 5, "other"), (2, 2, 1, "other")), "k", "at", buckets=2)
        publish(*args)

    monkeypatch.setattr(commit_log, "publish", late)
    incremental.add(spark, path, "own", df((3, 1, 4, "own"), (4, 2, 2, "own")), "k", "at", buckets=2)
    assert {(r.k, r.v) for r in incremental.current(spark, path).collect()} == {(1, "other"), (2, "own")}
