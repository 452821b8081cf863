import random

from pyspark.sql import functions as F

from quillon.operators import mutations
from quillon.operators.rate_limit import limited
from quillon.streaming import limits, states


def run(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def batches(rows, schema, spark, path, n=3):
    for i in range(n):
        spark.createDataFrame(rows[len(rows) * i // n : len(rows) * (i + 1) // n], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_limiter_stream_is_the_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted([(rng.choice("ab"), i, rng.randint(0, 3000)) for i in range(90)], key=lambda r: r[2])
    schema = "key string, id long, at_us long"
    got = run(spark, limits.limited_stream(batches(rows, schema, spark, str(tmp_path / "c")), 3, 200), "limits").collect()
    want = limited(spark.createDataFrame(rows, schema), 3, 200).collect()
    assert {(r.id, r.allowed) for r in got} == {(r.id, r.allowed) for r in want} and len(got) == 90


def test_stage_stream_is_the_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randint(1, 3), i, i * 10, rng.choice(["NEW", "WON"])) for i in range(60)]
    schema = "lead_id long, id long, at_us long, stage string"
    got = run(spark, states.stage_changes(batches(rows, schema, spark, str(tmp_path / "s"))), "stages").collect()
    want = mutations.stage_changes(spark.createDataFrame(rows, schema), at="at_us").collect()
    assert {(r.id, r.from_stage, r.to_stage) for r in got} == {(r.id, r.from_stage, r.to_stage) for r in want} and got


def test_job_states_and_windows(spark, tmp_path):
    rows = [(i, i // 3, ["QUEUED", "RUNNING", "COMPLETED"][i % 3], i * 600) for i in range(30)]
    stream = batches(rows, "id long, job_id long, status string, s long", spark, str(tmp_path / "j")).withColumn("created_at", F.timestamp_seconds("s"))
    got = run(spark, states.latest_states(stream), "jobs", "complete").collect()
    assert len(got) == 10 and {r.status for r in got} == {"COMPLETED"}
    counts = run(spark, states.counts_by_window(stream.withColumnRenamed("created_at", "ts"), "status"), "windows").collect()
    assert counts and sum(r.n for r in counts) <= 30


def test_limiter_state_goes_with_its_window(spark, tmp_path):
    """Keys that call no more leave no state once the watermark has passed their windows."""
    second = 1_000_000
    rows = [("old", i, i * second) for i in range(30)] + [("new", 100 + i, (10_000 + i) * second) for i in range(60)]
    calls = batches(rows, "key string, id long, at_us long", spark, str(tmp_path / "t"))
    out = limits.limited_stream(calls, 5, 60 * second, late="10 seconds")
    q = out.writeStream.outputMode("append").format("memory").queryName("expiry").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("expiry").where("key = 'old' and allowed").count() == 5
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
