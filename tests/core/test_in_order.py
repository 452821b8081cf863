import random

import pytest

from quillon.operators import mutations
from quillon.operators.rate_limit import limited
from quillon.streaming import in_order

SECOND = 1_000_000


@pytest.fixture
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", in_order.STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def shuffled(spark, rows, schema, path, at, jitter, n=4):
    """Files in an order in which no row comes more than ``jitter`` after a later one; the last row ends all waiting."""
    rng = random.Random(1)
    rows = sorted(rows, key=lambda r: r[at] + rng.randint(0, jitter))
    assert rows != sorted(rows, key=lambda r: r[at])
    for i in range(n):
        spark.createDataFrame(rows[len(rows) * i // n : len(rows) * (i + 1) // n], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, df, name):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name), q


def test_limiter_of_shuffled_calls_is_the_batch(spark, store, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), i, rng.randint(1, 300) * SECOND // 2) for i in range(200)]
    schema = "key string, id long, at_us long"
    stream = shuffled(spark, [*rows, ("end", 999, 100_000 * SECOND)], schema, str(tmp_path / "c"), 2, 25 * SECOND)
    out, q = run(spark, in_order.limited(stream, 3, 20 * SECOND, late="30 seconds"), "calls")
    want = limited(spark.createDataFrame(rows, schema), 3, 20 * SECOND).collect()
    got = out.where("id < 999").collect()
    assert {(r.key, r.id, r.allowed, r.retry_after_s) for r in got} == {(r.key, r.id, r.allowed, r.retry_after_s) for r in want} and len(got) == 200
    # All windows but the last one's are over: nothing is left of their keys.
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4


def test_stages_in_order_and_idle_leads(spark, store, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randint(1, 4), i, (i + 1) * SECOND, rng.choice(["NEW", "WON", "LOST"])) for i in range(120)]
    schema = "lead_id long, id long, at_us long, stage string"
    stream = shuffled(spark, [*rows, (1, 500, 1000 * SECOND, "LATE"), (9, 999, 100_000 * SECOND, "NEW")], schema, str(tmp_path / "s"), 2, 8 * SECOND)
    out, _ = run(spark, in_order.stage_changes(stream, late="10 seconds", idle_us=500 * SECOND), "ordered_stages")
    want = mutations.stage_changes(spark.createDataFrame(rows, schema), at="at_us").collect()
    # Lead 1 was idle for longer than its state is kept, so its last row is a first one.
    assert {(r.id, r.from_stage, r.to_stage) for r in out.collect()} == {(r.id, r.from_stage, r.to_stage) for r in want} and want


def test_another_store_is_refused(spark):
    with pytest.raises(ValueError, match="stateStore"):
        in_order.limited(spark.createDataFrame([], "key string, id long, at_us long"), 1, 1)
