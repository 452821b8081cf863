from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.operators.skew import PIECES, even_join, heavy_keys


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_one_key_with_nine_tenths_of_the_rows(spark, no_broadcast):
    """The largest task has at most three times the rows of the median one, and every row its match."""
    n = 100_000
    rows = spark.range(n).select("id", F.when(F.col("id") % 10 != 0, 1).when(F.col("id") % 100 != 0, F.col("id")).alias("owner"), F.create_map(F.lit("a"), F.col("id")).alias("m"))
    few = spark.range(n).where("id % 7 <> 0").select(F.col("id").alias("of"), (F.col("id") * 2).alias("twice"))
    out = even_join(rows, few, F.col("owner"), "of")
    got = out.withColumn("part", F.spark_partition_id()).select("id", "owner", "twice", "part").collect()
    assert len(got) == n and out.columns == ["id", "owner", "m", "of", "twice"]
    for r in got:
        assert r.twice == (None if r.owner is None or r.owner % 7 == 0 else 2 * r.owner)
    sizes = sorted(Counter(r.part for r in got).values())
    assert len(sizes) == 8 and sizes[-1] <= 3 * sizes[4]
    assert even_join(rows, few, F.col("owner"), "of", "inner").count() == sum(r.twice is not None for r in got)


def test_heavy_keys(spark):
    pieces = PIECES * 4
    rows = spark.range(pieces * 100).select(F.when(F.col("id") < pieces * 50, "half").when(F.col("id") < pieces * 75, "quarter").when(F.col("id") < pieces * 80, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"))
    got = {r.heavy: r.pieces for r in heavy_keys(rows, F.col("k")).collect()}
    assert set(got) == {"half", "quarter"} and abs(got["half"] - pieces * 50 / 95) <= 2 and abs(got["quarter"] - pieces * 25 / 95) <= 2
    none = rows.limit(0)
    assert heavy_keys(none, F.col("k")).collect() == [] and even_join(none, rows.select(F.col("k").alias("o")), F.col("k"), "o").collect() == []
