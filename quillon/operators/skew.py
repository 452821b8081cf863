"""Joins where some keys have a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pieces for each partition: a key is divided if it has more rows than a piece, so that partitions get several pieces each and are about even.
PIECES = 8


def heavy_keys(rows: DataFrame, key: Column) -> DataFrame:
    """(heavy, pieces): keys with more rows than a piece, and how many pieces they make.

    They are found in one pass by a sketch of frequent items, which is bounded and
    misses no key of that share; there are fewer of them than pieces.
    """
    spark = rows.sparkSession
    pieces = PIECES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select(key.alias("key"))
    tracked = min(1_000_000, 8 * pieces)
    found = keyed.where("key is not null").agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(key, {min(pieces, tracked)}, {tracked})").alias("top")).first()
    own = [(x["item"], -(-x["count"] * pieces // found.n)) for x in found.top or [] if x["count"] * pieces > found.n]
    return spark.createDataFrame(own, T.StructType([T.StructField("heavy", keyed.schema["key"].dataType), T.StructField("pieces", T.LongType())]))


def even_join(rows: DataFrame, few: DataFrame, key: Column, few_key: str, how: str = "left") -> DataFrame:
    """``rows`` joined to a table with one row a key, whatever share of the rows a key has: inner or left.

    Rows of a heavy key are dealt over its pieces, and the other table's row is copied for
    each; all other keys are joined as they are. Names of the two tables' columns must differ.
    """
    heavy = F.broadcast(heavy_keys(rows, key))
    spread = [c for c, kind in rows.dtypes if not kind.startswith(("map", "variant"))]
    dealt = rows.withColumn("__key", key).join(heavy, F.col("__key") == F.col("heavy"), "left")
    dealt = dealt.withColumn("__piece", F.when(F.col("pieces").isNull() & F.col("__key").isNotNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(*spread), F.coalesce("pieces", F.lit(1 << 20))))).drop("heavy", "pieces")
    copies = few.join(heavy, F.col(few_key) == F.col("heavy"), "left").withColumn("__of_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("pieces", F.lit(1)) - 1))).drop("heavy", "pieces")
    return dealt.join(copies, (F.col("__key") == F.col(few_key)) & (F.col("__piece") == F.col("__of_piece")), how).drop("__key", "__piece", "__of_piece")
