"""Places of rows and values before them, without gathering a key or a table in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.cuts import cut


def with_previous(rows: DataFrame, key: str, order: list[str], column: str, name: str) -> DataFrame:
    """``rows`` with ``name``: ``column`` of the row before in ``order`` among those of the same ``key``, null for the first.

    Rows are cut into ranges of (key, order), so a key with very many rows spans
    several. Within a range a window gives the value; the first row of a key in a
    range takes the last value of the range before, if that ends with the same key.
    There is one such value a range, so what is broadcast is as small as the number
    of partitions.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = cut(rows.repartitionByRange(parts, key, *order).withColumn("__part", F.spark_partition_id()))
    within = Window.partitionBy("__part", key).orderBy(*order)
    own = ranges.withColumn("__first", F.row_number().over(within) == 1).withColumn("__before", F.lag(column).over(within))
    place = F.struct(key, *order)
    ends = ranges.groupBy("__part").agg(F.max_by(F.struct(F.col(key).alias("k"), F.col(column).alias("v")), place).alias("end"))
    carried = ends.select((F.lead("__part").over(Window.orderBy("__part"))).alias("__to"), "end").where("__to is not null")
    joined = own.join(F.broadcast(carried), F.col("__part") == F.col("__to"), "left")
    value = F.when(~F.col("__first"), F.col("__before")).when(F.col("end.k").eqNullSafe(F.col(key)), F.col("end.v"))
    return joined.select(*rows.columns, value.alias(name))


def with_rank(rows: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """``rows`` with ``name``: their places in ``order``, from ``start`` + 1 without gaps. The rows of a range follow each other in a partition."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    sizes = ranges.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select(F.col("__part").alias("__of"), before.alias("__base"))
    place = F.col("__base") + F.row_number().over(Window.partitionBy("__part").orderBy(*order)) + start
    return ranges.join(F.broadcast(bases), F.col("__part") == F.col("__of")).select(*rows.columns, place.cast("long").alias(name))
