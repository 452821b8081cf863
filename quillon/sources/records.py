"""Records of delimited text with quoted line ends, read by many tasks at once.

Spark divides a file into ranges at line ends, and a line end within quotes is none
of a record's. Whether a line begins within quotes depends on all lines before
it; but a line does one of four things to that state: it keeps it, turns it,
sets it, or clears it, whatever it was. So each line is looked at under both
assumptions, a range's effect is that of its last line that sets or clears and the turns since,
and a pass over one row a range gives the state that each begins in. Numbers of
records follow from the ranges' counts in the same way.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators.cuts import cut

#: A record of more lines is refused: a quote that is never closed would make one of all that follows.
MOST_LINES = 10_000


class UnclosedQuoteError(ValueError):
    """A record has more lines than any should."""


def open_after(line: Column, sep: str) -> tuple[Column, Column]:
    """Whether a line ends within quotes if it begins outside, and if it begins within.

    Quotes open at the beginning of a field only, and close before a separator or the end of the line.
    """
    s = re.escape(sep)
    whole = f'(^|{s})"([^"]|"")*+"(?={s}|$)'
    begins = f'(^|{s})"'
    outside = F.regexp_replace(line, whole, "$1").rlike(begins)
    # What follows the quote that closes; without one the line is all within.
    closed = line.rlike(f'^([^"]|"")*+"({s}|$)')
    rest = F.regexp_replace(line, f'^([^"]|"")*+"(?={s}|$)', "")
    within = ~closed | F.regexp_replace(rest, whole, "$1").rlike(begins)
    return outside, within


def records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(file, n, value): the records of every file but for blank ones, numbered from 1 over all files in the order of their names; the first of each file is its header and has number 0."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("m"))
    outside, within = open_after(F.col("value"), sep)
    # Numbers that rows get as they are read hold only if they are kept.
    lines = cut(lines.withColumn("outside", outside).withColumn("within", within))
    lines = lines.withColumn("fixed", F.when(F.col("outside") == F.col("within"), F.col("outside"))).withColumn("turns", (F.col("outside") & ~F.col("within")).cast("int"))

    own = Window.partitionBy("file", "range").orderBy("m")
    before = own.rowsBetween(Window.unboundedPreceding, -1)

    def since(name: str, frame) -> Column:
        """The last line that sets or clears, as (its state, turns up to it)."""
        return F.last(F.when(F.col("fixed").isNotNull(), F.struct(F.col("fixed").cast("int").alias("state"), F.col("all_turns").alias("turns"))), ignorenulls=True).over(frame).alias(name)

    lines = lines.withColumn("all_turns", F.sum("turns").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.select("*", since("set", before), F.coalesce(F.lag("all_turns").over(own), F.lit(0)).alias("turned"))

    # Per range: what its last line that sets leaves, and the turns since; over ranges the same again.
    ranges = lines.groupBy("file", "range").agg(F.max("all_turns").alias("all"), F.max_by(F.when(F.col("fixed").isNotNull(), F.struct(F.col("fixed").cast("int").alias("state"), F.col("all_turns").alias("turns"))), F.when(F.col("fixed").isNotNull(), F.col("m"))).alias("set"))
    effect = ranges.select("file", "range", F.col("set.state").alias("set"), (F.col("all") - F.coalesce("set.turns", F.lit(0))).alias("turns"))
    order = Window.partitionBy("file").orderBy("range")
    effect = effect.withColumn("sum", F.sum(F.when(F.col("set").isNull(), F.col("turns")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ended = F.when(F.col("set").isNotNull(), F.struct(((F.col("set") + F.col("turns")) % 2).alias("state"), "sum"))
    effect = effect.withColumn("at", F.last(ended, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    begun = (F.coalesce("at.state", F.lit(0)) + F.coalesce(F.lag("sum").over(order), F.lit(0)) - F.coalesce("at.sum", F.lit(0))) % 2
    starts = effect.select(F.col("file").alias("of"), F.col("range").alias("in"), begun.alias("begun"))

    state = F.when(F.col("set").isNull(), F.col("begun") + F.col("turned")).otherwise(F.col("set.state") + F.col("turned") - F.col("set.turns")) % 2
    lines = lines.join(F.broadcast(starts), (F.col("file") == F.col("of")) & (F.col("range") == F.col("in"))).select("file", "range", "m", "value", (state == 0).cast("int").alias("first"))
    lines = lines.where((F.col("first") == 0) | (F.trim("value") != ""))

    # The records that begin in a range, and those before it; lines before its first belong to the last record of a range before.
    counts = lines.groupBy("file", "range").agg(F.sum("first").alias("n"))
    every = Window.orderBy("file", "range")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("in_file", before).withColumn("headers", F.sum(((F.col("in_file") == 0) & (F.col("n") > 0)).cast("int")).over(every.rowsBetween(Window.unboundedPreceding, 0)))
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bases = counts.select(F.col("file").alias("of"), F.col("range").alias("in"), "base", "in_file", "headers")
    within = F.sum("first").over(own.rowsBetween(Window.unboundedPreceding, 0))
    numbered = lines.join(F.broadcast(bases), (F.col("file") == F.col("of")) & (F.col("range") == F.col("in"))).select("*", within.alias("within"))
    numbered = numbered.select("file", "range", "m", "value", (F.col("in_file") + F.col("within")).alias("record"), F.when(F.col("in_file") + F.col("within") > 1, F.col("base") + F.col("within") - F.col("headers")).otherwise(0).alias("n"))
    sizes = numbered.groupBy("file", "record").agg(F.count(F.lit(1)).alias("lines"))
    if not sizes.where(F.col("lines") > MOST_LINES).isEmpty():
        raise UnclosedQuoteError(f"a record has more than {MOST_LINES} lines; is a quote left open?")
    ordered = F.sort_array(F.collect_list(F.struct("range", "m", "value")))
    return numbered.groupBy("file", "record").agg(F.max("n").alias("n"), F.array_join(F.transform(ordered, lambda x: x["value"]), "\n").alias("value")).select("file", "n", "value")
