"""A rate limiter whose windows open with the first call after the last has closed.

Neither tumbling nor session windows do that: a window starts at a call, not at
a multiple of its length, and calls within it don't prolong it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.cuts import cut

#: So many successive calls of a key make a block, which is one row.
BLOCK = 1024


class Limiter:
    """State of one key, for calls that come one by one."""

    __slots__ = ("count", "ends")

    def __init__(self, count: int = 0, ends: int | None = None):
        self.count, self.ends = count, ends

    def call(self, at: int, limit: int, window: int) -> bool:
        if self.ends is None or at >= self.ends:
            self.count, self.ends = 1, at + window
            return True
        if self.count >= limit:
            return False
        self.count += 1
        return True


def _once(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_successor(calls: DataFrame, window: int, key: str, at: str, tie: str) -> DataFrame:
    """(k, i, f, row): each call's place i among those of its key, from 0, and the place f of the first call at or after the end of a window that it would open.

    Calls and the ends of their windows are sorted together. Both come in the same
    order, so the n-th end is that of the n-th call, and the calls before it are
    its f. Sorting is by ranges of key and time, so that a key may lie in several;
    what goes from range to range is one row of counts for each.
    """
    none = F.lit(None).cast(T.StructType(calls.schema.fields))
    ends = calls.select(F.col(key).alias("k"), (F.col(at) + window).alias("t"), F.lit(0).alias("call"), F.col(tie).alias("tie"), F.struct(*calls.columns).alias("row"))
    both = ends.unionByName(calls.select(F.col(key).alias("k"), F.col(at).alias("t"), F.lit(1).alias("call"), F.col(tie).alias("tie"), none.alias("row")))
    parts = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = cut(both.repartitionByRange(parts, "k", "t", "call", "tie").withColumn("part", F.spark_partition_id()))
    so_far = Window.partitionBy("part", "k").orderBy("t", "call", "tie").rowsBetween(Window.unboundedPreceding, 0)
    counted = ranges.withColumn("calls", F.sum("call").over(so_far)).withColumn("ends", F.sum(1 - F.col("call")).over(so_far))
    totals = ranges.groupBy("part", F.struct("k").alias("of")).agg(F.sum("call").alias("calls"), F.sum(1 - F.col("call")).alias("ends"))
    last = totals.groupBy("part").agg(F.max_by(F.struct("of", "calls", "ends"), "of").alias("x")).select("part", "x.*")
    before = Window.partitionBy("of").orderBy("part")
    carried = last.select(F.lead("part").over(Window.orderBy("part")).alias("to"), "of", F.sum("calls").over(before).alias("c"), F.sum("ends").over(before).alias("e")).where("to is not null")
    same = F.col("of") == F.struct("k")
    joined = counted.where("call = 0").join(F.broadcast(carried), F.col("part") == F.col("to"), "left")
    return joined.select("k", (F.col("ends") - 1 + F.when(same, F.col("e")).otherwise(0)).alias("i"), (F.col("calls") + F.when(same, F.col("c")).otherwise(0)).alias("f"), "row")


def _leaps(start: Column, nodes: Column) -> Column:
    """Of each call of a block the first place beyond the block that windows lead to from it: pointers are doubled within the block."""
    out = F.transform(nodes, lambda x: x["f"])
    for _ in range(BLOCK.bit_length()):
        out = _once(out, lambda f: F.transform(f, lambda v: F.when(v - start < F.size(f), F.get(f, (v - start).cast("int"))).otherwise(v)))
    return out


def _entries(blocks: DataFrame) -> DataFrame:
    """(k, block, entry): of every block in which a window opens, the first such call.

    The leaps of a key's first call through its blocks are found by doubling: the
    nodes are the places that some block's leaps reach, and a round joins each with
    the node that its own leaps end at. So the rounds are the logarithm of a key's blocks.
    """
    first = blocks.where("block = 0").select("k", "block", F.lit(0).cast("long").alias("entry"))
    many = blocks.where((F.col("block") > 0) | (F.size("nodes") == BLOCK))
    leaps = cut(many.select("k", "block", _leaps(F.col("block") * BLOCK, F.col("nodes")).alias("leaps")))
    if leaps.where("block > 0").isEmpty():
        return first
    block = F.floor(F.col("e") / BLOCK)
    nodes = leaps.select("k", F.explode(F.array_distinct("leaps")).alias("e")).unionByName(leaps.where("block = 0").select("k", F.lit(0).cast("long").alias("e"))).distinct()
    at = leaps.select(F.col("k").alias("of"), "block", "leaps")
    jumps = nodes.join(at, F.col("k").eqNullSafe(F.col("of")) & (block == F.col("block"))).select("k", "e", F.get("leaps", (F.col("e") % BLOCK).cast("int")).alias("g"))
    jumps = jumps.where("g is not null")  # the place behind a key's last call is no node
    jumps, reached = cut(jumps), leaps.where("block = 0").select("k", F.lit(0).cast("long").alias("e"))
    while True:
        to = jumps.select(F.col("k").alias("of"), F.col("e").alias("from"), "g")
        further = reached.join(to, F.col("k").eqNullSafe(F.col("of")) & (F.col("e") == F.col("from"))).select("k", F.col("g").alias("e"))
        reached = cut(reached.unionByName(further))
        # A leap out of the key's last block meets no node, and so ends here.
        ahead = to.join(jumps.select("k", "e", F.col("g").alias("beyond")), F.col("of").eqNullSafe(F.col("k")) & (F.col("g") == F.col("e")))
        jumps = cut(ahead.select("k", F.col("from").alias("e"), F.col("beyond").alias("g")))
        if jumps.isEmpty():
            break
    within = reached.select("k", block.alias("block"), F.col("e").alias("entry")).where("entry > 0")
    real = blocks.select(F.col("k").alias("of"), F.col("block").alias("b"), (F.col("block") * BLOCK + F.size("nodes")).alias("end"))
    within = within.join(real, F.col("k").eqNullSafe(F.col("of")) & (F.col("block") == F.col("b")) & (F.col("entry") < F.col("end")), "left_semi")
    return first.unionByName(within)


def limited(calls: DataFrame, limit: int, window_us: int, key: str = "key", at: str = "at_us", tie: str = "id") -> DataFrame:
    """Calls with ``allowed``, and with ``retry_after_s`` where they are not: whole seconds until the window ends. ``at`` in microseconds.

    From each call leads a pointer to the call that opens the next window if this one
    opens one; windows open where pointers lead from a key's first call. They are
    followed in blocks of a key's successive calls, and from block to block by
    doubling, so no task has more than one block at a time, be it a key that never pauses. A call is
    allowed if fewer than ``limit`` are between it and the opener of its window.
    A call without time is none: ``allowed`` is null. Null keys are one key. Columns
    need an order (no maps).
    """
    columns = calls.columns
    timed = calls.where(F.col(at).isNotNull())
    nodes = with_successor(timed, window_us, key, at, tie)
    blocks = cut(nodes.groupBy("k", F.floor(F.col("i") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("i", "f", "row"))).alias("nodes")))
    opener = lambda x: F.struct(x["i"].alias("i"), x["f"].alias("f"), x["row"][at].alias("at"))

    def openers(entry: Column) -> Column:
        """The calls of a block at which windows open, from the first such on."""
        begun = F.struct(entry.alias("next"), F.array().cast("array<struct<i:bigint,f:bigint,at:bigint>>").alias("openers"))
        return F.aggregate("nodes", begun, lambda a, x: F.when(a["next"] == x["i"], F.struct(x["f"].alias("next"), F.concat(a["openers"], F.array(opener(x))).alias("openers"))).otherwise(a))["openers"]

    several = (F.col("block") > 0) | (F.size("nodes") == BLOCK)
    if not blocks.agg(F.bool_or(several)).first()[0]:  # every key begins in its only block
        opened = blocks.select("nodes", "block", openers(F.lit(0).cast("long")).alias("windows"))
    else:
        entries = _entries(blocks).select(F.col("k").alias("of"), F.col("block").alias("b"), "entry")
        opened = blocks.join(entries, F.col("k").eqNullSafe(F.col("of")) & (F.col("block") == F.col("b")), "left").select("k", "block", "nodes", openers(F.col("entry")).alias("openers"))
        # The window that is open where a block begins, which keys of one block don't need: a row a block.
        before = Window.partitionBy("k").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        last = opened.where(several).select("k", "block", F.when(F.size("openers") > 0, F.element_at("openers", -1)).alias("last"))
        carried = last.select(F.col("k").alias("of"), F.col("block").alias("b"), F.last("last", ignorenulls=True).over(before).alias("carried")).where("carried is not null")
        opened = opened.join(carried, F.col("k").eqNullSafe(F.col("of")) & (F.col("block") == F.col("b")), "left")
        opened = opened.select("nodes", "block", F.when(F.col("carried").isNull(), F.col("openers")).otherwise(F.concat(F.array("carried"), "openers")).alias("windows"))

    def members(o: Column) -> Column:
        start = F.col("block") * BLOCK
        low, high = F.greatest(o["i"], start), F.least(o["f"], start + F.size("nodes"))
        own = F.slice("nodes", (low - start + 1).cast("int"), (high - low).cast("int"))
        return F.transform(own, lambda x: F.struct(x["row"].alias("row"), (x["i"] - o["i"]).alias("n"), o["at"].alias("opened")))

    judged = opened.select(F.inline(F.flatten(F.transform("windows", members))))
    allowed = (F.col("n") == 0) | (F.col("n") < limit)
    wait = F.ceil((F.col("opened") + window_us - F.col("row")[at]) / 1_000_000).cast("long")
    out = judged.select(*[F.col("row")[c].alias(c) for c in columns], allowed.alias("allowed"), F.when(~allowed, wait).alias("retry_after_s"))
    never = calls.where(F.col(at).isNull()).select(*columns, F.lit(None).cast("boolean").alias("allowed"), F.lit(None).cast("long").alias("retry_after_s"))
    return out.unionByName(never)
