"""Connected components of a table of links, as joins over materialised tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import materialize

#: Rows in a file of links or labels, about. Few rows are not spread over all partitions of the session, where each would be a task and a file of its own.
FILE_ROWS = 50_000


def few_files(rows: DataFrame, at_most: int) -> DataFrame:
    """In as many partitions as so many rows fill, and no more than there are."""
    return rows.coalesce(max(1, -(-at_most // FILE_ROWS)))


def _flat(hooks: DataFrame, at_most: int) -> DataFrame:
    """Follow (node, up) to the top: each round doubles the steps taken, thrice."""
    while True:
        now = hooks
        for i in range(2):
            ups = hooks.select(F.col("node").alias(f"n{i}"), F.col("up").alias(f"u{i}"))
            now = now.join(ups, now["up"] == ups[f"n{i}"], "left").select("node", F.coalesce(f"u{i}", "up").alias("up"), *(["was"] if i else [now["up"].alias("was")]))
        now = materialize(few_files(now, at_most), "hooks")
        if now.where("up <> was").isEmpty():
            return now.select("node", "up")
        hooks = now.select("node", "up")


def components(links: DataFrame) -> DataFrame:
    """Of links (a, b) between longs: (node, label) for every node, label being the smallest node reachable.

    Every node hooks to its smallest smaller neighbour, the forest of hooks is
    flattened, links are carried over to the tops of their trees, and so on until
    none is left. A round at least halves the nodes that still have links. The
    smallest node of a link is taken per node before anything is shuffled, so a
    node with very many links is no hot key; the joins are between written tables
    and can be split where they are skewed.
    """
    rest = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    all_hooks, nodes = None, 0
    while n := rest.count():
        hooks = _flat(materialize(few_files(rest.groupBy("hi").agg(F.min("lo").alias("up")).withColumnRenamed("hi", "node"), n), "hooks"), n)
        nodes += n
        all_hooks = hooks if all_hooks is None else all_hooks.unionAll(hooks)
        high = hooks.select(F.col("node").alias("hi"), F.col("up").alias("top_hi"))
        low = hooks.select(F.col("node").alias("lo"), F.col("up").alias("top_lo"))
        moved = rest.join(high, "hi").join(low, "lo", "left").select("top_hi", F.coalesce("top_lo", "lo").alias("top_lo"))
        moved = moved.where("top_hi <> top_lo").select(F.greatest("top_hi", "top_lo").alias("hi"), F.least("top_hi", "top_lo").alias("lo"))
        rest = materialize(few_files(moved.distinct(), n), "links")
    if all_hooks is None:
        return rest.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
    labels = _flat(materialize(few_files(all_hooks, nodes), "hooks"), nodes).select("node", F.col("up").alias("label"))
    tops = labels.select(F.col("label").alias("node"), "label").distinct()
    return materialize(few_files(labels.unionAll(tops), 2 * nodes), "labels")
