"""Taking records in: what is there already, and duplicates within the batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import commit_log
from quillon.operators.components import components
from quillon.operators.cuts import cut
from quillon.operators.mutations import with_defaults
from quillon.operators.ordered import with_rank
from quillon.schemas import BUSINESS

#: Components of so many records or fewer are folded, each in one task; between attempts at that go so many rounds.
FOLDED, ROUNDS = 50_000, 2


def unseen(records: DataFrame, existing: DataFrame, key: str = "gbp_place_id") -> DataFrame:
    """Records whose key isn't there yet; an empty or null key never matches."""
    own = F.nullif(F.col(f"r.{key}"), F.lit(""))
    spread = F.when(own.isNull(), F.xxhash64("r.name")).otherwise(0)
    return records.alias("r").join(existing.select(F.col(key).alias("__k")).distinct(), (own == F.col("__k")) & (spread == 0), "left_anti")


def _keyed(rows: DataFrame) -> DataFrame:
    address = F.to_json(F.struct(F.lower("name").alias("n"), F.col("address").alias("a")))  # null addresses are equal
    return rows.withColumn("__place", F.nullif(F.col("gbp_place_id"), F.lit(""))).withColumn("__who", address)


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, places, names = None, set(), set()
    for batch in batches:
        keep = []
        for group, place, who in zip(batch["__group"], batch["__place"], batch["__who"], strict=True):
            if group != now:
                now, places, names = group, set(), set()
            new = who not in names and (place is None or place not in places)
            keep.append(new)
            if new:
                names.add(who)
                if place is not None:
                    places.add(place)
        yield batch[keep]


def _grouped(rows: DataFrame) -> DataFrame:
    """``rows`` with ``__group``: records that matches lead to from each other, by connected components of their place ids and names."""
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    found = components(rows.where("__place is not null").select(node("p", "__place").alias("a"), node("w", "__who").alias("b")))
    # A record's name is of the component of its place id; a name that no record joins to a place id is one by itself.
    of = found.where(F.col("node").startswith("w")).select(F.expr("substring(node, 2)").alias("__name"), "component")
    return rows.join(of, F.col("__who") == F.col("__name"), "left").withColumn("__group", F.coalesce("component", node("w", "__who"))).drop("__name", "component")


def deduplicate(records: DataFrame, existing: DataFrame, order: str = "row") -> DataFrame:
    """Records in order, each kept unless it matches the store or a record kept before it.

    Two records match if they have the same place id, or the same name in lower
    case and the same address. A record that is itself dropped drops no other, so
    the result is a fixpoint: of the undecided, those that come first under both
    their keys are kept, what matches them is dropped, and the rest goes on. Such a
    round is two pre-aggregated minimums and joins; no group is gathered anywhere.
    What a few rounds leave are chains. Records of different components never
    meet, so each component is folded in its order, many beside each other; one of over
    ``FOLDED`` records goes through further rounds until it is down to that or in pieces.
    Row numbers are taken to be unique; of records with the same number and keys any may be the one kept.
    """
    rows = _keyed(records)
    store = _keyed(existing)
    # Records without place id meet nothing by it; they are spread by their names.
    nowhere = F.when(F.col("__place").isNull(), F.xxhash64("__who")).otherwise(0) == 0

    def without(left: DataFrame, kept: DataFrame) -> DataFrame:
        left = left.join(kept.select(F.col("__place").alias("__p")).where("__p is not null").distinct(), (F.col("__place") == F.col("__p")) & nowhere, "left_anti")
        return left.join(kept.select(F.col("__who").alias("__w")).distinct(), F.col("__who") == F.col("__w"), "left_anti")

    def first(left: DataFrame, key: str, name: str, also: Column) -> DataFrame:
        least = left.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"__key_{name}")).agg(F.min(order).alias(name))
        return left.join(least, (F.col(key) == F.col(f"__key_{name}")) & also, "left").drop(f"__key_{name}")

    undecided = cut(without(rows, store))
    kept = undecided.limit(0)
    while True:
        for _ in range(ROUNDS):
            marked = first(first(undecided, "__place", "__first_place", nowhere), "__who", "__first_who", F.lit(True))
            won = marked.where(((F.col("__first_place").isNull()) | (F.col("__first_place") == F.col(order))) & (F.col("__first_who") == F.col(order)))
            won = cut(won.drop("__first_place", "__first_who"))
            kept = kept.unionByName(won)
            undecided = cut(without(undecided, won))
            if undecided.isEmpty():
                return kept.drop("__place", "__who")
        grouped = _grouped(undecided)
        small = grouped.groupBy(F.col("__group").alias("__g")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= FOLDED).select("__g")
        grouped = cut(grouped.join(small, F.col("__group") == F.col("__g"), "left"))
        own = grouped.where("__g is not null").drop("__g")
        parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        folded = own.repartition(parts, "__group").sortWithinPartitions("__group", order).mapInPandas(_fold, own.schema)
        kept = kept.unionByName(folded.drop("__group"))
        undecided = grouped.where("__g is null").drop("__g", "__group")
        if undecided.isEmpty():
            return kept.drop("__place", "__who")


def import_batch(records: DataFrame, errors: DataFrame, existing: DataFrame, path: str, owner_id: int, job_id: int) -> DataFrame:
    """Add what is new to the table at ``path`` as rows of the owner and job; one row of counts: inserted, duplicates, error_rows, status, progress_current, progress_total.

    New is what matches neither ``existing``, nor a row of the table, nor a record
    kept before it. Ids go on from the table's highest, in the order of the records. A job
    whose id the table lists adds nothing and gives the counts of its first run, so
    a retry is safe; if another import comes first, this one starts anew from what that has added.
    """
    spark = records.sparkSession
    keys = ["name", "address", "gbp_place_id"]

    def build(was: commit_log.Snapshot):
        store = existing.select(*keys).unionByName(commit_log.read(spark, path, BUSINESS, was).select(*keys))
        new = with_rank(deduplicate(records, store), ["row"], "id", was.high)
        now = F.current_timestamp()
        rows = with_defaults(new, BUSINESS, id=F.col("id"), owner_id=owner_id, source_job_id=job_id, created_at=now, updated_at=now)

        def report() -> dict:
            inserted, total, wrong = new.count(), records.count(), errors.count()
            return {"inserted": inserted, "duplicates": total - inserted, "error_rows": wrong, "status": "COMPLETED", "progress_current": total, "progress_total": total}

        return rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "id"), [], report

    said = commit_log.commit(spark, path, f"import-{job_id}", build)
    return spark.createDataFrame([said], "inserted long, duplicates long, error_rows long, status string, progress_current long, progress_total long")
