"""Finding names that contain a term, by an inverted index of their trigrams.

The index is two tables: the names, in files of disjoint ranges of ids, and for each
trigram of lower-case names the ids that have it, in lists of a block of ids each. A term's own
trigrams are looked up (the lists are sorted by trigram, so Parquet's statistics
skip the others), their lists are intersected block by block, and the names of what is left are read,
out of the files that hold such ids, and held against the term. No list is
longer than a block, however common a trigram is.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators import commit_log

#: Ids in a block: a list holds so many at most.
BLOCK = 1 << 14

NAMES = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
LISTS = T.StructType([T.StructField("gram", T.StringType()), T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType()))])


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a text in lower case."""
    low = F.lower(text)
    return F.when(F.char_length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))))


def build(spark: SparkSession, path: str, rows: DataFrame, files: int | None = None) -> None:
    """Write the index of rows (id, name). Null names are in no result; ids are unique."""
    parts = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = rows.where("id is not null and name is not null").select(F.col("id").cast("long").alias("id"), "name")
    commit_log.commit(spark, f"{path}/names", "build", lambda was: (own.repartitionByRange(parts, "id").sortWithinPartitions("id"), [], dict))
    grams = own.select("id", F.explode(trigrams(F.col("name"))).alias("gram"))
    lists = grams.groupBy("gram", F.floor(F.col("id") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    lists.repartitionByRange(parts, "gram", "block").sortWithinPartitions("gram", "block").write.parquet(f"{path}/lists")


def candidates(spark: SparkSession, path: str, grams: list[str]) -> DataFrame:
    """Ids whose names have all the trigrams."""
    lists = spark.read.schema(LISTS).parquet(f"{path}/lists").where(F.col("gram").isin(grams))
    # A term has a bounded number of trigrams, and each a list of a block at most.
    met = lists.groupBy("block").agg(F.collect_list("ids").alias("all")).where(F.size("all") == len(grams))
    both = F.aggregate(F.slice("all", 2, F.size("all")), F.get("all", F.lit(0)), lambda a, x: F.array_intersect(a, x))
    return met.select(F.explode(both).alias("id"))


def search(spark: SparkSession, path: str, term: str, wildcards: bool = False) -> DataFrame:
    """(id, name) of the names that contain the term, whatever the case.

    With ``wildcards``, ``%`` stands for any characters and ``_`` for any one, as in ILIKE.
    Where no piece of the term has three characters, all names are looked through.
    """
    found = F.col("name").ilike(f"%{term}%") if wildcards else F.contains(F.lower("name"), F.lower(F.lit(term)))
    # Of a pattern, what an escape or a wildcard divides.
    pieces = re.split(r"\\.|[%_]", term) if wildcards else [term]
    (row,) = spark.createDataFrame([([p for p in pieces if p],)], "p array<string>").select(F.array_distinct(F.flatten(F.filter(F.transform("p", trigrams), lambda x: x.isNotNull()))).alias("g")).collect()
    at = commit_log.snapshot(spark, f"{path}/names")
    if not row.g:
        return commit_log.read(spark, f"{path}/names", NAMES, at).where(found)
    ids = candidates(spark, path, row.g)
    files = commit_log.holding(ids, at.files, "id")
    if not files:
        return spark.createDataFrame([], NAMES)
    return spark.read.schema(NAMES).parquet(*files).where(found).join(ids, "id", "left_semi")
