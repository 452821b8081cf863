"""Auditing filters that are applied one after the other, in every order.

Documents are scanned once, as Arrow buffers: byte classes and prefix sums count
words, capitals, symbols and code points of each document; the word hashes of a
document are sorted, equal neighbours are compared byte by byte, and what is left
are its distinct words. Each document becomes a mask of the filters that it fails.
A filter on copies needs the whole table: of equal texts, by a 128-bit digest of
the text, all but those with the smallest id fail it. Copies of a text are counted
before they meet, so a text that very many documents share is a few rows. From the
counts of each mask every order follows by arithmetic, without further passes.

Null texts are empty. Rows with the same id are documents of their own and no
copies of each other; a null id is neither a copy nor an original. A document
without label is neither good nor toxic; of several labels the greatest counts.
Null parts are the empty string. An empty table has no parts, and so no rows.
Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import byte_words as w

IS_UPPER = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
IS_SYMBOL = np.isin(np.arange(256), list(b"#$%&*|"))
BEGINS_POINT = (np.arange(256) & 0xC0) != 0x80

MEASURES = ("n_words", "n_distinct", "n_upper", "n_symbols", "n_chars")

#: What fails, by one-letter name; None: the filter on copies.
FILTERS: dict[str, Callable[[], Column] | None] = {
    "A": lambda: F.col("n_words") < 200,
    "B": lambda: 100 * F.col("n_distinct") < 50 * F.col("n_words"),
    "C": lambda: 100 * F.col("n_upper") > 2 * F.col("n_chars"),
    "D": lambda: F.col("n_symbols") > 0,
    "E": None,
}


def distinct_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The number of distinct words of each text."""
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((hashes, text))
    a, b = order[:-1], order[1:]
    repeated = np.flatnonzero((hashes[a] == hashes[b]) & (text[a] == text[b]))
    a, b = a[repeated], b[repeated]
    same = w.same_words(data, start, end, a, b)
    out = count - np.bincount(text[a], minlength=len(count))
    for i in np.unique(text[a[~same]]):  # two words with one hash: count these texts' words themselves
        out[i] = len({data[x:y].tobytes() for x, y in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]], strict=True)})
    return out


def measured(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """MEASURES of the texts between ``bounds``."""

    def count(kind: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, "i8")
        np.cumsum(kind[data], out=sums[1:])
        return np.diff(sums[bounds])

    start, end, first, (hashes,) = w.words(data, bounds)
    return [np.diff(first), distinct_words(data, start, end, first, hashes), count(IS_UPPER), count(IS_SYMBOL), count(BEGINS_POINT)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = w.buffers(batch.column(batch.num_columns - 1))
        found, digests = [[] for _ in MEASURES], []
        for low, high in w.portions(at):
            own, bounds = data[at[low] : at[high]], at[low : high + 1] - at[low]
            for to, x in zip(found, measured(own, bounds), strict=True):
                to.append(x)
            digests += [hashlib.blake2b(own[a:b], digest_size=16).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        columns = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in found]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns, pa.array(digests, pa.binary())], names=[*batch.schema.names[:-1], *MEASURES, "digest"])


def measure(docs: DataFrame, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of each document, its MEASURES and a digest of its text."""
    own = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text_col).alias("text"))
    kinds = T.StructType([*own.schema.fields[:-1], *(T.StructField(m, T.LongType()) for m in MEASURES), T.StructField("digest", T.BinaryType())])
    return own.mapInArrow(_scan, kinds)


def masks(docs: DataFrame, labels: DataFrame, filters=FILTERS, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters that they fail, the first filter as bit 0."""
    copies = sum(1 << i for i, f in enumerate(filters.values()) if f is None)
    mask = F.lit(0)
    for i, f in enumerate(filters.values()):
        if f is not None:
            mask = mask.bitwiseOR(F.when(f(), 1 << i).otherwise(0))
    rows = measure(docs, {"id": F.col(id_col), "part": F.coalesce(F.col(part_col).cast("string"), F.lit(""))}, text_col)
    rows = rows.select("id", "part", "digest", mask.alias("mask")).groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    label = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("of")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    rows = rows.join(label, F.col("id") == F.col("of"), "left").select("id", "part", "digest", "mask", "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    # Of a text, one row for each part and label: its documents, those without id, and those with the smallest id.
    texts = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first")
    )
    least = texts.groupBy("digest").agg(F.min("first.id").alias("least")).withColumnRenamed("digest", "of")
    original = F.col("nameless") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask").alias("mask"), original.alias("n")), F.struct(F.col("mask").bitwiseOR(copies).alias("mask"), (F.col("n") - original).alias("n")))
    split = texts.join(least, F.col("digest") == F.col("of")).select("part", "good", "toxic", F.explode(both).alias("x"))
    return split.groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic")
    )


def audit(docs: DataFrame, labels: DataFrame, filters=FILTERS, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each part, order of the filters and step.

    ``kept`` are documents after the step, ``removed`` those that it removes,
    ``redundant`` those that fail its filter and were removed before it, ``unique_fails``
    those that fail no other filter; ``good_lost`` and ``toxic_lost`` are among the
    removed. ``shapley`` is what its filter removes, summed over all orders: a document that
    fails k filters is removed by each of them in one of k orders.
    """
    names = "".join(filters)
    if len(names) != len(filters) or not 0 < len(filters) < 8 or sum(f is None for f in filters.values()) > 1:
        raise ValueError("filters have names of one letter, are 1 to 7, and at most one of them is on copies")
    counts = masks(docs, labels, filters, part_col, id_col, text_col)
    # A part has as many counts as there are masks: at most 2 to the number of filters.
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    steps = parts.select("part", "counts", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(names)])).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(names)))).alias("step"))
    bits = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, 1 << i)])
    letters = F.split("filter_order", "")
    steps = steps.withColumn("bit", bits[F.get(letters, F.col("step") - 1)])
    steps = steps.withColumn("before", F.aggregate(F.slice(letters, 1, F.col("step") - 1), F.lit(0), lambda a, x: a + bits[x]))

    def total(what: str, when: Callable[[Column], Column], weight: Callable[[Column], Column] = lambda c: F.lit(1)) -> Column:
        return F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + F.when(when(c["mask"]), c[what] * weight(c["mask"])).otherwise(0))

    bit, before, fails = F.col("bit"), F.col("before"), lambda m: m.bitwiseAND(F.col("bit")) != 0
    removed = lambda m: fails(m) & (m.bitwiseAND(before) == 0)
    return steps.select(
        "part", "filter_order", "step",
        total("n", lambda m: m.bitwiseAND(before + bit) == 0).alias("kept"), total("n", removed).alias("removed"),
        total("n", lambda m: fails(m) & (m.bitwiseAND(before) != 0)).alias("redundant"), total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"),
        total("n", fails, lambda m: (math.factorial(len(names)) / F.bit_count(m)).cast("long")).alias("shapley"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_NAMES = ", ".join(f"'{n}'" for n in FILTERS)

ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
m AS (
  SELECT doc_id, part, text, (len(words) < 200)::INT
    + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), FALSE)::INT AS mask FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
c AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY 1, 2),
f AS (SELECT unnest([{_NAMES}]) AS letter, unnest(range({len(FILTERS)})) AS i),
o AS (
  SELECT '' AS filter_order
  UNION ALL SELECT filter_order || letter FROM o, f WHERE NOT contains(filter_order, letter)),
s AS (
  SELECT filter_order, step, (1 << (SELECT i FROM f WHERE letter = filter_order[step]))::INT AS bit,
    CAST(list_sum(list_transform(range(1, step), lambda k: CASE filter_order[k] {" ".join(f"WHEN '{n}' THEN {1 << i}" for i, n in enumerate(FILTERS))} END)) AS INTEGER) AS earlier
  FROM (SELECT filter_order, unnest(range(1, {len(FILTERS) + 1})) AS step FROM o WHERE length(filter_order) = {len(FILTERS)})),
t AS (SELECT part, filter_order, step, bit, coalesce(earlier, 0) AS earlier, mask, n, good, toxic FROM s, c)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
  CAST(coalesce(sum(n) FILTER (mask & (earlier + bit) = 0), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier <> 0), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * {math.factorial(len(FILTERS))} // greatest(bit_count(mask), 1)) FILTER (mask & bit <> 0), 0) AS BIGINT) AS shapley
FROM t GROUP BY 1, 2, 3
"""
