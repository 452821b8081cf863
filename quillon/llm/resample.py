"""Drawing documents that look like a target: importance weights from hashed word n-grams, with Gumbel noise.

A task adds the n-grams of its texts to a trie of words, whose nodes hold how often
their n-gram occurred and the state of its CRC, so that a longer n-gram costs one
more word. Its counts go into buckets by CRC; the buckets of all tasks are summed.
The gain of a bucket is the logarithm of its share of the target over its share of
the documents. A second pass walks the same paths in tries with gains attached and
takes their mean. Adding Gumbel noise, which depends on seed and id alone, to
the weights and taking the largest draws without replacement. Ranks come from a
histogram of the integer scores, which has a bounded number of rows.

Tries are emptied once they hold ``MOST_NODES`` n-grams; their counts are in the
buckets by then, so nothing is lost. What is broadcast is one gain a bucket and one
row for each of the highest scores.

Null and empty texts, and texts without words, have no features and weight 0. A
null id is the empty string in the noise and comes last in ties. Rows with the same
id have the same noise and are drawn each on its own; of equal rows any comes
first. Empty tables give no rows; without target, weights come from the documents
alone. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.shared import materialize, values

#: So many n-grams a trie holds before it is emptied.
MOST_NODES = 300_000

#: Digits, letters in lower case and all bytes of other characters make words; the rest separates.
_LOWER = b"abcdefghijklmnopqrstuvwxyz"
_WORD = {*b"0123456789", *_LOWER, *range(0x80, 0x100)}
_TABLE = bytes(c if c in _WORD else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Node(dict):
    """An n-gram, with the nodes of those one word longer by that word."""

    __slots__ = ("trie", "crc", "after", "count", "gain")

    def __init__(self, trie: Trie, crc: int, after: int):
        self.trie, self.crc, self.after, self.count, self.gain = trie, crc, after, 0, 0

    def __missing__(self, word: bytes) -> Node:
        crc = zlib.crc32(word, self.after)
        node = self[word] = Node(self.trie, crc, zlib.crc32(b" ", crc))
        trie = self.trie
        trie.size += 1
        if trie.gains is not None:
            node.gain = trie.gains[crc % len(trie.gains)]
        return node


class Trie:
    """N-grams of up to ``longest`` words."""

    def __init__(self, longest: int, gains: list[int] | None = None):
        self.longest, self.gains = longest, gains
        self.clear()

    def clear(self) -> None:
        self.size, self.root = 0, Node(self, 0, 0)

    def add(self, text: bytes) -> None:
        found = words(text)
        for i, word in enumerate(found):
            node = self.root[word]
            node.count += 1
            for word in found[i + 1 : i + self.longest]:
                node = node[word]
                node.count += 1

    def gain(self, text: bytes) -> tuple[int, int, int]:
        """(words, features, sum of their gains)."""
        found, total = words(text), 0
        for i, word in enumerate(found):
            node = self.root[word]
            total += node.gain
            for word in found[i + 1 : i + self.longest]:
                node = node[word]
                total += node.gain
        n = len(found)
        return n, sum(max(0, n - k) for k in range(self.longest)), total

    def pour(self, totals: list[int]) -> None:
        """Add all counts to their buckets, and empty the trie."""
        nodes = [self.root]
        while nodes:
            node = nodes.pop()
            totals[node.crc % len(totals)] += node.count
            nodes += node.values()
        self.clear()


def totals(texts: DataFrame, longest: int, buckets: int, text_col: str = "text") -> list[int]:
    """How many n-grams of all texts fall into each bucket; the driver gets a number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, trie = [0] * buckets, Trie(longest)
        for batch in batches:
            for text in values(batch.column(0)):
                if text:
                    trie.add(text)
                    if trie.size > MOST_NODES:
                        trie.pour(own)
        trie.pour(own)
        full = [i for i, n in enumerate(own) if n]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([own[i] for i in full], pa.int64())], names=["bucket", "n"])

    out = [0] * buckets
    for row in texts.select(F.col(text_col).cast("binary")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """Thousandths of the logarithm of each bucket's share of the target over that of the source, one feature added to every bucket."""
    s, t, n = sum(source), sum(target), len(source)
    return [math.floor(1000 * math.log(float((y + 1) * (s + n)) / float((x + 1) * (t + n)))) for x, y in zip(source, target, strict=True)]


def weights(docs: DataFrame, gain: list[int], longest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(longest, gain)
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for text in values(batch.column(1)):
                m, n, total = trie.gain(text or b"")
                n_words.append(m)
                n_features.append(n)
                weight.append(total // n if n else 0)
                if trie.size > MOST_NODES:
                    trie.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in (n_words, n_features, weight)]], names=["doc_id", "n_words", "n_features", "weight"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema[0].dataType.simpleString()}, n_words long, n_features long, weight long")


def ranked(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """Adds ``rank``: 1 for the highest score of those with enough words, down to that share of them; null for the rest."""
    able = F.col("n_words") >= min_words
    # Scores are integers between the logarithms of counts: a row for each is some tens of thousands.
    levels = scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = levels.select(F.col("score").alias("level"), above.alias("above"), F.expr(f"{percent} * sum(n) over () div 100").alias("drawn")).where("above < drawn")
    joined = scored.join(F.broadcast(levels), able & (F.col("score") == F.col("level")), "left")
    place = F.col("above") + F.row_number().over(Window.partitionBy("level").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight"))
    high = joined.where("level is not null").withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank")))
    return high.unionByName(joined.where("level is null").withColumn("rank", F.lit(None).cast("long"))).select(*scored.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; those drawn have a rank."""
    gain = gains(totals(docs, longest, buckets, text_col), totals(target, longest, buckets, target_col))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weights(docs, gain, longest, id_col, text_col).withColumn("score", F.col("weight") + noise)
    return ranked(materialize(scored, "scores"), percent, min_words)


def query(spark, sf_dir: str) -> DataFrame:
    out = resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, FALSE AS target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
  UNION ALL
  SELECT NULL, TRUE, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
u AS (SELECT doc_id, target, unnest(words) AS word FROM w),
k AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs),
x AS (
  SELECT word, list_transform(range(octet_length(encode(word))), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT)) AS bytes
  FROM (SELECT DISTINCT word FROM u)),
b AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(crcs[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM x, k),
n AS (
  SELECT r.bucket, count(word) FILTER (NOT target) AS s, count(word) FILTER (target) AS t
  FROM range(10000) r(bucket) LEFT JOIN (SELECT target, word, b.bucket FROM u JOIN b USING (word)) q ON q.bucket = r.bucket GROUP BY 1),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (sum(s) OVER () + 10000) AS DOUBLE) / CAST((s + 1) * (sum(t) OVER () + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM n),
f AS (SELECT doc_id, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM u JOIN b USING (word) JOIN g USING (bucket) WHERE NOT target GROUP BY 1),
d AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || w.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM w LEFT JOIN f ON w.doc_id = f.doc_id WHERE NOT target),
r AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM d)
SELECT doc_id, n_features, weight, score,
  CASE WHEN place <= 10 * (SELECT count(*) FROM d WHERE n_features >= 20) // 100 THEN place END AS rank FROM r
"""
