"""Dropping lines that many documents share.

Lines are exploded with their positions and a normalised key, keys are hashed to 128
bits, the distinct documents of each hash are counted, and documents are put together
again from the positions that stay, in their order. Of the documents that hold a line over the
threshold the one with the largest id keeps it. Only ids, positions and hashes
of long lines are shuffled for the count; a hash that very many documents share
is pre-aggregated before it is shuffled and its join is split when skewed. All
is built-in functions.

Null and empty texts are one empty line and stay as they are. A null id counts
as no document and loses nothing. Rows with the same id count as one document
and lose the same lines. Columns of the input pass through; ``n_lines`` and
``n_dropped`` replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import materialize

#: The white space and the letters that a key leaves out or folds.
WHITE = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def shared_lines(docs: DataFrame, min_chars: int, min_docs: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(document, text, position, hash) of every long line, and per hash over the threshold the document that keeps it. A text is told by its hash, since an id may have several."""
    keys = F.transform(F.split(F.col(text_col), "\n", -1), lambda line, i: F.struct(i.alias("pos"), line_key(line).alias("key")))
    long = F.transform(F.filter(keys, lambda k: F.char_length(k["key"]) >= min_chars), lambda k: F.struct(k["pos"].alias("__pos"), F.unhex(F.md5(k["key"])).alias("__hash")))
    # Hashed before they are exploded: no line's row carries the text.
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__doc"), F.xxhash64(text_col).alias("__text"), long.alias("__lines"))
    held = materialize(texts.select("__doc", "__text", F.inline("__lines")), "lines")
    over = held.select("__doc", "__hash").dropDuplicates().groupBy("__hash").agg(F.count(F.lit(1)).alias("n"), F.max("__doc").alias("keeper")).where(F.col("n") >= min_docs)
    return held, materialize(over.select(F.col("__hash").alias("__over"), "keeper"), "shared-lines")


def drop_shared_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their shared lines, with n_lines (before) and n_dropped."""
    held, over = shared_lines(docs, min_chars, min_docs, id_col, text_col)
    drops = (
        held.join(over, F.col("__hash") == F.col("__over"))
        .where(F.col("__doc") < F.col("keeper"))
        .groupBy("__doc", "__text")
        .agg(F.collect_set("__pos").alias("__drops"))
    )
    # The row's other columns travel as one, so that no name clashes. Rows without id meet nothing; their texts spread them.
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(F.struct(*[c for c in own if c != text_col], F.lit(0).alias("__any")).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    joined = rows.join(drops, (F.col("id") == F.col("__doc")) & (F.col("hash") == F.col("__text")), "left")

    def put_together(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drops"))
        kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
        return F.struct(F.when(F.col("__drops").isNull(), F.col("text")).otherwise(kept).alias("text"), F.size(lines).alias("n"))

    # As an argument of a lambda the split is made once for a text.
    whole = F.element_at(F.transform(F.array(F.split("text", "\n", -1)), put_together), 1)
    out = joined.select("row", whole.alias("new"), F.size("__drops").alias("d")).select("row", "new.text", "new.n", "d")
    keep = [F.col("text") if c == text_col else F.col("row")[c].alias(c) for c in own]
    count = lambda c, least, name: F.greatest(F.col(c), F.lit(least)).cast("long").alias(name)
    return out.select(*[k.alias(c) for k, c in zip(keep, own, strict=True)], count("n", 1, "n_lines"), count("d", 0, "n_dropped"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = drop_shared_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, (s.key IS NOT NULL AND k.doc_id < s.keeper) AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS BIGINT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
