"""Preference pairs for training: one prompt, two masked completions.

The longest common prefix of turns of a chosen and a rejected conversation is
rendered once as prompt; what follows in either is its completion, with the
character spans of the assistant's words as its mask. All steps are built-in
functions on arrays of turns.

Turns are ordered by number, then role and text; a turn without number comes
first. Null roles and texts render as empty. A pair whose conversations are
equal has two empty completions, a pair without one side only nulls. A conversation without partner, or without a
turn of the assistant, has no rejected side: its columns are null and ``paired``
is false. Other columns are ignored; an empty table gives no rows. The turns of
a conversation are gathered in one row, since they are one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands around a turn; ``{role}`` is replaced.
BEFORE, AFTER = "<|{role}|>\n", "<|end|>\n"
SPOKEN = "assistant"
#: Turns whose lengths are added up together.
CHUNK = 256


def _header(role: Column) -> Column:
    first, last = BEFORE.split("{role}")
    return F.concat(F.lit(first), role, F.lit(last))


def render(turns: Column) -> Column:
    """Text of an array of struct<role, text>."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t["role"]), t["text"], F.lit(AFTER))), "")


def _sums(lengths: Column) -> Column:
    """Of each length, the sum of those before it."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("sums"))
    step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["sums"], F.array(acc["at"])).alias("sums"))
    return F.aggregate(lengths, start, step, lambda acc: acc["sums"])


def mask(turns: Column) -> Column:
    """Spans [start, end) in render(turns) of what the assistant says, as array<struct<start, end>>.

    Lengths are added up within chunks and over chunks, so a conversation of
    very many turns doesn't copy a growing array for each of them.
    """
    heads = F.transform(turns, lambda t: F.char_length(_header(t["role"])))
    lengths = F.transform(turns, lambda t: F.char_length(_header(t["role"])) + F.char_length(t["text"]) + len(AFTER))
    n = F.size(turns)
    at = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))

    def spans(chunks: Column) -> Column:
        bases = _sums(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)))
        starts = F.flatten(F.zip_with(chunks, bases, lambda c, base: F.transform(_sums(c), lambda x: x + base)))
        begins = F.zip_with(starts, heads, lambda x, h: x + h)
        whole = F.zip_with(turns, begins, lambda t, x: F.struct(t["role"].alias("role"), x.alias("start"), (x + F.char_length(t["text"])).alias("end")))
        return F.transform(F.filter(whole, lambda s: s["role"] == SPOKEN), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    # Through a one-element array the chunks are made once, not for each use.
    return F.flatten(F.transform(F.array(F.transform(at, lambda i: F.slice(lengths, i * CHUNK + 1, CHUNK))), spans))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two arrays have in common at their start."""
    n = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs > 0, differs.cast("int") - 1).otherwise(n)


def conversations(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """conv_id and its turns in order, as array<struct<role, text>>."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = turns.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("turn"), role.alias("role"), text.alias("text")))).alias("t"))
    return whole.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """Of (pair_id, chosen, rejected): pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask."""
    both = F.col("chosen").isNotNull() & F.col("rejected").isNotNull()
    cut = pairs.select("pair_id", F.when(both, F.col("chosen")).alias("chosen"), F.when(both, F.col("rejected")).alias("rejected"), F.when(both, common_turns(F.col("chosen"), F.col("rejected"))).alias("n_common"))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.size(c))
    parts = cut.select("pair_id", "n_common", F.slice("chosen", F.lit(1), F.col("n_common")).alias("p"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    return parts.select(
        "pair_id", "n_common", render(F.col("p")).alias("prompt"), render(F.col("c")).alias("chosen"), render(F.col("r")).alias("rejected"),
        mask(F.col("c")).alias("chosen_mask"), mask(F.col("r")).alias("rejected_mask"),
    )


def swapped_replies(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Pairs from plain conversations: each is chosen; rejected is the same with its last reply taken from its neighbour (ids 2k and 2k + 1)."""
    whole = conversations(turns, id_col).where(F.col("conv_id").isNotNull())
    last = F.size("turns") - F.array_position(F.transform(F.reverse("turns"), lambda t: t["role"] == SPOKEN), True) + 1
    whole = whole.select("conv_id", "turns", last.cast("int").alias("last")).select("conv_id", "turns", F.when(F.col("last") <= F.size("turns"), F.col("last")).alias("last"))
    replies = whole.where("last is not null").select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("of"), F.element_at("turns", F.col("last")).alias("reply"))
    both = whole.join(replies, F.col("conv_id") == F.col("of"), "left")
    other = F.transform("turns", lambda t, i: F.when(i + 1 == F.col("last"), F.col("reply")).otherwise(t))
    return both.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.when(F.col("last").isNotNull() & F.col("reply").isNotNull(), other).alias("rejected"))


def query(spark, sf_dir: str) -> DataFrame:
    out = format_preferences(swapped_replies(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select(
        F.col("pair_id").alias("conv_id"), F.col("rejected").isNotNull().alias("paired"), F.col("n_common").cast("long").alias("n_common"),
        F.sha2("prompt", 256).alias("prompt_sha256"), F.sha2("chosen", 256).alias("chosen_sha256"), F.sha2("rejected", 256).alias("rejected_sha256"),
        spans(F.col("chosen_mask")).alias("chosen_mask"), spans(F.col("rejected_mask")).alias("rejected_mask"),
    )


ORACLE = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
lastk AS (SELECT conv_id, max(k) FILTER (WHERE role = 'assistant') AS last, max(k) AS n FROM t GROUP BY conv_id),
reply AS (SELECT xor(t.conv_id, 1) AS conv_id, t.role, t.text FROM t JOIN lastk l ON t.conv_id = l.conv_id AND t.k = l.last),
info AS (
  SELECT l.conv_id, l.last, l.n, r.text AS reply, (l.last IS NOT NULL AND r.conv_id IS NOT NULL) AS paired
  FROM lastk l LEFT JOIN reply r ON l.conv_id = r.conv_id),
sides AS (
  SELECT t.conv_id, t.k, t.role, t.text, i.paired, i.n, i.last,
         CASE WHEN t.k = i.last THEN i.reply ELSE t.text END AS other
  FROM t JOIN info i ON t.conv_id = i.conv_id),
common AS (
  SELECT conv_id, coalesce(min(k) FILTER (WHERE text <> other) - 1, max(n)) AS n_common
  FROM sides WHERE paired GROUP BY conv_id),
r AS (
  SELECT s.*, c.n_common,
         '<|' || role || '|>' || chr(10) AS head,
         '<|end|>' || chr(10) AS tail
  FROM sides s LEFT JOIN common c ON s.conv_id = c.conv_id),
p AS (
  SELECT *, sum(CASE WHEN k > n_common THEN length(head || text || tail) ELSE 0 END) OVER w AS c_at,
         sum(CASE WHEN k > n_common THEN length(head || other || tail) ELSE 0 END) OVER w AS r_at
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, bool_and(paired) AS paired, CAST(max(n_common) AS BIGINT) AS n_common,
  CASE WHEN bool_and(paired) THEN sha256(coalesce(string_agg(head || text || tail, '' ORDER BY k) FILTER (WHERE k <= n_common), '')) END AS prompt_sha256,
  CASE WHEN bool_and(paired) THEN sha256(coalesce(string_agg(head || text || tail, '' ORDER BY k) FILTER (WHERE k > n_common), '')) END AS chosen_sha256,
  CASE WHEN bool_and(paired) THEN sha256(coalesce(string_agg(head || other || tail, '' ORDER BY k) FILTER (WHERE k > n_common), '')) END AS rejected_sha256,
  CASE WHEN bool_and(paired) THEN coalesce(string_agg(CAST(coalesce(c_at, 0) + length(head) AS BIGINT)::VARCHAR || '-' || CAST(coalesce(c_at, 0) + length(head) + length(text) AS BIGINT)::VARCHAR, ',' ORDER BY k) FILTER (WHERE k > n_common AND role = 'assistant'), '') END AS chosen_mask,
  CASE WHEN bool_and(paired) THEN coalesce(string_agg(CAST(coalesce(r_at, 0) + length(head) AS BIGINT)::VARCHAR || '-' || CAST(coalesce(r_at, 0) + length(head) + length(other) AS BIGINT)::VARCHAR, ',' ORDER BY k) FILTER (WHERE k > n_common AND role = 'assistant'), '') END AS rejected_mask
FROM p GROUP BY conv_id
"""
