"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Every measure is computed from the whole text of its row by built-in functions,
so a document needs no shuffle. Rules compare integers: a document passes a rule
if ``100 * (measure + slack) >= least * base`` and ``100 * measure <= most * base``.

Null, empty and word-free texts have all measures 0 and fail the base rule.
Rows with the same id are judged each on its own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words, and the characters that count as symbols.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Common words of the languages covered; a text in another language needs a table of its own.
STOP_WORDS = (
    "the of and to in is that for it as with on be at by this was are or an from which you have not "
    "de la que el en y a los se del las un por con una su para es al lo "
    "le les des et du une est dans qui pour pas sur par plus au avec ce il ne "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch"
).split()


class Rule(NamedTuple):
    """In hundredths of ``base``; None: no bound. ``slack`` keeps short texts from failing by chance."""

    measure: str
    base: str
    least: int | None
    most: int | None
    slack: int = 0


#: Bounds wide enough for prose, lists and code comments; tables of symbols, shouting and boilerplate fall outside.
RULES = (
    Rule("word_chars", "n_words", 200, 1500),
    Rule("n_symbols", "n_words", None, 30),
    Rule("n_stop_words", "n_words", 3, None, 1),
    Rule("n_upper_words", "n_words", None, 50),
    Rule("n_dup_lines", "n_lines", None, 50),
    Rule("n_bullet_lines", "n_lines", None, 90),
)


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where it is used within a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words covered by windows of ``window`` words that occur twice or more, the first occurrence included.

    Windows are compared by 64-bit hashes, sorted with their places, so that equal
    ones stand together: linear in memory, n log n in time for the longest texts.
    """

    def covered(places: Column) -> Column:
        gaps = F.zip_with(F.slice(places, 2, F.size(places)), F.slice(places, 1, F.greatest(F.size(places) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(window)))
        return F.aggregate(gaps, F.lit(window), lambda t, x: t + x)

    def twice(s: Column) -> Column:
        last = F.size(s) - 1
        marked = F.transform(
            s,
            lambda x, i: F.when(
                ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(s, i + 1)["h"] == x["h"])), x["i"]
            ),
        )
        return _with(F.sort_array(F.filter(marked, lambda p: p.isNotNull())), covered)

    def over(hashes: Column) -> Column:
        placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_with(F.sort_array(placed), twice))

    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(n > window, _with(hashes, over)).otherwise(F.lit(0))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the integer measures that rules can name."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    split = base.select(
        "doc_id",
        F.char_length(F.translate("text", WHITE, "")).alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)).alias("lines"),
    )
    long = lambda c, name: c.cast("long").alias(name)
    return split.select(
        "doc_id",
        long(F.size("words"), "n_words"),
        long(F.col("word_chars"), "word_chars"),
        long(F.col("n_symbols"), "n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines")), "n_dup_lines"),
        long(repeated_words(F.col("words")), "n_repeat_words"),
        long(F.size("lines"), "n_lines"),
        long(F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))), "n_stop_words"),
        long(F.size(F.filter("words", lambda w: w.rlike(r"^[A-Z]{2,}[^a-z]*$"))), "n_upper_words"),
        long(F.size(F.filter("lines", lambda x: x.rlike(r"^\s*[-*•]"))), "n_bullet_lines"),
    )


def verdict(rules=RULES) -> Column:
    """All rules as one condition."""
    out = F.lit(True)
    for r in rules:
        if r.least is not None:
            out = out & (100 * (F.col(r.measure) + r.slack) >= r.least * F.col(r.base))
        if r.most is not None:
            out = out & (100 * F.col(r.measure) <= r.most * F.col(r.base))
    return out


def apply_rules(docs: DataFrame, rules=RULES, min_words: int = 10, most_repeated: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures with base_failed and kept."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return measures(docs, id_col, text_col).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def query(spark, sf_dir: str) -> DataFrame:
    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(rules=RULES) -> str:
    def bounds(r: Rule) -> list[str]:
        return [f"100 * ({r.measure} + {r.slack}) >= {r.least} * {r.base}"] * (r.least is not None) + [f"100 * {r.measure} <= {r.most} * {r.base}"] * (r.most is not None)

    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
wins AS (
  SELECT doc_id, i, words[i:i + {WINDOW - 1}] AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d)),
places AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1),
reps AS (SELECT doc_id, count(*) AS n FROM places GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(reps.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(list_filter(words, lambda w: lower(w) IN ({stop}))) AS BIGINT) AS n_stop_words,
         CAST(len(list_filter(words, lambda w: regexp_matches(w, '^[A-Z]{{2,}}[^a-z]*$'))) AS BIGINT) AS n_upper_words,
         CAST(len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*\x{{2022}}]'))) AS BIGINT) AS n_bullet_lines
  FROM d LEFT JOIN reps ON d.doc_id = reps.doc_id),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT *, (NOT base_failed AND {" AND ".join(x for r in rules for x in bounds(r))}) AS kept FROM b
"""
