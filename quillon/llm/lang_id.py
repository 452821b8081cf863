"""Language identification by compression.

For each label that occurs a raw-content dictionary is made from a bounded
sample of its documents, read whole: their words, the most frequent ones last,
where matches are cheapest. Words are counted by Spark, and the dictionaries
are a table. A text, reduced to its lower-case words, is encoded whole, in chunks,
with zstandard once for each language's dictionary; the language whose
dictionary gives the smallest total is chosen. Short texts are encoded several
times over, so that their few matches count. Where the runner-up is hardly
larger the choice is rejected.

Dictionaries go to the tasks in blocks of ``BLOCK_LABELS``, each one pass over
the documents that keeps the two best of the block; the driver and a worker hold
one block, whatever the number of labels. With a single block nothing is shuffled.

Null texts and texts without a letter are ``und`` with score 0 and rejected.
Ties go to the language that comes first by name. Without any labelled row
everything is ``und``. Rows with the same id are judged each on its own; for the
sample, rows with equal id and text are equal, and a null id is one like others.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.shared import materialize, turn_to, values

#: Bound of the sample that dictionaries are cut from: documents for a language.
SAMPLE_DOCS = 1_000
#: Bytes of a dictionary, and of the chunks that texts are encoded in.
DICTIONARY, CHUNK, LEVEL, MIN_MATCH = 64 << 10, 4 << 10, 5, 3
#: A choice is rejected if it saves less than this share of what the runner-up needs. Set from leads on held-out documents of sf0.1:
#: 8 of 2,499 lie below, and so do nearly all random letters and more than nine in ten texts of a language that was not learned.
MARGIN = 0.03
#: Dictionaries that a task, or the driver, holds at a time.
BLOCK_LABELS = 64
#: Below so many bytes a text is encoded so many times over, since zstandard leaves what it can't shorten as it is.
SHORT, COPIES = 512, 6

#: Values of the hash that the sample is drawn by.
SPAN = 1 << 30

#: Everything but letters; it says little about the language.
OTHER = re.compile(r"[\W\d_]+")


def _known(labelled: DataFrame, text_col: str, lang_col: str, id_col: str) -> DataFrame:
    """(lang, text, spot) of the rows to learn from; spots are evenly spread over ``SPAN`` values."""
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    return known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(SPAN)).alias("spot"))


def _labels(known: DataFrame) -> DataFrame:
    """(lang, limit): below the limit lies twice the bound of the sample by expectation, and at least the label's smallest spot."""
    share = F.greatest(F.ceil(F.lit(2 * SAMPLE_DOCS * SPAN) / F.count(F.lit(1))), F.min("spot") + 1)
    return materialize(known.groupBy("lang").agg(share.alias("limit")), "labels")


def _sample(known: DataFrame, labels: DataFrame) -> DataFrame:
    """A bounded sample (lang, text) for each label, the same on every run; it shuffles a bounded number of rows of each label."""
    picked = known.join(labels, "lang").where("spot < limit").select("lang", "text", "spot")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("spot", "text"))
    return picked.withColumn("n", first).where(F.col("n") <= SAMPLE_DOCS).select("lang", "text")


def words(text: str) -> str:
    return OTHER.sub(" ", text.lower())


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of texts (lang, text), added up within tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for lang, text in zip(*map(values, batch.columns), strict=True):
                counts.update((lang, w) for w in words(text).split())
            langs, found = zip(*counts, strict=True) if counts else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.string()), pa.array(counts.values(), pa.int64())], names=["lang", "word", "n"])

    return texts.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def dictionary(counts: dict[str, int], size: int = DICTIONARY) -> bytes:
    """Raw content: as many of the most frequent words as there is room for, rising in frequency."""
    out, n = [], 0
    for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        n += len(b := f" {w}".encode())
        if n >= size:
            break
        out.append(b)
    return b"".join(reversed(out)) + b" "


class Compressors:
    """Sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        self.langs = sorted(dictionaries)
        self.each = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
            d.precompute_compress(compression_params=p)
            self.each.append(zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress)

    def sizes(self, text: str) -> list[int]:
        data = f" {words(text).strip()} ".encode()
        if len(data) < SHORT:
            data *= COPIES
        chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
        return [sum(len(f(c)) for c in chunks) for f in self.each]


_CACHE: dict[int, Compressors] = {}


def compressors(dictionaries: dict[str, bytes]) -> Compressors:
    """One for each worker process."""
    turn_to("languages", _CACHE.clear)
    key = hash(tuple(sorted(dictionaries.items())))
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = Compressors(dictionaries)
    return _CACHE[key]


TWO = pa.list_(pa.struct([("size", pa.int64()), ("lang", pa.string())]))


def _nearest(dictionaries: dict[str, bytes]):
    """Of a text, the two languages of smallest size, by size and name; none without a letter."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = compressors(dictionaries)
        for texts in parts:
            found = []
            for text in values(texts):
                told = text and any(map(str.isalpha, text))
                sizes = sorted(zip(c.sizes(text), c.langs, strict=True))[:2] if told else []
                found.append([{"size": n, "lang": lang} for n, lang in sizes])
            yield pa.array(found, TWO)

    # Not to be evaluated again by a filter on what it says.
    return F.arrow_udf(run, "array<struct<size: long, lang: string>>").asNondeterministic()


def _dictionary(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"lang": rows["lang"].iloc[:1], "dictionary": [dictionary(dict(zip(rows["word"], rows["n"], strict=True)))]})


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """(block, lang, dictionary), written: a dictionary for every label that occurs; one whose sample holds no word has a dictionary of a blank."""
    known = _known(labelled, text_col, lang_col, id_col)
    labels = _labels(known)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    # A word takes two bytes at least, so no more than these can have a place.
    most = word_counts(_sample(known, labels)).withColumn("place", place).where(F.col("place") <= DICTIONARY // 2).select("lang", "word", "n")
    made = most.groupBy("lang").applyInPandas(_dictionary, "lang string, dictionary binary")
    blocks = max(1, -(-labels.count() // BLOCK_LABELS))
    block = F.pmod(F.xxhash64("lang"), F.lit(blocks)).cast("int").alias("block")
    return materialize(labels.select("lang").join(made, "lang", "left").select(block, "lang", F.coalesce("dictionary", F.lit(b" ")).alias("dictionary")), "dictionaries")


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict[str, bytes]:
    """The dictionaries of a few labels, to look at or to keep: all of them at once on the driver."""
    return {r["lang"]: bytes(r["dictionary"]) for r in learn(labelled, text_col, lang_col, id_col).collect()}


def blocks(dictionaries: DataFrame | dict[str, bytes]) -> Iterator[dict[str, bytes]]:
    """At most ``BLOCK_LABELS`` dictionaries at a time; of a table, a block of it at a time is fetched, which holds about so many."""
    if isinstance(dictionaries, dict):
        each = iter(dictionaries.items())
    else:
        last = dictionaries.agg(F.max("block")).first()[0]
        fetched = (dictionaries.where(F.col("block") == b).collect() for b in range(-1 if last is None else last + 1))
        each = ((r["lang"], bytes(r["dictionary"])) for rows in fetched for r in rows)
    while block := dict(islice(each, BLOCK_LABELS)):
        yield block


def identify(docs: DataFrame, dictionaries: DataFrame | dict[str, bytes], margin: float = MARGIN, text_col: str = "text") -> DataFrame:
    """The documents with lang_pred, score (lead over the runner-up, 0 to 1) and accepted; these replace columns of the same names.

    ``dictionaries`` come from ``learn``, or from ``train``. With several blocks
    the documents are written once with a number for each row, and each block's
    two best are written before the next block is fetched.
    """
    keep = [F.col(c) for c in docs.columns if c not in ("lang_pred", "score", "accepted")]
    row, two = _free("row", docs), _free("two", docs)
    each = blocks(dictionaries)
    first, second = next(each, {}), next(each, None)
    if second is None:
        judged = docs.select("*", _nearest(first)(F.col(text_col)).alias(two))
    else:
        docs = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        best = lambda block: materialize(docs.select(row, _nearest(block)(F.col(text_col)).alias(two)), "nearest")
        found = reduce(DataFrame.unionAll, map(best, each), best(first).unionAll(best(second)))
        # Two a block meet for each document.
        judged = docs.join(found.groupBy(row).agg(F.array_sort(F.flatten(F.collect_list(two))).alias(two)), row)
    size = lambda i: F.get(two, F.lit(i))["size"]
    lead = F.when(F.size(two) == 0, 0.0).when(F.size(two) == 1, 1.0).otherwise((size(1) - size(0)) / size(1))
    judged = judged.select(*keep, F.coalesce(F.get(two, F.lit(0))["lang"], F.lit("und")).alias("lang_pred"), lead.alias("score"), (F.size(two) > 0).alias("accepted"))
    return judged.withColumn("accepted", F.col("accepted") & (F.col("score") >= margin))


def _free(name: str, docs: DataFrame) -> str:
    """A name that no column has."""
    while name in docs.columns:
        name += "_"
    return name


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dictionaries = learn(docs.where(~held_out()).select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", "text"), dictionaries)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
