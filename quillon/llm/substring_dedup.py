"""Removing passages that also stand elsewhere, word for word, in the same or another document.

A passage of ``window`` words holds, wherever it begins, one of the non-overlapping
blocks of half that length into which each document is divided from its start. So:

1. The hashes of all blocks are the index, those of all rolling windows of a
   block's length the probes. A block that some other place repeats is an anchor.
2. Around every place of an anchor the hit is extended, to the left and to the
   right, to each passage of ``window`` words that contains it. Passages that occur
   twice or more, by 128-bit hashes, are repeats; those that follow each other
   word by word are one maximal repeat.
3. Words within a repeat go, all of them and wherever they stand; what counts is the
   input and not what is left.

Documents are dealt into chunks by a hash, once: all three passes use that shuffle.
What else travels are hashes. A chunk sends each hash once, however often it holds
it, in sorted lists by ranges of hashes, about three bytes a word; answers go back to the
chunks that asked. So no pairs are formed anywhere, a passage that very many
documents share is one entry for each chunk, and no list of places is gathered.
The number of chunks and of ranges follows the bytes of the texts; a task holds a
chunk or a range at a time. With so many chunks that a list is down to a few hashes, some
tens of thousands, the lists cost as much as rows.

Null texts stay null, and have no words, as do empty ones; neither is shuffled. Kept
words are joined by one space in every document. Rows with the same id are documents of
their own and repeat each other; rows equal in id and text share a chunk. A text
longer than a chunk is one. Empty tables give no rows. Columns of the input pass
through; ``n_words``, ``n_removed`` and ``repeats`` replace columns of these names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import byte_words as w

#: Bytes of text in a chunk; those whose hashes make a range; and hashes that a task holds until they are sent.
CHUNK, RANGE, HELD = 4 << 20, 16 << 20, 2_000_000
#: The most partitions that chunks or ranges are dealt to; beyond, a partition has several, one after the other.
MOST_PARTITIONS = 20_000

LISTS = "bucket long, chunk long, data binary"
_LISTS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary())])


def _pack(values: np.ndarray, flags: np.ndarray | None = None) -> bytes:
    """Ascending 32-bit integers as differences, low bytes first, and a byte for each."""
    steps = np.diff(values, prepend=values[:1] * 0).astype("<u4").view("u1").reshape(-1, 4).T.tobytes()
    steps = zstandard.compress(steps, 1)
    return struct.pack("<I", len(steps)) + steps + (b"" if flags is None else zstandard.compress(flags.astype("u1").tobytes(), 1))


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    (n,) = struct.unpack_from("<I", data)
    steps = np.frombuffer(zstandard.decompress(data[4 : 4 + n]), "u1").reshape(4, -1).T
    values = np.cumsum(np.ascontiguousarray(steps).view("<u4").ravel(), dtype="u4")
    return values, np.frombuffer(zstandard.decompress(data[4 + n :]), "u1") if len(data) > 4 + n else None


def _lists(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _LISTS, strict=True)], schema=_LISTS)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before, the first included."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _in(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array."""
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


class _Words:
    """The words of some texts, with what windows over them need."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lanes: int):
        _, _, self.first, self.hashes = w.words(data, bounds, lanes)
        count = np.diff(self.first)
        self.begin, self.end = np.repeat(self.first[:-1], count), np.repeat(self.first[1:], count)
        self.text = np.repeat(np.arange(len(count)), count)

    def starts(self, n: int) -> np.ndarray:
        """Where ``n`` words of one text begin."""
        return np.flatnonzero(np.arange(n, n + len(self.end)) <= self.end)

    def covered(self, start: np.ndarray, before: int, length: int) -> np.ndarray:
        """Words from ``before`` words ahead of each start, within its text, for ``length`` words."""
        n = len(self.end) + 1
        step = np.bincount(np.maximum(start - before, self.begin[start]), minlength=n) - np.bincount(start - before + length, minlength=n)
        return np.cumsum(step[:-1]) > 0


def _texts(column: pa.Array, lanes: int) -> Iterator[tuple[int, int, _Words]]:
    data, at = w.buffers(column)
    for low, high in w.portions(at):
        yield low, high, _Words(data[at[low] : at[high]], at[low : high + 1] - at[low], lanes)


def _probes(block: int, bits: int):
    """Of each chunk the hashes of all windows of a block's length, once: whether one is a block (1), whether there are several (2)."""

    def sent(keys: list[np.ndarray], chunks: list[np.ndarray], blocks: list[np.ndarray]) -> pa.RecordBatch:
        key, chunk, own = np.concatenate(keys), np.concatenate(chunks), np.concatenate(blocks)
        order = np.lexsort((key, chunk))
        key, chunk = key[order], chunk[order]
        new = _changes(key, chunk)
        flags = np.maximum.reduceat(own[order], new) | ((np.diff(new, append=len(key)) > 1) << 1).astype("u1")
        key, chunk = key[new], chunk[new]
        bucket = key >> np.uint64(32)
        cuts = _changes(chunk, bucket)
        rest = key.astype("u4")
        return _lists([(int(bucket[a]), int(chunk[a]), _pack(rest[a:b], flags[a:b])) for a, b in zip(cuts, np.append(cuts[1:], len(key)), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, chunks, blocks, n = [], [], [], 0
        for batch in batches:
            of = batch.column("chunk").to_numpy()
            for low, high, t in _texts(batch.column("text"), 1):
                start = t.starts(block)
                if len(start):
                    keys.append(w.runs(t.hashes[0], block)[start] >> np.uint64(32 - bits))
                    chunks.append(of[low:high][t.text[start]])
                    blocks.append(((start - t.begin[start]) % block == 0).astype("u1"))
                    n += len(start)
                if n >= HELD:
                    yield sent(keys, chunks, blocks)
                    keys, chunks, blocks, n = [], [], [], 0
        if n:
            yield sent(keys, chunks, blocks)

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """The lists of each bucket; the rows of a bucket follow each other."""
    now, chunks, data = None, [], []
    for batch in batches:
        for bucket, chunk, x in zip(batch.column("bucket").to_pylist(), batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
            if bucket != now:
                if chunks:
                    yield now, chunks, data
                now, chunks, data = bucket, [], []
            chunks.append(chunk)
            data.append(x.as_py())
    if chunks:
        yield now, chunks, data


def _answers(bucket: int, chunks: list[int], owner: np.ndarray, hits: np.ndarray, packed) -> pa.RecordBatch | None:
    """For each list that has some of the hits, these; hits are places in what all lists hold."""
    if not len(hits):
        return None
    hits = np.sort(hits)
    cuts = _changes(owner[hits])
    return _lists([(bucket, chunks[owner[hits[a]]], packed(hits[a:b])) for a, b in zip(cuts, np.append(cuts[1:], len(hits)), strict=True)])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of blocks that occur twice or more go back to every chunk that holds them."""
    for bucket, chunks, data in _buckets(batches):
        values, flags = zip(*map(_unpack, data), strict=True)
        owner = np.repeat(np.arange(len(data)), [len(v) for v in values])
        value, flag = np.concatenate(values), np.concatenate(flags)
        order = np.argsort(value, kind="stable")
        new = _changes(value[order])
        flag = flag[order]
        often = np.add.reduceat(1 + (flag >> 1), new) > 1
        good = often & (np.maximum.reduceat(flag & 1, new) > 0)
        hits = order[np.repeat(good, np.diff(new, append=len(order)))]
        found = _answers(bucket, chunks, owner, hits, lambda own, value=value: _pack(value[own]))
        if found is not None:
            yield found


def _extended(window: int, block: int, bits: int):
    """Of a chunk the hashes of all passages that hold an anchor, once."""

    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not answers.num_rows:
            return _LISTS.empty_table()
        anchors = np.unique(np.concatenate([_unpack(x.as_py())[0].astype("u8") | np.uint64(b << 32) for b, x in zip(answers["bucket"].to_pylist(), answers["data"], strict=True)]))
        found = [[], []]
        for column in docs["text"].chunks:
            for _, _, t in _texts(column, 2):
                start = t.starts(block)
                own = w.runs(t.hashes[0], block)[start] >> np.uint64(32 - bits)
                start = start[_in(own, anchors)]
                if len(start):
                    near = t.covered(start, window - block, window - block + 1)
                    passage = t.starts(window)
                    passage = passage[near[passage]]
                    for to, h in zip(found, t.hashes, strict=True):
                        to.append(w.runs(h, window)[passage] if len(passage) else np.empty(0, "u8"))
        if not sum(map(len, found[0])):
            return _LISTS.empty_table()
        one, two = map(np.concatenate, found)
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = _changes(one, two)
        several = (np.diff(new, append=len(one)) > 1).astype("u1")
        one, two = one[new], two[new]
        bucket = one >> np.uint64(64 - bits) if bits else np.zeros(len(one), "u8")
        cuts = _changes(bucket)
        rows = [(int(bucket[a]), int(key[0].as_py()), one[a:b].tobytes() + two[a:b].tobytes() + several[a:b].tobytes()) for a, b in zip(cuts, np.append(cuts[1:], len(one)), strict=True)]
        return pa.Table.from_batches([_lists(rows)])

    return run


def _pair(data: bytes, width: int) -> list[np.ndarray]:
    n = len(data) // width
    return [np.frombuffer(data, "u8", n), np.frombuffer(data, "u8", n, 8 * n), np.frombuffer(data, "u1", n if width == 17 else 0, 16 * n)]


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of passages that occur twice or more go back to every chunk that holds them."""
    for bucket, chunks, data in _buckets(batches):
        one, two, several = map(np.concatenate, zip(*(_pair(x, 17) for x in data), strict=True))
        owner = np.repeat(np.arange(len(data)), [len(x) // 17 for x in data])
        order = np.lexsort((two, one))
        new = _changes(one[order], two[order])
        often = np.add.reduceat(1 + several[order], new) > 1
        hits = order[np.repeat(often, np.diff(new, append=len(order)))]
        found = _answers(bucket, chunks, owner, hits, lambda own, one=one, two=two: one[own].tobytes() + two[own].tobytes())
        if found is not None:
            yield found


def _among(one: np.ndarray, two: np.ndarray, of: np.ndarray, with_: np.ndarray) -> np.ndarray:
    """Whether each pair (one, two) is among the pairs (of, with_), which are sorted by their first."""
    at = np.searchsorted(of, one)
    out = np.zeros(len(one), bool)
    for _ in range(int(np.diff(_changes(of), append=len(of)).max(initial=0))):
        inside = at < len(of)
        place = np.minimum(at, max(len(of) - 1, 0))
        out |= inside & (of[place] == one) & (with_[place] == two)
        at = at + 1
    return out


def _kept(texts: pa.Array, t: _Words, gone: np.ndarray) -> Iterator[bytes]:
    per_text = np.add.reduceat(np.append(gone, False).astype("i8"), np.minimum(t.first[:-1], len(gone))) if len(t.first) > 1 else []
    for i, text in enumerate(texts):
        own = text.as_py().split()
        a, b = t.first[i], t.first[i + 1]
        yield b" ".join(compress(own, (~gone[a:b]).tolist()) if b > a and per_text[i] else own)


def _cleaned(window: int):
    """The texts of a chunk without the words of repeated passages."""
    span = pa.struct([("start", pa.int64()), ("length", pa.int64())])

    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        pairs = [_pair(x.as_py(), 16) for x in answers["data"]]
        of, with_ = (np.concatenate([p[k] for p in pairs]) if pairs else np.empty(0, "u8") for k in (0, 1))
        order = np.lexsort((with_, of))
        of, with_ = of[order], with_[order]
        texts, n_words, n_removed, counts, starts, lengths = [], [], [], [], [], []
        for column in docs["text"].chunks:
            binary = column.cast(pa.binary())
            for low, high, t in _texts(column, 2 if len(of) else 1):
                gone = np.zeros(len(t.end), bool)
                if len(of):
                    start = t.starts(window)
                    one = w.runs(t.hashes[0], window)[start]
                    start = start[_in(one, of)]
                    start = start[_among(*(w.runs(h, window)[start] for h in t.hashes), of, with_)]
                    gone = t.covered(start, 0, window)
                texts += _kept(binary.slice(low, high - low), t, gone)
                sums = np.concatenate([[0], np.cumsum(gone)])
                n_words.append(np.diff(t.first))
                n_removed.append(np.diff(sums[t.first]))
                first = np.flatnonzero(gone & ~(np.concatenate([[False], gone[:-1]]) & (t.begin != np.arange(len(gone)))))
                last = np.flatnonzero(gone & ~(np.concatenate([gone[1:], [False]]) & (t.end - 1 != np.arange(len(gone)))))
                counts.append(np.bincount(t.text[first], minlength=high - low))
                starts.append(first - t.begin[first])
                lengths.append(last + 1 - first)
        flat = lambda x: np.concatenate(x) if x else np.empty(0, "i8")
        spans = pa.StructArray.from_arrays([pa.array(flat(starts), pa.int64()), pa.array(flat(lengths), pa.int64())], fields=list(span))
        offsets = pa.array(np.concatenate([[0], np.cumsum(flat(counts))]), pa.int32())
        return pa.table({
            "row": docs["row"], "text": pa.array(texts, pa.binary()).cast(pa.string()), "n_words": pa.array(flat(n_words), pa.int64()),
            "n_removed": pa.array(flat(n_removed), pa.int64()), "repeats": pa.ListArray.from_arrays(offsets, spans),
        })

    return run


def drop_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the words of repeated passages, with n_words (before), n_removed, and ``repeats``: where each maximal repeat began and its words."""
    if window < 2:
        raise ValueError("a passage has two words or more")
    block = (window + 1) // 2
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first().n or 0
    chunks = max(parts, -(-size // CHUNK))
    # Ranges are larger than chunks, and a partition has several chunks, so that partitions are about even.
    ranges = max(parts, -(-size // RANGE))
    bits = (ranges - 1).bit_length()
    dealt_to = min(ranges, MOST_PARTITIONS)

    own = [c for c in docs.columns if c not in ("n_words", "n_removed", "repeats")]
    rows = docs.select(F.struct(*[c for c in own if c != text_col], F.lit(None).cast("boolean").alias("__none")).alias("row"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    full = F.coalesce(F.octet_length("text") > 0, F.lit(False))
    dealt = rows.where(full).select(F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).alias("chunk"), "row", "text").repartition(dealt_to, "chunk")

    def met(lists: DataFrame, what) -> DataFrame:
        return lists.repartition(dealt_to, "bucket").sortWithinPartitions("bucket").mapInArrow(what, LISTS)

    anchors = met(dealt.mapInArrow(_probes(block, bits), LISTS), _anchors)
    passages = dealt.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(_extended(window, block, bits), LISTS)
    repeats = met(passages, _repeats)
    kind = T.StructType([rows.schema["row"], *T.StructType.fromDDL("text string, n_words long, n_removed long, repeats array<struct<start:long,length:long>>").fields])
    cleaned = dealt.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(_cleaned(window), kind)
    nothing = F.lit(0).cast("long")
    without = rows.where(~full).select("row", "text", nothing.alias("n_words"), nothing.alias("n_removed"), F.array().cast("array<struct<start:long,length:long>>").alias("repeats"))
    keep = [F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in own]
    return cleaned.unionByName(without).select(*keep, "n_words", "n_removed", "repeats")


def query(spark, sf_dir: str) -> DataFrame:
    kept = drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM d),
h AS (SELECT doc_id, i, sha256(array_to_string(words[i:i + 34], ' ')) AS passage FROM s),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY passage) AS n FROM h) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
p AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY 1),
k AS (
  SELECT d.doc_id, words, coalesce(gone, []) AS gone, list_sort(list_filter(range(1, len(words) + 1), lambda x: NOT list_contains(coalesce(gone, []), x))) AS stay
  FROM d LEFT JOIN p ON d.doc_id = p.doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_transform(stay, lambda x: words[x]), ' '), '')) AS kept_sha256 FROM k
"""
