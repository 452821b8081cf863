"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur in a document with up to k edits. Split
into k + 1 pieces, at least one piece of such an occurrence is exact. All pieces
are looked up at once in every text (Aho-Corasick). By the same principle some
two neighbouring pieces, or the last one of an odd number, hold at most as many
edits as they are less one, so a hit counts only if its neighbour follows with at
most one edit. Since an edit breaks at most
q of an item's runs of q characters, hits around which too few of these occur are
passed over; around the others the item is verified with Myers' bit-parallel distance, so no occurrence within the budget is
missed and none beyond it is reported.

Texts and items are compared in lower case with every run of white space and
ASCII punctuation as one blank. Items are a stated query set: they are taken in
blocks of bounded size, each block broadcast, and each document is searched
whole; a pass over the documents takes one block, so a benchmark of some million
characters takes one pass, one of very many blocks as many. Items too short for
any edit match between blanks only, not within words. Null and empty texts and
items match nothing. Items with equal text each
match; rows with the same id are searched each on its own.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import turn_to, values

#: Edits allowed in hundredths of an item's length, and the least length of a piece (which bounds the edits of short items).
EDITS, PIECE = 10, 8
#: Characters of the runs that an item and a part of a text must share before they are compared.
GRAM = 4
#: Characters of items in one block; more are searched in further passes.
BLOCK_CHARS = 4_000_000
#: Items whose masks and runs a worker keeps.
DETAILS = 1_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normal(text: str) -> str:
    return b" ".join(text.lower().encode().translate(_FOLD).split()).decode()


def budget(m: int, edits: int = EDITS, piece: int = PIECE) -> int:
    return min(m * edits // 100, max(0, m // piece - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of about equal length with their places."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance between the pattern and any part of the text, and where that part ends (the first such place)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for at, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xh = (((eq & pv) + pv) ^ pv) | eq | mv
        ph, mh = (mv | ~(xh | pv)) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, mh << 1
        xv = eq | mv
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
        if score < best:
            best, end = score, at
    return best, end


class Matcher:
    """Finds every item of a block in a text."""

    def __init__(self, items: list[tuple[int, str]], edits: int = EDITS, piece: int = PIECE):
        import ahocorasick

        self.items: list[tuple[int, str, int]] = []
        self.details = functools.lru_cache(DETAILS)(self._details)
        self.search = ahocorasick.Automaton()
        # Piece -> what may stand after or before it -> items and the piece's places in them.
        where: dict[str, dict[tuple[str, str], list[tuple[int, int]]]] = {}
        for item_id, text in items:
            if not (own := normal(text)):
                continue
            k = budget(len(own), edits, piece)
            own_pieces = pieces(own, k)
            for i, (at, p) in enumerate(own_pieces):
                mate = i ^ 1
                after = own_pieces[mate][1] if i < mate < len(own_pieces) else ""
                before = own_pieces[mate][1][::-1] if mate < i else ""
                where.setdefault(p, {}).setdefault((after, before), []).append((len(self.items), at))
            self.items.append((item_id, own, k))
        for p, mates in where.items():
            self.search.add_word(p, (len(p), [(*m, places) for m, places in mates.items()]))
        if where:
            self.search.make_automaton()

    def _details(self, item: int) -> tuple[dict[str, int], Counter]:
        own = self.items[item][1]
        return masks(own), Counter(own[i : i + GRAM] for i in range(len(own) - GRAM + 1))

    def find(self, text: str) -> list[tuple[int, int]]:
        """(item id, least distance) of all items that occur within their budget."""
        if not self.items or not (own := normal(text)):
            return []
        own = f" {own} "
        starts: dict[int, list[int]] = {}
        for end, (n, mates) in self.search.iter(own):
            first, last = end + 1 - n, end + 1
            for after, before, places in mates:
                if after:
                    if not _follows(after, own[last : last + len(after) + 1]):
                        continue
                elif before and not _follows(before, own[max(0, first - len(before) - 1) : first][::-1]):
                    continue
                for item, at in places:
                    starts.setdefault(item, []).append(first - at)
        out = []
        for item, found in starts.items():
            item_id, pattern, k = self.items[item]
            if (pattern if k else f" {pattern} ") in own:
                out.append((item_id, 0))
                continue
            if not k:
                continue
            best, m, (peq, grams) = k + 1, len(pattern), self.details(item)
            for low, high in _merged(_likely(own, sorted(set(found)), k, m, grams), k, m):
                best = min(best, myers(peq, m, own[max(0, low) : high])[0])
            if best <= k:
                out.append((item_id, best))
        return sorted(out)


def _follows(piece: str, text: str) -> bool:
    """Whether the text begins with the piece or something an edit away from it."""
    if text.startswith(piece):
        return True
    n, i = len(piece), 0
    while i < len(text) and piece[i] == text[i]:
        i += 1
    rest = piece[i + 1 :]
    return rest == text[i + 1 : n] or rest == text[i : n - 1] or piece[i:] == text[i + 1 : n + 1]


def _likely(own: str, starts: list[int], k: int, m: int, grams: Counter) -> list[int]:
    """The places around which enough of an item's runs occur for k edits; those within k of each other are tried together."""
    least, out, i = m - GRAM + 1 - k * GRAM, [], 0
    while i < len(starts):
        j = i
        while j < len(starts) and starts[j] - starts[i] <= k:
            j += 1
        low, high = max(0, starts[i] - k), min(len(own), starts[j - 1] + m + k)
        there = {own[x : x + GRAM] for x in range(low, high - GRAM + 1)}
        if sum(map(grams.__getitem__, there & grams.keys())) >= least:
            out += starts[i:j]
        i = j
    return out


def _merged(starts: list[int], k: int, m: int) -> Iterator[tuple[int, int]]:
    """Stretches of the text that hold every occurrence starting within k of a place; overlapping ones once."""
    i = 0
    while i < len(starts):
        low, high = starts[i] - k, starts[i] + m + k
        i += 1
        while i < len(starts) and starts[i] - k <= high:
            high = starts[i] + m + k
            i += 1
        yield low, high


_MATCHERS: dict[str, Matcher] = {}


def matcher(key: str, items: list[tuple[int, str]], edits: int, piece: int) -> Matcher:
    """Of the block a worker process has last searched for, made once."""
    turn_to("benchmark", _MATCHERS.clear)
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items, edits, piece)
    return _MATCHERS[key]


def _key(items: list[tuple[int, str]], edits: int, piece: int) -> str:
    return xxhash.xxh3_128_hexdigest(repr((items, edits, piece)).encode("utf-8", "surrogatepass"))


def _matches(items: list[tuple[int, str]], edits: int, piece: int):
    key = _key(items, edits, piece)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(key, items, edits, piece)
        for batch in batches:
            docs, ids, distances = [], [], []
            for doc_id, text in zip(*map(values, batch.columns), strict=True):
                for item_id, d in m.find(text) if text else ():
                    docs.append(doc_id), ids.append(item_id), distances.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (docs, ids, distances)], names=["doc_id", "item_id", "distance"])

    return run


def item_blocks(items: DataFrame, id_col: str, text_col: str, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, fetched partition by partition."""
    block, n = [], 0
    for r in items.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col)).toLocalIterator():
        block.append((r[0], r[1]))
        n += len(r[1])
        if n >= chars:
            yield block
            block, n = [], 0
    if block:
        yield block


def matches(docs: DataFrame, items: DataFrame, edits: int = EDITS, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, distance of every item found in a document within its budget."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kinds = "doc_id long, item_id long, distance long"
    out = rows.sparkSession.createDataFrame([], kinds)
    for i, block in enumerate(item_blocks(items, item_id, item_text)):
        found = rows.mapInArrow(_matches(block, edits, piece), kinds)
        out = found if i == 0 else out.unionAll(found)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, edits: int = EDITS, piece: int = PIECE, text_col: str = "text") -> DataFrame:
    """The documents that hold no item, in one pass over them for each block of items."""
    out = docs
    for block in item_blocks(items, "item_id", "text"):
        out = out.where(~_has(block, edits, piece)(F.col(text_col)))
    return out


def _has(items: list[tuple[int, str]], edits: int, piece: int):
    key = _key(items, edits, piece)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = matcher(key, items, edits, piece)
        for texts in parts:
            yield pd.Series([bool(t) and bool(m.find(t)) for t in texts], dtype=bool)

    return F.pandas_udf(run, "boolean")


def query(spark, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
