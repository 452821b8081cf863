"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document is the set of its distinct shingles of some words. Documents with
equal sets are one class from the start, represented by the smallest id. Each
representative has one signature in each of several trees; in every tree the
representatives are sorted by signature, so that those with a long common prefix
stand next to each other. Within a region of the order that shares the first few
values, all pairs are candidates if it is small; a larger region is divided by
the next value, and so on, which makes the depth follow the density; parts are
chained to their neighbours. A region can't be a hot key, since the order is cut
into ranges of about equal size wherever it falls.

Candidates whose one-bit sketches agree far less than the threshold implies are
dropped; the others are confirmed on the full sets. The links that connect most
documents of a region come first, then all candidates that still join different
components. Components are computed with joins. Only ids, hashes and candidates
are shuffled; sets travel for candidates alone.

Rows that stand at the ends of a range are brought together once more, so a
region that the cut between two ranges divides is searched like any other.

Division and chaining leave out pairs of large regions. These matter only where
a region still holds several components. The documents of such regions are
joined exactly: in an order of shingles from rare to frequent, the full sets of
linked documents share one of their first few, and from where they share it
follow bounds on their sizes. All pairs of different components that meet these
bounds are confirmed. Pages of one template differ in their rarest shingles, so
few of them ever meet.

Null texts and texts without words have no shingles and no links. Texts with
fewer words than a shingle have their whole sequence as one. A null id is never
linked. Rows with the same id are one document: their texts, equal or not, are
linked, and what is like any of them joins it. Recall is that of the forest:
for 24 trees and four common values a pair at the threshold of 0.8 is missed
with a probability of 3e-6, and the sketches drop another 2.7e-6, before
components bridge it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.components import components, few_files
from quillon.llm.shared import materialize, scratch, turn_to, values

#: Trees, values in a signature, values that a region shares at least, and documents in a region of which all pairs are tried.
TREES, DEPTH, SHARED, REGION = 24, 8, 4, 8
#: Bits of a sketch, and of these how many standard deviations below the threshold's expectation still pass.
BITS, DEVIATIONS = 128, 5
#: Trees whose strongest links are confirmed first.
FIRST_TREES = 2
#: Counters of shingles, a fixed number whatever the input, and the relative width of a band of set sizes.
COUNTERS, BAND = 1 << 20, 1.05
#: Rows in a range of an order, at most on average: one task holds a range.
RANGE_ROWS = 1 << 20
#: Pairs that a task holds before it gives them away; what it finds again later is folded by the shuffle.
HELD_PAIRS = 1 << 17
#: Ids of candidates that are broadcast at most (8 bytes each).
LISTED = 500_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


# --- sets and signatures -------------------------------------------------------------------------


class _Words(dict):
    """64-bit hash of each word; a full table starts anew."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_WORDS = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles. Bytes are split and lower-cased as ASCII, which leaves other letters as they are."""
    found = text.encode().lower().split() if text else []
    if not found:
        return np.zeros(0, "u8")
    h = np.fromiter(map(_WORDS.__getitem__, found), "u8", len(found))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, "u8")
    for i in range(n):
        out = _mixed(out * _MIX + h[i : len(h) - n + 1 + i])
    return np.unique(out)


@functools.cache
def _factors(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20_240_601)).integers(1 << 62, (1 << 64) - 1, n, dtype="u8") | np.uint64(1)


def signature(found: np.ndarray) -> tuple[bytes, bytes]:
    """Tree signatures (16 bits a value, big-endian, so that their order is that of bytes) and the sketch of one bit a value."""
    a = _factors(TREES * DEPTH)
    least = np.full(len(a), np.iinfo("u8").max, "u8")
    for i in range(0, len(found), 512):
        part = found[i : i + 512, None] * a[None, :]
        part ^= part >> np.uint64(32)
        np.minimum(least, part.min(axis=0), out=least)
    least = _mixed(least * _MIX)
    return (least >> np.uint64(48)).astype(">u2").tobytes(), np.packbits((least[:BITS] & np.uint64(1)).astype(bool)).tobytes()


def _signed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("shingles", _WORDS.clear)
        for batch in batches:
            sizes, marks, trees, sketches = [], [], [], []
            for text in values(batch.column(1)):
                found = shingles(text, words)
                sizes.append(len(found))
                mark = tree = sketch = None
                if len(found):
                    mark = xxhash.xxh3_128_digest(found.tobytes())
                    tree, sketch = signature(found)
                marks.append(mark), trees.append(tree), sketches.append(sketch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), *(pa.array(c, pa.binary()) for c in (marks, trees, sketches))],
                names=["doc_id", "n_shingles", "mark", "trees", "sketch"],
            )

    return run


# --- candidates ----------------------------------------------------------------------------------


def least_agreement(similarity: int) -> int:
    """Bits of a sketch that a pair at the threshold agrees in, less the deviations allowed for."""
    p = (1 + similarity / 100) / 2
    return int(np.floor(BITS * p - DEVIATIONS * np.sqrt(BITS * p * (1 - p))))


def region_pairs(values: np.ndarray, low: int, high: int, depth: int) -> Iterator[tuple[int, int]]:
    """Pairs of places in a sorted stretch whose signatures (rows of ``values``) share the first ``depth`` values."""
    if high - low <= REGION:
        for i in range(low, high):
            for j in range(i + 1, high):
                yield i, j
    elif depth >= values.shape[1]:
        for i in range(low, high):
            for j in range(i + 1, min(high, i + 4)):
                yield i, j
    else:
        cuts = np.flatnonzero(np.diff(values[low:high, depth])) + low + 1
        edges = [low, *cuts.tolist(), high]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > 1:
                yield from region_pairs(values, a, b, depth + 1)
            if b < high:
                yield b - 1, b


EDGES = "a long, b long, early boolean, part int, tree int, key binary, sketch binary"


class _Rows:
    """Rows of a stretch of the order as arrays."""

    def __init__(self, t: pa.Table, id_col: str):
        flat = lambda c, n: np.frombuffer(b"".join(t.column(c).to_pylist()), "u1").reshape(-1, n)
        self.tree, self.ids = t.column("tree").to_numpy(), t.column(id_col).to_numpy()
        self.keys = flat("key", 2 * DEPTH)
        self.values = self.keys.copy().view(">u2").astype("u2")
        self.bits = flat("sketch", BITS // 8)
        self.sketch = np.ascontiguousarray(self.bits).view("u8")

    def regions(self) -> list[int]:
        """Where regions begin, and the end."""
        same = (self.tree[1:] == self.tree[:-1]) & (self.values[1:, :SHARED] == self.values[:-1, :SHARED]).all(axis=1)
        return [0, *(np.flatnonzero(~same) + 1).tolist(), len(self.ids)]

    def pairs(self, low: int, high: int, agree: int, parts: np.ndarray | None = None) -> Iterator[tuple[int, int, bool]]:
        """(a, b, early) of a region, the likest first; only pairs of different ``parts`` if these are given."""
        at = np.array(list(region_pairs(self.values, low, high, SHARED)))
        if parts is not None:
            at = at[parts[at[:, 0]] != parts[at[:, 1]]]
        agrees = BITS - np.bitwise_count(self.sketch[at[:, 0]] ^ self.sketch[at[:, 1]]).sum(axis=1)
        top: dict[int, int] = {}
        early = self.tree[low] < FIRST_TREES

        def find(x: int) -> int:
            while (up := top.get(x, x)) != x:
                top[x] = top.get(up, up)
                x = up
            return x

        for k in np.argsort(-agrees, kind="stable"):
            if agrees[k] < agree:
                break
            i, j = int(at[k, 0]), int(at[k, 1])
            first = False
            if early and (x := find(i)) != (y := find(j)):
                top[x], first = y, True
            a, b = sorted((int(self.ids[i]), int(self.ids[j])))
            yield a, b, first


def _pairs(agree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # A partition is a range of the order, of a bounded number of rows on average (RANGE_ROWS).
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = _Rows(pa.Table.from_batches(held), "node")
        edges, out = rows.regions(), {}
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            if high - low > 1:
                for a, b, first in rows.pairs(low, high, agree):
                    out[a, b] = out.get((a, b), False) or first
                    if len(out) >= HELD_PAIRS:
                        yield _pair_batch(out)
                        out.clear()
        yield _pair_batch(out)
        # The rows on either side of a cut, for the regions that it may divide.
        ends = sorted({*range(min(edges[1], REGION)), *range(max(edges[-2], edges[-1] - REGION), edges[-1])})
        n, part = len(ends), TaskContext.get().partitionId()
        yield _edge_batch([rows.ids[ends], [None] * n, [None] * n, [part] * n, rows.tree[ends], [rows.keys[i].tobytes() for i in ends], [rows.bits[i].tobytes() for i in ends]], n)

    return run


def _pair_batch(pairs: dict[tuple[int, int], bool]) -> pa.RecordBatch:
    n, none = len(pairs), [None] * len(pairs)
    columns = list(zip(*pairs, strict=True)) or [(), ()]
    return _edge_batch([columns[0], columns[1], list(pairs.values()), none, none, none, none], n)


def _edge_batch(columns: list, n: int) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["a", "b", "early", "part", "tree", "key", "sketch"])


def _across_cuts(agree: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("key", "ascending"), ("a", "ascending")])
        parts, found = t.column("part").to_numpy(), []
        if len(np.unique(parts)) > 1:
            found = list(_Rows(t, "a").pairs(0, len(parts), agree, parts))
        a, b, early = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "early": pa.array(early, pa.bool_())})

    return run


def ranges(classes: DataFrame) -> int:
    """The session's number of partitions, or more where a range would hold too many rows."""
    return max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() * TREES // RANGE_ROWS))


def tree_rows(classes: DataFrame) -> DataFrame:
    """A row for each class and tree."""
    width = 2 * DEPTH
    rows = classes.select("node", "sketch", "trees", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    return rows.select("tree", F.expr(f"substring(trees, tree * {width} + 1, {width})").alias("key"), "node", "sketch")


def candidates(classes: DataFrame, similarity: int) -> DataFrame:
    """(a, b, early): pairs of nodes that stand close in some tree's order.

    A range sends at most ``REGION`` rows from either end to its neighbours, so
    what meets for a cut region is bounded by the number of ranges, not of rows.
    """
    parts, agree = ranges(classes), least_agreement(similarity)
    order = ["tree", "key", "node"]
    rows = tree_rows(classes).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = materialize(rows.mapInArrow(_pairs(agree), EDGES), "found")
    ends = found.where("b is null").drop("b", "early").groupBy("tree", F.substring("key", 1, 2 * SHARED).alias("region"))
    cut = ends.applyInArrow(_across_cuts(agree), "a long, b long, early boolean")
    return materialize(found.where("b is not null").select("a", "b", "early").unionAll(cut).groupBy("a", "b").agg(F.max("early").alias("early")), "candidates")


def mixed_members(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label, seeks) of the regions too large for all pairs that hold several components; a document seeks if it is outside the largest one of a region."""
    width = 2 * DEPTH
    own = labels.select(F.col("node").alias("of_node"), F.col("label").alias("own"))
    rows = classes.join(own, F.col("node") == F.col("of_node"), "left").select("node", F.coalesce("own", "node").alias("label"), "trees", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows = rows.select(F.xxhash64("tree", F.expr(f"substring(trees, tree * {width} + 1, {2 * SHARED})")).alias("region"), "node", "label")
    sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    mixed = materialize(sizes.where((F.col("n") > REGION) & (F.col("low") != F.col("high"))).select(F.col("region").alias("of")), "mixed-regions")
    rows = materialize(rows.join(mixed, F.col("region") == F.col("of")).select("region", "node", "label"), "mixed-rows")
    counts = rows.groupBy("region", "label").agg(F.count(F.lit(1)).alias("n"))
    mains = counts.groupBy("region").agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("top")).select(F.col("region").alias("of"), (-F.col("top.l")).alias("main"))
    inside = rows.join(materialize(mains, "mains"), F.col("region") == F.col("of"))
    return materialize(inside.groupBy("node", "label").agg(F.max(F.col("label") != F.col("main")).alias("seeks")), "members")


# --- links ---------------------------------------------------------------------------------------


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("shingles", _WORDS.clear)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = [shingles(t, words).tobytes() for t in batch.column(0).slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(map(xxhash.xxh3_128_digest, own), pa.binary()), pa.array(own, pa.binary())], names=["of", "own"])

    return run


def _confirmed(similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), "u8"), np.frombuffer(y.as_buffer(), "u8")
                small, large = (a, b) if len(a) < len(b) else (b, a)
                ok = 100 * len(small) >= similarity * len(large)
                if ok:
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int((large[at] == small).sum())
                    ok = 100 * both >= similarity * (len(a) + len(b) - both)
                keep.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    return run


def confirm(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("own").alias("own_a"))
    right = sets.select(F.col("node").alias("b"), F.col("own").alias("own_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "own_a", "own_b")
    return both.mapInArrow(_confirmed(similarity), "a long, b long")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(COUNTERS, "i8")
    for batch in batches:
        for own in batch.column(0):
            np.add.at(n, _counter(np.frombuffer(own.as_buffer(), "u8")), 1)
    at = np.flatnonzero(n)
    for i in range(0, len(at), 1 << 16):
        part = at[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype("i4")), pa.array(n[part])], names=["counter", "n"])


def _counter(found: np.ndarray) -> np.ndarray:
    return (found & np.uint64(COUNTERS - 1)).astype("i8")


def frequencies(sets: DataFrame) -> np.ndarray:
    """How often the shingles of each counter occur. Shingles may share one: that changes the order of shingles, not what it is good for."""
    out = np.zeros(COUNTERS, "i8")
    t = sets.select("own").mapInArrow(_counted, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out[t.column("counter").to_numpy()] = t.column("n").to_numpy()
    return out


def band(size):
    """Of set sizes, in steps of about 5 %."""
    return np.floor(np.log(size) / np.log(BAND)).astype("i4")


def prefix(own: np.ndarray, often: np.ndarray, similarity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rarest shingles of a set of which a linked set shares one: (shingle, place, smaller, first band, last band).

    As the smaller one of a pair a set stands in its own band and shares one of
    its first n - ceil(2t n / (1 + t)) + 1 shingles; as the larger one it stands
    in the bands of all sizes that a set may have which shares nothing before
    that place, and shares one of its first n - ceil(t n) + 1.
    """
    n = len(own)
    counts = often[_counter(own)]
    order = np.lexsort((own, counts))[: n + (-similarity * n // 100) + 1]
    alone = counts[order] < 2  # no other set has it
    at = np.arange(len(order))
    least, most = -(-similarity * n // 100), np.minimum(n, (n - at) * (100 + similarity) // similarity - n)
    large = ~alone & (most >= least)
    small = ~alone & (at < n + (-2 * similarity * n // (100 + similarity)) + 1)
    i = np.concatenate([np.flatnonzero(small), np.flatnonzero(large)])
    is_small = np.arange(len(i)) < small.sum()
    own_band = int(band(n))
    first = np.where(is_small, own_band, int(band(max(1, least))))
    last = np.where(is_small, own_band, band(np.maximum(1, most[i])))
    return own[order[i]], at[i], is_small, first, last


PREFIX = pa.schema([("shingle", pa.int64()), ("at", pa.int32()), ("small", pa.bool_()), ("first", pa.int32()), ("last", pa.int32()), ("node", pa.int64()), ("label", pa.int64()), ("seeks", pa.bool_()), ("size", pa.int32())])


def _prefixes(often: np.ndarray, similarity: int):
    often = np.minimum(often, np.iinfo("u4").max).astype("u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part, rows = batch.slice(low, 64), []
                for node, label, seeks, own in zip(*part.columns, strict=True):
                    found = np.frombuffer(own.as_buffer(), "u8")
                    of_set = prefix(found, often, similarity)
                    n = len(of_set[0])
                    rows.append([of_set[0].view("i8"), *of_set[1:], *(np.full(n, x) for x in (node.as_py(), label.as_py(), seeks.as_py(), len(found)))])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*rows, strict=True), PREFIX, strict=True)], schema=PREFIX)

    return run


def bounded_pairs(members: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(a, b): nodes of different components, one of which seeks, that share a shingle of their prefixes where the bounds on sizes allow a link.

    No link between such nodes is missing. A shingle that very many sets have in
    their prefixes is divided by bands of sizes; sets that don't seek never meet
    each other.
    """
    rows = members.join(sets, "node").select("node", "label", "seeks", "own").mapInArrow(
        _prefixes(frequencies(sets), similarity), "shingle long, at int, small boolean, first int, last int, node long, label long, seeks boolean, size int"
    )
    rows = materialize(rows.select("shingle", F.explode(F.sequence("first", "last")).alias("band"), "small", "at", "size", "node", "label", "seeks"), "prefixes")
    x, y = rows.where("small").drop("small").alias("x"), rows.where("not small").drop("small").alias("y")
    meets = F.expr(
        f"""x.shingle = y.shingle and x.band = y.band and x.label <> y.label and (x.size < y.size or (x.size = y.size and x.node < y.node))
        and least(x.size - x.at, y.size - y.at) * {100 + similarity}L >= {similarity}L * (x.size + y.size)"""
    )
    seeking = x.where("x.seeks").join(y, meets)
    held = x.where("not x.seeks").join(y.where("y.seeks"), meets)
    pair = [F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")]
    return materialize(seeking.select(*pair).unionAll(held.select(*pair)).distinct(), "bounded")


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    a = labels.select(F.col("node").alias("a"), F.col("label").alias("label_a"))
    b = labels.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
    both = pairs.join(a, "a", "left").join(b, "b", "left")
    return both.select("a", "b", F.coalesce("label_a", "a").alias("label_a"), F.coalesce("label_b", "b").alias("label_b"))


def _listed(ids: DataFrame) -> DataFrame:
    """Broadcast if so few, else shuffled to meet the rows."""
    return F.broadcast(ids) if ids.count() <= LISTED else ids


def _sets_of(rows: DataFrame, classes: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, own): the full sets of some classes, each from the texts of its first document."""
    wanted = materialize(classes.select("node", "doc_id", "mark").join(nodes.distinct(), "node", "left_semi"), "wanted")
    texts = rows.join(_listed(wanted.select("doc_id").distinct()), "doc_id", "left_semi").select("text")
    own = texts.mapInArrow(_sets(words), "of binary, own binary")
    of = wanted.select("node", F.col("mark").alias("of"))
    return materialize(own.join(of, "of").select("node", "own").dropDuplicates(["node"]), "sets")


def _moved(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after links (a, b) between them."""
    tops = components(links).select(F.col("node").alias("was"), F.col("label").alias("top"))
    moved = labels.join(tops, F.col("label") == F.col("was"), "left").select("node", F.coalesce("top", "label").alias("label"))
    moved = moved.unionAll(tops.select(F.col("was").alias("node"), F.col("top").alias("label"))).distinct()
    return materialize(few_files(moved, labels.count() + tops.count()), "labels")


def _new_links(pairs: DataFrame, labels: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(a, b): labels that a confirmed pair of nodes joins."""
    across = materialize(_labelled(pairs, labels).where("label_a <> label_b"), "across")
    return confirm(across, sets, similarity).join(across, ["a", "b"]).select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))


def _same_id(known: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): nodes of different texts with one id."""
    several = known.groupBy("doc_id").agg(F.min("spot").alias("low"), F.max("spot").alias("high")).where("low <> high").select("doc_id")
    several = materialize(several, "several")
    held = known.join(_listed(several), "doc_id", "left_semi").select("doc_id", F.col("mark").alias("of")).distinct()
    nodes = materialize(held.join(classes.select("mark", "node"), F.col("of") == F.col("mark")).select("doc_id", "node"), "same-id")
    return nodes.join(nodes.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select(F.col("node").alias("a"), "b")


def groups(docs: DataFrame, words: int = 5, similarity: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable by links), kept (it is that document)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with scratch(docs.sparkSession):
        signed = materialize(rows.mapInArrow(_signed(words), "doc_id long, n_shingles long, mark binary, trees binary, sketch binary"), "signatures")
        known = signed.where("doc_id is not null and mark is not null")
        first = known.groupBy("mark").agg(F.min(F.struct("doc_id", "trees", "sketch")).alias("first"))
        # Written once, so the nodes stay as they are.
        classes = materialize(first.select("mark", "first.*", F.monotonically_increasing_id().alias("node")), "classes")
        pairs = candidates(classes, similarity)
        sets = _sets_of(rows, classes, pairs.select(F.explode(F.array("a", "b")).alias("node")), words)
        same = _same_id(known.select("doc_id", "mark", F.xxhash64("mark").alias("spot")), classes)
        labels = components(confirm(pairs.where("early"), sets, similarity).unionAll(same))
        labels = _moved(labels, _new_links(pairs, labels, sets, similarity))
        members = mixed_members(classes, labels)
        sets = _sets_of(rows, classes, members.select("node"), words)
        labels = _moved(labels, _new_links(bounded_pairs(members, sets, similarity), labels, sets, similarity))
        own = labels.select(F.col("node").alias("of_node"), "label")
        placed = classes.select("mark", "doc_id", "node").join(own, F.col("node") == F.col("of_node"), "left")
        placed = materialize(placed.select("mark", "doc_id", F.coalesce("label", "node").alias("label")), "placed")
        least = placed.groupBy("label").agg(F.min("doc_id").alias("component"))
        out = signed.select("doc_id", "n_shingles", "mark").join(
            placed.join(least, "label").select(F.col("mark").alias("of"), "component"), F.col("mark") == F.col("of"), "left"
        )
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
        out = out.select("doc_id", "n_shingles", component.alias("component_id"))
        return materialize(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "groups", keep=True)


def query(spark, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2)


#: Links between distinct texts by their shared shingles, then the least id that reaches a document.
ORACLE = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w:
           translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
           ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s
  FROM docs),
kinds AS (SELECT s, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS (SELECT rep, len(s) AS n, unnest(s) AS t FROM kinds),
links AS (
  SELECT x.rep AS a, y.rep AS b FROM tokens x JOIN tokens y ON x.t = y.t AND x.rep <> y.rep
  GROUP BY x.rep, y.rep, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (
  SELECT rep AS a, rep AS b FROM kinds
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(least.component_id, sets.doc_id) AS component_id,
       coalesce(least.component_id, sets.doc_id) = sets.doc_id AS kept
FROM sets LEFT JOIN kinds ON sets.s = kinds.s LEFT JOIN least ON kinds.rep = least.a
"""
