"""Packing documents into fixed-length sequences as a cutting-stock problem.

Every document becomes its token ids and an end id, cut at multiples of the
sequence length; what is left over at the end is a shorter piece. Lengths are
counted in bins of ``unit`` tokens, those under a sixteenth of a sequence
exactly. Over that histogram, whose size is fixed, a linear program chooses how
often each pattern (a multiset of bins that fits a sequence) is cut; columns are
generated by a knapsack dynamic program that prices patterns with the program's
duals. Multiplicities are rounded down and the few items left are packed
first-fit by falling length. The program runs for the longer pieces first; short
ones fill the room that these leave, and the rest of them have a program of
their own. Pieces are ranked
within their bin in order of (doc_id, start), and arithmetic on the rank gives
each its sequence; only the histogram and the patterns ever reach the driver.

Null and empty texts are a single end id. Rows with the same id are separate
documents. Other columns of the input are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import warnings
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.shared import materialize, values
from quillon.llm.tokens import encoder, vocabulary

#: Relative distance from the optimum at which no more patterns are sought: the last 0.03 % of sequences would take most of the columns.
GAP = 3e-4
#: Columns after which the search ends with the plan it has; plans for drawn lengths end by the gap after a few hundred.
ROUNDS = 5000
#: Pieces under this part of a sequence are counted by their exact length.
SHORT = 16

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bin int"


# --- the cutting-stock program, on the driver ---------------------------------------------------


def best_pattern(sizes: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack over distinct sizes by dynamic programming: the most value that fits, and how often each item is taken."""
    worth, of = np.full(room + 1, -np.inf), np.zeros(room + 1, "i8")
    worth[sizes], of[sizes] = values, np.arange(len(sizes))
    best, last = np.zeros(room + 1), np.zeros(room + 1, "i8")
    longest = int(sizes.max())
    for c in range(1, room + 1):
        low = max(0, c - longest)
        gain = worth[1 : c - low + 1] + best[low:c][::-1]
        k = int(gain.argmax())
        if gain[k] > best[c - 1] + 1e-12:
            best[c], last[c] = gain[k], k + 1
        else:
            best[c] = best[c - 1]
    taken, c = np.zeros(len(sizes)), room
    while c > 0:
        if size := int(last[c]):
            taken[of[size]] += 1
            c -= size
        else:
            c -= 1
    return float(best[room]), taken


def cutting_patterns(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is cut, so that every item is used exactly once. After ``rounds`` columns it ends with the plan it has, which is valid, and warns how far that may be from the best."""
    m = len(sizes)
    if not m:
        return []
    basis = np.diag((room // sizes).astype(float))
    inverse = np.diag(1 / (room // sizes))
    amounts = inverse @ demand
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        value, column = best_pattern(sizes, duals, room)
        if value <= 1 + GAP:  # the optimum is at least the present plan divided by this value
            break
        step = inverse @ column
        can = step > 1e-9
        if not can.any():
            break
        ratios = np.where(can, amounts / np.where(can, step, 1), np.inf)
        row = int(np.argmin(ratios))
        pivot = inverse[row] / step[row]
        inverse = inverse - np.outer(step, pivot)
        inverse[row] = pivot
        basis[:, row] = column
        amounts = np.maximum(inverse @ demand, 0)
    else:
        warnings.warn(f"the plan may be {best_pattern(sizes, inverse.sum(axis=0), room)[0] - 1:.2%} longer than the best after {rounds} columns", stacklevel=2)
    times = np.floor(amounts + 1e-9).astype("i8")
    while (over := (basis @ times > demand)).any():  # never more than there is, whatever the rounding
        times[int(np.argmax((basis[over].sum(axis=0) > 0) & (times > 0)))] -= 1
    plan = [(basis[:, j].astype("i8"), int(t)) for j, t in enumerate(times) if t]
    left = (demand - basis @ times).round().astype("i8")
    return plan + first_fit(sizes, left, room)


def first_fit(sizes: np.ndarray, left: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Longest first, each into the first sequence with room."""
    free = np.zeros(0, "i8")
    contents: list[Counter] = []
    for k in np.argsort(-sizes, kind="stable"):
        for _ in range(int(left[k])):
            fits = np.flatnonzero(free >= sizes[k])
            if len(fits):
                at = int(fits[0])
            else:
                at = len(contents)
                contents.append(Counter())
                free = np.append(free, room)
            free[at] -= sizes[k]
            contents[at][int(k)] += 1
    same = Counter(tuple(sorted(c.items())) for c in contents)
    out = []
    for items, n in same.items():
        pattern = np.zeros(len(sizes), "i8")
        for k, x in items:
            pattern[k] = x
        out.append((pattern, n))
    return out


def sequence_plan(sizes: np.ndarray, demand: np.ndarray, length: int, unit: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """Patterns over bins given in tokens: those of the longer pieces, filled up with short ones, and those of the short ones left."""
    long = sizes >= length // SHORT
    short, left, out = sizes[~long], demand[~long].astype("i8"), []
    for pattern, times in cutting_patterns(sizes[long] // unit, demand[long], length // unit, rounds):
        room = length - int((pattern * sizes[long]).sum())
        while times:
            add, free = np.zeros(len(short), "i8"), room
            for k in np.argsort(-short, kind="stable"):
                add[k] = min(free // short[k], left[k])
                free -= int(add[k] * short[k])
            n = int(min([times, *(left[add > 0] // add[add > 0])]))
            whole = np.zeros(len(sizes), "i8")
            whole[long], whole[~long] = pattern, add
            out.append((whole, n))
            left, times = left - n * add, times - n
    some = np.flatnonzero(~long)[left > 0]
    for pattern, times in cutting_patterns(sizes[some], left[left > 0].astype(float), length, rounds):
        whole = np.zeros(len(sizes), "i8")
        whole[some] = pattern
        out.append((whole, times))
    return out


def assignment(sizes: np.ndarray, plan: list[tuple[np.ndarray, int]], exact: int) -> dict[int, tuple[np.ndarray, ...]]:
    """Per bin: first rank, items a sequence, first sequence, first slot, and tokens in the bins of exact length before, of each pattern that holds it. Those stand first."""
    out: dict[int, list[list[int]]] = {int(s): [] for s in sizes}
    ranks, sequence = dict.fromkeys(out, 0), 0
    for pattern, times in plan:
        slot = before = 0
        for k in np.argsort(sizes, kind="stable"):
            if n := int(pattern[k]):
                s = int(sizes[k])
                out[s].append([ranks[s], n, sequence, slot, before])
                ranks[s] += n * times
                slot += n
                before += n * s if s < exact else 0
        sequence += times
    return {s: tuple(np.array(c, "i8") for c in zip(*rows, strict=True)) for s, rows in out.items() if rows}


# --- on the executors ----------------------------------------------------------------------------


def bin_of(size: int, length: int, unit: int) -> int:
    """Tokens that a piece is counted as."""
    return size if size < length // SHORT else -(-size // unit) * unit


def _pieces(path: str, length: int, unit: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[list] = [[] for _ in range(6 + with_ids)]
            for doc_id, text in zip(*map(values, batch.columns), strict=True):
                ids = e.ids(text) + end
                n = len(ids) // 4
                for start in range(0, n, length):
                    own = ids[4 * start : 4 * (start + length)]
                    size = len(own) // 4
                    for column, x in zip(rows, (doc_id, start, size, zlib.crc32(own), n, bin_of(size, length, unit), own), strict=False):
                        column.append(x)
            kinds = [pa.int64()] * 5 + [pa.int32()] + [pa.binary()] * with_ids
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", "ids"][: len(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=names)

    return run


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rank of each piece among those of its bin in this partition."""
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), Counter()
    for batch in batches:
        ranks = []
        for b in batch.column("bin").to_pylist():
            ranks.append(seen[b])
            seen[b] += 1
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, "i4")), pa.array(ranks, pa.int64())], names=[*batch.schema.names, "part", "rank"]
        )


def _placed(before: dict[tuple[int, int], int], places: dict[int, tuple[np.ndarray, ...]], exact: int):
    """``base``: where a piece of exact length stands, or where those of its sequence end; ``among``: -1 for pieces that stand after others of their sequence by these' lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, parts, ranks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bin", "part", "rank"))
            sequence, slot, base = (np.zeros(len(bins), "i8") for _ in range(3))
            for b in np.unique(bins):
                first, n, first_sequence, first_slot, tokens = places[int(b)]
                own = np.flatnonzero(bins == b)
                rank = ranks[own] + np.array([before[int(p), int(b)] for p in parts[own]], "i8")
                k = np.searchsorted(first, rank, side="right") - 1
                nth = (rank - first[k]) % n[k]
                sequence[own] = first_sequence[k] + (rank - first[k]) // n[k]
                slot[own] = first_slot[k] + nth
                base[own] = tokens[k] + (nth * b if b < exact else 0)
            keep = [i for i, c in enumerate(batch.schema.names) if c not in ("bin", "part", "rank")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(sequence), pa.array(slot), pa.array(base), pa.array(np.where(bins < exact, slot, -1))],
                names=[*(batch.schema.names[i] for i in keep), "sequence_id", "slot", "base", "among"],
            )

    return run


def pack(docs: DataFrame, path: str, length: int = 2048, unit: int = 8, end_id: int = 1, with_ids: bool = False, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (little-endian unsigned 32-bit) if asked for."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = PIECES + ", ids binary" * with_ids
    pieces = materialize(rows.mapInArrow(_pieces(path, length, unit, end_id, with_ids), kinds), "pieces")
    order = ["bin", "doc_id", "start", "ids_crc32"]
    ranked = materialize(
        pieces.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_ranked, kinds + ", part int, rank long"), "ranked"
    )
    # A partition holds a range of bins, so there are about as many of these rows as partitions and bins together.
    counts = sorted((r["part"], r["bin"], r["count"]) for r in ranked.groupBy("part", "bin").count().collect())
    before: dict[tuple[int, int], int] = {}
    total: Counter = Counter()
    for part, b, n in counts:
        before[part, b] = total[b]
        total[b] += n
    sizes = np.array(sorted(total), "i8")
    plan = sequence_plan(sizes, np.array([total[int(s)] for s in sizes], float), length, unit, rounds)
    places = assignment(sizes, plan, length // SHORT)
    kept = PIECES.replace(", bin int", "") + ", ids binary" * with_ids
    placed = ranked.mapInArrow(_placed(before, places, length // SHORT), kept + ", sequence_id long, slot long, base long, among long")
    # Short pieces, of which a sequence may hold thousands, stand alone in their window; of the others it holds sixteen at most.
    earlier = Window.partitionBy("sequence_id", "among").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.col("base") + F.coalesce(F.sum("length").over(earlier), F.lit(0))).drop("slot", "base", "among")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"))
