"""Token counts without token ids: each distinct pre-token is counted once.

Documents are cut into segments (see ``tokens``: pre-tokens with the
punctuation that clings to them). A block of documents keeps each document's
segment frequencies as offsets into the block's list of distinct segments. The
lists, dealt into buckets by a hash of the segment and compressed, are all that
is shuffled for the count: equal segments of all blocks meet in a bucket, are
counted once, and their counts are joined to the frequencies of the blocks.

Blocks close by the bytes of their distinct segments as well as by number, and
there are more buckets where texts have more bytes, so that a task's memory
follows neither the number of documents nor their length. A single segment, up
to a whole text where a vocabulary can't be cut, is held as one string.

Null and empty texts have 0 tokens and 0 bytes. Documents with the same id each
keep a row. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import materialize, values
from quillon.llm.tokens import Encoder, encoder, vocabulary

#: A block is closed beyond so many distinct segments, characters of these, or documents.
BLOCK_SEGMENTS, BLOCK_CHARS, BLOCK_DOCS = 600_000, 16 << 20, 50_000
#: Bytes of texts for a bucket, at most.
BUCKET_BYTES = 1 << 30
#: Counts that a task remembers; beyond these it forgets the older half, and counts a forgotten segment anew if it comes again.
KNOWN = 2_000_000
#: Longer segments are remembered by a hash of 128 bits.
LONGEST = 64

BLOCKS = pa.schema([
    ("block_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())),
    ("at", pa.binary()), ("often", pa.binary()), ("chunks", pa.list_(pa.binary())),
])


def squeeze(x: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, low bytes first: of small ones the other bytes vanish."""
    return zstandard.compress(x.astype("<u4").view("u1").reshape(-1, 4).T.tobytes(), 1)


def expand(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), "u1").reshape(4, -1).T).view("<u4").ravel()


def pack_strings(strings: list[str]) -> bytes:
    own = [s.encode() for s in strings]
    return zstandard.compress(struct.pack("<I", len(own)) + np.fromiter(map(len, own), "<u4", len(own)).tobytes() + b"".join(own), 3)


def unpack_strings(data: bytes) -> list[str]:
    data = zstandard.decompress(data)
    (n,) = struct.unpack_from("<I", data)
    ends = (np.cumsum(np.frombuffer(data, "<u4", n, 4)) + 4 + 4 * n).tolist()
    return [data[a:b].decode() for a, b in zip([4 + 4 * n, *ends[:-1]], ends, strict=False)]


class PieceCounter:
    """Segments and their token counts for one vocabulary file."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encoder: Encoder | None = None
        else:
            self.encoder = encoder(path)

    def split(self, text: str) -> list[str]:
        if self.encoder is None:
            return [text]
        return self.encoder.split(text)

    @property
    def extra(self) -> int:
        return self.encoder.extra if self.encoder is not None else 0

    def count(self, segment: str) -> int:
        if self.encoder is None:
            return len(self.model.encode(segment))
        return len(self.encoder.segments.encode(segment)) // 4


_COUNTERS: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


class Counts(dict):
    """Token counts of the segments of a bucket, each counted when first asked for."""

    def __init__(self, count):
        super().__init__()
        self.count, self.older = count, {}

    def of(self, segment: str) -> int:
        key = segment if len(segment) <= LONGEST else hashlib.blake2b(segment.encode(), digest_size=16).digest()
        if (n := self.get(key)) is None:
            n = self.older.get(key)
            if n is None:
                n = self.count(segment)
            if len(self) >= KNOWN // 2:
                self.older = dict(self)
                self.clear()
            self[key] = n
        return n


def _blocks(path: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c, part, n, held = counter(path), TaskContext.get().partitionId(), 0, 0
        vocab: dict[str, int] = {}
        docs, sizes, n_bytes, at, often = [], [], [], [], []

        def close() -> pa.RecordBatch:
            """Segments take their places anew: by bucket, and in order within."""
            nonlocal n, held
            segments = list(vocab)
            of = np.fromiter((zlib.crc32(s.encode()) % buckets for s in segments), "i4", len(segments))
            table = pa.table({"bucket": of, "segment": pa.array(segments, pa.string())})
            order = pc.sort_indices(table, sort_keys=[("bucket", "ascending"), ("segment", "ascending")]).to_numpy()
            place = np.empty(len(order), "i8")
            place[order] = np.arange(len(order))
            ends = np.cumsum(np.bincount(of, minlength=buckets))
            chunks = [pack_strings([segments[i] for i in order[a:b]]) if b > a else None for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            gaps, times = [], []
            for p, x in zip(at, often, strict=True):
                own = place[p]
                o = np.argsort(own)
                gaps.append(np.diff(own[o], prepend=0))
                times.append(x[o])
            flat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, "i8")
            row = [[part << 32 | n], [docs[:]], [n_bytes[:]], [sizes[:]], [squeeze(flat(gaps))], [squeeze(flat(times))], [chunks]]
            n, held = n + 1, 0
            for x in (docs, sizes, n_bytes, at, often, vocab):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, BLOCKS, strict=True)], schema=BLOCKS)

        for batch in batches:
            for doc_id, text in zip(*map(values, batch.columns), strict=True):
                found = Counter(c.split(text)) if text else {}
                docs.append(doc_id)
                n_bytes.append(len(text.encode()) if text else 0)
                sizes.append(len(found))
                if found:
                    known = len(vocab)
                    at.append(np.fromiter((vocab.setdefault(s, len(vocab)) for s in found), "i4", len(found)))
                    often.append(np.fromiter(found.values(), "i4", len(found)))
                    held += sum(map(len, islice(reversed(vocab), len(vocab) - known)))
                if len(vocab) >= BLOCK_SEGMENTS or held >= BLOCK_CHARS or len(docs) >= BLOCK_DOCS:
                    yield close()
        if docs:
            yield close()

    return run


def _counted(path: str):
    """Rows come ordered by bucket; within one, a segment that several blocks hold is counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, bucket = counter(path), None
        known = Counts(c.count)
        for batch in batches:
            out = []
            for b, chunk in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if b != bucket:
                    bucket, known = b, Counts(c.count)
                own = unpack_strings(chunk.as_py())
                out.append(squeeze(np.fromiter(map(known.of, own), "i8", len(own))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["block_id", "bucket", "pieces"])

    return run


def _summed(path: str):
    def run(pieces: pa.Table, blocks: pa.Table) -> pa.Table:
        extra = counter(path).extra
        order = np.argsort(pieces.column("bucket").to_numpy())
        packed = pieces.column("pieces").combine_chunks()
        of = np.concatenate([np.zeros(0, "i8"), *(expand(packed[int(i)].as_py()) for i in order)]).astype("i8")
        ids, lengths, sums = [], [], []
        for row in range(blocks.num_rows):
            b = {n: blocks.column(n).combine_chunks()[row] for n in ("doc_ids", "n_bytes", "sizes", "at", "often")}
            sizes = b["sizes"].values.to_numpy()
            ends = np.cumsum(sizes, dtype="i8")
            # Places are gaps within a document; a running sum over all, less that before each document, restores them.
            run_sum = np.cumsum(expand(b["at"].as_py()), dtype="i8")
            before = np.concatenate([[0], run_sum])[ends - sizes]
            worth = of[run_sum - np.repeat(before, sizes)] * expand(b["often"].as_py())
            upto = np.concatenate([[0], np.cumsum(worth)])
            n = upto[ends] - upto[ends - sizes] - np.where(sizes > 0, extra, 0)
            ids.append(b["doc_ids"].values)
            lengths.append(b["n_bytes"].values)
            sums.append(pa.array(n.astype("i8"), pa.int64()))
        return pa.table({"doc_id": pa.chunked_array(ids, pa.int64()), "n_bytes": pa.chunked_array(lengths, pa.int64()), "n_tokens": pa.chunked_array(sums, pa.int64())})

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (2 * BUCKET_BYTES)))
    kinds = "block_id long, doc_ids array<long>, n_bytes array<long>, sizes array<int>, at binary, often binary, chunks array<binary>"
    blocks = materialize(rows.mapInArrow(_blocks(path, 2 * parts), kinds), "token-blocks")
    spread = blocks.select("block_id", F.posexplode("chunks").alias("bucket", "chunk")).where("chunk is not null")
    pieces = spread.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_counted(path), "block_id long, bucket int, pieces binary")
    summed = (
        pieces.groupBy("block_id")
        .cogroup(blocks.drop("chunks").groupBy("block_id"))
        .applyInArrow(_summed(path), "doc_id long, n_bytes long, n_tokens long")
    )
    return summed.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"))
