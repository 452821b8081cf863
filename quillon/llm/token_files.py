"""Token ids in Parquet files that can be read selectively.

A file holds documents in ascending order, one row each: id, offset of its
first token among all of the file's, number of tokens, and the ids as a list
column. Ids are dictionary-encoded bit-packed integers or delta-encoded, row
groups hold about the same number of tokens, and page indexes let a reader
fetch the metadata columns, some row groups or some pages without the rest:
``read_range`` reads a range of ids so, ``read_tokens`` whole files.

Documents are range-partitioned by id and a hash of the text, so a file is one
range, the files in order are all documents in order, and an id (or none) that
very many rows have is divided. A manifest names the files of the attempts
that succeeded. Null texts count as empty; a document with no text still has
its end id. Rows with the same id are ordered by that hash, equal ones together.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.shared import fresh_path, materialize, values
from quillon.llm.tokens import encoder, vocabulary

#: Tokens in a row group, about; bytes in a page, and documents at most.
GROUP_TOKENS, PAGE_BYTES, PAGE_DOCS = 1 << 20, 64 << 10, 256
#: Bytes of text in a file, about; there are at least as many files as the session has partitions.
FILE_BYTES = 64 << 20

FILE = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.field("element", pa.uint16(), nullable=False)))])
WIDE = FILE.set(3, pa.field("ids", pa.list_(pa.field("element", pa.uint32(), nullable=False))))

MANIFEST = pa.schema([("part", pa.int32()), ("path", pa.string()), ("row_group", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def _writer(path: str, out: str, end_id: int, encoding: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e, part = encoder(path), TaskContext.get().partitionId()
        schema = FILE if max(e.library.get_vocab_size(), end_id) < 1 << 16 else WIDE
        end = np.array([end_id], "<u4").tobytes()
        fs, folder = pafs.FileSystem.from_uri(out)
        name = f"{folder}/tokens-{part:06d}-{uuid.uuid4().hex}.parquet"
        fs.create_dir(folder, recursive=True)
        held_ids, held, held_tokens, first, groups = [], [], 0, 0, []
        writer = None

        def flush():
            nonlocal writer, held_tokens, first
            if writer is None:
                writer = pq.ParquetWriter(
                    name, schema, filesystem=fs, compression="zstd", write_page_index=True, data_page_size=PAGE_BYTES, max_rows_per_page=PAGE_DOCS,
                    use_dictionary=["ids.list.element"] if encoding == "dictionary" else False,
                    column_encoding={"doc_id": "DELTA_BINARY_PACKED", "first": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED"} | ({"ids.list.element": "DELTA_BINARY_PACKED"} if encoding == "delta" else {}),
                )
            lengths = np.array([len(b) // 4 for b in held], "i8")
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            flat = np.frombuffer(b"".join(held), "<u4")
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(schema.field(3).type.value_type.to_pandas_dtype())), type=schema.field(3).type)
            writer.write_table(pa.table([pa.array(held_ids, pa.int64()), pa.array(first + offsets[:-1]), pa.array(lengths, pa.int32()), ids], schema=schema), row_group_size=len(held))
            groups.append((part, name, len(groups), len(held), int(offsets[-1])))
            first += int(offsets[-1])
            held_ids.clear(), held.clear()
            held_tokens = 0

        for batch in batches:
            for doc_id, text in zip(*map(values, batch.columns), strict=True):
                held_ids.append(doc_id)
                held.append(e.ids(text) + end)
                held_tokens += len(held[-1]) // 4
                if held_tokens >= GROUP_TOKENS:
                    flush()
        if held:
            flush()
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(map(list, zip(*groups, strict=True)), MANIFEST, strict=True)], schema=MANIFEST)

    return run


def write_tokens(docs: DataFrame, path: str, out: str, end_id: int = 1, encoding: str = "dictionary", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write all documents to files in the shared folder ``out``; a row of the manifest for each row group."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    order = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kinds = "part int, path string, row_group int, n_docs long, n_tokens long"
    return materialize(ordered.mapInArrow(_writer(path, out, end_id, encoding), kinds), "token-manifest")


def _file_bases(manifest: DataFrame) -> DataFrame:
    """(part, path, file_base): tokens in all files before. A file is one row of what is summed on the driver, and their number that of the partitions."""
    files = manifest.groupBy("part", "path").agg(F.sum("n_tokens").alias("n")).toPandas().sort_values("part")
    bases = zip(files["part"].tolist(), files["path"].tolist(), (files["n"].cumsum() - files["n"]).tolist(), strict=True)
    return F.broadcast(manifest.sparkSession.createDataFrame(list(bases), "part int, path string, file_base long"))


def with_starts(manifest: DataFrame) -> DataFrame:
    """Adds ``base``: tokens in all row groups before."""
    base = _file_bases(manifest).drop("path")
    within = Window.partitionBy("part").orderBy("row_group").rowsBetween(Window.unboundedPreceding, -1)
    return (
        manifest.join(base, "part")
        .withColumn("base", F.col("file_base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .select("path", "row_group", "base", "n_docs", "n_tokens")
    )


def _reader(columns: list[str], out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, _ = pafs.FileSystem.from_uri(out)
                with pq.ParquetFile(row["path"], filesystem=fs) as f:
                    t = f.read_row_group(row["row_group"], columns=[c for c in ("doc_id", "n_tokens", "ids") if c in columns]).combine_chunks()
                n = t.column("n_tokens").to_numpy().astype("i8")
                got = {"doc_id": t.column("doc_id").combine_chunks(), "start": pa.array(row["base"] + np.cumsum(n) - n), "n_tokens": pa.array(n)}
                if "ids" in columns:
                    got["ids"] = t.column("ids").combine_chunks()
                yield row, got

    return run


def _digests(out: str):
    read = _reader(["doc_id", "n_tokens", "ids"], out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, got in read(batches):
            ids = got.pop("ids")
            flat, ends = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
            got["ids_crc32"] = pa.array([zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64())
            yield pa.RecordBatch.from_pydict(got)

    return run


def _tokens(out: str, columns: list[str]):
    read = _reader(columns, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, got in read(batches):
            if "ids" in got:
                got["ids"] = got["ids"].cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(got)

    return run


def read_tokens(manifest: DataFrame, out: str, with_ids: bool = True) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens and, if asked for, ids. Without ids only the metadata columns are read."""
    columns = ["doc_id", "n_tokens", *["ids"] * with_ids]
    return _spread(manifest).mapInArrow(_tokens(out, columns), "doc_id long, start long, n_tokens long" + ", ids array<long>" * with_ids)


def read_range(manifest: DataFrame, out: str, low: int, high: int, with_ids: bool = True) -> DataFrame:
    """As ``read_tokens``, of the documents with ids from low to high: files and row groups are chosen by their statistics, pages by the page index."""
    spark = manifest.sparkSession
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long" + ", ids array<long>" * with_ids)
    bases = _file_bases(manifest).select(F.element_at(F.split("path", "/"), -1).alias("file"), "file_base")
    # By name, which carries a random number: files of attempts that failed are in the folder but not in the manifest.
    rows = spark.read.parquet(out).where(F.col("doc_id").between(low, high)).select("doc_id", "first", "n_tokens", *["ids"] * with_ids, F.col("_metadata.file_name").alias("file"))
    start = (F.col("file_base") + F.col("first")).alias("start")
    return rows.join(bases, "file").select("doc_id", start, F.col("n_tokens").cast("long").alias("n_tokens"), *[F.col("ids").cast("array<long>").alias("ids")] * with_ids)


def read_digests(manifest: DataFrame, out: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32 of its ids as little-endian unsigned 32-bit integers."""
    return _spread(manifest).mapInArrow(_digests(out), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _spread(manifest: DataFrame) -> DataFrame:
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return with_starts(manifest).repartition(parts, "path", "row_group")


def query(spark, sf_dir: str) -> DataFrame:
    out = fresh_path(spark, "token-files")
    manifest = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"), out)
    return read_digests(manifest, out)
