import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillon.llm import shared, token_count, token_files
from quillon.llm.tokens import vocabulary

TEXTS = [
    (5, "The cat sat.\nIt's  here"), (3, None), (4, ""), (9, "the the the"), (9, "the the the"), (2, "a\n\n\n b\t c "), (7, "x" * 9000),
    (11, "<|endoftext|> hi <|endoftext|>"), (12, " lead"), (13, "Über die Brücke, ça va? 中文 text"), (14, "word " * 4000), (None, "no id"),
]


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_tokens string, block_id int")


def wanted(name, text, **kw):
    return Tokenizer.from_file(vocabulary(name)).encode(text or "", add_special_tokens=False).ids


def test_counts(spark):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(frame(spark), vocabulary("byte_bpe_50k.json")).collect())
    want = sorted((str(i), len((t or "").encode()), n := len(wanted("byte_bpe_50k.json", t)), n > 512) for i, t in TEXTS)
    assert got == want


def test_counts_sentencepiece_and_empty(spark):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted((str(r.doc_id), r.n_tokens) for r in token_count.count_tokens(frame(spark), path).collect())
    assert got == sorted((str(i), len(sp.encode(t or ""))) for i, t in TEXTS)
    assert token_count.count_tokens(frame(spark, []), path).collect() == []


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files_round_trip(spark, encoding, monkeypatch):
    monkeypatch.setattr(token_files, "GROUP_TOKENS", 50)
    out = shared.fresh_path(spark, "t")
    manifest = token_files.write_tokens(frame(spark), vocabulary("word_bpe_49k.json"), out, encoding=encoding)
    want, start = [], 0
    for i, t in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*wanted("word_bpe_49k.json", t), 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    got = sorted(token_files.read_digests(manifest, out).collect(), key=lambda r: r.start)
    assert [tuple(r) for r in got] == [w[:4] for w in want]
    full = sorted(token_files.read_tokens(manifest, out).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.ids) for r in full] == [(w[0], w[4]) for w in want]
    slim = token_files.read_tokens(manifest, out, with_ids=False)
    assert slim.columns == ["doc_id", "start", "n_tokens"] and slim.count() == len(want)


def test_files_empty(spark):
    out = shared.fresh_path(spark, "t")
    manifest = token_files.write_tokens(frame(spark, []), vocabulary("word_bpe_49k.json"), out)
    assert token_files.read_digests(manifest, out).collect() == []
    assert token_files.read_range(manifest, out, 0, 9).collect() == []


def _scanned(df):
    """Rows that the scan of a plan has given, after it ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    todo, out = [plan], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("ResultQueryStage"):
            todo.append(node.plan())
            continue
        if "Scan parquet" in node.nodeName():
            out += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_selective_reads(spark, encoding, monkeypatch):
    """A range of ids reads some groups and some pages of several files; encodings and indexes stand in the footer."""
    import glob

    import pyarrow.parquet as pq

    monkeypatch.setattr(token_files, "GROUP_TOKENS", 20_000)
    monkeypatch.setattr(token_files, "PAGE_DOCS", 64)
    out = shared.fresh_path(spark, "t")
    rows = [(i, f"some words of document {i} " * 6) for i in range(6000)]
    manifest = token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary("word_bpe_49k.json"), out, encoding=encoding)
    assert manifest.select("path").distinct().count() > 1 and manifest.count() > 2 * manifest.select("path").distinct().count()
    whole = {r.doc_id: tuple(r) for r in token_files.read_tokens(manifest, out).collect()}
    part = token_files.read_range(manifest, out, 3010, 3019)
    assert sorted(tuple(r) for r in part.collect()) == [whole[i] for i in range(3010, 3020)]
    most = max(r.n_docs for r in manifest.collect())
    scanned = _scanned(token_files.read_range(manifest, out, 3010, 3019))
    assert 10 <= scanned < most / 2 < len(rows)  # less than a group: pages were chosen
    assert token_files.read_range(manifest, out, -5, -1).count() == 0
    slim = token_files.read_range(manifest, out, 3010, 3019, with_ids=False)
    assert "ids" not in slim._jdf.queryExecution().executedPlan().toString() and slim.count() == 10
    for path in glob.glob(out.removeprefix("file://") + "/*.parquet"):
        group = pq.ParquetFile(path).metadata.row_group(0)
        columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        assert all(c.has_offset_index for c in columns.values()) and columns["doc_id"].has_column_index
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
        assert ("RLE_DICTIONARY" if encoding == "dictionary" else "DELTA_BINARY_PACKED") in columns["ids.list.element"].encodings


def test_many_rows_without_id_are_divided(spark):
    out = shared.fresh_path(spark, "t")
    rows = [(None, f"text number {i}") for i in range(3000)] + [(7, f"other {i}") for i in range(1000)]
    manifest = token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary("word_bpe_49k.json"), out)
    docs = [r.n for r in manifest.groupBy("part").agg({"n_docs": "sum"}).withColumnRenamed("sum(n_docs)", "n").collect()]
    assert len(docs) == 4 and max(docs) < 2000
    got = sorted((r.start, r.n_tokens) for r in token_files.read_digests(manifest, out).collect())
    assert len(got) == 4000 and all(a + n == b for (a, n), (b, _) in zip(got, got[1:]))


def test_blocks_close_by_bytes(spark, monkeypatch):
    """Of texts that can't be cut a block holds a bounded number of characters, however many documents there are."""
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [f"text number {i} " + "of many words " * 400 for i in range(1000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(token_count, "BLOCK_CHARS", 1 << 19)
    blocks = rows.mapInArrow(token_count._blocks(path, 4), "block_id long, doc_ids array<long>, n_bytes array<long>, sizes array<int>, at binary, often binary, chunks array<binary>")
    held = [sum(r.n_bytes) for r in blocks.select("n_bytes").collect()]
    assert sum(held) == sum(map(len, texts)) and len(held) > 5 and max(held) < (1 << 19) + 10_000
    got = sorted((r.doc_id, r.n_tokens) for r in token_count.count_tokens(rows, path).collect())
    assert got == [(i, len(sp.encode(t))) for i, t in enumerate(texts)]


def test_a_long_text_without_blanks(spark):
    """Two rows of 5 MB, one segment each, among short ones."""
    text = "abcdefghij" * 500_000
    rows = spark.range(4).selectExpr("id doc_id", "if(id < 2, repeat('abcdefghij', 500000), 'abcdefghij') text")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_count.count_tokens(rows, vocabulary("byte_bpe_50k.json")).collect()}
    assert got[0] == got[1] == (len(text), len(wanted("byte_bpe_50k.json", text))) and got[2] == got[3] == (10, len(wanted("byte_bpe_50k.json", "abcdefghij")))


def test_more_buckets_than_partitions(spark, monkeypatch):
    rows = [(i, f"Text {i % 37} about w{i} and w{i // 2}, " + "y" * (i % 90)) for i in range(300)]
    monkeypatch.setattr(token_count, "BUCKET_BYTES", sum(len(t) for _, t in rows) // 16 + 1)
    monkeypatch.setattr(token_count, "BLOCK_SEGMENTS", 50)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_tokens) for r in token_count.count_tokens(docs, vocabulary("byte_bpe_50k.json")).collect())
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    assert got == sorted((i, len(library.encode(t, add_special_tokens=False).ids)) for i, t in rows)


def test_forgotten_counts_are_counted_anew(monkeypatch):
    monkeypatch.setattr(token_count, "KNOWN", 4)
    asked = []
    counts = token_count.Counts(lambda s: asked.append(s) or len(s))
    segments = ["a", "bb", "a", "x" * 100, "x" * 100, "ccc", "dddd", "a", "x" * 101]
    assert [counts.of(s) for s in segments] == [len(s) for s in segments]
    assert asked.count("bb") == 1 and asked.count("x" * 100) == 1 and len(counts) + len(counts.older) <= 4
