import os
import random
import zlib
from collections import Counter

import pytest

from quillon.llm import lang_id as l

DIR = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = l.query(spark, DIR).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out and docs[r.doc_id].lang]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.96 * len(held)
    assert all(0 <= r.score <= 1 for r in got) and sum(r.accepted for r in got) >= 0.98 * len(got)


TEXTS = {"en": "the house of the man and the tree of the garden ", "de": "das haus und der baum in dem garten von dem mann "}


def test_defined_cases(spark):
    rows = [(i, t * 3, lang, "z") for lang, t in TEXTS.items() for i in range(5)] + [(50, None, "en", ""), (51, "", None, "")]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    dictionaries = l.train(train)
    assert set(dictionaries) == {"en", "de"}
    docs = [(1, None), (2, ""), (3, "12 :-) 34"), (4, TEXTS["de"]), (5, "the man and the house " * 5000), (5, "THE GARDEN OF THE MAN"), (None, "der garten und das haus")]
    got = [(r.doc_id, r.lang_pred, r.accepted) for r in l.identify(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string"), dictionaries).collect()]
    assert got == [(1, "und", False), (2, "und", False), (3, "und", False), (4, "de", True), (5, "en", True), (5, "en", True), (None, "de", True)]
    assert [r.lang_pred for r in l.identify(spark.createDataFrame([(1, "the")], "doc_id long, text string"), {}).collect()] == ["und"]
    assert l.train(train.where("false")) == {}
    assert l.identify(train.where("false"), dictionaries).collect() == []


def test_narrow_margins_are_rejected(spark):
    same = {"a": l.dictionary({"the": 3, "man": 1}), "b": l.dictionary({"the": 3, "man": 1})}
    r = l.identify(spark.createDataFrame([(1, TEXTS["en"])], "doc_id long, text string"), same).first()
    assert (r.lang_pred, r.score, r.accepted) == ("a", 0.0, False)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
def test_gibberish_and_unlearned_languages_are_rejected(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    gibberish = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.randint(15, 600)))) for i in range(200)], "doc_id long, text string")
    judged = l.identify(gibberish, l.train(docs.where(~l.held_out()))).collect()
    assert sum(not r.accepted for r in judged) >= 0.98 * len(judged)
    judged = l.identify(docs.where("lang = 'fr' and text is not null"), l.train(docs.where("lang <> 'fr'"))).collect()
    assert len(judged) > 100 and sum(not r.accepted for r in judged) >= 0.9 * len(judged)


def test_every_label_gets_a_dictionary(spark, monkeypatch):
    monkeypatch.setattr(l, "SAMPLE_DOCS", 2)
    rows = [(i, f"word{i}", f"l{i:03}") for i in range(150)]
    rows += [(7, f"many{i}", "one-id") for i in range(300)] + [(8, "copy", "copies")] * 300
    rows += [(i, f"own{i}", "xx") for i in range(1000, 1300)]
    rows += [(None, f"nobody{i % 7}", "no-id") for i in range(200)] + [(9000, "12 - 3", "no-words")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = l.train(df)
    assert got == l.train(df.repartition(7))
    assert got.pop("no-words") == b" " and rows.pop()
    assert set(got) == {r[2] for r in rows} and all(d.strip() for d in got.values())
    assert got["l149"] == b" word " and all(len(got[x].split()) <= 2 for x in ("one-id", "xx"))


def test_many_labels_go_in_blocks(spark):
    """No block holds more than its bound, and the best of all blocks is what all dictionaries at once give."""
    code = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:03}")
    rows = [(i, " ".join(f"{code(i)}{x} {x}{code(i)}" for x in ("in", "or", "un", "ta")) * 2, f"l{i:03}") for i in range(600)]
    learned = l.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    sizes = [len(b) for b in l.blocks(learned)]
    assert sum(sizes) == 600 and max(sizes) <= l.BLOCK_LABELS and len(sizes) >= 10
    whole = {k: v for b in l.blocks(learned) for k, v in b.items()}
    texts = [rows[i][1] for i in range(0, 600, 50)] + [None, "", "?", "aa bb"]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, row string, two int")
    judged = {r.doc_id: r for r in l.identify(docs, learned).collect()}
    assert len(judged) == len(texts) and judged[0].row == "x" and judged[0].two == 0
    every = l.Compressors(whole)
    for i, t in enumerate(texts):
        if not t or t == "?":
            assert (judged[i].lang_pred, judged[i].score, judged[i].accepted) == ("und", 0.0, False)
            continue
        (best, lang), (runner, _) = sorted(zip(every.sizes(t), every.langs))[:2]
        assert judged[i].lang_pred == lang and judged[i].score == pytest.approx(1 - best / runner) and judged[i].accepted == (judged[i].score >= l.MARGIN)


def by_hand(rows, texts):
    """All of it anew, without the module's functions: (language, lead) of each text."""
    import zstandard

    fold = lambda t: " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split())
    counts: dict = {}
    for _, text, lang in rows:
        if text is not None and lang is not None:
            counts.setdefault(lang, {})
            for w in fold(text).split():
                counts[lang][w] = counts[lang].get(w, 0) + 1
    makers = {}
    for lang, own in counts.items():
        whole = b""
        for w in sorted(own, key=lambda w: (-own[w], w)):
            if len(whole) + len(w.encode()) + 1 >= 65536:
                break
            whole = b" " + w.encode() + whole
        p = zstandard.ZstdCompressionParameters.from_level(5, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
        d = zstandard.ZstdCompressionDict(whole + b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        makers[lang] = zstandard.ZstdCompressor(compression_params=p, dict_data=d)
    out = []
    for text in texts:
        if not text or not any(c.isalpha() for c in text):
            out.append(("und", 0.0))
            continue
        data = f" {fold(text)} ".encode()
        data = data * 6 if len(data) < 512 else data
        sizes = sorted((sum(len(m.compress(data[i : i + 4096])) for i in range(0, len(data), 4096)), lang) for lang, m in makers.items())
        out.append((sizes[0][1], 1 - sizes[0][0] / sizes[1][0]))
    return out


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang").where("crc32(cast(doc_id as string)) % 4 <> 2")
    learned = docs.where("doc_id % 3 = 0")
    rows = [tuple(r) for r in learned.collect()]
    assert max(Counter(r[2] for r in rows).values()) <= l.SAMPLE_DOCS
    judged = [(r.text, r.lang_pred, r.score, r.accepted) for r in l.identify(docs, l.train(learned)).collect()]
    judged += [(r.text, r.lang_pred, r.score, r.accepted) for r in l.identify(spark.createDataFrame([("",), (None,), ("?",), ("la casa de la",), ("a " * 30_000,)], "text string"), l.train(learned)).collect()]
    want = by_hand(rows, [j[0] for j in judged])
    for (_, lang, score, accepted), (other, lead) in zip(judged, want, strict=True):
        assert lang == other and score == pytest.approx(lead) and accepted == (lead >= 0.03 and lang != "und")
