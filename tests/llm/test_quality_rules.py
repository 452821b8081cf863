import random
import re
from collections import Counter

from quillon.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    wins = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if wins[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_base_measures(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "é" * 3 + "\U0001f600 x", "a b c d e a b c d e", "x " * 3000, "l1 a\nl1 a\n \n \nl2", "#$ <b>|", "a\xa0b c d e\xa0f"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) + rng.choice(["", "\n", "\n\nq", "\r\n "]) for _ in range(150)]
    texts.append(" ".join(str(rng.randint(0, 40)) for _ in range(20_000)))
    rows = [(i, t, "extra", True) for i, t in enumerate(texts)] + [(3, "a", "again", True), (None, "no id", "", None)]
    got = q.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept boolean")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        r = by[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), repr(t)[:80]
        assert not (r.kept and r.base_failed)


def test_table_of_rules(spark):
    rows = [(1, "the house of the man is on the hill and it is red"), (2, "# # # # the house of the man is on the hill # # # #"), (3, "THE HOUSE OF THE MAN IS ON THE HILL AND IT IS RED")]
    got = {r.doc_id: r.kept for r in q.apply_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False}
    free = q.apply_rules(spark.createDataFrame(rows, "doc_id long, text string"), rules=())
    assert all(r.kept for r in free.collect())


def test_empty_table_and_no_python(spark):
    df = q.apply_rules(spark.createDataFrame([], "doc_id long, text string"))
    assert df.collect() == []
    assert "Python" not in df._jdf.queryExecution().toString()
