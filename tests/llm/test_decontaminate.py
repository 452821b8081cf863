import random

from quillon.llm import decontaminate as d


def distance(p, t):
    """Of p and the nearest part of t, by the full table."""
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_myers_against_the_table():
    rng = random.Random(1)
    for _ in range(300):
        p = "".join(rng.choice("abcé ") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 120)))
        assert d.myers(d.masks(p), len(p), t)[0] == distance(p, t)


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        k = rng.random()
        if k < 0.4:
            s[i] = rng.choice("abcdefgh")
        elif k < 0.7:
            del s[i]
        else:
            s.insert(i, rng.choice("abcdefgh"))
    return "".join(s)


def test_query_against_brute_force(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([2, 6, 20, 40]))) for i in range(25)] + [(90, None), (91, "  "), (92, "!!"), (93, "Same Item twice over here"), (94, "same item, twice over here")]
    docs = []
    for i in range(150):
        own = text(rng.choice([0, 3, 60]))
        if rng.random() < 0.7:
            t = rng.choice(items[:25])[1]
            own += " " + edited(rng, t, rng.randint(0, 1 + len(t) // 12)) + " " + text(5)
        docs.append((i, own))
    docs += [(200, None), (201, ""), (202, "SAME  item\ntwice -- over here"), (203, text(20_000) + " " + items[3][1])]
    rows = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in d.matches(rows, bench).collect()}
    want = {}
    for i, t in docs:
        for j, x in items:
            p, own = d.normal(x or ""), d.normal(t or "")
            if p and own and (i != 203 or j == 3):
                k = d.budget(len(p))
                if (n := 0 if p in own else distance(p, own)) <= k:
                    want[i, j] = n
    assert {k: v for k, v in got.items() if k[0] != 203 or k[1] == 3} == want and (202, 93) in got and (202, 94) in got
    kept = d.without_leaks(rows, bench)
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {k[0] for k in got}


def test_blocks_and_empty_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "six seven eight nine")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five"), (2, "six seven eight nine")], "item_id long, text string")
    monkeypatch.setattr(d, "item_blocks", lambda *a: iter([[(1, "one two three four five")], [(2, "six seven eight nine")]]))
    assert sorted(tuple(r) for r in d.matches(docs, items).collect()) == [(1, 1, 0), (2, 2, 0)] and d.without_leaks(docs, items).collect() == []
    monkeypatch.undo()
    assert d.matches(docs, items.where("false")).collect() == [] and d.matches(docs.where("false"), items).collect() == []
    assert len(list(d.item_blocks(items, "item_id", "text", chars=5))) == 2


def test_items_with_words_replaced_are_found():
    rng = random.Random(4)
    word = lambda n, letters="abcdefghijklm": "".join(rng.choice(letters) for _ in range(n))
    for n, replaced in [(81, 1), (130, 2), (250, 4)]:
        for _ in range(20):
            item = [word(5) for _ in range(n // 6)]
            item.append(word(n - 6 * len(item)))
            leak = item.copy()
            for i in rng.sample(range(len(item) - 1), replaced):
                leak[i] = word(5, "nopqrstuvwxyz")
            text = " ".join(word(5) for _ in range(40))
            assert [x for x, _ in d.Matcher([(1, " ".join(item))]).find(f"{text} {' '.join(leak)} {text}")] == [1]
            assert d.Matcher([(1, " ".join(item))]).find(f"{text} {text}") == []


def test_what_follows_with_one_edit():
    rng = random.Random(6)
    for _ in range(4000):
        p = "".join(rng.choice("ab") for _ in range(rng.randint(1, 7)))
        t = "".join(rng.choice("ab") for _ in range(rng.randint(0, 8)))[: len(p) + 1]
        want = any(d.myers(d.masks(p), len(p), "")[0] <= 1 if not t[:n] else whole(p, t[:n]) <= 1 for n in range(len(t) + 1))
        assert d._follows(p, t) == want, (p, t)


def whole(p, t):
    """Edit distance of both in full."""
    row = list(range(len(t) + 1))
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def test_items_of_one_template_and_a_small_memory(monkeypatch):
    monkeypatch.setattr(d, "DETAILS", 3)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(7))
    items = [(i, f"which of the following is true of {word()} {word()} {word()} {word()}") for i in range(40)]
    m = d.Matcher(items)
    text = " ".join(word() for _ in range(30))
    for i, t in items:
        assert m.find(f"{text} {t} {text}") == [(i, 0)]
        assert m.find(f"{text} {t[:45]}q{t[45:]} {text}") == [(i, 1)]
    both = m.find(f"{items[3][1][:40]}q{items[3][1][40:]} {text} {items[9][1][:50]}q{items[9][1][50:]}")
    assert both == [(3, 1), (9, 1)] and m.details.cache_info().currsize <= 3


def test_a_worker_makes_one_matcher_for_a_block():
    items, others = [(1, "one two three four five")], [(1, "one two three four six")]
    key, other = d._key(items, 10, 8), d._key(others, 10, 8)
    assert key != other and d._key(items, 10, 9) != key
    made = d.matcher(key, items, 10, 8)
    assert d.matcher(key, items, 10, 8) is made and d.matcher(other, others, 10, 8) is not made and list(d._MATCHERS) == [other]
