import random

import pytest

from narrata.llm import leakage as L

VOCABULARY = [f"w{i}" for i in range(400)]


def make(n, seed):
    r = random.Random(seed)
    return [r.choice(VOCABULARY) for _ in range(n)]


def edited(words, edits, seed):
    r, w = random.Random(seed), list(words)
    for _ in range(edits):
        i = r.randrange(1, len(w) - 1)
        kind = r.randrange(3)
        w[i : i + (kind < 2)] = [] if kind == 0 else [f"x{r.randrange(99)}"]
    return w


def test_finds_edited_parts_and_no_short_ones(spark):
    items = [(i, " ".join(make(60, i))) for i in range(40)]
    docs, want = [], set()
    for k in range(200):
        i, r = k % 40, random.Random(k)
        w = items[i][1].split()
        n = r.choice([10, 12, 18, 24, 40, 60])
        s = r.randrange(0, 61 - n)
        part = w[s : s + n] if n < 15 else edited(w[s : s + n], n // 10, k)
        docs.append((k, " ".join(make(80, 1000 + k) + part + make(50, 5000 + k))))
        if n >= 18:
            want.add((k, i))
    got = {(r.doc_id, r.item_id) for r in L.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(got & want) >= 0.97 * len(want)


@pytest.mark.parametrize("change", [str.upper, lambda t: t.replace(" ", ",\n"), lambda t: "<p><b>" + t.replace(" ", "</b> <i>") + "</p>", lambda t: "** " + t.replace(" ", " ​") + " **", lambda t: '{"a": "' + t.replace(" ", "\\n") + '"}'])
def test_form_does_not_matter(change):
    t = "The quiet keeper doesn't open the café near the harbour"
    got = [w for w in L.words(change(t)) if w not in ("a", "p", "b", "i")]
    assert got == L.words(t)


def test_odd_rows(spark):
    text = " ".join(make(30, 7))
    docs = spark.createDataFrame([(1, text, 0), (1, text, 0), (2, None, 0), (3, "", 0), (None, text, 0), (4, (" ".join(make(50_000, 9))) + " " + text, 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(10, text), (10, text), (11, None), (12, ""), (13, "w1 w2 w3"), (14, text + " tail")], "item_id long, text string")
    for most in (1 << 20, 0):
        assert {(r.doc_id, r.item_id) for r in L.leaks(docs, items, item_chars=most).collect()} == {(1, 10), (4, 10), (1, 14), (4, 14)}
    assert L.leaks(docs.where("false"), items).count() == 0
    assert L.leaks(docs, items.where("false")).count() == 0
