from collections import defaultdict

import pytest

from narrata.llm import mixing as M


def test_flow_fills_quotas_with_the_least_repetition():
    got = M.allocate({("a",): 100.0, ("b",): 10.0, ("a", "b"): 20.0}, {"a": 100.0, "b": 60.0}, {"a": 1, "b": 3})
    by = defaultdict(float)
    for (_, _, s), t in got.items():
        by[s] += t
    assert by["a"] == pytest.approx(100) and by["b"] == pytest.approx(60)
    # Shared texts serve b, whose own are too few; every text is used once before any is used twice.
    assert sum(t for (p, _, s), t in got.items() if s == "b" and p == ("a", "b")) > 19


def test_largest_total():
    assert M.largest_total({("a",): 100.0, ("b",): 10.0}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 4}) == pytest.approx(80, rel=1e-3)
    assert M.largest_total({}, {"a": 1.0}, {"a": 1}) == 0


@pytest.fixture(scope="module")
def made(spark):
    docs = [(i, "big" if i % 3 else "small" if i % 2 else "mid", f"text number {i} " + "of some words " * (i % 17 + 1)) for i in range(1, 1500)]
    docs += [(5000 + i, "mid", docs[i][2]) for i in range(0, 300, 3)]
    docs += [(9001, "big", None), (9002, None, "no source here"), (9003, "big", ""), (9004, "other", "not wanted"), (1, docs[0][1], docs[0][2])]
    targets = [("big", 0.5, 1), ("small", 0.2, 3), ("mid", 0.25, 2), ("absent", 0.05, 2), ("zero", 0.0, 1), (None, 0.5, 1)]
    return spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, source string, text string, n_tokens int"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_shares_and_caps(spark, made):
    docs, targets = made
    rows = M.mixture(docs, targets).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    cap = {"big": 1, "small": 3, "mid": 2}
    assert {r.source for r in rows} == set(cap)
    assert all(1 <= r.repeats <= cap[r.source] and text[r.doc_id] for r in rows)
    share = {r.source: r for r in M.shares(spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, repeats int"), targets).collect() if r.source}
    assert share["absent"].tokens == 0
    for s, w in (("big", 0.5), ("small", 0.2), ("mid", 0.25)):
        assert share[s].actual_share == pytest.approx(w / 0.95, abs=0.02)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.mixture(docs, targets).collect()))
    other = M.mixture(docs, targets, seed=5).collect()
    assert sorted(map(tuple, rows)) != sorted(map(tuple, other))


def test_small_source_falls_short_where_the_size_is_given(made):
    docs, targets = made
    rows = M.mixture(docs, targets, total_tokens=1e9).collect()
    used = defaultdict(int)
    for r in rows:
        used[r.source] = max(used[r.source], r.repeats)
    assert used["small"] == 3 and used["big"] == 1


def test_empty_tables(made):
    docs, targets = made
    assert M.mixture(docs.where("false"), targets).count() == 0
    assert M.mixture(docs, targets.where("false")).count() == 0
    assert M.shares(M.mixture(docs.where("false"), targets), targets).where("tokens > 0").count() == 0
