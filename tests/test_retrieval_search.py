"""Every question is answered, and searches meet every row."""

import __spark_entry__ as entry
from narrata.operators import retrieval as A

SF = "/root/testdata/sf0.001"
Q = entry.queries()


def test_every_question_is_answered(spark):
    m = spark.read.parquet(f"{SF}/memories.parquet").where("question IS NOT NULL AND book_id IS NOT NULL").select("memory_id", "book_id").distinct()
    asked = sorted(r.memory_id for r in m.collect())
    for name in ("chat_prompts", "chat_drafts"):
        assert sorted(r.query_id for r in Q[name](spark, SF).collect()) == asked, name
    p = spark.read.parquet(f"{SF}/passages.parquet").where("pos IS NOT NULL AND trim(text) <> ''")
    cited = {r.memory_id for r in m.join(p, "book_id", "left_semi").collect()}
    assert {r.query_id for r in Q["chat_citations"](spark, SF).collect()} == cited


def test_search_in_blocks_is_exact(spark):
    rows = spark.createDataFrame([(f"r{i}", "ab"[i % 2], i // 3, [float(i % 5), 1.0, float(i % 7)] if i != 9 else [1.0]) for i in range(60)], "id string, g string, pos long, v array<double>")
    q = spark.createDataFrame([(f"q{i}", "abc"[i % 3], [1.0, float(i), 0.0]) for i in range(9)], "query_id string, g string, q array<double>")
    want = A.searched(q, rows).collect()
    assert len(want) == 18 and sorted(map(str, want)) == sorted(map(str, A.searched(q, rows, block=2, cells=5).collect()))
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / sum(x * x for x in a) ** 0.5 / sum(x * x for x in b) ** 0.5, 12) if len(a) == len(b) else 0.0
    all_ = rows.collect()
    for x in q.where("g <> 'c'").collect():
        best = sorted((-cos(x.q, r.v), r.pos, r.id) for r in all_ if r.g == x.g)[:3]
        assert [r[2] for r in best] == [r.id for r in sorted(want, key=lambda r: r["rank"]) if r.query_id == x.query_id]


def test_unusable_vectors_are_left_out(spark):
    rows = spark.createDataFrame([("n", "a", 0, None), ("e", "a", 1, []), ("x", "a", 2, [1.0, float("nan")]), ("y", "a", 3, [None, 1.0]), ("ok", "a", 4, [1.0, 0.0]), ("z", "a", 5, [0.0, 0.0])], "id string, g string, pos long, v array<double>").coalesce(1)
    q = spark.createDataFrame([("q", "a", [1.0, 0.0]), ("bad", "a", [float("nan"), 0.0]), ("none", "a", None)], "query_id string, g string, q array<double>")
    assert [(r.query_id, r.id, r.s) for r in A.searched(q, rows).orderBy("rank").collect()] == [("q", "ok", 1.0), ("q", "z", 0.0)]
