import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from narrata.llm import split


@given(st.text(alphabet="ab .!?\ń。字", max_size=400), st.integers(1, 60), st.integers(0, 30))
@settings(max_examples=300, deadline=None)
def test_pieces_cover_the_text_with_the_overlap(text, most, overlap):
    cuts = split.cut_points(text, most, overlap)
    used = min(overlap, most - 1)
    assert all(e - s <= most for s, e in cuts)
    if len(text) <= most:
        assert cuts == [(0, len(text))]
        return
    assert "".join(text[s + (used if i else 0) : e] for i, (s, e) in enumerate(cuts)) == text
    assert all(b[0] == a[1] - used for a, b in zip(cuts, cuts[1:], strict=False))


def test_cuts_prefer_the_highest_boundary():
    text = "First sentence here. Second one.\n\nNext paragraph is here. And it ends."
    (_, e), *_ = split.cut_points(text, 45, 0)
    assert text[:e].endswith("\n\n")
    words = "alpha beta gamma delta epsilon"
    assert [words[s:e] for s, e in split.cut_points(words, 12, 0)] == ["alpha beta ", "gamma delta ", "epsilon"]
    assert all(75 < e - s <= 90 for s, e in split.cut_points("x" * 500, 90, 30)[:-1])


@pytest.fixture()
def limits(spark):
    return spark.createDataFrame([("passage", "m", 10, 2), ("passage", "n", None, 2), ("chapter", None, 12, None)], "item_kind string, embedding_model string, max_chars int, overlap_chars int")


def test_defined_results_of_odd_rows(spark, limits):
    rows = [("a", "0123456789", "m"), ("b", "0123456789x", "m"), ("b", "0123456789x", "m"), ("c", None, "m"), ("d", "", "m"), (None, "y" * 30, "m"), ("e", "z" * 30, "n"), ("f", "z" * 30, None), ("g", "w" * 50_000, "m")]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "id string, text string, model string, chunk_index string, item_id int")
    got = split.split_oversized(df, limits, item_kind="passage", id_col="id", model_col="model").collect()
    assert {r.item_id for r in got} == {"b", "g"}
    b = sorted((r.chunk_index, r.start_pos, r.end_pos, r.text) for r in got if r.item_id == "b")
    assert [x[0] for x in b] == [0, 1] and all(len(x[3]) <= 10 for x in b)
    assert sorted(r.chunk_index for r in got if r.item_id == "g") == list(range(sum(r.item_id == "g" for r in got)))
    ch = split.split_oversized(df.select("id", "text"), limits, item_kind="chapter", id_col="id").collect()
    assert {r.item_id for r in ch} == {"e", "f", "g"}


def test_empty_tables(spark, limits):
    df = spark.createDataFrame([], "id string, text string, model string")
    assert split.split_oversized(df, limits, item_kind="passage", id_col="id", model_col="model").count() == 0
    one = spark.createDataFrame([("a", "x" * 99, "m")], df.schema)
    assert split.split_oversized(one, limits.where("false"), item_kind="passage", id_col="id", model_col="model").count() == 0
