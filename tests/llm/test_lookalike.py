import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from narrata.llm import lookalike as L

T = L.tables()


@pytest.mark.parametrize(
    ("a", "b"),
    [("Ｔｈｅ ｆｏｘ ７", "The fox 7"), ("café", "café"), ("thе оld", "the old"), ("Τhat", "That"), ("a b c", "a b c"), ("sol​dier﻿", "soldier"), ("ﬁsh", "fish"), ("ạ̇", "ạ̇"), ("한", "한"), ("x\r\ny", "x\ny"), ("mµ", "mμ")],
)
def test_same_form(a, b):
    assert L.canonical([a], T) == L.canonical([b], T)


@pytest.mark.parametrize(("a", "b"), [("The", "the"), ("resume", "résumé"), ("a!", "a."), ("a！", "a!"), ("a\nb", "a b"), ("“a”", '"a"'), ("क्‍ष", "क्ष")])
def test_visible_differences_stay(a, b):
    assert L.canonical([a], T) != L.canonical([b], T)


@given(st.lists(st.text(alphabet=st.characters(min_codepoint=0x20, max_codepoint=0x24F) | st.characters(min_codepoint=0x300, max_codepoint=0x330) | st.characters(min_codepoint=0xAC00, max_codepoint=0xAC80) | st.characters(min_codepoint=0x900, max_codepoint=0x97F), max_size=20), max_size=6))
@settings(max_examples=300, deadline=None)
def test_agrees_with_normalisation_form_c(texts):
    texts = ["".join(c for c in t if not T["gone"][ord(c)] and not T["look"][ord(c)] and unicodedata.category(c) != "Zs" and not unicodedata.decomposition(c).startswith("<") and c != "\xb5") for t in texts]
    plain = lambda s: "".join(chr(T["look"][ord(c)] or ord(c)) for c in unicodedata.normalize("NFD", s))
    assert L.canonical(texts, T) == [unicodedata.normalize("NFC", plain(t)) for t in texts]


def test_pairs_and_odd_rows(spark):
    rows = [("p", "1", "The old fox"), ("p", "2", "Thе оld fox"), ("p", "3", "The old fox"), ("q", "4", "Thе оld fox"), ("p", "5", None), ("p", "6", ""), ("p", "7", "..."), ("p", "8", "..​."), ("p", "2", "Thе оld fox"), ("p", None, "Thе оld fоx"), ("p", "9", "The old fоx"), ("p", "10", "x" * 300_000)]
    df = spark.createDataFrame([(*r, "y") for r in rows], "item_kind string, item_id string, text string, form string")
    got = {(r.item_kind, r.id_a, r.id_b) for r in L.same_looking(df).collect()}
    assert got == {("p", "1", "2"), ("p", "2", "3"), ("p", "1", "9"), ("p", "2", "9"), ("p", "3", "9")}
    assert L.same_looking(df.where("false")).count() == 0
    out = L.normalized(df, "text", "form")
    assert [r.form for r in out.where("item_id IN ('5', '6', '9') ").orderBy("item_id").collect()] == [None, "", "The old fox"]


@pytest.mark.parametrize(("a", "b"), [("𝐓𝒉𝓮 ℋat", "The Hat"), ("ᎪᏴ", "AB"), ("ᴏᴠᴇʀ", "ovER"), ("ԍ ҽ", "G e"), ("a\u2011b", "a-b"), ("a\U000e0101b", "ab"), ("ꓡꓳ", "LO")])
def test_all_planes(a, b):
    assert L.canonical([a], T) == L.canonical([b], T)


@pytest.mark.parametrize(("a", "b"), [("Ⓐ", "A"), ("㈱", "(株)"), ("！", "!")])
def test_loose_forms_are_an_option(a, b):
    loose = L.tables(True)
    assert L.canonical([a], loose) == L.canonical([b], loose) and L.canonical([a], T) != L.canonical([b], T)


def test_every_code_point_settles():
    """The form of a form is itself, for every assigned code point; canonical equivalents have one form."""
    every = [c for c in map(chr, [*range(0x20, 0xD800), *range(0xE000, 0x110000)]) if unicodedata.category(c) not in ("Cn", "Co")]
    once = L.canonical(every, T)
    assert L.canonical(once, T) == once
    assert L.canonical([unicodedata.normalize("NFD", c) for c in every], T) == once
    assert L.canonical([unicodedata.normalize("NFC", c) for c in every], T) == once


def test_a_large_class_gives_a_row_an_item(spark):
    df = spark.range(3000).select(F.lit("p").alias("item_kind"), F.col("id").cast("string").alias("item_id"), F.concat(F.lit("fox"), F.repeat(F.lit("\u200b"), F.col("id").cast("int"))).alias("text"))
    got = L.classes(df)
    assert got.count() == 3000 and {(r.class_id, r.variants) for r in got.collect()} == {("0", 3000)}
