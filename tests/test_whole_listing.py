"""Listings hold every book."""

import pytest

import __spark_entry__ as entry
from narrata.operators import library as B

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("by", ["recent", "title", "author", "progress"])
def test_every_book_has_its_place(spark, by):
    n = spark.read.parquet(f"{SF}/books.parquet").select("id").distinct().count()
    rows = entry.queries()[f"library_all_by_{by}"](spark, SF).collect()
    top = entry.queries()[f"library_by_{by}"](spark, SF).collect()
    assert n > 12 and sorted(r.place for r in rows) == list(range(1, n + 1))
    assert {(r.place, r.id) for r in top} == {(r.place, r.id) for r in rows if r.place <= 12}


def test_places_over_partitions(spark):
    rows = spark.range(0, 5000, 1, 7).selectExpr("(id * 7919) % 5000 AS id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert sorted((r.place, r.id) for r in B.placed(rows, ["id"]).collect()) == [(i + 1, i) for i in range(5000)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert B.placed(rows.where("false"), ["id"]).count() == 0
