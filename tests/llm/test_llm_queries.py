"""The registered queries run on the smallest tables and give the stated columns."""

import pytest

from narrata.llm import queries as L

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["item_kind", "item_id"], "p2_found": ["record_kind", "record_id", "defect"], "p3_found": ["id_a", "id_b"], "p4_found": ["item_kind", "id_a", "id_b"],
    "p5_found": ["chapter_id", "start_pos", "end_pos"], "p6_found": ["doc_id", "item_id"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(L.QUERIES))
def test_runs(spark, name):
    df = L.QUERIES[name](spark, SF)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = df.collect()
    assert len(rows) > 0
    if name in COLUMNS:
        assert len(rows) == len(set(rows)) and all(v is not None for r in rows for v in r)
