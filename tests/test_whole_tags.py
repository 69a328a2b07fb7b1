"""Tags are looked for in the whole text."""

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_whole_text_is_extracted(spark):
    rows = spark.read.parquet(f"{SF}/chapters.parquet").where("text IS NOT NULL").dropDuplicates(["chapter_id"]).select("chapter_id", "text").collect()
    got = {r.chapter_id: r.out for r in entry.queries()["tagged_whole_outputs"](spark, SF).collect()}
    plain = {r.chapter_id: r.text.strip() for r in rows if "<" not in r.text}
    assert max(map(len, plain.values())) > 200 and {k: got[k].strip() for k in plain} == plain
