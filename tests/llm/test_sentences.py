import time

import pytest

from narrata.llm import sentences as S

CASES = [
    ("Mr. Vellan saw it. He left.", ["Mr. Vellan saw it.", "He left."]),
    ("L. T. Tamsworth came at 4 a.m. on a cold day. It rained.", ["L. T. Tamsworth came at 4 a.m. on a cold day.", "It rained."]),
    ("See vol. 2, p. 4 of it. The end.", ["See vol. 2, p. 4 of it.", "The end."]),
    ('"Who sold it?" asked the mill. "Stop!" Kröllmann said. Done.', ['"Who sold it?" asked the mill.', '"Stop!" Kröllmann said.', "Done."]),
    ("“Look out!” whispered the man. “All is lost.” Every bell rang.", ["“Look out!” whispered the man.", "“All is lost.”", "Every bell rang."]),
    ("He paused ... and then left. It fell . . . then broke.", ["He paused ... and then left.", "It fell . . . then broke."]),
    ("It cost 3.02 marks. Cheap!", ["It cost 3.02 marks.", "Cheap!"]),
    ("CHAPTER 3\n\nThe sun\nrose. It shone.", ["CHAPTER 3", "The sun\nrose.", "It shone."]),
    ("Across the meadow.Who came? No one.", ["Across the meadow.", "Who came?", "No one."]),
    ("Am 23. Oktober kam er. Prof. Thrane u. a. lasen Bd. 6 im Regen.", ["Am 23. Oktober kam er.", "Prof. Thrane u. a. lasen Bd. 6 im Regen."]),
    ("„Wir haben keine Zeit mehr?“, fragte Wexcombe. Er ging.", ["„Wir haben keine Zeit mehr?“, fragte Wexcombe.", "Er ging."]),
    ("—¿Él también lo sabía? —preguntó Okell. La torre cayó.", ["—¿Él también lo sabía? —preguntó Okell.", "La torre cayó."]),
    ("«\xa0Personne n'est venu\xa0?\xa0» demanda Okell. M. Quenby partit.", ["«\xa0Personne n'est venu\xa0?\xa0» demanda Okell.", "M. Quenby partit."]),
    ("「明日また来ます。」と彼は言った。港まで4.6キロだった。なんという夜だろう！", ["「明日また来ます。」と彼は言った。", "港まで4.6キロだった。", "なんという夜だろう！"]),
    ("“水很冷。”邮差说道。他问：“没有人来？”后来他走了。很久……然后回来。", ["“水很冷。”邮差说道。", "他问：“没有人来？”", "后来他走了。", "很久……然后回来。"]),
    ("गाँव 6.4 किमी दूर था। वह ... फिर गया।", ["गाँव 6.4 किमी दूर था।", "वह ... फिर गया।"]),
    ("บ้านอยู่ห่าง6.2กิโลเมตร กัปตันซ่อมสมุด", ["บ้านอยู่ห่าง6.2กิโลเมตร", "กัปตันซ่อมสมุด"]),
    ("", []), (" \n　\n ", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_cases(text, want):
    assert [text[s:e] for s, e in S.split_sentences(text, S.Boundaries())] == want


def test_held_out_accuracy(spark):
    """The classifier is right about reliable boundaries of texts it was not fitted on."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/chapters.parquet").where("text IS NOT NULL").select("text").distinct().orderBy("text").collect()]
    m = S.Boundaries.trained(texts[::2])
    held = [x for t in texts[1::2] for x in m.reliable(t)]
    right = sum((m._sum(f) > 0) == y for f, y in held)
    assert len(held) > 500 and right / len(held) > 0.98


def test_the_classifier_decides():
    """Without its weights another result comes out, for every script."""
    m, none = S.Boundaries(), S.Boundaries(S.np.zeros(S._DIMENSIONS))
    for text, want in CASES[:-2]:
        if len(want) > 1:
            assert S.split_sentences(text, m) != S.split_sentences(text, none)


def test_evidence_of_the_corpus(spark):
    """A title that no list knows is told from how the corpus uses it."""
    word = lambda i: "".join(chr(97 + (i * k) % 26) for k in (3, 5, 7, 11, 2))
    texts = [f"They met Xqv. {word(i).title()} at the gate. All saw the {word(i + 1)}.\n\nHe shut the gate.\n\nThey left the {word(i)}. It was late {word(i + 2)}." for i in range(300)]
    found = S.evidence(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert found["xqv"] == 7
    m = S.Boundaries.trained(texts[:100], found)
    assert [texts[7][s:e] for s, e in S.split_sentences(texts[7], m)][0] == texts[7][: texts[7].index(" All")]
    assert S.evidence(spark.createDataFrame([], "text string")) == {}


@pytest.mark.parametrize("part", ["he said e.g. that ", "a.", '"', "(“. ", "。「", "ก ", "“Hi?” Ann Bo ", "x"])
def test_one_long_line_takes_linear_time(part):
    m, took = S.Boundaries(), []
    for n in (50_000, 400_000):
        t = time.perf_counter()
        S.split_sentences(part * (n // len(part)), m)
        took.append(time.perf_counter() - t)
    assert took[1] < 24 * took[0] + 0.5


def test_odd_rows(spark):
    rows = [(1, "A bee. C dee."), (1, "A bee. C dee."), (2, None), (3, ""), (4, " \n "), (None, "A."), (5, "word " * 100_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "chapter_id long, text string, sentence string")
    got = sorted((r.chapter_id, r.start_pos, r.end_pos) for r in S.sentences(df, id_col="chapter_id").collect())
    assert got == [(1, 0, 6), (1, 7, 13), (5, 0, 499_999)]
    assert S.sentences(df.where("false"), id_col="chapter_id").count() == 0
