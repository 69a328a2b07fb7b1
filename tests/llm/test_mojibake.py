import random

import pytest

from narrata.llm import mojibake as M

FR = "La forêt immense répara le théâtre entre les chênes et oublia la clé près de la rivière. "
DE = "Der müde Gärtner überquerte die schöne Brücke während der Ernte und grüßte die Mühle. "
RU = "Старый лесник ждал и искал дверь перед рассветом, а потом починил фонарь у реки. "


@pytest.fixture(scope="module")
def judge():
    return M.Judge({"fr": "\0".join([FR * 3] * 9), "de": "\0".join([DE * 3] * 9), "ru": "\0".join([RU * 3] * 9)})


def broken(text, *codecs):
    for c in codecs:
        raw = text.encode("utf-8")
        text = "".join(bytes([b]).decode(c, "ignore") or chr(b) for b in raw)
    return text


@pytest.mark.parametrize("codecs", [("cp1252",), ("latin-1",), ("cp437",), ("mac-roman",), ("cp1250",), ("cp1251",), ("cp1252", "cp1252")])
@pytest.mark.parametrize(("text", "lang"), [(FR, "fr"), (DE, "de"), (RU, "ru")])
def test_round_trip(judge, text, lang, codecs):
    hit, chain, got = judge.restore(broken(text, *codecs), lang)
    assert hit and chain and got == text


def test_single_byte_misreading(judge):
    assert judge.restore(FR.encode("cp1252").decode("cp437"), "fr")[2] == FR
    assert judge.restore(RU.encode("koi8-r").decode("cp1251"), "ru")[2] == RU


@pytest.mark.parametrize(("text", "lang"), [(FR, "fr"), (DE, "de"), (RU, "ru"), ("L'ÂGE D'OR — «Très bien», dit-il. " + FR, "fr"), ("plain", "fr"), ("", "fr"), (FR, None), ("НЁМ… «Да», — сказал он. " + RU, "ru")])
def test_sound_text_stays(judge, text, lang):
    assert judge.restore(text, lang) == (False, None, text)


def test_partly_broken_and_lost(judge):
    hit, _, got = judge.restore(FR + "\n" + broken(FR, "cp1252"), "fr")
    assert hit and got == FR + "\n" + FR
    assert judge.restore("La for�t immense", "fr")[0]


def test_odd_rows(spark):
    rows = [(1, FR * 4, "fr"), (2, broken(FR, "cp1252"), "fr"), (3, None, "fr"), (4, "", None), (5, "ascii", "und"), (2, broken(FR, "cp1252"), "fr"), (6, broken(FR, "cp1252"), None), (7, FR * 3000, "fr")]
    rows += [(100 + i, FR * 3 + str(i), "fr") for i in range(30)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, damaged string")
    out = M.restored(df)
    assert sorted(r.doc_id for r in out.where("damaged").collect()) == [2, 2, 6]
    assert out.count() == len(rows) - 1
    assert {r.text_restored for r in out.where("damaged").collect()} == {FR}
    assert M.restored(df.where("false")).count() == 0


@pytest.mark.parametrize("codec", ["cp1252", "cp437", "cp850", "mac-roman", "cp1250"])
def test_one_letter_in_a_long_line(judge, codec):
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefghijklmnoprstuvz", k=rnd.randint(2, 9))) for _ in range(900)]
    text = " ".join([*words[:450], "Il vit la forêt immense.", *words[450:]])
    assert len(text) > 2000
    assert judge.restore(text.replace("ê", broken("ê", codec)), "fr")[::2] == (True, text)


@pytest.mark.parametrize("codec", ["cp1252", "cp437", "cp850", "mac-roman"])
@pytest.mark.parametrize("letter", "éèçàüñ")
def test_one_letter_is_flagged_where_nothing_undoes_it(codec, letter):
    assert M._SIGNS.search("caf" + broken(letter, codec) + " words")


@pytest.mark.parametrize("text", ["L'ÂGE D'OR", "«CAFÉ»", "√2 + √π ≈ 3", "NÃO, MANHÃ… AMANHÔ", "a ÷ b", "¬ p"])
def test_no_sign_in_sound_text(text):
    assert not M._SIGNS.search(text)


PREFACE = "Le pont dort sous la pluie et le meunier regarde la lune qui monte. " * 19


def test_models_count_whole_texts(spark):
    # Letters beyond ASCII come late in every text, where a sample of beginnings does not look.
    docs = [(i, PREFACE + f"\nNote {i}. " + FR, "fr") for i in range(40)] + [(99, broken(FR, "cp437"), "fr")]
    out = M.restored(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert [(r.doc_id, r.text_restored) for r in out.where("damaged").collect()] == [(99, FR)]


def test_models_count_every_text_once(spark):
    docs = [(i, f"Le soir {i} au théâtre, " + "une cloche sonne. " * (i % 7), "fr") for i in range(300)] + [(300, "Un œuf rare.", "fr"), (301, "Un œuf rare et cher.", "fr"), (302, "Lu seul: çà.", "fr")]
    docs += [(400 + i, f"Text {i}", f"x{i}") for i in range(300)] + [(900, broken(FR, "cp1252"), "fr"), (901, None, "fr"), (902, "", "fr"), (903, FR, None), (904, FR, "und")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = M.language_models(df.repartition(5))
    clean = [t for _, t, l in docs[:303]]
    assert len(got) == 301 and got == M.language_models(df.union(df).repartition(3))
    assert got["fr"].pieces == sum(map(len, clean)) / M.PIECE
    assert got["fr"].chars == {c: (n, sum(t.count(c) for t in clean)) for c in "éâœçà" if (n := sum(c in t for t in clean))}
    # A word that one text alone has is not in the dictionary.
    assert {"œuf", "théâtre,", "au théâtre,"} <= {*got["fr"].words.split(" "), *(x for x in ("au théâtre,",) if x in got["fr"].words)} and "seul" not in got["fr"].words
    assert M.language_models(df.where("false")) == {}
