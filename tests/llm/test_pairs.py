import pytest

from narrata.llm import pairs as P


@pytest.mark.parametrize("a", [None, "", " \t　", "​", "...", "—", "**", "N/A", "n/a", "(none)", "<empty>", "[no answer]", "No answer.", "{}", "null", "TODO", "?"])
def test_empty(a):
    assert P.is_empty(a)


@pytest.mark.parametrize("a", ["Yes.", "Twice", "No, never.", "4.1", "Chapter 3", "The dark satchel", "Only once (chapter 18)", "Nothing else happened."])
def test_short_answers_are_whole(a):
    assert not P.is_empty(a)
    assert P.defect("What happened after the storm passed the bridge?", a, None, False, 30, 10) is None


@pytest.mark.parametrize(
    ("a", "yes"),
    [
        ("I'm sorry, but I can't help with that request.", True),
        ("As an assistant, I am unable to answer this question, as I do not have access to the text.", True),
        ("Thanks for asking. Regrettably, this is not something I can assist with at this time. Please try a different question.", True),
        ("Lo siento, pero no me es posible responder a esa pregunta en este momento.", True),
        ("Désolé, je ne peux pas répondre à cette question.", True),
        ("Leider kann ich diese Frage nicht beantworten, weil es gegen meine Richtlinien verstößt.", True),
        ("Mi dispiace, ma non sono in grado di aiutarti su questo.", True),
        ("Извините, но я не вправе помогать с этой просьбой.", True),
        ("申し訳ありませんが、その質問にはお答えできません。", True),
        ("很抱歉，我不能协助处理这个请求。", True),
        ("Sorry for the short wait. The sailor left the harbour.", False),
        ("I am not able to find a single cause, yet two stand out. The storm came first.", False),
        ('The tenant weighed the granary. "I cannot help you with that," said Liesl.', False),
    ],
)
def test_refusal(a, yes):
    assert P.is_refusal(a) == yes


Q = "Who missed the shallow reservoir beyond the tattered harvest?"


@pytest.mark.parametrize(
    ("a", "yes"),
    [
        (Q, True), (Q + "\n" + Q, True), ("You asked: " + Q, True), (Q.upper(), True), (Q[:-1] + "...", True), ("missed the shallow reservoir beyond the tattered harvest? Who", True),
        ("Who missed the shallow reservoir beyond the harvest?", True), ("You asked: " + Q + "\n\nThe sailor missed it.", False), ("Which widow feared the blind carriage against the bitter windmill?", False), ("The sailor missed the shallow reservoir beyond the tattered harvest.", False),
    ],
)
def test_copies(a, yes):
    assert P.copies(Q, a) == yes


def test_other_language():
    de = "Der alte Fischer vergaß das Buch auf dem Dachboden und rief die Weberin."
    assert P.other_language(Q, de)
    assert not P.other_language("(in German, please) " + Q, de)
    assert not P.other_language("Warum vergaß der Fischer das Buch auf dem Dachboden?", de)
    assert not P.other_language(Q, 'The motto reads “Aquella noche, el puente llamó la torre bajo la lluvia.” and it is never explained by the keeper of the house.')
    assert not P.other_language(Q, "Lowenfell")
    assert P.other_language(Q, "静かな羊飼いは黙ったまま銀の鍵を預けた。")


def test_truncation():
    cut = lambda a, **k: P.is_truncated(a, k.get("goes_on", False), False, k.get("seen", 0), k.get("ended", 0))
    assert cut("The sailor left. The keeper found the modest bridge and whi")
    assert not cut("The sailor left. The keeper found the bridge.")
    assert not cut("- the sailor left the harbour\n- the keeper found the modest bridge", seen=20, ended=10)
    assert cut("1. the sailor left the harbour\n2. the keeper found the bridge\n3. The", seen=500, ended=0)
    assert cut("1. the sailor left the harbour\n2. the keeper found the bridge\n3.")
    assert cut("The ballad was named by Mrs.") and not cut("Купили нитки, гвозди, масло и т. д.")


def test_neighbours_show_shortened_texts(spark):
    texts = [f"prefix {i:03d} and its end" for i in range(300)] + [f"prefix {i:03d} and" for i in range(0, 300, 3)] + ["lonely text"]
    df = spark.createDataFrame([(hash(t) % (1 << 60), t) for t in texts], "h long, t string")
    got = {r.h: r.follows for r in P.shortened(df).collect()}
    assert got == {hash(t) % (1 << 60): " its end" for t in texts if t.endswith("and")}


def test_defined_results_of_odd_rows(spark):
    rows = [("m", "1", Q, None), ("m", "2", Q, Q), ("m", "2", Q, Q), ("m", "3", None, "The sailor left. The"), ("m", None, Q, ""), ("m", "4", Q, "The sailor left the bridge. " * 20_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "record_kind string, record_id string, question string, answer string, h string")
    got = {(r.record_id, r.defect) for r in P.defective(df).collect()}
    assert got == {("1", "empty"), ("2", "copies_question"), ("3", "truncated")}
    assert P.defective(df.where("false")).count() == 0


@pytest.fixture(scope="module")
def profiles():
    import itertools

    who, did, what, where = ("The sailor", "The old tailor", "A quiet keeper", "Every baker", "The young nurse"), ("missed", "carried", "watched", "forgot"), ("the shallow harbour", "a letter from the mill", "the bright lantern", "her brother's boat"), ("before the storm", "near the bridge", "while it was raining", "after the harvest")
    return P.Profiles([f"{a} {b} {c} {d} and that was the end of it." for a, b, c, d in itertools.product(who, did, what, where)])


ENGLISH = "Who missed the shallow harbour before the storm and what was the reason?"


@pytest.mark.parametrize(
    "a",
    [
        "De oude kleermaker vergat de brief bij de brug en ging toen naar huis zonder iets te zeggen.",
        "Stary krawiec zapomniał o liście przy moście i wrócił do domu bez słowa wyjaśnienia.",
        "Den gamle skräddaren glömde brevet vid bron och gick hem utan att säga något alls.",
        "늙은 재단사는 다리 근처에서 편지를 잊고 집으로 돌아갔다.",
        "نسي الخياط العجوز الرسالة قرب الجسر ثم عاد إلى بيته.",
        "Ο γέρος ράφτης ξέχασε το γράμμα κοντά στη γέφυρα.",
    ],
)
def test_languages_that_no_list_knows(profiles, a):
    assert P.defect(ENGLISH, a, None, False, 30, 10, profiles) == "other_language"


@pytest.mark.parametrize("a", ["The old tailor missed the harbour near the bridge before the storm.", "Kröllmann Astbury-Hale.", "The keeper forgot the lantern; Núñovar carried the boat while it was raining."])
def test_answers_in_the_language_stay(profiles, a):
    assert P.defect(ENGLISH, a, None, False, 30, 10, profiles) is None


ITEMS = [f"Die {a} {b} {c} in der Nacht, und das war das Ende von {i}." for i, (a, b, c) in enumerate([("Weberin", "vergaß den", "kleinen Kahn"), ("Nachbarin", "fand das", "alte Buch"), ("Schneiderin", "rief den", "müden Fischer"), ("Bäuerin", "sah die", "ferne Mühle")] * 5)]


def test_every_text_counts_in_the_models(spark):
    # Few texts of a language among many others: no sample of the rows would show it often enough.
    rows = [("m", str(i), f"Who missed the shallow harbour before storm {i} and what was the reason?", f"The sailor missed it at the bridge, and the keeper of mill {i} knew.") for i in range(12_000)]
    rows += [("g", str(i), f"Warum hat die Frau den Kahn {i} in der Nacht nicht auf dem Fluss gesehen?", t) for i, t in enumerate(ITEMS[:9])]
    rows += [("x", "1", "Warum hat die Frau den Kahn in der Nacht nicht auf dem Fluss gesehen?", "Den gamle skräddaren glömde brevet vid bron och gick hem utan att säga något alls.")]
    df = spark.createDataFrame(rows, "record_kind string, record_id string, question string, answer string").repartition(4)
    assert [tuple(r) for r in P.defective(df).where("record_kind <> 'm'").collect()] == [("x", "1", "other_language")]


def test_models_of_a_table_are_those_of_a_list(spark):
    texts = sorted({*ITEMS, "The end. " * 4000, *(f"The sailor of {w} missed the harbour and the bridge before the storm." for w in map(str, range(40)))})
    df = spark.createDataFrame([(P.language(t), t, True) for t in texts], "l string, t string, long boolean").repartition(3)
    one, all_ = P.Profiles(texts), P.Profiles.fitted(df)
    assert sorted(one.n) == ["de", "en"] and all((one.n[l] == all_.n[l]).all() for l in one.n)
    assert (one.mean, one.spread, one.total) == (all_.mean, all_.spread, all_.total)
    assert P.Profiles.fitted(df.where("false")).mean == {}


def test_a_text_is_not_judged_by_its_own_counts():
    dutch = "De was van die man was in de kast en de kat was op het dak in de zon."
    assert P.language(dutch) == "en"
    texts = [f"The sailor of {w} missed the harbour and the bridge before the storm, and that was the end of it." for w in ("Ely", "Rye", "Looe", "Wick")] + [f"The {a} was in the {b} when the {c} came by." for a in ("tailor", "nurse", "baker") for b in ("mill", "barn", "yard") for c in ("storm", "sailor", "boat")]
    without, with_it = P.Profiles(texts), P.Profiles([*texts, dutch])
    x = P.Profiles._grams(dutch)
    assert (without._bits(x, "en", own=False) == with_it._bits(x, "en", own=True)).all()
