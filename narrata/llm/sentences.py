"""Problem 5: sentence boundaries across languages and scripts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import sliced
from narrata.llm.lookalike import INVISIBLE, LOOKALIKES
from narrata.session import written

# Abbreviations that stand before what they belong to; examples of the class, no rule.
LEANING = frozenset(
    "mr mrs ms dr prof rev capt st col gen lt sgt hon fr sr sra dra srta don mme mlle mgr sig sigg dott dott.ssa ing avv herr hr no nr nos vol vols bd bde pp p pag pág págs cap ch chap ca cf vs approx abb fig art sec tab "
    "i.e e.g z b d h u p.ex ex vgl s inkl bzw ggf tel т г им ул р стр гл св d.h z.b u.a о".split()
)
# Abbreviations that may also end a sentence; examples of the class, no rule.
LOOSE = frozenset("etc usw ecc al co bros inc ltd jr sen a.m p.m u.s u.k д п др".split())
_MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jahrhundert".split()
# Verbs of speaking, as they follow a quotation and its speaker.
_SAY = "said|asked|cried|shouted|whispered|replied|answered|called|muttered|exclaimed|added|dit|demanda|répondit|cria|murmura|dijo|preguntó|respondió|gritó|sagte|fragte|rief|antwortete|disse|chiese|rispose|perguntou|respondeu|сказал|сказала|спросил|спросила"
_SPEAKER = re.compile(rf"(?:[A-ZÀ-ÞА-Я][\w'’-]*\.?\s+){{1,4}}(?:{_SAY})\b")
_ZH_SAY = re.compile(r"[^。！？.!?…\n]*(?:说|道|问|喊|叫|答|喃)")
_BLANK = re.compile(r"(?:\r\n|\n|\r)(?:[^\S\r\n]*(?:\r\n|\n|\r))+")
_MARKS = ".!?…。！？।॥．｡"
_QUOTES = "\"“«„「『（([”»」』）)]"
_EVENT = re.compile(rf"[{_MARKS}{re.escape(_QUOTES)}]")
_EVENT_OR_SPACE = re.compile(rf"[{_MARKS}{re.escape(_QUOTES)}]|[^\S\r\n]+")
#: A run of marks, what closes after it, the gap, and the word that follows.
_PLACE = re.compile(rf"((?:\.(?:[ \xa0]\.)+|[{_MARKS}])[{_MARKS}]*+)((?:[\"”’»“'」』）)\]*_]|[\s\xa0 ]++»)*+)(\s*+)(\w*+)")
_SPACE = re.compile(r"()()(\s*+)(\w*+)")
_GAP = re.compile(r"\s*+")
_SEEN_NOT = "".join(f"{chr(a)}-{chr(b)}" for a, b in INVISIBLE)
#: The word that ends at a place, read backwards.
_BEFORE = regex.compile(rf"(?r)[\w\p{{M}}’'\-{_SEEN_NOT}]*+")
_LETTER_BEFORE = regex.compile(r"(?r)[^\W\d_]")
_THAI = re.compile("[฀-๿]")
#: Full-width letters, digits and marks, one for one, so that positions hold.
_NARROW = {c: c - 0xFEE0 for c in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]}
_WIDE = re.compile("[０-ｚ]")
_UNSEEN = {c: None for a, b in INVISIBLE for c in range(a, b + 1)}
_ALIKE = {ord(a): b for row in LOOKALIKES.values() for a, b in row.split()} | _UNSEEN
_DIMENSIONS = 1 << 15
#: A word has evidence if one in so many full stops (or more) stands after it; there can be no more such words.
ONE_IN = 1 << 17

# Labelled examples; a bar stands where a sentence ends.
EXAMPLES = (
    "Mr. Quill saw it.| He left.", "Mrs. Hane and Dr. Pell went to St. Marn.| Nobody knew.", "L. T. Orme came at 4 a.m. on a cold day.| It rained.", "They woke at 5 p.m. in June.| J. Brand slept.", "See vol. 2, p. 4 of it.| The end.",
    "See fig. 3 and ch. 12, pp. 40.| No. 7 was gone.", "It rose by approx. 12 feet.| Prof. Tarn knew, i.e. he guessed.| We all did, e.g. the cook.", "She sold pins, nails etc. and went home.| They had rope etc.| The rest was lost.",
    "He worked for Dunn Bros. in Leith.| It belonged to Hart Co.| Nobody minded.", "He left at 9 a.m.| The bell rang.", '"Who sold it?" asked the mill.| "Stop!" Tolland said.| Done.', '"I will go." He stood up.|', '"I will go."| Then he stood up.| "Why?"| Nobody knew.', '"It is late. We must go," he said.| "Come. Now!" cried Ann.|',
    "“Look out!” whispered the man.| “All is lost.”| Every bell rang.", "“It was I.” Mr. Tolland said so.| She wept.", "“Never!” Aunt Ann replied.| She shut the door.", "He paused ... and then left.| It fell . . . then broke.| He waited…| Then he slept.", "Wait... what was that?| Nothing… or so it seemed.",
    "It cost 3.02 marks.| Cheap!| He paid 4.5 in all, at 6.30 sharp.", "CHAPTER 3|| The sun\nrose.| It shone\nall day.", "Across the meadow.|Who came?| No one.| Beyond the old bridge.|The river rose.| Near the tower?|Nobody.", "He stood (it was cold. Very cold.) by the door.| (He had come late.)| She knew.", "It was 1912.| The war was near.| In 1844.| Then came 1850.",
    "It was he — the thief!| — and so he ran.", "The inn (see p. 9) stood there.| Why not?!| Yes!| No?| Go!| On we went.", "The last of 14.| Nine came.| Was it so?| It was.| It was so!| And yet.", "*The end.*| _Not yet._| More came.", "He was called Sam Jr. by all.| Smith Inc. was sold.| It was in the U.S. then.", "Is it here? he asked.| Fire! they cried.| Oh! how he wept.",
    *(f"Am {n + 3}. {m} kam er.| Dann ging er." for n, m in enumerate(_MONTHS)), "Prof. Thal u. a. lasen Bd. 6 im Regen.| Das war z. B. neu, d. h. gut.| Er kam bzw. ging.| Nr. 4 blieb usw.| Dann kam Hr. Lenz.", "Es war 1912.| Der Krieg kam.| Er zählte 14.| Neun kamen.", "„Wir haben keine Zeit mehr?“, fragte Brand.| Er ging.| „Komm! Schnell!“, rief sie.| „Gut.“| Sie schwieg.", "„Nein.“ Frau Brand sagte es leise.|",
    "—¿Él también lo sabía? —preguntó Olmo.| La torre cayó.| —Mañana vuelvo —dijo Sol—, pero nadie oyó.| Llovía.| —Ya es tarde —dijo él.| Fin.", "El Sr. Olmo y la Dra. Paz leyeron la pág. 4.| ¿Quién era?| ¡Nadie!| «No hay nadie.»| Se fue.", "Llegó el 3.5 por la tarde.| Ud. lo vio, p. ej. ayer.|", "«\xa0Personne n'est venu\xa0?\xa0» demanda Olin.| M. Quern partit.| «\xa0Viens.\xa0»| Il sortit.", "Mme Rive et Mlle Or virent M. L. Brun.| Quoi\xa0!| Rien, etc.| La nuit tomba.| On vit cf. p. 12 du livre.",
    "Il Sig. Rossi e la Dott.ssa Neri lessero a pag. 9.| «È tardi.»| Se ne andò ecc. e tornò.| Poi dormì.", "O Sr. Lima e a Dra. Reis leram o vol. 2, cap. 4.| Ninguém veio.| — Quem é? — perguntou Ana.| Era tarde.| «Não.»| Foi.", "В г. Орле жил им. Г. Р. Лунин и др. люди.| Он ушёл в 5 ч. утра.| Был 1912 г. и шёл снег.| «Кто там?» — спросил он.| «Иди. Скорей!» — крикнула она.| — Нет, — сказал он.| Всё.| — Идём! — крикнул дед.| Тихо.| И т. д. и т. п. было там.| Он знал, т. е. думал.| Это был 1850 г.| Наступила зима.",
    "「明日また来ます。」と彼は言った。|港まで4.6キロだった。|なんという夜だろう！|誰だ？|彼は黙った。|「行こう。」|彼は立った。|「早く！」という声がした。|『海だ。』って叫んだ。|「そうだ。」などと言う。|「船。」の話。|「雨。」を見た。|「風。」は強い。|「星。」が出た。|「嘘だ。待て！」と言った。|", "彼は待った……そして去った。|若い船長は……雨の中で絵を売った。|祖母は……木の下で傘を直した。|3.5メートルの波。|「誰もいない？」と少女はたずねた。|「水が冷たい？」と老人は聞いた。|「急げ！」と叫んだ。|「もう遅い……」と母は言った。|（静かだった。）|朝が来た。|",
    "“水很冷。”邮差说道。|他问：“没有人来？”|后来他走了。|很久……然后回来。|“走吧！”她喊。|“好。”|天黑了。|“来。快来！”老人叫道。|“水很冷。”沉默的邮差说道。|“时间不多了。”年老的旅人说道。|“没有人来。”年轻的船长喊道。|渔夫问：“水很深？”|忽然，雨停了。|母亲问：“谁来了？”|聪明的老人笑了。|孩子说：“看！”|年轻的船长走了。|商人答：“不。”|大门开了。|他喊：“停下！”|沉默的教师坐下。|「晚了。」他答。|（无人。）|路长3.5公里。|他笑了。|为什么？|不知道！|老人……然后走了。|他的船……在雨中沉了。|",
    "गाँव 6.4 किमी दूर था।| वह ... फिर गया।| कौन था?| कोई नहीं!| “चलो।” उसने कहा।| डॉ. राव आए।| रात हुई।| श्री. वर्मा बोले।| “नहीं।”| वह चुप रहा।|", "बारिश हुई॥| सब भीगे।| पृ. 4 देखो।| फिर... वह सोया।|", "บ้านอยู่ห่าง6.2กิโลเมตร| กัปตันซ่อมสมุด| ฝนตก| เขาถามว่าใคร?| ไม่มีใคร!| ทะเลสงบ| นกบิน| เด็กวิ่งไปที่ท่าเรือ| แม่น้ำลึก3.5เมตร| คืนนั้น...เขารอ| เช้าแล้ว|",
    *(f"{w} {p}. {n}.| {b} {x}." for n, (p, w, b) in enumerate((("p", "It is on", "The end"), ("vol", "See", "He read"), ("pag", "È a", "Il libro"), ("pag", "Si legge a", "La casa"), ("pág", "Está en la", "El libro"), ("pág", "Está na", "A menina"), ("vol", "Lê-se no", "A casa"), ("vol", "It is in", "A man"), ("S", "Es steht auf", "Der Tag"), ("Bd", "Es steht in", "Die Nacht"), ("стр", "Это на", "Он ушёл"), ("cap", "Está no", "O mar"), ("p", "C'est à la", "Le soir"), ("no", "It was", "Every door"), ("ch", "She read", "No one")), 7) for x in ("fell", "1")),
    *(f"{a[0].upper()}{a[1:]}. Quill came.| We met {a}. Orme there." for a in sorted(LEANING) if a.isascii() and len(a) > 1), *(f"It was {a}. Then it ended.| He had it {a}. in spring." for a in sorted(LEANING & frozenset("vgl inkl bzw ggf ca cf vs ex".split()))),
)


def _script(c: str) -> str:
    o = ord(c)
    return "deva" if 0x900 <= o < 0x980 else "thai" if 0xE00 <= o < 0xE80 else "cjk" if 0x3000 <= o < 0xA000 or 0xFF00 <= o < 0xFFF0 else "cyrl" if 0x400 <= o < 0x530 else "latn" if c.isalpha() else "none"


def _known(token: str) -> str:
    """A token as evidence and features know it: lower case, without what is unseen, look-alikes made plain."""
    return token.lower() if token.isascii() else (low if (low := token.lower().translate(_UNSEEN)) in LEANING | LOOSE else token.translate(_ALIKE).lower())


class Candidate(NamedTuple):
    """A place where a sentence may end, after its mark and closing quotes, with what surrounds it."""

    end: int
    mark: str
    before: str
    dots: int
    closers: str
    after: str
    first: str
    kind: str
    gap: str
    close: str
    script: str
    inside: bool
    spoken: str
    number: bool


def _pairs(events: list[tuple[int, str]]) -> list[tuple[int, int]]:
    """Outermost pairs of quotes and brackets; what has no partner in the unit pairs with nothing."""
    stack: list[tuple[str, int]] = []
    count = dict.fromkeys("\"“«„「『（([", 0)
    partner = {"”": "“", "»": "«", "」": "「", "』": "『", "）": "（", ")": "(", "]": "["}
    found: list[tuple[int, int]] = []
    for i, ch in events:
        want = ch if ch == '"' and count['"'] else "„" if ch in "“”" and count["„"] else partner.get(ch)
        if want is None or (want == ch and not count[ch]):
            stack.append((ch, i))
            count[ch] += 1
        elif count[want]:
            while True:
                kind, at = stack.pop()
                count[kind] -= 1
                if kind == want:
                    break
            while found and found[-1][0] > at:
                found.pop()
            found.append((at, i))
    return found


def candidates(unit: str) -> list[Candidate]:
    """All candidate boundaries within a unit, in order; linear in its length."""
    thai = bool(_THAI.search(unit))
    marks, quotes = list[int](), list[tuple[int, str]]()
    for m in (_EVENT_OR_SPACE if thai else _EVENT).finditer(unit):
        ch = m[0]
        if ch in _QUOTES:
            quotes.append((m.start(), ch))
        else:
            marks.append(m.start())
    closing = _pairs(quotes)
    starts_low = {a for a, _ in closing if unit[a] == "„"}
    out, upto, k, script, dots, lows, last = list[Candidate](), 0, 0, "none", 0, 0, None
    low_quotes = [i for i, ch in quotes if ch == "„"] if starts_low else []
    for at in marks:
        if at < upto:
            continue
        token = _BEFORE.match(unit, upto, at)[0].strip("’'-")
        m = (_SPACE if unit[at].isspace() else _PLACE).match(unit, at)
        run, closers, gap, after = m.groups()
        end, rest = m.end(2), m.end(3)
        if not run:
            run, end = " ", at
        elif "“" in closers:
            # The mark that closes a low quote opens one elsewhere.
            while lows < len(low_quotes) and low_quotes[lows] < at:
                lows += 1
            if not lows:
                end = m.end(1) + closers.index("“")
                closers, gap, after, rest = unit[m.end(1) : end], "", "", end
        # A stop within a chain like "a.m." or "z.B." belongs to it; after a longer word it stands alone.
        dots = dots + 1 if token and last and last.mark == "." and last.end == at - len(token) and not last.closers and 0 < len(last.before) <= 2 else 0
        number = token.isdigit()
        if token and token[-1].isalpha():
            script = _script(token[-1])
        elif found := _LETTER_BEFORE.search(unit, upto, at):
            script = _script(found[0])
        while k < len(closing) and closing[k][1] < end:
            k += 1
        first = unit[rest : rest + 2]
        if first[:1] in "—–-" and first:
            d = _GAP.match(unit, rest + 1).end()
            first = first[:1] + unit[d : d + 1]
        close, spoken = "", ""
        if closers and not closers.isspace():
            close = _close(closers)
            if _SPEAKER.match(unit, rest):
                spoken = "by"
            elif script == "cjk" and _ZH_SAY.match(unit, rest):
                spoken = "zh"
        last = Candidate(end, run, f"{last.before}.{token}" if dots == 1 else token, dots, closers, after, first, _kind(first), _gap(gap), close, script, k < len(closing) and closing[k][0] < end, spoken, number)
        out.append(last)
        upto = rest if run == " " else end
    return out


def _mark(c: Candidate) -> str:
    return f"{c.mark[0]}{min(len(c.mark), 3)}" if len(c.mark) > 1 else c.mark


def _kind(first: str) -> str:
    a = first[:1]
    if a.isupper():
        return "up"
    if a.islower():
        return "low"
    if not a:
        return "end"
    if a in "—–-":
        return "dashlow" if first[1:].islower() else "dash"
    return "digit" if a.isdigit() else "quote" if a in "\"“«„¿¡「『‘*_([（" else "stop" if a in ",;:，、；：)]）" else _script(a) if a.isalpha() else "other"


def _gap(gap: str) -> str:
    return "none" if not gap else "one" if gap == " " else "line" if "\n" in gap or "\r" in gap else "one" if len(gap) == 1 else "many"


def _close(closers: str) -> str:
    return "q" if set(closers) & set("\"”»“」』") else "b" if set(closers) & set(")]）") else "o"


class Boundaries:
    """Maximum-entropy classifier of candidates; every candidate is its to decide.

    Without corpus it is fitted on the labelled examples alone. ``evidence``
    says of a token how the corpus speaks for it being an abbreviation (see
    :func:`evidence`).
    """

    def __init__(self, weights: np.ndarray | None = None, evidence: dict[str, int] | None = None) -> None:
        self.evidence = evidence or {}
        self.left: dict[tuple, tuple[float, str]] = {}
        self.right: dict[tuple, float] = {}
        self.cross: dict[tuple, float] = {}
        self.weights = (_examples_only() if evidence is None else Boundaries.trained([], evidence).weights) if weights is None else weights

    # Features come in three groups, each a function of a few facts, so that a group's sum is looked up.
    def _left(self, c: Candidate) -> tuple[list[str], str]:
        """The word before: who it is, its length, case and digits, and what the corpus says of it."""
        w, mark = c.before, _mark(c)
        if mark != ".":
            return [f"m{mark}", f"m{mark}len{min(len(w), 3)}"], "digit" if c.number else "word" if w else "none"
        if c.number:
            return ["m.", "shapedigit"], "digit"
        low = _known(w)
        listed = "lean" if low in LEANING else "loose" if low in LOOSE else ""
        shape = "none" if not w else ("One" if w.isupper() else "one") if len(w) == 1 and w.isalpha() else "dotted" if c.dots else "upper" if w.isupper() else "cap" if w[:1].isupper() else "low" if w[:1].islower() else "other"
        said = self.evidence.get(low, 0) if w else 0
        kind = listed or (shape if shape in ("none", "One", "one", "dotted") else "word")
        f = ["m.", f"w={low[:24]}", f"len{min(len(w), 5)}", f"shape{shape}", f"listed{listed}", f"said{said}", f"said{said}len{min(len(w), 4)}", f"said{said}{listed}", f"deep{c.dots > 1}"]
        return f, f"{kind}{'+' if said > 5 else '-' if said in (1, 2) else ''}{'s' if len(w) < 3 else ''}"

    @staticmethod
    def _right(c: Candidate, cls: str) -> list[str]:
        """The word after, by itself and after a number or a closing quote."""
        n = c.after[:2] if c.first[:1] >= "฀" else c.after.lower()[:24]
        near = "digit" if c.number else "quote" if c.close == "q" else ""
        return [f"n={n[:1]}/{c.script}{near}", f"n={n}/{near}"] if n and (near or c.script == "cjk") else [f"n{near}"]

    @staticmethod
    def _cross(c: Candidate, cls: str, began: str) -> list[str]:
        """How the sides go together: mark, script, gap, quotes and case."""
        mark, kind, gap, close = _mark(c), c.kind, c.gap, c.close
        soft = "d" if c.mark.strip("….") == "" and c.mark != "." else "s" if c.mark in ".．" else "h"
        f = ["bias", f"k{kind}", f"k{kind}g{gap}", f"k{kind}s{c.script}", f"{soft}k{kind}g{gap}", f"{mark}s{c.script}", f"{mark}k{kind}s{c.script}", f"{mark}g{gap}s{c.script}k{kind}", f"c{close}k{kind}", f"c{close}{soft}k{kind}s{c.script}", f"{soft}l{cls}", f"{soft}l{cls}k{kind}", f"{soft}l{cls}g{gap}k{kind}"]
        f += [f"in{c.inside}", f"in{c.inside}k{kind}", f"by{c.spoken}{began if c.spoken == 'zh' else ''}", f"by{c.spoken}{began}k{kind}s{c.script}c{close}", f"{soft}c{close}s{c.script}g{gap}"]
        return f

    def features(self, c: Candidate, began: str) -> list[str]:
        left, cls = self._left(c)
        return [*left, *self._right(c, cls), *self._cross(c, cls, began)]

    def _sum(self, f: list[str]) -> float:
        return float(sum(self.weights[i] for i in _ids(f)))

    def score(self, c: Candidate, began: str) -> float:
        """Log odds that the sentence, which began with a quote or not, ends here."""
        key = (c.before, c.mark[:3], c.number, c.dots)
        if (left := self.left.get(key)) is None:
            if len(self.left) > 200_000:
                self.left.clear()
            f, cls = self._left(c)
            left = self.left[key] = self._sum(f), cls
        key = (c.after, c.first[:1], c.script, c.close == "q", c.number)
        if (right := self.right.get(key)) is None:
            if len(self.right) > 200_000:
                self.right.clear()
            right = self.right[key] = self._sum(self._right(c, left[1]))
        key = (c.mark[:3], left[1], c.script, c.kind, c.gap, c.close, c.inside, c.spoken, began)
        if (cross := self.cross.get(key)) is None:
            cross = self.cross[key] = self._sum(self._cross(c, left[1], began))
        return left[0] + right + cross

    def examples(self) -> Iterator[tuple[list[str], bool]]:
        """The labelled examples as rows."""
        for e in EXAMPLES:
            # A bar that follows a bar ends a unit.
            for unit in e.split("||"):
                text, ends = "", set[int]()
                for part in unit.split("|"):
                    text += part
                    ends.add(len(text))
                yield from self._rows(text, lambda c, _, ends=ends: c.end in ends)

    def _rows(self, unit: str, label) -> Iterator[tuple[list[str], bool]]:
        begin = 0
        for c in candidates(unit):
            began = unit[begin:].lstrip()[:1] if begin < len(unit) else ""
            v = label(c, unit)
            if v is not None:
                yield self.features(c, "q" if began in "“「『\"" else ""), v
            if v or (v is None and self._sure(c)):
                begin = c.end

    def _sure(self, c: Candidate) -> bool | None:
        """A label where the place itself leaves no doubt, else None."""
        kind, gap = c.kind, c.gap
        if c.inside or kind == "stop" or c.spoken == "by":
            return False
        if c.script in ("latn", "cyrl"):
            if kind in ("low", "dashlow") or (kind == "digit" and gap == "none"):
                return False
            said = self._left(c)[1]
            if _mark(c) == "." and "+" in said and gap != "none":
                return False
            if gap != "none" and kind == "up" and not c.closers and (c.mark[0] in "?!" or (c.mark == "." and "-" in said and len(c.before) > 3)):
                return True
        elif c.script == "cjk":
            if c.mark[0] == "." and gap == "none" and kind == "digit":
                return False
            if c.mark in "。！？" and not c.closers and kind == "cjk":
                return True
        elif c.script == "deva":
            if c.mark in "।॥" and not c.closers and gap != "none":
                return True
            if c.mark == ".":
                return False
        elif c.script == "thai" and c.mark == " " and kind == "thai":
            return True
        return None

    def reliable(self, text: str) -> Iterator[tuple[list[str], bool]]:
        """Labelled candidates of a text: ends of units as if the next one went on, and places that leave no doubt."""
        units = [u.strip() for u in _BLANK.split(text) if u.strip()]
        for k, u in enumerate(units):
            stop = len(u)
            if k + 1 < len(units):
                joined = f"{u} {units[k + 1]}" if _script((_LETTER_BEFORE.search(u) or " ")[0]) != "cjk" else u + units[k + 1]
            else:
                joined = u
            rows = [c for c in candidates(u)]
            for c in rows:
                if c.end < stop and (v := self._sure(c)) is not None:
                    yield self.features(c, ""), v
            if joined is not u and rows and rows[-1].end == stop and rows[-1].mark != " ":
                for c in candidates(joined[max(0, _begin(u, rows)) : stop + 400]):
                    if c.end == stop - max(0, _begin(u, rows)):
                        yield self.features(c, ""), True

    @classmethod
    def trained(cls, texts: list[str], evidence: dict[str, int] | None = None, rounds: int = 150, decay: float = 2e-5) -> Boundaries:
        """Fitted by gradient ascent on the conditional likelihood (L2 decay).

        Rows are the labelled examples and the reliable candidates of ``texts``;
        either kind carries half of the weight.
        """
        m = cls(np.zeros(_DIMENSIONS), evidence)
        seeds = [(f, y) for f, y in m.examples()]
        rows = [r for t in texts for r in m.reliable(t)]
        m.weights = _fit(seeds, rows, rounds, decay)
        m.left.clear(), m.right.clear(), m.cross.clear()
        return m


def _begin(u: str, rows: list[Candidate]) -> int:
    """Where the last sentence of a unit begins, as its second last candidate tells."""
    return rows[-2].end if len(rows) > 1 else 0


def _ids(features: list[str]) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % _DIMENSIONS for f in features]


def _fit(seeds: list, rows: list, rounds: int, decay: float) -> np.ndarray:
    data = [*seeds, *rows]
    y = np.array([b for _, b in data], float)
    width = max(len(f) for f, _ in data)
    x = np.full((len(data), width), _DIMENSIONS)
    for i, (f, _) in enumerate(data):
        x[i, : len(f)] = _ids(f)
    share = np.concatenate((np.full(len(seeds), (0.5 if rows else 1.0) / len(seeds)), np.full(len(rows), 0.5 / max(1, len(rows)))))
    w, speed = np.zeros(_DIMENSIONS + 1), np.full(_DIMENSIONS + 1, 1e-10)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w[x].sum(1), -30, 30)))
        g = np.bincount(x.ravel(), np.repeat(share * (y - p), width), _DIMENSIONS + 1) - decay * w
        speed += g * g
        w += 0.3 * g / np.sqrt(speed)
        w[_DIMENSIONS] = 0.0
    return w[:_DIMENSIONS]


_FITTED: dict[str, np.ndarray] = {}


def _examples_only() -> np.ndarray:
    if "examples" not in _FITTED:
        _FITTED["examples"] = Boundaries.trained([], {}).weights
    return _FITTED["examples"]


def split_sentences(text: str, model: Boundaries) -> list[tuple[int, int]]:
    """``[(start, end)]`` of the sentences of a text, without outer white space."""
    out, at = [], 0
    bounds = [(m.start(), m.end()) for m in _BLANK.finditer(text)]
    narrow = text.translate(_NARROW) if _WIDE.search(text) else text
    for stop, following in [*bounds, (len(text), len(text))]:
        unit = narrow[at:stop]
        begin = _GAP.match(unit).end()
        cuts = []
        for c in candidates(unit):
            if c.end > begin and (not c.first or model.score(c, "q" if unit[begin] in "“「『\"" else "") > 0.0):
                cuts.append(c.end)
                begin = _GAP.match(unit, c.end).end()
        begin = 0
        for cut in [*cuts, len(unit)]:
            s = unit[begin:cut]
            if t := s.strip():
                a = at + begin + len(s) - len(s.lstrip())
                out.append((a, a + len(t)))
            begin = cut
        at = following
    return out


def evidence(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """What all texts say of the words before a full stop.

    An ordinary word often ends a unit (a blank line or the text's end follows)
    and is seldom followed by lower case or digits; an abbreviation is the
    reverse. The class is the binned log-likelihood ratio of both: 1 surely
    ordinary ... 7 surely an abbreviation. Only words that one in ``ONE_IN`` of
    all full stops follows reach the driver, of which there are at most that many.
    """
    found = docs.select(F.explode(F.regexp_extract_all(text_col, F.lit(r"[\p{L}\p{M}\p{N}]++\.(?=[\s\x{A0}]|$)[\s\x{A0}]*+\S?"), F.lit(0))).alias("x"))
    tail = F.substring_index("x", ".", -1)
    facts = found.select(F.lower(F.substring_index("x", ".", 1)).alias("w"), (~tail.rlike(r"[^\s\x{A0}]") | tail.rlike(r"\n[^\n\S]*\r?\n|\r\r")).cast("int").alias("unit"), tail.rlike(r"[\p{Ll}\p{Nd}]$").cast("int").alias("low"))
    counts = written(facts.groupBy("w").agg(F.count("*").alias("n"), F.sum("unit").alias("unit"), F.sum(F.when(F.col("unit") == 0, F.col("low")).otherwise(0)).alias("low")), "stops")
    n_all, unit_all = counts.agg(F.sum("n"), F.sum("unit")).first()
    if not n_all:
        return {}
    rows = counts.where(F.col("n") * ONE_IN >= n_all).orderBy("w").collect()
    n, unit, low = np.array([tuple(r)[1:] for r in rows], float).T
    usual = min(0.9, max(0.02, unit_all / n_all))
    # Shares of what follows: after an ordinary word, after a title or initial, after an abbreviation within a phrase.
    plain, kinds = (usual, 0.01, 0.99 - usual), ((0.002, 0.01, 0.988), (0.002, 0.3, 0.698))
    ratio = np.max([sum(k * np.log(b / a) for k, a, b in zip((unit, low, n - unit - low), plain, short, strict=True)) for short in kinds], axis=0)
    return {r["w"]: 1 + int(k) for r, k in zip(rows, np.digitize(ratio, [-12.0, -4.0, -1.0, 1.0, 4.0, 12.0]), strict=True)}


def sentences(docs: DataFrame, *, id_col: str, text_col: str = "text", sample_texts: int = 400, sample_chars: int = 20_000, model: Boundaries | None = None) -> DataFrame:
    """``<id_col>, start_pos, end_pos, sentence`` (0-based start, exclusive end).

    Every candidate of every script is decided by the classifier. It is fitted
    on labelled examples and on reliable boundaries of ``sample_texts`` texts
    (their first ``sample_chars`` characters), chosen by a hash of the id; what
    it knows of abbreviations is counted over all texts; every text is then split
    whole, in time linear in its length. Null and blank texts and null ids give
    no rows; copies of a row (same id) are split once; where an id has several
    texts, the least by digest counts; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).where(F.col("__id").isNotNull() & F.col("__t").rlike(r"\S"))
    if model is None:
        picked = rows.orderBy(F.xxhash64(F.col("__id").cast("string")), "__id").limit(sample_texts).select(F.substring("__t", 1, sample_chars).alias("t"))
        model = Boundaries.trained(sorted(r["t"] for r in picked.collect()), evidence(rows, "__t"))
    kind, weights, said = rows.schema["__id"].dataType.simpleString(), model.weights.astype(np.float32), model.evidence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Boundaries(weights, said)
        for b in sliced(batches, 1):
            ids, where, starts, ends, said_ = b.column(0), [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for s, e in split_sentences(t, own):
                    where.append(i)
                    starts.append(s)
                    ends.append(e)
                    said_.append(t[s:e])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(where, pa.int32())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(said_, pa.string())], names=[id_col, "start_pos", "end_pos", "sentence"])

    one = rows.groupBy("__id").agg(F.min_by("__t", F.md5("__t")).alias("__t"))
    return one.mapInArrow(run, f"`{id_col}` {kind}, start_pos bigint, end_pos bigint, sentence string")
