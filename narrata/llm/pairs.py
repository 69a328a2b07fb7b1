"""Problem 2: broken prompt and response pairs."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata.llm.common import sliced
from narrata.session import written

# Texts that stand in for a missing answer, without punctuation and in lower case.
STAND_INS = frozenset(
    "n/a|na|none|null|nil|nan|todo|tbd|empty|no answer|no response|no content|no reply|no text|blank|undefined|unknown|missing|placeholder|not available|not applicable|"
    "not provided|nothing|void|error|ohne antwort|keine antwort|sin respuesta|sans réponse|pas de réponse|aucune réponse|nessuna risposta|sem resposta|нет ответа|なし|回答なし|无|無|暂无|无回答|कोई उत्तर नहीं|ไม่มีคำตอบ".split("|")
)
# Frequent words that tell languages written in Latin letters apart.
FUNCTION_WORDS = {
    "en": "the of and to in that is was for with his her this which by from not but had were when before who what how why while into beyond every across near beneath behind according",
    "fr": "le la les des du et un une dans pour que qui sur avec ne pas est au aux sans plus son sa ses cette après avant à près derrière où l d puis entre pendant quand fois",
    "de": "der die das und den dem des ein eine mit von zu auf im am ist nicht ich sie er es dann für vor nach über zwischen hinter während ohne am bei aus als war wurde weshalb warum",
    "es": "el los las y en un una que por con para del al se no su más antes después bajo sobre junto detrás entre sin la luego durante cuando quién qué pero también",
    "it": "il lo gli e di un una che per con del della al alla nel nella non si è più prima dopo sotto sulla vicino dietro fra senza poi durante quando dell dall la le con molta",
    "pt": "o os as e em um uma que por com para do da ao à no na nos nas não se mais antes depois debaixo sobre perto atrás entre sem então durante quando pela pelo muita quem",
}
_WORDS_OF = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_LANGUAGES_OF = {w: tuple(k for k, v in _WORDS_OF.items() if w in v) for w in frozenset().union(*_WORDS_OF.values())}
# Language names, as a prompt may ask for them.
LANGUAGE_NAMES = {
    "en": "english|anglais|englisch|inglés|inglese|inglês|английском|英語|英语|अंग्रेज़ी|อังกฤษ", "fr": "french|français|französisch|francés|francese|francês|французском|フランス語|法语|फ़्रेंच|ฝรั่งเศส",
    "de": "german|allemand|deutsch|alemán|tedesco|alemão|немецком|ドイツ語|德语|जर्मन|เยอรมัน", "es": "spanish|espagnol|spanisch|español|castellano|spagnolo|espanhol|испанском|スペイン語|西班牙语|स्पेनिश|สเปน",
    "it": "italian|italien|italienisch|italiano|итальянском|イタリア語|意大利语|इतालवी|อิตาลี", "pt": "portuguese|portugais|portugiesisch|portugués|portoghese|português|португальском|ポルトガル語|葡萄牙语|पुर्तगाली|โปรตุเกส",
    "ru": "russian|russe|russisch|ruso|russo|русском|ロシア語|俄语|रूसी|รัสเซีย", "ja": "japanese|japonais|japanisch|japonés|giapponese|japonês|японском|日本語|日语|जापानी|ญี่ปุ่น",
    "zh": "chinese|chinois|chinesisch|chino|cinese|chinês|китайском|中国語|中文|चीनी|จีน", "hi": "hindi|хинди|ヒンディー語|印地语|हिन्दी|हिंदी|ฮินดี", "th": "thai|thaï|thailändisch|tailandés|тайском|タイ語|泰语|थाई|ไทย",
}
_ASKS = {k: re.compile(rf"\b(?:in|into|en|auf|em|на|an)\s+(?:{v})\b|(?:{v})(?:で|に|回答|में)|用(?:{v})|ภาษา(?:{v})", re.I) for k, v in LANGUAGE_NAMES.items()}
# What a refusal says, by language.
REFUSALS = re.compile(
    r"\b(?:i|we)\b[^.!?]{0,40}?\b(?:can\s?not|can['’]t|could\s?not|unable to|not able to|won['’]t be able|must decline|have to decline|not allowed|not permitted|do not have access|don['’]t have access)\b[^.!?]{0,50}?\b(?:help|assist|answer|respond|provide|share|comply|discuss|support|fulfil\w*|complete|respond|engage|continue|this|that)\b"
    r"|\b(?:must|have to|need to) (?:respectfully )?decline\b|\bnot something i (?:can|am able)\b|\bfalls outside what i\b|\bagainst my guidelines\b"
    r"|\bne (?:peux|puis|suis|saurais|pouvons)\b[^.!?]*\b(?:répondre|aider|fournir|traiter|partager|accéder|donner|en mesure|autorisé)|\bpas en mesure de\b"
    r"|\bno (?:puedo|podré|me es posible|estoy|tengo permitido|se me permite)\b[^.!?]*\b(?:responder|ayudar\w*|contestar|proporcionar|compartir|atender|hacerlo|autorizad[oa]|condiciones)"
    r"|\b(?:kann|darf|möchte|werde)\b[^.!?]*\bnicht\b[^.!?]*\b(?:beantworten|helfen|weiterhelfen|antworten|unterstützen|nachkommen|eingehen)|\bnicht (?:in der lage|befugt|möglich)\b|\bnicht (?:beantworten|helfen|weiterhelfen)\b"
    r"|\bnon (?:posso|sono in grado|mi è possibile|sono autorizzat[oa])\b[^.!?]*\b(?:rispondere|aiutar\w*|fornire|condividere|soddisfare|farlo)"
    r"|\bnão (?:posso|consigo|me é possível|estou autorizad[oa]|sou capaz)\b[^.!?]*\b(?:responder|ajudar\w*|ajudá\w*|fornecer|atender|fazer|partilhar|compartilhar)|\bnão me é possível\b"
    r"|\bне (?:могу|вправе|в состоянии|имею права|смогу)\b[^.!?]*(?:ответ|помо|отвеч|предостав|выполн|обсужд)|вынужден[аы]? отказ"
    r"|\b(?:dois|devons|préfère) (?:refuser|décliner)|\bimpossible (?:de|d['’]) ?(?:vous )?(?:aider|répondre|donner|fournir|traiter|partager)|\brefuse de (?:répondre|vous)"
    r"|\b(?:debo|tengo que) (?:negarme|declinar|rechazar|rehusar)|\bme niego a\b|\bimposible (?:ayudar|responder|contestar|atender)\w*|\bfuera de lo que (?:puedo|se me permite)"
    r"|\b(?:muss|möchte)\b[^.!?]*\b(?:ablehnen|verweigern)\b|\b(?:unmöglich|außerstande)\b|\bsehe mich nicht\b"
    r"|\b(?:devo|debbo) (?:rifiutar\w*|declinare)|\bimpossibile (?:aiutar|risponder|soddisfar)\w*|\bal di fuori di ciò che\b"
    r"|\b(?:devo|tenho de|tenho que|preciso) (?:recusar|declinar)|\bimpossível (?:ajudar|responder|atender)\w*|\bfora do que (?:posso|me é permitido)"
    r"|(?:должен|должна|приходится|придётся|вынужден[аы]?) (?:вам )?отказ|невозможно (?:ответить|помочь|выполнить)"
    r"|お断り(?:し|いた|させ)|差し控え|ご遠慮(?:いた|させ|し)|(?:拒绝|谢绝|婉拒)(?:回答|这个|此|该|协助)?|恕(?:难|不|我)|爱莫能助|无可奉告"
    r"|(?:मना कर|इनकार कर|अस्वीकार कर)\S* ?(?:ना|ता|ती|रहा|रही|हूँ)|(?:उत्तर|जवाब|मदद|सहायता)[^।]*संभव नहीं|ขอปฏิเสธ|จำเป็นต้องปฏิเสธ|ไม่(?:อาจ|สะดวก|ได้รับอนุญาต)[^\n]{0,12}(?:ตอบ|ช่วย|ให้|ดำเนิน)"
    r"|(?:お応え|お答え|回答|対応|お手伝い|ご協力|支援)[^。]{0,8}(?:できません|できない|致しかね|いたしかね|しかねます|できかねます)"
    r"|(?:无法|不能|不便|没办法|無法)[^。]{0,4}(?:回答|协助|提供|处理|帮助|满足|讨论|完成|答)"
    r"|(?:उत्तर|जवाब|मदद|सहायता|अनुरोध|प्रश्न|सवाल)[^।]*(?:नहीं (?:दे|कर)[^।]*(?:सकत|पाऊ|पाउ)|असमर्थ)|असमर्थ"
    r"|ไม่สามารถ[^\n]{0,12}(?:ตอบ|ช่วย|ให้|ดำเนิน)",
    re.I,
)
_POLITE = re.compile(
    r"^(?:thanks?\b.*|thank you.*|sorry\b.*|i(?:['’]m| am) (?:so |very |truly )?sorry.*|i apologi[sz]e.*|my apologies.*|unfortunately\W*|regrettably\W*|please (?:try|ask|rephrase|consult).*|you (?:may|might|could) (?:wish|want|try)\b.*|is there (?:anything|something).*|let me know.*|feel free.*|"
    r"(?:je suis )?désolée?.*|malheureusement\W*|merci\b.*|veuillez.*|lo siento.*|disculp\w*.*|lamento.*|gracias.*|por favor.*|perdón.*|es tut mir leid.*|leider\W*|entschuldig\w*.*|bitte .*|mi dispiace.*|purtroppo\W*|grazie.*|desculp\w*.*|infelizmente\W*|obrigad[oa].*|"
    r"извин\w*.*|к сожалению\W*|прост\w+.*|пожалуйста.*|申し訳.*|恐れ入り.*|すみません.*|ご了承.*|対不起|对不起.*|很抱歉.*|抱歉.*|请.*|क्षमा.*|माफ़.*|खेद.*|कृपया.*|ขออภัย.*|ขอโทษ.*|กรุณา.*)$",
    re.I,
)
_WRAPPER = re.compile(r"^\W*(?:you asked|your question(?: was)?|the question(?: was| is)?|question|prompt|user|q|frage|pregunta|domanda|pergunta|вопрос|質問|问题|प्रश्न|คำถาม)\s*[:：]\s*", re.I)
# Abbreviations that a sentence cannot end with.
_OPEN_ABBREVIATION = re.compile(r"(?:^|[\s(\"“«„])(?:mr|mrs|ms|dr|prof|rev|capt|sr|sra|dra|mme|mlle|sig|dott|dott\.ssa|no|nr|vol|bd|pp?|pag|pág|ch|approx|ca|cf)\.$", re.I)
_INITIAL = re.compile(r"(?:^|[\s(\"“«„])[A-ZÀ-ÞА-Я]\.$")
_ENDS = re.compile(r"[.!?…。！？．।॥]+[\"'”’»」』）)\]*_]*$|[.!?…。！？।]\s*[»”]$|[\"”»」』)\]）】]$")
_ITEM = re.compile(r"^\s*(?:[-*•–]|\d+[.)])\s+(.*)$")
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[぀-ヿ一-鿿]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_VISIBLE = re.compile(r"[^\W_]")
_IGNORED = dict.fromkeys([0xAD, 0x34F, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF])


def tokens(text: str) -> list[str]:
    text = _CJK.sub(lambda m: f" {m[0]} ", text.lower())
    return re.findall(r"[^\W_]+", re.sub(r"['’]", " ", text))


def is_empty(answer: str | None) -> bool:
    """Whether the answer says nothing: null, blank, invisible, punctuation only, or a stand-in."""
    if answer is None:
        return True
    t = answer.translate(_IGNORED).strip()
    return not _VISIBLE.search(t) or re.sub(r"\s+", " ", t.strip(" \t\r\n.。!?()[]<>{}\"'“”*_-–—:")).lower() in STAND_INS


def copies(question: str, answer: str) -> bool:
    """Whether the answer is nothing but the question: once or more, cut, turned round, or with a word changed."""
    q, rest = tokens(question), answer.strip()
    while (m := _WRAPPER.match(rest)) and m.end() < len(rest):
        rest = rest[m.end() :]
    a = tokens(rest)
    if not q or not a:
        return False
    k = max(1, round(len(a) / len(q)))
    common = sum((Counter({w: n * k for w, n in Counter(q).items()}) & Counter(a)).values())
    slack = max(1, int(0.12 * k * len(q))) if len(q) > 3 else 0
    return k * len(q) - common <= slack and len(a) - common <= slack


#: Scripts that one language (as told here) is written in.
_SCRIPT_OF = {"HIRAGANA": "ja", "KATAKANA": "ja", "CJK": "zh", "DEVANAGARI": "hi", "THAI": "th", "CYRILLIC": "ru", "LATIN": "latin", "FULLWIDTH": "latin"}
_SCRIPTS: dict[str, str] = {}


def script(c: str) -> str:
    """The script of a letter by its Unicode name; its language where it has but one here."""
    if (s := _SCRIPTS.get(c)) is None:
        name = unicodedata.name(c, "?").split(" ")[0].split("-")[0]
        s = _SCRIPTS[c] = _SCRIPT_OF.get(name, name.lower())
    return s


def language(text: str) -> str | None:
    """The language of a text (the script, where that is all there is to tell), or None where it shows too little of one."""
    n = Counter()
    for c, k in Counter(text).items():
        o = ord(c)
        if c.isalpha() or 0x900 <= o < 0x980 or 0xE00 <= o < 0xE80:
            n[script(c)] += k if o < 0x900 else 2 * k
    if not n:
        return None
    if n["ja"] + n["zh"] > sum(n.values()) - n["ja"] - n["zh"]:
        return "ja" if n["ja"] * 12 >= n["zh"] else "zh" if n["zh"] >= 8 else None
    best = n.most_common(1)[0][0]
    if best != "latin":
        return best if n[best] >= 4 else None
    hits = dict.fromkeys(_WORDS_OF, 0)
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        for k in _LANGUAGES_OF.get(w, ()):
            hits[k] += 1
    first, second = sorted(hits, key=lambda k: (-hits[k], k))[:2]
    return first if hits[first] >= 2 and hits[first] > hits[second] else None


class Profiles:
    """Letter-trigram models of languages, fitted on all texts of the corpus.

    They tell a text that is not in the language it should be in, whatever
    language it is in: its mean log-probability lies far below that of texts of
    the language, for its length. How texts of the language score is taken over
    all of them too, each by the counts of the others. Models are of the
    languages that word lists tell; no others are asked for.
    """

    SLOTS = 1 << 14
    #: Standard deviations below the mean, bits below the mean, and letters at least, for a text to be foreign.
    FAR, BITS, LEAST = 6.0, 1.5, 40
    #: Texts that a model rests on at least; trigrams that are scored together, as the scores of long texts spread otherwise.
    TEXTS, PIECE = 16, 2000

    def __init__(self, texts: list[str] | None = None) -> None:
        self.n, self.total = dict[str, np.ndarray](), dict[str, int]()
        self.mean, self.spread = dict[str, float](), dict[str, float]()
        self._own = np.zeros(self.SLOTS, np.int64)
        if texts is not None:
            told = [(language(t), t) for t in texts]
            self.fit(self.counted(told))
            self.scale([(l, *m) for l, m in self.scored(told).items()])

    @classmethod
    def fitted(cls, texts: DataFrame) -> Profiles:
        """The models of distinct texts, ``l, t`` with their languages: one pass counts, one scores."""
        texts = texts.select("l", "t").where(F.col("l").isin(list(_WORDS_OF)))
        pairs = lambda batches: (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = cls.counted(pairs(batches))
            for l, k in n.items():
                at = np.flatnonzero(k)
                yield pa.RecordBatch.from_arrays([pa.array([l] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(k[at], pa.int64())], names=["l", "slot", "n"])

        out = cls()
        n: dict[str, np.ndarray] = {}
        # The model itself: at most SLOTS + 1 rows a language.
        for r in texts.mapInArrow(count, "l string, slot int, n bigint").groupBy("l", "slot").agg(F.sum("n").alias("n")).collect():
            n.setdefault(r["l"], np.zeros(cls.SLOTS + 1, np.int64))[r["slot"]] = r["n"]
        out.fit(n)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [(l, *m.tolist()) for l, m in out.scored(pairs(batches)).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[i] for r in rows], pa.float64()) for i in range(1, 6))], names=["l", *names])

        names = ["k", "s", "w", "ws", "wss"]
        if out.n:
            out.scale([tuple(r) for r in texts.mapInArrow(score, "l string, " + ", ".join(f"{x} double" for x in names)).groupBy("l").agg(*(F.sum(x).alias(x) for x in names)).collect()])
        return out

    @classmethod
    def counted(cls, texts: Iterable[tuple[str | None, str]]) -> dict[str, np.ndarray]:
        """How often each trigram occurs in each language; in the last place the number of texts."""
        n: dict[str, np.ndarray] = {}
        for l, t in texts:
            if l in _WORDS_OF and len(x := cls._grams(t)) >= cls.LEAST:
                k = n.setdefault(l, np.zeros(cls.SLOTS + 1, np.int64))
                np.add.at(k, x, 1)
                k[-1] += 1
        return n

    def fit(self, n: dict[str, np.ndarray]) -> None:
        """Take the counts, of languages with texts enough."""
        for l, k in sorted(n.items()):
            if k[-1] >= self.TEXTS:
                self.n[l], self.total[l] = k[:-1], int(k[:-1].sum())

    def _bits(self, x: np.ndarray, lang: str, own: bool) -> np.ndarray:
        """The log-probabilities of a text's trigrams, by the counts of all other texts if it is one of those counted."""
        n, total = self.n[lang][x], self.total[lang]
        if own:
            np.add.at(self._own, x, 1)
            n, total = np.maximum(n - self._own[x], 0), max(total - len(x), 0)
            self._own[x] = 0
        return np.log2((n + 0.05) / (total + 0.05 * self.SLOTS))

    def scored(self, texts: Iterable[tuple[str | None, str]]) -> dict[str, np.ndarray]:
        """For each language: number and sum of the pieces' scores, and sums of their lengths, times the score and its square. Scores count from that of a model that knows nothing."""
        out: dict[str, np.ndarray] = {}
        for l, t in texts:
            if l in self.n and len(x := self._grams(t)) >= self.LEAST:
                bits = self._bits(x, l, own=True) + math.log2(self.SLOTS)
                m = out.setdefault(l, np.zeros(5))
                for i in range(0, len(bits), self.PIECE):
                    if len(b := bits[i : i + self.PIECE]) >= self.LEAST:
                        w, s = len(b), float(b.mean())
                        m += (1, s, w, w * s, w * s * s)
        return out

    def scale(self, moments: Iterable[tuple[str, float, float, float, float, float]]) -> None:
        """Mean and spread of the scores; rounded, as sums depend a little on their order."""
        for l, k, s, w, ws, wss in moments:
            mean = s / k
            self.mean[l] = round(float(mean) - math.log2(self.SLOTS), 6)
            # What one trigram adds to the spread, from texts of all lengths.
            self.spread[l] = round(math.sqrt(max(0.0, float(wss - 2 * mean * ws + mean * mean * w)) / k), 6)

    @classmethod
    def _grams(cls, text: str) -> np.ndarray:
        # Words with capitals are mostly names, which belong to no language.
        t = " " + " ".join(w for w in re.findall(r"[^\W\d_]+", text) if w == w.lower()) + " "
        cp = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if len(cp) < 3:
            return np.empty(0, np.int64)
        h = (cp[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ cp[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ cp[2:] * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(50)).astype(np.int64)

    def foreign(self, text: str, lang: str, told: str | None) -> bool:
        """Whether the text, told as being in one language, can hardly be in the language."""
        if lang not in self.mean or len(x := self._grams(text)) < self.LEAST:
            return False
        below = self.mean[lang] - float(self._bits(x, lang, own=told == lang).mean())
        return below > self.BITS and below > self.FAR * self.spread[lang] / math.sqrt(len(x))


def is_refusal(answer: str) -> bool:
    """Whether the answer declines and holds nothing else."""
    said = False
    for s in re.split(r"(?<=[.!?।])\s+|(?<=[。！？])|\n+", answer.strip()):
        s = s.strip()
        if not _VISIBLE.search(s):
            continue
        if REFUSALS.search(s) and s[0] not in "\"“„«—‘「『" and not re.search(r"[\"”»]\s*,?\s*(?:said|asked|cried)\b|,\s*(?:yet|but here|however)\b", s):
            said = True
        elif not _POLITE.match(s):
            return False
    return said


def other_language(question: str, answer: str, profiles: Profiles | None = None) -> bool:
    """Whether the answer is in another language than the question, which does not ask for it."""
    bare = re.sub(r"[“„\"«「『][^”“\"»」』]*[”“\"»」』]", " ", answer)
    ask = language(question)
    said = language(part := bare if len(tokens(bare)) >= 4 else answer)
    if ask in _WORDS_OF and said in (None, ask) and profiles and profiles.foreign(answer, ask, said if part == answer else language(answer)) and not any(x.search(question) for k, x in _ASKS.items() if k != ask):
        return True
    if ask and said and ask != said and said not in _ASKS:
        return True
    return bool(ask and said and ask != said and not ({ask, said} == {"ja", "zh"} and len(answer) < 12) and not _ASKS[said].search(question))


def last_line_key(line: str) -> str:
    """What the end of an unpunctuated line is looked up by: its last word, or in Thai its last letters."""
    if re.search("[฀-๿]$", line):
        return line.split()[-1][-5:]
    w = re.findall(r"[^\W\d_]+", line)
    return w[-1].lower() if w else ""


def is_truncated(answer: str, goes_on: bool, at_spike: bool, seen: int, ended: int) -> bool:
    """Whether the answer breaks off.

    ``goes_on``: another answer repeats it and goes on within the line;
    ``at_spike``: its length is one at which many unended answers stop;
    ``seen``/``ended``: how often its last word occurs, and closes a clause, elsewhere.
    """
    t = answer.translate(_IGNORED).rstrip()
    if re.search(r"(?:^|\n)\s*(?:\d+[.)]|[-*•–])$", t) and "\n" in t:
        return True
    if _ENDS.search(t):
        return bool(_OPEN_ABBREVIATION.search(t) or _INITIAL.search(t)) and len(tokens(t)) > 3
    lines = [x for x in t.split("\n") if x.strip()]
    if t[-1] in ",;:，、；：(（[“„«「『‘—–-":
        return True
    item = _ITEM.match(lines[-1])
    if item:
        said = re.findall(r"\w+", item[1])
        others = [len(re.findall(r"\w+", m[1])) for x in lines[:-1] if (m := _ITEM.match(x))]
        if not said or goes_on or at_spike:
            return True
        short = bool(others) and len(said) < min(others)
        return (seen >= 8 and ended * 50 < seen) or (short and (len(said) <= 2 or ended * 5 < seen)) or (seen == 0 and short)
    words = re.findall(r"\w+", lines[-1])
    # A few words without any stop are an answer by name, of which longer answers may well go on.
    if len(lines) == 1 and len(words) <= 6 and not re.search(r"[.!?…।]\s", t) and not _CJK.search(t) and not re.search("[฀-๿]", t):
        return seen >= 20 and ended * 50 < seen and len(words) > 1
    if goes_on or at_spike:
        return True
    if re.search("[฀-๿]$", t):
        return ended == 0
    if _CJK.search(t[-1]) or (_CJK.search(t) and t[-1].isalnum()):
        return len(t) > 12
    return True


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their languages."""
    for b in sliced(batches, 0):
        told = pa.array([language(t) for t in b.column(0).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), told], names=["t", "long", "l"])


def _prefix_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over sorted distinct texts: which one is the beginning of the one after it, and how that goes on."""
    pid, waiting, first = TaskContext.get().partitionId(), list[tuple[int, str]](), None
    names = ["what", "pid", "h", "text", "follows"]
    types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string()]
    for b in batches:
        out: list[tuple] = []
        for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if first is None:
                first = t
                out.append(("first", pid, None, t, None))
            while waiting and not t.startswith(waiting[-1][1]):
                waiting.pop()
            # Texts that begin t wait in order of length; each is settled by the first one that goes on.
            for hh, w in waiting:
                out.append(("found", pid, hh, None, t[len(w) : len(w) + 8]))
            waiting = [(h, t)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], ty) for i, ty in enumerate(types)], names=names)
    yield pa.RecordBatch.from_arrays([pa.array([x], ty) for x, ty in zip(("open", pid, waiting[-1][0], waiting[-1][1], None), types, strict=True)] if waiting else [pa.array([], ty) for ty in types], names=names)


def shortened(texts: DataFrame) -> DataFrame:
    """``h, follows``: hashes of texts that another text repeats and continues, with the next characters.

    Distinct texts are sorted by range; a text's continuation can only be its
    neighbour. A partition's last text meets the first of the next non-empty
    partition in a second step (two rows a partition).
    """
    return _shortened(texts.distinct())


def _shortened(d: DataFrame) -> DataFrame:
    seen = d.repartitionByRange("t").sortWithinPartitions("t").select("h", "t").mapInArrow(_prefix_batches, "what string, pid int, h bigint, text string, follows string")
    seen = written(seen, "prefixes")
    nxt = seen.where("what = 'first'").withColumn("before", F.lag("pid").over(Window.orderBy("pid"))).select("before", F.col("text").alias("nt"))
    edge = seen.where("what = 'open'").join(nxt, F.col("pid") == F.col("before")).where(F.startswith("nt", "text") & (F.length("nt") > F.length("text")))
    edge = edge.select("h", F.substring(F.col("nt"), F.length("text") + 1, F.lit(8)).alias("follows"))
    return seen.where("what = 'found'").select("h", "follows").unionByName(edge)


def defective(pairs: DataFrame, *, least_chars: int = 12, spike_z: float = 13.0, spike_times: float = 5.0) -> DataFrame:
    """``record_kind, record_id, defect`` of every broken pair.

    ``pairs(record_kind, record_id, question, answer)``. One defect a pair, the
    first that holds of ``empty``, ``copies_question``, ``refusal``,
    ``other_language``, ``truncated``. For the last, answers sorted by text show
    which are another's beginning, a histogram shows lengths at which
    ``spike_times`` as many unended answers stop as around them (and by
    ``spike_z`` standard deviations of a Poisson count more), and counts over all answers show whether the last word
    ever closes a clause. Null and blank answers are ``empty``; a null question
    leaves only the rules that need none. Repeated rows count once; other
    columns are not read. Letter-trigram models of all questions and answers,
    each distinct text once, tell answers in any further language.
    """
    rows = pairs.select("record_kind", F.col("record_id").cast("string").alias("record_id"), F.col("question").alias("q"), F.col("answer").alias("a")).where(F.col("record_id").isNotNull()).dropDuplicates(["record_kind", "record_id"])
    rows = written(rows.withColumn("h", F.xxhash64("a")).withColumn("bare", ~F.col("a").rlike(r"[.!?…。！？।\"”»」』)\]）】]\s*$")), "pairs")
    # Every distinct text once, for the language models; answers among them for the comparison of neighbours.
    texts = rows.select(F.inline(F.array(F.struct(F.col("q").alias("t"), F.lit(False).alias("long")), F.struct(F.col("a").alias("t"), (F.length("a") >= least_chars).alias("long"))))).where("t IS NOT NULL")
    texts = written(texts.groupBy("t").agg(F.max("long").alias("long")).mapInArrow(_tell, "t string, long boolean, l string"), "texts")
    profiles = Profiles.fitted(texts)
    long = rows.where(F.length("a") >= least_chars)
    on = _shortened(texts.where("long").select(F.xxhash64("t").alias("h"), "t")).groupBy("h").agg(F.min("follows").alias("follows"))
    size = long.where("bare").groupBy(F.length("a").alias("size")).count()
    around = F.sum("count").over(Window.orderBy("size").rangeBetween(-8, 8))
    spikes = size.withColumn("near", (around - F.col("count")) / 16.0).where((F.col("count") - F.col("near") >= spike_z * F.sqrt(F.col("near") + 1)) & (F.col("count") >= spike_times * F.greatest("near", F.lit(1.0)))).select("size", F.lit(True).alias("spike"))
    # Last words of unended answers, and how all answers use them.
    thai = F.regexp_extract("a", "([฀-๿]{1,5})\\s*$", 1)
    word = F.when(thai != "", thai).otherwise(F.lower(F.regexp_extract("a", r"([\p{L}\p{M}]+)[^\p{L}\p{M}]*$", 1)))
    ends = long.where("bare").select("record_kind", "record_id", word.alias("w"))
    used = long.select(F.explode(F.regexp_extract_all(F.lower("a"), F.lit(r"[\p{L}\p{M}]+(?:[\t ]*[.!?,;:…।\n\"”)])?"), F.lit(0))).alias("x")).where("x <> ''")
    used = used.groupBy("x").count().select(F.regexp_extract("x", r"^([\p{L}\p{M}]+)", 1).alias("w0"), F.col("x").rlike(r"[^\p{L}\p{M}]$").alias("end"), "count")
    used = used.select(F.when(F.col("w0").rlike("[฀-๿]$"), F.regexp_extract("w0", "([฀-๿]{1,5})$", 1)).otherwise(F.col("w0")).alias("w"), "end", "count")
    used = used.join(ends.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.sum("count").alias("seen"), F.sum(F.when(F.col("end"), F.col("count")).otherwise(0)).alias("ended"))
    # Written, so that its true size says whether it is broadcast; else a common last word is split by the skew join.
    used = written(used, "words")
    facts = ends.join(used, "w", "left").select("record_kind", "record_id", "seen", "ended")
    full = rows.join(on, "h", "left").join(spikes, (F.length("a") == F.col("size")) & F.col("bare"), "left").join(facts, ["record_kind", "record_id"], "left")
    return full.select("record_kind", "record_id", "q", "a", F.col("follows"), F.coalesce("spike", F.lit(False)).alias("spike"), F.coalesce("seen", F.lit(0)).cast("long").alias("seen"), F.coalesce("ended", F.lit(0)).cast("long").alias("ended")).mapInArrow(_judge(profiles), "record_kind string, record_id string, defect string").where("defect IS NOT NULL")


def defect(q: str | None, a: str | None, follows: str | None, spike: bool, seen: int, ended: int, profiles: Profiles | None = None) -> str | None:
    """The pair's defect, if any."""
    if is_empty(a):
        return "empty"
    if q and copies(q, a):
        return "copies_question"
    if is_refusal(a):
        return "refusal"
    if q and other_language(q, a, profiles):
        return "other_language"
    goes_on = bool(follows) and not follows[:1].isspace() or bool(follows and re.match(r"[ \t]+[^\W\d_]", follows))
    return "truncated" if is_truncated(a, goes_on, spike, seen, ended) else None


def _judge(profiles: Profiles):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 3):
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            got = [defect(*x, profiles) for x in zip(*cols[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(got, pa.string())], names=["record_kind", "record_id", "defect"])

    return run
