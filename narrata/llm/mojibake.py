"""Problem 8: text decoded with the wrong encoding."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata.llm.common import sliced
from narrata.session import spread, written

# Encodings that text is commonly misread in, and those it really had.
MISREAD_AS = ("cp1252", "latin-1", "cp437", "cp850", "mac-roman", "cp1250", "cp1251", "koi8-r", "cp866", "iso8859-2", "cp1254", "cp1253", "iso8859-5", "mac-cyrillic")
MISREAD_ONE = ("cp1252", "latin-1", "cp437", "cp850", "cp1251", "mac-roman", "koi8-r", "cp866")
SINGLE_BYTE_TRUTH = ("cp1252", "cp1251", "koi8-r", "cp866", "cp437", "cp850", "mac-roman", "iso8859-5", "cp1250")
CYRILLIC = ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic")
MULTI_BYTE_TRUTH = ("shift_jis", "gb18030", "euc_jp", "big5", "tis-620")

#: Bytes of description that a chain costs by itself, for each decoding step.
CHAIN_COST = 6.0
#: Bytes that a character not seen in the language costs on top.
NOVEL_COST = 3.0
#: Bytes that a character costs which the language hardly shows, and one that tears a word apart.
STRANGE_COST, TORN_COST = 1.0, 40.0
#: Bytes that a character costs which only the reading brings in and no language shows.
UNKNOWN_COST = 30.0
#: A chain must save at least this share of the description of the stretches it changes.
MIN_SAVING = 0.02
#: Characters that a piece of text has, of which shares are taken; shares of a language's pieces from which a character counts as usual, as seen, and as known at all.
PIECE, USUAL, SEEN, KNOWN = 1200, 0.02, 0.01, 0.001
#: Words, pairs and triples of words that a dictionary holds, of each; characters of a word that is counted whole, and of the parts that longer ones are counted by.
WORDS, WHOLE, PART = 8192, 12, 4
#: Share of a language's texts that a word of the dictionary is in, as damage that shows no sign repeats itself too.
COMMON = 0.002
#: Different keys that a task counts before it hands them on.
KEYS = 100_000
#: Characters that a stretch has beyond each change, and that must be equal before two readings go on alike.
AROUND, ALIKE, REACH = 24, 8, 240
FIELDS = [("doc_id", pa.int64()), ("damaged", pa.bool_()), ("chain", pa.string()), ("text_restored", pa.string())]
SCHEMA = "doc_id bigint, damaged boolean, chain string, text_restored string"


def _byte_map(codec: str) -> dict[str, int]:
    """Character -> byte for the upper half; bytes the codec leaves undefined stand for themselves."""
    return {bytes([b]).decode(codec, "ignore") or chr(b): b for b in range(0x80, 0x100)}


class Misread:
    """UTF-8 byte sequences as they look when read in ``codec``."""

    def __init__(self, codec: str) -> None:
        self.codec, self.of = codec, _byte_map(codec)
        if codec == "cp1252":
            self.of |= {chr(b): b for b in range(0x80, 0xA0) if chr(b) not in self.of}
        at = lambda lo, hi: "[" + re.escape("".join(c for c, b in self.of.items() if lo <= b <= hi)) + "]"
        tail = at(0x80, 0xBF)
        # A no-break space that stands for byte A0 is often stored as a plain space.
        soft = f"(?:{tail}| (?=[\\s\\w]))" if self.of.get("\xa0") == 0xA0 else tail
        self.leads, self.tails = ({c for c, b in self.of.items() if lo <= b <= hi} for lo, hi in ((0xC2, 0xF4), (0x80, 0xBF)))
        self.seq = re.compile(f"{at(0xF0, 0xF4)}{tail}{tail}{tail}|{at(0xE0, 0xEF)}{tail}{tail}|{at(0xC2, 0xDF)}(?:{soft})")

    def _one(self, m: re.Match[str]) -> str:
        try:
            return bytes(self.of.get(c, 0xA0) for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    def undo(self, line: str) -> str:
        return self.seq.sub(self._one, line)


def _to_latin(codec: str) -> dict[int, int]:
    """A translation that puts the codec's byte in each character's place; others become unencodable."""
    of = _byte_map(codec)
    return {c: 0xFFFF for c in range(0x80, 0x100)} | {ord(c): b for c, b in of.items()}


def _decoded(raw: bytes, truth: str) -> str | None:
    try:
        return raw.decode(truth)
    except UnicodeDecodeError:
        return None


_SURE = re.compile("�|[\x80-\x84\x86-\x9f]|ï»¿|ï¿½|â€[œ\x9d™˜“”¦œ\u0080-¿]|Ã[ƒ‚¡-¿]|Â[ -¿]|вЂ[™њќ“”¦љ]|ΓÇ[ªÿÖ£¥ô]|‚Ä[ôúùîì¶]|(?<=[^\\W\\d_])[├┬][═-╬─-▓]|[├┬][▒▓░®©±ñ¡íáóúéâàäçêëèïîìÄÅæÆôöòûùÿÖÜ¢£₧ƒ]")


def _signs() -> str:
    """UTF-8 pairs (lead and tail byte) as they look in codecs that make a symbol of the lead: no sound text has them."""
    out = []
    for codec in ("cp437", "cp850", "mac-roman"):
        char = {b: c for c, b in _byte_map(codec).items()}
        frame = lambda c: "\u2500" <= c <= "\u259f"
        for lead in range(0xC2, 0xE0):
            a = char[lead]
            if unicodedata.category(a) not in ("Sm", "So") or a == "÷":
                continue
            # Frames are drawn with several of the signs, and formulas have roots.
            tails = "".join(c for b in range(0x80, 0xC0) if not (frame(c := char[b]) and frame(a)) and not (a in "√≈¬" and (unicodedata.category(c) == "Sm" or c in "πΩµ")))
            out.append(f"{a}[{re.escape(tails)}]")
            if a == "√":
                out.append(f"(?<=[^\\W\\d_])√[{re.escape(''.join(char[b] for b in range(0x80, 0xC0)))}]")
    return "|".join(dict.fromkeys(out))


#: Signs of damage that stay a sign where nothing undoes them.
_SIGNS = re.compile(f"{_SURE.pattern}|{_signs()}|Ã[€†‡ˆ‰Š‹ŒŽ•˜™šœžŸ]|(?<=[a-zß-öø-ÿ])Ã|(?<![^\\W\\d_])Ã[\xa0 ]|[ÂĂ][\u0080-\u009f]|Ă[\xa0¨©Şˇ´¶Ľş§®Ż±]")


def _stretches(old: str, new: str) -> tuple[str, str]:
    """What differs between two readings of a line, each with the characters round it."""
    spans: list[list[int]] = []  # from and to in the old line, from and to in the new one
    i = j = 0
    while i < len(old) or j < len(new):
        n = _alike(old, new, i, j)
        i, j = i + n, j + n
        if i == len(old) and j == len(new):
            break
        for d in range(1, REACH):
            if len(gram := old[i + d : i + d + ALIKE]) == ALIKE and (k := new.find(gram, j, j + d + ALIKE)) >= 0:
                to = (i + d, k)
                break
        else:
            n = 0
            while n < min(len(old) - i, len(new) - j) and old[-1 - n] == new[-1 - n]:
                n += 1
            to = (len(old) - n, len(new) - n)
        if spans and i - spans[-1][1] < 2 * AROUND:
            spans[-1][1], spans[-1][3] = to
        else:
            spans.append([i, to[0], j, to[1]])
        i, j = to
    cut = lambda s, a, b: s[max(0, a - AROUND) : b + AROUND]
    return "\n".join(cut(old, a, b) for a, b, _, _ in spans), "\n".join(cut(new, a, b) for _, _, a, b in spans)


def _alike(old: str, new: str, i: int, j: int) -> int:
    """How many characters from these places on are the same."""
    n, step = 0, 64
    while step:
        a = old[i + n : i + n + step]
        if a and a == new[j + n : j + n + step]:
            n += len(a)
        else:
            step //= 2
    return n


_TURNED = re.compile("[а-яё][А-ЯЁ]")


def _torn(text: str) -> int:
    """Symbols inside words, and small letters between capitals."""
    return len(re.findall(r"\w[^\w\s\x00-\x7f’–]\w|[A-ZÀ-Þ][a-zß-ÿ][A-ZÀ-Þ]", text))


_MIXED = re.compile("[A-Za-z][\u0370-\u04ff\u0590-\u0fff]|[\u0370-\u04ff\u0590-\u0fff][A-Za-z]")


def _broken(old: str, new: str) -> int:
    """Words that rereading single bytes would tear: blanks that become letters, symbols or foreign letters within words, marks that become letters by themselves."""
    n = 0
    if len(old) == len(new):
        for i, (a, b) in enumerate(zip(old, new, strict=True)):
            if a != b and (a.isspace() and not b.isspace() or a.isalpha() and not b.isalpha() and b != "’" and new[i - 1 : i].isalpha() and (b not in "”»“…\xa0" or new[i + 1 : i + 2].isalpha()) or b.isalpha() and not a.isalpha() and not new[i - 1 : i].isalpha() and not new[i + 1 : i + 2].isalpha()):
                n += 1
    return n + max(0, _torn(new) - _torn(old)) + max(0, len(_MIXED.findall(new)) - len(_MIXED.findall(old)))


def _pair(read: str, truth: str) -> bool:
    """Pairs of single-byte encodings that meet: a Western one with the common ones, a Cyrillic text with any."""
    common = ("cp1252", "latin-1")
    return read != truth and not (read in common and truth in common) and (truth in CYRILLIC or (truth == "cp1252" and read not in CYRILLIC) or (read in common and truth not in CYRILLIC))


class Model(NamedTuple):
    """A language: its dictionary, its number of pieces, and for each character beyond ASCII the pieces that hold it and how often it occurs."""

    words: str
    pieces: float
    chars: dict[str, tuple[int, int]]

    @classmethod
    def of(cls, sample: str) -> Model:
        """The model of texts joined by NUL, each a piece, which are their own dictionary."""
        texts, n = sample.split("\0"), Counter(sample)
        k = Counter(c for t in texts for c in set(t))
        return cls(sample, len(texts), {c: (k[c], n[c]) for c in k if ord(c) > 127})

    def shown(self, share: float, least: int = 1) -> set[str]:
        """Characters in at least that share of the pieces."""
        return {c for c, (k, _) in self.chars.items() if k >= max(least, share * self.pieces) or self.pieces < 8}


class Judge:
    """Description lengths of text by zstandard dictionaries, one per language."""

    def __init__(self, models: dict[str, Model | str]) -> None:
        self.models = {k: Model.of(v) if isinstance(v, str) else v for k, v in models.items()}
        self.seen = {k: v.shown(SEEN) for k, v in self.models.items()}
        self.known = set().union(*(v.shown(KNOWN) for v in self.models.values()))
        self.usual = {k: v.shown(USUAL, 2) for k, v in self.models.items()}
        self.wide = [Misread(c) for c in MISREAD_AS]
        self.latin = {c: _to_latin(c) for c in MISREAD_ONE}
        self.runs = {c: re.compile("[\\x21-\\x7e" + re.escape("".join(_byte_map(c))) + "]+") for c in MISREAD_ONE}
        self.memory: dict[tuple[str, str, tuple[str, ...]], tuple[float, str | None, str]] = {}
        # What stands for a letter that is lost: the commonest beyond ASCII, if the language has one.
        self.letter = {k: min(((-v.chars[c][1], c) for c in self.usual[k] if c.isalpha()), default=(0, "e"))[1] for k, v in self.models.items()}
        # Made when a language is first met.
        self.zip, self.strange, self.quiet = cache(self._zip), cache(self._strange), cache(self._quiet)

    def _zip(self, lang: str) -> zstandard.ZstdCompressor | None:
        if lang not in self.models or not self.models[lang].words:
            return None
        words = zstandard.ZstdCompressionDict(self.models[lang].words.encode("utf-8", "surrogatepass"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(level=3, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)

    def _strange(self, lang: str) -> re.Pattern[str]:
        return re.compile("[^\\x00-\\x7f" + re.escape("".join(sorted(self.usual.get(lang, ())))) + "]")

    def cost(self, text: str, lang: str) -> float:
        z = self.zip(lang)
        raw = text.encode("utf-8", "surrogatepass")
        novel = sum(NOVEL_COST * (1 + (c not in self.known)) for c in text if ord(c) > 127 and c not in self.seen.get(lang, self.known))
        return (len(z.compress(raw)) if z else len(raw)) + novel

    def odd(self, line: str, lang: str) -> int:
        """How much in the line the language does not show: strange characters, and Cyrillic words in turned-round case."""
        return len(self.strange(lang).findall(line)) + len(_TURNED.findall(line))

    def _quiet(self, lang: str) -> list[tuple[str, str, frozenset[str], dict[int, str]]]:
        """Rereadings of single bytes that turn usual characters of the language into usual ones: ``(read, truth, characters, mapping)``."""
        out, usual = [], self.usual.get(lang, set())
        for read in MISREAD_ONE:
            of = _byte_map(read)
            for truth in SINGLE_BYTE_TRUTH:
                if _pair(read, truth):
                    m = {ord(c): new for c in usual if c in of and (new := _decoded(bytes([of[c]]), truth)) in usual}
                    if any(chr(c) != new for c, new in m.items()):
                        out.append((read, truth, frozenset(map(chr, m)), m))
        return out

    def language(self, text: str) -> str:
        return min(self.models, key=lambda k: (self.cost(text, k), k)) if self.models else ""

    def _chains(self, line: str, lang: str) -> Iterator[tuple[str, str, int]]:
        """``(chain, text, steps)`` for every decoding that changes the line."""
        done = {line}
        for m in self.wide:
            a = m.undo(line)
            if a in done:
                continue
            done.add(a)
            yield f"{m.codec}>utf-8", a, 1
            for n in self.wide:
                b = n.undo(a)
                if b not in done:
                    done.add(b)
                    yield f"{m.codec}>utf-8>{n.codec}>utf-8", b, 2
                    c = n.undo(b)
                    if c not in done:
                        done.add(c)
                        yield f"{m.codec}>utf-8>{n.codec}>utf-8>{n.codec}>utf-8", c, 3
        # Strange words, for damage within a line: those with letters beside the strange ones.
        words = [w for w in dict.fromkeys(re.findall(r"\S+", line)) if self.odd(w, lang) and len(re.findall(r"[^\W\d_]", w)) > 2]
        for read, to_latin in self.latin.items():
            try:
                raw = line.translate(to_latin).encode("latin-1")
            except UnicodeEncodeError:
                raw = None
            runs = {x for w in words for x in self.runs[read].findall(w) if not x.isascii()}
            for truth in SINGLE_BYTE_TRUTH + MULTI_BYTE_TRUTH:
                if truth in SINGLE_BYTE_TRUTH and not _pair(read, truth):
                    continue
                if raw is not None and (a := _decoded(raw, truth)) is not None and a not in done:
                    done.add(a)
                    yield f"{read}>{truth}", a, 1
                if runs and truth in SINGLE_BYTE_TRUTH:
                    new = {x: y for x in runs if (y := _decoded(x.translate(to_latin).encode("latin-1"), truth)) is not None}
                    a = re.sub(r"\S+", lambda m, r=read, n=new: self.runs[r].sub(lambda x: n.get(x[0], x[0]), m[0]) if m[0] in words else m[0], line) if new else line
                    if a not in done:
                        done.add(a)
                        yield f"{read}>{truth}", a, 1

    def _readings(self, line: str, lang: str, odd: int) -> Iterator[tuple[str, str, int]]:
        """All readings of a line that can be cheaper than the line itself.

        Where nothing in the line is strange to the language, a reading that
        brings in strange characters cannot be, so those alone are left out.
        """
        if odd:
            yield from self._chains(line, lang)
            return
        held = {c for c in line if ord(c) > 127}
        for read, truth, known, mapping in self.quiet(lang):
            if held <= known:
                yield f"{read}>{truth}", line.translate(mapping), 1
        for m in self.wide:
            if held & m.leads and held & m.tails and (a := m.undo(line)) != line:
                yield f"{m.codec}>utf-8", a, 1

    def _best(self, line: str, lang: str, known: tuple[str, ...]) -> tuple[float, str | None, str]:
        """``(saving, chain, text)`` of the cheapest reading of a line; a saving is taken over the stretches that change."""
        odd = self.odd(line, lang)
        best, costs = (0.0, None, line), dict[str, float]()
        for chain, new, steps in self._readings(line, lang, odd):
            wide = "utf-8" in chain
            extra = CHAIN_COST * steps * (1 if chain not in known else 0.25) + (0.0 if wide else 1.0)
            fewer = odd - self.odd(new, lang)
            # A reading must show fewer strange characters, or at least none where there was none.
            if fewer <= 0 and (odd or fewer < 0):
                continue
            besides = extra - STRANGE_COST * fewer
            besides += UNKNOWN_COST * sum(ord(c) > 127 and c not in self.known and c not in line for c in new)
            if not wide and (chain.endswith((*SINGLE_BYTE_TRUTH, "tis-620"))):
                besides += TORN_COST * _broken(line, new)
            was, now = _stretches(line, new)
            if was not in costs:
                costs[was] = self.cost(was, lang)
            if (c := costs[was] * (1 - MIN_SAVING) - self.cost(now, lang) - besides) > best[0]:
                best = (c, chain, new)
        return best

    def _lost(self, line: str, lang: str) -> bool:
        """Whether signs of damage that nothing undoes are dearer than a letter in their place."""
        if not _SIGNS.search(line):
            return False
        new = _SIGNS.sub(self.letter.get(lang, "e"), line)
        was, now = _stretches(line, new)
        return self.cost(was, lang) + STRANGE_COST * self.odd(line, lang) > self.cost(now, lang) + STRANGE_COST * self.odd(new, lang) + CHAIN_COST

    def restore(self, text: str, lang: str | None) -> tuple[bool, str | None, str]:
        """``(damaged, chain, text)``; chain and text tell the cheapest description.

        Each line is read by itself first; then lines that stay as they are get
        a second look, at which the chains found elsewhere in the text are cheap.
        The result does not depend on the order of the lines.
        """
        if lang not in self.models:
            lang = self.language(text)
        lines, found = text.split("\n"), Counter[str]()
        todo = [i for i, line in enumerate(lines) if not line.isascii()]
        for known in ((), None):
            if known is None:
                known = tuple(sorted(found))
                if not known:
                    break
            left = []
            for i in todo:
                if (best := self.memory.get((lines[i], lang, known))) is None:
                    if len(self.memory) > 20_000:
                        self.memory.clear()
                    best = self.memory[lines[i], lang, known] = self._best(lines[i], lang, known)
                if best[1]:
                    found[best[1]] += 1
                    lines[i] = best[2]
                else:
                    left.append(i)
            todo = left
        damaged = bool(found) or any(self._lost(lines[i], lang) for i in todo)
        return damaged, max(found, key=lambda k: (found[k], k)) if found else None, "\n".join(lines)


#: Signs of damage that keep a text out of the models.
_UNCLEAN = "[�\u0080-\u009f─-▟√Ωπτσ∫≤≥⌠⌡Γ]|[ÃÂÐÑâà][\u0080-¿€‚ƒ„…†‡ˆ‰‹Œ‘’“”•–—˜™›œ]|вЂ|[РС][\u0080-¿Ђ‚ѓ„…†‡€‰]"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What texts of each language show: words (``what`` is ``w``), pairs and triples of words (``p``, ``t``), characters beyond ASCII (``c``), and pieces (``n``)."""
    words, pairs, triples, pieces, often, size, texts = *(Counter[tuple[str, str]]() for _ in range(5)), Counter[str](), Counter[str]()

    def rows() -> pa.RecordBatch:
        out = [(l, "w", w, k, 0) for (l, w), k in words.items()] + [(l, "p", w, k, 0) for (l, w), k in pairs.items()] + [(l, "t", w, k, 0) for (l, w), k in triples.items()] + [(l, "c", c, k, often[l, c]) for (l, c), k in pieces.items()] + [(l, "n", "", k, texts[l]) for l, k in size.items()]
        for x in (words, pairs, triples, pieces, often, size, texts):
            x.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["l", "what", "x", "k", "m"])

    for b in sliced(batches, 1):
        for l, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held = set(w := t.split())
            if "\xa0" in t:
                # No-break spaces count with the words round them too: they are among what is misread.
                held |= {x for x in re.findall("[^ \t\r\n]+", t) if "\xa0" in x}
            long = {w for w in held if len(w) > WHOLE}
            words.update((l, w) for w in held - long | {w[i : i + PART] for w in long for i in range(len(w) - PART + 1)})
            size[l] += len(t)
            texts[l] += 1
            if not t.isascii():
                pairs.update((l, x) for x in {f"{a} {b}" for a, b in zip(w, w[1:], strict=False) if not (a.isascii() and b.isascii()) and len(a) <= WHOLE and len(b) <= WHOLE})
                triples.update((l, x) for x in {f"{a} {b} {c}" for a, b, c in zip(w, w[1:], w[2:], strict=False) if not (a.isascii() and b.isascii() and c.isascii()) and max(len(a), len(b), len(c)) <= WHOLE})
                often.update((l, c) for c in re.findall("[^\\x00-\\x7f]", t))
                pieces.update((l, c) for i in range(0, len(t), PIECE) for c in set(t[i : i + PIECE]) if ord(c) > 127)
            if len(words) + len(pairs) + len(triples) > KEYS:
                yield rows()
    yield rows()


def language_models(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text") -> dict[str, Model]:
    """The models of all languages, from every text without signs of damage.

    All such texts are counted whole, equal ones once: in how many of a
    language's pieces each character is and how often, and in how many texts
    each word is (long words, and what is written without blanks, by parts of
    ``PART`` characters), and pairs and triples of words with a character beyond
    ASCII. A dictionary holds the ``WORDS`` of each that save most, the best ones
    last; none that a single text has, which it would tell itself by, or a share of
    texts below ``COMMON``.
    """
    rows = docs.select(F.col(lang_col).alias("l"), F.col(text_col).alias("t")).where(F.col("l").isNotNull() & ~F.col("l").isin("und", ""))
    clean = rows.where(~F.col("t").rlike(r"[^\x00-\x7F]") | ~F.col("t").rlike(_UNCLEAN))
    n = written(clean.distinct().mapInArrow(_counts, "l string, what string, x string, k bigint, m bigint").groupBy("l", "what", "x").agg(F.sum("k").alias("k"), F.sum("m").alias("m")), "languages")
    saves = F.col("k") * (F.octet_length("x") - 1)
    best = n.where("what IN ('w', 'p', 't') AND k > 1").withColumn("i", F.row_number().over(Window.partitionBy("l", "what").orderBy(saves.desc(), "x"))).where(F.col("i") <= WORDS)
    words, chars, size = dict[str, list[tuple[str, int, str]]](), dict[str, dict[str, tuple[int, int]]](), dict[str, tuple[int, int]]()
    # A language's characters and its dictionary: bounded by the alphabet and by WORDS.
    for r in n.where("what IN ('c', 'n')").collect():
        if r["what"] == "n":
            size[r["l"]] = (r["k"], r["m"])
        else:
            chars.setdefault(r["l"], {})[r["x"]] = (r["k"], r["m"])
    for r in best.select("l", "what", "x", "i", "k").collect():
        if r["k"] >= COMMON * size[r["l"]][1]:
            words.setdefault(r["l"], []).append((r["what"], -r["i"], r["x"]))
    return {l: Model(" ".join(x for *_, x in sorted(words.get(l, []))), k / PIECE, chars.get(l, {})) for l, (k, _) in sorted(size.items())}


def restored(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", models: dict[str, Model] | None = None) -> DataFrame:
    """``doc_id, damaged, chain, text_restored`` of every document with text.

    Each line that holds non-ASCII characters is described by every chain of
    decodings that fits its bytes; the cheapest wins: zstandard size with the
    language's dictionary, plus the cost of characters the language does not
    use and of torn words, plus the cost of the chain. ``damaged`` also holds
    where signs remain that nothing can undo (replacement characters, C1
    controls, lone lead bytes) and that are dearer than a letter in their place. Null text gives
    no row; empty and pure-ASCII text is never damaged. A null or unknown
    language is judged by all dictionaries. Repeated rows give repeated rows.
    """
    models = language_models(docs, lang_col=lang_col, text_col=text_col) if models is None else models

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(models)
        for b in sliced(batches, 1):
            ids, texts, langs = (b.column(i).to_pylist() for i in range(3))
            got = [judge.restore(t, lang) for t, lang in zip(texts, langs, strict=True)]
            cols = list(zip(*got, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(list(c), t) for c, (_, t) in zip(cols, FIELDS[1:], strict=True))], names=[n for n, _ in FIELDS])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where(F.col("t").isNotNull())
    odd = F.col("t").rlike(r"[^\x00-\x7F]")
    plain = rows.where(~odd).select("doc_id", F.lit(False).alias("damaged"), F.lit(None).cast("string").alias("chain"), F.col("t").alias("text_restored"))
    return plain.unionByName(spread(rows.where(odd)).mapInArrow(run, SCHEMA))
