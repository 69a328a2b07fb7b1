"""Problem 4: one consistent form for text that looks the same."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from narrata.session import spread, written

# Letters of other scripts that look like the Latin letter beside them.
LOOKALIKES = {
    "Cyrillic": "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY ԚQ ԜW ӀI аa сc ԁd еe һh іi јj ӏl оo рp ԛq ѕs уy ѵv ԝw хx ҽe ԌG ԍG",
    "Greek": "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ιi ϳj ϲc ϹC ϺM",
    "Armenian": "օo Օo սu հh ոn ցg",
    "Latin": "ɑa ɡg ıi ȷj ſs ⅼl ǀl",
    "Cherokee": "ᎠD ᎡR ᎢT ᎥI ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᎽY ᏀG ᏃZ ᏒR ᏔW ᏕS ᏙV ᏚS ᏞL ᏟC ᏢP ᏦK ᏧD ᏴB",
    "Lisu": "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU",
    "Coptic": "ⲀA ⲂB ⲎH ⲒI ⲔK ⲘM ⲚN ⲞO ⲢP ⲤC ⲦT ⲨY ⲬX ⲟo ⲥc",
    "Punctuation": "‐-",
}
# Code points that print nothing, as (first, last).
INVISIBLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0x1D173, 0x1D17A), (0xE0001, 0xE007F), (0xE0100, 0xE01EF))
_SBASE, _LBASE, _VBASE, _TBASE = 0xAC00, 0x1100, 0x1161, 0x11A7
#: Small capitals that have the shape of the small letter; the others look like the capital.
_SAME_SMALL = "CFKOPSUVWXZ"


def _full(cp: int, loose: bool) -> list[int]:
    """Code point in fully decomposed form; full-width letters and digits, letters of another font, ligatures and letter-like compatibility forms open up too."""
    c = chr(cp)
    d = unicodedata.decomposition(c)
    kind = d[1 : d.index(">")] if d.startswith("<") else ""
    wide = unicodedata.normalize("NFKC", c)
    if kind in ("wide", "narrow") and wide.isalnum() or kind in ("font", "noBreak") and wide != " ":
        c = wide
    elif unicodedata.category(c) == "Zs":
        c = " "
    elif kind == "compat" and wide.isalpha() and not 0x600 <= cp < 0x2100 or cp == 0xB5:
        c = wide
    elif loose and kind:
        c = wide
    elif (name := unicodedata.name(c, "")).startswith("LATIN LETTER SMALL CAPITAL ") and len(name) == 28:
        c = name[-1].lower() if name[-1] in _SAME_SMALL else name[-1]
    out = [ord(x) for x in unicodedata.normalize("NFD", c)]
    return out if out == [cp] else [y for x in out for y in (_full(x, loose) if x != cp and x > 0x9F else [x])]


class Pages:
    """An array over all code points, of which only pages that differ from the rest are stored."""

    def __init__(self, values: dict[int, int], default: int, kind: type) -> None:
        pages = sorted({cp >> 8 for cp in values})
        self.index = np.zeros(0x1100, np.int32)
        self.index[pages] = np.arange(1, len(pages) + 1)
        self.data = np.full((len(pages) + 1, 256), default, kind)
        for cp, v in values.items():
            self.data[self.index[cp >> 8], cp & 255] = v

    def __getitem__(self, cp: np.ndarray) -> np.ndarray:
        return self.data[self.index[cp >> 8], cp & 255]


_MADE: dict[bool, dict] = {}


def tables(loose: bool = False) -> dict:
    """The mappings for every code point: fixed in size (some 200 KB), made by rule from the Unicode data, and shipped to every task.

    ``first``/``count`` index into ``parts`` (decomposition; 0 for a code point
    that stays); ``look`` maps a decomposed letter to the Latin letter it looks
    like; ``ccc`` is the class a combining mark is ordered by; ``pair``/``whole``
    recompose base and mark. ``loose`` opens every other compatibility form too
    (circled and squared letters, superscripts, full-width punctuation).
    """
    if loose in _MADE:
        return _MADE[loose]
    first, count, parts, ccc, pairs = dict[int, int](), dict[int, int](), list[int](), dict[int, int](), dict[int, int]()
    for cp in range(0xA0, 0x110000):
        c = chr(cp)
        if k := unicodedata.combining(c):
            ccc[cp] = k
        d = unicodedata.decomposition(c)
        # Hangul syllables stay whole; their letters are composed by rule.
        if not (d or 0x1D00 <= cp < 0x1D80 or 0x250 <= cp < 0x2B0 or 0xA720 <= cp < 0xA800 or unicodedata.category(c) == "Zs") or 0xAC00 <= cp < 0xD7A4:
            continue
        if (full := _full(cp, loose)) != [cp]:
            first[cp], count[cp] = len(parts), len(full)
            parts += full
        if d and d[0] != "<" and len(n := unicodedata.normalize("NFD", c)) > 1 and unicodedata.normalize("NFC", n) == c:
            b = unicodedata.normalize("NFC", n[:-1])
            if len(b) == 1 and unicodedata.combining(n[-1]):
                pairs[ord(b) << 32 | ord(n[-1])] = cp
    look = {ord(pair[0]): ord(pair[1]) for row in LOOKALIKES.values() for pair in row.split()}
    gone = {cp: 1 for a, b in INVISIBLE for cp in range(a, b + 1)}
    key = np.array(sorted(pairs), dtype=np.uint64)
    _MADE[loose] = {"first": Pages(first, 0, np.int32), "count": Pages(count, 0, np.int32), "parts": np.array(parts, np.uint32), "look": Pages(look, 0, np.uint32), "ccc": Pages(ccc, 0, np.uint8), "gone": Pages(gone, 0, bool), "pair": key, "whole": np.array([pairs[int(k)] for k in key], np.uint32)}
    return _MADE[loose]


def _compose(cp: np.ndarray, row: np.ndarray, ccc: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Join bases with the marks after them, mark by mark."""
    mark = ccc > 0
    at = np.arange(len(cp))
    base = np.maximum.accumulate(np.where(mark, -1, at))
    ok = mark & (base >= 0)
    ok &= row[np.maximum(base, 0)] == row
    nth = at - base
    keep, last = np.ones(len(cp), bool), np.zeros(len(cp), np.uint8)
    for k in range(1, int(nth[ok].max()) + 1 if ok.any() else 0):
        i = np.flatnonzero(ok & (nth == k))
        if not len(i):
            break
        b = base[i]
        key = cp[b].astype(np.uint64) << np.uint64(32) | cp[i].astype(np.uint64)
        p = np.minimum(np.searchsorted(t["pair"], key), len(t["pair"]) - 1)
        hit = (t["pair"][p] == key) & (last[b] < ccc[i])
        cp[b[hit]] = t["whole"][p[hit]]
        keep[i[hit]] = False
        last[b[~hit]] = ccc[i[~hit]]
    cp, row = cp[keep], row[keep]
    if ((cp >= _LBASE) & (cp < 0x1200)).any():
        for lead, n_lead, tail, n_tail in ((_LBASE, 19, _VBASE, 21), (_SBASE, 11172, _TBASE + 1, 27)):
            i = np.flatnonzero((cp[:-1] >= lead) & (cp[:-1] < lead + n_lead) & (cp[1:] >= tail) & (cp[1:] < tail + n_tail) & (row[:-1] == row[1:]))
            if lead == _LBASE:
                cp[i] = _SBASE + ((cp[i] - _LBASE) * 21 + cp[i + 1] - _VBASE) * 28
            else:
                i = i[(cp[i] - _SBASE) % 28 == 0]
                cp[i] += cp[i + 1] - _TBASE
            keep = np.ones(len(cp), bool)
            keep[i + 1] = False
            cp, row = cp[keep], row[keep]
    return cp, row


def canonical(texts: list[str], t: dict) -> list[str]:
    """The one form of each text.

    All texts become one array of code points with their row numbers; each step
    works on the whole array.
    """
    n = len(texts)
    if not n:
        return []
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(n), [len(x) for x in texts])
    many = t["count"][cp]
    opened = many > 0
    if opened.any():
        many = np.maximum(many, 1)
        start = np.repeat(np.cumsum(many) - many, many)
        src, inner = np.repeat(np.arange(len(cp)), many), np.arange(int(many.sum())) - start
        take = opened[src]
        out = cp[src]
        out[take] = t["parts"][t["first"][cp[src[take]]] + inner[take]]
        cp, row = out, row[src]
    look = t["look"][cp]
    cp = np.where(look > 0, look, cp).astype(np.uint32)
    gone = t["gone"][cp].copy()
    if len(cp):
        before = np.concatenate(([0], cp[:-1]))
        joiner = (cp == 0x200C) | (cp == 0x200D)
        shapes = (t["ccc"][before] == 9) | ((before >= 0x620) & (before < 0x750)) | ((before >= 0x2190) & (before < 0x2C00)) | (before >= 0x1F000) | (before == 0xFE0F)
        gone &= ~(joiner & shapes & np.concatenate(([False], row[1:] == row[:-1])))
        gone[:-1] |= (cp[:-1] == 13) & (cp[1:] == 10) & (row[:-1] == row[1:])
        cp, row = cp[~gone], row[~gone]
    ccc = t["ccc"][cp]
    if (ccc > 0).any():
        if ((ccc[:-1] > ccc[1:]) & (ccc[1:] > 0)).any():
            order = np.lexsort((ccc, np.cumsum((ccc == 0) | np.concatenate(([True], row[1:] != row[:-1])))))
            cp, row, ccc = cp[order], row[order], ccc[order]
        cp, row = _compose(cp.copy(), row, ccc, t)
    elif ((cp >= _LBASE) & (cp < 0x1200)).any():
        cp, row = _compose(cp.copy(), row, ccc, t)
    whole = cp.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    ends = np.cumsum(np.bincount(row, minlength=n)).tolist()
    return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


#: Characters that one array pass handles at most (one longer text is a pass of its own).
_PASS = 1 << 20


def canonical_column(texts: Iterator[pd.Series], t: dict) -> Iterator[pd.Series]:
    for s in texts:
        values, out, todo, size = s.tolist(), [None] * len(s), list[int](), 0
        for i, x in enumerate([*values, None]):
            last = i == len(values)
            if last or (x is not None and size + len(x) > _PASS):
                for j, y in zip(todo, canonical([values[j] for j in todo], t), strict=True):
                    out[j] = y
                todo, size = [], 0
            if not last and x is not None:
                todo.append(i)
                size += len(x)
        yield pd.Series(out, dtype=object)


def normalized(df: DataFrame, text_col: str = "text", out_col: str = "text_canonical", loose: bool = False) -> DataFrame:
    """``df`` with ``out_col``: the text in its one form.

    Spaces of any width become a space, invisible code points go (joiners stay
    where they shape Indic, Arabic or emoji sequences), full-width letters and
    digits, letters of another font, small capitals, ligatures and look-alike
    letters become plain letters, accents are
    ordered by class and recomposed, ``\\r\\n`` becomes ``\\n``. Case, accents,
    punctuation and line breaks stay; ``loose`` also opens circled letters,
    superscripts and full-width punctuation. Null stays null, empty stays empty. Text
    that is plain ASCII never leaves the JVM. ``out_col`` replaces a column of
    that name.
    """
    t = tables(loose)

    @pandas_udf("string")
    def form(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return canonical_column(texts, t)

    text = F.col(text_col)
    odd = text.rlike(r"[^\x00-\x7F]|\r\n")
    return df.withColumn(out_col, F.coalesce(form(F.when(odd, text)), text))


def _members(items: DataFrame, kind_col: str, id_col: str, text_col: str) -> DataFrame:
    """``kind, id, raw, form`` (digests) of items in classes with several stored texts."""
    src = items.select(F.col(kind_col).alias("kind"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t")).where(F.col("id").isNotNull() & F.col("t").rlike(r"\p{L}"))
    keyed = normalized(spread(src), "t", "c").select("kind", "id", F.unhex(F.md5("t")).alias("raw"), F.unhex(F.md5("c")).alias("form"))
    held = written(keyed, "forms")
    mixed = held.groupBy("kind", "form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("kind", "form")
    return written(held.join(mixed, ["kind", "form"], "left_semi"), "members")


def classes(items: DataFrame, *, kind_col: str = "item_kind", id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_kind, item_id, class_id, stored_id, variants``: every item whose text looks like another that is stored differently.

    ``class_id`` is the least id of all that look the same, ``stored_id`` the
    least of those stored alike, ``variants`` how many ways of storing it there
    are: one row an item, however many look alike. What takes no part in
    :func:`same_looking` takes none here.
    """
    members = _members(items, kind_col, id_col, text_col)
    stored = members.groupBy("kind", "form", "raw").agg(F.min("id").alias("stored_id"))
    whole = stored.groupBy("kind", "form").agg(F.min("stored_id").alias("class_id"), F.count("*").alias("variants"))
    out = members.join(stored, ["kind", "form", "raw"]).join(whole, ["kind", "form"])
    return out.select(F.col("kind").alias("item_kind"), F.col("id").alias("item_id"), "class_id", "stored_id", "variants").distinct()


def same_looking(items: DataFrame, *, kind_col: str = "item_kind", id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_kind, id_a, id_b``: items of a kind that look the same but are stored differently.

    Items meet on a 128-bit digest of their one form. Every stored text of a
    class is linked with each other one through its first id, and each further
    copy with the first ids of the other texts, so no link between different
    texts is lost and copies are not multiplied out. Null ids, null and letterless
    texts take no part; repeated rows count once.
    """
    members = _members(items, kind_col, id_col, text_col)
    texts = members.groupBy("kind", "form", F.col("raw").alias("raw2")).agg(F.min("id").alias("id2"))
    pairs = members.join(texts, ["kind", "form"]).where("raw <> raw2 AND id <> id2")
    return pairs.select(F.col("kind").alias("item_kind"), F.least("id", "id2").alias("id_a"), F.greatest("id", "id2").alias("id_b")).distinct()
