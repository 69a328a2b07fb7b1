"""Problem 6: evaluation texts leaking into training text."""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import sliced
from narrata.session import spread, written

SCHEMA = "doc_id bigint, item_id bigint, words int, edits int, at_word int"
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,120}>|\\[nrt]")
_DROP = re.compile("[­͏​-‏⁠﻿'’`]")
_WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+")


def words(text: str) -> list[str]:
    """Words without case, punctuation, spacing, line breaks and markup (a Han or kana character is a word)."""
    if "<" in text or "\\" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(_DROP.sub("", text).casefold())


class _Hashes(dict):
    def __missing__(self, w: str) -> int:
        b = w.encode("utf-8", "surrogatepass")
        self[w] = h = (zlib.crc32(b) << 32 | zlib.crc32(b, 0x9E3779B9)) & 0x7FFFFFFFFFFFFFFF
        return h


class Walks:
    """CGK embeddings of all windows of a word array, and samples of them.

    A window is read step by step from its first word on; at each step the word
    under the reader is put out and a random bit, drawn for that step and word,
    says whether to move on. Two windows a few edits apart soon read in step
    again, so edit distance becomes Hamming distance; each repetition compares
    ``samples`` of its ``steps`` places.
    """

    def __init__(self, repetitions: int = 16, steps: int = 16, samples: int = 9, seed: int = 20) -> None:
        rng = np.random.default_rng(seed)
        self.steps = steps
        self.odd = rng.integers(1, 2**62, (repetitions, steps), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.take = [frozenset(rng.choice(np.arange(steps), samples, replace=False).tolist()) for _ in range(repetitions)]
        self.mix = rng.integers(1, 2**62, (repetitions, steps), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    @classmethod
    def reaching(cls, recall: float = 0.995, least: int = 15, one_in: int = 8, most: int = 64, trials: int = 2000, seed: int = 20) -> Walks:
        """As many repetitions as reach the recall on shortest runs with as many edits as may be.

        Runs of ``least`` words with (least + 1) / one_in random edits between
        random words are drawn; repetitions are added until that share of them
        has a signature in common with the original, at starts within the run.
        """
        w, rng = cls(most, seed=seed), np.random.default_rng(seed)
        missed = np.ones(trials, bool)
        a, b = [], []
        for _ in range(trials):
            word = rng.integers(1, 2**62, 4 * w.steps, dtype=np.uint64)
            run = word[:least].tolist()
            for _ in range((least + 1) // one_in):
                i, kind = int(rng.integers(1, len(run) - 1)), rng.integers(3)
                run[i : i + (kind < 2)] = [] if kind == 0 else [int(rng.integers(1, 2**62))]
            # What follows the run differs.
            a.append(np.concatenate((word[: least + w.steps], np.zeros(w.steps, np.uint64))))
            b.append(np.concatenate((np.array(run, np.uint64), word[2 * w.steps : 3 * w.steps + least - len(run)], np.zeros(w.steps, np.uint64))))
        x, y = np.concatenate(a), np.concatenate(b)
        pad = np.zeros(w.steps, np.uint64)
        size = len(a[0])
        for r in range(most):
            p, q = (w.signatures(np.concatenate((z, pad)), r).reshape(trials, size)[:, :least] for z in (x, y))
            missed &= ~(p[:, :, None] == q[:, None, :]).any((1, 2))
            if missed.mean() <= 1 - recall:
                break
        w.odd, w.take, w.mix = w.odd[: r + 1], w.take[: r + 1], w.mix[: r + 1]
        return w

    def signatures(self, h: np.ndarray, r: int) -> np.ndarray:
        """The sampled signature of the window at every place; ``h`` ends in ``steps`` padding words."""
        n = len(h) - self.steps
        at, sig = np.arange(n), np.zeros(n, np.uint64)
        last = max(self.take[r])
        for j in range(last + 1):
            w = h[at]
            if j in self.take[r]:
                sig = (sig ^ w) * self.mix[r, j]
                sig ^= sig >> np.uint64(29)
            if j < last:
                at = at + ((w * self.odd[r, j]) >> np.uint64(63)).astype(np.int64)
        return sig


def _marks(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """A filter of ``2 ** bits`` bits of whole numbers, built by the executors; at most that many bits reach the driver."""
    x = F.pmod(F.col(column), F.lit(1 << bits)) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(x).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("m")).collect()
    out = np.zeros(1 << bits >> 3, np.uint8)
    for r in rows:
        at = (r["b"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r["m"]), np.uint8)[: len(out) - at]
    return out


def _held(marks: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of the numbers the filter may hold."""
    x = x & np.uint64(8 * len(marks) - 1)
    return (marks[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 > 0


def likely(doc: np.ndarray, item: np.ndarray, at: np.ndarray, place: np.ndarray, least: int = 15, one_in: int = 8) -> np.ndarray:
    """Which hits can lie in a run that counts.

    A run of n words (``least``, or the whole of a shorter item) with at most
    (n + 1) / ``one_in`` edits has n - 1 - 2 edits pairs of neighbouring words in
    common, all within n - 1 places and that many diagonals of any hit in it; a
    longer run holds one of that length around any place. So nothing that counts
    is lost, as long as its hit lies in it.
    """
    n = min(least, len(item))
    edits = (n + 1) // one_in
    need, drift, around = max(1, n - 1 - 2 * edits), edits + 1, n + edits
    pad = np.zeros(around + drift + 2, np.uint64)
    pairs = lambda x: x[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[1:]
    a, b = pairs(np.concatenate((pad, doc, pad))), pairs(np.concatenate((pad, item, pad)))
    # Pairs that reach into padding equal nothing on the other side.
    for x, size, no in ((a, len(doc), 1), (b, len(item), 2)):
        x[: len(pad)] = no
        x[len(pad) + size - 1 :] = no
    i, j, steps = at + len(pad), place + len(pad), np.arange(-around, around + 1)
    ok = np.zeros(len(at), bool)
    for c in range(0, len(at), 4096):
        x = a[np.clip(i[c : c + 4096, None] + steps, 0, len(a) - 1)]
        same = np.zeros(x.shape, bool)
        for d in range(-drift, drift + 1):
            same |= x == b[np.clip(j[c : c + 4096, None] + steps + d, 0, len(b) - 1)]
        ok[c : c + 4096] = same.sum(1) >= need
    return ok


def shared_span(doc: list[int], item: list[int], least: int = 15, one_in: int = 8) -> tuple[int, int] | None:
    """``(words, edits)`` of the longest run of item words that the text holds.

    The run has at least ``least`` words (or the whole item), of which about one
    in ``one_in`` may be changed, dropped or inserted. By local alignment; the
    alignments are tried from the best score down until one holds a run.
    """
    n, m = len(item), len(doc)
    score = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        row, up, w = score[i], score[i - 1], item[i - 1]
        for j in range(1, m + 1):
            v = up[j - 1] + (1 if doc[j - 1] == w else -1)
            if up[j] - 1 > v:
                v = up[j] - 1
            if row[j - 1] - 1 > v:
                v = row[j - 1] - 1
            row[j] = v if v > 0 else 0
    tried: set[tuple[int, int]] = set()
    best = None
    need = min(least, n)
    # A run of that many words with so many edits scores at least this.
    floor = max(1, need - 2 * ((need + 1) // one_in))
    ends = sorted(((v, i, j) for i, row in enumerate(score) for j, v in enumerate(row) if v >= floor), reverse=True)
    for _, i, j in ends:
        if (i, j) in tried:
            continue
        ops: list[tuple[int, int]] = []
        while i and j and score[i][j] > 0 and (i, j) not in tried:
            tried.add((i, j))
            s = score[i][j]
            if s == score[i - 1][j - 1] + (1 if doc[j - 1] == item[i - 1] else -1):
                ops.append((1, 0 if doc[j - 1] == item[i - 1] else 1))
                i, j = i - 1, j - 1
            elif s == score[i - 1][j] - 1:
                ops.append((1, 1))
                i -= 1
            else:
                ops.append((0, 1))
                j -= 1
        if len(ops) < need:
            continue
        # The longest stretch of the alignment in which edits are rare enough.
        for a in range(len(ops)):
            if ops[a][1]:
                continue
            length = edits = 0
            for k, e in ops[a:]:
                length, edits = length + k, edits + e
                if not e and length >= need and edits * one_in <= length + 1 and (best is None or length > best[0]):
                    best = (length, edits)
        if best:
            break
    return best


def leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least_words: int = 15, one_in: int = 8, target_recall: float = 0.995, filter_bits: int = 26, item_chars: int = 32 << 20, walks: Walks | None = None) -> DataFrame:
    """``doc_id, item_id, words, edits, at_word``: documents that hold test items, or long parts of them.

    Windows have the length of the shortest run that counts. Every window of
    every document meets every window of the items through sampled CGK walks, as
    many as reach ``target_recall``: the items' signatures are a table and a
    filter of ``2 ** filter_bits`` bits; windows that the filter may hold are
    joined with the table by shuffle. Documents with hits are read again (found
    by a filter of their ids), and whatever meets is verified by alignment with
    the whole item. Null texts, null ids and texts without words take part in
    nothing; repeated rows count once; where an id has several texts, each
    counts; other columns are not read.
    """
    walks = walks or Walks.reaching(target_recall, least_words, one_in)
    asked = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct().withColumn("ih", F.xxhash64("t"))
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t")).where("d IS NOT NULL AND t IS NOT NULL").withColumn("dh", F.xxhash64("t"))
    rows, marks = spread(rows), np.zeros(0, np.uint8)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``s, id, h, at``: signatures of the windows of texts ``(id, text, h)``, of those the filter may hold."""
        hashes, pad = _Hashes(), np.zeros(walks.steps, np.uint64)
        for b in batches:
            for part in sliced(iter([b]), 1):
                texts = [words(t) for t in part.column(1).to_pylist()]
                if len(hashes) > 2_000_000:
                    hashes.clear()
                parts = [np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w)) for w in texts]
                flat = np.concatenate([x for p in parts for x in (p, pad)] or [pad])
                starts = np.cumsum([0, *[len(p) + walks.steps for p in parts]])
                # A walk covers about half as many words as it has steps; it starts where so many are left, or at the first word.
                inside = np.zeros(len(flat), bool)
                for at, p in zip(starts.tolist(), parts, strict=False):
                    inside[at : at + max(min(1, len(p)), len(p) - walks.steps // 2 + 1)] = True
                wide = np.concatenate((flat, pad))
                got_s, got_at = [], []
                for r in range(len(walks.take)):
                    s = (walks.signatures(wide, r) ^ np.uint64(r)) * walks.mix[r, 0]
                    s ^= s >> np.uint64(31)
                    at = np.flatnonzero(inside & _held(marks, s) if len(marks) else inside)
                    got_s.append(s[at])
                    got_at.append(at)
                s, at = np.concatenate(got_s), np.concatenate(got_at)
                own = np.searchsorted(starts, at, side="right") - 1
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), part.column(0).take(take), part.column(2).take(take), pa.array((at - starts[own]).astype(np.int32))], names=["s", "id", "h", "at"])

    schema = "s bigint, id bigint, h bigint, at int"
    known = written(asked.select("i", "t", "ih").mapInArrow(windows, schema), "signatures")
    marks = _marks(known, "s", filter_bits)
    met = rows.select("d", "t", "dh").mapInArrow(windows, schema).select("s", F.col("id").alias("d"), F.col("h").alias("dh"), "at")
    hits = met.join(known.select("s", F.col("id").alias("i"), F.col("h").alias("ih"), F.col("at").alias("place")), "s").groupBy("d", "dh", "i", "ih").agg(F.collect_set(F.struct("at", "place")).alias("hits"))
    hits = written(hits, "hits")
    here = _marks(hits.select("dh"), "dh", filter_bits)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_held(here, b.column(2).to_numpy().view(np.uint64))))

    texts = rows.select("d", "t", "dh").mapInArrow(again, "d bigint, t string, dh bigint").dropDuplicates(["d", "dh"])

    # Items are a stated set: their texts go along with the task up to a size that is checked, else with the pairs.
    small = (asked.agg(F.sum(F.length("t"))).first()[0] or 0) <= item_chars
    held = {(r["i"], r["ih"]): r["t"] for r in asked.collect()} if small else {}

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, item_words = _Hashes(), dict[tuple[int, int], np.ndarray]()
        as_array = lambda t: np.fromiter(map(hashes.__getitem__, w := words(t)), np.uint64, len(w))
        for b in batches:
            for part in sliced(iter([b]), 1):
                out = []
                for d, t, pairs in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                    doc = as_array(t)
                    for x in pairs:
                        if (item := item_words.get(key := (x["i"], x["ih"]))) is None:
                            if len(item_words) > 10_000:
                                item_words.clear()
                            item = item_words[key] = as_array(held[key] if small else x["it"])
                        at, place = (np.array([h[k] for h in x["hits"]], np.int64) for k in ("at", "place"))
                        keep = likely(doc, item, at, place, least_words, one_in)
                        if not keep.any():
                            continue
                        best, upto = None, None
                        # Each stretch of diagonals is aligned once, with room for all edits the item may have.
                        room = 16 + len(item) // one_in
                        for g in sorted(set((at[keep] - place[keep]).tolist())):
                            if upto is not None and g < upto:
                                continue
                            upto, begin = g + 8, max(0, g - room)
                            got = shared_span(doc[begin : g + 8 + len(item) + room].tolist(), item.tolist(), least_words, one_in)
                            if got and (best is None or got > best[:2]):
                                best = (*got, begin)
                        if best:
                            out.append((d, x["i"], *best))
                if len(hashes) > 2_000_000:
                    hashes.clear()
                cols = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "words", "edits", "at_word"])

    if small:
        pairs = hits.groupBy("d", "dh").agg(F.collect_list(F.struct("i", "ih", "hits")).alias("pairs")).join(texts, ["d", "dh"])
    else:
        pairs = hits.join(asked.withColumnRenamed("t", "it"), ["i", "ih"]).join(texts, ["d", "dh"]).withColumn("pairs", F.array(F.struct("i", "ih", "it", "hits")))
    found = pairs.select("d", "t", "pairs").mapInArrow(verified, SCHEMA)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("words", -F.col("edits"), -F.col("at_word"))).alias("x")).select("doc_id", "item_id", "x.words", (-F.col("x.col2")).alias("edits"), (-F.col("x.col3")).alias("at_word"))
