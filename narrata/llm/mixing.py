"""Problem 7: mix sources to target weights."""

from __future__ import annotations

import base64
import heapq
import math
import os
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata.llm.common import sliced
from narrata.session import spread, written

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern by which byte-level BPE vocabularies of this kind cut text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(docs: DataFrame, *, text_col: str = "text", tokenizer_path: str = TOKENIZER, pattern: str = PATTERN, out_col: str = "n_tokens") -> DataFrame:
    """``docs`` without its text (a public byte-level BPE vocabulary in tiktoken's format; the driver must hold the file), with the number of tokens of the whole text (null for null) and its digest ``text_key``."""
    rest = [c for c in docs.columns if c not in (text_col, out_col, "text_key")]
    width, name = len(rest) + 2, os.path.basename(tokenizer_path)
    # The driver's copy is shipped; executors need none of their own.
    docs.sparkSession.sparkContext.addFile(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in sliced(batches, width - 1):
            n = [None if t is None else len(enc.encode_ordinary(t)) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*b.schema.names[:-1], out_col])

    src = docs.select(*[F.col(f"`{c}`") for c in rest], F.unhex(F.md5(F.col(text_col))).alias("text_key"), F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + f", `{out_col}` bigint"
    return spread(src).mapInArrow(run, schema)


class Flow:
    """Minimum-cost maximum flow by successive shortest paths: Dijkstra with a heap and node potentials, all paths of a length at once."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.cap: list[float] = []
        self.cost: list[float] = []

    def add(self, a: int, b: int, cap: float, cost: float) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0.0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, s: int, t: int, least: float = 1e-6) -> float:
        total, height = 0.0, [0.0] * len(self.out)
        while True:
            dist, heap = [math.inf] * len(self.out), [(0.0, s)]
            dist[s] = 0.0
            while heap:
                d, a = heapq.heappop(heap)
                if d > dist[a]:
                    continue
                for e in self.out[a]:
                    b = self.to[e]
                    if self.cap[e] > least and (n := d + max(0.0, self.cost[e] + height[a] - height[b])) < dist[b] - 1e-12:
                        dist[b] = n
                        heapq.heappush(heap, (n, b))
            if dist[t] == math.inf:
                return total
            height = [h + min(d, dist[t]) for h, d in zip(height, dist, strict=True)]
            total += self._fill(s, t, height, least)

    def _fill(self, s: int, t: int, height: list[float], least: float) -> float:
        """A blocking flow along edges of no reduced cost."""
        total, nth = 0.0, [0] * len(self.out)
        while True:
            path, on, a = list[int](), {s}, s
            while a != t:
                while nth[a] < len(self.out[a]):
                    e = self.out[a][nth[a]]
                    b = self.to[e]
                    if self.cap[e] > least and b not in on and abs(self.cost[e] + height[a] - height[b]) < 1e-9:
                        break
                    nth[a] += 1
                if nth[a] < len(self.out[a]):
                    path.append(e)
                    on.add(b)
                    a = b
                elif path:
                    on.discard(a)
                    a = self.to[path.pop() ^ 1]
                    nth[a] += 1
                else:
                    return total
            push = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= push
                self.cap[e ^ 1] += push
            total += push


def allocate(patterns: dict[tuple[str, ...], float], quotas: dict[str, float], repeats: dict[str, int]) -> dict[tuple[tuple[str, ...], int, str], float]:
    """Tokens by ``(pattern, n-th use, source)`` that fill the quotas with the least repetition.

    The n-th use of a token costs ``n - 1``, so costs are convex and every token
    is used once before any is used twice.
    """
    order = sorted(patterns)
    levels = [(p, r) for p in order for r in range(1, max(repeats[s] for s in p) + 1)]
    source = {s: 1 + len(levels) + i for i, s in enumerate(sorted(quotas))}
    sink = 1 + len(levels) + len(source)
    f, edges = Flow(sink + 1), {}
    for i, (p, r) in enumerate(levels):
        f.add(0, 1 + i, patterns[p], float(r - 1))
        for s in p:
            if r <= repeats[s]:
                edges[p, r, s] = f.add(1 + i, source[s], patterns[p], 0.0)
    for s, q in quotas.items():
        f.add(source[s], sink, q, 0.0)
    f.run(0, sink)
    return {k: f.cap[e ^ 1] for k, e in edges.items() if f.cap[e ^ 1] > 1e-6}


def largest_total(patterns: dict[tuple[str, ...], float], shares: dict[str, float], repeats: dict[str, int]) -> float:
    """The largest total at which every source that has documents fills its quota."""
    live = {s: w for s, w in shares.items() if w > 0 and any(s in p for p in patterns)}
    if not live:
        return 0.0
    lo, hi = 0.0, sum(t * max(repeats[s] for s in p) for p, t in patterns.items()) / sum(live.values())
    for _ in range(50):
        mid = (lo + hi) / 2
        want = {s: w * mid for s, w in live.items()}
        if sum(allocate(patterns, want, repeats).values()) >= sum(want.values()) * (1 - 1e-9) - 1e-3:
            lo = mid
        else:
            hi = mid
    return lo


def mixture(docs: DataFrame, targets: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total_tokens: float | None = None, seed: int = 17, tokenizer_path: str = TOKENIZER, max_patterns: int = 5_000, broadcast_rows: int = 200_000) -> DataFrame:
    """``doc_id, source, n_tokens, repeats``: the documents of the mixture, and how often each is used.

    ``targets(source, target_share, max_repeats)``. A document is a distinct
    text; one that lies under several sources may serve any of them. Texts are
    aggregated by the set of sources they lie under, a minimum-cost flow routes
    the tokens of these sets to the sources' quotas, and a seeded order of the
    texts says which are taken. ``total_tokens`` sets the size of the mixture;
    by default it is the largest at which every source that has documents
    reaches its share. A source that cannot fill its quota falls short, which
    :func:`shares` reports; nothing else takes its place.

    Null text, null source, sources without target, shares of 0 or null and
    ``max_repeats`` below 1 give no rows; empty texts have no tokens and are not
    taken. Repeated rows count once. The targets and the ``max_patterns`` largest
    sets of sources reach the driver; a text under any other set serves one of
    its sources, chosen by the seed, so every text keeps its chance.
    """
    spark = docs.sparkSession
    rows = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats >= 1").groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("r")).collect()
    share, repeats = {r["source"]: float(r["w"]) for r in rows}, {r["source"]: int(r["r"]) for r in rows}
    counted = token_counts(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")).where(F.col("source").isin(list(share)) & F.col("text").isNotNull() & F.col("doc_id").isNotNull()), tokenizer_path=tokenizer_path)
    by_source = counted.where("n_tokens > 0").groupBy("text_key", "source").agg(F.min("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"))
    texts = by_source.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("source", "doc_id"))).alias("under"), F.first("n_tokens").alias("n_tokens"))
    place = F.xxhash64(F.lit(seed), "text_key")
    texts = written(texts.select("text_key", "under", "n_tokens", F.concat_ws("\x1f", F.transform("under", lambda x: x["source"])).alias("pattern"), place.alias("place")), "texts")
    by_pattern = lambda: texts.groupBy("pattern").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"))
    seen = by_pattern().orderBy(F.desc("n"), "pattern").limit(max_patterns + 1).collect()
    if len(seen) > max_patterns:
        kept = spark.createDataFrame([(r["pattern"], True) for r in seen[:max_patterns]], "pattern string, kept boolean")
        one = F.element_at(F.split("pattern", "\x1f"), (F.pmod(F.xxhash64(F.lit(seed + 1), "text_key"), F.size(F.split("pattern", "\x1f"))) + 1).cast("int"))
        texts = texts.join(kept, "pattern", "left").withColumn("pattern", F.when(F.col("kept"), F.col("pattern")).otherwise(one)).drop("kept")
        texts = written(texts, "merged")
        # No more than the kept sets and one for each source.
        seen = by_pattern().collect()
    patterns = {tuple(r["pattern"].split("\x1f")): float(r["n"]) for r in seen}
    total = largest_total(patterns, share, repeats) if total_tokens is None else float(total_tokens)
    got = allocate(patterns, {s: w * total for s, w in share.items()}, repeats) if patterns else {}
    # Along a set's seeded order, each use is cut into one stretch for each source.
    stretches = []
    for p in sorted(patterns):
        for r in sorted({k[1] for k in got if k[0] == p}):
            here = [s for s in p if (p, r, s) in got]
            ends = [0.0]
            for s in here:
                ends.append(ends[-1] + got[p, r, s])
            stretches += [("\x1f".join(p), s, a, b) for s, (a, b) in zip(here, pairwise(ends), strict=True)]
    cut = spark.createDataFrame(stretches, "pattern string, source string, lo double, hi double")
    # Running totals in two steps, so that no set of sources is one task: by bucket of the order, then within.
    buckets = int(min(1 << 20, max(16, max((r["k"] for r in seen), default=0) // 20_000)))
    b = texts.withColumn("bucket", F.floor((F.col("place").cast("double") / 2.0**64 + 0.5) * buckets))
    sums = b.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("t"))
    before = sums.select("pattern", "bucket", F.coalesce(F.sum("t").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = Window.partitionBy("pattern", "bucket").orderBy("place", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    at = b.join(before, ["pattern", "bucket"]).withColumn("at", F.col("before") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    # A text belongs where its middle lies: rounding errs to either side alike.
    middle = F.col("at") + F.col("n_tokens") / 2.0
    used = at.join(F.broadcast(cut) if len(stretches) <= broadcast_rows else cut, "pattern").where((middle >= F.col("lo")) & (middle < F.col("hi")))
    out = used.groupBy("text_key", "source").agg(F.first("under").alias("under"), F.first("n_tokens").alias("n_tokens"), F.count("*").cast("int").alias("repeats"))
    return out.select(F.filter("under", lambda x: x["source"] == F.col("source"))[0]["doc_id"].alias("doc_id"), "source", "n_tokens", "repeats")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats, n_docs, tokens, actual_share, most_repeats`` of a mixture, sources without documents included."""
    t = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    m = mixed.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    all_ = m.agg(F.sum("tokens").alias("all"))
    j = t.join(m, "source", "left").crossJoin(F.broadcast(all_))
    return j.select("source", "target_share", "max_repeats", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.try_divide(F.col("tokens"), F.col("all")), F.lit(0.0)).alias("actual_share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
