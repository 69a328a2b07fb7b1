"""Problem 3: the most similar vectors for every vector."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata.session import spread, written

#: Most bytes of centres that a task is sent.
CENTRE_BYTES = 32 << 20
_ROW = pa.schema([("g", pa.string()), ("key", pa.binary()), ("id", pa.string()), ("unit", pa.binary())])


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors at unit length, keyed by a digest of the stored vector."""
    for b in batches:
        t = pa.table(b)
        for n in set(t.column("n").to_pylist()):
            part = t.filter(pc.equal(t.column("n"), n)) if t.column("n").null_count == 0 else t
            v = part.column("v").combine_chunks()
            v = v.flatten() if isinstance(v, pa.ListArray) else pa.concat_arrays([c.flatten() for c in part.column("v").chunks])
            x = v.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
            with np.errstate(all="ignore"):
                size = np.sqrt((x * x).sum(1))
                big = ~np.isfinite(size) & np.isfinite(x).all(1)
                if big.any():
                    x[big] /= np.abs(x[big]).max(1, keepdims=True)
                    size[big] = np.sqrt((x[big] * x[big]).sum(1))
            ok = np.flatnonzero(np.isfinite(size) & (size > 0))
            if not len(ok):
                continue
            x = x[ok] + 0.0
            unit = (x / size[ok, None]).astype(np.float32)
            part = part.take(pa.array(ok))
            keys = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in x]
            group = [f"{g}|{n}" for g in part.column("g").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(keys, pa.binary()), part.column("id").combine_chunks(), pa.array([u.tobytes() for u in unit], pa.binary())], schema=_ROW)


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(int8 codes, scales, lengths of the rounding errors)`` of vectors."""
    scale = (np.maximum(np.abs(unit).max(1), 1e-30) / 127.0).astype(np.float32)
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    return code, scale, _error(unit - code * scale[:, None])


def refined(unit: np.ndarray, code: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(int8 codes of what rounding left, lengths of the errors that remain)``, in steps of a 254th of the scale."""
    rest = unit - code * scale[:, None]
    low = np.clip(np.rint(rest * (254.0 / scale[:, None])), -127, 127).astype(np.int8)
    return low, _error(rest - low * (scale[:, None] / 254.0))


def _error(rest: np.ndarray) -> np.ndarray:
    return (np.sqrt((rest.astype(np.float64) ** 2).sum(1)) + 1e-6).astype(np.float32)


def packed(code: np.ndarray, low: np.ndarray | None, scale: np.ndarray, err: np.ndarray) -> np.ndarray:
    parts = [code.view(np.uint8), *([] if low is None else [low.view(np.uint8)]), np.ascontiguousarray(scale)[:, None].view(np.uint8), np.ascontiguousarray(err)[:, None].view(np.uint8)]
    return np.concatenate(parts, axis=1)


def unpacked(raw: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """``(vectors as their codes give them, lengths of the errors)``."""
    scale, err = (np.ascontiguousarray(raw[:, x : x + 4]).view(np.float32).ravel() for x in (raw.shape[1] - 8, raw.shape[1] - 4))
    v = np.ascontiguousarray(raw[:, :d]).view(np.int8).astype(np.float32)
    if raw.shape[1] > d + 8:
        v += np.ascontiguousarray(raw[:, d : 2 * d]).view(np.int8).astype(np.float32) / np.float32(254.0)
    v *= scale[:, None]
    return v, err


class Blocks:
    """The cells that vectors of a group fall into; fitted on a sample, used for all."""

    def __init__(self, centres: np.ndarray, shares: np.ndarray, rows: int, reach: float, chunk_rows: int, crowded: np.ndarray) -> None:
        self.centres, self.reach = centres, reach
        # A crowded block tells its vectors apart only by finer codes.
        self.fine = crowded
        self.chunks = np.maximum(1, np.ceil(shares * rows / chunk_rows)).astype(np.int64)

    def visit(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(home cell of each, rows that visit, cells they visit)``.

        A vector visits each cell whose centre c is about as near as its own
        centre h: u(h - c) <= reach |h - c|. Of two similar vectors in different
        cells at least one visits the other, unless their difference lies
        unusually far along h - c.
        """
        home, who, where = np.empty(len(unit), np.int64), [], []
        for a in range(0, len(unit), 2048):
            u = unit[a : a + 2048]
            s = u @ self.centres.T
            h = s.argmax(1)
            top = s[np.arange(len(u)), h]
            home[a : a + len(u)] = h
            if not math.isfinite(self.reach):
                near = np.ones_like(s, bool)
            else:
                near = top[:, None] - s <= 2.0 * self.reach
            near[np.arange(len(u)), h] = False
            i, c = np.nonzero(near)
            if math.isfinite(self.reach):
                apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.einsum("ij,ij->i", self.centres[h[i]], self.centres[c])))
                keep = top[i] - s[i, c] <= self.reach * apart
                i, c = i[keep], c[keep]
            who.append(i + a)
            where.append(c)
        return home, np.concatenate(who) if who else np.empty(0, np.int64), np.concatenate(where) if where else np.empty(0, np.int64)


def _best(row: np.ndarray, value: np.ndarray, err: float, k: int) -> np.ndarray:
    """Which entries can still be among the k best of their row, given the error of each value."""
    if not len(row):
        return np.zeros(0, bool)
    order = np.lexsort((-value, row))
    r, v = row[order], value[order]
    first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
    size = np.diff(np.concatenate((first, [len(r)])))
    kth = v[first + np.minimum(size, k) - 1]
    kth[size < k] = -np.inf
    keep = np.zeros(len(row), bool)
    keep[order] = v + 2 * err >= np.repeat(kth, size)
    return keep


def tile(left: np.ndarray, err_a: np.ndarray, right: np.ndarray, err_b: np.ndarray, k: int, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, columns)`` of a tile that may be among the k nearest of either side.

    Products of int8 codes (scaled, in float32) lie within ``ea + eb + ea eb``
    of the true cosine, so nothing that belongs is lost. Where more than a few
    pairs of a strip pass, the k best seen so far raise each vector's bar, so a
    dense group costs its products and not its pairs.
    ``same``: both sides are the same vectors.
    """
    right = np.ascontiguousarray(right.T)
    slack = float(err_a.max() + err_b.max() + err_a.max() * err_b.max()) + 1e-5
    rows, cols, vals, full = [], [], [], 1 << 22
    # The k best seen by each side; they raise the bar once a region proves dense.
    col_best = None if same else np.full((k, right.shape[1]), -2.0, np.float32)
    step, wide = 2048, 4096
    for a in range(0, len(left), step):
        row_best = np.full((min(step, len(left) - a), k), -2.0, np.float32)
        for b in range(0, right.shape[1], wide):
            s = left[a : a + step] @ right[:, b : b + wide]
            if same and a < b + wide and b < a + step:
                i = np.arange(max(a, b), min(a + len(s), b + s.shape[1]))
                s[i - a, i - b] = -2.0
            bar = np.maximum(least, row_best.min(1) - slack)[:, None] - slack
            if not same:
                bar = np.minimum(bar, np.maximum(least, col_best[:, b : b + wide].min(0) - slack)[None, :] - slack)
            hit = s >= bar
            if np.count_nonzero(hit) > 4 * k * len(s):
                top = min(k, s.shape[1])
                row_best = np.partition(np.concatenate((row_best, np.partition(s, s.shape[1] - top, axis=1)[:, s.shape[1] - top :]), axis=1), top, axis=1)[:, -k:]
                bar = np.maximum(least, row_best.min(1) - slack)[:, None] - slack
                if not same:
                    top = min(k, len(s))
                    part = np.concatenate((col_best[:, b : b + wide], np.partition(s, len(s) - top, axis=0)[len(s) - top :]), axis=0)
                    col_best[:, b : b + wide] = np.partition(part, top, axis=0)[-k:]
                    bar = np.minimum(bar, np.maximum(least, col_best[:, b : b + wide].min(0) - slack)[None, :] - slack)
                hit = s >= bar
            hit &= s > -1.5
            i, c = np.nonzero(hit)
            rows.append(i + a)
            cols.append(c + b)
            vals.append(s[i, c])
        if sum(map(len, rows)) > full:
            i, c, v = (np.concatenate(x) for x in (rows, cols, vals))
            keep = _best(i, v, slack, k)
            if not same:
                keep |= _best(c, v, slack, k)
            rows, cols, vals = [i[keep]], [c[keep]], [v[keep]]
            full = max(full, 2 * len(rows[0]))
    i, c, v = (np.concatenate(x) for x in (rows, cols, vals))
    keep = _best(i, v, slack, k)
    if not same:
        keep |= _best(c, v, slack, k)
    return i[keep], c[keep]


def apart(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors of ``x``, in order, that are less similar than ``most`` to all taken before."""
    kept = x[:0]
    for a in range(0, len(x), 256):
        b = x[a : a + 256]
        if len(kept):
            b = b[(b @ kept.T).max(1) < most]
        near = b @ b.T >= most
        take: list[int] = []
        for i in range(len(b)):
            if not near[i, take].any():
                take.append(i)
        kept = np.concatenate((kept, b[take]))
    return kept


class Cells:
    """Cells of a group for lists without a least similarity: centres, the blocks they lie in, and how many to probe."""

    def __init__(self, centres: np.ndarray, share: np.ndarray, rows: int, block_rows: int) -> None:
        self.centres = centres
        self.block = halved(centres, share * rows, block_rows)
        load = np.bincount(self.block, share * rows)
        self.chunks = np.maximum(1, np.ceil(load / (2 * block_rows))).astype(np.int64)
        self.salts = np.ones(len(load), np.int64)
        self.probes = len(centres)

    def place(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(home cell, least similarity of the centres to probe)`` of each vector."""
        home, bar = np.empty(len(unit), np.int64), np.empty(len(unit), np.float32)
        for a in range(0, len(unit), 2048):
            s = unit[a : a + 2048] @ self.centres.T
            home[a : a + len(s)] = s.argmax(1)
            bar[a : a + len(s)] = np.partition(s, s.shape[1] - self.probes, axis=1)[:, s.shape[1] - self.probes]
        return home, bar


def halved(centres: np.ndarray, load: np.ndarray, most: int) -> np.ndarray:
    """A block for each centre: the set is cut in half along its widest direction until a block's load is at most ``most``."""
    block, todo, n = np.zeros(len(centres), np.int64), [np.arange(len(centres))], 0
    while todo:
        own = todo.pop()
        if len(own) == 1 or load[own].sum() <= most:
            block[own] = n
            n += 1
            continue
        x = centres[own] - centres[own].mean(0)
        along = x @ np.linalg.svd(x[:: max(1, len(x) // 512)], full_matrices=False)[2][0]
        order = own[np.argsort(along, kind="stable")]
        half = min(len(own) - 1, max(1, int(np.searchsorted(np.cumsum(load[order]), load[own].sum() / 2))))
        todo += [order[half:], order[:half]]
    return block


def k_means(sample: np.ndarray, want: int, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """``(centres at unit length, share of the sample in each cell)``."""
    centres = sample[:want].copy()
    for turn in range(rounds + 1):
        home = np.concatenate([(sample[a : a + 4096] @ centres.T).argmax(1) for a in range(0, len(sample), 4096)])
        count = np.bincount(home, minlength=len(centres))
        if turn == rounds:
            return centres, count / len(sample)
        total = np.zeros_like(centres)
        np.add.at(total, home, sample)
        size = np.linalg.norm(total, axis=1)
        centres = np.where(size[:, None] > 1e-6, total / np.maximum(size, 1e-6)[:, None], centres).astype(np.float32)
    raise AssertionError


def best_of(query: np.ndarray, near: np.ndarray, bar: np.ndarray, unit: np.ndarray, cell: np.ndarray, centres: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(queries, rows, similarities)``: the k best rows of each query within the cells it probes, if above its bar.

    Products of int8 codes (whole numbers, exact in float32 up to 1,040
    dimensions) bound the similarity from both sides; the k-th lower bound
    raises a query's bar from cell to cell, and what can still pass it is
    computed again in float. ``own``: which row each query is itself, if any.
    """
    code, scale, err = quantised(unit)
    q_code, q_scale, q_err = quantised(query)
    code, q_code = code.astype(np.float32), q_code.astype(np.float32)
    order = np.argsort(cell, kind="stable")
    cells, first = np.unique(cell[order], return_index=True)
    bounds = [*first.tolist(), len(order)]
    best, bar = np.full((len(query), k), -2.0, np.float32), bar.astype(np.float32).copy()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for x, c in enumerate(cells.tolist()):
        rows = order[bounds[x] : bounds[x + 1]]
        who = np.flatnonzero(query @ centres[c] >= near - 1e-6)
        for a in range(0, len(who), 4096):
            w = who[a : a + 4096]
            for b in range(0, len(rows), 4096):
                r = rows[b : b + 4096]
                s = q_code[w] @ code[r].T
                s *= q_scale[w][:, None]
                s *= scale[r]
                slack = q_err[w] * (1 + float(err[r].max())) + float(err[r].max()) + 1e-6
                if own is not None:
                    s[own[w][:, None] == r] = -2.0
                hit = s >= (bar[w] - slack)[:, None]
                if np.count_nonzero(hit) > k * len(w):
                    top = min(k, len(r))
                    low = np.partition(s, len(r) - top, axis=1)[:, len(r) - top :] - slack[:, None]
                    best[w] = np.partition(np.concatenate((best[w], low), axis=1), top, axis=1)[:, -k:]
                    bar[w] = np.maximum(bar[w], best[w].min(1))
                    hit = s >= (bar[w] - slack)[:, None]
                hit &= s > -1.5
                i, j = np.nonzero(hit)
                i, j = w[i], r[j]
                out.append((i, j, np.einsum("ij,ij->i", query[i], unit[j])))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    i, j, s = (np.concatenate(x) for x in zip(*out, strict=True))
    keep = s >= bar[i] - 2e-6
    i, j, s = i[keep], j[keep], s[keep]
    order = np.lexsort((-s, i))
    i, j, s = i[order], j[order], s[order]
    nth = np.arange(len(i)) - np.concatenate(([0], np.flatnonzero(np.diff(i)) + 1, [len(i)]))[np.cumsum(np.concatenate(([0], np.diff(i) > 0))).astype(int)] if len(i) else i
    # Ties at the k-th place stay, for ids to decide.
    kth = np.full(len(query), np.inf, np.float32)
    np.minimum.at(kth, i[nth < k], s[nth < k])
    keep = s >= kth[i] - 1e-7
    return i[keep], j[keep], s[keep]


def _units(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    n = len(col)
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(n, -1) if n else np.empty((0, 1), np.float32)


def _spot(keys: list[bytes]) -> np.ndarray:
    """Whole numbers from keys, to place rows by."""
    return np.frombuffer(b"".join(x[:8] for x in keys), np.int64) & np.int64(0x7FFFFFFFFFFFFFFF)


def _sampled(classes: DataFrame, sizes: dict[str, int], want: dict[str, int]) -> dict[str, np.ndarray]:
    """``want`` unit vectors of each group, by order of their keys; one pass for all groups."""
    if not want:
        return {}
    # Keys are digests, so a first share of them is a sample; twice the rows wanted, then the first of them.
    part = F.coalesce(*[F.when(F.col("g") == g, F.lit(min(1.0, 2.0 * w / sizes[g]))) for g, w in want.items()]) if len(want) <= 64 else None
    if part is None:
        part = classes.sparkSession.createDataFrame([(g, min(1.0, 2.0 * w / sizes[g])) for g, w in want.items()], "g string, part double")
        rows = classes.join(F.broadcast(part), "g")
    else:
        rows = classes.withColumn("part", part)
    place = F.conv(F.substring(F.hex("key"), 1, 8), 16, 10).cast("double") / 4294967296.0
    rows = rows.where(place < F.col("part")).withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("key")))
    limit = {g: w for g, w in want.items()}
    got: dict[str, list[bytes]] = {}
    for r in rows.select("g", "r", "unit").orderBy("g", "r").collect():
        if r["r"] <= limit[r["g"]]:
            got.setdefault(r["g"], []).append(r["unit"])
    return {g: np.frombuffer(b"".join(v), np.float32).reshape(len(v), -1) for g, v in got.items()}


def _lists(classes: DataFrame, *, k: int, cell_rows: int, max_cells: int, block_rows: int, min_probes: int, target_recall: float, tune_queries: int) -> DataFrame:
    """``g, a, b, s``: for each class its k nearest others (and ties), by cells."""
    total = classes.count()
    # Small groups are one cell; so at most ``max_cells / 4`` groups need centres.
    least = max(4 * cell_rows, total * 4 // max_cells)
    sizes = {r["g"]: r["count"] for r in classes.groupBy("g").count().where(F.col("count") >= least).collect()}
    # Centres go to every task: at most ``max_cells`` of them, and at most CENTRE_BYTES.
    want = {g: max(2, min(n // cell_rows, max_cells * n // total, CENTRE_BYTES // (4 * int(g.rpartition("|")[2])) * n // total)) for g, n in sizes.items()}
    samples = _sampled(classes, sizes, {g: 4 * w for g, w in want.items()})
    cells, asked = dict[str, Cells](), dict[str, np.ndarray]()
    for g, x in samples.items():
        rows = max(1, min(block_rows, (64 << 20) // (4 * x.shape[1])))
        c = cells[g] = Cells(*k_means(x, min(want[g], len(x))), sizes[g], rows)
        c.probes = min(len(c.centres), min_probes)
        if c.probes < len(c.centres):
            asked[g] = x[-max(16, tune_queries * sizes[g] // total) :]

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each query of the tuning set the k best rows of this partition, and how many centres are nearer than theirs."""
        best: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            t = pa.table(b)
            for g in set(t.column("g").to_pylist()) & set(asked):
                u = _units(t.filter(pc.equal(t.column("g"), g)).column("unit"))
                q, c = asked[g], cells[g].centres
                s = u @ q.T
                s[s > 1 - 1e-6] = -2.0  # itself
                top = min(k, len(u))
                i = np.argpartition(-s, top - 1, axis=0)[:top]
                v = np.take_along_axis(s, i, 0)
                home = (u[i.ravel()] @ c.T).argmax(1).reshape(i.shape)
                near = q @ c.T
                rank = (near[None] > np.take_along_axis(near, home.T, 1).T[:, :, None]).sum(2)
                if g in best:
                    v, rank = np.concatenate((best[g][0], v)), np.concatenate((best[g][1], rank))
                    i = np.argpartition(-v, min(k, len(v)) - 1, axis=0)[:k]
                    v, rank = np.take_along_axis(v, i, 0), np.take_along_axis(rank, i, 0)
                best[g] = v, rank
        for g, (v, rank) in best.items():
            q = np.tile(np.arange(v.shape[1]), len(v))
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(q)), pa.array(q, pa.int32()), pa.array(v.ravel().astype(np.float64)), pa.array(rank.ravel(), pa.int32())], names=["g", "q", "s", "rank"])

    if asked:
        seen = classes.select("g", "unit").mapInArrow(ranks, "g string, q int, s double, rank int")
        seen = seen.withColumn("r", F.row_number().over(Window.partitionBy("g", "q").orderBy(F.desc("s"), "rank"))).where(F.col("r") <= k)
        need = seen.groupBy("g").agg(F.percentile("rank", F.lit(target_recall)).alias("need")).collect()
        for r in need:
            cells[r["g"]].probes = min(len(cells[r["g"]].centres), max(min_probes, int(math.ceil(r["need"])) + 1))
    alone = max(1, -(-least // (2 * block_rows)))

    def residents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.table(b)
            for g in set(t.column("g").to_pylist()):
                part = t.filter(pc.equal(t.column("g"), g))
                spot = _spot(part.column("key").to_pylist())
                if c := cells.get(g):
                    home, near = c.place(_units(part.column("unit")))
                    block, chunk = c.block[home], spot % c.chunks[c.block[home]]
                else:
                    home, near, block, chunk = np.zeros(len(spot), np.int64), np.full(len(spot), -2, np.float32), np.zeros(len(spot), np.int64), spot % alone
                yield pa.RecordBatch.from_arrays([part.column("g").combine_chunks(), pa.array(block, pa.int32()), pa.array(chunk, pa.int32()), pa.array(home, pa.int32()), pa.array(near, pa.float32()), part.column("key").combine_chunks(), part.column("unit").combine_chunks()], names=["g", "block", "chunk", "cell", "near", "key", "unit"])

    placed = written(classes.select("g", "key", "unit").mapInArrow(residents, "g string, block int, chunk int, cell int, near float, key binary, unit binary"), "placed")

    def found(keys_q: list, keys_r: list, i: np.ndarray, j: np.ndarray, s: np.ndarray) -> list[pa.Array]:
        return [pa.array([keys_q[x] for x in i.tolist()], pa.binary()), pa.array([keys_r[x] for x in j.tolist()], pa.binary()), pa.array(s.astype(np.float64))]

    def centres_of(g: str, unit: np.ndarray) -> np.ndarray:
        c = cells.get(g)
        return c.centres if c else np.zeros((1, unit.shape[1]), np.float32)

    def at_home(t: pa.Table) -> pa.Table:
        """Lists within a block and chunk; ``b`` null: the vector itself, with the bar that others must pass."""
        g, unit, keys, near = t.column("g")[0].as_py(), _units(t.column("unit")), t.column("key").to_pylist(), t.column("near").to_numpy()
        i, j, s = best_of(unit, near, np.full(len(unit), -2.0), unit, t.column("cell").to_numpy(), centres_of(g, unit), k, np.arange(len(unit)))
        kth = np.full(len(unit), -2.0)
        n = np.bincount(i, minlength=len(unit))
        low = np.full(len(unit), 2.0)
        np.minimum.at(low, i, s)
        kth[n >= k] = low[n >= k]
        a, b, v = found(keys, keys, i, j, s)
        lists = pa.table({"g": pa.array([g] * len(a), pa.string()), "block": pa.nulls(len(a), pa.int32()), "chunk": pa.nulls(len(a), pa.int32()), "near": pa.nulls(len(a), pa.float32()), "a": a, "b": b, "s": v, "unit": pa.nulls(len(a), pa.binary())})
        rest = pa.table({"g": t.column("g"), "block": t.column("block"), "chunk": t.column("chunk"), "near": t.column("near"), "a": t.column("key"), "b": pa.nulls(len(unit), pa.binary()), "s": pa.array(kth), "unit": t.column("unit")})
        return pa.concat_tables([lists, rest.cast(lists.schema)])

    first = written(placed.groupBy("g", "block", "chunk").applyInArrow(at_home, "g string, block int, chunk int, near float, a binary, b binary, s double, unit binary"), "home")

    def leaving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The other blocks and chunks that hold cells a vector probes; a bar of 1 nothing can pass."""
        for b in batches:
            t = pa.table(b)
            for g in set(t.column("g").to_pylist()):
                part = t.filter(pc.and_(pc.equal(t.column("g"), g), pc.less(t.column("s"), 1 - 1e-6)))
                n, c = part.num_rows, cells.get(g)
                if not n or (c is None and alone == 1):
                    continue
                unit, home, chunk, near = _units(part.column("unit")), part.column("block").to_numpy(), part.column("chunk").to_numpy(), part.column("near").to_numpy()
                if c:
                    who, block = [], []
                    for a in range(0, n, 2048):
                        i, cell = np.nonzero(unit[a : a + 2048] @ c.centres.T >= near[a : a + 2048, None] - 1e-6)
                        pair = np.unique(np.stack((i + a, c.block[cell]), 1), axis=0)
                        who.append(pair[:, 0])
                        block.append(pair[:, 1])
                    who, block = np.concatenate(who), np.concatenate(block)
                    times = c.chunks[block]
                else:
                    who, block, times = np.arange(n), np.zeros(n, np.int64), np.full(n, alone)
                src = np.repeat(np.arange(len(who)), times)
                to = np.arange(len(src)) - np.repeat(np.cumsum(times) - times, times)
                who, block = who[src], block[src]
                keep = (block != home[who]) | (to != chunk[who])
                who, block, to = who[keep], block[keep], to[keep]
                take = part.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([take.column("g").combine_chunks(), pa.array(block, pa.int32()), pa.array(to, pa.int32()), pa.array(np.full(len(who), -1), pa.int32()), take.column("near").combine_chunks(), take.column("s").combine_chunks(), take.column("a").combine_chunks(), take.column("unit").combine_chunks()], names=["g", "block", "chunk", "cell", "near", "bar", "key", "unit"])

    schema = "g string, block int, chunk int, cell int, near float, bar double, key binary, unit binary"
    visits = written(first.where("b IS NULL").mapInArrow(leaving, schema), "visits")
    # A block that very many visit is served by several tasks.
    crowd = visits.groupBy("g", "block", "chunk").count().where(F.col("count") > 16 * block_rows).withColumn("salts", F.ceil(F.col("count") / (16.0 * block_rows)).cast("int")).drop("count")
    salts = F.coalesce("salts", F.lit(1))
    here = placed.withColumn("bar", F.lit(0.0)).select(*visits.columns).join(crowd, ["g", "block", "chunk"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    there = visits.join(crowd, ["g", "block", "chunk"], "left").withColumn("salt", F.pmod(F.xxhash64("key"), salts).cast("int"))

    def away(t: pa.Table) -> pa.Table:
        cell = t.column("cell").to_numpy()
        live, out = t.filter(pa.array(cell >= 0)), t.filter(pa.array(cell < 0))
        g = t.column("g")[0].as_py()
        if not live.num_rows or not out.num_rows:
            i = j = s = np.empty(0, np.int64)
        else:
            unit, query = _units(live.column("unit")), _units(out.column("unit"))
            i, j, s = best_of(query, out.column("near").to_numpy(), out.column("bar").to_numpy(), unit, live.column("cell").to_numpy(), centres_of(g, unit), k)
        a, b, v = found(out.column("key").to_pylist(), live.column("key").to_pylist(), i, j, s)
        return pa.table({"g": pa.array([g] * len(a), pa.string()), "a": a, "b": b, "s": v})

    second = here.unionByName(there).drop("salts").groupBy("g", "block", "chunk", "salt").applyInArrow(away, "g string, a binary, b binary, s double")
    return first.where("b IS NOT NULL").select("g", "a", "b", "s").unionByName(second)


def _within(classes: DataFrame, *, k: int, min_similarity: float, deviations: float, cell_rows: int, max_cells: int, chunk_rows: int, fine_rows: int) -> tuple[DataFrame, DataFrame]:
    """``(pairs g, a, b, s, classes that take part)``: pairs of classes at least that similar, with what each needs for its k nearest."""
    blocks: dict[str, Blocks] = {}
    total = classes.count()
    # Small groups are one cell; so at most ``max_cells / 4`` groups need centres.
    least = max(4 * cell_rows, total * 4 // max_cells)
    sizes = {r["g"]: r["count"] for r in classes.groupBy("g").count().where(F.col("count") >= least).collect()}
    want = {g: min(max_cells * n // total, 1 << max(0, round(math.log2(n / cell_rows)))) for g, n in sizes.items()}
    samples = _sampled(classes, sizes, {g: 2 * w for g, w in want.items()})
    for g, unit in samples.items():
        n, d = sizes[g], unit.shape[1]
        # Near-equal centres are one: a dense group is one block, spread over tasks in chunks.
        centres, rest = apart(unit[0::2], 1 - (1 - min_similarity) / 2), unit[1::2]
        home = (rest @ centres.T).argmax(1)
        share = np.bincount(home, minlength=len(centres)) / max(1, len(rest))
        # How many neighbours a vector of the block has, as far as the sample tells.
        near = np.concatenate([(rest[a : a + 1024] @ unit[0::2].T >= min_similarity - 0.02).sum(1) for a in range(0, max(1, len(rest)), 1024)])
        each = np.bincount(home, near, len(centres)) / np.maximum(1, np.bincount(home, minlength=len(centres))) * n / max(1, len(unit[0::2]))
        crowded = (each > 4 * k) | (share * n > fine_rows)
        blocks[g] = Blocks(centres, share, n, deviations * math.sqrt(2 * (1 - min_similarity)) / (2 * math.sqrt(d)), chunk_rows, crowded)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.table(b)
            for g in set(t.column("g").to_pylist()):
                part = t.filter(pc.equal(t.column("g"), g))
                keys = part.column("key").combine_chunks()
                h = _spot(keys.to_pylist())
                unit = _units(part.column("unit"))
                code, scale, err = quantised(unit)
                bl = blocks.get(g) or Blocks(np.ones((1, unit.shape[1]), np.float32), np.ones(1), least, math.inf, chunk_rows, np.zeros(1, bool))
                home, who, where = bl.visit(unit)
                own, chunks = np.arange(len(h)), bl.chunks
                # In a block of several chunks a row lives in one and visits all.
                mine = (h >> 8) % chunks[home]
                src, cell, chunk, live = [own], [home], [mine], [np.ones(len(h), bool)]
                for s, c in ((own, home), (who, where)):
                    times = chunks[c]
                    i = np.repeat(np.arange(len(s)), times)
                    nth = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
                    # Of two chunks of its own block, one row of each pair visits the other's.
                    ahead = (nth - mine[s[i]]) % chunks[c[i]]
                    keep = np.ones(len(i), bool) if s is who else (ahead > 0) & (ahead <= chunks[c[i]] // 2)
                    src.append(s[i[keep]])
                    cell.append(c[i[keep]])
                    chunk.append(nth[keep])
                    live.append(np.zeros(int(keep.sum()), bool))
                src, cell, chunk, live = (np.concatenate(x) for x in (src, cell, chunk, live))
                low, err2 = refined(unit, code, scale) if bl.fine.any() else (None, err)
                fine = bl.fine[np.minimum(cell, len(bl.fine) - 1)]
                for some, p in ((np.flatnonzero(~fine), packed(code, None, scale, err)), (np.flatnonzero(fine), packed(code, low, scale, err2))):
                    if not len(some):
                        continue
                    x = src[some]
                    buf, width = pa.py_buffer(p[x].tobytes()), p.shape[1]
                    offsets = pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int32).tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g] * len(x)), pa.array(cell[some].astype(np.int32)), pa.array(chunk[some].astype(np.int32)), pa.array(live[some]), keys.take(pa.array(x)), pa.Array.from_buffers(pa.binary(), len(x), [None, offsets, buf])],
                        names=["g", "cell", "chunk", "live", "key", "p"],
                    )

    def tiles(t: pa.Table) -> pa.Table:
        g, keys = t.column("g")[0].as_py(), t.column("key").to_pylist()
        live = t.column("live").to_numpy(zero_copy_only=False)
        raw = np.frombuffer(b"".join(t.column("p").to_pylist()), np.uint8).reshape(len(keys), -1)
        v, err = unpacked(raw, int(g.rpartition("|")[2]))
        found, own = set[tuple[bytes, bytes]](), np.flatnonzero(live)
        for side in (own, np.flatnonzero(~live)):
            if len(own) and len(side):
                i, c = tile(v[side], err[side], v[own], err[own], k, min_similarity, side is own)
                found |= {(x, y) if x < y else (y, x) for x, y in zip((keys[z] for z in side[i].tolist()), (keys[z] for z in own[c].tolist()), strict=True) if x != y}
        return pa.table({"g": pa.array([g] * len(found), pa.string()), "a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    placed = classes.select("g", "key", "unit").mapInArrow(visits, "g string, cell int, chunk int, live boolean, key binary, p binary")
    pairs = written(placed.groupBy("g", "cell", "chunk").applyInArrow(tiles, "g string, a binary, b binary").distinct(), "pairs")
    # Survivors again, from the vectors.
    part = classes.join(pairs.select("g", F.col("a").alias("key")).union(pairs.select("g", "b")).distinct(), ["g", "key"], "left_semi").select("g", "key", "id", "many", "unit")
    part = written(part, "survivors")

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = _units(b.column(3)).astype(np.float64), _units(b.column(4)).astype(np.float64)
            s = np.einsum("ij,ij->i", x, y) / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y)), 1e-300)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.clip(s, -1.0, 1.0))], names=["g", "a", "b", "s"])

    va, vb = part.select("g", F.col("key").alias("a"), F.col("unit").alias("ua")), part.select("g", F.col("key").alias("b"), F.col("unit").alias("ub"))
    scored = pairs.join(va, ["g", "a"]).join(vb, ["g", "b"]).select("g", "a", "b", "ua", "ub").mapInArrow(cosines, "g string, a binary, b binary, s double")
    return scored.where(F.col("s") >= min_similarity), part


def nearest(vectors: DataFrame, *, id_col: str, vector_col: str, group_col: str, k: int = 5, dim: int | None = None, min_similarity: float | None = None, deviations: float = 3.5, cell_rows: int = 256, max_cells: int = 16_384, chunk_rows: int = 65_536, fine_rows: int = 4096, block_rows: int = 32_768, min_probes: int = 64, target_recall: float = 0.97, tune_queries: int = 256) -> DataFrame:
    """``group, id, neighbour_id, rank, similarity``: the k most similar vectors of the same group.

    A block matrix join: vectors fall into cells around ``rows / cell_rows``
    centres (at most ``max_cells`` over all groups, fitted on a bounded sample by
    order of the vectors' digests; every vector is placed and searched). Tiles of
    int8 products bound the similarities; what survives is computed again in
    float, and the lists of all tiles are merged.

    Without ``min_similarity`` every vector gets its k nearest. It first meets
    its own block of cells, which sets a bar, and then every other block that
    holds one of the ``probes`` centres nearest to it. ``probes`` is measured:
    the k nearest of ``tune_queries`` sampled vectors are found exactly among all
    rows, and so many centres are probed that ``target_recall`` of them lie in
    probed cells (at least ``min_probes``, so that groups of up to ``min_probes
    * cell_rows`` rows are searched whole and exactly). A vector whose k-th
    neighbour is nearer than 1 - 1e-6 looks no further.

    With ``min_similarity`` only neighbours at least that similar are listed and
    tiles that cannot hold one are skipped: a pair is lost only if its
    difference lies more than ``deviations`` standard deviations along the line
    between its two centres. Blocks of more than ``chunk_rows`` rows are spread
    over several tasks.

    Equal stored vectors form a class that is searched once (by a 128-bit
    digest); among equal similarities the smaller id comes first. Vectors that
    are null, empty, zero, hold null, NaN or infinity, or are not of length
    ``dim`` (if given) take no part, nor do null ids and groups; different
    lengths never meet. Repeated rows count once; other columns are not read.
    """
    rows = vectors.select(F.col(group_col).cast("string").alias("g"), F.col(id_col).cast("string").alias("id"), F.size(vector_col).alias("n"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("g").isNotNull() & F.col("id").isNotNull() & ((F.col("n") == dim) if dim else (F.col("n") > 0)))
    prepared = spread(rows).mapInArrow(_prepared, "g string, key binary, id string, unit binary")
    # Classes of equal vectors: most have one member; only the others are kept as such.
    classes = prepared.groupBy("g", "key").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.first("unit").alias("unit"))
    classes = written(classes.select("g", "key", "id", (F.col("id") != F.col("last")).alias("many"), "unit"), "classes")
    if min_similarity is None:
        directed = _lists(classes, k=k, cell_rows=cell_rows, max_cells=max_cells, block_rows=block_rows, min_probes=min_probes, target_recall=target_recall, tune_queries=tune_queries)
        both, part = written(directed, "scored"), classes
    else:
        scored, part = _within(classes, k=k, min_similarity=min_similarity, deviations=deviations, cell_rows=cell_rows, max_cells=max_cells, chunk_rows=chunk_rows, fine_rows=fine_rows)
        both = written(scored.unionByName(scored.select("g", F.col("b").alias("a"), F.col("a").alias("b"), "s")), "scored")
    # Members of classes with several; the first k + 1 stand for the rest in others' lists.
    keys = classes.where("many").select("g", "key")
    members = written(prepared.select("g", "key", "id").join(keys, ["g", "key"], "left_semi").distinct(), "members")
    by_id = Window.partitionBy("g", "key").orderBy("id")
    few = members.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1).select("g", F.col("key").alias("b"), "id")
    single = part.where("NOT many").select("g", F.col("key").alias("b"), "id")
    near = both.join(few.unionByName(single), ["g", "b"]).select("g", "a", "id", "s")
    own = few.select("g", F.col("b").alias("a"), "id", F.lit(1.0).alias("s"))
    ranked = near.unionByName(own).withColumn("r", F.row_number().over(Window.partitionBy("g", "a").orderBy(F.desc("s"), "id"))).where(F.col("r") <= k + 1)
    lists = ranked.groupBy("g", "a").agg(F.array_sort(F.collect_list(F.struct(F.col("r"), F.col("id"), F.col("s")))).alias("near"))
    everyone = members.select("g", F.col("key").alias("a"), F.col("id").alias("me")).unionByName(single.select("g", F.col("b").alias("a"), F.col("id").alias("me")))
    out = everyone.join(lists, ["g", "a"]).select("g", "me", F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("me")), 1, k)).alias("p", "x"))
    return out.select(F.regexp_replace("g", r"\|\d+$", "").alias("group"), F.col("me").alias("id"), F.col("x.id").alias("neighbour_id"), (F.col("p") + 1).alias("rank"), F.col("x.s").alias("similarity"))
