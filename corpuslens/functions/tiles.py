"""All-pairs work in tiles, without ever emitting the pairs.

A corpus of n vectors is cut into blocks of bounded size by a hash of the
document id. Each unordered pair of blocks is one group (a tile) that holds at
most two blocks; a kernel turns the tile's distance matrix into per-document or
per-tile aggregates, which Spark then merges. The tile count follows from the
corpus size, so a large corpus gives more tiles, never larger ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MAX_ROWS = 32768  # rows of the largest block: a row is copied once per block of its corpus
PAIR_ROWS = 4096  # the same where a whole tile of pairs is held at once
MIN_ROWS = 256    # below this a block is not worth a task
BLOCKS = 8        # blocks wanted for a corpus in between
CELLS = 1 << 22   # entries of a distance matrix held at once
PIECE = 512       # rows and columns of the pieces that a tile is worked off in
MAX_TASKS = 4096  # tasks that tiles are dealt to at most
DIGITS = 10       # distances are compared after rounding to this many digits


@dataclass
class Block:
    """Rows of one block, ordered by document id."""

    id: np.ndarray
    label: np.ndarray
    v: np.ndarray
    extra: dict

    def take(self, lo, hi):
        return Block(self.id[lo:hi], self.label[lo:hi], self.v[lo:hi],
                     {k: x[lo:hi] for k, x in self.extra.items()})

    def __len__(self):
        return len(self.id)


def matrix(col: pa.ChunkedArray) -> np.ndarray:
    """List column to a dense float64 matrix."""
    a = col.combine_chunks()
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1)


def block_of(tbl: pa.Table, extras=()) -> Block:
    tbl = tbl.sort_by("doc_id")
    label = tbl["label"].to_numpy()
    return Block(tbl["doc_id"].to_numpy(), label, matrix(tbl["v"]), {e: tbl[e].to_numpy() for e in extras})


def _blocks(points: DataFrame, keys, most: int) -> DataFrame:
    """(keys, _n, _nb): corpus size and its number of blocks of at most about ``most`` rows."""
    n = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = F.least(F.lit(most), F.greatest(F.lit(MIN_ROWS), F.ceil(F.col("_n") / BLOCKS)))
    return n.withColumn("_nb", F.ceil(F.col("_n") / rows).cast("int"))


def with_blocks(points: DataFrame, keys, most: int = MAX_ROWS) -> DataFrame:
    """Adds _n (corpus size), _nb (its number of blocks) and _b (the row's block)."""
    return points.join(_blocks(points, keys, most), list(keys)).withColumn(
        "_b", F.pmod(F.xxhash64("doc_id"), F.col("_nb")).cast("int"))


def tile_rows(points: DataFrame, keys, most: int = MAX_ROWS) -> DataFrame:
    """Every row once per tile of its block: (_ti, _tj) and the side it is on."""
    t = with_blocks(points, keys, most).withColumn(
        "_j", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    return t.select(
        *[c for c in t.columns if c not in ("_j", "_n", "_nb", "_b")],
        F.least("_b", "_j").alias("_ti"), F.greatest("_b", "_j").alias("_tj"),
        (F.col("_b") > F.col("_j")).cast("int").alias("_side"))


def dealt(rows: DataFrame, points: DataFrame, keys, most: int = MAX_ROWS) -> DataFrame:
    """``rows`` of the tiles of ``points`` over as many tasks as there are tiles, and as many again.

    A tile's work grows with the square of its rows: partitions joined by their bytes would
    put all tiles of a small corpus, and many of a large one, into one task.
    """
    nb = F.col("_nb").cast("long")
    tiles = _blocks(points, keys, most).agg(F.sum(nb * (nb + 1) / 2)).first()[0] or 1
    return rows.repartition(min(int(2 * tiles), MAX_TASKS), *keys, "_ti", "_tj")


def cosine(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.round(np.maximum(1.0 - unit_rows(q) @ unit_rows(s).T, 0.0), DIGITS) + 0.0


def euclid(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    qq, ss = (q * q).sum(axis=1)[:, None], (s * s).sum(axis=1)[None, :]
    d2 = qq + ss - 2.0 * (q @ s.T)
    # near-zero squares lose their digits in the expansion: take these exactly
    i, j = np.nonzero(d2 < 1e-7 * (qq + ss))
    for lo in range(0, len(i), 65536):
        a, b = i[lo:lo + 65536], j[lo:lo + 65536]
        d2[a, b] = ((q[a] - s[b]) ** 2).sum(axis=1)
    return np.round(np.sqrt(np.maximum(d2, 0.0)), DIGITS) + 0.0


METRICS = {"cosine": cosine, "euclid": euclid}


def tile_run(points: DataFrame, keys, kernel: Callable, out: str, extras=()) -> DataFrame:
    """Run ``kernel(a, b, same) -> dict of columns`` once per tile: two blocks, or one with itself."""
    keys = list(keys)
    key_schema = T.StructType([points.schema[k] for k in keys])
    schema = T.StructType(key_schema.fields + T.StructType.fromDDL(out).fields)
    arrow = to_arrow_schema(schema)
    names = [f.name for f in T.StructType.fromDDL(out).fields]
    extras = tuple(extras)

    def run(key, tbl):
        side = tbl["_side"].to_numpy()
        a = block_of(tbl.filter(pa.array(side == 0)), extras)
        same = key[len(keys)].as_py() == key[len(keys) + 1].as_py()
        b = a if same else block_of(tbl.filter(pa.array(side == 1)), extras)
        if not len(a) or not len(b):
            return arrow.empty_table()
        got = kernel(a, b, same)
        n = len(got[names[0]])
        cols = [pa.array([k.as_py()] * n, arrow.field(i).type) for i, k in enumerate(key[:len(keys)])]
        cols += [pa.array(got[c], arrow.field(c).type) for c in names]
        return pa.Table.from_arrays(cols, schema=arrow)

    cols = [*keys, "doc_id", "label", "v", *extras]
    rows = dealt(tile_rows(points.select(*cols), keys), points, keys)
    return rows.groupBy(*keys, "_ti", "_tj").applyInArrow(run, schema)


def tile_apply(points: DataFrame, keys, kernel: Callable, out: str, metric="euclid",
               extras=(), once=False) -> DataFrame:
    """Run ``kernel(q, s, dist) -> dict of columns`` over all tiles.

    ``q`` is a chunk of one block and ``s`` the whole other block; both
    directions are run unless ``once`` is set, in which case a tile's pairs are
    seen once and the caller's kernel keeps q.id < s.id. Pairs of a row with
    itself come with distance nan.
    """
    dist_of = METRICS[metric]
    names = [f.name for f in T.StructType.fromDDL(out).fields]

    def run(a, b, same):
        parts = []
        for q_all, s in [(a, b)] if once or same else [(a, b), (b, a)]:
            step = max(1, CELLS // max(1, len(s)))
            for lo in range(0, len(q_all), step):
                q = q_all.take(lo, lo + step)
                d = dist_of(q.v, s.v)
                if same:
                    if once:
                        d[q.id[:, None] >= s.id[None, :]] = np.nan
                    else:
                        d[q.id[:, None] == s.id[None, :]] = np.nan
                parts.append(kernel(q, s, d))
        return {c: [x for p in parts for x in p[c]] for c in names}

    return tile_run(points, keys, run, out, extras)


# ------------------------------------------------------------------ pieces of a tile

def pieces(a: Block, b: Block, same: bool):
    """(i, j, both): slices of a tile whose distances stay in a core's cache.

    A block meets itself on and above the diagonal only; ``both`` says whether
    the columns of a piece are to be read as rows, too.
    """
    for i in range(0, len(a), PIECE):
        for j in range(i if same else 0, len(b), PIECE):
            yield slice(i, min(i + PIECE, len(a))), slice(j, min(j + PIECE, len(b))), not same or i != j


def own(a: Block, b: Block, i: slice, j: slice, same: bool):
    """Pairs of a piece that are a row with itself, or None if there are none; blocks are ordered by id."""
    if not same or b.id[j.start] > a.id[i.stop - 1]:
        return None
    return a.id[i, None] == b.id[None, j]


class Squares:
    """Squared Euclidean distances of the pieces of a tile, small ones without the loss of digits."""

    def __init__(self, a: Block, b: Block):
        def wide(v, x, one, sign):
            return np.hstack([v * sign, x[:, None], one] if sign < 0 else [v, one, x[:, None]])
        self.a, self.b = a.v, b.v
        self.aa, self.bb = (a.v * a.v).sum(axis=1), (b.v * b.v).sum(axis=1)
        # one product of [-2 q, qq, 1] and [s, 1, ss]
        self.wa = wide(a.v, self.aa, np.ones((len(a), 1)), -2.0)
        self.wb = np.ascontiguousarray(wide(b.v, self.bb, np.ones((len(b), 1)), 1.0))

    def __call__(self, i: slice, j: slice) -> np.ndarray:
        d2 = self.wa[i] @ self.wb[j].T
        if not d2.min() >= 1e-7 * (self.aa[i].max() + self.bb[j].max()):
            r, c = np.nonzero(d2 < 1e-7 * (self.aa[i, None] + self.bb[None, j]))
            for lo in range(0, len(r), 65536):
                x, y = r[lo:lo + 65536], c[lo:lo + 65536]
                d2[x, y] = ((self.a[i][x] - self.b[j][y]) ** 2).sum(axis=1)
            np.maximum(d2, 0.0, out=d2)
        return d2


def rounded_root(d2: np.ndarray) -> np.ndarray:
    return np.round(np.sqrt(d2), DIGITS) + 0.0


def square_below(d: np.ndarray) -> np.ndarray:
    """A rounded distance is below ``d`` just where its square is below this."""
    return np.maximum(d - 0.5 * 10.0 ** -DIGITS, 0.0) ** 2


def square_upto(d: np.ndarray) -> np.ndarray:
    """A rounded distance is at most ``d`` just where its square is at most this."""
    return (d + 0.5 * 10.0 ** -DIGITS) ** 2


class CosineScore:
    """Single-precision products of unit vectors, which pairs are picked by, and exact distances of picked pairs."""

    def __init__(self, q: np.ndarray, s: np.ndarray):
        self.q, self.s = unit_rows(q), unit_rows(s)
        self.fq, self.fs = self.q.astype(np.float32), self.s.astype(np.float32)
        self.error = (q.shape[1] + 8) * 2.0 ** -23 + 1e-9  # of a product, and of rounding

    def __call__(self, i: slice, j: slice) -> np.ndarray:
        return self.fq[i] @ self.fs[j].T

    def limit(self, score):
        """Largest distance of a pair with this score."""
        return 1.0 - score + self.error

    def least(self, limit):
        """Smallest score of a pair at this distance."""
        return (1.0 - limit - self.error).astype(np.float32)

    def exact(self, r, c):
        return np.round(np.maximum(1.0 - np.einsum("ij,ij->i", self.q[r], self.s[c]), 0.0), DIGITS) + 0.0


class EuclidScore:
    """The same for Euclidean distances, by negative squares in double precision."""

    def __init__(self, q: np.ndarray, s: np.ndarray):
        self.q, self.s = q, s
        self.qq, self.ss = (q * q).sum(axis=1), (s * s).sum(axis=1)
        self.error = 1e-13 * (self.qq.max(initial=0.0) + self.ss.max(initial=0.0))

    def __call__(self, i: slice, j: slice) -> np.ndarray:
        d2 = self.q[i] @ self.s[j].T
        d2 *= 2.0
        d2 -= self.qq[i, None]
        d2 -= self.ss[None, j]
        return d2

    def limit(self, score):
        return np.sqrt(np.maximum(self.error - score, 0.0)) + 1e-9

    def least(self, limit):
        return -(limit + 1e-9) ** 2 - self.error

    def exact(self, r, c):
        return np.round(np.sqrt(((self.q[r] - self.s[c]) ** 2).sum(axis=1)), DIGITS) + 0.0


SCORES = {"cosine": CosineScore, "euclid": EuclidScore}


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def _first_k(r, c, d, n, k):
    """The k smallest of each row, equal ones by column, and each row's k-th or inf."""
    o = np.lexsort((c, d, r))
    r, c, d = r[o], c[o], d[o]
    place = np.arange(len(r)) - np.searchsorted(r, np.arange(n))[r]
    kth = np.full(n, np.inf)
    kth[r[place == k - 1]] = d[place == k - 1]
    keep = place < k
    return r[keep], c[keep], d[keep], kth


def nearest_k(q: Block, s: Block, k: int, metric: str, same: bool, apart: str | None = None):
    """(row of q, row of s, distance): the k nearest rows of ``s`` for each row of ``q``, equal ones by place.

    Scores of a piece are compared with what the row's k-th neighbour so far needs;
    only pairs that pass are looked at again. Rows with the same id, or with the
    same value of the extra column ``apart``, are no neighbours.
    """
    qr, sr = (np.flatnonzero(np.isfinite(x.v).all(axis=1)) for x in (q, s))
    score = SCORES[metric](q.v[qr], s.v[sr])
    qid, sid = q.id[qr], s.id[sr]
    qx, sx = (q.extra[apart][qr], s.extra[apart][sr]) if apart else (None, None)
    out = []
    for i0 in range(0, len(qr), PIECE):
        i = slice(i0, min(i0 + PIECE, len(qr)))
        n = i.stop - i0
        limit, best, more, held, seen, due = np.full(n, np.inf), None, [], 0, 0, 1
        for j0 in range(0, len(sr), PIECE):
            j = slice(j0, min(j0 + PIECE, len(sr)))
            m = score(i, j)
            if same and not (sid[j0] > qid[i.stop - 1] or sid[j.stop - 1] < qid[i0]):
                m[qid[i, None] == sid[None, j]] = -np.inf
            if apart:
                m[qx[i, None] == sx[None, j]] = -np.inf
            if not seen and m.shape[1] > k:
                limit = score.limit(np.partition(m, m.shape[1] - k, axis=1)[:, m.shape[1] - k])
            at = np.flatnonzero(m >= np.maximum(score.least(limit), np.finfo(m.dtype).min)[:, None])
            r, c = np.divmod(at, m.shape[1])
            for lo in range(0, len(r), 1 << 16):
                x, y = r[lo:lo + (1 << 16)], c[lo:lo + (1 << 16)] + j0
                more.append((x, y, score.exact(x + i0, y)))
            held, seen = held + len(r), seen + 1
            if more and (seen >= due or held > 1 << 18 or j.stop == len(sr)):
                parts = more if best is None else [best, *more]
                *best, kth = _first_k(*(np.concatenate([p[f] for p in parts]) for f in range(3)), n, k)
                limit, more, held, due = np.minimum(limit, kth), [], 0, max(due, 2 * seen)
        if best is not None:
            out.append((qr[best[0] + i0], sr[best[1]], best[2]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate([x[f] for x in out]) for f in range(3))


def tile_nearest(points: DataFrame, keys, k: int, metric="cosine", extras=(), apart: str | None = None) -> DataFrame:
    """(keys, doc_id, label, extras, nbr, nbr_label, dist): a row's k nearest of each block."""
    label = points.schema["label"].dataType.simpleString()
    kept = "".join(f"{e} {points.schema[e].dataType.simpleString()}, " for e in extras)

    def kernel(a, b, same):
        got = {}
        for q, s in [(a, b)] if same else [(a, b), (b, a)]:
            r, c, d = nearest_k(q, s, k, metric, same, apart)
            for name, x in (("doc_id", q.id[r]), ("label", q.label[r]), *((e, q.extra[e][r]) for e in extras),
                            ("nbr", s.id[c]), ("nbr_label", s.label[c]), ("dist", d)):
                got.setdefault(name, []).append(x)
        return {name: np.concatenate(x) for name, x in got.items()}

    return tile_run(points, keys, kernel, f"doc_id long, label {label}, {kept}nbr long, nbr_label {label}, dist double", extras)


def smallest_k(d: np.ndarray, k: int):
    """(row, column) of the k smallest entries per row, equal ones by column; nan is skipped."""
    d = np.where(np.isnan(d), np.inf, d)
    k = min(k, d.shape[1])
    kth = np.partition(d, k - 1, axis=1)[:, k - 1:k]
    r, c = np.nonzero((d <= kth) & np.isfinite(d))
    o = np.lexsort((c, d[r, c], r))
    r, c = r[o], c[o]
    first = np.searchsorted(r, np.arange(d.shape[0]))
    keep = (np.arange(len(r)) - first[r]) < k
    return r[keep], c[keep]
