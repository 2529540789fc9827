"""Vector code compression: product codebooks learned over tries of different part vectors.

A vector's components become integers and are cut into consecutive parts. All parts of
one position, sorted, form a trie: a node at depth d is a prefix of d components, and its
squared distances to the codebook's entries are those of its parent plus the squares of
one more component. A depth-first walk carries these sums down, so a prefix that many
parts share is computed once; at a leaf the smallest sum names the entry, and the leaf
adds its weight (the number of vectors that have this part) and its weighted components to it.

Spark folds equal parts in the task that reads them, sorts the rest by ranges of (position,
part), so that neighbours in the trie lie in one task, and stores them once; a round reads
them and returns sums of (position, entry, component). Only codebooks reach the driver.

All arithmetic is on 64-bit integers and exact. Components must be below 8192 in magnitude
(2**25 after scaling); larger ones raise an error, none is cut off.

Defined cases: a vector that is null or holds a null or a non-finite component is dropped, and so
is one whose length is not the most frequent (of equally frequent lengths the smaller); a length that
the parts do not divide is cut at floor(p * length / parts); with fewer kept vectors than entries the
codebooks have as many entries as vectors; a null vec_id comes after all others, equal ids go by
vector; repeated rows each count and are returned each; without kept vectors there are no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import Scratch, limit_arrow

SCALE = 4096
LARGEST = 1 << 25
#: Rows of a block that are walked together, and rows of a bundle of small subtrees.
ROWS = 1 << 15
BUNDLE = 1 << 11


def kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None = None) -> DataFrame:
    """vec_id, label, v (integer components) of the usable vectors."""
    limit_arrow(vectors.sparkSession)
    v = vectors[vector_col].cast("array<double>")
    label = vectors[label_col] if label_col else F.lit(None).cast("int")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.floor(x * SCALE))
    within = F.forall(whole, lambda x: F.abs(x) <= LARGEST)
    return (vectors.filter(v.isNotNull() & fine)
            .select(vectors[id_col].cast("long").alias("vec_id"), label.alias("label"),
                    F.when(within, F.transform(whole, lambda x: x.cast("int"))).otherwise(
                        F.raise_error(F.lit("a vector component is out of range"))).alias("v")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, (pa.ListArray, pa.LargeListArray)) else column
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def walk(rows: np.ndarray, book: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Depth-first over the trie of ``rows`` (n x d, sorted): (first row of each leaf, its distances to all entries).

    Sibling subtrees of few rows go down together; one of many rows goes alone."""
    n, width = rows.shape
    if not n:
        return
    fresh = np.ones((n, width + 1), dtype=bool)  # row opens a node of depth d
    fresh[1:, 0] = False
    np.logical_or.accumulate(rows[1:] != rows[:-1], axis=1, out=fresh[1:, 1:])
    stack = [(n, 0, np.zeros(1, dtype=np.int64), np.zeros((1, len(book)), dtype=np.int64))]
    while stack:
        hi, depth, starts, sums = stack.pop()
        if depth == width:
            yield starts, sums
            continue
        lo = starts[0]
        below = lo + np.flatnonzero(fresh[lo:hi, depth + 1])
        parent = np.searchsorted(starts, below, side="right") - 1
        step = rows[below, depth][:, None] - book[None, :, depth]
        sums = sums[parent] + step * step
        if hi - lo <= BUNDLE:
            stack.append((hi, depth + 1, below, sums))
            continue
        ends = np.append(below[1:], hi)
        cuts, at = [0], lo
        for k in range(1, len(below)):
            if ends[k] - at > BUNDLE:
                cuts.append(k)
                at = below[k]
        cuts.append(len(below))
        for a, b in reversed(list(zip(cuts[:-1], cuts[1:]))):
            stack.append((ends[b - 1], depth + 1, below[a:b], sums[a:b]))


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaves of sorted rows in order: first row, nearest entry (ties to the lower), squared distance."""
    first, entry, dist = [], [], []
    for starts, sums in walk(rows, book):
        best = sums.argmin(axis=1)
        first.append(starts)
        entry.append(best)
        dist.append(sums[np.arange(len(best)), best])
    e = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x) if x else e for x in (first, entry, dist))


def bounds(width: int, parts: int) -> list[int]:
    return [p * width // parts for p in range(parts + 1)]


def _blocks(batches, cols: list[str]) -> Iterator[pa.Table]:
    """Batches put together to some ROWS rows."""
    have, n = [], 0
    for b in batches:
        if b.num_rows:
            have.append(b.select(cols))
            n += b.num_rows
        if n >= ROWS:
            yield pa.Table.from_batches(have).combine_chunks()
            have, n = [], 0
    if n:
        yield pa.Table.from_batches(have).combine_chunks()


def different_parts(vecs: DataFrame, width: int, parts: int, scratch: Scratch) -> DataFrame:
    """part, key, n: the parts with the number of vectors that have them, in files sorted by part and key.

    ``key`` has the components as 4 big-endian bytes each, moved to be positive, so bytes sort as
    the components do. Equal parts are folded in each task; those of several tasks lie next to one another."""
    cut = bounds(width, parts)

    def fold(batches):
        for t in _blocks(batches, ["v"]):
            x = _matrix(t.column("v").combine_chunks(), width)
            for p in range(parts):
                a, b = cut[p], cut[p + 1]
                raw = np.ascontiguousarray((x[:, a:b] + (1 << 31)).astype(">u4"))
                size = 4 * (b - a)
                if size:
                    keys, n = np.unique(raw.view(f"V{size}").ravel(), return_counts=True)
                else:
                    keys, n = np.zeros(1, dtype="V1"), np.array([len(x)])
                offs = np.arange(len(keys) + 1, dtype=np.int32) * size
                key = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(keys.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), p, dtype=np.int32)), key, pa.array(n.astype(np.int64))], ["part", "key", "n"])

    rows = vecs.select("v").mapInArrow(fold, "part int, key binary, n long")
    return scratch.cut(rows.repartitionByRange("part", "key").sortWithinPartitions("part", "key"), "parts")


def entry_sums(parts: DataFrame, books: list[np.ndarray]) -> dict[tuple[int, int, int], int]:
    """(part, entry, component) -> sum over the parts nearest to the entry; component -1 is their number."""
    def work(batches):
        total = [np.zeros((len(b), b.shape[1] + 1), dtype=np.int64) for b in books]
        for t in _blocks(batches, ["part", "key", "n"]):
            part = t.column("part").to_numpy()
            keys, n = t.column("key").combine_chunks(), t.column("n").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                book = books[part[lo]]
                width = book.shape[1]
                k = keys.slice(lo, hi - lo)
                raw = np.frombuffer(k.buffers()[2] or b"", dtype=">u4")
                at = np.frombuffer(k.buffers()[1], dtype=np.int32)[k.offset] // 4
                x = raw[at:at + (hi - lo) * width].astype(np.int64).reshape(hi - lo, width) - (1 << 31)
                first, entry, _ = nearest(x, book)
                weight = np.add.reduceat(n[lo:hi], first)
                np.add.at(total[part[lo]], entry, np.column_stack([x[first] * weight[:, None], weight]))
        p, e, d, s = [], [], [], []
        for i, m in enumerate(total):
            for j in np.flatnonzero(m[:, -1]).tolist():
                p += [i] * m.shape[1]
                e += [j] * m.shape[1]
                d += [*range(m.shape[1] - 1), -1]
                s += m[j].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(d, pa.int32()), pa.array(s, pa.int64())], ["p", "e", "d", "s"])

    sums = parts.mapInArrow(work, "p int, e int, d int, s long").groupBy("p", "e", "d").agg(F.sum("s").alias("s"))
    return {(r.p, r.e, r.d): r.s for r in sums.collect()}  # a row for every number of the codebooks at most


def learn(vecs: DataFrame, scratch: Scratch, parts: int = 8, entries: int = 16, rounds: int = 6) -> list[np.ndarray]:
    """One codebook (entries x components) for each part position; [] without vectors. ``vecs``: vec_id, v of one length."""
    start = (vecs.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect())
    if not start:
        return []
    width = len(start[0].v)
    cut = bounds(width, parts)
    first = np.array([r.v for r in start], dtype=np.int64).reshape(len(start), width)
    books = [first[:, a:b].copy() for a, b in zip(cut[:-1], cut[1:])]
    table = different_parts(vecs, width, parts, scratch)
    for _ in range(rounds):
        sums = entry_sums(table, books)
        books = [np.array([[sums[p, e, d] // sums[p, e, -1] for d in range(b.shape[1])] if (p, e, -1) in sums else b[e].tolist()
                           for e in range(len(b))], dtype=np.int64).reshape(b.shape) for p, b in enumerate(books)]
    scratch.drop("parts")
    return books


def encode(vecs: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, codes (one byte a part), error (sum of the squared distances)."""
    width = sum(b.shape[1] for b in books)

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"), width)
            codes, error, at = np.zeros((len(x), len(books)), dtype=np.uint8), np.zeros(len(x), dtype=np.int64), 0
            for p, book in enumerate(books):
                y = x[:, at:at + book.shape[1]]
                at += book.shape[1]
                order = np.lexsort(y.T[::-1]) if y.shape[1] else np.arange(len(y))
                first, entry, dist = nearest(y[order], book)
                leaf = np.searchsorted(first, np.arange(len(y)), side="right") - 1
                codes[order, p] = entry[leaf]
                error[order] += dist[leaf]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)],
                                             ["vec_id", "label", "codes", "error"])

    kind = vecs.schema["label"].dataType.simpleString()
    return vecs.select("vec_id", "label", "v").mapInArrow(work, f"vec_id long, label {kind}, codes binary, error long")


def book_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, scratch: Scratch, parts: int = 8, entries: int = 16, rounds: int = 6, id_col: str = "vec_id",
             vector_col: str = "embedding", label_col: str | None = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(rows, codebooks). Rows: vec_id, label, codes, error, label_error (error summed over equal labels)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte: 1 to 256 entries")
    vecs = kept(vectors, id_col, vector_col, label_col)
    sizes = vecs.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
    width = sizes[0].w if sizes else 0
    vecs = vecs.filter(F.size("v") == width)
    books = learn(vecs, scratch, parts, entries, rounds)
    if not books:
        books = [np.zeros((1, 0), dtype=np.int64)] * parts
    coded = scratch.cut(encode(vecs, books), "coded")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    return out.select("vec_id", "label", "codes", "error", "label_error"), books
