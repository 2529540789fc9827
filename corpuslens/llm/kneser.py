"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped for scoring.

Counting combines in every task before anything moves, and what moves are packed
sorted arrays, one per shard:

1. Words: 64-bit hash -> count, in shards by hash range. A word's rank in the
   sorted hashes of all shards is its id.
2. Pairs: (id, id) as one 64-bit key -> count, in shards by hash of the key, so a
   frequent word's pairs are spread. A pair shard also yields, for words, how many
   different pairs they begin (with counts 1, 2, 3 or more) and end.
3. Words again: the weight left to the lower order after each word, and the
   number of different words before it.

Shards are files of sorted arrays in the shared folder, written under another name
and renamed, so a repeated task does no harm. Scorers map them into memory and
look their keys up by bisection; nothing is held whole by a task or the driver.
The number of shards follows the number of input partitions.

p(w|h) = (c(hw) - D(c))/c(h) + g(h) p(w), p(w) = (n(w) - D'(n))/n + g' / (V + 1),
with n(w) the number of different words before w; a text begins after a start
mark and ends with a token of its own. Unseen h: p(w) alone.

Defined cases: a null or empty text is its end token; a null id counts as the
empty text in the hold-out; repeated rows count and are scored each; without
training rows every probability is 1 / (V + 1) = 1.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import NOT_SPACE, Scratch, limit_arrow, mix, text_blocks, words_of

#: Hash of the end token; no word has it, as words have no white space.
END = np.uint64(0x0D0A0D0A20202020)
#: Tokens whose counts are combined at a time in a task.
COMBINE = 4_000_000
BLOB = "shard int, kind string, size long, keys binary, counts binary"


def shared_path(uri: str) -> str:
    """The folder as workers open it. Model files are memory-mapped, so it must be mounted."""
    path = uri.removeprefix("file://").removeprefix("file:")
    if "://" in path or not path.startswith("/"):
        raise ValueError(f"the model folder must be a mounted path that all executors share, not {uri}")
    return path


def _squeeze(a: np.ndarray) -> bytes:
    """Byte planes of an array, compressed; of ascending keys the differences."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def _expand(raw: bytes, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw, max_output_size=max(1, n * size)), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(dtype).ravel()


def _pack(keys: np.ndarray) -> bytes:
    return _squeeze(np.diff(keys, prepend=keys.dtype.type(0)))


def _unpack(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(_expand(raw, n, np.uint64), dtype=np.uint64)


def _combine(keys: list[np.ndarray], counts: list[np.ndarray] | None):
    k = np.concatenate(keys)
    if counts is None:
        return np.unique(k, return_counts=True)
    order = np.argsort(k, kind="stable")
    k, c = k[order], np.concatenate(counts)[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(c, first)


def _by_shard(keys: np.ndarray, shard: np.ndarray):
    order = np.argsort(shard, kind="stable")
    s = shard[order]
    cut = np.flatnonzero(np.diff(s)) + 1
    for part in np.split(order, cut):
        if len(part):
            yield int(shard[part[0]]), part


def _blobs(kind: str, keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> Iterator[pa.RecordBatch]:
    for s, part in _by_shard(keys, shard):
        yield _row(s, kind, len(part), _pack(keys[part]), _squeeze(counts[part].astype(np.uint64)))


def _row(shard: int, kind: str, size: int, keys: bytes, counts: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([shard], pa.int32()), pa.array([kind]), pa.array([size], pa.int64()), pa.array([keys], pa.binary()),
         pa.array([counts], pa.binary())], ["shard", "kind", "size", "keys", "counts"])


def _range_shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard by the upper 32 bits, in order of the hash."""
    return ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _pair_shard(k: np.ndarray, shards: int) -> np.ndarray:
    return _range_shard(mix(k), shards)


def _save(folder: str, name: str, array: np.ndarray) -> None:
    os.makedirs(folder, exist_ok=True)
    own = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.write(np.ascontiguousarray(array).tobytes())
    os.replace(own, f"{folder}/{name}")


def _load(folder: str, name: str, dtype) -> np.ndarray:
    path = f"{folder}/{name}"
    if not os.path.exists(path) or not os.path.getsize(path):
        return np.zeros(0, dtype=dtype)
    return np.memmap(path, dtype=dtype, mode="r")


class Words:
    """Ids and counts of words from the word shards."""

    def __init__(self, folder: str, shards: int, starts: list[int]):
        self.folder, self.shards, self.starts = folder, shards, starts
        self.open: dict[int, tuple] = {}

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of ascending hashes; id -1 and count 0 if unknown."""
        ids, counts = np.full(len(h), -1, dtype=np.int64), np.zeros(len(h), dtype=np.int64)
        s = _range_shard(h, self.shards).astype(np.int64)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(s)) + 1, [len(s)]]) if len(s) else [0]
        for a, b in zip(cut[:-1], cut[1:]):
            k = int(s[a])
            if k not in self.open:
                self.open[k] = (_load(self.folder, f"word-{k}.key", np.uint64), _load(self.folder, f"word-{k}.count", np.uint64))
            keys, cnt = self.open[k]
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, h[a:b]), len(keys) - 1)
            hit = keys[at] == h[a:b]
            ids[a:b][hit] = at[hit] + self.starts[k]
            counts[a:b][hit] = cnt[at[hit]]
        return ids, counts


def _tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the documents, each followed by END; and where documents begin."""
    _, _, h, first = words_of(buf, offs, NOT_SPACE)
    n = len(offs) - 1
    out = np.full(len(h) + n, END, dtype=np.uint64)
    doc = np.repeat(np.arange(n), np.diff(first))
    out[np.arange(len(h)) + doc] = h
    return out, np.concatenate([first + np.arange(n + 1)])


def _ids(words: Words, tok: np.ndarray):
    u, back = np.unique(tok, return_inverse=True)
    ids, counts = words.find(u)
    return ids[back], counts[back]


def _pairs(ids: np.ndarray, begin: np.ndarray, start_id: int) -> np.ndarray:
    before = np.empty(len(ids), dtype=np.int64)
    before[1:] = ids[:-1]
    before[begin] = start_id
    return before


def train(docs: DataFrame, scratch: Scratch) -> dict:
    """Model of ``docs`` (text): what a scorer needs to open it."""
    limit_arrow(docs.sparkSession)
    folder = shared_path(scratch.path("model"))
    shards = max(8, docs.rdd.getNumPartitions())

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size, docs_n = [], [], 0, 0
        for batch in batches:
            for rows, buf, offs in text_blocks(batch):
                k, c = np.unique(_tokens(buf, offs)[0], return_counts=True)
                keys.append(k)
                counts.append(c)
                size += len(k)
                if size >= COMBINE:
                    k, c = _combine(keys, counts)
                    yield from _blobs("word", k, c, _range_shard(k, shards).astype(np.int64))
                    keys, counts, size = [], [], 0
        if keys:
            k, c = _combine(keys, counts)
            yield from _blobs("word", k, c, _range_shard(k, shards).astype(np.int64))

    def merge_words(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        sizes = table.column("size").to_pylist()
        k, c = _combine([_unpack(x.as_py(), n) for x, n in zip(table.column("keys"), sizes)],
                        [_expand(x.as_py(), n, np.uint64) for x, n in zip(table.column("counts"), sizes)])
        _save(folder, f"word-{s}.key", k)
        _save(folder, f"word-{s}.count", c)
        return pa.table({"shard": pa.array([s], pa.int32()), "n": pa.array([len(k)], pa.int64()),
                         "total": pa.array([int(c.sum())], pa.int64())})

    text = docs.select(F.col("text").cast("string").alias("text"))
    words = (text.mapInArrow(count_words, BLOB).groupBy("shard").applyInArrow(merge_words, "shard int, n long, total long").collect())
    sizes = {r["shard"]: r["n"] for r in words}
    starts = np.cumsum([0] + [sizes.get(k, 0) for k in range(shards)]).tolist()
    v, total = starts[-1], sum(r["total"] for r in words)
    if v >= 2**32 - 1:
        raise ValueError("more than 2**32 words: word ids no longer fit a 64-bit pair key")
    model = {"folder": folder, "shards": shards, "starts": starts, "v": v, "total": total, "parts": shards,
             "span": max(1, -(-(v + 1) // shards)), "d2": (0.0,) * 3, "d1": (0.0,) * 3, "n": 0, "left": 1.0}
    if not v:
        return model

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, keys, size = Words(folder, shards, starts), [], 0
        for batch in batches:
            for rows, buf, offs in text_blocks(batch):
                tok, begin = _tokens(buf, offs)
                ids, _ = _ids(known, tok)
                keys.append((_pairs(ids, begin[:-1], v).astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64))
                size += len(ids)
                if size >= COMBINE:
                    k, c = _combine(keys, None)
                    yield from _blobs("pair", k, c, _pair_shard(k, shards).astype(np.int64))
                    keys, size = [], 0
        if keys:
            k, c = _combine(keys, None)
            yield from _blobs("pair", k, c, _pair_shard(k, shards).astype(np.int64))

    span = model["span"]

    def merge_pairs(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        sizes = table.column("size").to_pylist()
        k, c = _combine([_unpack(x.as_py(), n) for x, n in zip(table.column("keys"), sizes)],
                        [_expand(x.as_py(), n, np.uint64) for x, n in zip(table.column("counts"), sizes)])
        _save(folder, f"pair-{s}.key", k)
        _save(folder, f"pair-{s}.count", c.astype(np.uint32))
        out = [_row(s, "n2", 4, b"", np.bincount(np.minimum(c, 5).astype(np.int64), minlength=6)[1:5].astype(np.uint64).tobytes())]
        # for each word, packed: pairs it begins with count 1, 2, 3 or more (21 bits each), as three kinds
        first = k >> np.uint64(32)
        for kind, mask in (("b1", c == 1), ("b2", c == 2), ("b3", c >= 3)):
            u, n = np.unique(first[mask], return_counts=True)
            out += _blobs(kind, u, n, (u // np.uint64(span)).astype(np.int64))
        u, n = np.unique(k & np.uint64(2**32 - 1), return_counts=True)
        out += _blobs("e", u, n, (u // np.uint64(span)).astype(np.int64))
        return pa.Table.from_batches(out)

    pairs = scratch.cut(text.mapInArrow(count_pairs, BLOB).groupBy("shard").applyInArrow(merge_pairs, BLOB), "pairs")
    n2 = sum((np.frombuffer(r[0], dtype=np.uint64).astype(np.int64) for r in pairs.filter("kind = 'n2'").select("counts").collect()),
             np.zeros(4, dtype=np.int64))
    d2 = discounts(n2)

    def merge_stats(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        low, high = s * span, min((s + 1) * span, v + 1)
        sums = {kind: np.zeros(high - low, dtype=np.int64) for kind in ("b1", "b2", "b3", "e")}
        cols = [table.column(c).to_pylist() for c in ("kind", "size", "keys", "counts")]
        for kind, n, k, c in zip(*cols):
            sums[kind][_unpack(k, n).astype(np.int64) - low] += _expand(c, n, np.uint64).astype(np.int64)
        _save(folder, f"left-{s}.mass", d2[0] * sums["b1"] + d2[1] * sums["b2"] + d2[2] * sums["b3"])
        _save(folder, f"left-{s}.ends", sums["e"].astype(np.uint32))
        e = sums["e"]
        n1 = np.bincount(np.minimum(e, 5), minlength=6)[1:5]
        big = int((e >= 3).sum())
        return pa.table({"n": [int(e.sum())], "big": [big], "counts": pa.array([n1.astype(np.int64).tolist()], pa.list_(pa.int64()))})

    stats = (pairs.filter("kind <> 'n2'").groupBy("shard").applyInArrow(merge_stats, "n long, big long, counts array<long>").collect())
    n1 = np.sum([r["counts"] for r in stats], axis=0)
    d1 = discounts(n1)
    n = sum(r["n"] for r in stats)
    left = (d1[0] * n1[0] + d1[1] * n1[1] + d1[2] * sum(r["big"] for r in stats)) / n
    return {**model, "d2": d2, "d1": d1, "n": n, "left": float(left)}


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of things counted 1, 2, 3 and 4 times, kept within 0..k; 1/2 where undefined."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2 if n2 else d1
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return min(max(d1, 0.0), 1.0), min(max(d2, 0.0), 2.0), min(max(d3, 0.0), 3.0)


class Scorer:
    """Looks a model up; holds open maps only."""

    def __init__(self, model: dict):
        self.m = model
        self.words = Words(model["folder"], model["shards"], model["starts"])
        self.pairs: dict[int, tuple] = {}
        self.lefts: dict[int, tuple] = {}

    def _pair_counts(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), dtype=np.int64)
        for s, part in _by_shard(keys, _pair_shard(keys, self.m["shards"]).astype(np.int64)) if len(keys) else ():
            if s not in self.pairs:
                self.pairs[s] = (_load(self.m["folder"], f"pair-{s}.key", np.uint64), _load(self.m["folder"], f"pair-{s}.count", np.uint32))
            k, c = self.pairs[s]
            if len(k):
                at = np.minimum(np.searchsorted(k, keys[part]), len(k) - 1)
                hit = k[at] == keys[part]
                out[part[hit]] = c[at[hit]]
        return out

    def _left(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mass, ends) of ascending ids."""
        mass, ends = np.zeros(len(ids)), np.zeros(len(ids), dtype=np.int64)
        part = ids // self.m["span"]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(ids)]]) if len(ids) else [0]
        for a, b in zip(cut[:-1], cut[1:]):
            s = int(part[a])
            if s not in self.lefts:
                self.lefts[s] = (_load(self.m["folder"], f"left-{s}.mass", np.float64), _load(self.m["folder"], f"left-{s}.ends", np.uint32))
            x, e = self.lefts[s]
            if len(x):
                at = ids[a:b] - s * self.m["span"]
                mass[a:b], ends[a:b] = x[at], e[at]
        return mass, ends

    @staticmethod
    def _discount(d: tuple, c: np.ndarray) -> np.ndarray:
        return np.where(c <= 0, 0.0, np.where(c == 1, d[0], np.where(c == 2, d[1], d[2])))

    def score(self, buf: np.ndarray, offs: np.ndarray):
        """(n_tokens, n_known, base log10, model log10) of each document."""
        m = self.m
        tok, begin = _tokens(buf, offs)
        ids, counts = _ids(self.words, tok)
        base = np.log10((counts + 1) / (m["total"] + m["v"] + 1))
        u, back = np.unique(ids, return_inverse=True)
        known = u >= 0
        mass_u, ends_u = np.zeros(len(u)), np.zeros(len(u), dtype=np.int64)
        mass_u[known], ends_u[known] = self._left(u[known])
        ends = ends_u[back]
        low = m["left"] / (m["v"] + 1) + (np.maximum(ends - self._discount(m["d1"], ends), 0) / m["n"] if m["n"] else 0.0)
        before = _pairs(ids, begin[:-1], m["v"])
        seen_before = np.empty(len(ids), dtype=np.int64)
        seen_before[1:] = counts[:-1]
        mass = np.empty(len(ids))
        mass[1:] = mass_u[back][:-1]
        start_mass = self._left(np.array([m["v"]]))[0][0] if m["v"] else 0.0
        # the start mark is followed once by every training text, which is how often END was counted
        ends_total = int(self.words.find(np.array([END]))[1][0])
        seen_before[begin[:-1]], mass[begin[:-1]] = ends_total, start_mass
        both = (before >= 0) & (ids >= 0)
        key = (before[both].astype(np.uint64) << np.uint64(32)) | ids[both].astype(np.uint64)
        uk, kb = np.unique(key, return_inverse=True)
        c = np.zeros(len(ids), dtype=np.int64)
        c[both] = self._pair_counts(uk)[kb]
        ctx = seen_before > 0
        div = np.where(ctx, seen_before, 1)
        p = np.where(ctx, (c - self._discount(m["d2"], c)) / div + mass / div * low, low)
        at = begin[:-1]
        return (np.diff(begin), np.add.reduceat(counts > 0, at, dtype=np.int64), np.add.reduceat(base, at),
                np.add.reduceat(np.log10(p), at))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` (doc_id, text, other columns that stay) with n_tokens, n_known, base_score, score."""
    limit_arrow(docs.sparkSession)
    keep = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for rows, buf, offs in text_blocks(batch):
                cols = scorer.score(buf, offs)
                yield pa.RecordBatch.from_arrays([rows.column(c) for c in keep] + [pa.array(c) for c in cols],
                                                 keep + ["n_tokens", "n_known", "base_score", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{kinds}, n_tokens long, n_known long, base_score double, score double")
