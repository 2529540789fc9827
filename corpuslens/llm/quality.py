"""Quality classifier: a factorisation machine over hashed words and structure statistics.

A text's features are its words hashed to BUCKETS (logarithm of their counts, of
unit length together) and, one-hot by quantile, statistics of its characters,
words and length. The machine's pairwise interactions have rank RANK and are
summed in linear time: sum over factors of ((sum vx)**2 - sum (vx)**2) / 2.

It is fitted on at most SAMPLE labelled rows, drawn by a hash of the id; scoring
covers all rows and moves none. Only the text is an input.

Defined cases: a null text is empty; empty texts get the score of their
statistics; rows with equal texts get equal scores; labels that are null or
given twice for an id count once; without labelled rows of both kinds every
score is the share of label 1 (1/2 without any); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import NOT_SPACE, limit_arrow, text_blocks, words_of

BUCKETS = 1 << 14
RANK = 8
#: Labelled rows that the machine is fitted on, at most.
SAMPLE = 20_000
EPOCHS = 12
BATCH = 256
RATE = 0.02
DECAY = 1e-4
BINS = 12

#: Byte classes of the statistics: lower, upper, digit, blank, line end, stop, exclamation, bar, sign, other, not ASCII.
_CLASS = np.full(256, 9, dtype=np.int64)
for _k, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n",
                           b".,;:?", b"!", b"|", b"#*$%&<>@^~={}[]\\/_+")):
    _CLASS[list(_set)] = _k
_CLASS[128:] = 10
N_CLASS = 11
N_STATS = N_CLASS + 7


def _per_doc(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(x)])
    return c[first[1:]] - c[first[:-1]]


def features(buf: np.ndarray, offs: np.ndarray):
    """(row, bucket, value) of the word features and the matrix of statistics."""
    n = len(offs) - 1
    size = np.diff(offs)
    doc = np.repeat(np.arange(n), size)
    share = np.bincount(doc * N_CLASS + _CLASS[buf], minlength=n * N_CLASS).reshape(n, N_CLASS) / np.maximum(size, 1)[:, None]
    s, e, h, first = words_of(buf, offs, NOT_SPACE)
    m = np.diff(first)
    wdoc = np.repeat(np.arange(n), m)
    key, count = np.unique((wdoc << 14) | (h >> np.uint64(50)).astype(np.int64), return_counts=True)
    row, bucket = key >> 14, key & (BUCKETS - 1)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(row, value * value, minlength=n))
    value = value / norm[row]
    same = np.zeros(len(h))
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (wdoc[1:] == wdoc[:-1])
    stop = np.isin(buf[e - 1], np.frombuffer(b".!?", dtype=np.uint8)) if len(h) else np.zeros(0)
    words = np.maximum(m, 1)
    top = np.zeros(n)
    np.maximum.at(top, row, count)
    stats = np.column_stack([
        share, np.log1p(size), np.log1p(m), np.bincount(row, minlength=n) / words, top / words,
        _per_doc(same, first) / words, _per_doc(stop, first) / words, _per_doc(e - s, first) / words])
    return row, bucket, value, stats


def _rows(stats: np.ndarray, edges: np.ndarray):
    """One-hot features of the statistics: numbers from BUCKETS on, the constant 1/2."""
    n, k = stats.shape
    bins = np.stack([np.searchsorted(edges[j], stats[:, j], side="right") for j in range(k)], axis=1)
    at = BUCKETS + np.arange(k) * (BINS + 1) + bins
    return np.repeat(np.arange(n), k), at.ravel(), np.full(n * k, 0.5)


DIM = BUCKETS + N_STATS * (BINS + 1)


def output(model: dict, row: np.ndarray, at: np.ndarray, x: np.ndarray, n: int):
    """The machine's value for n rows given as (row, feature, value), and the factor sums."""
    y = model["b"] + np.bincount(row, model["w"][at] * x, minlength=n)
    sums = np.empty((RANK, n))
    for f in range(RANK):
        vx = model["v"][f][at] * x
        sums[f] = np.bincount(row, vx, minlength=n)
        y += 0.5 * (sums[f] ** 2 - np.bincount(row, vx * vx, minlength=n))
    return y, sums


def _sigmoid(y: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(y, -30, 30)))


def fit(rows: list[tuple], labels: np.ndarray, seed: int = 7) -> dict:
    """rows: (bucket, value, statistics) of each row. Mini-batches, Adam, classes weighted alike."""
    model = {"b": 0.0, "w": np.zeros(DIM), "v": np.zeros((RANK, DIM)), "edges": np.zeros((N_STATS, BINS))}
    share = labels.mean() if len(labels) else 0.5
    if not len(labels) or share in (0.0, 1.0):
        model["b"] = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return model
    stats = np.array([r[2] for r in rows])
    model["edges"] = edges = np.quantile(stats, np.arange(1, BINS + 1) / (BINS + 1), axis=0).T.copy()
    rng = np.random.default_rng(seed)
    model["v"] = rng.normal(0, 0.05, (RANK, DIM))
    model["b"] = float(np.log(share / (1 - share)))
    _, hot, _ = _rows(stats, edges)
    hot = hot.reshape(len(rows), -1)
    p = [model["w"], *model["v"]]
    m1, m2 = [np.zeros(DIM) for _ in p], [np.zeros(DIM) for _ in p]
    t = 0
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // BATCH)):
            t += 1
            at = np.concatenate([np.concatenate([rows[i][0], hot[i]]) for i in part])
            x = np.concatenate([np.concatenate([rows[i][1], np.full(N_STATS, 0.5)]) for i in part])
            row = np.repeat(np.arange(len(part)), [len(rows[i][0]) + N_STATS for i in part])
            y, sums = output(model, row, at, x, len(part))
            slope = (_sigmoid(y) - labels[part]) / len(part)
            model["b"] -= RATE * float(slope.sum())
            lead = slope[row] * x
            grads = [np.bincount(at, lead, minlength=DIM)]
            grads += [np.bincount(at, lead * (sums[f][row] - model["v"][f][at] * x), minlength=DIM) for f in range(RANK)]
            for k, g in enumerate(grads):
                g += DECAY * p[k] / len(part)
                m1[k] += 0.1 * (g - m1[k])
                m2[k] += 0.01 * (g * g - m2[k])
                p[k] -= RATE * (m1[k] / (1 - 0.9 ** t)) / (np.sqrt(m2[k] / (1 - 0.99 ** t)) + 1e-8)
    return model


ROW = "label int, bucket binary, value binary, stats binary"


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The machine for ``labels`` (doc_id, label) of ``docs`` (doc_id, text)."""
    limit_arrow(docs.sparkSession)
    few = (labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # at most ``sample`` rows of two numbers are broadcast
    rows = docs.join(F.broadcast(few), "doc_id").select("label", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in text_blocks(batch):
                row, bucket, value, stats = features(buf, offs)
                cut = np.searchsorted(row, np.arange(len(offs)))
                b, v, s = bucket.astype("<i4"), value.astype("<f4"), stats.astype("<f8")
                k = range(len(offs) - 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), pa.array([b[cut[i]:cut[i + 1]].tobytes() for i in k], pa.binary()),
                     pa.array([v[cut[i]:cut[i + 1]].tobytes() for i in k], pa.binary()), pa.array([s[i].tobytes() for i in k], pa.binary())],
                    ["label", "bucket", "value", "stats"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("stats", "ascending"), ("bucket", "ascending"), ("label", "ascending")])  # the same order on every run
        rows = [(np.frombuffer(b, "<i4"), np.frombuffer(v, "<f4").astype(float), np.frombuffer(s, "<f8"))
                for b, v, s in zip(*(table.column(c).to_pylist() for c in ("bucket", "value", "stats")))]
        m = fit(rows, np.array(table.column("label").to_pylist(), dtype=float))
        return pa.table({"b": [m["b"]], "w": pa.array([m["w"].astype("<f4").tobytes()], pa.binary()),
                         "v": pa.array([m["v"].astype("<f4").tobytes()], pa.binary()), "edges": pa.array([m["edges"].tobytes()], pa.binary())})

    got = (rows.mapInArrow(extract, ROW).groupBy(F.lit(0).alias("all")).applyInArrow(
        lambda t: learn(t.select(["label", "bucket", "value", "stats"])), "b double, w binary, v binary, edges binary").collect())
    if not got:
        return fit([], np.zeros(0))
    r = got[0]
    return {"b": r["b"], "w": np.frombuffer(r["w"], "<f4").astype(float), "v": np.frombuffer(r["v"], "<f4").astype(float).reshape(RANK, DIM),
            "edges": np.frombuffer(r["edges"]).reshape(N_STATS, BINS)}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` (text and other columns that stay) with score, the probability of label 1."""
    spark = docs.sparkSession
    limit_arrow(spark)
    shared = spark.sparkContext.broadcast(model)  # DIM x (RANK + 1) numbers, whatever the data
    keep = [f for f in docs.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, buf, offs in text_blocks(batch):
                row, at, x, stats = features(buf, offs)
                r2, a2, x2 = _rows(stats, m["edges"])
                y, _ = output(m, np.concatenate([row, r2]), np.concatenate([at, a2]), np.concatenate([x, x2]), len(offs) - 1)
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in keep] + [pa.array(_sigmoid(y))],
                                                 [f.name for f in keep] + ["score"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    return docs.mapInArrow(run, kinds + "score double")
