"""Vector descriptors over (dataset_id, space, doc_id, label, v)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from corpuslens.functions import text as tx
from corpuslens.functions.ranking import spread_row_number
from corpuslens.functions.tiles import (
    DIGITS, MAX_TASKS, PAIR_ROWS, Squares, own, pieces, smallest_k, tile_nearest, tile_run, unit_rows, with_blocks)
from corpuslens.operators.text import doc_counts
from corpuslens.session import dropped, stored

KEYS = ["dataset_id", "space"]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """v / max(norm, 1e-12)."""
    n = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x / n)


def unit_points(points: DataFrame) -> DataFrame:
    return points.withColumn("v", unit(F.col("v")))


def vector_sums(points: DataFrame, keys) -> DataFrame:
    """(keys, n, s): vector sums with map-side combine (no per-dimension rows)."""
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), Summarizer.sum(array_to_vector("v")).alias("_s")
    ).withColumn("s", vector_to_array("_s")).drop("_s")


# ------------------------------------------------------------------ TF-IDF

def tfidf(docs: DataFrame, min_df=2, sublinear=True, keys=("dataset_id",), tokens=None, numbered=False) -> DataFrame:
    """(keys, doc_id, label, term, w): L2-normalised weights in long form.

    idf = ln((1 + n) / (1 + df)) + 1; tf is 1 + ln(tf) when sublinear. ``numbered`` adds tid,
    the number of a term in its corpus. Texts are cut into terms once; a document's are written as one row.
    """
    keys = list(keys)
    who = [*keys, "doc_id", "label"]
    rows = stored(doc_counts(docs, tx.term_tokens(F.col("text")) if tokens is None else tokens, who))
    dt = rows.select(*who, F.inline(F.arrays_zip("w", "tf")).alias("term", "tf"))
    out = weigh(dt, docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, min_df, sublinear, numbered)
    out._rows = rows
    return out


def weigh(dt: DataFrame, sizes: DataFrame, keys, min_df=2, sublinear=True, numbered=False) -> DataFrame:
    df = dt.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= min_df)
    number = []
    if numbered:
        # a row per term: pairs of document and term are not joined again for its number
        df, number = spread_row_number(stored(df).withColumn("_h", F.md5("term")), keys, "_h", "tid").drop("_h"), ["tid"]
    idf = df.join(sizes, list(keys)).select(
        *keys, "term", *number, (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    if numbered:
        idf = stored(idf)
    tf = (1 + F.log("tf")) if sublinear else F.col("tf")
    raw = dt.join(idf, [*keys, "term"]).withColumn("w", tf * F.col("idf")).drop("tf", "idf")
    per_doc = Window.partitionBy(*keys, "doc_id")
    return raw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(per_doc)))


# ------------------------------------------------------------------ neighbours

def distance_profile(points: DataFrame, metric="cosine", keys=KEYS) -> DataFrame:
    """(keys, doc_id, n, mean, nearest, farthest) over all other rows of the corpus."""
    def stats(d):
        total = d.sum(axis=1)
        if not np.isnan(total).any():
            return np.full(len(d), d.shape[1]), total, d.min(axis=1), d.max(axis=1)
        ok = ~np.isnan(d)
        return (ok.sum(axis=1), np.where(ok, d, 0.0).sum(axis=1), np.where(ok, d, np.inf).min(axis=1),
                np.where(ok, d, -np.inf).max(axis=1))

    def kernel(a, b, same):
        if metric == "cosine":
            ua, ub = unit_rows(a.v), unit_rows(b.v)

            def dist(i, j):
                return np.maximum(1.0 - ua[i] @ ub[j].T, 0.0)
        else:
            squares = Squares(a, b)

            def dist(i, j):
                return np.sqrt(squares(i, j))

        def empty(x):
            return np.zeros(len(x), int), np.zeros(len(x)), np.full(len(x), np.inf), np.full(len(x), -np.inf)

        def add(held, rows, d):
            n, total, near, far = stats(d)
            held[0][rows] += n
            held[1][rows] += total
            np.minimum(held[2][rows], near, out=held[2][rows])
            np.maximum(held[3][rows], far, out=held[3][rows])

        of_a = empty(a)
        of_b = of_a if same else empty(b)
        for i, j, both in pieces(a, b, same):
            d = dist(i, j)
            me = own(a, b, i, j, same)
            if me is not None:
                d[me] = np.nan
            add(of_a, i, d)
            if both:
                add(of_b, j, d.T)
        n, total, near, far = of_a if same else (np.concatenate(x) for x in zip(of_a, of_b))
        return {"doc_id": a.id if same else np.concatenate([a.id, b.id]), "n": n, "total": total,
                "near": np.round(near, DIGITS) + 0.0, "far": np.round(far, DIGITS) + 0.0}

    parts = tile_run(points, keys, kernel, "doc_id long, n long, total double, near double, far double")
    return parts.groupBy(*keys, "doc_id").agg(
        F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"),
        F.min("near").alias("nearest"), F.max("far").alias("farthest"))


def _merge_knn(parts: DataFrame, keys, k: int) -> DataFrame:
    w = Window.partitionBy(*keys, "doc_id").orderBy("dist", "nbr")
    return parts.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)


def knn(points: DataFrame, k=5, metric="cosine", keys=KEYS) -> DataFrame:
    """(keys, doc_id, label, nbr, nbr_label, dist, pos): exact k nearest others.

    Each tile gives the best k of one block for each row of the other; a row's
    final group is k rows per block. Equal distances go to the lower id.
    """
    return _merge_knn(tile_nearest(points, keys, k, metric), list(keys), k)


TERM_CHUNK = 1024   # terms of a dense product
STRIP = 512         # rows whose neighbours are picked at once
DENSE = 2048        # a term of more than one in this many pairs goes into the dense product
PRODUCTS = 1 << 21  # products of the other terms that are made at once


def sparse_similarity(qi, qj, qw, si, sj, sw, nq, ns):
    """Products of two blocks in triplet form (row, term, weight).

    Terms that many pairs share go into dense products by chunks; of the others, only
    pairs that share them are gone through.
    """
    out = np.zeros((nq, ns))
    shared = np.intersect1d(qj, sj)

    def by_term(i, j, w):
        k = np.searchsorted(shared, j)
        ok = k < len(shared)
        ok[ok] = shared[k[ok]] == j[ok]
        o = np.flatnonzero(ok)[np.argsort(k[ok], kind="stable")]
        return i[o], k[o], w[o], np.bincount(k[o], minlength=len(shared))
    (qi, qk, qw, qn), (si, sk, sw, sn) = by_term(qi, qj, qw), by_term(si, sj, sw)
    dense = qn * sn * DENSE > nq * ns
    place = np.cumsum(dense) - 1
    for lo in range(0, int(dense.sum()), TERM_CHUNK):
        hi = min(lo + TERM_CHUNK, int(dense.sum()))
        a, b = np.zeros((nq, hi - lo)), np.zeros((ns, hi - lo))
        for m, i, k, w in ((a, qi, qk, qw), (b, si, sk, sw)):
            ok = dense[k] & (place[k] >= lo) & (place[k] < hi)
            m[i[ok], place[k[ok]] - lo] = w[ok]
        out += a @ b.T
    first = np.cumsum(sn) - sn
    rare = ~dense[qk]
    qi, qk, qw = qi[rare], qk[rare], qw[rare]
    n, flat = sn[qk], out.reshape(-1)
    ends = np.cumsum(n)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - n[lo] + PRODUCTS, side="right")))
        m = n[lo:hi]
        at = np.arange(m.sum()) + np.repeat(first[qk[lo:hi]] - (np.cumsum(m) - m), m)
        np.add.at(flat, np.repeat(qi[lo:hi], m) * ns + si[at], np.repeat(qw[lo:hi], m) * sw[at])
        lo = hi
    return out


def with_numbers(weights: DataFrame, keys) -> DataFrame:
    """Adds tid, the number of a term in its corpus, if it is not there."""
    if "tid" in weights.columns:
        return weights
    terms = weights.select(*keys, "term").distinct().withColumn("_h", F.md5("term"))
    return weights.join(stored(spread_row_number(terms, keys, "_h", "tid").select(*keys, "term", "tid")), [*keys, "term"])


def sparse_rows(weights: DataFrame, docs: DataFrame, keys) -> DataFrame:
    """One row per document: term numbers and weights as arrays. Documents without a
    known term get empty arrays, so none is lost. Weights that have no tid get one."""
    keys = list(keys)
    rows = with_numbers(weights, keys).groupBy(*keys, "doc_id").agg(F.collect_list(F.struct("tid", "w")).alias("e"))
    return docs.select(*keys, "doc_id", "label").join(rows, [*keys, "doc_id"], "left").select(
        *keys, "doc_id", "label",
        F.coalesce(F.col("e.tid"), F.array().cast("array<bigint>")).alias("tid"),
        F.coalesce(F.col("e.w"), F.array().cast("array<double>")).alias("w"))


SPARSE_ROWS = 8192   # rows of the largest block of sparse rows; tiles are worked off in parts of PAIR_ROWS
ROUND_ROWS = 1 << 18  # copies of rows that one round of tiles is dealt
SLICE_ROWS = 1 << 15  # documents whose weights are gathered at a time


def _gathered(weights: DataFrame, docs: DataFrame, keys) -> DataFrame:
    """``sparse_rows``, written once, by slices of documents: what is shuffled at a time does not grow with them."""
    n = max(1, -(-docs.count() // SLICE_ROWS))
    weights, out = with_numbers(weights, keys), []  # one numbering for all slices
    for x in range(n):
        here = F.pmod(F.xxhash64("doc_id"), F.lit(n)) == x
        out.append(stored(sparse_rows(weights.filter(here), docs.filter(here), keys).withColumn("tid", F.col("tid").cast("array<int>"))))
    return reduce(DataFrame.unionByName, out)


def _sparse_tile(a, b, same: bool, k: int):
    """(query block, its rows, columns, distances): the k nearest of each row, tried in parts of at most PAIR_ROWS rows.

    A block is (ids, labels, row starts, term numbers, weights)."""
    def part(x, lo, hi):
        ends = x[2]
        hi = min(hi, len(x[0]))
        return np.repeat(np.arange(hi - lo), np.diff(ends[lo:hi + 1])), x[3][ends[lo]:ends[hi]], x[4][ends[lo]:ends[hi]], hi - lo

    best: dict = {}

    def keep(side, q, s, m, i, j):
        for lo in range(0, m.shape[0], STRIP):
            d = np.round(1.0 - m[lo:lo + STRIP], DIGITS) + 0.0
            n = d.shape[0]
            d[q[0][i + lo:i + lo + n, None] == s[0][None, j:j + m.shape[1]]] = np.nan
            r, c = smallest_k(d, k)
            best.setdefault((side, i + lo), []).append((r, c + j, d[r, c]))

    for i in range(0, len(a[0]), PAIR_ROWS):
        ai, at, aw, an = part(a, i, i + PAIR_ROWS)
        for j in range(i if same else 0, len(b[0]), PAIR_ROWS):
            bi, bt, bw, bn = part(b, j, j + PAIR_ROWS)
            sims = sparse_similarity(ai, at, aw, bi, bt, bw, an, bn)  # serves both directions
            keep(0, a, b, sims, i, j)
            if not same or i != j:
                keep(1, b, a, sims.T, j, i)
    if same:  # both directions are rows of one block, in strips of the same places
        for (side, lo), x in [x for x in best.items() if x[0][0] == 1]:
            best.setdefault((0, lo), []).extend(x)
            del best[side, lo]
    for (side, lo), x in best.items():
        r, c, d = (np.concatenate([y[f] for y in x]) for f in range(3))
        o = np.lexsort((c, d, r))
        r, c, d = r[o], c[o], d[o]
        first = np.arange(len(r)) - np.searchsorted(r, r) < k
        yield side, r[first] + lo, c[first], d[first]


def knn_sparse(weights: DataFrame, docs: DataFrame, k=5, keys=("dataset_id",), last=False) -> DataFrame:
    """Exact cosine neighbours on TF-IDF weights, by the same tiles.

    Joining documents on a shared term would emit all pairs of a frequent term;
    here two bounded blocks of sparse rows meet and only the best k leave.
    Documents without a shared term are at distance 1.

    The rows are written once. Tiles are dealt in rounds of about ROUND_ROWS copies of rows,
    and only the best k so far are kept between rounds: the folders do not grow with the
    number of blocks, as they would if every row were copied once per block at the same time.
    ``last``: the weights are not read after this, so the terms that ``tfidf`` has written go.
    """
    keys = list(keys)
    rows = with_blocks(_gathered(weights, docs, keys), keys, SPARSE_ROWS).drop("_n")
    if last:
        dropped(weights._rows)
    label = docs.schema["label"].dataType.simpleString()
    schema = T.StructType([docs.schema[x] for x in keys] + T.StructType.fromDDL(
        f"doc_id long, label {label}, nbr long, nbr_label {label}, dist double").fields)
    arrow = to_arrow_schema(schema)

    def block(tbl):
        tbl = tbl.sort_by("doc_id")
        t, w = tbl["tid"].combine_chunks(), tbl["w"].combine_chunks()
        ends = t.offsets.to_numpy()
        return tbl["doc_id"].to_numpy(), tbl["label"].to_numpy(), ends - ends[0], t.flatten().to_numpy(), w.flatten().to_numpy()

    def run(key, tbl):
        side = tbl["_side"].to_numpy()
        a = block(tbl.filter(pa.array(side == 0)))
        same = key[len(keys)].as_py() == key[len(keys) + 1].as_py()
        b = a if same else block(tbl.filter(pa.array(side == 1)))
        out = []
        if len(a[0]) and len(b[0]):
            for back, r, c, d in _sparse_tile(a, b, same, k):
                q, s = (b, a) if back else (a, b)
                cols = [pa.array([y.as_py()] * len(r), arrow.field(i).type) for i, y in enumerate(key[:len(keys)])]
                cols += [pa.array(y, arrow.field(f).type) for f, y in (
                    ("doc_id", q[0][r]), ("label", q[1][r]), ("nbr", s[0][c]), ("nbr_label", s[1][c]), ("dist", d))]
                out.append(pa.Table.from_arrays(cols, schema=arrow))
        return pa.concat_tables(out) if out else arrow.empty_table()

    sizes = rows.groupBy(*keys, "_nb").agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum(F.col("n") * F.col("_nb")).alias("copies"), F.sum(F.col("_nb").cast("long") * (F.col("_nb") + 1) / 2).alias("tiles")).first()
    rounds, tiles, best = max(1, -(-(sizes.copies or 0) // ROUND_ROWS)), sizes.tiles or 1, None
    place = F.col("_tj").cast("long") * (F.col("_tj") + 1) / 2 + F.col("_ti")
    mine = F.floor(place * rounds / (F.col("_nb").cast("long") * (F.col("_nb") + 1) / 2))
    copies = rows.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))).select(
        *keys, "doc_id", "label", "tid", "w", "_nb", F.least("_b", "_j").alias("_ti"), F.greatest("_b", "_j").alias("_tj"),
        (F.col("_b") > F.col("_j")).cast("int").alias("_side"))
    for x in range(rounds):
        now = copies.filter(mine == x).drop("_nb").repartition(min(int(8 * tiles / rounds) + 1, MAX_TASKS), *keys, "_ti", "_tj")
        got = now.groupBy(*keys, "_ti", "_tj").applyInArrow(run, schema)
        got = _merge_knn(got if best is None else best.drop("pos").unionByName(got), keys, k)
        if rounds == 1:
            return got
        got, old = stored(got), best
        if old is not None:
            dropped(old)
        best = got
    return best


def same_label_counts(neighbours: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, doc_id, label, same, k): neighbours with the row's own label."""
    return neighbours.groupBy(*keys, "doc_id", "label").agg(
        F.sum((F.col("label") == F.col("nbr_label")).cast("int")).alias("same"),
        F.count(F.lit(1)).alias("k"))


def kdn(same: DataFrame, keys=KEYS) -> DataFrame:
    """Mean share of disagreeing neighbours, and the share of hard rows."""
    d = (F.col("k") - F.col("same")) / F.col("k")
    return same.groupBy(*keys).agg(
        F.avg(d).alias("kdn"), F.avg((d > 0.5).cast("int")).alias("hard_frac"))


def minority_typology(same: DataFrame, keys=KEYS) -> DataFrame:
    """Safe, borderline, rare and outlier shares of the smallest class (of equal
    classes the one seen first)."""
    cls = same.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_c"), F.min("doc_id").alias("_f"))
    small = cls.groupBy(*keys).agg(F.min_by("label", F.struct("_c", "_f")).alias("label"))
    s = same.join(small, [*keys, "label"], "left_semi")

    def share(lo, hi):
        return F.avg(F.col("same").between(lo, hi).cast("int"))
    return s.groupBy(*keys).agg(
        share(4, 5).alias("mt_safe"), share(2, 3).alias("mt_borderline"),
        share(1, 1).alias("mt_rare"), share(0, 0).alias("mt_outlier"))


def nn1_disagreement(points: DataFrame, keys=KEYS) -> DataFrame:
    one = knn(points, 1, "cosine", keys)
    return one.groupBy(*keys).agg(
        F.avg((F.col("label") != F.col("nbr_label")).cast("int")).alias("knn1_disagreement"))


# ------------------------------------------------------------------ classes

def centroid_gap(points: DataFrame, keys=KEYS) -> DataFrame:
    """One minus the mean cosine of class centroids; 0 with a single class.

    The mean over pairs follows from the sum of the k unit centroids:
    (|sum|^2 - sum |u|^2) / (k (k - 1)), so no pair is formed.
    """
    c = vector_sums(points, [*keys, "label"])
    u = c.withColumn("v", unit(F.transform("s", lambda x: x / F.col("n"))))
    t = u.withColumn("_uu", dot(F.col("v"), F.col("v"))).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), F.sum("_uu").alias("uu"), Summarizer.sum(array_to_vector("v")).alias("_s"))
    s = vector_to_array("_s")
    mean = (dot(s, s) - F.col("uu")) / (F.col("k") * (F.col("k") - 1))
    return t.select(*keys, F.when(F.col("k") >= 2, 1 - mean).otherwise(F.lit(0.0)).alias("centroid_cosine_gap"))


def class_array(sums: DataFrame, keys, fields) -> DataFrame:
    """One row per key group holding all its classes (bounded by classes x dimensions)."""
    return sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("classes"))


def silhouette(points: DataFrame, keys=KEYS) -> DataFrame:
    """Mean cosine silhouette with the labels as clusters, in linear time.

    The mean distance to a class is 1 - u.S/n with S the class sum of unit
    vectors; the own class leaves the row itself out; a singleton scores 0.
    """
    u = unit_points(points)
    cls = class_array(vector_sums(u, [*keys, "label"]), keys, ["label", "n", "s"])
    j = u.join(cls, list(keys))
    per = F.transform("classes", lambda c: F.struct(
        (c["label"] == F.col("label")).alias("own"), c["n"].alias("n"),
        (c["n"] - dot(F.col("v"), c["s"])).alias("total")))
    j = j.withColumn("_p", per).withColumn("_self", 1 - dot(F.col("v"), F.col("v")))
    own = F.get(F.filter("_p", lambda c: c["own"]), F.lit(0))
    a = (own["total"] - F.col("_self")) / (own["n"] - 1)
    b = F.array_min(F.transform(F.filter("_p", lambda c: ~c["own"]), lambda c: c["total"] / c["n"]))
    top = F.greatest(a, b)
    sil = F.when(own["n"] == 1, 0.0).when(top == 0, 0.0).otherwise((b - a) / top)
    out = j.withColumn("_k", F.size("classes")).select(*keys, "_k", sil.alias("_sil")).groupBy(*keys).agg(
        F.avg("_sil").alias("m"), F.max("_k").alias("k"), F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.when((F.col("k") >= 2) & (F.col("n") > F.col("k")), F.col("m")).otherwise(
        F.lit(0.0)).alias("silhouette_by_label"))
