"""Landmark learners and learning curves, all folds and corpora in one plan.

``assign`` tables say which document plays which role where:
(dataset_id, cfg, doc_id, label, role) with role 'train' or 'test'; ``cfg`` is a
fold, or a (size, seed) pair of a learning curve.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.functions import text as tx
from corpuslens.functions.ranking import pick_key, spread_row_number, top_k
from corpuslens.functions.tiles import DIGITS
from corpuslens.operators.text import doc_terms
from corpuslens.operators.vectors import class_array, dot, unit_points, vector_sums
from corpuslens.session import stored

SEED = 42
# Learning-curve sizes and seeds.
SIZES = (25, 50, 100, 200)
SEEDS = (0, 1, 2)
TEST_SHARE = 0.3


def folds(rows: DataFrame, k=5, keys=("dataset_id",), seed=SEED) -> DataFrame:
    """Adds a stratified fold 0..k-1: places by pick key inside each class, modulo k."""
    t = rows.withColumn("_key", pick_key(seed, "doc_id"))
    t = spread_row_number(t, [*keys, "label"], "_key", "_rn")
    return t.withColumn("fold", ((F.col("_rn") - 1) % k).cast("int")).drop("_key", "_rn")


def fold_roles(folded: DataFrame, k=5) -> DataFrame:
    """Every document once per fold: 'test' in its own, 'train' elsewhere."""
    return folded.withColumn("cfg", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select(
        "dataset_id", F.col("cfg").cast("string").alias("cfg"), "doc_id", "label",
        F.when(F.col("cfg") == F.col("fold"), "test").otherwise("train").alias("role"))


def macro_f1(predicted: DataFrame, keys) -> DataFrame:
    """(keys, f1): mean F1 over the classes of truth or prediction; 0 where undefined."""
    c = predicted.groupBy(*keys, "label", "pred").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    sides = F.array(F.struct(F.col("label").alias("cls"), hit.alias("tp")),
                    F.struct(F.col("pred").alias("cls"), F.lit(0).cast("bigint").alias("tp")))
    s = c.select(*keys, "n", F.explode(sides).alias("s")).groupBy(*keys, "s.cls").agg(
        F.sum("s.tp").alias("tp"), F.sum("n").alias("both"))
    return s.groupBy(*keys).agg(F.avg(2 * F.col("tp") / F.col("both")).alias("f1"))


# ------------------------------------------------------------------ nearest centroid

def _nearest(classes="classes"):
    """Label of the class with the smallest rounded distance; ties to the lowest label."""
    return F.array_min(F.transform(classes, lambda c: F.struct(
        F.round(dot(c["s"], c["s"]) / (c["n"] * c["n"]) - 2 * dot(F.col("v"), c["s"]) / c["n"], DIGITS).alias("d"),
        c["label"].alias("label"))))["label"]


def nc_dense_cv(points: DataFrame, k=5, keys=("dataset_id", "space")) -> DataFrame:
    """(keys, f1): k-fold nearest centroid on unit vectors.

    One pass for all folds: the training sum of a fold is the class total minus
    the fold's own sum.
    """
    keys = list(keys)
    p = unit_points(folds(points, k, keys))
    own = vector_sums(p, [*keys, "label", "fold"])
    total = own.groupBy(*keys, "label").agg(
        F.sum("n").alias("tn"), Summarizer.sum(array_to_vector("s")).alias("_t"),
        F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n", "s")))).alias("own"))
    total = total.withColumn("t", vector_to_array("_t")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    part = F.try_element_at("own", F.col("fold"))
    train = total.select(
        *keys, "fold", "label", (F.col("tn") - F.coalesce(part["n"], F.lit(0))).alias("n"),
        F.when(part.isNull(), F.col("t")).otherwise(F.zip_with("t", part["s"], lambda a, b: a - b)).alias("s")).filter("n > 0")
    j = p.join(class_array(train, [*keys, "fold"], ["label", "n", "s"]), [*keys, "fold"])
    f = macro_f1(j.select(*keys, "fold", "label", _nearest().alias("pred")), [*keys, "fold"])
    return f.groupBy(*keys).agg(F.avg("f1").alias("f1"))


def nc_dense(points: DataFrame, assign: DataFrame) -> DataFrame:
    """(dataset_id, cfg, label, pred) on unit vectors for any assignment."""
    p = unit_points(points.select("dataset_id", "doc_id", "v"))
    a = assign.join(p, ["dataset_id", "doc_id"])
    cls = class_array(vector_sums(a.filter("role = 'train'"), ["dataset_id", "cfg", "label"]),
                      ["dataset_id", "cfg"], ["label", "n", "s"])
    return a.filter("role = 'test'").join(cls, ["dataset_id", "cfg"]).select(
        "dataset_id", "cfg", "label", _nearest().alias("pred"))


def plays(assign: DataFrame, cfgs) -> DataFrame:
    """(dataset_id, doc_id, own, m, te): what a document does in every configuration of
    ``cfgs``, as arrays in their order. own: per label the training rows; m: all rows; te: test rows."""
    def rows(role):
        return F.array(*[F.sum(((F.col("cfg") == c) & (F.col("role") == role)).cast("int")) for c in cfgs])
    per = assign.groupBy("dataset_id", "doc_id", "label").agg(rows("train").alias("tr"), rows("test").alias("te"))
    at = range(len(cfgs))
    return per.groupBy("dataset_id", "doc_id").agg(
        F.collect_list(F.struct("label", "tr")).alias("own"),
        F.array(*[F.sum(F.get("tr", F.lit(i)) + F.get("te", F.lit(i))) for i in at]).alias("m"),
        F.array(*[F.sum(F.get("te", F.lit(i))) for i in at]).alias("te"))


def by_cfg(rows: DataFrame, keys, cfgs, value: str, out: str) -> DataFrame:
    """(keys, out): the values of the configurations as one array; 0 where there is none."""
    return rows.groupBy(*keys).agg(F.array(*[
        F.sum(F.when(F.col("cfg") == c, F.col(value)).otherwise(0)) for c in cfgs]).alias(out))


def nc_tfidf(terms: DataFrame, assign: DataFrame, min_df=2) -> DataFrame:
    """(dataset_id, cfg, doc_id, label, pred): nearest centroid on TF-IDF fitted on the
    training documents of each configuration.

    ``terms`` is (dataset_id, doc_id, term, tf). Squared distance to a centroid c
    is |x|^2 + |c|^2 - 2 x.c, so only the terms a test document shares with a
    class are joined. Configurations share every pass: a document's terms are written
    once, as one row, and the counts, weights and sums of all configurations are
    arrays beside a term or a document, so no term is copied per configuration.
    """
    key, doc, word = ["dataset_id", "cfg"], ["dataset_id", "doc_id"], ["dataset_id", "term"]
    assign = stored(assign)
    cfgs = sorted(r["cfg"] for r in assign.select("cfg").distinct().collect())
    at = range(len(cfgs))
    tr = assign.filter("role = 'train'")
    nc = tr.groupBy(*key, "label").agg(F.count(F.lit(1)).alias("nc"))
    if not cfgs:
        return assign.select(*key, "doc_id", "label", F.col("label").alias("pred"))

    def each(f):
        return F.array(*[f(i) for i in at])

    def sums(f, out):
        return F.array(*[F.sum(f(i)) for i in at]).alias(out)

    def get(c, i):
        return F.get(c, F.lit(i))

    rows = terms.groupBy(*doc).agg(F.collect_list("term").alias("w"), F.collect_list("tf").alias("tf"))
    rows = stored(rows.join(plays(assign, cfgs), doc))

    def words(d, *keep):
        x = d.select(*keep, F.explode(F.arrays_zip("w", "tf")).alias("x"))
        return x.select(*keep, F.col("x.w").alias("term"), (1 + F.log(F.col("x.tf"))).alias("a"))

    # document frequencies in the training rows of every configuration
    train = rows.filter(F.exists("own", lambda o: F.exists(o["tr"], lambda n: n > 0)))
    df = words(train.withColumn("tr", F.zip_with("m", "te", lambda a, b: a - b)), "dataset_id", "tr").groupBy(*word).agg(
        sums(lambda i: get("tr", i), "df"))
    size = by_cfg(nc, ["dataset_id"], cfgs, "nc", "n")
    idf = df.join(size, "dataset_id").select(*word, each(lambda i: F.when(
        get("df", i) >= min_df, F.log((1 + get("n", i)) / (1 + get("df", i))) + 1).otherwise(0.0)).alias("idf"))
    idf = stored(idf.filter(F.exists("idf", lambda x: x > 0)))
    norms = words(rows, *doc).join(idf, word).groupBy(*doc).agg(
        sums(lambda i: F.pow(F.col("a") * get("idf", i), 2), "q"))
    norms = rows.select(*doc, "m", "te").join(norms, doc).select(*doc, "te", each(
        lambda i: F.when(get("m", i) * get("q", i) > 0, 1 / F.sqrt(get("m", i) * get("q", i))).otherwise(0.0)).alias("r"))
    norms = stored(norms)
    # class sums of a / norm; a term's idf is a factor of them
    t = train.select(*doc, "w", "tf", "own").join(norms.select(*doc, "r"), doc)
    t = t.select("dataset_id", "w", "tf", "r", F.explode("own").alias("o")).select(
        "dataset_id", F.col("o.label").alias("cls"), "w", "tf", F.zip_with("o.tr", "r", lambda a, b: a * b).alias("s"))
    cent = words(t.filter(F.exists("s", lambda x: x > 0)), "dataset_id", "cls", "s").groupBy("dataset_id", "cls", "term").agg(
        sums(lambda i: F.col("a") * get("s", i), "s"))
    many = by_cfg(nc.withColumnRenamed("label", "cls"), ["dataset_id", "cls"], cfgs, "nc", "nc")
    cent = stored(cent.join(many, ["dataset_id", "cls"]).join(idf, word).select(*word, "cls", "idf", each(
        lambda i: F.when(get("nc", i) > 0, get("s", i) * get("idf", i) / get("nc", i)).otherwise(0.0)).alias("c")))
    sq = cent.groupBy("dataset_id", "cls").agg(sums(lambda i: get("c", i) * get("c", i), "cc"))
    model = cent.groupBy(*word).agg(F.collect_list(F.struct("cls", F.zip_with("idf", "c", lambda a, b: a * b).alias("g"))).alias("of"))
    test = rows.filter(F.exists("te", lambda n: n > 0)).withColumn("on", F.transform("te", lambda n: n > 0))
    dots = words(test, *doc, "on").join(model, word).select(*doc, "on", "a", F.explode("of").alias("o")).groupBy(
        *doc, F.col("o.cls").alias("cls")).agg(sums(
            lambda i: F.when(get("on", i), F.col("a") * F.get("o.g", F.lit(i))).otherwise(0.0), "x"))
    dots = dots.join(norms, doc).select(*doc, "cls", each(
        lambda i: get("x", i) * get("r", i) * get("te", i)).alias("x"))
    per = dots.groupBy(*doc).agg(F.map_from_entries(F.collect_list(F.struct("cls", "x"))).alias("dots"))
    place = (F.array_position(F.array(*[F.lit(c) for c in cfgs]), F.col("cfg")) - 1).cast("int")
    cls = nc.select(*key, F.col("label").alias("cls")).join(sq, ["dataset_id", "cls"], "left").groupBy(*key).agg(
        F.collect_list(F.struct("cls", F.coalesce(F.get("cc", place), F.lit(0.0)).alias("cc"))).alias("classes"))
    t = assign.filter("role = 'test'").join(cls, key).join(per, doc, "left").withColumn("_at", place)
    pred = F.array_min(F.transform("classes", lambda c: F.struct(
        F.round(c["cc"] - 2 * F.coalesce(F.get(F.try_element_at("dots", c["cls"]), F.col("_at")), F.lit(0.0)), DIGITS).alias("d"),
        c["cls"].alias("cls"))))["cls"]
    return t.select(*key, "doc_id", "label", pred.alias("pred"))


def corpus_terms(docs: DataFrame) -> DataFrame:
    return doc_terms(docs, tx.term_tokens(F.col("text")), ["dataset_id", "doc_id"])


def nc_tfidf_cv(docs: DataFrame, k=5, min_df=2) -> DataFrame:
    roles = fold_roles(folds(docs.drop("text"), k), k)
    f = macro_f1(nc_tfidf(corpus_terms(docs), roles, min_df), ["dataset_id", "cfg"])
    return f.groupBy("dataset_id").agg(F.avg("f1").alias("f1"))


# ------------------------------------------------------------------ small trees on words

def _entries(assign: DataFrame) -> DataFrame:
    """(dataset_id, doc_id, e): what a document does, as one array: configuration, label, role, node,
    rows of that kind (mult) and all rows of the document in the configuration (m)."""
    doc = ["dataset_id", "doc_id"]
    per = assign.groupBy(*doc, "cfg", "label", "role").agg(F.count(F.lit(1)).alias("mult"))
    per = per.groupBy(*doc, "cfg").agg(F.sum("mult").alias("m"), F.collect_list(F.struct("label", "role", "mult")).alias("x"))
    per = per.select(*doc, "cfg", "m", F.explode("x").alias("x")).groupBy(*doc)
    return per.agg(F.collect_list(F.struct(
        "cfg", "x.label", "x.role", F.lit(1).cast("long").alias("node"), F.col("x.mult").alias("mult"), "m")).alias("e"))


def bow_tree(terms: DataFrame, assign: DataFrame, depth=1, min_df=2, max_terms: int | None = None) -> DataFrame:
    """(dataset_id, cfg, doc_id, label, pred): gini tree of ``depth`` on term presence,
    balanced class weights, grown level by level for all corpora and folds.

    A document is one row: its terms and what it does in every configuration. A level is
    one aggregate over (node, label, term) with the counts of all configurations as an
    array, so no term is copied per configuration; the weight without a term is the
    node's rest. Then the row moves on to its next nodes, in place.
    """
    key, doc, word = ["dataset_id", "cfg"], ["dataset_id", "doc_id"], ["dataset_id", "term"]
    assign = stored(assign)
    cfgs = sorted(r["cfg"] for r in assign.select("cfg").distinct().collect())
    if not cfgs:
        return assign.select(*key, "doc_id", "label", F.col("label").alias("pred"))
    rows = terms.groupBy(*doc).agg(F.collect_list("term").alias("w"))
    rows = stored(_entries(assign).join(rows, doc, "left"))
    cls = assign.filter("role = 'train'").groupBy(*key, "label").agg(F.count(F.lit(1)).alias("nl"))
    tot = cls.groupBy(*key).agg(F.sum("nl").alias("n"), F.count(F.lit(1)).alias("k"))
    wt = stored(cls.join(tot, key).select(*key, "label", (F.col("n") / (F.col("k") * F.col("nl"))).alias("w")))

    def sums(x, of):
        """Per configuration the sum of ``of`` over the entries of ``x``."""
        return F.array(*[F.aggregate(F.filter(x, lambda e: e["cfg"] == c), F.lit(0).cast("long"), lambda s, e: s + of(e)) for c in cfgs])

    def added(name):
        return F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(len(cfgs))]).alias(name)

    def lengthened(t, name):
        return t.select("*", F.posexplode(name).alias("_at", "c1")).filter("c1 > 0").withColumn(
            "cfg", F.get(F.array(*[F.lit(c) for c in cfgs]), F.col("_at"))).drop("_at", name)

    def train(e):
        return F.filter(e, lambda x: x["role"] == "train")

    # document frequencies in the training rows of every configuration
    df = rows.select("dataset_id", "w", sums(train(F.col("e")), lambda e: e["mult"]).alias("df"))
    df = df.select("dataset_id", F.explode("w").alias("term"), "df").groupBy(*word).agg(added("df"))
    df = df.filter(F.exists("df", lambda n: n >= min_df))
    if max_terms is None:
        vocab = stored(df)
    else:
        top = top_k(lengthened(df, "df").filter(F.col("c1") >= min_df), key, [F.col("c1").desc(), F.col("term")], max_terms, F.col("term"))
        vocab = stored(top.groupBy(*word).agg(F.array(*[F.sum(F.when(F.col("cfg") == c, F.col("c1")).otherwise(0)) for c in cfgs]).alias("df")))
    for level in range(depth):
        flat = rows.select("dataset_id", F.explode("e").alias("e")).select("dataset_id", "e.*").filter("role = 'train'")
        node = flat.groupBy(*key, "node", "label").agg(F.sum("mult").alias("cn")).join(wt, [*key, "label"]).withColumn(
            "wn", F.col("cn") * F.col("w"))
        whole = node.groupBy(*key, "node").agg(
            F.sum("wn").alias("W"), F.sum("cn").alias("C"), F.sum(F.col("wn") * F.col("wn")).alias("Q"),
            F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
        # a document's places: the nodes that it is at in any configuration
        places = F.array_distinct(F.transform(train(F.col("e")), lambda e: F.struct(e["node"].alias("node"), e["label"].alias("label"))))
        slots = F.transform(places, lambda p: F.struct(p.alias("p"), sums(
            F.filter(train(F.col("e")), lambda e: (e["node"] == p["node"]) & (e["label"] == p["label"])),
            lambda e: e["mult"] * e["m"]).alias("c")))
        seen = rows.filter("w IS NOT NULL").select("dataset_id", "w", F.explode(slots).alias("s")).select(
            "dataset_id", "s.p.node", "s.p.label", "s.c", F.explode("w").alias("term"))
        seen = seen.groupBy(*word, "node", "label").agg(added("c")).join(vocab, word)
        seen = seen.withColumn("c", F.zip_with("c", "df", lambda c, n: F.when(n >= min_df, c).otherwise(0))).drop("df")
        s = lengthened(seen, "c").join(node, [*key, "node", "label"]).withColumn("w1", F.col("c1") * F.col("w"))
        s = s.groupBy(*key, "node", "term").agg(
            F.sum("w1").alias("W1"), F.sum("c1").alias("C1"), F.sum(F.col("w1") * F.col("w1")).alias("Q1"),
            # squares of the rest, summed over the classes that have the term
            F.sum((F.col("wn") - F.col("w1")) * (F.col("wn") - F.col("w1")) - F.col("wn") * F.col("wn")).alias("dQ"))
        s = s.join(whole, [*key, "node"]).filter("C1 < C")
        gain = F.round(F.col("Q1") / F.col("W1") + (F.col("Q") + F.col("dQ")) / (F.col("W") - F.col("W1")), DIGITS)
        # largest purity; equal ones take the first term
        best = s.withColumn("g", gain).groupBy(*key, "node").agg(
            F.min(F.struct((-F.col("g")).alias("g"), "term"))["term"].alias("term"))
        best = best.groupBy("dataset_id").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("cfg", "node"), "term"))).alias("best"))

        def move(e):
            has = F.coalesce(F.array_contains("w", F.try_element_at("best", F.struct(e["cfg"].alias("cfg"), e["node"].alias("node")))), F.lit(False))
            # a document of several rows in a configuration counts with each
            return F.struct(e["cfg"].alias("cfg"), e["label"].alias("label"), e["role"].alias("role"), (e["node"] * 2 + has.cast("long")).alias("node"),
                            F.when(has, e["mult"] * e["m"]).otherwise(e["mult"]).alias("mult"), e["m"].alias("m"))
        rows = rows.join(stored(best), "dataset_id", "left").select(*doc, F.transform("e", move).alias("e"), "w")
    flat = rows.select(*doc, F.explode("e").alias("e")).select(*doc, "e.*")
    leaf = flat.filter("role = 'train'").groupBy(*key, "node", "label").agg(F.sum("mult").alias("cn")).join(wt, [*key, "label"]).withColumn(
        "w", F.round(F.col("cn") * F.col("w"), DIGITS))
    pred = leaf.groupBy(*key, "node").agg(F.min(F.struct((-F.col("w")).alias("w"), "label"))["label"].alias("pred"))
    return flat.filter("role = 'test'").join(pred, [*key, "node"]).select(
        *key, "doc_id", "label", F.explode(F.array_repeat("pred", F.col("mult").cast("int"))).alias("pred"))


def bow_tree_cv(docs: DataFrame, depth=1, k=5) -> DataFrame:
    roles = fold_roles(folds(docs.drop("text"), k), k)
    f = macro_f1(bow_tree(corpus_terms(docs), roles, depth), ["dataset_id", "cfg"])
    return f.groupBy("dataset_id").agg(F.avg("f1").alias("f1"))


# ------------------------------------------------------------------ learning curve

def holdout(rows: DataFrame, share=TEST_SHARE, seed=SEED) -> DataFrame:
    """Stratified split: the first ceil-or-floor share of each class by pick key is
    'test' (largest remainders get the leftover places)."""
    c = rows.groupBy("dataset_id", "label").agg(F.count(F.lit(1)).alias("nl"))
    w = Window.partitionBy("dataset_id")
    c = c.withColumn("_n", F.sum("nl").over(w)).withColumn("_t", F.ceil(F.col("_n") * F.lit(share)))
    c = c.withColumn("_x", F.col("nl") * F.col("_t") / F.col("_n")).withColumn("_f", F.floor("_x"))
    order = w.orderBy((F.col("_x") - F.col("_f")).desc(), F.col("nl").desc(), "label")
    c = c.withColumn("q", F.col("_f") + (F.row_number().over(order) <= F.col("_t") - F.sum("_f").over(w)).cast("int"))
    t = rows.select("dataset_id", "doc_id", "label").withColumn("_key", pick_key(seed, "doc_id"))
    t = spread_row_number(t, ["dataset_id", "label"], "_key", "_rn").join(
        c.select("dataset_id", "label", "q"), ["dataset_id", "label"])
    return t.select("dataset_id", "doc_id", "label", F.when(F.col("_rn") <= F.col("q"), "test").otherwise("train").alias("role"))


def subsample_quota(train: DataFrame, sizes=SIZES) -> DataFrame:
    """(dataset_id, size, label, q): at least one row per class, the rest by share;
    missing or surplus places go round the classes by size."""
    c = train.groupBy("dataset_id", "label").agg(F.count(F.lit(1)).alias("nl"))
    c = c.withColumn("n", F.sum("nl").over(Window.partitionBy("dataset_id")))
    c = c.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes]))).filter("size <= n")
    c = c.withColumn("a", F.least("nl", F.greatest(F.lit(1), F.floor(F.col("nl") / F.col("n") * F.col("size")))))
    w = Window.partitionBy("dataset_id", "size")
    c = c.withColumn("diff", F.col("size") - F.sum("a").over(w)).withColumn(
        "ord", F.row_number().over(w.orderBy(F.col("nl").desc(), "label")))
    # each class offers units to add or to give back; round r of the walk uses its r-th unit
    units = F.least(F.abs("diff"), F.when(F.col("diff") > 0, F.col("nl") - F.col("a")).otherwise(F.col("a") - 1))
    u = c.filter("diff <> 0").withColumn("r", F.explode(F.filter(
        F.sequence(F.lit(0).cast("long"), units), lambda i: i > 0)))
    taken = u.withColumn("_p", F.row_number().over(w.orderBy("r", "ord"))).filter(F.col("_p") <= F.abs("diff")).groupBy(
        "dataset_id", "size", "label").agg(F.sum(F.signum("diff")).cast("long").alias("delta"))
    return c.join(taken, ["dataset_id", "size", "label"], "left").select(
        "dataset_id", "size", "label", (F.col("a") + F.coalesce("delta", F.lit(0))).alias("q"))


def strat_subsample(train: DataFrame, sizes=SIZES, seeds=SEEDS) -> DataFrame:
    """(dataset_id, size, seed, doc_id, label): one draw per size and seed."""
    parts = []
    for s in seeds:
        t = train.select("dataset_id", "doc_id", "label").withColumn("_key", pick_key(s, "doc_id"))
        parts.append(spread_row_number(t, ["dataset_id", "label"], "_key", "_rn").withColumn("seed", F.lit(s)).drop("_key"))
    t = reduce(lambda x, y: x.unionByName(y), parts).filter(F.col("_rn") <= max(sizes))
    return t.join(subsample_quota(train, sizes), ["dataset_id", "label"]).filter(F.col("_rn") <= F.col("q")).select(
        "dataset_id", "size", "seed", "doc_id", "label")


def curve_roles(rows: DataFrame, sizes=SIZES, seeds=SEEDS) -> DataFrame:
    """Assignment of a learning curve, cfg = 'size:seed'."""
    split = holdout(rows)
    sub = strat_subsample(split.filter("role = 'train'"), sizes, seeds)
    cfg = F.concat_ws(":", F.col("size").cast("string"), F.col("seed").cast("string"))
    train = sub.select("dataset_id", cfg.alias("cfg"), "doc_id", "label", F.lit("train").alias("role"))
    cfgs = sub.select("dataset_id", cfg.alias("cfg")).distinct().groupBy("dataset_id").agg(F.collect_list("cfg").alias("c"))
    test = split.filter("role = 'test'").join(cfgs, "dataset_id").select(
        "dataset_id", F.explode("c").alias("cfg"), "doc_id", "label", "role")
    return train.unionByName(test)


def curve_points(predicted: DataFrame) -> DataFrame:
    """(dataset_id, size, f1): macro-F1 averaged over the seeds."""
    f = macro_f1(predicted, ["dataset_id", "cfg"])
    return f.groupBy("dataset_id", F.split_part("cfg", F.lit(":"), F.lit(1)).cast("int").alias("size")).agg(
        F.avg("f1").alias("f1"))


def curve_slope(curve: DataFrame, out: str) -> DataFrame:
    return curve.groupBy("dataset_id").agg(F.coalesce(
        F.when(F.count(F.lit(1)) >= 2, F.regr_slope("f1", F.log2("size"))), F.lit(0.0)).alias(out))


def learning_curve(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """(dataset_id, lc_slope_dense, lc_slope_tfidf, lc_auc_gap)."""
    gap = dense.withColumnRenamed("f1", "a").join(sparse.withColumnRenamed("f1", "b"), ["dataset_id", "size"]).groupBy(
        "dataset_id").agg(F.avg(F.col("a") - F.col("b")).alias("lc_auc_gap"))
    return curve_slope(dense, "lc_slope_dense").join(curve_slope(sparse, "lc_slope_tfidf"), "dataset_id").join(gap, "dataset_id")
