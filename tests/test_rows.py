"""Terms of a document stay in its row: nothing is copied per fold, and what is shuffled is texts, counts or hits."""

import math
from collections import Counter

from corpuslens.functions import text as tx
from corpuslens.operators import landmark as lm
from corpuslens.operators import panel as pn
from corpuslens.operators import text as op
from pyspark.sql import functions as F

TEXTS = [(i, ("left a b" if i % 3 else "right right c d") + (" common" * (i % 4)) + f" w{i % 5}", "x" if i % 3 else "y") for i in range(30)]
#: One id twice, a text without a known term, one without any.
ROWS = [*TEXTS, TEXTS[7], TEXTS[9], (90, "never", "x"), (91, "", "y")]
ROLES = [(str(c), i, y, "test" if k % 3 == c else "train") for c in range(3) for k, (i, _, y) in enumerate(ROWS)]


def tables(spark):
    docs = spark.createDataFrame([("d", i, t) for i, t, _ in ROWS], "dataset_id string, doc_id long, text string")
    roles = spark.createDataFrame([("d", *r) for r in ROLES], "dataset_id string, cfg string, doc_id long, label string, role string")
    return op.doc_terms(docs, F.split("text", " +"), ["dataset_id", "doc_id"]).filter("term <> ''"), roles


def watched(monkeypatch, module):
    sizes, keep = [], module.stored

    def stored(df):
        sizes.append(df.count())
        return keep(df)
    monkeypatch.setattr(module, "stored", stored)
    return sizes


def counts():
    tf = {}
    for i, t, _ in ROWS:
        tf.setdefault(i, Counter()).update(t.split())
    return tf


def naive_bayes(cfg):
    """By the formulas; a document of several rows counts with each."""
    tf = counts()
    mine = [(i, y, r) for c, i, y, r in ROLES if c == cfg]
    train = [(i, y) for i, y, r in mine if r == "train"]
    df = Counter(w for i, _ in train for w in tf[i])
    idf = {w: math.log((1 + len(train)) / (1 + n)) + 1 for w, n in df.items() if n >= 2}
    times, tests = Counter(i for i, _, _ in mine), Counter(i for i, _, r in mine if r == "test")

    def weights(i):
        raw = {w: n * idf[w] for w, n in tf[i].items() if w in idf}
        size = math.sqrt(times[i] * sum(x * x for x in raw.values()))
        return {w: x / size for w, x in raw.items()}
    cell = {y: Counter() for _, y in train}
    for i, y in train:
        cell[y].update(weights(i))
    every = Counter()
    for c in cell.values():
        every.update(c)
    out = []
    for i, y, r in mine:
        if r == "test":
            s = {c: round(tests[i] * sum(x * math.log((sum(every.values()) + len(every) - sum(m.values())) / (every[w] + 1 - m[w]))
                                         for w, x in weights(i).items()), 10) for c, m in cell.items()}
            out.append((i, y, min((-x, c) for c, x in s.items())[1]))
    return sorted(out)


def test_naive_bayes_stores_a_document_once_for_all_folds(spark, monkeypatch):
    sizes = watched(monkeypatch, pn)
    terms, roles = tables(spark)
    got = pn.complement_nb(terms, roles).collect()
    for c in range(3):
        assert sorted((r.doc_id, r.label, r.pred) for r in got if r.cfg == str(c)) == naive_bayes(str(c))
    assert len(sizes) == 5 and max(sizes[1:]) <= len({i for i, _, _ in ROWS})


def test_tree_stores_a_document_once_for_all_folds(spark, monkeypatch):
    sizes = watched(monkeypatch, lm)
    terms, roles = tables(spark)
    for depth in (1, 2):
        got = lm.bow_tree(terms, roles, depth).collect()
        # 'left' or 'right' tells the class; without either word a row goes to the majority of its leaf
        assert {(r.doc_id, r.label) for r in got} == {(i, y) for i, _, y in ROWS}
        assert all(r.label == r.pred for r in got if r.doc_id < 90)
    assert sizes and sorted(sizes)[-3] <= len({i for i, _, _ in ROWS})  # the two largest are the roles


def test_terms_are_counted_where_their_document_is(spark):
    rows = [("d", 1, "b a b"), ("d", 1, "a"), ("d", 2, None), ("d", 3, ""), ("d", None, "c"), ("d", None, "c")]
    docs = spark.createDataFrame(rows, "dataset_id string, doc_id long, text string")
    got = op.doc_terms(docs, tx.word_tokens(F.col("text")), ["dataset_id", "doc_id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id or 0, r.term, r.tf) for r in got.collect()) == [(0, "c", 2), (1, "a", 2), (1, "b", 2)]
    assert plan.count("hashpartitioning") == 1 and "term" not in "".join(x for x in plan.split("\n") if "hashpartitioning" in x)


def test_only_lexicon_hits_are_shuffled(spark):
    docs = spark.createDataFrame([("d", 1, "a", "en", "bad dog bad"), ("d", 2, "b", "en", "fine"), ("d", 3, "b", None, "bad")],
                                 "dataset_id string, doc_id long, label string, language string, text string")
    lex = spark.createDataFrame([("en", "bad", 1, "p"), ("en", "bad dog", 2, "q")], "language string, lemma string, n_words int, category string")
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = op.lexicon_rates(docs, lex, 2)
        plan = out._jdf.queryExecution().executedPlan().toString()
        r = out.first()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert not [x for x in plan.split("\n") if "SortMergeJoin" in x and "lemma" in x]
    assert (r.hl_doc_rate, r.hl_token_rate, r.hl_class_gap) == (1 / 3, 2 / 5, 1.0)
    assert abs(r.hl_category_entropy - (math.log2(3) - 2 / 3)) < 1e-12


def test_grams_are_made_after_the_texts_have_met(spark):
    """Dealing rows by document again would shuffle every gram of every text."""
    docs = spark.createDataFrame([("d", 1, "aa bb"), ("d", 1, "aa bb")], "dataset_id string, doc_id long, text string")
    once = pn.with_grams(docs.dropDuplicates(["doc_id", "text"]), "char")
    got = op.doc_terms(once, F.col("grams"), ["doc_id", "text"], placed=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1
    assert sorted((r.term, r.tf) for r in got.collect()) == [(" aa", 1), (" aa ", 1), (" bb", 1), (" bb ", 1), ("aa ", 1), ("bb ", 1)]


def test_a_bound_that_no_vocabulary_reaches_changes_nothing(spark):
    terms, roles = tables(spark)
    for fit in (lambda **kw: lm.bow_tree(terms, roles, **kw), lambda **kw: pn.complement_nb(terms, roles, **kw)):
        assert sorted(map(tuple, fit(max_terms=100).collect())) == sorted(map(tuple, fit().collect()))


def test_documents_dealt_by_id_are_not_dealt_again(spark):
    """Rows of one document meet where a join has put them: its text is not shuffled once more."""
    texts = spark.createDataFrame([(1, "b a b"), (1, "c a"), (2, ""), (3, None), (4, "é a")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "y")], "doc_id long, label string")
    docs = texts.join(marks.hint("merge"), "doc_id").withColumn("dataset_id", F.lit("d"))
    counts = op.doc_counts(docs, tx.word_tokens(F.col("text")))
    got = {r.doc_id: dict(zip(r.w, r.tf)) for r in counts.collect()}
    assert got == {1: {"a": 2, "b": 2, "c": 1}, 4: {"a": 1, "é": 1}}
    plan = counts._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 2
