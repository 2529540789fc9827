"""Corpora without terms, with one class, without words."""

import random

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import complexity as cx
from corpuslens.operators import prep, protocol, text
from corpuslens.sources import io


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("a", 1, "alpha beta beta gamma", "x"), ("a", 2, "alpha alpha delta beta", "y"), ("b", 3, "one two", "x"), ("b", 4, "three", "y"),
            ("c", 5, "", "x")]
    return spark.createDataFrame(rows, "dataset_id string, doc_id long, text string, label string")


def test_corpora_without_repeated_terms_stay(docs):
    got = {r.dataset_id: r[1] for r in text.corpus_js(docs).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"] > 0 and got["b"] == got["c"] == 0


def test_corpora_without_words_have_no_fertility(spark, docs):
    vocab = spark.createDataFrame([("t", "al", True), ("t", "pha", False), ("t", "o", True), ("t", "ne", False)], "tag string, piece string, initial boolean")
    got = {r.dataset_id: r.fertility for r in text.subword_fertility(docs, vocab).collect()}
    assert set(got) == {"a", "b", "c"} and got["c"] == 0 and got["a"] > 1


def test_long_words_are_cut_into_pieces(spark):
    words = spark.createDataFrame([("a" * 300,)], "word string")
    vocab = spark.createDataFrame([("t", "a", True), ("t", "a", False)], "tag string, piece string, initial boolean")
    assert text.subword_pieces(words, vocab).first()["pieces"] == 300
    assert text.subword_pieces(words, vocab, max_word=100).first()["pieces"] == 1


def test_one_class_has_no_nearer_enemy(spark):
    near = spark.createDataFrame([("a", "s", 1, 0.5, None), ("a", "s", 2, 0.5, None), ("b", "s", 3, 1.0, 2.0)],
                                 "dataset_id string, space string, doc_id long, same double, other double")
    got = {r.dataset_id: r.cx_n2 for r in cx.n2(near, ["dataset_id", "space"]).collect()}
    assert got["a"] == 0 and abs(got["b"] - 1 / 3) < 1e-12


def test_sources_with_a_common_opening_differ(spark):
    start = "x" * 50
    m = spark.createDataFrame([("s1", start + "one"), ("s2", start + "two")], "source string, provenance string")
    assert protocol.source_collisions(m).count() == 0


def test_no_cap_by_default(spark):
    counts = spark.createDataFrame([("a", "x", 5000, 5000, 1), ("a", "y", 4000, 4000, 2)],
                                   "dataset_id string, label string, cnt long, orig long, first_seen long")
    assert {r.cnt for r in prep.prepare_plan(counts).collect()} == {5000, 4000}
    assert sum(r.cnt for r in prep.prepare_plan(counts, cap=3000).collect()) == 3000


def test_zipf_places(spark):
    rows = [("a", k, "aaa " * 8 + "bbb " * 4 + "ccc ddd " * 2 + f"e{'x' * k}y", "x") for k in range(1, 4)]
    d = spark.createDataFrame(rows, "dataset_id string, doc_id long, text string, label string")
    import numpy as np
    n = np.array([24, 12, 6, 6, 1, 1, 1])
    want = np.polyfit(np.log10(np.arange(1, 8)), np.log10(n), 1)[0]
    assert abs(text.zipf_slope(d).first()["ch_zipf_slope"] - want) < 1e-9


def test_sources_and_sinks(spark, docs, tmp_path):
    io.write_datasets(docs, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5
    for k in (1, 2):
        docs.filter(F.col("doc_id") % 2 == k % 2).write.parquet(f"{tmp_path}/split{k}")
    assert io.read_splits(spark, [f"{tmp_path}/split1", f"{tmp_path}/split2"], ["doc_id", "text"]).count() == 5
    io.write_table(docs.select("doc_id", "text"), f"{tmp_path}/json", "json")
    assert spark.read.schema("doc_id long, text string").json(f"{tmp_path}/json").count() == 5
    (tmp_path / "words.tsv").write_text("lemma\tcategory\nHate speech\tinsult\n \tnone\n")
    got = io.read_lexicon(spark, f"{tmp_path}/words.tsv", "EN").collect()
    assert [(r.language, r.lemma, r.n_words, r.category) for r in got] == [("EN", "hate speech", 2, "insult")]


@pytest.mark.parametrize("size", ["64", "1000", "1m"])
def test_quoted_fields_over_lines(spark, tmp_path, size):
    """Line ends, quotes and separators in texts survive, wherever a file is split."""
    rng = random.Random(3)
    texts = ["", None, '"', '""', "a,b", "\n", "x\ny\n\nz", 'he said "no,\n no"', " lead and trail ", "é🙂\n", "\n" * 40, "long " * 200 + "\n" + 'q"' * 60]
    texts += ["".join(rng.choice('ab,"\n é') for _ in range(rng.randrange(60))) for _ in range(150)]
    rows = [(k, t, f"s{k}") for k, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    io.write_table(d.coalesce(2), f"{tmp_path}/csv")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = io.read_delimited(spark, f"{tmp_path}/csv", "doc_id long, text string, source string", header=True)
        # CSV has no empty text: it is read as null
        assert sorted(map(tuple, got.collect())) == [(k, t or None, s) for k, t, s in rows]
        if size == "64":
            assert spark.read.text(f"{tmp_path}/csv").rdd.getNumPartitions() > 50
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
