"""The pipeline against its operators' contracts on a small table."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslens.llm.common import Scratch
from test_small import brute_components, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("in"))
    rng = random.Random(8)
    leak, base = prose(rng, 20), prose(rng, 80)
    rows = [(k, prose(rng, 80)) for k in range(12)] + [(20, base), (21, base + " more"), (21, base), (None, base), (22, None), (23, "short"),
            (24, "again and again the very same " * 30), (25, prose(rng, 40) + " " + leak), (26, prose(rng, 60) + " a.b@c.org")]
    spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in rows],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def test_stages(spark, folder):
    path, rows = folder
    scratch = Scratch(spark, "t")
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("row", F.lit(1)).withColumn("q", F.lit(2))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.cut(stage(spark, docs, path), name)
        if name != "packing":
            assert out.columns == docs.columns
        kept[name] = sorted((r.doc_id for r in out.select("doc_id").collect()), key=str)
        if name == "personal_data":
            text = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
            assert text[26][0].endswith("[EMAIL]") and text[26][1] == len(text[26][0])
        docs = out
    clean = list(range(12))
    assert kept["quality_rules"] == sorted([*clean, 20, 21, 21, None, 25, 26], key=str)
    assert kept["near_dedup"] == sorted([*clean, 20, 25, 26], key=str)
    assert len(set(x[2] for x in brute_components([r for r in rows if r[0] in kept["quality_rules"]]))) == 15
    assert kept["decontamination"] == kept["personal_data"] == kept["packing"] == sorted([*clean, 20, 26], key=str)


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).select("doc_id").distinct().count() == 14


def test_empty(spark, folder, tmp_path):
    path = folder[0]
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_texts_of_one_id(spark, tmp_path):
    """Different texts without an id, equal in 32 bits: each keeps its own fate."""
    from corpuslens.llm.repeats import removed
    texts = spark.range(300_000).select(F.concat_ws(" ", *[F.md5((F.col("id") * 8 + k).cast("string")) for k in range(7)], F.lit("a.b@c.org")).alias("text"))
    two = texts.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("t")).filter(F.size("t") > 1).orderBy("h").first().t[:2]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(None, t, None, "s", len(t)) for t in two], schema)
    spark.createDataFrame([(1, two[0])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r.text for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()) == sorted(two)
    assert [r.text for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()] == [two[1]]
    again = docs.unionByName(docs.filter(F.col("text") == two[1]).withColumn("doc_id", F.lit(1).cast("long")))
    cut = {(r.doc_id, bytes(r.kept).decode()): len(r.spans) for r in removed(again, Scratch(spark, "t"), least=50).collect()}
    assert cut[None, two[0]] == 0
