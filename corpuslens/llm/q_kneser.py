"""Query of language-model scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.llm.common import Scratch, hold_out, narrow
from corpuslens.llm.kneser import score, train
from corpuslens.llm.queries import query
from corpuslens.sources.bindings import table


@query("op8_kneser_ney")
def op8(spark, sf_dir):
    d = narrow(table(spark, sf_dir, "documents"))
    d = d.select("doc_id", hold_out(F.col("doc_id"), 7, 2).alias("held_out"), "text")
    model = train(d.filter("not held_out"), Scratch(spark, "kneser"))
    return (score(d, model).withColumn("train_tokens", F.lit(model["total"]).cast("long"))
            .select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"))
