"""Query of the quality classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.llm.common import hold_out, narrow
from corpuslens.llm.queries import query
from corpuslens.llm.quality import score, train
from corpuslens.sources.bindings import table


@query("op4_quality_classifier")
def op4(spark, sf_dir):
    d = narrow(table(spark, sf_dir, "documents"))
    d = d.select("doc_id", hold_out(F.col("doc_id"), 3, 1).alias("held_out"), "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = train(d.select("doc_id", "text"), labels.filter(~hold_out(F.col("doc_id"), 3, 1)))
    return score(d, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
