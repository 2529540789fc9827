"""Query of personal data."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.llm.common import Scratch
from corpuslens.llm.pii import KINDS, count_of, listed, personal_data
from corpuslens.llm.queries import query
from corpuslens.sources.bindings import table


@query("op3_personal_data")
def op3(spark, sf_dir):
    r = personal_data(table(spark, sf_dir, "documents"), Scratch(spark, "pii"))
    counts = [count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return r.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("every")).alias("spans"))
