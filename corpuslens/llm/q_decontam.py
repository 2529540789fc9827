"""Query of the benchmark decontamination operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.llm.common import Scratch
from corpuslens.llm.decontam import contamination
from corpuslens.llm.queries import query
from corpuslens.sources.bindings import table


WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
         "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
SQL = f"""
WITH low AS (SELECT doc_id, {WORDS} AS w FROM documents),
items AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
        FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
occ AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM low, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, occ.n, item_id FROM occ JOIN win USING (n, s)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""


@query("op9_benchmark_decontamination", SQL)
def op9(spark, sf_dir):
    docs, tests = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    r = contamination(docs, tests, Scratch(spark, "decontam"))
    return r.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                    (F.col("n_hit") > 0).alias("contaminated"))
