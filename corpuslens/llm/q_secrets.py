"""Query of secret scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.llm.common import Scratch
from corpuslens.llm.queries import query
from corpuslens.llm.secrets import RULES, count_of, listed, secrets
from corpuslens.sources.bindings import table


def _found(k: int) -> str:
    r = RULES[k]
    p = r.java.replace("'", "''")
    return (f"SELECT doc_id, {k} AS kind, unnest(regexp_extract_all(text, '{p}')) AS m, unnest(regexp_extract_all(text, '{p}', {r.group})) AS g, "
            f"unnest(string_split_regex(text, '{p}')[:-2]) AS gap, generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS i "
            f"FROM d WHERE regexp_matches(text, '{p}')")


LEAST = "CASE kind " + " ".join(f"WHEN {k} THEN {r.least}" for k, r in enumerate(RULES)) + " END"
NAME = "CASE kind " + " ".join(f"WHEN {k} THEN '{r.name}'" for k, r in enumerate(RULES)) + " END"
BASE = ", ".join(str(k) for k, r in enumerate(RULES) if r.base)
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({' UNION ALL '.join(_found(k) for k in range(len(RULES)))}),
placed AS (SELECT doc_id, kind, g, length(m) AS n, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM found),
spans AS (SELECT doc_id, kind, stop - n AS start, {NAME} || ':' || CAST(stop - n AS BIGINT) || ':' || CAST(stop AS BIGINT) AS s FROM placed WHERE length(g) >= {LEAST}),
sums AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(s, ',' ORDER BY start, kind) FILTER (kind IN ({BASE})) AS base, string_agg(s, ',' ORDER BY start, kind) AS spans FROM spans GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN sums USING (doc_id)"""


@query("op13_secret_scan", SQL)
def op13(spark, sf_dir):
    r = secrets(table(spark, sf_dir, "documents"), Scratch(spark, "secrets"))
    kinds = {x.name: k for k, x in enumerate(RULES) if x.base}
    return r.select("doc_id", *[count_of(F.col("base"), k).alias(f"n_{n}") for n, k in kinds.items()],
                    F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("every")).alias("spans"))
