"""Query of vector code compression."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.llm.codes import book_digest, compress
from corpuslens.llm.common import Scratch
from corpuslens.llm.queries import query
from corpuslens.sources.bindings import table

ROUNDS = 6


def _round(r: int) -> str:
    """Assignment a{r} to codebook c{r}, and the next codebook."""
    return f"""
a{r} AS MATERIALIZED (SELECT r, p, arg_min(e, dist * 16 + e) AS e, min(dist) AS dist FROM (
  SELECT q.r, q.p, c.e, sum((q.x - c.x) * (q.x - c.x)) AS dist FROM q JOIN c{r} c ON q.p = c.p AND q.d = c.d GROUP BY ALL) GROUP BY ALL),
m{r} AS (SELECT q.p, a.e, q.d, sum(q.x) AS s, count(*) AS n FROM q JOIN a{r} a ON q.r = a.r AND q.p = a.p GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, c.d, CAST(coalesce((s - ((s % n) + n) % n) // n, c.x) AS BIGINT) AS x
  FROM c{r} c LEFT JOIN m{r} m ON c.p = m.p AND c.e = m.e AND c.d = m.d)"""


SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, len(embedding) // 8 AS w,
    list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT r, i // w AS p, i % w AS d, v[i + 1] AS x FROM (SELECT r, v, w, unnest(range(len(v))) AS i FROM v)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, d, x FROM q WHERE r <= 16),
{",".join(_round(r) for r in range(ROUNDS))},
z AS MATERIALIZED (SELECT r, p, arg_min(e, dist * 16 + e) AS e, min(dist) AS dist FROM (
  SELECT q.r, q.p, c.e, sum((q.x - c.x) * (q.x - c.x)) AS dist FROM q JOIN c{ROUNDS} c ON q.p = c.p AND q.d = c.d GROUP BY ALL) GROUP BY ALL),
coded AS (SELECT r, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM z GROUP BY r),
books AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, d)) AS h FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM coded JOIN v USING (r), books"""


@query("op12_vector_codes", SQL)
def op12(spark, sf_dir):
    rows, books = compress(table(spark, sf_dir, "embeddings"), Scratch(spark, "codes"), rounds=ROUNDS)
    return rows.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256"))
