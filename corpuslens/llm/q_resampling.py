"""Query of target-distribution importance resampling."""

from __future__ import annotations

from corpuslens.llm.common import Scratch
from corpuslens.llm.queries import query
from corpuslens.llm.resampling import resample
from corpuslens.sources.bindings import table

WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
         "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
#: A CRC is the sum, modulo 2, of what each byte gives by the number of bytes behind it, and of the start value moved over all bytes.
SQL = f"""
WITH RECURSIVE step AS MATERIALIZED (SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS b)),
low AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM documents),
runs AS MATERIALIZED (SELECT doc_id, f, count(*) AS n FROM (
  SELECT doc_id, unnest(w) AS f FROM low
  UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM low)) GROUP BY ALL),
wanted AS MATERIALIZED (SELECT f, count(*) AS n FROM (
  SELECT unnest(w) AS f FROM (SELECT {WORDS} AS w FROM benchmark)
  UNION ALL SELECT w[i] || ' ' || w[i + 1] FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT {WORDS} AS w FROM benchmark))) GROUP BY ALL),
names AS MATERIALIZED (SELECT f, hex(encode(f)) AS x, octet_length(encode(f)) AS size FROM (SELECT f FROM runs UNION SELECT f FROM wanted)),
moved(k, b, v) AS (SELECT 0, b, v FROM step UNION ALL SELECT 0, 256, 4294967295
  UNION ALL SELECT k + 1, moved.b, xor(moved.v >> 8, step.v) FROM moved JOIN step ON step.b = moved.v & 255 WHERE k < (SELECT max(size) FROM names)),
sums AS (SELECT f, size, bit_xor(v) AS v FROM (
  SELECT f, size, size - i AS k, CAST('0x' || substr(x, 2 * i - 1, 2) AS BIGINT) AS b FROM (SELECT *, unnest(range(1, size + 1)) AS i FROM names)) JOIN moved USING (k, b) GROUP BY ALL),
bucket AS MATERIALIZED (SELECT f, xor(xor(sums.v, moved.v), 4294967295) % 10000 AS b FROM sums JOIN moved ON moved.k = size AND moved.b = 256),
s AS (SELECT b, sum(n) AS n FROM runs JOIN bucket USING (f) GROUP BY b),
t AS (SELECT b, sum(n) AS n FROM wanted JOIN bucket USING (f) GROUP BY b),
gain AS (SELECT b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000.0::DOUBLE)
    / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000.0::DOUBLE)))) AS BIGINT) AS g FROM s FULL JOIN t USING (b)),
rated AS (SELECT doc_id, sum(n) AS m, sum(n * g) AS g FROM runs JOIN bucket USING (f) JOIN gain USING (b) GROUP BY 1),
scored AS (SELECT doc_id, len(w) AS words, CAST(coalesce(m, 0) AS BIGINT) AS n_features,
    CAST(coalesce((g - ((g % m) + m) % m) // m, 0) AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS h FROM low LEFT JOIN rated USING (doc_id)),
final AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score, words >= 20 AS able FROM scored),
placed AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS k, count(*) FILTER (able) OVER () AS n FROM final)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND k <= 25 * n // 100 THEN k END AS rank FROM placed"""


@query("op11_importance_resampling", SQL)
def op11(spark, sf_dir):
    r = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "resample"))
    return r.select("doc_id", "n_features", "weight", "score", "rank")
