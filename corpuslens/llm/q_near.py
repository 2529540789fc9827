"""Query of the near-duplicate operator."""

from __future__ import annotations

from corpuslens.llm.common import Scratch
from corpuslens.llm.near import near_duplicates
from corpuslens.llm.queries import query
from corpuslens.sources.bindings import table


SQL = """
WITH RECURSIVE low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                         'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS h
      FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM low WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
several AS (SELECT h FROM s GROUP BY 1 HAVING count(*) > 1),
r AS (SELECT s.* FROM s SEMI JOIN several USING (h)),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM r a JOIN r b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN size a ON a.doc_id = x JOIN size b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
ab AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, other) AS (SELECT x, y FROM ab UNION SELECT reach.doc_id, ab.y FROM reach JOIN ab ON ab.x = reach.other),
low_id AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
       doc_id <= coalesce(m, doc_id) AS kept
FROM low LEFT JOIN size USING (doc_id) LEFT JOIN low_id USING (doc_id)"""


@query("op2_minhash_near_dedup", SQL)
def op2(spark, sf_dir):
    r = near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "near"))
    return r.select("doc_id", "n_shingles", "component_id", "kept")
