"""Corpus preparation over documents, labels, events and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions.text import white_tokens
from corpuslens.operators import prep
from corpuslens.plans.registry import cte, query
from corpuslens.session import cut
from corpuslens.sources import bindings as b

# thresholds that make every rule fire on the given tables
RULES = dict(min_total=20, min_class=3, share=0.2)

WS = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
CLEAN_SQL = b.DOCS_SQL + rf""",
stripped AS (
  SELECT dataset_id, doc_id, label, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS text FROM docs
),
clean AS (
  SELECT * FROM stripped WHERE text <> '' AND lower(text) <> 'nan' AND label IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY dataset_id, text ORDER BY doc_id) = 1
),
counts AS (
  SELECT dataset_id, label, count(*) AS cnt, min(doc_id) AS first_seen FROM clean GROUP BY ALL
)"""
RARE_SQL = """
rare AS (
  SELECT * FROM counts WHERE cnt >= 3
  QUALIFY count(*) OVER (PARTITION BY dataset_id) >= 2
)"""
FLOOR_SQL = """
fl0 AS (
  SELECT *, sum(cnt) OVER d AS n, min(cnt) OVER d AS mn,
         row_number() OVER (PARTITION BY dataset_id ORDER BY cnt, first_seen) = 1 AS is_min
  FROM rare WINDOW d AS (PARTITION BY dataset_id)
),
fl1 AS (
  SELECT *, least(floor(mn * (1 - 0.2::DOUBLE) / 0.2::DOUBLE), n - mn) / CAST(n - mn AS DOUBLE) AS scale FROM fl0
),
floored AS (
  SELECT dataset_id, label, first_seen, cnt AS before,
         CAST(CASE WHEN mn / CAST(n AS DOUBLE) < 0.2::DOUBLE AND NOT is_min
              THEN least(round_even(cnt * scale, 0), cnt) ELSE cnt END AS BIGINT) AS cnt
  FROM fl1
),
rechecked AS (
  SELECT * FROM floored WHERE cnt >= 3 QUALIFY count(*) OVER (PARTITION BY dataset_id) >= 2
),
sized AS (SELECT * FROM rechecked QUALIFY sum(cnt) OVER (PARTITION BY dataset_id) >= 20)"""
CAP_SQL = """
cp0 AS (
  SELECT *, sum(cnt) OVER (PARTITION BY dataset_id) AS n,
         cnt * 200::DOUBLE / CAST(sum(cnt) OVER (PARTITION BY dataset_id) AS DOUBLE) AS exact FROM sized
),
cp1 AS (
  SELECT *, 200 - sum(floor(exact)) OVER (PARTITION BY dataset_id) AS left_over,
         row_number() OVER (PARTITION BY dataset_id ORDER BY exact - floor(exact) DESC, cnt DESC, label) AS by_rem
  FROM cp0
),
final AS (
  SELECT dataset_id, label, CAST(CASE WHEN n > 200 THEN floor(exact) + CASE WHEN by_rem <= left_over THEN 1 ELSE 0 END
         ELSE cnt END AS BIGINT) AS cnt FROM cp1
)"""
WHOLE_SQL = """
final AS (SELECT dataset_id, label, cnt FROM sized)"""
GATE_SQL = """
gate AS (
  SELECT c.dataset_id, coalesce(n, 0) AS n, coalesce(k, 0) AS n_classes, coalesce(mn, 0) AS min_class,
         CASE WHEN coalesce(k, 0) < 2 THEN 'fewer than two classes' WHEN n < 20 THEN 'too few rows'
              WHEN mn < 3 THEN 'class too small'
              WHEN mn / CAST(n AS DOUBLE) < 0.2::DOUBLE - 1e-9 THEN 'minority share too low' ELSE 'kept' END AS reason
  FROM (SELECT DISTINCT dataset_id FROM counts) c LEFT JOIN (
    SELECT dataset_id, CAST(sum(cnt) AS BIGINT) AS n, count(*) AS k, min(cnt) AS mn FROM final GROUP BY ALL) f
  USING (dataset_id)
)"""


def _pick(plan):
    return f"""
picked AS (
  SELECT c.*, row_number() OVER (PARTITION BY c.dataset_id, c.label ORDER BY md5('42:' || c.doc_id)) AS rn, q.cnt
  FROM clean c JOIN {plan} q USING (dataset_id, label)
),
taken AS (SELECT dataset_id, doc_id, label, text FROM picked WHERE rn <= cnt)"""


PREPARED_SQL = [CLEAN_SQL, RARE_SQL, FLOOR_SQL, WHOLE_SQL, GATE_SQL, _pick("final"), """
prepared AS (
  SELECT dataset_id, doc_id, text,
         CAST(dense_rank() OVER (PARTITION BY dataset_id ORDER BY label) - 1 AS INTEGER) AS label
  FROM taken WHERE dataset_id IN (SELECT dataset_id FROM gate WHERE reason = 'kept')
)"""]


def cleaned(spark, sf):
    return prep.clean_text_label(b.docs(spark, sf))


@query("clean_dedup", cte(CLEAN_SQL, select="SELECT dataset_id, doc_id, label, md5(text) AS digest FROM clean"))
def clean_dedup(spark, sf):
    return cleaned(spark, sf).select("dataset_id", "doc_id", "label", F.md5("text").alias("digest"))


@query("rare_class_drop", cte(CLEAN_SQL, RARE_SQL, _pick("rare"), select="SELECT dataset_id, doc_id, label FROM taken"))
def rare_class_drop(spark, sf):
    c = cut(prep.clean_ids(b.docs(spark, sf)))
    counts = prep.class_counts(c)
    return prep.apply_quota(c, prep.plan_rare(counts, 3)).select("dataset_id", "doc_id", "label")


@query("minority_floor", cte(CLEAN_SQL, RARE_SQL, FLOOR_SQL, _pick("sized"),
                             select="SELECT dataset_id, doc_id, label FROM taken"))
def minority_floor(spark, sf):
    c = cut(prep.clean_ids(b.docs(spark, sf)))
    counts = prep.class_counts(c)
    plan = prep.plan_floor(prep.plan_rare(counts, 3), 0.2)
    plan = prep.plan_total(prep.plan_rare(plan, 3), 20)
    return prep.apply_quota(c, plan).select("dataset_id", "doc_id", "label")


@query("stratified_cap", cte(CLEAN_SQL, RARE_SQL, FLOOR_SQL, CAP_SQL, _pick("final"), select="SELECT dataset_id, doc_id, label FROM taken"))
def stratified_cap(spark, sf):
    c = cut(prep.clean_ids(b.docs(spark, sf)))
    counts = prep.class_counts(c)
    plan = prep.plan_floor(prep.plan_rare(counts, 3), 0.2)
    plan = prep.plan_cap(prep.plan_total(prep.plan_rare(plan, 3), 20), 200)
    return prep.apply_quota(c, plan).select("dataset_id", "doc_id", "label")


@query("proportional_cap", cte(CLEAN_SQL, """
q AS (
  SELECT dataset_id, label, CASE WHEN n > 200 THEN least(cnt, greatest(1, CAST(
           round_even(cnt * (200::DOUBLE / n), 0) AS BIGINT))) ELSE cnt END AS cnt
  FROM (SELECT *, CAST(sum(cnt) OVER (PARTITION BY dataset_id) AS DOUBLE) AS n FROM counts)
)""", _pick("q"), select="SELECT dataset_id, doc_id, label FROM taken"))
def proportional_cap(spark, sf):
    c = cut(prep.clean_ids(b.docs(spark, sf)))
    counts = prep.class_counts(c)
    return prep.apply_quota(c, prep.plan_cap(counts, 200, proportional=True)).select(
        "dataset_id", "doc_id", "label")


@query("rule_gate", cte(*PREPARED_SQL[:5], select="SELECT *, reason = 'kept' AS kept FROM gate"))
def rule_gate(spark, sf):
    counts = prep.class_counts(prep.clean_ids(b.docs(spark, sf)))
    plan = prep.plan_floor(prep.plan_rare(counts, 3), 0.2)
    plan = prep.plan_total(prep.plan_rare(plan, 3), 20)
    return prep.gate(counts, plan, 20, 3, 0.2)


@query("prepared", cte(*PREPARED_SQL, select="SELECT dataset_id, doc_id, label, md5(text) AS digest FROM prepared"))
def prepared(spark, sf):
    return prep.prepare(b.docs(spark, sf), **RULES).select(
        "dataset_id", "doc_id", "label", F.md5("text").alias("digest"))


@query("label_encode", cte(b.DOCS_SQL, select="""
SELECT dataset_id, doc_id, label, CAST(dense_rank() OVER (PARTITION BY dataset_id ORDER BY label) - 1 AS INTEGER) AS code
FROM docs"""))
def label_encode(spark, sf):
    return prep.encode_labels(b.docs(spark, sf)).select("dataset_id", "doc_id", "label", "code")


@query("one_vs_rest", cte(b.DOCS_SQL, select="""
SELECT d.dataset_id || '_' || c.label || '_vs_rest' AS dataset_id, doc_id,
       CASE WHEN d.label = c.label THEN d.label ELSE 'rest' END AS label
FROM docs d JOIN (SELECT DISTINCT dataset_id, label FROM docs) c USING (dataset_id)"""))
def one_vs_rest(spark, sf):
    return prep.one_vs_rest(b.docs(spark, sf)).drop("text")


@query("slices", """
SELECT 'english' AS slice, doc_id FROM documents WHERE lang = 'en' UNION ALL
SELECT 'romance', doc_id FROM documents WHERE lang IN ('fr', 'es') UNION ALL
SELECT 'not_src3', doc_id FROM documents WHERE source <> 'src3' UNION ALL
SELECT 'src1x', doc_id FROM documents WHERE starts_with(source, 'src1') UNION ALL
SELECT 'has_text', doc_id FROM documents WHERE text IS NOT NULL""")
def slices(spark, sf):
    d = b.table(spark, sf, "documents")
    return prep.slices(d, {
        "english": F.col("lang") == "en",
        "romance": F.col("lang").isin("fr", "es"),
        "not_src3": F.col("source") != "src3",
        "src1x": F.col("source").startswith("src1"),
        "has_text": F.col("text").isNotNull(),
    }).select("slice", "doc_id")


@query("value_map", """
SELECT doc_id, CASE quality WHEN 0 THEN 'low' WHEN 1 THEN 'high' END AS quality_name,
       CASE toxic WHEN 1 THEN 'toxic' END AS toxic_name,
       TRY_CAST(source AS DOUBLE) AS bad_number, TRY_CAST(substr(source, 4) AS DOUBLE) AS source_number
FROM documents JOIN labels USING (doc_id)""")
def value_map(spark, sf):
    j = b.table(spark, sf, "documents").join(b.table(spark, sf, "labels"), "doc_id")
    return j.select(
        "doc_id", prep.value_map(F.col("quality"), {0: "low", 1: "high"}).alias("quality_name"),
        prep.value_map(F.col("toxic"), {1: "toxic"}).alias("toxic_name"),
        prep.to_number(F.col("source")).alias("bad_number"),
        prep.to_number(F.col("source").substr(F.lit(4), F.length("source"))).alias("source_number"))


# groups that occur in the given texts, next to the fixed ones
LOCAL_PATTERNS = {"ver": r"(?<![\p{L}\p{N}_])ver", "tion": r"tion(?![\p{L}\p{N}_])|ment", "mark": r"@|#{2,}"}
TARGET_SQL = r"""
pat(target, pattern) AS (VALUES
  ('black', '(^|[^\p{L}\p{N}_])black'), ('jewish', '(^|[^\p{L}\p{N}_])jew'),
  ('muslim', '(^|[^\p{L}\p{N}_])muslim|islamic'), ('immigrant', 'immigra|illegal'),
  ('women', '(^|[^\p{L}\p{N}_])(women|woman)($|[^\p{L}\p{N}_])|(^|[^\p{L}\p{N}_])female'),
  ('lgbt', '(^|[^\p{L}\p{N}_])gay|lesbian|lgbt|homosexual|transgender|(^|[^\p{L}\p{N}_])trans($|[^\p{L}\p{N}_])'),
  ('ver', '(^|[^\p{L}\p{N}_])ver'), ('tion', 'tion($|[^\p{L}\p{N}_])|ment'), ('mark', '@|#{2,}')),
tagged AS (
  SELECT target, doc_id, text, lang FROM documents JOIN pat ON regexp_matches(lower(text), pattern)
)"""


def _tagged(spark, sf):
    return prep.regex_targets(b.table(spark, sf, "documents"), "text",
                              {**prep.TARGET_PATTERNS, **LOCAL_PATTERNS})


@query("regex_targets", cte(TARGET_SQL, select="SELECT target, doc_id FROM tagged"))
def regex_targets(spark, sf):
    return _tagged(spark, sf).select("target", "doc_id")


@query("sampled_negatives", cte(TARGET_SQL, """
pos AS (
  SELECT target, doc_id, text FROM tagged WHERE lang <> 'en'
  QUALIFY row_number() OVER (PARTITION BY target, text ORDER BY doc_id) = 1
),
quota AS (SELECT target, count(*) AS n_pos FROM pos GROUP BY 1 HAVING count(*) >= 3),
pool AS (
  SELECT doc_id, text FROM documents WHERE lang = 'en' AND text IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1
),
numbered AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id)) AS rn FROM pool)""", select="""
SELECT target AS dataset_id, doc_id, 'target_' || target AS label FROM pos WHERE target IN (SELECT target FROM quota)
UNION ALL
SELECT target, doc_id, 'not_target' FROM numbered JOIN quota ON rn <= 4 * n_pos"""))
def sampled_negatives(spark, sf):
    d = b.table(spark, sf, "documents")
    return prep.with_sampled_negatives(
        _tagged(spark, sf).filter("lang <> 'en'"), d.filter("lang = 'en'"), min_class=3).drop("text")


@query("vote_mean", """
SELECT example_id, min_by(props, event_id) AS text, round(avg(vote), 6) AS mean_vote,
       CASE WHEN avg(vote) > 0.5 THEN 1 ELSE 0 END AS label
FROM (SELECT *, event_id // 4 AS example_id,
             CASE WHEN event_type = 'error' THEN NULL WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS vote
      FROM events)
WHERE vote IS NOT NULL GROUP BY 1 HAVING avg(vote) <> 0.5""")
def vote_mean(spark, sf):
    e = b.table(spark, sf, "events").select("event_id", "event_type", "props")
    e = e.withColumn("example_id", F.floor(F.col("event_id") / 4)).withColumn(
        "vote", F.when(F.col("event_type") == "error", None).when(
            F.col("event_type").isin("click", "purchase"), 1).otherwise(0))
    return prep.vote_mean(e, ["example_id"], "event_id", "props", "vote").withColumn(
        "mean_vote", F.round("mean_vote", 6))


WHITE_SQL = r"regexp_extract_all(lower(text), '[^\t-\r\x{1c}-\x{20}\x{85}\p{Z}]+')"


@query("vote_mode", f"""
WITH t AS (SELECT doc_id, list_transform({WHITE_SQL}, lambda x: CAST(length(x) % 3 AS INTEGER)) AS labels FROM documents),
c AS (SELECT doc_id, v, count(*) AS n FROM (SELECT doc_id, unnest(labels) AS v FROM t) GROUP BY ALL),
top AS (SELECT doc_id, max(n) AS mx FROM c GROUP BY 1),
best AS (SELECT c.doc_id, count(*) AS ties, min(v) AS v FROM c JOIN top ON c.doc_id = top.doc_id AND n = mx GROUP BY 1)
SELECT doc_id, CASE WHEN ties = 1 THEN v END AS label FROM t LEFT JOIN best USING (doc_id)""")
def vote_mode(spark, sf):
    d = b.table(spark, sf, "documents").select(
        "doc_id", F.transform(white_tokens(F.col("text")), lambda x: (F.length(x) % 3).cast("int")).alias("labels"))
    return d.select("doc_id", prep.vote_mode(F.col("labels")).alias("label"))


@query("ordinal_band", """
SELECT comment_id, CASE WHEN m >= 1.0 THEN 'hate' ELSE 'not' END AS label, round(m, 6) AS mean_score
FROM (SELECT event_id // 3 AS comment_id, round(avg(value / 20), 9) AS m FROM events GROUP BY 1)
WHERE m >= 1.0 OR m <= 1.0 / 3.0""")
def ordinal_band(spark, sf):
    e = b.table(spark, sf, "events").select(
        F.floor(F.col("event_id") / 3).alias("comment_id"), (F.col("value") / 20).alias("score"))
    return prep.ordinal_band(e, ["comment_id"], "score").withColumn("mean_score", F.round("mean_score", 6))




@query("single_flag", """
SELECT comment_id, list_filter([CASE WHEN f1 >= 0.5 THEN 'click' END, CASE WHEN f2 >= 0.5 THEN 'error' END,
         CASE WHEN f3 >= 0.5 THEN 'purchase' END, CASE WHEN f4 >= 0.5 THEN 'signup' END,
         CASE WHEN f5 >= 0.5 THEN 'view' END], lambda x: x IS NOT NULL)[1] AS label
FROM (SELECT event_id // 3 AS comment_id,
             avg(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS f1, avg(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS f2,
             avg(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS f3, avg(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS f4,
             avg(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS f5 FROM events GROUP BY 1)
WHERE CAST(f1 >= 0.5 AS INT) + CAST(f2 >= 0.5 AS INT) + CAST(f3 >= 0.5 AS INT) + CAST(f4 >= 0.5 AS INT) + CAST(f5 >= 0.5 AS INT) = 1""")
def single_flag(spark, sf):
    kinds = ["click", "error", "purchase", "signup", "view"]
    e = b.table(spark, sf, "events").select(
        F.floor(F.col("event_id") / 3).alias("comment_id"),
        *[(F.col("event_type") == k).cast("int").alias(k) for k in kinds])
    return prep.single_flag(e, ["comment_id"], kinds)


@query("script_language", r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '[\x{0600}-\x{06FF}]') THEN 'ar'
  WHEN regexp_matches(lower(text), '[éèàçùâêîôûëïüœ]') THEN 'fr'
  WHEN regexp_matches(text, '[a-zA-Z]') THEN 'en' ELSE 'other' END AS guess FROM documents""")
def script_language(spark, sf):
    return b.table(spark, sf, "documents").select(
        "doc_id", prep.script_language(F.col("text")).alias("guess"))


@query("substring_label", """
SELECT event_id, CASE WHEN event_type = 'view' THEN 'view'
  WHEN contains(event_type, 'ick') OR contains(event_type, 'err') THEN 'marked' END AS label FROM events""")
def substring_label(spark, sf):
    return b.table(spark, sf, "events").select(
        "event_id", prep.substring_label(F.col("event_type"), "view", ["ick", "err"], "marked").alias("label"))


@query("token_join", f"""
SELECT doc_id, md5(array_to_string({WHITE_SQL}, ' ')) AS digest FROM documents""")
def token_join(spark, sf):
    return b.table(spark, sf, "documents").select(
        "doc_id", F.md5(prep.token_join(white_tokens(F.col("text")))).alias("digest"))


@query("fixed_sample", "SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id) LIMIT 150")
def fixed_sample(spark, sf):
    return prep.fixed_sample(b.table(spark, sf, "documents").select("doc_id", "lang"), 150)


@query("manifest_stats", cte(*PREPARED_SQL, select="""
SELECT dataset_id, CAST(sum(c) AS BIGINT) AS n_instances, count(*) AS n_classes,
       round(min(c) / CAST(sum(c) AS DOUBLE), 4) AS minority_pct
FROM (SELECT dataset_id, label, count(*) AS c FROM prepared GROUP BY ALL) GROUP BY 1"""))
def manifest_stats(spark, sf):
    return prep.manifest_stats(prep.prepare(b.docs(spark, sf), **RULES))


def _audit_sql():
    rules = {
        "in_both": "n IS NOT NULL AND mn IS NOT NULL", "columns": "true", "text_present": "blank = 0",
        "text_unique": "max_copies = 1", "label_integer": "true", "label_contiguous": "lo = 0 AND hi = k - 1",
        "cap": "n <= 200", "total": "n >= 20", "two_classes": "k >= 2", "class_size": "small >= 3",
        "minority_share": "small / CAST(n AS DOUBLE) >= 0.2::DOUBLE - 1e-6", "manifest_n": "mn = n",
        "manifest_k": "mk = k", "manifest_columns": "true"}
    return "\nUNION ALL\n".join(
        f"SELECT dataset_id, '{r}' AS rule, coalesce({c}, false) AS ok FROM j" for r, c in rules.items())


@query("rule_audit", cte(CLEAN_SQL, rf"""
enc AS (
  SELECT dataset_id, doc_id, text, dense_rank() OVER (PARTITION BY dataset_id ORDER BY label) - 1 AS label FROM docs
),
cls AS (SELECT dataset_id, label, count(*) AS c FROM enc GROUP BY ALL),
facts AS (
  SELECT dataset_id, sum(c) AS n, count(*) AS k, min(c) AS small, min(label) AS lo, max(label) AS hi FROM cls GROUP BY 1
),
txt AS (
  SELECT dataset_id, max(c) AS max_copies, max(bl) AS blank FROM (
    SELECT dataset_id, text, count(*) AS c,
           max(CASE WHEN regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') = '' THEN 1 ELSE 0 END) AS bl
    FROM enc GROUP BY ALL) GROUP BY 1
),
man AS (
  SELECT dataset_id, count(*) AS mn, count(DISTINCT label) AS mk FROM clean GROUP BY 1
),
j AS (SELECT * FROM facts JOIN txt USING (dataset_id) FULL JOIN man USING (dataset_id))""", select=_audit_sql()))
def rule_audit(spark, sf):
    """Raw documents against the manifest of the cleaned ones: several rules fail."""
    d = b.docs(spark, sf)
    raw = prep.encode_labels(d).select("dataset_id", "doc_id", "text", F.col("code").alias("label"))
    man = prep.manifest_stats(prep.clean_text_label(d))
    for c in prep.MANIFEST_COLUMNS:
        if c not in man.columns:
            man = man.withColumn(c, F.lit(""))
    return prep.rule_audit(raw, man, 20, 3, 0.2, 200)


@query("build_report", """
WITH m AS (SELECT lang AS language, source, CASE WHEN doc_id % 2 = 0 THEN 'web' ELSE 'chat' END AS platform,
                  CAST(2 + doc_id % 3 AS VARCHAR) AS n_classes FROM documents)
SELECT 'language' AS dimension, language AS value, count(*) AS n FROM m GROUP BY 2 UNION ALL
SELECT 'platform', platform, count(*) FROM m GROUP BY 2 UNION ALL
SELECT 'source', source, count(*) FROM m GROUP BY 2 UNION ALL
SELECT 'n_classes', n_classes, count(*) FROM m GROUP BY 2""")
def build_report(spark, sf):
    d = b.table(spark, sf, "documents")
    m = d.select(F.col("lang").alias("language"), "source",
                 F.when(F.col("doc_id") % 2 == 0, "web").otherwise("chat").alias("platform"),
                 (2 + F.col("doc_id") % 3).alias("n_classes"))
    return prep.build_report(m)
