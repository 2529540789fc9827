"""Text descriptors over whole texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from corpuslens.functions import text as tx
from corpuslens.operators import information as info
from corpuslens.operators import text as op
from corpuslens.plans.registry import cte, query, rounded
from corpuslens.sources import bindings as b

NON_WS = r"[^\t-\r\x{1c}-\x{20}\x{85}\p{Z}]+"
WHITE = rf"regexp_extract_all(lower(text), '{NON_WS}')"
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"


def rd(expr, name):
    return f"round({expr}, 6) + 0 AS {name}"


def _all_but(df, *keep):
    return rounded(df, *[c for c, t in df.dtypes if t == "double" and c not in keep])


BALANCE_SQL = b.DOCS_SQL + """,
c AS (SELECT dataset_id, label, count(*) AS n FROM docs GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY dataset_id) AS p, sum(n) OVER (PARTITION BY dataset_id) AS tot FROM c)"""


@query("size_features", cte(BALANCE_SQL, select=f"""
SELECT dataset_id, CAST(sum(n) AS BIGINT) AS n_instances, count(*) AS n_classes,
       {rd('log10(sum(n))', 'log_instances')}, {rd('sum(n) / count(*)', 'instances_per_class')} FROM s GROUP BY 1"""))
def size_features(spark, sf):
    return _all_but(op.size_and_balance(b.docs(spark, sf)).select(
        "dataset_id", "n_instances", "n_classes", "log_instances", "instances_per_class"))


@query("balance", cte(BALANCE_SQL, select=f"""
SELECT dataset_id, {rd('max(p)', 'majority_pct')}, {rd('min(p)', 'minority_pct')},
       {rd('max(n) / min(n)', 'imbalance_ratio')}, {rd('-sum(p * log2(p))', 'class_entropy')} FROM s GROUP BY 1"""))
def balance(spark, sf):
    return _all_but(op.size_and_balance(b.docs(spark, sf)).select(
        "dataset_id", "majority_pct", "minority_pct", "imbalance_ratio", "class_entropy"))


@query("vocab_stats", cte(b.DOCS_SQL, f"""
tok AS (SELECT dataset_id, token, count(*) AS n FROM
  (SELECT dataset_id, unnest({WHITE}) AS token FROM docs) GROUP BY ALL),
v AS (SELECT dataset_id, count(*) AS v, sum(n) AS t, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS h FROM tok GROUP BY 1),
d AS (SELECT dataset_id, count(*) AS docs FROM docs GROUP BY 1)""", select=f"""
SELECT dataset_id, v AS vocab_size, {rd('log10(v)', 'log_vocab_size')}, {rd('v / docs', 'vocab_per_instance')},
       {rd('v / t', 'type_token_ratio')}, {rd('h / v', 'hapax_ratio')} FROM v JOIN d USING (dataset_id)"""))
def vocab_stats(spark, sf):
    return _all_but(op.vocab_stats(b.docs(spark, sf)))


@query("length_stats", cte(b.DOCS_SQL, f"""
l AS (SELECT dataset_id, length(text) AS chars, {WHITE} AS t FROM docs)""", select=f"""
SELECT dataset_id, {rd('avg(len(t))', 'mean_doc_len_words')}, {rd('stddev_pop(len(t))', 'std_doc_len_words')},
       {rd('avg(chars)', 'mean_doc_len_chars')},
       {rd("sum(coalesce(list_sum(list_transform(t, lambda x: length(x))), 0)) / sum(len(t))", 'mean_word_len')}
FROM l GROUP BY 1"""))
def length_stats(spark, sf):
    return _all_but(op.length_stats(b.docs(spark, sf)))


MARK_SQL = r"""
long_runs AS (
  SELECT DISTINCT k FROM (
    SELECT k, c, lead(c) OVER w AS c1, lead(c, 2) OVER w AS c2 FROM (
      SELECT k, unnest(regexp_extract_all(text, '[\s\S]')) AS c, generate_subscripts(regexp_extract_all(text, '[\s\S]'), 1) AS i
      FROM src) WINDOW w AS (PARTITION BY k ORDER BY i))
  WHERE c = c1 AND c = c2 AND c <> chr(10)
)"""
MARK_COLS = ", ".join([
    rd(r"avg(CASE WHEN len(regexp_extract_all(text, '@[\p{L}\p{N}_]+')) > 0 THEN 1 ELSE 0 END)", "pct_docs_with_mention"),
    rd(r"avg(len(regexp_extract_all(text, '@[\p{L}\p{N}_]+')))", "mean_mentions_per_doc"),
    rd(r"avg(CASE WHEN len(regexp_extract_all(text, '#[\p{L}\p{N}_]+')) > 0 THEN 1 ELSE 0 END)", "pct_docs_with_hashtag"),
    rd(r"avg(len(regexp_extract_all(text, '#[\p{L}\p{N}_]+')))", "mean_hashtags_per_doc"),
    rd(r"avg(CASE WHEN regexp_matches(text, 'https?://|www\.') THEN 1 ELSE 0 END)", "pct_docs_with_url"),
    rd(r"avg(CASE WHEN regexp_matches(text, '[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}]') THEN 1 ELSE 0 END)",
       "pct_docs_with_emoji"),
    rd("avg(length(text) - length(replace(text, '!', '')))", "exclamation_rate"),
    rd("avg(CASE WHEN k IN (SELECT k FROM long_runs) THEN 1 ELSE 0 END)", "elongation_rate"),
])


@query("social_marks", cte(b.DOCS_SQL, "src AS (SELECT dataset_id || ':' || doc_id AS k, dataset_id, text FROM docs)",
                           MARK_SQL, select=f"SELECT dataset_id, {MARK_COLS} FROM src GROUP BY 1"))
def social_marks(spark, sf):
    return _all_but(op.social_marks(b.docs(spark, sf)))


@query("page_marks", cte("""src AS (SELECT page_id AS k, 'host' || (page_id % 4) AS dataset_id, html AS text FROM pages)""",
                         MARK_SQL, select=f"SELECT dataset_id, {MARK_COLS} FROM src GROUP BY 1"))
def page_marks(spark, sf):
    """The marks on raw web pages, where links and tags do occur."""
    p = b.table(spark, sf, "pages").select(
        F.concat(F.lit("host"), (F.col("page_id") % 4).cast("string")).alias("dataset_id"), F.col("html").alias("text"))
    return _all_but(op.social_marks(p))


@query("uppercase_ratio", cte(b.DOCS_SQL, select=rf"""
SELECT dataset_id, {rd(r"sum(len(regexp_extract_all(text, '\p{Lu}'))) / sum(len(regexp_extract_all(text, '\p{L}')))", 'uppercase_char_ratio')}
FROM docs GROUP BY 1"""))
def uppercase_ratio(spark, sf):
    return _all_but(op.uppercase_ratio(b.docs(spark, sf)))


LIST = (*tx.WORD_LIST, "the", "and", "ver", "paver")


@query("word_list_rate", cte(b.DOCS_SQL, rf"""
h AS (SELECT dataset_id, len({WHITE}) AS t,
      len(list_filter({WHITE}, lambda w: regexp_replace(w, '[^\p{{L}}\p{{N}}_]', '', 'g') IN ({", ".join(f"'{w}'" for w in LIST)}))) AS h
      FROM docs)""", select=f"""
SELECT dataset_id, {rd('avg(CASE WHEN h > 0 THEN 1 ELSE 0 END)', 'pct_docs_with_profanity')},
       {rd('sum(h) / sum(t)', 'profanity_token_rate')} FROM h GROUP BY 1"""))
def word_list_rate(spark, sf):
    """The fixed list holds no word of the given invented texts, so a few are added."""
    return _all_but(op.word_list_rate(b.docs(spark, sf), LIST))


@query("term_mi", cte(b.DOCS_SQL, f"""
raw AS (SELECT dataset_id, doc_id, label, unnest({TERMS}) AS term FROM docs),
tops AS (
  SELECT DISTINCT dataset_id, term FROM raw
),
pres AS (SELECT DISTINCT dataset_id, term, doc_id, label FROM raw SEMI JOIN tops USING (dataset_id, term)),
tl AS (SELECT dataset_id, term, label, count(*) AS n11 FROM pres GROUP BY ALL),
cls AS (SELECT dataset_id, label, count(*) AS nl FROM docs GROUP BY ALL),
tot AS (SELECT dataset_id, sum(nl) AS n FROM cls GROUP BY 1),
cells AS (
  SELECT t.dataset_id, t.term, c.label, coalesce(n11, 0) AS n11, nl, n,
         sum(coalesce(n11, 0)) OVER (PARTITION BY t.dataset_id, t.term) AS df
  FROM tops t JOIN cls c USING (dataset_id) JOIN tot USING (dataset_id)
  LEFT JOIN tl ON tl.dataset_id = t.dataset_id AND tl.term = t.term AND tl.label = c.label
),
mi AS (
  SELECT dataset_id, term, greatest(0, sum(
    CASE WHEN n11 > 0 THEN n11 / n * ln(n11 * n / (df * nl)) ELSE 0 END
    + CASE WHEN nl > n11 THEN (nl - n11) / n * ln((nl - n11) * n / ((n - df) * nl)) ELSE 0 END)) AS mi
  FROM (SELECT dataset_id, term, CAST(n11 AS DOUBLE) AS n11, CAST(nl AS DOUBLE) AS nl,
               CAST(n AS DOUBLE) AS n, CAST(df AS DOUBLE) AS df FROM cells) GROUP BY ALL
)""", select=f"SELECT dataset_id, {rd('avg(mi)', 'mean_mutual_info')}, {rd('max(mi)', 'max_mutual_info')} FROM mi GROUP BY 1"))
def term_mi(spark, sf):
    return _all_but(op.term_mutual_information(b.docs(spark, sf)))


_PSI = ("(ln({n} + 9.0) - 1 / (2 * ({n} + 9.0)) - (1 / pow({n} + 9.0, 2)) * (1 / 12.0::DOUBLE - (1 / pow({n} + 9.0, 2)) * (1 / 120.0::DOUBLE"
        " - (1 / pow({n} + 9.0, 2)) * (1 / 252.0::DOUBLE - (1 / pow({n} + 9.0, 2)) / 240.0::DOUBLE))) - ("
        + " + ".join(f"1 / ({{n}} + {i}.0::DOUBLE)" for i in range(9)) + "))")


def _psi(n):
    return _PSI.format(n=f"CAST({n} AS DOUBLE)")


def _radius_sql(k):
    side = lambda name, j: f"coalesce({name}{j}, 'inf'::DOUBLE)" if j else "0.0::DOUBLE"
    return "least(" + ", ".join(f"greatest({side('l', j)}, {side('r', k - j)})" for j in range(k + 1)) + ")"


@query("term_mi_neighbours", cte(b.DOCS_SQL, f"""
tf AS (SELECT dataset_id, doc_id, term, count(*) AS tf FROM (SELECT dataset_id, doc_id, unnest({TERMS}) AS term FROM docs) GROUP BY ALL),
dn AS (SELECT dataset_id, count(*) AS n FROM docs GROUP BY 1),
voc AS (SELECT dataset_id, term, ln((1 + n) / (1 + df)) + 1 AS idf, n FROM (
  SELECT dataset_id, term, count(*) AS df, sum(tf) AS c FROM tf GROUP BY dataset_id, term
  QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY sum(tf) DESC, term) <= 1000) JOIN dn USING (dataset_id)),
w AS (SELECT dataset_id, doc_id, term, n, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY dataset_id, doc_id)) AS w
      FROM tf JOIN voc USING (dataset_id, term)),
st AS (SELECT dataset_id, term, CASE WHEN sd < 1e-12 THEN 1 ELSE sd END AS sd, m FROM (
  SELECT dataset_id, term, sum(w) / max(n) AS m, sqrt(greatest(0, sum(w * w) / max(n) - pow(sum(w) / max(n), 2))) AS sd FROM w GROUP BY ALL)),
cls AS (SELECT dataset_id, label, count(*) AS c FROM docs GROUP BY ALL HAVING count(*) > 1),
x0 AS (SELECT dataset_id, term, doc_id, label, c, sd, m, md5('42:' || term || ':' || doc_id) AS h FROM docs JOIN cls USING (dataset_id, label) JOIN st USING (dataset_id)),
x AS (SELECT x0.dataset_id, x0.term, x0.doc_id, label, c, coalesce(w, 0) / sd + 1e-10::DOUBLE * greatest(1, m / sd)
        * sqrt(-2 * ln((CAST('0x' || substr(h, 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE))
        * cos(2 * pi() * ((CAST('0x' || substr(h, 13, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)) AS x
      FROM x0 LEFT JOIN w ON w.dataset_id = x0.dataset_id AND w.term = x0.term AND w.doc_id = x0.doc_id),
side AS (SELECT *, {", ".join(f"x - lag(x, {j}) OVER o AS l{j}, lead(x, {j}) OVER o - x AS r{j}" for j in (1, 2, 3))}
         FROM x WINDOW o AS (PARTITION BY dataset_id, term, label ORDER BY x, doc_id)),
rad AS (SELECT dataset_id, term, doc_id, c, least(3, c - 1) AS k, x,
          (CASE least(3, c - 1) WHEN 1 THEN {_radius_sql(1)} WHEN 2 THEN {_radius_sql(2)} ELSE {_radius_sql(3)} END) * (1 - pow(2, -50)) AS r FROM side),
ev AS (SELECT dataset_id, term, doc_id, c, k, x + r AS pos, 0 AS kind, 1 AS sign FROM rad UNION ALL SELECT dataset_id, term, doc_id, c, k, x, 1, 0 FROM rad
       UNION ALL SELECT dataset_id, term, doc_id, c, k, x - r, 2, -1 FROM rad),
cnt AS (SELECT *, sum(CASE WHEN kind = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY dataset_id, term ORDER BY pos, kind ROWS UNBOUNDED PRECEDING) AS n FROM ev),
mm AS (SELECT dataset_id, term, doc_id, max(c) AS c, max(k) AS k, sum(n * sign) AS m FROM cnt WHERE kind <> 1 GROUP BY ALL),
mi AS (SELECT dataset_id, term, greatest(0, {_psi('count(*)')} + avg({_psi('k')}) - avg({_psi('c')}) - avg({_psi('m')})) AS mi FROM mm GROUP BY ALL)""",
       select=f"SELECT dataset_id, {rd('avg(mi)', 'mean_mutual_info')}, {rd('max(mi)', 'max_mutual_info')} FROM mi GROUP BY 1"))
def term_mi_neighbours(spark, sf):
    return rounded(info.mutual_information(b.docs(spark, sf)), "mean_mutual_info", "max_mutual_info")


@query("manifest_flags", """
SELECT DISTINCT source || '_' || lang AS dataset_id, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS is_english,
       CASE WHEN lang <> 'en' THEN 1 ELSE 0 END AS is_multilingual_row,
       CASE WHEN source = 'src3' THEN 1 ELSE 0 END AS is_twitter FROM documents""")
def manifest_flags(spark, sf):
    m = b.table(spark, sf, "documents").select("source", "lang").distinct().select(
        F.concat_ws("_", "source", "lang").alias("dataset_id"), F.upper("lang").alias("language"),
        F.when(F.col("source") == "src3", " Twitter ").otherwise("web").alias("platform"))
    return op.manifest_flags(m)


# ---- subwords: two vocabularies made from the benchmark texts
VOCAB_SQL = r"""
bw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM benchmark),
subs AS (
  SELECT DISTINCT substr(w, CAST(i AS BIGINT), CAST(l AS BIGINT)) AS piece, i = 1 AS initial
  FROM bw JOIN range(1, 101) a(i) ON i <= length(w) JOIN range(1, 5) c(l) ON i + l - 1 <= length(w)
),
vocab AS (
  SELECT 'a' AS tag, piece, initial FROM subs
  UNION ALL SELECT 'b', w, true FROM bw
  UNION ALL SELECT 'b', piece, initial FROM subs WHERE length(piece) = 1 AND NOT initial
)"""
PIECES_SQL = VOCAB_SQL + rf""",
wc AS (SELECT dataset_id, word, count(*) AS n FROM (
  SELECT dataset_id, unnest(regexp_extract_all(text, '{NON_WS}')) AS word FROM docs) GROUP BY ALL),
parts AS (SELECT word, unnest(regexp_extract_all(word, '[^\p{{P}}\p{{S}}]+|[\p{{P}}\p{{S}}]')) AS part
          FROM (SELECT DISTINCT word FROM wc)),
dp AS (SELECT DISTINCT part FROM parts),
dpi AS (SELECT part, unnest(range(1, length(part) + 1)) AS i FROM dp),
best AS (
  SELECT tag, part, i AS pos, max(l) AS l
  FROM dpi
  JOIN range(1, 33) c(l) ON i + l - 1 <= length(part)
  JOIN vocab v ON v.piece = substr(part, CAST(i AS BIGINT), CAST(l AS BIGINT)) AND v.initial = (i = 1)
  GROUP BY ALL
),
walk AS (
  WITH RECURSIVE w(tag, part, pos, pieces) AS (
    SELECT tag, part, CAST(1 AS BIGINT), 0 FROM dp JOIN (SELECT DISTINCT tag FROM vocab) ON true
    UNION ALL
    SELECT w.tag, w.part, w.pos + b.l, w.pieces + 1 FROM w JOIN best b USING (tag, part, pos)
  ) SELECT tag, part, max(CASE WHEN pos = length(part) + 1 THEN pieces END) AS pieces FROM w GROUP BY ALL
),
pw AS (
  SELECT word, tag, sum(coalesce(pieces, 1)) AS pieces, max(CASE WHEN pieces IS NULL THEN 1 ELSE 0 END) AS unk
  FROM parts JOIN walk USING (part) GROUP BY ALL
),
fert AS (
  SELECT dataset_id, tag, sum(n * pieces) / sum(n) AS fertility,
         sum(CASE WHEN pieces >= 2 THEN n ELSE 0 END) / sum(n) AS continued,
         sum(CASE WHEN unk = 1 THEN n ELSE 0 END) / sum(n) AS unk
  FROM wc JOIN pw USING (word) GROUP BY ALL
)"""


def bench_vocab(spark, sf):
    w = b.table(spark, sf, "benchmark").select(F.explode(tx.word_tokens(F.col("text"))).alias("w")).distinct()
    subs = (
        w.select("w", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("i"))
        .select("w", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(4), F.length("w") - F.col("i") + 1))).alias("l"))
        .select(F.col("w").substr(F.col("i"), F.col("l")).alias("piece"), (F.col("i") == 1).alias("initial")).distinct())
    parts = [subs.select(F.lit("a").alias("tag"), "piece", "initial"),
             w.select(F.lit("b").alias("tag"), F.col("w").alias("piece"), F.lit(True).alias("initial")),
             subs.filter((F.length("piece") == 1) & ~F.col("initial")).select(F.lit("b").alias("tag"), "piece", "initial")]
    return reduce(lambda x, y: x.unionByName(y), parts)


@query("subword_fertility", cte(b.DOCS_SQL, PIECES_SQL, select=f"""
SELECT dataset_id, {rd('x.fertility', 'tok_fertility_a')}, {rd('x.continued', 'tok_continued_a')}, {rd('x.unk', 'tok_unk_a')},
       {rd('y.fertility', 'tok_fertility_b')}, {rd('y.continued', 'tok_continued_b')}, {rd('y.unk', 'tok_unk_b')},
       {rd('x.fertility - y.fertility', 'tok_fertility_gap')}
FROM (SELECT * FROM fert WHERE tag = 'a') x JOIN (SELECT * FROM fert WHERE tag = 'b') y USING (dataset_id)"""))
def subword_fertility(spark, sf):
    return _all_but(op.fertility_gap(op.subword_fertility(b.docs(spark, sf), bench_vocab(spark, sf)), "a", "b"))


# ---- lexicon: English single words and word pairs of the benchmark texts
LEXICON_SQL = r"""
bt AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM benchmark),
lemmas AS (
  SELECT DISTINCT lemma, 1 AS n_words FROM (SELECT unnest(t) AS lemma FROM bt) WHERE length(lemma) >= 6
  UNION
  SELECT DISTINCT t[i] || ' ' || t[i + 1], 2 FROM bt, range(1, 5000) r(i) WHERE i < len(t)
),
lexicon AS (
  SELECT 'en' AS language, lemma, n_words, 'c' || (ascii(substr(md5(lemma), 1, 1)) % 4) AS category FROM lemmas
  UNION
  SELECT 'en', lemma, n_words, 'long' FROM lemmas WHERE length(lemma) >= 9
)"""
LDOCS_SQL = "ldocs AS (SELECT lang AS dataset_id, doc_id, text, lang AS language, CAST(doc_id % 3 AS INTEGER) AS label FROM documents)"


def bench_lexicon(spark, sf):
    t = b.table(spark, sf, "benchmark").select(tx.word_tokens(F.col("text")).alias("t"))
    one = t.select(F.explode("t").alias("lemma")).filter(F.length("lemma") >= 6).select("lemma", F.lit(1).alias("n_words"))
    two = t.select(F.explode(tx.word_ngrams(F.col("t"), 2, 2)).alias("lemma")).select("lemma", F.lit(2).alias("n_words"))
    lem = one.union(two).distinct()
    cat = F.concat(F.lit("c"), (F.ascii(F.substring(F.md5("lemma"), 1, 1)) % 4).cast("string"))
    cats = F.filter(F.array(cat, F.when(F.length("lemma") >= 9, F.lit("long"))), lambda x: x.isNotNull())
    return lem.select(F.lit("en").alias("language"), "lemma", "n_words", F.explode(cats).alias("category"))


def lang_docs(spark, sf):
    return b.table(spark, sf, "documents").select(
        F.col("lang").alias("dataset_id"), "doc_id", "text", F.col("lang").alias("language"),
        (F.col("doc_id") % 3).cast("int").alias("label"))


@query("lexicon_rates", cte(LEXICON_SQL, LDOCS_SQL, f"""
toks AS (SELECT dataset_id, doc_id, language, label, {WORDS} AS t FROM ldocs),
grams AS (
  SELECT dataset_id, doc_id, language, unnest(t) AS lemma FROM toks
  UNION ALL
  SELECT dataset_id, doc_id, language, t[i] || ' ' || t[i + 1] FROM (
    SELECT dataset_id, doc_id, language, t, unnest(range(1, len(t))) AS i FROM toks)
),
hits AS (SELECT g.*, x.n_words, x.cats FROM grams g JOIN (
  SELECT language, lemma, max(n_words) AS n_words, list(category) AS cats FROM lexicon GROUP BY ALL) x USING (language, lemma)),
hd AS (SELECT DISTINCT dataset_id, doc_id, 1 AS hit FROM hits),
single AS (SELECT dataset_id, count(*) AS s FROM hits WHERE n_words = 1 GROUP BY 1),
per AS (
  SELECT dataset_id, label, avg(coalesce(hit, 0)) AS rate, count(*) AS n, sum(coalesce(hit, 0)) AS h, sum(len(t)) AS tk
  FROM toks LEFT JOIN hd USING (dataset_id, doc_id) GROUP BY ALL
),
cat AS (SELECT dataset_id, c, count(*) AS n FROM (SELECT dataset_id, unnest(cats) AS c FROM hits) GROUP BY ALL),
ent AS (SELECT dataset_id, -sum(p * log2(p)) AS e FROM (
  SELECT dataset_id, n / sum(n) OVER (PARTITION BY dataset_id) AS p FROM cat) GROUP BY 1)""", select=f"""
SELECT dataset_id, {rd('sum(h) / sum(n)', 'hl_doc_rate')}, {rd('coalesce(max(s), 0) / sum(tk)', 'hl_token_rate')},
       {rd('max(rate) - min(rate)', 'hl_class_gap')}, {rd('coalesce(max(e), 0)', 'hl_category_entropy')}
FROM per LEFT JOIN single USING (dataset_id) LEFT JOIN ent USING (dataset_id) GROUP BY 1"""))
def lexicon_rates(spark, sf):
    return _all_but(op.lexicon_rates(lang_docs(spark, sf), bench_lexicon(spark, sf), max_words=2))


CLASS_SQL = b.DOCS_SQL + f""",
cnt AS (SELECT dataset_id, label, term, count(*) AS n FROM (
  SELECT dataset_id, label, unnest({WORDS}) AS term FROM docs) GROUP BY ALL),
corp AS (SELECT dataset_id, term, sum(n) AS cn FROM cnt GROUP BY ALL HAVING sum(n) >= 2),
dist AS (
  SELECT dataset_id, label, term, n, cn, n / sum(n) OVER (PARTITION BY dataset_id, label) AS p,
         cn / (SELECT sum(cn) FROM corp c2 WHERE c2.dataset_id = c.dataset_id) AS q
  FROM cnt c JOIN corp USING (dataset_id, term)
),
cls AS (SELECT DISTINCT dataset_id, label FROM docs),
lp AS (SELECT a.dataset_id, a.label AS a, c.label AS b FROM cls a JOIN cls c ON a.dataset_id = c.dataset_id AND a.label < c.label)"""
JS_SUM = """0.5 * sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END)
  + 0.5 * sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)"""


@query("class_terms", cte(CLASS_SQL, select=f"""
SELECT dataset_id, label, term, n, CAST(cn AS BIGINT) AS corpus_n, {rd('p', 'p')}, {rd('q', 'q')} FROM dist"""))
def class_terms(spark, sf):
    return rounded(op.class_terms(b.docs(spark, sf)), "p", "q")


@query("class_js", cte(CLASS_SQL, f"""
pr AS (
  SELECT lp.dataset_id, lp.a, lp.b, t.term, coalesce(x.p, 0) AS p, coalesce(y.p, 0) AS q
  FROM lp JOIN corp t USING (dataset_id)
  LEFT JOIN dist x ON x.dataset_id = lp.dataset_id AND x.label = lp.a AND x.term = t.term
  LEFT JOIN dist y ON y.dataset_id = lp.dataset_id AND y.label = lp.b AND y.term = t.term
),
js AS (SELECT dataset_id, a, b, {JS_SUM} AS js FROM pr GROUP BY ALL)""",
                       select=f"SELECT dataset_id, {rd('avg(js)', 'ch_js_between_classes')} FROM js GROUP BY 1"))
def class_js(spark, sf):
    return _all_but(op.class_js(b.docs(spark, sf)))


@query("corpus_js", cte(CLASS_SQL, f"""
pr AS (
  SELECT cls.dataset_id, cls.label, coalesce(x.p, 0) AS p,
         t.cn / (SELECT sum(cn) FROM corp c2 WHERE c2.dataset_id = cls.dataset_id) AS q
  FROM cls JOIN corp t USING (dataset_id)
  LEFT JOIN dist x ON x.dataset_id = cls.dataset_id AND x.label = cls.label AND x.term = t.term
),
js AS (SELECT dataset_id, label, {JS_SUM} AS js FROM pr GROUP BY ALL)""",
                        select=f"SELECT dataset_id, {rd('avg(js)', 'ch_js_class_to_corpus')} FROM js GROUP BY 1"))
def corpus_js(spark, sf):
    return _all_but(op.corpus_js(b.docs(spark, sf)))


@query("vocab_jaccard", cte(CLASS_SQL, """
v AS (SELECT dataset_id, label, term FROM cnt WHERE n >= 2),
jj AS (
  SELECT lp.dataset_id, a, b,
         (SELECT count(*) FROM (SELECT term FROM v WHERE v.dataset_id = lp.dataset_id AND label = a INTERSECT
                                SELECT term FROM v WHERE v.dataset_id = lp.dataset_id AND label = b)) AS i,
         (SELECT count(*) FROM (SELECT term FROM v WHERE v.dataset_id = lp.dataset_id AND label = a UNION
                                SELECT term FROM v WHERE v.dataset_id = lp.dataset_id AND label = b)) AS u FROM lp)""",
                            select=f"SELECT dataset_id, {rd('avg(CASE WHEN u = 0 THEN 0 ELSE i / u END)', 'ch_vocab_jaccard')} FROM jj GROUP BY 1"))
def vocab_jaccard(spark, sf):
    return _all_but(op.vocab_jaccard(b.docs(spark, sf)))


@query("zipf_slope", cte(CLASS_SQL, """
top AS (SELECT dataset_id, term, sum(n) AS f, row_number() OVER (PARTITION BY dataset_id ORDER BY sum(n) DESC, term) AS r
        FROM cnt GROUP BY 1, 2)""",
                         select=f"SELECT dataset_id, {rd('regr_slope(log10(f), log10(r))', 'ch_zipf_slope')} FROM top GROUP BY 1"))
def zipf_slope(spark, sf):
    return _all_but(op.zipf_slope(b.docs(spark, sf)))
