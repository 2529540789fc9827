"""Text descriptors: one row per corpus out of tall (dataset_id, doc_id, text, label).

Counts are combined map-side before every shuffle and every key below carries
the term or the document, so one hot corpus or one hot word does not end up in
one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from corpuslens.functions import text as tx
from corpuslens.functions.ranking import spread_row_number, top_k


def _ratio(a, b):
    """a / b, and 0 where b is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def entropy_bits(count: Column, total: Column) -> Column:
    p = count / total
    return F.sum(-p * F.log2(p))


def size_and_balance(docs: DataFrame) -> DataFrame:
    """Counts, shares, imbalance and class entropy from the class counts."""
    c = docs.groupBy("dataset_id", "label").agg(F.count(F.lit(1)).alias("cnt"))
    a = c.groupBy("dataset_id").agg(
        F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("k"),
        F.max("cnt").alias("mx"), F.min("cnt").alias("mn"),
        F.sum(F.col("cnt") * F.log2("cnt")).alias("clogc"))
    n = F.col("n")
    return a.select(
        "dataset_id", n.alias("n_instances"), F.col("k").alias("n_classes"),
        F.log10(n).alias("log_instances"), (n / F.col("k")).alias("instances_per_class"),
        (F.col("mx") / n).alias("majority_pct"), (F.col("mn") / n).alias("minority_pct"),
        (F.col("mx") / F.col("mn")).alias("imbalance_ratio"),
        (F.log2(n) - F.col("clogc") / n).alias("class_entropy"))


def token_counts(docs: DataFrame, tokens: Column, keys=("dataset_id",), out="token") -> DataFrame:
    return docs.select(*keys, F.explode(tokens).alias(out)).groupBy(*keys, out).agg(
        F.count(F.lit(1)).alias("n"))


def vocab_stats(docs: DataFrame) -> DataFrame:
    t = token_counts(docs, tx.white_tokens(F.col("text"))).groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("v"), F.sum("n").alias("tokens"),
        F.sum((F.col("n") == 1).cast("long")).alias("hapax"))
    n = docs.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("docs"))
    j = n.join(t, "dataset_id", "left").fillna(0, ["v", "tokens", "hapax"])
    return j.select(
        "dataset_id", F.col("v").alias("vocab_size"),
        F.log10(F.greatest(F.col("v"), F.lit(1))).alias("log_vocab_size"),
        (F.col("v") / F.col("docs")).alias("vocab_per_instance"),
        _ratio("v", "tokens").alias("type_token_ratio"), _ratio("hapax", "v").alias("hapax_ratio"))


def length_stats(docs: DataFrame) -> DataFrame:
    """Word and character lengths; sums stay inside the row, nothing is exploded."""
    t = docs.select("dataset_id", F.length("text").alias("chars"), tx.white_tokens(F.col("text")).alias("t"))
    t = t.select("dataset_id", "chars", F.size("t").alias("words"),
                 F.length(F.array_join("t", "")).alias("word_chars"))
    return t.groupBy("dataset_id").agg(
        F.avg("words").alias("mean_doc_len_words"), F.stddev_pop("words").alias("std_doc_len_words"),
        F.avg("chars").alias("mean_doc_len_chars"),
        _ratio(F.sum("word_chars"), F.sum("words")).alias("mean_word_len"))


def social_marks(docs: DataFrame) -> DataFrame:
    """Mentions, hashtags, URLs, emoji, exclamation and elongation in one pass."""
    c = F.col("text")
    d = docs.select(
        "dataset_id", F.regexp_count(c, F.lit(tx.MENTION)).alias("m"),
        F.regexp_count(c, F.lit(tx.HASHTAG)).alias("h"), c.rlike(tx.URL).alias("u"),
        c.rlike(tx.EMOJI).alias("e"), F.regexp_count(c, F.lit(tx.EXCLAMATION)).alias("x"),
        c.rlike(tx.ELONGATION).alias("l"))

    def share(b):
        return F.avg(b.cast("int"))
    return d.groupBy("dataset_id").agg(
        share(F.col("m") > 0).alias("pct_docs_with_mention"), F.avg("m").alias("mean_mentions_per_doc"),
        share(F.col("h") > 0).alias("pct_docs_with_hashtag"), F.avg("h").alias("mean_hashtags_per_doc"),
        share(F.col("u")).alias("pct_docs_with_url"), share(F.col("e")).alias("pct_docs_with_emoji"),
        F.avg("x").alias("exclamation_rate"), share(F.col("l")).alias("elongation_rate"))


def uppercase_ratio(docs: DataFrame) -> DataFrame:
    c = F.col("text")
    return docs.groupBy("dataset_id").agg(
        _ratio(F.sum(F.regexp_count(c, F.lit(r"\p{Lu}"))), F.sum(F.regexp_count(c, F.lit(r"\p{L}")))
               ).alias("uppercase_char_ratio"))


def word_list_rate(docs: DataFrame, words=tuple(tx.WORD_LIST)) -> DataFrame:
    """Share of documents and of tokens that hit a fixed short word list.

    White-space tokens lose their non-word characters before the look-up, which
    is a hash-set test inside the row.
    """
    t = tx.white_tokens(F.col("text"))
    bare = F.transform(t, lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", ""))
    d = docs.select("dataset_id", F.size(t).alias("t"),
                    F.size(F.filter(bare, lambda w: w.isin(*words))).alias("h"))
    return d.groupBy("dataset_id").agg(
        F.avg((F.col("h") > 0).cast("int")).alias("pct_docs_with_profanity"),
        _ratio(F.sum("h"), F.sum("t")).alias("profanity_token_rate"))


COUNTED_ROWS = 1024  # documents whose terms are counted at once


def _term_runs(t: pa.ListArray) -> tuple[pa.ListArray, pa.ListArray]:
    """(distinct terms in order, their counts) of every row."""
    row = np.repeat(np.arange(len(t)), np.diff(t.offsets.to_numpy()))
    words = t.flatten().dictionary_encode()
    place = pc.sort_indices(words.dictionary).to_numpy()
    rank = np.empty(len(place), np.int64)
    rank[place] = np.arange(len(place))
    key, tf = np.unique(row * max(1, len(place)) + rank[words.indices.to_numpy()], return_counts=True)
    at, word = np.divmod(key, max(1, len(place)))
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(t)))]), pa.int32())
    return (pa.ListArray.from_arrays(ends, words.dictionary.take(pa.array(place[word]))),
            pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64())))


def doc_counts(docs: DataFrame, tokens: Column, keys=("dataset_id", "doc_id", "label"), placed=False) -> DataFrame:
    """(keys, w, tf): one row per document with its distinct terms and their counts.

    The shuffle carries the columns of ``docs``, not terms, and there is none where rows are dealt by a
    part of ``keys`` already, such as by a join of documents: rows of one document meet first, are cut into
    tokens then and counted in the row. ``placed``: rows are known to be dealt so. Documents without a token are left out.
    """
    rest = [c for c in docs.columns if c not in keys]
    d = docs if placed or not rest else docs.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("_r")).select(
        *keys, F.explode("_r").alias("_r")).select(*keys, "_r.*")
    t = d.select(*keys, tokens.alias("t")).groupBy(*keys).agg(F.flatten(F.collect_list("t")).alias("t")).filter(F.size("t") > 0)
    schema = T.StructType([t.schema[k] for k in keys] + T.StructType.fromDDL("w array<string>, tf array<bigint>").fields)
    arrow = to_arrow_schema(schema)

    def count(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, COUNTED_ROWS):
                rb = batch.slice(lo, COUNTED_ROWS)
                w, tf = _term_runs(pa.concat_arrays([rb["t"]]))
                yield pa.RecordBatch.from_arrays([*[rb[k] for k in keys], w.cast(arrow.field("w").type), tf.cast(arrow.field("tf").type)], schema=arrow)

    return t.mapInArrow(count, schema)


def doc_terms(docs: DataFrame, tokens: Column, keys=("dataset_id", "doc_id", "label"), placed=False) -> DataFrame:
    """(keys, term, tf), rows of one document side by side in one task."""
    return doc_counts(docs, tokens, keys, placed).select(*keys, F.inline(F.arrays_zip("w", "tf")).alias("term", "tf"))


def term_mutual_information(docs: DataFrame, k: int | None = None) -> DataFrame:
    """Plug-in mutual information (nats) of term presence and label over all terms,
    or the ``k`` most frequent ones.

    This is the contingency-table estimator, not a nearest-neighbour one on
    TF-IDF weights, so the values differ from that estimator's.
    """
    per_class = doc_terms(docs, tx.term_tokens(F.col("text"))).groupBy("dataset_id", "term", "label").agg(
        F.count(F.lit(1)).alias("n11"), F.sum("tf").alias("tf"))
    terms = per_class.groupBy("dataset_id", "term").agg(F.sum("tf").alias("tf"), F.sum("n11").alias("df"))
    if k is not None:
        terms = top_k(terms, ["dataset_id"], [F.col("tf").desc(), F.col("term")], k, F.col("term"))
    top = terms.select("dataset_id", "term", "df")
    cls = docs.groupBy("dataset_id", "label").agg(F.count(F.lit(1)).alias("nl"))
    cls = cls.withColumn("n", F.sum("nl").over(Window.partitionBy("dataset_id")))
    j = per_class.select("dataset_id", "term", "label", "n11").join(top, ["dataset_id", "term"]).join(
        cls, ["dataset_id", "label"])
    n, nl, n11, df = (F.col(c).cast("double") for c in ("n", "nl", "n11", "df"))
    n01 = nl - n11
    seen = n11 / n * F.log(n11 * n / (df * nl)) + F.when(n01 > 0, n01 / n * F.log(
        n01 * n / ((n - df) * nl))).otherwise(0.0)
    per_term = j.groupBy("dataset_id", "term").agg(
        F.sum(seen).alias("mi"), F.sum(nl / n).alias("cov"), F.max("n").alias("n"), F.max("df").alias("df"))
    # classes in which the term never occurs only add their "absent" cell
    rest = F.when(F.col("df") < F.col("n"), -(1 - F.col("cov")) * F.log(1 - F.col("df") / F.col("n"))).otherwise(0.0)
    per_term = per_term.withColumn("mi", F.greatest(F.lit(0.0), F.col("mi") + rest))
    out = per_term.groupBy("dataset_id").agg(
        F.avg("mi").alias("mean_mutual_info"), F.max("mi").alias("max_mutual_info"))
    return cls.select("dataset_id").distinct().join(out, "dataset_id", "left").fillna(0.0)


def manifest_flags(manifest: DataFrame) -> DataFrame:
    lang, plat = (F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) for c in ("language", "platform"))
    return manifest.select(
        "dataset_id", (lang == "en").cast("int").alias("is_english"),
        (lang != "en").cast("int").alias("is_multilingual_row"),
        (plat == "twitter").cast("int").alias("is_twitter"))


# ---------------------------------------------------------------- subwords

BASIC = r"[^\p{P}\p{S}]+|[\p{P}\p{S}]"


def subword_pieces(words: DataFrame, vocab: DataFrame, max_word: int | None = None) -> DataFrame:
    """(tag, word, pieces, unk) by greedy longest match against a vocabulary table
    (tag, piece, initial). A part without a match, or longer than ``max_word`` if
    that is given, is one unknown piece.

    Each distinct part meets the vocabulary once, through one equi-join of its
    substrings; the greedy walk over the longest matches then stays inside the
    row, so there is no join per step.
    """
    parts = words.select("word", F.explode(F.regexp_extract_all("word", F.lit(BASIC), F.lit(0))).alias("part"))
    distinct = parts.select("part").distinct()
    if max_word is not None:
        distinct = distinct.filter(F.length("part") <= max_word)
    size = F.length("part")
    # two rows: no substring longer than the longest piece of its kind is made
    longest = vocab.groupBy("initial").agg(F.max(F.length("piece")).alias("longest"))
    subs = (
        distinct.select("part", F.explode(F.sequence(F.lit(1), size)).alias("pos"))
        .withColumn("initial", F.col("pos") == 1)
        .join(longest, "initial")
        .select("part", "pos", "initial", F.explode(F.sequence(
            F.lit(1), F.least(F.col("longest"), F.length("part") - F.col("pos") + 1))).alias("len"))
        .withColumn("piece", F.col("part").substr(F.col("pos"), F.col("len")))
    )
    best = subs.join(vocab, ["piece", "initial"]).groupBy("tag", "part", "pos").agg(F.max("len").alias("len"))
    steps = best.groupBy("tag", "part").agg(
        F.map_from_entries(F.collect_list(F.struct("pos", "len"))).alias("jump"))

    def walk(acc, _):
        at = acc["pos"]
        hop = F.coalesce(F.try_element_at(F.col("jump"), at), F.lit(0))
        go = (at <= F.length("part")) & (acc["bad"] == 0)
        return F.struct(
            F.when(go, at + hop).otherwise(at).alias("pos"),
            (acc["pieces"] + F.when(go, 1).otherwise(0)).alias("pieces"),
            F.when(go & (hop == 0), 1).otherwise(acc["bad"]).alias("bad"))
    start = F.struct(F.lit(1).alias("pos"), F.lit(0).alias("pieces"), F.lit(0).alias("bad"))
    walked = steps.withColumn("_w", F.aggregate(F.sequence(F.lit(1), F.length("part")), start, walk))
    split = walked.select("tag", "part",
                          F.when(F.col("_w.bad") == 1, 1).otherwise(F.col("_w.pieces")).alias("pieces"),
                          F.col("_w.bad").alias("unk"))
    tags = vocab.groupBy(F.lit(1).alias("_one")).agg(F.collect_set("tag").alias("tags"))
    every = (parts.withColumn("_one", F.lit(1)).join(tags, "_one")
             .select("word", "part", F.explode("tags").alias("tag")))
    return every.join(split, ["tag", "part"], "left").groupBy("tag", "word").agg(
        F.greatest(F.lit(1), F.sum(F.coalesce("pieces", F.lit(1)))).alias("pieces"),
        F.max(F.coalesce("unk", F.lit(1))).alias("unk"))


def subword_fertility(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """(dataset_id, tag, fertility, continued, unk): weighted by word counts; 0 without words."""
    counts = token_counts(docs, F.filter(F.split("text", tx.WS + "+"), lambda w: w != ""), out="word")
    pieces = subword_pieces(counts.select("word").distinct(), vocab)
    j = counts.join(pieces, "word")
    n = F.sum("n")
    every = docs.select("dataset_id").distinct().join(F.broadcast(vocab.select("tag").distinct()))  # a few vocabularies
    rates = j.groupBy("dataset_id", "tag").agg(
        (F.sum(F.col("n") * F.col("pieces")) / n).alias("fertility"),
        (F.sum(F.when(F.col("pieces") >= 2, F.col("n")).otherwise(0)) / n).alias("continued"),
        (F.sum(F.when(F.col("unk") == 1, F.col("n")).otherwise(0)) / n).alias("unk"))
    return every.join(rates, ["dataset_id", "tag"], "left").fillna(0.0)


def fertility_gap(fert: DataFrame, a: str, b: str) -> DataFrame:
    """Wide columns per tag and the gap a - b."""
    w = fert.groupBy("dataset_id").pivot("tag", [a, b]).agg(
        F.first("fertility").alias("fertility"), F.first("continued").alias("continued"),
        F.first("unk").alias("unk"))
    cols = [F.col(f"{t}_{m}").alias(f"tok_{m}_{t}") for t in (a, b) for m in ("fertility", "continued", "unk")]
    return w.select("dataset_id", *cols, (F.col(f"{a}_fertility") - F.col(f"{b}_fertility")).alias("tok_fertility_gap"))


# ---------------------------------------------------------------- lexicon

def lexicon_rates(docs: DataFrame, lexicon: DataFrame, max_words=3) -> DataFrame:
    """Document rate, token rate, class gap and category entropy of lexicon hits.

    ``docs`` carries the corpus language; ``lexicon`` is (language, lemma,
    n_words, category). N-grams meet the lexicon, a word list that every task holds,
    where they are made, and only hits are shuffled; a corpus without a lexicon gets zeros.
    """
    toks = tx.word_tokens(F.col("text"))
    base = docs.select("dataset_id", "doc_id", "label", "language", toks.alias("t"))
    grams = base.select("dataset_id", "doc_id", "language", F.explode(tx.word_ngrams(F.col("t"), 1, max_words)).alias("lemma"))
    cats = lexicon.groupBy("language", "lemma").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("category")).alias("cats"))
    hits = grams.join(F.broadcast(cats), ["language", "lemma"])
    per_doc = hits.groupBy("dataset_id", "doc_id").agg(
        F.sum((F.col("n_words") == 1).cast("long")).alias("single"))
    d = base.select("dataset_id", "doc_id", "label", F.size("t").alias("tokens")).join(
        per_doc, ["dataset_id", "doc_id"], "left")
    cls = d.groupBy("dataset_id", "label").agg(
        F.count(F.lit(1)).alias("n"), F.count("single").alias("hit"),
        F.sum("tokens").alias("tokens"), F.sum("single").alias("single"))
    per = cls.groupBy("dataset_id").agg(
        (F.sum("hit") / F.sum("n")).alias("hl_doc_rate"),
        _ratio(F.coalesce(F.sum("single"), F.lit(0)), F.sum("tokens")).alias("hl_token_rate"),
        (F.max(F.col("hit") / F.col("n")) - F.min(F.col("hit") / F.col("n"))).alias("hl_class_gap"))
    c = hits.select("dataset_id", F.explode("cats").alias("category")).groupBy(
        "dataset_id", "category").agg(F.count(F.lit(1)).alias("c"))
    ent = c.groupBy("dataset_id").agg(
        (F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("hl_category_entropy"))
    return per.join(ent, "dataset_id", "left").fillna(0.0)


# ---------------------------------------------------------------- class terms

def class_terms(docs: DataFrame) -> DataFrame:
    """(dataset_id, label, term, n, corpus_n, p, q): counts of terms seen at least
    twice in the corpus, their share in the class (p) and in the corpus (q)."""
    cnt = token_counts(docs, tx.word_tokens(F.col("text")), ("dataset_id", "label"), "term")
    corpus = cnt.groupBy("dataset_id", "term").agg(F.sum("n").alias("corpus_n")).filter("corpus_n >= 2")
    kept = cnt.join(corpus, ["dataset_id", "term"])
    cls_tot = kept.groupBy("dataset_id", "label").agg(F.sum("n").alias("_ct"))
    all_tot = cls_tot.groupBy("dataset_id").agg(F.sum("_ct").alias("_at"))
    return (kept.join(cls_tot.join(all_tot, "dataset_id"), ["dataset_id", "label"])
            .withColumn("p", F.col("n") / F.col("_ct")).withColumn("q", F.col("corpus_n") / F.col("_at"))
            .drop("_ct", "_at"))


def _js_shared(p: Column, q: Column) -> Column:
    """Part of a shared term. Summed over shared terms and taken from one this is the
    Jensen-Shannon divergence (base 2): terms on one side only add half their mass."""
    return 0.5 * ((p + q) - p * F.log2(2 * p / (p + q)) - q * F.log2(2 * q / (p + q)))


def _label_pairs(classes: DataFrame) -> DataFrame:
    w = classes.select("dataset_id", "label").distinct()
    a = w.select("dataset_id", F.col("label").alias("a"))
    b = w.select("dataset_id", F.col("label").alias("b"))
    return a.join(b, "dataset_id").filter("a < b")


def class_js(docs: DataFrame) -> DataFrame:
    """ch_js_between_classes: mean divergence over class pairs. Only shared terms
    are joined; a term's group is one row per class."""
    t = class_terms(docs)
    a = t.select("dataset_id", "term", F.col("label").alias("a"), F.col("p").alias("pa"))
    b = t.select("dataset_id", "term", F.col("label").alias("b"), F.col("p").alias("pb"))
    shared = a.join(b, ["dataset_id", "term"]).filter("a < b").groupBy("dataset_id", "a", "b").agg(
        F.sum(_js_shared(F.col("pa"), F.col("pb"))).alias("s"))
    pairs = _label_pairs(docs).join(shared, ["dataset_id", "a", "b"], "left")
    out = pairs.groupBy("dataset_id").agg(F.avg(1 - F.coalesce("s", F.lit(0.0))).alias("ch_js_between_classes"))
    return docs.select("dataset_id").distinct().join(out, "dataset_id", "left").fillna(0.0)


def corpus_js(docs: DataFrame) -> DataFrame:
    """ch_js_class_to_corpus: mean divergence of a class from the whole corpus; 0 without repeated terms."""
    per = class_terms(docs).groupBy("dataset_id", "label").agg(
        (1 - F.sum(_js_shared(F.col("p"), F.col("q")))).alias("js"))
    out = per.groupBy("dataset_id").agg(F.avg("js").alias("ch_js_class_to_corpus"))
    return docs.select("dataset_id").distinct().join(out, "dataset_id", "left").fillna(0.0)


def vocab_jaccard(docs: DataFrame) -> DataFrame:
    """ch_vocab_jaccard: mean overlap of class vocabularies (class count at least 2)."""
    v = token_counts(docs, tx.word_tokens(F.col("text")), ("dataset_id", "label"), "term").filter("n >= 2")
    sizes = v.groupBy("dataset_id", "label").agg(F.count(F.lit(1)).alias("v"))
    a = v.select("dataset_id", "term", F.col("label").alias("a"))
    b = v.select("dataset_id", "term", F.col("label").alias("b"))
    both = a.join(b, ["dataset_id", "term"]).filter("a < b").groupBy("dataset_id", "a", "b").agg(
        F.count(F.lit(1)).alias("i"))
    sa = sizes.select("dataset_id", F.col("label").alias("a"), F.col("v").alias("va"))
    sb = sizes.select("dataset_id", F.col("label").alias("b"), F.col("v").alias("vb"))
    j = (_label_pairs(docs).join(both, ["dataset_id", "a", "b"], "left")
         .join(sa, ["dataset_id", "a"], "left").join(sb, ["dataset_id", "b"], "left").fillna(0, ["i", "va", "vb"]))
    out = j.groupBy("dataset_id").agg(
        F.avg(_ratio(F.col("i"), F.col("va") + F.col("vb") - F.col("i"))).alias("ch_vocab_jaccard"))
    return docs.select("dataset_id").distinct().join(out, "dataset_id", "left").fillna(0.0)


PLACES = 1 << 16


def zipf_slope(docs: DataFrame, k: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """ch_zipf_slope: slope of log10 frequency on log10 place over all terms, or the ``k`` most frequent ones.

    Terms of one frequency take the places after all more frequent ones, in any order, so
    only the number of terms of each frequency matters: their places are a range, summed
    in blocks, and no term moves after it has been counted. ``counts`` (dataset_id, term, n) spares the count.
    """
    cnt = token_counts(docs, tx.word_tokens(F.col("text")), out="term") if counts is None else counts
    above = Window.partitionBy("dataset_id").orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    base = cnt.groupBy("dataset_id", "n").agg(F.count(F.lit(1)).alias("c")).select(
        "dataset_id", F.log10("n").alias("y"), "c", F.coalesce(F.sum("c").over(above), F.lit(0)).alias("base"))
    if k is not None:
        base = base.withColumn("c", F.least(F.col("c"), F.lit(k) - F.col("base"))).filter("c > 0")
    blocks = base.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1, F.lit(PLACES).cast("long"))))
    size = F.least(F.lit(PLACES), F.col("c") - F.col("lo"))
    places = F.sequence(F.col("base") + F.col("lo") + 1, F.col("base") + F.col("lo") + size)
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("xx"))
    sums = F.aggregate(places, zero, lambda a, p: F.struct((a["x"] + F.log10(p)).alias("x"), (a["xx"] + F.log10(p) * F.log10(p)).alias("xx")))
    s = blocks.select("dataset_id", "y", size.alias("n"), sums.alias("s")).groupBy("dataset_id").agg(
        F.sum("n").alias("n"), F.sum("s.x").alias("x"), F.sum("s.xx").alias("xx"), F.sum(F.col("n") * F.col("y")).alias("y"), F.sum(F.col("s.x") * F.col("y")).alias("xy"))
    n, spread = F.col("n"), F.col("n") * F.col("xx") - F.col("x") * F.col("x")
    slope = s.select("dataset_id", F.when(n > 1, (n * F.col("xy") - F.col("x") * F.col("y")) / spread).alias("ch_zipf_slope"))
    return docs.select("dataset_id").distinct().join(slope, "dataset_id", "left").fillna(0.0)
