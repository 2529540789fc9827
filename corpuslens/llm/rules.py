"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of character classes and its histogram of its language's
most common words are compared with the language's own (the reference, medians
over all different texts of that language) by Jensen-Shannon distance. Documents
under a minimum length are not judged by a histogram that they cannot fill.

Two rules stand before the divergence: at least MIN_WORDS words, and at most
REPEAT_PCT per cent of the words inside a five-word window that occurs twice.

Defined cases: a null text is empty (it has no words and fails the first rule);
a null language is a language of its own; repeated rows are judged alike; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.llm.common import Scratch

SPACE = "[ \\t-\\r]"
MIN_WORDS = 10
REPEAT_PCT = 20
RUN = 5
#: Common words of a language that form the word histogram.
TOP = 24
#: Documents with fewer characters (words) are not judged by the class (word) histogram.
MIN_CHARS = 200
MIN_COMMON = 100
#: Steps of a share in the reference, and the weight of a text where words are counted.
SCALE = 10_000
ONE = 1 << 30
#: Largest Jensen-Shannon distances (base 2, 0 to 1) of a document that stays.
MAX_CLASS = 0.30
MAX_WORD = 0.33

#: Character classes by what they hold, besides lower-case letters; what is in none of them is the last class.
LOWER = "\\p{Ll}+"
CLASSES = {
    "upper": "\\p{Lu}", "digit": "\\p{Nd}", "space": " \\t-\\r", "stop": ".,;:?'\"()!-",
    "mark": "#*$%&|<>{}\\[\\]=_/\\\\@^~+`",
}
SYMBOLS = "#*$%&|<>"


def _only(rest: Column, inside: str) -> Column:
    return F.length(F.regexp_replace(rest, f"[^{inside}]+", "")).cast("long")


def _class_counts(size: Column, rest: Column) -> list[Column]:
    """Counts by class. ``rest`` is the text without lower-case letters, which are most of it."""
    counts = [(size - F.length(rest)).cast("long"), *[_only(rest, p) for p in CLASSES.values()]]
    return counts


def _hashes(t: Column) -> Column:
    """64-bit hashes of the words, in order."""
    return F.array_remove(F.transform(F.split(t, SPACE + "+"), lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and, of the column t: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_chars, classes, words (hashes)."""
    t, rest = F.col("t"), F.col("rest")
    lines = F.filter(F.split(t, "\n"), lambda l: l.rlike("[^ \\t-\\r]"))
    d = docs.select(*keep, F.length(t).alias("n_chars"), F.regexp_replace(t, LOWER, "").alias("rest"), _hashes(t).alias("words"), lines.alias("lines"))
    n = F.size("words")
    # five words from pairs of pairs
    two = F.zip_with(F.slice("words", 1, n - 1), F.slice("words", 2, n - 1), lambda a, b: F.xxhash64(a, b))
    d = d.select(*keep, "n_chars", "words", n.alias("n"), F.array(*_class_counts(F.col("n_chars"), rest)).alias("classes"),
                 _only(rest, SYMBOLS).alias("n_symbols"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.when(n >= RUN, two).alias("two"))
    m = F.size("two")
    four = F.zip_with(F.slice("two", 1, m - 3), F.slice("two", 3, m - 3), lambda a, b: F.xxhash64(a, b))
    d = d.withColumn("win", F.when(m > 0, F.zip_with(four, F.slice("words", 5, m - 3), lambda a, b: F.xxhash64(a, b)))).drop("two")
    # only texts with a repeated window need to know where its occurrences are
    repeated = F.size(F.array_distinct("win")) < F.size("win")
    placed = F.array_sort(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("placed", F.when(repeated, placed)).drop("win")
    size = F.size("placed")
    # neighbours in the order of hashes tell which occurrences are not alone
    again = F.filter("placed", lambda x, k: ((k > 0) & (F.get("placed", k - 1)["h"] == x["h"]))
                     | ((k < size - 1) & (F.get("placed", k + 1)["h"] == x["h"])))
    starts = F.array_sort(F.transform(again, lambda x: x["i"]))
    d = d.withColumn("starts", F.when(F.col("placed").isNotNull(), starts)).drop("placed")
    last = F.size("starts") - 1
    covered = F.aggregate(F.transform("starts", lambda s, k: F.when(k < last, F.least(F.lit(RUN), F.get("starts", k + 1) - s)).otherwise(RUN)),
                          F.lit(0), lambda a, x: a + x)
    space = F.get("classes", F.lit(1 + list(CLASSES).index("space")))
    return d.select(*keep, F.struct(
        F.col("n").cast("long").alias("n_words"), (F.col("n_chars") - space).alias("word_chars"), "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), F.col("n_chars").cast("long").alias("n_chars"),
        "classes", "words").alias("m"))


def _key(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit("\x00none"))


def _placed(words: Column, ref_words: Column) -> Column:
    """Places (from 1) in ``ref_words`` of the words that are in it."""
    return F.array_remove(F.transform(words, lambda w: F.array_position(ref_words, w).cast("int")), F.lit(0))


def _spread(placed: Column, size: Column, n_words: Column) -> Column:
    """Counts of the places 1..``size``, with the words in none of them last; null if ``size`` is 0."""
    hits = F.size(placed)
    counts = F.transform(F.sequence(F.lit(1), size), lambda k: (hits - F.size(F.array_remove(placed, k))).cast("long"))
    return F.when(size > 0, F.concat(counts, F.array((n_words - hits).cast("long"))))


def common_words(docs: DataFrame, bound: int = 200_000) -> DataFrame:
    """Per lang_key of ``docs`` (lang_key, t, d1, d2): top, the hashes of the TOP words that most different texts hold.

    Every different text counts once, however many rows hold it. Texts that occur more
    than once are sent to all tasks if they are at most ``bound`` (their keys are at
    most 512 bytes, so some 100 MB at the very worst), else joined by shuffle.
    """
    key = ["lang_key", "d1", "d2"]
    copies = docs.groupBy(*key).agg(F.count("*").alias("copies")).filter("copies > 1")
    size = copies.limit(bound + 1).agg(F.count("*").alias("n"), F.max(F.length("lang_key")).alias("longest")).first()
    if size.n <= bound and (size.longest or 0) <= 512:
        copies = F.broadcast(copies)
    # integers, so that the order of adding does not matter; a group of copies adds up to one text
    share = F.floor(F.lit(ONE) / F.coalesce("copies", F.lit(1)))
    words = (docs.join(copies, key, "left").select("lang_key", share.alias("c"), F.explode(F.array_distinct(_hashes(F.col("t")))).alias("w"))
             .groupBy("lang_key", "w").agg(F.sum("c").alias("c")))
    slice_order = Window.partitionBy("lang_key", "salt").orderBy(F.col("c").desc(), "w")
    few = (words.withColumn("salt", F.pmod("w", F.lit(64)).cast("int"))
           .withColumn("r", F.row_number().over(slice_order)).filter(F.col("r") <= TOP))
    order = Window.partitionBy("lang_key").orderBy(F.col("c").desc(), "w")
    return (few.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= TOP)
            .groupBy("lang_key").agg(F.array_sort(F.collect_list(F.struct("r", "w"))).alias("top")).select("lang_key", F.col("top.w").alias("top")))


def references(measured: DataFrame) -> DataFrame:
    """Per lang_key: class shares with the rest last, and the shares of its common words (0: not used).

    ``measured``: lang_key, d1, d2, classes, counts and m. Every different text counts once
    and by its shares, not its length (a text too short to be judged counts less). A share
    of the reference is the median over these texts, so what fewer than half of them have,
    copies with small changes or a large source among it, cannot decide it.
    """
    def shares(counts, total):
        return F.when(total > 0, F.transform(counts, lambda c: F.round(c * SCALE / total).cast("int")))

    size, n = F.col("m.n_chars"), F.col("m.n_words")
    d = measured.select("lang_key", "d1", "d2", F.struct(
        F.least(size, F.lit(MIN_CHARS)).alias("size"), F.least(n, F.lit(MIN_COMMON)).alias("n"),
        shares(F.col("classes"), size).alias("classes"), shares(F.col("counts"), n).alias("counts")).alias("s"))
    d = d.groupBy("lang_key", "d1", "d2").agg(F.first("s").alias("s"))

    def median(part, k, weight):
        return F.round(F.coalesce(F.percentile(F.get(f"s.{part}", F.lit(k)), F.lit(0.5), F.col(f"s.{weight}")), F.lit(0.0))).cast("long")

    return d.groupBy("lang_key").agg(F.array(*[median("classes", k, "size") for k in range(len(CLASSES) + 2)]).alias("ref_classes"),
                                     F.max(F.size("s.counts")).alias("k"), F.array(*[median("counts", k, "n") for k in range(TOP)]).alias("c")).select(
        # the last of the counts are the words in none of the places
        "lang_key", "ref_classes", F.slice("c", F.lit(1), F.greatest(F.lit(0), F.coalesce("k", F.lit(0)) - 1)).alias("ref_words"))


def _used(counts: Column, ref: Column) -> Column:
    """Of the counts (the rest last) those of words that the reference uses."""
    return F.transform(F.filter(F.arrays_zip(F.slice(counts, F.lit(1), F.size(ref)).alias("n"), ref.alias("c")), lambda x: x["c"] > 0), lambda x: x["n"])


def _with_rest(used: Column, counts: Column) -> Column:
    """``used`` and all other counts as the rest; null if none is used."""
    def total(a):
        return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(F.size(used) > 0, F.concat(used, F.array(total(counts) - total(used))))


def _rest(shares: Column) -> Column:
    used = F.filter(shares, lambda c: c > 0)
    return F.concat(used, F.array(F.greatest(F.lit(0).cast("long"), SCALE - F.aggregate(used, F.lit(0).cast("long"), lambda a, x: a + x))))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _js(p: Column, q: Column, tp: Column, tq: Column) -> Column:
    """``js_distance`` with the sums of ``p`` and ``q`` given."""
    def half(x, m):
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    parts = F.zip_with(p, q, lambda a, b: F.struct((a / tp).alias("a"), (b / tq).alias("b")))
    terms = F.transform(parts, lambda s: (half(s["a"], (s["a"] + s["b"]) / 2) + half(s["b"], (s["a"] + s["b"]) / 2)) / 2)
    return F.when((tp > 0) & (tq > 0), F.sqrt(F.greatest(F.lit(0.0), _total(terms)))).otherwise(0.0)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of counts of one length; 0 if either is all zero."""
    return _js(p, q, _total(p), _total(q))


def judged(docs: DataFrame, scratch: Scratch, text: str = "text", lang: str = "lang", max_class: float = MAX_CLASS,
           max_word: float = MAX_WORD, bound: int = 10_000, keep: list[str] | None = None) -> DataFrame:
    """Two structs: row, the columns of ``docs`` (or those named by ``keep``), and q: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_js, word_js, base_failed, kept.

    All a text gives is measured in one pass and stored; medians and distances come from the
    stored rows. Common words and references are broadcast if there are at most ``bound``
    languages (some 500 bytes each), and joined by shuffle beyond that.
    """
    t = F.coalesce(docs[text], F.lit(""))
    inner = docs.select(F.struct(*[docs[c] for c in (docs.columns if keep is None else keep)]).alias("row"), t.alias("t"), _key(docs[lang]).alias("lang_key"),
                        F.xxhash64(t).alias("d1"), F.xxhash64(F.lit(1), t).alias("d2"))
    few = F.broadcast if docs.select(F.approx_count_distinct(lang)).first()[0] <= bound else lambda df: df
    top = few(common_words(inner.select("lang_key", "t", "d1", "d2")))
    d = measures(inner, "row", "lang_key", "d1", "d2").join(top, "lang_key", "left")
    held = F.coalesce("top", F.array().cast("array<bigint>"))
    classes = F.concat("m.classes", F.array(F.col("m.n_chars") - F.aggregate("m.classes", F.lit(0).cast("long"), lambda a, x: a + x)))
    d = d.select("row", "lang_key", "d1", "d2", "m", classes.alias("classes"), F.size(held).alias("k"), _placed(F.col("m.words"), held).alias("placed"))
    d = scratch.cut(d.select("row", "lang_key", "d1", "d2", F.col("m").dropFields("words", "classes").alias("m"), "classes",
                             _spread(F.col("placed"), F.col("k"), F.col("m.n_words")).alias("counts")), "measured")
    # what a language gives is worked out once a language, and what is read more than once has a column of its own:
    # an expression inside a lambda is evaluated again for every element
    ref = references(d).withColumn("ref_rest", _rest(F.col("ref_words"))).withColumns(
        {"ref_chars": _total(F.col("ref_classes")), "ref_n": _total(F.col("ref_rest"))})
    d = d.join(few(ref), "lang_key", "left")
    failed = (F.col("m.n_words") < MIN_WORDS) | (100 * F.col("m.n_repeat_words") > REPEAT_PCT * F.col("m.n_words"))
    long, wordy = F.col("m.n_chars") >= MIN_CHARS, F.col("m.n_words") >= MIN_COMMON
    d = d.withColumns({"used": F.when(wordy, _used(F.col("counts"), F.col("ref_words"))), "n_classes": F.when(long, _total(F.col("classes")))})
    d = d.withColumn("common", _with_rest(F.col("used"), F.col("counts")))
    d = d.withColumn("n_common", _total(F.col("common")))
    cls = F.when(long, _js(F.col("classes"), F.col("ref_classes"), F.col("n_classes"), F.col("ref_chars")))
    wrd = F.when(wordy, _js(F.col("common"), F.col("ref_rest"), F.col("n_common"), F.col("ref_n")))
    d = d.select("row", "m", failed.alias("failed"), cls.alias("class_js"), wrd.alias("word_js"))
    keeps = (~F.col("failed") & (F.coalesce("class_js", F.lit(0.0)) <= max_class) & (F.coalesce("word_js", F.lit(0.0)) <= max_word))
    q = F.struct("m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "class_js", "word_js",
                 F.col("failed").alias("base_failed"), keeps.alias("kept"))
    # a filter on q must not be pushed below: it would repeat every expression in itself, many times over
    return d.select("row", F.explode(F.array(q)).alias("q"))
