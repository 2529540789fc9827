"""Secret scans over a trigram inverted index, in DataFrame functions only.

Every rule is a regular expression. Its Boolean trigram query (``trigrams.query_of``) says
which three-letter strings a text must hold to match. One pass over the texts notes the
queries' trigrams that each text holds and applies the rules that have no query, which
must see every text. The notes become postings: for each block of rows and trigram the sorted
row numbers. A rule's candidates are met from the postings of its block by intersection
and union; only candidates are read again and matched.

Offsets count code points; ends are exclusive. Rules name what is looked for; two kinds of
a rule may overlap, and each reports its own spans.

Defined cases: a null text is empty and has no spans; a null doc_id stays null; repeated rows
are documents of their own; an empty table gives no rows; a text without any match has empty arrays.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import Scratch
from corpuslens.llm.trigrams import grams_of, query_of


@dataclass(frozen=True)
class Rule:
    """``least`` characters are asked of ``group`` (0: of the whole match); other matches are dropped, without another try."""

    name: str
    pattern: str
    least: int = 1
    group: int = 0
    any_case: bool = False
    base: bool = False

    @property
    def java(self) -> str:
        return f"(?i){self.pattern}" if self.any_case else self.pattern


#: Order of kinds at equal starts.
RULES = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 2, True, True),
    Rule("access", "AKIA[A-Z0-9]+", 16, base=True),
    # runs of 32 and more are those of any length that are long enough
    Rule("hex", "[0-9a-f]{32,}", 32, base=True),
    Rule("private_key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("code_host", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("cloud_key", "AIza[A-Za-z0-9_-]+", 39),
    Rule("payment_key", "[rs]k_(live|test)_[A-Za-z0-9]+", 24),
    Rule("package_token", "npm_[A-Za-z0-9]+", 40),
    Rule("web_token", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", "bearer\\x20+([A-Za-z0-9+/_.~-]+)", 16, 1, True),
    Rule("login_url", "://[^\\x20\\x09-\\x0D/:@]{1,64}:[^\\x20\\x09-\\x0D/@]{3,128}@"),
)
#: Rows of a block have the same number above these bits: 4096 rows of one task.
BLOCK_BITS = 12

SPAN = "struct<start:int,kind:int,end:int>"
NONE = f"array<{SPAN}>"


def _let(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sums(steps: Column) -> Column:
    """steps (gap, size): the place where each match starts. Blocks of about the root of their number
    are summed apart, so that no long array is copied for each of its elements."""
    empty = F.array().cast("array<int>")

    def run(part, at):
        zero = F.struct(at.alias("at"), empty.alias("out"))
        return F.aggregate(part, zero, lambda a, x: F.struct((a["at"] + x["gap"] + x["size"]).alias("at"),
                                                            F.concat(a["out"], F.array(a["at"] + x["gap"])).alias("out")), lambda a: a["out"])

    def with_width(s, width):
        last = F.floor((F.size(s) - 1) / width).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(s, b * width + 1, width))

        def placed(ps):
            total = F.transform(ps, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x["gap"] + x["size"]))
            zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))
            before = F.aggregate(total, zero, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
            return F.flatten(F.zip_with(ps, before, run))

        return _let(parts, placed)

    return _let(steps, lambda s: _let(F.ceil(F.sqrt(F.size(s))).cast("int"), lambda width: with_width(s, width)))


def spans_of(text: Column, rule: Rule, kind: int) -> Column:
    """The rule's matches in a text: leftmost, not overlapping, long enough."""
    def lengths(group):
        return F.transform(F.regexp_extract_all(text, F.lit(rule.java), F.lit(group)), lambda m: F.length(m))

    def build(sizes):
        gaps = F.slice(F.transform(F.split(text, rule.java, -1), lambda g: F.length(g)), F.lit(1), F.size(sizes))
        steps = F.zip_with(gaps, sizes, lambda g, n: F.struct(g.alias("gap"), n.alias("size")))
        ends = F.zip_with(_sums(steps), sizes, lambda s, n: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + n).alias("end")))
        if not rule.group:
            return F.filter(ends, lambda x: x["end"] - x["start"] >= rule.least)
        fit = F.zip_with(ends, lengths(rule.group), lambda x, n: F.when(n >= rule.least, x))
        return F.filter(fit, lambda x: x.isNotNull())

    return _let(lengths(0), lambda sizes: F.when(F.size(sizes) > 0, build(sizes)).otherwise(F.array().cast(NONE)).cast(NONE))


def _held(text: Column, grams: list[str]) -> Column:
    """Numbers of the trigrams that the text holds."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(g).alias("g")) for i, g in enumerate(grams)])
    return _let(F.lower(text), lambda low: F.transform(F.filter(pairs, lambda p: F.contains(low, p["g"])), lambda p: p["i"]))


def postings(noted: DataFrame) -> DataFrame:
    """block, lists: for every trigram number the sorted rows of the block that hold it. ``noted``: row, grams."""
    rows = noted.select("row", F.explode("grams").alias("gram"))
    lists = (rows.groupBy(F.shiftright("row", BLOCK_BITS).alias("block"), "gram")
             .agg(F.array_sort(F.collect_list("row")).alias("rows")))  # 2**BLOCK_BITS rows at most
    return lists.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "rows"))).alias("lists"))


def met(query, numbers: dict[str, int]) -> Column:
    """Rows of a block that a query lets through."""
    if isinstance(query, str):
        return F.coalesce(F.try_element_at("lists", F.lit(numbers[query])), F.array().cast("array<bigint>"))
    meet = F.array_intersect if query[0] == "and" else F.array_union
    return reduce(meet, [met(q, numbers) for q in sorted(query[1], key=str)])


def candidates(index: DataFrame, queries: dict[int, object], numbers: dict[str, int]) -> DataFrame:
    """row, rules: the rules whose query the row's text satisfies."""
    found = F.array(*[F.struct(F.lit(k).alias("rule"), met(q, numbers).alias("rows")) for k, q in queries.items()])
    hits = index.select(F.explode(found).alias("f")).select("f.rule", F.explode("f.rows").alias("row"))
    return hits.groupBy("row").agg(F.collect_list("rule").alias("rules"))


def secrets(docs: DataFrame, scratch: Scratch, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, base and every: spans (start, kind: number of the rule, end), sorted.

    ``base`` has the spans of base rules, ``every`` those of all rules."""
    queries = {k: query_of(r.pattern) for k, r in enumerate(rules)}
    indexed = {k: q for k, q in queries.items() if q is not True}
    numbers = {g: i for i, g in enumerate(sorted(set().union(set(), *[grams_of(q) for q in indexed.values()])))}
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    always = [spans_of(F.col("text"), r, k) for k, r in enumerate(rules) if k not in indexed]
    seen = F.concat(*always) if always else F.array().cast(NONE)
    grams = _held(F.col("text"), list(numbers)) if numbers else F.array().cast("array<int>")
    held = scratch.cut(d.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", seen.alias("seen"), grams.alias("grams")), "texts")
    wanted = scratch.cut(candidates(postings(held.select("row", "grams")), indexed, numbers), "candidates") if indexed else None
    if wanted is None:
        both = held.select("doc_id", "seen", F.array().cast(NONE).alias("more"))
    else:
        # the candidate table's size is known from its files: small ones are sent to the texts, others meet them in a sort
        j = held.select("row", "doc_id", "text", "seen").join(wanted, "row", "left")
        ask = [F.when(F.array_contains("rules", k), spans_of(F.col("text"), rules[k], k)).otherwise(F.array().cast(NONE)) for k in indexed]
        both = j.select("doc_id", "seen", F.when(F.col("rules").isNull(), F.array().cast(NONE)).otherwise(F.concat(*ask)).alias("more"))
    both = both.select("doc_id", F.array_sort(F.concat("seen", "more")).alias("every"))
    base = [k for k, r in enumerate(rules) if r.base]
    return both.select("doc_id", F.filter("every", lambda s: s["kind"].isin(base)).alias("base"), "every")


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column, rules=RULES) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(r.name) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
