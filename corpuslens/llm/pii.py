"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are entities that a pattern alone proves: e-mail addresses, IP addresses,
payment cards (Luhn) and international phone numbers. The one and two words
before a seed are lexical patterns. Patterns and the strings that follow them,
seeds or other candidates with digits, form a graph; its scores are computed in
rounds: a pattern is as good as the mean confidence of its different strings, a
string as good as its patterns together (noisy or), seeds being certain. Patterns
with enough support and confidence extract unseen strings of a fitting shape.

Offsets count code points; ends are exclusive.

Defined cases: a null text is empty and has no spans; a null doc_id stays null;
repeated rows are documents of their own (and one string in the graph); an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import Scratch, text_tag

KINDS = ("email", "ip", "card", "phone")
#: A match never starts inside a run that could not start it, so no run is read twice.
PATTERNS = {
    "email": "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9]++(?:[ -][0-9]++)*+",
    "phone": "\\+[0-9][ ().0-9-]+[0-9]",
}
#: Words with a digit, and what follows of such words after single spaces.
CANDIDATE = "(?<![^ \\t-\\r])[^ \\t-\\r0-9]*+[0-9][^ \\t-\\r]*+(?: [^ \\t-\\r0-9]{0,2}+[0-9][^ \\t-\\r]*+)*+"
#: Shapes that unseen strings of a kind must have.
SHAPES = {
    "email": "^[^ @]+(?:@|\\(at\\)|\\[at\\])[^ @]+$",
    "ip": "^(?:[0-9]{1,3}[., -]){3}[0-9]{1,3}$|^[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}$",
    "card": "^[0-9](?:[ .-]?[0-9]){11,18}$",
    "phone": "^\\(?[0-9][0-9 ()./-]{5,18}[0-9]$",
}
#: Code points before an entity that hold its context.
REACH = 64
ROUNDS = 3
#: A pattern needs so many certain strings and this mean confidence.
SUPPORT = 5
CONFIDENCE = 0.6

SPAN = "struct<kind:int,start:int,end:int,surface:string,before:string>"


def _placed(t: Column, pattern: str, kind: int, likely: Column) -> Column:
    """All matches as structs (kind, start, end, surface, before); ``likely`` spares texts that cannot match."""
    found = F.when(likely, F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
    gaps = F.split(t, pattern, -1)
    both = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(a, x):
        s = a["at"] + F.length(x["g"])
        e = s + F.length(x["m"])
        one = F.struct(F.lit(kind).alias("kind"), s.alias("start"), e.alias("end"), x["m"].alias("surface"),
                       F.right(x["g"], F.lit(REACH)).alias("before"))
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(both, start, step, lambda a: a["out"])).otherwise(F.array().cast(f"array<{SPAN}>"))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _good(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, "\\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int"), F.lit(256)) <= 255)
    if kind == "card":
        d = _digits(s)
        return F.when(F.length(d).between(16, 19), F.call_function("luhn_check", d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(s)).between(8, 15)
    return F.lit(True)


def _checker(kind: str):
    return lambda x: _good(kind, x["surface"])


def spans(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, tag, text) -> doc_id, tag, base, cand: arrays of spans by kind and start, without the text."""
    t = F.coalesce(F.col("text"), F.lit(""))
    digit = t.rlike("[0-9]")
    d = docs.select("doc_id", "tag", t.alias("t"), digit.alias("digit"))
    t = F.col("t")
    likely = {"email": F.contains(t, F.lit("@")), "ip": F.col("digit") & F.contains(t, F.lit(".")),
              "card": F.col("digit"), "phone": F.col("digit") & F.contains(t, F.lit("+"))}
    cols = [F.filter(_placed(t, PATTERNS[k], i, likely[k]), _checker(k)).alias(k) for i, k in enumerate(KINDS)]
    d = d.select("doc_id", "tag", *cols, _placed(t, CANDIDATE, -1, F.col("digit")).alias("raw"))
    d = d.select("doc_id", "tag", F.concat(*KINDS).alias("base"), "raw")
    return d.select("doc_id", "tag", "base", F.filter("raw", lambda c: (F.length(c["surface"]) >= 6) & ~F.exists(
        "base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))).alias("cand"))


def _contexts(before: Column) -> Column:
    """The last word and the last two words before an entity, lower case, digits as 0."""
    words = F.filter(F.split(F.lower(F.regexp_replace(before, "[0-9]+", "0")), "[ \\t-\\r]+"), lambda w: w != "")
    n = F.size(words)
    two = F.when(n >= 2, F.concat_ws(" ", F.get(words, n - 2), F.get(words, n - 1)))
    return F.filter(F.array(F.when(n >= 1, F.get(words, n - 1)), two), lambda c: c.isNotNull())


def _trimmed(c: Column) -> Column:
    """A candidate without quotes, brackets and stops around it."""
    core = F.regexp_replace(F.regexp_replace(c["surface"], "^[\"'\\[<:=]*", ""), "[\"'\\]>.,;:!?]+$", "")
    lead = F.length(c["surface"]) - F.length(F.regexp_replace(c["surface"], "^[\"'\\[<:=]*", ""))
    return F.struct(core.alias("surface"), (c["start"] + lead).alias("start"), (c["start"] + lead + F.length(core)).alias("end"))


def bootstrap(table: DataFrame, scratch: Scratch, rounds: int = ROUNDS, support: float = SUPPORT,
              confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(patterns, candidates): patterns (ctx, kind, conf) and the rows (rid, start, end, surface, kind, ctx) they may extract.

    ``table``: rid, base, cand.
    """
    seeds = (table.select(F.explode("base").alias("b"))
             .select("b.kind", "b.surface", F.explode(_contexts(F.col("b.before"))).alias("ctx")).distinct())
    c = table.select("rid", F.explode("cand").alias("c")).select("rid", _trimmed(F.col("c")).alias("t"), F.col("c.before").alias("before"))
    shape = F.filter(F.array(*[F.when(F.col("t.surface").rlike(SHAPES[k]), F.lit(i)) for i, k in enumerate(KINDS)]), lambda k: k.isNotNull())
    c = c.select("rid", "t.start", "t.end", "t.surface", F.explode(_contexts(F.col("before"))).alias("ctx"), shape.alias("kinds"))
    cand = scratch.cut(c, "candidates")
    shaped = cand.select("rid", "start", "end", "surface", "ctx", F.explode("kinds").alias("kind"))
    unseen = shaped.select("kind", "surface", "ctx").distinct()
    strings = seeds.select("ctx", "surface").unionByName(cand.select("ctx", "surface")).distinct().groupBy("ctx").agg(F.count("*").alias("n"))
    sure = scratch.cut(seeds.groupBy("ctx", "kind").agg(F.count("*").cast("double").alias("sure"))
                       .filter(F.col("sure") >= support).join(strings, "ctx"), "sure")
    graph = scratch.cut(unseen.join(sure.select("ctx", "kind"), ["ctx", "kind"]), "graph")

    def rate(belief):
        extra = graph.join(belief, ["surface", "kind"]).groupBy("ctx", "kind").agg(F.sum("conf").alias("extra"))
        s = sure.join(extra, ["ctx", "kind"], "left")
        return (s.withColumn("conf", (F.col("sure") + F.coalesce("extra", F.lit(0.0))) / F.col("n"))
                .filter(F.col("conf") >= confidence).select("ctx", "kind", "conf"))

    belief = unseen.select("surface", "kind", F.lit(0.0).alias("conf")).limit(0)
    patterns = scratch.cut(rate(belief), "patterns-0")
    for r in range(1, rounds):
        belief = (graph.join(patterns, ["ctx", "kind"]).groupBy("surface", "kind")
                  .agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("conf"), F.lit(0.99)))))).alias("conf")))
        patterns = scratch.cut(rate(belief), f"patterns-{r}")
    return patterns, shaped


def personal_data(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, tag (hash of the text), base and every: spans (kind, start, end) by kind and start.

    ``base`` are the seeds, ``every`` has what the patterns add as well. Added
    spans never overlap others.
    """
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    d = d.select("doc_id", text_tag(F.col("text")).alias("tag"), "text")
    table = scratch.cut(spans(d).withColumn("rid", F.monotonically_increasing_id()), "spans")
    patterns, shaped = bootstrap(table.filter(F.size("base") + F.size("cand") > 0).select("rid", "base", "cand"), scratch)
    best = F.max_by("kind", F.struct("conf", -F.col("kind")))
    new = (shaped.join(patterns, ["ctx", "kind"]).groupBy("rid", "start", "end").agg(best.alias("kind"))
           .groupBy("rid").agg(F.collect_list(F.struct("kind", "start", "end")).alias("new")))
    bare = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    out = table.select("rid", "doc_id", "tag", F.array_sort(bare).alias("base")).join(new, "rid", "left")
    every = F.when(F.col("new").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "new")))
    return out.select("doc_id", "tag", "base", every.alias("every"))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span as [KIND]; of overlapping spans the one that starts first (then the longer)."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a, s):
        put = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.get(names, s["kind"]))
        return F.when(s["start"] >= a["at"], F.struct((-s["neg"]).alias("at"), put.alias("out"))).otherwise(a)

    return F.aggregate(order, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
