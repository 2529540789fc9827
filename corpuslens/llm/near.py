"""Near-duplicate documents by bottom-k sketches, inverted lists and exact verification.

One hash function orders the five-word shingles of a document; its K smallest
values are the sketch. Equal sets are folded into a class before anything else,
so copies cost one row.

Two classes at the threshold have CUT of their retained values in common (small
sets: three quarters). So, if each class sorts its values from the rarest to the
most frequent, the first common one is among the first K - CUT + 1 of both: only
these go to the inverted lists. Passages that many documents share are frequent,
come last and make no list, unless they are most of a document.

A long list is not expanded into pairs. Only members of *different* components
can still matter. Every member outside the list's largest component is compared
with a hub, a member of that component with few values of its own (such a one is
near the middle of a family of edited copies), and confirmed links join
components; lists inside one component are dropped. Hubs change from turn to
turn, and turns go on while one comparison in GAIN joins something. Of the rest,
lists of up to SMALL members give all pairs across components. A pair that
meets in longer lists only has both members in them: these classes retain
DEEP values instead of K, get lists of their own from the rarest of these, and
go through the same rounds. What is still long then is paired in full, so that
no link is lost. Sets that are whole in their lists (up to three quarters of K
or DEEP shingles) are paired only where the places of their first common value
leave room for the threshold.

Candidates are filtered by the estimate from the union sketch and confirmed on
full shingle sets. At the threshold, fewer than CUT = 28 common values of K = 64
have probability 1e-8, as have fewer than DEEP_CUT = 685 of DEEP = 1024.

Defined cases: no words (null or blank text): 0 shingles, linked with nothing;
fewer than five words: one shingle, the whole sequence; a null doc_id counts
only if no other id is in its component; repeated rows are equal documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import NOT_SPACE, Scratch, id_key, limit_arrow, mix, narrow, run_hash, text_blocks, text_tag, words_of

WIDTH = 5
K = 64
#: Of the K smallest values of a union, so many must be in both for a full check.
CUT = 28
#: Values that members of long lists retain, and how many of them a linked pair shares.
DEEP = 1024
DEEP_CUT = 685
#: Members of a list that is paired in full.
SMALL = 16
#: Up to so many pairs (two numbers of 8 bytes each) are sent to the tables that they name.
FEW = 100_000
#: Hubs drawn for a list at least; more while one comparison in GAIN is a link.
TURNS = 2
GAIN = 8
NUM, DEN = 75, 100

SKETCH = "doc_id long, tag binary, n long, cls binary, sketch array<long>"


def shingle_sets(buf: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    _, _, h, first = words_of(buf, offs, NOT_SPACE)
    runs = run_hash(h, WIDTH)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        m = b - a
        if m >= WIDTH:
            yield np.unique(runs[a:b - WIDTH + 1])
        elif m:
            yield run_hash(h[a:b], m) ^ mix(np.array([m], dtype=np.uint64))
        else:
            yield np.zeros(0, dtype=np.uint64)


def _set_digest(s: np.ndarray) -> bytes:
    """128 bits of a set: two sums of differently mixed members, with its size."""
    two = np.array([s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], dtype=np.uint64)
    return mix(two + np.uint64(len(s))).astype(">u8").tobytes()


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, tag (hash of the text), n (set size), cls (digest of the set), sketch (K smallest values)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offs in text_blocks(batch):
                n, cls, sk = [], [], []
                for s in shingle_sets(buf, offs):
                    n.append(len(s))
                    cls.append(_set_digest(s) if len(s) else None)
                    sk.append(s[:K].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("tag"), pa.array(n, pa.int64()),
                     pa.array(cls, pa.binary()), pa.array(sk, pa.list_(pa.int64()))],
                    ["doc_id", "tag", "n", "cls", "sketch"])

    d = narrow(docs)
    return d.withColumn("tag", text_tag(d["text"])).mapInArrow(run, SKETCH)


def _deep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, n, vals (DEEP smallest values) of texts."""
    for batch in batches:
        for rows, buf, offs in text_blocks(batch):
            vals = [s[:DEEP].view(np.int64) for s in shingle_sets(buf, offs)]
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("n"), pa.array(vals, pa.list_(pa.int64()))], ["id", "n", "vals"])


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): comp is the smallest node reachable.

    Alternates two star operations until nothing changes; each halves the
    distance to the smallest node.
    """
    e = scratch.cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-0")
    seen, step = None, 0
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(low, "a").filter(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "a", "m")
        small = (small.select(F.col("x").alias("a"), F.col("m").alias("b")).filter("a <> b")
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        step += 1
        e2 = scratch.cut(small, f"{label}-{step}")
        now = e2.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{label}-{step - 1}")
        e = e2
        if tuple(now) == seen:
            break
        seen = tuple(now)
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return nodes.unionByName(nodes.select(F.col("comp").alias("node"), "comp").distinct())


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep pairs whose sketches allow a link; ``sure`` if both sketches are whole sets and the link holds."""
    for batch in batches:
        keep, sure = [], []
        na, nb = batch.column("na").to_pylist(), batch.column("nb").to_pylist()
        for k, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"))):
            both = np.sort(np.concatenate([x.values.to_numpy(), y.values.to_numpy()]).view(np.uint64))
            same = both[1:] == both[:-1]
            if na[k] <= K and nb[k] <= K:
                common = int(same.sum())
                if DEN * common >= NUM * (len(both) - common):
                    keep.append(k)
                    sure.append(True)
                continue
            first = np.concatenate([[True], ~same])
            last = both[first][K - 1] if first.sum() >= K else both[-1]
            if int((same & (both[1:] <= last)).sum()) >= CUT:
                keep.append(k)
                sure.append(False)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("a").take(at), batch.column("b").take(at), pa.array(sure, pa.bool_())], ["a", "b", "sure"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def whole(x):
        raw = np.frombuffer(x.encode(), dtype=np.uint8)
        return next(shingle_sets(raw, np.array([0, len(raw)])))

    last, last_set = None, None
    for batch in batches:
        keep = []
        ids = batch.column("a").to_pylist()
        for k, (x, y) in enumerate(zip(batch.column("ta"), batch.column("tb"))):
            if ids[k] != last:
                last, last_set = ids[k], whole(x.as_py())
            other = whole(y.as_py())
            common = len(np.intersect1d(last_set, other, assume_unique=True))
            if DEN * common >= NUM * (len(last_set) + len(other) - common):
                keep.append(k)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], ["a", "b"])


def _first_of_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that repeat the class before them go: copies of one row arrive side by side."""
    last = None
    for batch in batches:
        keep = []
        for k, c in enumerate(batch.column("id").to_pylist()):
            if c != last:
                keep.append(k)
            last = c
        yield batch.take(pa.array(keep, pa.int64()))


class _Linker:
    """Confirms candidate pairs and keeps the components of what is confirmed."""

    def __init__(self, classes: DataFrame, texts: DataFrame, scratch: Scratch):
        self.classes, self.texts, self.scratch = classes, texts, scratch
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None
        self.round = 0

    def _only(self, table: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
        """Rows of ``table`` whose class is in ``pairs``. Few pairs (counted, at most FEW) go to the table; many leave it whole."""
        if n > FEW:
            return table
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        return table.join(F.broadcast(ids), "id", "left_semi")

    def add(self, pairs: DataFrame) -> tuple[int, int]:
        """``pairs``: a, b (classes), na, nb (their sizes). Returns how many pairs were compared and linked."""
        self.round += 1
        s, r = self.scratch, self.round
        pairs = s.cut(pairs, f"pairs-{r}")
        n = sent = pairs.count()
        if not n:
            return 0, 0
        few = self._only(self.classes, pairs, n)
        sk = few.select(F.col("id").alias("a"), F.col("sketch").alias("sa"))
        sk2 = few.select(F.col("id").alias("b"), F.col("sketch").alias("sb"))
        likely = s.cut(pairs.join(sk, "a").join(sk2, "b").mapInArrow(_estimate, "a long, b long, sure boolean"), f"likely-{r}")
        check = likely.filter("not sure").select("a", "b")
        n = check.count()
        new = likely.filter("sure").select("a", "b")
        if n:
            few = self._only(self.texts, check, n)
            ta = few.select(F.col("id").alias("a"), F.col("text").alias("ta"))
            tb = few.select(F.col("id").alias("b"), F.col("text").alias("tb"))
            new = new.unionByName(check.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb").mapInArrow(_verify, "a long, b long"))
        new = s.cut(new, f"links-{r}")
        s.drop_all("pairs-", "likely-")
        linked = new.count()
        if not linked:
            return sent, 0
        edges = new if self.labels is None else new.unionByName(self.links)
        found = components(edges, s, f"comp-{r}")
        old = [x for x in s.labels if x.startswith("labels-")]
        self.labels = s.cut(found, f"labels-{r}")
        # callers mark their lists anew after each call, so nothing reads the labels before
        s.drop_all("links-", "comp-")
        for x in old:
            s.drop(x)
        # a star per component says the same as all links so far
        self.links = self.labels.filter("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))
        return sent, linked

    def mark(self, inv: DataFrame) -> DataFrame:
        """Rows of lists that reach over components: comp, the list's largest component top, members m, and how many are out of top."""
        if self.labels is not None:
            inv = (inv.join(self.labels.withColumnRenamed("node", "id"), "id", "left")
                   .withColumn("comp", F.coalesce("comp", "id")))
        else:
            inv = inv.withColumn("comp", F.col("id"))
        stat = (inv.groupBy("key", "comp").agg(F.count("*").alias("c"), (-F.min("own")).alias("o")).groupBy("key")
                .agg(F.sum("c").alias("m"), F.max(F.struct("c", "o", "comp")).alias("t"))
                .select("key", F.col("t.comp").alias("top"), "m", (F.col("m") - F.col("t.c")).alias("out")).filter("out > 0"))
        return inv.join(stat, "key")


def _fits(x: str, y: str):
    """Sizes that allow the threshold."""
    return DEN * F.least(x, y) >= NUM * F.greatest(x, y)


def _meets(a: str, b: str):
    """A pair may link and this may be its first common value: nothing before it is shared, and the rest suffices.

    The places count for sets that are whole; if less than a place's rest is
    common at the first common value, the threshold cannot be reached.
    """
    n1, n2, p1, p2 = (F.col(f"{x}.{y}") for y in ("n", "pos") for x in (a, b))
    common = F.ceil((n1 + n2) * NUM / (NUM + DEN))
    placed = (p1 <= n1 - common + 1) & (p2 <= n2 - common + 1)
    return _fits(f"{a}.n", f"{b}.n") & (placed | ~(F.col(f"{a}.whole") & F.col(f"{b}.whole")))


def _rare_lists(sets: DataFrame, k: int, cut: int) -> DataFrame:
    """Inverted lists (key, id, n, own, whole, pos) of the rarest of the ``k`` values that ``sets`` (id, n, vals) retain.

    A linked pair has ``cut`` values in common, or three quarters of a set that
    is whole like all its partners; its first common value in the order of
    (frequency, value) is in both prefixes. Values that one set alone has come
    first and join nothing, so they are only counted (own). ``pos`` is a
    value's place in its set's order, from 1.
    """
    keys = sets.select("id", F.col("n").cast("int").alias("n"), F.explode("vals").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("f")).filter("f > 1")
    part = F.ceil(F.col("n") * NUM / DEN)
    need = F.when(DEN * F.col("n") <= NUM * k, part).otherwise(F.least(part, F.lit(cut)))
    alone = F.least(F.col("n"), F.lit(k)) - F.size("v")
    first = F.least(F.col("n"), F.lit(k)) - need + 1 - alone
    mine = (keys.join(shared, "key").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("f", "key"))).alias("v"))
            .select("id", F.col("n").cast("long").alias("n"), alone.alias("own"), (DEN * F.col("n") <= NUM * k).alias("whole"),
                    F.posexplode(F.slice("v", 1, F.greatest(F.lit(0), first).cast("int"))).alias("pos", "v"))
            .select("id", "n", "own", "whole", (F.col("own") + F.col("pos") + 1).alias("pos"), "v.key"))
    met = mine.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    return mine.join(met, "key")


def _hub_pairs(marked: DataFrame, turn: int) -> DataFrame:
    """Each member out of its list's largest component, with a member of that component: one of few own values, from another quarter in each turn."""
    away = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(4)) > 0
    hub = (marked.filter("comp = top").groupBy("key")
           .agg(F.min(F.struct((F.lit(turn > 1) & away).alias("away"), "own", "id", "n", "pos", "whole")).alias("hub")))
    return (marked.filter("comp <> top").select("key", F.struct("id", "n", "pos", "whole").alias("l")).join(hub, "key")
            .filter(_meets("hub", "l"))
            .select(F.col("hub.id").alias("a"), F.col("l.id").alias("b"), F.col("hub.n").alias("na"), F.col("l.n").alias("nb")).distinct())


def _cross_pairs(marked: DataFrame) -> DataFrame:
    """Pairs of members in different components, once."""
    side = F.struct("id", "n", "pos", "whole", "comp")
    l = marked.filter("comp <> top").select(F.col("key").alias("at"), side.alias("l"))
    r = marked.select("key", "top", side.alias("r"))
    once = (F.col("r.comp") == F.col("top")) | (F.col("l.id") < F.col("r.id"))
    p = l.join(r, (F.col("at") == F.col("key")) & (F.col("l.comp") != F.col("r.comp")) & once & _meets("l", "r"))
    turned = F.col("l.id") > F.col("r.id")
    a, b = F.when(turned, F.col("r")).otherwise(F.col("l")), F.when(turned, F.col("l")).otherwise(F.col("r"))
    return p.select(a.getField("id").alias("a"), b.getField("id").alias("b"), a.getField("n").alias("na"), b.getField("n").alias("nb")).distinct()


def _rounds(linker: _Linker, lists: DataFrame, name: str, last: bool) -> DataFrame:
    """Compare the members of ``lists``; what is long afterwards is returned, or paired too if ``last``."""
    s, turn = linker.scratch, 1
    sent, linked = linker.add(_hub_pairs(s.cut(linker.mark(lists), f"{name}-1"), 1))
    while sent and (turn < TURNS or linked * GAIN >= sent):
        turn += 1
        s.drop(f"{name}-{turn - 1}")
        # a list of two members has been compared
        sent, linked = linker.add(_hub_pairs(s.cut(linker.mark(lists).filter("m > 2"), f"{name}-{turn}"), turn))
    marked = s.cut(linker.mark(lists).filter("m > 2"), f"{name}-rest")
    short = F.col("m") <= SMALL
    linker.add(_cross_pairs(marked if last else marked.filter(short)))
    return linker.mark(marked.filter(~short).select(*lists.columns))


def near_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Per row of ``docs``: doc_id, tag, n_shingles, component_id, kept, chosen.

    ``kept``: the id is its component's. ``chosen`` also settles ids that several
    texts share: it marks the rows of one (doc_id, tag) in each component.
    """
    limit_arrow(docs.sparkSession)
    rows = scratch.cut(sketches(docs), "sketches")
    classes = rows.filter("n > 0").groupBy("cls").agg(
        F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min(F.struct("doc_id", "tag")).alias("rep"))
    classes = scratch.cut(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    # a set of one shingle has no near copy but equal sets
    lists = scratch.cut(_rare_lists(classes.filter("n > 1").select("id", "n", F.col("sketch").alias("vals")), K, CUT), "lists")
    wanted = classes.filter(DEN * F.col("n") > NUM * K).join(lists.select("id").distinct(), "id", "left_semi")
    wanted = wanted.select("id", "n", id_key(F.col("rep.doc_id")).alias("doc_key"), F.col("rep.tag").alias("tag"))
    d = narrow(docs)
    d = d.select(id_key(d["doc_id"]).alias("doc_key"), text_tag(d["text"]).alias("tag"), "text")
    texts = scratch.cut(d.join(wanted, ["doc_key", "tag"]).select("id", "n", "text")
                        .mapInArrow(_first_of_run, "id long, n long, text string"), "texts")

    linker = _Linker(classes.select("id", "sketch"), texts.select("id", "text"), scratch)
    hard = scratch.cut(_rounds(linker, lists, "marked", False).select("id").distinct(), "hard")
    scratch.drop_all("marked-", "lists")
    if not hard.isEmpty():
        whole = classes.filter(F.col("n").between(2, K)).join(hard, "id", "left_semi").select("id", "n", F.col("sketch").alias("vals"))
        deep = texts.filter(F.col("n") > K).join(hard, "id", "left_semi").mapInArrow(_deep, "id long, n long, vals array<long>")
        # repeated rows of one id and text may have left a text twice
        sets = whole.unionByName(deep).groupBy("id").agg(F.first("n").alias("n"), F.first("vals").alias("vals"))
        sets = scratch.cut(sets, "deep")
        _rounds(linker, scratch.cut(_rare_lists(sets, DEEP, DEEP_CUT), "deep-lists"), "deep-marked", True)
    comp = classes.select("cls", "id")
    if linker.labels is None:
        comp = comp.select("cls", F.col("id").alias("comp"))
    else:
        comp = (comp.join(linker.labels.withColumnRenamed("node", "id"), "id", "left")
                .select("cls", F.coalesce("comp", "id").alias("comp")))
    comp = scratch.cut(comp, "result")
    scratch.keep("sketches", "result")  # all that the answer reads
    out = rows.select("doc_id", "tag", "n", "cls").join(comp, "cls", "left")
    out = out.select("doc_id", "tag", F.col("n").alias("n_shingles"), "comp")
    # the smallest id first, null after all others
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    least = out.filter("comp is not null").groupBy("comp").agg(F.min(place).alias("low"))
    out = (out.join(least, "comp", "left")
           .withColumn("component_id", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("low.doc_id"))))
    return out.select("doc_id", "tag", "n_shingles", "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
                      (F.col("comp").isNull() | (place == F.col("low"))).alias("chosen"))
