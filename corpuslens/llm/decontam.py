"""Benchmark decontamination on a positional inverted index partitioned by document.

``build_index`` stores, for blocks of whole documents, every token's postings:
sorted term hashes, where each term's list begins, and positions. ``find_phrases``
sends a bounded block of test phrases to all index blocks; inside one, lists are
intersected after subtracting each term's offset in the phrase, rarest list
first. With ``slop`` the same intersection accepts positions that are off by up
to so many words (proximity matches); 0 is the exact phrase.

Defined cases: a null text has no words; a null doc_id stays null; a null
item_id is the empty string in lists; a test item without words has no phrase;
repeated rows are documents (items) of their own; an empty table gives no rows
(no matches).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import ALNUM, Scratch, limit_arrow, narrow, text_blocks, text_tag, words_of

#: Bytes of text in an index block, and of test texts sent to the index at a time.
INDEX_BYTES = 8 << 20
TEST_BYTES = 8 << 20
#: Phrases that are intersected at a time within a block.
AT_ONCE = 20_000
WINDOW = 10

INDEX = "block string, doc_id array<long>, tag array<binary>, first array<int>, terms binary, starts binary, positions binary"
FOUND = "block string, ord int, item string, start int, end int"


def _index_row(ids: list, tags: list, firsts: list, hashes: list) -> pa.RecordBatch:
    import uuid
    n = np.cumsum([0] + [len(h) for h in hashes])
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    first = np.concatenate([f[:-1] + a for f, a in zip(firsts, n)] + [n[-1:]])
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    starts = np.append(new, len(s)).astype(np.uint32)
    doc_id = pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([
        pa.array([uuid.uuid4().hex]), doc_id, pa.array([pa.concat_arrays(tags).to_pylist()], pa.list_(pa.binary())), pa.array([first.astype(np.int32)], pa.list_(pa.int32())),
        pa.array([s[new].tobytes()], pa.binary()), pa.array([starts.tobytes()], pa.binary()),
        pa.array([order.astype(np.uint32).tobytes()], pa.binary())],
        ["block", "doc_id", "tag", "first", "terms", "starts", "positions"])


def build_index(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Postings of all tokens of ``docs`` (doc_id, text), stored; one row per block of documents."""
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tags, firsts, hashes, size = [], [], [], [], 0
        for batch in batches:
            for rows, buf, offs in text_blocks(batch):
                _, _, h, first = words_of(buf, offs, ALNUM)
                ids.append(rows.column("doc_id"))
                tags.append(rows.column("tag"))
                firsts.append(first)
                hashes.append(h)
                size += len(buf)
                if size >= INDEX_BYTES:
                    yield _index_row(ids, tags, firsts, hashes)
                    ids, tags, firsts, hashes, size = [], [], [], [], 0
        if ids:
            yield _index_row(ids, tags, firsts, hashes)

    limit_arrow(docs.sparkSession)
    return scratch.cut(docs.select("doc_id", text_tag(docs["text"]).alias("tag"), "text").mapInArrow(index, INDEX), "index")


def phrases(texts: list[str], items: list[str], window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, item) by phrase length: the windows of each item, or the whole item if it is shorter."""
    by_length: dict[int, tuple[list, list]] = {}
    for k, text in enumerate(texts):
        raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
        h = words_of(raw, np.array([0, len(raw)]), ALNUM)[2]
        n = min(len(h), window)
        if n:
            rows, owner = by_length.setdefault(n, ([], []))
            rows.append(np.lib.stride_tricks.sliding_window_view(h, n))
            owner.append(np.full(len(h) - n + 1, k))
    return [(np.concatenate(r), np.concatenate(o)) for r, o in by_length.values()]


def _intersect(terms, starts, pos, keys, want, slop):
    """(phrase, start) of every occurrence: offset-adjusted lists met from the rarest on."""
    width = want.shape[1]
    at = np.searchsorted(terms, want)
    at[at == len(terms)] = 0
    alive = np.flatnonzero((terms[at] == want).all(axis=1))
    at = at[alive]
    count = (starts[at + 1] - starts[at]).astype(np.int64)
    order = np.argsort(count, axis=1, kind="stable")
    row = np.arange(len(alive))
    lead = order[:, 0]
    n = count[row, lead]
    who = np.repeat(row, n)
    inside = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    begin = pos[starts[at[who, lead[who]]] + inside].astype(np.int64) - lead[who]
    keep = begin >= 0
    who, begin = who[keep], begin[keep]
    for j in range(1, width):
        off = order[who, j]
        rank = at[who, off].astype(np.uint64) << np.uint64(32)
        low = rank | np.maximum(begin + off - slop, 0).astype(np.uint64)
        high = rank | (begin + off + slop).astype(np.uint64)
        k = np.searchsorted(keys, low)
        hit = k < len(keys)
        hit[hit] = keys[k[hit]] <= high[hit]
        who, begin = who[hit], begin[hit]
    return alive[who], begin


def _search(row: dict, tests, items, slop):
    terms = np.frombuffer(row["terms"], dtype=np.uint64)
    starts = np.frombuffer(row["starts"], dtype=np.uint32).astype(np.int64)
    pos = np.frombuffer(row["positions"], dtype=np.uint32)
    first = np.asarray(row["first"], dtype=np.int64)
    if not len(terms):
        return None
    keys = (np.repeat(np.arange(len(terms), dtype=np.uint64), np.diff(starts)) << np.uint64(32)) | pos
    found = []
    for want, owner in tests:
        width = want.shape[1]
        for a in range(0, len(want), AT_ONCE):
            w, b = _intersect(terms, starts, pos, keys, want[a:a + AT_ONCE], slop)
            doc = np.searchsorted(first, b, side="right") - 1
            ok = b + width <= first[np.minimum(doc + 1, len(first) - 1)]
            found.append((doc[ok], owner[a:a + AT_ONCE][w[ok]], b[ok] - first[doc[ok]],
                          np.full(int(ok.sum()), width)))
    doc, item, begin, width = (np.concatenate(x) for x in zip(*found))
    if not len(doc):
        return None
    order = np.lexsort((begin, item, doc))
    doc, item, begin, end = doc[order], item[order], begin[order], (begin + width)[order]
    # an item's phrases have one length, so ends are in order too
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (begin[1:] > end[:-1])
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(doc)) - 1
    return pa.RecordBatch.from_arrays([
        pa.array([row["block"]] * len(s)), pa.array(doc[s].astype(np.int32)),
        pa.array([items[k] for k in item[s]], pa.string()),
        pa.array(begin[s].astype(np.int32)), pa.array(end[e].astype(np.int32))],
        ["block", "ord", "item", "start", "end"])


def find_phrases(index: DataFrame, tests: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Word spans (block, ord, item, start, end) of ``index`` that match a phrase of ``tests`` (item_id, text).

    Test texts go out in blocks of about TEST_BYTES, each against the whole index.
    """
    spark = index.sparkSession
    t = tests.select(F.coalesce(tests["item_id"].cast("string"), F.lit("")).alias("item"),
                     F.coalesce(tests["text"], F.lit("")).alias("text"))
    total = t.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // TEST_BYTES + 1
    out = None
    for b in range(blocks):
        part = t.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect() if blocks > 1 else t.collect()
        items = [r["item"] for r in part]
        shared = spark.sparkContext.broadcast((phrases([r["text"] for r in part], items, window), items))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            prepared, names = shared.value
            for batch in batches:
                for k in range(batch.num_rows if prepared else 0):
                    row = {c: batch.column(c)[k].as_py() for c in ("block", "first", "terms", "starts", "positions")}
                    got = _search(row, prepared, names, slop)
                    if got is not None:
                        yield got

        hits = index.select("block", "first", "terms", "starts", "positions").mapInArrow(search, FOUND)
        out = hits if out is None else out.unionByName(hits)
    return out


def contamination(docs: DataFrame, tests: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, tag (hash of the text), n_words, n_hit, items (sorted item ids found), spans (word spans with item).

    One row per input row. ``n_hit`` counts words inside any match once.
    """
    index = build_index(narrow(docs), scratch)
    counted = (index.select("block", F.posexplode(F.arrays_zip(
        F.col("doc_id"), F.col("tag"), F.transform(F.slice("first", 2, F.greatest(F.size("first") - 1, F.lit(0))),
                                     lambda e, i: e - F.get("first", i)).alias("n"))).alias("ord", "d"))
        .select("block", "ord", F.col("d.doc_id").alias("doc_id"), F.col("d.tag").alias("tag"), F.col("d.n").cast("long").alias("n_words")))
    hits = (find_phrases(index, tests, window).groupBy("block", "ord")
            .agg(F.array_sort(F.collect_list(F.struct("start", "end", "item"))).alias("spans")))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    union = F.aggregate("spans", zero, lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["to"]))).alias("n"),
        F.greatest(a["to"], s["end"]).alias("to")), lambda a: a["n"])
    hits = hits.select("block", "ord", "spans", union.alias("n_hit"),
                       F.array_sort(F.array_distinct(F.col("spans.item"))).alias("items"))
    none = F.array().cast("array<string>")
    return (counted.join(hits, ["block", "ord"], "left")
            .select("doc_id", "tag", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce("items", none).alias("items"), "spans"))
