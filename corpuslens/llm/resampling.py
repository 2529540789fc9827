"""Importance resampling towards a target: hashed word runs found by an Aho-Corasick dictionary.

The different words of a block of texts, each bounded by a delimiter on both sides,
are the patterns of an automaton; a pattern's payload is the CRC-32 and the length of
its word. A scan emits the payloads in text order. The CRC of a run of words follows
from its parts without reading the text again: a CRC is moved over the bytes of the
next word by a linear map that depends on that word's length alone, and the next
word's CRC is added. A run's bucket is its CRC modulo ``buckets``.

Two counts, of the raw and of the target texts, give every bucket a gain; a document's
weight is the mean gain of its runs, and the highest weights plus Gumbel noise (from a
hash of the id) are a draw without replacement.

Memory follows the block (1 MB of text): a dictionary holds the words of one block,
a long text is read in parts cut between words. Only counts of ``buckets`` numbers reach
the driver.

Defined cases: a null or empty text has no words, no features and weight 0; a null
doc_id draws its noise from the empty id and comes after all others at equal scores;
repeated rows are documents of their own, in any order at equal score and id; an empty
table gives no rows; with an empty target all gains are those of the formula at 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import ALNUM, BLOCK, Scratch, narrow, text_blocks

#: Lower-cased word bytes; every other byte becomes a blank.
FOLDED = bytes((b + 32 if 65 <= b <= 90 else b) if ALNUM[b] else 32 for b in range(256))
#: Between documents; no word holds it.
MARK = b"\n"
_U4 = np.uint32
_BLANK = _U4(zlib.crc32(b" "))


def _moved(op: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by the images of the bits, on an array."""
    out = np.zeros(len(x), dtype=_U4)
    for bit in range(32):
        out ^= np.where((x >> _U4(bit)) & _U4(1), op[bit], _U4(0))
    return out


@lru_cache(maxsize=64)
def _doubled(power: int) -> np.ndarray:
    """The map that moves a CRC over 2**power zero bytes."""
    if power:
        half = _doubled(power - 1)
        return _moved(half, half)
    bits = _U4(1) << np.arange(32, dtype=_U4)
    # zlib inverts before and after; twice the same inversion leaves the linear part
    zero = zlib.crc32(b"\0", 0)
    return np.array([zlib.crc32(b"\0", int(b)) ^ zero for b in bits], dtype=_U4)


@lru_cache(maxsize=4096)
def move_table(length: int) -> np.ndarray:
    """4 x 256 images: moving a CRC over ``length`` bytes is four look-ups."""
    x = (np.arange(256, dtype=_U4)[None, :] << (_U4(8) * np.arange(4, dtype=_U4))[:, None]).ravel()
    for power in range(length.bit_length()):
        if length >> power & 1:
            x = _moved(_doubled(power), x)
    return x.reshape(4, 256)


def joined(left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs of the concatenations: ``right`` has the CRCs of the second parts, ``lengths`` their bytes."""
    kinds, at = np.unique(lengths, return_inverse=True)
    t = np.stack([move_table(int(n)) for n in kinds]) if len(kinds) else np.zeros((1, 4, 256), dtype=_U4)
    b = _U4(255)
    return t[at, 0, left & b] ^ t[at, 1, (left >> _U4(8)) & b] ^ t[at, 2, (left >> _U4(16)) & b] ^ t[at, 3, left >> _U4(24)] ^ right


class Dictionary:
    """Automaton over the different words of a block; ``scan`` emits payloads, -1 where a document ends."""

    def __init__(self, words: set[bytes]):
        known = list(words)
        self.crc = np.array([zlib.crc32(w) for w in known] or [0], dtype=_U4)
        self.length = np.array([len(w) for w in known] or [0], dtype=np.int64)
        self.auto = ahocorasick.Automaton()
        # one character a byte: the automaton never sees the encoding
        self.auto.add_word(MARK.decode("latin-1"), -1)
        for i, w in enumerate(known):
            self.auto.add_word(f" {w.decode('latin-1')} ", i)
        self.auto.make_automaton()

    def scan(self, text: str) -> np.ndarray:
        return np.fromiter((i for _, i in self.auto.iter(text)), dtype=np.int64)


def _parts(raw: bytes) -> Iterator[bytes]:
    """Pieces of about BLOCK bytes cut at blanks; together they hold all words."""
    at = 0
    while at < len(raw):
        to = len(raw) if len(raw) - at <= 2 * BLOCK else raw.find(b" ", at + BLOCK)
        to = len(raw) if to < 0 else to
        yield raw[at:to]
        at = to


def payloads(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, CRC, length) of every word in order, in parts that cover all documents.

    ``texts`` together are of about BLOCK bytes, or one long text."""
    folded = [t.translate(FOLDED) for t in texts]
    whole = (b" " + MARK + b" ").join(folded)
    at = 0
    for part in _parts(whole):
        known = Dictionary(set(part.replace(MARK, b"").split()))
        ids = known.scan(f" {part.decode('latin-1')} ")
        mark = ids < 0
        doc = at + np.cumsum(mark)
        at += int(mark.sum())
        word = ~mark
        yield doc[word], known.crc[ids[word]], known.length[ids[word]]


def run_buckets(texts: list[bytes], longest: int, buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words a document, and each document's buckets, one for every run of 1..``longest`` words."""
    n_words = np.zeros(len(texts), dtype=np.int64)
    docs, found = [], []
    keep = longest - 1
    carry = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=_U4), np.zeros(0, dtype=np.int64))
    for part in payloads(texts):
        n_words += np.bincount(part[0], minlength=len(texts))
        old = len(carry[0])
        doc, crc, length = (np.concatenate(x) for x in zip(carry, part))
        run = crc
        for k in range(longest):
            if k:
                run = joined(run[:-1], np.full(max(len(run) - 1, 0), _BLANK, dtype=_U4), np.ones(max(len(run) - 1, 0), dtype=np.int64))
                run = joined(run, crc[k:], length[k:])
            if not len(run):
                break
            # a run counts where it ends, so runs that end in the carried words are not counted again
            new = np.arange(k, len(crc)) >= old
            new &= doc[:len(run)] == doc[k:]
            docs.append(doc[k:][new])
            found.append(run[new] % _U4(buckets))
        carry = tuple(x[len(x) - min(keep, len(x)):] for x in (doc, crc, length))
    doc = np.concatenate(docs) if docs else np.zeros(0, dtype=np.int64)
    value = np.concatenate(found) if found else np.zeros(0, dtype=_U4)
    order = np.argsort(doc, kind="stable")
    cut = np.searchsorted(doc[order], np.arange(1, len(texts)))
    return n_words, np.split(value[order], cut)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = 2, buckets: int = 10_000) -> DataFrame:
    """Per row: doc_id, n_words, runs: the buckets of all its word runs as little-endian integers (2 bytes, 4 beyond 65 536 buckets)."""
    if longest < 1 or buckets < 1:
        raise ValueError("longest and buckets start at 1")
    kind = _kind(buckets)

    def work(batches):
        for batch in batches:
            for rows, raw, offs in text_blocks(batch):
                data = raw.tobytes()
                texts = [data[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
                n, runs = run_buckets(texts, longest, buckets)
                # sorted runs compress well, and no count depends on their order
                packed = [np.sort(r).astype(kind).tobytes() for r in runs]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n), pa.array(packed, type=pa.binary())], ["doc_id", "n_words", "runs"])

    return narrow(docs, id_col, text_col).mapInArrow(work, "doc_id long, n_words long, runs binary")


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _runs(batch: pa.RecordBatch, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a batch of rows, and the number of each row."""
    sizes, parts = [], []
    for v in batch.column("runs"):
        one = np.frombuffer(v.as_buffer(), dtype=kind)
        sizes.append(len(one))
        parts.append(one)
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=kind)), np.array(sizes, dtype=np.int64)


def bucket_counts(feats: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences of each bucket over all rows; tasks add up what they read first."""
    kind = _kind(buckets)

    def work(batches):
        have = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                have += np.bincount(_runs(batch.slice(k, 64), kind)[0], minlength=buckets)
        at = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(have[at])], ["bucket", "n"])

    sums = feats.select("runs").mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in sums.collect():  # at most one row a bucket
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of a bucket's share in the target to its share in the raw texts, one added to every count."""
    m = len(raw)
    s, t = raw.astype(float), target.astype(float)
    return np.floor(1000.0 * np.log((t + 1.0) * (s.sum() + m) / ((s + 1.0) * (t.sum() + m)))).astype(np.int64)


def weights(feats: DataFrame, gain: np.ndarray) -> DataFrame:
    """Per row: doc_id, n_words, n_features, weight (floored mean gain of its runs; 0 without runs)."""
    kind = _kind(len(gain))

    def work(batches):
        for batch in batches:
            total, size = [], []
            for k in range(0, batch.num_rows, 64):
                runs, n = _runs(batch.slice(k, 64), kind)
                upto = np.concatenate([[0], np.cumsum(gain[runs])])
                ends = np.cumsum(n)
                total.append(upto[ends] - upto[ends - n])
                size.append(n)
            if total:
                total, size = np.concatenate(total), np.concatenate(size)
                mean = np.where(size > 0, total // np.maximum(size, 1), 0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(size), pa.array(mean)],
                                                 ["doc_id", "n_words", "n_features", "weight"])

    return feats.mapInArrow(work, "doc_id long, n_words long, n_features long, weight long")


def with_noise(rated: DataFrame, seed: int) -> DataFrame:
    """Adds score: the weight plus Gumbel noise from the id's hash, in thousandths, floored."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return rated.withColumn("score", F.col("weight") + noise.cast("long"))


def numbered(df: DataFrame, order: list, scratch: Scratch, label: str, out: str) -> DataFrame:
    """Row numbers from 1 in a global order: sorted by ranges, written, and counted file by file.

    A file's rows are in order and so are the files, so a row's number is its place in
    its file plus the rows of the files before; only one count a file reaches the driver."""
    spark = df.sparkSession
    scratch.cut(df.orderBy(*order), label)
    kept = spark.read.schema(df.schema).parquet(scratch.path(label))
    placed = kept.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    before, starts = 0, []
    for r in sorted(placed.groupBy("_file").agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((r["_file"], before))
        before += r.n
    first = spark.createDataFrame(starts, "_file string, _before long")
    return placed.join(first, "_file").withColumn(out, F.col("_before") + F.col("_place") + 1).drop("_file", "_place", "_before")


def resample(docs: DataFrame, target: DataFrame, scratch: Scratch, percent: int = 25, min_words: int = 20, longest: int = 2,
             buckets: int = 10_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_features, weight, score, rank.

    ``rank`` counts the drawn rows from 1 by falling score, ties to the smaller id; it is
    null for the rest. Drawn are floor(percent * N / 100) of the N rows of at least
    ``min_words`` words.
    """
    feats = scratch.cut(features(docs, id_col, text_col, longest, buckets), "features")
    wanted = features(target.select(F.lit(None).cast("long").alias("doc_id"), target[target_text].alias("text")), "doc_id", "text", longest, buckets)
    gain = gains(bucket_counts(feats, buckets), bucket_counts(wanted, buckets))
    rated = scratch.cut(with_noise(weights(feats, gain), seed).withColumn("row", F.monotonically_increasing_id()), "rated")
    scratch.drop("features")
    able = rated.filter(F.col("n_words") >= min_words)
    drawn = percent * able.count() // 100
    # the row number splits ranges of equal score and id
    ranked = numbered(able, [F.desc("score"), F.asc_nulls_last("doc_id"), "row"], scratch, "order", "rank")
    cols = ["doc_id", "n_words", "n_features", "weight", "score"]
    return (ranked.select(*cols, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
            .unionByName(rated.filter(F.col("n_words") < min_words).select(*cols, F.lit(None).cast("long").alias("rank"))))
