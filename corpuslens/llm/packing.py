"""Best-fit packing of tokenised documents by the linear grouping scheme.

1. Documents are encoded once, where they lie; only lengths and checksums move.
2. Lengths are counted (at most one row per length up to the capacity). Large
   lengths are cut into groups of about equal cardinality, at whole lengths, and
   every member is rounded up to its group's largest.
3. For these few sizes, the numbers of bins of each configuration come from the
   linear program over configurations, solved by generating columns; whole parts
   are used.
4. Actual documents take the places of their size: numbered within the group,
   the j-th document takes the j-th place, found by arithmetic.
5. The space that rounding and configurations leave is filled best-fit with all
   other pieces, longest first, in shards of bounded size.

Defined cases: a null or empty text is its final id alone; a null doc_id stays
null; repeated rows are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.llm.common import Scratch, narrow, text_blocks

CAPACITY = 4096
END_ID = 1
#: Lengths over CAPACITY / LARGE are large; they form about GROUPS groups.
LARGE = 4
GROUPS = 16
#: Pieces in a shard, about.
SHARD = 100_000
#: Remembered chunks of text per worker; when full, it starts anew.
CACHE = 400_000
SEP = "\x01"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabularies of byte-level tokenizers: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ChunkEncoder:
    """Token ids of a text as bytes (little-endian unsigned 32 bits).

    The tokenizer drops white space and never joins over it, so a text's ids are
    those of its space-separated chunks in order; each distinct chunk is encoded
    once and remembered. Chunks of plain letters, digits and signs are taken apart
    as the tokenizer's own rule does, and their distinct words merged by rank with
    a word's last byte marked as such. All other chunks go to the tokenizer itself,
    many at a time, apart by a control character that makes a token of its own.
    """

    PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
    WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

    def __init__(self, path: str):
        import json
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        sep = self.tok.encode(SEP, add_special_tokens=False).ids
        self.sep = sep[0] if len(sep) == 1 else None
        letters, ranks = _byte_letters(), {}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # only what a merge makes is ever made; ids must ascend with the merges to serve as ranks
        made = [a + b for a, b in merges]
        numbers = [vocab[m] for m in made]
        single = [*letters, *(c + "</w>" for c in letters)]
        if numbers != sorted(numbers) or len(set(made)) != len(made) or max(vocab[t] for t in single) > numbers[0]:
            raise ValueError("the vocabulary's ids are not in the order of its merges")
        for token, number in [*((t, vocab[t]) for t in single), *zip(made, numbers)]:
            last = token.endswith("</w>")
            raw = bytes(letters[c] for c in (token[:-4] if last else token))
            ranks[self._marked(raw.decode("latin-1"), last)] = number
        self.merge = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.known: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}

    @staticmethod
    def _marked(latin: str, last: bool) -> bytes:
        """Two bytes a symbol: the byte, and whether it ends a word."""
        raw = latin.encode("utf-16-le")
        return raw[:-1] + b"\x01" if last else raw

    def _plain(self, s: str) -> bytes:
        return np.array(self.tok.encode(s, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, w: str) -> bytes:
        raw = w if w.isascii() else w.encode().decode("latin-1")
        return array("I", self.merge(raw.encode("utf-16-le")[:-1] + b"\x01")).tobytes()

    def learn(self, chunks: set[str]) -> None:
        if len(self.known) > CACHE:
            self.known = {"": b""}
        if len(self.words) > CACHE:
            self.words = {}
        known, words = self.known, self.words
        rest = []
        for c in chunks.difference(known):
            if c.isascii() and c.isalpha():
                w = c.lower()
                ids = words.get(w)
                if ids is None:
                    ids = words[w] = self._word(w)
                known[c] = ids
            elif self.PLAIN.fullmatch(c) and "<|" not in c:
                out = []
                for w in self.WORDS.findall(c.lower()):
                    ids = words.get(w)
                    if ids is None:
                        ids = words[w] = self._word(w)
                    out.append(ids)
                known[c] = b"".join(out)
            elif SEP in c or self.sep is None:
                known[c] = self._plain(c)
            else:
                rest.append(c)
        for a in range(0, len(rest), 2000):
            part = rest[a:a + 2000]
            ids = np.array(self.tok.encode_batch_fast([f" {SEP} ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.sep)
            if len(cuts) != len(part) - 1:  # never seen; be exact all the same
                for c in part:
                    known[c] = self._plain(c)
                continue
            raw, lo = ids.tobytes(), [0, *((cuts + 1) * 4).tolist()]
            hi = [*(cuts * 4).tolist(), len(raw)]
            for c, x, y in zip(part, lo, hi):
                known[c] = raw[x:y]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        self.learn(set().union(*split) if split else set())
        get = self.known.__getitem__
        return [b"".join(map(get, s)) for s in split]


#: One encoder for all tasks of a worker.
_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of at most ``capacity`` ids."""
    end = np.array([END_ID], dtype="<u4").tobytes()
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            for rows, _, _ in text_blocks(batch):
                ids = rows.column("doc_id").to_pylist()
                texts = [t or "" for t in rows.column("text").to_pylist()]
                out = []
                for doc, raw in zip(ids, enc.encode(texts)):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), step)):
                        part = raw[at:at + step]
                        out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32())] + [pa.array(c, pa.int64()) for c in cols[2:]],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return narrow(docs).mapInArrow(run, PIECES)


def group_sizes(lengths: np.ndarray, counts: np.ndarray, groups: int) -> np.ndarray:
    """For each length (ascending) the size it is rounded up to: the largest of its group."""
    target = counts.sum() / groups
    upto = np.cumsum(counts[::-1])  # groups are formed from the longest down
    label = ((upto - counts[::-1]) / target).astype(np.int64)
    top = {}
    for g, s in zip(label.tolist(), lengths[::-1].tolist()):
        top.setdefault(g, s)
    return np.array([top[g] for g in label.tolist()])[::-1]


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """(configs, bins): rows of item counts per size, and how many bins use each (real numbers).

    Revised simplex; a column enters if the knapsack over the dual prices finds a
    configuration worth more than one bin.
    """
    g = len(sizes)
    basis = np.diag(np.maximum(1, capacity // sizes)).astype(float)
    x = demand / np.diag(basis)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(g))
        best = np.zeros(capacity + 1)
        pick = np.full(capacity + 1, -1)
        for c in range(1, capacity + 1):
            best[c], pick[c] = best[c - 1], -1
            fit = np.flatnonzero(sizes <= c)
            if len(fit):
                v = best[c - sizes[fit]] + price[fit]
                k = int(v.argmax())
                if v[k] > best[c] + 1e-12:
                    best[c], pick[c] = v[k], fit[k]
        if best[capacity] <= 1 + 1e-7:
            break
        col, c = np.zeros(g), capacity
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                col[pick[c]] += 1
                c -= sizes[pick[c]]
        d = np.linalg.solve(basis, col)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        t = ratio[out]
        x = x - t * d
        x[out] = t
        basis[:, out] = col
        x = np.maximum(x, 0)
    return basis.T.astype(np.int64), x


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS):
    """Places for the large lengths.

    Returns ``size_of`` {length: group} and ``places`` rows (group, lo, hi, bin, per):
    documents lo..hi-1 of the group go to bins bin, bin + 1, ..., ``per`` to each;
    and the number of bins.
    """
    big = lengths > capacity / LARGE
    lengths, counts = lengths[big], counts[big]
    if not len(lengths):
        return {}, [], 0
    rounded = group_sizes(lengths, counts, groups)
    sizes, group = np.unique(rounded, return_inverse=True)
    demand = np.bincount(group, weights=counts).astype(float)
    configs, x = configurations(sizes, demand, capacity)
    taken = np.zeros(len(sizes), dtype=np.int64)
    places, at = [], 0
    for row, n in zip(configs, np.floor(x + 1e-9).astype(np.int64)):
        if n > 0:
            for k in np.flatnonzero(row):
                places.append((int(k), int(taken[k]), int(taken[k] + n * row[k]), at, int(row[k])))
                taken[k] += n * row[k]
            at += int(n)
    return dict(zip(lengths.tolist(), group.tolist())), places, at


def best_fit(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each length (taken longest first) into bins with the given free space; new bins follow the old."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, room in enumerate(bins.tolist()):
        free[room].append(b)
        mask |= 1 << room
    out = np.empty(len(lengths), dtype=np.int64)
    n = len(bins)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        m = mask >> need
        if m:
            room = need + (m & -m).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            room, b, n = capacity, n, n + 1
        out[i] = b
        rest = room - need
        free[rest].append(b)
        mask |= 1 << rest
    return out


def pack(docs: DataFrame, tokenizer_path: str, scratch: Scratch, capacity: int = CAPACITY,
         groups: int = GROUPS, shard: int = SHARD) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    spark = docs.sparkSession
    p = scratch.cut(pieces(docs, tokenizer_path, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    hist = p.groupBy("length").count().orderBy("length").collect()  # at most one row per length
    lengths = np.array([r[0] for r in hist], dtype=np.int64)
    counts = np.array([r[1] for r in hist], dtype=np.int64)
    size_of, places, _ = plan(lengths, counts, capacity, groups)
    shards = max(1, -(-int(counts.sum()) // shard)) if len(counts) else 1
    sized = spark.createDataFrame(list(size_of.items()) or [(-1, -1)], "length long, grp int")
    spots = spark.createDataFrame(places or [(-1, 0, 0, 0, 1)], "grp int, lo long, hi long, first_bin long, per long")
    # numbers within a group: a slice is numbered by itself, after the slices before it;
    # slices go by stored row numbers, so ids that many rows share fill none
    slices = 8 * shards
    s = (p.join(F.broadcast(sized), "length", "left")
         .withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int")))
    before = (s.filter("grp is not null").groupBy("grp", "slice").count()
              .withColumn("before", F.sum("count").over(Window.partitionBy("grp").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
              .select("grp", "slice", F.coalesce("before", F.lit(0).cast("long")).alias("before")))
    own = Window.partitionBy("grp", "slice").orderBy("doc_id", "piece", "length", "ids_crc32")
    large = (s.filter("grp is not null").withColumn("own", F.row_number().over(own) - 1)
             .join(before, ["grp", "slice"]).withColumn("j", F.col("before") + F.col("own")))
    spot = F.broadcast(spots.withColumnRenamed("grp", "g"))
    large = (large.join(spot, (F.col("grp") == F.col("g")) & (F.col("j") >= F.col("lo")) & (F.col("j") < F.col("hi")), "left")
             .withColumn("bin", F.col("first_bin") + F.floor((F.col("j") - F.col("lo")) / F.col("per")).cast("long")))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "slice", "bin"]
    every = large.select(cols).unionByName(s.filter("grp is null").withColumn("bin", F.lit(None).cast("long")).select(cols))
    every = every.withColumn("shard", F.pmod(F.coalesce("bin", F.col("slice").cast("long")), F.lit(shards)).cast("int")).drop("slice")

    def fill(key, t):
        t = t.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        n = t["length"].to_numpy()
        bins = t["bin"].to_numpy(dtype="float64", na_value=np.nan)
        placed = ~np.isnan(bins)
        old, where = np.unique(bins[placed], return_inverse=True)
        used = np.bincount(where, weights=n[placed], minlength=len(old)).astype(np.int64)
        at = np.empty(len(t), dtype=np.int64)
        at[placed] = where
        at[~placed] = best_fit(capacity - used, n[~placed], capacity)
        order = np.argsort(at, kind="stable")
        ends = np.cumsum(n[order])
        first = np.concatenate([[True], at[order][1:] != at[order][:-1]]) if len(order) else np.zeros(0, bool)
        base = (ends - n[order])[first][np.cumsum(first) - 1]
        offset = np.empty(len(t), dtype=np.int64)
        offset[order] = ends - n[order] - base
        t["sequence_id"] = at * shards + int(key[0])
        t["offset"] = offset
        return t[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return every.groupBy("shard").applyInPandas(fill, PIECES + ", sequence_id long, offset long")
