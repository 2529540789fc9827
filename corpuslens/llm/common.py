"""Shared pieces: scratch tables, document keys, words of a batch of texts as hash arrays.

Words are found on UTF-8 bytes with numpy, many documents at a time, so no
Python code runs per word. A word's identity is a 64-bit polynomial hash of its
lower-cased (A-Z only) bytes.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.session import ensure_checkpoint_dir

#: Bytes of text that are tokenised at a time; results do not depend on it.
BLOCK = 1 << 20
#: Rows of an Arrow batch at most, so that a batch of long texts stays small.
ARROW_ROWS = 1000

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 2**64, 256, dtype=_U) | _U(1)
_R = _U(0x9E3779B97F4A7C15)
_RINV = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWERED = _BYTE[_LOWER]
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 4096)
        out = np.full(size, base, dtype=_U)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if size <= 4 * BLOCK:
            _powers[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finish that spreads all bits."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def prefix_hash(buf: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """Running sums from which ``span_hash`` reads the hash of any span."""
    out = np.empty(len(buf) + 1, dtype=_U)
    out[0] = 0
    np.cumsum(table[buf] * _power("r", _R, len(buf)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes start..end-1 of each span (the length is part of it)."""
    inv = _power("inv", _RINV, len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(_U))


def byte_class(*parts: tuple[int, int]) -> np.ndarray:
    """A 256-entry table, true for bytes in the given ranges (both ends included)."""
    out = np.zeros(256, dtype=bool)
    for a, b in parts:
        out[a:b + 1] = True
    return out


#: Bytes of words split at ASCII white space, and of words of letters and digits.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
ALNUM = ~byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)) | byte_class((65, 90))


def _words_once(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    n = len(buf)
    w = inside[buf]
    first = np.empty(n + 1, dtype=bool)
    first[1:n] = ~w[:-1]
    first[0] = True
    first[n] = True
    first[offsets] = True
    starts = np.flatnonzero(w & first[:n])
    stop = ~w
    after = np.empty(n, dtype=bool)
    after[:n - 1] = stop[1:]
    after[n - 1] = True
    cut = offsets[(offsets > 0) & (offsets <= n)] - 1
    after[cut] = True
    ends = np.flatnonzero(w & after) + 1
    return starts, ends


def words_of(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_SPACE):
    """Words of the documents buf[offsets[i]:offsets[i+1]].

    Returns (start, end, hash, first): byte spans, 64-bit hashes of the
    lower-cased words, and for each document the index of its first word
    (one entry more than documents). A long document is worked on in parts cut
    between words, so memory follows BLOCK and not the document.
    """
    n = len(buf)
    if n <= 2 * BLOCK or len(offsets) != 2:
        if not n:
            e = np.zeros(0, dtype=np.int64)
            return e, e, np.zeros(0, dtype=_U), np.zeros(len(offsets), dtype=np.int64)
        s, e = _words_once(buf, offsets, inside)
        return s, e, span_hash(prefix_hash(buf, _LOWERED), s, e), np.searchsorted(s, offsets)
    parts, at = [], 0
    while at < n:
        to = min(n, at + BLOCK)
        while to < n and inside[buf[to - 1]] and inside[buf[to]]:
            gap = np.flatnonzero(~inside[buf[to:to + BLOCK]])
            to = to + int(gap[0]) if len(gap) else min(n, to + BLOCK)
        s, e, h, _ = words_of_block(buf[at:to], inside)
        parts.append((s + at, e + at, h))
        at = to
    s, e, h = (np.concatenate(x) for x in zip(*parts))
    return s, e, h, np.array([0, len(s)])


def words_of_block(buf: np.ndarray, inside: np.ndarray):
    s, e = _words_once(buf, np.array([0, len(buf)]), inside)
    return s, e, span_hash(prefix_hash(buf, _LOWERED), s, e), None


def run_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive values (len(h) - width + 1 of them)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    out = np.zeros(n, dtype=_U)
    for i in range(width):
        out *= _R
        out += h[i:i + n]
    return mix(out)


def text_blocks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about BLOCK bytes of text: (rows, bytes, offsets). Null is empty."""
    col = batch.column(column)
    if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
        col = col.cast(pa.large_binary() if pa.types.is_binary(col.type) else pa.large_string())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_large_string(col.type) else b"")
    if not len(col):
        return
    _, off, data = col.buffers()
    offs = np.frombuffer(off, dtype=np.int64, count=len(col) + 1, offset=8 * col.offset)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + BLOCK, side="right")) - 1)
        to = min(to, len(col))
        yield batch.slice(at, to - at), raw[offs[at]:offs[to]], offs[at:to + 1] - offs[at]
        at = to


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names, so that no other column can clash."""
    limit_arrow(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def limit_arrow(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def text_tag(text: Column) -> Column:
    """128 bits of the text (binary); with doc_id it tells rows apart that share an id, however many these are."""
    t = F.coalesce(text, F.lit(""))
    return F.unhex(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(t), F.xxhash64(F.lit(1), t))]))


def id_key(col: Column) -> Column:
    """doc_id for joins: null is one id of its own, the smallest long."""
    return F.coalesce(col, F.lit(-(2**63)))


def hold_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text leaves ``remainder``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus) == remainder


class Scratch:
    """Tables under the shared checkpoint folder; what is left goes when Python ends."""

    def __init__(self, spark: SparkSession, name: str):
        ensure_checkpoint_dir(spark)
        # tables are written and read again, so no later query can use a query's shuffle files: they go when it ends
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
        self.spark = spark
        self.base = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self.labels: set[str] = set()
        atexit.register(self._quietly)

    def path(self, label: str) -> str:
        return f"{self.base}/{label}"

    def cut(self, df: DataFrame, label: str) -> DataFrame:
        """Write and read back: lineage ends here, and a lost executor costs no earlier work."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(label))
        self.labels.add(label)
        return self.spark.read.schema(df.schema).parquet(self.path(label))

    def keep(self, *labels: str) -> None:
        """Drop all tables but these."""
        for label in list(self.labels):
            if label not in labels:
                self.drop(label)

    def drop_all(self, *starts: str) -> None:
        """Drop the tables whose labels start so."""
        for label in list(self.labels):
            if label.startswith(starts):
                self.drop(label)

    def feeds(self, df: DataFrame) -> bool:
        """Whether ``df`` reads a table of this folder."""
        folder = self.base.rsplit("/", 1)[-1]
        return any(f"/{folder}/" in f for f in df.inputFiles())

    def drop(self, label: str = "") -> None:
        self.labels.discard(label)
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(self.path(label) if label else self.base)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)

    def _quietly(self) -> None:
        try:
            self.drop()
        except Exception:
            pass


def is_small(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has at most ``rows`` rows; reads no more than that many and one."""
    return df.limit(rows + 1).count() <= rows
