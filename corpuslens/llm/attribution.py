"""Token counts by section from one encoding of the whole document.

A document is encoded once; the tokens' byte lengths give their spans, and the
spans are merge-joined with the sections' (both in order, so one bisection per
token edge). A token that lies over a boundary belongs to the section that holds
its first byte (rule "start"), its last byte ("end"), or is split by bytes
("share"). Whichever rule, a document's sections add up to its tokens.

Sections are fields given in order, or the paragraphs and lines of a text.

Defined cases: a null or empty text has no section and no token; blank lines
belong to the section before them; a null doc_id stays null; repeated rows are
counted each; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpuslens.llm.common import narrow, text_blocks

RULES = ("start", "end", "share")
_open: dict[tuple, tuple] = {}


def tokenizer(path: str, pattern: str):
    """The encoder of a rank file and the byte length of each id; opened once in a worker."""
    if (path, pattern) not in _open:
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for raw, n in ranks.items():
            length[n] = len(raw)
        _open[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), length
    return _open[path, pattern]


def line_sections(raw: np.ndarray) -> np.ndarray:
    """Where the lines of a text begin (byte offsets); a line that holds white space only joins the one before."""
    if not len(raw):
        return np.zeros(0, dtype=np.int64)
    begin = np.concatenate([[0], np.flatnonzero(raw[:-1] == 10) + 1])
    solid = np.concatenate([[0], np.cumsum(~np.isin(raw, np.frombuffer(b" \t\n\r\x0b\x0c", dtype=np.uint8)))])
    end = np.append(begin[1:], len(raw))
    keep = solid[end] > solid[begin]
    keep[0] = True
    return begin[keep]


def allocate(ends: np.ndarray, begins: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section. ``ends``: ascending byte ends of tokens that lie gapless from 0; ``begins``: of sections, the first 0."""
    n = len(begins)
    starts = np.concatenate([[0], ends[:-1]])
    if rule == "start":
        return np.bincount(np.searchsorted(begins, starts, side="right") - 1, minlength=n).astype(float)
    if rule == "end":
        return np.bincount(np.searchsorted(begins, ends - 1, side="right") - 1, minlength=n).astype(float)
    # tokens up to a byte, interpolated inside a token; differences give the sections
    at = np.interp(np.append(begins, ends[-1]), np.concatenate([[0], ends]), np.arange(len(ends) + 1))
    return np.diff(at)


def section_tokens(docs: DataFrame, path: str, pattern: str, rule: str = "start") -> DataFrame:
    """Per line of each document: doc_id, section (from 0), start and end (code points), n_tokens (double).

    One row per section of each row of ``docs`` (doc_id, text).
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, length = tokenizer(path, pattern)
        for batch in batches:
            for rows, buf, offs in text_blocks(batch):
                out = [[], [], [], [], []]
                ids = rows.column("doc_id").to_pylist()
                for k, text in enumerate(rows.column("text").to_pylist()):
                    if not text:
                        continue
                    raw = buf[offs[k]:offs[k + 1]]
                    begins = line_sections(raw)
                    counts = allocate(np.cumsum(length[np.array(enc.encode_ordinary(text))]), begins, rule)
                    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    out[0] += [ids[k]] * len(begins)
                    out[1].append(np.arange(len(begins)))
                    out[2].append(chars[begins])
                    out[3].append(chars[np.append(begins[1:], len(raw))])
                    out[4].append(counts)
                if out[0]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[0], pa.int64()), pa.array(np.concatenate(out[1]).astype(np.int32)),
                         *(pa.array(np.concatenate(x).astype(np.int64)) for x in out[2:4]), pa.array(np.concatenate(out[4]))],
                        ["doc_id", "section", "start", "end", "n_tokens"])

    return narrow(docs).mapInArrow(run, "doc_id long, section int, start long, end long, n_tokens double")
