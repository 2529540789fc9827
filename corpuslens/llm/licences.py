"""Licence notices by Dice coefficient over word bigrams.

Lines and paragraphs (runs of lines without a blank one) are reduced to words of
letters and digits, lower case; their sets of word bigrams are compared with
those of the templates. A Dice coefficient of t needs at least t / (2 - t) and
at most (2 - t) / t times a template's bigrams, and t / 2 of both sizes in
common, so nearly all segments are left out by counting alone.

Defined cases: a null or empty text has no segment; a segment of one word has no
bigram and matches nothing; of equally good templates the first by name counts;
a null doc_id stays null; repeated rows are scanned each; empty tables give no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpuslens.llm.common import ALNUM, narrow, run_hash, text_blocks, words_of

THRESHOLD = 0.8

#: Notices as they are printed in files and pages.
TEMPLATES = {
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                         "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                           "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
                           "See the License for the specific language governing permissions and limitations under the License.",
    "bsd-3-clause": "Released under the 3-Clause BSD License.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                  "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Released under the ISC License.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                 "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
                 "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
                 "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def bigrams(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return np.unique(run_hash(words_of(raw, np.array([0, len(raw)]), ALNUM)[2], 2))


class Index:
    """Templates' bigrams: one sorted array to look a bigram up, and each template's own."""

    def __init__(self, templates: dict[str, str], threshold: float):
        self.names = sorted(templates)
        self.sets = [bigrams(templates[n]) for n in self.names]
        self.any = np.unique(np.concatenate([*self.sets, np.zeros(0, np.uint64)]))
        sizes = [len(s) for s in self.sets if len(s)]
        t = self.threshold = threshold
        self.low = min(sizes, default=1) * t / (2 - t)
        self.high = max(sizes, default=0) * (2 - t) / t
        self.least = t / 2 * (min(sizes, default=1) + self.low)

    def best(self, grams: np.ndarray) -> tuple[str, float] | None:
        found = None
        for name, s in zip(self.names, self.sets):
            small, large = sorted((len(s), len(grams)))
            if not small or 2 * small < self.threshold * (small + large):
                continue
            dice = 2 * len(np.intersect1d(s, grams, assume_unique=True)) / (small + large)
            if dice >= self.threshold and (found is None or dice > found[1]):
                found = (name, dice)
        return found


def _segments(buf: np.ndarray, s: np.ndarray, first: np.ndarray):
    """Word ranges (from, to, kind): lines (0) and paragraphs of several lines (1), cut at documents too."""
    ends = np.flatnonzero(buf == 10)
    line = np.searchsorted(ends, s)
    doc = np.searchsorted(first, np.arange(len(s)), side="right") - 1
    new = np.ones(len(s), dtype=bool)
    new[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    lines = np.stack([begin, np.append(begin[1:], len(s)), np.zeros(len(begin), dtype=np.int64)], axis=1)
    gap = np.ones(len(s), dtype=bool)
    gap[1:] = (line[1:] > line[:-1] + 1) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(gap)
    part = np.stack([begin, np.append(begin[1:], len(s)), np.ones(len(begin), dtype=np.int64)], axis=1)
    several = np.searchsorted(lines[:, 0], part[:, 1]) - np.searchsorted(lines[:, 0], part[:, 0]) > 1
    return np.concatenate([lines, part[several]])


def licence_notices(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Matches: doc_id, kind (line or paragraph), start and end (code points), licence, dice.

    ``templates`` (name, text) travel with the tasks: they are a fixed list, not data.
    """
    index = Index(TEMPLATES if templates is None else templates, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offs in text_blocks(batch):
                s, e, h, first = words_of(buf, offs, ALNUM)
                if len(h) < 2 or not len(index.any):
                    continue
                grams = run_hash(h, 2)
                at = np.minimum(np.searchsorted(index.any, grams), len(index.any) - 1)
                hits = np.concatenate([[0], np.cumsum(index.any[at] == grams)])
                seg = _segments(buf, s, first)
                n = seg[:, 1] - seg[:, 0] - 1
                seg = seg[(n > 0) & (n >= index.low)]
                # repeated bigrams make a segment's set smaller, so only common ones bound it from above
                common = hits[seg[:, 1] - 1] - hits[seg[:, 0]]
                out = []
                ids = rows.column("doc_id").to_pylist()
                for a, b, kind in seg[common >= index.least].tolist():
                    own = np.unique(grams[a:b - 1])
                    hit = index.best(own) if len(own) <= index.high else None
                    if hit:
                        k = int(np.searchsorted(offs, s[a], side="right")) - 1
                        raw = buf[offs[k]:e[b - 1]]
                        x = int(((raw[:s[a] - offs[k]] & 0xC0) != 0x80).sum())
                        y = int(((raw & 0xC0) != 0x80).sum())
                        out.append((ids[k], "paragraph" if kind else "line", x, y, hit[0], hit[1]))
                if out:
                    c = list(zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[0], pa.int64()), pa.array(c[1]), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()),
                         pa.array(c[4]), pa.array(c[5], pa.float64())], ["doc_id", "kind", "start", "end", "licence", "dice"])

    return narrow(docs).mapInArrow(run, "doc_id long, kind string, start long, end long, licence string, dice double")
