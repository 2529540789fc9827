"""Importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpuslens.llm.common import Scratch
from corpuslens.llm.resampling import joined, resample, run_buckets

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def runs_of(text, longest=2):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def bucket(s, m=10_000):
    return zlib.crc32(s.encode()) % m


def brute(docs, target, percent=25, least=20):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, runs_of(x)[1]))
    for x in target:
        t.update(map(bucket, runs_of(x)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    out = []
    for i, x in docs:
        n, f = runs_of(x)
        w = sum(gain(bucket(r)) for r in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def prose(rng, n):
    return " ".join(rng.choice(["The", "quick", "brown-fox", "Über", "naïve", "日本", "x1y2", "of", "and;to"]) + str(rng.randrange(30)) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(11)
    out = [(1, None), (2, ""), (3, " .,\n\t"), (4, "one"), (5, "One TWO"), (6, "a" * 5000 + " b"), (7, "\x01x\x7fy z\x85"), (8, prose(rng, 400_000)),
           (9, "same words again " * 12), (9, "same words again " * 12), (None, prose(rng, 40)), (None, prose(rng, 5)), (10, "new\nline\nmarks " * 9)]
    return out + [(100 + k, prose(rng, rng.randrange(1, 90))) for k in range(60)]


def test_resample(spark, docs):
    rng = random.Random(12)
    target = [prose(rng, 30) for _ in range(9)] + [None, "the quick1 of2"]
    d = spark.createDataFrame([(i, x, "en", 5, 1, 2) for i, x in docs], "doc_id long, text string, lang string, rank int, runs int, row int").repartition(3)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = resample(d, t, Scratch(spark, "t")).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, target)
    none = resample(d, t.limit(0), Scratch(spark, "t")).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, none), key=str) == brute(docs, [])
    assert resample(d.limit(0), t, Scratch(spark, "t")).count() == 0


def test_ties(spark):
    """Equal rows share score and id: ranks stay 1..k, one each."""
    d = spark.createDataFrame([(5, "word " * 25)] * 40 + [(None, "word " * 30)] * 40, "doc_id long, text string").repartition(4)
    r = resample(d, d.select("text"), Scratch(spark, "t"), percent=50)
    got = [x["rank"] for x in r.select("rank").collect() if x["rank"] is not None]
    assert sorted(got) == list(range(1, 41))
    assert {x.doc_id for x in r.filter("rank is not null").select("doc_id").collect()} in ({5}, {None})


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_runs(longest):
    """Runs composed from payloads have the CRC of their bytes, across parts of a long text too."""
    rng = random.Random(longest)
    texts = [prose(rng, n) for n in (0, 1, 2, 3, 50)] + ["", "é", "end "]
    for group in (texts, [prose(rng, 400_000)]):
        n, got = run_buckets([t.encode() for t in group], longest, 50_000)
        want = [runs_of(t, longest) for t in group]
        assert n.tolist() == [w[0] for w in want]
        assert [sorted(g.tolist()) for g in got] == [sorted(bucket(s, 50_000) for s in w[1]) for w in want]


def test_joined():
    rng = random.Random(1)
    pairs = [(rng.randbytes(rng.randrange(9)), rng.randbytes(rng.choice([0, 1, 2, 7, 300, 70_000]))) for _ in range(200)]
    a, b = (np.array([zlib.crc32(p[k]) for p in pairs], dtype=np.uint32) for k in (0, 1))
    assert joined(a, b, np.array([len(y) for _, y in pairs])).tolist() == [zlib.crc32(x + y) for x, y in pairs]
