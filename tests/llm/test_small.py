"""Operators against brute force on small fixtures with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm.common import Scratch

SPACED = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def prose(rng, n):
    return " ".join(rng.choice(["Alpha", "beta", "gamma,", "delta.", "épsilon", "zeta", "eta", "theta", "iota", "kappa"])
                    + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = prose(rng, 120)
    shared = prose(rng, 60)
    words = base.split(" ")
    out = [(1, base), (2, base), (2, base), (3, base + " tail"), (4, " ".join(words[:60] + ["odd"] + words[61:])),
           (5, None), (6, ""), (7, " \n\t "), (8, "one two"), (9, "One  TWO"), (10, "ab " * 400), (11, "x" * 5000),
           (None, base), (None, "only this"), (12, prose(rng, 30) + "\n" + shared + "\n" + prose(rng, 40)),
           (13, prose(rng, 200) + " " + shared), (14, shared.upper()), (15, "é" * 300 + " " + "é" * 300), (16, prose(rng, 30000)),
           (17, "Write to a.b@c.example.org or +1 (555) 010-9999; 10.0.0.256 10.0.0.25 4111 1111 1111 1111")]
    out += [(20 + k, prose(rng, rng.randrange(1, 60))) for k in range(20)]
    return out


SCHEMA = "name int, doc_id long, text string, lang string, source string, n_chars long, tag string, doc_key string, q int"


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(1, i, t, "en" if (i or 0) % 3 else None, "s", len(t or ""), "x", "y", 3) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    key = lambda r: [str(x) for x in r]
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


@pytest.mark.parametrize("group", [50_000, 1])
def test_repeats(spark, docs, empty, rows, group):
    from corpuslens.llm.repeats import removed
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k:k + 200] for _, b in raw for k in range(len(b) - 199))
    want = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k:k + 200]] > 1:
                gone[k:k + 200] = b"\1" * 200
        want.append((i, len(b), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    got = removed(docs, Scratch(spark, "t"), keep_first=False, group=group)
    same(got.select("doc_id", "n_bytes", F.sha2("kept", 256)).collect(), want)
    assert removed(empty, Scratch(spark, "t")).count() == 0


def test_repeats_keep_first(spark):
    from corpuslens.llm.repeats import removed
    rng = random.Random(1)
    part, a, b = prose(rng, 40), prose(rng, 20), prose(rng, 20)
    d = spark.createDataFrame([(1, a + " @ " + part), (2, part), (3, b)], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept).decode() for r in removed(d, Scratch(spark, "t")).collect()}
    assert got == {1: a + " @ " + part, 2: "", 3: b}


def test_longest_previous_factor():
    from corpuslens.llm.repeats import previous_factors, suffix_order
    rng = random.Random(2)
    text = np.array([rng.choice(b"ab") for _ in range(600)], dtype=np.uint8)
    starts = np.arange(len(text) - 11)
    sa, lcp = suffix_order(text, starts, 12)
    got = previous_factors(sa, lcp, starts, 4)
    raw = text.tobytes()
    for i in starts.tolist():
        best = max((next((k for k in range(12) if raw[i + k] != raw[j + k]), 12) for j in range(i)), default=0)
        assert got[i] == (best if best >= 4 else 0)


def sets_of(rows):
    out = []
    for i, t in rows:
        w = SPACED.findall((t or "").translate(LOWER))
        out.append((i, frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def brute_components(rows):
    s = sets_of(rows)
    up = list(range(len(s)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in range(len(s)):
        for b in range(a):
            n = len(s[a][1] & s[b][1])
            if n and 100 * n >= 75 * len(s[a][1] | s[b][1]):
                up[find(a)] = find(b)
    low = {}
    for k, (i, x) in enumerate(s):
        if x and i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return [(i, len(x), low.get(find(k)) if x else i) for k, (i, x) in enumerate(s)]


def test_near(spark, docs, empty, rows):
    from corpuslens.llm.near import near_duplicates
    got = near_duplicates(docs, Scratch(spark, "t"))
    same(got.select("doc_id", "n_shingles", "component_id").collect(), brute_components(rows))
    assert near_duplicates(empty, Scratch(spark, "t")).count() == 0


def test_near_crowded(spark, monkeypatch):
    """Long lists at every depth: one passage in all texts, a family of copies with small edits."""
    from corpuslens.llm import near
    monkeypatch.setattr(near, "SMALL", 2)
    rng = random.Random(9)
    shared, text = prose(rng, 40).split(" "), prose(rng, 90).split(" ")
    rows = [(k, " ".join(shared + prose(rng, rng.randrange(6, 12)).split(" "))) for k in range(25)]
    for k in range(40):
        w = list(text)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        rows.append((100 + k, " ".join(w)))
    rows += [(200 + k, "same seven words stand before the " + f"end{k}") for k in range(12)] + [(300, "same seven words stand before the")]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"))
    same(got.select("doc_id", "n_shingles", "component_id").collect(), brute_components(rows))


@pytest.mark.parametrize("n", [60, 240])
def test_near_shared_boilerplate(spark, monkeypatch, n):
    """Texts that share half of their words without being linked: candidates grow with the texts, not with their pairs."""
    from corpuslens.llm import near
    sent, add = [], near._Linker.add

    def counted(self, pairs):
        pairs = self.scratch.cut(pairs, f"seen-{len(sent)}")
        sent.append(pairs.count())
        return add(self, pairs)

    monkeypatch.setattr(near._Linker, "add", counted)
    rng = random.Random(5)
    shared = prose(rng, 300)
    rows = [(k, shared + " " + " ".join(f"own{rng.randrange(10**9)}" for _ in range(300))) for k in range(n)]
    rows.append((n, rows[7][1] + " with one more end"))
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"))
    comp = {r.doc_id: r.component_id for r in got.collect()}
    assert comp == {k: 7 if k == n else k for k in range(n + 1)}
    assert sum(sent) <= 40 * n, sent


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    out = []
    for kind, p in KINDS.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))
                    or kind == "card" and 16 <= len(d) <= 19 and luhn or kind == "phone" and 8 <= len(d) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_personal_data(spark, docs, empty, rows):
    from corpuslens.llm.pii import listed, personal_data, redact
    more = [(70, "a@b.c_d@e.f x..y@z.w 1.2.3.4.5.6.7.8 é 300.1.1.1 0001.2.3.4 +12 +1-2 5-6 4111-1111 11111111  4111111111111111"),
            (71, "9" * 40000), (72, "a" * 40000 + "@x"), (73, "1 " * 20000), (74, "+1" + " (" * 9000 + "5")]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    r = personal_data(d, Scratch(spark, "t"))
    same(r.select("doc_id", listed(F.col("base")), listed(F.col("every"))).collect(),
         [(i, base_spans(t or ""), base_spans(t or "")) for i, t in rows + more])
    assert personal_data(empty, Scratch(spark, "t")).count() == 0
    t = spark.createDataFrame([("mail a@b.cc now", [(0, 5, 11)])], "t string, s array<struct<kind:int,start:int,end:int>>")
    assert t.select(redact(F.col("t"), F.col("s"))).first()[0] == "mail [EMAIL] now"


def test_personal_data_learns(spark):
    """Numbers after words that often precede phone numbers are found without the sign."""
    from corpuslens.llm.pii import listed, personal_data
    rng = random.Random(3)
    rows = [(k, f"{prose(rng, 5)} please call +1 555 010 {1000 + k} {prose(rng, 3)}") for k in range(12)]
    rows += [(50, "so please call 555-010-4477 today"), (51, "version 555-010-4477 of it")]
    got = {r[0]: r[1] for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"))
           .select("doc_id", listed(F.col("every"))).collect()}
    assert got[50] == "phone:15:27" and got[51] == ""


def test_quality(spark, empty):
    from corpuslens.llm.quality import score, train
    rng = random.Random(4)
    rows = [(k, prose(rng, rng.randrange(20, 80)) if k % 2 else ("SPAM!! " * rng.randrange(5, 40))) for k in range(300)] + [(900, None), (901, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(None, 1), (3, None), (5, 1)], "doc_id long, label int")
    got = {r.doc_id: r.score for r in score(d, train(d, labels)).collect()}
    assert all((got[k] >= 0.5) == bool(k % 2) for k in range(200, 300))
    assert got[900] == got[901] and 0 <= got[900] <= 1
    none = labels.limit(0)
    assert {r.score for r in score(d, train(d, none)).collect()} == {0.5}
    assert score(empty.select("doc_id", "text"), train(d, none)).count() == 0


def test_machine_identity():
    """The linear-time sum equals the sum over pairs."""
    from corpuslens.llm import quality as Q
    rng = np.random.default_rng(0)
    model = {"b": 0.3, "w": rng.normal(size=Q.DIM), "v": rng.normal(size=(Q.RANK, Q.DIM))}
    at, x = rng.choice(Q.DIM, 9, replace=False), rng.normal(size=9)
    pairs = sum(model["v"][:, at[i]] @ model["v"][:, at[j]] * x[i] * x[j] for i in range(9) for j in range(i))
    y, _ = Q.output(model, np.zeros(9, dtype=int), at, x, 1)
    assert math.isclose(y[0], 0.3 + model["w"][at] @ x + pairs)


@pytest.mark.parametrize("rule", ["start", "end", "share"])
def test_attribution(spark, docs, empty, rows, rule):
    import public_tokenizers as P
    from corpuslens.llm.attribution import section_tokens, tokenizer
    path = P.path("byte_bpe_50k.tiktoken")
    enc, length = tokenizer(path, P.PATTERN)
    got = section_tokens(docs, path, P.PATTERN, rule).filter("doc_id is not null").collect()
    by = defaultdict(dict)
    for r in got:
        by[r.doc_id][r.section] = r
    for i, t in rows:
        if i is None or i == 2 or not t:
            assert t or i not in by
            continue
        ids, at = enc.encode_ordinary(t), 0
        assert math.isclose(sum(r.n_tokens for r in by[i].values()), len(ids))
        assert "".join(t[r.start:r.end] for _, r in sorted(by[i].items())) == t
        if rule == "start" and len(by[i]) > 1:
            first = len(t[:by[i][0].end].encode())
            ends = np.cumsum(length[np.array(ids)])
            assert by[i][0].n_tokens == int((ends - length[np.array(ids)] < first).sum())
    assert section_tokens(empty, path, P.PATTERN).count() == 0


def test_licences(spark, docs, empty):
    from corpuslens.llm.licences import TEMPLATES, licence_notices
    rows = [(1, "text\nReleased under the MIT license\nmore"), (2, "Licensed  under CC-BY-NC 4.0!"), (3, "the MIT"), (4, None),
            (5, "é\n" + TEMPLATES["mit-grant"][:200] + "\n" + TEMPLATES["mit-grant"][200:] + "\n\nend"), (1, "Released under the MIT License.")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = licence_notices(d).collect()

    def grams(s):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", s.lower())
        return {(a, b) for a, b in zip(w, w[1:])}
    want = []
    for i, t in rows:
        for kind, part in [("line", x) for x in (t or "").split("\n")] + [("paragraph", p) for p in (t or "").split("\n\n") if "\n" in p]:
            g = grams(part)
            best = max(((2 * len(g & grams(x)) / (len(g) + len(grams(x))), n) for n, x in TEMPLATES.items() if g), key=lambda v: v[0], default=(0, ""))
            if best[0] >= 0.8:
                want.append((i, kind, best[1], round(best[0], 9)))
    same([(r.doc_id, r.kind, r.licence, round(r.dice, 9)) for r in got], want)
    assert licence_notices(docs).count() == 0 and licence_notices(empty).count() == 0


def test_packing(spark, docs, empty, rows):
    import public_tokenizers as P
    from tokenizers import Tokenizer
    from corpuslens.llm.packing import pack
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            want.append((i, k, a, len(ids[a:a + 4096]), zlib.crc32(np.array(ids[a:a + 4096], dtype="<u4").tobytes())))
    got = pack(docs, path, Scratch(spark, "t")).collect()
    same([r[:5] for r in got], want)
    at = defaultdict(list)
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    for spans in at.values():
        spans.sort()
        assert [s[0] for s in spans] == [sum(x[1] for x in spans[:k]) for k in range(len(spans))] and sum(x[1] for x in spans) <= 4096
    assert pack(empty, path, Scratch(spark, "t")).count() == 0


def test_packing_is_tight():
    from corpuslens.llm.packing import best_fit, plan
    rng = np.random.default_rng(1)
    n = np.clip(rng.lognormal(6.5, 1.0, 20000).astype(int), 1, 4096)
    lengths, counts = np.unique(n, return_counts=True)
    size_of, places, bins = plan(lengths, counts)
    used, number = defaultdict(int), defaultdict(int)
    left = []
    spot = defaultdict(list)
    for p in places:
        spot[p[0]].append(p)
    for x in n.tolist():
        g = size_of.get(x)
        j = number[g]
        number[g] += 1
        hit = next((p for p in spot.get(g, []) if p[1] <= j < p[2]), None)
        if hit:
            used[hit[3] + (j - hit[1]) // hit[4]] += x
        else:
            left.append(x)
    assert max(used.values(), default=0) <= 4096
    free = 4096 - np.array(list(used.values()) or [4096])
    total = max(len(used), int(best_fit(free, np.array(left), 4096).max()) + 1)
    assert total <= 1.01 * n.sum() / 4096 + 1


def test_encoder_is_exact():
    import public_tokenizers as P
    from corpuslens.llm.packing import ChunkEncoder
    enc = ChunkEncoder(P.path("word_bpe_49k.json"))
    rng = random.Random(6)
    odd = ["don't it's'll", "Áb İX ΣΑΣ", "x\ty\r\nz", "½² a\x1cb", "<|endoftext|>x", "ñÑ_12 !!!???", " nb", "Ångström’s ß ẞ", "日本語 🙂a",
           "\x01y \x01", "'S 'RE ǅx ﬁ é ́e", "", "   "]
    odd += ["".join(rng.choice("abcXYZ019'.,!?ßéñ_-<|> \n") for _ in range(300)) for _ in range(200)]
    for t, got in zip(odd, enc.encode(odd)):
        assert got == np.array(enc.tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), t


def test_kneser_ney(spark, docs, empty, rows):
    from corpuslens.llm.kneser import discounts, score, train
    texts = [SPACED.findall((t or "").translate(LOWER)) + ["\n"] for _, t in rows]
    model = train(docs, Scratch(spark, "t"))
    uni = Counter(w for t in texts for w in t)
    two = Counter(p for t in texts for p in zip([" "] + t, t))
    before, ends, after = Counter(), Counter(), defaultdict(lambda: [0, 0, 0])
    for (h, w), n in two.items():
        before[h] += n
        ends[w] += 1
        after[h][min(n, 3) - 1] += 1
    of = lambda c: np.array([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)])
    d2, d1, n = discounts(of(two)), discounts(of(ends)), len(two)
    cut = lambda d, c: d[min(c, 3) - 1] if c else 0.0
    left = sum(cut(d1, v) for v in ends.values()) / n
    total, v = sum(uni.values()), len(uni)
    fresh = spark.createDataFrame([(None, t, i) for i, t in rows] + [(None, "never seen words alpha1", 99)], "x int, text string, doc_id long")
    want = []
    for i, t in rows + [(99, "never seen words alpha1")]:
        w, s = SPACED.findall((t or "").translate(LOWER)) + ["\n"], 0.0
        for h, x in zip([" "] + w, w):
            low = left / (v + 1) + (ends[x] - cut(d1, ends[x])) / n
            c = two[h, x]
            s += math.log10((c - cut(d2, c)) / before[h] + sum(a * b for a, b in zip(d2, after[h])) / before[h] * low if before[h] else low)
        base = sum(math.log10((uni[x] + 1) / (total + v + 1)) for x in w)
        want.append((i, len(w), sum(uni[x] > 0 for x in w), f"{base:.6f}", f"{s:.6f}"))
    same([(r.doc_id, r.n_tokens, r.n_known, f"{r.base_score:.6f}", f"{r.score:.6f}") for r in score(fresh, model).collect()], want)
    nothing = train(empty, Scratch(spark, "t"))
    assert nothing["v"] == 0 and score(empty.select("doc_id", "text"), model).count() == 0
    assert {r.score for r in score(fresh.select("doc_id", "text"), nothing).collect()} == {0.0}


def test_decontamination(spark, docs, empty, rows):
    from corpuslens.llm.decontam import contamination
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    passage = rows[14][1].split("\n")[1]
    tests = [(1, passage), (2, "one TWO"), (3, None), (4, "..."), (None, "x" * 5000), (5, passage), (10, prose(random.Random(77), 30)),
             (6, "ab " * 12)]
    t = spark.createDataFrame(tests, "item_id long, text string")
    want = []
    for i, s in rows:
        w, hit, items = word.findall((s or "").translate(LOWER)), set(), set()
        for k, x in tests:
            q = word.findall((x or "").translate(LOWER))
            n = min(10, len(q))
            windows = {tuple(q[a:a + n]) for a in range(len(q) - n + 1)} if n else set()
            for a in range(len(w) - n + 1 if n else 0):
                if tuple(w[a:a + n]) in windows:
                    hit |= set(range(a, a + n))
                    items.add("" if k is None else str(k))
        want.append((i, len(w), len(hit), ",".join(sorted(items))))
    got = contamination(docs, t, Scratch(spark, "t")).select("doc_id", "n_words", "n_hit", F.array_join("items", ","))
    same(got.collect(), want)
    assert contamination(empty, t, Scratch(spark, "t")).count() == 0
    assert contamination(docs, t.limit(0), Scratch(spark, "t")).filter("n_hit > 0").count() == 0


def test_proximity(spark):
    from corpuslens.llm.decontam import build_index, find_phrases
    d = spark.createDataFrame([(1, "the quick very brown fox"), (2, "the quick brown fox"), (3, "fox brown")], "doc_id long, text string")
    t = spark.createDataFrame([(7, "quick brown fox")], "item_id long, text string")
    index = build_index(d.coalesce(1), Scratch(spark, "t"))
    assert find_phrases(index, t).count() == 1 and find_phrases(index, t, slop=1).select("ord").distinct().count() == 2


def test_rules(spark, docs, empty, rows):
    from corpuslens.llm.rules import judged
    want = []
    for i, t in rows:
        t = t or ""
        w = SPACED.findall(t)
        win = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
        n, cover = Counter(win), set()
        for k, x in enumerate(win):
            if n[x] > 1:
                cover |= set(range(k, k + 5))
        lines = [x for x in t.split("\n") if SPACED.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover),
                     len(w) < 10 or 100 * len(cover) > 20 * len(w)))
    r = judged(docs, Scratch(spark, "t"))
    same(r.select("row.doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", "q.base_failed").collect(), want)
    assert r.select("row.*").columns == docs.columns and judged(empty, Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("junk", ["copies", "variants"])
def test_rules_skewed(spark, junk):
    """A third of the rows, copies of a text of marks or variants of it, rejects no clean document and is rejected itself."""
    from corpuslens.llm.rules import judged
    rng = random.Random(3)
    common = "the of and to in is was for that with on as by at from this".split()
    clean = [" ".join(rng.choice(common) if rng.random() < 0.6 else f"w{rng.choice('abcdefgh') * 3}{rng.choice('abcdefgh')}" for _ in range(200)) for _ in range(60)]
    bad = [" ".join(f"the{'&' * 3}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(675))] * 30
    if junk == "variants":
        bad = [f"{t} {k}" for k, t in enumerate(bad)]
    d = spark.createDataFrame([(k, t, "en") for k, t in enumerate(clean + bad)], "doc_id long, text string, lang string")
    r = judged(d, Scratch(spark, "t")).select("row.doc_id", "q.kept", "q.class_js", "q.word_js").collect()
    assert len(r) == 90 and all(x.kept == (x.doc_id < 60) for x in r)
    alone = {x.doc_id: x for x in judged(d.filter("doc_id < 60"), Scratch(spark, "t")).select("row.doc_id", "q.class_js", "q.word_js").collect()}
    assert all(abs(x.class_js - alone[x.doc_id].class_js) < 0.1 for x in r if x.doc_id < 60)


def test_divergence(spark):
    from corpuslens.llm.rules import js_distance
    p, q = [3, 1, 0], [0, 1, 3]
    d = spark.createDataFrame([(p, q, p, [0, 0, 0])], "a array<long>, b array<long>, c array<long>, z array<long>")
    got = d.select(js_distance(F.col("a"), F.col("b")), js_distance(F.col("a"), F.col("c")), js_distance(F.col("a"), F.col("z"))).first()
    x, y = np.array(p) / 4, np.array(q) / 4
    m = (x + y) / 2
    kl = lambda u: sum(a * math.log2(a / b) for a, b in zip(u, m) if a)
    assert math.isclose(got[0], math.sqrt((kl(x) + kl(y)) / 2)) and got[1] == 0 and got[2] == 0


def test_rules_work_out_counts_once(spark, docs):
    """No count that a distance reads is worked out again for every element of it."""
    from corpuslens.llm.rules import judged
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = judged(docs, Scratch(spark, "t"))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("arrays_zip(") == 1
