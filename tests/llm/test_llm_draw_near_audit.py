"""Importance resampling, SimHash components and the source audit against brute force: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from snapfold.llm import golay, resampling, simhash_near, source_audit

DDL = "doc_id long, text string, lang string, source string, row string, mark string, key string, n string, at int, rank int"
UP = {c: c + 32 for c in range(65, 91)}


def low(t):
    return (t or "").translate(UP)


def corpus():
    rnd = random.Random(11)
    vocabulary = ["alpha", "Beta", "gamma,", "délta", "ß", "x1", "abcdefgh", "abcdefghi", "ABCDEFGHIJKLMNOPQRSTU", "abcdefghijklmnopqrst", "zeta", "can't", "日本語テキスト"]
    base = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(5, 120))) for _ in range(30)]
    out = [None, None, "", " \n", "a", "A b  c", "word " * 30_000, "x" * 50_000, "日本語 🎉\t\x00end", "1 2 3"]
    for b in base:
        w = b.split()
        out += [b, b, " ".join([*w[:3], "changed", *w[4:]])]
    rows = [(i, t, [None, "en", "", "de"][i % 4], [None, "", "s1", "s2", "é"][i % 5]) for i, t in enumerate(out)]
    return [*rows, (5, "a", "en", "s1"), (5, "other text under one id", "en", "s1"), (None, "no id", "de", "s2"), (None, base[0], "de", "s2"), *[(900 + i, "alpha beta", "fr", "lone") for i in range(3)]]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "r", "m", "k", "n", 1, 2) for r in rows], DDL).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DDL)


def bag(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def brute_draw(rows, target, n, buckets, percent, least):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    grams = lambda w: [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]
    place = lambda g: zlib.crc32(g.encode()) % buckets
    own = [[place(g) for g in grams(words(t))] for _, t, *_ in rows]
    s, t = Counter(b for o in own for b in o), Counter(place(g) for x in target for g in grams(words(x)))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for (i, text, *_), o in zip(rows, own, strict=True):
        weight = sum(map(gain, o)) // len(o) if o else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(o), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(text)) >= least])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = Counter((r[0], r[1], r[2], r[3], k + 1) for k, r in enumerate(fit[: len(fit) * percent // 100]))
    rest = Counter((*r[:4], None) for r in fit[len(fit) * percent // 100 :]) + Counter((*r[:4], None) for r in out if not r[4])
    return drawn + rest


@pytest.mark.parametrize(("n", "buckets", "percent", "least"), [(1, 10_000, 10, 20), (3, 97, 50, 5), (2, 64, 100, 0), (1, 64, 0, 20)])
def test_resampling(spark, docs, rows, n, buckets, percent, least):
    target = ["alpha beta zeta", None, "", "gamma ß zeta zeta", "unseen"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "doc_id int, text string")
    got = resampling.resample(docs, bench, n=n, buckets=buckets, percent=percent, least_words=least)
    assert bag(got, "doc_id", "n_features", "weight", "score", "rank") == brute_draw(rows, target, n, buckets, percent, least)
    assert set(dict(got.dtypes).values()) == {"bigint"}


def test_resampling_of_nothing(docs, nothing, rows):
    assert resampling.resample(nothing, docs).count() == 0
    assert bag(resampling.resample(docs, nothing), "doc_id", "n_features", "weight", "score", "rank") == brute_draw(rows, [], 1, 10_000, 10, 20)


def test_batch_words_do_not_cross():
    words, of = resampling.batch_words(["ab", None, "", "cd-EF", "\n", "ß1"])
    assert [w.decode() for w in words] == ["ab", "cd", "ef", "ß1"] and of.tolist() == [0, 3, 3, 5]


def test_ranks_over_many_ranges(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(0, 20)) for i in range(5000)]
    got = resampling.ranked(spark.createDataFrame(rows, "doc_id long, score long").repartition(7), 1234).collect()
    want = {r[0]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0]))[:1234])}
    assert {r.doc_id: r["rank"] for r in got} == {i: want.get(i) for i, _ in rows}


def test_golay_code():
    _, _, many = golay._tables()
    assert Counter(many.tolist()) == {0: 2048, 1: 277, 6: 1771}
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << golay.LENGTH, 500)
    keys, on = golay.codeword_indices(words)
    own = [set(k[o].tolist()) for k, o in zip(keys, on, strict=True)]
    for a in range(golay.LENGTH):
        for b in range(a, golay.LENGTH):
            other, others = golay.codeword_indices(words ^ (1 << a) ^ (1 << b if b > a else 0))
            assert all(s & set(k[o].tolist()) for s, k, o in zip(own, other, others, strict=True))


def test_keys_within_the_radius():
    rng = np.random.default_rng(4)
    marks = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 400, dtype=np.uint64)
    for trial in range(60):
        places = rng.permutation(64)[: trial % (simhash_near.RADIUS + 1)]
        other = marks ^ np.bitwise_or.reduce([np.uint64(1) << np.uint64(p) for p in places] or [np.uint64(0)])
        a, b = defaultdict(set), defaultdict(set)
        for held, m in ((a, marks), (b, other)):
            for key, of in zip(*map(np.ndarray.tolist, simhash_near.golay_keys(m)), strict=True):
                held[of].add(key)
        assert all(a[i] & b[i] for i in range(len(marks)))


def brute_mark(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots_of(marks, radius):
    marks = sorted(set(marks))
    root = {m: m for m in marks}

    def find(m):
        while root[m] != m:
            root[m] = root[root[m]]
            m = root[m]
        return m

    array = np.array(marks, np.uint64)
    for i, m in enumerate(marks):
        for j in np.flatnonzero(np.bitwise_count(array[:i] ^ array[i]) <= radius).tolist():
            root[find(m)] = find(marks[j])
    return {m: find(m) for m in marks}


def test_simhash_components(docs, rows, nothing):
    marks = [brute_mark(t, 4) for _, t, *_ in rows]
    root, least = roots_of(marks, simhash_near.RADIUS), {}
    for (i, *_), m in zip(rows, marks, strict=True):
        r = root[m]
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    got = simhash_near.simhash_components(docs)
    assert bag(got, "doc_id", "fingerprint", "component_id") == Counter((i, f"{m:016x}", least[root[m]]) for (i, *_), m in zip(rows, marks, strict=True))
    assert simhash_near.simhash_components(nothing).count() == 0


def crowd(seed, bits):
    """Fingerprints around some centres, up to `bits` bits off, chains of steps and strangers."""
    rng = np.random.default_rng(seed)
    one = lambda: rng.integers(0, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    off = lambda n: np.bitwise_xor.reduce([np.uint64(1) << np.uint64(p) for p in rng.permutation(64)[:n]] or [np.uint64(0)])
    out = [one() for _ in range(300)]
    for _ in range(4):
        c = one()
        out += [c ^ off(rng.integers(0, bits + 1)) for _ in range(700)]
    m = one()
    for _ in range(60):
        m = m ^ off(4)
        out.append(m)
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize(("bits", "block", "held"), [(3, 4096, 1 << 16), (9, 64, 200), (14, 32, 100)])
def test_large_groups_of_near_marks(spark, monkeypatch, bits, block, held):
    """Groups above the block size are split, runs above what is held come in parts, cells above the mean are salted; no link is lost."""
    monkeypatch.setattr(simhash_near, "BLOCK", block)
    monkeypatch.setattr(simhash_near, "_meet", partial(simhash_near._meet, most=held))
    marks = crowd(bits, bits)
    df = spark.createDataFrame([(int(m),) for m in marks.view(np.int64)], "mark long").repartition(6)
    got = defaultdict(set)
    for r in simhash_near.linked_fingerprints(df).collect():
        got[r.root].add(r["mark"] % 2**64)
    want = defaultdict(set)
    for m, r in roots_of([int(x) for x in marks], simhash_near.RADIUS).items():
        want[r].add(m)
    big = lambda d: {frozenset(v) for v in d.values() if len(v) > 1}
    assert big(got) == big(want)


def terms_of(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text))


def brute_audit(rows, least, top):
    held, counts, groups = defaultdict(lambda: defaultdict(set)), defaultdict(Counter), set()
    for r, (_, text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in terms_of(text):
            held[lang][t].add(r)
            counts[lang, source][t] += 1
    kept = {lang: {t for t, d in own.items() if len(d) >= least} for lang, own in held.items()}
    apart = lambda p, q: (p - q) ** 2 // (p + q)

    def shares(count, lang):
        own = kept.get(lang, set())
        total = sum(count[t] for t in own)
        return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(own)) for t in own}

    out = Counter()
    for lang, source in groups:
        p = shares(counts[lang, source], lang)
        whole = Counter()
        for (other_lang, _), c in list(counts.items()):
            if other_lang == lang:
                whole.update(c)
        q = shares(whole, lang)
        others = [s for g, s in groups if g == lang and s != source]
        values = {s: sum(apart(p[t], x) for t, x in shares(counts[lang, s], lang).items()) for s in others}
        terms = {t: apart(x, q[t]) for t, x in p.items() if counts[lang, source][t] and x > q[t]}
        for part, found, most in (("pair", values, len(values)), ("term", terms, top)):
            for k, (item, value) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0].encode()))[:most]):
                out[lang, source, part, item, value, k + 1] += 1
    return out


@pytest.mark.parametrize(("least", "top", "size"), [(10, 10, 8 << 20), (2, 3, 100), (1, 50, 4000), (10**6, 10, 8 << 20)])
def test_source_audit(docs, rows, nothing, least, top, size):
    got = source_audit.divergence(docs, least=least, top=top, slice_bytes=size)
    assert bag(got, "lang", "source", "part", "item", "value", "rank") == brute_audit(rows, least, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(got.dtypes)["rank"] == "int"


def test_source_audit_of_nothing(nothing):
    assert source_audit.divergence(nothing).count() == 0


def test_pointer_sort():
    rnd = random.Random(9)
    texts = ["".join(rnd.choice(["ab", "abcdefgh", "é", " ", "1", "Z", "q" * 40]) for _ in range(rnd.randint(0, 60))) for _ in range(300)] + ["", "end"]
    groups = np.sort(np.array([rnd.randint(0, 6) for _ in texts]))
    terms, lang, df, borders, group, counts = source_audit.slice_terms(pa.array(texts), groups, groups // 3)
    want, held = Counter(), Counter()
    for t, g in zip(texts, groups.tolist(), strict=True):
        want.update((g // 3, g, x) for x in terms_of(t))
        held.update((g // 3, x) for x in set(terms_of(t)))
    names = terms.to_pylist()
    assert {(lang[i], t): df[i] for i, t in enumerate(names)} == held
    assert {(lang[i], group[k], t): counts[k] for i, t in enumerate(names) for k in range(borders[i], borders[i + 1])} == want
    assert [t.encode() for t in names] == sorted(t.encode() for t in names)
