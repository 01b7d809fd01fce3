"""Small fixtures for the corpus operators: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from snapfold.llm import components, decontaminate, exact_dedup, katz, line_dedup, near_join, personal_data, piece_codec, quality, sharding, token_file
from snapfold.llm.common import scratch
from snapfold.llm.queries import tokenizer

DDL = "doc_id long, text string, row string, n string, pos string, word string, size int"
UP = {c: c + 32 for c in range(65, 91)}


def low(t):
    return (t or "").translate(UP)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", low(t))


def corpus():
    rnd = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma,", "délta", "ß", "epsilon.", "zeta", "eta", "theta", "IOTA", "kappa", "x1"]
    base = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(5, 120))) for _ in range(25)]
    out = [None, None, "", " ", "\n\n", "a", "a b  c", "  lead and trail  ", "word " * 3000, "日本語 🎉\t\x00end"]
    for b in base:
        w = b.split()
        out += [b, b, " ".join([*w[:3], "changed", *w[4:]])]
    line = "This very line stands in many documents."
    out += [f"own {i}\n  {line.upper() if i % 2 else line} \nshort\nshort" for i in range(6)]
    ids = list(range(len(out)))
    return list(zip(ids, out, strict=True)) + [(5, "a"), (5, "other text under one id"), (None, "no id"), (None, base[0])]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "r", "n", "p", "w", 1) for i, t in rows], DDL).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DDL)


def bag(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_token_codes():
    import numpy as np

    ids = np.random.default_rng(1).choice([0, 3, 255, 256, 70_000, 1 << 24], 3000).astype(np.uint32)
    levels, more, ranks = token_file.dac_encode(ids)
    assert (token_file.dac_decode(levels, more) == ids).all()
    assert all(token_file.dac_at(levels, more, ranks, i) == ids[i] for i in range(0, 3000, 7))
    assert len(token_file.dac_decode(*token_file.dac_encode(ids[:0])[:2])) == 0


def test_token_file(spark, docs, rows, nothing):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    path = scratch(spark, "t")
    token_file.write_tokens(docs, tokenizer("byte_bpe_50k.json"), path)
    got = token_file.read_documents(spark, path)
    flat, want = [], Counter()
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        want[i, len(flat), len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))] += 1
        flat += ids
    assert bag(got, "doc_id", "start", "n_tokens", "ids_crc32") == want
    at = spark.createDataFrame([(p,) for p in [*range(0, len(flat), 97), None, len(flat)]], "position long")
    assert {tuple(r) for r in token_file.tokens_at(spark, path, at).collect()} == {(p, flat[p]) for p in range(0, len(flat), 97)}
    empty = scratch(spark, "t")
    token_file.write_tokens(nothing, tokenizer("byte_bpe_50k.json"), empty)
    assert token_file.read_documents(spark, empty).count() == 0


def test_line_dedup(docs, rows, nothing):
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(-1 if i is None else i)
    want = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == (-1 if i is None else i)]
        want[i, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    assert bag(line_dedup.dedup_lines(docs), "doc_id", "text", "n_lines", "n_dropped") == want
    assert line_dedup.dedup_lines(nothing).count() == 0


def brute_katz(rows, order, cut=katz.CUT):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    grams = lambda w, n: [tuple((["<s>"] * (n - 1) + w)[i : i + n]) for i in range(len(w))]
    counts = [Counter() for _ in range(order + 1)]
    for i, t in rows:
        for n in range(1, order + 1) if not held(i) else ():
            counts[n].update(grams([*words(t), "</s>"], n))

    def discount(c):
        n = Counter(c.values())
        if all(n[r] for r in range(1, cut + 2)) and (common := (cut + 1) * n[cut + 1] / n[1]) < 1:
            d = {r: ((r + 1) * n[r + 1] / (n[r] * r) - common) / (1 - common) for r in range(1, cut + 1)}
            if all(0 < x < 1 for x in d.values()):
                return d
        least = min(max(n[1] / (n[1] + 2 * n[2]), 0.1), 0.9) if n[1] else 0.5
        return {r: (r - least) / r for r in range(1, cut + 1)}

    total = sum(counts[1].values())
    d = discount(counts[1])
    p = [None, {g: c * d.get(c, 1) / total for g, c in counts[1].items()}]
    unknown, weights = 1 - sum(p[1].values()), [None, None]
    for n in range(2, order + 1):
        d, sums, leaves = discount(counts[n]), Counter(), defaultdict(int)
        for g, c in counts[n].items():
            sums[g[:-1]] += c
            leaves[g[:-1]] |= c <= cut
        p.append({g: c * d.get(c, 1) / (sums[g[:-1]] + 1 - leaves[g[:-1]]) for g, c in counts[n].items()})
        own, below = defaultdict(float), defaultdict(float)
        for g in counts[n]:
            own[g[:-1]] += p[n][g]
            below[g[:-1]] += p[n - 1][g[1:]]
        weights.append({h: (1 - own[h]) / (1 - below[h]) for h in own})

    def log(g):
        if len(g) == 1:
            return math.log10(p[1].get(g, unknown))
        return math.log10(p[len(g)][g]) if g in p[len(g)] else math.log10(weights[len(g)].get(g[:-1], 1)) + log(g[1:])

    for h, w in (weights[2].items() if order > 1 else ()):  # exactly normalised: seen words, unseen known ones, the unknown class
        mass = sum(10 ** log((*h, *g)) for g in counts[1]) + w * unknown
        assert abs(mass - 1) < 1e-9
    out = []
    for i, t in rows:
        w = [*words(t), "</s>"]
        c = [counts[1][(x,)] for x in w]
        out.append((i, held(i), len(w), sum(x > 0 for x in c), total, sum(math.log10((x + 0.1) / (total + 0.1 * (len(counts[1]) + 1))) for x in c), sum(map(log, grams(w, order)))))
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_katz(docs, rows, nothing, order):
    got = katz.score_documents(docs, quality.held_out(F.col("doc_id"), 10), order).collect()
    show = lambda r: (-1 if r[0] is None else r[0], *r[1:5], round(r[5], 6), round(r[6], 6))
    assert sorted(map(show, got)) == sorted(map(show, brute_katz(rows, order)))
    if order == 2:
        assert katz.score_documents(nothing, quality.held_out(F.col("doc_id"), 10)).count() == 0


def good_turing(n, r, cut=katz.CUT):
    common = (cut + 1) * n[cut + 1] / n[1]
    return ((r + 1) * n[r + 1] / (n[r] * r) - common) / (1 - common)


@pytest.mark.parametrize("n", [[215810, 61309, 26017, 14862, 13741, 7222], [1655711, 262472, 56325, 23262, 20048, 8151], [51654, 14844, 5474, 2713, 2570, 1129], [16971, 3831, 1233, 563, 507, 210]])
def test_katz_factors(n):
    """Counts of counts of sf0.1 (words, pairs), sf0.01 and sf0.001: n5 near n4 leaves the other factors Good-Turing's."""
    n = dict(enumerate(n, 1))
    d = katz.factors(n)
    assert good_turing(n, 4) > 1 and all(0 < d[r] < 1 for r in d)
    assert all(abs(d[r] - good_turing(n, r)) < 1e-12 for r in (1, 2, 3, 5))
    assert max(d[2], 0.5) < d[4] < 1


def test_katz_many_copies(spark):
    """A corpus with n5 near n4: word probabilities are Good-Turing's, and packed pairs give what the tables of train() give."""
    rnd = random.Random(9)
    n = dict(zip(range(1, 7), (120, 48, 26, 14, 13, 6), strict=True))
    seq = [f"w{r}x{i}" for r, many in n.items() for i in range(many) for _ in range(r)]
    rnd.shuffle(seq)
    texts = [(1, " ".join(seq)), (2, "w1x1 w5x1 unseen w4x1 w2x2")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    model = katz.train(df.filter("doc_id = 1").select("text"), 2)
    n[1] += 1  # the end of the text
    by_count = {r["count"]: r.p for r in model["grams"][1].select("count", "p").distinct().collect()}
    total = len(seq) + 1
    assert good_turing(n, 4) > 1 and all(abs(by_count[r] - r * good_turing(n, r) / total) < 1e-12 for r in (1, 2, 3, 5)) and by_count[4] < 4 / total
    each = katz.evaluate(model, katz.tokens(df.select("doc_id", "text"), 2, "doc_id"), "doc_id").groupBy("doc_id").agg(F.sum("p").alias("p"))
    want = {r.doc_id: r.p for r in each.collect()}
    got = {r.doc_id: r.score for r in katz.score_documents(df, F.col("doc_id") == 2).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in got)


def test_pieces(docs, rows, nothing):
    model = tokenizer("piece_bpe_32k.model")
    library = piece_codec.agenda(model).library
    out = piece_codec.encode_pieces(docs, model)
    want = Counter((i, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for i, t in rows)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in out.collect()) == want
    assert bag(piece_codec.decode_pieces(out, model), "doc_id", "text") == Counter((i, d) for i, _, d in want.elements())
    assert piece_codec.encode_pieces(nothing, model).count() == 0


def test_decontamination(spark, docs, nothing):
    rnd = random.Random(3)
    item = [f"w{rnd.randint(0, 500)}" for _ in range(40)]
    many = [f"v{rnd.randint(0, 5000)}" for _ in range(3000)]
    items = spark.createDataFrame([(1, " ".join(item), "x"), (2, None, "x"), (3, "", "x"), (None, "a b", "x"), (4, "tiny item", "x"), (5, "q q q q q q q q q", "x")], "item_id long, text string, doc_id string")
    cases = [
        (1, " ".join([*many, *item, *many]), True), (2, " ".join(item).upper().replace(" ", ", "), True), (3, " ".join([*many[:9], "new", *item[1:], *many]), True), (4, " ".join(item[:20]), False),
        (5, " ".join([*item[20:], *item[:20]]), True), (6, " ".join(many), False), (7, None, False), (8, "", False), (None, " ".join(item), True), (9, " ".join([*item[:18], "one", "two", *item[20:]]), False), (10, " ".join(item), True), (10, " ".join(item), True),
    ]
    more = [(20, "here a Tiny item!", 4), (21, "q " * 9, 5), (22, "q " * 5, None)]
    df = spark.createDataFrame([(i, t) for i, t, _ in cases + more], "doc_id long, text string")
    got = bag(decontaminate.contaminated(df, items), "doc_id", "item_id")
    assert got == Counter({*((i, 1) for i, _, leak in cases if leak), *((i, n) for i, _, n in more if n)})
    assert decontaminate.contaminated(nothing, items).count() == decontaminate.contaminated(df, items.limit(0)).count() == 0


def brute_near(rows, k, percent):
    sets = [{tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()) for w in (words(t) for _, t in rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * len(sets[x] | sets[y]):
                root[find(x)] = find(y)
    ids = defaultdict(list)
    for x, (i, _) in enumerate(rows):
        ids[find(x)] += [i] if i is not None else []
    return Counter((i, len(sets[x]), min(ids[find(x)], default=None) if sets[x] else i) for x, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_near_join(spark, rows, k, percent, nothing):
    rnd = random.Random(k)
    base = [f"b{rnd.randint(0, 80)}" for _ in range(60)]
    more = [(1000 + j, " ".join(w if rnd.random() > 0.03 else f"z{rnd.randint(0, 9)}" for w in base)) for j in range(60)]
    every = rows + more
    df = spark.createDataFrame([(i, t, "r", "n", "p", "w", 1) for i, t in every], DDL)
    assert bag(near_join.near_components(df, k, percent), "doc_id", "n_shingles", "component_id") == brute_near(every, k, percent)
    if k == 5:
        assert near_join.near_components(nothing).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 202), (201, 202)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 201: 200, 202: 200}


def test_sharding(docs, rows, nothing):
    out = sharding.shard_documents(docs, [1.0] * 8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len({r.shard for r in out if r.doc_id == i}) == 1 for i in (5, None))
    assert sharding.shard_documents(nothing, [1.0] * 8).count() == 0


def test_weights_share_keys(spark):
    keys = spark.range(20_000).select(sharding.rendezvous(F.col("id"), [1.0, 3.0, 0.0]).alias("s"))
    n = {r.s: r["count"] for r in keys.groupBy("s").count().collect()}
    assert set(n) == {0, 1} and 0.23 < n[0] / 20_000 < 0.27


def test_quality(spark, docs, rows, nothing):
    sf = "/root/testdata/sf0.01"
    whole, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    forest = quality.train(whole, labels.filter(~quality.held_out(F.col("doc_id"))))
    scored = quality.score_documents(whole, forest).join(labels.filter(quality.held_out(F.col("doc_id"))), "doc_id").collect()
    right = sum((r.score >= 0.3) == (r.quality == 1) for r in scored)
    assert len(scored) > 50 and right / len(scored) > 0.93
    odd = quality.score_documents(docs, forest, ("doc_id", "text")).collect()
    assert Counter((r.doc_id, r.text) for r in odd) == Counter(rows) and all(0 <= r.score <= 1 for r in odd)
    assert quality.score_documents(nothing, forest).count() == 0
    alone = quality.train(whole, labels.limit(0))
    assert {r.score for r in quality.score_documents(docs, alone).collect()} == {0.5}


def test_top_word_is_of_all_words():
    texts = [" ".join([f"w{i}" for i in range(300)] + ["junk"] * 700), "a b c d e f g h i j j", "", None, "one", " \n "]
    got = quality.statistics(texts)[:, quality.FEATURES.index("top_word")]
    want = [max(Counter((t or "").split()).values(), default=0) / max(1, len((t or "").split())) for t in texts]
    assert got.tolist() == want and want[0] == 0.7


def brute_spans(t):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m, d: 12 <= len(d) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 9 <= len(d) <= 15),
    }
    out = []
    for rank, (kind, (pattern, valid)) in enumerate(kinds.items()):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, t or "") if valid(m[0], re.sub("[^0-9]", "", m[0]))]
    return ",".join(s for _, _, s in sorted(out))


PERSONAL = [
    "mail a.b@c.example.com and x@y, a@b.c@d.e", "🎉é ip 1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.0255 99999999999.1.1.1", "card 4337166598464399 4337-1665-9846-4399 4337 1665 9846 4399 1 4337166598464398",
    "+1 (988) 555-2485, +1 23, ++49 30 123456", None, "", "1 2 3 4 5 6 7 8 9 " * 2000, "a" * 30_000 + "@", "x@y.zz" * 50, "4" * 5000, "+1" + "-" * 40 + "2", "79927398713 0000000000000000", "a@b.c.", "@", "a@b..c",
]


def test_base_spans(spark, rows, nothing):
    every = [(i, t) for i, t in enumerate(PERSONAL)] + rows
    df = spark.createDataFrame([(i, t, "r", "n", "p", "w", 1) for i, t in every], DDL)
    got = personal_data.find_personal_data(df).select("doc_id", "text", personal_data.spelled(F.col("base")).alias("s"))
    assert bag(got, "doc_id", "text", "s") == Counter((i, t or "", brute_spans(t)) for i, t in every)
    assert personal_data.find_personal_data(nothing).count() == 0


def test_disclosing_terms(spark):
    texts = [f"number {i} notes: Zebulon writes from zed@mail.example.com about thing{i}" for i in range(4)] + [f"notes about thing{i} and number {i}" for i in range(20)] + ["Zebulon alone"] * 0
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in personal_data.find_personal_data(df).select("doc_id", personal_data.spelled(F.col("spans")).alias("s"), personal_data.sanitised(F.col("text"), F.col("spans")).alias("t")).collect()}
    at = texts[0].index("Zebulon")
    assert f"term:{at}:{at + 7}" in out[0].s and "zed" not in out[0].t and "[email]" in out[0].t and "Zebulon" not in out[0].t and "about thing0" in out[0].t
    assert all(out[i].s == "" and out[i].t == texts[i] for i in range(4, 24))


def test_terms_of_rare_entities(spark):
    """Whole texts and smoothed small counts against brute force: entities of one text, terms far away, repeated texts."""
    rnd = random.Random(4)
    common = [a + b for a in ("over", "under", "after", "before") for b in ("ground", "hand", "line", "word")]
    fill = lambda n: " ".join(rnd.choice(common) for _ in range(n))
    texts = [f"Zebulonia {fill(60)} one@a.example {fill(9)} xerxesque", f"{fill(20)} Quillon lives {fill(40)} two@b.example", f"{fill(30)} two@b.example {fill(30)} quillon three@c.example", f"Quillon {fill(9)}"]
    texts += [fill(12) for _ in range(20)] + [f"xerxesque {fill(5)}", ""]
    texts += [texts[0], texts[3]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "doc_id long, text string")
    patterns, distinct = re.compile(r"\w+@\w\.example"), set(texts)
    terms = {t: {w.lower() for w in re.findall("[^\\W\\d_]{4,}", t)} for t in distinct}
    own = {t: {w.lower() for w in re.findall("[^\\W\\d_]{4,}", patterns.sub(" ", t))} for t in distinct}
    for disclosure in (0.5, 0.7, 0.3):
        want = set()
        for c in {m for t in distinct for m in re.findall(r"\w+@\w\.example", t)}:
            for w in {w for t in distinct if c in t for w in own[t]}:
                n_c, n_ct, n_t = sum(c in t for t in distinct), sum(c in t and w in own[t] for t in distinct), sum(w in terms[t] for t in distinct)
                given = (n_ct + n_c / len(distinct)) / (n_t + 1)
                want |= {w} if given >= disclosure and given > n_c / len(distinct) else set()
        got = personal_data.find_personal_data(df, disclosure).select("doc_id", "text", "spans").collect()
        spelt = {r.text[s.start : s.end].lower() for r in got for s in r.spans if s["rank"] == 4}
        assert spelt == want and len(got) == len(texts) + 1
        assert ("zebulonia" in want) == (disclosure <= 0.5)
        held = {r.doc_id: {r.text[s.start : s.end].lower() for s in r.spans if s["rank"] == 4} for r in got}
        assert all(held[i] == terms[t] & want for i, t in enumerate(texts)) and held[99] == set()


def test_exact_dedup(docs, rows, nothing):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(-1 if i is None else i)
    got = exact_dedup.exact_duplicates(docs)
    show = lambda v: None if v == -1 else v
    want = Counter((i, show(max(groups[t or ""])), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert bag(got, "doc_id", "keep_id", "group_size", "text_sha256") == want
    assert got.filter("kept").count() == len(groups)
    assert bag(exact_dedup.exact_duplicates(docs, sizes=(1, 2, 16)), "doc_id", "keep_id", "group_size", "text_sha256") == want
    assert exact_dedup.exact_duplicates(nothing).count() == 0


def test_chunks_follow_content():
    import numpy as np

    data = np.random.default_rng(2).integers(97, 123, 60_000).astype(np.uint8).tobytes()

    def cut(raw):
        ends = next(exact_dedup.cuts(np.frombuffer(raw, np.uint8), [0, len(raw)]))
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    own, moved = cut(data), cut(b"xyz" + data)
    assert b"".join(own) == data and max(map(len, own)) <= exact_dedup.MOST and len(set(own) & set(moved)) >= len(own) - 3
