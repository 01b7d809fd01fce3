"""Corpus operators against plain versions: spans and windows, hot keys, long texts, forests, shards, pipeline stages."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import brute_katz, brute_near, low, words

from snapfold.llm import decontaminate, exact_dedup, katz, katz_pairs, line_dedup, near_join, personal_data, quality, sharding
from snapfold.llm.common import scratch


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def bags(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])


def brute_leaks(docs, items, k=5, least=0.8):
    """(doc, item) -> (similarity, first start) of the best window, over all windows of every text."""
    split = lambda t: [x for x in re.split(r"[^\w]+", (t or "").lower()) if x]
    out = {}
    for d, t in docs:
        w = split(t)
        for i, text in items:
            own = split(text)
            if not own or not w:
                continue
            for s in range(max(1, len(w) - len(own) + 1)):
                a, b = bags(w[s : s + len(own)], k), bags(own, k)
                like = sum((a & b).values()) / sum((a | b).values())
                if like >= least and (-like, s) < out.get((d, i), (0, 0)):
                    out[d, i] = (-like, s)
    return {key: (-v[0], v[1]) for key, v in out.items()}


def test_leaks_against_brute_force(spark):
    """Edits of items inside other words: every window of 0.8 is found, with its place and its similarity."""
    rnd = random.Random(11)
    word = lambda n: f"w{rnd.randint(0, n)}"
    items = [(i, " ".join(word(300) for _ in range(rnd.choice([3, 9, 20, 40, 56])))) for i in range(12)]
    two = ["one"] * 30 + ["two"] * 30
    rnd.shuffle(two)
    items.append((12, " ".join(two)))
    docs = []
    for n in range(90):
        own = rnd.choice(items)[1].split()
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            at = rnd.randrange(len(own))
            own[at : at + rnd.choice([0, 1, 1])] = [word(300)]
        docs.append((n, " ".join([*[word(300) for _ in range(rnd.randint(0, 60))], *own, *[word(300) for _ in range(rnd.randint(0, 60))]])))
    docs += [(100, " ".join(["new", *two[1:]])), (101, " ".join(two * 3))]
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in decontaminate.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_leaks(docs, items)
    assert (100, 12) in want and 0.9 < want[100, 12][0] < 1
    missed = want.keys() - got.keys()
    assert got.keys() <= want.keys() and len(missed) <= 0.01 * len(want), missed
    assert all(math.isclose(got[x][0], want[x][0]) for x in got)
    assert sum(got[x][1] == want[x][1] for x in got) >= 0.98 * len(got)


def test_long_items(spark):
    """A word that makes up half of a long item, and an item longer than STEPS shingles inside a longer text."""
    rnd = random.Random(12)
    long = [rnd.choice(["the", f"x{rnd.randint(0, 9)}"]) for _ in range(80_000)]
    items = spark.createDataFrame([(1, " ".join(long))], "item_id long, text string")
    docs = frame(spark, [(1, " ".join([*["a", "b"] * 5, *long, *["c"] * 10])), (2, " ".join(long[:40_000])), (3, "the " * 5000)])
    got = {r.doc_id: r.similarity for r in decontaminate.contaminated(docs, items).collect()}
    assert got.keys() == {1} and got[1] > 0.999


def test_long_item_off_the_grid(spark):
    """An item of more than STEPS shingles, five words into a text, changed so that its best window is just 0.8 alike."""
    rnd = random.Random(15)
    own = [f"x{rnd.randint(0, 10**9)}" for _ in range(20_004)]
    changed = list(own)
    for i in range(444):
        changed[4 + 45 * i] = f"y{i}"
    want = sum((bags(changed, 5) & bags(own, 5)).values()) / sum((bags(changed, 5) | bags(own, 5)).values())
    assert 0.8 <= want < 0.802
    docs = frame(spark, [(1, " ".join([*"abcde", *changed, "tail"])), (2, " ".join([*["p"] * 17, *own])), (3, " ".join(own[:15_000]))])
    got = {r.doc_id: (r.similarity, r.start_word) for r in decontaminate.contaminated(docs, spark.createDataFrame([(1, " ".join(own))], "item_id long, text string")).collect()}
    assert got == {1: (want, 5), 2: (1.0, 17)}


def test_repeated_text(spark):
    """Items of few heavy shingles, whose fingerprints tell nothing."""
    text = lambda *runs: " ".join(w for word, n in runs for w in [word] * n)
    items = [(1, text(("alpha", 52), ("beta", 56))), (2, text(("la", 40))), (3, text(("a", 30), ("b", 30), ("c", 30), ("d", 30))), (4, "one two three")]
    docs = [(1, text(("alpha", 56), ("beta", 52))), (2, "so " + text(("la", 43)) + " end"), (3, text(("x", 3), ("d", 33), ("c", 27), ("b", 33), ("a", 27))), (4, "we say one two three times"), (5, "clean"), (6, text(("a", 33), ("b", 27), ("c", 33), ("d", 27)))]
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word) for r in decontaminate.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {k: (round(v[0], 9), v[1]) for k, v in brute_leaks(docs, items).items()} and {(1, 1), (2, 2), (6, 3), (4, 4)} <= got.keys()


@pytest.mark.parametrize("parts", [5, 10, 50, 5000])
def test_recall_just_above_the_threshold(spark, parts):
    """Planted windows of a similarity from 0.8 to 0.85: at least 99 % of them are found, over items of each size."""
    rnd = random.Random(parts)
    many = 300 if parts < 1000 else 30
    items, docs, want = [], [], set()
    for i in range(many):
        own = [f"{i}x{rnd.randint(0, 10**6)}" for _ in range(parts + 4)]
        while True:
            new = list(own)
            for _ in range(rnd.randint(0, max(1, parts // 20))):
                new[rnd.randrange(len(new))] = f"y{rnd.randint(0, 10**6)}"
            cut = rnd.randint(0, parts // 5)
            new[: cut] = [f"z{rnd.randint(0, 10**6)}" for _ in range(cut)]
            like = sum((bags(new, 5) & bags(own, 5)).values()) / sum((bags(new, 5) | bags(own, 5)).values())
            if 0.8 <= like < 0.85 or parts == 5 and like == 1:
                break
        items.append((i, " ".join(own)))
        docs.append((i, " ".join([*["before"] * rnd.randint(0, 9), *new, "after"])))
        want.add((i, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.99 * many, (parts, len(got), many)


def test_near_fingerprints_share_a_block(spark):
    """Whatever 19 bits differ, an indexed value of one block is met."""
    rnd = random.Random(13)
    pairs = []
    for _ in range(300):
        a = rnd.getrandbits(64)
        b = a
        for x in rnd.sample(range(64), decontaminate.RADIUS):
            b ^= 1 << x
        pairs.append(tuple(v - (1 << 64) if v >> 63 else v for v in (a, b)))
    df = spark.createDataFrame(pairs, "a long, b long").select(decontaminate.blocks(F.col("a")).alias("x"), decontaminate.near_blocks(F.col("b")).alias("y"))
    assert df.filter(~F.arrays_overlap("x", "y")).count() == 0


def test_katz_with_contexts_dealt_out(spark, monkeypatch):
    """Partitions so small that contexts are dealt out by pair; scores, and the tables' own recursion, as brute force has them."""
    rnd = random.Random(14)
    texts = [(i, " ".join(rnd.choice(["a", "b", "c", *[f"w{rnd.randint(0, 60)}"] * 4]) for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    monkeypatch.setattr(katz_pairs, "PART_TOKENS", 60)
    df = frame(spark, texts)
    scores, model = katz_pairs.score_pairs(df, quality.held_out(F.col("doc_id"), 10))
    show = lambda r: (*r[:5], round(r[5], 6), round(r[6], 6))
    want = brute_katz_fitted(texts)
    assert sorted(map(show, scores.collect())) == sorted(map(show, want))
    assert model.stats.groupBy("context").count().filter("count > 1").count() > 3
    assert all(0 < r.p < 1 for r in model.grams().collect()) and all(r.weight > 0 for r in model.contexts().collect())
    assert abs(sum(r.p for r in model.words().collect()) + model.unknown - 1) < 1e-9


def test_katz_tables_score_by_themselves(spark):
    """Sums over tokens of what the tables say, token by token, are the documents' scores."""
    from snapfold.llm.words import word_hashes

    rnd = random.Random(20)
    texts = [(i, " ".join(rnd.choice(["x", "y", *[f"v{rnd.randint(0, 80)}"] * 3]) for _ in range(rnd.randint(0, 40)))) for i in range(50)]
    scores, model = katz_pairs.score_pairs(frame(spark, texts), quality.held_out(F.col("doc_id"), 10))
    rows = []
    for i, t in texts:
        own = [katz.START, *word_hashes([t])[0].view(np.int64).tolist(), katz.END] if t else [katz.START, katz.END]
        rows += [(i, c, w) for c, w in zip(own, own[1:], strict=False)]
    each = spark.createDataFrame(rows, "doc_id long, context long, word long")
    got = {r.doc_id: r.p for r in model.evaluate(each, "doc_id").groupBy("doc_id").agg(F.sum("p").alias("p")).collect()}
    want = {r.doc_id: r.score for r in scores.collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in got)


def brute_katz_fitted(rows):
    """brute_katz() with the operator's own discount factors, which have their own test."""
    import test_llm

    held = lambda i: test_llm.zlib.crc32(str(i).encode()) % 10 == 0
    one, two = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            w = ["<s>", *words(t), "</s>"]
            one.update(w[1:]), two.update(zip(w, w[1:], strict=False))
    d1, d2 = (katz.factors({r: n for r, n in Counter(c.values()).items() if r <= katz.CUT + 1}) for c in (one, two))
    total = sum(one.values())
    mass = total + all(c > katz.CUT for c in one.values())  # nothing discounted: as if one more token had followed
    p1 = {w: c * d1.get(c, 1) / mass for w, c in one.items()}
    unknown = 1 - sum(p1.values())
    sums, leaves = Counter(), defaultdict(int)
    for (h, _), c in two.items():
        sums[h] += c
        leaves[h] |= c <= katz.CUT
    p2 = {g: c * d2.get(c, 1) / (sums[g[0]] + 1 - leaves[g[0]]) for g, c in two.items()}
    own, below = defaultdict(float), defaultdict(float)
    for g in two:
        own[g[0]] += p2[g]
        below[g[0]] += p1[g[1]]
    out = []
    for i, t in rows:
        w = ["<s>", *words(t), "</s>"]
        logs = []
        for g in zip(w, w[1:], strict=False):
            back = (1 - own[g[0]]) / (1 - below[g[0]]) if g[0] in own else 1.0
            logs.append(math.log10(p2[g]) if g in p2 else math.log10(back) + math.log10(p1.get(g[1], unknown)))
        c = [one[x] for x in w[1:]]
        out.append((i, held(i), len(w) - 1, sum(x > 0 for x in c), total, sum(math.log10((x + 0.1) / (total + 0.1 * (len(one) + 1))) for x in c), sum(logs)))
    return out


def test_lines_of_many_documents_and_long_texts(spark):
    """A key in most documents (hot) and one text of 60,000 lines, of which every third is shared."""
    shared = [f"this line number {i} stands in many documents" for i in range(40)]
    docs = [(i, "\n".join([shared[0], f"own {i}", shared[i % 40]])) for i in range(400)]
    docs.append((1000, "\n".join(shared[(i // 3) % 40] if i % 3 == 0 else f"line {i}" for i in range(60_000))))
    docs.append((1001, "\n".join(shared)))
    held = defaultdict(set)
    for i, t in docs:
        for x in t.split("\n"):
            held[low(x)].add(i)
    want = {i: "\n".join(x for x in t.split("\n") if len(x) < 20 or len(held[low(x)]) < 3 or max(held[low(x)]) == i) for i, t in docs}
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, docs)).collect()}
    assert got == want and len(want[1000].split("\n")) == 40_000


def test_a_group_with_a_third_of_all_rows(spark):
    rnd = random.Random(15)
    docs = [(i, "the same text " * 900 if i % 3 == 0 else f"text {rnd.randint(0, 150)}") for i in range(600)]
    groups = defaultdict(list)
    for i, t in docs:
        groups[t].append(i)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_duplicates(frame(spark, docs)).collect()}
    assert got == {i: (max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in docs}


def test_near_copies_beyond_one_block(spark, monkeypatch):
    """A class with far more partners than a block takes, and rows that stand for their group."""
    rnd = random.Random(16)
    monkeypatch.setattr(near_join, "BLOCK", 7)
    base = [f"b{i}" for i in range(120)]
    docs = [(i, " ".join([*base[:60], f"z{i}", *base[61:]])) for i in range(60)] + [(200 + i, " ".join(f"y{rnd.randint(0, 900)}" for _ in range(30))) for i in range(40)]
    docs += [(0, " ".join(base)), (0, docs[0][1])]
    out = near_join.near_rows(frame(spark, docs), 5, 80).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute_near(docs, 5, 80)
    kept = Counter((r.component_id, r.row) for r in out if r.kept)
    assert len(kept) == 41 and len({c for c, _ in kept}) == 41


def test_shards_are_written_whole(spark):
    rows = [(1, "a", 7), (1, "b", 8), (None, "c", 9), (2, "d", 1), (2, "d", 1), (3, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    path = scratch(spark, "shards")
    sharding.write_shards(docs, [1.0] * 4, path)
    back = spark.read.parquet(path)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t) for i, t, _ in rows)
    slots = defaultdict(list)
    for r in back.collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    placed = {r.doc_id: r.shard for r in sharding.shard_documents(docs, [1.0] * 4).collect()}
    assert all(placed[r.doc_id] == r.shard for r in back.collect())


def test_rendezvous_against_plain_argmin(spark):
    """The shard is that of the least cost over all shards, and one shard more takes keys only into itself."""
    keys = spark.range(3000).select(F.col("id"), sharding.rendezvous(F.col("id"), [1.0, 2.0, 0.5]).alias("s"), *[sharding._cost(F.col("id"), F.lit(i), F.lit(w)).alias(f"c{i}") for i, w in enumerate([1.0, 2.0, 0.5])]).collect()
    assert all(r.s == min(range(3), key=lambda i, r=r: r[f"c{i}"]) for r in keys)


def test_forest_against_a_plain_walk():
    rnd = np.random.default_rng(17)
    x = rnd.normal(size=(900, 5))
    y = ((x[:, 1] > 0.3) & (x[:, 3] < 0.5)).astype(float)
    forest = quality.fit(x, y, trees=12, depth=3)

    def plain(row):
        raw = forest.base
        for feature, limit, value in zip(forest.feature, forest.limit, forest.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > limit[node] else 1)
            raw += value[node - len(feature)]
        return 1 / (1 + math.exp(-raw))

    assert np.allclose(forest.score(x), [plain(r) for r in x])
    assert ((forest.score(x) > 0.5) == y).mean() > 0.97


def test_first_split_has_the_best_gain():
    """The root of the first tree against every cut between quantile bins, tried one by one."""
    rnd = np.random.default_rng(18)
    x = rnd.normal(size=(400, 3))
    y = (x[:, 2] + 0.3 * rnd.normal(size=400) > 0.2).astype(float)
    forest = quality.fit(x, y, trees=1, depth=1)
    p = (y.sum() + 0.5) / (len(y) + 1)
    g, h = y - p, np.full(len(y), p * (1 - p))
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality.RIDGE)
    best = (-1.0, None, None)
    for f in range(3):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1])):
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) >= quality.LEAST_ROWS:
                best = max(best, (score(left) + score(~left), f, cut))
    assert (forest.feature[0, 0], forest.limit[0, 0]) == best[1:]


def test_one_text_for_each_label(spark):
    docs = frame(spark, [(1, f"text {i}") for i in range(50)] + [(2, "other"), (None, "none")])
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, quality int")
    assert abs(1 / (1 + math.exp(-quality.train(docs, labels).base)) - 0.5) < 1e-9  # one row of each


def test_credentials_and_sanitised_text(spark):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    texts = [f'x token = "{key}" y', f"API_KEY: {key}", f"tokens {key}", f'passwd="{key}" a@b.example', "secret = short", "token token token " * 4000]
    out = {r.doc_id: r for r in personal_data.find_personal_data(frame(spark, list(enumerate(texts)))).select("doc_id", personal_data.spelled(F.col("spans")).alias("s"), personal_data.sanitised(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert out[0].s.split(",")[0].startswith("secret:11:51") and key not in out[0].t and "[secret]" in out[0].t
    assert "secret:9:49" in out[1].s and "secret" not in out[2].s and out[4].s == "" and out[5].s == "" and out[5].t == texts[5]
    assert "email" in out[3].s and "[email]" in out[3].t and "[secret]" in out[3].t


def test_very_many_matches_in_one_text(spark):
    text = "é 1.2.3.4 " * 20_000
    (r,) = personal_data.find_personal_data(frame(spark, [(1, text)])).collect()
    assert [(s.start, s.end) for s in r.base] == [(10 * i + 2, 10 * i + 9) for i in range(20_000)]


@pytest.fixture(scope="module")
def small_corpus(spark, tmp_path_factory):
    """Tables for the pipeline: good and junk texts, copies under one id and others, shared lines, a leaking passage."""
    rnd = random.Random(19)
    home = tmp_path_factory.mktemp("corpus")
    sentence = lambda n: " ".join(rnd.choice(["The", "river", "runs", "past", "old", "mills", "and", "quiet", "fields", "where", "people", "walk", "home", "slowly"]) + str(rnd.randint(0, 40)) for _ in range(n)).capitalize() + "."
    item = " ".join(f"q{rnd.randint(0, 9000)}" for _ in range(30))
    good = [" ".join(sentence(12) for _ in range(8)) for _ in range(120)]
    junk = ["$$$ 123 ### " * rnd.randint(20, 60) + "!!! ???" for _ in range(80)]
    line = "Copyright of this page rests with somebody else."
    docs = [(i, t) for i, t in enumerate(good)] + [(500 + i, t) for i, t in enumerate(junk)]
    docs += [(600, good[0]), (601, good[1].replace("river", "stream", 1)), (602, f"{good[2]} {item} {good[3]}"), (603, good[4]), (603, good[4]), (603, good[5] + " tail of its own"), (604, None), (605, "")]
    docs += [(700 + i, f"{sentence(60)}\n{line}") for i in range(4)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{home}/documents.parquet")
    labels = [(i, int(i < 500), 0) for i, _ in docs if i < 600]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    return str(home)


def test_pipeline_stages_against_plain_ones(spark, small_corpus):
    """Each stage keeps from its own input exactly what a plain version keeps."""
    import corpus_pipeline as p

    rows = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    docs = spark.read.parquet(f"{small_corpus}/documents.parquet")
    stages = dict(p.STAGES)

    def run(name):
        path = scratch(spark, "stage")
        stages[name](spark, docs, small_corpus).write.parquet(path)
        return spark.read.parquet(path)

    forest = quality.train(docs, spark.read.parquet(f"{small_corpus}/labels.parquet").filter(~quality.held_out(F.col("doc_id"))))
    before = docs.collect()
    scores = forest.score(quality.statistics([r.text for r in before]))
    out = run("quality classifier")
    assert rows(out) == Counter((r.doc_id, r.text) for r, s in zip(before, scores, strict=True) if s >= 0.3)
    good = {r.doc_id for r in out.collect()}
    assert len(good & set(range(120))) >= 118 and len(good & set(range(500, 580))) <= 2
    docs = out

    held = defaultdict(set)
    for r in docs.collect():
        for x in (r.text or "").split("\n"):
            held[low(x.strip(" \t\n\x0b\x0c\r"))].add(r.doc_id)
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    want = Counter((r.doc_id, "\n".join(x for x in (r.text or "").split("\n") if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == r.doc_id)) for r in docs.collect())
    docs = run("line dedup")
    assert rows(docs) == want

    every = sorted({(r.doc_id, r.text) for r in docs.collect()})
    sets = [frozenset(bags(words(t), 5)) for _, t in every]
    root = list(range(len(every)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(every)):
        for y in range(x):
            if sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                root[find(x)] = find(y)
    groups = defaultdict(set)
    for x, row in enumerate(every):
        groups[find(x)].add(row)
    docs = run("n-gram Jaccard join")
    got = rows(docs)
    assert max(got.values()) == 1 and len(got) == len(groups)
    for members in groups.values():
        assert sum(r in got for r in members) == 1 and any(r in got for r in members if r[0] == min(m[0] for m in members))

    leaks = brute_leaks([(i, t) for i, (_, t) in enumerate(sorted(got))], [(r.item_id, r.text) for r in spark.read.parquet(f"{small_corpus}/benchmark.parquet").collect()])
    want = Counter(row for i, row in enumerate(sorted(got)) if not any(d == i for d, _ in leaks))
    docs = run("benchmark decontamination")
    assert rows(docs) == want and len(want) == len(got) - 1
    assert {r.doc_id for r in run("SentencePiece encoding and decoding").collect()} == {i for i, _ in want}


def test_unused_brute_helpers_agree():
    assert brute_katz([(1, "a b"), (2, "a")], 2)[0][2] == 3


def test_terms_through_the_filter(spark, monkeypatch):
    """More terms than are broadcast meet the words through the filter, and the same words come out."""
    rnd = random.Random(21)
    words_ = spark.createDataFrame([(rnd.randint(0, 50), f"t{rnd.randint(0, 4000)}") for _ in range(6000)], "row long, term string").cache()
    terms = spark.createDataFrame([(f"t{i}",) for i in range(0, 4000, 3)], "term string").cache()
    plain = sorted(map(tuple, personal_data._among(words_, terms).select("row", "term").collect()))
    monkeypatch.setattr(personal_data, "BROADCAST_ROWS", 10)
    assert sorted(map(tuple, personal_data._among(words_, terms).select("row", "term").collect())) == plain and plain
