"""The graph operators over links as they are: all of them, several components, long chains; brute force."""

import random
from collections import defaultdict, deque
from itertools import combinations

import pandas as pd
from compare import SF
from pyspark.sql import functions as F

from snapfold.operators import topology
from snapfold.plans.fixtures import model


def brute_bfs(nodes, edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    left, out = set(nodes), set()
    while left:
        comp, queue = set(), deque([min(left)])
        while queue:
            n = queue.popleft()
            if n not in comp:
                comp.add(n)
                queue.extend(near[n])
        root = min(comp, key=lambda n: (-len(near[n]), n))
        depth, levels, queue = {root: 0}, defaultdict(int), deque([root])
        while queue:
            n = queue.popleft()
            out.add((n, root, depth[n], levels[depth[n]]))
            levels[depth[n]] += 1
            for m in sorted(near[n]):
                if m not in depth:
                    depth[m] = depth[n] + 1
                    queue.append(m)
        left -= comp
    return out


def test_bfs_has_no_depth_limit(spark):
    edges = [(f"c{i:02}", f"c{i + 1:02}") for i in range(54)] + [("c00", "x1"), ("c00", "x2"), ("x2", "a1"), ("x1", "z1")] + [("t1", "t2"), ("t2", "t3"), ("t3", "t1")]
    nodes = sorted({n for e in edges for n in e} | {"alone"})
    got = topology.bfs_levels(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "src string, dst string"))
    rows = [(r.node, r.root, r.depth, r.slot) for r in got.collect()]
    assert len(rows) == len(nodes) and set(rows) == brute_bfs(nodes, edges) and max(r[2] for r in rows) == 54


def test_edges_are_all_links(spark):
    lines = pd.read_parquet(f"{SF}/lineitem.parquet", columns=["l_orderkey", "l_linenumber", "l_suppkey"])
    after = lines.assign(l_linenumber=lines.l_linenumber - 1)
    both = lines.merge(after, on=["l_orderkey", "l_linenumber"])
    want = {(f"r{min(a, b)}", f"r{max(a, b)}") for a, b in zip(both.l_suppkey_x, both.l_suppkey_y, strict=True) if a != b}
    got = [(r.src, r.dst) for r in model(spark, SF, "edges").collect()]
    assert len(got) == len(want) and set(got) == want


def test_blast_radius_of_components(spark):
    edges = [("a", "b"), ("b", "c"), ("b", "d"), ("d", "e"), ("x", "y"), ("y", "z"), ("z", "x")]
    nodes = spark.createDataFrame([(n,) for n in "abcdexyzo"], "node string")
    scenarios = spark.createDataFrame([("1", "b"), ("2", "y"), ("2", "d")], "scenario string, device string")
    got = topology.blast_radius(nodes, spark.createDataFrame(edges, "src string, dst string"), scenarios)
    assert {tuple(r) for r in got.select("scenario", "components", "largest", "isolated").collect()} == {("1", 5, 3, 3), ("2", 4, 3, 2)}


def test_components_read_their_links_once(spark, monkeypatch):
    """Chains, hubs and unknown nodes, with keys; every round after the first one has fewer links."""
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(200)]
    comb = [(f"{'z' if i % 2 else 'd'}{i // 2:03}", f"{'d' if i % 2 else 'z'}{(i + 1) // 2:03}") for i in range(60)]
    hub = [("zz", f"h{i}") for i in range(30)]
    edges = [(k, a, b) for k in (1, 2) for a, b in chain + comb + hub if k == 1 or a != "c100"] + [(1, "c000", "unknown"), (1, "unknown", "h1"), (1, "h2", "h2")]
    nodes = sorted({(k, n) for k, a, b in edges for n in (a, b) if n != "unknown"} | {(k, "alone") for k in (1, 2)})
    sizes, put = [], topology.Scratch.put
    monkeypatch.setattr(topology.Scratch, "put", lambda self, df, name: (out := put(self, df, name), sizes.append(out.count()) if name == "pairs" else None)[0])
    got = topology.connected(spark, spark.createDataFrame(nodes, "k int, node string"), spark.createDataFrame(edges, "k int, src string, dst string"), ["k"])
    rows = {(r.k, r.node): r.root for r in got.collect()}
    want = {(k, n): min(c) for k in (1, 2) for c in parts_of([(a, b) for kk, a, b in edges if kk == k and "unknown" not in (a, b)], [n for kk, n in nodes if kk == k]) for n in c}
    assert rows == want and len(sizes) > 1 and sizes[-1] == 0 and all(a > b for a, b in zip(sizes, sizes[1:]))


def parts_of(edges, nodes):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    left, out = set(nodes), []
    while left:
        comp, queue = set(), deque([min(left)])
        while queue:
            n = queue.popleft()
            if n not in comp:
                comp.add(n)
                queue.extend(near[n])
        out.append(comp)
        left -= comp
    return out


def brute_radius(nodes, edges, down, cut):
    before, out = parts_of(edges, nodes), set()
    for s in {s for s, *_ in down + cut}:
        gone, lost = {d for k, d in down if k == s}, {frozenset(e) for k, *e in cut if k == s}
        after = parts_of([e for e in edges if frozenset(e) not in lost and not gone & set(e)], [n for n in nodes if n not in gone])
        out.add((s, len(after), max(map(len, after)), sum(len(c) == 1 for c in after), len(before), max(map(len, before))))
    return out


def radius(spark, nodes, edges, down, cut):
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    out = topology.blast_radius(frame([(n,) for n in nodes], "node string"), frame(edges, "src string, dst string"), frame(down, "scenario string, device string"), frame(cut, "scenario string, src string, dst string"))
    return {tuple(r) for r in out.collect()}


def test_blast_radius_takes_up_a_part_of_many_links(spark, monkeypatch):
    """Three dense blobs in one component, joined by a node, by one link and with a tail; scenarios do not lay out all links."""
    rnd = random.Random(5)
    blobs = [[f"{b}{i:02}" for i in range(60)] for b in "abc"]
    edges = [e for blob in blobs for e in combinations(blob, 2) if rnd.random() < 0.9]
    edges += [("x", "a00"), ("x", "a01"), ("b00", "x"), ("b05", "c05"), ("c09", "t0"), ("t0", "t1"), ("t1", "t2"), ("o", "p"), ("p", "o"), ("q", "q")]
    nodes = sorted({n for e in edges for n in e})
    down = [("node", "x"), ("tail", "c09"), ("half", "b05"), *[("half", n) for n in blobs[0][:50]], ("unknown", "nobody"), ("mixed", "t1")]
    cut = [("link", "c05", "b05"), ("mixed", "b05", "c05"), ("mixed", "b00", "x"), *[("all of one", a, b) for a, b in edges if "c30" in (a, b)], ("pair", "o", "p")]
    sizes, put = [], topology.Scratch.put
    monkeypatch.setattr(topology.Scratch, "put", lambda self, df, name: (out := put(self, df, name), sizes.append(out.count()) if "scenario" in df.columns else None)[0])
    assert radius(spark, nodes, edges, down, cut) == brute_radius(nodes, edges, down, cut)
    assert max(sizes) < 2 * len(edges)  # six scenarios touch nearly all of them
    assert len(edges) > topology.MANY_LINKS * len(nodes)


def test_blast_radius_with_any_first_links(spark, monkeypatch):
    """What is found first says where to begin only: no links and some of them give the same."""
    rnd = random.Random(8)
    nodes = [f"n{i:02}" for i in range(40)]
    edges = sorted({tuple(sorted(rnd.sample(nodes, 2))) for _ in range(45)})
    down, cut = [("1", nodes[0]), ("1", nodes[9]), ("2", nodes[3])], [("2", *edges[5]), ("3", *edges[7]), ("3", *edges[8])]
    for share in (0, 1):
        monkeypatch.setattr(topology, "first_links", lambda pairs, nodes, share=share: pairs.filter(F.pmod(F.xxhash64("src", "dst"), F.lit(2)) < share))
        assert radius(spark, nodes, edges, down, cut) == brute_radius(nodes, edges, down, cut), share
