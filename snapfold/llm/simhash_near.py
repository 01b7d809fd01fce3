"""Near-duplicates by SimHash fingerprints, found exactly through Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments of 22, 21 and 21 bits. Each segment is decoded to its nearby Golay
codewords, whose indices are its fuzzy keys: one or six, shared by segments within two bits (golay.py). Errors are placed
by pigeonhole. Of four wrong bits or fewer,
* either one segment has none, and of the other two one has two at most: key (a whole segment, a codeword index of another);
* or each has one at least, so the first has two at most and the 42 bits behind it three at most, which leave two of five
  blocks of these whole: key (a codeword index of the first segment, two whole blocks).
So any two fingerprints within four bits share one of these keys of 30 to 34 bits, about 85 for each fingerprint.

Only distinct fingerprints get keys. Those that share a key are first compared with one central member of their group, and
what that links forms components; then only members of different components are compared, in blocks, and what links them
is returned as links of components. So no group is ever laid out in pairs, whatever its size, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, pieces, strings, written
from .components import components
from .golay import codeword_indices
from .words import mix

SEED, RADIUS = 42, 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: The bits behind the first segment in five blocks.
BLOCKS = ((22, 9), (31, 9), (40, 8), (48, 8), (56, 8))
#: Members of a group that are compared with all others of it in one task at most, and rows that are held in memory.
BLOCK, HELD = 4096, 1 << 16
#: Cells of the sketch of key counts; a cell above HOT times the mean and above BLOCK is split.
CELL_BITS, HOT = 16, 8
HOT_LEAST, HOT_SHARE = 1000, 1000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64


def shingle_hashes(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every k-word shingle (repeats included, words joined by one space, A-Z in lower case) and how many each text has.

    A text of fewer words is one shingle, one without words has none.
    """
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join([b"", *raw, b""]).lower(), np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    begin, end = edge[0::2], edge[1::2]
    borders = 1 + np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    at = np.searchsorted(begin, borders)
    count = np.diff(at)
    # One space behind each word and nothing else between words.
    kept = ~space
    kept[end] = True
    plain = np.where(space, np.uint8(32), data)[kept].tobytes()
    stop = np.cumsum(end - begin + 1) - 1
    start = stop - (end - begin)
    doc = np.repeat(np.arange(len(texts)), count)
    last = np.minimum(np.arange(len(doc)) + k - 1, at[1:][doc] - 1)  # of the shingle that begins here
    first = (last - np.arange(len(doc)) == k - 1) | (np.arange(len(doc)) == at[:-1][doc]) & (count[doc] < k)
    a, b = start[first], stop[last[first]]
    out, digest = np.zeros(len(a), np.uint64), xxhash.xxh64_intdigest
    for i in range(0, len(a), HELD):
        part = slice(i, i + HELD)
        out[part] = np.fromiter((digest(plain[x:y], SEED) for x, y in zip(a[part].tolist(), b[part].tolist(), strict=True)), np.uint64, len(a[part]))
    return out, np.bincount(doc[first], minlength=len(texts))


def fingerprint(hashes: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each text, of which `many` gives its hashes: bit b is 1 where more than half of them have it; 0 without any."""
    out = np.zeros(len(many), np.uint64)
    full = np.flatnonzero(many)
    if not len(full):
        return out
    ends = np.cumsum(many[full])
    starts = ends - many[full]
    cuts = np.union1d(starts, np.arange(0, len(hashes), 1 << 15))  # so that 16 bits hold each sum
    first = np.searchsorted(cuts, starts)
    marks = np.zeros(len(full), np.uint64)
    for low in range(16):
        lanes = np.add.reduceat((hashes >> _U(low)) & _U(0x0001000100010001), cuts)
        for j in range(4):
            ones = np.add.reduceat((lanes >> _U(16 * j)) & _U(0xFFFF), first)
            marks |= (ones * _U(2) > many[full].astype(np.uint64)).astype(np.uint64) << _U(low + 16 * j)
    out[full] = marks
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        marks = fingerprint(*shingle_hashes(strings(batch.column("text")), k))
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "mark": pa.array(marks.view(np.int64))})


def golay_keys(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the fingerprints and, for each key, the place of its fingerprint."""
    part = [((marks >> _U(at)) & _U((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]
    block = [((marks >> _U(at)) & _U((1 << size) - 1)).astype(np.int64) for at, size in BLOCKS]
    fuzzy = [codeword_indices(p) for p in part]
    keys, of, rows = [], [], np.arange(len(marks))
    for kind, (i, j) in enumerate(permutations(range(3), 2)):
        index, on = fuzzy[j]
        keys.append((kind << 48 | part[i][:, None] << 12 | index)[on])
        of.append(np.broadcast_to(rows[:, None], on.shape)[on])
    index, on = fuzzy[0]
    for kind, (i, j) in enumerate(combinations(range(5), 2), 6):
        keys.append((kind << 48 | index << 18 | (block[i] << 9 | block[j])[:, None])[on])
        of.append(np.broadcast_to(rows[:, None], on.shape)[on])
    return np.concatenate(keys), np.concatenate(of)


def _cells(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys.view(np.uint64)) >> _U(64 - CELL_BITS)).astype(np.int64)


def _key_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << CELL_BITS, np.int64)
    for batch in batches:
        counts += np.bincount(_cells(golay_keys(batch.column("mark").to_numpy().view(np.uint64))[0]), minlength=len(counts))
    at = np.flatnonzero(counts)
    yield pa.record_batch({"cell": pa.array(at, pa.int32()), "n": pa.array(counts[at])})


def _keys(batches: Iterator[pa.RecordBatch], salts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = batch.column("mark").to_numpy().view(np.uint64)
        keys, of = golay_keys(marks)
        mark = marks[of]
        many = salts[_cells(keys)]
        with np.errstate(over="ignore"):
            salt = np.where(many > 1, (mix(mark) >> _U(8)).astype(np.int64) % many + 1, 0)
        yield pa.record_batch({"key": pa.array(keys), "salt": pa.array(salt.astype(np.int32)), "mark": pa.array(mark.view(np.int64))})


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))


def _central(marks: np.ndarray) -> int:
    """The mark nearest to the majority of bits."""
    own = marks.view(np.uint64)
    middle = fingerprint(own, np.array([len(own)]))
    return int(marks[np.argmin(np.bitwise_count(own ^ middle))])


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], most: int | None) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, bool]]:
    """Rows sorted by `keys`, some whole runs of equal keys at a time: columns, the places where runs begin, and whether the
    first run goes on from before. A run of more than `most` rows is given in parts (never, if most is None)."""
    held: dict[str, np.ndarray] = {}
    going = False

    def borders(cols: dict[str, np.ndarray]) -> np.ndarray:
        new = np.ones(len(cols[keys[0]]), bool)
        new[1:] = np.any([cols[k][1:] != cols[k][:-1] for k in keys], axis=0)
        return np.flatnonzero(new)

    for batch in batches:
        if not len(batch):
            continue
        cols = {n: batch.column(n).to_numpy() for n in batch.schema.names}
        if held:
            cols = {n: np.concatenate([held[n], cols[n]]) for n in cols}
        at = borders(cols)
        cut = int(at[-1])
        if cut:
            yield {n: c[:cut] for n, c in cols.items()}, at[:-1], going
            going = False
        held = {n: c[cut:] for n, c in cols.items()}
        if most is not None and len(held[keys[0]]) > most:
            # All but the last row, which shows where the run goes on.
            yield {n: c[:-1] for n, c in held.items()}, np.zeros(1, np.int64), going
            held, going = {n: c[-1:] for n, c in held.items()}, True
    if held:
        yield held, np.zeros(1, np.int64), going


def _meet(batches: Iterator[pa.RecordBatch], most: int = HELD) -> Iterator[pa.RecordBatch]:
    """Fingerprints that share a key with another (or whose key is split), each with a central one within the radius, or null."""
    for cols, at, going in _runs(batches, ("key", "salt"), most):
        mark, size = cols["mark"], np.diff(np.append(at, len(cols["mark"])))
        hub = mark[at].copy()
        for r in np.flatnonzero(size > 8).tolist():
            hub[r] = _central(mark[at[r] : at[r] + size[r]])
        kept = np.repeat(size > 1, size) | (cols["salt"] > 0)
        if going:
            kept[: size[0]] = True
        hubs = np.repeat(hub, size)
        near = (_apart(mark, hubs) <= RADIUS) & (mark != hubs)
        yield pa.record_batch({"key": pa.array(cols["key"][kept]), "mark": pa.array(mark[kept]), "hub": pa.array(hubs[kept], mask=~near[kept])})


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components that fingerprints of one group link. Rows of a group come together, in order of component."""
    for cols, at, _ in _runs(batches, ("key", "group"), None):
        mark, comp = cols["mark"], cols["comp"]
        ends = np.append(at, len(mark))
        two = np.flatnonzero(np.diff(ends) == 2)
        i = at[two]
        hit = (_apart(mark[i], mark[i + 1]) <= RADIUS) & (comp[i] != comp[i + 1])
        found = [np.stack([comp[i[hit]], comp[i[hit] + 1]], axis=1)]
        for r in np.flatnonzero(np.diff(ends) > 2).tolist():
            m, c = mark[ends[r] : ends[r + 1]], comp[ends[r] : ends[r + 1]]
            edge = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1], [True]]))
            # The largest component last: each other one is compared with what comes behind it.
            order = np.argsort(np.diff(edge), kind="stable").tolist()
            place = np.concatenate([np.arange(edge[o], edge[o + 1]) for o in order])
            m, c = m[place], c[place]
            edge = np.cumsum([0, *np.diff(edge)[order].tolist()]).tolist()
            for a, b in zip(edge[:-2], edge[1:-1], strict=True):
                near = (_apart(m[a:b, None], m[None, b:]) <= RADIUS).any(axis=0)
                other = np.unique(c[b:][near])
                if len(other):
                    found.append(np.stack([np.full(len(other), c[a]), other], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        if len(pairs):
            yield pa.record_batch({"a": pa.array(pairs[:, 0].copy()), "b": pa.array(pairs[:, 1].copy())})


def linked_fingerprints(marks: DataFrame) -> DataFrame:
    """mark, root for each distinct 64-bit `mark` within RADIUS bits of another: marks that links hold together have one root."""
    salts = np.ones(1 << CELL_BITS, np.int64)
    counts = marks.mapInArrow(_key_counts, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 2^CELL_BITS rows at most
    few = max(BLOCK, HOT * sum(r["n"] for r in counts) // len(salts))
    for r in counts:
        salts[r["cell"]] = -(-r["n"] // few)
    keyed = marks.mapInArrow(partial(_keys, salts=salts), "key long, salt int, mark long")
    met = written(keyed.repartition("key", "salt").sortWithinPartitions("key", "salt", "mark").mapInArrow(_meet, "key long, mark long, hub long"), "meetings")
    stars = components(met.filter("hub is not null").select(F.col("mark").alias("a"), F.col("hub").alias("b")))

    # Groups with two components or more. The component with the most members is the anchor: its members meet the others only.
    comp = met.select("key", "mark").join(stars.withColumnsRenamed({"node": "mark"}), "mark", "left").select("key", "mark", F.coalesce("root", "mark").alias("comp"))
    comp = written(comp, "group-members")
    by_comp = comp.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = by_comp.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("anchor"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    parts = lambda n: F.ceil(n / BLOCK).cast("long")
    mixed = mixed.select("key", F.col("anchor.comp").alias("anchor"), parts(F.col("anchor.n")).alias("ga"), parts(F.col("total") - F.col("anchor.n")).alias("go"), (F.col("total") <= BLOCK).alias("small"))
    rows = comp.join(mixed, "key").withColumn("h", F.xxhash64("mark"))
    i, j, ga, go = F.pmod("h", F.col("ga")), F.pmod("h", F.col("go")), F.col("ga"), F.col("go")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    # Group numbers: 0 for all of a small group; anchor block i with other block j; two other blocks, below 0.
    with_anchors = F.transform(upto(ga), lambda x: x * go + j + 1)
    with_others = F.transform(F.filter(upto(go), lambda x: x != j), lambda x: -(F.least(x, j) * go + F.greatest(x, j) + 1))
    groups = F.when(F.col("small"), F.array(F.lit(0).cast("long"))).when(F.col("comp") == F.col("anchor"), F.transform(upto(go), lambda x: i * go + x + 1)).otherwise(F.concat(with_anchors, with_others))
    blocks = rows.select("key", F.explode(groups).alias("group"), "mark", "comp")
    links = blocks.repartition("key", "group").sortWithinPartitions("key", "group", "comp").mapInArrow(_cross, "a long, b long")
    joined = components(links)
    nodes = met.select(F.col("mark")).distinct().join(stars.withColumnsRenamed({"node": "mark", "root": "star"}), "mark", "left").withColumn("star", F.coalesce("star", "mark"))
    out = nodes.join(joined.withColumnsRenamed({"node": "star"}), "star", "left").select("mark", F.coalesce("root", "star").alias("root"))
    out = written(out, "linked-marks")
    discard(met, comp)
    return out


def simhash_components(docs: DataFrame, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for each row: the smallest id reachable over links, its own included.

    Documents link when their SimHash fingerprints over k-word shingles differ in RADIUS bits at most (bits set in more
    than half of the shingles' hashes). Texts without words, null and empty ones have fingerprint 0 and link like any
    other; a text of fewer than k words is one shingle. Rows that repeat an id or a text are rows of their own; a null id
    names a component only if nothing else is in it. Other columns are not read. An empty table gives no rows.

    A fingerprint of more than its share of all rows (one in HOT_SHARE, so there are fewer than HOT_SHARE of them) is
    broadcast with its component: its rows stay where they are.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(texts.mapInArrow(partial(_fingerprints, k=k), "doc_id long, mark long"), "fingerprints")
    marks = written(signed.groupBy("mark").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least"), F.count(F.lit(1)).alias("rows")), "marks")
    roots = marks.join(linked_fingerprints(marks.select("mark")), "mark", "left").select("mark", "least", "rows", F.coalesce("root", "mark").alias("root"))
    names = roots.groupBy("root").agg(F.min("least").alias("name"))
    named = written(roots.join(names, "root").select("mark", "rows", F.col("name.doc_id").alias("component_id")), "named-marks")
    large = F.col("rows") > max(HOT_LEAST, signed.count() // HOT_SHARE)
    hot, rest = F.broadcast(named.filter(large).drop("rows")), named.filter(~large).drop("rows")
    out = signed.join(hot, "mark").unionByName(signed.join(hot.select("mark"), "mark", "left_anti").join(rest, "mark"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")
