"""Set-similarity join of documents on word shingles: rare-first prefix filtering with length, positional and suffix filters.

Documents of one shingle set are one class. The prefix of a class are its rarest shingles, so many that two classes within
the limit share one; shingle counts come from a sketch of fixed size over the whole corpus, which orders shingles alike
everywhere (any order gives exact results, a good one few candidates). Classes meet on prefix shingles. A class is first
checked against one central class that it shares a shingle with; what that links is one component, and only pairs that lie
in different components, pass all filters and have not been checked remain. Each is verified once, on whole texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, pieces, strings, written
from .components import components
from .words import shingle_sets

SKETCH_BITS, SLICE_BITS = 18, 12
#: Rows of a broadcast at most, and pairs of one class in a block.
BROADCAST_ROWS, BLOCK = 250_000, 256


def _sketch(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in pieces(batches, "text"):
        hashes, _ = shingle_sets(strings(batch.column("text")), k)
        counts += np.bincount((hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
    if counts.any():
        slices = counts.reshape(-1, 1 << SLICE_BITS).astype("<i8")
        yield pa.RecordBatch.from_arrays([pa.array(range(len(slices)), pa.int32()), pa.array([s.tobytes() for s in slices], pa.binary())], names=["slice", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, raw in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            sums[s] = sums.get(s, 0) + np.frombuffer(raw, "<i8")
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["slice", "counts"])


def shingle_sketch(docs: DataFrame, k: int) -> np.ndarray:
    """For each of 2^SKETCH_BITS cells of the hash space, the documents' distinct shingles in it, over the whole corpus.

    Each task sends one sketch; slices of them are summed by executors. The result, of fixed size, comes to the driver.
    """
    schema = "slice int, counts binary"
    parts = docs.select("text").mapInArrow(partial(_sketch, k=k), schema)
    rows = parts.repartition("slice").mapInArrow(_add, schema).collect()  # 2^SKETCH_BITS numbers
    out = np.zeros((1 << (SKETCH_BITS - SLICE_BITS), 1 << SLICE_BITS), np.int64)
    for r in rows:
        out[r["slice"]] += np.frombuffer(r["counts"], "<i8")
    return out.ravel()


def _lanes(own: np.ndarray) -> tuple[int, int]:
    """How many shingles lie in each of 16 parts of the hash space, 255 at most, as two numbers of 8 bytes."""
    counts = np.minimum(np.bincount((own & np.uint64(15)).astype(np.int64), minlength=16), 255).astype(np.uint8)
    return tuple(np.frombuffer(counts.tobytes(), "<i8").tolist())


def _signatures(batches: Iterator[pa.RecordBatch], k: int, percent: int, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        hashes, at = shingle_sets(strings(batch.column("text")), k)
        rank = sketch[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
        sizes, sets, lows, highs, prefixes = [], [], [], [], []
        for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
            own, n = hashes[a:b], b - a
            sizes.append(n)
            sets.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if n else None)
            low, high = _lanes(own)
            lows.append(low)
            highs.append(high)
            short = n - -(-percent * n // 100) + 1 if n else 0
            order = np.argsort(rank[a:b], kind="stable")[:short]
            prefixes.append(own[order].view(np.int64))
        ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
        prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row"), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(lows, pa.int64()), pa.array(highs, pa.int64()), prefix],
            names=["doc_id", "row", "n", "cls", "low", "high", "prefix"],
        )


def _may_link(a: str, b: str, percent: int) -> Column:
    """Length, positional and suffix filters for rows a and b that share a prefix shingle."""
    c = lambda side, name: F.col(f"{side}_{name}")
    na, nb = c(a, "n"), c(b, "n")
    long_enough = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent
    # If this is the first shared shingle, the overlap is 1 and at most what follows in either; else the pair meets at the first.
    most = F.least(na - c(a, "pos"), nb - c(b, "pos"))
    overlap = most * (100 + percent) >= (na + nb) * percent
    # Shingles of one part of the hash space match only there, so counts that differ are shingles that don't match.
    lane = lambda side, half, i: F.shiftrightunsigned(c(side, half), 8 * i).bitwiseAND(255)
    apart = sum((F.abs(lane(a, h, i) - lane(b, h, i)) for h in ("low", "high") for i in range(8)), F.lit(0))
    return long_enough & overlap & ((na + nb - apart) * (100 + percent) >= (na + nb) * 2 * percent)


def _named(df: DataFrame, side: str, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in keys])


def _blocks(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come block by block, the text b that all are compared with first; its set is kept, each other text is met once."""
    block, held = None, np.zeros(0, np.uint64)
    for batch in pieces(batches, "text"):
        sets, at = shingle_sets(strings(batch.column("text")), k)
        a, b, salt = (batch.column(c).to_numpy() for c in ("cid", "b", "salt"))
        out, linked = [], []
        for i in range(len(a)):
            own = sets[at[i] : at[i + 1]]
            if a[i] == b[i]:
                block, held = (b[i], salt[i]), own.copy()
                continue
            if block != (b[i], salt[i]):
                raise ValueError("a block without its first text")
            both = len(np.intersect1d(own, held, assume_unique=True))
            out.append(i)
            linked.append(100 * both >= percent * (len(own) + len(held) - both))
        yield pa.record_batch({"a": pa.array(a[out]), "b": pa.array(b[out]), "linked": pa.array(linked, pa.bool_())})


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b, linked for each pair of classes, a written table. Only texts of classes in a pair are moved, once for each pair.

    The pairs of one b are cut into blocks of about BLOCK, so that no class gathers all its partners in one task; b's own
    text goes to each of its blocks.
    """
    pairs = written(pairs, "pairs")
    many = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    salted = pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("salt"))
    members = salted.select(F.col("a").alias("cid"), "b", "salt").unionByName(salted.select(F.col("b").alias("cid"), "b", "salt").distinct())
    placed = written(members.join(classes.select("cid", "rep", "rep_row"), "cid"), "pair-members")
    few = F.broadcast(placed) if placed.count() <= BROADCAST_ROWS else placed
    rows = docs.withColumn("row", F.xxhash64("text"))
    texts = rows.join(few, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("row") == F.col("rep_row"))).select("cid", "b", "salt", "text")
    ordered = texts.repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("cid") != F.col("b"))
    out = written(ordered.mapInArrow(partial(_blocks, k=k, percent=percent), "a long, b long, linked boolean"), "checked-pairs")
    discard(pairs, placed)
    return out


def near_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs: the smallest id reachable over links, its own included.

    Two documents link when 100 * shared >= percent * all of their distinct k-word shingles (A-Z in lower case, words
    between ASCII white space; a text of fewer words is one shingle). Null, empty and white texts have no shingles and
    link with nothing: component_id is their own id. Rows of one id are joined by their texts like other rows; a null id
    is named as a component only if nothing else is in it. Other columns are not read. An empty table gives no rows.
    """
    out = near_rows(docs, k, percent, id_col, text_col)
    return out.select("doc_id", "n_shingles", "component_id")


def near_rows(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """near_components() with two more columns: row, the hash of the row's text, and kept.

    kept is true for the rows that stand for their component: those of its smallest id and, where that id has several
    texts in it, of the least hash among them. Rows without shingles stand for themselves.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketch = shingle_sketch(texts, k)
    schema = "doc_id long, row long, n long, cls binary, low long, high long, prefix array<long>"
    signed = written(texts.withColumn("row", F.xxhash64("text")).mapInArrow(partial(_signatures, k=k, percent=percent, sketch=sketch), schema), "signatures")
    first = F.min(F.struct("doc_id", "row"))
    classes = signed.filter("cls is not null").groupBy("cls").agg(first.alias("r"), F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")).alias("least"), *[F.first(c).alias(c) for c in ("n", "low", "high", "prefix")])
    # Classes get a number of 8 bytes as they are written, which stands for them from here on.
    bucket = F.floor(F.log(F.col("n")) / F.lit(math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1.0)).cast("int")
    classes = written(classes.select(F.monotonically_increasing_id().alias("cid"), "cls", F.col("r.doc_id").alias("rep"), F.col("r.row").alias("rep_row"), "least", "n", "low", "high", bucket.alias("bucket"), "prefix"), "classes")
    tokens = classes.select("cid", F.posexplode("prefix").alias("pos", "token"))

    # Shingles that two classes share; only the shingles themselves are counted, so those of one class are dropped as narrow rows.
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("token")
    met = tokens.join(shared, "token", "left_semi").join(classes.select("cid", "n", "low", "high", "bucket"), "cid")
    meeting = written(met.select("token", "bucket", "cid", "n", "pos", "low", "high"), "meetings")
    # The most central class of each shingle and length: the one with the fewest rarer shingles.
    central = meeting.groupBy("token", "bucket").agg(F.min(F.struct("pos", "cid", "n", "low", "high")).alias("hub"))
    hubs = central.select("token", "bucket", *[F.col(f"hub.{c}").alias(f"b_{c}") for c in ("cid", "n", "pos", "low", "high")])
    star = _named(meeting, "a", "token", "bucket").join(hubs, ["token", "bucket"]).filter((F.col("a_cid") != F.col("b_cid")) & _may_link("a", "b", percent))
    star = star.groupBy("a_cid").agg(F.min(F.struct("b_pos", "b_cid")).alias("hub")).select(F.col("a_cid").alias("a"), F.col("hub.b_cid").alias("b"))
    tried = _verified(star, classes, texts, k, percent)
    links = tried.filter("linked").select("a", "b")
    roots = components(links)

    # What is left: pairs of different components that meet on a shingle, pass the filters and were not tried. Partners lie in
    # one length bucket or in neighbouring ones; the shorter class goes to its own and the next, so a shingle is split by length.
    placed = meeting.join(roots.withColumnsRenamed({"node": "cid"}), "cid", "left").withColumn("comp", F.coalesce("root", "cid")).drop("root")
    mixed = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    open_rows = written(placed.join(mixed, "token", "left_semi"), "open-meetings")
    a = _named(open_rows.withColumn("bucket", F.explode(F.array("bucket", F.col("bucket") + 1))), "a", "token", "bucket")
    b = _named(open_rows, "b", "token", "bucket")
    apart = (F.struct("a_n", "a_cid") < F.struct("b_n", "b_cid")) & (F.col("a_comp") != F.col("b_comp"))
    rest = a.join(b, ["token", "bucket"]).filter(apart & _may_link("a", "b", percent)).select(F.col("a_cid").alias("a"), F.col("b_cid").alias("b")).distinct()
    known = tried.select("a", "b").unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    checked = _verified(rest.join(known, ["a", "b"], "left_anti"), classes, texts, k, percent)
    roots = components(links.union(checked.filter("linked").select("a", "b")))
    discard(meeting, open_rows, tried, checked)

    member = classes.select("cid", "cls", "least").join(roots.withColumnsRenamed({"node": "cid"}), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    names = member.groupBy("root").agg(F.min("least").alias("name"))
    named = member.join(names, "root").select("cls", "name")
    none = F.col("cls").isNull()
    chosen = F.col("doc_id").eqNullSafe(F.col("name.doc_id")) & (F.col("row") == F.col("name.row"))
    return signed.select("doc_id", "row", "n", "cls").join(named, "cls", "left").select(
        "doc_id", "row", F.col("n").alias("n_shingles"), F.when(none, F.col("doc_id")).otherwise(F.col("name.doc_id")).alias("component_id"), (none | chosen).alias("kept")
    )
