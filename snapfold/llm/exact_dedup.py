"""Exact duplicates by content-defined chunk recipes.

A text is cut where a rolling hash of its last 16 bytes says so, hence equal texts are cut alike. Each chunk gets a keyed
digest as its identifier. Identifiers are verified first: the distinct chunks of the whole corpus are brought together by
content, and if any digest stands for two contents, longer digests are taken for all. Then a document is its ordered list
of identifiers, and only lists are compared and moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, written

WINDOW, LEAST, MEAN_BITS, MOST = 16, 1024, 12, 16384
#: Digest lengths in bytes, tried in turn until no two contents share a digest.
DIGESTS = (16, 32, 64)
#: A group of more than one row in HOT_SHARE, HOT_LEAST rows and at most HOT_CHUNKS chunks is broadcast: 64 MB of recipes at most.
HOT_SHARE, HOT_LEAST, HOT_CHUNKS = 1000, 64, 4096
_TABLE = np.random.default_rng(20240131).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte, the hash of the WINDOW bytes that end there (fewer at the start), by doubling."""
    h, width = _TABLE[data], 1
    while width < WINDOW:
        g = h.copy()
        g[width:] += h[:-width] << np.uint32(width)
        h, width = g, 2 * width
    return h


def cuts(buffer: np.ndarray, offsets: Sequence[int]) -> Iterator[list[int]]:
    """For each text in the buffer the ends of its chunks. A chunk has LEAST to MOST bytes, but for the last."""
    at = np.flatnonzero(rolling(buffer) >> np.uint32(32 - MEAN_BITS) == 0) + 1
    for a, b in zip(offsets, offsets[1:], strict=False):
        ends: list[int] = []
        start = a
        if b - a > LEAST:
            for c in at[np.searchsorted(at, a + LEAST) : np.searchsorted(at, b)].tolist():
                while c - start > MOST:
                    start += MOST
                    ends.append(start)
                if c - start >= LEAST:
                    ends.append(c)
                    start = c
        while b - start > MOST:
            start += MOST
            ends.append(start)
        if b > start:
            ends.append(b)
        yield ends


def _buffer(column: pa.Array) -> tuple[bytes, list[int]]:
    parts = [(x or "").encode() for x in column.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return b"".join(parts), offsets.tolist()


def _id(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", 4 << 20):
        data, offsets = _buffer(batch.column("text"))
        seen = set()
        for a, ends in zip(offsets, cuts(np.frombuffer(data, np.uint8), offsets), strict=False):
            for b in ends:
                seen.add(data[a:b])
                a = b
        out = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([_id(c, size) for c in out], pa.binary()), pa.array(out, pa.binary())], names=["chunk_id", "content"])


def _recipes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", 4 << 20):
        data, offsets = _buffer(batch.column("text"))
        recipes, digests = [], []
        for a, z, ends in zip(offsets, offsets[1:], cuts(np.frombuffer(data, np.uint8), offsets), strict=False):
            digests.append(hashlib.sha256(data[a:z]).hexdigest())
            own = []
            for b in ends:
                own.append(_id(data[a:b], size))
                a = b
            recipes.append(own)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(recipes, pa.list_(pa.binary())), pa.array(digests, pa.string())], names=["doc_id", "recipe", "text_sha256"])


def verified_size(texts: DataFrame, sizes: Sequence[int] = DIGESTS) -> int:
    """The first digest length under which every identifier stands for one content, over all chunks of all texts.

    Equal chunks meet before the exchange (in a batch, then in the task), so a chunk that very many texts share moves
    once from each task; its content moves nowhere else.
    """
    for size in sizes:
        chunks = texts.select("text").mapInArrow(partial(_chunks, size=size), "chunk_id binary, content binary").distinct()
        if chunks.groupBy("chunk_id").count().filter("count > 1").isEmpty():
            return size
    raise ValueError("no digest length keeps the chunks apart")


def exact_duplicates(docs: DataFrame, normal: F.Column | None = None, id_col: str = "doc_id", text_col: str = "text", sizes: Sequence[int] = DIGESTS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the largest doc_id stays.

    `normal` is the text to compare, as a Column (default: the text as it is). Null counts as empty; empty texts equal one
    another. Rows with the same id and text are copies: one of them is kept. A null id is below all others; keep_id is
    null only where a group has no other id. Other columns are not read.

    Recipes are written once. Groups are summed up before they meet, and a group with more than its share of all rows
    (one in HOT_SHARE, so there are fewer than HOT_SHARE of them) is broadcast: its rows stay where they are.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(text_col) if normal is None else normal).alias("text"))
    size = verified_size(texts, sizes)
    recipes = written(texts.mapInArrow(partial(_recipes, size=size), "doc_id long, recipe array<binary>, text_sha256 string"), "recipes")
    rows = recipes.groupBy("recipe", "doc_id").agg(F.count(F.lit(1)).alias("copies"), F.first("text_sha256").alias("text_sha256"))
    groups = written(recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "recipe-groups")
    large = (F.col("group_size") > max(HOT_LEAST, recipes.count() // HOT_SHARE)) & (F.size("recipe") <= HOT_CHUNKS)
    hot = F.broadcast(groups.filter(large))
    out = rows.join(hot, "recipe").unionByName(rows.join(hot.select("recipe"), "recipe", "left_anti").join(groups.filter(~large), "recipe"))
    out = out.withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")
