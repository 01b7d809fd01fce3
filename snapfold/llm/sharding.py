"""Weighted rendezvous hashing of stable record keys over shards, in DataFrame functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_A_CELL = 100_000
MOST_CELLS = 4096


def _cost(key: Column, shard: Column, weight: Column) -> Column:
    """-ln(u) / weight for u in (0, 1) from the hash of key and shard: the shard of least cost wins, in proportion to its weight."""
    u = (F.shiftrightunsigned(F.xxhash64(key, shard), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / weight


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, 0 to len(weights) - 1, of the key. Shards of weight 0 or less get nothing.

    Adding a shard moves keys only into it, removing one moves only its keys, as each key keeps its order of the others.
    A null key is a key like any other.
    """
    on = [(i, float(w)) for i, w in enumerate(weights) if w > 0]
    if not on:
        raise ValueError("no shard has a weight above 0")
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(w).alias("weight")) for i, w in on])
    costs = F.transform(shards, lambda s: F.struct(_cost(key, s["shard"], s["weight"]).alias("cost"), s["shard"].alias("shard")))
    return F.array_min(costs)["shard"]


def number_slots(df: DataFrame, shards: int, tie: Sequence[str], rows: int | None = None) -> DataFrame:
    """Adds slot: 0, 1, ... without gaps in each shard of column `shard`.

    No shard is numbered in one task: it is cut into cells by a hash of the `tie` columns, cells are counted, and a row's
    slot is its place in the cell after all rows of the cells before. Offsets are shards x cells rows, MOST_CELLS a shard.
    """
    rows = df.count() if rows is None else rows
    cells = max(1, min(MOST_CELLS, -(-rows // (max(1, shards) * ROWS_A_CELL))))
    df = df.withColumn("_cell", F.pmod(F.xxhash64(F.lit(7), *tie), F.lit(cells)))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("_n")).select("shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("shard", "_cell").orderBy(*tie)) - 1
    return df.withColumn("_place", place).join(F.broadcast(offsets), ["shard", "_cell"]).withColumn("slot", F.col("_offset") + F.col("_place")).drop("_cell", "_place", "_offset")


def _placed(docs: DataFrame, weights: Sequence[float], grown: float, id_col: str, text_col: str, carry: Sequence[str] = ()) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col).cast("long")
    kept = [F.col(c).alias(f"_carry_{i}") for i, c in enumerate(carry)]
    base = docs.select(key.alias("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"), *kept)
    placed = base.withColumn("shard", rendezvous(F.col("doc_id"), weights)).withColumn("grown_shard", rendezvous(F.col("doc_id"), [*weights, grown]))
    return number_slots(placed, len(weights), ["doc_id", "text_crc32", "size"], rows=docs.count())


def shard_documents(docs: DataFrame, weights: Sequence[float], grown: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('key'), shard, slot, grown_shard (with one more shard, of weight `grown`) for each row.

    Null text has no bytes (size 16, crc 0); a null id is a key of its own; repeated rows go to one shard, each with its
    own slot. Other columns are not read, so no name can clash. An empty table gives no rows.
    """
    out = _placed(docs, weights, grown, id_col, text_col)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, weights: Sequence[float], path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Every row of docs, whole, in one folder per shard with its `slot`; rows of a shard lie in slot order within each file.

    Rows keep all their columns (a column named shard or slot gives way to these); repeated rows and null ids are written
    like all others.
    """
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    out = _placed(docs, weights, 1.0, id_col, text_col, names).select(*[F.col(f"_carry_{i}").alias(c) for i, c in enumerate(names)], "shard", "slot")
    out.repartition("shard", F.floor(F.col("slot") / ROWS_A_CELL)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
