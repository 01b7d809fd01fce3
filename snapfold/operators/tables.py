"""Keyed tables: latest row per key, upserts, merges, and the schemas of the snapshot database."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import Scratch

#: Columns and key of each table.
TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "parsed_outputs": ("device_name string, command string, parsed_data string, snapshot_id string, raw_output_hash string, ingested_at timestamp, platform string", ("device_name", "command", "snapshot_id")),
    "raw_output_store": ("device_name string, command string, raw_output string, snapshot_id string, updated_at timestamp, platform string, bundle_id string, bundle_sha256 string, ingested_via string", ("device_name", "command")),
    "devices": ("hostname string, ip_address string, platform string, site string, role string, vendor string, model string, os_version string, environment string, last_seen timestamp, metadata string", ("hostname",)),
    "topology_links": ("link_id string, source_device string, source_interface string, destination_device string, destination_interface string, discovery_protocol string, link_type string, link_status string, link_speed string, first_seen timestamp, last_seen timestamp, last_verified timestamp, status_changes int, snapshot_id string, platform string", ("link_id",)),
    "commands": ("platform string, command string, safe_command string, parser_type string, parser_path string, blacklisted boolean, pipe_allowed boolean, backup_only boolean, synced_at timestamp", ("platform", "command")),
    "bundle_ingests": ("bundle_id string, snapshot_id string, bundle_sha256 string, collector_name string, collector_version string, collected_at timestamp, ingested_at timestamp, ingested_by string, pre_scrubbed boolean, salt_fingerprint string, hosts_count int, commands_count int, parser_fill_summary string", ("bundle_id",)),
    "view_recipes": ("command string, concept string, vendor_hint string, field_mappings map<string,string>, filter_expr string, discovered_at timestamp", ("command", "concept", "vendor_hint")),
    "value_profile": ("view_name string, column_name string, value string, freq int, fingerprint string, cluster_id int", ("view_name", "column_name", "value")),
}


#: Rows of a table that is broadcast at most.
BROADCAST_ROWS = 200_000


def few(df: DataFrame) -> DataFrame:
    """df for broadcasting if it is small enough, else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by `order`. Ties beyond it are for the caller to break."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_place = 1").drop("_place")


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column], required: str | None = None) -> DataFrame:
    """existing with incoming laid over it: the newest row of each key stays. Incoming rows whose `required` text is blank are dropped."""
    new = incoming if required is None else incoming.filter(F.trim(F.coalesce(F.col(required), F.lit(""))) != "")
    return latest_per_key(existing.unionByName(new, allowMissingColumns=True), keys, order)


def merge_links(links: DataFrame, order: str = "seq") -> DataFrame:
    """One row per link_id: first_seen and link_type of the first sighting, all else of the last."""
    last = [F.max_by(c, order).alias(c) for c in ("snapshot_id", "discovery_protocol", "link_status")]
    return links.groupBy("link_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min_by("link_type", order).alias("link_type"), *last)


def merge_devices(existing: DataFrame, incoming: DataFrame, key: str = "hostname") -> DataFrame:
    """Column by column the incoming value, else the existing one."""
    e, i = existing.alias("e"), incoming.alias("i")
    return e.join(i, F.col(f"e.{key}") == F.col(f"i.{key}"), "full_outer").select(*[F.coalesce(F.col(f"i.{c}"), F.col(f"e.{c}")).alias(c) for c in existing.columns])


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """df with exactly the columns of a schema; missing ones are typed nulls (the additive migration)."""
    fields = df.sparkSession.createDataFrame([], ddl).schema.fields
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])


def sync_by_hash(existing: DataFrame, incoming: DataFrame, key: str, settings: Sequence[str], owner: str) -> DataFrame:
    """key and action of an incremental load: insert, update (other hash of settings and text), unchanged, or prune.

    existing has key, hash and owner; rows whose owner was scanned and whose key is gone are pruned.
    """
    digest = F.sha2(F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in settings]), 256)
    new = incoming.select(F.col(key), F.col(owner), digest.alias("new_hash"))
    scanned = new.select(F.col(owner).alias("_owner")).distinct()
    old = existing.select(F.col(key), F.col(owner).alias("old_owner"), F.col("hash").alias("old_hash"))
    joined = new.join(old, key, "full_outer").join(scanned, F.col("old_owner") == F.col("_owner"), "left")
    action = F.when(F.col("old_hash").isNull(), "insert").when(F.col("new_hash").isNull(), F.when(F.col("_owner").isNotNull(), "prune").otherwise("kept")).when(F.col("new_hash") == F.col("old_hash"), "unchanged").otherwise("update")
    return joined.select(key, action.alias("action"))


def export_backups(raw: DataFrame, commands: DataFrame, path: str) -> None:
    """Text of backup-only commands, one folder per snapshot and device, which one task writes."""
    wanted = commands.filter("backup_only").select("command").distinct()
    rows = raw.join(few(wanted), "command", "left_semi").select("snapshot_id", "device_name", F.col("raw_output").alias("value"))
    rows.repartition("snapshot_id", "device_name").write.partitionBy("snapshot_id", "device_name").text(path)


def stamp_bundle(raw: DataFrame, snapshot_id: str, bundle_id: str, sha256: str, via: str) -> DataFrame:
    """raw with the provenance of one snapshot's bundle on its rows."""
    own = F.col("snapshot_id") == snapshot_id
    values = {"bundle_id": bundle_id, "bundle_sha256": sha256, "ingested_via": via}
    return raw.withColumns({c: F.when(own, F.lit(v)).otherwise(F.col(c) if c in raw.columns else F.lit(None).cast("string")) for c, v in values.items()})


def inventory_shape(devices: DataFrame, raw: DataFrame, status: str = "active") -> DataFrame:
    """name, role, site, status, snapshot_id: devices in the shape of an inventory import, under the newest snapshot (one row)."""
    last = raw.agg(F.max("snapshot_id").alias("snapshot_id"))
    rows = devices.select(F.col("hostname").alias("name"), F.coalesce("role", F.lit("")).alias("role"), "site", F.lit(status).alias("status"))
    return rows.crossJoin(F.broadcast(last))


def export_inventory(devices: DataFrame, raw: DataFrame, path: str) -> None:
    inventory_shape(devices, raw).write.option("header", True).csv(path)


def prefer_first(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The rows of first, and those of second whose key first doesn't have; columns are aligned by name, missing ones null."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def number_rows(df: DataFrame, stored: Scratch, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with `place`: 0, 1, ... in each group of the `by` columns, in the order of the `order` columns.

    Rows are sorted by ranges over all groups, so that no task holds a group; a row's number is its place in its range after
    all rows of the ranges before, less that of the first row of its group. Equal rows get places of their own in any order.
    """
    keys = [*by, *order]
    at = stored.put(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "in-order")
    part = F.shiftrightunsigned("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = at.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))  # a row for each range
    placed = at.withColumn("_part", part).join(F.broadcast(sizes), "_part").withColumn("_all", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    first = placed.groupBy(*by).agg(F.min("_all").alias("_first"))
    return placed.join(first, list(by)).select(*df.columns, (F.col("_all") - F.col("_first")).alias("place"))
