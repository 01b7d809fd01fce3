"""Views over parsed outputs: explosion, metadata, profiles, recipes."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.network import fingerprint
from .layers import l2_links


def latest_snapshots(df: DataFrame) -> DataFrame:
    """Rows of the latest snapshot of each device and command. One shuffle, no join."""
    newest = F.max("snapshot_id").over(Window.partitionBy("device_name", "command"))
    return df.withColumn("_newest", newest).filter("snapshot_id = _newest").drop("_newest")


def element_type(parsed: DataFrame) -> dict[str, str]:
    """For each command whose parsed_data are lists of objects the merged element type, over all rows."""
    shapes = parsed.groupBy("command").agg(F.expr("schema_of_variant_agg(try_parse_json(parsed_data))").alias("shape"))
    rows = shapes.filter(F.col("shape").rlike("^ARRAY<OBJECT<")).collect()  # a row for each command
    return {r["command"]: r["shape"] for r in rows}


def explode_parsed(parsed: DataFrame, fields: Iterable[str], latest: bool = True) -> DataFrame:
    """device_name, snapshot_id and one typed row per parsed record. Fields are text; what is no list gives no rows."""
    schema = "array<struct<" + ",".join(f"`{f}`:string" for f in fields) + ">>"
    rows = latest_snapshots(parsed) if latest else parsed
    return rows.select("device_name", "snapshot_id", F.inline(F.from_json("parsed_data", schema)))


# Variant type names and the column types that stand for them.
TYPES = {"BIGINT": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean", "STRING": "string", "VOID": "string"}


def _fields(shape: str) -> list[tuple[str, str]]:
    """(name, type) of the top-level fields of an OBJECT<...> shape."""
    out, depth, start = [], 0, 0
    inner = shape[len("OBJECT<") : -1]
    for i, c in enumerate(inner + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            name, _, kind = inner[start:i].strip().partition(": ")
            out += [(name.strip("`"), kind)] if name else []
            start = i + 1
    return out


def flat_columns(shape: str, path: str = "$") -> list[tuple[str, str, str]]:
    """(column, JSON path, type) of an object's fields, those of nested objects as outer_inner; lists stay JSON text."""
    out = []
    for name, kind in _fields(shape):
        at = f"{path}['{name}']"
        if kind.startswith("OBJECT<"):
            out += [(f"{name}_{c}", p, t) for c, p, t in flat_columns(kind, at)]
        else:
            out.append((name, at, TYPES.get(kind, "decimal(38,10)" if kind.startswith("DECIMAL") else "string")))
    return out


def typed_view(parsed: DataFrame, shape: str) -> DataFrame:
    """device_name, snapshot_id and the typed columns of one command's parsed lists, for the newest snapshot of each device."""
    rows = latest_snapshots(parsed).select("device_name", "snapshot_id", F.expr("try_parse_json(parsed_data)").alias("v"))
    each = rows.filter("schema_of_variant(v) like 'ARRAY<%'").select("device_name", "snapshot_id", F.explode(F.expr("cast(v as array<variant>)")).alias("o"))
    names = [c for c, _, _ in flat_columns(shape)]
    taken = {"device_name", "snapshot_id"}
    columns = [F.try_variant_get("o", p, t).alias(c if c.lower() not in taken and names.count(c) == 1 else f"{c}_{i}") for i, (c, p, t) in enumerate(flat_columns(shape))]
    return each.select("device_name", "snapshot_id", *columns)


def build_views(parsed: DataFrame) -> dict[str, DataFrame]:
    """v_<command>_auto for every command whose outputs hold lists of objects, with columns and types found in all its rows.

    One aggregate finds all shapes (a row for each command comes to the driver); the views themselves are plans, not tables.
    """
    out = {}
    for command, shape in element_type(parsed).items():
        out[f"v_{view_slug(command)}_auto"] = typed_view(parsed.filter(F.col("command") == command), shape[len("ARRAY<") : -1])
    return out


def view_slug(command: str) -> str:
    return re.sub("[^a-z0-9_]+", "_", command.strip().lower()).strip("_")


def snapshot_metadata(parsed: DataFrame) -> DataFrame:
    """Per snapshot: first and last ingestion, devices, rows, seconds; the id's own date where no time was written."""
    named = F.try_to_timestamp(F.substring("snapshot_id", 6, 15), F.lit("yyyyMMdd_HHmmss")).cast("timestamp_ntz")
    out = parsed.groupBy("snapshot_id").agg(F.min("ingested_at").alias("started"), F.max("ingested_at").alias("ended"), F.count_distinct("device_name").alias("devices"), F.count(F.lit(1)).alias("outputs"))
    seconds = (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1e6
    return out.select("snapshot_id", F.coalesce("started", named).alias("captured_at"), "devices", "outputs", seconds.alias("duration_s"))


# Columns that name things, whose values are not worth a profile.
NAMING_COLUMNS = [
    "device_name", "hostname", "snapshot_id", "ip_address", "address", "neighbor_ip", "router_id", "mac_address", "hardware_address", "physical_address", "interface", "local_interface",
    "neighbor_interface", "port", "name", "neighbor_name", "platform_id", "platform", "vlan_id", "neighbor_id", "prefix", "network", "next_hop",
]


def _long(view: DataFrame, name: str, columns: Iterable[str]) -> DataFrame:
    values = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return view.select(F.lit(name).alias("view_name"), F.inline(values)).filter("value is not null")


def _profile(long: DataFrame, max_cardinality: int, mode: str) -> DataFrame:
    counts = long.groupBy("view_name", "column_name", "value").agg(F.count(F.lit(1)).alias("freq"))
    few = counts.groupBy("view_name", "column_name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= max_cardinality).select("view_name", "column_name")
    marked = counts.join(F.broadcast(few), ["view_name", "column_name"]).withColumn("fingerprint", fingerprint(F.col("value"), mode))  # a row for each column
    cluster = F.dense_rank().over(Window.partitionBy("view_name", "column_name").orderBy("fingerprint"))
    return marked.select("view_name", "column_name", "value", "freq", "fingerprint", cluster.alias("cluster_id"))


def value_profile(view: DataFrame, name: str, columns: Iterable[str], max_cardinality: int = 30, mode: str = "documented") -> DataFrame:
    """Frequency, fingerprint and cluster of each value of the columns that have few distinct ones, in one pass over the view."""
    return _profile(_long(view, name, list(columns)), max_cardinality, mode)


def profile_views(views: dict[str, DataFrame], max_cardinality: int = 30, mode: str = "documented", skip: Iterable[str] = NAMING_COLUMNS) -> DataFrame:
    """value_profile() of all text columns of all views at once; columns that name things are left out.

    One job sketches the distinct counts of all columns of all views, each view in one scan, and a row for each view comes
    to the driver. Columns whose sketch says twice the limit or less are counted exactly, which settles the limit: their
    values alone are laid out, again in one scan of each view that has such columns.
    """
    left_out = {c.lower() for c in skip}
    asked = {name: [c for c, t in view.dtypes if t == "string" and c.lower() not in left_out] for name, view in views.items()}
    sketches = [
        views[name].agg(F.lit(name).alias("view_name"), F.array(*[F.approx_count_distinct(f"`{c}`", 0.02) for c in columns]).alias("about"))
        for name, columns in asked.items() if columns
    ]
    none = "view_name string, column_name string, value string, freq long, fingerprint string, cluster_id int"
    if not sketches:
        return next(iter(views.values())).sparkSession.createDataFrame([], none) if views else _no_views(none)
    found = {r["view_name"]: r["about"] for r in reduce(DataFrame.unionByName, sketches).collect()}  # a row for each view
    few = {name: [c for c, n in zip(asked[name], about, strict=True) if 0 < n <= 2 * max_cardinality] for name, about in found.items()}
    long = [_long(views[name], name, columns) for name, columns in few.items() if columns]
    if not long:
        return next(iter(views.values())).sparkSession.createDataFrame([], none)
    return _profile(reduce(DataFrame.unionByName, long), max_cardinality, mode)


def _no_views(schema: str) -> DataFrame:
    from pyspark.sql import SparkSession

    return SparkSession.active().createDataFrame([], schema)


def build_all(parsed: DataFrame, outputs: DataFrame, links: DataFrame, max_cardinality: int = 30) -> dict[str, DataFrame]:
    """All views that follow a landing, by name: v_snapshots_auto, v_l2_links_auto, one for each command, and value_profile over
    the commands' views. outputs has what snapshot_metadata() takes, links what l2_links() does."""
    commands = build_views(parsed)
    out = {"v_snapshots_auto": snapshot_metadata(outputs), "v_l2_links_auto": l2_links(links), **commands}
    return out | {"value_profile": profile_views(commands, max_cardinality)}


def recipe_view(views: dict[str, DataFrame], recipes: Iterable[dict], devices: DataFrame, concept: str) -> DataFrame | None:
    """The union of a concept's vendor branches; of several recipes of one vendor the newest. Recipes whose view or columns are missing are passed over."""
    newest: dict[str, dict] = {}
    for r in recipes:
        if r["concept"] == concept and (r["vendor_hint"] not in newest or r["discovered_at"] > newest[r["vendor_hint"]]["discovered_at"]):
            newest[r["vendor_hint"]] = r
    out = None
    for vendor, r in sorted(newest.items()):
        view = views.get(r["command"])
        if view is None or not set(r["field_mappings"]) <= set(view.columns):
            continue
        if vendor != "universal":
            view = view.join(devices.filter(F.lower("vendor") == vendor).select(F.col("hostname").alias("device_name")), "device_name", "left_semi")
        if r.get("filter_expr"):
            view = view.filter(r["filter_expr"])
        branch = view.select("device_name", "snapshot_id", *[F.col(a).alias(b) for a, b in sorted(r["field_mappings"].items())])
        out = branch if out is None else out.unionByName(branch, allowMissingColumns=True)
    return out


def recipe_gaps(intent: DataFrame, devices: DataFrame, recipes: DataFrame) -> DataFrame:
    """protocol, vendor pairs of intent and inventory that no recipe covers. intent: protocol; both lists are small and distinct."""
    vendors = devices.select(F.lower("vendor").alias("vendor")).filter("vendor is not null").distinct()
    pairs = vendors.crossJoin(F.broadcast(intent.select("protocol").distinct()))  # protocols x vendors, no data rows
    covers = (F.col("concept") == F.col("protocol")) & ((F.col("vendor_hint") == F.col("vendor")) | (F.col("vendor_hint") == "universal"))
    return pairs.join(recipes.select("concept", "vendor_hint"), covers, "left_anti")


def json_text(column: Column, path: str) -> Column:
    return F.get_json_object(column, path)
