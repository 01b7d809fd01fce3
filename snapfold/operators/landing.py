"""Landing a snapshot: raw outputs in, all tables of the snapshot database and an import report out."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.network import canonical_platform, normalised_by
from . import report
from .layers import parsed_rows, pick
from .stored import Scratch
from .tables import latest_per_key, merge_devices, upsert_latest
from .text import is_cli_error, redact_text, salt_fingerprint, secrets_in, with_records
from .topology import build_devices, extract_links
from .views import build_all

# The fields in which parsed version output holds a model and an OS version, the first one counts.
MODEL_FIELDS = ["hardware", "model", "chassis", "platform"]
OS_FIELDS = ["version", "junos_version", "os_version", "software_image"]
# Keys of neighbour rows.
LOCAL_IF = ["local_interface", "local_port", "local_intf"]
PEER = ["neighbor", "neighbor_name", "destination_host", "system_name"]
PEER_IF = ["neighbor_interface", "remote_port", "remote_interface", "port_id"]


def pick_model(fields: Column) -> Column:
    """The model of a version row, by the ordered field list; of a list its first."""
    return pick(fields, MODEL_FIELDS, first=True)


def pick_os_version(fields: Column) -> Column:
    return pick(fields, OS_FIELDS, first=True)


def vendor_by_profile(devices: DataFrame, profiles: DataFrame) -> DataFrame:
    """devices with `vendor`: the platform's profile (platform, vendor), else the platform's first word in title case."""
    known = profiles.select("platform", F.col("vendor").alias("_vendor")).dropDuplicates(["platform"])
    own = F.initcap(F.split_part("platform", F.lit("_"), F.lit(1)))
    return devices.join(known, "platform", "left").withColumn("vendor", F.coalesce("_vendor", own)).drop("_vendor")


def loopbacks(interfaces: DataFrame) -> DataFrame:
    """device_name, loopback: the first interface, by place, that is up and named Loopback* or lo0*; a mask is taken off.

    interfaces: device_name, pos, interface, ip_address, status.
    """
    up = interfaces.filter(F.lower("status").startswith("up") & F.lower("interface").rlike("^(loopback|lo0)") & ~F.lower(F.coalesce("ip_address", F.lit(""))).isin("unassigned", "none", ""))
    first = F.min(F.struct("pos", "interface", "ip_address"))["ip_address"]
    return up.groupBy("device_name").agg(F.split_part(first, F.lit("/"), F.lit(1)).alias("loopback"))


def ids_of_text(raw: DataFrame) -> DataFrame:
    """device_name, router_id, local_as as the newest of a device's texts that names them says."""
    router = F.regexp_extract("raw_output", r"(?i)router[ -]id(?: is)?[: ]+(\d+\.\d+\.\d+\.\d+)", 1)
    number = F.regexp_extract("raw_output", r"(?i)(?:local AS number|router bgp|autonomous-system) +(\d+)", 1)
    rows = raw.select("device_name", "snapshot_id", F.nullif(router, F.lit("")).alias("router_id"), F.nullif(number, F.lit("")).alias("local_as"))
    newest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("snapshot_id", c)))[c].alias(c)
    return rows.groupBy("device_name").agg(newest("router_id"), newest("local_as")).filter("router_id is not null or local_as is not null")


def prefix_text(network: Column, length: Column) -> Column:
    """10.0.0.0/8; without a length the network alone."""
    return F.concat_ws("/", network, length.cast("string"))


def is_default_route(network: Column, length: Column) -> Column:
    return (network == "0.0.0.0") & (length.cast("int") == 0)


def normalize_fields(parsed: DataFrame) -> DataFrame:
    """device_name, command, snapshot_id, row, field, value, canonical for every field of every parsed row; list values one by one.

    row tells the objects of one list apart. What a field's name says decides how its value is put in canonical form.
    """
    rows = parsed.select("device_name", "command", "snapshot_id", F.posexplode(F.from_json("parsed_data", "array<map<string,string>>")).alias("row", "fields"))
    flat = rows.select("device_name", "command", "snapshot_id", "row", F.explode("fields").alias("field", "value")).filter("value is not null")
    each = F.when(F.col("value").startswith("["), F.coalesce(F.from_json("value", "array<string>"), F.array("value"))).otherwise(F.array("value"))
    out = flat.withColumn("value", F.explode(each))
    return out.withColumn("canonical", normalised_by(F.col("field"), F.col("value")))


def raw_neighbors(raw: DataFrame, kind: str, linked: DataFrame | None = None) -> DataFrame:
    """device, local_if, peer, peer_if, protocol, snapshot_id read from the text of CDP or LLDP listings.

    In CDP text a 'Device ID:' line names the peer of the first 'Interface: ..., Port ID ...:' line behind it. An LLDP line
    is local port first, then either peer and port at its end (five words or more, a slash in the first) or the three words
    before a number. Texts under 50 characters are no listings. Devices that have links already (linked: device_name) are
    left out.
    """
    rows = raw if linked is None else raw.join(linked.select("device_name").distinct(), "device_name", "left_anti")
    rows = rows.filter(F.length("raw_output") >= 50)
    lines = rows.select("device_name", "snapshot_id", F.posexplode(F.split(F.trim("raw_output"), "\n")).alias("pos", "line"), F.xxhash64("raw_output").alias("_text"))
    if kind == "cdp":
        named = F.nullif(F.regexp_extract("line", r"Device ID:\s*(\S+)", 1), F.lit(""))
        local, far = (F.regexp_extract("line", r"Interface:\s*(\S+),\s*Port ID.*?:\s*(\S+)", i) for i in (1, 2))
        marks = lines.withColumns({"peer": named, "local_if": F.rtrim(local, F.lit(",")), "peer_if": far}).filter("peer is not null or local_if <> ''")
        order = Window.partitionBy("device_name", "snapshot_id", "_text").orderBy("pos")
        found = marks.withColumn("peer", F.when(F.col("peer").isNull(), F.lag("peer").over(order))).filter("local_if <> '' and peer is not null")
    else:
        words = F.split(F.trim("line"), r"\s+")
        first, n = F.get(words, F.lit(0)), F.size(words)
        wide = (n >= 5) & F.contains(first, F.lit("/"))
        three = (n >= 4) & F.col("line").rlike(r"^\S+\s+\S+\s+\S+\s+\d") & (F.contains(first, F.lit("/")) | first.rlike("^(Gi|Et)"))
        peer = F.when(wide, F.get(words, n - 1)).when(three, F.get(words, F.lit(1)))
        port = F.when(wide, F.get(words, n - 2)).when(three, F.get(words, F.lit(2)))
        found = lines.withColumns({"local_if": first, "peer": peer, "peer_if": port}).filter("peer is not null and not (peer in ('', '-'))")
    return found.select(F.col("device_name").alias("device"), "local_if", "peer", "peer_if", F.lit(kind).alias("protocol"), "snapshot_id").distinct()


def neighbor_rows(parsed: DataFrame, like: str, protocol: str) -> DataFrame:
    """device, local_if, peer, peer_if, protocol, snapshot_id of the parsed rows of neighbour commands."""
    f = F.col("fields")
    rows = parsed_rows(parsed.filter(F.col("command").ilike(like)))
    out = rows.select(F.col("device_name").alias("device"), pick(f, LOCAL_IF).alias("local_if"), pick(f, PEER).alias("peer"), pick(f, PEER_IF).alias("peer_if"), F.lit(protocol).alias("protocol"), "snapshot_id")
    return out.filter("local_if is not null and peer is not null and peer_if is not null")


def landed_outputs(outputs: DataFrame, templates: DataFrame, salt: str | None, platforms: DataFrame | None = None) -> DataFrame:
    """device_name, command, snapshot_id, platform, raw_output (redacted), parsed_data, parsed, error, reason, replacements,
    degraded of each output; every row of outputs gives one, whatever it repeats or lacks.

    outputs: device_name, command, snapshot_id, platform, raw_output and, if texts were redacted by the collector, pre_scrubbed.
    platforms (device_name, platform) is what discovery found and goes before the output's own. Without a salt texts stay as
    they are, and those that nobody has redacted are marked as degraded.
    """
    scrubbed = F.coalesce(F.col("pre_scrubbed"), F.lit(False)) if "pre_scrubbed" in outputs.columns else F.lit(False)
    text = F.col("raw_output")
    clean = text if salt is None else F.when(scrubbed, text).otherwise(redact_text(text, salt))
    counted = F.when(scrubbed | F.lit(salt is None), 0).otherwise(secrets_in(text))
    rows = outputs.withColumns({"replacements": counted, "degraded": ~scrubbed & F.lit(salt is None)}).withColumn("raw_output", clean)
    if platforms is not None:
        found = platforms.groupBy("device_name").agg(F.min("platform").alias("_found"))
        rows = rows.join(found, "device_name", "left").withColumn("platform", F.coalesce("_found", "platform")).drop("_found")
    rows = with_records(rows.withColumn("platform", canonical_platform(F.col("platform"))), templates)
    return rows.select("device_name", "command", "snapshot_id", "platform", "raw_output", F.col("records").alias("parsed_data"), (F.col("reason") == "ok").alias("parsed"), is_cli_error(F.col("raw_output")).alias("error"), "reason", "replacements", "degraded")


# What is known of a bundle.
BUNDLE = ["bundle_id", "bundle_sha256", "collector_name", "collector_version"]


def land_snapshot(
    outputs: DataFrame, templates: DataFrame, commands: DataFrame, inventory: DataFrame, wanted: DataFrame, salt: str | None, existing: DataFrame | None = None, platforms: DataFrame | None = None,
    existing_devices: DataFrame | None = None, existing_links: DataFrame | None = None, bundle: dict[str, str] | None = None, via: str = "offline", views: bool = True,
) -> dict[str, DataFrame]:
    """The tables of one landing by name: outputs, parsed, devices, links, refused, redaction, totals, reasons, silent, learn_queue,
    fills, bundle_ingests and, if asked for, the views that follow (v_..., value_profile).

    outputs of one bundle; existing: outputs that are there already, over which the new ones are laid (newest snapshot of each
    device and command). templates as with_records() takes them, commands (platform, command, ...) as report.unparsed().
    Rows without a device, a command or a text are refused, and listed as such. What lands is redacted and parsed once, as it
    is written to the shared folder; all tables are read from there. The same write observes the redaction: its counts take no
    second pass. Links come from parsed neighbours, and for devices without any from the text of their CDP and LLDP
    listings. existing_devices keep what the landing does not know; of existing_links the first sighting stays. bundle
    (BUNDLE) and via are stamped on the outputs. The input may be empty: all tables are then empty but totals and redaction.
    """
    spark = outputs.sparkSession
    stored, seen = Scratch(spark), Observation("redaction")
    lacks = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    problem = reduce(lambda w, c: w.when(lacks(c), f"no {c}"), ["command", "raw_output"], F.when(lacks("device_name"), "no device_name"))
    refused = outputs.withColumn("problem", problem).filter("problem is not null").select("device_name", "command", "snapshot_id", "problem")
    counts = [F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum("replacements"), F.lit(0)).alias("replacements"), F.count_if("degraded").alias("degraded")]
    landed = stored.put(landed_outputs(outputs.filter(problem.isNull()), templates, salt, platforms).observe(seen, *counts), "landed")
    found = seen.get
    mark = salt_fingerprint(salt) if salt is not None else None
    redaction = spark.createDataFrame([(found.get("texts", 0), found.get("replacements", 0), mark, found.get("degraded", 0) > 0)], "texts long, replacements long, salt_fingerprint string, degraded boolean")
    about = {**dict.fromkeys(BUNDLE), **(bundle or {})}
    rows = landed.select("device_name", "command", "snapshot_id", "platform", "raw_output", "parsed_data", F.lit(about["bundle_id"]).cast("string").alias("bundle_id"), F.lit(about["bundle_sha256"]).cast("string").alias("bundle_sha256"), F.lit(via).alias("ingested_via"))
    order = [F.desc("snapshot_id"), F.desc("raw_output")]
    table = upsert_latest(existing, rows, ["device_name", "command"], order) if existing is not None else latest_per_key(rows, ["device_name", "command"], order)
    version = parsed_rows(rows.filter(F.col("command").isin("show version", "display version")), "platform")
    f = F.col("fields")
    facts = version.select("device_name", "snapshot_id", "platform", pick_model(f).alias("model"), pick_os_version(f).alias("os_version"), pick(f, ["pid"]).alias("pid"), pick(f, ["ip_address"]).alias("ip_address"))
    every = rows.select("device_name", "snapshot_id", "platform", *[F.lit(None).cast("string").alias(c) for c in ("model", "os_version", "pid", "ip_address")]).distinct()
    devices = build_devices(facts.unionByName(every), inventory)
    devices = stored.put(devices if existing_devices is None else merge_devices(existing_devices, devices), "devices")
    near = stored.put(neighbor_rows(rows, "%cdp neighbors%", "cdp").unionByName(neighbor_rows(rows, "%lldp neighbors%", "lldp")), "near")
    have = near.select(F.col("device").alias("device_name"))
    text = [raw_neighbors(rows.filter(F.col("command").ilike(f"%{k} neighbors%")), k, have) for k in ("cdp", "lldp")]
    links = extract_links(stored.put(near.unionByName(text[0]).unionByName(text[1]), "neighbors"), devices)  # names and rows of the same texts
    links = stored.put(links if existing_links is None else merge_sightings(existing_links, links), "links")
    reasons = report.unparsed(landed, commands)
    out = {"outputs": table, "parsed": rows.filter("parsed_data is not null"), "devices": devices, "links": links, "refused": refused, "redaction": redaction, "totals": report.totals(landed), "reasons": reasons}
    out |= {"silent": report.silent_devices(landed), "learn_queue": report.learn_queue(reasons, wanted), "fills": report.fills(landed), "bundle_ingests": bundle_ingest(landed, about, mark)}
    dated = landed.withColumn("ingested_at", F.lit(None).cast("timestamp"))
    up = links.withColumn("link_status", F.lit(None).cast("string"))
    return out | build_all(out["parsed"], dated, up) if views else out


def merge_sightings(existing: DataFrame, links: DataFrame) -> DataFrame:
    """One row per link_id of two link tables: the ends as last seen, the first sighting of all."""
    rest = [c for c in links.columns if c not in ("link_id", "first_snapshot", "snapshot_id")]
    both = existing.select(*links.columns).unionByName(links)
    last = F.max(F.struct("snapshot_id", *rest)).alias("l")
    merged = both.groupBy("link_id").agg(last, F.min("first_snapshot").alias("first_snapshot"))
    return merged.select(*[F.col(f"l.{c}").alias(c) if c in (*rest, "snapshot_id") else F.col(c) for c in links.columns])


def bundle_ingest(landed: DataFrame, bundle: dict[str, str | None], mark: str | None) -> DataFrame:
    """A row for each snapshot: what is known of the bundle, devices, outputs, replacements, the salt's fingerprint, whether texts
    stayed as they were though nobody had redacted them, and a JSON summary of outputs by reason."""
    counts = landed.groupBy("snapshot_id", "reason").agg(F.count(F.lit(1)).alias("n"))
    summary = counts.groupBy("snapshot_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n"))))).alias("summary"))
    known = [F.lit(bundle[c]).cast("string").alias(c) for c in BUNDLE]
    own = landed.groupBy("snapshot_id").agg(F.count_distinct("device_name").alias("devices"), F.count(F.lit(1)).alias("outputs"), F.sum("replacements").alias("replacements"), F.max("degraded").alias("degraded"))
    joined = own.join(summary.withColumnRenamed("snapshot_id", "_of"), F.col("snapshot_id").eqNullSafe(F.col("_of"))).drop("_of")
    return joined.select(*known, "snapshot_id", "devices", "outputs", "replacements", F.lit(mark).cast("string").alias("salt_fingerprint"), "degraded", "summary")


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """The parts of the import report as JSON folders under the path."""
    for name in ("totals", "reasons", "silent", "learn_queue", "fills", "bundle_ingests", "refused", "redaction"):
        tables[name].write.mode("overwrite").json(f"{path}/{name}")


def export_csv(df: DataFrame, home: str) -> str:
    """Writes df as CSV into a folder named by its content and returns the path; what is there already isn't written again.

    The name is a digest of the rows' hashes, in any order: their number, sum and exclusive-or.
    """
    cells = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    one = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(cells).cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(1), cells))).first()
    path = f"{home}/{hashlib.sha256(repr((df.columns, *map(str, one))).encode()).hexdigest()[:24]}"
    spark: SparkSession = df.sparkSession
    try:
        spark.read.text(path)
    except Exception as e:  # the path isn't there
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df.write.option("header", True).csv(path)
    return path
