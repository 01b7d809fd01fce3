"""Searches over logs, evidence text, commands, and small planning questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.network import canonical_interface, ipv4_number, rollout_stage

# Syslog severities.
SEVERITIES = "emergency alert critical error warning notice info debug".split()


def search_logs(logs: DataFrame, query: str, as_of: str, hours: int = 24, severity: str | None = None, host: str | None = None, limit: int = 50) -> DataFrame:
    """Newest matching rows of the last `hours` before as_of; if there are none under 24 hours, of the last 24, with widened = true."""
    if severity is not None and severity.lower() not in SEVERITIES:
        raise ValueError(f"unknown severity: {severity}")
    if not query.strip():
        raise ValueError("an empty query")
    now = F.to_timestamp(F.lit(as_of)).cast("timestamp_ntz")
    since = lambda h: now - F.make_dt_interval(hours=F.lit(h))
    wide = F.contains(F.lower("message"), F.lit(query.lower())) & (F.col("timestamp") >= since(max(hours, 24)))
    rows = logs.filter(wide)
    if severity:
        rows = rows.filter(F.lower("severity") == severity.lower())
    if host:
        rows = rows.filter(F.contains(F.lower("host"), F.lit(host.lower())))
    rows = rows.withColumn("_in", F.col("timestamp") >= since(hours))
    order = [F.desc("_in"), F.desc("timestamp"), F.asc("host"), F.asc("message")]
    top = rows.orderBy(*order).limit(min(max(limit, 1), 500))  # narrow rows first: the wide ones show only where there are none
    any_in = F.max("_in").over(Window.partitionBy(F.lit(0)))  # over `limit` rows
    return top.withColumn("_any", any_in).filter("_in or not _any").select("timestamp", "host", "severity", "message", (~F.col("_any")).alias("widened"))


# Named ranges of time, in hours.
RANGES = {"last_1h": 1, "last_24h": 24, "last_7d": 168}


def since(df: DataFrame, column: str, as_of: str, span: str | int) -> DataFrame:
    """The rows of the last hours up to as_of; span is a number of hours or the name of a range. What is no time is left out."""
    hours = RANGES[span] if isinstance(span, str) else span
    at, now = F.col(column).try_cast("timestamp_ntz"), F.to_timestamp(F.lit(as_of)).cast("timestamp_ntz")
    return df.filter((at >= now - F.make_dt_interval(hours=F.lit(hours))) & (at <= now))


def stale_devices(devices: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """devices with `seen`: never, stale (last_seen more than `hours` before as_of) or fresh."""
    limit = F.to_timestamp(F.lit(as_of)).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))
    last = F.col("last_seen").cast("timestamp_ntz")
    return devices.withColumn("seen", F.when(last.isNull(), "never").when(last < limit, "stale").otherwise("fresh"))


def excerpt(text: Column, pattern: str, before: int = 200, length: int = 1200, default: int = 800) -> Column:
    """Text around the first match in any case, else the head."""
    at = F.locate(pattern.lower(), F.lower(text))
    return F.when(at > 0, F.substring(text, F.greatest(at - before, F.lit(1)), F.lit(length))).otherwise(F.left(text, F.lit(default)))


def query_evidence(df: DataFrame, pattern: str, *, device: str | None = None, snapshot_id: str | None = None, time: str | None = None, as_of: str | None = None, span: str | int = "last_24h", text: str = "raw_output", limit: int = 50) -> DataFrame:
    """The first `limit` texts that hold the pattern, newest snapshot first, as excerpts.

    df is any source of evidence: outputs, configurations or logs, with device_name, command, snapshot_id and a text column.
    A device, a snapshot, or a range of a time column up to as_of narrows it.
    """
    if not pattern.strip():
        raise ValueError("an empty pattern")
    rows = df.filter(F.contains(F.lower(text), F.lit(pattern.lower())))
    if device:
        rows = rows.filter(F.col("device_name") == device)
    if snapshot_id:
        rows = rows.filter(F.col("snapshot_id") == snapshot_id)
    if time and as_of:
        rows = since(rows, time, as_of, span)
    out = rows.select("device_name", "command", "snapshot_id", excerpt(F.col(text), pattern).alias("excerpt"))
    return out.orderBy(F.desc("snapshot_id"), "device_name", "command", "excerpt").limit(limit)


def within_budget(df: DataFrame, by: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """Rows of each group until their sizes exceed the budget; the first row always."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_sum", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w)).filter((F.col("_sum") <= budget) | (F.col("_n") == 1)).drop("_sum", "_n")


def search_commands(commands: DataFrame, devices: DataFrame, keyword: str, device: str | None = None, platform: str | None = None, limit: int = 20) -> DataFrame:
    """Commands of a device's or given platform and generic ones (*), own platform first."""
    rows = commands.filter(~F.col("blacklisted") & F.contains(F.lower("command"), F.lit(keyword.lower())))
    own = devices.filter(F.col("hostname") == device).select("platform").limit(1) if device else None
    if own is not None:
        rows = rows.join(own.withColumnRenamed("platform", "own"), F.lit(True)).filter("platform = own or platform = '*'")
    else:
        rows = rows.withColumn("own", F.lit(platform)).filter("own is null or platform = own or platform = '*'")
    return rows.orderBy(F.when(F.col("platform") == F.col("own"), 0).otherwise(1), F.asc_nulls_last("command"), "platform").limit(limit).select("platform", "command", (F.col("parser_type") != "raw_only").alias("has_template"))


def rollout_plan(devices: DataFrame, model_like: str) -> DataFrame:
    """Devices of a model with their stage and place in it: access, distribution, WAN, core."""
    rows = devices.filter(F.col("model").like(model_like)).withColumn("stage", rollout_stage(F.col("role")))
    place = F.row_number().over(Window.partitionBy("stage").orderBy(F.asc_nulls_first("role"), "hostname"))
    return rows.select("hostname", "role", "stage", place.alias("place"))


def plan_check(claims: DataFrame, interfaces: DataFrame) -> DataFrame:
    """claims (claim, device, subnet and, if given, interface) with what speaks against them: one row for each claim.

    device_known; in_use: addresses inside the claimed subnet; interface_known and interface_address: the claimed interface of
    the device and the address that it has already. Subnets of any width are met: distinct addresses are counted by network
    for each length that is claimed, 33 at most, and a claim takes the count of its own network, so no addresses are compared.
    """
    length = F.split_part("subnet", F.lit("/"), F.lit(2)).try_cast("int")
    network = lambda address: F.call_function("shiftright", address, 32 - F.col("length"))
    asked = claims.withColumn("length", F.when(length.between(0, 32), length))
    nets = asked.select("claim", "length", network(ipv4_number(F.col("subnet"))).alias("network")).filter("network is not null")
    lengths = nets.select("length").distinct()  # 33 rows at most
    used = interfaces.select(ipv4_number(F.col("ip_address")).alias("address")).filter("address is not null").distinct()
    counts = used.crossJoin(F.broadcast(lengths)).groupBy("length", network(F.col("address")).alias("network")).agg(F.count(F.lit(1)).alias("n"))
    hits = nets.join(counts, ["length", "network"]).groupBy("claim").agg(F.sum("n").alias("in_use"))
    known = interfaces.select(F.col("device_name").alias("device")).distinct().withColumn("known", F.lit(True))
    out = asked.join(hits, "claim", "left").join(known, "device", "left")
    columns = ["claim", "device", F.coalesce("known", F.lit(False)).alias("device_known"), F.coalesce("in_use", F.lit(0)).alias("in_use")]
    if "interface" in claims.columns:
        have = interfaces.groupBy(F.col("device_name").alias("device"), canonical_interface(F.col("interface")).alias("_if")).agg(F.max("ip_address").alias("interface_address"), F.lit(True).alias("_have"))
        out = out.withColumn("_if", canonical_interface(F.col("interface"))).join(have, ["device", "_if"], "left")
        columns += [F.coalesce("_have", F.lit(False)).alias("interface_known"), "interface_address"]
    return out.select(*columns)
