"""The command catalogue: sources that override one another, the blacklist, candidates, samples to learn from, platform discovery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .report import coverage
from .stored import replace_table
from .tables import few
from .text import is_learnable, structure, with_records

# Whose word counts more, the last one most.
SOURCES = ["ntc", "user", "custom", "learned"]
# Commands whose output tells the platform, in the order in which they are tried.
VERSION_COMMANDS = ["show version", "display version"]
SECONDARY_COMMANDS = ["show system information", "show platform", "show inventory"]


def merge_commands(commands: DataFrame) -> DataFrame:
    """One row for each platform and command: the source of most weight wins. commands: platform, command, source and more.

    Unknown sources weigh least; of equal rows of one source any is the same row.
    """
    rank = F.coalesce(F.array_position(F.lit(SOURCES), F.col("source")), F.lit(0))
    rest = [c for c in commands.columns if c not in ("platform", "command")]
    best = F.max(F.struct(rank.alias("_rank"), *rest)).alias("b")
    return commands.groupBy("platform", "command").agg(best).select("platform", "command", *[F.col(f"b.{c}").alias(c) for c in rest])


def flag_blacklisted(commands: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """commands with `blacklisted`: whether any of the patterns occurs in the command, in any case. Blank patterns say nothing."""
    held = [p.strip() for p in patterns if p.strip()]
    hit = F.exists(F.array(*[F.lit(f"(?i){p}") for p in held]), lambda p: F.regexp_like(F.col("command"), p)) if held else F.lit(False)
    return commands.withColumn("blacklisted", F.coalesce(hit, F.lit(False)))


def refresh(table: DataFrame, path: str) -> None:
    """Replaces a versioned table as a whole; readers (stored.read_current) see the old version or the new one."""
    replace_table(table, path)


def match_command(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """asked, command: the first stored command, by name, that holds every word of the one asked for; null if none does.

    Meets on the asked command's longest word, which a stored command must hold as part of its text, so stored commands are
    looked up by their words' pieces and every pair is verified.
    """
    words = F.filter(F.split(F.lower(F.trim("asked")), r"\s+"), lambda w: w != "")
    want = asked.select("asked").distinct().withColumn("words", words)
    anchor = F.array_max(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    want = want.withColumn("anchor", F.substring(anchor, 1, 3))
    held = stored.select("command").distinct().withColumn("low", F.lower("command"))
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.length("low")), lambda i: F.substring(F.col("low"), i, F.lit(n)))
    held = held.filter(F.length("low") > 0).withColumn("anchor", F.explode(F.array_distinct(F.concat(grams(1), grams(2), grams(3)))))
    fits = want.join(held, "anchor").filter(F.forall("words", lambda w: F.contains(F.col("low"), w)))
    return want.select("asked").join(fits.groupBy("asked").agg(F.min("command").alias("command")), "asked", "left")


def candidate_commands(parsed: DataFrame, devices: DataFrame, keywords: DataFrame) -> DataFrame:
    """protocol, command, devices, sample: commands that hold a protocol's keyword on known devices, with one parsed entry each.

    keywords: protocol, keyword. The sample is that of the newest snapshot, then of the least device name.
    """
    known = parsed.join(devices.select(F.col("hostname").alias("device_name")).distinct(), "device_name", "left_semi").filter("parsed_data is not null")
    held = known.groupBy("command").agg(F.count_distinct("device_name").alias("devices"), F.max("snapshot_id").alias("newest"))
    last = known.join(held.select("command", F.col("newest").alias("snapshot_id")), ["command", "snapshot_id"])
    sample = last.groupBy("command").agg(F.min(F.struct("device_name", "parsed_data"))["parsed_data"].alias("sample"))
    names = held.select("command", "devices").join(sample, "command")
    # Distinct commands and keywords are two short lists; they meet by containment.
    hits = names.join(few(keywords.select("protocol", F.lower("keyword").alias("keyword")).distinct()), F.contains(F.lower("command"), F.col("keyword")))
    return hits.select("protocol", "command", "devices", "sample").distinct()


def learn_candidates(raw: DataFrame, limit: int = 3) -> DataFrame:
    """platform, command, samples, non_blank, aligned_share, outputs of what a parser could be learned from.

    Of the outputs that are worth learning, the `limit` least by device and snapshot are the samples; the hints are over all
    of them. A job with code parsers needs two samples at least: `quarantined` says where there are fewer.
    """
    rows = raw.filter(is_learnable(F.col("command"), F.col("raw_output"))).withColumn("s", structure(F.col("raw_output")))
    stats = rows.groupBy("platform", "command").agg(F.count(F.lit(1)).alias("outputs"), F.avg("s.non_blank").alias("non_blank"), F.avg(F.col("s.aligned").cast("int")).alias("aligned_share"))
    taken = _least(rows, limit)
    same = lambda c: F.col(f"_{c}").eqNullSafe(F.col(c))
    out = stats.join(taken.withColumnsRenamed({"platform": "_platform", "command": "_command"}), same("platform") & same("command"))
    return out.select("platform", "command", "samples", "outputs", "non_blank", "aligned_share", (F.size("samples") < 2).alias("quarantined"))


def _least(rows: DataFrame, limit: int) -> DataFrame:
    """The least `limit` rows of each platform and command, picked by a window that keeps no group in memory."""
    order = Window.partitionBy("platform", "command").orderBy("device_name", "snapshot_id", "raw_output")
    few = rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit)
    return few.groupBy("platform", "command").agg(F.array_sort(F.collect_list(F.struct("device_name", "snapshot_id", "raw_output"))).alias("samples"))


def validate_learned(raw: DataFrame, templates: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Share of learnable outputs that a candidate template reads, by platform and command, and whether it reaches the threshold."""
    rows = raw.filter(is_learnable(F.col("command"), F.col("raw_output")))
    return coverage(with_records(rows, templates).withColumn("parsed", F.col("reason") == "ok"), threshold)


def discover_platform(files: DataFrame, templates: DataFrame, signatures: DataFrame) -> DataFrame:
    """host, platform, confidence, sample_command of each host. files: host, command, text.

    A file name that one platform alone has (signatures: command, platform) narrows the candidates to it. The first version
    command, then the first secondary one, whose output a candidate's template (platform, command, pattern, priority) reads
    decides; else the signature does; else the platform is unknown, with the longest output as the sample.
    """
    order = {c: i for i, c in enumerate([*VERSION_COMMANDS, *SECONDARY_COMMANDS])}
    rank = F.coalesce(*[F.when(F.col("command") == c, F.lit(i)) for c, i in order.items()])
    hint = files.join(few(signatures), "command").groupBy("host").agg(F.min(F.struct("command", "platform")).alias("hint"))
    tried = files.withColumn("rank", rank).filter("rank is not null").join(hint, "host", "left").join(few(templates), "command")
    read = tried.filter(F.coalesce(F.col("hint.platform") == F.col("platform"), F.lit(True))).filter(F.exists(F.split("text", "\n"), lambda x: F.regexp_like(x, F.col("pattern"))))
    best = read.groupBy("host").agg(F.min(F.struct("rank", "priority", "platform", "command")).alias("b"))
    sample = files.groupBy("host").agg(F.max(F.struct(F.length("text").alias("n"), F.col("command")))["command"].alias("longest"))
    out = sample.join(best, "host", "left").join(hint, "host", "left")
    version = F.col("b.rank") < len(VERSION_COMMANDS)
    confidence = F.when(version, "template-version").when(F.col("b.rank").isNotNull(), "template-secondary").when(F.col("hint").isNotNull(), "filename-signature").otherwise("unknown")
    return out.select("host", F.coalesce("b.platform", "hint.platform").alias("platform"), confidence.alias("confidence"), F.coalesce("b.command", "hint.command", "longest").alias("sample_command"))
