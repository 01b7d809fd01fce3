"""Import reports: what was parsed, what was not and why, what to learn next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unparsed(outputs: DataFrame, commands: DataFrame) -> DataFrame:
    """Unparsed outputs per platform, command and reason. outputs: device_name, platform, command, parsed (boolean), error (boolean)."""
    known = commands.select("platform", "command", "parser_type").dropDuplicates(["platform", "command"])
    counted = outputs.filter("not parsed").groupBy("platform", "command").agg(F.count(F.lit(1)).alias("n"), F.max("error").alias("error")).join(known, ["platform", "command"], "left")
    reason = F.when(F.col("error"), "parser_error").when(F.col("platform").isNull(), "unclassified").when(F.col("parser_type").isNull(), "no_parser_registered").when(F.col("parser_type") == "raw_only", "raw_only").otherwise("parser_no_match")
    return counted.select("platform", "command", "n", reason.alias("reason"))


def totals(outputs: DataFrame) -> DataFrame:
    """One row, of zeros and a null percentage where nothing has landed."""
    n, ok = F.count(F.lit(1)), F.count_if("parsed")
    return outputs.agg(n.alias("landed"), ok.alias("parsed"), (n - ok).alias("unparsed"), F.bround(F.try_divide(F.lit(100.0) * ok, n), 1).alias("percent"))


def fills(outputs: DataFrame) -> DataFrame:
    return outputs.groupBy("command").agg(F.count_if("parsed").alias("parsed"), F.count(F.lit(1)).alias("landed"))


def silent_devices(outputs: DataFrame, limit: int = 20) -> DataFrame:
    """Devices none of whose outputs was parsed: the first `limit` by name."""
    return outputs.groupBy("device_name").agg(F.max("parsed").alias("any")).filter("not any").select("device_name").orderBy("device_name").limit(limit)


def learn_queue(reasons: DataFrame, wanted: DataFrame, limit: int = 15) -> DataFrame:
    """Commands worth a parser: those a recipe wants first, then the most frequent. wanted: command."""
    open_ = reasons.filter(F.col("reason").isin("no_parser_registered", "parser_no_match") & ~F.col("command").contains("@"))
    marked = open_.join(wanted.select("command").distinct().withColumn("wanted", F.lit(True)), "command", "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
    return marked.orderBy(F.desc("wanted"), F.desc("n"), "command", "platform").limit(limit).select("platform", "command", "n", "reason", "wanted")


def coverage(outputs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Share of samples with a record per platform and command, and whether it reaches the threshold."""
    share = F.avg(F.col("parsed").cast("double"))
    return outputs.groupBy("platform", "command").agg(F.count(F.lit(1)).alias("samples"), share.alias("share"), (share >= threshold).alias("passes"))
