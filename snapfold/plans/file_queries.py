"""Queries over files and streams, which each query writes from the driver's tables into the shared folder first."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import network as net
from ..operators import landing, stored, tables, text, views
from ..sources import bundles
from ..streaming import logs as streams
from .fixtures import cte, model
from .queries import query


def write_files(files: DataFrame, home: str) -> int:
    """Writes each row (path, content) as one file under home, from the tasks; returns how many."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", home))
        for pdf in batches:
            for folder in {f"{at}/{p}".rsplit("/", 1)[0] for p in pdf["path"]}:
                system.create_dir(folder, recursive=True)
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                with system.open_output_stream(f"{at}/{p}") as f:
                    f.write(content)
            yield pd.DataFrame({"n": [len(pdf)]})

    return files.select("path", "content").mapInPandas(work, "n long").agg(F.sum("n")).first()[0] or 0


def _bytes(value: Column) -> Column:
    return F.encode(value, "UTF-8")


def _captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bundle, host, file, command, text: the newest output of each device and command; every third has a header."""
    raw = model(spark, sf_dir, "raw")
    last = raw.groupBy(F.col("device_name").alias("host"), "command").agg(F.max_by("raw_output", "seq").alias("body"), F.max("seq").alias("seq"))
    head = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("# command: "), F.upper("command"), F.lit("\n# pre_scrubbed: True\n\n"))).otherwise("")
    bundle = F.concat(F.lit("b"), F.substring("host", 2, 9).cast("int") % 7)
    return last.select(bundle.alias("bundle"), "host", F.regexp_replace("command", " ", "_").alias("file"), "command", F.concat(head, "body").alias("text"))


_CAPTURED = """, newest AS (SELECT device_name AS host, command, arg_max(raw_output, seq) AS body, max(seq) AS seq FROM raw GROUP BY ALL),
    files AS (SELECT 'b' || substr(host, 2)::INT % 7 AS bundle, host, replace(command, ' ', '_') AS file, command, body, seq,
        CASE WHEN seq % 3 = 0 THEN '# command: ' || upper(command) || chr(10) || '# pre_scrubbed: True' || chr(10) || chr(10) ELSE '' END || body AS text FROM newest)"""
_HEADED = """ SELECT host, CASE WHEN seq % 3 = 0 THEN upper(command) ELSE command END AS command, CASE WHEN seq % 3 = 0 THEN true END AS pre_scrubbed, sha256(body) AS body FROM files"""


def _tree(spark: SparkSession, sf_dir: str) -> str:
    """A tree of bundles: <bundle>/devices/<host>/<file>.txt and <bundle>/manifest.yaml."""
    home, files = stored.scratch(spark, "bundles"), _captured(spark, sf_dir)
    write_files(files.select(F.concat_ws("/", "bundle", F.lit("devices"), "host", F.concat("file", F.lit(".txt"))).alias("path"), _bytes(F.col("text")).alias("content")), home)
    all_texts = F.array_sort(F.collect_list(F.struct("host", "file", "text")))["text"]  # the texts of one bundle of the fixture
    about = files.groupBy("bundle").agg(F.sha2(F.array_join(all_texts, ""), 256).alias("sha"), F.count_distinct("host").alias("hosts"))
    odd = F.substring("bundle", 2, 1).cast("int") % 2 == 1
    manifest = F.concat(F.lit("schema_version: 1\ncollector: {name: c, version: '2'}\nhosts_collected: "), F.col("hosts") + F.when(F.col("bundle") == "b2", 1).otherwise(0), F.lit("\ncontent_sha256: "), F.when(odd, "other").otherwise(F.col("sha")), F.lit("\n"))
    write_files(about.select(F.concat("bundle", F.lit("/manifest.yaml")).alias("path"), _bytes(manifest).alias("content")), home)
    return home


@query(cte("raw") + _CAPTURED + _HEADED)
def bundle_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs read from a tree of bundles, with what their headers say."""
    rows = bundles.parse_headers(bundles.read_bundle(spark, _tree(spark, sf_dir)))
    return rows.select("host", "command", "pre_scrubbed", F.sha2("body", 256).alias("body"))


@query(cte("raw") + _CAPTURED + """ SELECT bundle, sha256(string_agg(text, '' ORDER BY host, file)) AS sha256, count(DISTINCT host) AS hosts, count(*) AS commands,
    CASE WHEN substr(bundle, 2)::INT % 2 = 1 THEN 'digest differs' ELSE '' END AS errors, CASE bundle WHEN 'b2' THEN 'host count differs' ELSE '' END AS warnings FROM files GROUP BY bundle""")
def bundle_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of bundles, and what their manifests disagree with."""
    home = _tree(spark, sf_dir)
    named = lambda df: df.withColumn("bundle", F.regexp_extract("path", r"/([^/]+)/(?:devices/|manifest)", 1))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).load(home)
    at = r"/([^/]+)/devices/([^/]+)/([^/]+)\.txt$"
    listed = files.select(*[F.regexp_extract("path", at, i).alias(c) for i, c in enumerate(("bundle", "host", "file"), 1)], F.decode("content", "UTF-8").alias("text"))
    digests = bundles.bundle_digest(listed)
    found = bundles.validate_bundles(digests, named(bundles.read_manifests(spark, home)))
    return digests.join(found, "bundle").select("bundle", "sha256", "hosts", "commands", F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings"))


@query(cte("raw") + _CAPTURED + _HEADED)
def archive_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same outputs out of one zip for each bundle, read member by member."""
    home = stored.scratch(spark, "archives")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for host, file, body in zip(pdf["host"], pdf["file"], pdf["text"], strict=True):
                z.writestr(f"devices/{host}/{file}.txt", body)
        return pd.DataFrame({"path": [f"{pdf['bundle'].iloc[0]}.zip"], "content": [held.getvalue()]})

    write_files(_captured(spark, sf_dir).groupBy("bundle").applyInPandas(pack, "path string, content binary"), home)
    rows = bundles.parse_headers(bundles.members_as_files(bundles.expand_archives(spark, home)))
    return rows.select("host", "command", "pre_scrubbed", F.sha2("body", 256).alias("body"))


@query(cte("raw") + _CAPTURED + """ SELECT bundle, 'canonical' AS format, count(DISTINCT host) AS hosts, count(*) AS files FROM files GROUP BY bundle
    UNION ALL SELECT 'd' || (substr(host, 2)::INT % 3), 'vendor_dump', 0, count(*) FROM newest GROUP BY ALL""")
def bundle_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listing of files says of each bundle's format."""
    files = _captured(spark, sf_dir)
    listing = files.select("bundle", F.concat_ws("/", "bundle", F.lit("devices"), "host", F.concat("file", F.lit(".txt"))).alias("path"))
    dumps = files.select(F.concat(F.lit("d"), F.substring("host", 2, 9).cast("int") % 3).alias("bundle"), F.concat_ws("/", F.lit("network_data"), "file", "host").alias("path"))
    return bundles.survey(listing.unionByName(dumps)).select("bundle", "format", "hosts", "files")


@query(cte("raw") + _CAPTURED + """ SELECT command, host, sha256(text) AS body FROM files""")
def dump_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs read from a command-major dump."""
    home = stored.scratch(spark, "dump")
    write_files(_captured(spark, sf_dir).select(F.concat_ws("/", F.lit("network_data"), "file", "host").alias("path"), _bytes(F.col("text")).alias("content")), home)
    return bundles.read_dump(spark, home).select("command", "host", F.sha2("text", 256).alias("body"))


@query(cte("raw") + _CAPTURED + """ SELECT host AS device_name, command, seq FROM newest WHERE substr(host, 2)::INT % 10 <> 9""")
def staging_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of staging files, JSON lists, of which some are broken."""
    home = stored.scratch(spark, "staging")
    rows = model(spark, sf_dir, "raw").groupBy("device_name", "command").agg(F.max("seq").alias("seq"))
    lists = rows.groupBy("device_name").agg(F.to_json(F.collect_list(F.struct("device_name", "command", "seq"))).alias("held"))  # five commands
    broken = F.substring("device_name", 2, 9).cast("int") % 10 == 9
    write_files(lists.select(F.concat("device_name", F.lit(".json")).alias("path"), _bytes(F.when(broken, F.expr("left(held, length(held) - 3)")).otherwise(F.col("held"))).alias("content")), home)
    return bundles.read_staging(spark, f"{home}/*.json", "device_name string, command string, seq long").filter("device_name is not null")


@query(cte("logs") + """ SELECT severity, CASE WHEN severity = 'ERROR' THEN 'local7' END AS facility, count(*) AS n, count(DISTINCT host) AS hosts FROM logs GROUP BY ALL""")
def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log files of different columns, read as one table."""
    home, rows = stored.scratch(spark, "logs"), model(spark, sf_dir, "logs")
    rows.filter("severity <> 'ERROR'").write.parquet(f"{home}/2024-01-01")
    rows.filter("severity = 'ERROR'").withColumn("facility", F.lit("local7")).write.parquet(f"{home}/2024-01-02")
    return bundles.read_logs(spark, home).groupBy("severity", "facility").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("host").alias("hosts"))


@query(cte("devices") + """ SELECT hostname, ip_address, platform, role, site, CASE WHEN role IS NULL THEN '' ELSE 'a,' || role END AS groups, model FROM devices""")
def inventory_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of inventory files, one for each site."""
    home = stored.scratch(spark, "inventory")
    role = lambda a, b: F.when(F.col("role").isNull(), "").otherwise(F.concat(F.lit(a), F.col("role"), F.lit(b)))
    entry = F.concat("hostname", F.lit(": {hostname: "), "ip_address", F.lit(", platform: "), "platform", role(", groups: [a, ", "]"), F.lit(", data: {site: '"), "site", F.lit("'"), role(", role: ", ""), F.lit(", model: "), "model", F.lit("}}"))
    sites = model(spark, sf_dir, "devices").groupBy("site").agg(F.array_join(F.collect_list(entry), "\n").alias("held"))  # the hosts of one site
    write_files(sites.select(F.concat(F.regexp_replace("site", " ", "_"), F.lit("/hosts.yaml")).alias("path"), _bytes(F.col("held")).alias("content")), home)
    rows = bundles.read_inventory(spark, home)
    return rows.select("hostname", "ip_address", "platform", "role", "site", F.coalesce(F.array_join("groups", ","), F.lit("")).alias("groups"), F.element_at("extra", "model").alias("model"))


def _log_source(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    home, rows = stored.scratch(spark, "stream"), model(spark, sf_dir, "logs")
    rows.write.parquet(f"{home}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{home}/in"), home


@query(cte("logs") + """ SELECT host, severity, "timestamp" AS last_seen, message FROM logs QUALIFY row_number() OVER (PARTITION BY host, severity ORDER BY "timestamp" DESC, message DESC) = 1""")
def landing_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest message of each host and severity, as a stream of files lands it; the last batch comes twice."""
    source, home = _log_source(spark, sf_dir)
    keys, order = ["host", "severity"], ["timestamp", "message"]
    upsert = streams.upsert_into(f"{home}/out", keys, order)
    streams.land_stream(source, upsert, f"{home}/cp").awaitTermination()
    upsert(spark.read.parquet(f"{home}/in"), 0)
    return streams.landed(spark, f"{home}/out", keys, order).select("host", "severity", F.col("timestamp").alias("last_seen"), "message")


@query(cte("logs") + """ SELECT host, count(*) AS n FROM (SELECT DISTINCT host, "timestamp", severity, message FROM logs) GROUP BY host""")
def dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by host after a stream in which each comes twice has lost its repeats."""
    source, home = _log_source(spark, sf_dir)
    twice = source.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withColumn("_n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_n")
    once = streams.dedup_in_flight(twice, ["host", "timestamp", "severity", "message"], "400 days")
    q = once.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{home}/out").groupBy("host").agg(F.count(F.lit(1)).alias("n"))


@query(cte("raw", "commands") + """ SELECT snapshot_id, device_name, count(*) AS lines FROM (SELECT snapshot_id, device_name, unnest(string_split(raw_output, chr(10)))
        FROM raw WHERE command IN (SELECT command FROM commands WHERE command = 'show running-config')) GROUP BY ALL""")
def backup_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the backups that were exported, read back from their folders."""
    home = stored.scratch(spark, "backups")
    commands = model(spark, sf_dir, "commands").withColumn("backup_only", F.col("command") == "show running-config")
    tables.export_backups(model(spark, sf_dir, "raw"), commands, home)
    return spark.read.text(home).groupBy("snapshot_id", "device_name").agg(F.count(F.lit(1)).alias("lines"))


@query(cte("devices") + """ SELECT hostname, site, platform, role, 1 AS copies FROM devices""")
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices read back from a CSV export; the same rows in another order are not written again."""
    home = stored.scratch(spark, "csv")
    d = model(spark, sf_dir, "devices").select("hostname", "site", "platform", "role")
    paths = {landing.export_csv(d, home), landing.export_csv(d.orderBy(F.desc("hostname")), home)}
    return spark.read.option("header", True).csv(list(paths)).select("hostname", "site", "platform", "role", F.lit(len(paths)).alias("copies"))


@query("""WITH r AS (SELECT turn, conv_id, role, '{"user": "' || role || '", "api_token": "t' || conv_id || '", "nested": [{"password": "p", "tokens_in": ' || turn || '}]}' AS j FROM conversations)
    SELECT conv_id, turn, json_extract_string(j, '$.user') AS said_by, 'REDACTED' AS token, 'REDACTED' AS password, turn::VARCHAR AS tokens_in FROM r""")
def json_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret keys of JSON redacted at any depth, and values read by their paths."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    j = F.concat(F.lit('{"user": "'), "role", F.lit('", "api_token": "t'), "conv_id", F.lit('", "nested": [{"password": "p", "tokens_in": '), "turn", F.lit("}]}"))
    rows = text.redact_json(c.select("conv_id", "turn", j.alias("j")), "j")
    path = lambda p: views.json_text(F.col("j"), p)
    return rows.select("conv_id", "turn", path("$.user").alias("said_by"), path("$.api_token").alias("token"), path("$.nested[0].password").alias("password"), path("$.nested[0].tokens_in").alias("tokens_in"))


@query(cte("raw") + """, t AS (SELECT seq, CASE seq % 5 WHEN 0 THEN 'Cisco IOS Software' WHEN 1 THEN 'Nexus Operating System (NX-OS)' WHEN 2 THEN 'Junos: 21.1'
        WHEN 3 THEN 'TiMOS-B' ELSE 'nothing' END || chr(10) || chr(10) || 'Name  Port' || chr(10) || raw_output AS x, raw_output FROM raw)
    SELECT seq, CASE seq % 5 WHEN 0 THEN 'cisco_ios' WHEN 1 THEN 'cisco_nxos' WHEN 2 THEN 'juniper_junos' WHEN 3 THEN 'nokia_sros' END AS platform,
        len(list_filter(string_split(raw_output, chr(10)), lambda l: trim(l) <> '')) AS n_rows, lower(replace(replace('Show X/' || seq, ' ', '_'), '/', '_')) AS slug FROM t""")
def text_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The platform that a banner names, rows below a table's header, and a command's slug."""
    raw = model(spark, sf_dir, "raw")
    banner = F.element_at(F.array(*map(F.lit, ["Cisco IOS Software", "Nexus Operating System (NX-OS)", "Junos: 21.1", "TiMOS-B", "nothing"])), (F.col("seq") % 5 + 1).cast("int"))
    x = raw.select("seq", F.concat(banner, F.lit("\n\nName  Port\n"), "raw_output").alias("x"))
    return x.select("seq", text.sniff_platform(F.col("x")).alias("platform"), text.estimate_rows(F.col("x"), "port").alias("n_rows"), net.command_slug(F.concat(F.lit("Show X/"), "seq")).alias("slug"))


@query(cte("devices") + """ SELECT hostname, ip_address, site, NULL AS environment, '{}' || hostname AS metadata, NULL::TIMESTAMP AS last_seen FROM devices""")
def conformed_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices in the schema of their table: columns that it has gained since are typed nulls, others go."""
    d = model(spark, sf_dir, "devices").withColumns({"metadata": F.concat(F.lit("{}"), "hostname"), "extra": F.lit(1)})
    return tables.conform(d, tables.TABLES["devices"][0]).select("hostname", "ip_address", "site", "environment", "metadata", "last_seen")
