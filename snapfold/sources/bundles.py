"""Bundles of captured output: files to rows, headers, manifests, archives, checks."""

from __future__ import annotations

import hashlib
import io
import json
import re
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.text import sniff_platform


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """host, file, text, length of every devices/<host>/<command>.txt under the path; dot files and _meta files are no outputs."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path)
    at = r"devices/([^/]+)/([^/]+)\.txt$"
    rows = files.select(F.regexp_extract("path", at, 1).alias("host"), F.regexp_extract("path", at, 2).alias("file"), F.decode("content", "UTF-8").alias("text"), "length")
    return rows.filter("host <> '' and file not like '.%' and file not like '\\\\_%'")


def parse_headers(files: DataFrame) -> DataFrame:
    """files with command, collected_at, pre_scrubbed from leading '# key: value' lines, and the body behind them."""
    block = r"^((?:\s*#[^\n]*\n)*)\n?"
    head = F.regexp_extract("text", block, 1)
    value = lambda k: F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^\s*#+\s*{k}:\s*(.+)$", 1)), F.lit(""))
    return files.select(
        *[c for c in files.columns if c != "text"], F.coalesce(value("command"), F.regexp_replace("file", "_", " ")).alias("command"), value("collected_at").alias("collected_at"),
        (F.lower(value("pre_scrubbed")) == "true").alias("pre_scrubbed"), F.regexp_replace("text", block, "").alias("body"),
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come bundle by bundle in order; only the running digest is held."""
    now, digest, hosts, last, n = None, None, 0, None, 0
    done: list[tuple] = []
    for batch in batches:
        for bundle, host, text in zip(*(batch.column(c).to_pylist() for c in ("bundle", "host", "text")), strict=True):
            if digest is None or bundle != now:
                done += [(now, digest.hexdigest(), hosts, n)] if digest else []
                now, digest, hosts, last, n = bundle, hashlib.sha256(), 0, None, 0
            digest.update((text or "").encode())
            hosts, last, n = hosts + (host != last), host, n + 1
    done += [(now, digest.hexdigest(), hosts, n)] if digest else []
    yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["bundle", "sha256", "hosts", "commands"])


def bundle_digest(files: DataFrame) -> DataFrame:
    """sha256 over each bundle's texts by host, then file. files: bundle, host, file, text.

    A bundle is one digest and so one task's work; its files stream through it in order, and none is held.
    """
    rows = files.select(F.col("bundle").cast("string").alias("bundle"), "host", "file", "text")
    return rows.repartition("bundle").sortWithinPartitions("bundle", "host", "file").select("bundle", "host", "text").mapInArrow(_digests, "bundle string, sha256 string, hosts long, commands long")


def _yaml(text: str | None) -> dict:
    import yaml

    try:
        held = yaml.safe_load(text or "")
    except yaml.YAMLError:
        return {}
    return held if isinstance(held, dict) else {}


def _yaml_json(files: DataFrame) -> DataFrame:
    """files with `held`, the YAML document of each as JSON; a broken one is {}. Each is small: a manifest, or one host's."""

    @F.pandas_udf(StringType())
    def held(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(_yaml(t), default=str))

    return files.withColumn("held", held("text"))


MANIFEST = "schema_version int, collector struct<name: string, version: string>, collected_at string, collected_by string, workspace_id string, hosts_collected int, hosts_failed int, redaction struct<pre_scrubbed: boolean, salt_fingerprint: string>, content_sha256 string, templates struct<count: int, sha256: string>"
META = "hostname string, mgmt_ip string, platform string, vendor string, os_version string, model string, commands_attempted int, commands_succeeded int, commands_failed int, collected_at string"


def read_yaml(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """path and the fields of schema of every YAML file of this name under the path. Fields that a file lacks are null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "true").load(path)
    rows = _yaml_json(files.select("path", F.decode("content", "UTF-8").alias("text")))
    return rows.select("path", F.from_json("held", schema).alias("m")).select("path", "m.*")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return read_yaml(spark, path, "manifest.yaml", MANIFEST)


def read_metas(spark: SparkSession, path: str) -> DataFrame:
    """path and the fields of META of the _meta.yaml beside each host's outputs.

    Spark's readers pass over names that begin with an underscore, so tasks open these small files themselves, one for each
    host folder that the listing of the outputs names.
    """

    @F.pandas_udf(StringType())
    def held(folders: pd.Series) -> pd.Series:
        from pyarrow import fs

        def one(folder: str) -> str | None:
            system, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder) + "/_meta.yaml")
            if system.get_file_info(at).type == fs.FileType.NotFound:
                return None
            with system.open_input_stream(at) as f:
                return json.dumps(_yaml(f.read().decode("utf-8", "replace")), default=str)

        return folders.map(one)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path)
    folders = files.select(F.regexp_extract("path", r"^(.*/devices/[^/]+)/[^/]+$", 1).alias("path")).filter("path <> ''").distinct()
    return folders.select("path", F.from_json(held("path"), META).alias("m")).filter("m is not null").select("path", "m.*")


def with_meta(files: DataFrame, metas: DataFrame) -> DataFrame:
    """files with platform, mgmt_ip and vendor of their host; hosts without a meta file have nulls."""
    known = metas.groupBy(F.col("hostname").alias("host")).agg(*[F.min(c).alias(c) for c in ("platform", "mgmt_ip", "vendor")])
    return files.join(known, "host", "left")


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """hostname, ip_address, platform, role, site, environment, groups, aliases, extra (a map) of each host in hosts.yaml files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "hosts.yaml").option("recursiveFileLookup", "true").load(path)
    held = _yaml_json(files.select("path", F.decode("content", "UTF-8").alias("text"))).select(F.explode(F.from_json("held", "map<string,string>")).alias("hostname", "entry"))
    data = F.from_json(F.get_json_object("entry", "$.data"), "map<string,string>")
    value = lambda k: F.element_at("data", k)
    own = ("role", "site", "environment", "aliases")
    rows = held.select("hostname", F.get_json_object("entry", "$.hostname").alias("ip_address"), F.get_json_object("entry", "$.platform").alias("platform"), F.from_json(F.get_json_object("entry", "$.groups"), "array<string>").alias("groups"), F.coalesce(data, F.create_map().cast("map<string,string>")).alias("data"))
    return rows.select("hostname", "ip_address", "platform", *[value(c).alias(c) for c in own[:3]], "groups", F.from_json(value("aliases"), "array<string>").alias("aliases"), F.map_filter("data", lambda k, _: ~k.isin(*own)).alias("extra"))


def dump_facts(dump: DataFrame) -> DataFrame:
    """host, platform, mgmt_ip of a command-major dump: the first banner that names a platform, the first address of the interface brief."""
    address = F.regexp_extract("text", r"\b(\d{1,3}(?:\.\d{1,3}){3})\b", 1)
    brief = F.when(F.col("command").rlike("interfaces? brief|interfaces terse") & (address != ""), address)
    named = F.min(F.when(sniff_platform(F.col("text")).isNotNull(), F.struct("command", sniff_platform(F.col("text")).alias("p"))))
    return dump.groupBy("host").agg(named["p"].alias("platform"), F.min(F.when(brief.isNotNull(), F.struct("command", brief.alias("ip"))))["ip"].alias("mgmt_ip"))


def validate_bundles(digests: DataFrame, manifests: DataFrame, allowed_templates: DataFrame | None = None) -> DataFrame:
    """bundle, errors, warnings. manifests: bundle, content_sha256, hosts_collected and, if given, templates (count, sha256).

    With allowed_templates (sha256, count) a bundle's template set must be one of them (error) and of its size (warning).
    """
    both = manifests.join(digests, "bundle", "left")
    errors = [F.when(F.coalesce("commands", F.lit(0)) == 0, "empty tree"), F.when(F.col("sha256") != F.col("content_sha256"), "digest differs")]
    warnings = [F.when(F.col("hosts") != F.col("hosts_collected"), "host count differs")]
    if allowed_templates is not None:
        known = allowed_templates.groupBy(F.col("sha256").alias("_set")).agg(F.max("count").alias("_count"))
        both = both.join(known, F.col("templates.sha256") == F.col("_set"), "left")
        errors.append(F.when(F.col("templates.sha256").isNotNull() & F.col("_set").isNull(), "unknown templates"))
        warnings.append(F.when(F.col("_count") != F.col("templates.count"), "template count differs"))
    return both.select("bundle", F.array_compact(F.array(*errors)).alias("errors"), F.array_compact(F.array(*warnings)).alias("warnings"))


class _File(io.RawIOBase):
    """A file of Spark's listing for reading at any place; a place before its start is an OSError, as archive readers expect."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
        self.file = system.open_input_file(at)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:  # noqa: ANN001
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (0, self.file.tell(), self.file.size())[whence]
        if at < 0:
            raise OSError("before the start of the file")
        return self.file.seek(at)

    def tell(self) -> int:
        return self.file.tell()

    def close(self) -> None:
        self.file.close()
        super().close()


def _open(path: str) -> io.BufferedReader:
    return io.BufferedReader(_File(path), 1 << 16)


#: Compressed bytes of an archive that one task inflates, about, and rows of a batch.
GROUP_BYTES, GROUP_ROWS = 8 << 20, 1000
_MEMBER = "archive string, name string, kind string, offset long, packed long, size long, method int, crc long, part long"


def _members(archive: str) -> Iterator[tuple]:
    """archive, name, kind, offset, packed, size, method, crc, part of each file of an archive, from its directory or its headers.

    Only a zip's directory and the headers of a tar are read; a compressed tar has no places to jump to, so it is one part.
    """
    if re.search(r"\.(tgz|tar\.gz)$", archive):
        yield archive, None, "stream", 0, 0, 0, 0, 0, 0
        return
    with _open(archive) as f:
        if archive.endswith(".zip"):
            with zipfile.ZipFile(f) as z:
                found = [(i.filename, "zip", i.header_offset, i.compress_size, i.file_size, i.compress_type if not i.flag_bits & 1 else -1, i.CRC) for i in z.infolist() if not i.is_dir()]
        else:
            with tarfile.open(fileobj=f) as t:
                found = [(m.name, "tar", m.offset_data, m.size, m.size, 0, 0) for m in t if m.isfile() and not m.issparse()]
    held = part = rows = 0
    for name, kind, offset, packed, size, method, crc in sorted(found, key=lambda m: m[2]):
        if rows and (held + packed > GROUP_BYTES or rows >= GROUP_ROWS):
            held, rows, part = 0, 0, part + 1
        held, rows = held + packed, rows + 1
        yield archive, name, kind, offset, packed, size, method, crc, part


def _directories(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split(" ")[0] for c in _MEMBER.split(", ")]
    for pdf in batches:
        for archive in pdf["path"]:
            yield pd.DataFrame(list(_members(archive)), columns=columns)


def _inflated(f, m) -> bytes:  # noqa: ANN001
    """The bytes of one member; a zip's local header says how far behind it they begin."""
    if m.kind == "tar":
        f.seek(m.offset)
        return f.read(m.size)
    if m.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError(f"{m.archive}: {m.name} is encrypted or packed in a way that is not read")
    f.seek(m.offset)
    names, extra = struct.unpack("<HH", f.read(30)[26:])
    f.seek(m.offset + 30 + names + extra)
    raw = f.read(m.packed)
    out = raw if m.method == zipfile.ZIP_STORED else zlib.decompress(raw, -15)
    if zlib.crc32(out) != m.crc:
        raise ValueError(f"{m.archive}: {m.name} is damaged")
    return out


def _inflate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come archive by archive; each file is opened once for a run of its members, and a member's text is held alone."""
    for pdf in batches:
        for archive, own in pdf.groupby("archive", sort=False):
            if (own["kind"] == "stream").any():
                with _open(archive) as f, tarfile.open(fileobj=f, mode="r|gz") as t:
                    for m in t:
                        if m.isfile():
                            yield pd.DataFrame([(archive, m.name, t.extractfile(m).read().decode("utf-8", "replace"))], columns=["archive", "name", "text"])
                continue
            with _open(archive) as f:
                for some in (own.iloc[i : i + 100] for i in range(0, len(own), 100)):
                    yield pd.DataFrame([(archive, m.name, _inflated(f, m).decode("utf-8", "replace")) for m in some.itertuples()], columns=["archive", "name", "text"])


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, name, kind, offset, packed, size, method, crc, part of each file in the .zip, .tar and .tgz archives of a path.

    The content of archives is not read. part numbers runs of members of about GROUP_BYTES; a .tgz is one row of kind stream.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{zip,tar,tgz,tar.gz}").option("recursiveFileLookup", "true").load(path)
    return files.select("path").mapInPandas(_directories, _MEMBER)


def expand_archives(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """archive, name, text of each file in the .zip, .tar and .tgz archives of a path.

    Archives are opened by their directories, and runs of members, each read at its own place, are dealt out over tasks: a
    large archive is the work of many, and none holds it. A .tgz streams through one task, member by member. Damaged,
    encrypted or oddly packed members fail the job. Names that occur twice in an archive give two rows.
    """
    members = archive_members(spark, path)
    dealt = members.repartition(partitions, "archive", "part") if partitions else members.repartition("archive", "part")
    return dealt.sortWithinPartitions("archive", "offset").mapInPandas(_inflate, "archive string, name string, text string")


def members_as_files(members: DataFrame) -> DataFrame:
    """host, file, text, length of the outputs among expanded members, in the shape of read_bundle()."""
    at = r"devices/([^/]+)/([^/]+)\.txt$"
    rows = members.select(F.regexp_extract("name", at, 1).alias("host"), F.regexp_extract("name", at, 2).alias("file"), "text", F.octet_length("text").cast("long").alias("length"))
    return rows.filter("host <> '' and file not like '.%' and file not like '\\\\_%'")


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """command, host, text of a command-major dump network_data/<command>/<host>."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    at = r"network_data/([^/]+)/([^/]+)$"
    return files.select(F.regexp_replace(F.regexp_extract("path", at, 1), "_", " ").alias("command"), F.regexp_extract("path", at, 2).alias("host"), F.decode("content", "UTF-8").alias("text")).filter("host <> ''")


def read_staging(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Staging files of JSON arrays; malformed ones are passed over."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(glob)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """A tree of log files, whose columns are merged by name."""
    return spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(path)


def survey(files: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """bundle, format, hosts, files from a listing (bundle, path); with texts (bundle, host, text) also the platform most of its hosts
    speak of, and how many hosts speak of none."""
    has = lambda p: F.max(F.col("path").rlike(p).cast("int")) == 1
    kind = F.when(has(r"devices/[^/]+/[^/]+\.txt$"), "canonical").when(has(r"network_data/"), "vendor_dump").when(has(r"router\.db$"), "rancid").when(has(r"(?i)tech-?support"), "tech_support").otherwise("unknown")
    host = F.regexp_extract("path", r"devices/([^/]+)/", 1)
    out = files.groupBy("bundle").agg(kind.alias("format"), F.count_distinct(F.when(host != "", host)).alias("hosts"), F.count(F.lit(1)).alias("files"))
    if texts is None:
        return out
    each = texts.groupBy("bundle", "host").agg(F.min(sniff_platform(F.col("text"))).alias("platform"))
    votes = each.groupBy("bundle", "platform").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.when(F.col("platform").isNotNull(), F.struct("n", "platform")))["platform"].alias("platform_guess")
    return out.join(votes.groupBy("bundle").agg(best, F.coalesce(F.sum(F.when(F.col("platform").isNull(), F.col("n"))), F.lit(0)).alias("undetected")), "bundle", "left")
