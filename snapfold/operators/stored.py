"""Tables in the shared folder: written intermediate results, and versioned tables that are switched as a whole."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

POINTER = "CURRENT"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, one of our own in local mode; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="snapfold-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Intermediate tables of one job: put() writes and rereads one, which cuts lineage; drop() deletes tables that nothing reads any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def union(self, *tables: DataFrame) -> DataFrame:
        """Tables of one schema as one scan, so that a plan does not grow with their number."""
        return self.spark.read.schema(tables[0].schema).parquet(*[self.paths[id(t)][1] for t in tables])

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete(self.spark, self.paths.pop(id(t))[1])


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):  # noqa: ANN202
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    _system(spark, path).delete(_path(spark, path), True)


def current_version(spark: SparkSession, home: str) -> str | None:
    """The folder that the pointer of a versioned table names; None where there is no table yet."""
    try:
        name = spark.read.text(f"{home}/{POINTER}").first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return f"{home}/{name[0]}" if name else None


def read_current(spark: SparkSession, home: str) -> DataFrame:
    """The table as it was last switched. What is read stays whole while a refresh goes on: versions are never changed."""
    path = current_version(spark, home)
    if path is None:
        raise FileNotFoundError(home)
    return spark.read.parquet(path)


def replace_table(df: DataFrame, home: str, keep: int = 1, before_switch: Callable[[], None] | None = None) -> str:
    """Writes df as a new version of the table and switches the pointer to it last; returns the version's folder.

    The pointer is a small file that is written beside and renamed over the old one, in one step where the file system
    renames atomically. Whatever fails before it leaves the old version current. `keep` earlier versions stay for readers
    that have begun; older ones, and what broken refreshes left behind, are deleted after the switch. before_switch runs
    between the two (for checks). One refresh of a table goes on at a time.
    """
    spark = df.sparkSession
    old = current_version(spark, home)
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{home}/{name}")
    if before_switch is not None:
        before_switch()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs = _system(spark, home)
    beside = _path(spark, f"{home}/_next-{name}")
    out = fs.create(beside, True)
    out.write(bytearray(name.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    target = fs.makeQualified(_path(spark, f"{home}/{POINTER}"))
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(fs.makeQualified(beside), target, over)
    _clean(spark, home, {name, (old or "").rsplit("/", 1)[-1]}, keep)
    return f"{home}/{name}"


def _clean(spark: SparkSession, home: str, kept: set[str], keep: int) -> None:
    """Deletes versions that are neither current nor among the newest `keep` others, the one before the switch first of all."""
    fs = _system(spark, home)
    found = [s for s in fs.listStatus(_path(spark, home)) if s.getPath().getName().startswith("v-")]  # a table has few versions
    others = sorted((s for s in found if s.getPath().getName() not in kept), key=lambda s: -s.getModificationTime())
    for s in others[max(0, keep - 1) :]:
        fs.delete(s.getPath(), True)
