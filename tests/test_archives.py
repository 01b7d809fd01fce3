"""Archives read member by member: large ones over many tasks, damaged ones refused."""

import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from snapfold.operators import landing
from snapfold.sources import bundles


def test_large_archive_spreads_and_equals_its_tree(spark, tmp_path):
    rnd, tree = random.Random(1), tmp_path / "tree"
    texts = {f"devices/r{i % 50}/show_x{i // 50}.txt": f"# command: show x{i // 50}\n\nname é{i} " + "w " * rnd.randint(0, 40) for i in range(10_000)}
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for n, t in texts.items():
            z.writestr(n, t, zipfile.ZIP_STORED if len(t) % 3 == 0 else None)
    few = dict(list(texts.items())[:40])
    for n, t in few.items():
        (tree / n).parent.mkdir(parents=True, exist_ok=True)
        (tree / n).write_text(t)
    with tarfile.open(tmp_path / "b.tar", "w") as t:
        t.add(tree, "x")
    with tarfile.open(tmp_path / "c.tar.gz", "w:gz") as t:
        t.add(tree, "x")
    members = bundles.archive_members(spark, f"file://{tmp_path}")
    assert members.filter("kind = 'zip'").agg(F.count_distinct("part")).first()[0] == 10
    rows = bundles.expand_archives(spark, f"file://{tmp_path}", 12)
    assert rows.filter("archive like '%a.zip'").select(F.spark_partition_id()).distinct().count() > 4
    got = {r.name: r.text for r in rows.filter("archive like '%a.zip'").collect()}
    assert got == texts
    for name in ("b.tar", "c.tar.gz"):
        assert {r.name: r.text for r in rows.filter(F.col("archive").endswith(name)).collect()} == {f"x/{n}": t for n, t in few.items()}
    own = lambda df: sorted((r.host, r.file, r.text) for r in df.select("host", "file", "text").collect())
    assert own(bundles.members_as_files(rows.filter("archive like '%b.tar'"))) == own(bundles.read_bundle(spark, f"file://{tree}"))

    outputs = bundles.parse_headers(bundles.members_as_files(rows.filter("archive like '%a.zip'"))).select(F.col("host").alias("device_name"), "command", F.lit("s").alias("snapshot_id"), F.lit("ios").alias("platform"), F.col("body").alias("raw_output"))
    made = spark.createDataFrame
    out = landing.land_snapshot(outputs, made([], "platform string, command string, tier int, pattern string, fields array<string>"), made([], "platform string, command string, parser_type string"), made([], "hostname string, ip_address string, platform string, site string, role string"), made([], "command string"), "s", views=False)
    assert out["totals"].first().landed == 10_000 and out["devices"].count() == 50


def test_damaged_and_odd_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("x.txt", "some text")
        z.writestr("dir/", "")
    data = (tmp_path / "a.zip").read_bytes().replace(b"some text", b"some tex!", 1)
    (tmp_path / "a.zip").write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        bundles.expand_archives(spark, f"file://{tmp_path}").collect()
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_LZMA) as z:
        z.writestr("x.txt", "some text")
    with pytest.raises(Exception, match="not read"):
        bundles.expand_archives(spark, f"file://{tmp_path}").collect()
    with zipfile.ZipFile(tmp_path / "a.zip", "w"):
        pass
    assert bundles.expand_archives(spark, f"file://{tmp_path}").count() == 0
