"""A landing of odd rows and of nothing; profiles of odd views."""

import pytest
from pyspark.sql import functions as F

from snapfold.operators import landing, topology, views

OUTPUTS = "device_name string, command string, snapshot_id string, platform string, raw_output string, pre_scrubbed boolean"
TEMPLATES = "platform string, command string, tier int, pattern string, fields array<string>"
COMMANDS = "platform string, command string, parser_type string"
INVENTORY = "hostname string, ip_address string, platform string, site string, role string"
LONG = "password abc\nname x\n" + "line that goes on\n" * 3


@pytest.fixture
def land(spark):
    def run(rows, **more):
        made = lambda data, ddl: spark.createDataFrame(data, ddl)
        args = {"templates": [("cisco_ios", "show x", 0, r"^name (\S+)$", ["name"])], "commands": [("cisco_ios", "show x", "builtin")], "inventory": [("r1", "1.1.1.1", "ios", "S", "core")], "salt": "s"} | more
        return landing.land_snapshot(made(rows, OUTPUTS), made(args.pop("templates"), TEMPLATES), made(args.pop("commands"), COMMANDS), made(args.pop("inventory"), INVENTORY), made([("show x",)], "command string"), args.pop("salt"), **args)

    return run


def test_nothing_lands(land):
    out = land([], inventory=[], commands=[], templates=[])
    assert tuple(out["totals"].first()) == (0, 0, 0, None)
    assert out["redaction"].first().texts == 0 and not out["redaction"].first().degraded
    assert all(df.count() == 0 for name, df in out.items() if name not in ("totals", "redaction"))


def test_rows_that_lack_or_repeat_something(land):
    rows = [("r1", "show x", "s1", "ios", LONG, None), ("r1", "show x", None, "ios", LONG, None), ("r1", "show x", "s1", "ios", LONG, None), ("r2", "show y", "s1", None, LONG, True), (None, "show x", "s1", "ios", LONG, None), ("r3", " ", "s1", "ios", LONG, None), ("r4", "show x", "s1", "ios", None, None)]
    out = land(rows, bundle={"bundle_id": "b", "bundle_sha256": "sha"})
    assert out["totals"].first().landed == 4 and out["totals"].first().parsed == 3
    assert sorted(r.problem for r in out["refused"].collect()) == ["no command", "no device_name", "no raw_output"]
    assert {(r.device_name, r.command, r.snapshot_id, r.bundle_id, r.bundle_sha256, r.ingested_via) for r in out["outputs"].collect()} == {("r1", "show x", "s1", "b", "sha", "offline"), ("r2", "show y", "s1", "b", "sha", "offline")}
    assert {(r.snapshot_id, r.outputs, r.replacements) for r in out["bundle_ingests"].collect()} == {("s1", 3, 2), (None, 1, 1)}
    seen = out["redaction"].first()
    assert (seen.texts, seen.replacements, seen.degraded, len(seen.salt_fingerprint)) == (4, 3, False, 8)
    assert all("abc" not in r.raw_output for r in out["outputs"].filter("device_name = 'r1'").collect())
    assert {r.hostname for r in out["devices"].collect()} == {"r1", "r2"}
    assert out["v_show_x_auto"].columns == ["device_name", "snapshot_id", "name"] and out["value_profile"].count() == 0
    assert out["v_snapshots_auto"].count() == 2


def test_landing_without_a_salt_is_degraded(land):
    out = land([("r1", "show x", "s1", "ios", LONG, None), ("r2", "show x", "s1", "ios", LONG, True)], salt=None, views=False)
    assert out["redaction"].first().degraded and out["bundle_ingests"].first().degraded and out["redaction"].first().replacements == 0
    assert "value_profile" not in out and "abc" in out["outputs"].first().raw_output


def test_known_devices_and_links_stay(land, spark):
    near = spark.createDataFrame([("r1", "Gi0/1", "r2", "Gi0/2", "cdp", "s0"), ("r8", "Gi0/1", "r9", "Gi0/2", "cdp", "s0")], "device string, local_if string, peer string, peer_if string, protocol string, snapshot_id string")
    hosts = spark.createDataFrame([(h,) for h in ("r1", "r2", "r8", "r9")], "hostname string")
    known = topology.extract_links(near, hosts)
    old = land([], inventory=[("r9", "9.9.9.9", "ios", "T", "wan"), ("r1", "0.0.0.0", "ios", "T", "wan")], views=False)["devices"]
    listing = "Device ID: r2\nEntry address(es):\nInterface: Gi0/1,  Port ID (outgoing port): GigabitEthernet0/2\n"
    out = land([("r1", "show cdp neighbors", "s1", "ios", listing, None), ("r2", "show x", "s1", "ios", LONG, None)], existing_devices=old, existing_links=known, views=False)
    assert {(r.source_device, r.first_snapshot, r.snapshot_id) for r in out["links"].collect()} == {("r1", "s0", "s1"), ("r8", "s0", "s0")}
    assert {r.hostname: r.ip_address for r in out["devices"].collect()} == {"r1": "1.1.1.1", "r2": None, "r9": "9.9.9.9"}


def test_profiles_of_odd_views(spark):
    many = spark.range(500).select(F.concat(F.lit("v"), "id").alias("many"), (F.col("id") % 3).cast("string").alias("few"), F.lit(None).cast("string").alias("none"), F.lit("x").alias("Address"), F.col("id").alias("number"))
    got = views.profile_views({"v_a": many, "v_b": many.limit(0), "v_c": many.select("number")})
    assert {(r.view_name, r.column_name, r.value, r.freq) for r in got.collect()} == {("v_a", "few", "0", 167), ("v_a", "few", "1", 167), ("v_a", "few", "2", 166)}
    assert views.profile_views({}).count() == views.profile_views({"v_c": many.select("number")}).count() == 0
