"""Files that a test writes: bundles, manifests, inventories, archives, dumps, exports; streams; what-if questions; odd values."""

import hashlib
import io
import json
import tarfile
import zipfile
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from snapfold.functions import network as net
from snapfold.operators import catalog, landing, layers, policy, search, stored, tables, text, topology, views
from snapfold.sources import bundles
from snapfold.streaming import logs as streams


@pytest.fixture(scope="module")
def bundle(tmp_path_factory):
    home = tmp_path_factory.mktemp("bundle") / "b1"
    for host, platform in (("r1", "cisco_ios"), ("r2", "juniper_junos")):
        at = home / "devices" / host
        at.mkdir(parents=True)
        (at / "_meta.yaml").write_text(f"hostname: {host}\nmgmt_ip: 10.0.0.{host[1]}\nplatform: {platform}\nvendor: v\ncommands_attempted: 2\n")
        (at / "show_version.txt").write_text(f"# command: show version\n# pre_scrubbed: true\n\nhostname {host}\n")
        (at / "show_ip_route.txt").write_text("10.0.0.0/8 via é\n")
    (home / "devices" / "r1" / ".hidden.txt").write_text("no")
    (home / "manifest.yaml").write_text("schema_version: 1\ncollector: {name: c, version: '2'}\nhosts_collected: 2\ncontent_sha256: abc\ntemplates: {count: 3, sha256: t1}\nextra: x\n")
    (home / "hosts.yaml").write_text("r1: {hostname: 10.0.0.1, platform: ios, groups: [a, b], data: {role: core, site: S, aliases: [x1], rack: 7}}\nr2: {hostname: 10.0.0.2}\n")
    (home.parent / "broken").mkdir()
    (home.parent / "broken" / "manifest.yaml").write_text("a: [")
    return home


def test_bundle_files(spark, bundle):
    files = bundles.read_bundle(spark, str(bundle))
    heads = {(r.host, r.command): r for r in bundles.parse_headers(files).collect()}
    assert set(heads) == {("r1", "show version"), ("r2", "show version"), ("r1", "show ip route"), ("r2", "show ip route")}
    assert heads["r1", "show version"].pre_scrubbed and heads["r1", "show version"].body == "hostname r1\n"
    met = {r.host: (r.platform, r.mgmt_ip) for r in bundles.with_meta(files, bundles.read_metas(spark, str(bundle))).collect()}
    assert met == {"r1": ("cisco_ios", "10.0.0.1"), "r2": ("juniper_junos", "10.0.0.2")}
    names = sorted((p.parent.name, p.stem) for p in (bundle / "devices").glob("*/show*.txt"))
    want = hashlib.sha256(b"".join((bundle / "devices" / h / f"{f}.txt").read_bytes() for h, f in names)).hexdigest()
    digests = bundles.bundle_digest(files.withColumn("bundle", F.lit("b1")).unionByName(files.withColumn("bundle", F.lit("b2"))))
    assert {tuple(r) for r in digests.collect()} == {("b1", want, 2, 4), ("b2", want, 2, 4)}


def test_manifests(spark, bundle):
    read = {r.path.rsplit("/", 2)[1]: r for r in bundles.read_manifests(spark, str(bundle.parent)).collect()}
    assert read["b1"].hosts_collected == 2 and read["b1"].collector.name == "c" and read["broken"].schema_version is None
    m = bundles.read_manifests(spark, str(bundle)).withColumn("bundle", F.lit("b1"))
    digests = spark.createDataFrame([("b1", "abc", 3, 4)], "bundle string, sha256 string, hosts long, commands long")
    allowed = spark.createDataFrame([("t1", 4)], "sha256 string, count int")
    (r,) = bundles.validate_bundles(digests, m, allowed).collect()
    assert r.errors == [] and r.warnings == ["host count differs", "template count differs"]
    (r,) = bundles.validate_bundles(digests, m, allowed.filter("count = 0")).collect()
    assert r.errors == ["unknown templates"]


def test_inventory(spark, bundle):
    rows = {r.hostname: r for r in bundles.read_inventory(spark, str(bundle)).collect()}
    assert rows["r1"].role == "core" and rows["r1"].groups == ["a", "b"] and rows["r1"].aliases == ["x1"] and rows["r1"].extra == {"rack": "7"}
    assert rows["r2"].ip_address == "10.0.0.2" and rows["r2"].role is None and rows["r2"].extra == {}


def test_archives_dumps_and_survey(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/1.txt", "one")
    with tarfile.open(tmp_path / "b.tgz", "w:gz") as t:
        info = tarfile.TarInfo("y.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"two"))
    assert {(r.name, r.text) for r in bundles.expand_archives(spark, str(tmp_path)).collect()} == {("x/1.txt", "one"), ("y.txt", "two")}
    for command, host, body in (("show_version", "r1.example", "Cisco IOS Software"), ("show_ip_interface_brief", "r1.example", "Gi0/0 10.1.2.3 up"), ("show_version", "r2", "none")):
        (tmp_path / "network_data" / command).mkdir(parents=True, exist_ok=True)
        (tmp_path / "network_data" / command / host).write_text(body)
    dump = bundles.read_dump(spark, str(tmp_path / "network_data"))
    assert {tuple(r) for r in bundles.dump_facts(dump).collect()} == {("r1.example", "cisco_ios", "10.1.2.3"), ("r2", None, None)}
    listing = spark.createDataFrame([("b", "b/devices/r1/a.txt"), ("b", "b/devices/r2/a.txt"), ("c", "c/router.db"), ("d", "d/x")], "bundle string, path string")
    texts = spark.createDataFrame([("b", "r1", "Cisco IOS"), ("b", "r2", "?")], "bundle string, host string, text string")
    assert {tuple(r) for r in bundles.survey(listing, texts).collect()} == {("b", "canonical", 2, 2, "cisco_ios", 1), ("c", "rancid", 0, 1, None, None), ("d", "unknown", 0, 1, None, None)}


def test_staging_and_logs(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "1.json").write_text(json.dumps([{"device_name": "r1", "command": "c"}, {"device_name": "r2"}]))
    assert {r.device_name for r in bundles.read_staging(spark, f"{tmp_path}/s/*.json", "device_name string, command string").collect()} == {"r1", "r2"}
    for day, more in (("2024-01-01", {}), ("2024-01-02", {"facility": "f"})):
        (tmp_path / "l" / day).mkdir(parents=True)
        pd.DataFrame([{"host": "h", "message": day, **more}]).to_parquet(tmp_path / "l" / day / "syslog-00.parquet")
    assert {(r.message, r.facility) for r in bundles.read_logs(spark, f"{tmp_path}/l").collect()} == {("2024-01-01", None), ("2024-01-02", "f")}


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    first = landing.export_csv(df, str(tmp_path))
    before = {p.name: p.stat().st_mtime_ns for p in __import__("pathlib").Path(first).iterdir()}
    assert landing.export_csv(df.orderBy(F.desc("k")), str(tmp_path)) == first and landing.export_csv(df.limit(1), str(tmp_path)) != first
    assert before == {p.name: p.stat().st_mtime_ns for p in __import__("pathlib").Path(first).iterdir()}
    catalog.refresh(df, f"{tmp_path}/t"), catalog.refresh(df.limit(1), f"{tmp_path}/t")
    assert stored.read_current(spark, f"{tmp_path}/t").count() == 1
    raw = spark.createDataFrame([("r1", "show running-config", "s1", "text")], "device_name string, command string, snapshot_id string, raw_output string")
    stamped = tables.stamp_bundle(raw, "s1", "b", "sha", "offline").first()
    assert (stamped.bundle_id, stamped.ingested_via) == ("b", "offline")


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("2024-01-01 00:00:00", "h", "p", "up"), ("2024-01-01 00:01:00", "h", "p", "down"), ("2024-01-01 00:01:00", "h", "p", "down"), ("2024-01-01 00:05:00", "h", "p", "up"), ("2024-01-01 00:00:00", "h", "q", "up")]
    spark.createDataFrame(rows, "timestamp string, host string, severity string, message string").withColumn("timestamp", F.to_timestamp("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("timestamp timestamp, host string, severity string, message string").parquet(f"{tmp_path}/in")

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
        return [tuple(r) for r in spark.table(name).collect()]

    assert len(run(streams.dedup_in_flight(stream(), ["timestamp", "host", "severity", "message"]), "once", "append")) == 4
    assert sum(r[3] for r in run(streams.severity_windows(stream(), "1 hour", "1 minute"), "counts", "complete")) == 5
    assert {(r[0], r[3]) for r in run(streams.host_sessions(stream(), "2 minutes", "1 minute"), "runs", "complete")} == {("h", 4), ("h", 1)}
    q = streams.land_stream(stream(), streams.upsert_into(f"{tmp_path}/out", ["host", "severity"], ["timestamp", "message"]), f"{tmp_path}/cp")
    assert q.awaitTermination(120)
    streams.upsert_into(f"{tmp_path}/out", ["host", "severity"], ["timestamp", "message"])(spark.read.parquet(f"{tmp_path}/in"), 0)  # the batch once more
    assert {(r.severity, r.message) for r in streams.landed(spark, f"{tmp_path}/out", ["host", "severity"], ["timestamp", "message"]).collect()} == {("p", "up"), ("q", "up")}


def brute_components(nodes, edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    seen, out = set(), []
    for n in nodes:
        if n not in seen:
            comp, todo = set(), [n]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp.add(x)
                    todo += near[x]
            seen |= comp
            out.append(len(comp))
    return out


def test_blast_radius_of_devices_and_links(spark):
    import random

    rnd = random.Random(3)
    nodes = [f"n{i:02}" for i in range(40)]
    edges = sorted({tuple(sorted(rnd.sample(nodes, 2))) for _ in range(34)})
    down = [("a", nodes[0]), ("a", nodes[7]), ("b", nodes[3]), ("c", "unknown")]
    cut = [("b", *edges[0]), ("d", edges[1][1], edges[1][0]), ("d", *edges[2])]
    got = {r.scenario: r[1:] for r in topology.blast_radius(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(down, "scenario string, device string"), spark.createDataFrame(cut, "scenario string, src string, dst string")).collect()}
    before = brute_components(nodes, edges)
    for s in "abcd":
        gone, lost = {d for k, d in down if k == s}, {frozenset(e) for k, *e in cut if k == s}
        left = [n for n in nodes if n not in gone]
        after = brute_components(left, [e for e in edges if frozenset(e) not in lost and not gone & set(e)])
        assert got[s] == (len(after), max(after), sum(n == 1 for n in after), len(before), max(before)), s


def test_adjacency_scope(spark):
    d = spark.createDataFrame([("a", "core", "s"), ("b", None, "s")], "hostname string, role string, site string")
    e = spark.createDataFrame([("a", "i", "b", "j", "up", "s1"), ("b", "i", "c", "j", "up", "s1"), ("c", "i", "d", "j", "up", "s2")], "src string, sif string, dst string, dif string, status string, snapshot_id string")
    with pytest.raises(ValueError, match="scope"):
        layers.adjacency_table(e, d)
    with pytest.raises(ValueError, match="more than 1"):
        layers.adjacency_table(e, d, center="a", hops=1, max_hosts=1)
    assert {r.src for r in layers.adjacency_table(e, d, roles=["core"]).collect()} == {"a"}
    assert {r.src for r in layers.adjacency_table(e, d, center="a", hops=2).collect()} == {"a", "b"}
    assert layers.adjacency_table(e, d, center="zz").count() == 0


def test_layers_of_odd_rows(spark):
    rows = [("r1", "show ip ospf neighbor", "s1", '[{"Neighbor_ID": "1.1.1.1", "state": null}, {"state": "FULL"}]'), ("r1", "show ip ospf neighbor", "s1", "nope"), ("r2", "SHOW IP OSPF NEIGHBOR", "s1", None), ("r2", "show ip ospf neighbor", "s0", '[{"neighbor_id": "2.2.2.2"}]')]
    parsed = spark.createDataFrame(rows, "device_name string, command string, snapshot_id string, parsed_data string")
    assert [tuple(r)[:5] for r in layers.ospf_layer(parsed).collect()] == [("r1", "1.1.1.1", None, None, "")]
    assert layers.ospf_layer(parsed, scope=["r2"]).count() == 0 and layers.ospf_layer(parsed, "s0").count() == 1
    out, absent = layers.query_topology(parsed, None, concept="all", snapshot="s1")
    assert out["ospf"].first()["errors"] == ["interface", "state"] and {r.layer for r in absent.collect()} == {"bgp", "l2"}
    assert layers.layer_neighbors(layers.layer_edges(layers.ospf_layer(parsed), "ospf"), "1.1.1.1").collect()[0].node == "r1"


def test_validation(spark):
    rows = [("a", "10.0.0.1", "65000", None, "Established"), ("", "10.0.0.999", "x", "y", "Up"), ("b", "2001:db8::1", "1", "2", "Idle")]
    df = spark.createDataFrame(rows, "device string, neighbor_ip string, neighbor_as string, local_as string, state string")
    assert [r.errors for r in layers.validate_rows(df, "bgp").collect()] == [[], ["device", "neighbor_ip", "neighbor_as", "local_as", "state"], []]


def test_typed_views(spark):
    rows = [("r1", "Show X/y", "s2", '[{"a": 1, "b": {"c": "t", "d": 2.5}, "l": [1, 2]}, {"a": 3}]'), ("r1", "Show X/y", "s1", '[{"a": 9}]'), ("r2", "Show X/y", "s1", '[{"a": 7, "b": {"c": "u"}}]'), ("r1", "other", "s1", '{"not": "a list"}')]
    built = views.build_views(spark.createDataFrame(rows, "device_name string, command string, snapshot_id string, parsed_data string"))
    assert set(built) == {"v_show_x_y_auto"}
    view = built["v_show_x_y_auto"]
    assert dict(view.dtypes)["a"] == "bigint" and {"b_c", "b_d", "l"} <= set(view.columns)
    assert Counter((r.device_name, r.a, r.b_c, float(r.b_d) if r.b_d is not None else None, r.l) for r in view.collect()) == Counter([("r1", 1, "t", 2.5, "[1,2]"), ("r1", 3, None, None, None), ("r2", 7, "u", None, None)])


def test_route_maps_keep_text_order_and_stanzas(spark):
    lines = ["route-map A permit 10", " set metric 2", " match z", " match a", "!", "route-map A permit 10", " match q", "", " match lost", "route-map B deny 5"]
    maps = policy.route_maps(spark.createDataFrame([("r", "\n".join(lines))], "device_name string, raw_output string")).orderBy("place").collect()
    assert [(r.policy, r.action, r.seq, r.matches, r.sets) for r in maps] == [("A", "permit", 10, ["match z", "match a"], ["set metric 2"]), ("A", "permit", 10, ["match q"], []), ("B", "deny", 5, [], [])]


def test_plan_check_of_wide_subnets_and_interfaces(spark):
    used = spark.createDataFrame([("r1", "Gi0/1", "10.1.0.1"), ("r1", "Gi0/2", "10.200.3.4"), ("r2", "Gi0/1", None)], "device_name string, interface string, ip_address string")
    claims = spark.createDataFrame([(1, "r1", "10.0.0.0/8", "GigabitEthernet0/1"), (2, "r1", "10.1.0.0/30", "Gi0/9"), (3, "rx", "0.0.0.0/0", "Gi0/1"), (4, "r2", "10.128.0.0/9", "Gi0/1"), (5, "r2", "11.0.0.0/12", None)], "claim int, device string, subnet string, interface string")
    got = {r.claim: (r.device_known, r.in_use, r.interface_known, r.interface_address) for r in search.plan_check(claims, used).collect()}
    assert got == {1: (True, 2, True, "10.1.0.1"), 2: (True, 1, False, None), 3: (False, 2, False, None), 4: (True, 1, True, None), 5: (True, 0, False, None)}


def test_secrets_that_look_like_patterns(spark):
    value = spark.createDataFrame([("password a\\Eb.*c\nsecret $1",)], "x string").select(text.redact_text(F.col("x"), "s").alias("y")).first().y
    assert r"\E" not in value and value.count("removed_") == 2
    doc = spark.createDataFrame([(json.dumps({"my_apikey": "k", "credentials": "c", "passwd": 5, "auth_header": "h", "tokens_in": 3}),)], "j string")
    assert json.loads(text.redact_json(doc, "j").first().j) == {"my_apikey": "REDACTED", "credentials": "REDACTED", "passwd": "REDACTED", "auth_header": "REDACTED", "tokens_in": 3}


def test_pre_scrubbed_texts_stay(spark):
    outputs = spark.createDataFrame([("r1", "c", "s", "ios", "password abc", True), ("r2", "c", "s", "ios", "password abc", False)], "device_name string, command string, snapshot_id string, platform string, raw_output string, pre_scrubbed boolean")
    templates = spark.createDataFrame([], "platform string, command string, tier int, pattern string, fields array<string>")
    got = {r.device_name: r.raw_output for r in landing.landed_outputs(outputs, templates, "s").collect()}
    assert got["r1"] == "password abc" and "removed_" in got["r2"]


@pytest.mark.parametrize(("host", "role", "kind"), [("a-fw1", None, "firewall"), ("x.r2.net", None, "router"), ("r", None, "switch"), ("edge-7", None, "router"), ("sw1", None, "switch"), ("r1", "FW", "firewall"), ("asr9k-1", None, "router"), ("lab-asr1001x", None, "router"), ("bgprr1", None, "router"), ("fw12", None, "switch"), ("xr1", None, "switch"), ("my_core", None, "router"), ("cores", None, "switch"), ("any", "core", "router"), ("asa-1", "dist", "switch")])
def test_device_kind(spark, host, role, kind):
    df = spark.createDataFrame([(host, role)], "h string, r string")
    assert df.select(net.device_kind(F.col("h"), F.col("r")).alias("k")).first().k == kind


@pytest.mark.parametrize(("field", "value", "want"), [("ip_mtu", "1500", "1500"), ("ip_address", "2001:DB8:0:0::1/64", "2001:db8::1/64"), ("ip", "10.00.0.1", "10.00.0.1"), ("link_state", "connected", "up"), ("state", "no such", "no such"), ("local_port", "Gi0/1", "GigabitEthernet0/1"), ("remote_as", "1.1", "65537"), ("chassis_id", "aabb.ccdd.eeff", "aa:bb:cc:dd:ee:ff"), ("ip", "unassigned", "unassigned"), ("x", "  a ", "a"), ("x", " ", ""), ("router_id", "::FFFF", "::ffff")])
def test_normalised(spark, field, value, want):
    df = spark.createDataFrame([(value, field)], "v string, f string")
    assert tuple(df.select(net.normalised(field, F.col("v")), net.normalised_by(F.col("f"), F.col("v"))).first()) == (want, want)


def test_log_search_widens(spark):
    logs = spark.createDataFrame([("2024-01-01 01:00:00", "h", "ERROR", "boom")], "t string, host string, severity string, message string").select(F.to_timestamp("t").cast("timestamp_ntz").alias("timestamp"), "host", "severity", "message")
    assert search.search_logs(logs, "boom", "2024-01-01 12:00:00", hours=1).first().widened
    assert not search.search_logs(logs, "boom", "2024-01-01 01:30:00", hours=1).first().widened
    assert search.search_logs(logs, "boom", "2024-01-09 01:30:00", hours=1).count() == 0


def test_facts_ladder(spark):
    devices = spark.createDataFrame([("a", "ios", "1.1.1.1", "core"), ("b", "ios", None, "border"), ("c", None, None, "access"), ("d", None, "4.4.4.4", None), ("e", None, None, "Spine-2")], "hostname string, platform string, loopback string, role string")
    sessions = spark.createDataFrame([("a", "9.9.9.9", "65001", "4.4.4.4", "65004"), ("b", "2.2.2.2", None, "1.1.1.1", "65001"), ("a", None, None, "7.7.7.7", "65007")], "device string, loopback string, local_as string, peer_ip string, remote_as string")
    said = spark.createDataFrame([("b", "8.8.8.8", "65002")], "device_name string, router_id string, local_as string")
    got = {r.hostname: (r.loopback, r.local_as) for r in topology.device_facts(devices, sessions, said).collect()}
    assert got == {"a": ("1.1.1.1", "65001"), "b": ("2.2.2.2", "65002"), "c": (None, None), "d": ("4.4.4.4", "65004"), "e": ("7.7.7.7", "65007")}
