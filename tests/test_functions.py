import pytest
from pyspark.sql import functions as F

from snapfold.functions import network as net
from snapfold.operators import diff, policy, search, tables, text, topology, views
from snapfold.sources import bundles


def value(spark, expression, x):
    return spark.createDataFrame([(x,)], "x string").select(expression(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("f", "x", "y"),
    [
        (net.canonical_state, "Estab", "Established"), (net.canonical_state, "connected", "up"), (net.canonical_state, "notconnect", "down"), (net.canonical_state, "FULL/DR", "Full/DR"),
        (net.canonical_state, "FWD", "forwarding"), (net.canonical_state, "administratively down", "admin-down"), (net.canonical_state, "2-way/DROTHER", "2-Way/DROTHER"), (net.canonical_state, "what", None),
        (net.asn_number, "1.1", 65537), (net.asn_number, "65000", 65000), (net.mac_colons, "AA:BB:CC:DD:EE:FF", "aa:bb:cc:dd:ee:ff"), (net.mac_colons, "aabb.ccdd.eeff", "aa:bb:cc:dd:ee:ff"),
        (net.canonical_interface, "Gi0/0", "GigabitEthernet0/0"), (net.canonical_interface, "ge-0/0/0", "ge-0/0/0"), (net.role_of_host, "alpha-border-4500x.net.demo.internal", "border"),
        (net.role_of_host, "kappa-2P1-BORDER-S1.net.demo.internal", "border"), (net.role_of_host, "alpha-as1-3850.net.demo.internal", None), (net.role_of_host, "coreless-1", None),
        (net.usable_interface, "Uni Eth 0/1", False), (net.usable_interface, "512", False), (net.usable_interface, "Gi0/1", True), (net.canonical_platform, "nx-os", "cisco_nxos"), (net.canonical_platform, "iosxe", "cisco_ios"),
        (net.canonical_platform, "Mikrotik-ROS", "mikrotik_ros"), (net.ipv4_number, "10.0.0.1/24", 167772161), (net.ipv4_number, "10.00.0.1", None), (net.fingerprint, "Established b A a", "a b established"),
        (net.view_name, " Show IP/bgp ", "show_ip_bgp"), (net.bgp_state, "12", "Established"), (net.ospf_state, "2WAY", "2-Way"), (net.ospf_state, "full/dr", "FULL/DR"), (net.platform_of_product, "C9300-48", "cisco_ios"),
        (text.sniff_platform, "\nCisco IOS XR Software", "cisco_xr"), (net.clean_text, "a\n\n\n\nb=== PAGE 3 ===\n", "a\n\nb"),
    ],
)
def test_values(spark, f, x, y):
    assert value(spark, f, x) == y


def test_link_id_is_symmetric(spark):
    row = spark.sql("select 'A' a, 'x' b, 'B' c, 'y' d").select(net.link_id(F.col("a"), F.col("b"), F.col("c"), F.col("d")) == net.link_id(F.lower("c"), F.col("d"), F.col("a"), F.col("b"))).first()
    assert row[0]


def test_hostname_ladder(spark):
    names = spark.createDataFrame([("R4",), ("r4",), ("R4.local",), ("R4-primary",), ("R40-primary",), ("WAN",), ("R4x",)], "raw string")
    devices = spark.createDataFrame([("R4",), ("core1",)], "hostname string")
    got = {r.raw: r.hostname for r in topology.resolve_hostnames(names, devices).collect()}
    assert got == {"R4": "R4", "r4": "R4", "R4.local": "R4", "R4-primary": "R4", "R40-primary": "R40-primary", "WAN": "WAN", "R4x": "R4"}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, t int, v string")
    new = spark.createDataFrame([("a", 2, "z"), ("c", 2, " ")], "k string, t int, v string")
    once = tables.upsert_latest(old, new, ["k"], [F.desc("t")], "v")
    twice = tables.upsert_latest(once, new, ["k"], [F.desc("t")], "v")
    assert sorted(once.collect()) == sorted(twice.collect()) == [("a", 2, "z"), ("b", 1, "y")]
    assert tables.conform(old, "k string, more long").columns == ["k", "more"]


def test_diff_mirrors(spark):
    df = spark.createDataFrame([("d", "k1", "s1", 1), ("d", "k2", "s1", 1), ("d", "k2", "s2", 2), ("d", "k3", "s2", 1)], "device_name string, k string, snapshot_id string, v int")
    there = {(r.k, r.change) for r in diff.diff_snapshots(df, ["k"], "s1", "s2", include_changed=True, values=["v"]).collect()}
    assert there == {("k1", "removed"), ("k2", "changed"), ("k3", "added")}


def test_policy_cases(spark):
    raw = spark.createDataFrame([("d", "neighbor 1.1.1.1 route-map OLD in\nneighbor 1.1.1.1 route-map P in\nroute-map P permit 10\n match tag 1\n match tag 2\n set metric 5\nroute-map P deny 20\n match tag 9\n\nroute-map Q permit 5\n")], "device_name string, raw_output string")
    maps = policy.route_maps(raw).withColumnRenamed("device_name", "device")
    assert {(r.policy, r.seq, tuple(r.matches), tuple(r.sets)) for r in maps.collect()} == {("P", 10, ("match tag 1", "match tag 2"), ("set metric 5",)), ("P", 20, ("match tag 9",), ()), ("Q", 5, (), ())}
    assert [r.policy for r in policy.bindings(raw).collect()] == ["P"]
    asked = spark.createDataFrame([("r1", "d", "P"), ("r2", "d", "P"), ("r3", "d", "Q"), ("r4", "d", "NO"), ("r5", "d", None)], "request string, device string, policy string")
    truth = spark.createDataFrame([("r1", "match tag 1", True), ("r3", "x", True)], "request string, condition string, holds boolean")
    got = {r.request: r.outcome for r in policy.policy_walk(maps, asked, truth).collect()}
    assert got == {"r1": "implicit_deny", "r2": "permit", "r3": "permit", "r4": "missing", "r5": "unbound"}


def test_hops_and_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("a", "c")], "src string, dst string")
    hop = lambda c, n: {tuple(r) for r in topology.nhop_subgraph(edges, c, n).collect()}
    assert hop("a", 0) == hop("zz", 2) == set()
    assert hop("a", 1) == {("a", "b"), ("b", "c"), ("a", "c")}
    nodes = spark.createDataFrame([(n,) for n in "abcdxyz"], "node string")
    out = topology.blast_radius(nodes, edges, spark.createDataFrame([("s1", "c"), ("s2", "q")], "scenario string, device string")).collect()
    assert {tuple(r) for r in out} == {("s1", 4, 2, 2, 3, 4), ("s2", 3, 4, 1, 3, 4)}
    depth = {r.node: (r.root, r.depth) for r in topology.bfs_levels(nodes, edges).collect()}
    assert depth["d"] == ("c", 1) and depth["y"] == ("x", 1) and depth["z"] == ("z", 0)


def test_text_jobs(spark):
    raw = spark.createDataFrame([("d1", "show x", "s", "p", "name a 1\nnoise\nname b 2"), ("d2", "show x", "s", "p", "none"), ("d3", "show y", "s", "p", "z")], "device_name string, command string, snapshot_id string, platform string, raw_output string")
    templates = spark.createDataFrame([("p", "show x", 0, r"^never (\S+)$", ["q"]), ("p", "show x", 1, r"^name (\S+) (\d+)$", ["n", "v"])], "platform string, command string, tier int, pattern string, fields array<string>")
    got = {r.device_name: (r.reason, r.records) for r in text.parse_outputs(raw, templates).collect()}
    assert got == {"d1": ("ok", '[{"n":"a","v":"1"},{"n":"b","v":"2"}]'), "d2": ("no_rows", None), "d3": ("no_template", None)}
    assert value(spark, lambda c: text.redact_text(c, "s"), "password abc\nset community abc ro") == f"password {text.salted('abc', 's')}\nset community {text.salted('abc', 's')} ro"
    doc = spark.createDataFrame([(1, '{"a": [{"password": "x", "tokens_in": 10430}], "api_token": "t"}'), (2, "no json")], "id int, j string")
    assert [r.j for r in text.redact_json(doc, "j").orderBy("id").collect()] == ['{"a": [{"password": "REDACTED", "tokens_in": 10430}], "api_token": "REDACTED"}', "no json"]
    chunks = text.chunk_text(spark.createDataFrame([(1, "word " * 700), (2, None)], "id int, t string"), "id", "t").collect()
    assert all(len(r.chunk) <= 1024 for r in chunks) and {r.total_chunks for r in chunks} == {len(chunks)}


def test_bundle(spark, tmp_path):
    host = tmp_path / "devices" / "r1"
    host.mkdir(parents=True)
    (host / "show_version.txt").write_text("# command: show version\n# pre_scrubbed: true\n\nIOS 1\n")
    (host / "show_x.txt").write_text("body\n")
    (host / "_meta.txt").write_text("no")
    files = bundles.read_bundle(spark, f"file://{tmp_path}")
    got = {(r.host, r.command, r.pre_scrubbed, r.body.strip()) for r in bundles.parse_headers(files).collect()}
    assert got == {("r1", "show version", True, "IOS 1"), ("r1", "show x", None, "body")}
    digest = bundles.bundle_digest(files.withColumn("bundle", F.lit("b")))
    manifest = digest.select("bundle", F.col("sha256").alias("content_sha256"), F.lit(2).alias("hosts_collected"))
    assert bundles.validate_bundles(digest, manifest).first().asDict() == {"bundle": "b", "errors": [], "warnings": ["host count differs"]}


def test_log_search_widens(spark):
    logs = spark.sql("select timestamp_ntz'2024-01-30 20:00:00' as timestamp, 'h' as host, 'ERROR' as severity, 'link down' as message")
    assert search.search_logs(logs, "LINK", "2024-01-31 00:00:00", hours=1).first().widened
    assert not search.search_logs(logs, "link", "2024-01-31 00:00:00", hours=5).first().widened
    with pytest.raises(ValueError, match="severity"):
        search.search_logs(logs, "x", "2024-01-31 00:00:00", severity="loud")


def test_json_shapes(spark):
    df = spark.createDataFrame([("c", '[{"a": "1"}]'), ("c", '[{"b": "2"}]'), ("d", '{"a": 1}')], "command string, parsed_data string")
    shapes = views.element_type(df)
    assert set(shapes) == {"c"} and "a" in shapes["c"] and "b" in shapes["c"]
