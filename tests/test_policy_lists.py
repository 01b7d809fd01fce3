"""Match lines over prefix and AS path lists: values by hand, and work that is done once."""

from snapfold.operators import policy

TEXT = """hostname r
ip prefix-list A seq 10 permit 10.0.0.0/8 ge 16 le 28
ip prefix-list A seq 5 deny 10.1.0.0/16 le 24
ip prefix-list ANY permit 0.0.0.0/0
ip prefix-list BAD permit 300.0.0.0/8
ip as-path access-list 7 deny _64514_
ip as-path access-list 7 permit ^6451[345]_
!
route-map P permit 10
 match ip address prefix-list A ANY
 set metric 5
route-map P deny 20
 match as-path 7
 match ip address prefix-list BAD NONE
route-map P permit 30
"""
ASKED = [(1, "10.9.0.0/16", "64513"), (2, "10.1.5.0/24", "64513 64514"), (3, "10.1.5.0/26", "64515"), (4, "0.0.0.0/0", None), (5, "11.0.0.0/8", "64513 1"), (6, "no prefix", "64512")]
A, AS, BAD = "match ip address prefix-list A ANY", "match as-path 7", "match ip address prefix-list BAD NONE"


def test_lists_are_met_once(spark):
    raw = spark.createDataFrame([("r", TEXT)], "device string, raw_output string")
    asked = spark.createDataFrame([(i, "r", "P", p, a) for i, p, a in ASKED], "request int, device string, policy string, prefix string, as_path string")
    keys = ("device",)
    lists = policy.prefix_lists(raw, keys=keys)
    assert [(r.list, r.seq, r.place, r.action, r.network, r.length, r.low, r.high) for r in lists.orderBy("place").collect()] == [
        ("A", 10, 1, "permit", 10 << 24, 8, 16, 28), ("A", 5, 2, "deny", (10 << 24) + (1 << 16), 16, 16, 24), ("ANY", 3, 3, "permit", 0, 0, 0, 0)]
    truth = policy.resolve_matches(asked, policy.route_maps(raw, keys=keys), lists, policy.as_path_lists(raw, keys=keys))
    got = {(r.request, r.condition): r.holds for r in truth.collect()}
    want = {(i, c): False for i in range(1, 7) for c in (A, AS, BAD)}
    want |= {(1, A): True, (3, A): True, (4, A): True, (1, AS): True, (3, AS): True, (5, AS): True}
    assert got == want
    plan = truth._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan  # what reads it twice does not read the texts twice
    maps = policy.route_maps(raw, keys=keys)._jdf.queryExecution().optimizedPlan().toString()
    assert maps.count("split(raw_output") == 1  # not once for each line
