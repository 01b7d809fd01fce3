"""Best paths where all that is compared is equal: the answer does not hang on the order of the rows."""

from snapfold.operators import policy

SAME = {"weight": 0, "local_pref": 100, "is_local": False, "as_path_len": 1, "origin": 0, "is_internal": False, "igp_metric": 0, "valid": True, "prefix": "p", "router_id": 5}


def test_equal_paths_have_one_winner(spark):
    ends = [("64536", 70, "10.0.0.2"), ("64536", 70, "10.0.0.1"), ("64586", 60, "10.0.0.0")]
    for order in (ends, ends[::-1], ends[1:] + ends[:1]):
        rows = [{**SAME, "device": f"r{i}", "neighbor_as": a, "med": m, "next_hop": h} for i in range(20) for a, m, h in order]
        got = policy.best_path(spark.createDataFrame(rows).coalesce(1)).collect()
        assert len(got) == 20 and {(r.neighbor_as, r.med, r.next_hop) for r in got} == {("64536", 70, "10.0.0.1")}
