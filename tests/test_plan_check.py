"""Claims of subnets of all widths against brute force, without comparing addresses."""

import ipaddress
import random

from snapfold.operators import search


def test_claims_of_all_lengths(spark):
    rng = random.Random(3)
    addresses = [f"10.{rng.randrange(3)}.{rng.randrange(4)}.{rng.randrange(256)}" for _ in range(300)] + ["255.255.255.255", "0.0.0.0", "10.0.300.1", None]
    subnets = [f"10.{rng.randrange(3)}.{rng.randrange(4)}.{rng.randrange(256)}/{n}" for n in range(33) for _ in range(3)] + ["255.255.255.255/32", "10.0.0.1", "10.0.0.0/40", None]
    claims = spark.createDataFrame([(i, f"r{i}", s) for i, s in enumerate(subnets)], "claim int, device string, subnet string")
    used = spark.createDataFrame([(f"r{i % 50}", a) for i, a in enumerate(addresses)], "device_name string, ip_address string")
    out = search.plan_check(claims, used)
    known = {ipaddress.ip_address(a) for a in addresses if a and "300" not in a}
    want = {i: sum(a in ipaddress.ip_network(s, strict=False) for a in known) if s and "/" in s and not s.endswith("/40") else 0 for i, s in enumerate(subnets)}
    assert {r.claim: r.in_use for r in out.collect()} == want and out.count() == len(subnets)
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]
    assert joins and not any("<=" in line or ">=" in line for line in joins)
