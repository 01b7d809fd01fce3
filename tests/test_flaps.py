"""The flap stream over micro-batches whose rows come out of order, against the batch result."""

import random
from datetime import datetime, timedelta

import pytest

from snapfold.operators import topology
from snapfold.streaming import logs as streams

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "timestamp timestamp, host string, peer string, state string"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.set(key, before)


def play(spark, path, batches, **more):
    """Each batch is a file; one file is one micro-batch. Returns all rows that the stream gave."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in/{i:03}")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{path}/in")
    out = streams.flap_stream(source, ["host", "peer"], "timestamp", "state", **more)
    q = out.writeStream.format("memory").queryName("flaps_out").outputMode("update").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(300) and q.exception() is None
    return [tuple(r) for r in spark.table("flaps_out").collect()]


def test_out_of_order_rows_give_the_batch_result(rocks, tmp_path):
    rnd, start = random.Random(6), datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=i), f"h{rnd.randint(0, 2)}", f"p{rnd.randint(0, 1)}", rnd.choice(["up", "down", None])) for i in range(90)]
    rows += rows[10:13]  # repeated rows
    late = sorted(rows, key=lambda r: r[0] + timedelta(minutes=rnd.randint(0, 8)))
    batches = [late[i : i + 23] for i in range(0, len(late), 23)] + [[(start + timedelta(days=1), "end", "x", "up")]]
    got = {}
    for host, peer, n in play(rocks, tmp_path, batches):
        got[host, peer] = max(n, got.get((host, peer), 0))
    known = [r for r in rows if r[3] is not None]
    want = {(r.host, r.peer): r.flaps for r in topology.session_flaps(rocks.createDataFrame(rows, SCHEMA), ["host", "peer"], "timestamp", "state").collect()}
    assert len({r[1:3] for r in known}) == len(got) - ("end" in {k[0] for k in got})
    assert {k: n for k, n in got.items() if n} == want


def test_idle_keys_leave_the_state(rocks, tmp_path):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    batches = [[(at(0), "h", "p", "up"), (at(1), "h", "p", "down")], [(at(60), "z", "z", "up")], [(at(200), "z", "z", "up")], [(at(201), "h", "p", "up"), (at(202), "h", "p", "down")], [(at(400), "z", "z", "up")], [(at(401), "z", "z", "up")]]
    got = [n for host, _, n in play(rocks, tmp_path, batches, late="1 minute", idle_ms=30 * 60_000) if host == "h"]
    assert set(got) == {0, 1} and got[-1] == 1 and got.count(1) == 2  # the second count has begun anew
