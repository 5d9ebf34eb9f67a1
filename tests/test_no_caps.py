"""Inputs past what used to be size limits."""

import random

from pyspark.sql import functions as F

from tidemark.plans import sequence as SQ
from tidemark.plans import study as ST
from tidemark.plans import timeseries as TS

S = 1_000_000_000


def test_an_interval_of_days_keeps_its_bytes(spark):
    """Two overlapping sockets, one interval of 20,000 s and short ones beside and inside it."""
    rows = [("a", 0, 20_000 * S + S // 2, S // 2, 2_000_000, 0), ("b", 0, 103 * S, 100 * S, 300, 0), ("c", 0, 30_001 * S, 30_000 * S, 50, 0)]
    seg = spark.createDataFrame(rows, "sock_cookie string, seg int, ts_ns long, prev_ts_ns long, bytes_recv long, prev_bytes_recv long")
    seg = seg.withColumn("bytes_sent", F.lit(0)).withColumn("prev_bytes_sent", F.lit(0))
    stats = seg.select("sock_cookie", "seg", F.lit("down").alias("direction"))
    got = TS.aggregate_buckets(seg, stats)
    plain: dict[int, list] = {}
    for cookie, _, tb, ta, new, old in rows:
        for bucket in range(ta // S, (tb - 1) // S + 1):
            lo, hi = max(ta, bucket * S), min(tb, (bucket + 1) * S)
            at = plain.setdefault(bucket, [0.0, set(), lo, hi])
            at[0] += (new - old) * (hi - lo) / (tb - ta)
            at[1].add(cookie)
            at[2], at[3] = min(at[2], lo), max(at[3], hi)
    want = {b: (round(x[0], 4), len(x[1])) for b, x in plain.items() if x[3] - x[2] >= S // 4}
    stretches = got.collect()
    assert len(stretches) < 20
    spread = {r.bucket + k: (round(r.bytes, 4), r.sockets) for r in stretches for k in range(r.buckets)}
    assert spread == want
    total = TS.aggregate_throughput(got).first()
    assert total.max_sockets == 2 and abs(total.typical - 100) < 1e-6


def test_a_read_of_many_blocks_is_expanded_whole(spark):
    rows = [("*", 1, "1", "get", "o", 5000 * 10, 200), ("*", 2, "2", "put", "o", 10, 200)]
    trace = spark.createDataFrame(rows, "app string, ts_ns long, op_id string, op string, object_id string, size long, status int")
    got = ST.to_blocks(trace, 10).groupBy("op").count().collect()
    assert {r["op"]: r["count"] for r in got} == {"get": 5000, "put": 5000}


TRACE = "app string, ts_ns long, op_id string, op string, object_id string, size long, status int, range_start long, range_end long"


def test_five_terabytes_in_blocks_of_a_kilobyte_are_one_range(spark):
    rows = [("*", 1, "1", "get", "o", 5 * 10**12, 200, None, None), ("*", 2, "2", "get", "o", None, 206, 5 * 10**12 + 800, 5 * 10**12 + 3000), ("*", 3, "3", "put", "o", 10, 200, None, None)]
    ranges = ST.block_ranges(spark.createDataFrame(rows, TRACE), 1024)
    last = (5 * 10**12 - 1) // 1024
    more = (5 * 10**12 + 3000) // 1024
    assert sorted((r.op, r.b0, r.b1) for r in ranges.collect()) == [("get", 0, last), ("get", last + 1, more), ("put", 0, more)]
    run = SQ.sequential_runs(ranges).collect()
    assert [(r.length, r.first_block) for r in run] == [(more + 1, 0)]


def test_ranges_hold_the_blocks_of_a_plain_walk(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        lo = rng.randrange(0, 400)
        rows.append(("*", rng.randrange(60), f"{i:03}", rng.choice(["get"] * 4 + ["put", "delete"]), rng.choice("ab"), 40, 206, lo, lo + rng.randrange(0, 90)))
    got = [(r.op, r.op_id, r.object_id) for r in ST.to_blocks(spark.createDataFrame(rows, TRACE), 10).collect()]
    want, seen = [], {"a": set(), "b": set()}
    for _, _, i, op, obj, _, _, lo, hi in sorted(rows, key=lambda r: (r[1], r[2])):
        own = set(range(lo // 10, hi // 10 + 1))
        blocks = own if op == "get" else own | seen[obj]
        seen[obj] = seen[obj] | own if op == "get" else set()
        want += [(op, i, f"{obj}#{b}") for b in blocks]
    assert sorted(got) == sorted(want)
