"""Batches in parallel against a loop."""

import random

import pytest

from tarnwell.operators import batching


def loop(rows, limit, most, base):
    out, now, batch, held, total = {}, object(), 0, 0, 0
    for root, at, size, kids in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        size = max(0, size or 0)
        if root != now:
            now, batch, held, total = root, 0, 0, base
        if held and not kids and (total + size > limit or most is not None and held >= most):
            batch, held, total = batch + 1, 0, base
        held, total = held + 1, total + size
        out[root, at] = batch
    return out


def made(spark, rows, **rule):
    frame = spark.createDataFrame(rows, "root string, at long, size long, kids boolean")
    return {(r.root, r.at): r.batch for r in batching.batches(frame, "root", "at", "size", "kids", **rule).collect()}


@pytest.mark.parametrize("limit, most, base, tasks", [(100, None, 0, 7), (100, 5, 30, 7), (40, 3, 10, 3), (5000, None, 0, 9), (100, None, 0, None), (10**9, None, 0, 5), (0, None, 0, 4), (100, 1, 0, 6)])
def test_ranges_equal_the_loop(spark, limit, most, base, tasks):
    rng = random.Random(limit + (most or 0))
    rows = [("long", i, rng.choice([0, 1, 5, 20, 60, 150, None]), rng.random() < 0.15) for i in range(900)]
    rows += [(f"r{k:02}", i, rng.randint(0, 70), None if i % 3 else False) for k in range(20) for i in range(rng.randint(1, 12))]
    rows += [("kids", i, 50, True) for i in range(120)] + [(None, i, 30, False) for i in range(40)]
    assert made(spark, rows, limit=limit, most=most, base=base, tasks=tasks) == loop(rows, limit, most, base)


def test_a_long_root_in_many_tasks(spark):
    n = 200_000
    frame = spark.range(n).selectExpr("'one' AS root", "id AS at", "(id * 7919) % 501 AS size", "id % 13 = 0 AS kids")
    out = batching.batches(frame, "root", "at", "size", "kids", limit=12_000, base=500, tasks=8).cache()
    tasks = out.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert sum(tasks) == n and max(tasks) < n / 4
    want = loop([("one", i, i * 7919 % 501, i % 13 == 0) for i in range(n)], 12_000, None, 500)
    assert {(r.root, r.at): r.batch for r in out.collect()} == want


def test_no_rows(spark):
    assert made(spark, [], limit=10) == {}
    assert made(spark, [("a", 1, None, None)], limit=10) == {("a", 1): 0}
