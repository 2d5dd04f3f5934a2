"""Range joins, sweeps and clustering against brute force."""

import random

import pytest
from conftest import rows

from splicelake.operators import components, ranges

SCHEMA = "id long, k string, start long, end long"


def spans(n, seed, keys=("a", "b")):
    rng = random.Random(seed)
    return [(i, rng.choice([*keys, None]), s := rng.randint(0, 500), s + rng.choice([0, 1, 5, 80])) for i in range(n)]


@pytest.mark.parametrize("bin_size", [7, 1 << 14])
def test_overlap_join(spark, bin_size):
    a, b = spans(60, 1), spans(50, 2)
    got = rows(ranges.overlap_join(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), ["k"], bin_size=bin_size).select("id", "r_id"))
    want = sorted(((x[0], y[0]) for x in a for y in b if x[1] and x[1] == y[1] and x[2] < y[3] and y[2] < x[3] and x[2] < x[3] and y[2] < y[3]), key=repr)
    assert got == want


def test_semi_and_anti(spark):
    a, b = spans(40, 3, ("a",)), spans(6, 4, ("a",))
    da, db = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    semi = {r[0] for r in ranges.overlap_semi(da, db, ["k"], "id", pad=3).select("id").collect()}
    anti = {r[0] for r in ranges.overlap_semi(da, db, ["k"], "id", anti=True, pad=3).select("id").collect()}
    assert semi | anti == {x[0] for x in a} and not semi & anti
    want = {x[0] for x in a if any(x[1] and x[1] == y[1] and x[2] < y[3] + 3 and y[2] - 3 < x[3] and x[2] < x[3] for y in b)}
    assert semi == want


def test_tolerance_and_nearest(spark):
    rng = random.Random(5)
    a = [(i, "a", rng.randint(0, 60), rng.randint(0, 60)) for i in range(40)]
    b = [(i, "a", rng.randint(0, 60), rng.randint(0, 60)) for i in range(40)]
    da, db = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    got = rows(ranges.tolerance_join(da, db, ["k"], ["start", "end"], 4).select("id", "r_id"))
    assert got == sorted(((x[0], y[0]) for x in a for y in b if abs(x[2] - y[2]) <= 4 and abs(x[3] - y[3]) <= 4), key=repr)
    near = {r["id"]: r["nearest_start"] for r in ranges.nearest_join(da, db, ["k"], "start", 4, ["id"]).collect()}
    for x in a:
        c = sorted((abs(y[2] - x[2]), y[2]) for y in b if abs(y[2] - x[2]) <= 4)
        assert near[x[0]] == (c[0][1] if c else None)


@pytest.mark.parametrize("bits", [3, 16])
def test_coverage(spark, bits):
    a = spans(80, 6)
    got = rows(ranges.coverage_segments(spark.createDataFrame(a, SCHEMA), ["k"], bin_bits=bits))
    for k in ("a", "b", None):
        own = [(s, e) for _, q, s, e in a if q == k]
        depth = {p: sum(s <= p < e for s, e in own) for p in range(0, 700)}
        seen = {p: d for q, s, e, d in got if q == k for p in range(s, e)}
        assert {p: d for p, d in depth.items() if d} == seen
    seg = spark.createDataFrame(got, "k string, start long, end long, depth long")
    q = [(1, "a", 0, 700), (2, "b", 100, 120), (3, "zz", 0, 9)]
    cov = {r["id"]: (r["cov_sum"], r["cov_bases"]) for r in ranges.range_coverage(seg, spark.createDataFrame(q, SCHEMA), ["k"], ["id"]).collect()}
    for i, k, s, e in q:
        d = [sum(x <= p < y for _, z, x, y in a if z == k) for p in range(s, e)]
        assert cov[i] == (sum(d), sum(v > 0 for v in d))


def test_regions_and_splits(spark):
    data = [(1, "a", 0, 10), (2, "a", 210, 220), (3, "a", 421, 430), (4, "a", 5, 8), (5, None, 0, 3)]
    df = spark.createDataFrame(data, SCHEMA).withColumnRenamed("k", "chrom")
    assert rows(ranges.region_table(df)) == sorted([("a", 0, 220, 3), ("a", 421, 430, 1), (None, 0, 3, 1)], key=repr)
    seg = df.select("chrom", "start", "end")
    assert rows(ranges.split_uncovered(seg.where("chrom = 'a'"), ["chrom"], 201)) == [("a", 0, 220), ("a", 421, 430)]
    assert rows(ranges.split_uncovered(seg.where("chrom = 'a'"), ["chrom"], 200)) == [("a", 0, 10), ("a", 210, 220), ("a", 421, 430)]


def test_clusters(spark):
    pts = [("a", 10, 4), ("a", 15, 4), ("a", 20, 4), ("a", 26, 11), ("b", 3, 30), ("a", 10, 8)]
    df = spark.createDataFrame(pts, "k string, pos long, weight long")
    assert rows(ranges.cluster_positions(df, ["k"])) == [("a", 13, 20, 10, 20), ("b", 3, 30, 3, 3)]
    c = ranges.cluster_positions(df, ["k"])
    p = spark.createDataFrame([("a", 16), ("a", 40)], "k string, pos long")
    assert rows(ranges.merge_points(c, p, ["k"], 5).select("pos", "merged")) == [(16, 14), (40, 40)]


def union_find(edges, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(30)] + [(i, i + 1) for i in range(100, 130)] + [(200, x) for x in range(201, 220)]
    df = spark.createDataFrame([*edges, (None, 5), (7, 7)], "src long, dst long")
    extra = spark.createDataFrame([(999,)], "node long")
    want = union_find(edges, {x for e in edges for x in e} | {999, 7})
    assert {r["node"]: r["component"] for r in components.connected_components(df, vertices=extra).collect()} == want
    assert components.connected_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("per_task", [1, 3, 40])
def test_components_of_more_than_one_task(spark, monkeypatch, per_task):
    monkeypatch.setattr(components, "PER_TASK", per_task)
    rng = random.Random(per_task)
    edges = [(f"n{rng.randint(0, 60)}", f"n{rng.randint(0, 60)}") for _ in range(45)] + [("hub", f"n{i}") for i in range(8)]
    want = {}
    for a, b in edges:
        x = want.get(a, {a}) | want.get(b, {b})
        for n in x:
            want[n] = x
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {n: min(x) for n, x in want.items()}
    assert components.contract([]) == [] and sorted(components.contract([(3, 2), (2, 1), (9, 8)])) == [(2, 1), (3, 1), (9, 8)]
