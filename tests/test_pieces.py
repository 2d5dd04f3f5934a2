"""A node walked along its coverage segments has the change points of a scan of its bases."""

import random

from conftest import rows

from splicelake.operators import coverage as CV


def test_segments_same_as_bases(spark):
    rng, data, at = random.Random(5), [], 0
    while at < 6000:
        n = rng.randint(5, 90)
        data.append(("c", at, at + n, rng.choice([1, 2, 15, 40, 90])))
        at += n
    seg = spark.createDataFrame(data, "chrom string, start long, end long, depth long")
    nodes = spark.createDataFrame([("c", 0, at)], "chrom string, start long, end long")
    depth = [float(d) for _, s, e, d in data for _ in range(s, e)]
    want = sorted(("c", 0, *p) for p in CV.scan_boundaries(depth))
    assert want
    assert sorted(rows(CV.node_boundaries(nodes, seg, ["chrom"]))) == want
    # stretches without coverage have no segment, and equal neighbours are one step
    bare = seg.where("depth <> 2").unionByName(seg.where("depth = 2").selectExpr("chrom", "start", "start + 3 AS end", "depth")).unionByName(seg.where("depth = 2").selectExpr("chrom", "start + 3 AS start", "end", "depth"))
    assert sorted(rows(CV.node_boundaries(nodes, bare, ["chrom"]))) == want
    zero = [0.0 if d == 2 else d for d in depth]
    assert sorted(rows(CV.node_boundaries(nodes, seg.where("depth <> 2"), ["chrom"]))) == sorted(("c", 0, *p) for p in CV.scan_boundaries(zero))
