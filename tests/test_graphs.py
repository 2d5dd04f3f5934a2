"""Graph algorithms, folds and assembly on small graphs."""

import itertools
import random

import pytest
from conftest import rows

from splicelake.operators import graphs as G
from splicelake.operators.folding import fold_groups


def random_dag(seed):
    rng = random.Random(seed)
    n = rng.randint(2, 6)
    edges = [(u, v, float(rng.randint(1, 9))) for u, v in itertools.combinations(range(n), 2) if rng.random() < 0.6]
    edges += [(-1, u, float(rng.randint(1, 9))) for u in range(n) if rng.random() < 0.5]
    edges += [(u, -2, float(rng.randint(1, 9))) for u in range(n) if rng.random() < 0.5]
    return edges


def min_cut(edges):
    nodes = {x for u, v, _ in edges for x in (u, v)} - {-1, -2}
    best = float("inf")
    for k in range(len(nodes) + 1):
        for side in itertools.combinations(sorted(nodes), k):
            s = {-1, *side}
            best = min(best, sum(c for u, v, c in edges if u in s and v not in s))
    return best if edges else 0.0


@pytest.mark.parametrize("seed", range(25))
def test_flow_is_the_smallest_cut(seed):
    e = random_dag(seed)
    total, flow = G.max_flow(e)
    assert abs(total - min_cut(e)) < 1e-6
    for n in {x for a, b, _ in e for x in (a, b)} - {-1, -2}:
        assert abs(sum(f for (a, b), f in flow.items() if b == n) - sum(f for (a, b), f in flow.items() if a == n)) < 1e-6


@pytest.mark.parametrize("seed", range(25))
def test_greedy_paths(seed):
    e = random_dag(seed)
    cap = {}
    for u, v, c in e:
        cap[u, v] = cap.get((u, v), 0) + c
    got = G.greedy_decomposition(e)
    for path, flow, _ in got:
        full = [-1, *path, -2]
        assert flow > 0
        for a, b in zip(full, full[1:]):
            cap[a, b] -= flow
            assert cap[a, b] > -1e-6
    assert G.widest_first_path(G.build([(u, v, c) for (u, v), c in cap.items()]), -1, -2, G.EPS) is None
    assert sum(f for _, f, _ in got) <= G.max_flow(e)[0] + 1e-6


def test_order_reach_components():
    g = G.build([(0, 1, 1), (1, 2, 1), (0, 2, 1), (5, 6, 1)])
    assert G.topological(g) == [0, 1, 2, 5, 6]
    r = G.reachable(g)
    assert r[0] == 0b110 and r[1] == 0b100 and r[5] == 0b10000
    assert G.undirected_components(g) == [{0, 1, 2}, {5, 6}]
    assert G.undirected_components(g, (1, 0)) == [{2}, {5, 6}]
    with pytest.raises(ValueError):
        G.topological(G.build([(0, 1, 1), (1, 0, 1)]))
    assert G.compact(G.build([(0, 1, 1), (1, 2, 1), (2, 3, 1), (2, 4, 1)]), {(0, 1), (1, 2), (2, 3)}) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}
    assert G.prune({1: 5.0, 2: 9.0, 3: 5.0}, 2) == {2, 1}


def test_paths():
    kept = dict(G.absorb_subpaths([((1, 2, 3), 6.0), ((2, 3), 2.0), ((1, 3), 1.0), ((1, 2), 4.0), ((1, 2, 4), 2.0)]))
    assert kept == {(1, 2, 3): 6 + 2 + 3.0, (1, 2, 4): 2 + 1.0, (1, 3): 1.0}
    assert G.split_chimeric([1, 2, 3, 4], [100, 100, 0.1, 100]) == [[1, 2], [4]]
    assert G.split_chimeric([1, 2, 3], [9, 0, 9]) == [[1, 2, 3]]
    assert G.best_match([1, 2, 3], [[1, 2], [2, 3, 9], [1, 2, 7], [8]]) == [0]


def test_fold_groups(spark):
    data = [(k, i) for k in ("a", "b", None) for i in (3, 1, 2)]
    df = spark.createDataFrame(data, "k string, i long")
    got = fold_groups(df, ["k"], ["i"], lambda r: [(r[0]["k"], [x["i"] for x in r])], "k string, l array<bigint>", flush=1)
    assert rows(got) == sorted([(k, [1, 2, 3]) for k in ("a", "b", None)], key=repr)
    assert fold_groups(df.limit(0), ["k"], ["i"], lambda r: [], "k string").count() == 0


def test_graph_of_reads(spark):
    """Two isoforms, one with a skipped middle exon, and a read that ends early."""
    data = [
        (1, "c", 1, [(0, 10), (20, 30), (100, 110)], 5),
        (2, "c", 1, [(0, 10), (100, 110)], 2),
        (3, "c", 1, [(5, 10), (20, 25)], 1),
    ]
    reads = spark.createDataFrame(data, "row_id long, chrom string, strand int, exons array<struct<start:bigint,end:bigint>>, weight long")
    nodes = G.split_nodes(reads)
    assert [(r["start"], r["end"]) for r in nodes.orderBy("start").collect()] == [(0, 10), (20, 30), (100, 110)]
    assert rows(G.graph_edges(nodes, reads, min_intron=1).select("from_end", "to_start", "n_reads")) == [(10, 100, 2), (10, 20, 6), (30, 100, 5)]
    paths = G.map_reads(reads, nodes)
    tf = G.transfrags(paths)
    assert rows(tf.select("path", "abundance")) == sorted([([0, 20, 100], 5), ([0, 100], 2), ([0, 20], 1)], key=repr)
    cap = G.edge_capacities(tf.withColumn("abundance", tf["abundance"].cast("double")), ["chrom", "strand"])
    got = {tuple(r["path"]): r["bottleneck"] for r in G.decompose(cap, ["chrom", "strand"]).collect()}
    assert got == {(0, 20, 100): 5.0, (0, 100): 2.0, (0, 20): 1.0}
    assert G.flow_values(cap, ["chrom", "strand"]).first()["max_flow"] == 8.0
    assert tuple(G.graph_stats(cap, ["chrom", "strand"]).first())[2:] == (3, 6, 1, 3)
