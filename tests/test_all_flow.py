"""Greedy flow takes every path, however many there are."""

from splicelake.operators import graphs as G


def test_more_paths_than_ten_thousand():
    k = 101
    edges = [(-1, a, float(k)) for a in range(k)] + [(k + b, -2, float(k)) for b in range(k)]
    edges += [(a, k + b, 1.0) for a in range(k) for b in range(k)]
    got = G.greedy_decomposition(edges)
    assert len(got) == k * k and got[-1][2] == float(k * k)
