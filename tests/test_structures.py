"""Read filters and the plain functions behind folds."""

import itertools
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from splicelake.operators import profiles as P
from splicelake.operators import reads as RD
from splicelake.operators import structures as S
from splicelake.operators.graphs import build

R = "row_id long, chrom string, strand int, exons array<struct<start:bigint,end:bigint>>"


def test_read_filters(spark):
    r = spark.createDataFrame([(1, "c", 1, [(0, 100), (200, 210), (300, 400)]), (2, "c", 1, [(0, 100)]), (3, "c", -1, [(50, 60), (700, 800)])], R)
    g = spark.createDataFrame([("c", 100, 200)], "chrom string, donor long, acceptor long")
    assert rows(RD.neutralise(r, g).select("row_id", "strand")) == [(1, 1), (2, 1), (3, 0)]
    assert rows(RD.kept_exons(r, g).where("NOT keep").select("row_id", "i")) == [(3, 0)]
    assert rows(RD.kept_exons(r, g.limit(0)).where("NOT keep").select("row_id", "i")) == [(1, 1), (3, 0)]
    assert rows(RD.without_killed(r.withColumnRenamed("row_id", "tx_id"), g).select("tx_id")) == [(2,), (3,)]
    assert [len(x[0]) for x in r.orderBy("row_id").select(RD.cap_span(F.col("exons"), 500)).collect()] == [3, 1, 1]
    spans = r.withColumn("start", F.col("exons")[0]["start"]).withColumn("end", F.element_at("exons", -1)["end"])
    m = spark.createDataFrame([("c", 750, 760)], "chrom string, start long, end long")
    assert rows(RD.mask_regions(spans, m).select("row_id")) == [(1,), (2,)]
    f = r.withColumn("last_is_a", F.col("row_id") != 2).withColumn("first_is_t", F.col("row_id") == 3)
    assert [(x["row_id"], len(x["exons"])) for x in RD.trim_tail_exons(f).orderBy("row_id").collect()] == [(1, 2), (2, 1)]
    t = r.withColumn("a_tail", F.col("row_id") == 2).withColumn("t_tail", F.lit(None).cast("boolean"))
    assert rows(RD.drop_tail_artefacts(t).select("row_id")) == [(1,), (3,)]
    one = spark.range(1).select(
        RD.pair_weight(F.lit(0.5), F.lit(2), F.lit(4)), RD.mismatch_weight(F.lit(2.0), F.lit(9), F.lit(100), F.lit(False), F.lit(1), False),
        RD.terminal_valid(F.lit(5), F.lit(True)), RD.mates_joinable(F.lit(5), F.lit(True), F.lit(True)),
    ).first()
    assert list(one) == [0.25, 2.0, False, True]


def test_mismatches(spark):
    assert RD.mismatches(10, [(2, "S"), (3, "M"), (5, "N"), (1, "I"), (2, "M")], "TTACGGNA", "ACTxxxxxTC", 10) == [(12, "G"), (19, "A")]
    assert RD.fnv1a(b"") == -3750763034362895579 and RD.fnv1a(b"a") == 0xAF63DC4C8601EC8C - (1 << 64)
    c = spark.createDataFrame([("c", "ACGTACGT")], "name string, seq string")
    r = spark.createDataFrame([(1, "c", 2, 6, "4M", "GTTC", True), (2, "c", 0, 2, "2M", None, True)], "row_id long, chrom string, start long, end long, cigar string, seq string, is_mapped boolean")
    assert rows(RD.read_mismatches(r, c)) == [(1, 4, "T")]


def test_nodes():
    assert S.split_at([(0, 10), (20, 30)], [5, 10, 25, 99]) == [(0, 5), (5, 10), (20, 25), (25, 30)]
    assert S.boundary_contrast([0.0] * 50 + [2.0] * 50, 50) == 4.0
    assert S.terminal_edges([(0, 5), (5, 9)], {0: 1.0, 5: 100.0}, [(0, 5)]) == [(-1, 0, 0.5), (-1, 5, 49.5), (5, -2, 50.0)]
    assert S.hard_ends([((1, 2), 5, 0), ((1, 3), 3, 9)]) == ({1}, {3})
    assert S.drop_empty([(0, 5), (5, 5), (5, 9)], [(0, 1), (1, 2)]) == ([(0, 5), (5, 9)], [(0, 2)])
    assert S.subgraph(build([(1, 2, 1), (2, 3, 1)]), {2, 3}) == {2: {3: 1}}


def test_paths():
    ends = {0: 10, 10: 20, 30: 40, 50: 60, 200: 400}
    assert S.split_segments((0, 10, 30, 50), ends, {(20, 30)}) == [(0, 10, 30), (50,)]
    assert S.trim_weak_ends((0, 10, 30), ends, {0: 0.5, 10: 90.0, 30: 1.0}) == (10, 30)
    none: set[int] = set()
    assert S.long_compatible((0, 10, 30), (0, 10, 30), ends, none, none) == 3
    assert S.long_compatible((0, 10, 30), (10, 30), ends, none, none) == 3
    assert S.long_compatible((10, 30, 50), (10, 30), ends, none, none) == 1
    assert S.long_compatible((10, 30, 50), (10, 30), ends, none, {30}) == 0
    assert S.long_compatible((10, 30, 50), (0, 10, 30), ends, none, none) == 1
    assert S.long_compatible((10, 30), (10, 50), ends, none, none) == 0
    assert S.long_compatible((0, 30), (0, 10, 30), ends, none, none) == 0
    assert S.long_compatible((0, 10), (10, 30), ends, {0, 10}, none) == 0
    g = build([(1, 2, 5), (2, 4, 1), (1, 3, 3), (3, 4, 3), (4, 5, 9)])
    assert S.stitch((0, 1), (4, 5), g) == (0, 1, 3, 4, 5) and S.stitch((5,), (9,), g) is None
    e = build([(-1, 1, 1), (1, 2, 1), (1, 3, 1), (2, -2, 1), (3, -2, 1)])
    assert S.enumerate_paths(e) == [(1, 2), (1, 3)]
    with pytest.raises(ValueError):
        S.enumerate_paths(e, most=1)
    assert S.recombine([((1, 5, 9), 4.0), ((2, 5, 8), 3.0), ((7, 1, 5, 8), 1.0)], 1)[0] == ((1, 5, 8), 3.0)


def test_shares_and_sets():
    a = S.guide_shares({1: 10.0, 2: 30.0, 3: 10.0}, {"g": (1, 2), "h": (2, 3)})
    assert abs(a["g"] - 12.5) < 1e-3 and abs(a["h"] - 12.5) < 1e-3
    assert S.guide_shares({1: 6.0}, {"g": (1,), "z": (9,)})["z"] == 0.0
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 8)
        w = {i: float(rng.randint(1, 9)) for i in range(n)}
        c = {(i, j) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.4}
        best = max(sum(w[i] for i in s) for k in range(n + 1) for s in itertools.combinations(range(n), k) if not any(x in c for x in itertools.combinations(s, 2)))
        total, picked = S.max_compatible(w, c)
        assert total == best == sum(w[i] for i in picked) and not any(x in c for x in itertools.combinations(picked, 2))
    assert [p for p, _ in S.merge_paths([((1, 2, 4), 5.0), ((1, 3, 4), 2.0), ((2, 4), 1.0)])] == [(1, 2, 4), (1, 3, 4)]


def test_alignment():
    assert S.align_pair("ACGT", "ACGT") == ("ACGT", "ACGT")
    assert S.align_pair("ACGGT", "ACT") in [("ACGGT", "AC--T")]
    rng = random.Random(6)
    base = "".join(rng.choice("ACGT") for _ in range(40))
    seqs = [base, base[:10] + base[12:], base[:20] + "T" + base[20:], base]
    al = S.align_many(seqs)
    assert [r.replace("-", "") for r in al] == seqs and len({len(r) for r in al}) == 1
    assert S.identity(al) > 0.9 and S.identity(["A", "A"]) == 1.0 and S.identity(["-", "-"]) == 0.0
    assert S.column_stats(["AAC-", "AGGT", "AAAT"]) == {"conserved": 1, "majority": 1, "polymorphic": 1, "indel": 1}


def test_profiles_of_copies():
    rng = random.Random(2)
    base = "".join(rng.choice("ACGT") for _ in range(60))
    other = base[:30] + "".join(rng.choice("ACGT") for _ in range(5)) + base[35:]
    shared, own, specific = S.fit_profiles({"a": base, "b": other})
    assert not specific and P.log_likelihood(own["a"], base) > P.log_likelihood(own["b"], base)
    _, own, specific = S.fit_profiles({"a": base, "b": "".join(rng.choice("ACGT") for _ in range(60))})
    assert set(own) == {"a", "b"}
    assert S.assign_copy({1, 2, 3}, {"x": {1, 9}, "y": {1, 2}, "z": {1, 2}}) == "y"
    assert S.graph_compatibility(1, 2, 1) == 0.5 and S.graph_compatibility(1, 0, 0) == 0.0
