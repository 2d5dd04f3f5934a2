"""Families, weights and junction folds on small fixtures."""

import itertools
import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from splicelake.operators import families as FA
from splicelake.operators import junctions as J
from splicelake.operators import profiles as P

S = "chrom string, strand int, donor long, acceptor long, mrcount long, nreads_good long, leftsupport long, rightsupport long, nm long, mm long"


def test_links_and_families(spark):
    data = [("r1", "a"), ("r1", "b"), ("r1", "b"), ("r2", "b"), ("r2", "c"), ("r3", "a"), ("r4", "x"), ("r4", "y"), (None, "a"), (None, "z")]
    p = spark.createDataFrame(data, "read string, locus string")
    links = FA.locus_links(p)
    assert rows(links) == [("a", "b", 1), ("b", "c", 1), ("x", "y", 1)]
    assert FA.locus_links(p, 2).count() == 0
    assert rows(FA.families(links).select("locus", "family", "copy_idx")) == [("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("x", "x", 0), ("y", "x", 1)]
    loci = spark.createDataFrame([("a", "1", 0, 100, "+"), ("b", "1", 5, 100, "-"), ("c", "1", 0, 10, "-"), ("x", "2", 0, 9, "+"), ("y", "3", 0, 9, "-")], "locus string, chrom string, start long, end long, strand string")
    assert rows(FA.drop_mirrors(links, loci)) == [("b", "c", 1), ("x", "y", 1)]
    m = spark.createDataFrame([(1, "a", "+"), (1, "b", "+"), (1, "c", "-")], "family long, locus string, strand string")
    assert rows(FA.strand_partition(m).select("locus", "part")) == [("a", "1/+"), ("b", "1/+")]


def test_quality_routes_phase(spark):
    m = spark.createDataFrame([(1, "a", 4), (1, "b", 6), (2, "c", 0), (2, "d", 0), (3, "e", 1)], "family long, locus string, n_introns int")
    e = spark.createDataFrame([(1, 12), (2, 3)], "family long, n_shared long")
    q = {r["family"]: (r["n_copies"], r["n_shared"], round(r["cv"], 6), r["keep"]) for r in FA.family_quality(m, e).collect()}
    assert q == {1: (2, 12, 0.2, True), 2: (2, 3, 0.0, False), 3: (1, 0, 0.0, False)}
    f = spark.createDataFrame([(1, 5, 1), (41, 5, 1), (2, 5, 0), (30, 100, 2), (2, 9, 3)], "n_copies int, n_reads int, n_introns int")
    assert [r["route"] for r in FA.em_route(f).collect()] == ["skip", "too_many", "skip", "too_large", "em"]
    r = spark.createDataFrame([("l", 1), ("l", 2), ("l", None), ("m", 1), ("m", None)], "locus string, hp int")
    assert rows(FA.phase_split(r).select("locus", "hp", "phase")) == sorted([("l", 1, 1), ("l", 2, 2), ("l", None, 1), ("l", None, 2), ("m", 1, 0), ("m", None, 0)], key=repr)


def test_consensus_and_alleles(spark):
    j = spark.createDataFrame([(1, "a", 101, 204), (1, "b", 98, 199), (1, "b", 98, 199), (1, "c", 300, 400)], "family long, copy string, donor long, acceptor long")
    assert rows(FA.junction_consensus(j)) == [(1, 100, 200, 2)]
    b = [(1, "a", 5, "G", 9), (1, "a", 5, "=", 1), (1, "b", 5, "=", 4), (1, "a", 6, "T", 9), (1, "b", 6, "T", 9), (1, "a", 7, "C", 2), (1, "b", 7, "=", 9), (1, "c", 5, "A", 1)]
    got = FA.diagnostic_alleles(spark.createDataFrame(b, "family long, copy string, pos long, base string, n long"))
    assert rows(got.select("copy", "pos", "base", "n", "depth")) == [("a", 5, "G", 9, 10), ("b", 5, "=", 4, 4)]


def brute_em(data, rounds):
    w = {}
    for r, c, _ in data:
        w[r, c] = 1 / sum(x[0] == r for x in data)
    compat = {(r, c): k for r, c, k in data}
    for _ in range(rounds):
        mass = {}
        for (r, c), x in w.items():
            mass[c] = mass.get(c, 0) + x
        s = {k: (compat[k] + 0.01) * math.sqrt(mass[k[1]]) for k in w}
        w = {k: v / sum(x for q, x in s.items() if q[0] == k[0]) for k, v in s.items()}
    return w


def test_em(spark):
    data = [("r1", "a", 1.0), ("r1", "b", 0.5), ("r2", "a", 1.0), ("r3", "a", 0.2), ("r3", "b", 0.9), ("r4", "b", 0.0)]
    df = spark.createDataFrame(data, "read string, copy string, compat double")
    x, used, delta = FA.em_reweight(df, rounds=4, settled=0.0)
    got = {(r["read"], r["copy"]): r["weight"] for r in x.collect()}
    want = brute_em(data, 4)
    assert used == 4 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    _, used, delta = FA.em_reweight(df, rounds=60, settled=1e-3)
    assert used < 60 and delta < 1e-3


def test_tiles(spark):
    df = spark.createDataFrame([("c", 100, 150), ("c", 4900, 60), ("c", 9000, 250), ("c", 30000, 300)], "chrom string, pos long, n long")
    assert rows(FA.tile_scan(df)) == [("c", 0, 12500, 4, 250), ("c", 27500, 35000, 2, 300)] or rows(FA.tile_scan(df))[1] == ("c", 27500, 35000, 2, 300)


def test_shared_kmers(spark):
    rng = random.Random(7)
    sets = {i: set(rng.sample(range(14), rng.randint(1, 9))) for i in range(40)}
    sets[40], sets[41] = set(sets[0]), set(sets[0])
    df = spark.createDataFrame([(i, str(k)) for i, s in sets.items() for k in s], "id long, kmer string")
    for t in (0.2, 0.5, 0.8, 1.0):
        want = sorted((a, b, len(sets[a] & sets[b])) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t - 1e-12)
        assert sorted((r["a"], r["b"], r["shared"]) for r in FA.shared_kmers(df, t).collect()) == want, t


# junction folds ----------------------------------------------------------------


def test_coalesce(spark):
    data = [
        ("c", 1, 100, 200, 50, 9, 1, 1, 0, 0), ("c", 1, 103, 205, 5, 1, 1, 1, 0, 0), ("c", 1, 108, 200, 40, 2, 1, 1, 0, 0),
        ("c", 1, 500, 900, 7, 7, 1, 1, 0, 0), ("c", -1, 100, 200, 3, 3, 1, 1, 0, 0),
    ]
    got = rows(J.coalesce_junctions(spark.createDataFrame(data, S)).select("strand", "donor", "acceptor", "mrcount", "n_merged"))
    assert got == [(-1, 100, 200, 3, 1), (1, 100, 200, 55, 2), (1, 108, 200, 40, 1), (1, 500, 900, 7, 1)]


def test_redirects(spark):
    p = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (11, 10), (20, None)], "src long, dst long")
    got = dict(rows(J.resolve_redirects(p)))
    assert {k: got[k] for k in (1, 2, 3)} == {1: 4, 2: 4, 3: 4} and set(got) == {1, 2, 3, 10, 11}
    stats = [("c", 1, 100, 200, 9, 0, 0, 0, 9, 0), ("c", 1, 110, 205, 30, 5, 0, 0, 0, 0), ("c", 1, 112, 205, 30, 5, 0, 0, 0, 0), ("c", 1, 160, 200, 99, 9, 0, 0, 0, 0)]
    df = spark.createDataFrame(stats, S)
    assert rows(J.redirect_to_stronger(df)) == [("c", 1, 100, 200, 110, 205)]
    assert rows(J.demote_alternatives(df, 60).select("donor", "to_donor")) == [(100, 160)]


def test_gate_and_consensus(spark):
    data = [("c", 1, 1, 100, 5, 0, 1, 1, 0, 0), ("c", 1, 2, 100, 5, 1, 1, 1, 5, 5), ("c", 1, 3, 200_000, 5, 3, 1, 1, 5, 5), ("c", 1, 4, 100, 1, 3, 1000, 1, 0, 0), ("c", 1, 5, 100, 5, 5, 5, 5, 0, 0)]
    got = J.good_junction_gate(spark.createDataFrame(data, S)).orderBy("donor")
    assert [r["verdict"] for r in got.collect()] == ["few_good", "all_bad_low", "long_all_bad", "low_share", "good"]
    assert J.killed(J.kill(spark.createDataFrame(data, S), F.col("donor") == 2)).count() == 1
    s = spark.createDataFrame([(1, "GC", "AG"), (-1, "CT", "GC"), (1, "CT", "AC"), (0, "CT", "AC")], "strand int, donor_bases string, acceptor_bases string")
    assert [r["consensus"] for r in J.splice_consensus(s).collect()] == [True, True, False, True]


# profiles ----------------------------------------------------------------------------


def brute_forward(p, read):
    """Sum over all paths, by plain recursion with memory."""
    from functools import cache

    n, k = len(read), p.columns

    @cache
    def f(state, j, i):
        if j < 1 or i < 0:
            return P.NEG
        t = j - 2
        first = j == 1
        begin = 0.0
        if state == "M":
            if i < 1 or read[i - 1] < 0:
                return P.NEG
            if first:
                a = begin if i == 1 else P.NEG
            else:
                a = lse(f("M", j - 1, i - 1) + p.trans[t, 0], f("I", j - 1, i - 1) + p.trans[t, 3], f("D", j - 1, i - 1) + p.trans[t, 5])
            return a + p.match[j - 1, read[i - 1]] if a > P.NEG / 2 else P.NEG
        if state == "I":
            if i < 1 or read[i - 1] < 0:
                return P.NEG
            a = lse(f("M", j, i - 1) + p.trans[j - 1, 1], f("I", j, i - 1) + p.trans[j - 1, 4])
            return a + p.insert[j - 1, read[i - 1]] if a > P.NEG / 2 else P.NEG
        if first:
            return math.log(0.01) if i == 0 else P.NEG
        return lse(f("M", j - 1, i) + p.trans[t, 2], f("D", j - 1, i) + p.trans[t, 6])

    return lse(f("M", k, n), f("I", k, n), f("D", k, n))


def lse(*x):
    m = max(x)
    return P.NEG if m <= P.NEG / 2 else m + math.log(sum(math.exp(v - m) for v in x))


def test_forward_sums_all_paths():
    rng = random.Random(1)
    for _ in range(20):
        p = P.from_sequence("".join(rng.choice("ACGT") for _ in range(rng.randint(1, 5))), 0.01)
        s = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 6)))
        a, b = P.log_likelihood(p, s, band=None), brute_forward(p, tuple(P.encode(s)))
        assert abs(a - b) < 1e-6 or (a < -1e20 and b < -1e20)


def test_profiles_tell_copies_apart(spark):
    rng = random.Random(9)
    a = "".join(rng.choice("ACGT") for _ in range(80))
    b = a[:20] + "".join(rng.choice("ACGT") for _ in range(20)) + a[40:]
    pa, pb = P.from_sequence(a), P.from_sequence(b)
    assert P.log_likelihood(pa, a) > P.log_likelihood(pb, a) + 20
    assert P.viterbi(pa, a)[1] == "M" * 80 and "D" in P.viterbi(pa, a[:40] + a[45:])[1]
    assert P.log_likelihood(pa, a.replace("A", "N", 1)) < -1e20
    shared = P.from_alignment([a, b, a])
    assert shared.columns == 80 and P.log_likelihood(P.tilted(shared, b), b) > P.log_likelihood(shared, b)
    assert P.family_forward([P.from_sequence(a[:40]), P.from_sequence(a[40:])], {(0, 1): 5.0}, a) > P.family_forward([P.from_sequence(a[:40]), P.from_sequence(b[:40])], {(0, 1): 5.0}, a)
    reads = spark.createDataFrame([("ra", a), ("rb", b), ("n", None)], "read string, seq string")
    s = P.score_reads(reads, {"a": pa, "b": pb})
    pri = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "copy string, prior double")
    w = {(r["read"], r["copy"]): r["weight"] for r in P.hmm_weights(s.where("loglik IS NOT NULL"), pri).collect()}
    assert w == {("ra", "a"): 1.0, ("ra", "b"): 0.0, ("rb", "a"): 0.0, ("rb", "b"): 1.0}
    assert s.where("loglik IS NULL").count() == 2


def test_many_reads_score_like_single_ones():
    rng = random.Random(6)
    word = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    p = P.from_alignment([word("ACGT-", 12) for _ in range(4)])
    seqs = [word("ACGTN", rng.randint(0, 20)) for _ in range(40)] + [word("ACGT", 15) for _ in range(20)]
    for q in (p, P.from_sequence("ACCGT"), P.of_copy(["AC-GT", "ACCGA"], 0)):
        for s, x in zip(seqs, P.score_many(q, seqs, cells=100)):
            y = P.log_likelihood(q, s)
            assert x == pytest.approx(y, abs=1e-6) or (x < -1e20 and y < -1e20), s


def test_profile_rules():
    p = P.from_sequence("AN")
    assert p.match[1] == pytest.approx([math.log(0.001)] * 4) and math.exp(p.trans[0][0]) == pytest.approx(0.95)
    q = P.from_alignment(["AAC", "AAC", "AAC"])
    assert math.exp(q.match[0][0]) > math.exp(q.match[2][0]) > math.exp(q.match[2][3])
    c = P.of_copy(["AC-T", "A-GT", "AG-T"], 0, alpha=0.7)
    assert c.columns == 3 and math.exp(c.match[1][1]) == pytest.approx(0.85 / 1.002, abs=1e-3)


def test_redirects_raise_when_not_settled(spark):
    p = spark.createDataFrame([(i, i + 1) for i in range(40)], "src int, dst int")
    assert dict(rows(J.resolve_redirects(p))) == {i: 40 for i in range(40)}
    with pytest.raises(RuntimeError):
        J.resolve_redirects(p, rounds=3)
