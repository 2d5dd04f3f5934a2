"""Assembly, order-dependent filters and coverage scans on small loci."""

import random

from conftest import rows
from pyspark.sql import functions as F

from splicelake.operators import assembly as A
from splicelake.operators import coverage as CV
from splicelake.operators import families as FA
from splicelake.operators import graphs as G
from splicelake.operators import locus_filters as LF
from splicelake.operators import ranges

ENDS = {0: 100, 200: 300, 400: 500, 600: 700, 800: 900}


def made(weight, **kw):
    return sorted((p, round(c, 3), o) for p, c, o in A.assemble(A.Locus(ENDS, weight), min_length=100, **kw))


def test_two_isoforms_and_a_fragment():
    got = made({(0, 200, 400): 10.0, (0, 400): 4.0, (200, 400): 2.0})
    assert [(p, o) for p, _, o in got] == [((0, 200, 400), "seed"), ((0, 400), "seed")]
    cov = {p: c for p, c, _ in got}
    assert cov[0, 400] == 4.0 and 10.0 < cov[0, 200, 400] <= 12.0


def test_fragments_are_joined_only_where_witnessed():
    assert [p for p, _, _ in made({(0, 200, 400): 5.0, (200, 400, 600): 5.0, (400, 600): 3.0})] == [(0, 200, 400, 600)]
    got = made({(0, 200): 5.0, (200, 400): 5.0})
    assert (0, 200, 400) not in [p for p, _, _ in got]


def test_gates_and_guides():
    assert made({(0,): 3.0}) == []
    assert made({(0,): 5.0}) == [((0,), 5.0, "seed")]
    assert A.assemble(A.Locus(ENDS, {(0, 200): 9.0}), min_length=999) == []
    locus = A.Locus(ENDS, {(0, 200): 0.5, (0, 200, 400): 5.0}, guides={(0, 200)})
    assert ("guide" in [o for _, _, o in A.assemble(locus, min_length=100)])


def test_weight_is_not_invented():
    rng = random.Random(4)
    for _ in range(60):
        weight = {}
        for _ in range(rng.randint(1, 7)):
            p = tuple(n for n in ENDS if rng.random() < 0.6)
            if p:
                weight[p] = weight.get(p, 0) + rng.randint(1, 9)
        locus = A.Locus(ENDS, weight)
        got = A.assemble(locus, min_length=100)
        bases = sum(w * locus.length(p) for p, w in weight.items())
        assert sum(c * locus.length(p) for p, c, _ in got) <= bases + 1e-6
        assert len({p for p, _, _ in got}) == len(got)
        assert got == A.assemble(A.Locus(ENDS, dict(reversed(weight.items()))), min_length=100)
        for p, c, o in got:
            assert c > 0 and A.witnessed(locus, p)


def test_helpers():
    assert A.compatible((1, 2), (2, 3)) and not A.compatible((1, 3), (1, 2, 3)) and not A.compatible((1,), (2,))
    assert A.inside((2, 3), (1, 2, 3)) and not A.inside((1, 3), (1, 2, 3)) and not A.inside((9,), (1,))
    locus = A.Locus({0: 10, 10: 20, 30: 40}, {(0, 10, 30): 2.0, (0, 30): 3.0, (10, 30): 4.0})
    assert A.exons_of(locus, (0, 10, 30)) == [(0, 20), (30, 40)]
    assert A.novel_chains([(0, 10, 30)], locus) == [((0, 30), 3.0)]
    assert A.competing_acceptors([(0, 30)], A.Locus({0: 5, 10: 20, 30: 40}, {(0, 10): 1.0, (0, 10, 30): 1.0, (0, 30): 1.0}), 2) == [(0, 10)]
    long = tuple(range(30))
    assert A.chimeric_suffix(long[-12:], [long]) == 0 and A.chimeric_suffix(long[-9:], [long]) is None
    assert A.same_outer((1, 2, 4), (1, 3, 4)) and not A.same_outer((1, 2), (1, 2))


def test_assembly_of_reads(spark):
    data = [(i, "c", 1, [(0, 100), (200, 300), (400, 500)], 1) for i in range(6)]
    data += [(10 + i, "c", 1, [(0, 100), (400, 500)], 1) for i in range(3)] + [(20, "c", -1, [(5000, 5400)], 9), (21, "d", 1, [(0, 50)], 9)]
    reads = spark.createDataFrame(data, "row_id long, chrom string, strand int, exons array<struct<start:bigint,end:bigint>>, weight long")
    reads = reads.withColumn("start", F.col("exons")[0]["start"]).withColumn("end", F.element_at("exons", -1)["end"])
    x = A.assemble_loci(A.locus_paths(reads), ["chrom", "strand", "locus"])
    got = {(r["chrom"], tuple(map(tuple, r["exons"]))): r["coverage"] for r in x.collect()}
    assert got == {("c", ((0, 100), (200, 300), (400, 500))): 6.0, ("c", ((5000, 5400),)): 9.0} | {("c", ((0, 100), (400, 500))): 3.0}
    assert A.assemble_loci(A.locus_paths(reads.limit(0)), ["chrom", "strand", "locus"]).count() == 0


def test_guided_assembly(spark):
    """Guides with support come out with their own ends, whatever the reads' ends; in estimation mode all do."""
    schema = "row_id long, chrom string, strand int, exons array<struct<start:bigint,end:bigint>>, weight long"
    reads = spark.createDataFrame([(i, "c", 1, [(0, 100), (200, 300), (400, 520)], 4) for i in range(3)], schema)
    reads = reads.withColumn("start", F.col("exons")[0]["start"]).withColumn("end", F.element_at("exons", -1)["end"])
    data = [(7, "c", 1, [(20, 100), (200, 300), (400, 480)]), (8, "c", 1, [(10, 100), (200, 300), (400, 500)]), (9, "c", 1, [(0, 100), (200, 300), (400, 450), (900, 990)]), (10, "d", 1, [(5, 50)])]
    guides = spark.createDataFrame(data, "tx_id long, chrom string, strand int, exons array<struct<start:bigint,end:bigint>>")
    paths = A.locus_paths(reads, guides=guides)
    got = {r.guide_id: (r.origin, r.coverage, [tuple(e) for e in r.exons]) for r in A.assemble_loci(paths, ["chrom", "strand", "locus"]).collect()}
    assert got[7][0] == got[8][0] == "guide" and got[7][2] == data[0][3] and got[8][2] == data[1][3] and got[7][1] == got[8][1] > 0
    assert 10 not in got
    only = {r.guide_id: r.coverage for r in A.assemble_loci(paths, ["chrom", "strand", "locus"], only_guides=True).collect()}
    assert set(only) == {7, 8, 9, 10} and only[10] == 0.0 and only[7] > 0
    none = A.locus_paths(reads, guides=guides.limit(0))
    assert [r.guide_id for r in A.assemble_loci(none, ["chrom", "strand", "locus"]).collect()] == [None]


def test_supplements():
    rng = random.Random(2)
    ends = {n: n + 150 for n in range(0, 1800, 200)}
    origins = set()
    for _ in range(200):
        weight = {}
        for _ in range(rng.randint(2, 9)):
            lo = rng.choice([0, 0, 200, 400, 600])
            p = tuple(n for n in ends if lo <= n <= lo + 800 and rng.random() < 0.6)
            if len(p) > 1:
                weight[p] = weight.get(p, 0) + rng.randint(1, 9)
        plain, more = A.assemble(A.Locus(ends, dict(weight))), A.assemble(A.Locus(ends, dict(weight)), supplement=True)
        assert {p for p, _, _ in plain} <= {p for p, _, _ in more} and len({p for p, _, _ in more}) == len(more)
        locus = A.Locus(ends, dict(weight))
        held = {s for p, _, _ in more for s in locus.splice_edges(p)}
        assert {s for p, w in weight.items() if w >= 1 and locus.length(p) >= 200 for s in locus.splice_edges(p)} <= held
        origins |= {o for _, _, o in more}
    assert "seed" in origins and origins & {"novel", "greedy", "alternative", "competing", "rescue"}, origins
    assert A.full_witness(A.Locus(ENDS, {(0, 200, 400): 1.0}), (0, 200)) and not A.full_witness(A.Locus(ENDS, {(0, 200): 1.0, (200, 400): 1.0}), (0, 200, 400))


def test_dense_locus_is_extended_by_index(monkeypatch):
    """A path is compared with those that can take its weight, not with all that pass each step of its extension."""
    calls, real = [0], A.compatible

    def counted(part, whole):
        calls[0] += 1
        assert calls[0] < 2000
        return real(part, whole)

    monkeypatch.setattr(A, "compatible", counted)
    ends = {n: n + 10 for n in range(0, 2000, 10)}
    nodes = sorted(ends)
    weight = {tuple(nodes[i : i + 40]): 1.0 + i % 5 for i in range(160)}
    got = A.assemble(A.Locus(ends, weight))
    assert (tuple(nodes[:199]), "seed") in {(p, o) for p, _, o in got}


def test_interval_flow():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(2, 9)
        pieces = [(*sorted(rng.sample(range(n + 1), 2)), rng.choice([0.5, 1.0, 2.0, 7.0])) for _ in range(rng.randint(1, 12))]
        total, used = G.max_flow([*pieces, *((i + 1, i, 1e12) for i in range(n))], 0, n)
        got, own = G.interval_flow(pieces, n)
        assert got == total and all(own.get((a, b), 0.0) == max(used.get((a, b), 0.0), 0.0) for a, b, _ in pieces)


def test_supplements_of_many_paths(monkeypatch):
    """What is kept is not gone through again for every supplement, and a path of the decomposition costs its own nodes."""
    n = 300
    ends = {a: a + 120 for k in range(n) for a in (1000 * k, 1000 * k + 300, 1000 * k + 600)}
    weight = {p: 3.0 for k in range(n) for a in [1000 * k] for p in ((a, a + 300), (a, a + 600), (a + 300, a + 600))}
    calls, real = [0], A.Locus.splice_edges

    def counted(locus, p):
        calls[0] += 1
        assert calls[0] < 20 * len(weight)
        return real(locus, p)

    monkeypatch.setattr(A.Locus, "splice_edges", counted)
    held = {p for p, _, _ in A.assemble(A.Locus(ends, weight), supplement=True)}
    assert {real(A.Locus(ends, {}), p) for p in held} >= {(p,) for p in weight if p[1] - p[0] == 600}
    rng = random.Random(3)
    for _ in range(300):
        edges = [(*sorted(rng.sample(range(10), 2)), float(rng.randint(1, 6))) for _ in range(rng.randint(1, 30))]
        edges += [e for k in range(10) for e in ((-1, k, float(rng.randint(0, 6))), (k, -2, float(rng.randint(0, 6)))) if rng.random() < 0.5]
        assert G.greedy_acyclic(edges, least=1.0) == G.greedy_decomposition(edges, least=1.0)


# filters -----------------------------------------------------------------------

E3 = [(0, 100), (200, 300), (400, 500)]


def fates(f, *txs, **kw):
    return {t.tx_id: t.why for t in f([LF.Tx(*t) for t in txs], **kw)}


def test_pairwise():
    assert fates(LF.pairwise, (1, 1, E3, 100.0), (2, 1, [(0, 100), (200, 350)], 10.0), (3, -1, [(10, 60)], 3.0), (4, 1, [(90, 210), (400, 500)], 2.0), (5, 1, [(0, 100), (200, 220)], 0.5)) == {
        1: "", 2: "included_drop", 3: "strand_conflict", 4: "retained_intron", 5: "short_terminal_exon",
    }
    assert fates(LF.pairwise, (1, 1, E3, 9.0), (2, 1, [(0, 100), (200, 300)], 8.0)) == {1: "", 2: ""}
    assert fates(LF.pairwise, (1, 1, E3, 100.0), (2, 1, [(0, 100), (200, 350)], 10.0, 0.0, True)) == {1: "", 2: ""}
    assert LF.included(LF.Tx(1, 1, [(210, 290)], 1), LF.Tx(2, 1, E3, 1)) and not LF.included(LF.Tx(1, 1, [(110, 180)], 1), LF.Tx(2, 1, E3, 1), 5)


def test_isofrac_runoff_bridge():
    assert fates(LF.interval_isofrac, (1, 1, E3, 40.0), (2, 1, [(0, 100), (400, 500)], 0.3), (3, 1, [(0, 100), (900, 950)], 0.3), (4, -1, E3, 0.1)) == {1: "", 2: "isofrac", 3: "", 4: ""}
    txs = [LF.Tx(1, 1, [(0, 100)], 6.0), LF.Tx(2, 1, [(150, 250)], 4.0), LF.Tx(3, 1, [(900, 999)], 4.0), LF.Tx(4, 1, [(2000, 2100), (2200, 2300)], 1.0), LF.Tx(5, 1, [(2250, 2400)], 9.0)]
    LF.runoff(txs)
    assert [t.why for t in txs] == ["stitched", "", "low_single", "", "runoff"]
    assert txs[1].exons == [(0, 250)] and txs[1].cov == 5.0
    assert fates(LF.bridges, (1, 1, [(0, 100), (200, 300)], 9.0), (2, 1, [(400, 500)], 9.0), (3, 1, [(250, 300), (400, 450)], 1.0)) == {1: "", 2: "", 3: "bridge"}
    a, b = LF.Tx(1, 1, [(0, 100)], 10.0), LF.Tx(2, 1, [(50, 100)], 4.0, why="isofrac")
    LF.absorb_killed([a, b])
    assert a.cov == 12.0


def test_filters_do_not_depend_on_partitions(spark):
    rng = random.Random(8)
    data = []
    for i in range(120):
        s = rng.randint(0, 4000)
        ex, p = [], s
        for _ in range(rng.randint(1, 4)):
            ex.append((p, p + rng.randint(20, 200)))
            p = ex[-1][1] + rng.randint(30, 300)
        data.append((i, rng.choice(["a", "b", None]), rng.choice([1, -1, 0]), ex, float(rng.randint(1, 60))))
    df = spark.createDataFrame(data, "tx_id long, chrom string, strand int, exons array<struct<start:bigint,end:bigint>>, coverage double")
    got = rows(LF.filter_loci(df).select("tx_id", "why", F.round("coverage", 6)))
    assert got == rows(LF.filter_loci(df.repartition(7, "coverage")).select("tx_id", "why", F.round("coverage", 6)))
    assert len(got) == 120 and {r[1] for r in got} > {"", "included_drop"} or {r[1] for r in got} > {""}
    assert LF.filter_loci(df.limit(0)).count() == 0


# coverage -------------------------------------------------------------------------


def test_boundaries():
    depth = [0.0] * 100 + [30.0] * 200 + [2.0] * 100
    assert CV.scan_boundaries(depth) == [(100, "start", 30.0), (300, "end", 28.0)]
    assert CV.scan_boundaries([30.0] * 400) == [] and CV.scan_boundaries([0.0] * 50 + [9.0] * 50) == []
    t = CV.trims(depth)
    assert [(p, k) for p, k, _ in t] == [(100, "start"), (300, "end")]
    assert CV.trims([1.0] * 10) == []


def test_node_boundaries(spark):
    seg = spark.createDataFrame([("c", 100, 300, 30), ("c", 300, 400, 2)], "chrom string, start long, end long, depth long")
    nodes = spark.createDataFrame([("c", 0, 400), ("c", 500, 900)], "chrom string, start long, end long")
    assert rows(CV.node_boundaries(nodes, seg, ["chrom"])) == [("c", 0, 100, "start", 30.0), ("c", 0, 300, "end", 28.0)]


def test_coverage_columns(spark):
    tx = spark.createDataFrame([(1, "c", [(0, 100), (200, 300)])], "tx_id long, chrom string, exons array<struct<start:bigint,end:bigint>>")
    seg = spark.createDataFrame([("c", 0, 100, 10), ("c", 150, 200, 1), ("c", 200, 300, 20)], "chrom string, start long, end long, depth long")
    assert rows(CV.transcript_coverage(tx, seg)) == [(1, 3000, 15.0)]
    assert rows(CV.low_introns(tx, seg)) == [(1, 0, 0.5, True)] and rows(CV.low_introns(tx, seg, 0.01)) == [(1, 0, 0.5, False)]
    st = spark.createDataFrame([("c", 1, 100, 200)], "chrom string, strand int, donor long, acceptor long")
    assert tuple(CV.witness(st, seg).first())[4:] == (50, 0, 100, 5, True)
    assert [r[0] for r in spark.range(1).select(CV.coverage_drop(F.lit(10), F.lit(100), F.lit(2), F.lit(50))).collect()] == [True]


def test_reads_and_strands(spark):
    data = [(1, "c", 0, [(0, 10), (20, 30)]), (2, "c", 0, [(0, 10)]), (3, "c", 1, [(0, 10), (20, 30)]), (4, "c", 0, [(0, 10), (90, 95)])]
    r = spark.createDataFrame(data, "row_id long, chrom string, strand int, exons array<struct<start:bigint,end:bigint>>")
    st = spark.createDataFrame([("c", -1, 10, 20, 9), ("c", 1, 10, 20, 3)], "chrom string, strand int, donor long, acceptor long, mrcount long")
    assert rows(CV.resolve_strand(r, st).select("row_id", "resolved_strand")) == [(1, -1), (2, 0), (3, 1), (4, 0)]
    m = spark.createDataFrame([(1, "x", 0, "c", 5, 90), (2, "x", 0, "c", 90, 5), (3, "y", 0, "c", 5, None), (4, None, 0, "c", 5, 5), (5, "z", 0, "c", 7, 7), (6, "z", 0, "c", 7, 7)], "row_id long, read_name string, hi int, chrom string, start long, mate_start long")
    assert rows(CV.pair_mates(m)) == [(1, 2), (5, 6)]
    b = spark.createDataFrame([("c", [(0, 100), (300, 400)], 2), ("c", [(0, 100)], 1)], "chrom string, exons array<struct<start:bigint,end:bigint>>, weight long")
    seg = ranges.coverage_segments(b.select("chrom", F.explode("exons").alias("e")).select("chrom", "e.start", "e.end"), ["chrom"])
    assert rows(CV.bridge_gaps(seg, b)) == [("c", 100, 300, 2)]


# families --------------------------------------------------------------------------


def test_family_structures(spark):
    tx = spark.createDataFrame([(1, "c", 0, 10), (1, "c", 5010, 5020), (1, "c", 20000, 20010), (2, "c", 5, 9)], "family long, chrom string, start long, end long")
    assert rows(FA.gene_loci(tx)) == [(1, "c", 0, 5020, 2), (1, "c", 20000, 20010, 1), (2, "c", 5, 9, 1)]
    ex = [(1, 1, "a", 0, 100), (1, 2, "b", 20, 110), (1, 3, "a", 300, 400), (1, 4, "b", 390, 600), (2, 5, "a", 0, 100)]
    x = FA.exon_classes(spark.createDataFrame(ex, "family long, exon_id long, copy string, start long, end long"))
    assert {r["exon_id"]: r["node"] for r in x.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert rows(FA.family_edges(x)) == [(1, 1, 3, 1), (1, 1, 4, 1)]
    assert rows(FA.representative_copy(x)) == [(1, "a"), (2, "a")]
    rng = random.Random(1)
    s = "".join(rng.choice("ACGT") for _ in range(120))
    o = "".join(rng.choice("ACGT") for _ in range(120))
    m = spark.createDataFrame([(1, 1, s), (1, 2, s[:110] + "A" * 10), (1, 3, o)], "node long, exon_id long, seq string")
    assert {r["exon_id"]: r["part"] for r in FA.split_by_minimizers(m).collect()} == {1: 1, 2: 1, 3: 3}


def test_rescue(spark):
    r = spark.createDataFrame([(1, "p", -5.0)] * 3 + [(1, "q", -1.0)], "family long, path string, loglik double")
    assert rows(FA.synthesize_bundles(r)) == [(1, "p", 3, -5.0)]
    c = spark.createDataFrame([(1, 0.0), (9, 0.9), (9, 0.1)], "hits int, masked_share double")
    assert [x["rescue_class"] for x in FA.rescue_class(c).collect()] == ["below", "masked", "external"]
    k = spark.createDataFrame([(1, "ACG"), (1, "CGT"), (2, "TTT")], "family long, kmer string")
    reads = spark.createDataFrame([("a", "ACGTACGT"), ("b", "AAAAAA"), ("n", None), ("z", "GGGGGG"), ("s", "AC")], "read string, seq string")
    assert rows(FA.novel_reads(reads, k, k=3)) == [("a", 1, 4), ("b", 2, 4)]


def test_templates(spark):
    t = spark.createDataFrame([("g", "c", "+", 0, 10), ("h", "c", "+", 100, 120), ("h", "c", "+", 900, 950)], "gene_id string, chrom string, strand string, start long, end long")
    assert rows(FA.template_families(t).select("template", "start")) == [("g", 0), ("h", 100), ("h", 900)]
    assert rows(FA.template_families(t, by_gene=False).select("template", "start")) == [("c:+:0", 0), ("c:+:0", 100), ("c:+:900", 900)]
    S = "chrom string, strand int, exons array<struct<start:bigint,end:bigint>>"
    tx = spark.createDataFrame([(1, "c", 1, [(0, 10), (20, 30), (40, 50)]), (2, "c", 1, [(0, 10), (99, 110)])], f"tx_id long, {S}")
    ref = spark.createDataFrame([("F", "c", 1, [(5, 10), (20, 30)])], f"template string, {S}")
    assert rows(FA.family_names(tx, ref)) == [(1, "F-like", 0.5)]
