"""Column functions over exon arrays and sequences against plain Python."""

import random

from pyspark.sql import functions as F

from splicelake.functions import chains as C
from splicelake.functions import coords
from splicelake.functions import sequences as S

EX = "array<struct<start:bigint,end:bigint>>"
JX = "array<struct<donor:bigint,acceptor:bigint>>"


def one(spark, schema, row, *cols):
    return spark.createDataFrame([row], schema).select(*cols).first()


def test_basic(spark):
    ex = [(10, 20), (30, 35), (36, 50)]
    r = one(
        spark, f"e {EX}, z {EX}, n {EX}", (ex, [], None),
        C.junctions(F.col("e")), C.junctions(F.col("z")), C.junctions(F.col("n")), C.introns(F.col("e")), C.exonic_length(F.col("e")),
        C.bounds(F.col("e")), C.bounds(F.col("z")), C.merge_gaps(F.col("e"), 1), C.merge_gaps(F.col("z"), 1), C.intron_lengths(F.col("e")),
        C.shorten_terminal(F.col("e"), 3, True), C.shorten_terminal(F.col("e"), 99, False), C.score(F.col("e"), F.lit(2)),
    )
    t = lambda x: None if x is None else [tuple(y) for y in x]
    assert t(r[0]) == [(20, 30), (35, 36)] and t(r[1]) == [] and r[2] is None
    assert t(r[3]) == [(20, 30)] and r[4] == 29 and tuple(r[5]) == (10, 50) and tuple(r[6]) == (None, None)
    assert t(r[7]) == [(10, 20), (30, 50)] and t(r[8]) == [] and r[9] == [10]
    assert t(r[10]) == [(10, 20), (30, 35), (36, 47)] and t(r[11]) == [(19, 20), (30, 35), (36, 50)] and r[12] == 58


def test_packed_and_back(spark):
    r = one(
        spark, "t string", ('"11-20", 31-35',), C.packed_exons(F.col("t")),
        C.exons_of_chain(F.lit(10), C.junctions(C.packed_exons(F.col("t"))), F.lit(35)),
    )
    assert [tuple(x) for x in r[0]] == [(10, 20), (30, 35)] == [tuple(x) for x in r[1]]


def test_subchains(spark):
    rng = random.Random(2)

    def sub(a, b):
        it = iter(b)
        return all(x in it for x in a)

    data = []
    for _ in range(200):
        b = [(rng.randint(0, 3), rng.randint(4, 6)) for _ in range(rng.randint(0, 5))]
        a = [x for x in b if rng.random() < 0.6] if rng.random() < 0.6 else [(rng.randint(0, 3), rng.randint(4, 6)) for _ in range(rng.randint(0, 3))]
        data.append((a, b))
    df = spark.createDataFrame(data, f"a {JX}, b {JX}")
    for r in df.select("a", "b", C.is_subchain(F.col("a"), F.col("b")), C.is_proper_subchain(F.col("a"), F.col("b"))).collect():
        a, b = [tuple(x) for x in r[0]], [tuple(x) for x in r[1]]
        assert r[2] == sub(a, b), (a, b)
        assert r[3] == (sub(a, b) and len(a) < len(b))


def test_near_equal_and_offset(spark):
    r = one(
        spark, f"a {JX}, b {JX}, x array<bigint>, y array<bigint>", ([(10, 20)], [(12, 18)], [100, 200], [50, 101, 199, 9]),
        C.near_equal(F.col("a"), F.col("b"), 2), C.near_equal(F.col("a"), F.col("b"), 1),
        C.contiguous_offset(F.col("x"), F.col("y"), 1), C.contiguous_offset(F.col("x"), F.col("y"), 0), C.contiguous_offset(F.col("y"), F.col("x"), 9),
    )
    assert list(r) == [True, False, 1, -1, -1]


def nw(a, b):
    prev = [-500.0 * j for j in range(len(b) + 1)]
    for x in a:
        cur = [prev[0] - 500.0]
        for j, y in enumerate(b):
            cur.append(max(prev[j] - 0.1 * min(abs(x - y), 2000), prev[j + 1] - 500.0, cur[-1] - 500.0))
        prev = cur
    return prev[-1]


def test_alignment(spark):
    rng = random.Random(4)
    data = [([rng.randint(1, 9000) for _ in range(rng.randint(0, 4))], [rng.randint(1, 9000) for _ in range(rng.randint(0, 4))]) for _ in range(30)]
    df = spark.createDataFrame(data, "a array<bigint>, b array<bigint>")
    for a, b, s in df.select("a", "b", C.align_lengths(F.col("a"), F.col("b"))).collect():
        assert abs(s - nw(a, b)) < 1e-6


def test_overlap_and_containment(spark):
    r = one(
        spark, f"a {EX}, b {EX}", ([(0, 10), (20, 30)], [(5, 25), (29, 40)]),
        C.exons_overlap(F.col("a"), F.col("b")), C.contained(F.col("a"), F.col("b")), C.contained(F.array(F.struct(F.lit(6).alias("start"), F.lit(9).alias("end"))), F.col("b")),
        C.union_intervals(F.concat("b", "a")),
    )
    assert r[0] == 11 and r[1] is False and r[2] is True and [tuple(x) for x in r[3]] == [(0, 40)]


def test_coords(spark):
    i = lambda *x: [F.lit(v).cast("long") for v in x]
    r = spark.range(1).select(
        coords.minus(*i(3, 9)), coords.overlap(*i(0, 10, 8, 20)), coords.overlaps(*i(0, 10, 10, 20)), coords.from_closed(*i(0)), coords.to_closed(*i(4)),
        coords.overlap_fraction_of_smaller(*i(0, 10, 5, 9)), coords.reciprocal_overlap(*i(0, 10, 5, 10)),
        coords.is_strand_mirror(F.lit("c"), *i(0, 10), F.lit("+"), F.lit("c"), *i(1, 10), F.lit("-")),
    ).first()
    assert list(r) == [0, 2, False, 0, 5, 1.0, 0.5, True]


def test_sequences(spark):
    r = one(
        spark, "s string", ("ACGTN",), S.reverse_complement(F.col("s")), S.kmers(F.col("s"), 3), S.kmers(F.col("s"), 9), S.share_of(F.col("s"), "AC"),
        S.tail_flags(F.lit("GGAAAAA"))["a_end"], S.tail_flags(F.lit("TTTTTGG"))["t_start"], S.tail_flags(F.lit("ACGT" * 9))["a_end"],
        S.entropy(F.array(F.lit(1.0), F.lit(1.0), F.lit(0.0))), S.entropy(F.array(F.lit(0.0))), S.hamming(F.lit("ACGT"), F.lit("AGGA")), S.hamming(F.lit("A"), F.lit("AC")),
        F.size(S.minimizers(F.lit("ACGTTGCAACGT"), 3, 4)) >= 1, S.sketch_similarity(S.sketch(S.kmers(F.col("s"), 2), 16), S.sketch(S.kmers(F.col("s"), 2), 16)),
    )
    assert list(r)[:12] == ["NACGT", ["ACG", "CGT", "GTN"], [], 0.4, True, True, False, 1.0, 0.0, 2, None, True] and r[12] == 1.0


def test_cigar(spark):
    cases = [("5M10N6M", [(100, 105), (115, 121)]), ("3S5M2I4M1D3M10N2M7H", [(100, 113), (123, 125)]), ("4=1X", [(100, 105)]), ("*", []), ("5N3M", [(105, 108)])]
    df = spark.createDataFrame([(c,) for c, _ in cases], "c string")
    got = df.select("c", S.exons_of_cigar(F.lit(100), F.col("c")), S.clips(F.col("c")), S.has_long_indel(F.col("c"), 2)).collect()
    for r, (c, want) in zip(got, cases):
        assert r[0] == c and [tuple(x) for x in r[1]] == want
    assert tuple(got[1][2]) == (3, 7) and tuple(got[0][2]) == (0, 0)
    assert [r[3] for r in got] == [True, True, False, False, True]


def test_read_scalars(spark):
    L = F.lit
    r = spark.range(1).select(
        S.edit_distance(L(None).cast("long"), L(5).cast("long"), L(True), L(1)), S.read_strand(L("+"), L(True)), S.read_strand(L(None).cast("string"), L(True)),
        S.read_weight(L(0.0), L(3.0), L(2)), S.read_weight(L(4.0), L(3.0), L(None).cast("int")), S.demotion_ratio(L(60)), S.strand_coverage(L(3.0), L(1.0), L(4.0), L(1)),
        S.identity_proxy(L(0.2), L(0.4)), S.allele_factor(L(0.0), L(9.0)),
    ).first()
    assert [round(x, 6) for x in r] == [3, -1, 0, 1.5, 4.0, 0.5, 6.0, 0.7, 0.1]
