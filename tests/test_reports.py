"""Reports, junction preprocessing and the later transcript rules."""

from conftest import rows
from pyspark.sql import functions as F

from splicelake.operators import junctions as J
from splicelake.operators import reports as R
from splicelake.operators import transcripts as T

S = "chrom string, strand int, donor long, acceptor long, mrcount long, nreads_good long, leftsupport long, rightsupport long, nm long, mm long"
TX = "tx_id long, chrom string, strand int, exons array<struct<start:bigint,end:bigint>>, coverage double"


def test_diff_logs(spark):
    a = spark.createDataFrame([("x", 1, "k"), ("y", 1, "k"), (None, 2, "k"), ("z", 1, "a"), ("z", 1, "b")], "key string, n long, v string")
    b = spark.createDataFrame([("x", 1, "k"), ("y", 3, "k"), (None, 2, "k"), ("w", 1, "k"), ("z", 1, "a")], "key string, n long, v string")
    assert rows(R.diff_logs(a, b, ["key"], ["n", "v"])) == sorted(
        [("x", "same", ""), ("y", "changed", "n"), (None, "same", ""), ("w", "only_b", ""), ("z", "changed", "")], key=repr
    )
    assert R.diff_logs(a.limit(0), b.limit(0), ["key"], ["n"]).count() == 0


def test_stages(spark):
    ref = spark.createDataFrame([("a",), ("b",), ("c",)], "ref_id string")
    s1, s2 = spark.createDataFrame([("a",), ("b",)], "ref_id string"), spark.createDataFrame([("a",)], "ref_id string")
    assert rows(R.kill_stage(ref, [("one", s1), ("two", s2)])) == [("a", ""), ("b", "two"), ("c", "one")]
    assert rows(R.stage_counts([("one", s1), ("two", s2)], ["ref_id"])) == [("a", 1, 1), ("b", 1, 0)]
    e = spark.createDataFrame([("c", 0, 10), ("c", 20, 30), ("c", 90, 99)], "chrom string, start long, end long")
    f = spark.createDataFrame([("c", 0, 10), ("c", 21, 40)], "chrom string, start long, end long")
    assert rows(R.match_regions(f, e)) == [("exact", 1), ("missing", 1), ("overlap", 1)]
    st = spark.createDataFrame([("c", 1, 5, 9, 4, 1, 1, 1, 0, 0)], S)
    t = spark.createDataFrame([("c", 1, 5, 9), ("c", 1, 6, 9)], "chrom string, strand int, donor long, acceptor long")
    assert rows(R.junction_trace(t, [("raw", st), ("none", st.limit(0))])) == [("c", 1, 5, 9, 4, None), ("c", 1, 6, 9, None, None)]
    assert rows(R.compare_graphs(e, f, ["chrom"], ["start", "end"])) == [("c", 1, 2, 1, False)]
    assert [r["start"] for r in R.panel(e, [F.col("end")], 2, "start").collect()] == [90, 20]
    assert rows(R.coherence(spark.createDataFrame([(1, 2.0), (1, 4.0)], "family long, v double"), "v")) == [(1, 2, 3.0, 1 / 3)]


def test_chain_collapse(spark):
    tx = spark.createDataFrame([(1, "c", 1, [(5, 10), (20, 30)], 1.0), (2, "c", 1, [(0, 10), (20, 30)], 1.0), (3, "c", 1, [(0, 9)], 1.0)], TX)
    assert rows(R.chain_collapse(tx)) == [("c", 1, 2, 2)]


def test_guides_and_witness(spark):
    st = spark.createDataFrame([("c", 1, 5, 9, 4, 1, 1, 1, 0, 0)], S)
    g = spark.createDataFrame([("c", 1, 5, 9), ("c", 1, 50, 90)], "chrom string, strand int, donor long, acceptor long")
    assert rows(J.inject_guides(st, g).select("donor", "mrcount")) == [(5, 4), (50, 1)]
    reads = spark.createDataFrame([(1, "c", [(0, 10), (20, 30), (40, 50)]), (2, "c", [(0, 10), (25, 50)])], "row_id long, chrom string, exons array<struct<start:bigint,end:bigint>>")
    p = spark.createDataFrame([(1, "c", 11, 21, 29, 41), (2, "c", 30, 40, 10, 20), (3, "c", 10, 25, 30, 40)], "pair_id long, chrom string, d1 long, a1 long, d2 long, a2 long")
    assert rows(J.two_splice_witness(p, reads, 2).select("pair_id", "seen")) == [(1, True), (2, False), (3, False)]


def test_demotion_and_preprocessing(spark):
    data = [("c", 1, 100, 200, 3, 0, 1, 1, 3, 0), ("c", 1, 110, 205, 30, 9, 1, 1, 0, 0), ("c", 1, 115, 205, 9, 9, 1, 1, 9, 0), ("c", 1, 400, 900, 5, 5, 1, 1, 5, 0), ("c", 0, 1, 99, 5, 5, 1, 1, 0, 0)]
    df = spark.createDataFrame(data, S)
    assert rows(J.demote_high_error(df).select("donor", "to_donor", "to_acceptor")) == sorted([(100, 110, 205), (110, None, None), (115, 110, 205), (400, None, None), (1, None, None)], key=repr)
    assert rows(J.preprocess(df).select("donor", "mrcount")) == [(110, 42), (400, 5)]


def test_windows(spark):
    full = [(0, 10), (20, 30), (40, 50), (60, 70)]
    tx = spark.createDataFrame([(1, "c", 1, full, 1.0), (2, "c", 1, full[:3], 1.0), (3, "c", 1, [(0, 10)], 1.0)], TX)
    reads = spark.createDataFrame([("c", 1, full[:3]), ("c", 1, full[1:])], "chrom string, strand int, exons array<struct<start:bigint,end:bigint>>")
    assert rows(T.window_witness(tx, reads, 2)) == [] and rows(T.window_witness(tx, reads, 3)) == [(1,)]


def test_near_duplicates_and_conflicts(spark):
    tx = spark.createDataFrame([(1, "c", 1, [(0, 10), (20, 30)], 9.0), (2, "c", 1, [(0, 10), (22, 30)], 3.0), (3, "c", 1, [(0, 12), (24, 30)], 3.0)], TX)
    assert rows(T.near_duplicates(tx)) == [(2,)]
    one = spark.createDataFrame([(1, "c", 1, [(0, 110)], 1.0), (2, "c", -1, [(100, 300)], 1.0), (3, "c", 1, [(150, 250)], 1.0)], TX)
    assert [[tuple(e) for e in r["exons"]] for r in T.split_strand_conflicts(one).orderBy("tx_id").collect()] == [[(0, 105)], [(105, 300)], [(150, 250)]]
    ri = spark.createDataFrame([(1, "c", 1, [(0, 10), (20, 30)], 9.0), (2, "c", 1, [(5, 25)], 1.0), (3, "c", 1, [(0, 3), (8, 22), (90, 99)], 1.0)], TX)
    assert rows(T.rank_penalised(ri)) == [(2, 3), (3, 2)]
