"""Transcript operators on small fixtures where order and ties matter."""

from conftest import rows
from pyspark.sql import functions as F

from splicelake.operators import transcripts as T

S = "tx_id long, chrom string, strand int, exons array<struct<start:bigint,end:bigint>>, coverage double, longcov double"


def make(spark, *data):
    return spark.createDataFrame([(i, c, s, e, float(v), float(v)) for i, c, s, e, v in data], S)


A = [(0, 100), (200, 300), (400, 500)]
B = [(50, 100), (200, 300), (400, 450)]
PART = [(210, 300), (400, 480)]


def ids(df):
    return sorted(r["tx_id"] for r in df.select("tx_id").collect())


def test_dedup(spark):
    tx = make(spark, (3, "c", 1, A, 5), (1, "c", 1, A, 2), (2, "c", 1, B, 9), (4, "c", -1, A, 1), (5, "c", 1, [(0, 9)], 1), (6, "c", 1, [(0, 8)], 1))
    assert ids(T.exact_dedup(tx)) == [1, 2, 4, 5, 6]
    assert ids(T.chain_dedup(tx)) == [2, 4, 5, 6]
    assert ids(T.chain_dedup(tx, prefer=(F.col("tx_id") == 3).cast("int"))) == [3, 4, 5, 6]
    assert rows(T.near_chain_pairs(tx, 0).select("tx_id", "r_tx_id")) == [(1, 2), (1, 3), (2, 3)]
    assert ids(T.near_equal_collapse(tx)) == [1, 2, 3, 4, 5, 6]
    assert ids(T.near_equal_collapse(tx, terminal=60)) == [2, 3, 4, 5, 6]
    assert T.exact_dedup(tx.limit(0)).count() == 0


def test_subsets_and_containment(spark):
    tx = make(spark, (1, "c", 1, A, 5), (2, "c", 1, PART, 5), (3, "c", 1, [(410, 420)], 5), (4, "c", 1, [(410, 420)], 5), (5, "c", -1, PART, 1))
    assert rows(T.subset_chains(tx)) == [(2, 1)]
    assert ids(T.containment_filter(tx)) == [1, 5]
    assert ids(T.contained_merge(tx)) == [1, 3, 5]
    assert ids(T.contained_merge(make(spark, (1, "c", 1, A, 5), (2, "c", 1, PART, 9)))) == [1]


def test_isofrac(spark):
    tx = make(spark, (1, "c", 1, A, 200), (2, "c", 1, B, 3), (3, "c", 1, [(450, 460)], 1), (4, "c", 1, [(900, 990)], 1), (5, "c", 1, PART, 0.9))
    assert ids(T.isofrac_locus(tx, 0.01)) == [1, 2, 4]
    assert ids(T.underrepresented(tx, 0.01)) == [5]


def test_overlaps(spark):
    tx = make(spark, (1, "c", 1, A, 50), (2, "c", -1, [(450, 460)], 1), (3, "c", 1, [(120, 180)], 1), (4, "c", 1, [(90, 210)], 2), (5, "c", 0, [(450, 460)], 1))
    assert ids(T.opposite_dominated(tx)) == [2]
    assert ids(T.intronic(tx)) == [3]
    assert ids(T.retained_introns(tx)) == [4]


def test_gates(spark):
    tx = make(spark, (1, "c", 1, A, 1), (2, "c", 1, [(0, 300)], 4), (3, "c", 1, [(0, 300)], 5), (4, "c", 1, [(0, 10), (20, 900)], 5), (5, "c", 1, [], 9))
    assert ids(T.coverage_gate(tx)) == [1, 3, 4, 5]
    assert ids(T.coverage_gate(tx.withColumn("is_guide", F.col("tx_id") == 2))) == [1, 2, 3, 4, 5]
    assert ids(T.length_filters(tx, min_exon=11)) == [1, 2, 3]
    assert ids(T.length_filters(tx, terminal=15)) == [1, 2, 3]


def test_genes(spark):
    """3 lies in an intron of 1 without touching an exon: a gene of its own; 4 links 1 and 2."""
    tx = make(spark, (1, "c", 1, A, 1), (2, "c", 1, [(600, 700)], 1), (3, "c", 1, [(120, 180)], 1), (4, "c", 1, [(480, 490), (650, 660)], 1), (5, "c", -1, A, 1))
    g = {r["tx_id"]: r["gene_id"] for r in T.gene_ids(tx).collect()}
    assert g == {1: 1, 2: 1, 4: 1, 3: 3, 5: 5}
    ab = T.gene_abundance(T.gene_ids(T.abundance(tx, 1e9)))
    assert rows(ab.select("gene_id", "start", "end", "n_tx", F.round("tpm", 3), F.round("fpkm", 3))) == [
        (1, 0, 700, 3, 600000.0, 3.0), (3, 120, 180, 1, 200000.0, 1.0), (5, 0, 500, 1, 200000.0, 1.0),
    ]
    zero = T.abundance(tx.withColumn("coverage", F.lit(0.0)))
    assert rows(zero.select("tpm", "fpkm").distinct()) == [(0.0, 0.0)]


def test_reference(spark):
    tx = make(spark, (1, "c", 1, B, 1), (2, "c", 1, PART, 1), (3, "c", 1, [(0, 100), (200, 300), (390, 500)], 1), (4, "c", 1, [(0, 100), (400, 500)], 1))
    ref = make(spark, (10, "c", 1, A, 1), (11, "c", 1, [(0, 100), (400, 600), (700, 800)], 1), (12, "d", 1, PART, 1))
    assert rows(T.exact_reference(tx, ref)) == [(1, 10)]
    assert ids(T.reference_subset(tx, ref)) == [2, 4]
    assert ids(T.zero_novel_not_exact(tx, ref)) == [2, 4]
    assert ids(T.recover_guides(tx, ref.withColumn("coverage", F.lit(0.0)))) == [1, 2, 3, 4, 10, 11, 12]
    cmp = T.set_comparison(tx.select("chrom"), ref.select("chrom"), ["chrom"]).first()
    assert tuple(cmp) == (1, 1, 0, 0.5, 1.0)
    t = spark.createDataFrame([("a", "c"), ("a", "j"), ("b", "u"), ("b", "zz"), (None, "=")], "ref_id string, class_code string")
    best = T.best_class(t)
    assert rows(best) == [("a", "j"), ("b", "u")]
    refs = spark.createDataFrame([("a",), ("b",), ("x",), ("x",)], "ref_id string")
    assert rows(T.loss_report(best, refs)) == [("matched", 1), ("missed", 1), ("partial_u", 1)]


def test_merge(spark):
    one = make(spark, (1, "c", 1, A, 7), (2, "c", 1, [(0, 50)], 7))
    two = make(spark, (3, "c", 1, B, 3), (4, "c", 1, [(0, 100), (200, 310), (400, 700)], 3), (5, "c", 1, PART, 2), (6, "d", 1, [(0, 300)], 1))
    assert ids(T.structural_merge([one, two])) == [4, 6]
    assert ids(T.structural_merge([one, two], tolerance=5)) == [1, 4, 6]


def test_chimeras(spark):
    ref = make(spark, (10, "c", 1, [(0, 10), (20, 30), (40, 50)], 1), (11, "c", 1, [(60, 70), (80, 90)], 1), (12, "c", 1, [(40, 50), (55, 60)], 1))
    tx = make(
        spark, (1, "c", 1, [(0, 10), (20, 30), (40, 50)], 1), (2, "c", 1, [(0, 10), (20, 30), (35, 70), (80, 90)], 1),
        (3, "c", 1, [(20, 30), (40, 50), (55, 60)], 1), (4, "c", 1, [(0, 10), (20, 30)], 1),
    )
    assert ids(T.chimeras(tx, ref)) == [3]
    assert T.chimeras(tx.limit(0), ref).count() == 0
