"""Queries over transcripts see every usable read: SQL over chains and distinct single exons.

The oracles in ``loci_sql`` hold the multi-exon part only; here their texts are read over both."""

import oracle
import pytest

from splicelake.plans import loci
from splicelake.plans import loci_sql as Q


def _all(name: str, keep: str = "true") -> str:
    lone = f"SELECT chrom, strand, [] AS chain, min(row_id) AS tx_id, sum(w)::DOUBLE AS cov, s, e, 1 AS n, ex FROM reads WHERE len(ex) = 1 AND {keep} GROUP BY chrom, strand, s, e, ex"
    return f"{Q._tx(f'{name}_m', 'reads', keep)}, {name} AS (SELECT chrom, strand, chain, tx_id, cov, s, e, n, ex FROM {name}_m UNION ALL {lone})"


TX = Q.READS + "," + _all("tx")
TWO = Q.READS + "," + _all("ta", f"({Q._RUN}) = 0") + "," + _all("tb", f"({Q._RUN}) = 1")
PLACE = "x.chrom = y.chrom AND x.strand = y.strand"
LOCUS = ", l AS (SELECT *, sum(nw) OVER (PARTITION BY chrom, strand ORDER BY s, e, tx_id) AS locus FROM (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY chrom, strand ORDER BY s, e, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS nw FROM tx))"

SQL = {
    **{n: Q.ORACLES[n].replace(Q.TX, TX) for n in ("containment_filter", "opposite_dominated", "tpm", "top_transcripts", "transcript_coverage")},
    "length_filters": Q.w(TX, "SELECT tx_id FROM tx WHERE list_min(list_transform(ex, lambda x: x.e - x.s)) >= 20 AND list_sum(list_transform(ex, lambda x: x.e - x.s)) >= 500 AND (n = 1 OR (ex[1].e - ex[1].s >= 25 AND ex[n].e - ex[n].s >= 25))"),
    "isofrac_locus": Q.w(
        TX + LOCUS,
        """SELECT tx_id, cov AS coverage FROM (SELECT *, max(cov) OVER (PARTITION BY chrom, strand, locus) AS m, max(CASE WHEN n > 1 THEN cov END) OVER (PARTITION BY chrom, strand, locus) AS mm FROM l)
        WHERE cov >= 0.05 * (CASE WHEN cov > 100 THEN 0.05 WHEN cov > 50 THEN 0.5 ELSE 1 END) * CASE WHEN n > 1 THEN mm ELSE m END""",
    ),
    "exact_reference": Q.w(TWO, f"SELECT x.tx_id, y.tx_id AS ref_id FROM ta x JOIN tb y ON {PLACE} AND x.n > 1 AND y.n > 1 AND x.chain = y.chain UNION ALL SELECT x.tx_id, y.tx_id FROM ta x JOIN tb y ON {PLACE} AND x.n = 1 AND y.n = 1 AND x.s = y.s AND x.e = y.e"),
}


@pytest.fixture(scope="module")
def con(tiny):
    return oracle.connect(tiny)


def test_single_exons_are_there(con):
    assert con.execute(Q.w(TX, "SELECT count(*) FROM tx WHERE n = 1")).fetchone()[0] > 0


LARGER = ("opposite_dominated", "length_filters")  # sf0.001 has no single exon that these keep


@pytest.mark.parametrize("name", SQL)
def test_all_transcripts(spark, tiny, con, name):
    assert TX in SQL[name] or TWO in SQL[name]
    d = tiny.replace("sf0.001", "sf0.01") if name in LARGER else tiny
    n, extra, missing = oracle.compare(loci.QUERIES[name](spark, d), oracle.connect(d), SQL[name])
    assert not extra and not missing, (n, extra, missing)


def test_filter_loci_judges_single_exons(spark, tiny, con):
    got = loci.filtered_loci(spark, tiny).collect()
    want = {r[0] for r in con.execute(Q.w(TX, "SELECT tx_id FROM tx")).fetchall()}
    assert {r.tx_id for r in got} == want and len(got) == len(want)
    assert "low_single" in {r.why for r in got}


def test_genes_hold_all_reads(spark, tiny, con):
    got = loci.gene_abundance(spark, tiny).collect()
    n, cov = con.execute(Q.w(TX, "SELECT count(*), sum(cov) FROM tx")).fetchone()
    assert sum(r.n_tx for r in got) == n and sum(r.coverage for r in got) == cov


def test_merge_absorbs_single_exons(spark, tiny, con):
    """Of the single exons of both samples those of 200 bases that no other single exon of the place holds."""
    lone = "u AS (SELECT chrom, strand, s, e FROM ta WHERE n = 1 UNION SELECT chrom, strand, s, e FROM tb WHERE n = 1)"
    hold = f"SELECT 1 FROM u y WHERE {PLACE} AND y.s <= x.s AND x.e <= y.e AND (y.s < x.s OR x.e < y.e)"
    want = con.execute(Q.w(f"{TWO}, {lone}", f"SELECT chrom, strand, s || '-' || e FROM u x WHERE e - s >= 200 AND NOT EXISTS ({hold})")).fetchall()
    got = [(r.chrom, r.strand, r.exons) for r in loci.structural_merge(spark, tiny).collect() if "," not in r.exons]
    assert want and sorted(got) == sorted(want)
