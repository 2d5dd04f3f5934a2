"""Queries over alignments: regions, coverage, junctions, transcripts, graphs, families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splicelake.functions import chains
from splicelake.functions import sequences as S
from splicelake.operators import assembly as A
from splicelake.operators import coverage as CV
from splicelake.operators import families as FA
from splicelake.operators import graphs as G
from splicelake.operators import junctions as J
from splicelake.operators import locus_filters as LF
from splicelake.operators import ranges as R
from splicelake.operators import transcripts as T
from splicelake.plans import lifts
from splicelake.plans.lifts import BUNDLE
from splicelake.session import cut
from splicelake.sources import sinks
from splicelake.sources.tables import table

QUERIES: dict = {}


def query(f):
    """Register a query under its name; it gets the session and the table directory."""
    QUERIES[f.__name__] = f
    return f


def _chain_text(c: str = "chain"):
    """A chain as text, so that results compare as plain values."""
    return F.array_join(F.transform(c, lambda j: F.concat_ws("-", j["donor"], j["acceptor"])), ",")


def _exon_text(c: str = "exons"):
    return F.array_join(F.transform(c, lambda e: F.concat_ws("-", e["start"], e["end"])), ",")


def _coverage(spark: SparkSession, d: str, keys: list[str]) -> DataFrame:
    """Coverage segments of all exons, written once: they are read several times and far fewer than reads."""
    return cut(R.coverage_segments(lifts.exon_rows(lifts.reads(spark, d)), keys))


# regions and coverage ---------------------------------------------------------


@query
def bundle_regions(spark: SparkSession, d: str) -> DataFrame:
    return R.region_table(lifts.reads(spark, d))


@query
def zero_cov_split(spark: SparkSession, d: str) -> DataFrame:
    return R.split_uncovered(lifts.exon_rows(lifts.reads(spark, d)), ["chrom"], 50)


@query
def pileup(spark: SparkSession, d: str) -> DataFrame:
    return R.coverage_segments(lifts.exon_rows(lifts.reads(spark, d)), ["chrom", "strand"])


@query
def elementary_intervals(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes").where("chrom IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL")
    return R.elementary_intervals(n, BUNDLE)


@query
def range_coverage(spark: SparkSession, d: str) -> DataFrame:
    return R.range_coverage(_coverage(spark, d, ["chrom"]), lifts.panels(spark, d), ["chrom"], ["row_id"])


@query
def interval_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    p = lifts.panels(spark, d)
    r = lifts.reads(spark, d).select("chrom", "start", "end", "weight")
    hit = R.overlap_join(p, r, ["chrom"])
    return hit.groupBy("row_id").agg(F.count(F.lit(1)).alias("n_reads"), F.min("r_start").alias("first_start"))


@query
def interval_anti_join(spark: SparkSession, d: str) -> DataFrame:
    r = lifts.reads(spark, d)
    return J.known_region_anti(r, lifts.panels(spark, d), "row_id", pad=100).groupBy("chrom").agg(F.count(F.lit(1)).alias("n_reads"))


@query
def interval_semi_join(spark: SparkSession, d: str) -> DataFrame:
    x = R.overlap_semi(lifts.reads(spark, d), lifts.panels(spark, d), ["chrom"], "row_id")
    return x.groupBy("chrom").agg(F.count(F.lit(1)).alias("n_reads"))


@query
def tss_clusters(spark: SparkSession, d: str) -> DataFrame:
    x = lifts.reads(spark, d).select("chrom", "strand", F.col("start").alias("pos"), "weight")
    return R.cluster_positions(x, ["chrom", "strand"], window=5, least=3)


@query
def read_boundaries(spark: SparkSession, d: str) -> DataFrame:
    r = lifts.reads(spark, d)
    ends = F.explode(F.array(F.struct(F.lit("start").alias("kind"), F.col("start").alias("pos")), F.struct(F.lit("end").alias("kind"), F.col("end").alias("pos"))))
    return r.select("chrom", "strand", "weight", ends.alias("b")).groupBy("chrom", "strand", "b.kind", "b.pos").agg(F.sum("weight").alias("weight"))


@query
def endpoint_representatives(spark: SparkSession, d: str) -> DataFrame:
    x = lifts.reads(spark, d).select("chrom", F.col("end").alias("pos"), "weight")
    return J.endpoint_map(x, ["chrom"], 10)


@query
def tile_loci(spark: SparkSession, d: str) -> DataFrame:
    x = lifts.reads(spark, d).select("chrom", F.col("start").alias("pos"), F.col("weight").alias("n"))
    return FA.tile_scan(x, least=5)


# junctions ---------------------------------------------------------------------


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return J.junction_stats(lifts.reads(spark, d))


@query
def junction_stats(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d)


@query
def splice_site_support(spark: SparkSession, d: str) -> DataFrame:
    return J.site_support(_stats(spark, d)).select(*J.JKEY, "leftsupport", "rightsupport")


@query
def good_junctions(spark: SparkSession, d: str) -> DataFrame:
    return J.good_junction_gate(J.site_support(_stats(spark, d))).select(*J.JKEY, "verdict")


@query
def weak_junctions(spark: SparkSession, d: str) -> DataFrame:
    return J.weak_filter(_stats(spark, d), 2).select(*J.JKEY, "mrcount")


@query
def killed_junctions(spark: SparkSession, d: str) -> DataFrame:
    return J.killed(_stats(spark, d))


@query
def splice_site_isofrac(spark: SparkSession, d: str) -> DataFrame:
    return J.site_isofrac(_stats(spark, d), 10.0).select(*J.JKEY, "mrcount", "site_total", "keep")


@query
def nearby_weak(spark: SparkSession, d: str) -> DataFrame:
    return J.nearby_weak(_stats(spark, d)).select(*J.JKEY, "best_near", "drop")


@query
def shared_site_weak(spark: SparkSession, d: str) -> DataFrame:
    return J.shared_site_weak(_stats(spark, d)).select(*J.JKEY, "drop")


@query
def junction_rank(spark: SparkSession, d: str) -> DataFrame:
    return J.rank_sites(_stats(spark, d)).select(*J.JKEY, "rank")


@query
def junction_found_fraction(spark: SparkSession, d: str) -> DataFrame:
    r = lifts.reads(spark, d)
    return J.found_fraction(r, J.junction_stats(r).where("mrcount >= 3")).withColumn("found", F.round("found", 6))


@query
def nearest_snap(spark: SparkSession, d: str) -> DataFrame:
    s = _stats(spark, d)
    return J.snap_to_guides(s, s.where("mrcount >= 5")).select(*J.JKEY, "nearest_donor", "nearest_acceptor")


@query
def redirect_junctions(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of 200 bases make a read reliable here; neighbours are 2,000 bases away at most."""
    return J.redirect_to_stronger(J.junction_stats(lifts.reads(spark, d), support=200, long_support=250), window=2000)


@query
def demoted_alternatives(spark: SparkSession, d: str) -> DataFrame:
    """Donors within 1,000 bases: the tables hold no alternatives that are closer."""
    return J.demote_alternatives(_stats(spark, d), window=1000)


@query
def coalesced_junctions(spark: SparkSession, d: str) -> DataFrame:
    return J.coalesce_junctions(_stats(spark, d))


@query
def intron_pairs(spark: SparkSession, d: str) -> DataFrame:
    return J.intron_pairs(lifts.reads(spark, d))


@query
def junction_usage(spark: SparkSession, d: str) -> DataFrame:
    a, b = lifts.halves(lifts.reads(spark, d))
    return J.usage(lifts.chain_transcripts(a), J.junction_stats(b))


@query
def dominated_novel(spark: SparkSession, d: str) -> DataFrame:
    return J.dominated_novel(J.usage(lifts.chain_transcripts(lifts.reads(spark, d)))).select(*J.JKEY)


@query
def junction_set_compare(spark: SparkSession, d: str) -> DataFrame:
    a, b = (J.junction_rows(x).select(*J.JKEY) for x in lifts.halves(lifts.reads(spark, d)))
    x = T.set_comparison(a, b, J.JKEY)
    return x.withColumn("sensitivity", F.round("sensitivity", 6)).withColumn("precision", F.round("precision", 6))


# transcripts ----------------------------------------------------------------------


def _tx(spark: SparkSession, d: str) -> DataFrame:
    """For operators on all transcripts."""
    return lifts.transcripts(lifts.reads(spark, d))


def _chained(spark: SparkSession, d: str) -> DataFrame:
    """For operators on intron chains."""
    return lifts.chain_transcripts(lifts.reads(spark, d))


@query
def dup_collapse(spark: SparkSession, d: str) -> DataFrame:
    x = T.collapse_alignments(lifts.reads(spark, d))
    return x.select("chrom", "strand", _exon_text().alias("exons"), "weight", "n_reads", "row_id")


@query
def read_chains(spark: SparkSession, d: str) -> DataFrame:
    x = T.read_chains(lifts.reads(spark, d))
    return x.select("chrom", "strand", "tx_id", "coverage", "start", "end", _chain_text().alias("chain"))


@query
def raw_transcripts(spark: SparkSession, d: str) -> DataFrame:
    return T.raw_transcripts(lifts.reads(spark, d)).select("tx_id", "chrom", "strand", "coverage", _exon_text().alias("exons"))


@query
def chain_dedup(spark: SparkSession, d: str) -> DataFrame:
    raw = T.raw_transcripts(lifts.reads(spark, d))
    return T.chain_dedup(raw).select("tx_id", "coverage")


@query
def subset_chains(spark: SparkSession, d: str) -> DataFrame:
    return T.subset_chains(_chained(spark, d))


@query
def containment_filter(spark: SparkSession, d: str) -> DataFrame:
    return T.containment_filter(_tx(spark, d)).select("tx_id", "coverage")


@query
def near_equal_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Chains within 500 bases at every site: the tables hold none that are closer."""
    return T.near_chain_pairs(_chained(spark, d), 500).select("tx_id", "r_tx_id")


@query
def isofrac_locus(spark: SparkSession, d: str) -> DataFrame:
    return T.isofrac_locus(_tx(spark, d), 0.05).select("tx_id", "coverage")


@query
def opposite_dominated(spark: SparkSession, d: str) -> DataFrame:
    return T.opposite_dominated(_tx(spark, d), 3.0)


@query
def intronic(spark: SparkSession, d: str) -> DataFrame:
    return T.intronic(T.raw_transcripts(lifts.reads(spark, d)))


@query
def retained_introns(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh read keeps its introns of at most 2,500 bases: the tables hold no retained ones."""
    return T.retained_introns(T.raw_transcripts(lifts.retaining(lifts.reads(spark, d))), 1.0)


@query
def unwitnessed(spark: SparkSession, d: str) -> DataFrame:
    a, b = lifts.halves(lifts.reads(spark, d))
    return T.unwitnessed(lifts.chain_transcripts(a), b)


@query
def supported_introns(spark: SparkSession, d: str) -> DataFrame:
    r = lifts.reads(spark, d)
    return T.supported_introns(lifts.chain_transcripts(r), J.junction_stats(r), 2).select("tx_id")


@query
def length_filters(spark: SparkSession, d: str) -> DataFrame:
    return T.length_filters(_tx(spark, d), min_exon=20, min_length=500, terminal=25).select("tx_id")


@query
def coverage_gate(spark: SparkSession, d: str) -> DataFrame:
    return T.coverage_gate(T.raw_transcripts(lifts.reads(spark, d)), 2, 3).select("tx_id", "coverage")


@query
def tpm(spark: SparkSession, d: str) -> DataFrame:
    x = T.abundance(_tx(spark, d), 1e6)
    return x.select("tx_id", F.round("tpm", 4).alias("tpm"), F.round("fpkm", 4).alias("fpkm"))


@query
def gene_abundance(spark: SparkSession, d: str) -> DataFrame:
    x = T.gene_abundance(T.gene_ids(T.abundance(_tx(spark, d))))
    return x.select("gene_id", "chrom", "strand", "start", "end", "n_tx", "coverage", F.round("tpm", 3).alias("tpm"))


@query
def top_transcripts(spark: SparkSession, d: str) -> DataFrame:
    return T.rank_in_locus(_tx(spark, d), 3).select("chrom", "strand", "locus", "tx_id", "rank")


@query
def exact_reference(spark: SparkSession, d: str) -> DataFrame:
    a, b = (lifts.transcripts(x) for x in lifts.halves(lifts.reads(spark, d)))
    return T.exact_reference(a, b)


@query
def reference_subset(spark: SparkSession, d: str) -> DataFrame:
    a, b = (lifts.chain_transcripts(x) for x in lifts.halves(lifts.reads(spark, d)))
    return T.reference_subset(a, b)


@query
def zero_novel_not_exact(spark: SparkSession, d: str) -> DataFrame:
    a, b = (lifts.chain_transcripts(x) for x in lifts.halves(lifts.reads(spark, d)))
    return T.zero_novel_not_exact(a, b)


@query
def recovered_guides(spark: SparkSession, d: str) -> DataFrame:
    a, b = (T.raw_transcripts(x).withColumn("coverage", F.col("coverage").cast("double")) for x in lifts.halves(lifts.reads(spark, d)))
    return T.recover_guides(a, b).select("tx_id", "coverage")


@query
def structural_merge(spark: SparkSession, d: str) -> DataFrame:
    parts = [lifts.transcripts(x) for x in lifts.halves(lifts.reads(spark, d))]
    return T.structural_merge(parts).select("tx_id", "chrom", "strand", _exon_text().alias("exons"))


@query
def loss_report(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "ggo19_needy_top15")
    c = p.select(F.col("locus_id").alias("ref_id"), F.explode_outer(F.regexp_extract_all("classes", F.lit("([=a-z]):"), F.lit(1))).alias("class_code"))
    best = T.best_class(c.where("class_code IS NOT NULL"))
    return T.loss_report(best, p.select(F.col("locus_id").alias("ref_id")).where("ref_id IS NOT NULL"))


@query
def cigar_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    r = lifts.reads(spark, d).withColumn("cigar", S.cigar_of_exons(F.col("exons")))
    back = r.withColumn("back", S.exons_of_cigar(F.col("start"), F.col("cigar")))
    return back.select("row_id", "cigar", _exon_text("back").alias("exons"))


@query
def intron_table(spark: SparkSession, d: str) -> DataFrame:
    return sinks.intron_rows(_chained(spark, d))


@query
def assembled(spark: SparkSession, d: str) -> DataFrame:
    p = A.locus_paths(lifts.reads(spark, d))
    x = A.assemble_loci(p, ["chrom", "strand", "locus"])
    return x.select("chrom", "strand", "locus", "tx_no", "origin", F.round("coverage", 4).alias("coverage"), _exon_text().alias("exons"))


def _guided(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Reads of one sample and, as guides, the chains of the other."""
    a, b = lifts.halves(lifts.reads(spark, d))
    return a, cut(lifts.chain_transcripts(b))


def _assembled(x: DataFrame) -> DataFrame:
    return x.select("chrom", "strand", "locus", "tx_no", "origin", "guide_id", F.round("coverage", 4).alias("coverage"), _exon_text().alias("exons"))


@query
def assembled_guided(spark: SparkSession, d: str) -> DataFrame:
    r, g = _guided(spark, d)
    return _assembled(A.assemble_loci(A.locus_paths(r, guides=g), ["chrom", "strand", "locus"]))


@query
def guide_expression(spark: SparkSession, d: str) -> DataFrame:
    """Estimation mode: every guide with its own exons, whether anything supports it or not."""
    r, g = _guided(spark, d)
    x = A.assemble_loci(A.locus_paths(r, guides=g), ["chrom", "strand", "locus"], only_guides=True)
    return x.select("guide_id", "chrom", "strand", _exon_text().alias("exons"))


@query
def assembled_supplemented(spark: SparkSession, d: str) -> DataFrame:
    x = A.assemble_loci(A.locus_paths(lifts.reads(spark, d)), ["chrom", "strand", "locus"], supplement=True)
    return _assembled(x)


@query
def filtered_loci(spark: SparkSession, d: str) -> DataFrame:
    x = LF.filter_loci(_tx(spark, d))
    return x.select("tx_id", "chrom", "strand", F.round("coverage", 4).alias("coverage"), "why", _exon_text().alias("exons"))


@query
def transcript_coverage(spark: SparkSession, d: str) -> DataFrame:
    r = cut(lifts.reads(spark, d))
    x = CV.transcript_coverage(lifts.transcripts(r), cut(R.coverage_segments(lifts.exon_rows(r), ["chrom"])))
    return x.select("tx_id", "cov_sum", F.floor(F.col("mean") * 1000).alias("mean_milli"))


@query
def low_introns(spark: SparkSession, d: str) -> DataFrame:
    r = cut(lifts.reads(spark, d))
    x = CV.low_introns(lifts.chain_transcripts(r), cut(R.coverage_segments(lifts.exon_rows(r), ["chrom"])))
    return x.select("tx_id", "part", F.floor(F.col("mean") * 1000).alias("mean_milli"), "low")


@query
def resolved_strands(spark: SparkSession, d: str) -> DataFrame:
    r = cut(lifts.reads(spark, d))
    return CV.resolve_strand(r, J.junction_stats(r)).groupBy("strand", "resolved_strand").agg(F.count(F.lit(1)).alias("n_reads"))


@query
def pile_ups(spark: SparkSession, d: str) -> DataFrame:
    return CV.pile_ups(cut(lifts.reads(spark, d)))


@query
def bridged_gaps(spark: SparkSession, d: str) -> DataFrame:
    r = cut(lifts.reads(spark, d))
    return CV.bridge_gaps(cut(R.coverage_segments(lifts.exon_rows(r), ["chrom"])), r)


@query
def node_boundaries(spark: SparkSession, d: str) -> DataFrame:
    r = cut(lifts.reads(spark, d))
    seg = cut(R.coverage_segments(lifts.exon_rows(r), ["chrom", "strand"]))
    x = CV.node_boundaries(G.split_nodes(r), seg, ["chrom", "strand"])
    return x.withColumn("strength", F.round("strength", 3))


# graphs and flow --------------------------------------------------------------------


@query
def exon_islands(spark: SparkSession, d: str) -> DataFrame:
    return G.exon_islands(lifts.reads(spark, d)).select("chrom", "strand", "start", "end")


@query
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.split_nodes(lifts.reads(spark, d))


@query
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    r = cut(lifts.reads(spark, d))
    return G.graph_edges(G.split_nodes(r), r)


@query
def read_paths(spark: SparkSession, d: str) -> DataFrame:
    r = cut(lifts.reads(spark, d))
    x = G.map_reads(r, G.split_nodes(r))
    return x.select("row_id", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query
def transfrags(spark: SparkSession, d: str) -> DataFrame:
    r = cut(lifts.reads(spark, d))
    x = G.transfrags(G.map_reads(r, G.split_nodes(r)))
    return x.select("chrom", "strand", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"), "abundance", "n_reads")


@query
def edge_capacities(spark: SparkSession, d: str) -> DataFrame:
    return G.edge_capacities(lifts.flow_paths(spark, d), BUNDLE).withColumn("capacity", F.round("capacity", 4))


@query
def node_flux(spark: SparkSession, d: str) -> DataFrame:
    x = G.node_flux(lifts.flow_paths(spark, d), BUNDLE)
    return x.select(*BUNDLE, "node", *[F.round(c, 4).alias(c) for c in ("abundin", "abundout", "longcov", "nodecov")])


@query
def greedy_flow(spark: SparkSession, d: str) -> DataFrame:
    return G.decompose(G.edge_capacities(lifts.flow_paths(spark, d), BUNDLE), BUNDLE)


@query
def max_flow(spark: SparkSession, d: str) -> DataFrame:
    """All paths run from source to sink, so the flow is their weight."""
    x = G.flow_values(G.edge_capacities(lifts.flow_paths(spark, d), BUNDLE), BUNDLE)
    return x.withColumn("max_flow", F.round("max_flow", 4))


@query
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.graph_stats(G.edge_capacities(lifts.flow_paths(spark, d), BUNDLE), BUNDLE)


@query
def absorbed_paths(spark: SparkSession, d: str) -> DataFrame:
    x = lifts.flow_paths(spark, d).groupBy(*BUNDLE, "path").agg(F.sum("abundance").alias("abundance"))
    x = G.absorb(x, BUNDLE)
    return x.select(*BUNDLE, F.array_join(F.col("path").cast("array<string>"), ",").alias("path"), F.round("abundance", 4).alias("abundance"))


@query
def partition_signature(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes").where("chrom IS NOT NULL AND start < end").select(*BUNDLE, "start", "end").distinct()
    return sinks.segment_signature(n, BUNDLE)


# families -------------------------------------------------------------------------------


@query
def multimap_links(spark: SparkSession, d: str) -> DataFrame:
    return FA.locus_links(lifts.placements(lifts.reads(spark, d)))


@query
def families(spark: SparkSession, d: str) -> DataFrame:
    return FA.families(FA.locus_links(lifts.placements(lifts.reads(spark, d))))


@query
def em_weights(spark: SparkSession, d: str) -> DataFrame:
    p = lifts.placements(lifts.reads(spark, d)).withColumnRenamed("locus", "copy")
    x, _, _ = FA.em_reweight(p)
    return x.select("read", "copy", F.round("weight", 5).alias("weight"))


@query
def phase_split(spark: SparkSession, d: str) -> DataFrame:
    r = R.regions(lifts.reads(spark, d), ["chrom"]).select(
        "row_id", F.concat_ws(":", "chrom", "region_start").alias("locus"),
        F.when(F.col("strand") == 1, 1).when(F.col("strand") == -1, 2).alias("hp"),
    )
    return FA.phase_split(r).groupBy("locus", "phase").agg(F.count(F.lit(1)).alias("n_reads"))


@query
def junction_jaccard(spark: SparkSession, d: str) -> DataFrame:
    j = F.explode(chains.junctions(F.col("exons")))
    k = _chained(spark, d).select(F.col("tx_id").alias("id"), "chrom", "strand", j.alias("j"))
    k = k.select("id", F.concat_ws(":", "chrom", "strand", "j.donor", "j.acceptor").alias("kmer"))
    return FA.shared_kmers(k, 0.8).withColumn("jaccard", F.round("jaccard", 6))


@query
def diagnostic_alleles(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select(
        F.lit(0).alias("family"), F.col("l_returnflag").alias("copy"), F.col("l_partkey").alias("pos"), F.col("l_linestatus").alias("base"), F.lit(1).cast("long").alias("n")
    )
    return FA.diagnostic_alleles(x)


# reports -----------------------------------------------------------------------------------


@query
def stage_dashboard(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "ggo19_needy_next5_run_strg_29")
    sums = ("n_reads", "n_junctions", "n_nodes", "n_edges", "n_transfrags", "n_transcripts", "seed_total", "seed_stored", "seed_rescued")
    return x.groupBy("stage_id").agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(c).alias(c) for c in sums])


@query
def stage_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Bundles with the stages that changed their structure: distinct hashes by bundle."""
    x = table(spark, d, "ggo19_needy_next5_run_strg_29").where("chrom IS NOT NULL")
    return x.groupBy("run_id", "chrom", "start", "end", "strand").agg(
        F.countDistinct("stage_id").alias("n_stages"), F.countDistinct("struct_hash").alias("n_hashes")
    )


@query
def needy_panel(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen loci of highest priority (a top-k report)."""
    x = table(spark, d, "ggo19_needy_top15").where("locus_id IS NOT NULL")
    best = x.groupBy("locus_id").agg(F.max("priority_score").alias("priority_score"), F.max("n_needy_refs").alias("n_needy_refs"))
    return best.orderBy(F.desc("priority_score"), F.desc("n_needy_refs"), "locus_id").limit(15)


@query
def source_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "aligned_reads").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query
def partition_drift(spark: SparkSession, d: str) -> DataFrame:
    """Segments that graph nodes and partition signatures of one bundle share or not."""
    p = table(spark, d, "partition_geometry").where("chrom IS NOT NULL AND signature IS NOT NULL")
    seg = p.select("run_id", "chrom", F.explode(chains.packed_exons(F.col("signature"))).alias("s"))
    seg = seg.select("run_id", "chrom", (F.col("s.start") + 1).alias("start"), (F.col("s.end") + 1).alias("end"))
    n = table(spark, d, "nodes").where("chrom IS NOT NULL AND start < end").select("run_id", "chrom", "start", "end")
    return T.set_comparison(seg, n, ["run_id", "chrom", "start", "end"]).select("found", "missing", "extra")


@query
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    from splicelake.streaming.sessions import sessions

    return sessions(table(spark, d, "events"), "user_id", "ts", "6 hours")


@query
def first_events(spark: SparkSession, d: str) -> DataFrame:
    """Repeats of one user, type and second collapsed to the first."""
    x = table(spark, d, "events").withColumn("second", F.date_trunc("second", "ts"))
    g = x.groupBy("user_id", "event_type", "second").agg(F.min("event_id").alias("event_id"), F.count(F.lit(1)).alias("n"))
    return g.select("user_id", "event_type", "event_id", "n")


from splicelake.plans.loci_sql import ORACLES  # noqa: E402,F401
