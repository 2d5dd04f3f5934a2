"""Audits of runs against references, and rules that look at one neighbour at a time.

All are compositions of joins and aggregations; interval sides go through bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splicelake.functions import chains
from splicelake.operators.coverage import exon_coverage
from splicelake.operators.ranges import overlap_join, overlap_semi, range_coverage, tolerance_join
from splicelake.operators.transcripts import PLACE, exact_reference, with_structure

JKEY = ("chrom", "strand", "donor", "acceptor")


# runs and references -------------------------------------------------------------------------


def presence(parts: Sequence[tuple[str, DataFrame]], keys: Sequence[str]) -> DataFrame:
    """Bundle disambiguation: keys of several layers with one flag a layer and ``layer``: the first that
    holds it. Keys compare null-safely."""
    u = None
    for name, df in parts:
        x = df.select(*keys, F.lit(name).alias("__l"))
        u = x if u is None else u.unionByName(x)
    flags = [F.max((F.col("__l") == n).cast("int")).cast("boolean").alias(n) for n, _ in parts]
    g = u.groupBy(*keys).agg(*flags)
    return g.withColumn("layer", F.coalesce(*[F.when(F.col(n), n) for n, _ in parts]))


def class_gaps(tracking: DataFrame, code: str = "class_code", bucket: Sequence[tuple[str, str]] = (("exact", "="), ("variant", "jcmno"), ("inside", "ieki"), ("apart", "xspuyr"))) -> DataFrame:
    """Gap analysis: comparison rows by bucket of their class and class, with their share."""
    at = F.coalesce(*[F.when(F.instr(F.lit(letters), F.col(code)) > 0, name) for name, letters in bucket], F.lit("other"))
    g = tracking.where(F.col(code).isNotNull()).groupBy(at.alias("bucket"), F.col(code).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("bucket", "code", "n", (F.col("n") / g.agg(F.sum("n")).scalar()).alias("share"))


def attribute_agreement(tx: DataFrame, ref: DataFrame, value: str = "coverage") -> DataFrame:
    """GTF attribute comparison: number, correlation and mean ratio of a value over exact matches."""
    m = exact_reference(tx, ref).join(tx.select("tx_id", F.col(value).cast("double").alias("a")), "tx_id")
    m = m.join(ref.select(F.col("tx_id").alias("ref_id"), F.col(value).cast("double").alias("b")), "ref_id")
    return m.agg(F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("correlation"), F.avg(F.col("a") / F.col("b")).alias("mean_ratio"))


def region_support(regions: DataFrame, reads: DataFrame, ident: str) -> DataFrame:
    """Absent references: reads and spliced reads that overlap each region; regions without any have 0."""
    r = reads.select("chrom", "start", "end", (F.size("exons") > 1).cast("int").alias("spliced"))
    hit = overlap_join(regions.select(ident, "chrom", "start", "end"), r, ["chrom"])
    n = hit.groupBy(ident).agg(F.count(F.lit(1)).alias("n_reads"), F.sum("r_spliced").alias("n_spliced"))
    return regions.select(ident).join(n, ident, "left").fillna(0, ["n_reads", "n_spliced"])


def transcript_fates(tx: DataFrame, ref: DataFrame) -> DataFrame:
    """Full audit: tx_id, fate: exact, known_introns (all of them), some_introns, overlap or novel."""
    x = with_structure(tx).select("tx_id", *PLACE, "start", "end", "chain", "n_exons")
    known = with_structure(ref).select(*PLACE, F.explode("chain").alias("j")).distinct().withColumn("k", F.lit(1))
    own = x.select("tx_id", *PLACE, F.explode("chain").alias("j")).join(known, [*PLACE, "j"], "left").groupBy("tx_id").agg(F.count("k").alias("k"), F.count(F.lit(1)).alias("n"))
    exact = exact_reference(tx, ref).select("tx_id").distinct().withColumn("exact", F.lit(True))
    r = with_structure(ref).select(*PLACE, "start", "end")
    near = overlap_semi(x, r, list(PLACE), "tx_id").select("tx_id", F.lit(True).alias("near"))
    y = x.select("tx_id").join(own, "tx_id", "left").join(exact, "tx_id", "left").join(near, "tx_id", "left")
    fate = F.when(F.col("exact"), "exact").when(F.col("k") == F.col("n"), "known_introns").when(F.col("k") > 0, "some_introns").when(F.col("near"), "overlap").otherwise("novel")
    return y.select("tx_id", fate.alias("fate"))


def overlapping_names(regions: DataFrame, genes: DataFrame, ident: str, name: str) -> DataFrame:
    """Gene lookup: (ident, name) of genes that overlap a region, once each."""
    hit = overlap_join(regions.select(ident, "chrom", "start", "end"), genes.select(name, "chrom", "start", "end"), ["chrom"])
    return hit.select(ident, F.col(f"r_{name}").alias(name)).distinct()


def paralog_matrix(members: DataFrame, family: str, copy: str, copies: Sequence[str]) -> DataFrame:
    """Per-paralog breakdown: rows per family and copy, one column a copy."""
    return members.groupBy(family).pivot(copy, list(copies)).count().fillna(0, list(copies))


# junctions and coverage ----------------------------------------------------------------------------


def run_through(stats: DataFrame, segments: DataFrame, flank: int = 25, share: float = 0.5) -> DataFrame:
    """Q5: junctions with the mean coverage of their intron and of ``flank`` bases of exon on either side;
    demoted where the intron's reaches ``share`` of the flanks'."""
    part = F.explode(F.array(*[
        F.struct(F.lit(n).alias("p"), s.alias("start"), e.alias("end"))
        for n, s, e in (("flank", F.col("donor") - flank, F.col("donor")), ("intron", F.col("donor"), F.col("acceptor")), ("flank2", F.col("acceptor"), F.col("acceptor") + flank))
    ]))
    r = stats.where("donor < acceptor").select(*JKEY, part.alias("w")).select(*JKEY, "w.p", "w.start", "w.end")
    c = range_coverage(segments, r, ["chrom"], [*JKEY, "p"])
    g = c.groupBy(*JKEY).agg(
        F.sum(F.when(F.col("p") == "intron", F.col("cov_sum") / (F.col("end") - F.col("start")))).alias("intron"),
        (F.sum(F.when(F.col("p") != "intron", F.col("cov_sum"))) / (2 * flank)).alias("flank"),
    )
    return g.withColumn("demoted", F.col("intron") >= F.col("flank") * F.lit(share))


def exon_pairing(stats: DataFrame, exons: DataFrame, tolerance: int = 10) -> DataFrame:
    """Q17: junctions whose sites meet exon ends within the tolerance, with the smaller of the weights of the
    exons that end at the donor and begin at the acceptor. ``exons``: chrom, strand, start, end, weight."""
    ends = exons.groupBy(*PLACE, F.col("end").alias("donor")).agg(F.sum("weight").alias("w"))
    starts = exons.groupBy(*PLACE, F.col("start").alias("acceptor")).agg(F.sum("weight").alias("w"))
    d = tolerance_join(stats.select(*JKEY), ends, list(PLACE), ["donor"], tolerance).groupBy(*JKEY).agg(F.sum("r_w").alias("wd"))
    a = tolerance_join(stats.select(*JKEY), starts, list(PLACE), ["acceptor"], tolerance).groupBy(*JKEY).agg(F.sum("r_w").alias("wa"))
    return d.join(a, list(JKEY)).select(*JKEY, F.least("wd", "wa").alias("weight"))


def run_on_splits(tx: DataFrame, segments: DataFrame, share: float = 0.5) -> DataFrame:
    """Transcripts split at internal exons whose mean coverage is below ``share`` of both neighbours':
    tx_id, part (from 0), exons; the weak exon falls away. Transcripts without one have no row."""
    e = exon_coverage(tx, segments).select("tx_id", "part", "start", "end", "mean")
    w = Window.partitionBy("tx_id").orderBy("part")
    e = e.withColumn("__l", F.lag("mean").over(w)).withColumn("__r", F.lead("mean").over(w))
    e = e.withColumn("dip", (F.col("mean") < F.lit(share) * F.least("__l", "__r")) & F.col("__l").isNotNull() & F.col("__r").isNotNull())
    e = e.withColumn("piece", F.sum(F.col("dip").cast("int")).over(w))
    g = e.where("NOT dip").groupBy("tx_id", "piece").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("exons"))
    return g.join(e.where("dip").select("tx_id").distinct(), "tx_id", "left_semi").select("tx_id", F.col("piece").alias("part"), "exons")


def chain_registry(candidates: DataFrame, registry: DataFrame, tolerance: int = 10, least: int = 5) -> DataFrame:
    """tx_ids whose intron lengths, ``least`` or more, agree within the tolerance with those of a registered
    transcript, wherever it lies. The registry is a table built first, not state that grows on the way."""

    def lengths(x: DataFrame) -> DataFrame:
        return x.select("tx_id", chains.intron_lengths(F.col("exons")).alias("l")).where(F.size("l") >= least).withColumn("n", F.size("l")).withColumn("first", F.get("l", F.lit(0)))

    reg = lengths(registry).select("n", "first", "l").distinct()
    near = tolerance_join(lengths(candidates), reg, ["n"], ["first"], tolerance)
    close = F.forall(F.arrays_zip("l", "r_l"), lambda x: F.abs(x["l"] - x["r_l"]) <= tolerance)
    return near.where(close).select("tx_id").distinct()


def near_anchor(exons: Column, position: Column, support: int = 10) -> Column:
    """Mismatch near an anchor: whether a position lies within ``support`` bases of a splice site."""
    return F.exists(chains.junctions(exons), lambda j: (F.abs(position - j["donor"]) <= support) | (F.abs(position - j["acceptor"]) <= support))


def stitched_coverage(cov: Column, length: Column, other_cov: Column, other_length: Column) -> Column:
    """Extend prediction: coverage of a single exon stitched to another, weighted by length."""
    return (cov * length + other_cov * other_length) / (length + other_length)


# families -----------------------------------------------------------------------------------------


def exon_coverage_share(reads: DataFrame, nodes: DataFrame, keys: Sequence[str], group: str, ident: str = "row_id") -> DataFrame:
    """V7: share of a group's nodes that a read's exons touch. ``nodes``: keys, group, start, end; reads have group, too."""
    keys = list(keys)
    total = nodes.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("__n"))
    ex = reads.select(ident, *keys, group, F.explode("exons").alias("e")).select(ident, *keys, group, F.col("e.start").alias("start"), F.col("e.end").alias("end"))
    hit = overlap_join(ex, nodes.select(*keys, group, "start", "end"), [*keys, group]).groupBy(ident, *keys, group).agg(F.countDistinct("r_start").alias("__k"))
    return hit.join(total, [*keys, group]).select(ident, (F.col("__k") / F.col("__n")).alias("share"))


def length_divergence(reads: DataFrame, group: str, ident: str = "row_id") -> DataFrame:
    """V8: the smallest difference of a read's exonic length to that of another read of its group (0 where one is
    equal, null where it is alone). Lengths are compared in order, so only neighbours meet."""
    x = reads.select(ident, group, chains.exonic_length(F.col("exons")).alias("n"))
    g = x.groupBy(group, "n").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(group).orderBy("n")
    near = F.least(F.col("n") - F.lag("n").over(w), F.lead("n").over(w) - F.col("n"))
    g = g.withColumn("divergence", F.when(F.col("c") > 1, F.lit(0).cast("long")).otherwise(near))
    return x.join(g.select(group, "n", "divergence"), [group, "n"]).select(ident, "divergence")


def copy_paths(members: DataFrame) -> DataFrame:
    """The nodes of each copy of a family in order of start: family, copy, path. Needs node, start."""
    g = members.groupBy("family", "copy").agg(F.array_sort(F.collect_set(F.struct("start", "node"))).alias("l"))
    return g.select("family", "copy", F.col("l.node").alias("path"))


# graphs --------------------------------------------------------------------------------------------


def missing_edges(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Neighbouring nodes (by number) of a bundle that no path joins, as paths of two: keys, u, v."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("node")
    x = nodes.select(*keys, "node").distinct().withColumn("v", F.lead("node").over(w)).where("v IS NOT NULL").withColumnRenamed("node", "u")
    return x.join(edges.select(*keys, "u", "v").distinct(), [*keys, "u", "v"], "left_anti")


def seed_ranks(paths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """O2, O3: the order in which paths of a bundle seed: by weight, then by their nodes."""
    w = Window.partitionBy(*keys).orderBy(F.desc("abundance"), "path")
    return paths.withColumn("rank", F.row_number().over(w))


def strand_colours(islands: DataFrame) -> DataFrame:
    """Unstranded islands (strand 0) with the strand of the stranded ones they overlap; 0 where there are
    none or both. Needs chrom, strand, start, end."""
    plain, marked = islands.where("strand = 0"), islands.where("strand <> 0")
    hit = overlap_join(plain.select("chrom", "start", "end"), marked.select("chrom", "strand", "start", "end"), ["chrom"])
    g = hit.groupBy("chrom", "start", "end").agg(F.min("r_strand").alias("lo"), F.max("r_strand").alias("hi"))
    x = plain.select("chrom", "start", "end").join(g, ["chrom", "start", "end"], "left")
    return x.select("chrom", "start", "end", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(0).alias("colour"))


def read_groups(reads: DataFrame, islands: DataFrame, keys: Sequence[str] = PLACE, ident: str = "row_id") -> DataFrame:
    """The islands each read touches, in order: ident, groups (their starts)."""
    from splicelake.operators.graphs import map_reads

    x = map_reads(reads, islands, keys, ident)
    return x.select(ident, F.col("path").alias("groups"))


# transcripts ---------------------------------------------------------------------------------------


def high_overlap(tx: DataFrame, share: float = 0.8, ratio: float = 0.5) -> DataFrame:
    """Multi-exon tx_ids of which another of the place with more coverage holds at least ``share`` of the
    introns, and that have at most ``ratio`` of its coverage.

    Such a transcript shares one of its ``n - ceil(share * n) + 1`` rarest introns with the other, so only
    these are joined; candidates are counted exactly."""
    x = with_structure(tx).where("n_exons > 1").select("tx_id", *PLACE, "coverage", "n_exons", F.explode("chain").alias("j"))
    df = x.groupBy(*PLACE, "j").agg(F.count(F.lit(1)).alias("df"))
    w = Window.partitionBy("tx_id").orderBy("df", "j")
    n = F.col("n_exons") - 1
    ranked = x.join(df, [*PLACE, "j"]).withColumn("r", F.row_number().over(w))
    pre = ranked.where(F.col("r") <= n - F.ceil(n * F.lit(share) - 1e-9) + 1).select("tx_id", "coverage", "n_exons", *PLACE, "j")
    other = x.select(F.col("tx_id").alias("o"), F.col("coverage").alias("oc"), *PLACE, "j")
    cand = pre.join(other, [*PLACE, "j"]).where((F.col("o") != F.col("tx_id")) & (F.col("oc") > F.col("coverage")) & (F.col("coverage") <= F.col("oc") * F.lit(ratio)))
    cand = cand.select("tx_id", "n_exons", "o").distinct()
    both = cand.join(x.select("tx_id", "j"), "tx_id").join(other.select("o", "j"), ["o", "j"])
    k = both.groupBy("tx_id", "o", "n_exons").agg(F.count(F.lit(1)).alias("k"))
    return k.where(F.col("k") >= n * F.lit(share) - 1e-9).select("tx_id").distinct()


def included_variants(tx: DataFrame, drop: float = 0.5, reach: int = 100) -> DataFrame:
    """tx_ids whose introns are a run of those of another of the place, whose ends pass its exons there by at
    most ``reach`` bases, and that have less than ``drop`` of its coverage."""
    from splicelake.operators.transcripts import larger_chains
    from splicelake.session import cut

    x = cut(with_structure(tx).where("n_exons > 1").select("tx_id", *PLACE, "chain", "n_exons", "exons", "start", "end", "coverage"))
    o = x.select(F.col("tx_id").alias("r_tx_id"), F.col("chain").alias("rc"), F.col("exons").alias("re"), F.col("coverage").alias("rcov"))
    p = larger_chains(x, x).join(x, "tx_id").join(o, "r_tx_id").where(F.col("coverage") < F.col("rcov") * F.lit(drop))
    at = F.array_position("rc", F.get("chain", F.lit(0))).cast("int")
    k = F.size("chain")
    run = (at > 0) & (F.slice("rc", F.greatest(at, F.lit(1)), k) == F.col("chain"))
    first, last = F.get("re", at - 1), F.get("re", at + k - 1)
    ends = (F.col("start") >= first["start"] - reach) & (F.col("end") <= last["end"] + reach)
    return p.where(run & ends).select("tx_id").distinct()


def within_exon(tx: DataFrame, share: float = 0.3) -> DataFrame:
    """P16 (kill): tx_ids that lie inside one exon of another of the place and have less than ``share`` of its coverage.
    Exons of one span count once, with their most coverage."""
    x = with_structure(tx).select("tx_id", *PLACE, "start", "end", "coverage")
    e = tx.select("tx_id", *PLACE, "coverage", F.explode("exons").alias("e")).groupBy(*PLACE, F.col("e.start").alias("start"), F.col("e.end").alias("end")).agg(F.max("coverage").alias("coverage"))
    hit = overlap_join(x, e, list(PLACE)).where("r_start <= start AND end <= r_end")
    return hit.where(F.col("coverage") < F.col("r_coverage") * F.lit(share)).select("tx_id").distinct()


def trim_weak_terminals(tx: DataFrame, segments: DataFrame, share: float = 0.1) -> DataFrame:
    """P16 (trim): multi-exon transcripts without a first or last exon whose mean coverage is below ``share`` of its
    neighbour's: tx_id, exons."""
    e = exon_coverage(tx.where(F.size("exons") > 1), segments).select("tx_id", "part", "start", "end", "mean")
    w = Window.partitionBy("tx_id").orderBy("part")
    e = e.withColumn("l", F.lag("mean").over(w)).withColumn("r", F.lead("mean").over(w))
    first = F.col("l").isNull() & (F.col("mean") < F.col("r") * F.lit(share))
    last = F.col("r").isNull() & (F.col("mean") < F.col("l") * F.lit(share))
    return e.where(~F.coalesce(first | last, F.lit(False))).groupBy("tx_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("exons"))


def cross_strand_retained(tx: DataFrame, share: float = 0.1) -> DataFrame:
    """tx_ids with an exon that spans an intron of a transcript of the other strand, of which they have less
    than ``share`` of the coverage. Introns of one span count once, with their most coverage."""
    x = with_structure(tx).where("strand <> 0")
    ex = x.select("tx_id", "chrom", F.col("strand").alias("s"), "coverage", F.explode("exons").alias("e"))
    ex = ex.select("tx_id", "chrom", "s", "coverage", F.col("e.start").alias("start"), F.col("e.end").alias("end"))
    it = x.select("chrom", (-F.col("strand")).alias("s"), F.col("coverage").alias("cov"), F.explode("chain").alias("j"))
    it = it.groupBy("chrom", "s", F.col("j.donor").alias("start"), F.col("j.acceptor").alias("end")).agg(F.max("cov").alias("cov"))
    p = overlap_join(ex, it, ["chrom", "s"]).where("start < r_start AND end > r_end")
    return p.where(F.col("coverage") < F.col("r_cov") * F.lit(share)).select("tx_id").distinct()


def alternative_ends(tx: DataFrame, clusters: DataFrame, margin: int = 25) -> DataFrame:
    """Shortened variants of multi-exon transcripts that begin at a cluster of read starts inside their first
    exon, ``margin`` bases or more from its ends: tx_id, centre, weight, exons. ``clusters``: place, centre, weight."""
    x = with_structure(tx).where("n_exons > 1").select("tx_id", *PLACE, "exons")
    e = F.get("exons", F.lit(0))
    first = x.select("tx_id", *PLACE, "exons", (e["start"] + margin).alias("start"), (e["end"] - margin).alias("end")).where("start < end")
    c = clusters.select(*PLACE, "weight", F.col("centre").alias("start"), (F.col("centre") + 1).alias("end"))
    hit = overlap_join(first, c, list(PLACE))
    new = F.concat(F.array(F.struct(F.col("r_start").alias("start"), e["end"].alias("end"))), F.slice("exons", F.lit(2), F.size("exons") - 1))
    return hit.select("tx_id", F.col("r_start").alias("centre"), F.col("r_weight").alias("weight"), new.alias("exons"))


def alternative_sites(tx: DataFrame, stats: DataFrame, window: int = 25, ratio: float = 0.7) -> DataFrame:
    """Variants of transcripts with an intron moved to another of its acceptor, whose donor lies within ``window``
    bases and which has at least ``ratio`` of its reads: tx_id, part (of the intron), donor, exons. A donor that
    would empty the exon before it makes no variant."""
    j = with_structure(tx).where("n_exons > 1").select("tx_id", *PLACE, "exons", F.posexplode("chain").alias("part", "j"))
    j = j.select("tx_id", *PLACE, "exons", "part", F.col("j.donor").alias("donor"), F.col("j.acceptor").alias("acceptor"))
    s = stats.select(*JKEY, "mrcount")
    own = s.select(*JKEY, F.col("mrcount").alias("own"))
    near = tolerance_join(j, s, [*PLACE, "acceptor"], ["donor"], window).where("donor <> r_donor").join(own, list(JKEY))
    near = near.where(F.col("r_mrcount") >= F.col("own") * F.lit(ratio))
    e = F.get("exons", F.col("part"))
    moved = F.transform("exons", lambda x, i: F.struct(x["start"].alias("start"), F.when(i == F.col("part"), F.col("r_donor")).otherwise(x["end"]).alias("end")))
    return near.where(e["start"] < F.col("r_donor")).select("tx_id", "part", F.col("r_donor").alias("donor"), moved.alias("exons"))


def longtrim(nodes: DataFrame, segments: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """Nodes cut at the change points of their coverage: keys, node, start, end."""
    from splicelake.operators.bundles import cut_nodes
    from splicelake.operators.coverage import node_boundaries
    from splicelake.session import cut

    return cut_nodes(nodes, cut(node_boundaries(nodes, segments, keys, **options)), keys)


def length_consensus(members: DataFrame, window: int = 20) -> DataFrame:
    """Per family and node the heaviest cluster of exon lengths (ties: the shorter): family, node, length, n.
    ``members``: family, node, length."""
    from splicelake.operators.ranges import cluster_positions

    c = cluster_positions(members.withColumn("w", F.lit(1).cast("long")), ["family", "node"], "length", "w", window, 1)
    best = c.groupBy("family", "node").agg(F.max(F.struct("weight", (-F.col("centre")).alias("c"))).alias("m"))
    return best.select("family", "node", (-F.col("m.c")).alias("length"), F.col("m.weight").alias("n"))


def local_pair_links(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Mates by the groups they lie in: group, mate_group, n. ``pairs``: row_id, mate_id; ``groups``: row_id, group."""
    a = pairs.join(groups, "row_id").join(groups.select(F.col("row_id").alias("mate_id"), F.col("group").alias("mate_group")), "mate_id")
    return a.groupBy("group", "mate_group").agg(F.count(F.lit(1)).alias("n"))


def snapped_guides(guides: DataFrame, stats: DataFrame, tolerance: int = 25) -> DataFrame:
    """Guides all of whose introns have a junction of their place within the tolerance at both sites, with these
    junctions: tx_id, chain. The nearest counts (ties: more reads, then the smaller sites)."""
    j = with_structure(guides).where("n_exons > 1").select("tx_id", *PLACE, F.size("chain").alias("n"), F.posexplode("chain").alias("i", "j"))
    j = j.select("tx_id", *PLACE, "n", "i", F.col("j.donor").alias("donor"), F.col("j.acceptor").alias("acceptor"))
    near = tolerance_join(j, stats.select(*JKEY, "mrcount"), list(PLACE), ["donor", "acceptor"], tolerance)
    far = F.abs(F.col("donor") - F.col("r_donor")) + F.abs(F.col("acceptor") - F.col("r_acceptor"))
    best = near.groupBy("tx_id", "n", "i").agg(F.min(F.struct(far.alias("d"), (-F.col("r_mrcount")).alias("m"), F.col("r_donor").alias("donor"), F.col("r_acceptor").alias("acceptor"))).alias("b"))
    g = best.groupBy("tx_id", "n").agg(F.array_sort(F.collect_list(F.struct("i", "b"))).alias("l")).where(F.size("l") == F.col("n"))
    return g.select("tx_id", F.transform("l", lambda x: F.struct(x["b"]["donor"].alias("donor"), x["b"]["acceptor"].alias("acceptor"))).alias("chain"))


def graph_compatibility(matched: Column, exons: Column, path_length: Column) -> Column:
    """V2: share of matched exons times (1 + .1 ln(path length)); 0 without exons or path."""
    return F.when((exons > 0) & (path_length > 0), matched / exons * (1 + 0.1 * F.log(path_length.cast("double")))).otherwise(F.lit(0.0))


def assigned_copies(paths: DataFrame, members: DataFrame, ident: str) -> DataFrame:
    """Per path of a family the copy with the largest share of its nodes on the path (ties: more of them, then the
    smaller copy): ident, copy. ``paths``: family, ident, path; ``members``: family, copy, node."""
    m = members.select("family", "copy", "node").distinct()
    size = m.groupBy("family", "copy").agg(F.count(F.lit(1)).alias("n"))
    p = paths.select("family", ident, F.explode(F.array_distinct("path")).alias("node"))
    k = p.join(m, ["family", "node"]).groupBy("family", ident, "copy").agg(F.count(F.lit(1)).alias("k")).join(size, ["family", "copy"])
    best = k.groupBy(ident).agg(F.min(F.struct((-F.col("k") / F.col("n")).alias("s"), (-F.col("k")).alias("t"), "copy")).alias("b"))
    return best.select(ident, F.col("b.copy").alias("copy"))
