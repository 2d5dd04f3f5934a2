"""Gene families: linking loci, evidence for copies, and re-weighting of ambiguous placements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splicelake.functions import coords
from splicelake.operators.components import connected_components
from splicelake.session import cut


def multi_locus_reads(placements: DataFrame) -> DataFrame:
    """Distinct (read, locus) of reads that lie in more than one locus. Null names are no reads."""
    d = placements.where("read IS NOT NULL AND locus IS NOT NULL").select("read", "locus").distinct()
    many = d.groupBy("read").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("read")
    return d.join(many, "read", "left_semi")


TOGETHER = 256
"""Loci of one read that meet in one join key."""


def locus_links(placements: DataFrame, min_shared: int = 1) -> DataFrame:
    """Pairs of loci (a < b) with the number of reads they share, at least ``min_shared``.

    Pairs arise from a join of the distinct placements on the read. The loci of a read with
    more than ``TOGETHER`` are dealt into slices, and each pair of slices is a key of its own, so
    the pairs of one read, which the definition asks for, spread over tasks; counts are combined map-side."""
    d = cut(multi_locus_reads(placements))
    n = d.groupBy("read").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("__m"))
    d = d.join(n, "read").withColumn("__own", F.pmod(F.xxhash64("locus"), F.col("__m")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("__m") - 1))
    a = d.select("read", F.col("locus").alias("a"), F.col("__own").alias("__x"), others.alias("__y"))
    b = d.select("read", F.col("locus").alias("b"), others.alias("__x"), F.col("__own").alias("__y"))
    p = a.join(b, ["read", "__x", "__y"]).where("a < b")
    return p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_shared")).where(F.col("n_shared") >= min_shared)


def drop_mirrors(links: DataFrame, loci: DataFrame, share: float = 0.9) -> DataFrame:
    """Links between loci that are strand mirrors of each other removed.
    ``loci``: locus, chrom, start, end, strand (+ - .)."""
    cols = ("chrom", "start", "end", "strand")
    x = links
    for side in ("a", "b"):
        x = x.join(loci.select(F.col("locus").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in cols]), side)
    mirror = coords.is_strand_mirror(
        F.col("a_chrom"), F.col("a_start"), F.col("a_end"), F.col("a_strand"),
        F.col("b_chrom"), F.col("b_start"), F.col("b_end"), F.col("b_strand"), share,
    )
    return x.where(~mirror).select(*links.columns)


def families(links: DataFrame) -> DataFrame:
    """(family, locus, copy_idx) of loci connected by links; copies count from 0 by locus."""
    comp = connected_components(links, "a", "b").select(F.col("node").alias("locus"), F.col("component").alias("family"))
    w = Window.partitionBy("family").orderBy("locus")
    return comp.withColumn("copy_idx", F.row_number().over(w) - 1)


def strand_partition(members: DataFrame) -> DataFrame:
    """Families split by the strand of their loci; parts of fewer than two are dropped."""
    part = members.withColumn("part", F.concat_ws("/", F.col("family").cast("string"), "strand"))
    n = part.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("part")
    return part.join(n, "part", "left_semi")


def family_quality(members: DataFrame, evidence: DataFrame, max_copies: int = 30, min_shared: int = 10, per_copy: float = 1.0, max_cv: float = 1.5) -> DataFrame:
    """Copies, shared reads and intron-count variation per family, and whether it is kept.
    ``members``: family, locus, n_introns; ``evidence``: family, n_shared."""
    m = members.groupBy("family").agg(
        F.count(F.lit(1)).alias("n_copies"), F.avg("n_introns").alias("mean_introns"), F.stddev_pop("n_introns").alias("__sd")
    )
    x = m.join(evidence.groupBy("family").agg(F.sum("n_shared").alias("n_shared")), "family", "left").fillna(0, ["n_shared"])
    cv = F.when(F.col("mean_introns") > 0, F.col("__sd") / F.col("mean_introns")).otherwise(F.lit(0.0))
    keep = (
        F.col("n_copies").between(2, max_copies)
        & (F.col("n_shared") >= min_shared)
        & (F.col("n_shared") / F.col("n_copies") >= per_copy)
        & (F.col("cv") <= max_cv)
    )
    return x.withColumn("cv", cv).drop("__sd").withColumn("keep", keep)


def junction_consensus(junctions: DataFrame, round_to: int = 10, least: int = 2) -> DataFrame:
    """Junctions of a family relative to their copy, rounded, with the copies that show
    them. ``junctions``: family, copy, donor, acceptor."""
    r = lambda c: (F.floor(F.col(c) / round_to + 0.5) * round_to).cast("long").alias(c)
    x = junctions.select("family", "copy", r("donor"), r("acceptor"))
    return x.groupBy("family", "donor", "acceptor").agg(F.countDistinct("copy").alias("n_copies")).where(F.col("n_copies") >= least)


def diagnostic_alleles(bases: DataFrame, least: int = 3, dominant: float = 0.8) -> DataFrame:
    """Positions at which at least two copies are dominated by different bases.

    ``bases``: family, copy, pos, base ('=' where a covering read agrees with the
    reference), n. A copy counts with ``least`` reads or more and a base of share
    ``dominant`` (ties: the smaller base)."""
    n = bases.groupBy("family", "copy", "pos", "base").agg(F.sum("n").alias("n"))
    c = n.groupBy("family", "copy", "pos").agg(F.sum("n").alias("depth"), F.min(F.struct((-F.col("n")).alias("k"), "base")).alias("m"))
    c = c.select("family", "copy", "pos", "depth", F.col("m.base").alias("base"), (-F.col("m.k")).alias("n"))
    c = c.where((F.col("depth") >= least) & (F.col("n") >= F.col("depth") * F.lit(dominant)))
    good = c.groupBy("family", "pos").agg(F.min("base").alias("lo"), F.max("base").alias("hi")).where("lo <> hi")
    return c.join(good.select("family", "pos"), ["family", "pos"], "left_semi")


def em_reweight(placements: DataFrame, rounds: int = 20, settled: float = 1e-3, floor: float = 0.01) -> tuple[DataFrame, int, float]:
    """V1, V3: weights of ambiguous placements.

    ``placements``: read, copy, compat (fit of the read to the copy). Score of a
    placement is (compat + floor) times the square root of the copy's weight; scores
    are normalised per read, until no weight moves by ``settled`` or more. Returns the
    placements with weight, the rounds used and the last largest change. A read with one
    copy has weight 1 in every round, so the rounds take the ambiguous reads only and add
    the others' number by copy. Each round is two map-side combined aggregations and
    joins of ambiguous placements, and is checkpointed.
    """
    n = F.count(F.lit(1))
    base = cut(placements.groupBy("read", "copy").agg(F.max("compat").alias("compat")))
    per = cut(base.groupBy("read").agg(n.alias("__n")).where("__n > 1"))
    lone = base.where("read IS NOT NULL AND copy IS NOT NULL").join(per, "read", "left_anti")
    cur = cut(base.join(per, "read").select("read", "copy", "compat", (F.lit(1.0) / F.col("__n")).alias("weight")))
    held = cut(lone.groupBy("copy").agg(n.alias("__held")).join(cur, "copy", "left_semi"))
    used, delta = 0, float("inf")
    while used < rounds and delta >= settled:
        mass = cur.groupBy("copy").agg(F.sum("weight").alias("__mass")).join(held, "copy", "left")
        mass = mass.select("copy", (F.col("__mass") + F.coalesce("__held", F.lit(0))).alias("__mass"))
        s = cur.join(mass, "copy").withColumn("__s", (F.col("compat") + floor) * F.sqrt("__mass"))
        tot = s.groupBy("read").agg(F.sum("__s").alias("__t"))
        new = s.join(tot, "read").select(
            "read", "copy", "compat", F.when(F.col("__t") > 0, F.col("__s") / F.col("__t")).otherwise(F.col("weight")).alias("weight"),
            F.col("weight").alias("__old"),
        )
        new = cut(new)
        delta = new.agg(F.max(F.abs(F.col("weight") - F.col("__old")))).first()[0] or 0.0
        cur = new.drop("__old")
        used += 1
    return cur.unionByName(lone.withColumn("weight", F.lit(1.0))), used, delta


def em_route(families_: DataFrame, max_copies: int = 40, max_work: int = 2000) -> DataFrame:
    """V6: route of each family: skip (fewer than two copies or intronless), too_many, too_large, em."""
    work = F.col("n_copies") * F.greatest("n_reads", F.lit(10))
    route = (
        F.when((F.col("n_copies") < 2) | (F.col("n_introns") == 0), "skip")
        .when(F.col("n_copies") > max_copies, "too_many")
        .when(work > max_work, "too_large")
        .otherwise("em")
    )
    return families_.withColumn("route", route)


def phase_split(reads: DataFrame) -> DataFrame:
    """Loci that show both haplotypes split in two; unphased reads go to both. ``hp`` is 1, 2 or null."""
    both = reads.groupBy("locus").agg(F.max(F.when(F.col("hp") == 1, 1)).alias("a"), F.max(F.when(F.col("hp") == 2, 1)).alias("b"))
    both = both.where("a = 1 AND b = 1").select("locus", F.lit(True).alias("__both"))
    x = reads.join(both, "locus", "left")
    parts = F.when(F.col("__both") & F.col("hp").isNull(), F.array(F.lit(1), F.lit(2))).when(
        F.col("__both"), F.array("hp")
    ).otherwise(F.array(F.lit(0)))
    return x.withColumn("phase", F.explode(parts)).drop("__both")


def tile_scan(hits: DataFrame, keys: Sequence[str] = ("chrom",), size: int = 5000, stride: int = 2500, least: int = 200) -> DataFrame:
    """Tiles with at least ``least`` hits, and runs of such tiles as loci.
    ``hits``: keys, pos, n. Tiles begin at multiples of ``stride``."""
    from splicelake.operators.islands import label_islands

    keys = list(keys)
    last = F.floor(F.col("pos") / stride)
    first = F.greatest(F.floor((F.col("pos") - size) / stride) + 1, F.lit(0))
    t = hits.select(*keys, "n", F.explode(F.sequence(first, last)).alias("tile")).groupBy(*keys, "tile").agg(F.sum("n").alias("n"))
    t = t.where(F.col("n") >= least).select(
        *keys, "n", (F.col("tile") * stride).alias("start"), (F.col("tile") * stride + size).alias("end")
    )
    lab = label_islands(t, keys).select(
        *[F.col(k).alias(f"__{k}") for k in keys], F.col("__s").alias("__st"), F.col("__island").alias("locus_start")
    )
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("start") == F.col("__st")]
    return (
        t.join(lab, on)
        .groupBy(*keys, "locus_start")
        .agg(F.max("end").alias("locus_end"), F.count(F.lit(1)).alias("n_tiles"), F.max("n").alias("best"))
    )


def shared_kmers(kmers: DataFrame, min_jaccard: float) -> DataFrame:
    """Exact Jaccard of k-mer sets for all pairs (a < b) that reach ``min_jaccard``.

    ``kmers``: id, kmer. A pair can only reach t if the sizes agree within t, and then
    shares a k-mer among the ``(1-t)|A|+1`` rarest of either side (prefix filter), so the
    join runs on rare k-mers; candidates are then counted exactly. Nothing is capped.
    """
    k = cut(kmers.where("id IS NOT NULL AND kmer IS NOT NULL").select("id", "kmer").distinct())
    freq = k.groupBy("kmer").agg(F.count(F.lit(1)).alias("df"))
    w = Window.partitionBy("id").orderBy("df", "kmer")
    size = k.groupBy("id").agg(F.count(F.lit(1)).alias("size"))
    ranked = k.join(freq, "kmer").withColumn("rank", F.row_number().over(w)).join(size, "id")
    keep = F.col("size") - F.ceil(F.col("size") * F.lit(min_jaccard) - 1e-9) + 1
    pre = cut(ranked.where(F.col("rank") <= keep).select("id", "kmer", "size"))
    b = pre.select(F.col("id").alias("b"), "kmer", F.col("size").alias("sb"))
    cand = pre.withColumnRenamed("id", "a").join(b, "kmer").where("a < b")
    cand = cand.where((F.least("size", "sb") >= F.greatest("size", "sb") * F.lit(min_jaccard) - 1e-9)).select("a", "b", "size", "sb").distinct()
    both = cand.join(k.withColumnRenamed("id", "a"), "a").join(k.withColumnRenamed("id", "b"), ["b", "kmer"])
    n = both.groupBy("a", "b", "size", "sb").agg(F.count(F.lit(1)).alias("shared"))
    j = F.col("shared") / (F.col("size") + F.col("sb") - F.col("shared"))
    return n.withColumn("jaccard", j).where(F.col("jaccard") >= min_jaccard).select("a", "b", "shared", "jaccard")


# structures of a family ---------------------------------------------------------------


def gene_loci(tx: DataFrame, gap: int = 5000) -> DataFrame:
    """V9: transcripts of a family chained into gene loci while the gap is at most ``gap``:
    family, chrom, locus_start, locus_end, n_tx. Needs family, chrom, start, end."""
    from splicelake.operators.islands import label_islands

    keys = ["family", "chrom"]
    lab = label_islands(tx, keys, slack=gap).select(
        F.col("family").alias("__f"), F.col("chrom").alias("__c"), F.col("__s").alias("__st"), F.col("__island").alias("locus_start")
    )
    on = F.col("family").eqNullSafe(F.col("__f")) & F.col("chrom").eqNullSafe(F.col("__c")) & (F.col("start") == F.col("__st"))
    return tx.join(lab, on).groupBy(*keys, "locus_start").agg(F.max("end").alias("locus_end"), F.count(F.lit(1)).alias("n_tx"))


def exon_classes(exons: DataFrame, least: float = 0.3) -> DataFrame:
    """Exons of a family, in coordinates relative to their copy, clustered by reciprocal
    overlap of at least ``least`` (connected): adds node, the smallest exon_id of the class.
    Needs family, exon_id (unique), start, end."""
    from splicelake.operators.ranges import overlap_join

    x = exons.select("family", "exon_id", "start", "end")
    p = overlap_join(x, x, ["family"], bin_size=1 << 12).where("exon_id < r_exon_id")
    p = p.where(coords.reciprocal_overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")) >= least)
    comp = connected_components(p, "exon_id", "r_exon_id", vertices=x.select(F.col("exon_id").alias("node")))
    return exons.join(comp.select(F.col("node").alias("exon_id"), F.col("component").alias("node")), "exon_id")


def split_by_minimizers(members: DataFrame, least: float = 0.3) -> DataFrame:
    """Classes split where sequences don't share enough minimizers: members of one node
    stay together while linked by a Jaccard of at least ``least``. Needs node, exon_id, seq; adds part."""
    from splicelake.functions.sequences import minimizers

    k = members.select(F.col("exon_id").alias("id"), F.explode(minimizers(F.upper("seq"))).alias("kmer"))
    pairs = shared_kmers(k, least)
    n = members.select("exon_id", "node")
    same = pairs.join(n.select(F.col("exon_id").alias("a"), F.col("node").alias("na")), "a").join(
        n.select(F.col("exon_id").alias("b"), F.col("node").alias("nb")), "b"
    )
    comp = connected_components(same.where("na = nb"), "a", "b", vertices=n.select(F.col("exon_id").alias("node")))
    return members.join(comp.select(F.col("node").alias("exon_id"), F.col("component").alias("part")), "exon_id")


def family_edges(members: DataFrame) -> DataFrame:
    """Edges between exon classes: consecutive exons of a copy, with the copies that show them.
    Needs family, copy, node, start. A family with exons of both strands must be split before."""
    w = Window.partitionBy("family", "copy").orderBy("start", "node")
    x = members.withColumn("next", F.lead("node").over(w)).where("next IS NOT NULL")
    return x.groupBy("family", F.col("node").alias("u"), F.col("next").alias("v")).agg(F.countDistinct("copy").alias("support"))


def representative_copy(members: DataFrame) -> DataFrame:
    """Per family the copy in most classes (ties: the smallest)."""
    n = members.groupBy("family", "copy").agg(F.countDistinct("node").alias("n"))
    return n.groupBy("family").agg(F.min(F.struct((-F.col("n")).alias("k"), "copy")).alias("m")).select("family", F.col("m.copy").alias("copy"))


def synthesize_bundles(reads: DataFrame, least: int = 3) -> DataFrame:
    """Rescued reads with one node path as a bundle: family, path, n_reads, loglik (mean)."""
    g = reads.groupBy("family", "path").agg(F.count(F.lit(1)).alias("n_reads"), F.avg("loglik").alias("loglik"))
    return g.where(F.col("n_reads") >= least)


def rescue_class(reads: DataFrame, k: int = 15, masked: str = "masked_share", hits: str = "hits") -> DataFrame:
    """Rescue class: hits * k below 40: below; masked share above .3: masked; else external."""
    c = F.when(F.col(hits) * k < 40, "below").when(F.col(masked) > 0.3, "masked").otherwise("external")
    return reads.withColumn("rescue_class", c)


def novel_reads(reads: DataFrame, family_kmers: DataFrame, k: int = 15, least: int = 3, share: float = 0.01) -> DataFrame:
    """Unmapped reads matched to families by k-mers of both strands: read, family, hits.

    Windows are counted, repeats included; per family the better strand counts; at least
    ``least`` hits and ``share`` of the windows; the best family wins (ties: the smallest).
    ``reads``: read, seq; ``family_kmers``: family, kmer."""
    from splicelake.functions.sequences import kmers, reverse_complement

    up = F.upper("seq")
    both = F.explode(F.array(F.struct(F.lit(1).alias("s"), up.alias("q")), F.struct(F.lit(-1).alias("s"), reverse_complement(up).alias("q"))))
    x = reads.where("seq IS NOT NULL").select("read", F.greatest(F.length("seq") - k + 1, F.lit(0)).alias("n"), both.alias("b"))
    x = x.select("read", "n", "b.s", F.explode(kmers(F.col("b.q"), k)).alias("kmer"))
    # one row per distinct k-mer of a read, so the join carries counts and not windows
    x = x.groupBy("read", "n", "s", "kmer").agg(F.count(F.lit(1)).alias("c"))
    h = x.join(family_kmers.select("family", "kmer").distinct(), "kmer").groupBy("read", "n", "family", "s").agg(F.sum("c").alias("hits"))
    h = h.groupBy("read", "n", "family").agg(F.max("hits").alias("hits"))
    h = h.where((F.col("hits") >= least) & (F.col("hits") >= F.col("n") * F.lit(share)))
    best = h.groupBy("read").agg(F.min(F.struct((-F.col("hits")).alias("m"), "family")).alias("b"))
    return best.select("read", F.col("b.family").alias("family"), (-F.col("b.m")).alias("hits"))


def template_families(tx: DataFrame, by_gene: bool = True, gap: int = 100) -> DataFrame:
    """Annotation transcripts grouped to templates: by gene, or by overlapping spans with
    gaps of at most ``gap``. Adds template. Needs gene_id, chrom, strand, start, end."""
    if by_gene:
        return tx.withColumn("template", F.col("gene_id"))
    from splicelake.operators.islands import label_islands

    keys = ["chrom", "strand"]
    lab = label_islands(tx, keys, slack=gap).select(
        *[F.col(k).alias(f"__{k}") for k in keys], F.col("__s").alias("__st"), F.col("__island").alias("__i")
    )
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("start") == F.col("__st")]
    x = tx.join(lab, on)
    return x.withColumn("template", F.concat_ws(":", "chrom", "strand", "__i")).drop("__st", "__i", *[f"__{k}" for k in keys])


def family_names(tx: DataFrame, templates: DataFrame, least: float = 0.3) -> DataFrame:
    """Transcripts named after the template with the best Jaccard of junction sets
    above ``least`` (ties: the smaller name): tx_id, name (``<template>-like``), jaccard.
    Both need chrom, strand, exons; ``templates`` has template."""
    from splicelake.functions.chains import junctions

    own = tx.select("tx_id", "chrom", "strand", F.explode(junctions(F.col("exons"))).alias("j")).distinct()
    ref = templates.select("template", "chrom", "strand", F.explode(junctions(F.col("exons"))).alias("j")).distinct()
    n1 = own.groupBy("tx_id").agg(F.count(F.lit(1)).alias("n1"))
    n2 = ref.groupBy("template").agg(F.count(F.lit(1)).alias("n2"))
    both = own.join(ref, ["chrom", "strand", "j"]).groupBy("tx_id", "template").agg(F.count(F.lit(1)).alias("n"))
    x = both.join(n1, "tx_id").join(n2, "template").withColumn("jaccard", F.col("n") / (F.col("n1") + F.col("n2") - F.col("n")))
    best = x.where(F.col("jaccard") > least).groupBy("tx_id").agg(F.min(F.struct((-F.col("jaccard")).alias("k"), "template")).alias("m"))
    return best.select("tx_id", F.concat("m.template", F.lit("-like")).alias("name"), (-F.col("m.k")).alias("jaccard"))
