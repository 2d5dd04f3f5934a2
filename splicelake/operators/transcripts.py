"""Transcript-level operators: collapse, filters, comparison, abundance, merge.

A transcript has tx_id, chrom, strand, exons, coverage and optionally longcov,
source and is_guide. Every order that decides anything is total: ties end at tx_id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splicelake.functions import chains
from splicelake.operators.components import connected_components
from splicelake.operators.islands import label_islands
from splicelake.operators.ranges import overlap_join
from splicelake.session import cut

PLACE = ("chrom", "strand")


def with_structure(tx: DataFrame) -> DataFrame:
    """Adds start, end, n_exons, tx_len and the intron chain."""
    b = chains.bounds(F.col("exons"))
    return (
        tx.withColumn("start", b["start"])
        .withColumn("end", b["end"])
        .withColumn("n_exons", F.size("exons"))
        .withColumn("tx_len", chains.exonic_length(F.col("exons")))
        .withColumn("chain", chains.junctions(F.col("exons")))
    )


def collapse_alignments(reads: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """A1: identical alignments (place, class columns ``extra``, exons) added up."""
    return reads.groupBy(*PLACE, *extra, "exons").agg(
        F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n_reads"), F.min("row_id").alias("row_id")
    )


def read_chains(reads: DataFrame, least: float = 1.0) -> DataFrame:
    """Transcripts from exact intron chains of multi-exon reads: added weight
    of at least ``least``, outermost start and end."""
    x = with_structure(reads).where("n_exons > 1")
    g = x.groupBy(*PLACE, "chain").agg(
        F.min("row_id").alias("tx_id"), F.sum("weight").alias("coverage"), F.min("start").alias("start"), F.max("end").alias("end")
    )
    return g.where(F.col("coverage") >= least)


def raw_transcripts(reads: DataFrame, min_length: int = 200) -> DataFrame:
    """Each distinct structure of sufficient length as a transcript."""
    return (
        collapse_alignments(reads)
        .select(*PLACE, "exons", F.col("weight").alias("coverage"), F.col("row_id").alias("tx_id"))
        .where(chains.exonic_length(F.col("exons")) >= min_length)
    )


def exact_dedup(tx: DataFrame) -> DataFrame:
    """One row per (place, exons): the smallest tx_id."""
    best = tx.groupBy(*PLACE, "exons").agg(F.min("tx_id").alias("tx_id"))
    return tx.join(best.select("tx_id"), "tx_id", "left_semi")


def chain_dedup(tx: DataFrame, prefer: Column | None = None) -> DataFrame:
    """Per (place, chain) the best by ``prefer``, coverage, then smallest tx_id; single exons stay."""
    x = with_structure(tx)
    order = F.struct(
        (F.lit(0) if prefer is None else prefer).alias("p"), F.col("coverage").alias("c"), (-F.col("tx_id")).alias("i")
    )
    multi = x.where("n_exons > 1").groupBy(*PLACE, "chain").agg((-F.max(order)["i"]).alias("tx_id")).select("tx_id")
    keep = multi.unionByName(x.where("n_exons = 1").select("tx_id"))
    return tx.join(keep, "tx_id", "left_semi")


def near_chain_pairs(tx: DataFrame, tolerance: int, bin_size: int = 1 << 14) -> DataFrame:
    """Pairs of multi-exon transcripts of one place whose chains agree within the tolerance (a before b)."""
    x = with_structure(tx).where("n_exons > 1").withColumn("__d", F.get("chain", F.lit(0))["donor"])
    w = tolerance + 1
    left = x.select("tx_id", *PLACE, "chain", "n_exons", "start", "end", "coverage", F.floor(F.col("__d") / w).alias("__b"))
    right = x.withColumn("__b", F.explode(F.array(*[F.floor(F.col("__d") / w) + d for d in (-1, 0, 1)])))
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in ("tx_id", *PLACE, "chain", "n_exons", "start", "end", "coverage", "__b")])
    on = [F.col(c) == F.col(f"r_{c}") for c in (*PLACE, "n_exons", "__b")] + [F.col("tx_id") < F.col("r_tx_id")]
    return left.join(right, on).where(chains.near_equal(F.col("chain"), F.col("r_chain"), tolerance)).drop("__b", "r___b")


def near_equal_collapse(tx: DataFrame, tolerance: int = 0, terminal: int = 0, ratio: float = 0.3) -> DataFrame:
    """Of two transcripts with one chain (within ``tolerance``) and close ends the weaker
    is dropped if its coverage is at most ``ratio`` of the other's. Nothing changes at terminal 0."""
    if terminal == 0:
        return tx
    p = near_chain_pairs(tx, tolerance)
    close = (F.abs(F.col("start") - F.col("r_start")) <= terminal) & (F.abs(F.col("end") - F.col("r_end")) <= terminal)
    a_weak = F.col("coverage") <= F.col("r_coverage") * F.lit(ratio)
    b_weak = F.col("r_coverage") <= F.col("coverage") * F.lit(ratio)
    lost = p.where(close & (a_weak | b_weak)).select(F.when(b_weak, F.col("r_tx_id")).otherwise(F.col("tx_id")).alias("tx_id"))
    return tx.join(lost.distinct(), "tx_id", "left_anti")


def _overlapping(x: DataFrame, keys: Sequence[str], slim: Sequence[str] | None = None, bin_size: int = 1 << 15) -> DataFrame:
    cols = list(dict.fromkeys([*(slim or x.columns), "tx_id", *keys, "start", "end"]))
    s = x.select(*cols)
    return overlap_join(s, s, keys, bin_size=bin_size).where("tx_id <> r_tx_id")


def larger_chains(small: DataFrame, large: DataFrame) -> DataFrame:
    """Pairs (tx_id, r_tx_id) of which the first's chain is an ordered proper part of the second's, of one place.

    A part shares all its introns with the whole, so only chains that hold the part's rarest intron
    are compared. Both: tx_id, place, chain, n_exons."""
    s = small.select("tx_id", *PLACE, "chain", "n_exons")
    r = cut(large.select(F.col("tx_id").alias("r_tx_id"), *PLACE, F.col("chain").alias("r_chain"), F.col("n_exons").alias("r_n_exons")))
    holds = r.select("r_tx_id", *PLACE, F.explode("r_chain").alias("j"))
    df = holds.groupBy(*PLACE, "j").agg(F.count(F.lit(1)).alias("df"))
    own = s.select("tx_id", *PLACE, F.explode("chain").alias("j")).join(df, [*PLACE, "j"])
    rare = own.groupBy("tx_id").agg(F.min_by("j", F.struct("df", "j")).alias("j"))
    # ids come from both sides by equal joins; the arrays join last, for candidates only
    pairs = s.select("tx_id", *PLACE, "n_exons").join(rare, "tx_id").join(holds, [*PLACE, "j"]).select("tx_id", "n_exons", "r_tx_id")
    pairs = pairs.join(r.select("r_tx_id", "r_chain", "r_n_exons"), "r_tx_id").where("n_exons < r_n_exons")
    both = pairs.join(s.select("tx_id", "chain"), "tx_id")
    return both.where(chains.is_proper_subchain(F.col("chain"), F.col("r_chain"))).select("tx_id", "r_tx_id")


def subset_chains(tx: DataFrame) -> DataFrame:
    """tx_ids whose chain is an ordered proper part of another chain of the place,
    with the number of such others."""
    x = cut(with_structure(tx).where("n_exons > 1").select("tx_id", *PLACE, "chain", "n_exons"))
    return larger_chains(x, x).groupBy("tx_id").agg(F.countDistinct("r_tx_id").alias("n_larger"))


def containment_filter(tx: DataFrame) -> DataFrame:
    """Transcripts whose exons all lie inside exons of another of the place with at
    least their coverage (ties: the smaller tx_id wins) are dropped."""
    x = with_structure(tx)
    p = _overlapping(x, PLACE, ["exons", "coverage"])
    wins = (F.col("r_coverage") > F.col("coverage")) | ((F.col("r_coverage") == F.col("coverage")) & (F.col("r_tx_id") < F.col("tx_id")))
    inside = (F.col("start") >= F.col("r_start")) & (F.col("end") <= F.col("r_end"))
    lost = p.where(wins & inside & chains.contained(F.col("exons"), F.col("r_exons"))).select("tx_id").distinct()
    return tx.join(lost, "tx_id", "left_anti")


def contained_merge(tx: DataFrame) -> DataFrame:
    """Single exons inside single exons, and chains that are parts of others with the
    span inside, are absorbed (ties of equal spans: the smaller tx_id stays)."""
    x = with_structure(tx)
    x = cut(x.select("tx_id", *PLACE, "start", "end", "chain", "n_exons"))
    span = x.select(F.col("tx_id").alias("r_tx_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    inside = (F.col("start") >= F.col("r_start")) & (F.col("end") <= F.col("r_end"))
    multi = x.where("n_exons > 1")
    parts = larger_chains(multi, multi).join(multi.select("tx_id", "start", "end"), "tx_id").join(span, "r_tx_id").where(inside).select("tx_id")
    same = (F.col("start") == F.col("r_start")) & (F.col("end") == F.col("r_end"))
    lone = _overlapping(x.where("n_exons = 1"), PLACE).where(inside & (~same | (F.col("r_tx_id") < F.col("tx_id")))).select("tx_id")
    return tx.join(parts.unionByName(lone).distinct(), "tx_id", "left_anti")


def length_filters(tx: DataFrame, min_exon: int = 1, min_length: int = 200, terminal: int = 0) -> DataFrame:
    """Minimum exon, transcript and terminal exon lengths."""
    e = F.col("exons")
    size = lambda x: x["end"] - x["start"]
    ok = F.forall(e, lambda x: size(x) >= min_exon) & (chains.exonic_length(e) >= min_length)
    if terminal:
        ok = ok & ((F.size(e) == 1) | ((size(F.get(e, F.lit(0))) >= terminal) & (size(F.try_element_at(e, F.lit(-1))) >= terminal)))
    return tx.where(ok)


def coverage_gate(tx: DataFrame, multi: float = 1.0, single: float = 4.75) -> DataFrame:
    """readthr / singlethr: guides pass, others need the coverage of their kind."""
    guide = F.col("is_guide") if "is_guide" in tx.columns else F.lit(False)
    need = F.when(F.size("exons") > 1, F.lit(multi)).otherwise(F.lit(single))
    return tx.where(guide | (F.col("coverage") >= need))


def supported_introns(tx: DataFrame, stats: DataFrame, least: float = 1.0) -> DataFrame:
    """Transcripts all of whose introns are in ``stats`` with ``nreads_good`` of at least ``least``."""
    rows = tx.select("tx_id", *PLACE, F.explode(chains.junctions(F.col("exons"))).alias("j"))
    rows = rows.select("tx_id", *PLACE, F.col("j.donor").alias("donor"), F.col("j.acceptor").alias("acceptor"))
    good = stats.where(F.col("nreads_good") >= least).select(*PLACE, "donor", "acceptor").distinct()
    lost = rows.join(good, [*PLACE, "donor", "acceptor"], "left_anti").select("tx_id").distinct()
    return tx.join(lost, "tx_id", "left_anti")


def loci(tx: DataFrame) -> DataFrame:
    """Spans of one place that overlap or touch: adds locus (the start of the chain of spans)."""
    x = cut(with_structure(tx))
    lab = label_islands(x, PLACE).select(
        *[F.col(k).alias(f"__{k}") for k in PLACE], F.col("__s").alias("__st"), F.col("__island").alias("locus")
    )
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in PLACE] + [F.col("start") == F.col("__st")]
    return x.join(lab, on).drop("__st", *[f"__{k}" for k in PLACE])


def isofrac_locus(tx: DataFrame, share: float = 0.01) -> DataFrame:
    """Transcripts below ``share`` of the strongest of their kind at their locus are
    dropped. The share is scaled by .05 above coverage 100 and by .5 above 50; multi-exon
    transcripts without a multi-exon rival fall only when also below 5."""
    x = loci(tx)
    multi = F.col("n_exons") > 1
    m = x.groupBy(*PLACE, "locus").agg(F.max("coverage").alias("__max"), F.max(F.when(multi, F.col("coverage"))).alias("__mm"))
    y = x.join(m, [*PLACE, "locus"])
    c = F.col("coverage")
    f = F.lit(share) * F.when(c > 100, 0.05).when(c > 50, 0.5).otherwise(1.0)
    keep = F.when(~multi, c >= f * F.col("__max")).otherwise(c >= f * F.col("__mm"))
    return y.where(keep).select(*tx.columns)


def underrepresented(tx: DataFrame, share: float = 0.01) -> DataFrame:
    """Multi-exon transcripts whose longcov is below ``share`` of the sum over other overlapping ones."""
    x = with_structure(tx).where("n_exons > 1")
    p = _overlapping(x, ["chrom"], ["longcov"])
    s = p.groupBy("tx_id").agg(F.sum("r_longcov").alias("others"))
    weak = x.join(s, "tx_id").where(F.col("longcov") < F.col("others") * F.lit(share))
    return weak.select("tx_id")


def opposite_dominated(tx: DataFrame, ratio: float = 10.0) -> DataFrame:
    """tx_ids with an overlapping opposite-strand transcript of ``ratio`` times their coverage."""
    x = with_structure(tx)
    p = _overlapping(x, ["chrom"], ["strand", "coverage", "n_exons"])
    opp = (F.col("strand") * F.col("r_strand")) < 0
    return p.where(opp & (F.col("r_coverage") >= F.col("coverage") * F.lit(ratio))).select("tx_id").distinct()


def intronic(tx: DataFrame) -> DataFrame:
    """tx_ids that lie inside an intron of a transcript of the same place with more exons."""
    x = with_structure(tx)
    big = x.where("n_exons > 1").select(
        F.col("tx_id").alias("owner"), *PLACE, F.col("n_exons").alias("owner_exons"), F.explode("chain").alias("j")
    )
    big = big.select("owner", *PLACE, "owner_exons", F.col("j.donor").alias("start"), F.col("j.acceptor").alias("end"))
    p = overlap_join(x.select("tx_id", *PLACE, "n_exons", "start", "end"), big, PLACE)
    inside = (F.col("start") >= F.col("r_start")) & (F.col("end") <= F.col("r_end"))
    return p.where(inside & (F.col("r_owner_exons") > F.col("n_exons"))).select("tx_id").distinct()


def retained_introns(tx: DataFrame, share: float = 0.1) -> DataFrame:
    """tx_ids with an exon that spans an intron of a transcript of the place whose
    coverage exceeds theirs by 1/``share``."""
    x = with_structure(tx)
    ex = x.select("tx_id", *PLACE, "coverage", F.explode("exons").alias("e"))
    ex = ex.select("tx_id", *PLACE, "coverage", F.col("e.start").alias("start"), F.col("e.end").alias("end"))
    it = x.where("n_exons > 1").select(F.col("tx_id").alias("owner"), *PLACE, F.col("coverage").alias("cov"), F.explode("chain").alias("j"))
    it = it.groupBy(*PLACE, F.col("j.donor").alias("start"), F.col("j.acceptor").alias("end")).agg(F.max("cov").alias("cov"))
    p = overlap_join(ex, it, PLACE)
    spans = (F.col("start") < F.col("r_start")) & (F.col("end") > F.col("r_end"))
    return p.where(spans & (F.col("coverage") < F.col("r_cov") * F.lit(share))).select("tx_id").distinct()


def unwitnessed(tx: DataFrame, reads: DataFrame) -> DataFrame:
    """tx_ids with a pair of consecutive introns that no read shows together."""
    from splicelake.operators.junctions import intron_pairs

    seen = intron_pairs(reads).select(*PLACE, "d1", "a1", "d2", "a2")
    j = chains.junctions(F.col("exons"))
    n = F.greatest(F.size("exons") - 2, F.lit(0))
    pairs = F.zip_with(F.slice(j, 1, n), F.slice(j, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    p = tx.select("tx_id", *PLACE, F.explode(pairs).alias("p")).select(
        "tx_id", *PLACE, F.col("p.a.donor").alias("d1"), F.col("p.a.acceptor").alias("a1"),
        F.col("p.b.donor").alias("d2"), F.col("p.b.acceptor").alias("a2"),
    )
    return p.join(seen, [*PLACE, "d1", "a1", "d2", "a2"], "left_anti").select("tx_id").distinct()


# comparison with a reference ------------------------------------------------


def exact_reference(tx: DataFrame, ref: DataFrame) -> DataFrame:
    """(tx_id, ref_id) with equal place and intron chain; single exons by equal span."""
    a, b = with_structure(tx), with_structure(ref).withColumnRenamed("tx_id", "ref_id")
    key = F.when(F.col("n_exons") > 1, F.col("chain").cast("string")).otherwise(F.concat_ws("-", "start", "end"))
    a = a.select("tx_id", *PLACE, key.alias("k"))
    b = b.select("ref_id", *PLACE, key.alias("k"))
    return a.join(b, [*PLACE, "k"]).select("tx_id", "ref_id")


def set_comparison(found: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Found, missing and extra keys with sensitivity and the share of found among reported."""
    a = found.select(*keys).distinct().withColumn("__a", F.lit(1))
    b = truth.select(*keys).distinct().withColumn("__b", F.lit(1))
    j = a.join(b, list(keys), "full")
    c = lambda x: F.count(F.when(x, 1))
    hit = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    out = j.agg(c(hit).alias("found"), c(F.col("__a").isNull()).alias("missing"), c(F.col("__b").isNull()).alias("extra"))
    ratio = lambda x: F.when(F.col("found") + x > 0, F.col("found") / (F.col("found") + x)).otherwise(F.lit(0.0))
    return out.withColumn("sensitivity", ratio(F.col("missing"))).withColumn("precision", ratio(F.col("extra")))


def reference_subset(tx: DataFrame, ref: DataFrame) -> DataFrame:
    """tx_ids whose introns are all known, that match no reference chain exactly and
    are an ordered proper part of one."""
    sub, r = (with_structure(x).where("n_exons > 1") for x in (tx, ref))
    part = larger_chains(cut(sub.select("tx_id", *PLACE, "chain", "n_exons")), r).select("tx_id").distinct()
    return part.join(exact_reference(tx, ref).select("tx_id").distinct(), "tx_id", "left_anti")


def zero_novel_not_exact(tx: DataFrame, ref: DataFrame) -> DataFrame:
    """Multi-exon tx_ids without novel intron whose chain is no reference chain."""
    known = with_structure(ref).select(*PLACE, F.explode("chain").alias("j")).distinct()
    rows = with_structure(tx).where("n_exons > 1").select("tx_id", *PLACE, F.explode("chain").alias("j"))
    novel = rows.join(known, [*PLACE, "j"], "left_anti").select("tx_id").distinct()
    ids = rows.select("tx_id").distinct().join(novel, "tx_id", "left_anti")
    return ids.join(exact_reference(tx, ref).select("tx_id").distinct(), "tx_id", "left_anti")


def recover_guides(tx: DataFrame, guides: DataFrame) -> DataFrame:
    """Transcripts with the guides appended whose structure is missing."""
    cols = ["tx_id", *PLACE, "exons", "coverage"]
    new = guides.join(tx.select(*PLACE, "exons"), [*PLACE, "exons"], "left_anti")
    return tx.select(*cols).unionByName(new.select(*cols))


def best_class(tracking: DataFrame, ref: str = "ref_id", code: str = "class_code") -> DataFrame:
    """Best comparison class per reference by the fixed rank = j c m x i y p n s u."""
    rank = F.instr(F.lit("=jcmxiypnsu"), F.col(code))
    r = tracking.where(F.col(ref).isNotNull()).withColumn("__r", F.when(rank > 0, rank).otherwise(99))
    return r.groupBy(ref).agg(F.min(F.struct("__r", code)).alias("m")).select(ref, F.col(f"m.{code}").alias(code))


def loss_report(best: DataFrame, refs: DataFrame, ref: str = "ref_id", code: str = "class_code") -> DataFrame:
    """References matched (= or j), partial by class, or missed, counted."""
    x = refs.select(ref).distinct().join(best, ref, "left")
    fate = F.when(F.col(code).isNull(), "missed").when(F.col(code).isin("=", "j"), "matched").otherwise(F.concat(F.lit("partial_"), F.col(code)))
    return x.groupBy(fate.alias("fate")).agg(F.count(F.lit(1)).alias("n"))


# abundance -----------------------------------------------------------------


def abundance(tx: DataFrame, fragment_bases: float | None = None) -> DataFrame:
    """TPM = coverage * 1e6 / sum of coverage; FPKM = coverage * 1e9 / fragment bases (0 without)."""
    # the total is a scalar subquery of the same plan
    total = tx.agg(F.sum("coverage").cast("double").alias("t")).select(F.when(F.col("t") > 1e-9, F.col("t")).otherwise(1.0)).scalar()
    fpkm = F.col("coverage") * F.lit(1e9 / fragment_bases) if fragment_bases else F.lit(0.0)
    return tx.withColumn("tpm", F.col("coverage") * F.lit(1e6) / total).withColumn("fpkm", fpkm)


def gene_ids(tx: DataFrame) -> DataFrame:
    """Genes are transcripts of one place connected by overlapping exons.

    Exons are merged into islands; a transcript links its islands, so the genes are
    the components of that bipartite graph. Adds gene_start (smallest start of the
    gene) and gene_id (smallest tx_id)."""
    ex = tx.select("tx_id", *PLACE, F.explode("exons").alias("e")).select(
        "tx_id", *PLACE, F.col("e.start").alias("start"), F.col("e.end").alias("end")
    )
    lab = label_islands(ex, PLACE, slack=-1).select(
        *[F.col(k).alias(f"__{k}") for k in PLACE], F.col("__s").alias("__st"), "__island"
    )
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in PLACE] + [F.col("start") == F.col("__st")]
    x = cut(ex.join(lab, on).select("tx_id", *PLACE, "__island").distinct())
    # an island is stood for by its first transcript, so all vertices are transcripts
    first = x.groupBy(*PLACE, "__island").agg(F.min("tx_id").alias("__first"))
    links = x.join(first, [*PLACE, "__island"]).select(F.col("tx_id").alias("src"), F.col("__first").alias("dst"))
    comp = connected_components(links, vertices=x.select(F.col("tx_id").alias("node")))
    return tx.join(comp.select(F.col("node").alias("tx_id"), F.col("component").alias("gene_id")), "tx_id")


def gene_abundance(tx: DataFrame) -> DataFrame:
    """Gene roll-up: bounds, number of transcripts, sums of coverage, TPM and FPKM."""
    x = with_structure(tx)
    return x.groupBy("gene_id", *PLACE).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_tx"),
        F.sum("coverage").alias("coverage"), F.sum("tpm").alias("tpm"), F.sum("fpkm").alias("fpkm"),
    )


def structural_merge(inputs: Sequence[DataFrame], min_length: int = 200, tolerance: int = 250) -> DataFrame:
    """M1: inputs united with coverage 1, deduplicated exactly and by chain, chains within the
    tolerance collapsed to the longest (ties: widest, smallest tx_id), contained ones
    absorbed, short ones dropped."""
    u = inputs[0]
    for x in inputs[1:]:
        u = u.unionByName(x)
    u = u.withColumn("coverage", F.lit(1.0))
    u = cut(chain_dedup(cut(exact_dedup(u))))
    p = near_chain_pairs(u, tolerance)
    span = lambda a: F.col(f"{a}end") - F.col(f"{a}start")
    lost = p.select(F.when(span("") >= span("r_"), F.col("r_tx_id")).otherwise(F.col("tx_id")).alias("tx_id")).distinct()
    return length_filters(contained_merge(cut(u.join(lost, "tx_id", "left_anti"))), min_length=min_length)


def rank_in_locus(tx: DataFrame, n: int) -> DataFrame:
    """The ``n`` strongest transcripts of each locus (a top-n report)."""
    w = Window.partitionBy(*PLACE, "locus").orderBy(F.desc("coverage"), "tx_id")
    return loci(tx).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def window_witness(tx: DataFrame, reads: DataFrame, k: int = 4) -> DataFrame:
    """tx_ids with a run of ``k`` consecutive introns that no read shows together.

    Transcripts with fewer introns are judged by their whole chain. Distinct windows are
    compared as values, so the join is an equi-join whatever the number of reads."""
    j = chains.junctions(F.col("exons"))

    def windows(df: DataFrame, n: Column) -> Column:
        count = F.size("exons") - n
        at = F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.slice(j, i, n))

    own = F.least(F.size("exons") - 1, F.lit(k))
    t = tx.where(F.size("exons") > 1).select("tx_id", *PLACE, F.explode(windows(tx, own)).alias("w"))
    sizes = [reads.where(F.size("exons") > n).select(*PLACE, F.explode(windows(reads, F.lit(n))).alias("w")) for n in range(1, k + 1)]
    seen = sizes[0]
    for s in sizes[1:]:
        seen = seen.unionByName(s)
    return t.join(seen.distinct(), [*PLACE, "w"], "left_anti").select("tx_id").distinct()


def near_duplicates(tx: DataFrame, most: int = 2) -> DataFrame:
    """tx_ids that differ from a stronger transcript of the place (ties: smaller tx_id) in at
    most ``most`` introns, each sharing a donor or acceptor with the other's intron there."""
    x = with_structure(tx).where("n_exons > 1")
    p = _overlapping(x, PLACE, ["chain", "n_exons", "coverage"]).where("n_exons = r_n_exons")
    stronger = (F.col("r_coverage") > F.col("coverage")) | ((F.col("r_coverage") == F.col("coverage")) & (F.col("r_tx_id") < F.col("tx_id")))
    both = F.zip_with("chain", "r_chain", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    other = F.filter(both, lambda x: x["a"] != x["b"])
    share = F.forall(other, lambda x: (x["a"]["donor"] == x["b"]["donor"]) | (x["a"]["acceptor"] == x["b"]["acceptor"]))
    return p.where(stronger & (F.size(other) > 0) & (F.size(other) <= most) & share).select("tx_id").distinct()


def split_strand_conflicts(tx: DataFrame, most: int = 50) -> DataFrame:
    """Ends of single-exon transcripts that overlap the start of one of the opposite strand
    by at most ``most`` bases are moved to the middle of the overlap. Each transcript keeps the
    innermost of its bounds; one that would become empty stays as it is."""
    x = with_structure(tx).where("n_exons = 1")
    p = _overlapping(x, ["chrom"], ["strand"]).where(F.col("strand") * F.col("r_strand") < 0)
    p = p.where((F.col("start") < F.col("r_start")) & (F.col("end") < F.col("r_end")) & (F.col("end") - F.col("r_start") <= most))
    mid = F.floor((F.col("end") + F.col("r_start")) / 2)
    ends = p.groupBy("tx_id").agg(F.min(mid).alias("__end"))
    starts = p.groupBy(F.col("r_tx_id").alias("tx_id")).agg(F.max(mid).alias("__start"))
    y = tx.join(ends, "tx_id", "left").join(starts, "tx_id", "left")
    e = F.get("exons", F.lit(0))
    s2, e2 = F.coalesce("__start", e["start"]), F.coalesce("__end", e["end"])
    moved = F.array(F.struct(s2.alias("start"), e2.alias("end")))
    touched = F.col("__end").isNotNull() | F.col("__start").isNotNull()
    return y.withColumn("exons", F.when(touched & (s2 < e2), moved).otherwise(F.col("exons"))).select(*tx.columns)


def rank_penalised(tx: DataFrame) -> DataFrame:
    """Retained-intron score per transcript: 3 for a leading, 2 for a middle and 1 for a
    terminal exon that spans an intron of a stronger transcript of the place, added up."""
    x = with_structure(tx)
    ex = x.select("tx_id", *PLACE, "coverage", "n_exons", F.posexplode("exons").alias("i", "e"))
    ex = ex.select("tx_id", *PLACE, "coverage", "n_exons", "i", F.col("e.start").alias("start"), F.col("e.end").alias("end"))
    it = x.where("n_exons > 1").select(*PLACE, F.col("coverage").alias("cov"), F.explode("chain").alias("j"))
    it = it.groupBy(*PLACE, F.col("j.donor").alias("start"), F.col("j.acceptor").alias("end")).agg(F.max("cov").alias("cov"))
    p = overlap_join(ex, it, PLACE).where((F.col("start") < F.col("r_start")) & (F.col("end") > F.col("r_end")) & (F.col("r_cov") > F.col("coverage")))
    hit = p.select("tx_id", "i", "n_exons").distinct()
    points = F.when(F.col("i") == 0, 3).when(F.col("i") == F.col("n_exons") - 1, 1).otherwise(2)
    return hit.groupBy("tx_id").agg(F.sum(points).alias("ri_score"))


def chimeras(tx: DataFrame, ref: DataFrame) -> DataFrame:
    """tx_ids without novel intron that fall into two parts: at some point the references
    that hold an intron before it and those that hold one after it have none in common.

    A reference bridges the points between its first and last intron in the transcript; only
    these two are kept of it, and only distinct pairs of them meet: no more than a
    transcript's introns squared, however many references hold them."""
    r = with_structure(ref).select(F.col("tx_id").alias("ref_id"), *PLACE, F.explode("chain").alias("j"))
    x = with_structure(tx).where("n_exons > 2").select("tx_id", *PLACE, "n_exons", F.posexplode("chain").alias("i", "j"))
    known = x.join(r.select(*PLACE, "j").distinct(), [*PLACE, "j"], "left_semi").groupBy("tx_id", "n_exons").agg(F.count(F.lit(1)).alias("n"))
    known = known.where("n = n_exons - 1").select("tx_id")
    spans = x.join(known, "tx_id", "left_semi").join(r, [*PLACE, "j"]).groupBy("tx_id", "n_exons", "ref_id").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    g = spans.where("lo < hi").groupBy("tx_id").agg(F.collect_set(F.struct("lo", "hi")).alias("b"))
    all_ = spans.select("tx_id", "n_exons").distinct().join(g, "tx_id", "left")
    points = F.sequence(F.lit(0), F.col("n_exons") - 3)
    apart = F.exists(points, lambda k: ~F.exists(F.coalesce("b", F.array()), lambda y: (y["lo"] <= k) & (y["hi"] > k)))
    return all_.where(apart).select("tx_id")
