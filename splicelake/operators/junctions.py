"""Junction statistics, their gates, and joins of reads with junctions.

Letters and numbers in docstrings (A2, Q1, ...) name rows of the operator
inventory. A junction is killed by strand 0; a null strand is unknown.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splicelake.functions import chains
from splicelake.operators.folding import fold_groups, key_schema
from splicelake.operators.islands import label_islands
from splicelake.operators.ranges import nearest_join, overlap_semi, tolerance_join
from splicelake.session import cut

JKEY = ("chrom", "strand", "donor", "acceptor")
LONG_INTRON, NEAR = 100_000, 25


def junction_rows(reads: DataFrame, min_intron: int = 20, support: int = 10, long_support: int = 25) -> DataFrame:
    """One row per read and junction with its anchors: the running maximum exon
    length from either end of the read."""
    lens = F.transform("exons", lambda x: x["end"] - x["start"])
    x = reads.withColumn("__len", lens).select("*", F.posexplode(chains.junctions(F.col("exons"))).alias("__i", "__j"))
    n = F.size("__len")
    x = x.select(
        *[c for c in reads.columns if c != "exons"],
        F.col("__j.donor").alias("donor"),
        F.col("__j.acceptor").alias("acceptor"),
        F.array_max(F.slice("__len", F.lit(1), F.col("__i") + 1)).alias("left_anchor"),
        F.array_max(F.slice("__len", F.col("__i") + 2, n)).alias("right_anchor"),
    ).where(F.col("acceptor") - F.col("donor") >= min_intron)
    need = F.when(F.col("acceptor") - F.col("donor") > LONG_INTRON, long_support).otherwise(support)
    return x.withColumn("left_ok", F.col("left_anchor") >= need).withColumn("right_ok", F.col("right_anchor") >= need)


def junction_stats(reads: DataFrame, primary_only: bool = False, **kw) -> DataFrame:
    """A2, A3: sums of weight per junction: mrcount, left and right support, good reads,
    mismatch weight (nm; column ``mismatch`` of the reads if there) and reads whose
    anchors both exceed 25 among them (mm)."""
    if primary_only:
        reads = reads.where("is_primary")
    if "mismatch" not in reads.columns:
        reads = reads.withColumn("mismatch", F.lit(0).cast("long"))
    w = F.col("weight")
    zero = F.lit(0).cast("long")
    pick = lambda c: F.sum(F.when(c, w).otherwise(zero))
    both = F.col("left_ok") & F.col("right_ok")
    wide = (F.col("left_anchor") > 25) & (F.col("right_anchor") > 25)
    return junction_rows(reads, **kw).groupBy(*JKEY).agg(
        F.sum("weight").alias("mrcount"),
        pick(both).alias("nreads_good"),
        pick(F.col("left_ok")).alias("leftsupport"),
        pick(F.col("right_ok")).alias("rightsupport"),
        F.sum("mismatch").alias("nm"),
        F.sum(F.when(wide, F.col("mismatch")).otherwise(zero)).alias("mm"),
    )


def site_support(stats: DataFrame, keys: Sequence[str] = ("chrom", "strand"), last_group_kept: bool = True) -> DataFrame:
    """Left support summed over equal donors and right support over equal acceptors.

    With ``last_group_kept`` the last donor (acceptor) of a chromosome, in
    coordinate order, keeps its own values, which the inventory calls for."""
    keys = list(keys)
    d = stats.groupBy(*keys, "donor").agg(F.sum("leftsupport").alias("__ls"))
    a = stats.groupBy(*keys, "acceptor").agg(F.sum("rightsupport").alias("__rs"))
    out = stats.join(d, [*keys, "donor"]).join(a, [*keys, "acceptor"])
    left, right = F.col("__ls"), F.col("__rs")
    if last_group_kept:
        ends = stats.groupBy(*keys).agg(F.max("donor").alias("__ld"), F.max("acceptor").alias("__la"))
        out = out.join(ends, keys)
        left = F.when(F.col("donor") == F.col("__ld"), F.col("leftsupport")).otherwise(left)
        right = F.when(F.col("acceptor") == F.col("__la"), F.col("rightsupport")).otherwise(right)
    return out.withColumn("leftsupport", left).withColumn("rightsupport", right).select(*stats.columns)


def kill(df: DataFrame, when: Column) -> DataFrame:
    """Set strand 0 where ``when`` holds."""
    return df.withColumn("strand", F.when(when, F.lit(0)).otherwise(F.col("strand")))


def good_junction_gate(stats: DataFrame, threshold: float = 1.0, error: float = 0.1) -> DataFrame:
    """Q1, Q2: verdict per junction, rules in order: guide, few_good, all_bad_low,
    long_all_bad, low_share, good. ``guide_match`` is optional."""
    guide = F.col("guide_match") if "guide_match" in stats.columns else F.lit(False)
    all_bad = (F.col("mrcount") > 0) & (F.col("nm") >= F.col("mrcount"))
    long = F.col("acceptor") - F.col("donor") > LONG_INTRON
    site = F.greatest("leftsupport", "rightsupport")
    verdict = (
        F.when(guide, "guide")
        .when(F.col("nreads_good") < threshold, "few_good")
        .when(all_bad & (F.col("nreads_good") < 1.25 * threshold), "all_bad_low")
        .when(all_bad & long & (F.col("mrcount") < 10), "long_all_bad")
        .when(F.col("mrcount") * 10 < error * site, "low_share")
        .otherwise("good")
    )
    return stats.withColumn("verdict", verdict)


def splice_consensus(df: DataFrame, first: str = "donor_bases", last: str = "acceptor_bases") -> DataFrame:
    """GT/GC..AG on +, CT..AC/GC on -, either where the strand is unknown: adds ``consensus``."""
    plus = F.col(first).isin("GT", "GC") & (F.col(last) == "AG")
    minus = (F.col(first) == "CT") & F.col(last).isin("AC", "GC")
    s = F.col("strand")
    return df.withColumn("consensus", F.when(s == 1, plus).when(s == -1, minus).otherwise(plus | minus))


def killed(stats: DataFrame) -> DataFrame:
    """Q6: junctions that are killed: strand 0 or a negative counter."""
    return stats.where("strand = 0 OR mm < 0 OR mrcount < 0 OR nreads_good < 0").select(*JKEY)


def weak_filter(stats: DataFrame, least: float = 1.0) -> DataFrame:
    """Q8, Q9: live junctions with at least ``least`` good reads."""
    return stats.where((F.col("strand") != 0) & (F.col("nreads_good") >= least) & (F.col("mrcount") > 0))


def site_isofrac(stats: DataFrame, percent: float = 1.0, by_acceptor: bool = False, floor: float | None = None) -> DataFrame:
    """Share of a junction among those of its donor (acceptor); kept if it reaches
    ``percent`` or, if given, the absolute ``floor``. Adds site_total and keep."""
    site = "acceptor" if by_acceptor else "donor"
    tot = stats.groupBy("chrom", "strand", site).agg(F.sum("mrcount").alias("site_total"))
    keep = F.col("mrcount") * 100 >= F.col("site_total") * F.lit(percent)
    if floor is not None:
        keep = keep | (F.col("mrcount") >= floor)
    return stats.join(tot, ["chrom", "strand", site]).withColumn("keep", keep)


def nearby_weak(stats: DataFrame, window: int = NEAR, share: float = 0.1) -> DataFrame:
    """Junctions below ``share`` of the strongest other junction within ``window`` at both ends: adds drop."""
    slim = stats.select(*JKEY, "mrcount")
    near = tolerance_join(slim, slim, ["chrom", "strand"], ["donor", "acceptor"], window)
    near = near.where("donor <> r_donor OR acceptor <> r_acceptor").groupBy(*JKEY).agg(F.max("r_mrcount").alias("best_near"))
    out = stats.join(near, list(JKEY), "left").fillna(0, ["best_near"])
    return out.withColumn("drop", F.col("mrcount") < F.col("best_near") * F.lit(share))


def shared_site_weak(stats: DataFrame, most: float = 2, share: float = 0.1) -> DataFrame:
    """At most ``most`` reads and below ``share`` of the strongest junction with the same donor, then acceptor."""
    d = stats.groupBy("chrom", "strand", "donor").agg(F.max("mrcount").alias("__d"))
    a = stats.groupBy("chrom", "strand", "acceptor").agg(F.max("mrcount").alias("__a"))
    x = stats.join(d, ["chrom", "strand", "donor"]).join(a, ["chrom", "strand", "acceptor"])
    weak = (F.col("mrcount") <= most) & (
        (F.col("mrcount") < F.col("__d") * F.lit(share)) | (F.col("mrcount") < F.col("__a") * F.lit(share))
    )
    return x.withColumn("drop", weak).drop("__d", "__a")


def found_fraction(reads: DataFrame, stats: DataFrame, ident: str = "row_id", tolerance: int = 10) -> DataFrame:
    """Fraction of a read's junctions found in ``stats`` within the tolerance at both ends; 1 without junctions."""
    rows = reads.select(ident, "chrom", F.posexplode(chains.junctions(F.col("exons"))).alias("i", "j"))
    rows = rows.select(ident, "chrom", "i", F.col("j.donor").alias("donor"), F.col("j.acceptor").alias("acceptor"))
    target = stats.select("chrom", "donor", "acceptor").distinct()
    hit = tolerance_join(rows, target, ["chrom"], ["donor", "acceptor"], tolerance).select(ident, "i").distinct()
    got = hit.groupBy(ident).agg(F.count(F.lit(1)).alias("n_found"))
    n = F.greatest(F.size("exons") - 1, F.lit(0))
    return reads.join(got, ident, "left").select(
        ident,
        F.coalesce("n_found", F.lit(0)).alias("n_found"),
        F.when(n > 0, F.coalesce("n_found", F.lit(0)) / n).otherwise(F.lit(1.0)).alias("found"),
    )


def snap_to_guides(stats: DataFrame, guides: DataFrame, tolerance: int = 25) -> DataFrame:
    """Donors and acceptors snapped to the closest guide site within the tolerance."""
    by = ["chrom", "strand"]
    x = nearest_join(stats, guides, by, "donor", tolerance, JKEY)
    return nearest_join(x, guides, by, "acceptor", tolerance, JKEY)


def redirect_to_stronger(stats: DataFrame, window: int = NEAR, share: float = 0.9) -> DataFrame:
    """Junctions without good reads pointed to the strongest reliable neighbour
    within ``window`` at both ends (more reads than ``share`` of their own)."""
    reliable = stats.where("nreads_good > 0").select(*JKEY, "mrcount")
    bad = stats.where("nreads_good = 0").select(*JKEY, "mrcount")
    near = tolerance_join(bad, reliable, ["chrom", "strand"], ["donor", "acceptor"], window)
    near = near.where(F.col("r_mrcount") > F.col("mrcount") * F.lit(share))
    best = near.groupBy(*JKEY).agg(
        F.max(F.struct("r_mrcount", (-F.col("r_donor")).alias("d"), (-F.col("r_acceptor")).alias("a"))).alias("m")
    )
    return best.select(*JKEY, (-F.col("m.d")).alias("to_donor"), (-F.col("m.a")).alias("to_acceptor"))


def resolve_redirects(pointers: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 32) -> DataFrame:
    """Pointers followed to their end by doubling. A cycle ends at its smallest member.
    Raises if ``rounds`` don't suffice (a chain of 2**rounds pointers)."""
    cur = cut(pointers.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL"))
    for _ in range(rounds):
        hop = cur.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
        step = cur.join(hop, "dst", "left")
        # within a cycle the smallest member wins, so doubling settles
        nxt = F.when(F.col("next").isNull(), F.col("dst")).when(F.col("next") == F.col("src"), F.least("dst", "src")).otherwise(F.col("next"))
        new = cut(step.select("src", nxt.alias("dst")))
        changed = new.withColumnRenamed("dst", "d2").join(cur, "src").where("d2 <> dst").limit(1).count()
        cur = new
        if not changed:
            return cur
    raise RuntimeError("redirects did not settle")


def demote_alternatives(stats: DataFrame, window: int = 50, share: float = 0.5) -> DataFrame:
    """Junctions of one acceptor (donors within ``window``) below ``share`` of the strongest, with their target."""
    slim = stats.select(*JKEY, "mrcount")
    near = tolerance_join(slim, slim, ["chrom", "strand", "acceptor"], ["donor"], window).where("donor <> r_donor")
    near = near.where(F.col("mrcount") < F.col("r_mrcount") * F.lit(share))
    best = near.groupBy(*JKEY).agg(F.max(F.struct("r_mrcount", (-F.col("r_donor")).alias("d"))).alias("m"))
    return best.select(*JKEY, (-F.col("m.d")).alias("to_donor"))


def primary_supported(stats: DataFrame, reads: DataFrame) -> DataFrame:
    """Junctions with at least one primary read, counts kept as they are."""
    own = junction_rows(reads.where("is_primary")).select(*JKEY).distinct()
    return stats.join(own, list(JKEY), "left_semi")


def coalesce_junctions(stats: DataFrame, tolerance: int = 10, share: float = 0.4) -> DataFrame:
    """Q10, Q11: greedy clusters in (donor, acceptor) order around a seed, within the
    tolerance at both ends; a member above ``share`` of the cluster's strongest stays
    apart. The representative is the member with guide, canonical sites, most reads,
    then the smallest coordinates; counters are summed.

    Order matters inside a cluster only. Rows are first cut into chains of donors
    closer than the tolerance, so a fold sees one chain; it holds distinct junctions.
    """
    by = ["chrom", "strand"]
    lab = label_islands(stats, by, "donor", "donor", slack=tolerance).select(
        *[F.col(k).alias(f"__{k}") for k in by], F.col("__s").alias("__d"), "__island"
    )
    x = stats.join(lab, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by] + [F.col("donor") == F.col("__d")]).drop(
        "__d", *[f"__{k}" for k in by]
    )
    cols = [f.name for f in stats.schema]
    sums = ("mrcount", "nreads_good", "leftsupport", "rightsupport", "nm", "mm")

    def best_first(r: dict) -> tuple:
        return (not r.get("guide_match"), not r.get("consensus"), -r["mrcount"], r["donor"], r["acceptor"])

    def fold(rows: list[dict]):
        free = rows
        while free:
            seed = free[0]
            near = [r for r in free if r["donor"] - seed["donor"] <= tolerance and abs(r["acceptor"] - seed["acceptor"]) <= tolerance]
            top = max(r["mrcount"] for r in near)
            if seed["mrcount"] < top and seed["mrcount"] > share * top:
                group = [seed]
            else:
                first = next(r for r in near if r["mrcount"] == top)
                group = [r for r in near if r is first or r is seed or r["mrcount"] <= share * top]
            new = dict(min(group, key=best_first))
            for c in sums:
                new[c] = sum(r[c] for r in group)
            yield (*[new[c] for c in cols], len(group))
            free = [r for r in free if all(r is not g for g in group)]

    schema = f"{key_schema(stats, cols)}, n_merged int"
    # a chain of one row has nothing to fold and never leaves the JVM
    x = cut(x)
    n = x.groupBy(*by, "__island").agg(F.count(F.lit(1)).alias("__n"))
    x = x.join(n, [*by, "__island"])
    alone = x.where("__n = 1").select(*cols, F.lit(1).alias("n_merged"))
    return alone.unionByName(fold_groups(x.where("__n > 1"), [*by, "__island"], ["donor", "acceptor"], fold, schema))


def usage(transcripts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Transcripts per junction, and whether it is novel (not in ``known``)."""
    rows = transcripts.select("chrom", "strand", "tx_id", F.explode(chains.junctions(F.col("exons"))).alias("j"))
    u = rows.groupBy("chrom", "strand", F.col("j.donor").alias("donor"), F.col("j.acceptor").alias("acceptor")).agg(
        F.countDistinct("tx_id").alias("n_tx")
    )
    if known is None:
        return u.withColumn("novel", F.lit(True))
    k = known.select(*JKEY).distinct().withColumn("__known", F.lit(True))
    return u.join(k, list(JKEY), "left").withColumn("novel", F.col("__known").isNull()).drop("__known")


def dominated_novel(use: DataFrame, most: int = 1, strong: int = 3) -> DataFrame:
    """Novel junctions used at most ``most`` times with a competitor at the
    same donor or acceptor used at least ``strong`` times."""
    d = use.groupBy("chrom", "strand", "donor").agg(F.max("n_tx").alias("__d"))
    a = use.groupBy("chrom", "strand", "acceptor").agg(F.max("n_tx").alias("__a"))
    x = use.join(d, ["chrom", "strand", "donor"]).join(a, ["chrom", "strand", "acceptor"])
    return x.where(F.col("novel") & (F.col("n_tx") <= most) & (F.greatest("__d", "__a") >= strong)).drop("__d", "__a")


def known_region_anti(df: DataFrame, known: DataFrame, ident: str, pad: int = 0) -> DataFrame:
    """Rows that overlap no padded known span."""
    return overlap_semi(df, known, ["chrom"], ident, anti=True, pad=pad)


def intron_pairs(reads: DataFrame) -> DataFrame:
    """Distinct pairs of consecutive junctions with the number of reads."""
    j = chains.junctions(F.col("exons"))
    n = F.greatest(F.size("exons") - 2, F.lit(0))
    pairs = F.zip_with(F.slice(j, 1, n), F.slice(j, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    x = reads.select("chrom", "strand", "weight", F.explode(pairs).alias("p"))
    return x.groupBy(
        "chrom", "strand", F.col("p.a.donor").alias("d1"), F.col("p.a.acceptor").alias("a1"),
        F.col("p.b.donor").alias("d2"), F.col("p.b.acceptor").alias("a2"),
    ).agg(F.sum("weight").alias("n_reads"))


def endpoint_map(points: DataFrame, keys: Sequence[str], radius: int = 10) -> DataFrame:
    """Every position with its representative: the heaviest position (ties: the
    smallest) of the chain of positions closer than ``radius``."""
    keys = list(keys)
    w = cut(points.groupBy(*keys, "pos").agg(F.sum("weight").alias("__w")))
    lab = label_islands(w, keys, "pos", "pos", slack=radius).select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__s").alias("__p"), "__island"
    )
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col("pos") == F.col("__p")]
    x = w.join(lab, on).select(*keys, "pos", "__w", "__island")
    rep = x.groupBy(*keys, "__island").agg(F.max(F.struct("__w", (-F.col("pos")).alias("p"))).alias("m"))
    r = rep.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__island").alias("__i"), (-F.col("m.p")).alias("rep"))
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col("__island") == F.col("__i")]
    return x.join(r, on).select(*keys, "pos", "rep")


def rank_sites(stats: DataFrame) -> DataFrame:
    """Rank of each junction among those of its donor by reads (ties by acceptor)."""
    w = Window.partitionBy("chrom", "strand", "donor").orderBy(F.desc("mrcount"), "acceptor")
    return stats.withColumn("rank", F.row_number().over(w))


def inject_guides(stats: DataFrame, guides: DataFrame, weight: float = 1.0) -> DataFrame:
    """Q18, guide junctions: guide junctions that are missing are added with ``weight`` everywhere."""
    new = guides.select(*JKEY).distinct().join(stats.select(*JKEY), list(JKEY), "left_anti")
    one = [F.lit(weight).cast(stats.schema[c].dataType).alias(c) for c in ("mrcount", "nreads_good", "leftsupport", "rightsupport")]
    return stats.unionByName(new.select(*JKEY, *one), allowMissingColumns=True)


def two_splice_witness(pairs: DataFrame, reads: DataFrame, tolerance: int = 5) -> DataFrame:
    """Q7: whether some read holds both junctions of a pair in order, within the tolerance.
    ``pairs``: pair_id, chrom, d1, a1, d2, a2 (donor and acceptor of both). Adds seen."""
    j = reads.select("row_id", "chrom", F.posexplode(chains.junctions(F.col("exons"))).alias("i", "j")).select(
        "row_id", "i", "chrom", F.col("j.donor").alias("donor"), F.col("j.acceptor").alias("acceptor")
    )
    side = lambda d, a: pairs.select("pair_id", "chrom", F.col(d).alias("donor"), F.col(a).alias("acceptor"))
    one = tolerance_join(side("d1", "a1"), j, ["chrom"], ["donor", "acceptor"], tolerance).select("pair_id", F.col("r_row_id").alias("row_id"), F.col("r_i").alias("i1"))
    two = tolerance_join(side("d2", "a2"), j, ["chrom"], ["donor", "acceptor"], tolerance).select("pair_id", F.col("r_row_id").alias("row_id"), F.col("r_i").alias("i2"))
    hit = one.join(two, ["pair_id", "row_id"]).where("i1 < i2").select("pair_id").distinct().withColumn("seen", F.lit(True))
    return pairs.join(hit, "pair_id", "left").fillna(False, ["seen"])


def demote_high_error(stats: DataFrame, window: int = NEAR) -> DataFrame:
    """Q4: junctions all of whose reads mismatch (nm >= mrcount) walk to a better neighbour.

    Rows are visited by donor, then acceptor, within chains of donors closer than
    ``window``; each looks for the neighbour, within ``window`` at both ends, with most
    reads that itself is not demoted; it needs more reads than the tiered share of the
    distance allows (1 up to 25 bases, .5 up to 100, .25 up to 200, else .1). Adds
    to_donor and to_acceptor (null where nothing changes); earlier decisions count for later rows."""
    by = ["chrom", "strand"]
    lab = label_islands(stats, by, "donor", "donor", slack=window).select(
        *[F.col(k).alias(f"__{k}") for k in by], F.col("__s").alias("__d"), "__island"
    )
    x = stats.join(lab, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by] + [F.col("donor") == F.col("__d")]).drop(
        "__d", *[f"__{k}" for k in by]
    )
    cols = [f.name for f in stats.schema]

    def tier(d: int) -> float:
        return 1.0 if d <= 25 else 0.5 if d <= 100 else 0.25 if d <= 200 else 0.1

    def fold(rows: list[dict]):
        gone: set[int] = set()
        for i, r in enumerate(rows):
            to = None
            if r["mrcount"] > 0 and (r["nm"] or 0) >= r["mrcount"]:
                near = [
                    (q["mrcount"], -q["donor"], -q["acceptor"]) for k, q in enumerate(rows)
                    if k != i and k not in gone and abs(q["donor"] - r["donor"]) <= window and abs(q["acceptor"] - r["acceptor"]) <= window
                    and r["mrcount"] < q["mrcount"] * tier(abs(q["donor"] - r["donor"]) + abs(q["acceptor"] - r["acceptor"]))
                ]
                if near:
                    best = max(near)
                    to = (-best[1], -best[2])
                    gone.add(i)
            yield (*[r[c] for c in cols], *(to or (None, None)))

    schema = f"{key_schema(stats, cols)}, to_donor bigint, to_acceptor bigint"
    return fold_groups(x, [*by, "__island"], ["donor", "acceptor"], fold, schema)


def preprocess(stats: DataFrame, least: float = 1.0, percent: float = 1.0, tolerance: int = 10) -> DataFrame:
    """Q12, Q13: coalesce, then drop killed, weak, nearby-weak and low-share junctions, then canonicalise."""
    # each stage reads its input several times, so stages are cut from each other
    x = cut(coalesce_junctions(stats, tolerance).drop("n_merged"))
    x = nearby_weak(weak_filter(x, least)).where("NOT drop").drop("drop", "best_near")
    x = cut(site_isofrac(x, percent).where("keep").drop("keep", "site_total"))
    return coalesce_junctions(x.select(*stats.columns), tolerance).drop("n_merged")
