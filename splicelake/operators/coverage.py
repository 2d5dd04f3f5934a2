"""What coverage says: transcript means, low introns, witnesses, boundaries, drops, strands.

Coverage comes as run-length segments (``ranges.coverage_segments``); everything
that needs single bases expands one node at a time inside a fold, never a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicelake.functions import chains
from splicelake.operators.folding import Rows, fold_groups, key_schema
from splicelake.operators.ranges import overlap_join, range_coverage
from splicelake.session import cut


def exon_coverage(tx: DataFrame, segments: DataFrame, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """(tx_id, part, start, end, mean) for every exon, part counting from 0."""
    ex = tx.select("tx_id", *keys, F.posexplode("exons").alias("part", "e")).select(
        "tx_id", *keys, "part", F.col("e.start").alias("start"), F.col("e.end").alias("end")
    )
    c = range_coverage(segments, ex, keys, ["tx_id", "part"])
    return c.withColumn("mean", F.col("cov_sum") / (F.col("end") - F.col("start"))).select("tx_id", "part", "start", "end", "mean", "cov_sum")


def transcript_coverage(tx: DataFrame, segments: DataFrame, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Sum and mean of coverage over the bases of each transcript."""
    e = exon_coverage(tx, segments, keys)
    return e.groupBy("tx_id").agg(F.sum("cov_sum").alias("cov_sum"), (F.sum("cov_sum") / F.sum(F.col("end") - F.col("start"))).alias("mean"))


def low_introns(tx: DataFrame, segments: DataFrame, share: float = 0.1, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """(tx_id, part, mean, low): introns whose mean coverage is below ``share`` of
    that of both flanking exons together (mean over their bases)."""
    it = tx.select("tx_id", *keys, F.posexplode(chains.junctions(F.col("exons"))).alias("part", "j")).select(
        "tx_id", *keys, "part", F.col("j.donor").alias("start"), F.col("j.acceptor").alias("end")
    )
    c = range_coverage(segments, it.where("start < end"), keys, ["tx_id", "part"]).select(
        "tx_id", "part", (F.col("cov_sum") / (F.col("end") - F.col("start"))).alias("mean")
    )
    e = exon_coverage(tx, segments, keys).select("tx_id", "part", "cov_sum", (F.col("end") - F.col("start")).alias("len"))
    nxt = e.select("tx_id", (F.col("part") - 1).alias("part"), F.col("cov_sum").alias("s2"), F.col("len").alias("l2"))
    x = c.join(e, ["tx_id", "part"]).join(nxt, ["tx_id", "part"])
    flank = (F.col("cov_sum") + F.col("s2")) / (F.col("len") + F.col("l2"))
    return x.select("tx_id", "part", "mean", (F.col("mean") < flank * F.lit(share)).alias("low"))


def witness(stats: DataFrame, segments: DataFrame, window: int = 5, share: float = 0.1) -> DataFrame:
    """Junctions with the coverage of the ``window`` bases before and after each site.

    Adds donor_in, donor_out, acceptor_in, acceptor_out (sums) and seen: coverage falls to
    ``share`` or less across the donor and rises alike across the acceptor, or reads span it."""
    sides = F.explode(F.array(*[
        F.struct(F.lit(n).alias("side"), s.alias("start"), (s + window).alias("end"))
        for n, s in (("donor_in", F.col("donor") - window), ("donor_out", F.col("donor")), ("acceptor_out", F.col("acceptor") - window), ("acceptor_in", F.col("acceptor")))
    ]))
    key = ["chrom", "strand", "donor", "acceptor"]
    r = stats.select(*key, sides.alias("w")).select(*key, "w.side", "w.start", "w.end")
    c = range_coverage(segments, r, ["chrom"], [*key, "side"]).select(*key, "side", "cov_sum")
    pick = lambda n: F.max(F.when(F.col("side") == n, F.col("cov_sum"))).alias(n)
    x = c.groupBy(*key).agg(*[pick(n) for n in ("donor_in", "donor_out", "acceptor_in", "acceptor_out")])
    seen = (F.col("donor_out") <= F.col("donor_in") * (1 - share)) & (F.col("acceptor_out") <= F.col("acceptor_in") * (1 - share))
    return x.withColumn("seen", seen)


def coverage_drop(prev_cov: Column, prev_len: Column, cov: Column, length: Column, drop: float = 0.5) -> Column:
    """Previous mean times ``drop`` exceeds the mean, compared without division."""
    return prev_cov * F.lit(drop) * length > cov * prev_len


def scan_boundaries(depth: Sequence[float], window: int = 50, least: float = 10.0, share: float = 0.1, margin: int = 25, apart: int = 100) -> list[tuple[int, str, float]]:
    """Change points of per-base coverage: (position, start or end, strength).

    At each position the rises (falls) of the ``window`` bases on either side are added.
    A start has more than ``least`` rises to the right and less than ``share`` of them to
    the left; an end mirrors that with falls: many to the left. Nothing within ``margin`` of the
    edges or in spans of 150 or less; within ``apart`` bases only the strongest of a
    kind stays (ties: the first)."""
    if len(depth) <= 150:
        return []
    return _strongest(_change_points(depth, window, least, share, margin), apart)


def _change_points(depth: Sequence[float], window: int = 50, least: float = 10.0, share: float = 0.1, margin: int = 25) -> list[tuple[int, str, float]]:
    """All change points of per-base coverage, near ones too."""
    steps = [(i, depth[i] - depth[i - 1]) for i in range(1, len(depth)) if depth[i] != depth[i - 1]]
    return change_points(steps, len(depth), window, least, share, margin)


def change_points(steps: Sequence[tuple[int, float]], n: int, window: int = 50, least: float = 10.0, share: float = 0.1, margin: int = 25) -> list[tuple[int, str, float]]:
    """All change points of a stretch of ``n`` bases, from the positions (1 to n - 1, ascending) at which
    coverage rises or falls: only there can one be, so the work grows with the steps and not the bases."""
    at = [i for i, _ in steps]
    up, down = [0.0], [0.0]
    for _, x in steps:
        up.append(up[-1] + max(x, 0.0))
        down.append(down[-1] + max(-x, 0.0))
    found: list[tuple[int, str, float]] = []
    lo = hi = 0
    for k, (i, x) in enumerate(steps):
        # steps of the windows [i - window, i) and [i, i + window)
        while at[lo] < i - window:
            lo += 1
        while hi < len(at) and at[hi] < i + window:
            hi += 1
        if not max(margin, 1) <= i < n - margin:
            continue
        rise_l, rise_r = up[k] - up[lo], up[hi] - up[k]
        fall_l, fall_r = down[k] - down[lo], down[hi] - down[k]
        if x > 0 and rise_r > least and rise_l < share * rise_r:
            found.append((i, "start", rise_r))
        if x < 0 and fall_l - x > least and fall_r + x < share * (fall_l - x):
            found.append((i, "end", fall_l - x))
    return found


def _strongest(points: Sequence[tuple[int, str, float]], apart: int = 100) -> list[tuple[int, str, float]]:
    """Of points of a kind within ``apart`` bases the strongest (ties: the first)."""
    out: list[tuple[int, str, float]] = []
    for p in sorted(points, key=lambda x: (x[1] != "start", -x[2], x[0])):
        if all(abs(p[0] - q[0]) > apart or q[1] != p[1] for q in out):
            out.append(p)
    return sorted(out)


def node_boundaries(nodes: DataFrame, segments: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """Change points inside every node: keys, node_start, pos, kind, strength.

    ``nodes``: keys, start, end. A fold walks the coverage segments of one node, however long
    it is; nodes of 150 bases or fewer have none."""
    keys, apart = list(keys), options.pop("apart", 100)
    long = nodes.select(*keys, "start", "end").where(F.col("end") - F.col("start") > 150)
    hit = overlap_join(long, segments.select(*keys, "start", "end", "depth"), keys)
    hit = hit.select(*keys, "start", "end", F.greatest("start", "r_start").alias("s"), F.least("end", "r_end").alias("e"), F.col("r_depth").cast("double").alias("d"))

    def run(rows: Rows):
        a, b = rows[0]["start"], rows[0]["end"]
        steps: list[tuple[int, float]] = []
        end, depth = a, 0.0
        for r in rows:
            if r["s"] > end and depth:
                steps.append((end - a, -depth))
                depth = 0.0
            if r["s"] > a and r["d"] != depth:
                steps.append((r["s"] - a, r["d"] - depth))
            end, depth = r["e"], r["d"]
        if end < b and depth:
            steps.append((end - a, -depth))
        for pos, kind, strength in _strongest(change_points(steps, b - a, **options), apart):
            yield (*[rows[0][k] for k in keys], a, a + pos, kind, strength)

    schema = f"{key_schema(nodes, keys)}, node_start bigint, pos bigint, kind string, strength double"
    return fold_groups(hit, [*keys, "start", "end"], ["s"], run, schema)


def trims(depth: Sequence[float], window: int = 25, drop: float = 0.2) -> list[tuple[int, str, float]]:
    """Positions where the mean of ``window`` bases on one side is below ``drop`` of the
    other's: of each run of such positions the lowest ratio, then the largest
    contrast: (position, start or end, ratio)."""
    n = len(depth)
    if n < 2 * window:
        return []
    total = [0.0]
    for x in depth:
        total.append(total[-1] + x)
    out: list[tuple[int, str, float]] = []
    run: list[tuple[float, float, int, str]] = []
    for i in range(window, n - window + 1):
        left, right = total[i] - total[i - window], total[i + window] - total[i]
        kind, ratio = ("start", left / right) if right > left else ("end", right / left) if left > 0 else ("", 1.0)
        if kind and ratio < drop and (not run or run[-1][3] == kind):
            run.append((ratio, -max(left, right), i, kind))
        else:
            if run:
                r = min(run)
                out.append((r[2], r[3], r[0]))
            run = [(ratio, -max(left, right), i, kind)] if kind and ratio < drop else []
    if run:
        r = min(run)
        out.append((r[2], r[3], r[0]))
    return out


def resolve_strand(reads: DataFrame, stats: DataFrame) -> DataFrame:
    """Q21: unstranded multi-exon reads take the strand with more support at their
    junctions (reads at the same donor and acceptor of a stranded junction; ties stay 0).
    Adds resolved_strand."""
    votes = stats.where("strand <> 0").groupBy("chrom", "donor", "acceptor").agg(F.sum(F.col("strand") * F.col("mrcount")).alias("vote"))
    j = reads.where((F.col("strand") == 0) & (F.size("exons") > 1)).select("row_id", "chrom", F.explode(chains.junctions(F.col("exons"))).alias("j"))
    j = j.select("row_id", "chrom", F.col("j.donor").alias("donor"), F.col("j.acceptor").alias("acceptor"))
    v = j.join(votes, ["chrom", "donor", "acceptor"]).groupBy("row_id").agg(F.sum("vote").alias("vote"))
    out = reads.join(v, "row_id", "left")
    s = F.signum(F.coalesce(F.col("vote"), F.lit(0))).cast("int")
    return out.withColumn("resolved_strand", F.when(F.col("strand") == 0, s).otherwise(F.col("strand"))).drop("vote")


def bridge_gaps(segments: DataFrame, reads: DataFrame, keys: Sequence[str] = ("chrom",), min_intron: int = 20, least: float = 1.0) -> DataFrame:
    """Q16: uncovered gaps of at least ``min_intron`` bases that reads jump over, as junctions with their weight.

    A gap is bridged by a read whose neighbouring exons end and begin at its edges or beyond."""
    from splicelake.operators.islands import periods_and_gaps

    keys = list(keys)
    g = periods_and_gaps(segments, keys, closed=False).where("kind = 'gap'").select(*keys, F.col("p_start").alias("start"), F.col("p_end").alias("end"))
    g = g.where(F.col("end") - F.col("start") >= min_intron)
    j = reads.select(*keys, "weight", F.explode(chains.junctions(F.col("exons"))).alias("j"))
    j = j.groupBy(*keys, F.col("j.donor").alias("start"), F.col("j.acceptor").alias("end")).agg(F.sum("weight").alias("w"))
    hit = overlap_join(g, j.where("start < end"), keys, bin_size=1 << 16).where("r_start <= start AND r_end >= end")
    n = hit.groupBy(*keys, F.col("start").alias("donor"), F.col("end").alias("acceptor")).agg(F.sum("r_w").alias("weight"))
    return n.where(F.col("weight") >= least)


def pile_ups(reads: DataFrame, tolerance: int = 10, least: int = 5, min_length: int = 200) -> DataFrame:
    """Clusters of unspliced reads with close starts that no multi-exon read overlaps:
    chrom, strand, start, end, n_reads."""
    from splicelake.operators.islands import label_islands
    from splicelake.operators.ranges import overlap_semi

    keys = ["chrom", "strand"]
    one = reads.where((F.size("exons") == 1) & (F.col("end") - F.col("start") >= min_length))
    one = cut(overlap_semi(one, reads.where(F.size("exons") > 1), ["chrom"], "row_id", anti=True))
    lab = label_islands(one, keys, "start", "start", slack=tolerance).select(
        *[F.col(k).alias(f"__{k}") for k in keys], F.col("__s").alias("__st"), "__island"
    )
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("start") == F.col("__st")]
    g = one.join(lab, on).groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_reads"))
    return g.where(F.col("n_reads") >= least).drop("__island")


def pair_mates(reads: DataFrame) -> DataFrame:
    """Mates joined on name, hit index and each other's start: (row_id, mate_id), the first mate
    by start, then row_id, in front. Needs read_name, hi, start, mate_start."""
    a = reads.select("row_id", "read_name", "hi", "chrom", "start", "mate_start").where("read_name IS NOT NULL AND mate_start IS NOT NULL")
    b = a.select(
        F.col("row_id").alias("mate_id"), "read_name", "hi", "chrom", F.col("start").alias("mate_start"), F.col("mate_start").alias("start")
    )
    p = a.join(b, ["read_name", "hi", "chrom", "start", "mate_start"])
    first = (F.col("start") < F.col("mate_start")) | ((F.col("start") == F.col("mate_start")) & (F.col("row_id") < F.col("mate_id")))
    return p.where(first).select("row_id", "mate_id")
