"""Assembly of transcripts from the weighted paths of one graph.

A locus reaches Python as its distinct paths with added weights. Seeds are taken
by weight; each is extended to both ends along the best supported neighbours,
must be witnessed, receives its flow from the paths it contains, and takes that
weight away. Seeds that fail are matched to kept paths, which then share their
weight, or stand on their own. Guides are paths that come first, are not extended and
keep their own ends; in estimation mode nothing else comes out. Supplements add what
the seeds left out. All orders are total. Paths are indexed by node, edge and splice,
so a step meets the paths that can matter and not all of a locus.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.operators.folding import Rows, fold_groups, key_schema
from splicelake.operators.graphs import EPS, greedy_acyclic, interval_flow
from splicelake.session import cut

Path = tuple[int, ...]


@dataclass
class Locus:
    """Nodes (start -> end) and weighted paths of node starts, with the edges in use."""

    ends: dict[int, int]
    weight: dict[Path, float]
    guides: set[Path] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.after: dict[int, dict[int, float]] = defaultdict(dict)
        self.before: dict[int, dict[int, float]] = defaultdict(dict)
        for p in self.guides:
            self.weight.setdefault(p, 0.0)
        # paths go by their numbers: hashing a path costs its length
        self.paths: list[Path] = list(self.weight)
        self.weights: list[float] = list(self.weight.values())
        self.by_first: dict[int, list[int]] = defaultdict(list)
        self.by_last: dict[int, list[int]] = defaultdict(list)
        self.by_edge: dict[tuple[int, int], list[int]] = defaultdict(list)
        self.by_splice: dict[tuple[int, int], set[int]] = defaultdict(set)
        self.passing: dict[int, float] = defaultdict(float)
        for i, (p, w) in enumerate(self.weight.items()):
            self.by_first[p[0]].append(i)
            self.by_last[p[-1]].append(i)
            if len(p) > 1:
                for n in p:
                    self.passing[n] += w
            for e in zip(p, p[1:]):
                self.by_edge[e].append(i)
                if w > 0:
                    u, v = e
                    self.after[u][v] = self.after[u].get(v, 0.0) + w
                    self.before[v][u] = self.before[v].get(u, 0.0) + w
        self.splices = [self.splice_edges(p) for p in self.paths]
        for i, s in enumerate(self.splices):
            for e in s:
                self.by_splice[e].add(i)
        self._together: dict[tuple, bool] = {}
        self._around: dict[int, float] = {}

    def together(self, a: tuple[int, int], b: tuple[int, int]) -> bool:
        """Whether an input path with weight holds both splices; nodes ascend, so it holds them in order."""
        got = self._together.get((a, b))
        if got is None:
            both = self.by_splice.get(a, set()) & self.by_splice.get(b, set())
            got = self._together[a, b] = any(self.weights[i] > 0 for i in both)
        return got

    def around(self, i: int) -> float:
        """Weight of the longer input paths that hold the whole path ``i``."""
        got = self._around.get(i)
        if got is None:
            p = self.paths[i]
            if len(p) == 1:
                got = self.passing[p[0]]
            else:
                rare = min((self.by_edge[e] for e in zip(p, p[1:])), key=len)
                got = sum(self.weights[j] for j in rare if len(self.paths[j]) > len(p) and inside(p, self.paths[j]))
            self._around[i] = got
        return got

    def splice_edges(self, p: Path) -> tuple[tuple[int, int], ...]:
        """Edges of a path that jump over bases."""
        return tuple((u, v) for u, v in zip(p, p[1:]) if self.ends[u] < v)

    def length(self, p: Path) -> int:
        return sum(self.ends[n] - n for n in p)


def compatible(part: Path, whole: Path) -> bool:
    """Where the spans of two paths overlap, they use the same nodes."""
    lo, hi = max(part[0], whole[0]), min(part[-1], whole[-1])
    if lo > hi:
        return False
    a, b = part[bisect_left(part, lo) : bisect_right(part, hi)], whole[bisect_left(whole, lo) : bisect_right(whole, hi)]
    return a == b and bool(a)


def inside(part: Path, whole: Path) -> bool:
    """Whether ``part`` is a contiguous piece of ``whole``."""
    i = bisect_left(whole, part[0])
    return whole[i : i + len(part)] == part


def extend(locus: Locus, seed: Path, left: Sequence[float], forward: bool) -> Path:
    """Grow a path to one side.

    Among the neighbours in use the one with the most remaining weight (``left``, by path number) of
    paths that agree with the path so far is taken (ties: all weight of the edge, then the nearest
    node); growth stops where no such path goes on. The paths that agree are carried along: they go
    on with the path, or begin at its end."""
    paths, fresh, edges = locus.paths, locus.by_first if forward else locus.by_last, locus.after if forward else locus.before
    end, move = (seed[-1], 1) if forward else (seed[0], -1)
    agree: dict[int, int] = {}  # paths that agree and go on, with the place of the end less (backward: and) the steps so far
    stop: dict[int, list[int]] = defaultdict(list)  # by step: those of them that end there
    grown: list[int] = []

    def add(i: int, k: int) -> None:
        at = k - move * len(grown)
        agree[i] = at
        stop[len(paths[i]) - 1 - at if forward else at].append(i)

    if len(seed) > 1:
        for i in locus.by_edge.get(seed[-2:] if forward else seed[:2], ()):
            if left[i] > EPS:
                p = paths[i]
                k = bisect_left(p, end)
                if forward:
                    m = min(k + 1, len(seed))
                    same = p[k + 1 - m : k + 1] == seed[len(seed) - m :]
                else:
                    m = min(len(p) - k, len(seed))
                    same = p[k : k + m] == seed[:m]
                if same:
                    add(i, k)
    else:
        for n in edges.get(end, ()):
            for i in locus.by_edge[(end, n) if forward else (n, end)]:
                if left[i] > EPS:
                    add(i, bisect_left(paths[i], end))
    while options := edges.get(end):
        if grown or len(seed) > 1:
            for i in fresh.get(end, ()):
                if left[i] > EPS:
                    add(i, 0 if forward else len(paths[i]) - 1)
        for i in stop.pop(len(grown), ()):
            agree.pop(i, None)
        if not agree:
            break
        if len(options) == 1:
            (end,) = options
        else:
            on: dict[int, list[int]] = defaultdict(list)
            d = move * (len(grown) + 1)
            for i, k in agree.items():
                on[paths[i][k + d]].append(i)
            if len(on) > 1:
                best = max(((sum(left[i] for i in sorted(those)), options[n], -abs(n - end)), n) for n, those in on.items())[1]
                agree = {i: agree[i] for i in on[best]}
                end = best
            else:
                (end,) = on
        grown.append(end)
    return (*seed, *grown) if forward else (*grown[::-1], *seed)


def witnessed(locus: Locus, path: Path) -> bool:
    """X15 (pairs): every two consecutive splices of a path occur together, in order, in some input path with weight."""
    s = locus.splice_edges(path)
    return all(locus.together(a, b) for a, b in zip(s, s[1:]))


def full_witness(locus: Locus, path: Path) -> bool:
    """X15 (chain): one input path with weight holds all splices of a path, one after the other."""
    s = locus.splice_edges(path)
    if not s:
        return True
    k = len(s)
    for j in locus.by_splice.get(s[0], ()):
        i = locus.splices[j].index(s[0])
        if locus.weights[j] > 0 and locus.splices[j][i : i + k] == s:
            return True
    return False


def path_flow(locus: Locus, path: Path, left: list[float], take: bool = True) -> tuple[float, list[float]]:
    """Flow from the first to the last node of a path over the input paths that are its
    pieces, and the weight each node carries; that weight is taken from them.

    A piece is an edge from its first node to the gap behind its last, weighted by what
    remains; overlapping pieces join, as a step back costs nothing. Of a piece that the
    flow does not use up, the path gets the share that input paths inside it have among
    all longer input paths with that piece (all of it where there are none)."""
    total, carried, taken = _flow(locus, path, left)
    if take:
        for i, f in taken.items():
            left[i] -= f
    return total, carried


def _flow(locus: Locus, path: Path, left: Sequence[float]) -> tuple[float, list[float], dict[int, float]]:
    """Flow, weight by node, and what is taken from each piece (by path number)."""
    paths, size = locus.paths, len(path)
    held = []  # input paths inside the path: place of the first node, place behind the last, number
    for a, n in enumerate(path):
        for i in locus.by_first.get(n, ()):
            p = paths[i]
            b = a + len(p)
            if b <= size and p[-1] == path[b - 1] and p == path[a:b]:
                held.append((a, b, i))
    edges = [(a, b, left[i]) for a, b, i in held if left[i] > EPS]
    total, used = interval_flow(edges, size) if edges else (0.0, {})
    taken: dict[int, float] = {}
    if total <= EPS:
        return 0.0, [0.0] * size, taken
    rest = []
    for a, b, i in held:
        if left[i] > EPS:
            f = taken[i] = min(left[i], used.get((a, b), 0.0))
            if left[i] - f > EPS and paths[i] != path:
                rest.append(i)
    if rest:
        own = _inner(held, locus.weights, size)
        for i in rest:
            every = locus.around(i)
            taken[i] += (left[i] - taken[i]) * (own[i] / every if every else 1.0)
    carried = [0.0] * size
    for a, b, i in held:
        if f := taken.get(i, 0.0):
            for k in range(a, b):
                carried[k] += f
    return total, carried, taken


def _inner(held: Sequence[tuple[int, int, int]], weights: Sequence[float], size: int) -> dict[int, float]:
    """By number of each held path: weight of the longer held paths around it (sums by place of the end, longer ones first)."""
    sums, out = [0.0] * (size + 2), {}
    for a, b, i in sorted(held, key=lambda x: (x[0], -x[1])):
        k, got = size + 1 - b, 0.0
        j = k
        while j:
            got += sums[j]
            j &= j - 1
        out[i] = got
        while k < len(sums):
            sums[k] += weights[i]
            k += k & -k
    return out


def exons_of(locus: Locus, path: Path) -> list[tuple[int, int]]:
    """Exons of a path: touching nodes joined."""
    out: list[list[int]] = []
    for n in path:
        if out and out[-1][1] == n:
            out[-1][1] = locus.ends[n]
        else:
            out.append([n, locus.ends[n]])
    return [(a, b) for a, b in out]


def assemble(
    locus: Locus, min_length: int = 200, read_least: float = 1.0, single_least: float = 4.75, supplement: bool = False, only_guides: bool = False
) -> list[tuple[Path, float, str]]:
    """(path, coverage, origin) of a locus.

    origin is guide, seed or rescue; with ``supplement`` also suffix-free rescues of equal outer ends
    (alternative, X14), input paths with a splice of their own (novel, X31), paths of the greedy
    decomposition with one (greedy, X32) and the heaviest path of a competing splice (competing, X33),
    while seeds that are the end of a much longer kept path go to it (X13). With ``only_guides``
    (X8) every guide comes out, with coverage 0 where nothing supports it, and nothing else."""
    left = list(locus.weights)
    kept = Kept()
    place: dict[Path, int] = {}
    deferred: list[int] = []
    guides, paths, weights = locus.guides, locus.paths, locus.weights
    order = sorted(range(len(paths)), key=lambda i: (paths[i] not in guides if guides else True, -weights[i], -len(paths[i]), paths[i]))
    for i in order:
        seed = paths[i]
        guide = bool(guides) and seed in guides
        if not guide and (only_guides or left[i] <= EPS):
            continue
        path = seed if guide else extend(locus, extend(locus, seed, left, False), left, True)
        least = read_least if locus.splice_edges(path) else single_least
        if not only_guides and (locus.length(path) < min_length or not (guide or witnessed(locus, path))):
            deferred.append(i)
            continue
        flow, carried, taken = _flow(locus, path, left)
        if flow <= EPS:
            if only_guides:
                place[path] = kept.add(path, 0.0, "guide")
            else:
                deferred.append(i)
            continue
        bases = sum(c * (locus.ends[n] - n) for c, n in zip(carried, path))
        cov = bases / locus.length(path)
        if cov < least and not guide:
            deferred.append(i)
            continue
        for j, f in taken.items():
            left[j] -= f
        if left[i] > EPS:
            deferred.append(i)
        if path in place:
            kept.rows[place[path]][1] += cov
        else:
            place[path] = kept.add(path, cov, "guide" if guide else "seed")
    if only_guides:
        return [(k[0], k[1], k[2]) for k in kept.rows]
    for i in sorted(deferred, key=lambda i: (-weights[i], paths[i])):
        seed, rest = paths[i], left[i]
        if rest <= EPS:
            continue
        hosts = [kept.rows[h] for h in kept.best_match(seed) if compatible(seed, kept.rows[h][0])]
        total = sum(h[1] for h in hosts)
        whole = kept.chimeric_suffix(seed) if supplement else None
        if whole is not None:
            kept.rows[whole][1] += rest * locus.length(seed) / locus.length(kept.rows[whole][0])
        elif hosts and total > 0:
            for h, cov in [(h, h[1]) for h in hosts]:
                share = rest * cov / total
                h[1] += share * locus.length(seed) / locus.length(h[0])
        elif rest >= (read_least if locus.splice_edges(seed) else single_least) and locus.length(seed) >= min_length and witnessed(locus, seed):
            outer = supplement and kept.same_outer(seed)
            kept.add(seed, rest, "alternative" if outer else "rescue")
        left[i] = 0.0
    if supplement:
        _supplement(locus, kept, min_length, read_least)
    return [(k[0], k[1], k[2]) for k in kept.rows]


class Kept:
    """Kept paths (path, coverage, origin), found by node, by ends and as a whole."""

    def __init__(self) -> None:
        self.rows: list[list] = []
        self.whole: set[Path] = set()
        self.by_node: dict[int, list[int]] = defaultdict(list)
        self.by_last: dict[int, list[int]] = defaultdict(list)
        self.by_outer: dict[tuple[int, int], list[Path]] = defaultdict(list)

    def add(self, path: Path, cov: float, origin: str) -> int:
        at = len(self.rows)
        self.rows.append([path, cov, origin])
        self.whole.add(path)
        for n in path:
            self.by_node[n].append(at)
        self.by_last[path[-1]].append(at)
        self.by_outer[path[0], path[-1]].append(path)
        return at

    def best_match(self, path: Path) -> list[int]:
        """X11: as ``graphs.best_match``, by nodes shared."""
        shared: dict[int, int] = defaultdict(int)
        for n in path:
            for i in self.by_node.get(n, ()):
                shared[i] += 1
        best = min(((-k, len(self.rows[i][0]) - k) for i, k in shared.items()), default=None)
        return sorted(i for i, k in shared.items() if (-k, len(self.rows[i][0]) - k) == best)

    def chimeric_suffix(self, seed: Path) -> int | None:
        """Index of the first kept path that ends with the seed and is much longer."""
        own = self.by_last.get(seed[-1], ())
        at = chimeric_suffix(seed, [self.rows[i][0] for i in own])
        return None if at is None else own[at]

    def same_outer(self, seed: Path) -> bool:
        """Whether a kept path has the seed's ends."""
        return any(same_outer(seed, p) for p in self.by_outer.get((seed[0], seed[-1]), ()))


def _supplement(locus: Locus, kept: Kept, min_length: int, least: float) -> None:
    """Paths with splices that nothing kept has, in this order, each once."""
    known = {s for k in kept.rows for s in locus.splice_edges(k[0])}

    def add(path: Path, cov: float, origin: str) -> None:
        if locus.length(path) >= min_length and path not in kept.whole:
            kept.add(path, cov, origin)
            known.update(locus.splice_edges(path))

    for p, w in sorted(novel_chains([k[0] for k in kept.rows], locus, least), key=lambda x: (-x[1], x[0])):
        if any(s not in known for s in locus.splice_edges(p)):
            add(p, w, "novel")
    edges = [(u, v, c) for u, x in locus.after.items() for v, c in x.items()]
    heads, tails = defaultdict(float), defaultdict(float)
    for p, w in locus.weight.items():
        heads[p[0]] += w
        tails[p[-1]] += w
    edges += [(-1, n, w) for n, w in sorted(heads.items())] + [(n, -2, w) for n, w in sorted(tails.items())]
    for nodes, flow, _ in greedy_acyclic(edges, least=least):
        p = tuple(nodes)
        if any(s not in known for s in locus.splice_edges(p)) and witnessed(locus, p):
            add(p, flow, "greedy")
    for s in competing_acceptors([k[0] for k in kept.rows], locus):
        best = max(locus.by_splice[s], key=lambda i: (locus.weights[i], [-n for n in locus.paths[i]]))
        add(locus.paths[best], locus.weights[best], "competing")


def novel_chains(kept: Sequence[Path], locus: Locus, least: float = 1.0) -> list[tuple[Path, float]]:
    """Input paths with a splice that no kept path has, weighted at least ``least``."""
    known = {s for k in kept for s in locus.splice_edges(k)}
    return [(p, w) for p, w, own in sorted(zip(locus.paths, locus.weights, locus.splices)) if w >= least and any(s not in known for s in own)]


def competing_acceptors(kept: Sequence[Path], locus: Locus, least: int = 3) -> list[tuple[int, int]]:
    """Splices of donors with several acceptors, seen by ``least`` input paths or more, that no kept path has."""
    known = {s for k in kept for s in locus.splice_edges(k)}
    seen: dict[tuple[int, int], int] = defaultdict(int)
    for t in locus.splices:
        for s in set(t):
            seen[s] += 1
    by = defaultdict(set)
    for u, v in seen:
        by[u].add(v)
    return sorted(s for s, n in seen.items() if n >= least and len(by[s[0]]) > 1 and s not in known)


def chimeric_suffix(seed: Path, kept: Sequence[Path], least: int = 10, more: int = 15) -> int | None:
    """Index of a kept path that ends with the whole seed and is longer by ``more`` nodes."""
    if len(seed) >= least:
        for i, k in enumerate(kept):
            if len(k) >= len(seed) + more and k[-len(seed) :] == seed:
                return i
    return None


def same_outer(a: Path, b: Path) -> bool:
    """Equal ends, different inside."""
    return a != b and a[0] == b[0] and a[-1] == b[-1]


def assemble_loci(paths: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """X1 for every locus: keys, tx_no, origin, coverage, exons, guide_id.

    ``paths``: keys, path (array of struct<start,end> nodes in order), abundance; and, in guided
    mode, guides (array of struct<guide_id,start,end>: J19, J21: those with this path, each of which
    keeps its own ends, X18, and has a row of its own with the path's coverage)."""
    guided = "guides" in paths.columns

    def run(rows: Rows):
        ends = {n["start"]: n["end"] for r in rows for n in r["path"]}
        weight: dict[Path, float] = defaultdict(float)
        guides: dict[Path, list[dict]] = defaultdict(list)
        for r in rows:
            p = tuple(n["start"] for n in r["path"] or ())
            if p and r["abundance"]:
                weight[p] += r["abundance"]
            if p and guided:
                guides[p] += r["guides"] or []
        locus = Locus(ends, dict(weight), {p for p, g in guides.items() if g})
        own = [rows[0][k] for k in keys]
        no = 0
        for p, cov, origin in assemble(locus, **options):
            ex = exons_of(locus, p)
            for g in sorted(guides[p], key=lambda g: g["guide_id"]) if origin == "guide" else [None]:
                no += 1
                out = ex
                if g:
                    out = [(g["start"], ex[0][1]), *ex[1:-1], (ex[-1][0], g["end"])] if len(ex) > 1 else [(g["start"], g["end"])]
                yield (*own, no, origin, cov, [{"start": a, "end": b} for a, b in out], g["guide_id"] if g else None)

    schema = f"{key_schema(paths, keys)}, tx_no int, origin string, coverage double, exons array<struct<start:bigint,end:bigint>>, guide_id bigint"
    return fold_groups(paths, keys, ["abundance"], run, schema)


def locus_paths(reads: DataFrame, runoff: int = 0, guides: DataFrame | None = None) -> DataFrame:
    """Reads to the input of ``assemble_loci``: chrom, strand, locus, path, abundance.

    Loci are chains of overlapping reads of one strand; a path's nodes are those its exons overlap.
    ``guides`` (tx_id, chrom, strand, exons) take part without weight: their junctions cut
    nodes (G19, G20), and their paths come with them."""
    from splicelake.functions.chains import bounds
    from splicelake.operators.graphs import split_nodes
    from splicelake.operators.ranges import overlap_join, regions

    keys = ["chrom", "strand"]
    # distinct structures first: what is cut into nodes and meets them is no longer every read
    base, more = reads.select(*keys, "exons", "weight", "row_id"), []
    if guides is not None:
        none = F.lit(0).cast(base.schema["weight"].dataType)
        g = guides.select(*keys, "exons", none.alias("weight"), (-1 - F.col("tx_id")).alias("row_id"), F.col("tx_id").cast("long").alias("guide_id"))
        base, more = base.withColumn("guide_id", F.lit(None).cast("long")).unionByName(g), [F.collect_set("guide_id").alias("guide_id")]
    base = base.groupBy(*keys, "exons").agg(F.sum("weight").cast("double").alias("abundance"), F.min("row_id").alias("sid"), *more)
    b = bounds(F.col("exons"))
    base = cut(base.withColumn("start", b["start"]).withColumn("end", b["end"]))
    s = cut(regions(base, keys, runoff).withColumnRenamed("region_start", "locus"))
    nodes = cut(split_nodes(base, keys).drop("island"))
    ex = s.select(*keys, "sid", F.explode("exons").alias("e")).select(*keys, "sid", F.col("e.start").alias("start"), F.col("e.end").alias("end"))
    hit = overlap_join(ex, nodes, keys).select(*keys, "sid", F.struct(F.col("r_start").alias("start"), F.col("r_end").alias("end")).alias("n"))
    p = hit.groupBy(*keys, "sid").agg(F.array_sort(F.collect_set("n")).alias("path"))
    if guides is None:
        x = s.select(*keys, "sid", "locus", "abundance").join(p, [*keys, "sid"])
        return x.groupBy(*keys, "locus", "path").agg(F.sum("abundance").alias("abundance"))
    own = F.transform("guide_id", lambda i: F.struct(i.alias("guide_id"), b["start"].alias("start"), b["end"].alias("end")))
    x = s.select(*keys, "sid", "locus", "abundance", own.alias("g")).join(p, [*keys, "sid"])
    return x.groupBy(*keys, "locus", "path").agg(F.sum("abundance").alias("abundance"), F.flatten(F.collect_list("g")).alias("guides"))
