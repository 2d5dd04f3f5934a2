"""Structures of one locus in plain Python.

These are the bodies of folds: small inputs, total orders, no Spark. The callers
hand them distinct nodes, paths and sequences of one group.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from splicelake.operators.graphs import EPS, Graph, build, topological

Path = tuple[int, ...]
Span = tuple[int, int]


# nodes ---------------------------------------------------------------------------


def split_at(nodes: Sequence[Span], cuts: Sequence[int]) -> list[Span]:
    """Nodes cut at positions inside them."""
    out = []
    for s, e in sorted(nodes):
        inner = sorted({c for c in cuts if s < c < e})
        out += list(zip([s, *inner], [*inner, e]))
    return out


def boundary_contrast(depth: Sequence[float], at: int, window: int = 50) -> float:
    """(right - left) / (.5 * window) of the coverage sums beside a position."""
    left, right = sum(depth[max(0, at - window) : at]), sum(depth[at : at + window])
    return (right - left) / (0.5 * window)


def terminal_edges(nodes: Sequence[Span], cov: dict[int, float], edges: Sequence[Span], share: float = 0.05) -> list[tuple[int, int, float]]:
    """Source (-1) edges to nodes whose parents together have less than ``share`` of their
    coverage, weighted half the difference; sink (-2) edges likewise. Nodes are named by their start."""
    into, out = defaultdict(list), defaultdict(list)
    for u, v in edges:
        into[v].append(u)
        out[u].append(v)
    made = []
    for s, _ in sorted(nodes):
        for end, near in ((-1, into[s]), (-2, out[s])):
            other = sum(cov[n] for n in near)
            if other < share * cov[s]:
                w = (cov[s] - other) / 2
                made.append((end, s, w) if end == -1 else (s, end, w))
    return made


def hard_ends(paths: Sequence[tuple[Path, int, int]], least: int = 8) -> tuple[set[int], set[int]]:
    """Nodes at which tails pile up: (hard starts, hard ends) from (path, tails at the
    start, tails at the end)."""
    first, last = defaultdict(int), defaultdict(int)
    for p, a, b in paths:
        first[p[0]] += a
        last[p[-1]] += b
    return {n for n, k in first.items() if k >= least}, {n for n, k in last.items() if k >= least}


def drop_empty(nodes: Sequence[Span], edges: Sequence[Span]) -> tuple[list[Span], list[Span]]:
    """Empty nodes removed, their neighbours joined. Nodes are named by index."""
    g = set(edges)
    for i, (s, e) in enumerate(nodes):
        if s == e:
            into, out = {u for u, v in g if v == i}, {v for u, v in g if u == i}
            g = {x for x in g if i not in x} | {(u, v) for u in into for v in out}
    return [n for n in nodes if n[0] < n[1]], sorted(g)


def subgraph(g: Graph, nodes: set[int]) -> Graph:
    """The part of a graph on some nodes."""
    return build([(u, v, c) for u, x in g.items() for v, c in x.items() if u in nodes and v in nodes])


# paths ----------------------------------------------------------------------------


def split_segments(path: Path, ends: dict[int, int], junctions: set[Span], window: int = 0) -> list[Path]:
    """A path cut at gaps that no junction of the read explains within the window."""
    out, cur = [], [path[0]]
    for u, v in zip(path, path[1:]):
        gap = ends[u] < v
        if gap and not any(abs(d - ends[u]) <= window and abs(a - v) <= window for d, a in junctions):
            out.append(tuple(cur))
            cur = []
        cur.append(v)
    return [*out, tuple(cur)]


def trim_weak_ends(path: Path, ends: dict[int, int], cov: dict[int, float], share: float = 0.1) -> Path:
    """Terminal nodes that touch their neighbour and have less than ``share`` of its coverage dropped."""
    p = list(path)
    while len(p) > 1 and ends[p[0]] == p[1] and cov[p[0]] < share * cov[p[1]]:
        p.pop(0)
    while len(p) > 1 and ends[p[-2]] == p[-1] and cov[p[-1]] < share * cov[p[-2]]:
        p.pop()
    return tuple(p)


def long_compatible(a: Path, b: Path, ends: dict[int, int], hard_start: set[int], hard_end: set[int], edge: int = 100) -> int:
    """0 incompatible, 1 a longer, 2 b longer, 3 the same extent.

    Different hard starts or ends exclude each other; where both reach they use the same
    nodes; nodes only one has at an end may not add an intron against a hard end of the
    other, and the ends may not favour different paths by an intron."""
    if (a[0] in hard_start and b[0] in hard_start and a[0] != b[0]) or (a[-1] in hard_end and b[-1] in hard_end and a[-1] != b[-1]):
        return 0
    lo, hi = max(a[0], b[0]), min(a[-1], b[-1])
    ma, mb = [n for n in a if lo <= n <= hi], [n for n in b if lo <= n <= hi]
    if not ma or ma != mb:
        return 0

    def jumps(extra: Sequence[int], before: bool) -> bool:
        chain = [*extra, ma[0]] if before else [ma[-1], *extra]
        return any(ends[u] < v for u, v in zip(chain, chain[1:]))

    longer = 0
    for before in (True, False):
        ea, eb = ([n for n in a if n < lo], [n for n in b if n < lo]) if before else ([n for n in a if n > hi], [n for n in b if n > hi])
        who, extra = (1, ea) if ea else (2, eb)
        if not extra:
            continue
        other = b if who == 1 else a
        stiff = (other[0] in hard_start) if before else (other[-1] in hard_end)
        if jumps(extra, before):
            if stiff or longer not in (0, who):
                return 0
            longer = who
        elif sum(ends[n] - n for n in extra) > edge and longer == 0:
            longer = who
    return longer or 3


def stitch(left: Path, right: Path, g: Graph) -> Path | None:
    """The widest way (largest smallest capacity, then fewest nodes) from the end of one path
    to the start of another."""
    best: dict[int, tuple[float, int, Path]] = {left[-1]: (float("inf"), 0, left)}
    order = [n for n in topological(g) if n >= left[-1]]
    for u in order:
        if u not in best:
            continue
        w, k, p = best[u]
        for v, c in g.get(u, {}).items():
            new = (min(w, c), -(k + 1))
            if v <= right[0] and (v not in best or new > (best[v][0], -best[v][1])):
                best[v] = (min(w, c), k + 1, (*p, v))
    if right[0] in best and best[right[0]][0] > EPS:
        return (*best[right[0]][2], *right[1:])
    return None


def enumerate_paths(g: Graph, s: int = -1, t: int = -2, most: int = 1000) -> list[Path]:
    """All paths from source to sink in order, inner nodes only; raises beyond ``most``."""
    out: list[Path] = []
    todo: list[tuple[int, Path]] = [(s, ())]
    while todo:
        u, p = todo.pop()
        if u == t:
            out.append(p)
            if len(out) > most:
                raise ValueError(f"more than {most} paths")
            continue
        todo += [(v, p if v == t else (*p, v)) for v in sorted(g.get(u, {}), reverse=True)]
    return sorted(out)


def recombine(paths: Sequence[tuple[Path, float]], least: int = 2) -> list[tuple[Path, float]]:
    """Prefixes and suffixes of paths joined at shared inner nodes, where the result is new and at
    least ``least`` input paths agree with it around the node; weight is the smaller of both."""
    known = {p for p, _ in paths}
    out: dict[Path, float] = {}
    for p, w in paths:
        for q, x in paths:
            for n in set(p[1:-1]) & set(q[1:-1]):
                new = (*p[: p.index(n)], *q[q.index(n) :])
                if new in known or p == q:
                    continue
                i = new.index(n)
                near = new[max(0, i - 1) : i + 2]
                votes = sum(any(r[k : k + len(near)] == near for k in range(len(r))) for r, _ in paths)
                if votes >= least:
                    out[new] = max(out.get(new, 0.0), min(w, x))
    return sorted(out.items())


def guide_shares(nodes: dict[int, float], guides: dict[str, Path], rounds: int = 100, settled: float = 1e-6) -> dict[str, float]:
    """Coverage of nodes dealt to competing guides by expectation maximisation: each node
    is shared in proportion to the guides' abundance; abundance is the share per node."""
    a = {k: 1.0 for k in guides}
    for _ in range(rounds):
        got = {k: 0.0 for k in guides}
        for n, c in nodes.items():
            own = [k for k, p in guides.items() if n in p]
            total = sum(a[k] for k in own)
            for k in own:
                got[k] += c * a[k] / total if total else 0.0
        new = {k: got[k] / len(guides[k]) for k in guides}
        if max((abs(new[k] - a[k]) for k in a), default=0.0) < settled:
            return new
        a = new
    return a


def max_compatible(weights: dict[int, float], conflicts: set[tuple[int, int]], most: int = 40) -> tuple[float, list[int]]:
    """M3: heaviest set of members without conflicts, by branch and bound; ties: the smaller members.
    Components of conflicts are solved one by one; one of more than ``most`` members raises."""
    near = defaultdict(set)
    for u, v in conflicts:
        near[u].add(v)
        near[v].add(u)

    def solve(free: frozenset[int], memo: dict) -> tuple[float, tuple[int, ...]]:
        if not free:
            return 0.0, ()
        if free in memo:
            return memo[free]
        u = min(free, key=lambda n: (-len(near[n] & free), n))
        if not near[u] & free:
            got = (sum(weights[n] for n in free), tuple(sorted(free)))
        else:
            w, s = solve(free - near[u] - {u}, memo)
            take = (w + weights[u], tuple(sorted((*s, u))))
            skip = solve(free - {u}, memo)
            got = max(take, skip, key=lambda x: (x[0], [-n for n in x[1]]))
        memo[free] = got
        return got

    total, picked, left = 0.0, [], set(weights)
    while left:
        part, todo = set(), [min(left)]
        while todo:
            n = todo.pop()
            if n not in part:
                part.add(n)
                todo += near[n] & left
        if len(part) > most:
            raise ValueError(f"a conflict component of {len(part)} members")
        w, s = solve(frozenset(part), {})
        total += w
        picked += s
        left -= part
    return total, sorted(picked)


def merge_paths(paths: Sequence[tuple[Path, float]]) -> list[tuple[Path, float]]:
    """M2, M4: sub-paths absorbed, then the heaviest set of paths that don't contradict each other
    (same outer ends, different inside) is kept with its weight; the others are returned after it."""
    from splicelake.operators.assembly import same_outer
    from splicelake.operators.graphs import absorb_subpaths

    kept = absorb_subpaths(paths)
    conflicts = {(i, j) for i in range(len(kept)) for j in range(i) if same_outer(kept[i][0], kept[j][0])}
    _, best = max_compatible({i: w for i, (_, w) in enumerate(kept)}, conflicts)
    return [kept[i] for i in best] + [k for i, k in enumerate(kept) if i not in set(best)]


# sequences -------------------------------------------------------------------------


def align_pair(a: str, b: str, match: float = 1.0, mismatch: float = -1.0, opening: float = -2.0, extension: float = -1.0) -> tuple[str, str]:
    """Global alignment of two sequences with affine gaps; ties prefer matches, then gaps in ``b``."""
    n, m = len(a), len(b)
    low = -1e18
    M = [[low] * (m + 1) for _ in range(n + 1)]
    X = [[low] * (m + 1) for _ in range(n + 1)]
    Y = [[low] * (m + 1) for _ in range(n + 1)]
    M[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                M[i][j] = max(M[i - 1][j - 1], X[i - 1][j - 1], Y[i - 1][j - 1]) + (match if a[i - 1] == b[j - 1] else mismatch)
            if i:
                X[i][j] = max(M[i - 1][j] + opening, X[i - 1][j] + extension, Y[i - 1][j] + opening)
            if j:
                Y[i][j] = max(M[i][j - 1] + opening, Y[i][j - 1] + extension, X[i][j - 1] + opening)
    i, j, top, bottom = n, m, [], []
    state = max((M[n][m], 2), (X[n][m], 1), (Y[n][m], 0))[1]
    while i or j:
        if state == 2:
            top.append(a[i - 1])
            bottom.append(b[j - 1])
            i, j = i - 1, j - 1
            state = max((M[i][j], 2), (X[i][j], 1), (Y[i][j], 0))[1]
        elif state == 1:
            top.append(a[i - 1])
            bottom.append("-")
            i -= 1
            state = max((M[i][j] + opening, 2), (X[i][j] + extension, 1), (Y[i][j] + opening, 0))[1]
        else:
            top.append("-")
            bottom.append(b[j - 1])
            j -= 1
            state = max((M[i][j] + opening, 2), (X[i][j] + opening, 1), (Y[i][j] + extension, 0))[1]
    return "".join(reversed(top)), "".join(reversed(bottom))


def align_many(seqs: Sequence[str]) -> list[str]:
    """Progressive alignment of sequences in their order: each is aligned to the consensus so
    far (most frequent base of a column, ties in the order of the alphabet)."""
    rows = [seqs[0]]
    for s in seqs[1:]:
        cols = list(zip(*rows))
        consensus = "".join(min(set(c) - {"-"}, key=lambda b: (-c.count(b), b)) for c in cols)
        top, bottom = align_pair(consensus, s)
        grown = ["" for _ in rows]
        k = 0
        for t in top:
            for r in range(len(rows)):
                grown[r] += "-" if t == "-" else rows[r][k]
            k += t != "-"
        rows = [*grown, bottom]
    return rows


def identity(rows: Sequence[str]) -> float:
    """Equal pairs over all pairs of rows and columns that are not gap and gap."""
    same = seen = 0
    for c in zip(*rows):
        for i in range(len(c)):
            for j in range(i):
                if c[i] != "-" or c[j] != "-":
                    seen += 1
                    same += c[i] == c[j]
    return same / seen if seen else 0.0


def column_stats(rows: Sequence[str]) -> dict[str, int]:
    """MSA family stats: conserved, majority, polymorphic and indel columns."""
    out = {"conserved": 0, "majority": 0, "polymorphic": 0, "indel": 0}
    for c in zip(*rows):
        if "-" in c:
            out["indel"] += 1
        elif len(set(c)) == 1:
            out["conserved"] += 1
        elif max(c.count(b) for b in set(c)) * 2 > len(c):
            out["majority"] += 1
        else:
            out["polymorphic"] += 1
    return out


def fit_profiles(seqs: dict[str, str], shared_from: float = 0.6, tilt_from: float = 0.5, alpha: float = 0.7):
    """(shared profile, profile per copy, copy_specific). One profile from the alignment if two
    or more sequences are alike by ``shared_from``, else that of the first; copies are tilted from
    ``tilt_from`` on, below it each has a profile of its own."""
    from splicelake.operators import profiles as P

    names = sorted(seqs)
    if len(names) < 2:
        one = P.from_sequence(seqs[names[0]])
        return one, {names[0]: one}, False
    rows = align_many([seqs[n] for n in names])
    like = identity(rows)
    shared = P.from_alignment(rows) if like >= shared_from else P.from_sequence(seqs[names[0]])
    if like < tilt_from:
        return shared, {n: P.from_sequence(seqs[n]) for n in names}, True
    return shared, {n: P.of_copy(rows, i, alpha) for i, n in enumerate(names)}, False


def assign_copy(path: set[int], copies: dict[str, set[int]]) -> str:
    """The copy with the largest share of its nodes on the path, then of the path's nodes in it."""
    return min(copies, key=lambda c: (-len(copies[c] & path) / max(len(copies[c]), 1), -len(copies[c] & path) / max(len(path), 1), c))


def graph_compatibility(matched: int, exons: int, path_len: int) -> float:
    """V2: share of matched exons times (1 + .1 ln(path length))."""
    import math

    return matched / exons * (1 + 0.1 * math.log(path_len)) if exons and path_len else 0.0
