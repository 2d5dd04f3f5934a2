"""Splice graphs and the flow on them.

Construction, read mapping and edge capacities are relational. Order-dependent
graph algorithms run once per graph in a fold over groups; what reaches a
group are distinct nodes, edges or paths with added weights, never single reads,
so its size follows the structure of a locus and not the depth of sequencing.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Sequence
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splicelake.functions import chains
from splicelake.operators.folding import Rows, fold_groups, key_schema
from splicelake.operators.islands import label_islands
from splicelake.operators.ranges import overlap_join
from splicelake.session import cut

EPS = 1e-6


def exon_islands(reads: DataFrame, keys: Sequence[str] = ("chrom", "strand"), merge: int = 0) -> DataFrame:
    """Bundle nodes: stretches covered by exons, joined over gaps of at most ``merge`` bases (G3, G4),
    with the number of distinct starts."""
    keys = list(keys)
    ex = reads.select(*keys, F.explode("exons").alias("e")).select(*keys, F.col("e.start").alias("start"), F.col("e.end").alias("end"))
    lab = label_islands(ex, keys, slack=merge)
    return lab.groupBy(*keys, F.col("__island").alias("start")).agg(F.max("__e").alias("end"), F.count(F.lit(1)).alias("n_starts"))


def split_nodes(reads: DataFrame, keys: Sequence[str] = ("chrom", "strand"), live: DataFrame | None = None) -> DataFrame:
    """Graph nodes: exon islands cut at the donors and acceptors of live junctions.

    Columns: keys, island, start, end. ``live`` (junction table) restricts the cuts."""
    keys = list(keys)
    isl = cut(exon_islands(reads, keys))
    j = reads.select(*keys, F.explode(chains.junctions(F.col("exons"))).alias("j")).select(
        *keys, F.col("j.donor").alias("donor"), F.col("j.acceptor").alias("acceptor")
    )
    if live is not None:
        j = j.join(live.select(*keys, "donor", "acceptor").distinct(), [*keys, "donor", "acceptor"], "left_semi")
    cuts = j.select(*keys, F.explode(F.array("donor", "acceptor")).alias("pos")).distinct()
    points = cuts.select(*keys, F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"))
    spans = isl.select(*keys, F.col("start").alias("i_start"), F.col("end").alias("i_end"), "start", (F.col("end") + 1).alias("end"))
    hit = overlap_join(points, spans, keys, bin_size=1 << 16)
    inner = hit.select(*keys, F.col("r_i_start").alias("island"), F.col("start").alias("pos"))
    ends = isl.select(*keys, F.col("start").alias("island"), F.explode(F.array("start", "end")).alias("pos"))
    allp = inner.unionByName(ends).distinct()
    w = Window.partitionBy(*keys, "island").orderBy("pos")
    return (
        allp.withColumn("end", F.lead("pos").over(w))
        .where("end IS NOT NULL")
        .select(*keys, "island", F.col("pos").alias("start"), "end")
    )


def graph_edges(nodes: DataFrame, reads: DataFrame, keys: Sequence[str] = ("chrom", "strand"), min_intron: int = 20) -> DataFrame:
    """Edges between nodes: contiguous ones inside an island, and junctions, with read support."""
    keys = list(keys)
    nodes = cut(nodes)
    left = nodes.select(*keys, F.col("start").alias("from_start"), F.col("end").alias("from_end"), F.col("island"))
    right = nodes.select(*keys, F.col("start").alias("to_start"), F.col("end").alias("to_end"), F.col("island").alias("to_island"))
    touch = left.join(right.withColumn("from_end", F.col("to_start")), [*keys, "from_end"]).where("island = to_island")
    touch = touch.select(*keys, "from_start", "from_end", "to_start", "to_end", F.lit("contiguous").alias("kind"), F.lit(0).cast("long").alias("n_reads"))
    j = reads.select(*keys, "weight", F.explode(chains.junctions(F.col("exons"))).alias("j"))
    j = j.groupBy(*keys, F.col("j.donor").alias("from_end"), F.col("j.acceptor").alias("to_start")).agg(F.sum("weight").alias("n_reads"))
    j = j.where(F.col("to_start") - F.col("from_end") >= min_intron)
    jump = j.join(left.drop("island"), [*keys, "from_end"]).join(right.drop("to_island"), [*keys, "to_start"])
    return touch.unionByName(jump.select(*keys, "from_start", "from_end", "to_start", "to_end", F.lit("junction").alias("kind"), "n_reads"))


def map_reads(reads: DataFrame, nodes: DataFrame, keys: Sequence[str] = ("chrom", "strand"), ident: str = "row_id") -> DataFrame:
    """The path of each read: starts of the nodes its exons overlap, in order.

    Distinct structures meet the nodes; reads take the path of theirs."""
    keys = list(keys)
    s = cut(reads.groupBy(*keys, "exons").agg(F.min(ident).alias("__sid")))
    ex = s.select("__sid", *keys, F.explode("exons").alias("e")).select("__sid", *keys, F.col("e.start").alias("start"), F.col("e.end").alias("end"))
    p = overlap_join(ex, nodes, keys).groupBy("__sid", *keys).agg(F.array_sort(F.collect_set("r_start")).alias("path"))
    known = s.join(p, ["__sid", *keys]).drop("__sid")
    return reads.select(ident, *keys, "weight", "exons").join(known, [*keys, "exons"]).drop("exons")


def transfrags(paths: DataFrame, keys: Sequence[str] = ("chrom", "strand")) -> DataFrame:
    """Weight and reads per distinct path."""
    return paths.groupBy(*keys, "path").agg(F.sum("weight").alias("abundance"), F.count(F.lit(1)).alias("n_reads"))


def edge_capacities(paths: DataFrame, keys: Sequence[str], path: str = "path", weight: str = "abundance") -> DataFrame:
    """Weight per edge (u, v) over all paths, with source (-1) and sink (-2) edges."""
    full = F.concat(F.array(F.lit(-1).cast("long")), F.col(path).cast("array<bigint>"), F.array(F.lit(-2).cast("long")))
    n = F.size(full) - 1
    pairs = F.zip_with(F.slice(full, 1, n), F.slice(full, 2, n), lambda a, b: F.struct(a.alias("u"), b.alias("v")))
    x = paths.where(F.size(path) > 0).select(*keys, weight, F.explode(pairs).alias("e"))
    return x.groupBy(*keys, F.col("e.u").alias("u"), F.col("e.v").alias("v")).agg(F.sum(weight).alias("capacity"))


def node_flux(paths: DataFrame, keys: Sequence[str], path: str = "path", weight: str = "abundance") -> DataFrame:
    """Per node the weight that enters (path starts before it), leaves (ends after it) and passes;
    nodecov is the larger of the first two."""
    n = F.size(path)
    x = paths.select(*keys, weight, n.alias("__n"), F.posexplode(path).alias("__i", "node"))
    w = F.col(weight)
    zero = F.lit(0).cast("double")
    return (
        x.groupBy(*keys, "node")
        .agg(
            F.sum(F.when(F.col("__i") > 0, w).otherwise(zero)).alias("abundin"),
            F.sum(F.when(F.col("__i") < F.col("__n") - 1, w).otherwise(zero)).alias("abundout"),
            F.sum(w).alias("longcov"),
        )
        .withColumn("nodecov", F.greatest("abundin", "abundout"))
    )


# algorithms on one graph ----------------------------------------------------

Graph = dict[int, dict[int, float]]


def build(edges: Sequence[tuple[int, int, float]]) -> Graph:
    g: Graph = defaultdict(dict)
    for u, v, c in edges:
        g[u][v] = g[u].get(v, 0.0) + c
    return g


def widest_first_path(g: Graph, s: int, t: int, least: float) -> list[int] | None:
    """A path by breadth first, children by capacity (ties: smaller node), or None."""
    seen, back, todo = {s}, {}, deque([s])
    while todo:
        u = todo.popleft()
        if u == t:
            path = [t]
            while path[-1] != s:
                path.append(back[path[-1]])
            return path[::-1]
        for v, c in sorted(g.get(u, {}).items(), key=lambda x: (-x[1], x[0])):
            if c >= least and c > EPS and v not in seen:
                seen.add(v)
                back[v] = u
                todo.append(v)
    return None


def greedy_decomposition(edges: Sequence[tuple[int, int, float]], s: int = -1, t: int = -2, least: float = EPS, most: int | None = None) -> list[tuple[list[int], float, float]]:
    """Paths from source to sink taken off one after the other: (inner nodes, bottleneck, total after).

    Each path uses up an edge, so there are no more paths than edges; ``most`` stops earlier."""
    g, out, total = build(edges), [], 0.0
    while most is None or len(out) < most:
        path = widest_first_path(g, s, t, least)
        if path is None:
            break
        flow = min(g[a][b] for a, b in zip(path, path[1:]))
        for a, b in zip(path, path[1:]):
            g[a][b] -= flow
        total += flow
        out.append((path[1:-1], flow, total))
    return out


def greedy_acyclic(edges: Sequence[tuple[int, int, float]], s: int = -1, t: int = -2, least: float = EPS) -> list[tuple[list[int], float, float]]:
    """``greedy_decomposition`` of a graph whose edges lead from smaller to larger nodes (and from ``s``, to ``t``).

    The path that breadth first finds is, of those with fewest steps to the sink, the first by its
    children's ranks. So the steps that are left to the sink are held for every node and mended where
    edges are used up, and a path costs its own nodes and not the whole graph."""
    g, none = build(edges), 1 << 60
    into: dict[int, list[int]] = defaultdict(list)
    for u, x in g.items():
        for v in x:
            into[v].append(u)
    steps: dict[int, int] = {t: 0}

    def nearest(u: int) -> int:
        return min((steps.get(v, none) for v, c in g[u].items() if c >= least and c > EPS), default=none)

    for u in sorted((n for n in g if n not in (s, t)), reverse=True):
        if (k := nearest(u)) < none:
            steps[u] = k + 1
    heads = g.get(s, {})
    first = [(steps[v], -c, v) for v, c in heads.items() if v in steps and c >= least and c > EPS]
    heapify(first)
    out, total = [], 0.0
    while first:
        k, c, v = first[0]
        if steps.get(v, none) != k or heads[v] != -c:
            heappop(first)
            continue
        path = [s, v]
        while v != t:
            k -= 1
            v = min((-c, w) for w, c in g[v].items() if c >= least and c > EPS and steps.get(w, none) == k)[1]
            path.append(v)
        flow = min(g[a][b] for a, b in zip(path, path[1:]))
        todo: list[int] = []
        for a, b in zip(path, path[1:]):
            c = g[a][b] = g[a][b] - flow
            if a == s and c >= least and c > EPS:
                heappush(first, (steps[b], -c, b))
            elif a != s and not (c >= least and c > EPS):
                heappush(todo, -a)
        while todo:
            u = -heappop(todo)
            old, k = steps.get(u, none), min(nearest(u) + 1, none)
            if k == old:
                continue
            steps[u] = k
            for a in into[u]:
                c = g[a][u]
                if c >= least and c > EPS:
                    if a != s:
                        if steps.get(a, none) == old + 1:
                            heappush(todo, -a)
                    elif k < none:
                        heappush(first, (k, -c, u))
        total += flow
        out.append((path[1:-1], flow, total))
    return out


def interval_flow(pieces: Sequence[tuple[int, int, float]], size: int) -> tuple[float, dict[tuple[int, int], float]]:
    """``max_flow`` from 0 to ``size`` over pieces (a, b, weight) with a < b and free steps back: value and flow of the pieces."""
    cap: dict[tuple[int, int], float] = defaultdict(float)
    for a, b, w in pieces:
        cap[a, b] += w
    for k in range(size):
        cap[k, k + 1] += 0.0  # steps back never fill up, and can be taken back
    adj: list[list[int]] = [[k - 1] if k else [] for k in range(size + 1)]
    for a, b in cap:
        adj[a].append(b)
        if b - a > 1:
            adj[b].append(a)
    for x in adj:
        x.sort()
    room = dict(cap)  # what is left of a piece; flow that can be sent back
    for a, b in cap:
        if b - a > 1:
            room[b, a] = 0.0
    total = 0.0
    while True:
        back = [-1] * (size + 1)
        back[0], todo = 0, [0]
        for u in todo:
            for v in adj[u]:
                if back[v] < 0 and (v == u - 1 or room[u, v] > EPS):
                    back[v] = u
                    if v == size:
                        break
                    todo.append(v)
            if back[size] >= 0:
                break
        if back[size] < 0:
            return total, {e: c - room[e] for e, c in cap.items() if c - room[e] > EPS}
        path, v = [], size
        while v:
            path.append((back[v], v))
            v = back[v]
        step = min(room[e] for e in path if e[0] < e[1] or e[0] - e[1] > 1)
        for a, b in path:
            if (a, b) in room:
                room[a, b] -= step
            if (b, a) in room:
                room[b, a] += step
        total += step


def max_flow(edges: Sequence[tuple[int, int, float]], s: int = -1, t: int = -2) -> tuple[float, dict[tuple[int, int], float]]:
    """Maximum flow by shortest augmenting paths: value and flow per edge."""
    cap, adj = defaultdict(float), defaultdict(set)
    for u, v, c in edges:
        cap[u, v] += c
        adj[u].add(v)
        adj[v].add(u)
    flow: dict[tuple[int, int], float] = defaultdict(float)
    total = 0.0
    while True:
        back, todo = {s: s}, deque([s])
        while todo and t not in back:
            u = todo.popleft()
            for v in sorted(adj[u]):
                if v not in back and cap[u, v] - flow[u, v] > EPS:
                    back[v] = u
                    todo.append(v)
        if t not in back:
            return total, {e: f for e, f in flow.items() if f > EPS}
        path = [t]
        while path[-1] != s:
            path.append(back[path[-1]])
        path.reverse()
        step = min(cap[a, b] - flow[a, b] for a, b in zip(path, path[1:]))
        for a, b in zip(path, path[1:]):
            flow[a, b] += step
            flow[b, a] -= step
        total += step


def topological(g: Graph) -> list[int]:
    """Order of an acyclic graph, smaller nodes first among equals; raises on a cycle."""
    import heapq

    nodes = set(g) | {v for x in g.values() for v in x}
    into = {n: 0 for n in nodes}
    for x in g.values():
        for v in x:
            into[v] += 1
    free = [n for n, k in into.items() if not k]
    heapq.heapify(free)
    out = []
    while free:
        u = heapq.heappop(free)
        out.append(u)
        for v in g.get(u, {}):
            into[v] -= 1
            if not into[v]:
                heapq.heappush(free, v)
    if len(out) < len(nodes):
        raise ValueError("the graph has a cycle")
    return out


def reachable(g: Graph) -> dict[int, int]:
    """Nodes reachable from each node, as bit sets over the topological order (bit 0: the first)."""
    order = topological(g)
    bit = {n: 1 << i for i, n in enumerate(order)}
    out: dict[int, int] = {}
    for u in reversed(order):
        m = 0
        for v in g.get(u, {}):
            m |= bit[v] | out[v]
        out[u] = m
    return out


def undirected_components(g: Graph, without: Sequence[int] = ()) -> list[set[int]]:
    """Components of the graph without some nodes, by smallest member."""
    skip, adj = set(without), defaultdict(set)
    for u, x in g.items():
        for v in x:
            if u not in skip and v not in skip:
                adj[u].add(v)
                adj[v].add(u)
    nodes = (set(g) | {v for x in g.values() for v in x}) - skip
    out = []
    while nodes:
        start = min(nodes)
        part, todo = {start}, [start]
        while todo:
            for v in adj[todo.pop()]:
                if v not in part:
                    part.add(v)
                    todo.append(v)
        nodes -= part
        out.append(part)
    return out


def compact(g: Graph, contiguous: set[tuple[int, int]]) -> dict[int, int]:
    """Head of the maximal chain of contiguous one-in one-out links each node belongs to."""
    into = defaultdict(int)
    for x in g.values():
        for v in x:
            into[v] += 1
    head: dict[int, int] = {}
    for u in topological(g):
        head.setdefault(u, u)
        if len(g.get(u, {})) == 1:
            (v,) = g[u]
            if into[v] == 1 and (u, v) in contiguous:
                head[v] = head[u]
    return head


def prune(weights: dict[int, float], most: int) -> set[int]:
    """The ``most`` heaviest nodes (ties: smaller)."""
    return set(sorted(weights, key=lambda n: (-weights[n], n))[:most])


def absorb_subpaths(paths: Sequence[tuple[tuple[int, ...], float]]) -> list[tuple[tuple[int, ...], float]]:
    """Paths by length then weight; a path that is a contiguous part of kept ones gives
    its weight to them in proportion to theirs (ties: the order of the nodes)."""
    kept: list[list] = []
    for nodes, w in sorted(paths, key=lambda x: (-len(x[0]), -x[1], x[0])):
        k = len(nodes)
        hosts = [h for h in kept if any(tuple(h[0][i : i + k]) == nodes for i in range(len(h[0]) - k + 1))]
        total = sum(h[2] for h in hosts)
        if hosts and total > 0:
            for h in hosts:
                h[1] += w * h[2] / total
        else:
            kept.append([nodes, w, w])
    return [(tuple(h[0]), h[1]) for h in kept]


def split_chimeric(nodes: Sequence[int], coverage: Sequence[float], share: float = 0.01) -> list[list[int]]:
    """A path of four or more nodes split at its deepest interior node below ``share`` of
    both neighbours and of the median; both parts keep the weight."""
    if len(nodes) < 4:
        return [list(nodes)]
    mid = sorted(coverage)[len(coverage) // 2]
    low = [
        (coverage[i], i)
        for i in range(1, len(nodes) - 1)
        if coverage[i] < share * min(coverage[i - 1], coverage[i + 1]) and coverage[i] < share * mid
    ]
    if not low:
        return [list(nodes)]
    i = min(low)[1]
    return [list(nodes[:i]), list(nodes[i + 1 :])]


def best_match(path: Sequence[int], kept: Sequence[Sequence[int]]) -> list[int]:
    """X11: indexes of kept paths that share most nodes, then have fewest foreign ones; ties share."""
    own = set(path)
    scored = [((-len(own & set(k)), len(set(k) - own)), i) for i, k in enumerate(kept) if own & set(k)]
    return [i for s, i in scored if s == min(x[0] for x in scored)] if scored else []


# the same, per graph of a DataFrame ------------------------------------------


def _edges(rows: Rows) -> list[tuple[int, int, float]]:
    return [(r["u"], r["v"], r["capacity"]) for r in rows]


def decompose(capacities: DataFrame, keys: Sequence[str], least: float = EPS, most: int | None = None) -> DataFrame:
    """Greedy decomposition of every graph: keys, iter_idx, path, bottleneck, total_flow_after."""

    def run(rows: Rows):
        own = [rows[0][k] for k in keys]
        for i, (path, flow, total) in enumerate(greedy_decomposition(_edges(rows), least=least, most=most), 1):
            yield (*own, i, path, flow, total)

    schema = f"{key_schema(capacities, keys)}, iter_idx int, path array<bigint>, bottleneck double, total_flow_after double"
    return fold_groups(capacities, keys, ["u", "v"], run, schema)


def flow_values(capacities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Maximum flow of every graph."""

    def run(rows: Rows):
        yield (*[rows[0][k] for k in keys], max_flow(_edges(rows))[0])

    return fold_groups(capacities, keys, ["u", "v"], run, f"{key_schema(capacities, keys)}, max_flow double")


def longest_path(g: Graph) -> int:
    """Most inner nodes on a path to the sink; -1 if the graph has a cycle."""
    try:
        order = topological(g)
    except ValueError:
        return -1
    depth: dict[int, int] = {}
    for u in order:
        d = depth.setdefault(u, 0) + (u >= 0)
        for v in g.get(u, {}):
            depth[v] = max(depth.get(v, 0), d)
    return depth.get(-2, 0)


def graph_stats(capacities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nodes, edges, components without source and sink, longest path in nodes."""

    def run(rows: Rows):
        g = build(_edges(rows))
        inner = (set(g) | {v for x in g.values() for v in x}) - {-1, -2}
        yield (*[rows[0][k] for k in keys], len(inner), len(rows), len(undirected_components(g, (-1, -2))), longest_path(g))

    schema = f"{key_schema(capacities, keys)}, n_nodes int, n_edges int, n_parts int, longest_path int"
    return fold_groups(capacities, keys, ["u", "v"], run, schema)


def absorb(paths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Contiguous sub-paths absorbed, per graph: keys, path, abundance."""

    def run(rows: Rows):
        for nodes, w in absorb_subpaths([(tuple(r["path"]), r["abundance"]) for r in rows]):
            yield (*[rows[0][k] for k in keys], list(nodes), w)

    return fold_groups(paths, keys, ["path"], run, f"{key_schema(paths, keys)}, path array<bigint>, abundance double")
