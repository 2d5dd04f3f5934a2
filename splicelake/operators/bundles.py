"""Graph algorithms of ``structures`` and ``graphs`` applied to every bundle of a table.

Whatever looks at one edge or node at a time is relational; what walks along a graph is a
fold over the distinct nodes, edges or paths of a bundle. Node names are numbers that
ascend along the genome; -1 and -2 are source and sink.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splicelake.operators import graphs as G
from splicelake.operators import structures as S
from splicelake.operators.folding import Rows, fold_groups, key_schema
from splicelake.operators.ranges import range_coverage

PATH = "array<bigint>"


def _own(rows: Rows, keys: Sequence[str]) -> list:
    return [rows[0][k] for k in keys]


# nodes and edges, relational ----------------------------------------------------------------


def prune_nodes(nodes: DataFrame, keys: Sequence[str], weight: str, most: int) -> DataFrame:
    """Nodes of a bundle with keep: the ``most`` heaviest (ties: the smaller node)."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(weight), "node")
    return nodes.withColumn("keep", F.row_number().over(w) <= most)


def cut_nodes(nodes: DataFrame, cuts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nodes (keys, start, end) cut at the positions (keys, pos) inside them."""
    from splicelake.operators.ranges import overlap_join

    keys = list(keys)
    n = nodes.select(*keys, "start", "end").distinct()
    at = cuts.select(*keys, F.col("pos").alias("start"), (F.col("pos") + 1).alias("end")).distinct()
    hit = overlap_join(n, at, keys).where("r_start > start").groupBy(*keys, "start", "end").agg(F.array_sort(F.collect_set("r_start")).alias("c"))
    x = n.join(hit, [*keys, "start", "end"], "left").withColumn("c", F.coalesce("c", F.array().cast(PATH)))
    parts = F.zip_with(F.concat(F.array("start"), F.col("c")), F.concat(F.col("c"), F.array("end")), lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    return x.select(*keys, F.col("start").alias("node"), F.explode(parts).alias("p")).select(*keys, "node", "p.start", "p.end")


def boundary_contrast(points: DataFrame, segments: DataFrame, keys: Sequence[str], window: int = 50, least: float = 0.0) -> DataFrame:
    """(right - left) / (.5 * window) of the coverage beside each position (keys, pos), and whether
    it reaches ``least`` in size."""
    keys = list(keys)
    side = F.explode(F.array(F.struct(F.lit("l").alias("s"), (F.col("pos") - window).alias("start"), F.col("pos").alias("end")), F.struct(F.lit("r").alias("s"), F.col("pos").alias("start"), (F.col("pos") + window).alias("end"))))
    r = points.select(*keys, "pos").distinct().select(*keys, "pos", side.alias("w")).select(*keys, "pos", "w.*")
    c = range_coverage(segments, r, keys, [*keys, "pos", "s"])
    both = c.groupBy(*keys, "pos").agg(*[F.max(F.when(F.col("s") == n, F.col("cov_sum"))).alias(n) for n in ("l", "r")])
    x = both.select(*keys, "pos", ((F.col("r") - F.col("l")) / (0.5 * window)).alias("contrast"))
    return x.withColumn("kept", F.abs("contrast") >= least)


def terminal_edges(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], share: float = 0.05) -> DataFrame:
    """Edges from the source (u = -1) to nodes whose parents together have less than ``share`` of
    their coverage, and to the sink (v = -2) from nodes whose children have, weighted half the difference.
    ``nodes``: keys, node, cov; ``edges``: keys, u, v."""
    keys = list(keys)
    made = []
    for own, other, end in (("v", "u", "source"), ("u", "v", "sink")):
        near = edges.select(*keys, F.col(own).alias("node"), F.col(other).alias("o")).distinct()
        near = near.join(nodes.select(*keys, F.col("node").alias("o"), "cov"), [*keys, "o"]).groupBy(*keys, "node").agg(F.sum("cov").alias("near"))
        x = nodes.select(*keys, "node", "cov").join(near, [*keys, "node"], "left").withColumn("near", F.coalesce("near", F.lit(0.0)))
        x = x.where(F.col("near") < F.col("cov") * F.lit(share))
        made.append(x.select(*keys, F.lit(end).alias("end"), "node", ((F.col("cov") - F.col("near")) / 2).alias("weight")))
    return made[0].unionByName(made[1])


def hard_ends(paths: DataFrame, keys: Sequence[str], least: int = 8) -> DataFrame:
    """Nodes at which ``least`` tails or more end: keys, node, hard_start, hard_end.
    ``paths``: keys, path, head_tails, end_tails."""
    a = paths.select(*keys, F.get("path", F.lit(0)).alias("node"), F.col("head_tails").alias("a"), F.lit(0).cast("long").alias("b"))
    b = paths.select(*keys, F.try_element_at("path", F.lit(-1)).alias("node"), F.lit(0).cast("long").alias("a"), F.col("end_tails").alias("b"))
    g = a.unionByName(b).groupBy(*keys, "node").agg((F.sum("a") >= least).alias("hard_start"), (F.sum("b") >= least).alias("hard_end"))
    return g.where("hard_start OR hard_end")


def edit_edges(edges: DataFrame, add: DataFrame, remove: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct edges (keys, u, v) without those to remove, with those to add."""
    cols = [*keys, "u", "v"]
    kept = edges.select(*cols).distinct().join(remove.select(*cols).distinct(), cols, "left_anti")
    return kept.unionByName(add.select(*cols)).distinct()


# walks ----------------------------------------------------------------------------------------


def _edges(rows: Rows) -> list[tuple[int, int, float]]:
    return [(r["u"], r["v"], r["capacity"]) for r in rows]


def _fold_edges(capacities: DataFrame, keys: Sequence[str], run, cols: str) -> DataFrame:
    return fold_groups(capacities, keys, ["u", "v"], run, f"{key_schema(capacities, keys)}, {cols}")


def reachability(capacities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys, node, n_reachable: how many other inner nodes a node leads to. Cycles do no harm."""

    def run(rows: Rows):
        g = {u: set(x) for u, x in G.build(_edges(rows)).items()}
        for s in sorted({n for r in rows for n in (r["u"], r["v"]) if n >= 0}):
            seen, todo = set(), [s]
            while todo:
                new = g.get(todo.pop(), set()) - seen
                seen |= new
                todo += new
            yield (*_own(rows, keys), s, len({n for n in seen if n >= 0} - {s}))

    return _fold_edges(capacities, keys, run, "node bigint, n_reachable int")


def components(capacities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys, node, part (its smallest node), without source and sink."""

    def run(rows: Rows):
        for part in G.undirected_components(G.build(_edges(rows)), (-1, -2)):
            for n in sorted(part):
                yield (*_own(rows, keys), n, min(part))

    return _fold_edges(capacities, keys, run, "node bigint, part bigint")


def compact_chains(capacities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys, node, head: the first node of the chain of neighbours (v = u + 1) with one way in and out."""

    def run(rows: Rows):
        out, into = defaultdict(set), defaultdict(set)
        for u, v, _ in _edges(rows):
            out[u].add(v)
            into[v].add(u)
        head: dict[int, int] = {}
        for n in sorted({n for n in (*out, *into) if n >= 0}):
            joins = n - 1 in into[n] and len(into[n]) == 1 and len(out[n - 1]) == 1 and n > 0
            head[n] = head[n - 1] if joins else n
            yield (*_own(rows, keys), n, head[n])

    return _fold_edges(capacities, keys, run, "node bigint, head bigint")


def drop_nodes(capacities: DataFrame, keys: Sequence[str], gone: Column) -> DataFrame:
    """Nodes dropped (``gone``: a condition on the column ``node``), their neighbours joined:
    keys, u, v of the edges that are left. An edge whose ends stay stays."""
    marked = capacities.withColumn("node", F.col("u")).withColumn("__gu", gone & (F.col("u") >= 0))
    marked = marked.withColumn("node", F.col("v")).withColumn("__gv", gone & (F.col("v") >= 0)).drop("node")

    def run(rows: Rows):
        g = G.build(_edges(rows))
        lost = {r["u"] for r in rows if r["__gu"]} | {r["v"] for r in rows if r["__gv"]}
        made = set()
        for u in sorted(set(g) - lost):
            seen, todo = set(), [u]
            while todo:
                for v in g.get(todo.pop(), {}):
                    if v not in seen:
                        seen.add(v)
                        if v in lost:
                            todo.append(v)
                        elif v != u:
                            made.add((u, v))
        for u, v in sorted(made):
            yield (*_own(rows, keys), u, v)

    return _fold_edges(marked, keys, run, "u bigint, v bigint")


def path_counts(capacities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys, n_paths (from source to sink, as a decimal number of any size in text) and widest: the
    largest smallest capacity of one (T18). No path is enumerated; a graph with a cycle has null."""

    def run(rows: Rows):
        g = G.build(_edges(rows))
        try:
            order = G.topological(g)
        except ValueError:
            yield (*_own(rows, keys), None, None)
            return
        ways, wide = {-1: 1}, {-1: float("inf")}
        for u in order:
            for v, c in g.get(u, {}).items() if u in ways else ():
                ways[v] = ways.get(v, 0) + ways[u]
                wide[v] = max(wide.get(v, 0.0), min(wide[u], c))
        yield (*_own(rows, keys), str(ways.get(-2, 0)), wide.get(-2))

    return _fold_edges(capacities, keys, run, "n_paths string, widest double")


def sink_within(capacities: DataFrame, nodes: DataFrame, keys: Sequence[str], anchor: int) -> DataFrame:
    """Keys, node, near: whether a way of at most ``anchor`` bases behind a node leads to the sink.
    ``nodes``: keys, node, start, end; unknown nodes have no length."""
    n = nodes.select(*keys, F.col("node").alias("v"), (F.col("end") - F.col("start")).alias("len")).distinct()
    e = capacities.select(*keys, "u", "v", "capacity").join(n, [*keys, "v"], "left").withColumn("len", F.coalesce("len", F.lit(0)))

    def run(rows: Rows):
        import heapq

        g, size = G.build(_edges(rows)), {r["v"]: r["len"] for r in rows}
        for s in sorted({r["v"] for r in rows if r["v"] >= 0}):
            best, todo, near = {s: 0}, [(0, s)], False
            while todo and not near:
                l, u = heapq.heappop(todo)
                for v in g.get(u, {}) if l <= best.get(u, l) else ():
                    k = l + (size.get(v, 0) if v >= 0 else 0)
                    if k <= anchor and k < best.get(v, anchor + 1):
                        near = near or v == -2
                        best[v] = k
                        heapq.heappush(todo, (k, v))
            yield (*_own(rows, keys), s, near)

    return _fold_edges(e, keys, run, "node bigint, near boolean")


# paths ------------------------------------------------------------------------------------------


def split_segments(paths: DataFrame, edges: DataFrame, keys: Sequence[str], ident: str) -> DataFrame:
    """Paths cut where two neighbours are no edge: ident, part (from 0), path.
    ``paths``: keys, ident, path; ``edges``: keys, u, v."""
    keys = list(keys)
    x = paths.select(*keys, ident, F.posexplode("path").alias("i", "v"))
    w = Window.partitionBy(ident).orderBy("i")
    x = x.withColumn("u", F.lag("v").over(w)).join(edges.select(*keys, "u", "v", F.lit(1).alias("__e")).distinct(), [*keys, "u", "v"], "left")
    brk = F.when(F.col("u").isNull() | F.col("__e").isNotNull(), 0).otherwise(1)
    x = x.withColumn("part", F.sum(brk).over(w))
    return x.groupBy(*keys, ident, "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("path"))


def _node_maps(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nodes of a bundle as one array: keys, n (struct of node, start, end, cov)."""
    return nodes.groupBy(*keys).agg(F.collect_set(F.struct("node", "start", "end", "cov")).alias("n"))


def _per_path(paths: DataFrame, nodes: DataFrame, keys: Sequence[str], ident: str, run, cols: str) -> DataFrame:
    """``run(row, start, end, cov)`` on every path of a bundle whose nodes are all known."""
    keys = list(keys)
    p = paths.select(*keys, F.col(ident).alias("__id"), "path", F.lit(None).cast("bigint").alias("node"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end"), F.lit(None).cast("double").alias("cov"))
    n = nodes.select(*keys, F.lit(None).cast(p.schema["__id"].dataType).alias("__id"), F.lit(None).cast(PATH).alias("path"), "node", "start", "end", F.col("cov").cast("double").alias("cov")).distinct()
    both = n.unionByName(p).withColumn("__kind", F.col("path").isNotNull().cast("int"))

    def fold(rows: Rows):
        start, end, cov = {}, {}, {}
        for r in rows:
            if not r["__kind"]:
                start.setdefault(r["node"], r["start"])
                end.setdefault(r["node"], r["end"])
                cov.setdefault(r["node"], r["cov"] or 0.0)
            elif all(v in start for v in r["path"]):
                yield from ((*_own(rows, keys), r["__id"], *t) for t in run(tuple(r["path"]), start, end, cov))

    kind = p.schema["__id"].dataType.simpleString()
    return fold_groups(both, keys, ["__kind", "node", "start", "end", "__id"], fold, f"{key_schema(paths, keys)}, `{ident}` {kind}, {cols}")


def trim_ends(paths: DataFrame, nodes: DataFrame, keys: Sequence[str], ident: str, share: float = 0.1) -> DataFrame:
    """Weak terminal nodes of paths dropped: keys, ident, path. ``nodes``: keys, node, start, end, cov
    (of a node given twice the first by start and end counts); paths with an unknown node have no row."""

    def run(path, start, end, cov):
        # node names stand for positions here: a node ends at its neighbour where they touch
        named = {v: (w if end[v] == start[w] else v) for v, w in zip(path, path[1:])}
        yield (list(S.trim_weak_ends(path, {**{path[-1]: path[-1]}, **named}, cov, share)),)

    return _per_path(paths, nodes, keys, ident, run, f"path {PATH}")


def split_chimeric(paths: DataFrame, nodes: DataFrame, keys: Sequence[str], ident: str, share: float = 0.01) -> DataFrame:
    """Paths split at a deep interior node: keys, ident, part, path."""

    def run(path, start, end, cov):
        for i, part in enumerate(G.split_chimeric(path, [cov[v] for v in path], share)):
            yield i, part

    return _per_path(paths, nodes, keys, ident, run, f"part int, path {PATH}")


def _fold_paths(paths: DataFrame, keys: Sequence[str], run, cols: str) -> DataFrame:
    return fold_groups(paths, keys, ["path"], run, f"{key_schema(paths, keys)}, {cols}")


def _weighted(rows: Rows) -> list[tuple[tuple[int, ...], float]]:
    return [(tuple(r["path"]), r["abundance"]) for r in rows]


def recombined(paths: DataFrame, keys: Sequence[str], least: int = 2) -> DataFrame:
    """New paths from prefixes and suffixes of others: keys, path, abundance."""

    def run(rows: Rows):
        for p, w in S.recombine(_weighted(rows), least):
            yield (*_own(rows, keys), list(p), w)

    return _fold_paths(paths, keys, run, f"path {PATH}, abundance double")


def merged(paths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """M2-M4: sub-paths absorbed; keys, path, abundance, and whether a path is in the heaviest set
    without contradictions."""

    def run(rows: Rows):
        kept = G.absorb_subpaths(_weighted(rows))
        from splicelake.operators.assembly import same_outer

        clash = {(i, j) for i in range(len(kept)) for j in range(i) if same_outer(kept[i][0], kept[j][0])}
        _, best = S.max_compatible({i: w for i, (_, w) in enumerate(kept)}, clash)
        for i, (p, w) in enumerate(kept):
            yield (*_own(rows, keys), list(p), w, i in set(best))

    return _fold_paths(paths, keys, run, f"path {PATH}, abundance double, kept boolean")


def guide_abundance(nodes: DataFrame, guides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coverage of nodes dealt to the guides (distinct paths) that hold them: keys, path, abundance.
    ``nodes``: keys, node, cov; ``guides``: keys, path."""
    keys = list(keys)
    n = nodes.select(*keys, "node", F.col("cov").cast("double").alias("cov"), F.lit(None).cast(PATH).alias("path")).where("cov IS NOT NULL")
    g = guides.select(*keys, F.lit(None).cast("bigint").alias("node"), F.lit(None).cast("double").alias("cov"), "path").distinct()

    def run(rows: Rows):
        cov: dict[int, float] = {}
        for r in rows:
            if r["path"] is None:
                cov[r["node"]] = max(cov.get(r["node"], 0.0), r["cov"])
        paths = sorted(tuple(r["path"]) for r in rows if r["path"])
        got = S.guide_shares(cov, {p: p for p in paths}) if paths else {}
        for p in paths:
            yield (*_own(rows, keys), list(p), got[p])

    return fold_groups(n.unionByName(g), keys, ["node", "path"], run, f"{key_schema(guides, keys)}, path {PATH}, abundance double")
