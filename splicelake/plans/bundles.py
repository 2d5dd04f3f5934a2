"""Queries over the graphs of bundles. Each stands beside its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splicelake.operators import bundles as B
from splicelake.operators import graphs as G
from splicelake.operators import ranges as RG
from splicelake.plans import lifts
from splicelake.plans import loci_sql as Q
from splicelake.plans.lifts import BUNDLE
from splicelake.plans.registry import Registry
from splicelake.session import cut
from splicelake.sources.tables import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
W = Q.w
K = Q.B
EQ = Q._FB.format
EDGES = Q.FLOW + f", fq AS (SELECT {K}, w, p, list_concat([-1::BIGINT], p, [-2::BIGINT]) AS q FROM flow), ed AS (SELECT {K}, q[i] AS u, q[i + 1] AS v, sum(w) AS c FROM (SELECT *, unnest(range(1, len(q))) AS i FROM fq) GROUP BY {K}, q[i], q[i + 1])"
NODE = f'nd AS (SELECT {K}, node_idx::BIGINT AS node, min(start) AS start, min("end") AS "end", max(cov) AS cov FROM nodes WHERE chrom IS NOT NULL AND node_idx IS NOT NULL AND start < "end" AND cov IS NOT NULL GROUP BY ALL)'
QK = ", ".join(f"{{0}}.{c}" for c in K.split(", "))


def _text(c: str = "path"):
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


def _capacities(spark: SparkSession, d: str) -> DataFrame:
    return G.edge_capacities(lifts.flow_paths(spark, d), BUNDLE)


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "nodes").where("chrom IS NOT NULL AND node_idx IS NOT NULL AND start < end AND cov IS NOT NULL")
    return x.groupBy(*BUNDLE, F.col("node_idx").cast("long").alias("node")).agg(F.min("start").alias("start"), F.min("end").alias("end"), F.max("cov").alias("cov"))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return lifts.flow_paths(spark, d).groupBy(*BUNDLE, "path").agg(F.sum("abundance").alias("abundance"))


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    """Distinct paths named by bundle and nodes."""
    return _paths(spark, d).withColumn("pid", F.concat_ws("/", *BUNDLE, F.array_join(F.col("path").cast("array<string>"), ",")))


def _inner(spark: SparkSession, d: str) -> DataFrame:
    """Named paths without their first and last node, which stand for source and sink."""
    x = _numbered(spark, d).where(F.size("path") > 2)
    return x.withColumn("path", F.slice("path", F.lit(2), F.size("path") - 2))


PID = "concat_ws('/', run_id, chrom, bdstart, bdend, strand, array_to_string(p, ','))"
DPATH = Q.FLOW + f", dp AS (SELECT DISTINCT {K}, p[2:len(p) - 1] AS p, {PID} AS pid FROM flow WHERE len(p) > 2)"


@R.query(W(NODE, f"SELECT {K}, node, row_number() OVER (PARTITION BY {K} ORDER BY cov DESC, node) <= 3 AS keep FROM nd"))
def pruned_nodes(spark: SparkSession, d: str) -> DataFrame:
    return B.prune_nodes(_nodes(spark, d), BUNDLE, "cov", 3).select(*BUNDLE, "node", "keep")


@R.query(
    W(
        f'n AS (SELECT DISTINCT {K}, start AS s, "end" AS e FROM nodes WHERE chrom IS NOT NULL AND start < "end"), c AS (SELECT DISTINCT n.*, o.s AS p FROM n JOIN n o ON {EQ(x="n", y="o")} AND o.s > n.s AND o.s < n.e), a AS (SELECT {K}, s, e, p FROM c UNION SELECT {K}, s, e, unnest([s, e]) FROM n)',
        f'SELECT {K}, s AS node, p AS start, nx AS "end" FROM (SELECT *, lead(p) OVER (PARTITION BY {K}, s, e ORDER BY p) AS nx FROM a) WHERE nx IS NOT NULL',
    )
)
def cut_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes cut at the starts of others inside them."""
    n = table(spark, d, "nodes").where("chrom IS NOT NULL AND start < end")
    return B.cut_nodes(n, n.select(*BUNDLE, F.col("start").alias("pos")), BUNDLE)


@R.query(
    W(
        Q.READS + f""", seg AS ({Q._segments('exon', 'chrom')}), pt AS (SELECT DISTINCT chrom, start AS pos FROM nodes WHERE chrom IS NOT NULL AND start IS NOT NULL),
l AS (SELECT pt.chrom, pos, coalesce(sum((least(pos, g."end") - greatest(pos - 50, g.start)) * g.depth) FILTER (g.start < pos AND g."end" > pos - 50), 0) AS l,
  coalesce(sum((least(pos + 50, g."end") - greatest(pos, g.start)) * g.depth) FILTER (g.start < pos + 50 AND g."end" > pos), 0) AS r FROM pt LEFT JOIN seg g ON g.chrom = pt.chrom AND g.start < pos + 50 AND g."end" > pos - 50 GROUP BY ALL)""",
        "SELECT chrom, pos, round((r - l) / 25, 6) AS contrast, abs(r - l) / 25 >= 1 AS kept FROM l",
    )
)
def boundary_contrast(spark: SparkSession, d: str) -> DataFrame:
    seg = cut(RG.coverage_segments(lifts.exon_rows(lifts.reads(spark, d)), ["chrom"]))
    pt = table(spark, d, "nodes").where("chrom IS NOT NULL AND start IS NOT NULL").select("chrom", F.col("start").alias("pos"))
    return B.boundary_contrast(pt, seg, ["chrom"], 50, 1.0).withColumn("contrast", F.round("contrast", 6))


@R.query(
    W(
        EDGES + "," + NODE + f", de AS (SELECT DISTINCT {K}, u, v FROM ed), a AS (SELECT {QK.format('nd')}, nd.node, nd.cov, coalesce(sum(o.cov), 0) AS near FROM nd LEFT JOIN de ON {EQ(x='nd', y='de')} AND de.v = nd.node LEFT JOIN nd o ON {EQ(x='o', y='de')} AND o.node = de.u GROUP BY ALL), "
        + f"b AS (SELECT {QK.format('nd')}, nd.node, nd.cov, coalesce(sum(o.cov), 0) AS near FROM nd LEFT JOIN de ON {EQ(x='nd', y='de')} AND de.u = nd.node LEFT JOIN nd o ON {EQ(x='o', y='de')} AND o.node = de.v GROUP BY ALL)",
        f"SELECT {K}, 'source' AS \"end\", node, round(cov - near, 4) AS twice FROM a WHERE near < cov * 0.05::DOUBLE UNION ALL SELECT {K}, 'sink', node, round(cov - near, 4) FROM b WHERE near < cov * 0.05::DOUBLE",
    )
)
def terminal_edges(spark: SparkSession, d: str) -> DataFrame:
    x = B.terminal_edges(_nodes(spark, d), _capacities(spark, d), BUNDLE)
    return x.select(*BUNDLE, "end", "node", F.round(F.col("weight") * 2, 4).alias("twice"))


@R.query(W(Q.FLOW + f", t AS (SELECT {K}, p[1] AS node, floor(w)::BIGINT AS a, 0 AS b FROM flow UNION ALL SELECT {K}, p[len(p)], 0, len(p) FROM flow)", f"SELECT {K}, node, sum(a) >= 8 AS hard_start, sum(b) >= 8 AS hard_end FROM t GROUP BY {K}, node HAVING sum(a) >= 8 OR sum(b) >= 8"))
def hard_ends(spark: SparkSession, d: str) -> DataFrame:
    """Nodes where tails pile up (here the weight of paths at their heads, their lengths at their ends)."""
    p = lifts.flow_paths(spark, d).withColumn("head_tails", F.floor("abundance")).withColumn("end_tails", F.size("path").cast("long"))
    return B.hard_ends(p, BUNDLE)


@R.query(
    W(
        EDGES + f", x AS (SELECT {K}, u, v FROM ed WHERE c >= 5), y AS (SELECT {K}, -1 AS u, v FROM ed WHERE u = 0)",
        f"SELECT DISTINCT {K}, u, v FROM (SELECT * FROM (SELECT {K}, u, v FROM ed EXCEPT SELECT * FROM (SELECT {K}, u, v FROM ed WHERE c < 5)) UNION ALL SELECT {K}, u::BIGINT, v FROM y)",
    )
)
def edited_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges without the weak ones, with edges from the source past node 0."""
    c = cut(_capacities(spark, d))
    return B.edit_edges(c, c.where("u = 0").withColumn("u", F.lit(-1).cast("long")), c.where("capacity < 5"), BUNDLE)


@R.query(
    W(
        "RECURSIVE " + EDGES + f", r AS (SELECT {K}, u, v FROM ed WHERE u >= 0 AND v >= 0 UNION SELECT {QK.format('r')}, r.u, ed.v FROM r JOIN ed ON {EQ(x='r', y='ed')} AND r.v = ed.u WHERE ed.v >= 0), n AS (SELECT DISTINCT {K}, unnest(p) AS node FROM flow)",
        f"SELECT {QK.format('n')}, n.node, count(r.v)::INT AS n_reachable FROM n LEFT JOIN r ON {EQ(x='n', y='r')} AND r.u = n.node AND r.v <> n.node GROUP BY ALL",
    )
)
def reachable_nodes(spark: SparkSession, d: str) -> DataFrame:
    return B.reachability(_capacities(spark, d), BUNDLE)


@R.query(
    W(
        "RECURSIVE " + EDGES + f", l AS (SELECT {K}, u, v FROM ed WHERE u >= 0 AND v >= 0 UNION ALL SELECT {K}, v, u FROM ed WHERE u >= 0 AND v >= 0), n AS (SELECT DISTINCT {K}, unnest(p) AS node FROM flow), r AS (SELECT {K}, node AS u, node AS v FROM n UNION SELECT {QK.format('r')}, r.u, l.v FROM r JOIN l ON {EQ(x='r', y='l')} AND r.v = l.u)",
        f"SELECT {K}, u AS node, min(v) AS part FROM r GROUP BY {K}, u",
    )
)
def graph_parts(spark: SparkSession, d: str) -> DataFrame:
    return B.components(_capacities(spark, d), BUNDLE)


@R.query(
    W(
        EDGES
        + f""", n AS (SELECT DISTINCT {K}, unnest(p) AS node FROM flow), i AS (SELECT {K}, v, count(*) AS k, min(u) AS u FROM ed GROUP BY {K}, v), o AS (SELECT {K}, u, count(*) AS k FROM ed GROUP BY {K}, u),
j AS (SELECT n.*, coalesce(i.k = 1 AND i.u = n.node - 1 AND o.k = 1 AND n.node > 0, false) AS joins FROM n LEFT JOIN i ON {EQ(x='n', y='i')} AND i.v = n.node LEFT JOIN o ON {EQ(x='n', y='o')} AND o.u = n.node - 1)""",
        f"SELECT {K}, node, max(CASE WHEN NOT joins THEN node END) OVER (PARTITION BY {K} ORDER BY node) AS head FROM j",
    )
)
def compacted_chains(spark: SparkSession, d: str) -> DataFrame:
    return B.compact_chains(_capacities(spark, d), BUNDLE)


@R.query(
    W(
        "RECURSIVE " + EDGES + f", g AS (SELECT {K}, u, v FROM ed WHERE u < 0 OR u % 3 <> 1 UNION SELECT {QK.format('g')}, g.u, ed.v FROM g JOIN ed ON {EQ(x='g', y='ed')} AND g.v = ed.u WHERE g.v >= 0 AND g.v % 3 = 1)",
        f"SELECT {K}, u, v FROM g WHERE (v < 0 OR v % 3 <> 1) AND u <> v",
    )
)
def dropped_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Every third node dropped, its neighbours joined."""
    return B.drop_nodes(_capacities(spark, d), BUNDLE, F.col("node") % 3 == 1)


@R.query(
    W(
        "RECURSIVE " + EDGES + f", g AS (SELECT {K}, v, c AS w FROM ed WHERE u = -1 UNION ALL SELECT {QK.format('g')}, ed.v, least(g.w, ed.c) FROM g JOIN ed ON {EQ(x='g', y='ed')} AND g.v = ed.u WHERE g.v >= 0)",
        f"SELECT {K}, count(*)::VARCHAR AS n_paths, round(max(w), 4) AS widest FROM g WHERE v = -2 GROUP BY {K}",
    )
)
def path_counts(spark: SparkSession, d: str) -> DataFrame:
    return B.path_counts(_capacities(spark, d), BUNDLE).withColumn("widest", F.round("widest", 4))


@R.query(
    W(
        EDGES + f", dp AS (SELECT DISTINCT {K}, p, {PID} AS pid FROM flow), x AS (SELECT dp.*, i, p[i] AS v, CASE WHEN i > 1 THEN p[i - 1] END AS u FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM dp) dp), y AS (SELECT x.*, CASE WHEN x.u IS NULL OR ed.c IS NOT NULL THEN 0 ELSE 1 END AS b FROM x LEFT JOIN ed ON {EQ(x='x', y='ed')} AND x.u = ed.u AND x.v = ed.v AND ed.c >= 5), z AS (SELECT *, sum(b) OVER (PARTITION BY pid ORDER BY i) AS part FROM y)",
        "SELECT pid, part::BIGINT AS part, string_agg(v, ',' ORDER BY i) AS path FROM z GROUP BY pid, part",
    )
)
def path_segments(spark: SparkSession, d: str) -> DataFrame:
    """Paths cut at edges of less than five."""
    c = _capacities(spark, d).where("capacity >= 5")
    return B.split_segments(_numbered(spark, d), c, BUNDLE, "pid").select("pid", "part", _text())


PN = f", pn AS (SELECT x.pid, x.i, x.v, nd.start AS s, nd.\"end\" AS e, nd.cov AS c, len(x.p) AS n FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS v FROM dp) x JOIN nd ON {EQ(x='x', y='nd')} AND nd.node = x.v), ok AS (SELECT pid, n, list(v ORDER BY i) AS v, list(s ORDER BY i) AS s, list(e ORDER BY i) AS e, list(c ORDER BY i) AS c FROM pn GROUP BY pid, n HAVING count(*) = n)"


@R.query(
    W(
        DPATH + "," + NODE + PN + """, a AS (SELECT *, coalesce(list_min(list_filter(range(1, n), lambda i: NOT (e[i] = s[i + 1] AND c[i] < 0.9::DOUBLE * c[i + 1]))), n) AS f FROM ok), b AS (SELECT *, coalesce(list_max(list_filter(range(f + 1, n + 1), lambda i: NOT (e[i - 1] = s[i] AND c[i] < 0.9::DOUBLE * c[i - 1]))), f) AS l FROM a)""",
        "SELECT pid, array_to_string(v[f:l], ',') AS path FROM b",
    )
)
def trimmed_paths(spark: SparkSession, d: str) -> DataFrame:
    """Terminal nodes dropped that touch a neighbour of more coverage (by a tenth)."""
    return B.trim_ends(_inner(spark, d), _nodes(spark, d), BUNDLE, "pid", 0.9).select("pid", _text())


@R.query(
    W(
        DPATH + "," + NODE + PN + """, a AS (SELECT *, list_sort(c)[n // 2 + 1] AS mid FROM ok), b AS (SELECT *, CASE WHEN n < 4 THEN NULL ELSE list_min(list_transform(list_filter(range(2, n), lambda i: c[i] < 0.5::DOUBLE * least(c[i - 1], c[i + 1]) AND c[i] < 0.5::DOUBLE * mid), lambda i: {'c': c[i], 'i': i})).i END AS k FROM a)""",
        "SELECT pid, 0 AS part, array_to_string(CASE WHEN k IS NULL THEN v ELSE v[1:k - 1] END, ',') AS path FROM b UNION ALL SELECT pid, 1, array_to_string(v[k + 1:n], ',') FROM b WHERE k IS NOT NULL",
    )
)
def chimeric_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths split at an interior node of less than half of both neighbours and of the median."""
    return B.split_chimeric(_inner(spark, d), _nodes(spark, d), BUNDLE, "pid", 0.5).select("pid", "part", _text())


@R.query()
def recombined_paths(spark: SparkSession, d: str) -> DataFrame:
    return B.recombined(_paths(spark, d), BUNDLE).select(*BUNDLE, _text(), F.round("abundance", 4).alias("abundance"))


@R.query()
def merged_paths(spark: SparkSession, d: str) -> DataFrame:
    return B.merged(_paths(spark, d), BUNDLE).select(*BUNDLE, _text(), F.round("abundance", 4).alias("abundance"), "kept")


@R.query()
def guide_abundance(spark: SparkSession, d: str) -> DataFrame:
    """Node coverage dealt to the paths of a bundle, taken as guides."""
    return B.guide_abundance(_nodes(spark, d), _paths(spark, d), BUNDLE).select(*BUNDLE, _text(), F.round("abundance", 3).alias("abundance"))
