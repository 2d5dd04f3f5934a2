"""SQL oracles of the queries in ``loci``."""

from __future__ import annotations

NEXT5 = "ggo19_needy_next5_run_strg_29"

# common table expressions -----------------------------------------------------------
READS = """
r0 AS (SELECT row_id, run_id, chrom, coalesce(strand, 0) AS strand, read_name,
    list_transform(regexp_extract_all(exons, '[0-9]+-[0-9]+'),
      lambda x: {'s': split_part(x, '-', 1)::BIGINT - 1, 'e': split_part(x, '-', 2)::BIGINT}) AS ex
  FROM aligned_reads WHERE chrom IS NOT NULL AND exons IS NOT NULL),
reads AS (SELECT *, ex[1].s AS s, ex[len(ex)].e AS e, 1::BIGINT AS w FROM r0 WHERE len(ex) > 0
  AND len(list_filter(ex, lambda x: x.s >= x.e)) = 0
  AND len(list_filter(range(1, len(ex)), lambda i: ex[i].e > ex[i + 1].s)) = 0),
exon AS (SELECT row_id, chrom, strand, u.i, u.x.s AS s, u.x.e AS e, len(ex) AS n, w, read_name
  FROM reads, LATERAL (SELECT unnest(ex) AS x, unnest(range(1, len(ex) + 1)) AS i) u),
junc AS (SELECT row_id, read_name, chrom, strand, w, u.i, ex[u.i].e AS donor, ex[u.i + 1].s AS acceptor, ex
  FROM reads, LATERAL (SELECT unnest(range(1, len(ex))) AS i) u)"""

STATS = (
    READS
    + """,
jx AS (SELECT *, CASE WHEN acceptor - donor > 100000 THEN 25 ELSE 10 END AS need,
    list_max(list_transform(ex[1:i], lambda x: x.e - x.s)) AS la, list_max(list_transform(ex[i + 1:], lambda x: x.e - x.s)) AS ra
  FROM junc WHERE acceptor - donor >= 20),
stats AS (SELECT chrom, strand, donor, acceptor, sum(w)::BIGINT AS mrcount,
    sum(CASE WHEN la >= need AND ra >= need THEN w ELSE 0 END)::BIGINT AS nreads_good,
    sum(CASE WHEN la >= need THEN w ELSE 0 END)::BIGINT AS leftsupport,
    sum(CASE WHEN ra >= need THEN w ELSE 0 END)::BIGINT AS rightsupport, 0::BIGINT AS nm, 0::BIGINT AS mm
  FROM jx GROUP BY ALL)"""
)
SITES = (
    STATS
    + """,
sites AS (SELECT chrom, strand, donor, acceptor, mrcount, nreads_good, nm,
    CASE WHEN donor = max(donor) OVER (PARTITION BY chrom, strand) THEN leftsupport
         ELSE sum(leftsupport) OVER (PARTITION BY chrom, strand, donor) END::BIGINT AS leftsupport,
    CASE WHEN acceptor = max(acceptor) OVER (PARTITION BY chrom, strand) THEN rightsupport
         ELSE sum(rightsupport) OVER (PARTITION BY chrom, strand, acceptor) END::BIGINT AS rightsupport FROM stats)"""
)
CHAIN = "list_transform(range(1, len(ex)), lambda i: {'d': ex[i].e, 'a': ex[i + 1].s})"
CHAIN_TEXT = "array_to_string(list_transform(chain, lambda j: j.d || '-' || j.a), ',')"
EXON_TEXT = "array_to_string(list_transform(ex, lambda x: x.s || '-' || x.e), ',')"


def _tx(name: str, src: str, keep: str = "true") -> str:
    return f"""
{name}_c AS (SELECT chrom, strand, {CHAIN} AS chain, min(row_id) AS tx_id, sum(w)::DOUBLE AS cov, min(s) AS s, max(e) AS e
  FROM {src} WHERE len(ex) > 1 AND {keep} GROUP BY ALL),
{name} AS (SELECT *, len(chain) + 1 AS n, list_transform(range(1, len(chain) + 2), lambda i: {{
    's': CASE WHEN i = 1 THEN s ELSE chain[i - 1].a END, 'e': CASE WHEN i = len(chain) + 1 THEN e ELSE chain[i].d END}}) AS ex FROM {name}_c)"""


TX = READS + "," + _tx("tx", "reads")


def _all(name: str, keep: str = "true") -> str:
    """All transcripts: chains, and each distinct single exon."""
    lone = f"SELECT chrom, strand, [] AS chain, min(row_id) AS tx_id, sum(w)::DOUBLE AS cov, s, e, 1 AS n, ex FROM reads WHERE len(ex) = 1 AND {keep} GROUP BY chrom, strand, s, e, ex"
    return f"{_tx(f'{name}_m', 'reads', keep)}, {name} AS (SELECT chrom, strand, chain, tx_id, cov, s, e, n, ex FROM {name}_m UNION ALL {lone})"


ALL = READS + "," + _all("tx")
_RAW = """,
raw AS (SELECT chrom, strand, ex, min(row_id) AS tx_id, sum(w)::BIGINT AS cov, ex[1].s AS s, ex[len(ex)].e AS e, len(ex) AS n
  FROM reads WHERE list_sum(list_transform(ex, lambda x: x.e - x.s)) >= 200 GROUP BY chrom, strand, ex)"""
RAW = READS + _RAW
_RUN = "CASE WHEN regexp_extract(coalesce(read_name, ''), '_s([0-9]+)/', 1) IN ('1', '2') THEN 0 ELSE 1 END"
# every seventh read keeps its introns of at most 2,500 bases
RETAINING = READS.replace("reads AS (SELECT", "reads0 AS (SELECT", 1).replace(
    "exon AS (",
    """rm AS (SELECT *, list_filter(range(1, len(ex)), lambda i: ex[i + 1].s - ex[i].e > 2500) AS b FROM reads0),
reads AS (SELECT * REPLACE (CASE WHEN row_id % 7 = 0 THEN list_transform(range(1, len(b) + 2), lambda k: {'s': ex[CASE WHEN k = 1 THEN 1 ELSE b[k - 1] + 1 END].s,
  'e': ex[CASE WHEN k = len(b) + 1 THEN len(ex) ELSE b[k] END].e}) ELSE ex END AS ex) FROM rm),
exon AS (""",
    1,
)
TWO = READS + "," + _tx("ta", "reads", f"({_RUN}) = 0") + "," + _tx("tb", "reads", f"({_RUN}) = 1")
ALL_TWO = READS + "," + _all("ta", f"({_RUN}) = 0") + "," + _all("tb", f"({_RUN}) = 1")
REGION = (
    READS
    + """,
g1 AS (SELECT *, CASE WHEN s - 200 > max(e) OVER (PARTITION BY chrom ORDER BY s, e, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS nw FROM reads),
g2 AS (SELECT *, sum(nw) OVER (PARTITION BY chrom ORDER BY s, e, row_id) AS g FROM g1),
reg AS (SELECT *, min(s) OVER (PARTITION BY chrom, g) AS region_start FROM g2)"""
)
PLACES = (
    REGION
    + """,
pl AS (SELECT read_name AS read, chrom || ':' || region_start AS locus, max(least(len(ex), 10) / 10.0) AS compat
  FROM reg WHERE read_name IS NOT NULL GROUP BY ALL),
multi AS (SELECT read, locus FROM pl WHERE read IN (SELECT read FROM pl GROUP BY read HAVING count(*) > 1)),
links AS (SELECT x.locus AS a, y.locus AS b, count(*) AS n_shared FROM multi x JOIN multi y ON x.read = y.read AND x.locus < y.locus GROUP BY ALL)"""
)
EM_START = ", e0 AS MATERIALIZED (SELECT read, locus, compat, 1.0::DOUBLE / count(*) OVER (PARTITION BY read) AS wt, false AS done FROM pl)"
EM_THREE = (
    "WITH " + PLACES + EM_START
    + "".join(f", s{k} AS (SELECT read, locus, compat, (compat + 0.01) * sqrt(sum(wt) OVER (PARTITION BY locus)) AS sc FROM e{k - 1}), e{k} AS (SELECT read, locus, compat, sc / sum(sc) OVER (PARTITION BY read) AS wt FROM s{k})" for k in (1, 2, 3))
    + " SELECT read, locus AS copy, round(wt, 5) AS weight FROM e3"
)


def _em_rounds(most: int) -> str:
    """Rounds of the re-weighting until no weight moves by 1e-3; after that rounds change nothing."""
    return "".join(
        f""", s{k} AS (SELECT *, (compat + 0.01) * sqrt(sum(wt) OVER (PARTITION BY locus)) AS sc FROM e{k - 1}),
        n{k} AS (SELECT *, sc / sum(sc) OVER (PARTITION BY read) AS nw FROM s{k}),
        e{k} AS MATERIALIZED (SELECT read, locus, compat, CASE WHEN done THEN wt ELSE nw END AS wt, done OR max(abs(nw - wt)) OVER () < 1e-3 AS done FROM n{k})"""
        for k in range(1, most + 1)
    )


PANEL = """panel AS (SELECT row_id, chrom, panel_start AS s, panel_end AS e FROM ggo19_needy_top15 WHERE chrom IS NOT NULL AND panel_start < panel_end)"""
FLOW = """
fp AS (SELECT run_id, chrom, bdstart, bdend, strand, bottleneck AS w, list_transform(regexp_extract_all(path_nodes, '[0-9]+'), lambda x: x::BIGINT) AS p
  FROM flow_iterations WHERE path_nodes IS NOT NULL AND bottleneck IS NOT NULL AND chrom IS NOT NULL),
flow AS (SELECT * FROM fp WHERE len(p) > 0)"""
B = "run_id, chrom, bdstart, bdend, strand"
_FB = " AND ".join(f"{{x}}.{c} IS NOT DISTINCT FROM {{y}}.{c}" for c in B.split(", "))


def _segments(src: str, keys: str) -> str:
    """Run-length coverage of the ranges s, e of ``src``."""
    return f"""SELECT {keys}, pos AS start, nxt AS "end", depth FROM (
  SELECT {keys}, pos, lead(pos) OVER (PARTITION BY {keys} ORDER BY pos) AS nxt,
    (sum(d) OVER (PARTITION BY {keys} ORDER BY pos))::BIGINT AS depth FROM (
      SELECT {keys}, pos, sum(d) AS d FROM (
        SELECT {keys}, s AS pos, 1 AS d FROM {src} UNION ALL SELECT {keys}, e, -1 FROM {src}) GROUP BY ALL))
  WHERE depth > 0 AND nxt IS NOT NULL"""


def _islands(src: str, keys: str, slack: int, what: str, s: str = "s", e: str = "e") -> str:
    """Islands of s, e over keys; ``what`` selects aggregates from the labelled rows."""
    return f"""SELECT {keys}, {what} FROM (
  SELECT *, sum(nw) OVER (PARTITION BY {keys} ORDER BY {s}, {e}) AS isl FROM (
    SELECT *, CASE WHEN {s} - {slack} > max({e}) OVER (PARTITION BY {keys} ORDER BY {s}, {e} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS nw
    FROM {src})) GROUP BY {keys}, isl"""


NODES = (
    READS
    + f""",
isl AS ({_islands('exon', 'chrom, strand', 0, 'min(s) AS s, max(e) AS e')}),
cuts AS (SELECT DISTINCT chrom, strand, unnest([donor, acceptor]) AS pos FROM junc),
pts AS (SELECT i.chrom, i.strand, i.s AS island, c.pos FROM isl i JOIN cuts c ON i.chrom = c.chrom AND i.strand = c.strand AND c.pos BETWEEN i.s AND i.e
  UNION SELECT chrom, strand, s, unnest([s, e]) FROM isl),
node AS (SELECT * FROM (SELECT chrom, strand, island, pos AS s, lead(pos) OVER (PARTITION BY chrom, strand, island ORDER BY pos) AS e FROM pts) WHERE e IS NOT NULL)"""
)
RPATH = (
    NODES
    + """,
rp AS (SELECT x.row_id, x.chrom, x.strand, list_sort(list(DISTINCT n.s)) AS p
  FROM exon x JOIN node n ON x.chrom = n.chrom AND x.strand = n.strand AND x.s < n.e AND n.s < x.e GROUP BY ALL)"""
)


# change points of coverage inside nodes: steps are where exons begin or end; of a kind the strongest within 100 bases
# stays (a fold over the points in order of strength)
BOUNDARIES = (
    NODES
    + """,
ev AS (SELECT chrom, strand, pos, sum(d) AS x FROM (SELECT chrom, strand, s AS pos, 1 AS d FROM exon UNION ALL SELECT chrom, strand, e, -1 FROM exon) GROUP BY ALL HAVING sum(d) <> 0),
sp AS (SELECT n.chrom, n.strand, n.s, n.e, v.pos, v.x FROM node n JOIN ev v ON n.chrom = v.chrom AND n.strand = v.strand AND v.pos > n.s AND v.pos < n.e WHERE n.e - n.s > 150),
wn AS (SELECT *, coalesce(sum(greatest(x, 0)) OVER l, 0) AS rl, sum(greatest(x, 0)) OVER r AS rr, coalesce(sum(greatest(-x, 0)) OVER l, 0) AS fl, sum(greatest(-x, 0)) OVER r AS fr FROM sp
  WINDOW l AS (PARTITION BY chrom, strand, s ORDER BY pos RANGE BETWEEN 50 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY chrom, strand, s ORDER BY pos RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)),
cp AS (SELECT chrom, strand, s, e, pos, CASE WHEN x > 0 THEN 'start' ELSE 'end' END AS kind, CASE WHEN x > 0 THEN rr ELSE fl - x END AS strength FROM wn
  WHERE pos - s >= 25 AND pos - s < e - s - 25 AND CASE WHEN x > 0 THEN rr > 10 AND rl < 0.1 * rr ELSE fl - x > 10 AND fr + x < 0.1 * (fl - x) END),
kp AS (SELECT chrom, strand, s, e, kind, list_reduce(list([{'p': pos, 'w': strength}] ORDER BY strength DESC, pos), lambda a, b: CASE WHEN len(list_filter(a, lambda q: abs(q.p - b[1].p) <= 100)) = 0 THEN list_concat(a, b) ELSE a END) AS k FROM cp GROUP BY chrom, strand, s, e, kind),
bd AS (SELECT chrom, strand, s AS node_start, e, u.x.p AS pos, kind, u.x.w AS strength FROM kp, LATERAL (SELECT unnest(k) AS x) u)"""
)


def _near(cols: str, window: int) -> str:
    return " AND ".join(f"abs(x.{c} - y.{c}) <= {window}" for c in cols.split())


_DIFF = "(x.donor <> y.donor OR x.acceptor <> y.acceptor)"
_SAME = "x.chrom = y.chrom AND x.strand = y.strand"
_JK = "chrom, strand, donor, acceptor"


def w(ctes: str, body: str) -> str:
    return f"WITH {ctes} {body}"


# whether a is an ordered proper part of b: same chains of the joined rows x (small) and y (large).
# An ordered part of a list without repeats: all members occur, and their positions ascend;
# donors ascend within a chain, so occurring is enough.
_PART = "len(x.chain) < len(y.chain) AND list_has_all(y.chain, x.chain)"
_EXACT = """SELECT x.tx_id, y.tx_id AS ref_id FROM ta x JOIN tb y ON x.chrom = y.chrom AND x.strand = y.strand AND x.chain = y.chain"""

ORACLES = {
    "bundle_regions": w(REGION, "SELECT chrom, region_start, max(e) AS region_end, count(*) AS n_reads FROM reg GROUP BY chrom, region_start"),
    "zero_cov_split": w(READS, _islands("exon", "chrom", 49, 'min(s) AS start, max(e) AS "end"')),
    "pileup": w(READS, _segments("exon", "chrom, strand")),
    "elementary_intervals": w(f"""n AS (SELECT {B}, start AS s, "end" AS e FROM nodes WHERE chrom IS NOT NULL AND start < "end")""", _segments("n", B)),
    "range_coverage": w(
        READS + "," + PANEL + f", seg AS ({_segments('exon', 'chrom')})",
        """SELECT p.row_id, p.chrom, p.s AS start, p.e AS "end", coalesce(sum(CASE WHEN g.start IS NOT NULL THEN (least(p.e, g."end") - greatest(p.s, g.start)) * g.depth END), 0)::BIGINT AS cov_sum,
        coalesce(sum(CASE WHEN g.start IS NOT NULL THEN least(p.e, g."end") - greatest(p.s, g.start) END), 0)::BIGINT AS cov_bases
        FROM panel p LEFT JOIN seg g ON p.chrom = g.chrom AND p.s < g."end" AND g.start < p.e GROUP BY ALL""",
    ),
    "interval_overlap_join": w(READS + "," + PANEL, "SELECT p.row_id, count(*) AS n_reads, min(r.s) AS first_start FROM panel p JOIN reads r ON p.chrom = r.chrom AND p.s < r.e AND r.s < p.e GROUP BY ALL"),
    "interval_anti_join": w(READS + "," + PANEL, "SELECT chrom, count(*) AS n_reads FROM reads r WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE p.chrom = r.chrom AND p.s - 100 < r.e AND r.s < p.e + 100) GROUP BY ALL"),
    "interval_semi_join": w(READS + "," + PANEL, "SELECT chrom, count(*) AS n_reads FROM reads r WHERE EXISTS (SELECT 1 FROM panel p WHERE p.chrom = r.chrom AND p.s < r.e AND r.s < p.e) GROUP BY ALL"),
    "tss_clusters": w(
        READS + ", pt AS (SELECT chrom, strand, s, s AS e, sum(w) AS w FROM reads GROUP BY ALL)",
        f"SELECT chrom, strand, centre, weight, first, last FROM ({_islands('pt', 'chrom, strand', 5, 'floor(sum(s * w) / sum(w) + 0.5)::BIGINT AS centre, sum(w)::BIGINT AS weight, min(s) AS first, max(s) AS last')}) WHERE weight >= 3",
    ),
    "read_boundaries": w(READS, "SELECT chrom, strand, kind, pos, sum(w)::BIGINT AS weight FROM (SELECT chrom, strand, 'start' AS kind, s AS pos, w FROM reads UNION ALL SELECT chrom, strand, 'end', e, w FROM reads) GROUP BY ALL"),
    "endpoint_representatives": w(
        READS + ", pt AS (SELECT chrom, e AS pos, sum(w) AS w FROM reads GROUP BY ALL)",
        """SELECT chrom, pos, first_value(pos) OVER (PARTITION BY chrom, isl ORDER BY w DESC, pos) AS rep FROM (
          SELECT *, sum(nw) OVER (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) AS isl FROM (
            SELECT *, CASE WHEN pos - 10 > lag(pos) OVER (PARTITION BY chrom ORDER BY pos) THEN 1 ELSE 0 END AS nw FROM pt))""",
    ),
    "tile_loci": w(
        READS + ", t AS (SELECT chrom, tile * 2500 AS s, tile * 2500 + 5000 AS e, count(*) AS n FROM (SELECT chrom, unnest(range(greatest(floor((s - 5000) / 2500)::BIGINT + 1, 0), floor(s / 2500)::BIGINT + 1)) AS tile FROM reads) GROUP BY ALL HAVING count(*) >= 5)",
        _islands("t", "chrom", 0, "min(s) AS locus_start, max(e) AS locus_end, count(*) AS n_tiles, max(n) AS best"),
    ),
    "junction_stats": w(STATS, "SELECT * FROM stats"),
    "splice_site_support": w(SITES, f"SELECT {_JK}, leftsupport, rightsupport FROM sites"),
    "good_junctions": w(SITES, f"SELECT {_JK}, CASE WHEN nreads_good < 1 THEN 'few_good' WHEN mrcount * 10 < 0.1 * greatest(leftsupport, rightsupport) THEN 'low_share' ELSE 'good' END AS verdict FROM sites"),
    "weak_junctions": w(STATS, f"SELECT {_JK}, mrcount FROM stats WHERE strand <> 0 AND nreads_good >= 2 AND mrcount > 0"),
    "killed_junctions": w(STATS, f"SELECT {_JK} FROM stats WHERE strand = 0"),
    "splice_site_isofrac": w(STATS, f"SELECT *, mrcount * 100 >= site_total * 10 AS keep FROM (SELECT {_JK}, mrcount, (sum(mrcount) OVER (PARTITION BY chrom, strand, donor))::BIGINT AS site_total FROM stats)"),
    "nearby_weak": w(STATS, f"SELECT *, m < best_near * 0.1::DOUBLE AS drop FROM (SELECT x.chrom, x.strand, x.donor, x.acceptor, x.mrcount AS m, coalesce(max(y.mrcount), 0) AS best_near FROM stats x LEFT JOIN stats y ON {_SAME} AND {_near('donor acceptor', 25)} AND {_DIFF} GROUP BY ALL)").replace("SELECT *, m <", f"SELECT {_JK}, best_near, m <"),
    "shared_site_weak": w(STATS, f"SELECT {_JK}, mrcount <= 2 AND (mrcount < 0.1::DOUBLE * max(mrcount) OVER (PARTITION BY chrom, strand, donor) OR mrcount < 0.1::DOUBLE * max(mrcount) OVER (PARTITION BY chrom, strand, acceptor)) AS drop FROM stats"),
    "junction_rank": w(STATS, f"SELECT {_JK}, row_number() OVER (PARTITION BY chrom, strand, donor ORDER BY mrcount DESC, acceptor) AS rank FROM stats"),
    "junction_found_fraction": w(
        STATS + ", t AS (SELECT DISTINCT chrom, donor, acceptor FROM stats WHERE mrcount >= 3), hit AS (SELECT DISTINCT x.row_id, x.i FROM junc x JOIN t y ON x.chrom = y.chrom AND " + _near("donor acceptor", 10) + ")",
        "SELECT r.row_id, coalesce(c, 0) AS n_found, CASE WHEN len(ex) > 1 THEN round(coalesce(c, 0) / (len(ex) - 1), 6) ELSE 1 END AS found FROM reads r LEFT JOIN (SELECT row_id, count(*) AS c FROM hit GROUP BY 1) h ON r.row_id = h.row_id",
    ),
    "nearest_snap": w(
        STATS + ", g AS (SELECT * FROM stats WHERE mrcount >= 5)",
        f"""SELECT {_JK},
        (SELECT y.donor FROM g y WHERE {_SAME} AND abs(y.donor - x.donor) <= 25 ORDER BY abs(y.donor - x.donor), y.donor LIMIT 1) AS nearest_donor,
        (SELECT y.acceptor FROM g y WHERE {_SAME} AND abs(y.acceptor - x.acceptor) <= 25 ORDER BY abs(y.acceptor - x.acceptor), y.acceptor LIMIT 1) AS nearest_acceptor FROM stats x""",
    ),
    "redirect_junctions": w(STATS.replace("THEN 25 ELSE 10", "THEN 250 ELSE 200"), f"SELECT x.chrom, x.strand, x.donor, x.acceptor, y.donor AS to_donor, y.acceptor AS to_acceptor FROM stats x JOIN stats y ON {_SAME} AND {_near('donor acceptor', 2000)} WHERE x.nreads_good = 0 AND y.nreads_good > 0 AND y.mrcount > x.mrcount * 0.9 QUALIFY row_number() OVER (PARTITION BY x.chrom, x.strand, x.donor, x.acceptor ORDER BY y.mrcount DESC, y.donor, y.acceptor) = 1"),
    "demoted_alternatives": w(STATS, f"SELECT x.chrom, x.strand, x.donor, x.acceptor, y.donor AS to_donor FROM stats x JOIN stats y ON {_SAME} AND x.acceptor = y.acceptor AND abs(x.donor - y.donor) <= 1000 AND x.donor <> y.donor WHERE x.mrcount < y.mrcount * 0.5 QUALIFY row_number() OVER (PARTITION BY x.chrom, x.strand, x.donor, x.acceptor ORDER BY y.mrcount DESC, y.donor) = 1"),
    "intron_pairs": w(READS, "SELECT chrom, strand, ex[i].e AS d1, ex[i + 1].s AS a1, ex[i + 1].e AS d2, ex[i + 2].s AS a2, sum(w)::BIGINT AS n_reads FROM (SELECT chrom, strand, ex, w, unnest(range(1, len(ex) - 1)) AS i FROM reads) GROUP BY ALL"),
    "junction_usage": w(
        STATS + "," + _tx("ta", "reads", f"({_RUN}) = 0") + f", known AS (SELECT DISTINCT {_JK} FROM jx WHERE ({_RUN}) = 1), u AS (SELECT chrom, strand, tx_id, unnest(chain) AS j FROM ta)",
        "SELECT u.chrom, u.strand, j.d AS donor, j.a AS acceptor, count(DISTINCT tx_id) AS n_tx, NOT bool_or(k.donor IS NOT NULL) AS novel FROM u LEFT JOIN known k ON u.chrom = k.chrom AND u.strand = k.strand AND j.d = k.donor AND j.a = k.acceptor GROUP BY ALL",
    ),
    "dominated_novel": w(TX + ", u AS (SELECT chrom, strand, j.d AS donor, j.a AS acceptor, count(DISTINCT tx_id) AS n FROM (SELECT chrom, strand, tx_id, unnest(chain) AS j FROM tx) GROUP BY ALL)", f"SELECT {_JK} FROM u QUALIFY n <= 1 AND greatest(max(n) OVER (PARTITION BY chrom, strand, donor), max(n) OVER (PARTITION BY chrom, strand, acceptor)) >= 3"),
    "junction_set_compare": w(
        READS + f", a AS (SELECT DISTINCT {_JK} FROM junc WHERE acceptor - donor >= 20 AND ({_RUN}) = 0), b AS (SELECT DISTINCT {_JK} FROM junc WHERE acceptor - donor >= 20 AND ({_RUN}) = 1), f AS (SELECT count(*) AS n FROM a JOIN b USING ({_JK}))",
        "SELECT n AS found, (SELECT count(*) FROM b) - n AS missing, (SELECT count(*) FROM a) - n AS extra, round(n / (SELECT count(*) FROM b), 6) AS sensitivity, round(n / (SELECT count(*) FROM a), 6) AS precision FROM f",
    ),
    "dup_collapse": w(READS, f"SELECT chrom, strand, {EXON_TEXT} AS exons, sum(w)::BIGINT AS weight, count(*) AS n_reads, min(row_id) AS row_id FROM reads GROUP BY chrom, strand, ex"),
    "read_chains": w(TX, f"SELECT chrom, strand, tx_id, cov::BIGINT AS coverage, s AS start, e AS \"end\", {CHAIN_TEXT} AS chain FROM tx"),
    "raw_transcripts": w(RAW, f"SELECT tx_id, chrom, strand, cov AS coverage, {EXON_TEXT} AS exons FROM raw"),
    "chain_dedup": w(RAW, f"SELECT tx_id, cov AS coverage FROM raw WHERE n = 1 UNION ALL SELECT tx_id, cov FROM (SELECT *, {CHAIN} AS chain FROM raw WHERE n > 1) QUALIFY row_number() OVER (PARTITION BY chrom, strand, chain ORDER BY cov DESC, tx_id) = 1"),
    "subset_chains": w(TX, f"SELECT x.tx_id, count(*) AS n_larger FROM tx x JOIN tx y ON {_SAME} AND {_PART} GROUP BY ALL"),
    "containment_filter": w(
        ALL,
        f"""SELECT tx_id, cov AS coverage FROM tx x WHERE NOT EXISTS (SELECT 1 FROM tx y WHERE {_SAME} AND x.tx_id <> y.tx_id AND y.s <= x.s AND x.e <= y.e
        AND (y.cov > x.cov OR (y.cov = x.cov AND y.tx_id < x.tx_id))
        AND len(list_filter(x.ex, lambda a: len(list_filter(y.ex, lambda b: b.s <= a.s AND a.e <= b.e)) = 0)) = 0)""",
    ),
    "near_equal_pairs": w(TX, f"SELECT x.tx_id, y.tx_id AS r_tx_id FROM tx x JOIN tx y ON {_SAME} AND x.n = y.n AND x.tx_id < y.tx_id AND abs(x.chain[1].d - y.chain[1].d) <= 500 WHERE len(list_filter(range(1, x.n), lambda i: abs(x.chain[i].d - y.chain[i].d) > 500 OR abs(x.chain[i].a - y.chain[i].a) > 500)) = 0"),
    "isofrac_locus": w(
        ALL + ", l AS (SELECT *, sum(nw) OVER (PARTITION BY chrom, strand ORDER BY s, e, tx_id) AS locus FROM (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY chrom, strand ORDER BY s, e, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS nw FROM tx))",
        """SELECT tx_id, cov AS coverage FROM (SELECT *, max(cov) OVER (PARTITION BY chrom, strand, locus) AS m, max(CASE WHEN n > 1 THEN cov END) OVER (PARTITION BY chrom, strand, locus) AS mm FROM l)
        WHERE cov >= 0.05 * (CASE WHEN cov > 100 THEN 0.05 WHEN cov > 50 THEN 0.5 ELSE 1 END) * CASE WHEN n > 1 THEN mm ELSE m END""",
    ),
    "opposite_dominated": w(ALL, "SELECT DISTINCT x.tx_id FROM tx x JOIN tx y ON x.chrom = y.chrom AND x.s < y.e AND y.s < x.e WHERE x.strand * y.strand < 0 AND y.cov >= 3 * x.cov"),
    "intronic": w(RAW + f", i AS (SELECT chrom, strand, n, unnest({CHAIN}) AS j FROM raw WHERE n > 1)", f"SELECT DISTINCT x.tx_id FROM raw x JOIN i y ON {_SAME} AND x.s >= y.j.d AND x.e <= y.j.a AND y.n > x.n WHERE y.j.d < y.j.a"),
    "retained_introns": w(
        RETAINING + _RAW + f", i AS (SELECT chrom, strand, j.d AS d, j.a AS a, max(cov) AS c FROM (SELECT chrom, strand, cov, unnest({CHAIN}) AS j FROM raw WHERE n > 1) WHERE j.d < j.a GROUP BY ALL), x AS (SELECT chrom, strand, tx_id, cov, unnest(ex) AS b FROM raw)",
        f"SELECT DISTINCT x.tx_id FROM x JOIN i y ON {_SAME} AND x.b.s < y.d AND x.b.e > y.a WHERE x.cov < y.c",
    ),
    "unwitnessed": w(
        TWO + f", seen AS (SELECT DISTINCT chrom, strand, ex[i].e AS d1, ex[i + 1].s AS a1, ex[i + 1].e AS d2, ex[i + 2].s AS a2 FROM (SELECT chrom, strand, ex, unnest(range(1, len(ex) - 1)) AS i FROM reads WHERE ({_RUN}) = 1)), p AS (SELECT chrom, strand, tx_id, chain[i].d AS d1, chain[i].a AS a1, chain[i + 1].d AS d2, chain[i + 1].a AS a2 FROM (SELECT chrom, strand, tx_id, chain, unnest(range(1, len(chain))) AS i FROM ta))",
        "SELECT DISTINCT tx_id FROM p ANTI JOIN seen USING (chrom, strand, d1, a1, d2, a2)",
    ),
    "supported_introns": w(STATS + "," + _tx("tx", "reads"), "SELECT tx_id FROM tx WHERE tx_id NOT IN (SELECT tx_id FROM (SELECT tx_id, chrom, strand, j.d AS donor, j.a AS acceptor FROM (SELECT tx_id, chrom, strand, unnest(chain) AS j FROM tx)) ANTI JOIN (SELECT * FROM stats WHERE nreads_good >= 2) USING (chrom, strand, donor, acceptor))"),
    "length_filters": w(ALL, "SELECT tx_id FROM tx WHERE list_min(list_transform(ex, lambda x: x.e - x.s)) >= 20 AND list_sum(list_transform(ex, lambda x: x.e - x.s)) >= 500 AND (n = 1 OR (ex[1].e - ex[1].s >= 25 AND ex[n].e - ex[n].s >= 25))"),
    "coverage_gate": w(RAW, "SELECT tx_id, cov AS coverage FROM raw WHERE cov >= CASE WHEN n > 1 THEN 2 ELSE 3 END"),
    "tpm": w(ALL, "SELECT tx_id, round(cov * 1e6 / (SELECT sum(cov) FROM tx), 4) AS tpm, round(cov * 1000, 4) AS fpkm FROM tx"),
    "top_transcripts": w(
        ALL + ", l AS (SELECT *, sum(nw) OVER (PARTITION BY chrom, strand ORDER BY s, e, tx_id) AS g FROM (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY chrom, strand ORDER BY s, e, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS nw FROM tx))",
        "SELECT chrom, strand, locus, tx_id, rank FROM (SELECT *, min(s) OVER (PARTITION BY chrom, strand, g) AS locus, row_number() OVER (PARTITION BY chrom, strand, g ORDER BY cov DESC, tx_id) AS rank FROM l) WHERE rank <= 3",
    ),
    "exact_reference": w(ALL_TWO, f"SELECT x.tx_id, y.tx_id AS ref_id FROM ta x JOIN tb y ON {_SAME} AND x.n > 1 AND y.n > 1 AND x.chain = y.chain UNION ALL SELECT x.tx_id, y.tx_id FROM ta x JOIN tb y ON {_SAME} AND x.n = 1 AND y.n = 1 AND x.s = y.s AND x.e = y.e"),
    "reference_subset": w(TWO, f"SELECT tx_id FROM ta x WHERE EXISTS (SELECT 1 FROM tb y WHERE {_SAME} AND {_PART}) AND tx_id NOT IN (SELECT tx_id FROM ({_EXACT}))"),
    "zero_novel_not_exact": w(TWO, f"SELECT tx_id FROM ta WHERE tx_id NOT IN (SELECT tx_id FROM (SELECT tx_id, chrom, strand, unnest(chain) AS j FROM ta) ANTI JOIN (SELECT chrom, strand, unnest(chain) AS j FROM tb) USING (chrom, strand, j)) AND tx_id NOT IN (SELECT tx_id FROM ({_EXACT}))"),
    "recovered_guides": w(
        READS + "".join(f", r{k} AS (SELECT chrom, strand, ex, min(row_id) AS tx_id, sum(w)::DOUBLE AS cov FROM reads WHERE ({_RUN}) = {k} AND list_sum(list_transform(ex, lambda x: x.e - x.s)) >= 200 GROUP BY chrom, strand, ex)" for k in (0, 1)),
        "SELECT tx_id, cov AS coverage FROM r0 UNION ALL SELECT tx_id, cov FROM r1 ANTI JOIN r0 USING (chrom, strand, ex)",
    ).replace("r0 AS (SELECT chrom, strand, ex,", "q0 AS (SELECT chrom, strand, ex,").replace("FROM r0 UNION ALL SELECT tx_id, cov FROM r1 ANTI JOIN r0", "FROM q0 UNION ALL SELECT tx_id, cov FROM r1 ANTI JOIN q0"),
    "guide_expression": w(TWO, f"SELECT tx_id AS guide_id, chrom, strand, {EXON_TEXT} AS exons FROM tb"),
    "transcript_coverage": w(
        ALL + f", seg AS ({_segments('exon', 'chrom')}), b AS (SELECT tx_id, chrom, unnest(ex) AS x FROM tx)",
        """SELECT tx_id, sum(c)::BIGINT AS cov_sum, floor(sum(c) / sum(l) * 1000)::BIGINT AS mean_milli FROM (
          SELECT b.tx_id, b.x, any_value(b.x.e - b.x.s) AS l, coalesce(sum((least(b.x.e, g."end") - greatest(b.x.s, g.start)) * g.depth), 0) AS c
          FROM b LEFT JOIN seg g ON b.chrom = g.chrom AND b.x.s < g."end" AND g.start < b.x.e GROUP BY ALL) GROUP BY tx_id""",
    ),
    "low_introns": w(
        TX + f", seg AS ({_segments('exon', 'chrom')}), "
        "iv AS (SELECT tx_id, chrom, i AS part, ex[i + 1].s AS s, ex[i + 1].e AS e, 'x' AS k FROM (SELECT *, unnest(range(0, n)) AS i FROM tx) "
        "UNION ALL SELECT tx_id, chrom, i, chain[i + 1].d, chain[i + 1].a, 'i' FROM (SELECT *, unnest(range(0, n - 1)) AS i FROM tx)), "
        """c AS (SELECT tx_id, part, k, e - s AS l, coalesce(sum(CASE WHEN g.start IS NOT NULL THEN (least(e, g."end") - greatest(s, g.start)) * g.depth END), 0) AS c
          FROM iv LEFT JOIN seg g ON iv.chrom = g.chrom AND s < g."end" AND g.start < e GROUP BY tx_id, part, k, s, e)""",
        """SELECT i.tx_id, i.part, floor(i.c / i.l * 1000)::BIGINT AS mean_milli, i.c / i.l < (a.c + b.c) / (a.l + b.l) * 0.1::DOUBLE AS low FROM c i
          JOIN c a ON a.k = 'x' AND a.tx_id = i.tx_id AND a.part = i.part JOIN c b ON b.k = 'x' AND b.tx_id = i.tx_id AND b.part = i.part + 1 WHERE i.k = 'i' AND i.l > 0""",
    ),
    "resolved_strands": w(
        STATS + ", v AS (SELECT chrom, donor, acceptor, sum(strand * mrcount) AS v FROM stats WHERE strand <> 0 GROUP BY ALL), rv AS (SELECT row_id, sum(v) AS v FROM junc JOIN v USING (chrom, donor, acceptor) WHERE strand = 0 GROUP BY 1)",
        "SELECT strand, CASE WHEN strand = 0 THEN coalesce(sign(v), 0)::INT ELSE strand END AS resolved_strand, count(*) AS n_reads FROM reads LEFT JOIN rv USING (row_id) GROUP BY ALL",
    ),
    "pile_ups": w(
        READS + ", one AS (SELECT chrom, strand, s, e, row_id FROM reads r WHERE len(ex) = 1 AND e - s >= 200 AND NOT EXISTS (SELECT 1 FROM reads m WHERE len(m.ex) > 1 AND m.chrom = r.chrom AND m.s < r.e AND r.s < m.e))",
        """SELECT chrom, strand, min(s) AS start, max(e) AS "end", count(*) AS n_reads FROM (
          SELECT *, sum(nw) OVER (PARTITION BY chrom, strand ORDER BY s, row_id) AS g FROM (
            SELECT *, CASE WHEN s - 10 > lag(s) OVER (PARTITION BY chrom, strand ORDER BY s, row_id) THEN 1 ELSE 0 END AS nw FROM one)) GROUP BY chrom, strand, g HAVING count(*) >= 5""",
    ),
    "bridged_gaps": w(
        READS + f", p AS ({_islands('exon', 'chrom', 0, 'min(s) AS s, max(e) AS e')}), g AS (SELECT * FROM (SELECT chrom, lag(e) OVER (PARTITION BY chrom ORDER BY s) AS d, s AS a FROM p) WHERE a - d >= 20), j AS (SELECT chrom, donor, acceptor, sum(w) AS w FROM junc WHERE donor < acceptor GROUP BY ALL)",
        "SELECT g.chrom, g.d AS donor, g.a AS acceptor, sum(j.w)::BIGINT AS weight FROM g JOIN j ON j.chrom = g.chrom AND j.donor <= g.d AND j.acceptor >= g.a GROUP BY ALL HAVING sum(j.w) >= 1",
    ),
    "loss_report": """SELECT fate, count(*) AS n FROM (SELECT l.locus_id, CASE WHEN m IS NULL THEN 'missed' WHEN m.c IN ('=', 'j') THEN 'matched' ELSE 'partial_' || m.c END AS fate
      FROM (SELECT DISTINCT locus_id FROM ggo19_needy_top15 WHERE locus_id IS NOT NULL) l LEFT JOIN
      (SELECT locus_id, min({'r': CASE WHEN instr('=jcmxiypnsu', c) > 0 THEN instr('=jcmxiypnsu', c) ELSE 99 END, 'c': c}) AS m FROM (SELECT locus_id, unnest(regexp_extract_all(classes, '([=a-z]):', 1)) AS c FROM ggo19_needy_top15) GROUP BY 1) b ON l.locus_id = b.locus_id) GROUP BY ALL""",
    "cigar_roundtrip": w(READS, f"SELECT row_id, array_to_string(list_transform(range(1, len(ex) + 1), lambda i: CASE WHEN i > 1 THEN (ex[i].s - ex[i - 1].e) || 'N' ELSE '' END || (ex[i].e - ex[i].s) || 'M'), '') AS cigar, {EXON_TEXT} AS exons FROM reads"),
    "intron_table": w(TX, "SELECT chrom, strand, j.d + 1 AS start, j.a AS \"end\", count(DISTINCT tx_id) AS n_tx FROM (SELECT chrom, strand, tx_id, unnest(chain) AS j FROM tx) GROUP BY ALL"),
    "node_boundaries": w(BOUNDARIES, "SELECT chrom, strand, node_start, pos, kind, round(strength, 3)::DOUBLE AS strength FROM bd"),
    "exon_islands": w(NODES, "SELECT chrom, strand, s AS start, e AS \"end\" FROM isl"),
    "graph_nodes": w(NODES, "SELECT chrom, strand, island, s AS start, e AS \"end\" FROM node"),
    "graph_edges": w(
        NODES,
        """SELECT a.chrom, a.strand, a.s AS from_start, a.e AS from_end, b.s AS to_start, b.e AS to_end, 'contiguous' AS kind, 0::BIGINT AS n_reads FROM node a JOIN node b ON a.chrom = b.chrom AND a.strand = b.strand AND a.e = b.s AND a.island = b.island
        UNION ALL SELECT a.chrom, a.strand, a.s, a.e, b.s, b.e, 'junction', j.n FROM (SELECT chrom, strand, donor, acceptor, sum(w)::BIGINT AS n FROM junc WHERE acceptor - donor >= 20 GROUP BY ALL) j
        JOIN node a ON a.chrom = j.chrom AND a.strand = j.strand AND a.e = j.donor JOIN node b ON b.chrom = j.chrom AND b.strand = j.strand AND b.s = j.acceptor""",
    ),
    "read_paths": w(RPATH, "SELECT row_id, array_to_string(p, ',') AS path FROM rp"),
    "transfrags": w(RPATH, "SELECT chrom, strand, array_to_string(p, ',') AS path, count(*) AS abundance, count(*) AS n_reads FROM rp GROUP BY ALL"),
    "edge_capacities": w(FLOW + f", fe AS (SELECT {B}, w, list_concat([-1::BIGINT], p, [-2::BIGINT]) AS q FROM flow)", f"SELECT {B}, q[i] AS u, q[i + 1] AS v, round(sum(w), 4) AS capacity FROM (SELECT *, unnest(range(1, len(q))) AS i FROM fe) GROUP BY ALL"),
    "node_flux": w(FLOW, f"SELECT {B}, p[i] AS node, round(sum(CASE WHEN i > 1 THEN w ELSE 0 END), 4) AS abundin, round(sum(CASE WHEN i < len(p) THEN w ELSE 0 END), 4) AS abundout, round(sum(w), 4) AS longcov, round(greatest(sum(CASE WHEN i > 1 THEN w ELSE 0 END), sum(CASE WHEN i < len(p) THEN w ELSE 0 END)), 4) AS nodecov FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM flow) GROUP BY {B}, p[i]"),
    "max_flow": w(FLOW, f"SELECT {B}, round(sum(w), 4) AS max_flow FROM flow GROUP BY {B}"),
    "absorbed_paths": w(
        FLOW + f""", dp AS (SELECT {B}, p, sum(w) AS w FROM flow GROUP BY ALL),
l AS (SELECT {B}, list([{{'t': ',' || array_to_string(p, ',') || ',', 'w': w, 'o': w}}] ORDER BY len(p) DESC, w DESC, p) AS k FROM dp GROUP BY {B}),
r AS (SELECT {B}, list_reduce(k, lambda a, b: CASE WHEN len(list_filter(a, lambda h: contains(h.t, b[1].t))) = 0 THEN list_concat(a, b) ELSE list_transform(a, lambda h: {{'t': h.t, 'w': CASE WHEN contains(h.t, b[1].t)
  THEN h.w + b[1].w * h.o / list_sum(list_transform(list_filter(a, lambda g: contains(g.t, b[1].t)), lambda g: g.o)) ELSE h.w END, 'o': h.o}}) END) AS k FROM l)""",
        f"SELECT {B}, trim(u.x.t, ',') AS path, round(u.x.w, 4) AS abundance FROM r, LATERAL (SELECT unnest(k) AS x) u",
    ),
    "partition_signature": f"SELECT {B}, array_to_string(list(t ORDER BY s, t), '+') AS signature FROM (SELECT DISTINCT {B}, start AS s, (start + 1) || '-' || \"end\" AS t FROM nodes WHERE chrom IS NOT NULL AND start < \"end\") GROUP BY {B}",
    "families": w(
        "RECURSIVE " + PLACES + ", l AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links), r AS (SELECT u, u AS v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u), c AS (SELECT u AS locus, min(v) AS family FROM r GROUP BY u)",
        "SELECT locus, family, (row_number() OVER (PARTITION BY family ORDER BY locus) - 1)::INT AS copy_idx FROM c",
    ),
    "gene_abundance": w(
        "RECURSIVE " + ALL + """, x AS (SELECT tx_id, chrom, strand, unnest(ex) AS b FROM tx), l AS (SELECT DISTINCT x.tx_id AS u, y.tx_id AS v FROM x JOIN x y ON x.chrom = y.chrom AND x.strand = y.strand AND x.b.s < y.b.e AND y.b.s < x.b.e),
r AS (SELECT tx_id AS u, tx_id AS v FROM tx UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u), g AS (SELECT u AS tx_id, min(v) AS gene_id FROM r GROUP BY u)""",
        'SELECT gene_id, chrom, strand, min(s) AS start, max(e) AS "end", count(*) AS n_tx, sum(cov) AS coverage, round(sum(cov) * 1e6 / (SELECT sum(cov) FROM tx), 3) AS tpm FROM tx JOIN g USING (tx_id) GROUP BY ALL',
    ),
    "structural_merge": w(
        ALL_TWO + f""", u AS (SELECT chrom, strand, ex, min(tx_id) AS tx_id FROM (SELECT * FROM ta UNION ALL SELECT * FROM tb) GROUP BY ALL), v AS (SELECT *, len(ex) AS n, ex[1].s AS s, ex[len(ex)].e AS e, {CHAIN} AS chain FROM u),
c AS (SELECT * FROM v QUALIFY n = 1 OR row_number() OVER (PARTITION BY chrom, strand, n, chain ORDER BY tx_id) = 1),
p AS (SELECT x.tx_id AS a, y.tx_id AS b, x.e - x.s AS la, y.e - y.s AS lb FROM c x JOIN c y ON {_SAME} AND x.n = y.n AND x.n > 1 AND x.tx_id < y.tx_id AND abs(x.chain[1].d - y.chain[1].d) <= 250
  WHERE len(list_filter(range(1, x.n), lambda i: abs(x.chain[i].d - y.chain[i].d) > 250 OR abs(x.chain[i].a - y.chain[i].a) > 250)) = 0),
k AS (SELECT * FROM c WHERE tx_id NOT IN (SELECT CASE WHEN la >= lb THEN b ELSE a END FROM p)),
z AS (SELECT x.tx_id FROM k x JOIN k y ON {_SAME} AND x.tx_id <> y.tx_id AND x.s >= y.s AND x.e <= y.e WHERE (x.n = 1 AND y.n = 1 AND (x.s <> y.s OR x.e <> y.e OR y.tx_id < x.tx_id)) OR (x.n > 1 AND {_PART}))""",
        f"SELECT tx_id, chrom, strand, {EXON_TEXT} AS exons FROM k WHERE tx_id NOT IN (SELECT tx_id FROM z) AND list_sum(list_transform(ex, lambda x: x.e - x.s)) >= 200",
    ),
    "graph_stats": w(
        "RECURSIVE " + FLOW + f""", fq AS (SELECT {B}, list_concat([-1::BIGINT], p, [-2::BIGINT]) AS q FROM flow), ed AS (SELECT DISTINCT {B}, q[i] AS u, q[i + 1] AS v FROM (SELECT *, unnest(range(1, len(q))) AS i FROM fq)),
nd AS (SELECT DISTINCT {B}, unnest(p) AS n FROM flow), l AS (SELECT {B}, u, v FROM ed WHERE u >= 0 AND v >= 0 UNION ALL SELECT {B}, v, u FROM ed WHERE u >= 0 AND v >= 0),
r AS (SELECT {B}, n AS u, n AS v FROM nd UNION SELECT r.run_id, r.chrom, r.bdstart, r.bdend, r.strand, r.u, l.v FROM r JOIN l ON {_FB.format(x='r', y='l')} AND r.v = l.u),
parts AS (SELECT {B}, count(DISTINCT m) AS n_parts FROM (SELECT {B}, u, min(v) AS m FROM r GROUP BY ALL) GROUP BY ALL),
dp AS (SELECT DISTINCT {B}, v AS n, 0 AS k FROM ed WHERE u = -1 UNION SELECT dp.run_id, dp.chrom, dp.bdstart, dp.bdend, dp.strand, ed.v, dp.k + 1 FROM dp JOIN ed ON {_FB.format(x='dp', y='ed')} AND dp.n = ed.u WHERE dp.n >= 0)""",
        f"SELECT {B}, (SELECT count(*) FROM nd WHERE {_FB.format(x='nd', y='parts')})::INT AS n_nodes, (SELECT count(*) FROM ed WHERE {_FB.format(x='ed', y='parts')})::INT AS n_edges, n_parts::INT AS n_parts, (SELECT max(k) FROM dp WHERE dp.n = -2 AND {_FB.format(x='dp', y='parts')})::INT AS longest_path FROM parts",
    ),
    "multimap_links": w(PLACES, "SELECT * FROM links"),
    "em_weights": w(PLACES + EM_START + _em_rounds(20), "SELECT read, locus AS copy, round(wt, 5) AS weight FROM e20"),
    "phase_split": w(
        REGION + ", h AS (SELECT chrom || ':' || region_start AS locus, CASE strand WHEN 1 THEN 1 WHEN -1 THEN 2 END AS hp FROM reg), f AS (SELECT *, bool_or(coalesce(hp, 0) = 1) OVER (PARTITION BY locus) AND bool_or(coalesce(hp, 0) = 2) OVER (PARTITION BY locus) AS two FROM h)",
        "SELECT locus, phase, count(*) AS n_reads FROM (SELECT locus, unnest(CASE WHEN NOT two THEN [0] WHEN hp IS NULL THEN [1, 2] ELSE [hp] END) AS phase FROM f) GROUP BY ALL",
    ),
    "junction_jaccard": w(
        TX + ", k AS (SELECT DISTINCT tx_id, chrom, strand, unnest(chain) AS j FROM tx), n AS (SELECT tx_id, count(*) AS c FROM k GROUP BY 1), p AS (SELECT x.tx_id AS a, y.tx_id AS b, count(*) AS shared FROM k x JOIN k y ON x.chrom = y.chrom AND x.strand = y.strand AND x.j = y.j AND x.tx_id < y.tx_id GROUP BY ALL)",
        "SELECT a, b, shared, round(shared / (u.c + v.c - shared), 6) AS jaccard FROM p JOIN n u ON u.tx_id = a JOIN n v ON v.tx_id = b WHERE shared / (u.c + v.c - shared) >= 0.8",
    ),
    "diagnostic_alleles": """WITH n AS (SELECT l_returnflag AS copy, l_partkey AS pos, l_linestatus AS base, count(*) AS n FROM lineitem GROUP BY ALL),
      c AS (SELECT copy, pos, sum(n) OVER (PARTITION BY copy, pos) AS depth, base, n FROM n QUALIFY row_number() OVER (PARTITION BY copy, pos ORDER BY n DESC, base) = 1),
      d AS (SELECT * FROM c WHERE depth >= 3 AND n >= depth * 0.8)
      SELECT 0 AS family, pos, copy, depth::BIGINT AS depth, base, n FROM d WHERE pos IN (SELECT pos FROM d GROUP BY pos HAVING min(base) <> max(base))""",
    "stage_dashboard": f"SELECT stage_id, count(*) AS n_rows, {', '.join(f'sum({c})::BIGINT AS {c}' for c in ('n_reads', 'n_junctions', 'n_nodes', 'n_edges', 'n_transfrags', 'n_transcripts', 'seed_total', 'seed_stored', 'seed_rescued'))} FROM {NEXT5} GROUP BY stage_id",
    "stage_alignment": f'SELECT run_id, chrom, start, "end", strand, count(DISTINCT stage_id) AS n_stages, count(DISTINCT struct_hash) AS n_hashes FROM {NEXT5} WHERE chrom IS NOT NULL GROUP BY ALL',
    "needy_panel": "SELECT locus_id, max(priority_score) AS priority_score, max(n_needy_refs) AS n_needy_refs FROM ggo19_needy_top15 WHERE locus_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 15",
    "source_histogram": "SELECT source, count(*) AS n FROM aligned_reads GROUP BY 1",
    "partition_drift": """WITH a AS (SELECT DISTINCT run_id, chrom, split_part(x, '-', 1)::BIGINT AS s, split_part(x, '-', 2)::BIGINT + 1 AS e FROM (SELECT run_id, chrom, unnest(regexp_extract_all(signature, '[0-9]+-[0-9]+')) AS x FROM partition_geometry WHERE chrom IS NOT NULL)),
      b AS (SELECT DISTINCT run_id, chrom, start AS s, "end" AS e FROM nodes WHERE chrom IS NOT NULL AND start < "end"), f AS (SELECT count(*) AS n FROM a JOIN b USING (run_id, chrom, s, e))
      SELECT n AS found, (SELECT count(*) FROM b) - n AS missing, (SELECT count(*) FROM a) - n AS extra FROM f""",
    "session_windows": """SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n_events FROM (
      SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (
        SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS nw FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)) GROUP BY user_id, g""",
    "first_events": "SELECT user_id, event_type, min(event_id) AS event_id, count(*) AS n FROM events GROUP BY user_id, event_type, date_trunc('second', ts)",
}
