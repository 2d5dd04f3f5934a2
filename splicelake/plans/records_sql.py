"""SQL oracles of the queries in ``records``."""

from __future__ import annotations

SNAPSHOTS = "ggo19_needy_top5_run_strg_157"

P2 = f"""
WITH r AS (
  SELECT snap_id, record::JSON AS j FROM {SNAPSHOTS} WHERE record IS NOT NULL AND json_valid(record)
), objs AS (
  SELECT snap_id, -1 AS graph_pos, j AS o, true AS top FROM r
  UNION ALL
  SELECT snap_id, (u.pos - 1)::INT, u.g, false FROM (
    SELECT snap_id, CASE WHEN json_type(j, '$.graphs') = 'ARRAY' THEN from_json(j->'$.graphs', '["json"]')
                         WHEN json_type(j, '$.graphs') IS NULL OR json_type(j, '$.graphs') = 'NULL' THEN []
                         ELSE [j->'$.graphs'] END AS gs
    FROM r) q, LATERAL (SELECT unnest(gs) AS g, unnest(range(1, len(gs) + 1)) AS pos) u
), arrs AS (
  SELECT snap_id, graph_pos, top, name,
         CASE WHEN json_type(o, '$.' || name) = 'ARRAY' THEN from_json(json_extract(o, '$.' || name), '["json"]')
              WHEN json_type(o, '$.' || name) IS NULL OR json_type(o, '$.' || name) = 'NULL' THEN []
              ELSE [json_extract(o, '$.' || name)] END AS xs
  FROM objs, (VALUES ('nodes'), ('transfrags'), ('junctions')) n(name)
  WHERE top OR name <> 'junctions'
), els AS (
  SELECT snap_id, graph_pos, name, (u.pos - 1)::INT AS pos, u.x
  FROM arrs, LATERAL (SELECT unnest(xs) AS x, unnest(range(1, len(xs) + 1)) AS pos) u
), tf AS (
  SELECT snap_id, graph_pos, pos,
         CASE WHEN json_type(x, '$.node_ids') = 'ARRAY' THEN from_json(x->'$.node_ids', '["json"]')
              WHEN json_type(x, '$.node_ids') IS NULL OR json_type(x, '$.node_ids') = 'NULL' THEN []
              ELSE [x->'$.node_ids'] END AS ids
  FROM els WHERE name = 'transfrags'
)
SELECT snap_id, 'node' AS child, graph_pos, -1 AS parent_pos, pos, coalesce(try_cast(x->>'$.id' AS BIGINT), -1) AS val
FROM els WHERE name = 'nodes'
UNION ALL
SELECT snap_id, 'junction', graph_pos, -1, pos, coalesce(try_cast(x->>'$.donor' AS BIGINT), -1) FROM els WHERE name = 'junctions'
UNION ALL
SELECT snap_id, 'transfrag', graph_pos, -1, pos, len(ids)::BIGINT FROM tf
UNION ALL
SELECT snap_id, 'transfrag_node', graph_pos, pos, (u.p - 1)::INT, coalesce(try_cast(u.x->>'$' AS BIGINT), -1)
FROM tf, LATERAL (SELECT unnest(ids) AS x, unnest(range(1, len(ids) + 1)) AS p) u
"""

P2_NODES = P2[: P2.index(", tf AS (")] + """
SELECT snap_id, graph_pos, pos, x->>'$.id' AS id, x->>'$.start' AS start, x->>'$.end' AS "end", x->>'$.cov' AS cov,
  x->>'$.hardstart' AS hardstart, x->>'$.hardend' AS hardend FROM els WHERE name = 'nodes'
"""

_PARITY_BAD = """CASE
 WHEN NOT regexp_full_match(v[1], 'LOCG\\.[0-9]+') THEN 'gene_id'
 WHEN NOT regexp_full_match(v[3], '[0-9]{1,18}') THEN 'start'
 WHEN NOT regexp_full_match(v[4], '[0-9]{1,18}') OR v[4]::BIGINT < v[3]::BIGINT THEN 'end'
 WHEN NOT regexp_full_match(v[5], '[+.-]') THEN 'strand'
 WHEN NOT regexp_full_match(v[6], '[0-9]{1,18}') THEN 'ref_transcripts'
 WHEN NOT regexp_full_match(v[7], '[0-9]{1,18}') THEN 'live_bundle_rows'
 WHEN NOT regexp_full_match(v[8], '[0-9]{1,18}') THEN 'live_bundle_bnodes'
 WHEN NOT regexp_full_match(v[9], '[0-9]{1,18}') THEN 'live_graph_rows'
 WHEN NOT regexp_full_match(v[10], '[0-9]{1,18}') THEN 'live_graph_active_transfrags'
 WHEN NOT regexp_full_match(v[11], '[0-9]{1,18}') THEN 'live_final_seed_total'
 WHEN NOT regexp_full_match(v[12], '[0-9]{1,18}') THEN 'live_final_seed_stored' ELSE '' END"""
_CHAIN_BAD = """CASE
 WHEN NOT regexp_full_match(v[1], 'LOCG\\.[0-9]+') THEN 'gene_id'
 WHEN NOT regexp_full_match(v[2], 'LOCG\\.[0-9]+\\.[0-9]+') THEN 'tx_id'
 WHEN NOT regexp_full_match(v[4], '[+.-]') THEN 'strand'
 WHEN NOT regexp_full_match(v[5], '[0-9]+-[0-9]+') OR split_part(v[5], '-', 2)::HUGEINT < split_part(v[5], '-', 1)::HUGEINT THEN 'span'
 WHEN NOT regexp_full_match(v[6], 'exons=[0-9]{1,18}') OR split_part(v[6], '=', 2)::BIGINT < 1 THEN 'exons'
 WHEN NOT regexp_full_match(v[7], 'introns=[0-9]{1,18}') THEN 'introns' ELSE '' END"""


def _lines(tbl: str, n: int, bad: str) -> str:
    column = ' *(?:"(?:[^"]|"")*" *|[^" \\t][^\\t]*)?'
    return f"""
SELECT line_id, '{tbl}' AS tbl, v,
  CASE WHEN NOT regexp_full_match(line, '(?s){column}(?:\\t{column})*') THEN 'quoting'
       WHEN len(v) <> {n} THEN 'column_count' WHEN {bad} <> '' THEN 'bad_value' ELSE '' END AS reason,
  CASE WHEN regexp_full_match(line, '(?s){column}(?:\\t{column})*') AND len(v) = {n} THEN {bad} ELSE '' END AS field
FROM (SELECT line_id, line, list_transform(
        regexp_extract_all(line || chr(9), '(?s)( *"(?:[^"]|"")*" *|[^\\t]*)\\t', 1),
        lambda x: trim(CASE WHEN regexp_full_match(trim(x, ' '), '(?s)"(?:[^"]|"")*"')
                       THEN replace(substr(trim(x, ' '), 2, length(trim(x, ' ')) - 2), '""', '"') ELSE x END, ' ')) AS v
  FROM (SELECT line_id, regexp_replace(raw, '\\r$', '') AS line FROM {tbl} WHERE raw IS NOT NULL) a
  WHERE trim(line, ' ' || chr(9) || chr(10) || chr(13)) <> ''
    AND NOT starts_with(ltrim(line, ' ' || chr(9) || chr(10)), '#')
    AND NOT starts_with(ltrim(line, ' "' || chr(9) || chr(10)), 'gene_id')) b"""


_BOTH = {
    "compare_live_parity_to_backward": _lines("compare_live_parity_to_backward", 14, _PARITY_BAD),
    "gtf_chain_audit": _lines("gtf_chain_audit", 9, _CHAIN_BAD),
}
P3 = " UNION ALL ".join(f"SELECT tbl, line_id, reason, field FROM ({s}) WHERE reason <> ''" for s in _BOTH.values())

P3_PARITY = f"""
SELECT line_id, v[1] AS gene_id, v[2] AS chrom, v[3]::BIGINT AS start, v[4]::BIGINT AS "end", v[5] AS strand,
  v[6]::BIGINT AS ref_transcripts, v[7]::BIGINT AS live_bundle_rows, v[8]::BIGINT AS live_bundle_bnodes,
  v[9]::BIGINT AS live_graph_rows, v[10]::BIGINT AS live_graph_active_transfrags,
  v[11]::BIGINT AS live_final_seed_total, v[12]::BIGINT AS live_final_seed_stored,
  v[13] AS earliest_live_divergence, v[14] AS divergence_detail
FROM ({_BOTH["compare_live_parity_to_backward"]}) WHERE reason = ''"""
P3_CHAINS = f"""
SELECT line_id, v[1] AS gene_id, v[2] AS tx_id, v[3] AS chrom, v[4] AS strand,
  split_part(v[5], '-', 1)::BIGINT AS span_start, split_part(v[5], '-', 2)::BIGINT AS span_end,
  split_part(v[6], '=', 2)::BIGINT AS exons, split_part(v[7], '=', 2)::BIGINT AS introns,
  v[8] AS exon_preview, v[9] AS intron_preview
FROM ({_BOTH["gtf_chain_audit"]}) WHERE reason = ''"""


def _packed(tbl: str, field: str, pattern: str, names: bool = False) -> str:
    xs = f"regexp_extract_all(trim({field}, ' '), '{pattern}')"
    if names:
        xs = f"""list_filter(list_transform({xs}, lambda x: trim(CASE
          WHEN length(x) > 1 AND x[1] = '"' THEN replace(substr(x, 2, length(x) - 2), '""', '"')
          WHEN length(x) > 1 AND x[1] = '''' THEN replace(substr(x, 2, length(x) - 2), '''''', '''') ELSE x END, ' ')),
          lambda x: x NOT IN ('', '-', '.'))"""
    return f"""SELECT '{tbl}' AS tbl, row_id, pos::INT AS pos, val FROM (
      SELECT row_id, unnest(xs) AS val, unnest(range(1, len(xs) + 1)) AS pos FROM (
        SELECT row_id, {xs} AS xs FROM {tbl} WHERE trim({field}, ' ') NOT IN ('', '-', '.')))"""


P4 = " UNION ALL ".join(
    (
        _packed("aligned_reads", "exons", "[0-9]+-[0-9]+"),
        _packed("flow_iterations", "path_nodes", "[0-9]+"),
        _packed("ggo19_needy_top15", "absent_refs", r"""\"(?:[^\"]|\"\")*\"|''(?:[^'']|'''')*''|[^\s,;|/\"''\[\]{}]+""", True),
        _packed("partition_geometry", "signature", "[0-9]+-[0-9]+"),
    )
)


def _islands(src: str, tbl: str, entity: str, keys: str, step: int) -> str:
    return f"""
SELECT '{tbl}' AS tbl, {entity} AS entity, kind, p_start, p_end FROM (
  WITH v AS ({src}),
  a AS (SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM v),
  b AS (SELECT *, sum(CASE WHEN prev IS NULL OR s - {step} > prev THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY s, e) AS isl FROM a),
  p AS (SELECT {keys}, isl, min(s) AS p_start, max(e) AS p_end FROM b GROUP BY {keys}, isl),
  g AS (SELECT *, lag(p_end) OVER (PARTITION BY {keys} ORDER BY isl) AS before FROM p)
  SELECT {keys}, 'period' AS kind, p_start, p_end FROM p
  UNION ALL SELECT {keys}, 'gap', before + {step}, p_start - {step} FROM g WHERE before IS NOT NULL)"""


P5 = (
    _islands(
        """SELECT run_id, chrom, coalesce(strand, 0) AS strand, start AS s, "end" AS e FROM aligned_reads
           WHERE chrom IS NOT NULL AND start <= "end" """,
        "aligned_reads",
        "coalesce(run_id, '') || '|' || chrom || '|' || strand",
        "run_id, chrom, strand",
        1,
    )
    + " UNION ALL "
    + _islands(
        """SELECT run_id, chrom, bdstart, bdend, strand, start AS s, "end" AS e FROM nodes
           WHERE chrom IS NOT NULL AND start < "end" """,
        "nodes",
        "coalesce(run_id, '') || '|' || chrom || '|' || coalesce(bdstart::VARCHAR, '') || '|' || coalesce(bdend::VARCHAR, '') || '|' || coalesce(strand, '')",
        "run_id, chrom, bdstart, bdend, strand",
        0,
    )
)

P6 = """
SELECT 'aligned_reads' AS tbl, chrom, count(*) AS n_rows, count(DISTINCT read_name) AS n_things,
  sum(CASE WHEN start <= "end" THEN "end" - start + 1 ELSE 0 END)::BIGINT AS total
FROM aligned_reads WHERE chrom IS NOT NULL GROUP BY chrom
UNION ALL
SELECT 'ggo19_needy_next5_run_strg_29', chrom, count(*), count(DISTINCT struct_hash), sum(coalesce(n_reads, 0))::BIGINT
FROM ggo19_needy_next5_run_strg_29 WHERE chrom IS NOT NULL GROUP BY chrom"""

ORACLES = {
    "p2_found": P2, "p2_nodes": P2_NODES, "p3_found": P3, "p3_parity_rows": P3_PARITY, "p3_chain_rows": P3_CHAINS, "p4_found": P4, "p5_found": P5, "p6_found": P6,
}
