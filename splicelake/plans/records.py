"""Queries over logs, snapshots, raw lines, packed fields, spans and hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splicelake.operators.islands import periods_and_gaps
from splicelake.operators.logs import line_kinds, log_entries
from splicelake.operators.nested import path_triples, pivot_paths
from splicelake.operators.packed import INTEGERS, NAMES, SPANS, split_packed
from splicelake.operators.rejects import Layout, judge_lines
from splicelake.operators.skew import per_key_report
from splicelake.session import spread
from splicelake.sources.tables import table

SNAPSHOTS = "ggo19_needy_top5_run_strg_157"
COUNTERS = "ggo19_needy_next5_run_strg_29"
PANEL = "ggo19_needy_top15"

_COUNT = "[0-9]{1,18}"
_STRAND = "[+.-]"


def _end_before_start(v: dict[str, Column]) -> Column:
    digits = v["start"].rlike(f"^{_COUNT}$") & v["end"].rlike(f"^{_COUNT}$")
    return digits & (v["end"].try_cast("long") < v["start"].try_cast("long"))


def _span_reversed(v: dict[str, Column]) -> Column:
    """By number of digits, then as text: a span may have more digits than any integer type."""
    a, b = (F.ltrim(F.regexp_extract(v["span"], "^([0-9]+)-([0-9]+)$", k), F.lit("0")) for k in (1, 2))
    return (F.length(b) < F.length(a)) | ((F.length(b) == F.length(a)) & (b < a))


PARITY = Layout(
    columns=(
        "gene_id", "chrom", "start", "end", "strand", "ref_transcripts", "live_bundle_rows", "live_bundle_bnodes",
        "live_graph_rows", "live_graph_active_transfrags", "live_final_seed_total", "live_final_seed_stored",
        "earliest_live_divergence", "divergence_detail",
    ),
    patterns={
        "gene_id": r"LOCG\.[0-9]+",
        "strand": _STRAND,
        **{
            c: _COUNT
            for c in (
                "start", "end", "ref_transcripts", "live_bundle_rows", "live_bundle_bnodes", "live_graph_rows",
                "live_graph_active_transfrags", "live_final_seed_total", "live_final_seed_stored",
            )
        },
    },
    faults={"end": _end_before_start},
)

CHAINS = Layout(
    columns=("gene_id", "tx_id", "chrom", "strand", "span", "exons", "introns", "exon_preview", "intron_preview"),
    patterns={
        "gene_id": r"LOCG\.[0-9]+",
        "tx_id": r"LOCG\.[0-9]+\.[0-9]+",
        "strand": _STRAND,
        "span": "[0-9]+-[0-9]+",
        "exons": "exons=(?=0*[1-9])[0-9]{1,18}",
        "introns": f"introns={_COUNT}",
    },
    faults={"span": _span_reversed},
)

LINES = {"compare_live_parity_to_backward": PARITY, "gtf_chain_audit": CHAINS}
PACKED = (
    ("aligned_reads", "exons", SPANS),
    ("flow_iterations", "path_nodes", INTEGERS),
    (PANEL, "absent_refs", NAMES),
    ("partition_geometry", "signature", SPANS),
)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return log_entries(table(spark, d, "trace_decision_extract"))


def p1_layouts(spark: SparkSession, d: str) -> DataFrame:
    """Lines by layout, and those that look like a header but are of no known layout."""
    return line_kinds(table(spark, d, "trace_decision_extract"))


TOPS = ("", "graphs[].")


def _triples(spark: SparkSession, d: str, wanted: set[str]) -> DataFrame:
    arrays = {"graphs", "junctions"} | {f"{p}{a}" for p in TOPS for a in ("nodes", "transfrags", "transfrags[].node_ids")}
    return path_triples(spread(table(spark, d, SNAPSHOTS)), "snap_id", "record", arrays, wanted)


def _long(c: Column) -> Column:
    exact = c.try_cast("decimal(38, 6)")
    return F.coalesce(c.try_cast("long"), F.when(F.abs(exact) < F.lit(9 * 10**18), exact.cast("long")), F.lit(-1))


# tables by the name of the repeated ancestor
CHILDREN = {"nodes": "node", "junctions": "junction", "transfrags": "transfrag", "node_ids": "transfrag_node"}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    wanted = {"junctions[]", "junctions[].donor"} | {p + x for p in TOPS for x in ("nodes[]", "nodes[].id", "transfrags[]", "transfrags[].node_ids[]")}
    p = pivot_paths(_triples(spark, d, wanted), leaves=("id", "donor"), children=("node_ids",))
    last = F.regexp_extract("ancestor", r"([^.\[]+)\[\]$", 1)
    child = F.coalesce(*[F.when(last == k, v) for k, v in CHILDREN.items()])
    none, at = F.lit(-1), lambda k: F.element_at("ords", k)
    value = F.when(F.col("child") == "node", F.col("id")).when(F.col("child") == "junction", F.col("donor")).otherwise(F.col("value"))
    return p.withColumn("child", child).where("child IS NOT NULL").select(
        F.col("__id").alias("snap_id"),
        "child",
        F.when(F.col("ancestor").startswith("graphs[]"), at(1)).otherwise(none).alias("graph_pos"),
        F.when(F.col("child") == "transfrag_node", at(-2)).otherwise(none).alias("parent_pos"),
        at(-1).alias("pos"),
        F.when(F.col("child") == "transfrag", F.col("n_node_ids")).otherwise(_long(value)).alias("val"),
    )


def p2_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The table of nodes with all its columns, as text; absent or null parts are null."""
    leaves = ("id", "start", "end", "cov", "hardstart", "hardend")
    wanted = {f"{p}nodes[]{x}" for p in TOPS for x in ("", *[f".{n}" for n in leaves])}
    p = pivot_paths(_triples(spark, d, wanted), leaves).where(F.col("ancestor").endswith("nodes[]"))
    graph = F.when(F.size("ords") > 1, F.element_at("ords", 1)).otherwise(F.lit(-1))
    return p.select(F.col("__id").alias("snap_id"), graph.alias("graph_pos"), F.element_at("ords", -1).alias("pos"), *leaves)


def _judged(spark: SparkSession, d: str) -> list[DataFrame]:
    return [
        judge_lines(spread(table(spark, d, t)), layout).withColumn("tbl", F.lit(t)) for t, layout in LINES.items()
    ]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [x.where("reason <> ''").select("tbl", "line_id", "reason", "field") for x in _judged(spark, d)]
    return reduce(DataFrame.unionByName, parts)


def p3_edits(spark: SparkSession, d: str) -> DataFrame:
    """The failing lines whose quotes or columns are wrong, with the least edits that mend them."""
    parts = [x.where("edits <> ''").select("tbl", "line_id", "reason", "edits") for x in _judged(spark, d)]
    return reduce(DataFrame.unionByName, parts)


def p3_parity_rows(spark: SparkSession, d: str) -> DataFrame:
    """The valid lines of compare_live_parity_to_backward, typed."""
    x = _judged(spark, d)[0].where("reason = ''")
    longs = [c for c in PARITY.columns if PARITY.patterns.get(c) == _COUNT]
    return x.select("line_id", *[F.col(c).cast("long").alias(c) if c in longs else F.col(c) for c in PARITY.columns])


def p3_chain_rows(spark: SparkSession, d: str) -> DataFrame:
    """The valid lines of gtf_chain_audit, with counts and span typed."""
    x = _judged(spark, d)[1].where("reason = ''")
    num = lambda c: F.split(F.col(c), "=")[1].cast("long").alias(c)
    return x.select(
        "line_id", "gene_id", "tx_id", "chrom", "strand",
        F.expr("try_cast(split(span, '-')[0] AS bigint)").alias("span_start"),
        F.expr("try_cast(split(span, '-')[1] AS bigint)").alias("span_end"),
        num("exons"), num("introns"), "exon_preview", "intron_preview",
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        split_packed(table(spark, d, t), "row_id", f, packing).select(F.lit(t).alias("tbl"), "row_id", "pos", "val")
        for t, f, packing in PACKED
    ]
    return reduce(DataFrame.unionByName, parts)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    reads = table(spark, d, "aligned_reads").where("chrom IS NOT NULL").withColumn("strand", F.coalesce("strand", F.lit(0)))
    nodes = table(spark, d, "nodes").where("chrom IS NOT NULL")
    parts = []
    for name, df, keys, closed in (
        ("aligned_reads", reads, ["run_id", "chrom", "strand"], True),
        ("nodes", nodes, ["run_id", "chrom", "bdstart", "bdend", "strand"], False),
    ):
        x = periods_and_gaps(df, keys, closed=closed)
        entity = F.concat_ws("|", *[text(k) for k in keys]).alias("entity")
        parts.append(x.select(F.lit(name).alias("tbl"), entity, "kind", "p_start", "p_end"))
    return reduce(DataFrame.unionByName, parts)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    reads = table(spark, d, "aligned_reads")
    counters = table(spark, d, COUNTERS)
    span = F.when(F.col("start") <= F.col("end"), F.col("end") - F.col("start") + 1)
    parts = [
        per_key_report(reads, "chrom", "read_name", span).withColumn("tbl", F.lit("aligned_reads")),
        per_key_report(counters, "chrom", "struct_hash", F.col("n_reads")).withColumn("tbl", F.lit(COUNTERS)),
    ]
    return reduce(DataFrame.unionByName, parts).select("tbl", "chrom", "n_rows", "n_things", "total")


QUERIES = {f.__name__: f for f in (p1_found, p1_layouts, p2_found, p2_nodes, p3_found, p3_edits, p3_parity_rows, p3_chain_rows, p4_found, p5_found, p6_found)}

from splicelake.plans.records_sql import ORACLES  # noqa: E402,F401
