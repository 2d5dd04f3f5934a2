"""Queries over the text corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from splicelake.llm.leakage import leaked_items
from splicelake.llm.normal import look_alike_members, look_alike_pairs
from splicelake.llm.tokens import encode_corpus
from splicelake.sources.tables import table


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return look_alike_pairs(table(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return look_alike_members(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p7_ids, p8_found, p9_found, p9_classes)}
ORACLES: dict[str, str] = {}
