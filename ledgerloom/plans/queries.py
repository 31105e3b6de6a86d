"""Queries of the core operators by name: callables over (spark, sf_dir) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators.nested import elements, flat_table, triples
from ledgerloom.plans import engine_queries, form_queries, record_queries, registry_queries, source_queries, text_queries, view_queries
from ledgerloom.operators.timestamps import capture_instants
from ledgerloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return capture_instants(table(spark, d, "dedupe_docs"), table(spark, d, "dedupe_requests"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return elements(table(spark, d, "coc_envelopes"))


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of all key-value pairs of the segments, pivoted from its triples."""
    return flat_table(triples(table(spark, d, "coc_envelopes")), "/machine_readable/segments/*/content/pairs/*",
                      ["/key", "/value", "/delimiter"])


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p5_found": p5_found, "p5_pairs": p5_pairs}
SQL: dict[str, str] = {}
for _module in (record_queries, registry_queries, text_queries, form_queries, source_queries, view_queries, engine_queries):
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
