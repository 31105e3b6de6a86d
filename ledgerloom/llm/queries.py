"""Queries of the ``llm`` operators by name: callables over (spark, sf_dir) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm.duplicates import collapse
from ledgerloom.llm.history import resubmissions
from ledgerloom.llm.matching import deals
from ledgerloom.llm.names import name_pairs
from ledgerloom.llm.packing import fill, pack
from ledgerloom.llm.passages import shared_chars
from ledgerloom.llm.tokens import decode, encode
from ledgerloom.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return collapse(table(spark, d, "dedupe_docs"))[1]


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    return collapse(table(spark, d, "dedupe_docs"))[0]


def p3_matches(spark: SparkSession, d: str) -> DataFrame:
    found = deals(table(spark, d, "relationships"), table(spark, d, "reconcile_requests"))
    return found.select(F.least("id_l", "id_r").alias("id_1"), F.greatest("id_l", "id_r").alias("id_2"), "confidence")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_matches(spark, d).select("id_1", "id_2")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return resubmissions(table(spark, d, "dedupe_docs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    cases, resolutions = table(spark, d, "cases"), table(spark, d, "resolutions")
    return name_pairs(cases.select("vendor_canon").unionAll(resolutions.select("vendor_canon")), "vendor_canon")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The exact round trip: encoded and decoded again; null texts come back empty."""
    return decode(encode(table(spark, d, "documents")))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"), table(spark, d, "pack_specs"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill(p8_packed(spark, d), table(spark, d, "pack_specs"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_chars(table(spark, d, "documents"))


_P2_FORMS = r"""
WITH forms AS (
  SELECT doc_key, array_to_string(list_sort(list_filter(regexp_split_to_array(
    regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}\n\r|;•]+', '', 'g'), '[\n\r|;•]+'), lambda x: x <> '')), chr(10)) AS form
  FROM dedupe_docs WHERE text IS NOT NULL),
groups AS (SELECT form, min(doc_key) AS first_key, count(*) AS copies FROM forms GROUP BY form)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_records": p2_records,
    "p3_found": p3_found,
    "p3_matches": p3_matches,
    "p4_found": p4_found,
    "p6_found": p6_found,
    "p7_ids": p7_ids,
    "p7_decoded": p7_decoded,
    "p8_packed": p8_packed,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
}

SQL: dict[str, str] = {
    "p2_found": _P2_FORMS + "SELECT g.first_key, f.doc_key FROM forms f JOIN groups g USING (form) WHERE f.doc_key <> g.first_key",
    "p2_records": _P2_FORMS + "SELECT first_key, copies FROM groups UNION ALL SELECT doc_key, 1 FROM dedupe_docs WHERE text IS NULL",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
