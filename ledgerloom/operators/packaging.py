"""Structured segments: selection, pairs, cleaning, checks, envelopes; all over the flat tables of ``nested``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.operators.nested import flat_table

SEGMENTS = "/machine_readable/segments/*"
# Cells that mean nothing.
NULL_CELLS = ["-", "n/a", "na", "nan", "none", "null", ""]


def canonical_type(name: Column) -> Column:
    """The leading word of a type: ``kv_block`` is kv."""
    found = F.regexp_extract(F.lower(name), r"^(kv|table|context|hierarchy|prose|mixed)(_|$)", 1)
    return F.when(found != "", found).otherwise(F.lower(name))


def segments(rows: DataFrame) -> DataFrame:
    """``env_id, ordinal, node_path, segment_id, type, confidence`` from triples."""
    flat = flat_table(rows, SEGMENTS, ["/segment_id", "/type", "/metadata/confidence"])
    return flat.select("env_id", "ordinal", "node_path", "segment_id", canonical_type(F.col("type")).alias("type"), F.col("metadata_confidence").try_cast("double").alias("confidence"))


def filter_segments(segs: DataFrame, types: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """By canonical type and least confidence; an unknown confidence passes."""
    kept = segs.filter(F.col("confidence").isNull() | (F.col("confidence") >= least))
    return kept.filter(F.col("type").isin(types)) if types else kept


def kv_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of each segment once, with the number of times and the first place they stand."""
    own = rows.filter(F.col("table") == SEGMENTS + "/content/pairs/*")
    member = lambda m: F.max(F.when(F.col("member") == m, F.col("value")))
    flat = own.groupBy("env_id", "node_path", "parent_path", "ordinal").agg(member("/key").alias("key"), member("/value").alias("value"))
    return flat.filter("`key` is not null").groupBy("env_id", "parent_path", "key", "value").agg(F.min("ordinal").alias("first"), F.count("*").alias("n"))


def table_cells(rows: DataFrame) -> DataFrame:
    """Cells of all tables of segments, tokens that mean nothing as null."""
    cells = rows.filter((F.col("table") == SEGMENTS + "/content/rows/*/*") & (F.col("member") == ""))
    value = F.when(~F.lower(F.trim(F.coalesce("value", F.lit("")))).isin(NULL_CELLS), F.col("value"))
    return cells.select("env_id", F.col("parent_path").alias("row_path"), F.col("ordinal").alias("column"), value.alias("value"))


def ragged_rows(cells: DataFrame) -> DataFrame:
    """Rows narrower or wider than the most frequent width of their table."""
    own = cells.withColumn("table_path", F.regexp_replace("row_path", r"/\d+$", ""))
    widths = own.groupBy("env_id", "table_path", "row_path").agg(F.count("*").alias("width"))
    counts = widths.groupBy("env_id", "table_path", "width").agg(F.count("*").alias("n"))
    modal = counts.groupBy("env_id", "table_path").agg(F.max_by("width", F.struct("n", "width")).alias("modal"))
    return widths.join(modal, ["env_id", "table_path"]).filter("width <> modal").select("env_id", "row_path", "width", "modal")


def conflicting_keys(pairs: DataFrame) -> DataFrame:
    """Keys that have more than one value in a segment."""
    return pairs.groupBy("env_id", "parent_path", "key").agg(F.countDistinct("value").alias("n_values")).filter("n_values > 1")


def depth_jumps(rows: DataFrame) -> DataFrame:
    """Hierarchy nodes that are more than one level deeper than the node before them."""
    flat = flat_table(rows, SEGMENTS + "/content/nodes/*", ["/depth"]).withColumn("depth", F.col("depth").try_cast("int"))
    w = Window.partitionBy("env_id", F.regexp_replace("node_path", r"/\d+$", "")).orderBy("ordinal")
    return flat.withColumn("before", F.lag("depth").over(w)).filter("depth - before > 1").select("env_id", "node_path", "depth", "before")


def flag_counts(rows: DataFrame) -> DataFrame:
    """How often each flag was raised, by envelope."""
    flags = rows.filter((F.col("table") == SEGMENTS + "/metadata/flags/*") & (F.col("member") == ""))
    return flags.groupBy("env_id", F.col("value").alias("flag")).agg(F.count("*").alias("n"))


def quality(segs: DataFrame, errors: DataFrame, warnings: DataFrame) -> DataFrame:
    """1 less 0.15 for each error and 0.05 for each warning a segment, within 0 and 1."""
    per = segs.groupBy("env_id").agg(F.count("*").alias("n"))
    count = lambda df, name: df.groupBy("env_id").agg(F.count("*").alias(name))
    both = per.join(count(errors, "errors"), "env_id", "left").join(count(warnings, "warnings"), "env_id", "left").fillna(0, ["errors", "warnings"])
    score = 1 - (0.15 * F.col("errors") + 0.05 * F.col("warnings")) / F.col("n")
    return both.select("env_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2).alias("quality"))


def source_id(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def latest_envelopes(envelopes: DataFrame) -> DataFrame:
    """The newest envelope of each source, by its own time stamp."""
    return envelopes.groupBy("source_id").agg(F.max_by("env_id", F.struct("envelope_ts", "env_id")).alias("env_id"), F.count("*").alias("n"))


def expiry(stored: Column, enabled: Column, auto_delete: Column, days: Column) -> Column:
    """When a stored result goes: after its days, in ten years where it is kept, else after six hours."""
    return F.when(enabled & auto_delete, stored + F.make_interval(days=days)).when(enabled, stored + F.expr("INTERVAL 3650 DAYS")).otherwise(stored + F.expr("INTERVAL 6 HOURS"))


def write_envelopes(envelopes: DataFrame, path: str) -> None:
    """Sink: JSON lines, a folder for each day."""
    envelopes.withColumn("day", F.to_date("envelope_ts")).write.mode("append").partitionBy("day").json(path)
