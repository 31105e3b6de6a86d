"""Views of structured segments for machines and readers, money lines, and coverage between blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.operators.packaging import SEGMENTS
from ledgerloom.operators.textlines import strip

#: Roles of money lines, the first whose words the label has.
ROLES = [("taxable", r"taxable|tax base"), ("tax", r"\b(?:tax|vat|gst|mwst|tva)\b"), ("discount", r"discount|rebate|rabatt"), ("shipping", r"shipping|freight|delivery"),
         ("subtotal", r"sub-?total|zwischensumme|sous-total"), ("total", r"total|amount due|balance|gesamtbetrag|zu zahlen|payer|amount paid")]
_MONEY = r"\(?[$£€¥]?\d[\d.,]*[.,]\d{2}\)?(?:[^\d.,]|$)"


def machine_records(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """One record a segment: its type, confidence and how many pairs, rows, nodes and lines it has."""
    parts = {"pairs": "/content/pairs/*", "rows": "/content/rows/*", "nodes": "/content/nodes/*", "lines": "/content/lines/*"}
    own = rows.filter((F.col("member") == "") & F.col("table").isin([SEGMENTS + p for p in parts.values()]))
    counts = own.groupBy("env_id", "parent_path").agg(*[F.count_if(F.col("table") == SEGMENTS + p).alias(n) for n, p in parts.items()])
    return segments.join(counts.withColumnRenamed("parent_path", "node_path"), ["env_id", "node_path"], "left").fillna(0, list(parts))


def render_pairs(rows: DataFrame) -> DataFrame:
    """The pairs of each segment as lines ``key: value`` in their order."""
    own = rows.filter((F.col("table") == SEGMENTS + "/content/pairs/*") & F.col("member").isin("/key", "/value"))
    pair = own.groupBy("env_id", "parent_path", "ordinal").agg(
        F.max(F.when(F.col("member") == "/key", F.col("value"))).alias("k"), F.max(F.when(F.col("member") == "/value", F.col("value"))).alias("v"))
    line = F.concat(F.coalesce("k", F.lit("")), F.lit(": "), F.coalesce("v", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line"))))
    return pair.groupBy("env_id", "parent_path").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def readable(text: Column) -> Column:
    """Without the markers that extraction put in."""
    return F.regexp_replace(F.regexp_replace(text, r"(?m)^\[(?:PAGE|SHEET|SEGMENT|VISUAL)[^\]]*\]\n?|^\[WORKBOOK\]\n?", ""), r"\n{3,}", "\n\n")


def money_role(label: Column) -> Column:
    s, out = F.lower(label), None
    for role, words in ROLES:
        out = (F.when if out is None else out.when)(s.rlike(words), F.lit(role))
    return out.otherwise("line")


def money_nodes(lines: DataFrame) -> DataFrame:
    """``doc_id, line_no, label, role, cents``: lines with an amount, by its last figure; brackets are negative."""
    figures = F.regexp_extract_all("normalized", F.lit("(" + _MONEY + ")"), F.lit(1))
    last = F.element_at(figures, -1)
    found = lines.filter(F.size(figures) > 0).select("doc_id", "line_no", strip(F.regexp_extract("normalized", r"^([^\d$£€¥(]*)", 1)).alias("label"), last.alias("figure"))
    digits = F.regexp_replace("figure", r"\D", "").cast("long")
    return found.select("doc_id", "line_no", F.regexp_replace("label", r"[:\s]+$", "").alias("label"), money_role(F.col("label")).alias("role"),
                        F.when(F.col("figure").startswith("("), -digits).otherwise(digits).alias("cents"))


def money_sections(nodes: DataFrame) -> DataFrame:
    """Sums of the lines against the stated subtotal, and of subtotal and tax against the total."""
    total = lambda r: F.sum(F.when(F.col("role") == r, F.col("cents")))
    sums = nodes.groupBy("doc_id").agg(total("line").alias("lines"), F.max(F.when(F.col("role") == "subtotal", F.col("cents"))).alias("subtotal"),
                                       F.coalesce(total("tax"), F.lit(0)).alias("tax"), F.max(F.when(F.col("role") == "total", F.col("cents"))).alias("total"))
    return sums.withColumn("subtotal_ok", F.abs(F.col("lines") - F.col("subtotal")) <= 1).withColumn("total_ok", F.abs(F.col("subtotal") + F.col("tax") - F.col("total")) <= 1)


def redundant_context(blocks: DataFrame, share: float = 0.8) -> DataFrame:
    """Context blocks of whose lines at least ``share`` stand in blocks of other sources."""
    lines = blocks.withColumn("line", F.explode(F.sequence("start_line", "end_line")))
    specific = lines.filter("source <> 'context'").select("doc_id", "line").distinct().withColumn("covered", F.lit(1))
    per = lines.filter("source = 'context'").join(specific, ["doc_id", "line"], "left").groupBy("doc_id", "block_id").agg(F.count("*").alias("n"), F.count("covered").alias("covered"))
    return per.filter(F.col("covered") >= share * F.col("n"))


def near_misses(a: DataFrame, b: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Lines with equal signature whose amounts differ, but by at most ``tolerance``."""
    j = a.alias("a").join(b.alias("b"), ["doc_id", "signature"])
    gap = F.abs(F.col("a.amount") - F.col("b.amount"))
    return j.filter((gap > 0.01) & (gap <= tolerance * F.col("a.amount"))).select("doc_id", "signature", F.col("a.line").alias("a_line"), F.col("b.line").alias("b_line"))
