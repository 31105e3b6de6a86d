"""Findings about records against their vendor's history, and the report that ranks them.

A finding is ``id, check, severity, detail``. Norms are aggregates by vendor that combine before the
shuffle and are joined back; a vendor with a third of all records is one row of norms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Records that a norm needs.
OBSERVED = 3
# Rank of severities.
SEVERITY = {"high": 0, "medium": 1, "low": 2}


def _findings(rows: DataFrame, check: str, severity: str, detail: Column) -> DataFrame:
    return rows.select("id", F.lit(check).alias("check"), F.lit(severity).alias("severity"), detail.alias("detail"))


def check_internal(records: DataFrame, tolerance: int = 1) -> DataFrame:
    """Records whose subtotal and tax (cents) don't make their total; those without subtotal or total aren't judged."""
    made = F.col("subtotal") + F.coalesce("tax", F.lit(0))
    bad = records.filter(F.abs(made - F.col("total")) > tolerance)
    return _findings(bad, "TOTAL_MISMATCH", "high", F.concat_ws(" vs ", made, "total"))


def check_duplicates(classified: DataFrame, allowed: tuple[str, ...] = ("LOW_CONFIDENCE", "RECURRING_INVOICE")) -> DataFrame:
    """The later record of each pair whose relationship isn't one of ``allowed``; one finding for each relationship."""
    bad = classified.filter(~F.col("relationship").isin(*allowed)).groupBy(F.col("b_id").alias("id"), "relationship").agg(F.min("a_id").alias("of"))
    return _findings(bad, "DUPLICATE", "high", F.concat_ws(" of ", "relationship", "of"))


def _norm(history: DataFrame, value: str) -> DataFrame:
    """Vendors with at least ``OBSERVED`` values that are all the same."""
    per = history.filter(F.col(value).isNotNull()).groupBy("vendor").agg(F.min(value).alias("norm"), F.max(value).alias("most"), F.count("*").alias("seen"))
    return per.filter((F.col("norm") == F.col("most")) & (F.col("seen") >= OBSERVED)).select("vendor", "norm")


def check_tax_rate(records: DataFrame, history: DataFrame) -> DataFrame:
    """Records whose effective rate (tax by subtotal, four digits) isn't the only one of the vendor's history."""
    rate = F.when(F.col("subtotal") > 0, F.round(F.col("tax") / F.col("subtotal"), 4))
    bad = records.withColumn("rate", rate).join(_norm(history.withColumn("rate", rate), "rate"), "vendor").filter("rate <> norm")
    return _findings(bad, "TAX_RATE_DEVIATION", "medium", F.concat_ws(" vs ", "rate", "norm"))


def check_missing_tax_id(records: DataFrame, history: DataFrame) -> DataFrame:
    """Records without a tax id of vendors whose history has one."""
    known = history.filter("tax_id is not null").select("vendor").distinct()
    return _findings(records.filter("tax_id is null").join(known, "vendor", "left_semi"), "TAX_ID_MISSING", "medium", F.lit("no tax id"))


def evaluate(*findings: DataFrame) -> DataFrame:
    """All findings of several checks."""
    out = findings[0]
    for f in findings[1:]:
        out = out.unionByName(f)
    return out


def by_kind(findings: DataFrame) -> DataFrame:
    """``check, severity, findings, records``."""
    return findings.groupBy("check", "severity").agg(F.count("*").alias("findings"), F.countDistinct("id").alias("records"))


def report(records: DataFrame, findings: DataFrame) -> DataFrame:
    """``id, status, headline, findings, confidence`` of every record.

    One finding counts for each topic (its check); a high one needs review, a medium one attention. Confidence is 0.98 less 0.03 a topic, at least 0.5.
    """
    rank = F.coalesce(*[F.when(F.col("severity") == k, F.lit(v)) for k, v in SEVERITY.items()], F.lit(9))
    topics = findings.withColumn("rank", rank).groupBy("id", "check").agg(F.min("rank").alias("rank"))
    per = topics.groupBy("id").agg(F.count("*").alias("findings"), F.min("rank").alias("worst"), F.min_by("check", F.struct("rank", "check")).alias("first"))
    j = records.select("id").join(per, "id", "left")
    status = F.when(F.col("worst") == 0, "needs_review").when(F.col("worst") == 1, "attention").otherwise("clear")
    more = F.when(F.col("findings") > 1, F.concat(F.lit(" and "), F.col("findings") - 1, F.lit(" more"))).otherwise("")
    headline = F.when(F.col("first").isNull(), "Nothing found.").otherwise(F.concat(F.initcap(F.replace("first", F.lit("_"), F.lit(" "))), more, F.lit(".")))
    confidence = F.round(F.greatest(F.lit(0.5), 0.98 - 0.03 * F.coalesce("findings", F.lit(0))), 2)
    return j.select("id", status.alias("status"), headline.alias("headline"), F.coalesce("findings", F.lit(0)).cast("long").alias("findings"), confidence.alias("confidence"))


def overlay(base: DataFrame, pending: DataFrame, key: str = "id") -> DataFrame:
    """The registry as it would be with ``pending``, which replaces what has the same key; nothing is written."""
    return base.join(pending.select(key), key, "left_anti").unionByName(pending.select(*base.columns))


def vendor_documents(records: DataFrame, recent: int = 10) -> DataFrame:
    """``vendor, id, at, position`` of each vendor's most recent records; ranks are cut before the shuffle of a large vendor."""
    w = Window.partitionBy("vendor").orderBy(F.desc("at"), "id")
    return records.select("vendor", "id", "at", F.row_number().over(w).alias("position")).filter(F.col("position") <= recent)


def kept_sessions(sessions: DataFrame, now: Column, many: int = 20) -> DataFrame:
    """Each owner's latest sessions that haven't expired."""
    w = Window.partitionBy("owner").orderBy(F.desc("created_at"), "session_id")
    return sessions.filter(F.col("expires_at") > now).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= many).drop("n")
