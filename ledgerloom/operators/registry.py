"""Append-only registry of assertions: lookups, histories, self-excluding baselines, cases and precedents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Observations from which a norm counts as established.
BASELINE = 3


def registry_keys(records: DataFrame) -> DataFrame:
    """``doc_id, key_type, key_value``: every handle a record can be found by."""
    c, bar = F.col, F.lit("|")
    keys = {
        "vendor": c("vendor"), "po_ref": c("po"), "po_vendor": F.concat(c("po"), bar, c("vendor")), "tax_id": c("tax_id"),
        "vendor_tax_id": F.concat(c("vendor"), bar, c("tax_id")), "vendor_invnum": F.concat(c("vendor"), bar, c("number")),
        "doc_ref": F.concat(c("doc_type"), bar, F.when(c("doc_type") == "purchase_order", c("po")).otherwise(c("number"))),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("key_type"), v.alias("key_value")) for k, v in keys.items()])
    return records.select("doc_id", F.inline(pairs)).filter("key_value is not null")


def append(records: DataFrame, path: str) -> None:
    """Appends assertions; a record is never changed, a later one supersedes it."""
    records.write.mode("append").parquet(path)


def latest(assertions: DataFrame, key: str = "doc_id", at: str = "asserted_at") -> DataFrame:
    """The newest assertion of each document (one row a key, combined before the shuffle)."""
    row = F.struct(*[F.col(c) for c in assertions.columns])
    return assertions.groupBy(key).agg(F.max_by(row, F.struct(at)).alias("r")).select("r.*")


def vendor_history(records: DataFrame, limit: int = 200) -> DataFrame:
    """The first ``limit`` records of each vendor by assertion time (a top-k report)."""
    w = Window.partitionBy("vendor").orderBy("asserted_at", "doc_id")
    return records.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit)


def by_reference(queries: DataFrame, records: DataFrame) -> DataFrame:
    """For each (doc_type, reference): documents with that own reference, else those that cite it as order."""
    own = queries.join(records.select("doc_type", F.col("number").alias("reference"), "doc_id"), ["doc_type", "reference"]).withColumn("how", F.lit("doc_ref"))
    missing = queries.join(own.select("doc_type", "reference").distinct(), ["doc_type", "reference"], "left_anti")
    cited = missing.join(records.select(F.col("po").alias("reference"), "doc_id"), "reference").withColumn("how", F.lit("po_ref"))
    return own.select("doc_type", "reference", "doc_id", "how").unionAll(cited.select("doc_type", "reference", "doc_id", "how"))


def deviations(records: DataFrame, value: str, group: str = "vendor") -> DataFrame:
    """Records whose ``value`` differs from the one norm of all other records of their group.

    A record is no evidence about itself: it is taken out of the counts. The norm must be unanimous
    among at least ``BASELINE`` others. Counts are made by value first, so a group that holds a
    third of all rows is never gathered.
    """
    known = records.filter(F.col(value).isNotNull())
    per_value = known.groupBy(group, value).agg(F.count("*").alias("n"))
    # unanimous without one record: a single value, or two of which one has that record alone
    norms = per_value.groupBy(group).agg(F.count("*").alias("n_values"), F.sum("n").alias("total"), F.max_by(value, "n").alias("norm"), F.max("n").alias("n_norm"))
    odd = norms.filter((F.col("n_values") == 2) & (F.col("total") - F.col("n_norm") == 1) & (F.col("n_norm") >= BASELINE))
    return known.join(odd.select(group, "norm", F.col("n_norm").alias("observations")), group).filter(F.col(value) != F.col("norm"))


def patterns(records: DataFrame, columns: list[str], group: str = "vendor") -> DataFrame:
    """For each group and column: number of values, observations and whether a norm is established."""
    out = None
    for c in columns:
        one = records.filter(F.col(c).isNotNull()).groupBy(group).agg(F.countDistinct(c).alias("n_values"), F.count("*").alias("observations"), F.min(c).alias("example"))
        one = one.select(group, F.lit(c).alias("pattern"), "n_values", "observations", ((F.col("n_values") == 1) & (F.col("observations") >= BASELINE)).alias("established"),
                         F.when(F.col("n_values") == 1, F.col("example")).alias("value"))
        out = one if out is None else out.unionAll(one)
    return out


def value_timeline(records: DataFrame, value: str, group: str = "vendor", at: str = "asserted_at") -> DataFrame:
    """First and last sight and count of each value of a group, with the latest one marked."""
    seen = records.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("n"))
    newest = Window.partitionBy(group).orderBy(F.desc("last_seen"), value)
    return seen.withColumn("is_latest", F.row_number().over(newest) == 1)


def references_missing(records: DataFrame, orders: DataFrame, cited: str, key: str) -> DataFrame:
    """Records that cite an order which isn't there."""
    return records.filter(F.col(cited).isNotNull()).join(orders.select(F.col(key).alias(cited)).distinct(), cited, "left_anti")


def payments_for(records: DataFrame, payments: DataFrame) -> DataFrame:
    """Payments recorded against each record and their sum."""
    paid = payments.groupBy("reference").agg(F.count("*").alias("n_payments"), F.sum("cents").alias("paid_cents"))
    return records.join(paid, "reference", "left").withColumn("n_payments", F.coalesce("n_payments", F.lit(0)))


def same_case(kind: str = "kind", subject: str = "subject", counterparts: str = "counterparts") -> list[Column]:
    return [F.col(kind), F.col(subject), F.array_sort(F.coalesce(F.col(counterparts), F.array().cast("array<string>"))).alias("who")]


def open_cases(requested: DataFrame, existing: DataFrame) -> DataFrame:
    """Requests for which no case of the same kind, subject and set of counterparts is open; each once."""
    keys = ["kind", "subject", "who"]
    fresh = requested.withColumn("who", same_case()[2])
    held = existing.filter("status = 'open'").withColumn("who", same_case()[2]).select(*keys).distinct()
    return fresh.join(held, keys, "left_anti").groupBy(*keys).agg(F.min("case_id").alias("case_id"))


def precedents(resolutions: DataFrame, limit: int = 3) -> DataFrame:
    """The last ``limit`` different resolutions of each kind and vendor (a top-k report)."""
    distinct = resolutions.filter("kind is not null and vendor_canon is not null").dropDuplicates(["resolution_id"])
    w = Window.partitionBy("kind", "vendor_canon").orderBy(F.desc("resolved_at"), "resolution_id")
    return distinct.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def case_status(cases: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Status of each case as its resolutions tell it; resolutions of cases that aren't there drop out."""
    done = resolutions.groupBy("case_id").agg(F.countDistinct("resolution_id").alias("n_resolutions"), F.max("resolved_at").alias("last_resolved"))
    return cases.join(done, "case_id", "left").select(
        "case_id", F.coalesce("n_resolutions", F.lit(0)).alias("n_resolutions"), "last_resolved",
        F.when(F.col("n_resolutions") > 0, "resolved").otherwise("open").alias("derived_status"))
