"""Two-source matching: keyed record sets, lines of two documents, verdicts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.functions.canon import blank_null, normalize_value


def with_key(records: DataFrame, fields: list[str], normalizers: list[str]) -> DataFrame:
    """Adds ``match_key``: the normalised fields joined, null if any is missing or empty."""
    parts = [blank_null(normalize_value(F.col(f).cast("string"), normalizers)) for f in fields]
    return records.withColumn("match_key", reduce(lambda x, y: F.concat(x, F.lit("|"), y), parts))


def match_pairs(a: DataFrame, b: DataFrame, compare: dict, key: str = "match_key") -> DataFrame:
    """Full outer one-to-one match of two keyed sides (columns ``id``, key, and the compared fields).

    A key repeated on either side is set aside as NOT_ONE_TO_ONE; rows without a key are one-sided.
    ``compare`` maps a check's name to a function of the two sides' column prefixes.
    """
    side = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != key], F.col(key).alias(key))
    la, rb = side(a, "a"), side(b, "b")
    count = lambda df, n: df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(n))
    repeated = count(la, "na").join(count(rb, "nb"), key, "full_outer").filter("na > 1 or nb > 1").select(key)
    keyed = lambda df: df.filter(F.col(key).isNotNull()).join(repeated, key, "left_anti")
    joined = keyed(la).join(keyed(rb), key, "full_outer")
    aside = la.join(repeated, key, "left_semi").unionByName(rb.join(repeated, key, "left_semi"), allowMissingColumns=True)
    lonely = la.filter(F.col(key).isNull()).unionByName(rb.filter(F.col(key).isNull()), allowMissingColumns=True)
    checks = [f("a_", "b_") for f in compare.values()]
    passed = sum((F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0) for c in checks), F.lit(0))
    consistent = reduce(lambda x, y: x & y, [F.coalesce(c, F.lit(True)) for c in checks])
    kind = (F.when(F.col("a_id").isNull(), "RIGHT_ONLY").when(F.col("b_id").isNull(), "LEFT_ONLY")
            .when(consistent, "MATCH").otherwise("MISMATCH"))
    out = joined.unionByName(lonely, allowMissingColumns=True).withColumn("relationship", kind)
    out = out.unionByName(aside.withColumn("relationship", F.lit("NOT_ONE_TO_ONE")), allowMissingColumns=True)
    share = F.when(F.col("relationship").isin("MATCH", "MISMATCH"), passed / F.lit(len(checks)))
    return out.select("relationship", key, "a_id", "b_id", share.alias("confidence"))


def edge_identity(pairs: DataFrame, weights: dict[str, float], keystone: str, threshold: float = 0.7) -> DataFrame:
    """Weighted agreement of the fields that both sides have; the keystone field alone is enough."""
    both = {f: F.col(f"a_{f}").isNotNull() & F.col(f"b_{f}").isNotNull() for f in weights}
    norm = lambda p, f: normalize_value(F.col(f"{p}_{f}").cast("string"), ["lower", "trim", "collapse_ws"])
    same = {f: both[f] & (norm("a", f) == norm("b", f)) for f in weights}
    pick = lambda cond: sum((F.when(cond[f], w).otherwise(0.0) for f, w in weights.items()), F.lit(0.0))
    score = F.round(pick(same) / F.nullif(pick(both), F.lit(0.0)), 4)
    status = F.when(same[keystone], "PASS").when(F.col("score") >= threshold, "PASS").when(F.col("score").isNull(), "NOT_CHECKED").otherwise("FAIL")
    return pairs.withColumn("score", score).withColumn("status", status)


def line_candidates(a: DataFrame, b: DataFrame, floor: float = 0.75) -> DataFrame:
    """Lines of one document pair with equal signature and enough agreement in quantity and amount."""
    joined = a.alias("a").join(b.alias("b"), ["doc_id", "signature"])
    agree = lambda f: F.coalesce(F.abs(F.col(f"a.{f}") - F.col(f"b.{f}")) <= 0.001, F.lit(False))
    score = F.round(0.5 + F.when(agree("quantity"), 0.25).otherwise(0.0) + F.when(agree("amount"), 0.25).otherwise(0.0), 4)
    return joined.select("doc_id", F.col("a.line").alias("a_line"), F.col("b.line").alias("b_line"), score.alias("score")).filter(F.col("score") >= floor)


def align_lines(candidates: DataFrame) -> DataFrame:
    """Greedy one-to-one alignment in each document, best score first, then line order.

    One pass over partitions that are sorted by document; only one document's taken lines are held.
    """

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, used_a, used_b = None, set(), set()
        for batch in batches:
            keep = []
            for doc, a, b in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "a_line", "b_line"))):
                if doc != current:
                    current, used_a, used_b = doc, set(), set()
                take = a not in used_a and b not in used_b
                if take:
                    used_a.add(a)
                    used_b.add(b)
                keep.append(take)
            yield batch.filter(pa.array(keep, pa.bool_()))

    ordered = candidates.repartition("doc_id").sortWithinPartitions("doc_id", F.desc("score"), "a_line", "b_line")
    return ordered.mapInArrow(greedy, candidates.schema)


def split_groups(a: DataFrame, b: DataFrame) -> DataFrame:
    """Signatures with one line on one side and several on the other, and whether the sums agree."""
    total = lambda df, p: df.groupBy("doc_id", "signature").agg(
        F.count("*").alias(f"{p}_lines"), F.sum("quantity").alias(f"{p}_quantity"), F.sum("amount").alias(f"{p}_amount"))
    both = total(a, "a").join(total(b, "b"), ["doc_id", "signature"])
    kind = F.when((F.col("a_lines") == 1) & (F.col("b_lines") > 1), "SPLIT").when((F.col("a_lines") > 1) & (F.col("b_lines") == 1), "MERGE")
    close = lambda f: F.coalesce(F.abs(F.col(f"a_{f}") - F.col(f"b_{f}")) < 0.01, F.lit(False))
    return both.withColumn("kind", kind).filter("kind is not null").select(
        "doc_id", "signature", "kind", "a_lines", "b_lines", close("quantity").alias("quantity_ok"), close("amount").alias("amount_ok"))


def unmatched_lines(a: DataFrame, b: DataFrame) -> DataFrame:
    """Lines whose signature is missing on the other side."""
    keys = ["doc_id", "signature"]
    one = lambda x, y, s: x.join(y.select(*keys).distinct(), keys, "left_anti").select(F.lit(s).alias("side"), "doc_id", "line", "signature")
    return one(a, b, "A").unionAll(one(b, a, "B"))


def verdict(dimensions: DataFrame, key: str = "id") -> DataFrame:
    """Folds rows of ``id, dimension, status``: any FAIL, else any NOT_CHECKED, else RECONCILED."""
    names = lambda s: F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("dimension")))), ",")
    return dimensions.groupBy(key).agg(
        F.when(F.bool_or(F.col("status") == "FAIL"), "EXCEPTION").when(F.bool_or(F.col("status") == "NOT_CHECKED"), "INCOMPLETE")
        .otherwise("RECONCILED").alias("overall"), names("FAIL").alias("failed"), names("NOT_CHECKED").alias("not_checked"))


def nearest_previous(lines: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """As-of lookup within a group: the last non-null ``value`` before each row."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn(f"previous_{value}", F.last(value, ignorenulls=True).over(w))
