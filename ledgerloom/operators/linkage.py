"""Identity keys, candidate pairs, evidence and relationship types of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions import canon

# Weights of agreement and of conflict, in hundredths.
AGREE = {"invoice_number_exact": 60, "vendor_canon": 20, "amount_exact": 15, "currency_match": 5, "po_match": 25, "date_within_3d": 10}
CONFLICT = {"different_amount": -40, "different_currency": -60, "different_recipient": -30, "composition_differs": -20,
            "different_document_type": -35, "different_date_month": -10}


def canonicalize(records: DataFrame) -> DataFrame:
    """The canonical fields of rows of id, invoice_number, vendor, recipient, amount, currency, date, po_number, document_type.

    ``record_type`` (an invoice where it is missing), ``subtotal`` and ``tax`` are taken where the rows have them.
    """
    c = F.col
    given = lambda n: c(n) if n in records.columns else F.lit(None).cast("string")
    return records.select(
        "id", c("invoice_number").alias("raw_number"), c("vendor").alias("raw_vendor"),
        canon.alnum_upper(c("invoice_number")).alias("number"), canon.canon_vendor(c("vendor")).alias("vendor"),
        canon.canon_vendor(c("recipient")).alias("recipient"), canon.canon_amount(c("amount")).alias("amount"),
        canon.canon_currency(c("currency"), c("amount")).alias("currency"), canon.canon_date(c("date")).alias("date"),
        canon.alnum_upper(c("po_number")).alias("po"), canon.canon_doc_type(c("document_type")).alias("doc_type"),
        F.coalesce(F.lower(given("record_type")), F.lit("invoice")).alias("record_type"), canon.canon_amount(given("subtotal")).alias("subtotal"), canon.canon_amount(given("tax")).alias("tax"),
    )


def identity_keys(canonical: DataFrame) -> DataFrame:
    """``id, key_type, key_value``: the keys that can be formed; a missing part gives no key."""
    c, bar = F.col, F.lit("|")
    cents = F.round(c("amount") * 100).cast("long").cast("string")
    keys = {
        "vendor_invnum": F.concat(c("vendor"), bar, c("number")),
        "vendor_amount_curr": F.concat(c("vendor"), bar, cents, bar, c("currency")),
        "po": c("po"),
        "vendor_amount_month": F.concat(c("vendor"), bar, cents, bar, F.date_format("date", "yyyy-MM")),
        "invnum": c("number"),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("key_type"), v.alias("key_value")) for k, v in keys.items()])
    return canonical.select("id", "record_type", F.inline(pairs)).filter("key_value is not null")


def candidate_pairs(canonical: DataFrame) -> DataFrame:
    """``a_id, b_id``: distinct unordered pairs of one record type that share a key (an equi-join on exploded keys, never an OR).

    Records of different types share keys by rights, as an order and its invoice do; they are no candidates.
    """
    keys = identity_keys(canonical)
    left = keys.select("record_type", "key_type", "key_value", F.col("id").alias("a_id"))
    right = keys.select("record_type", "key_type", "key_value", F.col("id").alias("b_id"))
    return left.join(right, ["record_type", "key_type", "key_value"]).filter("a_id < b_id").select("a_id", "b_id").distinct()


def _same(name: str) -> Column:
    return F.coalesce(F.col(f"a.{name}") == F.col(f"b.{name}"), F.lit(False))


def _differ(name: str) -> Column:
    return F.coalesce(F.col(f"a.{name}") != F.col(f"b.{name}"), F.lit(False))


def evidence(pairs: DataFrame, canonical: DataFrame) -> DataFrame:
    """The facts of each pair and its scores for and against being the same (hundredths)."""
    a, b = canonical.alias("a"), canonical.alias("b")
    joined = pairs.join(a, F.col("a_id") == F.col("a.id")).join(b, F.col("b_id") == F.col("b.id"))
    amount = F.coalesce(F.abs(F.col("a.amount") - F.col("b.amount")) <= 0.0100001, F.lit(False))
    both = F.col("a.amount").isNotNull() & F.col("b.amount").isNotNull()
    days = F.abs(F.datediff("a.date", "b.date"))
    month = F.date_format("a.date", "yyyy-MM") == F.date_format("b.date", "yyyy-MM")
    apart = lambda n: F.coalesce(F.abs(F.col(f"a.{n}") - F.col(f"b.{n}")) > 0.0100001, F.lit(False))
    facts = joined.select(
        "a_id", "b_id", _same("number").alias("invnum_match"), _same("vendor").alias("vendor_match"), amount.alias("amount_match"),
        _same("currency").alias("currency_match"), _same("po").alias("po_match"), _differ("recipient").alias("recipient_differs"),
        canon.instruments_conflict(F.col("a.doc_type"), F.col("b.doc_type")).alias("doc_type_differs"),
        _differ("number").alias("invnum_differs"), _differ("currency").alias("currency_differs"), both.alias("both_amounts"), (amount & (apart("subtotal") | apart("tax"))).alias("composition_differs"),
        days.alias("days_apart"), month.alias("same_month"),
        (_same("raw_number") & _same("raw_vendor") & (F.trim("a.raw_number") != "")).alias("surface_same"),
    )
    c = F.col
    plus = {"invoice_number_exact": c("invnum_match"), "vendor_canon": c("vendor_match"), "amount_exact": c("amount_match"),
            "currency_match": c("currency_match"), "po_match": c("po_match"), "date_within_3d": F.coalesce(c("days_apart") <= 3, F.lit(False))}
    minus = {"different_amount": c("both_amounts") & ~c("amount_match"), "different_currency": c("currency_differs"),
             "different_recipient": c("recipient_differs"), "composition_differs": c("composition_differs"), "different_document_type": c("doc_type_differs"),
             "different_date_month": F.coalesce(~c("same_month"), F.lit(False))}
    total = lambda signals, weights: sum((F.when(v, weights[k]).otherwise(0) for k, v in signals.items()), F.lit(0))
    names = lambda signals: F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in signals.items()]))
    return facts.withColumns({
        "positive": total(plus, AGREE), "negative": total(minus, CONFLICT),
        "signals": F.array_join(F.concat(names(plus), names(minus)), ","),
        "provable": c("invnum_match") & c("vendor_match") & c("amount_match") & c("currency_match"),
    })


def classify(found: DataFrame) -> DataFrame:
    """``relationship`` of each pair by the first rule that holds."""
    c = F.col
    kind = (
        F.when(c("invnum_match") & c("vendor_match") & (c("recipient_differs") | c("doc_type_differs") | c("composition_differs")), "IDENTITY_COLLISION")
        .when(c("provable") & c("surface_same"), "EXACT_DUPLICATE")
        .when(c("provable"), "NORMALIZED_DUPLICATE")
        .when(c("invnum_match") & c("vendor_match") & ~c("amount_match") & c("both_amounts"), "CORRECTED_INVOICE")
        .when(c("invnum_match") & c("amount_match") & c("currency_match") & ~c("vendor_match"), "VENDOR_VARIANT_DUPLICATE")
        .when(c("vendor_match") & c("amount_match") & c("currency_match") & (c("same_month") == False) & ~c("invnum_match"), "RECURRING_INVOICE")  # noqa: E712
        .when(c("po_match") & c("vendor_match") & c("invnum_differs") & (c("amount_match") | c("both_amounts")), "SPLIT_INVOICE_SUSPECT")
        .otherwise("LOW_CONFIDENCE")
    )
    return found.withColumn("relationship", kind)
