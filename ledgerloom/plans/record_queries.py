"""Queries over records: canonical forms, links, rules and two-source matching, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.functions import canon
from ledgerloom.operators import linkage, recordsets, rules
from ledgerloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- invoices made from orders, and second copies of seven kinds --------------------------------
_INV = """inv AS (
  SELECT o_orderkey AS id, 'INV-' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS invoice_number,
    'Supplier ' || (o_orderkey % 100) || ' Ltd' AS vendor, c_name AS recipient,
    CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
    CASE o_custkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS currency,
    CAST(o_orderdate AS DATE) AS date, 'PO-' || (o_orderkey - o_orderkey % 4) AS po_number
  FROM orders JOIN customer ON o_custkey = c_custkey),
copies AS (
  SELECT id + 100000000 AS id,
    CASE id % 10 WHEN 1 THEN lower(replace(invoice_number, '-', ' ')) WHEN 4 THEN 'N' || invoice_number WHEN 5 THEN 'S' || invoice_number ELSE invoice_number END AS invoice_number,
    CASE id % 10 WHEN 1 THEN upper(replace(vendor, 'Ltd', 'Limited')) WHEN 3 THEN replace(vendor, 'Supplier', 'Vendor') ELSE vendor END AS vendor,
    CASE id % 10 WHEN 6 THEN recipient || ' Branch' ELSE recipient END AS recipient,
    CASE id % 10 WHEN 2 THEN cents + 1000 ELSE cents END AS cents, currency,
    CASE id % 10 WHEN 4 THEN CAST(date + INTERVAL 1 MONTH AS DATE) ELSE date END AS date, po_number
  FROM inv WHERE id % 10 <= 7),
records AS (
  SELECT id, invoice_number, vendor, recipient, cents, currency, date, po_number,
    CASE WHEN id % 7 = 3 THEN 'purchase_order' ELSE 'invoice' END AS record_type, CASE WHEN id % 10 = 7 THEN id // 100000000 END AS tax,
    (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS amount
  FROM (SELECT * FROM inv UNION ALL SELECT * FROM copies)),
canon AS (
  SELECT id, invoice_number AS raw_number, vendor AS raw_vendor, upper(regexp_replace(invoice_number, '[^A-Za-z0-9]', '', 'g')) AS number,
    upper(regexp_replace(lower(vendor), '( (ltd|limited))+$', '')) AS vendor, upper(recipient) AS recipient, cents, currency, date,
    upper(regexp_replace(po_number, '[^A-Za-z0-9]', '', 'g')) AS po, record_type, tax
  FROM records)"""
_PAIRS = _INV + """,
keys AS (
  SELECT id, record_type, 'vendor_invnum' AS key_type, vendor || '|' || number AS key_value FROM canon UNION ALL
  SELECT id, record_type, 'vendor_amount_curr', vendor || '|' || cents || '|' || currency FROM canon UNION ALL
  SELECT id, record_type, 'po', po FROM canon UNION ALL
  SELECT id, record_type, 'vendor_amount_month', vendor || '|' || cents || '|' || strftime(date, '%Y-%m') FROM canon UNION ALL
  SELECT id, record_type, 'invnum', number FROM canon),
pairs AS (SELECT DISTINCT a.id AS a_id, b.id AS b_id FROM keys a JOIN keys b USING (record_type, key_type, key_value) WHERE a.id < b.id)"""
_FACTS = _PAIRS + """,
facts AS (
  SELECT a_id, b_id, a.number = b.number AS invnum_match, a.vendor = b.vendor AS vendor_match, abs(a.cents - b.cents) <= 1 AS amount_match,
    a.currency = b.currency AS currency_match, a.po = b.po AS po_match, a.recipient <> b.recipient AS recipient_differs,
    abs(a.date - b.date) AS days_apart, strftime(a.date, '%Y-%m') = strftime(b.date, '%Y-%m') AS same_month,
    a.raw_number = b.raw_number AND a.raw_vendor = b.raw_vendor AS surface_same,
    abs(a.cents - b.cents) <= 1 AND coalesce(a.tax <> b.tax, false) AS composition_differs
  FROM pairs JOIN canon a ON a_id = a.id JOIN canon b ON b_id = b.id),
scored AS (
  SELECT *, 60 * invnum_match::INT + 20 * vendor_match::INT + 15 * amount_match::INT + 5 * currency_match::INT + 25 * po_match::INT + 10 * (days_apart <= 3)::INT AS positive,
    -40 * (NOT amount_match)::INT - 60 * (NOT currency_match)::INT - 30 * recipient_differs::INT - 20 * composition_differs::INT - 10 * (NOT same_month)::INT AS negative,
    invnum_match AND vendor_match AND amount_match AND currency_match AS provable
  FROM facts),
typed AS (
  SELECT *, CASE
    WHEN invnum_match AND vendor_match AND (recipient_differs OR composition_differs) THEN 'IDENTITY_COLLISION'
    WHEN provable AND surface_same THEN 'EXACT_DUPLICATE' WHEN provable THEN 'NORMALIZED_DUPLICATE'
    WHEN invnum_match AND vendor_match AND NOT amount_match THEN 'CORRECTED_INVOICE'
    WHEN invnum_match AND amount_match AND currency_match AND NOT vendor_match THEN 'VENDOR_VARIANT_DUPLICATE'
    WHEN vendor_match AND amount_match AND currency_match AND NOT same_month AND NOT invnum_match THEN 'RECURRING_INVOICE'
    WHEN po_match AND vendor_match AND NOT invnum_match THEN 'SPLIT_INVOICE_SUSPECT' ELSE 'LOW_CONFIDENCE' END AS relationship
  FROM scored)"""


def invoices(spark: SparkSession, d: str) -> DataFrame:
    """Records of orders and their second copies, of two types, some with another tax in the same total."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    inv = o.join(c, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "o_orderkey AS id", "concat('INV-', lpad(cast(o_orderkey AS string), 7, '0')) AS invoice_number",
        "concat('Supplier ', o_orderkey % 100, ' Ltd') AS vendor", "c_name AS recipient", "cast(round(o_totalprice * 100) AS bigint) AS cents",
        "CASE o_custkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS currency", "cast(o_orderdate AS date) AS date",
        "concat('PO-', o_orderkey - o_orderkey % 4) AS po_number")
    copies = inv.filter("id % 10 <= 7").selectExpr(
        "id + 100000000 AS id",
        "CASE id % 10 WHEN 1 THEN lower(replace(invoice_number, '-', ' ')) WHEN 4 THEN concat('N', invoice_number) WHEN 5 THEN concat('S', invoice_number) ELSE invoice_number END AS invoice_number",
        "CASE id % 10 WHEN 1 THEN upper(replace(vendor, 'Ltd', 'Limited')) WHEN 3 THEN replace(vendor, 'Supplier', 'Vendor') ELSE vendor END AS vendor",
        "CASE id % 10 WHEN 6 THEN concat(recipient, ' Branch') ELSE recipient END AS recipient",
        "CASE id % 10 WHEN 2 THEN cents + 1000 ELSE cents END AS cents", "currency",
        "CASE id % 10 WHEN 4 THEN add_months(date, 1) ELSE date END AS date", "po_number")
    return inv.unionByName(copies).selectExpr(
        "id", "invoice_number", "vendor", "recipient", "concat(cents div 100, '.', lpad(cast(cents % 100 AS string), 2, '0')) AS amount", "currency",
        "cast(date AS string) AS date", "po_number", "'Invoice' AS document_type",
        "CASE WHEN id % 7 = 3 THEN 'purchase_order' ELSE 'invoice' END AS record_type", "CASE WHEN id % 10 = 7 THEN concat(id div 100000000, '.00') END AS tax")


def _evidence(spark, d):
    c = linkage.canonicalize(invoices(spark, d))
    return linkage.classify(linkage.evidence(linkage.candidate_pairs(c), c))


@query("WITH " + _INV + " SELECT id, number, vendor, recipient, cents, currency, date, po FROM canon")
def canonical_invoices(spark, d):
    c = linkage.canonicalize(invoices(spark, d))
    return c.select("id", "number", "vendor", "recipient", F.round(F.col("amount") * 100).cast("long").alias("cents"), "currency", "date", "po")


@query("WITH " + _PAIRS + " SELECT key_type, count(*) AS n, count(DISTINCT key_value) AS n_values FROM keys GROUP BY 1")
def identity_key_counts(spark, d):
    return linkage.identity_keys(linkage.canonicalize(invoices(spark, d))).groupBy("key_type").agg(
        F.count("*").alias("n"), F.countDistinct("key_value").alias("n_values"))


@query("WITH " + _PAIRS + " SELECT * FROM pairs")
def dedup_pairs(spark, d):
    return linkage.candidate_pairs(linkage.canonicalize(invoices(spark, d)))


@query("WITH " + _FACTS + " SELECT a_id, b_id, positive, negative, provable, days_apart, same_month FROM scored")
def dedup_evidence(spark, d):
    return _evidence(spark, d).select("a_id", "b_id", "positive", "negative", "provable", "days_apart", "same_month")


@query("WITH " + _FACTS + " SELECT a_id, b_id, relationship FROM typed")
def dedup_classified(spark, d):
    return _evidence(spark, d).select("a_id", "b_id", "relationship")


@query("WITH " + _FACTS + " SELECT relationship, count(*) AS n, sum(positive + negative) AS net FROM typed GROUP BY 1")
def dedup_summary_by_type(spark, d):
    return _evidence(spark, d).groupBy("relationship").agg(F.count("*").alias("n"), F.sum(F.col("positive") + F.col("negative")).alias("net"))


# ---- scalar forms over the noisy columns ---------------------------------------------------------
_TAIL = "|".join(canon.VENDOR_TAIL)


@query(rf"""
WITH s AS (SELECT vendor_canon AS v, regexp_replace(trim(lower(regexp_replace(vendor_canon, '[.,]', '', 'g'))), '\s+', ' ', 'g') AS b FROM cases WHERE vendor_canon IS NOT NULL),
t AS (SELECT v, b, regexp_replace(b, '( ({_TAIL}))+$', '') AS short FROM s)
SELECT v AS vendor, nullif(upper(CASE WHEN regexp_matches(short, '^({_TAIL})$') THEN b ELSE short END), '') AS canonical, count(*) AS n FROM t GROUP BY 1, 2""")
def canon_vendor(spark, d):
    v = table(spark, d, "cases").filter("vendor_canon is not null")
    return v.select(F.col("vendor_canon").alias("vendor"), canon.canon_vendor(F.col("vendor_canon")).alias("canonical")).groupBy("vendor", "canonical").agg(F.count("*").alias("n"))


_MONEY = r"""lines AS (SELECT doc_key, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line FROM dedupe_docs),
money AS (SELECT doc_key, regexp_extract(line, '^[A-Z][^:]*: ([0-9][0-9.,]* [A-Z]{3})$', 1) AS raw FROM lines)"""


def _money(spark, d):
    lines = table(spark, d, "dedupe_docs").select("doc_key", F.explode(F.split("text", "\r?\n")).alias("line"))
    return lines.select("doc_key", F.regexp_extract("line", r"^[A-Z][^:]*: ([0-9][0-9.,]* [A-Z]{3})$", 1).alias("raw")).filter("raw <> ''")


@query("WITH " + _MONEY + r"""
, f AS (SELECT doc_key, raw, regexp_extract(raw, '^[0-9.,]*[0-9]') AS s, regexp_extract(raw, '[A-Z]{3}$') AS currency FROM money WHERE raw <> '')
SELECT doc_key, raw, currency, CASE
  WHEN regexp_full_match(s, '\d{1,3}(,\d{3})+(\.\d*)?') THEN CAST(round(CAST(replace(s, ',', '') AS DOUBLE) * 100) AS BIGINT)
  WHEN regexp_full_match(s, '\d+\.?\d*') THEN CAST(round(CAST(s AS DOUBLE) * 100) AS BIGINT)
  WHEN regexp_full_match(s, '\d{1,3}(\.\d{3})+(,\d*)?') THEN CAST(round(CAST(replace(replace(s, '.', ''), ',', '.') AS DOUBLE) * 100) AS BIGINT)
  WHEN regexp_full_match(s, '\d+,\d{2}') THEN CAST(round(CAST(replace(s, ',', '.') AS DOUBLE) * 100) AS BIGINT) END AS cents
FROM f""")
def canon_amount_us_eu(spark, d):
    return _money(spark, d).select("doc_key", "raw", canon.canon_currency(F.col("raw")).alias("currency"),
                                   F.round(canon.canon_amount(F.col("raw")) * 100).cast("long").alias("cents"))


@query(r"""
WITH lines AS (SELECT doc_key, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line FROM dedupe_docs),
raw AS (SELECT doc_key, trim(regexp_extract(line, '^(Invoice|Order|Payment) Date: ([A-Za-z0-9, -]+)$', 2)) AS s FROM lines)
SELECT doc_key, s AS raw, CAST(coalesce(try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%d %B %Y'), try_strptime(s, '%B %d, %Y'), try_strptime(s, '%d-%b-%Y')) AS DATE) AS date
FROM raw WHERE s <> ''""")
def canon_date(spark, d):
    lines = table(spark, d, "dedupe_docs").select("doc_key", F.explode(F.split("text", "\r?\n")).alias("line"))
    raw = lines.select("doc_key", F.regexp_extract("line", r"^(Invoice|Order|Payment) Date: ([A-Za-z0-9, -]+)$", 2).alias("raw")).filter("raw <> ''")
    return raw.select("doc_key", F.trim("raw").alias("raw"), canon.canon_date(F.col("raw")).alias("date"))


@query(r"""
WITH lines AS (SELECT doc_key, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line FROM dedupe_docs),
raw AS (SELECT regexp_extract(line, '^(Invoice Number|Inv\. no|Ref #|Document ref): ([A-Za-z0-9/-]+)$', 2) AS s FROM lines)
SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '[A-Za-z]', 'A', 'g'), '[0-9]', '9', 'g'), 'A{2,}', 'A+', 'g'), '9{2,}', '9+', 'g') AS signature,
  count(*) AS n FROM raw WHERE s <> '' GROUP BY 1""")
def number_signature(spark, d):
    lines = table(spark, d, "dedupe_docs").select(F.explode(F.split("text", "\r?\n")).alias("line"))
    raw = lines.select(F.regexp_extract("line", r"^(Invoice Number|Inv\. no|Ref #|Document ref): ([A-Za-z0-9/-]+)$", 2).alias("s")).filter("s <> ''")
    return raw.groupBy(canon.number_signature(F.col("s")).alias("signature")).agg(F.count("*").alias("n"))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '\s+', ' ', 'g'), '[^0-9a-z]', '', 'g') AS form FROM part")
def normalize_value(spark, d):
    return table(spark, d, "part").select("p_partkey", canon.normalize_value(F.col("p_name"), ["lower", "trim", "collapse_ws", "alnum"]).alias("form"))


@query("""
WITH t AS (SELECT DISTINCT o_orderpriority AS p FROM orders), docs AS (SELECT * FROM (VALUES ('INVOICE'), ('CREDIT NOTE'), ('STATEMENT'), ('PURCHASE ORDER'), ('QUOTE')) v(k))
SELECT a.k AS a, b.k AS b, coalesce(a.k <> b.k AND a.k IN ('INVOICE','CREDIT NOTE','PURCHASE ORDER') AND b.k IN ('INVOICE','CREDIT NOTE','PURCHASE ORDER'), false) AS conflict
FROM docs a, docs b""")
def instruments_conflict(spark, d):
    kinds = spark.createDataFrame([(x,) for x in ("Tax invoice", "credit memo", "Billing statement", "Purchase order 7", "Quotation")], "raw string")
    kinds = kinds.select(canon.canon_doc_type(F.col("raw")).alias("k"))  # five rows
    a, b = kinds.select(F.col("k").alias("a"), F.lit(1).alias("j")), kinds.select(F.col("k").alias("b"), F.lit(1).alias("j"))
    return a.join(b, "j").select("a", "b", canon.instruments_conflict(F.col("a"), F.col("b")).alias("conflict"))


# ---- rules -----------------------------------------------------------------------------------------
RULES = [
    {"id": "has_clerk", "type": "exists", "field": "o_orderpriority"},
    {"id": "price_form", "type": "match", "field": "price_text", "format": "number", "requires": ["price_text"]},
    {"id": "status_known", "type": "contains", "field": "o_orderstatus", "allowed": ["F", "O"]},
    {"id": "price_high", "type": "compare", "op": ">=", "left": "o_totalprice", "right": {"const": 1000}},
    {"id": "lines_count", "type": "compute", "operation": "count", "inputs": ["items.price"], "op": ">=", "target": {"const": 3}, "requires": ["items"]},
    {"id": "lines_max", "type": "compute", "operation": "max", "inputs": ["items.price"], "op": "<", "target": {"const": 40000}, "requires": ["items"]},
    {"id": "lines_sum", "type": "compute", "operation": "sum", "inputs": ["items.quantity"], "equals": "declared", "tolerance": 0.5, "requires": ["items", "declared"]},
]
_VIEWS = """
WITH li AS (SELECT l_orderkey, count(*) AS n, max(l_extendedprice) AS high, sum(l_quantity) AS qty FROM lineitem GROUP BY 1),
v AS (SELECT o_orderkey AS id, o_orderpriority, o_orderstatus, o_totalprice, n, high, qty,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE qty + (o_orderkey % 2) END AS declared FROM orders LEFT JOIN li ON o_orderkey = l_orderkey),
r AS (
  SELECT id, 'has_clerk' AS rule_id, CASE WHEN trim(o_orderpriority) <> '' THEN 'PASS' ELSE 'FAIL' END AS status FROM v UNION ALL
  SELECT id, 'price_form', 'PASS' FROM v UNION ALL
  SELECT id, 'status_known', CASE WHEN o_orderstatus IN ('F', 'O') THEN 'PASS' ELSE 'FAIL' END FROM v UNION ALL
  SELECT id, 'price_high', CASE WHEN o_totalprice >= 1000 THEN 'PASS' ELSE 'FAIL' END FROM v UNION ALL
  SELECT id, 'lines_count', CASE WHEN n IS NULL THEN 'SKIPPED' WHEN n >= 3 THEN 'PASS' ELSE 'FAIL' END FROM v UNION ALL
  SELECT id, 'lines_max', CASE WHEN n IS NULL THEN 'SKIPPED' WHEN high < 40000 THEN 'PASS' ELSE 'FAIL' END FROM v UNION ALL
  SELECT id, 'lines_sum', CASE WHEN n IS NULL OR declared IS NULL THEN 'SKIPPED' WHEN abs(qty - declared) <= 0.5 THEN 'PASS' ELSE 'FAIL' END FROM v)
"""


def order_views(spark, d):
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.struct(F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))).alias("items"), F.sum("l_quantity").alias("qty"))
    o = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select(F.col("o_orderkey").alias("id"), "o_orderpriority", "o_orderstatus", "o_totalprice", F.round(F.col("o_totalprice") * 100).cast("long").cast("string").alias("price_text"),
                    "items", F.when(F.col("o_orderkey") % 5 != 0, F.col("qty") + F.col("o_orderkey") % 2).alias("declared"))


@query(_VIEWS + "SELECT id, rule_id, status FROM r")
def rules_evaluated(spark, d):
    return rules.evaluate(order_views(spark, d), RULES).select("id", "rule_id", "status")


@query(_VIEWS + """SELECT id, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'FAIL') AS failed,
  count(*) FILTER (WHERE status = 'SKIPPED') AS skipped FROM r GROUP BY id""")
def rules_summary(spark, d):
    return rules.summarize(rules.evaluate(order_views(spark, d), RULES))


# ---- two sources ---------------------------------------------------------------------------------
_LEDGERS = """
WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'ref ' || (o_orderkey - (CASE WHEN o_orderkey % 50 = 2 THEN 1 ELSE 0 END)) END AS reference,
    CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders WHERE o_orderkey % 7 <> 3),
b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'REF-' || o_orderkey END AS reference,
    CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderkey % 6 = 0 THEN 50 ELSE 0 END AS cents FROM orders WHERE o_orderkey % 5 <> 4),
ka AS (SELECT id, cents, nullif(regexp_replace(lower(reference), '[^0-9a-z]', '', 'g'), '') AS k FROM a),
kb AS (SELECT id, cents, nullif(regexp_replace(lower(reference), '[^0-9a-z]', '', 'g'), '') AS k FROM b),
rep AS (SELECT k FROM ka WHERE k IS NOT NULL GROUP BY 1 HAVING count(*) > 1 UNION SELECT k FROM kb WHERE k IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
m AS (SELECT coalesce(x.k, y.k) AS match_key, x.id AS a_id, y.id AS b_id, x.cents = y.cents AS same
  FROM (SELECT * FROM ka WHERE k NOT IN (SELECT k FROM rep)) x FULL JOIN (SELECT * FROM kb WHERE k NOT IN (SELECT k FROM rep)) y ON x.k = y.k),
res AS (
  SELECT CASE WHEN a_id IS NULL THEN 'RIGHT_ONLY' WHEN b_id IS NULL THEN 'LEFT_ONLY' WHEN same THEN 'MATCH' ELSE 'MISMATCH' END AS relationship, match_key, a_id, b_id,
    CASE WHEN a_id IS NOT NULL AND b_id IS NOT NULL THEN CAST(CASE WHEN same THEN 1 ELSE 0 END AS DOUBLE) END AS confidence FROM m
  UNION ALL SELECT 'LEFT_ONLY', NULL, id, NULL, NULL FROM ka WHERE k IS NULL UNION ALL SELECT 'RIGHT_ONLY', NULL, NULL, id, NULL FROM kb WHERE k IS NULL
  UNION ALL SELECT 'NOT_ONE_TO_ONE', k, id, NULL, NULL FROM ka WHERE k IN (SELECT k FROM rep) UNION ALL SELECT 'NOT_ONE_TO_ONE', k, NULL, id, NULL FROM kb WHERE k IN (SELECT k FROM rep))
"""


def _ledgers(spark, d):
    o = table(spark, d, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    a = o.filter("o_orderkey % 7 <> 3").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 11 <> 0 THEN concat('ref ', o_orderkey - CASE WHEN o_orderkey % 50 = 2 THEN 1 ELSE 0 END) END AS reference", "cents")
    b = o.filter("o_orderkey % 5 <> 4").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 13 <> 0 THEN concat('REF-', o_orderkey) END AS reference", "cents + CASE WHEN o_orderkey % 6 = 0 THEN 50 ELSE 0 END AS cents")
    keyed = lambda df: recordsets.with_key(df, ["reference"], ["lower", "trim", "alnum"]).drop("reference")
    return recordsets.match_pairs(keyed(a), keyed(b), {"amount": lambda x, y: F.col(f"{x}cents") == F.col(f"{y}cents")})


@query(_LEDGERS + "SELECT * FROM res")
def match_pairs_full_outer(spark, d):
    return _ledgers(spark, d)


@query(_LEDGERS + "SELECT relationship, count(*) AS n, count(confidence) AS scored FROM res GROUP BY 1")
def match_summary(spark, d):
    return _ledgers(spark, d).groupBy("relationship").agg(F.count("*").alias("n"), F.count("confidence").alias("scored"))


@query(r"""
WITH p AS (SELECT DISTINCT left_rec.rec_id AS a_id, right_rec.rec_id AS b_id, regexp_replace(trim(lower(left_rec.reference)), '\s+', ' ', 'g') AS ra, regexp_replace(trim(lower(right_rec.reference)), '\s+', ' ', 'g') AS rb, left_rec.currency AS ca, right_rec.currency AS cb,
  regexp_replace(trim(lower(left_rec.city)), '\s+', ' ', 'g') AS la, regexp_replace(trim(lower(right_rec.town)), '\s+', ' ', 'g') AS lb FROM relationships WHERE relationship IN ('MATCH', 'MISMATCH')),
s AS (SELECT *, (CASE WHEN ra = rb THEN 0.5 ELSE 0.0 END) + (CASE WHEN ca = cb THEN 0.2 ELSE 0.0 END) + (CASE WHEN la = lb THEN 0.3 ELSE 0.0 END) AS same,
  (CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN 0.5 ELSE 0.0 END) + (CASE WHEN ca IS NOT NULL AND cb IS NOT NULL THEN 0.2 ELSE 0.0 END) + (CASE WHEN la IS NOT NULL AND lb IS NOT NULL THEN 0.3 ELSE 0.0 END) AS known FROM p)
SELECT a_id, b_id, CAST(round(same / nullif(known, 0) * 1000) AS BIGINT) AS score, CASE WHEN ra = rb THEN 'PASS' WHEN round(same / nullif(known, 0), 4) >= 0.7 THEN 'PASS' WHEN known = 0 THEN 'NOT_CHECKED' ELSE 'FAIL' END AS status FROM s""")
def edge_identity(spark, d):
    r = table(spark, d, "relationships").filter("relationship in ('MATCH', 'MISMATCH')")
    pairs = r.selectExpr("left_rec.rec_id AS a_id", "right_rec.rec_id AS b_id", "left_rec.reference AS a_reference", "right_rec.reference AS b_reference", "left_rec.currency AS a_currency",
                         "right_rec.currency AS b_currency", "left_rec.city AS a_place", "right_rec.town AS b_place").distinct()
    found = recordsets.edge_identity(pairs, {"reference": 0.5, "currency": 0.2, "place": 0.3}, "reference")
    return found.select("a_id", "b_id", F.round(F.col("score") * 1000).cast("long").alias("score"), "status")


_LINES = """
WITH a AS (SELECT l_orderkey AS doc_id, l_linenumber AS line, CAST(l_partkey AS VARCHAR) AS signature, l_quantity AS quantity, l_extendedprice AS amount FROM lineitem),
b AS (
  SELECT doc_id, line, signature, CASE WHEN line % 3 = 0 THEN quantity + 1 ELSE quantity END AS quantity, amount FROM a WHERE (doc_id + line) % 9 <> 0 AND (doc_id + line) % 8 <> 0
  UNION ALL SELECT doc_id, line + 100 * n, signature, quantity / 2, amount / 2 FROM a, (VALUES (1), (2)) v(n) WHERE (doc_id + line) % 9 <> 0 AND (doc_id + line) % 8 = 0)
"""


def _two_sides(spark, d):
    a = table(spark, d, "lineitem").selectExpr("l_orderkey AS doc_id", "l_linenumber AS line", "cast(l_partkey AS string) AS signature", "l_quantity AS quantity", "l_extendedprice AS amount")
    kept = a.filter("(doc_id + line) % 9 <> 0")
    whole = kept.filter("(doc_id + line) % 8 <> 0").selectExpr("doc_id", "line", "signature", "CASE WHEN line % 3 = 0 THEN quantity + 1 ELSE quantity END AS quantity", "amount")
    halves = kept.filter("(doc_id + line) % 8 = 0").withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).selectExpr(
        "doc_id", "line + 100 * n AS line", "signature", "quantity / 2 AS quantity", "amount / 2 AS amount")
    return a, whole.unionByName(halves)


@query()
def align_lines(spark, d):
    return recordsets.align_lines(recordsets.line_candidates(*_two_sides(spark, d)))


@query(_LINES + """, x AS (SELECT doc_id, signature, count(*) AS n, sum(quantity) AS q, sum(amount) AS m FROM a GROUP BY 1, 2), y AS (SELECT doc_id, signature, count(*) AS n, sum(quantity) AS q, sum(amount) AS m FROM b GROUP BY 1, 2)
SELECT doc_id, signature, CASE WHEN x.n = 1 THEN 'SPLIT' ELSE 'MERGE' END AS kind, x.n AS a_lines, y.n AS b_lines, abs(x.q - y.q) < 0.01 AS quantity_ok, abs(x.m - y.m) < 0.01 AS amount_ok
FROM x JOIN y USING (doc_id, signature) WHERE (x.n = 1 AND y.n > 1) OR (x.n > 1 AND y.n = 1)""")
def split_merge_groups(spark, d):
    return recordsets.split_groups(*_two_sides(spark, d))


@query(_LINES + """SELECT 'A' AS side, doc_id, line, signature FROM a ANTI JOIN b USING (doc_id, signature)
UNION ALL SELECT 'B', doc_id, line, signature FROM b ANTI JOIN a USING (doc_id, signature)""")
def unmatched_lines(spark, d):
    return recordsets.unmatched_lines(*_two_sides(spark, d))


@query(_VIEWS + """SELECT id, CASE WHEN count(*) FILTER (WHERE s = 'FAIL') > 0 THEN 'EXCEPTION' WHEN count(*) FILTER (WHERE s = 'NOT_CHECKED') > 0 THEN 'INCOMPLETE' ELSE 'RECONCILED' END AS overall,
  coalesce(string_agg(rule_id, ',' ORDER BY rule_id) FILTER (WHERE s = 'FAIL'), '') AS failed, coalesce(string_agg(rule_id, ',' ORDER BY rule_id) FILTER (WHERE s = 'NOT_CHECKED'), '') AS not_checked
FROM (SELECT id, rule_id, CASE WHEN status = 'SKIPPED' THEN 'NOT_CHECKED' ELSE status END AS s FROM r) GROUP BY id""")
def verdict_overall(spark, d):
    found = rules.evaluate(order_views(spark, d), RULES)
    return recordsets.verdict(found.select("id", F.col("rule_id").alias("dimension"), F.when(F.col("status") == "SKIPPED", "NOT_CHECKED").otherwise(F.col("status")).alias("status")))
