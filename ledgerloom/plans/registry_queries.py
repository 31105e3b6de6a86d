"""Queries over the registry, cases and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.canon import number_signature
from ledgerloom.operators import registry
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


_REG = """reg AS (
  SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'purchase_order' ELSE 'invoice' END AS doc_type, 'V' || o_custkey AS vendor,
    CASE WHEN o_orderkey % 97 = 0 THEN 'X' || o_orderkey ELSE 'N-' || o_orderkey END AS number, 'PO' || (o_orderkey // 3 * 3) AS po,
    CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 53 = 0 THEN 'T-other' ELSE 'T' || o_custkey END AS tax_id,
    CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CAST(o_orderdate AS DATE) AS asserted_at FROM orders)"""


def _registry(spark, d):
    return table(spark, d, "orders").selectExpr(
        "o_orderkey AS doc_id", "CASE WHEN o_orderkey % 3 = 0 THEN 'purchase_order' ELSE 'invoice' END AS doc_type", "concat('V', o_custkey) AS vendor",
        "CASE WHEN o_orderkey % 97 = 0 THEN concat('X', o_orderkey) ELSE concat('N-', o_orderkey) END AS number", "concat('PO', o_orderkey div 3 * 3) AS po",
        "CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 53 = 0 THEN 'T-other' ELSE concat('T', o_custkey) END AS tax_id",
        "cast(round(o_totalprice * 100) AS bigint) AS cents", "cast(o_orderdate AS date) AS asserted_at")


@query("WITH " + _REG + """, k AS (
  SELECT doc_id, 'vendor' AS key_type, vendor AS key_value FROM reg UNION ALL SELECT doc_id, 'po_ref', po FROM reg UNION ALL SELECT doc_id, 'po_vendor', po || '|' || vendor FROM reg
  UNION ALL SELECT doc_id, 'tax_id', tax_id FROM reg UNION ALL SELECT doc_id, 'vendor_tax_id', vendor || '|' || tax_id FROM reg UNION ALL SELECT doc_id, 'vendor_invnum', vendor || '|' || number FROM reg
  UNION ALL SELECT doc_id, 'doc_ref', doc_type || '|' || CASE WHEN doc_type = 'purchase_order' THEN po ELSE number END FROM reg)
SELECT * FROM k WHERE key_value IS NOT NULL""")
def registry_keys(spark, d):
    return registry.registry_keys(_registry(spark, d))


@query("WITH " + _REG + " SELECT vendor, doc_id, n FROM (SELECT vendor, doc_id, row_number() OVER (PARTITION BY vendor ORDER BY asserted_at, doc_id) AS n FROM reg) WHERE n <= 10")
def vendor_history_topn(spark, d):
    return registry.vendor_history(_registry(spark, d), 10).select("vendor", "doc_id", "n")


@query("WITH " + _REG + """, q AS (SELECT DISTINCT 'invoice' AS doc_type, CASE WHEN doc_id % 2 = 0 THEN number ELSE po END AS reference FROM reg WHERE doc_id % 5 = 1),
own AS (SELECT q.doc_type, q.reference, r.doc_id, 'doc_ref' AS how FROM q JOIN reg r ON q.doc_type = r.doc_type AND q.reference = r.number)
SELECT * FROM own UNION ALL SELECT q.doc_type, q.reference, r.doc_id, 'po_ref' FROM q JOIN reg r ON q.reference = r.po WHERE q.reference NOT IN (SELECT reference FROM own)""")
def by_reference_fallback(spark, d):
    reg = _registry(spark, d)
    q = reg.filter("doc_id % 5 = 1").selectExpr("'invoice' AS doc_type", "CASE WHEN doc_id % 2 = 0 THEN number ELSE po END AS reference").distinct()
    return registry.by_reference(q, reg)


_ODD = """ SELECT r.doc_id, r.{v} AS value, o.norm, o.observations FROM x r JOIN (
  SELECT vendor, arg_max({v}, n) AS norm, max(n) AS observations FROM (SELECT vendor, {v}, count(*) AS n FROM x WHERE {v} IS NOT NULL GROUP BY 1, 2) GROUP BY 1
  HAVING count(*) = 2 AND sum(n) - max(n) = 1 AND max(n) >= 3) o USING (vendor) WHERE r.{v} <> o.norm"""


@query("WITH " + _REG + ", x AS (SELECT * FROM reg)" + _ODD.format(v="tax_id"))
def check_tax_id_changed(spark, d):
    return registry.deviations(_registry(spark, d), "tax_id").select("doc_id", F.col("tax_id").alias("value"), "norm", "observations")


@query("WITH " + _REG + r", x AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(number, '[A-Za-z]', 'A', 'g'), '[0-9]', '9', 'g'), 'A{2,}', 'A+', 'g'), '9{2,}', '9+', 'g') AS shape FROM reg WHERE length(number) >= 4)" + _ODD.format(v="shape"))
def check_number_format(spark, d):
    r = _registry(spark, d).filter("length(number) >= 4").withColumn("shape", number_signature(F.col("number")))
    return registry.deviations(r, "shape").select("doc_id", F.col("shape").alias("value"), "norm", "observations")


@query("WITH " + _REG + " SELECT doc_id, vendor FROM reg WHERE tax_id IS NULL AND vendor IN (SELECT vendor FROM reg WHERE tax_id IS NOT NULL)")
def check_missing_tax_id(spark, d):
    reg = _registry(spark, d)
    return reg.filter("tax_id is null").join(reg.filter("tax_id is not null").select("vendor").distinct(), "vendor", "left_semi").select("doc_id", "vendor")


@query("WITH " + _REG + """, v AS (SELECT vendor, 'currency' AS pattern, 0 AS z FROM reg), p AS (
  SELECT vendor, 'tax_id' AS pattern, count(DISTINCT tax_id) AS n_values, count(*) AS observations, min(tax_id) AS ex FROM reg WHERE tax_id IS NOT NULL GROUP BY 1
  UNION ALL SELECT vendor, 'doc_type', count(DISTINCT doc_type), count(*), min(doc_type) FROM reg GROUP BY 1)
SELECT vendor, pattern, n_values, observations, n_values = 1 AND observations >= 3 AS established, CASE WHEN n_values = 1 THEN ex END AS value FROM p""")
def vendor_patterns(spark, d):
    return registry.patterns(_registry(spark, d), ["tax_id", "doc_type"])


@query("WITH " + _REG + """ SELECT vendor, tax_id, first_seen, last_seen, n, row_number() OVER (PARTITION BY vendor ORDER BY last_seen DESC, tax_id) = 1 AS is_latest
FROM (SELECT vendor, tax_id, min(asserted_at) AS first_seen, max(asserted_at) AS last_seen, count(*) AS n FROM reg WHERE tax_id IS NOT NULL GROUP BY 1, 2)""")
def vendor_tax_timeline(spark, d):
    return registry.value_timeline(_registry(spark, d), "tax_id")


@query("WITH " + _REG + " SELECT doc_id, po FROM reg WHERE doc_type = 'invoice' AND po NOT IN (SELECT po FROM reg WHERE doc_type = 'purchase_order' AND doc_id % 4 <> 0)")
def check_po_not_found(spark, d):
    reg = _registry(spark, d)
    return registry.references_missing(reg.filter("doc_type = 'invoice'"), reg.filter("doc_type = 'purchase_order' and doc_id % 4 <> 0"), "po", "po").select("doc_id", "po")


@query("WITH " + _REG + """ SELECT i.doc_id, p.doc_id AS po_doc_id, i.vendor <> p.vendor AS vendor_conflict, i.cents - p.cents AS over_cents
FROM reg i JOIN reg p ON i.po = p.po AND p.doc_type = 'purchase_order' AND i.doc_type = 'invoice' WHERE i.vendor <> p.vendor OR i.cents > p.cents + 1""")
def check_po_mismatch(spark, d):
    reg = _registry(spark, d)
    p = reg.filter("doc_type = 'purchase_order'").selectExpr("po", "doc_id AS po_doc_id", "vendor AS po_vendor", "cents AS po_cents")
    j = reg.filter("doc_type = 'invoice'").join(p, "po").filter("vendor <> po_vendor or cents > po_cents + 1")
    return j.selectExpr("doc_id", "po_doc_id", "vendor <> po_vendor AS vendor_conflict", "cents - po_cents AS over_cents")


@query("WITH " + _REG + """, pay AS (SELECT number AS reference, cents // 2 AS cents FROM reg, (VALUES (0), (1)) v(n) WHERE doc_id % 4 >= n * 3 AND doc_id % 3 <> 0)
SELECT doc_id, coalesce(n, 0) AS n_payments, paid AS paid_cents FROM reg LEFT JOIN (SELECT reference, count(*) AS n, CAST(sum(cents) AS BIGINT) AS paid FROM pay GROUP BY 1) ON reference = number""")
def check_payments(spark, d):
    reg = _registry(spark, d).withColumn("reference", F.col("number"))
    pay = reg.filter("doc_id % 3 <> 0").withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).filter("doc_id % 4 >= n * 3").selectExpr("reference", "cents div 2 AS cents")
    return registry.payments_for(reg, pay).select("doc_id", "n_payments", "paid_cents")


@query("""WITH doubled AS (SELECT * FROM cases UNION ALL SELECT * REPLACE (case_id || 'b' AS case_id) FROM cases)
SELECT kind, subject, array_to_string(list_sort(coalesce(counterparts, [])), ',') AS who, min(case_id) AS case_id FROM doubled d
WHERE NOT EXISTS (SELECT 1 FROM cases c WHERE c.status = 'open' AND c.kind = d.kind AND c.subject = d.subject AND list_sort(coalesce(c.counterparts, [])) = list_sort(coalesce(d.counterparts, [])))
GROUP BY 1, 2, 3""")
def cases_open_idempotent(spark, d):
    c = table(spark, d, "cases")
    twice = c.unionByName(c.withColumn("case_id", F.concat("case_id", F.lit("b"))))
    return registry.open_cases(twice, c).select("kind", "subject", F.array_join("who", ",").alias("who"), "case_id")


@query("""SELECT kind, vendor_canon, resolution_id, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY kind, vendor_canon ORDER BY resolved_at DESC, resolution_id) AS rank
  FROM (SELECT DISTINCT kind, vendor_canon, resolution_id, resolved_at FROM resolutions WHERE kind IS NOT NULL AND vendor_canon IS NOT NULL)) WHERE rank <= 3""")
def case_precedent_top3(spark, d):
    return registry.precedents(table(spark, d, "resolutions")).select("kind", "vendor_canon", "resolution_id", "rank")


@query("""SELECT c.case_id, coalesce(n, 0) AS n_resolutions, last_resolved, CASE WHEN n > 0 THEN 'resolved' ELSE 'open' END AS derived_status
FROM cases c LEFT JOIN (SELECT case_id, count(DISTINCT resolution_id) AS n, max(resolved_at) AS last_resolved FROM resolutions GROUP BY 1) USING (case_id)""")
def case_status(spark, d):
    return registry.case_status(table(spark, d, "cases"), table(spark, d, "resolutions"))


@query("""SELECT vendor_canon, count(*) AS n_cases, count(DISTINCT kind) AS kinds, max(created_at) AS last_case, mode(status) IS NOT NULL AS has_status FROM cases WHERE vendor_canon IS NOT NULL GROUP BY 1""")
def vendor_case_profile(spark, d):
    return table(spark, d, "cases").filter("vendor_canon is not null").groupBy("vendor_canon").agg(
        F.count("*").alias("n_cases"), F.countDistinct("kind").alias("kinds"), F.max("created_at").alias("last_case"), F.mode("status").isNotNull().alias("has_status"))


@query("""WITH f AS (SELECT subject, kind, created_at, case_id, CASE json_extract_string(finding, '$.risk') WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END AS severity FROM cases)
SELECT subject, string_agg(kind, ',' ORDER BY severity, kind) AS findings, min(severity) AS worst FROM (SELECT subject, kind, min(severity) AS severity FROM f GROUP BY 1, 2) GROUP BY 1""")
def report_ranked(spark, d):
    """Findings of each subject, one for each topic, worst first."""
    risk = F.get_json_object("finding", "$.risk")
    severity = F.when(risk == "high", 0).when(risk == "medium", 1).when(risk == "low", 2).otherwise(3)
    topics = table(spark, d, "cases").groupBy("subject", "kind").agg(F.min(severity).alias("severity"))
    return topics.groupBy("subject").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("severity", "kind"))), lambda x: x["kind"]), ",").alias("findings"), F.min("severity").alias("worst"))


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS requests, CAST(sum(greatest(1, ceil(length(props) / 100000.0))) AS BIGINT) AS units FROM events GROUP BY 1, 2")
def usage_per_day(spark, d):
    units = F.greatest(F.lit(1), F.ceil(F.length("props") / F.lit(100_000.0)))
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("requests"), F.sum(units).cast("long").alias("units"))


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS requests FROM events GROUP BY 1, 2 HAVING count(*) > 2")
def usage_over_limit(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("requests")).filter("requests > 2")
