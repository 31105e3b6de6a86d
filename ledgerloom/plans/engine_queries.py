"""Queries over typed segments, views, signals, layout and findings, with their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import consistency, engine, layout, signals, structure, view
from ledgerloom.plans import record_queries, text_queries
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


def _segments(spark, d):
    return engine.segments(table(spark, d, "dedupe_docs"), "doc_key")


@query()
def document_segments(spark, d):
    """Typed, cleaned and checked segments of every document."""
    return _segments(spark, d)


@query()
def document_report(spark, d):
    return engine.report(_segments(spark, d), table(spark, d, "dedupe_docs"), "doc_key")


@query()
def document_human(spark, d):
    return engine.documents_text(engine.rendered(_segments(spark, d)))


@query()
def document_ai(spark, d):
    return engine.documents_text(engine.rendered(_segments(spark, d)), "ai")


@query()
def document_machine(spark, d):
    return engine.rendered(_segments(spark, d)).select("doc_id", "segment", "type", "machine")


@query()
def document_envelopes(spark, d):
    return engine.envelopes(_segments(spark, d), None, table(spark, d, "dedupe_docs"), "received_at", "doc_key")


@query("""SELECT env_id, CASE WHEN version IS NULL THEN 'version' WHEN event_type IS NULL THEN 'event_type' WHEN source_id IS NULL OR source_id = '' THEN 'source_id'
  WHEN envelope_ts IS NULL THEN 'envelope_ts' ELSE 'payload' END AS fault FROM coc_envelopes
WHERE version IS NULL OR event_type IS NULL OR source_id IS NULL OR source_id = '' OR envelope_ts IS NULL OR payload IS NULL OR NOT json_valid(payload)""")
def envelope_faults(spark, d):
    return engine.envelope_faults(table(spark, d, "coc_envelopes")).select("env_id", "fault")


@query()
def document_views(spark, d):
    """Fields, line items and the check of the total of every document."""
    return view.document_views(table(spark, d, "dedupe_docs"))


@query()
def reading_order(spark, d):
    """The text of every document rebuilt from the boxes of its words, each six units a character wide and lines twelve apart."""
    lines = text_queries.form_lines(spark, d)
    words = lines.select("doc_id", "line_no", "line", F.posexplode(F.regexp_extract_all("line", F.lit(r"(\S+)"), 1)).alias("n", "text"))
    before = F.aggregate(F.slice(F.regexp_extract_all("line", F.lit(r"(\s*\S+)"), 1), 1, F.col("n") + 1), F.lit(0), lambda a, x: a + F.length(x))
    x1 = before.cast("double") * 6
    return layout.reading_order(words.select(F.col("doc_id").alias("page_id"), (x1 - F.length("text") * 6).alias("x0"), x1.alias("x1"), (F.col("line_no") * 12.0).alias("top"), "text"))


_TAGGED = "(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '<p class=\"r\">' || text || '</p> &amp; &lt;b&gt;' ELSE text END AS text FROM documents)"


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '<[a-zA-Z/][^>]*>') THEN
  replace(replace(replace(replace(replace(replace(regexp_replace(text, '<[a-zA-Z/][^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')
  ELSE text END AS text FROM """ + _TAGGED)
def sanitize_text(spark, d):
    made = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('<p class="r">'), "text", F.lit("</p> &amp; &lt;b&gt;"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", signals.sanitize(made).alias("text"))


@query(text_queries._LISTS + r""", f AS (SELECT *, start + length(line) AS stop, lead(line_no) OVER w IS NULL AS last, is_empty AND NOT coalesce(lag(is_empty) OVER w, false) AS opens FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
r AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM f)
SELECT doc_id, 'newline' AS signal, stop AS start, stop + 1 AS stop, 0.25 AS strength FROM r WHERE NOT last
UNION ALL SELECT doc_id, 'list_marker', start, start + length(regexp_extract(line, '^[ \t]*(?:[-*•]|\d+[.)])[ \t]+')), 0.5 FROM r WHERE regexp_matches(line, '^[ \t]*(?:[-*•]|\d+[.)])[ \t]+')
UNION ALL SELECT doc_id, 'separator', start, stop, 1.0 FROM r WHERE regexp_matches(line, '^[ \t]*(?:[-=_][ \t]*){3,}$')
UNION ALL SELECT doc_id, 'empty_line', min(start) - 1, max(stop) + 1, 0.75 FROM r WHERE is_empty AND line_no > 0 AND NOT last GROUP BY doc_id, run""")
def regex_signal_spans(spark, d):
    return signals.signal_spans(text_queries.listed_lines(spark, d)).withColumn("strength", F.col("strength").cast("decimal(3,2)").cast("double"))


@query("SELECT count(*) AS broken FROM documents WHERE false")
def signal_contract(spark, d):
    """How many spans of all texts break the contract: none."""
    lines = text_queries.listed_lines(spark, d)
    lengths = lines.groupBy("doc_id").agg((F.max(F.col("start") + F.length("line"))).alias("length"))
    return signals.broken_spans(signals.signal_spans(lines), lengths).agg(F.count("*").alias("broken"))


@query(text_queries._DOCS + " SELECT doc_id, line_no, length(line) AS n_chars FROM lines WHERE length(line) > 1000")
def long_lines(spark, d):
    return signals.long_lines(text_queries.doc_lines(spark, d), 1000)


@query(text_queries._FORMS + r""", h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM lines WHERE NOT is_empty) WHERE n <= 50),
m AS (SELECT doc_id, sum(length(line) - length(replace(line, ',', ''))) AS a, sum(length(line) - length(replace(line, ';', ''))) AS b,
  sum(length(line) - length(replace(line, chr(9), ''))) AS c, sum(length(line) - length(replace(line, '|', ''))) AS e FROM h GROUP BY 1),
g AS (SELECT doc_id, CASE WHEN greatest(a, b, c, e) = 0 OR a = greatest(a, b, c, e) THEN ',' WHEN b = greatest(a, b, c, e) THEN ';' WHEN c = greatest(a, b, c, e) THEN chr(9) ELSE '|' END AS delimiter FROM m),
k AS (SELECT h.doc_id, delimiter, regexp_matches(normalized, '(?i)</[a-z][a-z0-9]*>|^<(?:div|table|tr|td|p|span|html|body|ul|li)\b|<!doctype') AS html,
  regexp_matches(normalized, '^[\[{]|^[\]}],?$|^"[^"]+"\s*:') AS json,
  CASE WHEN NOT regexp_matches(normalized, '^[<{\[#]') AND len(string_split(line, delimiter)) >= 2 THEN len(string_split(line, delimiter)) END AS width FROM h JOIN g USING (doc_id)),
s AS (SELECT doc_id, delimiter, round(avg(html::INT), 4) AS html, round(avg(json::INT), 4) AS json, round(count(width) / count(*), 4) AS csv FROM k GROUP BY 1, 2),
t AS (SELECT doc_id, round(max(n) / sum(n), 4) AS steady FROM (SELECT doc_id, width, count(*) AS n FROM k WHERE width IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT doc_id, html, json, csv, delimiter, CASE WHEN html >= 0.25 THEN 'html' WHEN csv >= 0.70 AND steady >= 0.85 THEN 'csv' WHEN json >= 0.40 THEN 'json' ELSE 'txt' END AS kind FROM s LEFT JOIN t USING (doc_id)""")
def unknown_kind(spark, d):
    return signals.unknown_kind(text_queries.form_lines(spark, d))


@query()
def formulas(spark, d):
    return signals.formulas(text_queries.form_lines(spark, d))


@query("""WITH s AS (SELECT doc_id, text, regexp_split_to_array(regexp_replace(text, '([.!?])(\\s)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS p FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) AS sentences, sum(length(x)) AS chars FROM (SELECT doc_id, unnest(p) AS x FROM s) GROUP BY 1""".replace("\\\\", "\\"))
def sentence_counts(spark, d):
    spans = signals.sentence_spans(table(spark, d, "documents"))
    return spans.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.col("stop") - F.col("start")).alias("chars"))


_INDENTED = "(SELECT doc_id, regexp_replace(replace(text, '. ', '.' || chr(10) || '    '), ', ', ',' || chr(10) || '  ', 'g') AS text FROM documents)"


@query("WITH " + text_queries._model(_INDENTED, "doc_id") + """, f AS (SELECT * FROM lines WHERE NOT is_empty),
u AS (SELECT doc_id, min(indent) AS least, coalesce(list_reduce(list_prepend(0, list(DISTINCT indent) FILTER (WHERE indent > 0)), lambda a, b: gcd(a, b)), 0) AS g FROM f GROUP BY 1)
SELECT doc_id, line_no, greatest(1, g) AS unit, indent // greatest(1, g) - least // greatest(1, g) AS depth FROM f JOIN u USING (doc_id)""")
def line_depths(spark, d):
    made = F.regexp_replace(F.replace("text", F.lit(". "), F.lit(".\n    ")), ", ", ",\n  ")
    lines = text_queries.textlines.line_model(table(spark, d, "documents").select("doc_id", made.alias("text")))
    return structure.indent_depths(lines).select("doc_id", "line_no", "unit", "depth")


# ---- findings -----------------------------------------------------------------------------------
_BOOK = """book AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS vendor, CAST(round(l_extendedprice * 100) AS BIGINT) AS subtotal,
    CAST(round(l_extendedprice * CASE WHEN l_suppkey % 3 = 0 THEN l_tax ELSE 0.04 END * 100) AS BIGINT) AS tax,
    CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(round(l_extendedprice * CASE WHEN l_suppkey % 3 = 0 THEN l_tax ELSE 0.04 END * 100) AS BIGINT) + CASE WHEN l_partkey % 50 = 0 THEN 250 ELSE 0 END AS total,
    CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE 'T' || l_suppkey END AS tax_id, CAST(l_shipdate AS DATE) AS "at"
  FROM lineitem)"""


def _book(spark, d):
    """Every order line as a record of its supplier."""
    rate = "CASE WHEN l_suppkey % 3 = 0 THEN l_tax ELSE 0.04D END"
    cents = lambda x: f"cast(round({x} * 100) as bigint)"
    sub, tax = cents("l_extendedprice"), cents(f"l_extendedprice * {rate}")
    return table(spark, d, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber as id", "l_suppkey as vendor", f"{sub} as subtotal", f"{tax} as tax", f"{sub} + {tax} + CASE WHEN l_partkey % 50 = 0 THEN 250 ELSE 0 END as total",
        "CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE concat('T', l_suppkey) END as tax_id", "cast(l_shipdate as date) as at")


_INTERNAL = "SELECT id, 'TOTAL_MISMATCH' AS \"check\", 'high' AS severity, (subtotal + tax) || ' vs ' || total AS detail FROM book WHERE abs(subtotal + tax - total) > 1"
_TAXID = "SELECT id, 'TAX_ID_MISSING' AS \"check\", 'medium' AS severity, 'no tax id' AS detail FROM book WHERE tax_id IS NULL AND vendor IN (SELECT vendor FROM book WHERE tax_id IS NOT NULL)"


def _findings(spark, d):
    book = _book(spark, d)
    return consistency.evaluate(consistency.check_internal(book), consistency.check_missing_tax_id(book, book))


@query("WITH " + _BOOK + " " + _INTERNAL)
def check_internal(spark, d):
    return consistency.check_internal(_book(spark, d))


@query("WITH " + _BOOK + " " + _TAXID)
def check_tax_id_missing(spark, d):
    book = _book(spark, d)
    return consistency.check_missing_tax_id(book, book)


@query("WITH " + _BOOK + """, r AS (SELECT *, CASE WHEN l.vendor % 3 = 1 THEN 7 ELSE 4 END AS own FROM book l),
n AS (SELECT vendor FROM book GROUP BY 1 HAVING count(*) >= 3)
SELECT id, 'TAX_RATE_DEVIATION' AS "check", 'medium' AS severity FROM r JOIN n USING (vendor) WHERE own = 7""")
def check_tax_rate(spark, d):
    """Suppliers with an even history of 4 % and records of 7 % of every third of them."""
    own = _book(spark, d).select("id", "vendor", F.lit(10_000).alias("subtotal"), F.when(F.col("vendor") % 3 == 1, 700).otherwise(400).alias("tax"))
    history = own.withColumn("tax", F.lit(400))
    return consistency.check_tax_rate(own, history).select("id", "check", "severity")


@query("WITH " + record_queries._FACTS + """ SELECT DISTINCT b_id AS id, 'DUPLICATE' AS "check", relationship || ' of ' || min(a_id) OVER (PARTITION BY b_id, relationship) AS detail
FROM typed WHERE relationship NOT IN ('LOW_CONFIDENCE', 'RECURRING_INVOICE')""")
def check_duplicates(spark, d):
    return consistency.check_duplicates(record_queries._evidence(spark, d)).select("id", "check", "detail")


@query("WITH " + _BOOK + f", f AS ({_INTERNAL} UNION ALL {_TAXID}) SELECT \"check\", severity, count(*) AS findings, count(DISTINCT id) AS records FROM f GROUP BY 1, 2")
def findings_by_kind(spark, d):
    return consistency.by_kind(_findings(spark, d))


@query("WITH " + _BOOK + f""", f AS ({_INTERNAL} UNION ALL {_TAXID}), t AS (SELECT id, "check", min(CASE severity WHEN 'high' THEN 0 ELSE 1 END) AS rank FROM f GROUP BY 1, 2),
p AS (SELECT id, count(*) AS n, min(rank) AS worst, arg_min("check", rank) AS first FROM t GROUP BY 1)
SELECT b.id, CASE worst WHEN 0 THEN 'needs_review' WHEN 1 THEN 'attention' ELSE 'clear' END AS status,
  CASE WHEN first IS NULL THEN 'Nothing found.' ELSE CASE first WHEN 'TOTAL_MISMATCH' THEN 'Total Mismatch' ELSE 'Tax Id Missing' END || CASE WHEN n > 1 THEN ' and ' || (n - 1) || ' more' ELSE '' END || '.' END AS headline,
  coalesce(n, 0) AS findings, round(greatest(0.5, 0.98 - 0.03 * coalesce(n, 0)), 2)::DOUBLE AS confidence FROM book b LEFT JOIN p USING (id)""")
def record_report(spark, d):
    return consistency.report(_book(spark, d), _findings(spark, d))


@query("WITH " + _BOOK + " SELECT vendor, id, \"at\", position FROM (SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY \"at\" DESC, id) AS position FROM book) WHERE position <= 10")
def vendor_documents_recent(spark, d):
    return consistency.vendor_documents(_book(spark, d))


@query("WITH " + _BOOK + " SELECT vendor, count(*) AS records, sum(total) AS total FROM (SELECT id, vendor, total FROM book WHERE id % 4 <> 0 UNION ALL SELECT id, vendor, total + 5 FROM book WHERE id % 4 = 0 UNION ALL SELECT -id, vendor, 1 FROM book WHERE id % 4 = 1) GROUP BY 1")
def registry_overlay(spark, d):
    """The registry with every fourth record replaced and some new ones, nothing written."""
    book = _book(spark, d).select("id", "vendor", "total")
    pending = book.filter("id % 4 = 0").withColumn("total", F.col("total") + 5).unionAll(book.filter("id % 4 = 1").selectExpr("-id", "vendor", "1L"))
    return consistency.overlay(book, pending).groupBy("vendor").agg(F.count("*").alias("records"), F.sum("total").alias("total"))


@query("""SELECT owner, session_id FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY created_at DESC, session_id) AS n FROM
  (SELECT user_id AS owner, event_id AS session_id, ts AS created_at FROM events WHERE event_type <> (SELECT min(event_type) FROM events))) WHERE n <= 20""")
def stored_sessions(spark, d):
    e = table(spark, d, "events")
    least = e.agg(F.min("event_type").alias("least"))
    s = e.crossJoin(F.broadcast(least)).select(F.col("user_id").alias("owner"), F.col("event_id").alias("session_id"), F.col("ts").alias("created_at"),
                                               F.when(F.col("event_type") == F.col("least"), F.lit(0)).otherwise(1).alias("expires_at"))
    return consistency.kept_sessions(s, F.lit(0)).select("owner", "session_id")
