"""Queries over views of segments, money lines and extracted files, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import packaging, rendering
from ledgerloom.plans import form_queries, record_queries, text_queries
from ledgerloom.session import table
from ledgerloom.sources import formats

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_N = "CASE WHEN json_type(content, '$.{0}') = 'ARRAY' THEN json_array_length(content, '$.{0}') ELSE 0 END"


@query(form_queries._SEG + f""" SELECT env_id, ordinal, segment_id, type, coalesce({_N.format('pairs')}, 0) AS pairs, coalesce({_N.format('rows')}, 0) AS rows,
  coalesce({_N.format('nodes')}, 0) AS nodes, coalesce({_N.format('lines')}, 0) AS lines FROM c""")
def machine_records(spark, d):
    rows = form_queries._triples(spark, d)
    return rendering.machine_records(rows, packaging.segments(rows)).select("env_id", "ordinal", "segment_id", "type", "pairs", "rows", "nodes", "lines")


@query(form_queries._PAIRS + """ SELECT env_id, parent_path, string_agg(coalesce(key, '') || ': ' || coalesce(value, ''), chr(10) ORDER BY n) AS text FROM kv GROUP BY 1, 2""")
def render_pairs(spark, d):
    return rendering.render_pairs(form_queries._triples(spark, d))


_ROLE = "CASE " + " ".join(f"WHEN regexp_matches(lower(label), '{w}') THEN '{r}'" for r, w in rendering.ROLES) + " ELSE 'line' END"
_NODES = text_queries._FORMS + r""", f AS (SELECT doc_id, line_no, regexp_replace(regexp_extract(normalized, '^([^\d$£€¥(]*)', 1), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS label, regexp_extract_all(normalized, '(\(?[$£€¥]?\d[\d.,]*[.,]\d{2}\)?(?:[^\d.,]|$))', 1) AS fs FROM lines),
nodes AS (SELECT doc_id, line_no, regexp_replace(label, '[:\s]+$', '') AS label, """ + _ROLE + r""" AS role,
  CAST(regexp_replace(fs[len(fs)], '\D', '', 'g') AS BIGINT) * CASE WHEN starts_with(fs[len(fs)], '(') THEN -1 ELSE 1 END AS cents FROM f WHERE len(fs) > 0)"""


@query(_NODES + " SELECT * FROM nodes")
def money_nodes(spark, d):
    return rendering.money_nodes(text_queries.form_lines(spark, d))


@query(_NODES + """, s AS (SELECT doc_id, CAST(sum(cents) FILTER (WHERE role = 'line') AS BIGINT) AS lines, max(cents) FILTER (WHERE role = 'subtotal') AS subtotal,
  CAST(coalesce(sum(cents) FILTER (WHERE role = 'tax'), 0) AS BIGINT) AS tax, max(cents) FILTER (WHERE role = 'total') AS total FROM nodes GROUP BY 1)
SELECT *, abs(lines - subtotal) <= 1 AS subtotal_ok, abs(subtotal + tax - total) <= 1 AS total_ok FROM s""")
def money_regions(spark, d):
    return rendering.money_sections(rendering.money_nodes(text_queries.form_lines(spark, d)))


@query(record_queries._LINES + """ SELECT a.doc_id, a.signature, a.line AS a_line, b.line AS b_line FROM (SELECT doc_id, line, signature, amount FROM a) a
JOIN (SELECT doc_id, line, signature, amount * CASE WHEN line % 4 = 0 THEN 1.03 ELSE 1 END AS amount FROM b) b USING (doc_id, signature) WHERE abs(a.amount - b.amount) > 0.01 AND abs(a.amount - b.amount) <= 0.05 * a.amount""")
def near_misses(spark, d):
    a, b = record_queries._two_sides(spark, d)
    return rendering.near_misses(a, b.withColumn("amount", F.col("amount") * F.when(F.col("line") % 4 == 0, 1.03).otherwise(1)))


@query()
def redundant_context(spark, d):
    return rendering.redundant_context(text_queries._blocks(spark, d))


@query(r"SELECT doc_id, trim(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g'), ' ') AS text FROM (SELECT doc_id, title AS text FROM documents WHERE title IS NOT NULL AND title <> '')")
def html_text(spark, d):
    """Titles put into pages with noise, and read out of them again."""
    page = F.concat(F.lit("<html><script>x()</script><nav>menu</nav><p>"), F.replace(F.replace(F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</p></html>"))
    own = table(spark, d, "documents").filter("title is not null and title <> ''").select("doc_id", F.encode(page, "UTF-8").alias("content"))
    kind = formats.detect_format(F.col("content"), F.lit("page"))
    return own.select("doc_id", formats.extract("content", kind)["text"].alias("text"))


@query("SELECT p_partkey, 'n,' || replace(p_name, ',', ' ') || chr(10) || p_partkey || ',' || p_size AS text FROM part")
def csv_text(spark, d):
    """Semicolon files with blank rows, read and written as comma files."""
    raw = F.concat(F.lit("n ; "), F.replace("p_name", F.lit(","), F.lit(" ")), F.lit("\n\n"), F.col("p_partkey").cast("string"), F.lit(";  "), F.col("p_size").cast("string"), F.lit("\n"))
    return table(spark, d, "part").select("p_partkey", formats.extract(F.encode(raw, "UTF-8"), F.lit("csv"))["text"].alias("text"))


@query("""SELECT format, count(*) AS n FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'html' WHEN 2 THEN 'csv' ELSE 'unknown' END AS format FROM events) GROUP BY 1""")
def detect_format(spark, d):
    k = F.col("event_id") % 4
    content = F.when(k == 0, "%PDF-1.7").when(k == 1, "  <!DOCTYPE html><p>").otherwise("a,b")
    path = F.when(k == 2, "/x/data.CSV").otherwise("/x/thing")
    return table(spark, d, "events").groupBy(formats.detect_format(F.encode(content, "UTF-8"), path).alias("format")).agg(F.count("*").alias("n"))
