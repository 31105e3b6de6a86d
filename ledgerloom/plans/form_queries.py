"""Queries over documents' fields and over structured envelopes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import nested, packaging, resolve, structure, textlines
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


# The labels are fixed values that both sides must share, so the SQL has the whole lists too.
_ALIASES = ", ".join("('" + a.lower().replace("'", "''") + f"', '{field}', {n})" for field, names in resolve.ALIASES.items() for n, a in enumerate(names))
_LABELLED = rf"""
WITH raw AS (SELECT doc_key AS doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS parts FROM dedupe_docs WHERE text IS NOT NULL),
ex AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS line_no FROM raw),
lab AS (SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_extract(line, '^([^:]{{2,40}}): (.+)$', 1))), '\s*:+$', ''), '\s*\([^)]*\)', '', 'g'), '\s*@?\s*\d+(\.\d+)?\s*%', '', 'g')) AS label,
  trim(regexp_extract(line, '^([^:]{{2,40}}): (.+)$', 2)) AS value FROM ex WHERE regexp_matches(line, '^([^:]{{2,40}}): (.+)$')),
al AS (SELECT * FROM (VALUES {_ALIASES}) v(label, field, preference)),
res AS (SELECT doc_id, field, arg_min(value, preference * 100000 + line_no) AS value, count(DISTINCT value) AS n_values FROM lab JOIN al USING (label) GROUP BY 1, 2)
"""


def _resolved(spark, d):
    return resolve.resolve_fields(resolve.labelled_lines(table(spark, d, "dedupe_docs")))


@query(_LABELLED + "SELECT doc_id, field, value, n_values FROM res")
def resolve_fields(spark, d):
    return _resolved(spark, d)


@query(_LABELLED + "SELECT doc_id, CASE WHEN bool_or(field IN ('invoice_number', 'total') AND n_values > 1) THEN 'MULTIPLE' ELSE 'SINGLE' END AS status FROM res GROUP BY 1")
def partition_status(spark, d):
    return resolve.partition_status(_resolved(spark, d), ["invoice_number", "total"])


def _items(spark, d):
    lines = textlines.line_model(table(spark, d, "dedupe_docs"), "doc_key")
    rows = structure.parse_item_rows(lines).filter("n_numbers >= 3")
    return rows.select("doc_id", resolve.cents(F.col("last_number")).alias("cents"))


_CENTS = lambda x: f"CAST(regexp_replace(regexp_extract({x}, '^[-+]?[0-9.,]*[0-9]'), '[^0-9]', '', 'g') AS BIGINT) * CASE WHEN regexp_matches(regexp_extract({x}, '^[-+]?[0-9.,]*[0-9]'), '[.,][0-9][0-9]$') THEN 1 ELSE 100 END"
_ITEM = r"(?s)^(.*?\S)((?:[\s\p{Z}]+[$£€¥]?\d[\d.,]*){2,})$"
_SUMS = _LABELLED + rf""", ln AS (SELECT doc_key AS doc_id, unnest(string_split(text, chr(10))) AS line FROM dedupe_docs WHERE text IS NOT NULL),
nb AS (SELECT doc_id, regexp_replace(regexp_extract(n, '{_ITEM}', 2), '^[\s\p{{Z}}]+', '') AS tail FROM (SELECT doc_id, regexp_replace(line, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS n FROM ln) WHERE regexp_matches(n, '{_ITEM}')),
it AS (SELECT doc_id, list_last(regexp_split_to_array(tail, '[\s\p{{Z}}]+')) AS last FROM nb WHERE len(regexp_split_to_array(tail, '[\s\p{{Z}}]+')) >= 3),
su AS (SELECT doc_id, sum({_CENTS("last")})::BIGINT AS items FROM it GROUP BY 1),
st AS (SELECT doc_id, max({_CENTS("value")}) FILTER (WHERE field = 'subtotal') AS subtotal, max({_CENTS("value")}) FILTER (WHERE field = 'tax') AS tax, max({_CENTS("value")}) FILTER (WHERE field = 'total') AS total
  FROM res WHERE field IN ('subtotal', 'tax', 'total') GROUP BY 1)
SELECT doc_id, items, subtotal, tax, total, CASE WHEN total IS NULL OR coalesce(subtotal, items) IS NULL THEN 'UNVERIFIABLE'
  WHEN abs(total - coalesce(subtotal, items) - coalesce(tax, 0)) <= 1 THEN 'CONFIRM' ELSE 'CONFLICT' END AS verdict FROM st LEFT JOIN su USING (doc_id)"""


@query(_SUMS)
def line_items_sum(spark, d):
    return resolve.document_sums(_resolved(spark, d), _items(spark, d)).select("doc_id", "items", "subtotal", "tax", "total", "verdict")


@query()
def coverage_multiset(spark, d):
    labelled = resolve.labelled_lines(table(spark, d, "dedupe_docs")).filter(F.col("value").rlike(r"^\d[\d.,]*\d( [A-Z]{3})?$"))
    raw = labelled.select("doc_id", resolve.cents(F.col("value")).alias("cents")).filter("cents is not null")
    taken = _resolved(spark, d).filter("field in ('subtotal', 'total')").select("doc_id", resolve.cents(F.col("value")).alias("cents"))
    return resolve.coverage(raw, taken)


@query()
def verify_total(spark, d):
    money = _resolved(spark, d).filter("field in ('subtotal', 'tax', 'total')").select("doc_id", resolve.cents(F.col("value")).alias("cents"))
    return money.groupBy("doc_id").agg(F.sort_array(F.collect_list("cents")).alias("values")).select("doc_id", resolve.total_by_identity("values").alias("total"))


# ---- envelopes -----------------------------------------------------------------------------------
_SEG = """
WITH p AS (SELECT env_id, CASE WHEN json_valid(payload) THEN CASE WHEN json_type(payload) = 'VARCHAR' THEN json_extract_string(payload, '$') ELSE payload END END AS j FROM coc_envelopes),
q AS (SELECT env_id, CAST(j AS JSON) AS j FROM p WHERE j IS NOT NULL AND json_valid(j)),
s AS (SELECT env_id, unnest(json_extract(j, '$.machine_readable.segments[*]')) AS seg, generate_subscripts(json_extract(j, '$.machine_readable.segments[*]'), 1) - 1 AS ordinal FROM q),
t AS (SELECT env_id, ordinal, json_extract_string(seg, '$.segment_id') AS segment_id, lower(json_extract_string(seg, '$.type')) AS raw_type, TRY_CAST(json_extract_string(seg, '$.metadata.confidence') AS DOUBLE) AS confidence, seg FROM s),
u AS (SELECT *, coalesce(nullif(regexp_extract(raw_type, '^(kv|table|context|hierarchy|prose|mixed)(_|$)', 1), ''), raw_type) AS type FROM t),
c AS (SELECT *, CASE WHEN json_type(seg, '$.content') = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(seg, '$.content')) THEN CAST(json_extract_string(seg, '$.content') AS JSON) END ELSE json_extract(seg, '$.content') END AS content FROM u)
"""


def _triples(spark, d):
    return nested.triples(table(spark, d, "coc_envelopes"))


@query(_SEG + "SELECT env_id, ordinal, segment_id, type, confidence FROM u WHERE (confidence IS NULL OR confidence >= 0.4) AND type IN ('kv', 'table')")
def segment_filter(spark, d):
    return packaging.filter_segments(packaging.segments(_triples(spark, d)), ["kv", "table"], 0.4).select("env_id", "ordinal", "segment_id", "type", "confidence")


@query(_SEG + "SELECT type, count(*) AS n FROM u GROUP BY 1")
def available_types(spark, d):
    return packaging.segments(_triples(spark, d)).groupBy("type").agg(F.count("*").alias("n"))


_PAIRS = _SEG + """, pr AS (SELECT env_id, ordinal AS seg, unnest(json_extract(content, '$.pairs[*]')) AS pair, generate_subscripts(json_extract(content, '$.pairs[*]'), 1) - 1 AS n FROM c),
kv AS (SELECT env_id, '/machine_readable/segments/' || seg AS parent_path, json_extract_string(pair, '$.key') AS key, CASE WHEN json_type(pair, '$.value') = 'NULL' THEN NULL ELSE json_extract_string(pair, '$.value') END AS value, n FROM pr)"""


@query(_PAIRS + " SELECT env_id, parent_path, key, value, min(n) AS first, count(*) AS n FROM kv WHERE key IS NOT NULL GROUP BY 1, 2, 3, 4")
def kv_pairs_dedup(spark, d):
    return packaging.kv_pairs(_triples(spark, d))


@query(_PAIRS + " SELECT env_id, parent_path, key, count(DISTINCT value) AS n_values FROM kv WHERE key IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT value) > 1")
def validation_kv_duplicates(spark, d):
    return packaging.conflicting_keys(packaging.kv_pairs(_triples(spark, d)))


_CELLS = _SEG + """, r AS (SELECT env_id, ordinal AS seg, unnest(json_extract(content, '$.rows[*]')) AS row, generate_subscripts(json_extract(content, '$.rows[*]'), 1) - 1 AS k FROM c),
x AS (SELECT env_id, seg, k, unnest(json_extract(row, '$[*]')) AS cell, generate_subscripts(json_extract(row, '$[*]'), 1) - 1 AS col FROM r),
cells AS (SELECT env_id, '/machine_readable/segments/' || seg || '/content/rows/' || k AS row_path, col, json_extract_string(cell, '$') AS v FROM x)"""


@query(_CELLS + " SELECT env_id, count(*) AS cells, count(CASE WHEN lower(trim(coalesce(v, ''))) NOT IN ('-', 'n/a', 'na', 'nan', 'none', 'null', '') THEN 1 END) AS filled FROM cells GROUP BY 1")
def cleanup_table_nulls(spark, d):
    return packaging.table_cells(_triples(spark, d)).groupBy("env_id").agg(F.count("*").alias("cells"), F.count("value").alias("filled"))


@query(_CELLS + r""", w AS (SELECT env_id, regexp_replace(row_path, '/\d+$', '') AS table_path, row_path, count(*) AS width FROM cells GROUP BY 1, 2, 3),
k AS (SELECT env_id, table_path, width, count(*) AS n FROM w GROUP BY 1, 2, 3), m AS (SELECT env_id, table_path, arg_max(width, n * 100000 + width) AS modal FROM k GROUP BY 1, 2)
SELECT env_id, row_path, width, modal FROM w JOIN m USING (env_id, table_path) WHERE width <> modal""")
def ragged_rows(spark, d):
    return packaging.ragged_rows(packaging.table_cells(_triples(spark, d)))


@query(_SEG + """, n AS (SELECT env_id, ordinal AS seg, unnest(json_extract(content, '$.nodes[*]')) AS node, generate_subscripts(json_extract(content, '$.nodes[*]'), 1) - 1 AS k FROM c),
m AS (SELECT env_id, '/machine_readable/segments/' || seg || '/content/nodes/' || k AS node_path, TRY_CAST(json_extract_string(node, '$.depth') AS INT) AS depth, lag(TRY_CAST(json_extract_string(node, '$.depth') AS INT)) OVER (PARTITION BY env_id, seg ORDER BY k) AS before FROM n)
SELECT env_id, node_path, depth, before FROM m WHERE depth - before > 1""")
def validation_hierarchy_jumps(spark, d):
    return packaging.depth_jumps(_triples(spark, d))


@query(_SEG + ", f AS (SELECT env_id, unnest(json_extract_string(seg, '$.metadata.flags[*]')) AS flag FROM u) SELECT env_id, flag, count(*) AS n FROM f GROUP BY 1, 2")
def rule_trigger_counts(spark, d):
    return packaging.flag_counts(_triples(spark, d))


@query()
def quality_score(spark, d):
    rows = _triples(spark, d)
    return packaging.quality(packaging.segments(rows), packaging.conflicting_keys(packaging.kv_pairs(rows)), packaging.ragged_rows(packaging.table_cells(rows)))


@query("SELECT source_id, arg_max(env_id, envelope_ts || lpad(CAST(env_id AS VARCHAR), 12, '0')) AS env_id, count(*) AS n FROM coc_envelopes GROUP BY 1")
def latest_envelopes(spark, d):
    return packaging.latest_envelopes(table(spark, d, "coc_envelopes"))


@query("SELECT doc_id, substring(sha256(text), 1, 16) AS source_id FROM documents WHERE text IS NOT NULL")
def source_ids(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", packaging.source_id(F.col("text")).alias("source_id"))


@query("""SELECT recon_id, CASE WHEN recon_id % 3 = 0 THEN received_at + to_days(CAST(recon_id % 30 AS INT)) WHEN recon_id % 3 = 1 THEN received_at + INTERVAL 3650 DAY ELSE received_at + INTERVAL 6 HOUR END AS expires_at FROM reconcile_requests""")
def result_expiry(spark, d):
    c = F.col("recon_id")
    return table(spark, d, "reconcile_requests").select("recon_id", packaging.expiry(F.col("received_at"), c % 3 < 2, c % 3 == 0, (c % 30).cast("int")).alias("expires_at"))
