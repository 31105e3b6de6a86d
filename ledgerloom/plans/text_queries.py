"""Queries over texts and their structure, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import structure, textlines
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


def _model(source: str, key: str) -> str:
    return rf"""raw AS (SELECT {key} AS doc_id, string_split(text, chr(10)) AS parts FROM {source} WHERE text IS NOT NULL),
ex AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS line_no FROM raw),
lines AS (
  SELECT doc_id, line_no, line, normalized, length(regexp_extract(line, '^([\s\p{{Z}}]*)', 1)) AS indent, normalized = '' AS is_empty,
    CASE WHEN normalized = '' THEN 0 ELSE len(regexp_split_to_array(normalized, '[\s\p{{Z}}]+')) END AS n_tokens,
    CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM (SELECT *, regexp_replace(line, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS normalized FROM ex))"""


#: Texts with list items and rows of cells, made from the plain texts.
_LISTED = "(SELECT doc_id, replace(replace(text, '. ', '.' || chr(10) || '- '), ', ', ' | ') AS text FROM documents)"
_LISTS = "WITH " + _model(_LISTED, "doc_id")
_DOCS = "WITH " + _model("documents", "doc_id")
_FORMS = "WITH " + _model("dedupe_docs", "doc_key")


def doc_lines(spark, d):
    return textlines.line_model(table(spark, d, "documents"))


def listed_lines(spark, d):
    made = F.replace(F.replace("text", F.lit(". "), F.lit(".\n- ")), F.lit(", "), F.lit(" | "))
    return textlines.line_model(table(spark, d, "documents").select("doc_id", made.alias("text")))


def form_lines(spark, d):
    return textlines.line_model(table(spark, d, "dedupe_docs"), "doc_key")


@query(_DOCS + " SELECT doc_id, line_no, normalized, indent, is_empty, n_tokens, start FROM lines")
def line_model(spark, d):
    return doc_lines(spark, d).select("doc_id", "line_no", "normalized", "indent", "is_empty", "n_tokens", "start")


@query(_DOCS + r""" SELECT doc_id, count(*) AS total_lines, count(*) FILTER (WHERE is_empty) AS empty_lines, count(*) FILTER (WHERE regexp_matches(line, '^[\s\p{Z}]*[-*•][\s\p{Z}]+')) AS bullet_lines,
  count(*) FILTER (WHERE regexp_matches(line, '^[\s\p{Z}]*\d+[.)][\s\p{Z}]+')) AS numbered_lines, CAST(sum(CASE WHEN is_empty THEN 0 ELSE length(line) END) AS BIGINT) AS content_chars,
  count(*) FILTER (WHERE NOT is_empty) AS content_lines FROM lines GROUP BY 1""")
def text_signals(spark, d):
    return textlines.text_signals(doc_lines(spark, d)).drop("content_squares")


def _n(cls: str) -> str:
    return f"length(text) - length(regexp_replace(text, '{cls}', '', 'g'))"


@query(rf"""SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS words, {_n(chr(92) + 'p{Lu}')} AS uppercase, {_n(chr(92) + 'p{Ll}')} AS lowercase,
  {_n(chr(92) + 'p{Nd}')} AS digits, {_n(chr(92) + 'p{P}')} AS punctuation, {_n(chr(92) + 'p{S}')} AS symbols FROM documents WHERE text IS NOT NULL""")
def token_observations(spark, d):
    return textlines.token_observations(table(spark, d, "documents"))


_BLOCKS = r""", f AS (SELECT *, regexp_matches(line, '^[\s\p{Z}]*(?:[-*•]|\d+[.)])[\s\p{Z}]+') AS is_list FROM lines WHERE NOT is_empty),
b AS (SELECT *, is_list AND NOT coalesce(lag(is_list) OVER w, false) AS enters, NOT is_list AND coalesce(lag(is_list) OVER w, false) AS leaves,
  coalesce(line_no - lag(line_no) OVER w, 1) > 1 AS gap FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))"""
_END = r"""regexp_matches(normalized, '[.!?]$') AND NOT regexp_matches(normalized, '(?:^|[^A-Za-z])(?:[A-Za-z]\.){2,}$') AND NOT regexp_matches(normalized, '(?:^|[^\p{L}\p{N}_])[A-Za-z]{1,3}\.$')"""


@query(_LISTS + _BLOCKS + f""" SELECT doc_id, count(*) FILTER (WHERE gap) AS paragraph_breaks, count(*) FILTER (WHERE {_END}) AS sentence_end_lines, count(*) FILTER (WHERE enters) AS list_block_count,
  greatest(count(*) FILTER (WHERE enters) - 1, 0) AS list_block_transitions FROM b GROUP BY 1""")
def boundary_signals(spark, d):
    return textlines.boundary_signals(listed_lines(spark, d))


@query(_LISTS + _BLOCKS + " SELECT doc_id, line_no, start, CASE WHEN enters THEN 'entry' ELSE 'exit' END AS kind FROM b WHERE enters OR leaves")
def list_transitions(spark, d):
    return textlines.list_transitions(listed_lines(spark, d))


@query(_FORMS + r""", m AS (SELECT *, is_empty AND NOT coalesce(lag(is_empty) OVER (PARTITION BY doc_id ORDER BY line_no), false) AND line_no > 0 AS opens,
  line_no < max(line_no) FILTER (WHERE NOT is_empty) OVER (PARTITION BY doc_id) AS inn FROM lines)
SELECT doc_id, count(*) - 1 AS newline, count(*) FILTER (WHERE opens AND coalesce(inn, false)) AS empty_line, count(*) FILTER (WHERE regexp_matches(line, '^[ \t]*(?:[-*•]|\d+\.)[\s\p{Z}]')) AS list_marker,
  count(*) FILTER (WHERE regexp_matches(line, '^[ \t]*[-=_]{3,}[ \t]*$')) AS separator FROM m GROUP BY 1""")
def regex_signal_counts(spark, d):
    return textlines.signal_counts(form_lines(spark, d))


_METRICS = "SELECT t.doc_id, (r.separator * 1.0 + r.empty_line * 0.75 + r.list_marker * 0.5 + r.newline * 0.25 + b.paragraph_breaks * 0.75 + b.list_block_transitions * 0.5 + b.sentence_end_lines * 0.25) / t.total_lines AS strength, " \
    "(b.paragraph_breaks + b.list_block_transitions) / t.total_lines AS pressure, 1 / (1 + greatest(q.squares / t.content_lines - power(t.content_chars / t.content_lines, 2), 0)) AS consistency " \
    f"FROM ({SQL['text_signals']}) t JOIN ({SQL['boundary_signals'].replace(_LISTS, _DOCS)}) b USING (doc_id) JOIN ({SQL['regex_signal_counts'].replace(_FORMS, _DOCS)}) r USING (doc_id) " \
    f"JOIN ({_DOCS} SELECT doc_id, sum(length(line) ** 2) FILTER (WHERE NOT is_empty) AS squares FROM lines GROUP BY 1) q USING (doc_id)"


@query(f"SELECT doc_id, round(strength, 6) AS normalized_strength, round(pressure, 6) AS boundary_pressure, round(consistency, 6) AS consistency FROM ({_METRICS})")
def structural_metrics(spark, d):
    m = textlines.structural_metrics(doc_lines(spark, d))
    return m.select("doc_id", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


@query(f"""SELECT doc_id, round(strength / (strength + 1), 6) AS structure_intensity, round(pressure / (pressure + 1), 6) AS boundary_intensity, round(consistency, 6) AS stability,
  round(CASE WHEN c <= 0 THEN 0 ELSE c / (c + 0.5) END, 6) AS chaos_index FROM (SELECT *, pressure / (pressure + 1) * (1 - consistency) AS c FROM ({_METRICS}))""")
def feature_vector(spark, d):
    v = textlines.feature_vector(textlines.structural_metrics(doc_lines(spark, d)))
    return v.select("doc_id", *[F.round(c, 6).alias(c) for c in v.columns[1:]])


@query(_LISTS + _BLOCKS + r""", g AS (SELECT *, regexp_matches(normalized, '^(?:[-=_][\s\p{Z}]*){3,}$') AS is_sep,
  regexp_matches(normalized, '^[\p{L}\p{N}_.-]+(?: [\p{L}\p{N}_.-]+){0,2} ?[:=] *[^ ].*') AS is_kv FROM b),
h AS (SELECT *, enters OR leaves OR is_sep OR coalesce(lag(is_sep) OVER w, false) OR (gap AND NOT (is_kv AND coalesce(lag(is_kv) OVER w, false))) AS opens FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
p AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS piece FROM h),
s AS (SELECT doc_id, piece, min(line_no) AS first_line, max(line_no) AS last_line, string_agg(normalized, chr(10) ORDER BY line_no) AS content FROM p GROUP BY 1, 2)
SELECT doc_id, first_line, last_line, content, row_number() OVER (PARTITION BY doc_id ORDER BY piece) AS ordinal FROM s WHERE regexp_matches(content, '[\p{L}\p{N}]')""")
def split_segments(spark, d):
    return textlines.split_segments(listed_lines(spark, d))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x{200B}-\x{200D}\x{FEFF}\x{2060}]', '', 'g'), '\x{00A0}', ' ', 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g'),
  '(?:\n\s*){3,}', chr(10) || chr(10), 'g') AS text FROM documents""")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", textlines.normalize_text(F.col("text")).alias("text"))


@query(_FORMS + r""" SELECT doc_id, line_no, concat_ws(',', CASE WHEN is_empty THEN 'empty' END, CASE WHEN regexp_matches(normalized, '^(?:[-=_][\s\p{Z}]*){3,}$') THEN 'separator' END,
  CASE WHEN regexp_matches(normalized, '^[\s\p{Z}]*(?:[-*•]|\d+[.)])[\s\p{Z}]+') THEN 'list_item' END, CASE WHEN regexp_matches(normalized, '^[^:=]+[:=].*') THEN 'kv_pair' END,
  CASE WHEN indent > 0 AND NOT is_empty THEN 'indented' END, CASE WHEN regexp_matches(normalized, '(?:^|[^\p{L}\p{N}_])\d[\d,.]*') THEN 'numeric_value' END,
  CASE WHEN length(normalized) <= 60 AND n_tokens BETWEEN 1 AND 5 AND regexp_matches(normalized, '\p{L}') AND NOT regexp_matches(normalized, '[.!?]$')
    AND NOT regexp_matches(normalized, '^[\s\p{Z}]*(?:[-*•]|\d+[.)])[\s\p{Z}]+') AND NOT regexp_matches(normalized, '^[^:=]+[:=].*') AND NOT regexp_matches(normalized, '^(?:[-=_][\s\p{Z}]*){3,}$') THEN 'header_like' END) AS patterns FROM lines""")
def line_patterns(spark, d):
    return structure.line_patterns(form_lines(spark, d))


_REGION = r""", f AS (SELECT *, regexp_matches(normalized, '[:=]') AS dl FROM lines WHERE NOT is_empty),
sh AS (SELECT doc_id, count(*) AS n_lines, round(avg(contains(normalized, '|')::INT), 4) AS pipe, round(avg(regexp_matches(normalized, '^[^:=]+[:=].*')::INT), 4) AS kv, round(avg(dl::INT), 4) AS delimiter,
  round(avg(regexp_matches(normalized, '[\s\p{Z}]{2,}')::INT), 4) AS multi_space, round(avg(regexp_matches(line, '^\s*(?:[│|]\s*)*[+├└]\s*[-─]+')::INT), 4) AS glyph,
  round(avg(regexp_matches(normalized, '(?:\s+[$£€¥]?-?\d[\d.,]*){2,}$')::INT), 4) AS numeric_tail, bool_or(regexp_matches(normalized, '^(?:[-=_][\s\p{Z}]*){3,}$') OR contains(normalized, '|')) AS ruled FROM f GROUP BY 1),
st AS (SELECT doc_id, round(max(c) / sum(c), 4) AS stable FROM (SELECT doc_id, n_tokens, count(*) AS c FROM f GROUP BY 1, 2) GROUP BY 1),
sp AS (SELECT doc_id, round(max(c) / sum(c), 4) AS shape FROM (SELECT doc_id, n_tokens, dl, indent > 0 AS i, count(*) AS c FROM f GROUP BY 1, 2, 3, 4) GROUP BY 1),
ft AS (SELECT * FROM sh JOIN st USING (doc_id) JOIN sp USING (doc_id))"""


@query(_FORMS + _REGION + """ SELECT doc_id, CASE WHEN n_lines >= 3 AND pipe >= 0.5 AND ruled THEN 'table_candidate' WHEN n_lines >= 3 AND glyph >= 0.3 THEN 'structured_block'
  WHEN n_lines >= 3 AND (numeric_tail >= 0.5 OR (stable >= 0.6 AND multi_space >= 0.5)) THEN 'table_candidate'
  WHEN n_lines >= 2 AND (kv >= 0.35 OR (delimiter >= 0.4 AND shape >= 0.5)) THEN 'structured_block' ELSE 'unstructured' END AS region FROM ft""")
def region_class(spark, d):
    return structure.classify_regions(structure.region_features(form_lines(spark, d), ["doc_id"])).select("doc_id", "region")


@query(_FORMS + _REGION + """, r AS (SELECT doc_id, greatest(pipe, kv, glyph) AS top, list_sort([pipe, kv, glyph], 'DESC')[2] AS nxt, pipe, kv, glyph FROM ft)
SELECT doc_id, CASE WHEN top < 0.05 THEN 'NO_STRUCTURE' WHEN top < 0.15 THEN 'WEAK' ELSE 'STRUCTURED' END AS tier,
  CASE WHEN top < 0.15 THEN 'PASS_THROUGH' WHEN top - nxt >= 0.15 THEN CASE WHEN pipe = top THEN 'TABLE' WHEN kv = top THEN 'KV' ELSE 'TREE' END ELSE 'AMBIGUOUS' END AS route FROM r""")
def route_decision(spark, d):
    return structure.route(structure.region_features(form_lines(spark, d), ["doc_id"])).select("doc_id", "tier", "route")


_KV = r""", kv AS (SELECT doc_id, line_no, trim(regexp_extract(normalized, '^([^:=]*)([:=])(.*)$', 1)) AS key, regexp_extract(normalized, '^([^:=]*)([:=])(.*)$', 2) AS delimiter,
  trim(regexp_extract(normalized, '^([^:=]*)([:=])(.*)$', 3)) AS value FROM lines WHERE regexp_matches(normalized, '^[^:=]+[:=].*')
  AND NOT regexp_matches(normalized, '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}|^\[?\d{4}-\d{2}-\d{2}|^\s*(?:at [\p{L}\p{N}_.$]+\(|Caused by:)|\.java:\d+')),
pairs AS (SELECT *, CASE WHEN value = '' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM kv WHERE regexp_matches(key, '^[\p{L}\p{N}_.-]+(?: [\p{L}\p{N}_.-]+){0,2}(?: \([^)]{1,12}\))?$'))"""


@query(_FORMS + _KV + " SELECT doc_id, line_no, key, delimiter, value, confidence FROM pairs")
def kv_detect(spark, d):
    return structure.detect_kv(form_lines(spark, d))


@query(_FORMS + _KV + r""", c AS (SELECT doc_id, line_no, key, list_filter(list_transform(regexp_split_to_array(value, '[;,]'), lambda x: trim(x)), lambda x: x <> '') AS p FROM pairs),
n AS (SELECT doc_id, line_no, key, len(p) AS parts, len(list_filter(p, lambda x: regexp_matches(x, '^[\p{L}\p{N}_.-]+(?: [\p{L}\p{N}_.-]+){0,2} ?[:=].+'))) AS pairs FROM c)
SELECT * FROM n WHERE parts >= 2 AND pairs >= 0.6 * parts""")
def kv_nested(spark, d):
    return structure.nested_pairs(structure.detect_kv(form_lines(spark, d)))


@query(_LISTS + r""", r AS (SELECT doc_id, line_no, list_transform(regexp_split_to_array(regexp_replace(normalized, '^\|+|\|+$', '', 'g'), '\|'), lambda x: trim(x)) AS cells FROM lines
  WHERE contains(normalized, '|') AND NOT regexp_matches(normalized, '^[|\-+ =]+$'))
SELECT doc_id, line_no, array_to_string(cells, '~') AS cells, max(len(cells)) OVER (PARTITION BY doc_id) AS width FROM r""")
def pipe_table_parse(spark, d):
    return structure.parse_pipe_rows(listed_lines(spark, d)).select("doc_id", "line_no", F.array_join("cells", "~").alias("cells"), "width")


@query(_FORMS + r""", r AS (SELECT doc_id, line_no, regexp_extract(normalized, '^(.*?\S)((?:[\s\p{Z}]+[$£€¥]?\d[\d.,]*){2,})$', 1) AS description,
  regexp_split_to_array(regexp_replace(regexp_extract(normalized, '^(.*?\S)((?:[\s\p{Z}]+[$£€¥]?\d[\d.,]*){2,})$', 2), '^[\s\p{Z}]+', ''), '[\s\p{Z}]+') AS n
  FROM lines WHERE regexp_matches(normalized, '^(.*?\S)((?:[\s\p{Z}]+[$£€¥]?\d[\d.,]*){2,})$'))
SELECT doc_id, line_no, description, len(n) AS n_numbers, n[len(n)] AS last_number FROM r""")
def item_rows(spark, d):
    return structure.parse_item_rows(form_lines(spark, d))


_TYPED = r""", tk AS (SELECT doc_id, line_no, normalized, regexp_split_to_array(normalized, '[\s\p{Z}]+') AS t FROM lines WHERE NOT is_empty),
typed AS (SELECT doc_id, line_no, CASE
  WHEN regexp_matches(normalized, '^[^:=]+[:=].*') AND NOT regexp_matches(normalized, '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}|^\[?\d{4}-\d{2}-\d{2}|^\s*(?:at [\p{L}\p{N}_.$]+\(|Caused by:)|\.java:\d+') THEN 'kv'
  WHEN len(list_filter(t, lambda x: regexp_matches(upper(x), '^(?:ERROR|WARN|WARNING|INFO|DEBUG|CRITICAL|FATAL)$'))) > 0 THEN 'log'
  WHEN len(list_filter(t, lambda x: regexp_matches(x, '^[\[(]?[$£€¥]?-?\d[\d.,]*%?(?:ms|MB/s|GB|KB|s)?[\])]?$'))) / len(t) >= 0.6 THEN 'telemetry' ELSE 'prose' END AS kind FROM tk)"""


@query(_FORMS + _TYPED + """, g AS (SELECT *, coalesce((kind <> lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no))::INT, 0) AS o FROM typed),
r AS (SELECT *, CAST(sum(o) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS run FROM g)
SELECT doc_id, run, kind, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_lines FROM r GROUP BY 1, 2, 3""")
def context_runs(spark, d):
    return structure.context_runs(structure.context_lines(form_lines(spark, d)))


@query(_FORMS + _TYPED + """, p AS (SELECT doc_id, kind, count(*) AS n FROM typed GROUP BY 1, 2),
q AS (SELECT doc_id, kind, n, sum(n) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, kind) AS k FROM p)
SELECT doc_id, CASE WHEN n * 2 >= total THEN kind ELSE 'mixed' END AS dominant, round(n / total, 4) AS share FROM q WHERE k = 1""")
def context_dominant(spark, d):
    return structure.context_dominant(structure.context_lines(form_lines(spark, d)))


@query(_FORMS + _TYPED + """, p AS (SELECT doc_id, kind, count(*) AS n FROM typed GROUP BY 1, 2), q AS (SELECT *, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM p)
SELECT doc_id, round(CASE WHEN count(*) < 2 THEN 0.0 ELSE -sum(p * log2(p)) / log2(count(*)) END, 4) AS entropy FROM q GROUP BY 1""")
def type_entropy(spark, d):
    typed = structure.context_lines(form_lines(spark, d)).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))
    return structure.entropy(typed, "doc_id", "kind", "n")


_TREE = """ln AS (SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS line_no, l_partkey % 5 AS depth FROM lineitem
  UNION ALL SELECT -1 - o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT), row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) % 17 + o_orderkey % 2 FROM orders),
tree AS (SELECT a.doc_id, a.line_no, a.depth, max(b.line_no) AS parent_line FROM ln a LEFT JOIN ln b ON a.doc_id = b.doc_id AND b.line_no < a.line_no AND b.depth < a.depth GROUP BY 1, 2, 3)"""


def _tree(spark, d):
    """Lines with depths from 0 to 4 (items) and to 17 (the orders of a customer)."""
    li = table(spark, d, "lineitem").selectExpr("l_orderkey AS doc_id", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS line_no", "l_partkey % 5 AS depth")
    o = table(spark, d, "orders").selectExpr("-1 - o_custkey AS doc_id", "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line_no", "o_orderkey % 2 AS odd")
    return structure.hierarchy(li.unionAll(o.selectExpr("doc_id", "line_no", "line_no % 17 + odd AS depth")), ["doc_id"])


@query("WITH " + _TREE + " SELECT doc_id, line_no, parent_line FROM tree")
def hierarchy_parent(spark, d):
    return _tree(spark, d).select("doc_id", "line_no", "parent_line")


@query("WITH " + _TREE + """, s AS (SELECT *, (depth - lag(depth) OVER (PARTITION BY doc_id ORDER BY line_no)) AS step FROM tree)
SELECT doc_id, count(*) AS n_lines, max(depth) AS max_depth, count(*) FILTER (WHERE parent_line IS NULL) AS roots, round(avg((step <= 1)::INT), 4) AS smooth_share FROM s GROUP BY 1""")
def hierarchy_metrics(spark, d):
    return structure.hierarchy_metrics(_tree(spark, d), ["doc_id"])


def _blocks(spark, d):
    """Blocks of the typed runs and item tables of each form."""
    lines = form_lines(spark, d)
    total = lines.groupBy("doc_id").agg(F.count("*").alias("total_lines"))
    runs = structure.context_runs(structure.context_lines(lines)).filter("kind in ('kv', 'prose')").select(
        "doc_id", F.when(F.col("kind") == "kv", "kv").otherwise("context").alias("source"), F.col("first_line").alias("start_line"), F.col("last_line").alias("end_line"), F.lit(0.8).alias("confidence"))
    items = structure.parse_item_rows(lines).groupBy("doc_id").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line")).select(
        "doc_id", F.lit("table").alias("source"), "start_line", "end_line", F.lit(0.9).alias("confidence"))
    return runs.unionByName(items).withColumn("block_id", F.xxhash64("doc_id", "source", "start_line", "end_line")).join(total, "doc_id")


@query()
def block_arbitration(spark, d):
    return structure.arbitrate(_blocks(spark, d)).select("doc_id", "source", "start_line", "end_line", "score")


@query()
def classification(spark, d):
    return structure.classify_blocks(structure.arbitrate(_blocks(spark, d)))
