"""Queries over sources and streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.operators import textlines
from ledgerloom.session import shared_dir, table
from ledgerloom.sources import formats
from ledgerloom.streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(r"""
WITH ex AS (SELECT env_id AS doc_id, unnest(string_split(payload, chr(10))) AS line, generate_subscripts(string_split(payload, chr(10)), 1) - 1 AS line_no FROM coc_envelopes WHERE payload IS NOT NULL),
t AS (SELECT doc_id, line_no, CASE WHEN trim(line, ' ') = '' THEN NULL
  WHEN regexp_matches(trim(line, ' '), '(?i)</[a-z][a-z0-9]*>|^<(?:div|table|tr|td|p|span|html|body|ul|li)\b|<!doctype') THEN 'html'
  WHEN regexp_matches(trim(line, ' '), '^[\[{]$|^[\]}],?$|^"[^"]+"\s*:') THEN 'json'
  WHEN length(line) - length(replace(line, ',', '')) >= 2 AND NOT regexp_matches(trim(line, ' '), '^[<{\[#]') THEN 'csv' ELSE 'text' END AS type FROM ex),
f AS (SELECT *, coalesce(type <> lag(type) OVER w OR line_no - lag(line_no) OVER w > 2, false) AS opens FROM t WHERE type IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
r AS (SELECT *, CAST(sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS segment FROM f)
SELECT doc_id, segment, type, min(line_no) AS start_line, max(line_no) AS end_line, count(*) AS n_lines FROM r GROUP BY 1, 2, 3""")
def segmenter_types(spark, d):
    return formats.typed_segments(textlines.line_model(table(spark, d, "coc_envelopes"), "env_id", "payload"))


@query("""
WITH n AS (SELECT doc_id, length(text) AS length FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id, (doc_id % 7) * 20 AS position FROM n WHERE doc_id % 3 <> 0 AND (doc_id % 7) * 20 > 0),
s AS (SELECT doc_id, 0 AS position FROM n UNION SELECT doc_id, position FROM g)
SELECT doc_id, row_number() OVER w AS region, position AS start, coalesce(lead(position) OVER w, length) AS "end" FROM s JOIN n USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY position)""")
def partition_regions(spark, d):
    n = table(spark, d, "documents").filter("text is not null").select("doc_id", F.length("text").alias("length"))
    signals = n.selectExpr("doc_id", "(doc_id % 7) * 20 AS position", "CASE WHEN doc_id % 3 = 0 THEN 0.5D ELSE 0.9D END AS strength")
    return formats.partition_regions(signals, n)


@query("""SELECT event_type, sha256(CAST(sum(CAST('0x' || substr(md5(user_id || ':' || n), 1, 12) AS HUGEINT)) AS VARCHAR) || ':' || count(*)) AS digest
FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def event_digest(spark, d):
    """A digest of the users of each kind of event and how often they stand, whatever their order."""
    per = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    part = F.conv(F.substring(F.md5(F.concat_ws(":", "user_id", "n")), 1, 12), 16, 10).cast("decimal(38,0)")  # a sum needs no order and combines before the shuffle
    return per.groupBy("event_type").agg(F.sha2(F.concat_ws(":", F.sum(part).cast("string"), F.count("*")), 256).alias("digest"))


def _stream(spark, d):
    kind = table(spark, d, "events").schema
    return spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT count(DISTINCT user_id || event_type || CAST(ts AS DATE)) AS n FROM events")
def stream_drop_repeats(spark, d):
    """Streaming ingestion of the events in which a user's kind of a day counts once."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    keyed = _stream(spark, d).withColumn("source_id", F.concat_ws("|", "user_id", "event_type", F.to_date("ts").cast("string")))
    once = ingest.run_once(ingest.drop_repeats(keyed, delay="3650 days").select("source_id", "ts"), base, base + "-checkpoint")
    return once.agg(F.count("*").alias("n"))


@query("SELECT event_type, count(value) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def stream_baseline(spark, d):
    """Running baseline of the values of each kind of event, from keyed state."""
    base, parts = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", []
    stream = ingest.running_baseline(_stream(spark, d), "event_type", "value")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{base}/{number}")
        parts.append(f"{base}/{number}")

    stream.writeStream.outputMode("update").option("checkpointLocation", base + "-checkpoint").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(*parts).groupBy("event_type").agg(F.max_by(F.struct("n", "low", "high"), "n").alias("s")).select("event_type", "s.*")
