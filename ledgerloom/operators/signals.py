"""Signals in texts: spans, markup, long lines, the kind of unknown text, formulas, and their contracts.

All are expressions over the text or its line model; nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.operators.textlines import STRENGTH

TAG = r"<[a-zA-Z/][^>]*>"
MARKER = r"^[ \t]*(?:[-*•]|\d+[.)])[ \t]+"
RULE = r"^[ \t]*(?:[-=_][ \t]*){3,}$"
#: Lines of more characters are worth a warning.
LONG_LINE = 10_000
# Words that make a line look like a formula.
MATH_WORDS = ["sum", "integral", "limit", "theorem", "equation", "derivative", "matrix", "vector", "sqrt", "log"]


def sanitize(text: Column) -> Column:
    """Text without tags and with its entities resolved; text without any tag stays as it is."""
    bare = F.regexp_replace(text, TAG, "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.when(text.rlike(TAG), bare).otherwise(text)


def signal_spans(lines: DataFrame) -> DataFrame:
    """``doc_id, signal, start, stop, strength`` in code points: line ends, runs of blank lines between two line ends, list markers and rules."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    last = F.lead("line_no").over(w).isNull()
    stop = F.col("start") + F.length("line")
    blank = F.col("is_empty")
    own = lines.withColumns({"stop": stop, "last": last, "opens": blank & ~F.coalesce(F.lag("is_empty").over(w), F.lit(False))})
    own = own.withColumn("run", F.sum(F.col("opens").cast("int")).over(w))
    one = lambda s, cond, a, b: own.filter(cond).select("doc_id", F.lit(s).alias("signal"), a.alias("start"), b.alias("stop"))
    c = F.col
    marker = F.regexp_extract("line", MARKER, 0)
    spans = one("newline", ~c("last"), c("stop"), c("stop") + 1).unionAll(
        one("list_marker", c("line").rlike(MARKER), c("start"), c("start") + F.length(marker))).unionAll(
        one("separator", c("line").rlike(RULE), c("start"), c("stop")))
    gaps = own.filter(blank & (c("line_no") > 0) & ~c("last")).groupBy("doc_id", "run").agg((F.min("start") - 1).alias("start"), (F.max("stop") + 1).alias("stop"))
    spans = spans.unionAll(gaps.select("doc_id", F.lit("empty_line").alias("signal"), "start", "stop"))
    strength = F.coalesce(*[F.when(c("signal") == k, F.lit(v)) for k, v in STRENGTH.items()])
    return spans.withColumn("strength", strength)


def broken_spans(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """Spans that break the contract: unknown kind or strength, or not 0 <= start <= stop <= length of the text."""
    fits = F.col("signal").isin(*STRENGTH) & F.col("strength").between(0, 1) & (F.col("start") >= 0) & (F.col("start") <= F.col("stop")) & (F.col("stop") <= F.col("length"))
    return spans.join(lengths, "doc_id").filter(~F.coalesce(fits, F.lit(False)))


def broken_features(features: DataFrame, names: list[str]) -> DataFrame:
    """Rows with a feature that is missing, no number or outside 0 to 1."""
    fits = F.lit(True)
    for n in names:
        fits = fits & F.coalesce(F.col(n).between(0, 1), F.lit(False)) & ~F.coalesce(F.isnan(F.col(n).cast("double")), F.lit(False))
    return features.filter(~fits)


def long_lines(lines: DataFrame, most: int = LONG_LINE) -> DataFrame:
    return lines.filter(F.length("line") > most).select("doc_id", "line_no", F.length("line").alias("n_chars"))


def looks_binary(content: Column) -> Column:
    """Of the first 4,096 bytes: zeros (but not those of UTF-16), or more than 30 % that no text has."""
    head = F.hex(F.substring(content, 1, 4096))
    n = F.length(head) / 2
    pairs = F.regexp_replace(head, "(..)", "$1 ")
    zeros = F.regexp_count(pairs, F.lit("00 ")) / n
    odd = F.regexp_count(pairs, F.lit("(?:0[1-8BEF]|1[0-9A-F]|7F) ")) / n
    wide = head.rlike("^(?:FFFE|FEFF)") | zeros.between(0.3, 0.6)
    return F.when(n == 0, False).otherwise(((zeros > 0) & ~wide) | (odd > 0.3))


def unknown_kind(lines: DataFrame, most: int = 50) -> DataFrame:
    """``doc_id, html, json, csv, delimiter, kind``: what the first ``most`` lines that aren't blank look like.

    The delimiter is the most frequent of comma, semicolon, tab and bar; csv needs the same width in 85 % of the lines that have it.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    head = lines.filter(~F.col("is_empty")).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    s = F.col("normalized")
    count = lambda mark: F.length("line") - F.length(F.replace("line", F.lit(mark), F.lit("")))
    marks = {"comma": ",", "semicolon": ";", "tab": "\t", "bar": "|"}
    per = head.groupBy("doc_id").agg(*[F.sum(count(m)).alias(k) for k, m in marks.items()])
    best = F.greatest(*marks)
    named = F.coalesce(*[F.when((F.col(k) == best) & (best > 0), F.lit(m)) for k, m in marks.items()], F.lit(","))
    marked = head.join(per.select("doc_id", named.alias("delimiter")), "doc_id")
    width = F.size(F.split("line", F.concat(F.lit("\\Q"), "delimiter", F.lit("\\E"))))
    marked = marked.withColumns({
        "html": s.rlike(r"(?i)</[a-z][a-z0-9]*>|^<(?:div|table|tr|td|p|span|html|body|ul|li)\b|<!doctype"), "json": s.rlike(r'^[\[{]|^[\]}],?$|^"[^"]+"\s*:'),
        "width": F.when(~s.rlike(r"^[<{\[#]") & (width >= 2), width)})
    shares = marked.groupBy("doc_id", "delimiter").agg(
        F.round(F.avg(F.col("html").cast("int")), 4).alias("html"), F.round(F.avg(F.col("json").cast("int")), 4).alias("json"), F.round(F.count("width") / F.count("*"), 4).alias("csv"))
    modal = marked.filter("width is not null").groupBy("doc_id", "width").count().groupBy("doc_id").agg(F.round(F.max("count") / F.sum("count"), 4).alias("steady"))
    kind = (F.when(F.col("html") >= 0.25, "html").when((F.col("csv") >= 0.70) & (F.col("steady") >= 0.85), "csv").when(F.col("json") >= 0.40, "json").otherwise("txt"))
    return shares.join(modal, "doc_id", "left").select("doc_id", "html", "json", "csv", "delimiter", kind.alias("kind"))


def math_score(line: Column) -> Column:
    """3 for each mathematical character, 1 for each operator, 2 for each word of mathematics, 5 for an equals sign beside a letter or digit."""
    count = lambda rx: F.regexp_count(line, F.lit(rx))
    return (3 * count(r"[\x{2200}-\x{22FF}\x{2A00}-\x{2AFF}\x{27C0}-\x{27EF}\x{2190}-\x{21FF}]") + count(r"[+*/^]") + 2 * count(r"(?i)\b(?:" + "|".join(MATH_WORDS) + r")\b")
            + F.when(line.rlike(r"[a-zA-Z0-9]\s*=|=\s*[a-zA-Z0-9]"), 5).otherwise(0))


def formulas(lines: DataFrame, least: int = 5) -> DataFrame:
    """``doc_id, first_line, last_line, score, confidence`` of runs of lines that read like formulas.

    A run goes on while a line scores ``least`` - 3 or has an equals sign, and counts if one of its lines scores ``least``.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    scored = lines.withColumn("score", math_score(F.col("line")))
    near = scored.withColumn("near", (F.col("score") >= least - 3) | F.col("line").contains("="))
    run = near.withColumn("run", F.sum(F.when(F.col("near") & ~F.coalesce(F.lag("near").over(w), F.lit(False)), 1).otherwise(0)).over(w)).filter("near")
    found = run.groupBy("doc_id", "run").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.max("score").alias("score"))
    return found.filter(F.col("score") >= least).select("doc_id", "first_line", "last_line", "score", F.round(F.least(F.lit(0.98), F.col("score") / 25), 4).alias("confidence"))


def sentence_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, sentence, start, stop`` in code points: a sentence ends at a mark before a blank, or at the end of the text."""
    cut = F.split(F.col(text), r"(?<=[.!?])(?=\s)")
    pieces = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), F.posexplode(cut).alias("sentence", "piece"))
    before = Window.partitionBy("doc_id").orderBy("sentence").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0))
    return pieces.select("doc_id", "sentence", at.alias("start"), (at + F.length("piece")).alias("stop"))
