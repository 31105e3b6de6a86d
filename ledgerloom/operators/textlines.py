"""Text as lines: the line model, signals, metrics, features, boundaries and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WS = r"[\s\p{Z}]"
LIST_LINE = rf"^{WS}*(?:[-*•]|\d+[.)]){WS}+"
BULLET, NUMBERED = rf"^{WS}*[-*•]{WS}+", rf"^{WS}*\d+[.)]{WS}+"
SEPARATOR = rf"^(?:[-=_]{WS}*){{3,}}$"
KV_LINE = r"^[^:=]+[:=].*"
#: A line such as "Due date: 2 May": a short key of at most three words and a value.
KV_SHORT = r"^[\p{L}\p{N}_.-]+(?: [\p{L}\p{N}_.-]+){0,2} ?[:=] *[^ ].*"
# Weights of signals.
STRENGTH = {"separator": 1.0, "empty_line": 0.75, "list_marker": 0.5, "newline": 0.25}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def line_model(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a line: ``doc_id, line_no, line, normalized, indent, is_empty, n_tokens, start`` (code points)."""
    own = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = own.withColumn("normalized", strip(F.col("line")))
    return rows.select(
        "doc_id", "line_no", "line", "normalized", F.length(F.regexp_extract("line", rf"^({WS}*)", 1)).alias("indent"), (F.col("normalized") == "").alias("is_empty"),
        F.when(F.col("normalized") == "", 0).otherwise(F.size(F.split("normalized", rf"{WS}+"))).alias("n_tokens"),
        F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).alias("start"))


def text_signals(lines: DataFrame) -> DataFrame:
    full = ~F.col("is_empty")
    size = F.length("line")
    return lines.groupBy("doc_id").agg(
        F.count("*").alias("total_lines"), F.count_if("is_empty").alias("empty_lines"), F.count_if(F.col("line").rlike(BULLET)).alias("bullet_lines"),
        F.count_if(F.col("line").rlike(NUMBERED)).alias("numbered_lines"), F.sum(F.when(full, size).otherwise(0)).alias("content_chars"),
        F.sum(F.when(full, size * size).otherwise(0)).alias("content_squares"), F.count_if(full).alias("content_lines"))


def token_observations(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    count = lambda rx: F.regexp_count(F.col(text), F.lit(rx))
    return docs.filter(F.col(text).isNotNull()).select(
        F.col(key).alias("doc_id"), F.length(text).alias("chars"), count(r"[\p{L}\p{N}_]+").alias("words"), count(r"\p{Lu}").alias("uppercase"),
        count(r"\p{Ll}").alias("lowercase"), count(r"\p{Nd}").alias("digits"), count(r"\p{P}").alias("punctuation"), count(r"\p{S}").alias("symbols"))


def sentence_end(line: Column) -> Column:
    s = strip(line)
    return s.rlike(r"[.!?]$") & ~s.rlike(r"(?:^|[^A-Za-z])(?:[A-Za-z]\.){2,}$") & ~s.rlike(r"(?:^|[^\p{L}\p{N}_])[A-Za-z]{1,3}\.$")


def list_blocks(lines: DataFrame) -> DataFrame:
    """Non-blank lines with whether they enter or leave a list; blanks don't leave it."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    full = lines.filter(~F.col("is_empty")).withColumn("is_list", F.col("line").rlike(LIST_LINE))
    was = F.coalesce(F.lag("is_list").over(w), F.lit(False))
    return full.withColumn("enters", F.col("is_list") & ~was).withColumn("leaves", ~F.col("is_list") & was)


def boundary_signals(lines: DataFrame) -> DataFrame:
    marked = list_blocks(lines)
    w = Window.partitionBy("doc_id").orderBy("line_no")
    gap = F.coalesce(F.col("line_no") - F.lag("line_no").over(w), F.lit(1)) > 1
    per = marked.withColumn("gap", gap).groupBy("doc_id").agg(
        F.count_if("gap").alias("paragraph_breaks"), F.count_if(sentence_end(F.col("line"))).alias("sentence_end_lines"), F.count_if("enters").alias("list_block_count"))
    return per.withColumn("list_block_transitions", F.greatest(F.col("list_block_count") - 1, F.lit(0)))


def list_transitions(lines: DataFrame) -> DataFrame:
    """Offsets at which a list begins or ends."""
    return list_blocks(lines).filter("enters or leaves").select("doc_id", "line_no", "start", F.when(F.col("enters"), "entry").otherwise("exit").alias("kind"))


def signal_counts(lines: DataFrame) -> DataFrame:
    """Counts of newlines, blank runs, list markers and separators of each document."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    marked = lines.withColumn("opens", F.col("is_empty") & ~F.coalesce(F.lag("is_empty").over(w), F.lit(False)) & (F.col("line_no") > 0))
    last = Window.partitionBy("doc_id")
    marked = marked.withColumn("inner", F.col("line_no") < F.max(F.when(~F.col("is_empty"), F.col("line_no"))).over(last))
    return marked.groupBy("doc_id").agg(
        (F.count("*") - 1).alias("newline"), F.count_if(F.col("opens") & F.coalesce("inner", F.lit(False))).alias("empty_line"),
        F.count_if(F.col("line").rlike(rf"^[ \t]*(?:[-*•]|\d+\.){WS}")).alias("list_marker"), F.count_if(F.col("line").rlike(r"^[ \t]*[-=_]{3,}[ \t]*$")).alias("separator"))


def structural_metrics(lines: DataFrame) -> DataFrame:
    """Strength, boundary pressure and consistency of each document's structure."""
    joined = text_signals(lines).join(boundary_signals(lines), "doc_id").join(signal_counts(lines), "doc_id")
    c = F.col
    strength = sum((c(k) * v for k, v in STRENGTH.items()), F.lit(0.0)) + c("paragraph_breaks") * 0.75 + c("list_block_transitions") * 0.5 + c("sentence_end_lines") * 0.25
    n = c("content_lines")
    variance = F.greatest(c("content_squares") / n - (c("content_chars") / n) * (c("content_chars") / n), F.lit(0.0))
    return joined.select("doc_id", (strength / c("total_lines")).alias("normalized_strength"),
                         ((c("paragraph_breaks") + c("list_block_transitions")) / c("total_lines")).alias("boundary_pressure"), (1 / (1 + variance)).alias("consistency"))


def soft(x: Column, scale: float) -> Column:
    return F.when(x <= 0, 0.0).otherwise(x / (x + scale))


def feature_vector(metrics: DataFrame) -> DataFrame:
    """Features in [0, 1]: intensities, stability and disorder."""
    boundary, stability = soft(F.col("boundary_pressure"), 1.0), F.least(F.greatest("consistency", F.lit(0.0)), F.lit(1.0))
    return metrics.select("doc_id", soft(F.col("normalized_strength"), 1.0).alias("structure_intensity"), boundary.alias("boundary_intensity"),
                          stability.alias("stability"), soft(boundary * (1 - stability), 0.5).alias("chaos_index"))


def split_segments(lines: DataFrame) -> DataFrame:
    """``doc_id, ordinal, first_line, last_line, content``: pieces between accepted boundaries.

    A separator, the entry and exit of a list, and a blank run split, the last unless the lines on
    both sides are keys with values. Pieces without a letter or digit are left out.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    full = list_blocks(lines).withColumn("is_sep", F.col("normalized").rlike(SEPARATOR)).withColumn("is_kv", F.col("normalized").rlike(KV_SHORT))
    lag = lambda c: F.coalesce(F.lag(c).over(w), F.lit(False))
    gap = (F.col("line_no") - F.lag("line_no").over(w) > 1) & ~(F.col("is_kv") & lag("is_kv"))
    opens = F.col("enters") | F.col("leaves") | F.col("is_sep") | lag("is_sep") | F.coalesce(gap, F.lit(False))
    piece = full.withColumn("opens", opens).withColumn("piece", F.sum(F.col("opens").cast("int")).over(w))
    grouped = piece.groupBy("doc_id", "piece").agg(
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "normalized"))), lambda x: x["normalized"]), "\n").alias("content"))
    kept = grouped.filter(F.col("content").rlike(r"[\p{L}\p{N}]"))
    return kept.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("piece"))).drop("piece")


def normalize_text(text: Column) -> Column:
    """Without zero-width characters, with plain spaces, and at most one blank line in a row."""
    s = F.regexp_replace(text, "[\\u200B-\\u200D\\uFEFF\\u2060]", "")
    s = F.regexp_replace(s, "\\u00A0", " ")
    return F.regexp_replace(F.regexp_replace(s, "\n{4,}", "\n\n\n"), r"(?:\n\s*){3,}", "\n\n")
