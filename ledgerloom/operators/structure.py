"""Structure of line groups: patterns, routing signals, regions, keys with values, tables, runs, trees, blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ledgerloom.operators.textlines import KV_LINE, LIST_LINE, SEPARATOR, WS

NUMBER = r"^[\[(]?[$£€¥]?-?\d[\d.,]*%?(?:ms|MB/s|GB|KB|s)?[\])]?$"
KEY = r"^[\p{L}\p{N}_.-]+(?: [\p{L}\p{N}_.-]+){0,2}(?: \([^)]{1,12}\))?$"
NOT_KV = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}|^\[?\d{4}-\d{2}-\d{2}|^\s*(?:at [\p{L}\p{N}_.$]+\(|Caused by:)|\.java:\d+"
# Words of log severity.
SEVERITY = "ERROR|WARN|WARNING|INFO|DEBUG|CRITICAL|FATAL"
# Priority and weight of block sources, and the sources that conflict beside equal ones.
PRIORITY = {"table": 5, "tree_structure": 4, "context": 3, "kv": 2}
WEIGHT = {"table": 1.0, "tree_structure": 0.9, "kv": 0.8, "context": 0.7}
_RIVALS = ({"table", "kv"}, {"tree_structure", "context"})


def conflicting(a: str, b: str) -> bool:
    """Whether overlapping blocks of two sources can't both stay."""
    return a == b or {a, b} in _RIVALS


def line_patterns(lines: DataFrame) -> DataFrame:
    """The names of all patterns that a line shows, in fixed order."""
    n = F.col("normalized")
    checks = {
        "empty": F.col("is_empty"), "separator": n.rlike(SEPARATOR), "list_item": n.rlike(LIST_LINE), "kv_pair": n.rlike(KV_LINE),
        "indented": (F.col("indent") > 0) & ~F.col("is_empty"), "numeric_value": n.rlike(r"(?:^|[^\p{L}\p{N}_])\d[\d,.]*"),
        "header_like": (F.length(n) <= 60) & F.col("n_tokens").between(1, 5) & n.rlike(r"\p{L}") & ~n.rlike(r"[.!?]$") & ~n.rlike(LIST_LINE) & ~n.rlike(KV_LINE) & ~n.rlike(SEPARATOR),
    }
    return lines.select("doc_id", "line_no", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()])), ",").alias("patterns"))


def _share(cond: Column, digits: int = 4) -> Column:
    return F.round(F.avg(cond.cast("int")), digits)


def region_features(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Shares over the non-empty lines of each group, and the modal shares of token count and shape."""
    full = lines.filter(~F.col("is_empty"))
    n = F.col("normalized")
    delim = n.rlike("[:=]")
    shares = full.groupBy(*keys).agg(
        F.count("*").alias("n_lines"), _share(n.contains("|")).alias("pipe"), _share(n.rlike(KV_LINE)).alias("kv"), _share(delim).alias("delimiter"),
        _share(n.rlike(rf"{WS}{{2,}}")).alias("multi_space"), _share(F.col("line").rlike(r"^\s*(?:[│|]\s*)*[+├└]\s*[-─]+")).alias("glyph"),
        _share(n.rlike(r"(?:\s+[$£€¥]?-?\d[\d.,]*){2,}$")).alias("numeric_tail"), F.bool_or(n.rlike(SEPARATOR) | n.contains("|")).alias("ruled"))
    modal = lambda *c: full.groupBy(*keys, *c).count().groupBy(*keys).agg(F.round(F.max("count") / F.sum("count"), 4).alias("m"))
    stable = modal("n_tokens").withColumnRenamed("m", "stable")
    shaped = full.withColumn("has_delim", delim).withColumn("indented", F.col("indent") > 0)
    shape = shaped.groupBy(*keys, "n_tokens", "has_delim", "indented").count().groupBy(*keys).agg(F.round(F.max("count") / F.sum("count"), 4).alias("shape"))
    return shares.join(stable, keys).join(shape, keys)


def classify_regions(features: DataFrame) -> DataFrame:
    """``region`` by the first rule that holds: table_candidate, structured_block or unstructured."""
    c = F.col
    table = (c("n_lines") >= 3) & (((c("pipe") >= 0.5) & c("ruled")) | (c("numeric_tail") >= 0.5))
    glyph = (c("n_lines") >= 3) & (c("glyph") >= 0.3)
    spaced = (c("n_lines") >= 3) & (c("stable") >= 0.6) & (c("multi_space") >= 0.5)
    block = (c("n_lines") >= 2) & ((c("kv") >= 0.35) | ((c("delimiter") >= 0.4) & (c("shape") >= 0.5)))
    region = (F.when((c("n_lines") >= 3) & (c("pipe") >= 0.5) & c("ruled"), "table_candidate").when(glyph, "structured_block")
              .when(table | spaced, "table_candidate").when(block, "structured_block").otherwise("unstructured"))
    return features.withColumn("region", region)


def route(features: DataFrame, gap: float = 0.15) -> DataFrame:
    """Where a group goes: the leading candidate if it is clear of the next, AMBIGUOUS if not, PASS_THROUGH if weak."""
    scores = F.sort_array(F.array(*[F.struct(F.col(k).alias("score"), F.lit(v).alias("name")) for k, v in (("pipe", "TABLE"), ("kv", "KV"), ("glyph", "TREE"))]), asc=False)
    top = features.withColumn("s", scores)
    first, second = F.col("s")[0], F.col("s")[1]
    tier = F.when(first["score"] < 0.05, "NO_STRUCTURE").when(first["score"] < 0.15, "WEAK").otherwise("STRUCTURED")
    where = F.when(first["score"] < 0.15, "PASS_THROUGH").when(first["score"] - second["score"] >= gap, first["name"]).otherwise("AMBIGUOUS")
    return top.withColumn("tier", tier).withColumn("route", where).drop("s")


def detect_kv(lines: DataFrame) -> DataFrame:
    """``doc_id, line_no, key, delimiter, value, confidence`` of the lines that are a key and a value."""
    n = F.col("normalized")
    cut = lambda i: F.regexp_extract(n, r"^([^:=]*)([:=])(.*)$", i)
    rows = lines.filter(~n.rlike(NOT_KV) & n.rlike(KV_LINE)).select("doc_id", "line_no", F.trim(cut(1)).alias("key"), cut(2).alias("delimiter"), F.trim(cut(3)).alias("value"))
    return rows.filter(F.col("key").rlike(KEY)).withColumn("confidence", F.when(F.col("value") == "", 0.8).otherwise(1.0))


def nested_pairs(kv: DataFrame) -> DataFrame:
    """Values that are themselves pairs, split at ``;`` or ``,`` where at least 60 % of the parts are pairs."""
    parts = F.filter(F.transform(F.split("value", "[;,]"), lambda x: F.trim(x)), lambda x: x != "")
    pairs = F.filter(parts, lambda x: x.rlike(r"^[\p{L}\p{N}_.-]+(?: [\p{L}\p{N}_.-]+){0,2} ?[:=].+"))
    sized = kv.withColumn("parts", F.size(parts)).withColumn("pairs", F.size(pairs))
    return sized.filter((F.col("parts") >= 2) & (F.col("pairs") >= 0.6 * F.col("parts"))).select("doc_id", "line_no", "key", "parts", "pairs")


def parse_pipe_rows(lines: DataFrame) -> DataFrame:
    """Cells of lines with pipes, without rule lines; ``width`` is the widest row of the document."""
    rows = lines.filter(F.col("normalized").contains("|") & ~F.col("normalized").rlike(r"^[|\-+ =]+$"))
    cells = F.transform(F.split(F.regexp_replace("normalized", r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x))
    rows = rows.select("doc_id", "line_no", cells.alias("cells"))
    return rows.withColumn("width", F.max(F.size("cells")).over(Window.partitionBy("doc_id")))


def parse_item_rows(lines: DataFrame) -> DataFrame:
    """Rows of a description and a trailing run of at least two numbers."""
    rx = r"^(.*?\S)((?:[\s\p{Z}]+[$£€¥]?\d[\d.,]*){2,})$"
    found = lines.filter(F.col("normalized").rlike(rx))
    numbers = F.split(F.regexp_replace(F.regexp_extract("normalized", rx, 2), r"^[\s\p{Z}]+", ""), r"[\s\p{Z}]+")
    return found.select("doc_id", "line_no", F.regexp_extract("normalized", rx, 1).alias("description"), F.size(numbers).alias("n_numbers"), numbers.getItem(F.size(numbers) - 1).alias("last_number"))


def context_lines(lines: DataFrame) -> DataFrame:
    """Each non-empty line as kv, log, telemetry or prose."""
    n = F.col("normalized")
    tokens = F.split("normalized", rf"{WS}+")
    numeric = F.size(F.filter(tokens, lambda t: t.rlike(NUMBER))) / F.size(tokens)
    severity = F.exists(tokens, lambda t: F.upper(t).rlike(f"^(?:{SEVERITY})$"))
    kind = F.when(n.rlike(KV_LINE) & ~n.rlike(NOT_KV), "kv").when(severity, "log").when(numeric >= 0.6, "telemetry").otherwise("prose")
    return lines.filter(~F.col("is_empty")).select("doc_id", "line_no", kind.alias("kind"))


def context_runs(typed: DataFrame) -> DataFrame:
    """Runs of equal kind: gaps and islands over the lines of a document."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    opens = (F.col("kind") != F.lag("kind").over(w)).cast("int")
    run = typed.withColumn("run", F.sum(F.coalesce(opens, F.lit(0))).over(w))
    return run.groupBy("doc_id", "run", "kind").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count("*").alias("n_lines"))


def context_dominant(typed: DataFrame) -> DataFrame:
    """The kind of at least half of the lines, else mixed; ties in the order kv, log, telemetry, prose."""
    rank = F.when(F.col("kind") == "kv", 0).when(F.col("kind") == "log", 1).when(F.col("kind") == "telemetry", 2).otherwise(3)
    per = typed.groupBy("doc_id", "kind").agg(F.count("*").alias("n")).withColumn("rank", rank)
    top = per.groupBy("doc_id").agg(F.max_by("kind", F.struct("n", -F.col("rank"))).alias("kind"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return top.select("doc_id", F.when(F.col("n") * 2 >= F.col("total"), F.col("kind")).otherwise("mixed").alias("dominant"), F.round(F.col("n") / F.col("total"), 4).alias("share"))


def hierarchy(lines: DataFrame, group: list[str]) -> DataFrame:
    """``lines`` with ``parent_line``: the nearest line before each in its group with smaller ``depth``, however deep.

    One pass over the sorted lines of each group with a stack of the open ancestors; null depths count as 0.
    """
    columns = lines.columns
    ordered = lines.repartition(*group).sortWithinPartitions(*group, "line_no")
    at, depth = columns.index("line_no"), columns.index("depth")
    keys = [columns.index(g) for g in group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, stack = None, []
        for batch in batches:
            parents = []
            for row in zip(*(batch.column(i).to_pylist() for i in (at, depth, *keys))):
                if row[2:] != current:
                    current, stack = row[2:], []
                own = row[1] or 0
                while stack and stack[-1][0] >= own:
                    stack.pop()
                parents.append(stack[-1][1] if stack else None)
                stack.append((own, row[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parents, batch.column(at).type)], [*columns, "parent_line"])

    return ordered.mapInArrow(run, T.StructType([*lines.schema.fields, T.StructField("parent_line", lines.schema["line_no"].dataType)]))


def indent_depths(lines: DataFrame) -> DataFrame:
    """``lines`` (the line model) with ``unit``, the greatest common divisor of the document's indents, and ``depth`` in it, the least depth being 0.

    The different indents of a document are few; their divisor is folded from them as an expression.
    """
    gcd = "aggregate(sequence(1, 64), named_struct('a', acc, 'b', x), (s, i) -> if(s.b = 0, s, named_struct('a', s.b, 'b', s.a % s.b)), s -> s.a)"
    full = lines.filter(~F.col("is_empty"))
    per = full.groupBy("doc_id").agg(F.collect_set(F.when(F.col("indent") > 0, F.col("indent"))).alias("i"), F.min("indent").alias("least"))
    unit = F.expr(f"greatest(1, aggregate(i, 0, (acc, x) -> {gcd}))")
    per = per.select("doc_id", unit.alias("unit"), "least")
    return full.join(per, "doc_id").withColumn("depth", F.floor(F.col("indent") / F.col("unit")) - F.floor(F.col("least") / F.col("unit"))).drop("least")


def hierarchy_metrics(tree: DataFrame, group: list[str]) -> DataFrame:
    w = Window.partitionBy(*group).orderBy("line_no")
    step = F.col("depth") - F.lag("depth").over(w)
    marked = tree.withColumn("smooth", F.when(step.isNotNull(), (step <= 1).cast("int")))
    return marked.groupBy(*group).agg(F.count("*").alias("n_lines"), F.max("depth").alias("max_depth"), F.count_if(F.col("parent_line").isNull()).alias("roots"),
                                      F.round(F.avg("smooth"), 4).alias("smooth_share"))


def arbitrate(blocks: DataFrame, total: str = "total_lines") -> DataFrame:
    """Blocks that stay after overlaps of conflicting sources are settled, best score first kept.

    Blocks (doc_id, block_id, source, start_line, end_line, confidence, total_lines) are swept in
    order of their start within a document, in one streaming pass over sorted partitions.
    """
    lines = F.col("end_line") - F.col("start_line") + 1
    priority = F.coalesce(*[F.when(F.col("source") == k, F.lit(v)) for k, v in PRIORITY.items()], F.lit(1))
    score = F.round(F.col("confidence") * 0.75 + priority / 5 * 0.15 + F.least(F.lit(1.0), lines / F.greatest(F.col(total), F.lit(1))) * 0.10, 6)
    scored = blocks.filter("confidence >= 0.15").withColumn("score", score).withColumn("_p", priority)
    ordered = scored.repartition("doc_id").sortWithinPartitions("doc_id", "start_line", F.desc("_p"), F.desc("end_line"), "block_id").drop("_p")
    names = ordered.columns

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kept = None, []

        def flush():
            return pa.RecordBatch.from_pylist(kept, schema=batch.schema)

        for batch in batches:
            for row in batch.to_pylist():
                if row["doc_id"] != current:
                    if kept:
                        yield flush()
                    current, kept = row["doc_id"], []
                rivals = [k for k in kept if k["end_line"] >= row["start_line"] and conflicting(k["source"], row["source"])]
                if all(row["score"] >= k["score"] for k in rivals):
                    kept = [k for k in kept if k not in rivals] + [row]
        if kept:
            yield flush()

    return ordered.mapInArrow(sweep, ordered.schema).select(*names)


def classify_blocks(blocks: DataFrame) -> DataFrame:
    """The label with the strongest evidence of a document's blocks, or mixed where the lead is small."""
    lines = F.col("end_line") - F.col("start_line") + 1
    weight = F.coalesce(*[F.when(F.col("source") == k, F.lit(v)) for k, v in WEIGHT.items()], F.lit(0.5))
    score = 0.6 * F.col("confidence") + 0.25 * F.least(F.lit(1.0), lines / F.col("total_lines")) + 0.15 * weight
    per = blocks.withColumn("s", score).groupBy("doc_id", "source").agg(F.max("s").alias("best"), F.count("*").alias("n"))
    per = per.withColumn("evidence", F.round(F.least(F.lit(1.0), F.col("best") + F.least(F.lit(0.2), 0.05 * (F.col("n") - 1))), 4))
    ranked = per.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("evidence", "source")), asc=False).alias("e"))
    lead = F.col("e")[0]["evidence"] - F.coalesce(F.get("e", F.lit(1))["evidence"], F.lit(0.0))
    return ranked.select("doc_id", F.when(lead < 0.15, "mixed").otherwise(F.col("e")[0]["source"]).alias("label"), F.col("e")[0]["evidence"].alias("evidence"))


def entropy(counts: DataFrame, key: str, label: str, n: str) -> DataFrame:
    """Shannon entropy of ``n`` over ``label``, divided by its greatest possible value."""
    total = F.sum(n).over(Window.partitionBy(key))
    p = counts.withColumn("p", F.col(n) / total)
    return p.groupBy(key).agg(F.round(F.when(F.count("*") < 2, 0.0).otherwise(-F.sum(F.col("p") * F.log2("p")) / F.log2(F.count("*").cast("double"))), 4).alias("entropy"))
