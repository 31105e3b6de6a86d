"""Declarative rules compiled to columns: one result row for each record and rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Named formats.
FORMATS = {
    "number": r"^-?\d+(\.\d+)?$", "integer": r"^-?\d+$", "date_iso": r"^\d{4}-\d{2}-\d{2}$",
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "currency_code": r"^[A-Z]{3}$", "non_empty": r"\S",
}
_PREDICATES: dict = {}


def register_predicate(name: str, build) -> None:
    """Adds a custom predicate: ``build(rule)`` gives a boolean column."""
    _PREDICATES[name] = build


def to_number(value: Column) -> Column:
    return F.regexp_replace(value.cast("string"), r"[,\s$£€¥]", "").try_cast("double")


def _operand(ref) -> Column:
    return F.lit(ref["const"]) if isinstance(ref, dict) else F.col(ref)


def _compare(op: str, a: Column, b: Column) -> Column:
    table = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}
    return table[op]


def _compute(rule: dict) -> Column:
    """An aggregate over scalar fields and ``table.column`` arrays; cells that aren't numbers are left out."""
    parts = [F.transform(F.col(ref), lambda x: to_number(x)) if "." in ref else F.array(to_number(F.col(ref))) for ref in rule["inputs"]]
    values = F.array_compact(reduce(lambda x, y: F.concat(x, y), parts))
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    result = {"sum": total, "average": total / F.nullif(F.size(values), F.lit(0)), "count": F.size(values).cast("double"),
              "min": F.array_min(values), "max": F.array_max(values)}[rule["operation"]]
    if "equals" in rule:
        return F.abs(result - to_number(_operand(rule["equals"]))) <= rule.get("tolerance", 0.01) + 1e-9
    return _compare(rule["op"], result, to_number(_operand(rule["target"])))


def predicate(rule: dict) -> Column:
    """The boolean column of one rule; null counts as failed."""
    kind = rule["type"]
    if kind == "exists":
        field = F.col(rule["field"])
        return field.isNotNull() & (F.trim(field.cast("string")) != "") if rule.get("non_empty", True) else field.isNotNull()
    if kind == "match":
        return F.col(rule["field"]).cast("string").rlike(FORMATS[rule["format"]] if "format" in rule else rule["pattern"])
    if kind == "compare":
        a, b = _operand(rule["left"]), _operand(rule["right"])
        x, y = to_number(a), to_number(b)
        text = _compare(rule["op"], a.cast("string"), b.cast("string"))
        return F.when(x.isNotNull() & y.isNotNull(), _compare(rule["op"], x, y)).otherwise(text)
    if kind == "compute":
        return _compute(rule)
    if kind == "contains":
        return F.col(rule["field"]).isin(rule["allowed"])
    if kind == "custom" and rule["predicate"] in _PREDICATES:
        return _PREDICATES[rule["predicate"]](rule)
    return F.lit(False)


def evaluate(views: DataFrame, rules: list[dict], key: str = "id") -> DataFrame:
    """``id, rule_id, rule_type, status``; SKIPPED where a required field is null, FAIL where the rule can't hold."""
    rows = []
    for rule in rules:
        needs = [F.col(r).isNull() for r in rule.get("requires", [])]
        missing = reduce(lambda x, y: x | y, needs) if needs else F.lit(False)
        status = F.when(missing, "SKIPPED").when(F.coalesce(predicate(rule), F.lit(False)), "PASS").otherwise("FAIL")
        rows.append(F.struct(F.lit(rule["id"]).alias("rule_id"), F.lit(rule["type"]).alias("rule_type"), status.alias("status")))
    return views.select(F.col(key).alias("id"), F.inline(F.array(*rows)))


def summarize(results: DataFrame) -> DataFrame:
    """Counts of each status by record."""
    count = lambda s: F.count_if(F.col("status") == s)
    return results.groupBy("id").agg(count("PASS").alias("passed"), count("FAIL").alias("failed"), count("SKIPPED").alias("skipped"))
