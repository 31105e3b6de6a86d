"""Problem 5: deeply nested records as related flat tables.

Each record is scanned once, as a stream of tokens without recursion, into path-value-ordinal
triples. Paths are grouped by their nearest repeated ancestor: each group is one table, each array
element one row of it, and each row carries the JSON pointer of its own element and of the parent
element. Pivoting the members of a group gives that table's columns.

Defined results
  * null, blank, broken or incomplete JSON, NaN and Infinity: no rows.
  * a payload, or a member named ``content``, that is a string holding JSON is read as that JSON,
    without a step in the path; any other string stays a string.
  * a key repeated within an object: the last one counts.
  * nesting of any depth is read; unpaired surrogates become replacement characters.
  * an id that is null or repeated stays as it is; columns beside those named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_space = re.compile(r"[ \t\n\r]*").match
_number = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?").match
_WORDS = {"t": ("true", "boolean"), "f": ("false", "boolean"), "n": ("null", "null")}
#: Members whose string value is read as JSON where it is JSON.
READ_AS_JSON = "content"


def _step(key: str) -> str:
    return "/" + key.replace("~", "~0").replace("/", "~1")


def _scan(s: str, pointer: str, member: str, owner: tuple, name: str | None, out: list) -> None:
    """Appends the triples of the JSON text ``s``; ValueError where it isn't one complete value.

    A triple is [table, node_path, parent_path, ordinal, member, value, kind]; ``owner`` is the
    nearest array element: (node_path, parent_path, table, ordinal).
    """
    n, i, stack = len(s), _space(s, 0).end(), []
    slot = None  # the row of the element whose value comes next

    def leaf(value, kind):
        if slot is not None:
            slot[5], slot[6] = value, kind
        else:
            out.append([owner[2], owner[0], owner[1], owner[3], member, value, kind])

    while True:
        c = s[i] if i < n else ""
        opened = False
        if c == '"':
            value, i = scanstring(s, i + 1, True)
            if name != READ_AS_JSON or not _nested(value, pointer, member, owner, out):
                leaf(value, "string")
        elif c == "{" or c == "[":
            if slot is not None:
                slot[6] = "object" if c == "{" else "array"
            i = _space(s, i + 1).end()
            if s[i:i + 1] == ("}" if c == "{" else "]"):
                i += 1
            else:
                stack.append([c, pointer, member, owner, -1, {} if c == "{" else None, None])
                opened = True
        elif c in _WORDS and s.startswith(_WORDS[c][0], i):
            word, kind = _WORDS[c]
            leaf(None if kind == "null" else word, kind)
            i += len(word)
        elif (found := _number(s, i)) is not None:
            leaf(found.group(), "number")
            i = found.end()
        else:
            raise ValueError(i)
        while not opened:
            i = _space(s, i).end()
            if not stack:
                if i != n:
                    raise ValueError(i)
                return
            frame = stack[-1]
            if frame[6] is not None:
                frame[5][frame[6]][1] = len(out)
            c = s[i:i + 1]
            if c == ",":
                i = _space(s, i + 1).end()
                break
            if c != ("}" if frame[0] == "{" else "]"):
                raise ValueError(i)
            stack.pop()
            i += 1
        frame = stack[-1]
        if frame[0] == "[":
            frame[4] += 1
            above = frame[3]
            pointer = f"{frame[1]}/{frame[4]}"
            owner = (pointer, above[0], above[2] + frame[2] + "/*", frame[4])
            member, name = "", None
            slot = [owner[2], pointer, above[0], frame[4], "", None, None]
            out.append(slot)
        else:
            if s[i:i + 1] != '"':
                raise ValueError(i)
            name, i = scanstring(s, i + 1, True)
            i = _space(s, i).end()
            if s[i:i + 1] != ":":
                raise ValueError(i)
            i = _space(s, i + 1).end()
            if name in frame[5]:
                start, end = frame[5][name]
                out[start:end] = [None] * (end - start)
            frame[5][name], frame[6] = [len(out), len(out)], name
            step = _step(name)
            pointer, member, owner, slot = frame[1] + step, frame[2] + step, frame[3], None


def _nested(text: str, pointer: str, member: str, owner: tuple, out: list) -> bool:
    """Reads a string as the JSON it holds; false, with nothing added, where it holds none."""
    start = len(out)
    try:
        _scan(text, pointer, member, owner, READ_AS_JSON, out)
        return True
    except (ValueError, RecursionError):
        del out[start:]
        return False


def triples_of(text: str | None) -> list[list]:
    """The triples of one record, an empty list where it is null or not complete JSON."""
    out: list = []
    if text is None or not _nested(text, "", "", ("", None, "", 0), out):
        return []
    return [row for row in out if row is not None]


def _clean(text):
    return text.encode("utf-8", "replace").decode() if isinstance(text, str) and not text.isascii() else text


def _rows(elements_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list = []
            columns: list[list] = [[] for _ in range(7)]

            def flush():
                arrays = [pa.array(ids, pa.int64())]
                if elements_only:
                    arrays += [pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())]
                    return pa.RecordBatch.from_arrays(arrays, ["env_id", "node_path", "parent_path"])
                kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                arrays += [pa.array(c, k) for c, k in zip(columns, kinds)]
                return pa.RecordBatch.from_arrays(arrays, ["env_id", "table", "node_path", "parent_path", "ordinal", "member", "value", "kind"])

            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for row in triples_of(text.as_py()):
                    if elements_only and row[4] or elements_only and not row[1]:
                        continue
                    ids.append(key)
                    for k, value in enumerate(row):
                        columns[k].append(_clean(value))
                if len(ids) > 50_000:
                    yield flush()
                    ids, columns = [], [[] for _ in range(7)]
            if ids:
                yield flush()

    return run


def triples(records: DataFrame, key: str = "env_id", payload: str = "payload") -> DataFrame:
    """All path-value-ordinal triples of ``records``; no shuffle."""
    schema = "env_id long, `table` string, node_path string, parent_path string, ordinal long, member string, value string, kind string"
    return records.select(F.col(key).alias("env_id"), F.col(payload).alias("payload")).mapInArrow(_rows(False), schema)


def elements(records: DataFrame, key: str = "env_id", payload: str = "payload") -> DataFrame:
    """``env_id, node_path, parent_path`` of every array element at any depth; no shuffle."""
    return records.select(F.col(key).alias("env_id"), F.col(payload).alias("payload")).mapInArrow(
        _rows(True), "env_id long, node_path string, parent_path string")


def flat_table(rows: DataFrame, name: str, members: list[str] | None = None) -> DataFrame:
    """Pivots one group of ``triples`` into its table: a row an element, a column a member.

    ``members`` are member paths such as ``/key``; where they aren't given they are read from the
    data once (as many as the table has columns). The value of a plain element is ``value``.
    """
    own = rows.filter(F.col("table") == name)
    if members is None:
        members = sorted(r[0] for r in own.select("member").filter("member <> ''").distinct().collect())
    picked = [F.max(F.when(F.col("member") == m, F.col("value"))).alias("value_member" if m == "/value" else m.strip("/").replace("/", "_")) for m in members]
    return own.groupBy("env_id", "node_path", "parent_path", "ordinal").agg(
        F.max(F.when(F.col("member") == "", F.col("value"))).alias("value"), *picked)


def nodes(rows: DataFrame) -> DataFrame:
    """Every row of every table with its members as a map, for tables whose columns aren't known."""
    return rows.groupBy("env_id", "table", "node_path", "parent_path", "ordinal").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("member", "value")))).alias("members"))
