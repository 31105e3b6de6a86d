"""The view of a document: its fields from pairs, header rows, tables and headings, its line items and what is in doubt.

Built on the typed segments of one document at a time, in the same pass over Arrow batches, so no
shuffle is needed. Each field is looked for in the order pairs, header rows, tables, headings; the
first place that has it counts, and all its different values there are kept as rivals.

Defined results: null and blank texts have no fields; of equal values the first line counts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.operators.engine import segments_of, split_pair, spoken_pair
from ledgerloom.operators.resolve import ALIASES

_FIELD = {a.lower(): (f, n) for f, names in ALIASES.items() for n, a in enumerate(names)}
_MONEY = re.compile(r"[-(]?[$£€¥]?\s?\d[\d.,]*\d\)?|\d")
# Kinds of documents by their headings, and legal forms that end a firm's name.
INSTRUMENTS = ["credit note", "debit note", "purchase order", "payment advice", "remittance advice", "tax invoice", "commercial invoice", "proforma invoice", "invoice", "receipt", "statement",
               "quotation", "rechnung", "facture", "gutschrift"]
FORMS = {"ltd", "limited", "llc", "inc", "corp", "gmbh", "ag", "sa", "bv", "nv", "plc", "pty", "sarl", "srl", "co"}
#: Columns of line items and their headings.
ITEM_COLUMNS = {"description": ["description", "item", "product", "article", "goods"], "quantity": ["qty", "quantity", "units", "menge"],
                "unit_price": ["price", "unit price", "rate", "unit cost"], "amount": ["amount", "total", "line total", "betrag", "montant"]}


def plain(label: str) -> str:
    """A label without colon, unit in brackets and rate, in lower case."""
    s = re.sub(r"\s*\([^)]*\)|\s*@?\s*\d+(\.\d+)?\s*%", "", label.strip().rstrip(":").lower())
    return " ".join(s.split())


def figure(text: str | None) -> float | None:
    """An amount with either mark for decimals; in brackets or with a minus sign it is negative."""
    m = _MONEY.search(text or "")
    if not m:
        return None
    digits = re.sub(r"[^\d.,]", "", m[0])
    whole, part = (digits[:-3], digits[-2:]) if digits[-3:-2] in (".", ",") else (digits, "")
    value = float(re.sub(r"\D", "", whole) or 0) + (int(part) / 100 if part else 0.0)
    return -value if m[0][0] in "-(" else value


def _fits(field: str, value: str) -> bool:
    if not value.strip():
        return False
    if field in ("total", "subtotal", "tax"):
        return figure(value) is not None
    if field == "date":
        return bool(re.search(r"\d", value))
    return True


def _from_pairs(pairs: list[tuple[str, str]], found: dict) -> None:
    best: dict[str, tuple[int, list[str]]] = {}
    for label, value in pairs:
        field, rank = _FIELD.get(plain(label), (None, 0))
        if field is None:  # the last two words of a longer label, then the last
            words = plain(label).split()
            field, rank = next((_FIELD[t] for t in (" ".join(words[-2:]), words[-1] if words else "") if len(words) > 1 and t in _FIELD), (None, 0))
            rank += 1000
        if field and _fits(field, value):
            if field not in best or rank < best[field][0]:
                best[field] = (rank, [value])
            elif rank == best[field][0] and value not in best[field][1]:
                best[field][1].append(value)
    for field, (_, values) in best.items():
        found.setdefault(field, (values, "pairs"))


def _from_header_rows(lines: list[str], found: dict) -> None:
    """A line of labels over a line of as many values."""
    for a, b in zip(lines, lines[1:]):
        heads, values = [x.strip() for x in a.split(",")], [x.strip() for x in b.split(",")]
        if len(heads) > 1 and len(heads) == len(values):
            for h, v in zip(heads, values):
                field = _FIELD.get(plain(h), (None,))[0]
                if field and _fits(field, v):
                    found.setdefault(field, ([v], "header_row"))


def _from_tables(tables: list[dict], found: dict) -> None:
    for t in tables:
        for i, h in enumerate(t["headers"] or []):
            field = _FIELD.get(plain(h or ""), (None,))[0]
            cell = next((r[i] for r in t["rows"] if i < len(r) and r[i]), None)
            if field and cell and _fits(field, cell):
                found.setdefault(field, ([cell], "table"))


def entity(line: str) -> str | None:
    """A firm's name from a prominent line: without the kind of document, up to the legal form; two words or a legal form make one."""
    s = line
    for kind in INSTRUMENTS:
        s = re.sub(rf"(?i)\b{kind}\b", " ", s)
    words = s.replace("|", " ").split()
    end = next((i for i, w in enumerate(words) if re.sub(r"\W", "", w).lower() in FORMS), None)
    words = words[:end + 1] if end is not None else words
    return " ".join(words).strip(" ,-/") if (end is not None or len(words) >= 2) and any(c.isalpha() for w in words for c in w) else None


def _from_headings(lines: list[str], found: dict) -> None:
    for x in lines[:12]:
        low = x.lower()
        kind = next((k for k in INSTRUMENTS if re.search(rf"\b{k}\b", low)), None)
        if kind and len(x.split()) <= 6 and not split_pair(x):
            found.setdefault("document_type", ([kind], "heading"))
            break
    if "vendor" not in found:
        for x in lines[:3]:
            if not split_pair(x) and not spoken_pair(x) and not any(c.isdigit() for c in x) and (name := entity(x)):
                found["vendor"] = ([name], "heading")
                break
    for i, x in enumerate(lines):  # a label alone, its value in the next line
        field = _FIELD.get(plain(x), (None,))[0]
        if field and field not in found and x.strip().endswith(":") and i + 1 < len(lines) and not split_pair(lines[i + 1]) and _fits(field, lines[i + 1]):
            found[field] = ([lines[i + 1]], "heading")


def items_of(tables: list[dict]) -> list[dict]:
    """Line items of the first table that has a description and an amount, by its headings or by its columns."""
    for t in tables:
        heads = [plain(h or "") for h in t["headers"] or []]
        at = {c: next((i for i, h in enumerate(heads) if h in names), None) for c, names in ITEM_COLUMNS.items()}
        if at["description"] is None or at["amount"] is None:
            widths = {len(r) for r in t["rows"]}
            if heads or widths != {4}:
                continue
            at = {"description": 0, "quantity": 1, "unit_price": 2, "amount": 3}
        cell = lambda r, c: r[at[c]] if at[c] is not None and at[c] < len(r) else None  # noqa: E731, B023
        rows = [{"description": cell(r, "description"), **{c: figure(cell(r, c)) for c in ("quantity", "unit_price", "amount")}} for r in t["rows"]]
        rows = [r for r in rows if r["description"] and r["amount"] is not None]
        if rows:
            return rows
    return []


def view_of(text: str | None) -> tuple[dict, list[dict]]:
    """``(fields, items)`` of a text; a field has its different values and where they stood."""
    pairs: list[tuple[str, str]] = []
    tables: list[dict] = []

    def walk(kind: str, content: dict) -> None:
        if kind == "kv_block":
            pairs.extend((p["key"], p["value"]) for p in content["pairs"])
        elif kind == "table_block":
            tables.append(content)
        elif kind == "mixed":
            for b in content["sub_blocks"]:
                walk(b["type"], b["content"])

    for s in segments_of(text):
        walk(s["type"], json.loads(s["content"]))
    lines = [x.strip() for x in (text or "").splitlines() if x.strip()]
    numbered = [m.groups() for x in lines if (m := re.fullmatch(r"(.*?\S)((?:\s+[$£€¥]?-?\d[\d.,]*){3})", x))]
    if numbered:
        tables.append({"headers": None, "rows": [[a, *b.split()] for a, b in numbered]})
    pairs += [(p[0], p[2]) for x in lines if (p := split_pair(x) or spoken_pair(x))]
    found: dict = {}
    _from_pairs(pairs, found)
    _from_header_rows(lines, found)
    _from_tables(tables, found)
    _from_headings(lines, found)
    return found, items_of(tables)


def verdict(fields: dict, items: list[dict]) -> str:
    """Whether the stated total follows: from subtotal (or items) and tax; DERIVED where it isn't stated but can be made."""
    stated = {f: figure(fields[f][0][0]) for f in ("subtotal", "tax", "total") if f in fields}
    base = stated.get("subtotal", sum(i["amount"] for i in items) if items else None)
    if base is None:
        return "UNVERIFIABLE"
    made = base + (stated.get("tax") or 0.0)
    if "total" not in stated:
        return "DERIVED"
    return "CONFIRM" if abs(stated["total"] - made) < 0.02 else "CONFLICT"


def document_views(docs: DataFrame, key: str = "doc_key", text: str = "text") -> DataFrame:
    """``doc_id, fields, items, status, verdict``: fields as ``array<struct<field,value,source,n_values>>``; MULTIPLE where number, date or total have rivals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, items = view_of(t)
                many = any(len(found[f][0]) > 1 for f in ("invoice_number", "date", "total") if f in found)
                rows.append({"doc_id": k, "fields": [{"field": f, "value": v[0], "source": s, "n_values": len(v)} for f, (v, s) in sorted(found.items())], "items": items,
                             "status": "MULTIPLE" if many else "SINGLE", "verdict": verdict(found, items)})
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    shape = pa.schema([("doc_id", pa.int64()), ("fields", pa.list_(pa.struct([("field", pa.string()), ("value", pa.string()), ("source", pa.string()), ("n_values", pa.int32())]))),
                       ("items", pa.list_(pa.struct([("description", pa.string()), ("quantity", pa.float64()), ("unit_price", pa.float64()), ("amount", pa.float64())]))),
                       ("status", pa.string()), ("verdict", pa.string())])
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, fields array<struct<field:string,value:string,source:string,n_values:int>>, "
             "items array<struct<description:string,quantity:double,unit_price:double,amount:double>>, status string, verdict string")
