"""Whole documents from text to typed segments: parts, regions, detectors, arbitration, packaging, cleanup, checks.

A document is one row and its lines are few, so one pass of Python over Arrow batches takes it from
text to segments without any shuffle; what follows (reports, renderings, envelopes) are expressions
over the segments. Every document is independent, so the pass scales with the partitions of the scan.

Defined results
  * null and blank texts have no segments; their report has the flag EMPTY_DOCUMENT.
  * texts and lines of any length are taken whole; columns other than key and text are ignored.
  * repeated keys give their segments once for each row.
"""

from __future__ import annotations

import csv
import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.operators.resolve import ALIASES
from ledgerloom.operators.structure import PRIORITY, SEVERITY, WEIGHT, conflicting

_KEY = re.compile(r"[\w.-]+(?: [\w.-]+){0,2}(?: \([^)]{1,12}\))?")
_NOT_KV = re.compile(r"\[?\d{4}-\d{2}-\d{2}|\s*(?:at [\w.$]+\(|Caused by:)|.*\.java:\d+")
_NUMBER = re.compile(r"[\[(]?[$£€¥]?[-+]?\d[\d.,]*%?(?:ms|MB/s|GB|KB|s)?[\])]?")
_RULE = re.compile(r"(?:[-=_*~]\s*){3,}")
_LIST = re.compile(r"\s*(?:[-*•]|\d+[.)])\s+")
_GLYPH = re.compile(r"\s*(?:[│|]\s*)*[+├└]\s*[-─]+\s*")
_MARK = re.compile("[:=]")
_TAIL = re.compile(r"(?:[$£€¥]?-?\d[\d.,]*)")
_SPACED = re.compile(r"\S\s{2,}\S")
_TOKEN = re.compile(r"\S+")
_DIGIT = re.compile(r"\d")
_WORD = re.compile(r"\w")
_TWO = re.compile(r"\w{2}")
_BARS = re.compile(r"[\s│|]*")
_TAGS = re.compile(r"^(?:\[[^\]]*\]\s*)+")
_LEVELS = set(SEVERITY.split("|"))
_CONTROL = re.compile(r"[\x00-\x08\x0b-\x1f\x7f]")
# Labels that stand before their value without a mark, the longest first, and cells that stand for nothing.
_LABELS = sorted({x for names in ALIASES.values() for x in names if " " in x}, key=lambda x: (-len(x), x))
_BY_WORD: dict[str, list[str]] = {}
for _label_ in _LABELS:
    _BY_WORD.setdefault(_label_.lower().split(" ", 1)[0], []).append(_label_)
_NOTHING = {"", "-", "n/a", "na", "nan", "none", "null"}
#: The kind of segment that each source of blocks makes.
KIND = {"kv": "kv_block", "table": "table_block", "context": "context_block", "tree_structure": "hierarchy_block"}


@dataclass
class Line:
    no: int
    text: str
    bare: str = ""
    indent: int = 0
    tokens: list[str] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    marked: bool = False
    pair: tuple[str, str, str] | None = None

    def __post_init__(self):
        self.bare = self.text.strip()
        self.indent = len(self.text) - len(self.text.lstrip())
        found = list(_TOKEN.finditer(self.text))
        self.tokens, self.offsets = [m[0] for m in found], [m.start() for m in found]
        self.marked = ":" in self.bare or "=" in self.bare
        self.pair = split_pair(self.bare) if self.marked else None


def is_number(s: str) -> bool:
    try:
        float(s.replace(",", "").rstrip("%"))
        return True
    except ValueError:
        return False


# ---- parts and regions -----------------------------------------------------------------------------
def parts(lines: list[Line]) -> list[list[Line]]:
    """Lines between rules and unindented blank lines; a part of one line joins the next one."""
    out: list[list[Line]] = []
    held: list[Line] = []
    for line in [*lines, None]:
        ends = line is None or _RULE.fullmatch(line.bare) or line.text == ""
        if not ends:
            held.append(line)
        elif held and (len(held) > 1 or line is None):
            out.append(held)
            held = []
    return out


def _share(hits, total: int) -> float:
    return round(sum(map(bool, hits)) / total, 4) if total else 0.0


def _figures(line: Line) -> int:
    """How many figures end a line, after a first word."""
    n = 0
    for t in reversed(line.tokens[1:]):
        if not _TAIL.fullmatch(t):
            break
        n += 1
    return n


def shares(lines: list[Line]) -> dict[str, float]:
    """What the lines of a region have in common, each between 0 and 1."""
    full = [x for x in lines if x.bare]
    n = len(full)
    sizes = Counter(len(x.tokens) for x in full)
    modal = sizes.most_common(1)[0][0] if n else 0
    alike = [x for x in full if len(x.tokens) == modal]
    columns = list(zip(*(x.offsets for x in alike)))
    tails = [_figures(x) for x in full]
    return {
        "pipe": _share(("|" in x.bare for x in full), n), "kv": _share((x.pair for x in full), n), "delimiter": _share((x.marked for x in full), n),
        "spaced": _share((_SPACED.search(x.bare) for x in full), n), "glyph": _share((_GLYPH.match(x.text) for x in full), n),
        "numeric": _share((t >= 2 for t in tails), n), "stable": round(len(alike) / n, 4) if n else 0.0,
        "aligned": _share((max(c) - min(c) <= 2 for c in columns), len(columns)) if len(alike) > 1 else 0.0,
        "shape": round(Counter((len(x.tokens), x.marked, x.indent > 0) for x in full).most_common(1)[0][1] / n, 4) if n else 0.0,
        "indented": _share((x.indent > 0 for x in full), n), "separated": float(separator_of(full) is not None), "lines": float(n),
    }


def region(s: dict[str, float]) -> tuple[str, float]:
    """``(table, block or plain, confidence)`` of a region by the first rule that its shares meet."""
    table = round((sum(s[k] >= least for k, least in (("pipe", 0.5), ("aligned", 0.7), ("stable", 0.6))) + (s["pipe"] > 0)) / 4, 2)
    block = round(sum(s[k] >= least for k, least in (("kv", 0.35), ("delimiter", 0.4), ("shape", 0.5))) / 3, 2)
    if s["lines"] >= 2 and s["separated"] and s["kv"] < 0.35:
        return "table", 0.9
    if s["lines"] >= 3:
        if s["glyph"] >= 0.3:
            return "block", max(block, 0.6)
        if s["pipe"] >= 0.5 or s["aligned"] >= 0.7 and s["stable"] >= 0.7 and s["kv"] < 0.35:
            return "table", max(table, 0.55)
        if s["numeric"] >= 0.5 or s["stable"] >= 0.6 and s["spaced"] >= 0.5:
            return "table", max(table, 0.6)
    if s["lines"] >= 2 and (s["kv"] >= 0.35 or s["delimiter"] >= 0.4 and s["shape"] >= 0.5 or s["indented"] >= 0.5):
        return "block", block
    return "plain", 0.3


def engine_of(kind: str, confidence: float) -> str:
    """Which detectors a region goes to; a table that is hardly one is read as a block."""
    return "structure" if kind == "table" and confidence >= 0.55 else "block" if kind != "plain" else "fallback"


# ---- keys and values --------------------------------------------------------------------------------
def split_pair(text: str) -> tuple[str, str, str] | None:
    """Key, mark and value at the first colon or equals sign, if what stands before can be a key."""
    m = _MARK.search(text)
    if not m or _NOT_KV.match(text):
        return None
    key = text[:m.start()].strip()
    return (key, m[0], text[m.end():].strip()) if _KEY.fullmatch(key) else None


def spoken_pair(text: str) -> tuple[str, str, str] | None:
    """A known label and its value with only a space between them."""
    low = text.lower()
    for label in _BY_WORD.get(low.split(" ", 1)[0], ()):
        if low.startswith(label.lower() + " "):
            value = text[len(label):].strip()
            words = value.split()
            if words and len(words) <= 6 and (any(c.isdigit() for c in value) or len(words) <= 3 and all(w[0].isupper() for w in words)):
                return text[:len(label)], " ", value
    return None


def nested(value: str) -> list[dict] | None:
    """The pairs in a value, where at least 60 % of its pieces are pairs; the mark that gives most of them counts."""
    best = None
    if ":" not in value and "=" not in value:
        return None
    for mark in ";,":
        if mark not in value:
            continue
        pieces = [p.strip() for p in value.split(mark) if p.strip()]
        found = [dict(zip(("key", "delimiter", "value"), p)) for p in map(split_pair, pieces) if p and p[2]]
        if len(pieces) > 1 and len(found) >= 0.6 * len(pieces) and (best is None or len(found) > len(best)):
            best = found
    return best


def find_pairs(lines: list[Line]) -> list[dict]:
    out = []
    for x in lines:
        found, sure = x.pair, 1.0
        if not found and (found := spoken_pair(x.bare)):
            sure = 0.75
        if found:
            key, mark, value = found
            pair = {"key": key, "value": value, "delimiter": mark, "line_index": x.no, "confidence": sure if value else 0.8}
            if inner := nested(value):
                pair["nested"] = inner
            out.append(pair)
    return out


# ---- tables -----------------------------------------------------------------------------------------
def _cut(lines: list[str], mark: str):
    csv.field_size_limit(2**62)  # cells of any length; set here, as a worker may start with the default
    return csv.reader(lines, delimiter=mark)


def separator_of(lines: list[Line]) -> str | None:
    """The first of comma, tab and semicolon that cuts all of two or more lines into the same number of cells, at least two."""
    full = [x.text for x in lines if x.bare]
    for mark in (",", "\t", ";"):
        if len(full) >= 2 and all(mark in x for x in full):
            widths = {len(row) for row in _cut(full, mark)}
            if len(widths) == 1 and widths.pop() >= 2:
                return mark
    return None


def with_header(rows: list[list[str]]) -> tuple[list[str] | None, list[list[str]]]:
    """The first row as header where it has fewer numbers than the rest and no fewer words than the next."""
    if len(rows) < 2:
        return None, rows
    numbers = lambda r: sum(map(is_number, r)) / max(len(r), 1)
    words = lambda r: sum(any(c.isalpha() for c in x) for x in r) / max(len(r), 1)
    rest = sum(map(numbers, rows[1:])) / (len(rows) - 1)
    return (rows[0], rows[1:]) if numbers(rows[0]) < rest and words(rows[0]) >= words(rows[1]) else (None, rows)


def _scored(rows: list[list[str]], quality: float) -> dict | None:
    if not rows or max(map(len, rows)) - min(map(len, rows)) > 4:
        return None
    width = max(map(len, rows))
    headers, body = with_header([r + [""] * (width - len(r)) for r in rows])
    score = 0.4 * (width >= 2) + 0.3 * min(1.0, len(body) / 3) + 0.2 * (headers is not None) + 0.1 * quality
    return {"headers": headers, "rows": body, "columns": width, "confidence": round(score, 4)}


def pipe_table(lines: list[Line]) -> dict | None:
    rows = [[c.strip() for c in x.bare.strip("|").split("|")] for x in lines if "|" in x.bare and not re.fullmatch(r"[|\-+ =]+", x.bare)]
    return _scored(rows, _share(("|" in x.bare for x in lines if x.bare), len([x for x in lines if x.bare])))


def aligned_table(lines: list[Line]) -> dict | None:
    """Columns at the offsets where a token starts in at least two lines and in 40 % of them; a token belongs to the last column before it."""
    full = [x for x in lines if x.bare and not _RULE.fullmatch(x.bare)]
    starts = Counter(o for x in full for t, o in enumerate(x.offsets) if t == 0 or x.text[o - 2:o] == "  ")
    edges = sorted(o for o, n in starts.items() if n >= max(2, 0.4 * len(full)))
    if len(edges) < 2:
        return None
    rows = []
    for x in full:
        cells = [""] * len(edges)
        for token, at in zip(x.tokens, x.offsets):
            k = max((i for i, e in enumerate(edges) if e <= at), default=0)
            cells[k] = f"{cells[k]} {token}".strip()
        rows.append(cells)
    return _scored(rows, _share((all(o in edges for o in x.offsets) for x in full), len(full)))


def item_table(lines: list[Line]) -> dict | None:
    """Rows of a description and a run of numbers of one length; a line of as many words before them is the header."""
    rows, head = [], None
    for x in lines:
        if n := _figures(x):
            k = len(x.tokens) - n - 1
            rows.append([x.text[x.offsets[0]:x.offsets[k] + len(x.tokens[k])], *x.tokens[-n:]])
        elif not rows and x.bare and not any(c.isdigit() for c in x.bare):
            head = re.split(r"\s{2,}|\t", x.bare)
    if len(rows) < 2 or len({len(r) for r in rows}) != 1 or len(rows[0]) < 3:
        return None
    headed = head is not None and len(head) == len(rows[0])
    return {"headers": head if headed else None, "rows": rows, "columns": len(rows[0]), "confidence": 0.72, "headed": headed}


def find_table(lines: list[Line]) -> dict | None:
    """Separated values first; then a table of items if it is wider or has a header; else pipes or aligned columns, whichever is surer."""
    if mark := separator_of(lines):
        rows = [[c.strip() for c in r] for r in _cut([x.text for x in lines if x.bare], mark)]
        return _scored(rows, 1.0)
    pipes, aligned, items = pipe_table(lines), aligned_table(lines), item_table(lines)
    other = max((t for t in (pipes, aligned) if t), key=lambda t: t["confidence"], default=None)
    if items and (other is None or items.pop("headed") or items["columns"] > other["columns"]):
        items.pop("headed", None)
        return items
    if other and pipes and aligned and abs(pipes["confidence"] - aligned["confidence"]) < 0.15:
        return pipes  # too close: pipes are written on purpose
    return other


# ---- context and trees ------------------------------------------------------------------------------
def find_context(lines: list[Line], pairs: list[dict]) -> dict | None:
    """Each line as pair, log, telemetry or prose, their runs, the kind of at least half of them, and how pure that is."""
    at = {p["line_index"] for p in pairs}
    full = [x for x in lines if x.bare]
    if not full:
        return None
    marked = []
    for x in full:
        level = next((t for t in (t.strip("[]:").upper() for t in x.tokens) if t in _LEVELS), None)
        numeric = sum(1 for t in x.tokens if _NUMBER.fullmatch(t)) / len(x.tokens) if _DIGIT.search(x.bare) else 0.0
        kind = "kv" if x.no in at else "log" if level else "telemetry" if numeric >= 0.6 else "prose"
        marked.append({"line_index": x.no, "type": kind, "text": x.text, **({"level": level} if level else {})})
    kinds = [m["type"] for m in marked]
    runs = [i for i, k in enumerate(kinds) if i == 0 or kinds[i - 1] != k]
    top = max(("kv", "log", "telemetry", "prose"), key=lambda k: kinds.count(k))
    purity = kinds.count(top) / len(kinds)
    dominant = top if purity >= 0.5 else "mixed"
    return {"dominant": dominant, "annotated": marked, "runs": [{"type": kinds[i], "line_index": marked[i]["line_index"]} for i in runs],
            "confidence": round(0.7 * (purity if dominant != "mixed" else 0.3) + 0.3 * (1 - len(runs) / len(kinds)), 4)}


def _lead(line: Line) -> str:
    return _BARS.match(line.text)[0]


def indent_unit(lines: list[Line]) -> int:
    """The greatest common divisor of all indents, drawn bars included, at least two; four where nothing is indented."""
    found = [len(_lead(x)) for x in lines if x.bare and _lead(x)]
    return max(2, math.gcd(*found)) if found else 4


def depth_of(line: Line, unit: int) -> int:
    """Depth from the width of what leads a line; a drawn branch is one deeper than where it starts."""
    return len(_lead(line)) // unit + bool(_GLYPH.match(line.text))


def find_tree(lines: list[Line]) -> dict | None:
    """The tree of lines by depth, if it is two levels deep or more; a line's parent is the nearest one before it that is less deep."""
    full = [x for x in lines if x.bare]
    unit = indent_unit(full)
    nodes, stack = [], []
    for x in full:
        depth = depth_of(x, unit)
        while stack and stack[-1]["depth"] >= depth:
            stack.pop()
        node = {"line_index": x.no, "text": _GLYPH.sub("", x.text).strip(), "depth": depth, "parent": stack[-1]["line_index"] if stack else None, "child_count": 0}
        if stack:
            stack[-1]["child_count"] += 1
        stack.append(node)
        nodes.append(node)
    if not nodes or max(n["depth"] for n in nodes) < 2:
        return None
    steps = [b["depth"] - a["depth"] for a, b in zip(nodes, nodes[1:])]
    smooth = _share((s <= 1 for s in steps), len(steps))
    even = _share((x.indent % unit == 0 for x in full), len(full))
    inner = [n["child_count"] for n in nodes if n["child_count"]]
    spread = min(1.0, sum(inner) / len(inner) / 3) if inner else 0.0
    roots = [n["line_index"] for n in nodes if n["parent"] is None]
    return {"nodes": nodes, "roots": roots, "orphans": sum(n["depth"] > 0 for n in nodes if n["parent"] is None), "max_depth": max(n["depth"] for n in nodes),
            "confidence": round(0.35 * smooth + 0.25 * smooth + 0.25 * even + 0.15 * spread, 4)}


# ---- blocks -----------------------------------------------------------------------------------------
def _block(source: str, start: int, end: int, confidence: float, content: dict) -> dict:
    if not (0 <= start <= end and 0.0 <= confidence <= 1.0):
        raise ValueError(f"a block of {source} from {start} to {end} with confidence {confidence}")
    name = hashlib.sha256(f"{source}:{start}:{end}".encode()).hexdigest()
    return {"id": int(name, 16) % 10**12, "source": source, "start": start, "end": end, "confidence": confidence, "content": content}


def detect(lines: list[Line], engine: str) -> list[dict]:
    """The blocks that the detectors of ``engine`` find, by start and then the longest first."""
    first, last, out = lines[0].no, lines[-1].no, []
    table = find_table(lines) if engine == "structure" else None
    if table:
        out.append(_block("table", first, last, table.pop("confidence"), table))
    if engine != "structure" or table is None:
        pairs = find_pairs(lines)
        if pairs:
            mean = sum(p["confidence"] for p in pairs) / len(pairs)
            out.append(_block("kv", pairs[0]["line_index"], pairs[-1]["line_index"], round(mean, 4), {"pairs": pairs}))
        if context := find_context(lines, pairs):
            marked = context["annotated"]
            out.append(_block("context", marked[0]["line_index"], marked[-1]["line_index"], context.pop("confidence"), context))
        if engine == "block" and (tree := find_tree(lines)):
            tree.pop("confidence")  # a checked tree is sure; its measure tells how regular the indents are
            out.append(_block("tree_structure", tree["nodes"][0]["line_index"], tree["nodes"][-1]["line_index"], 1.0, tree))
    return sorted(out, key=lambda b: (b["start"], -b["end"]))


def settle(blocks: list[dict], total: int) -> list[dict]:
    """Blocks that stay when of overlapping ones of conflicting sources the better one is kept, the later one on a tie."""
    score = lambda b: round(0.75 * b["confidence"] + 0.15 * PRIORITY.get(b["source"], 1) / 5 + 0.1 * min(1.0, (b["end"] - b["start"] + 1) / max(total, 1)), 6)
    kept: list[dict] = []
    for b in {x["id"]: x for x in blocks if x["confidence"] >= 0.15}.values():
        rivals = [k for k in kept if k["end"] >= b["start"] and k["start"] <= b["end"] and conflicting(k["source"], b["source"])]
        if all(score(b) >= score(k) for k in rivals):
            kept = [k for k in kept if k not in rivals] + [b]
    return kept


def _lines_of(b: dict) -> set[int]:
    if b["source"] == "kv":
        return {p["line_index"] for p in b["content"]["pairs"]}
    return set(range(b["start"], b["end"] + 1))


def specific(blocks: list[dict]) -> list[dict]:
    """Blocks without context of which 80 % of the lines stand in others."""
    others = set().union(*(_lines_of(b) for b in blocks if b["source"] != "context"))
    keep = lambda b: b["source"] != "context" or len(own := {m["line_index"] for m in b["content"]["annotated"]}) * 0.8 > len(own & others)
    return [b for b in blocks if keep(b)]


def classify(blocks: list[dict], total: int) -> tuple[str, float, dict[str, int]]:
    """``(kind, confidence, lines of each kind)`` of a part from its blocks."""
    scores: dict[str, list[float]] = {}
    density: Counter = Counter()
    for b in blocks:
        span = (b["end"] - b["start"] + 1) / max(total, 1)
        scores.setdefault(KIND[b["source"]], []).append(0.6 * b["confidence"] + 0.25 * min(1.0, span) + 0.15 * WEIGHT.get(b["source"], 0.5))
        density[KIND[b["source"]]] += len(_lines_of(b))
    evidence = {k: min(1.0, max(v) + min(0.2, 0.05 * (len(v) - 1))) for k, v in scores.items()}
    ranked = sorted(evidence.items(), key=lambda e: (-e[1], e[0]))
    covered = max(density.values(), default=0) / max(total, 1)
    if not ranked or ranked[0][1] < 0.45 and covered < 0.5:
        return "prose", round(1 - (ranked[0][1] if ranked else 0.5), 2), dict(density)
    whole = sum(density.values())
    spread = -sum(n / whole * math.log2(n / whole) for n in density.values()) / math.log2(len(density)) if len(density) > 1 else 0.0
    kind, best = ranked[0]
    if len(ranked) > 1 and (spread >= 0.85 or best - ranked[1][1] < 0.15):
        kind = "mixed"
    only_prose = kind == "context_block" and all(m["type"] == "prose" for b in blocks if b["source"] == "context" for m in b["content"]["annotated"])
    return ("prose" if only_prose else kind), round(best * (0.5 + 0.5 * min(1.0, covered)), 2), dict(density)


# ---- segments ---------------------------------------------------------------------------------------
def _content(source: str, content: dict) -> dict:
    if source == "kv":
        return {"pairs": content["pairs"]}
    if source == "table":
        return {"headers": content["headers"], "rows": content["rows"]}
    if source == "tree_structure":
        return {"nodes": content["nodes"]}
    return {"lines": [m["text"] for m in content["annotated"]], "annotated": content["annotated"]}


def gaps(lines: list[Line], content: dict) -> list[dict]:
    """Lines of which no word of three letters stands in what was packed."""
    packed = json.dumps(content, ensure_ascii=False)
    out = []
    for x in lines:
        words = [t for t in x.tokens if len(t) >= 3] or x.tokens
        if x.bare and not any(w in packed for w in words):
            out.append({"line_index": x.no, "text": x.text})
    return out


def package(lines: list[Line], blocks: list[dict], kind: str) -> dict:
    """What a segment of ``kind`` says, with the lines that its blocks left out."""
    text = "\n".join(x.text for x in lines)
    if kind == "prose" or not blocks:
        return {"text": text}
    if kind == "mixed":
        inner = [{"type": KIND[b["source"]], "start_line": b["start"], "end_line": b["end"], "confidence": b["confidence"], "content": _content(b["source"], b["content"])} for b in blocks]
        dominant = max(inner, key=lambda b: b["end_line"] - b["start_line"])["type"]
        return {"dominant_type": dominant, "sub_blocks": inner, "gaps": gaps(lines, {"b": inner})}
    own = next(b for b in blocks if KIND[b["source"]] == kind)
    content = _content(own["source"], own["content"])
    if kind != "context_block" and (left := gaps(lines, content)):
        content["gaps"] = left
    return content


def _clean_key(key: str) -> str | None:
    bare = _TAGS.sub("", _CONTROL.sub("", key)).strip(" \t|*#>")
    return bare if bare and len(bare) <= 128 and any(c.isalnum() for c in bare) else None


def _clean_rows(rows: list[list], flags: list[str]) -> list[list]:
    kept = [[None if (c is None or c.strip().lower() in _NOTHING) else c for c in r] for r in rows if any(_WORD.search(c or "") for c in r)]
    if len(kept) < len(rows):
        flags.append("TABLE_ROWS_REMOVED")
    if kept and len({len(r) for r in kept}) > 1:
        width = Counter(len(r) for r in kept).most_common(1)[0][0]
        kept = [r[:width] if len(r) > width and not any(r[width:]) else r + [None] * (width - len(r)) for r in kept]
        flags.append("TABLE_ROWS_PADDED")
    return kept


def _calm(lines: list[str]) -> list[str]:
    """Lines without rules and control characters, with two blank ones in a row at most."""
    out: list[str] = []
    for x in lines:
        bare = _CONTROL.sub("", x)
        if not bare.strip():
            if out[-2:] != ["", ""]:
                out.append("")
        elif _WORD.search(bare):
            out.append(bare)
    return out


def clean(kind: str, content: dict) -> tuple[dict, list[str]]:
    """The content without junk keys, rule rows, drawn branches and control characters, and what was done."""
    flags: list[str] = []
    out = dict(content)
    if kind == "kv_block":
        named = [(p, _clean_key(p["key"])) for p in content["pairs"]]
        out["pairs"] = [{**p, "key": k, "value": _CONTROL.sub("", p["value"]).strip()} for p, k in named if k]
        if len(out["pairs"]) < len(named):
            flags.append("KV_KEYS_REMOVED")
    elif kind == "table_block":
        out["rows"] = _clean_rows(content["rows"], flags)
    elif kind == "hierarchy_block":
        base = min((n["depth"] for n in content["nodes"]), default=0)
        out["nodes"] = [{**n, "depth": n["depth"] - base, "text": _GLYPH.sub("", n["text"]).strip()} for n in content["nodes"]]
        if any(b["depth"] - a["depth"] > 1 for a, b in zip(out["nodes"], out["nodes"][1:])):
            flags.append("HIERARCHY_DEPTH_JUMP")
    elif kind == "mixed":
        out["sub_blocks"] = [{**b, "content": clean(b["type"], b["content"])[0]} for b in content["sub_blocks"]]
        out["gaps"] = [{**g, "text": _CONTROL.sub("", g["text"])} for g in content["gaps"] if re.search(r"\w", g["text"])]
    elif "text" in content:
        out["text"] = "\n".join(_calm(content["text"].split("\n"))).strip("\n")
    else:
        out["lines"] = _calm(content["lines"])
    return out, flags


def is_empty(kind: str, content: dict) -> bool:
    keys = {"kv_block": ["pairs", "gaps"], "table_block": ["rows", "headers"], "hierarchy_block": ["nodes"], "mixed": ["sub_blocks", "gaps"], "context_block": ["lines"]}
    return not any(content.get(k) for k in keys.get(kind, ["text", "lines"]))


def check(kind: str, content: dict, confidence: float) -> list[tuple[str, str]]:
    """``(code, severity)`` of what is wrong with a segment."""
    out: list[tuple[str, str]] = []
    if confidence < 0.40:
        out.append(("LOW_CONFIDENCE", "flag"))
    if kind == "kv_block":
        pairs, seen = content["pairs"], {}
        if not pairs:
            out.append(("EMPTY_KV", "error"))
        if pairs and sum(not p["value"] for p in pairs) >= 0.5 * len(pairs):
            out.append(("EMPTY_VALUES", "warning"))
        if any(seen.setdefault(p["key"], p["value"]) != p["value"] for p in pairs):
            out.append(("DUPLICATE_KEYS", "warning"))
        if any(re.match(r"\[|\d{4}-\d{2}-\d{2}", p["key"]) for p in pairs):
            out.append(("SUSPECT_KEY", "flag"))
    elif kind == "table_block":
        rows, headers = content["rows"], content["headers"]
        widths = Counter(len(r) for r in rows)
        if not rows:
            out.append(("EMPTY_TABLE", "error"))
        elif len(rows) < 2:
            out.append(("FEW_ROWS", "flag"))
        if headers and any(w != len(headers) for w in widths):
            out.append(("WIDTH_MISMATCH", "error"))
        if len(widths) > 1:
            out.append(("UNSTABLE_WIDTH", "warning"))
        if rows and sum(None in r for r in rows) > 0.2 * len(rows):
            out.append(("REPAIRED_CELLS", "flag"))
    elif kind == "hierarchy_block":
        nodes = content["nodes"]
        if any(n["depth"] < 0 for n in nodes):
            out.append(("NEGATIVE_DEPTH", "error"))
        if any(b["depth"] - a["depth"] > 1 for a, b in zip(nodes, nodes[1:])):
            out.append(("DEPTH_JUMP", "warning"))
        if any(not n["text"] for n in nodes):
            out.append(("EMPTY_NODE", "flag"))
    elif kind == "mixed":
        if not content["sub_blocks"] and not content["gaps"]:
            out.append(("EMPTY_MIXED", "error"))
    else:
        lines = content["text"].split("\n") if "text" in content else content["lines"]
        if sum(bool(_TWO.search(x)) for x in lines) < 0.2 * len(lines):
            out.append(("NO_MEANING", "warning"))
    return out


def accounted(kind: str, content: dict) -> int:
    """How many lines of the document a segment stands for."""
    left = {g["line_index"] for g in content.get("gaps", ())}
    if kind == "kv_block":
        return len({p["line_index"] for p in content["pairs"]} | left)
    if kind == "table_block":
        return len(content["rows"]) + (content["headers"] is not None) + len(left)
    if kind == "hierarchy_block":
        return len(content["nodes"])
    if kind == "mixed":
        return len(left.union(*(range(b["start_line"], b["end_line"] + 1) for b in content["sub_blocks"])))
    return sum(bool(x.strip()) for x in (content["text"].split("\n") if "text" in content else content["lines"]))


def segments_of(text: str | None) -> list[dict]:
    """All segments of a text."""
    lines = [Line(i, x) for i, x in enumerate((text or "").splitlines())]
    out = []
    for part in parts(lines):
        measured = shares(part)
        kind, sure = region(measured)
        engine = engine_of(kind, sure)
        blocks = specific(settle(detect(part, engine), len(part)))
        label, confidence, density = classify(blocks, len(part))
        content, flags = clean(label, package(part, blocks, label))
        if is_empty(label, content):
            continue
        body = "\n".join(x.text for x in part)
        out.append({
            "segment": len(out), "segment_id": hashlib.sha256(f"{label}:{body}".encode()).hexdigest()[:16], "type": label, "engine": engine, "confidence": confidence,
            "start_line": part[0].no, "end_line": part[-1].no, "content": json.dumps(content, ensure_ascii=False), "flags": flags,
            "anomalies": [{"code": c, "severity": s} for c, s in check(label, content, confidence)], "accounted": accounted(label, content),
            "density": json.dumps(density, sort_keys=True)})
    return out


_SHAPE = pa.schema([
    ("segment", pa.int32()), ("segment_id", pa.string()), ("type", pa.string()), ("engine", pa.string()), ("confidence", pa.float64()), ("start_line", pa.int32()),
    ("end_line", pa.int32()), ("content", pa.string()), ("flags", pa.list_(pa.string())),
    ("anomalies", pa.list_(pa.struct([("code", pa.string()), ("severity", pa.string())]))), ("accounted", pa.int32()), ("density", pa.string())])
_DDL = ("segment int, segment_id string, type string, engine string, confidence double, start_line int, end_line int, content string, flags array<string>, "
        "anomalies array<struct<code:string,severity:string>>, accounted int, density string")


def segments(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the segments of every document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = segments_of(t)
                ids += [k] * len(found)
                rows += found
            made = pa.RecordBatch.from_pylist(rows, schema=_SHAPE)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *made.columns], ["doc_id", *_SHAPE.names])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, " + _DDL)


def report(segs: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Flags, line conservation and quality of each document from its segments.

    Quality is one less 0.15 an error, 0.05 a warning and 0.10 a flag, by segments, and 0.20 a failed check.
    """
    return _judged(_sources(docs, key, text), segs.groupBy("doc_id").agg(*_counts())).select("doc_id", "segments", "lines", "accounted", "flags", "is_valid", "quality")


def _counts() -> list:
    count = lambda s: F.sum(F.size(F.filter("anomalies", lambda a: a["severity"] == s)))
    return [F.count("*").alias("segments"), F.sum("accounted").alias("accounted"), count("error").alias("errors"), count("warning").alias("warnings"), count("flag").alias("marks"),
            F.count_if(F.col("type") == "mixed").alias("mixed")]


def _sources(docs: DataFrame, key: str, text: str, *more) -> DataFrame:
    lines = F.size(F.filter(F.split(F.col(text), r"\R"), lambda x: F.trim(x) != ""))
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.when(F.col(text).isNull(), 0).otherwise(lines).alias("lines"), *more)


def _judged(whole: DataFrame, per: DataFrame) -> DataFrame:
    j = whole.join(per, "doc_id", "left").fillna(0, ["segments", "accounted", "errors", "warnings", "marks", "mixed"])
    c = F.col
    conserved = (c("lines") == 0) | c("accounted").between(0.5 * c("lines"), 1.5 * c("lines"))
    flags = F.array_compact(F.array(
        F.when(c("segments") == 0, "EMPTY_DOCUMENT"), F.when((c("segments") > 1) & (c("lines") < 3 * c("segments")), "HIGH_FRAGMENTATION"),
        F.when((c("segments") > 0) & (c("mixed") >= 0.6 * c("segments")), "EXCESSIVE_MIXED"), F.when(~conserved, "LINES_LOST")))
    failed = F.when(c("segments") == 0, 1).otherwise(0) + F.when(conserved, 0).otherwise(1)
    quality = 1 - (0.15 * c("errors") + 0.05 * c("warnings") + 0.10 * c("marks")) / F.greatest(c("segments"), F.lit(1)) - 0.20 * failed
    return j.select("*", flags.alias("flags"), ((c("errors") == 0) & (failed == 0)).alias("is_valid"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), quality)), 2).alias("quality"))


# ---- renderings -------------------------------------------------------------------------------------
def _label(content: dict) -> str | None:
    """A line that was left out and reads like a heading."""
    for g in content.get("gaps", ()):
        t = g["text"].strip()
        if t and (t.endswith(":") or len(t) < 60) and any(c.isalpha() for c in t):
            return t
    return None


def _pairs_text(pairs: list[dict], lead: str = "") -> list[str]:
    out = []
    for p in pairs:
        out.append(f"{lead}{p['key']}: {p['value']}".rstrip())
        out += _pairs_text(p.get("nested") or [], lead + "  ")
    return out


def _told(inner: list[dict]) -> list[dict]:
    """The sub-blocks that a text tells: the context alone if there is one, as it has all lines in order."""
    return [b for b in inner if b["type"] == "context_block"] or inner


def human(kind: str, content: dict) -> str:
    """A segment as text for people."""
    if kind == "kv_block":
        lines = _pairs_text(content["pairs"])
    elif kind == "table_block":
        rows = [r for r in [content["headers"], *content["rows"]] if r]
        cells = [["" if c is None else str(c) for c in r] for r in rows]
        widths = [max(len(r[i]) for r in cells if i < len(r)) for i in range(max(map(len, cells), default=0))]
        lines = ["  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in cells]
        if content["headers"]:
            lines.insert(1, "  ".join("-" * w for w in widths))
    elif kind == "hierarchy_block":
        lines = ["  " * n["depth"] + n["text"] for n in content["nodes"]]
    elif kind == "mixed":
        lines = [x for b in _told(content["sub_blocks"]) for x in human(b["type"], b["content"]).split("\n")]
    else:
        lines = content["text"].split("\n") if "text" in content else [x for x in content["lines"] if x.strip()]
    label = _label(content)
    return "\n".join([*([label] if label and label not in lines else []), *lines])


def machine(kind: str, content: dict) -> dict:
    """A segment as one record for analysis: table rows by header, all else as it is."""
    if kind == "table_block":
        names = content["headers"] or [f"col_{i}" for i in range(max(map(len, content["rows"]), default=0))]
        return {"columns": names, "rows": [dict(zip(names, r)) for r in content["rows"]]}
    if kind == "mixed":
        return {"dominant_type": content["dominant_type"], "sub_blocks": [{"type": b["type"], **machine(b["type"], b["content"])} for b in content["sub_blocks"]], "gaps": content["gaps"]}
    return content


def ai(kind: str, content: dict) -> str:
    """A segment between tags that name its kind, as short text."""
    if kind == "table_block":
        head = " | ".join(content["headers"] or [])
        body = "\n".join(" | ".join("" if c is None else c for c in r) for r in content["rows"])
        text = f"{head}\n{body}".strip("\n")
    elif kind == "mixed":
        text = "\n".join(ai(b["type"], b["content"]) for b in _told(content["sub_blocks"]))
    else:
        text = human(kind, {k: v for k, v in content.items() if k != "gaps"})
    tag = kind.removesuffix("_block")
    return f"<{tag}>\n{text}\n</{tag}>"


def rendered(segs: DataFrame) -> DataFrame:
    """``doc_id, segment`` and the segment as ``human`` and ``ai`` text and as a ``machine`` record; invalid ones carry their codes in the tag's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for kind, content, wrong in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                c = json.loads(content)
                bad = [a["code"] for a in wrong if a["severity"] == "error"]
                made.append((human(kind, c), ai(kind, c) + (f"\n[invalid: {', '.join(bad)}]" if bad else ""), json.dumps(machine(kind, c), ensure_ascii=False)))
            columns = list(zip(*made)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(x, pa.string()) for x in columns)],
                                             ["doc_id", "segment", "type", "human", "ai", "machine"])

    return segs.select("doc_id", "segment", "type", "content", "anomalies").mapInArrow(run, "doc_id long, segment int, type string, human string, ai string, machine string")


def documents_text(parts_: DataFrame, column: str = "human") -> DataFrame:
    """``doc_id, text``: the rendered segments of each document in order, a rule between different kinds of them."""
    ordered = F.array_sort(F.collect_list(F.struct("segment", "type", column)))
    per = parts_.groupBy("doc_id").agg(ordered.alias("s"))  # the segments of one document
    joined = F.transform("s", lambda x, i: F.when((i > 0) & (F.get("s", i - 1)["type"] != x["type"]), F.concat(F.lit("---\n\n"), x[column])).otherwise(x[column]))
    return per.select("doc_id", F.array_join(joined, "\n\n").alias("text"))


def envelopes(segs: DataFrame, reports: DataFrame | None, docs: DataFrame, at: str, key: str = "doc_id", text: str = "text", version: str = "1.0") -> DataFrame:
    """``doc_id, source_id, version, event_type, envelope_ts, payload`` in the form of the envelope table; one for each document with segments.

    Without ``reports`` the report comes from the aggregate that gathers the segments, so the texts are read once; then a repeated key has an envelope for each of its rows.
    """
    one = F.struct("segment", "segment_id", "type", F.col("content"), F.struct("confidence", "start_line", "end_line", "flags").alias("metadata"))
    gathered = F.array_sort(F.collect_list(one)).alias("s")
    source = (F.substring(F.sha2(F.col(text), 256), 1, 16).alias("source_id"), F.date_format(F.col(at), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("envelope_ts"))
    if reports is None:
        whole = _judged(_sources(docs, key, text, *source), segs.groupBy("doc_id").agg(gathered, *_counts())).filter("s is not null")
    else:
        per = segs.groupBy("doc_id").agg(gathered)
        whole = per.join(docs.select(F.col(key).cast("long").alias("doc_id"), *source), "doc_id").join(reports, "doc_id")
    payload = F.to_json(F.struct(F.lit("document").alias("region_type"), F.struct(F.col("s").alias("segments")).alias("machine_readable"), F.struct("quality", "is_valid", "flags").alias("validation")))
    return whole.select("doc_id", "source_id", F.lit(version).alias("version"), F.lit("document.processed").alias("event_type"), "envelope_ts", payload.alias("payload"))


def envelope_faults(made: DataFrame) -> DataFrame:
    """The fault of each envelope that lacks a member or whose payload is no JSON; valid ones give no row."""
    c = F.col
    fault = (F.when(c("version").isNull(), "version").when(c("event_type").isNull(), "event_type").when(c("source_id").isNull() | (c("source_id") == ""), "source_id")
             .when(c("envelope_ts").isNull(), "envelope_ts").when(c("payload").isNull() | F.expr("try_parse_json(payload)").isNull(), "payload"))
    return made.withColumn("fault", fault).filter("fault is not null")
