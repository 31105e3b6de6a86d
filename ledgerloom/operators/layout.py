"""Reading order of a page from the boxes of its words: lines, a gap between two columns, the band of a table.

Words (page_id, x0, x1, top, text) are sorted by page in the shuffle and read page by page, so a page
is all that is held at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Words whose tops differ by more stand in different lines; a gap of at least this width may part columns.
LINE_STEP, COLUMN_GAP, BUCKET = 3.0, 40.0, 10.0
# Words of a table's header, and the labels that end it.
HEADER_WORDS = {"item", "description", "qty", "quantity", "price", "unit", "amount", "total", "rate", "no", "code"}
TOTAL_LINE = re.compile(r"(?i)^\s*(?:sub\s?total|total|amount due|balance)\b")


def group_lines(words: list[dict]) -> list[list[dict]]:
    """Words of one height, each line measured from its first word, from left to right."""
    lines: list[list[dict]] = []
    for w in sorted(words, key=lambda w: (w["top"], w["x0"])):
        if lines and w["top"] - lines[-1][0]["top"] <= LINE_STEP:
            lines[-1].append(w)
        else:
            lines.append([w])
    return [sorted(line, key=lambda w: w["x0"]) for line in lines]


def line_text(line: list[dict]) -> str:
    return " ".join(w["text"] for w in line)


def table_band(lines: list[list[dict]]) -> tuple[float, float] | None:
    """From a header of at least two column words, half of the line and no figures, to the line of totals below it."""
    top = None
    for line in lines:
        words = [re.sub(r"\W", "", w["text"]).lower() for w in line]
        known = sum(w in HEADER_WORDS for w in words)
        if top is None and known >= 2 and known * 2 >= len(words) and not re.search(r"[\d$£€¥]", line_text(line)):
            top = line[0]["top"]
        elif top is not None and TOTAL_LINE.match(line_text(line)):
            return top, line[0]["top"]
    return None if top is None else (top, lines[-1][0]["top"])


def column_split(lines: list[list[dict]], width: float, band: tuple[float, float] | None) -> float | None:
    """Where the page parts: the place in its middle 60 % where most lines have their first wide gap; at least two lines and three words on each side."""
    votes: Counter = Counter()
    free = [x for x in lines if band is None or not band[0] <= x[0]["top"] <= band[1]]
    for line in free:
        for a, b in zip(line, line[1:]):
            middle = (a["x1"] + b["x0"]) / 2
            if b["x0"] - a["x1"] >= COLUMN_GAP and 0.2 * width <= middle <= 0.8 * width:
                votes[int(middle // BUCKET)] += 1
                break
    if not votes:
        return None
    bucket, n = max(votes.items(), key=lambda v: (v[1], -v[0]))
    at = bucket * BUCKET + BUCKET / 2
    left = sum(w["x0"] < at for line in free for w in line)
    right = sum(w["x0"] >= at for line in free for w in line)
    return at if n >= 2 and min(left, right) >= 3 else None


def page_text(words: list[dict]) -> str:
    """The words in reading order: above a table, its band across the page, then below; in two columns the left one first."""
    lines = group_lines(words)
    band = table_band(lines)
    at = column_split(lines, max((w["x1"] for w in words), default=0.0), band)
    if at is None:
        return "\n".join(map(line_text, lines))
    inside = lambda x: band is not None and band[0] <= x[0]["top"] <= band[1]
    out: list[str] = []

    def columns(part: list[list[dict]]) -> None:
        for side in (lambda w: w["x0"] < at, lambda w: w["x0"] >= at):
            out.extend(line_text(own) for line in part if (own := [w for w in line if side(w)]))

    columns([x for x in lines if not inside(x) and (band is None or x[0]["top"] < band[0])])
    out += [line_text(x) for x in lines if inside(x)]
    columns([x for x in lines if band is not None and x[0]["top"] > band[1]])
    return "\n".join(out)


def reading_order(words: DataFrame) -> DataFrame:
    """``page_id, text`` of every page of ``words``."""
    ordered = words.select("page_id", "x0", "x1", "top", "text").repartition("page_id").sortWithinPartitions("page_id", "top", "x0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        done = lambda: pa.RecordBatch.from_pydict({"page_id": pa.array([current], pa.int64()), "text": pa.array([page_text(held)])})
        for batch in batches:
            for row in batch.to_pylist():
                if row["page_id"] != current:
                    if held:
                        yield done()
                    current, held = row["page_id"], []
                held.append(row)
        if held:
            yield done()

    return ordered.mapInArrow(run, "page_id long, text string")
