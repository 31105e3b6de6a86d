"""Reading files: format detection, text extraction and typed segments.

Binary scans go through ``binaryFile``; a file is read by one task. Formats that need libraries which
aren't part of the platform (PDF, images) give an unsuccessful result with a warning. The scan
leaves out empty files.
"""

from __future__ import annotations

import csv
import html
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

# File name endings.
ENDINGS = {"txt": "txt", "log": "txt", "md": "txt", "csv": "csv", "tsv": "csv", "htm": "html", "html": "html", "json": "json", "pdf": "pdf", "docx": "docx",
           "xlsx": "xlsx", "png": "image", "jpg": "image", "jpeg": "image"}
_NOISE = {"script", "style", "nav", "aside", "header", "footer", "noscript", "form", "button"}
_BLOCKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "tr", "table", "title"}
RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("success", T.BooleanType()), T.StructField("encoding", T.StringType()),
                       T.StructField("warnings", T.ArrayType(T.StringType()))])


@F.pandas_udf(T.StringType())
def _office_format(contents: pd.Series) -> pd.Series:
    """docx or xlsx by the names of all entries of a zip file, else null."""

    def find(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        try:
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                names = z.namelist()
        except Exception:  # as damaged files raise many kinds
            return None
        return next((f for f, folder in (("docx", "word/"), ("xlsx", "xl/")) if any(n.startswith(folder) for n in names)), None)

    return pd.Series([find(x) for x in contents], dtype="object")


def detect_format(content: Column, path: Column) -> Column:
    """By leading bytes and a zip file's entries, then a look for HTML, then the ending of the name."""
    head = F.hex(F.substring(content, 1, 4))
    sniff = F.lower(F.decode(F.substring(content, 1, 200), "ISO-8859-1"))
    office = _office_format(F.when(head == "504B0304", content))
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    named = F.create_map(*[F.lit(x) for pair in ENDINGS.items() for x in pair])
    return (
        F.when(head == "25504446", "pdf").when(head.startswith("89504E47") | head.startswith("FFD8FF"), "image")
        .when((head == "504B0304") & office.isNotNull(), office)
        .when((head == "504B0304") & ending.isin("docx", "xlsx"), ending)
        .when(F.ltrim(sniff).startswith("<html") | F.substring(sniff, 1, 80).contains("<!doctype html"), "html")
        .otherwise(F.coalesce(F.try_element_at(named, ending), F.lit("unknown"))))


def decode(raw: bytes) -> tuple[str, str]:
    """Text and encoding by the first of a chain that fits; NUL characters are dropped."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        chain = ["utf-16", "latin-1"]
    elif raw and raw[:200].count(0) * 3 >= len(raw[:200]):
        chain = ["utf-16-le" if raw[1:2] == b"\0" else "utf-16-be", "latin-1"]
    else:
        chain = ["utf-8-sig", "latin-1"]
    for name in chain:
        try:
            return raw.decode(name).replace("\0", ""), name
        except UnicodeDecodeError:
            continue
    return "", "none"


def csv_text(text: str) -> tuple[str, list[str]]:
    """Rows with stripped cells under one delimiter, blank rows left out, ragged ones named."""
    try:
        dialect = csv.Sniffer().sniff(text[:4096], ",;\t|")
        delimiter, notes = dialect.delimiter, []
    except csv.Error:
        delimiter, notes = ",", ["delimiter not found, comma taken"]
    rows = [[c.strip() for c in row] for row in csv.reader(io.StringIO(text), delimiter=delimiter)]
    rows = [r for r in rows if any(r)]
    if len({len(r) for r in rows}) > 1:
        notes.append("rows of different width")
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    return out.getvalue().rstrip("\n"), notes


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0
        self.row: list[str] | None = None
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in _NOISE:
            self.hidden += 1
        elif tag == "img" and not self.hidden:
            a = dict(attrs)
            label = a.get("alt") or a.get("title") or re.sub(r"\.\w+$", "", (a.get("src") or "").rsplit("/", 1)[-1])
            self.parts.append(f"[VISUAL: {label}]")
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th"):
            self.cell = []
        elif tag in _BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in _NOISE:
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("td", "th") and self.cell is not None and self.row is not None:
            self.row.append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "tr" and self.row is not None:
            out = io.StringIO()
            csv.writer(out, lineterminator="").writerow(self.row)
            self.parts.append("\n" + out.getvalue() + "\n")
            self.row = None
        elif tag in _BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.hidden:
            return
        (self.cell if self.cell is not None else self.parts).append(re.sub(r"[ \t\r\n\f]+", " ", data))


def html_text(text: str) -> str:
    """Visible text; tables as delimited rows, images as placeholders, noise tags left out."""
    reader = _Reader()
    reader.feed(text)
    reader.close()
    lines = [re.sub(r" {2,}", " ", x).strip(" ") for x in "".join(reader.parts).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def _docx(raw: bytes) -> str:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{w}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    out = []
    for e in body if body is not None else []:
        if e.tag == f"{w}p":
            out.append(text(e))
        elif e.tag == f"{w}tbl":
            out += [",".join(text(c).replace(",", ";") for c in row.iter(f"{w}tc")) for row in e.iter(f"{w}tr")]
    return "\n".join(out)


def _xlsx(raw: bytes) -> str:
    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{m}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        out = []
        for n in sorted(x for x in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", x)):
            rows = []
            for row in ET.fromstring(z.read(n)).iter(f"{m}row"):
                cells = []
                for c in row.iter(f"{m}c"):
                    v = c.find(f"{m}v")
                    if c.get("t") == "s" and v is not None:
                        cells.append(shared[int(v.text)])
                    elif c.get("t") == "inlineStr":
                        cells.append("".join(t.text or "" for t in c.iter(f"{m}t")))
                    else:
                        cells.append(re.sub(r"\.0$", "", v.text) if v is not None and v.text else "")
                if any(cells):
                    rows.append(",".join(cells))
            if rows:
                out.append(f"[SHEET: {len(out) + 1}]\n" + "\n".join(rows))
    return "\n\n".join(out)


def extract_one(raw: bytes | None, kind: str | None) -> tuple:
    """``(text, success, encoding, warnings)`` of one file; never raises."""
    if not raw:
        return "", False, None, ["empty file"]
    try:
        if kind in ("docx", "xlsx"):
            return (_docx if kind == "docx" else _xlsx)(raw), True, None, []
        if kind in ("pdf", "image"):
            return "", False, None, [f"{kind} needs a reader that isn't installed"]
        text, encoding = decode(raw)
        if kind == "csv":
            text, notes = csv_text(text)
            return text, True, encoding, notes
        if kind == "html":
            return html_text(text), True, encoding, []
        if kind == "json":
            try:
                return json.dumps(json.loads(text), indent=2, ensure_ascii=False), True, encoding, []
            except ValueError:
                return text, True, encoding, ["JSON is damaged"]
        text = html.unescape(text) if "&" in text and ";" in text else text
        return text.replace("\r\n", "\n").replace("\r", "\n"), True, encoding, []
    except Exception as e:  # noqa: BLE001 - a damaged file is a result, not a failure of the job
        return "", False, None, [f"unreadable: {type(e).__name__}"]


@F.pandas_udf(RESULT)
def extract(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract_one(c, k) for c, k in zip(content, kind)], columns=RESULT.names)


def normalize_input(text: Column, kind: Column) -> Column:
    """Line ends as LF, form feeds and soft hyphens gone, at most two blank lines, ends stripped."""
    s = F.regexp_replace(text, "\r\n?", "\n")
    s = F.when(kind == "pdf", F.regexp_replace(s, "\f", "\n")).when(kind == "docx", F.regexp_replace(F.regexp_replace(s, "­", ""), " ", " ")).otherwise(s)
    return F.regexp_replace(F.regexp_replace(s, "\n{4,}", "\n\n\n"), r"^\s+|\s+$", "")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, format, text, success, encoding, warnings, n_chars, n_lines`` of every file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    typed = files.withColumn("format", detect_format(F.col("content"), F.col("path")))
    done = typed.withColumn("r", extract("content", "format")).select("path", "format", "r.*")
    return done.withColumn("text", normalize_input(F.col("text"), F.col("format"))).withColumns({
        "n_chars": F.length("text"), "n_lines": F.size(F.split("text", "\n"))})


def line_type(line: Column) -> Column:
    """html, json, csv or text, in that priority; null for a blank line."""
    s = F.trim(line)
    return (
        F.when(s == "", None)
        .when(s.rlike(r"(?i)</[a-z][a-z0-9]*>|^<(?:div|table|tr|td|p|span|html|body|ul|li)\b|<!doctype"), "html")
        .when(s.rlike(r'^[\[{]$|^[\]}],?$|^"[^"]+"\s*:'), "json")
        .when((F.regexp_count(s, F.lit(",")) >= 2) & ~s.rlike(r"^[<{\[#]"), "csv")
        .otherwise("text"))


def typed_segments(lines: DataFrame) -> DataFrame:
    """Runs of lines of one type; blank lines belong to the run before, two of them end it."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    full = lines.withColumn("type", line_type(F.col("line"))).filter("type is not null")
    opens = (F.col("type") != F.lag("type").over(w)) | (F.col("line_no") - F.lag("line_no").over(w) > 2)
    run = full.withColumn("segment", F.sum(F.coalesce(opens, F.lit(False)).cast("int")).over(w))
    return run.groupBy("doc_id", "segment", "type").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.count("*").alias("n_lines"))


def partition_regions(signals: DataFrame, lengths: DataFrame, least: float = 0.8) -> DataFrame:
    """Regions between boundary signals (doc_id, position, strength); always at least one a document."""
    strong = signals.filter((F.col("strength") >= least) & (F.col("position") > 0)).select("doc_id", "position")
    starts = lengths.select("doc_id", F.lit(0).cast("long").alias("position")).unionByName(strong.withColumn("position", F.col("position").cast("long"))).distinct()
    w = Window.partitionBy("doc_id").orderBy("position")
    return starts.join(lengths, "doc_id").select("doc_id", F.row_number().over(w).alias("region"), F.col("position").alias("start"),
                                                  F.coalesce(F.lead("position").over(w), F.col("length").cast("long")).alias("end"))
