"""Segments, views, layout and findings on small hand-made cases."""

import json

from pyspark.sql import functions as F

from ledgerloom.operators import consistency, engine, layout, linkage, signals, structure, view
from ledgerloom.operators.engine import Line

LINES = lambda t: [Line(i, x) for i, x in enumerate(t.split("\n"))]
TREE = "root\n    a\n        b\n            c\n    d"


def test_parts_and_regions():
    assert [len(p) for p in engine.parts(LINES("a: 1\nb: 2\n\nx\n\ny\nz\n---\nlast"))] == [2, 3, 1]
    assert engine.region(engine.shares(LINES("a,b,c\n1,2,3\n4,5,6")))[0] == "table"
    assert engine.region(engine.shares(LINES("| a | b |\n|---|---|\n| 1 | 2 |")))[0] == "table"
    assert engine.region(engine.shares(LINES("Name: x\nTown: y\nDate: z")))[0] == "block"
    assert engine.region(engine.shares(LINES("It was a fine day.\nWe went out")))[0] == "plain"
    assert engine.engine_of("table", 0.4) == "block"


def test_pairs():
    got = engine.find_pairs(LINES("Due Date: 2 May\n2024-01-01 12:00:00 x: y\nInvoice Number INV-7\nspec: a=1; b=2; c\nempty:"))
    assert [(p["key"], p["value"], p["confidence"]) for p in got] == [("Due Date", "2 May", 1.0), ("Invoice Number", "INV-7", 0.75), ("spec", "a=1; b=2; c", 1.0), ("empty", "", 0.8)]
    assert [x["key"] for x in got[2]["nested"]] == ["a", "b"]


def test_tables():
    assert engine.find_table(LINES("name,qty\nx,1\ny,2"))["headers"] == ["name", "qty"]
    assert engine.find_table(LINES("| n | q |\n|---|---|\n| x | 1 |\n| y | 2 |"))["rows"] == [["x", "1"], ["y", "2"]]
    aligned = engine.aligned_table(LINES("name      town      size\nalpha     Bern      4\nbeta two  Rome      5\ngamma     Oslo      6"))
    assert aligned["headers"] == ["name", "town", "size"] and aligned["rows"][1] == ["beta two", "Rome", "5"]
    items = engine.item_table(LINES("Description  Qty  Price  Sum\noak beam long  2  5.00  10.00\nsteel nut  1  1.50  1.50"))
    assert items["headers"] == ["Description", "Qty", "Price", "Sum"] and items["rows"][0] == ["oak beam long", "2", "5.00", "10.00"]
    assert engine.find_table(LINES("just words here\nand there")) is None


def test_tree_and_context():
    tree = engine.find_tree(LINES(TREE))
    assert [(n["depth"], n["parent"]) for n in tree["nodes"]] == [(0, None), (1, 0), (2, 1), (3, 2), (1, 0)] and tree["max_depth"] == 3 and tree["roots"] == [0]
    drawn = engine.find_tree(LINES("top\n├── a\n│   ├── b\n│   │   └── c"))
    assert [n["depth"] for n in drawn["nodes"]] == [0, 1, 2, 3]
    context = engine.find_context(LINES("ERROR disk full\n12 13 14\nplain words"), [])
    assert [m["type"] for m in context["annotated"]] == ["log", "telemetry", "prose"] and context["dominant"] == "mixed"


def test_settling():
    block = lambda s, a, b, c: engine._block(s, a, b, c, {})
    kept = lambda *bs: [b["source"] for b in engine.settle(sorted(bs, key=lambda b: (b["start"], -b["end"])), 10)]
    assert kept(block("table", 0, 5, 0.9), block("kv", 1, 3, 0.9)) == ["table"]
    assert kept(block("table", 0, 5, 0.9), block("tree_structure", 1, 3, 0.9)) == ["table", "tree_structure"]
    assert kept(block("context", 0, 5, 0.5), block("tree_structure", 1, 3, 1.0)) == ["tree_structure"]
    assert kept(block("kv", 0, 5, 0.9), block("context", 0, 5, 0.9)) == ["kv", "context"] and kept(block("kv", 0, 5, 0.1)) == []


def test_cleanup_and_checks():
    content, flags = engine.clean("kv_block", {"pairs": [{"key": "[x] [y] Name", "value": "a\x00b", "line_index": 0}, {"key": "***", "value": "", "line_index": 1}]})
    assert content["pairs"][0]["key"] == "Name" and content["pairs"][0]["value"] == "ab" and flags == ["KV_KEYS_REMOVED"]
    content, flags = engine.clean("table_block", {"headers": ["a", "b"], "rows": [["1", "n/a"], ["--", "=="], ["2"]]})
    assert content["rows"] == [["1", None], ["2", None]] and set(flags) == {"TABLE_ROWS_REMOVED", "TABLE_ROWS_PADDED"}
    assert ("WIDTH_MISMATCH", "error") in engine.check("table_block", {"headers": ["a"], "rows": [["1", "2"], ["3", "4"]]}, 0.9)
    assert ("DUPLICATE_KEYS", "warning") in engine.check("kv_block", {"pairs": [{"key": "a", "value": "1"}, {"key": "a", "value": "2"}]}, 0.9)
    assert engine.check("hierarchy_block", {"nodes": [{"depth": 0, "text": "a"}, {"depth": 2, "text": ""}]}, 0.1) == [("LOW_CONFIDENCE", "flag"), ("DEPTH_JUMP", "warning"), ("EMPTY_NODE", "flag")]


def test_documents(spark):
    rows = [(1, "Acme Ovens Ltd\nInvoice\nInvoice Number: A-1\nInvoice Date: 2 May 2025\nTotal: 10.00 EUR\n\nname,qty\nx,1\ny,2"), (2, None), (3, "  \n "), (4, TREE), (5, "word " * 50_000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, segment string")
    segs = engine.segments(docs)
    got = {(r.doc_id, r.segment): r for r in segs.collect()}
    assert [k[0] for k in sorted(got)] == [1, 1, 4, 5] and got[1, 1].type == "table_block" and got[4, 0].type in ("hierarchy_block", "mixed")
    report = {r.doc_id: r for r in engine.report(segs, docs).collect()}
    assert report[2].flags == ["EMPTY_DOCUMENT"] == report[3].flags and report[1].is_valid and report[2].quality == 0.8
    shown = engine.rendered(segs)
    text = {r.doc_id: r.text for r in engine.documents_text(shown).collect()}
    assert "Invoice Number: A-1" in text[1] and "name  qty" in text[1] and set(text) == {1, 4, 5}
    machine = {(r.doc_id, r.segment): json.loads(r.machine) for r in shown.collect()}
    assert machine[1, 1]["rows"] == [{"name": "x", "qty": "1"}, {"name": "y", "qty": "2"}]
    made = engine.envelopes(segs, engine.report(segs, docs), docs.withColumn("at", F.lit("2025-01-01 00:00:00").cast("timestamp")), "at")
    assert made.count() == 3 and engine.envelope_faults(made).count() == 0
    assert engine.envelope_faults(made.withColumn("payload", F.lit("{"))).select("fault").distinct().collect()[0].fault == "payload"
    assert engine.segments(docs.limit(0)).count() == 0


def test_envelopes_read_texts_once(spark):
    """The same envelopes from one pass, with cells longer than 131,072 characters, at which the csv reader stopped."""
    docs = spark.createDataFrame([(1, "Invoice Number: A-1\nTotal: 3"), (2, None), (3, "a,b\n" + "x" * 140_000 + ",1"), (4, "a: 1\nb: 2\n\nc: 3\nd: 4")], "doc_id long, text string")
    docs = docs.withColumn("at", F.lit("2025-01-01 00:00:00").cast("timestamp"))
    segs = engine.segments(docs)
    once = engine.envelopes(segs, None, docs, "at")
    assert sorted(once.collect()) == sorted(engine.envelopes(segs, engine.report(segs, docs), docs, "at").collect())
    assert {r.doc_id for r in once.collect()} == {1, 3, 4}
    assert once._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_views(spark):
    text = "Acme Ovens Ltd\nTax invoice\nRechnungsnummer: A-1\nInvoice Date: 2 May 2025\noak beam  2  5.00  10.00\nnut  1  2.50  2.50\nSubtotal: 12.50\nTax: 2.50\nTotal Due: 15.00 EUR"
    docs = spark.createDataFrame([(1, text), (2, text.replace("15.00 EUR", "16.00 EUR")), (3, None), (4, text + "\nTotal Due: 9.00 EUR"), (5, "Invoice Number,Total\nB-7,3.00")], "doc_key long, text string")
    got = {r.doc_id: r for r in view.document_views(docs).collect()}
    fields = {f.field: (f.value, f.source) for f in got[1].fields}
    assert fields["vendor"] == ("Acme Ovens Ltd", "heading") and fields["invoice_number"] == ("A-1", "pairs") and fields["document_type"] == ("tax invoice", "heading")
    assert [(i.description, i.amount) for i in got[1].items] == [("oak beam", 10.0), ("nut", 2.5)]
    assert (got[1].verdict, got[2].verdict, got[3].verdict) == ("CONFIRM", "CONFLICT", "UNVERIFIABLE") and got[3].fields == [] and got[4].status == "MULTIPLE"
    assert {f.field: f.source for f in got[5].fields}["total"] in ("header_row", "table")
    assert view.figure("(1.234,50)") == -1234.5 and view.figure("1,234") == 1234.0 and view.figure("none") is None


def test_reading_order(spark):
    left, right = ["one two", "three four", "five six"], ["seven eight", "nine ten", "eleven twelve"]
    words = []
    for page, sides in ((1, [(left, 0), (right, 400)]), (2, [(left, 0)])):
        for lines, x in sides:
            for n, line in enumerate(lines):
                for k, w in enumerate(line.split()):
                    words.append((page, x + k * 60.0, x + k * 60.0 + 50, n * 12.0 + (1.0 if x else 0.0), w))
    df = spark.createDataFrame(words, "page_id long, x0 double, x1 double, top double, text string")
    got = {r.page_id: r.text.split("\n") for r in layout.reading_order(df).collect()}
    assert got == {1: left + right, 2: left} and layout.reading_order(df.limit(0)).count() == 0


def test_depths_beyond_any_bound(spark):
    chain = [(1, i, i if i < 20 else 3) for i in range(21)] + [(2, 0, None), (2, 1, 5)]
    df = spark.createDataFrame(chain, "doc_id long, line_no int, depth int")
    got = {(r.doc_id, r.line_no): r.parent_line for r in structure.hierarchy(df, ["doc_id"]).collect()}
    assert all(got[1, i] == i - 1 for i in range(1, 20)) and got[1, 0] is None and got[1, 20] == 2 and got[2, 1] == 0
    lines = spark.createDataFrame([(1, i, n, False) for i, n in enumerate([6, 9, 12, 6])], "doc_id long, line_no int, indent int, is_empty boolean")
    assert [(r.unit, r.depth) for r in structure.indent_depths(lines).orderBy("line_no").collect()] == [(3, 0), (3, 1), (3, 2), (3, 0)]


def test_signals(spark):
    binary = spark.createDataFrame([(bytearray(b"\x00\x01\x02" * 50),), (bytearray(b"plain text"),), (bytearray("wide".encode("utf-16")),), (bytearray(b""),)], "c binary")
    assert [r[0] for r in binary.select(signals.looks_binary(F.col("c"))).collect()] == [True, False, False, False]
    score = spark.createDataFrame([("x = y + 2 ∑",), ("nothing here",)], "t string").select(signals.math_score(F.col("t")).alias("s"))
    assert [r.s for r in score.collect()] == [9, 0]
    spans = spark.createDataFrame([(1, "newline", 3, 9, 0.25), (1, "other", 0, 1, 0.5), (1, "newline", 1, 2, 0.25)], "doc_id long, signal string, start int, stop int, strength double")
    assert signals.broken_spans(spans, spark.createDataFrame([(1, 5)], "doc_id long, length int")).count() == 2
    features = spark.createDataFrame([(0.5, 1.0), (None, 0.1), (1.5, 0.1)], "a double, b double")
    assert signals.broken_features(features, ["a", "b"]).count() == 2


def test_pairs_of_one_type_and_composition(spark):
    rows = [(1, "A-1", "Acme", "R", "10.00", "EUR", "2025-01-01", "P1", "Invoice", "invoice", "2.00"), (2, "A-1", "Acme", "R", "10.00", "EUR", "2025-01-01", "P1", "Invoice", "purchase_order", "2.00"),
            (3, "A-1", "Acme", "R", "10.00", "EUR", "2025-01-01", "P1", "Invoice", "invoice", "3.00"), (4, "A-1", "Acme", "R", "10.00", "EUR", "2025-01-01", "P1", "Invoice", None, "2.00")]
    df = spark.createDataFrame(rows, "id long, invoice_number string, vendor string, recipient string, amount string, currency string, date string, po_number string, document_type string, record_type string, tax string")
    c = linkage.canonicalize(df)
    got = {(r.a_id, r.b_id): r.relationship for r in linkage.classify(linkage.evidence(linkage.candidate_pairs(c), c)).collect()}
    assert got == {(1, 3): "IDENTITY_COLLISION", (1, 4): "EXACT_DUPLICATE", (3, 4): "IDENTITY_COLLISION"}


def test_findings(spark):
    book = spark.createDataFrame([(i, "v", 1000, 40, 1040, "T", i) for i in range(4)] + [(9, "v", 1000, 70, 1075, None, 9), (10, "w", None, None, 5, None, 1)],
                                 "id long, vendor string, subtotal long, tax long, total long, tax_id string, at int")
    found = consistency.evaluate(consistency.check_internal(book), consistency.check_tax_rate(book, book.filter("id < 9")), consistency.check_missing_tax_id(book, book))
    assert sorted((r.id, r.check) for r in found.collect()) == [(9, "TAX_ID_MISSING"), (9, "TAX_RATE_DEVIATION"), (9, "TOTAL_MISMATCH")]
    report = {r.id: r for r in consistency.report(book, found).collect()}
    assert report[9].status == "needs_review" and report[9].headline == "Total Mismatch and 2 more." and report[9].confidence == 0.89 and report[0].status == "clear"
    assert consistency.overlay(book, book.filter("id = 9").withColumn("total", F.lit(1).cast("long"))).filter("id = 9").first().total == 1
    assert consistency.report(book.limit(0), found).count() == 0
