"""Small cases of the core operators, and their SQL on the smallest tables."""

import datetime as dt
import glob
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import canon
from ledgerloom.operators import linkage, recordsets, registry, resolve, rules, structure, textlines
from ledgerloom.plans import queries as core
from ledgerloom.sources import formats
from ledgerloom.streaming import ingest

SF = "/root/testdata/sf0.001"


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_amounts(spark):
    values = [",500.00", "1,,500", "1,50,0.00", "$,00", "1,850.00", "1.850,00", "$ 12.5", "EUR 7", "1,234,567", "12,34", "(5)", "", None, "abc", ".50", "1.850"]
    assert column(spark, values, canon.canon_amount) == [None, None, None, None, 1850.0, 1850.0, 12.5, 7.0, 1234567.0, 12.34, None, None, None, None, 0.5, 1.85]


def test_names_and_types(spark):
    assert column(spark, ["Horizon IT Solutions, Inc.", "Group Ltd", " ", None, "A.B.C  Corp"], canon.canon_vendor) == ["HORIZON IT", "GROUP LTD", None, None, "ABC"]
    assert column(spark, ["Tax invoice", "BILLING STATEMENT 3", "Credit memo", "Other", ""], canon.canon_doc_type) == ["INVOICE", "STATEMENT", "CREDIT NOTE", "OTHER", None]
    assert column(spark, ["inv-007/a", "", None], canon.alnum_upper) == ["INV007A", None, None]
    assert column(spark, ["INV-2026/07", "a1", ""], canon.number_signature) == ["A+-9+/9+", "A9", None]


def test_dates(spark):
    day = dt.date
    values = ["2026-08-02", "2 August 2026", "January 5, 2026", "5. Januar 2026", "2 août 2026", "08/02/2026", "13/02/26", "31/02/2026", "x", None]
    assert column(spark, values, canon.canon_date) == [day(2026, 8, 2), day(2026, 8, 2), day(2026, 1, 5), day(2026, 1, 5), day(2026, 8, 2), day(2026, 8, 2), day(2026, 2, 13), None, None, None]
    assert column(spark, ["08/02/2026"], lambda v: canon.canon_date(v, True)) == [day(2026, 2, 8)]


def test_rules(spark):
    rows = [(1, "5", "x@y.z", None), (2, None, "bad", 3.0)]
    df = spark.createDataFrame(rows, "id long, a string, b string, c double")
    spec = [{"id": "e", "type": "exists", "field": "a"}, {"id": "m", "type": "match", "field": "b", "format": "email"},
            {"id": "c", "type": "compare", "op": ">", "left": "a", "right": {"const": 4}, "requires": ["a"]}, {"id": "u", "type": "unknown"}]
    got = {(r.id, r.rule_id): r.status for r in rules.evaluate(df, spec).collect()}
    assert got == {(1, "e"): "PASS", (2, "e"): "FAIL", (1, "m"): "PASS", (2, "m"): "FAIL", (1, "c"): "PASS", (2, "c"): "SKIPPED", (1, "u"): "FAIL", (2, "u"): "FAIL"}


def test_alignment_is_one_to_one(spark):
    c = spark.createDataFrame([(1, 1, 1, 1.0), (1, 1, 2, 1.0), (1, 2, 1, 1.0), (1, 2, 2, 0.75), (2, 1, 1, 0.8)], "doc_id long, a_line int, b_line int, score double")
    assert {(r.doc_id, r.a_line, r.b_line) for r in recordsets.align_lines(c).collect()} == {(1, 1, 1), (1, 2, 2), (2, 1, 1)}


def test_baseline_leaves_the_record_out(spark):
    r = spark.createDataFrame([(i, "v", "a") for i in range(3)] + [(9, "v", "b"), (10, "w", "a"), (11, "w", "b")], "doc_id long, vendor string, x string")
    assert [(q.doc_id, q.norm, q.observations) for q in registry.deviations(r, "x").collect()] == [(9, "a", 3)]


def test_hierarchy_equals_stack(spark):
    import random

    rnd, rows = random.Random(3), []
    for doc in range(40):
        stack = []
        for line in range(25):
            depth = rnd.randrange(6)
            while stack and stack[-1][1] >= depth:
                stack.pop()
            rows.append((doc, line, depth, stack[-1][0] if stack else None))
            stack.append((line, depth))
    df = spark.createDataFrame(rows, "doc_id long, line_no int, depth int, want int")
    assert structure.hierarchy(df, ["doc_id"]).filter("not (parent_line <=> want)").count() == 0


def test_arbitration(spark):
    b = spark.createDataFrame([(1, 1, "table", 0, 5, 0.9, 10), (1, 2, "kv", 2, 3, 0.5, 10), (1, 3, "context", 0, 9, 0.8, 10), (1, 4, "kv", 7, 8, 0.1, 10)],
                              "doc_id long, block_id long, source string, start_line int, end_line int, confidence double, total_lines int")
    assert {r.block_id for r in structure.arbitrate(b).collect()} == {1, 3}


def test_total_by_identity(spark):
    df = spark.createDataFrame([([100, 20, 120],), ([1, 2],), ([1, 2, 3, 4, 5],), (None,)], "v array<long>")
    assert [r[0] for r in df.select(resolve.total_by_identity("v")).collect()] == [120, None, None, None]


def test_line_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a\n\n- x\n- y\n\nz 😀"), (4, "q" * 200_000)], "doc_id long, text string")
    lines = textlines.line_model(docs)
    assert {r.kind for r in textlines.list_transitions(lines).collect()} == {"entry", "exit"}
    assert textlines.split_segments(lines).filter("doc_id = 3").count() == 3
    assert textlines.structural_metrics(lines).count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x; y\n1; 2\n\n3;4\n")
    (tmp_path / "b.html").write_text("<html><script>no</script><p>Hi &amp; you</p><table><tr><td>a</td><td>b,c</td></tr></table><img alt='logo'></html>")
    (tmp_path / "c.json").write_text('{"a":1}')
    (tmp_path / "d.txt").write_bytes("﻿ä\r\nb".encode())
    (tmp_path / "e.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "f.bin").write_bytes(b"")
    with zipfile.ZipFile(tmp_path / "g.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p></w:body></w:document>')
    with zipfile.ZipFile(tmp_path / "h.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c><v>1.0</v></c><c t="inlineStr"><is><t>k</t></is></c></row></sheetData></worksheet>')
    got = {os.path.basename(r.path): r for r in formats.read_files(spark, str(tmp_path)).collect()}
    assert got["a.csv"].text == "x,y\n1,2\n3,4" and got["a.csv"].format == "csv"
    assert got["b.html"].text == 'Hi & you\n\na,"b,c"\n\n[VISUAL: logo]'
    assert got["c.json"].text == '{\n  "a": 1\n}' and got["d.txt"].text == "ä\nb"
    assert not got["e.pdf"].success and "f.bin" not in got
    assert got["g.docx"].text == "Hello" and got["h.xlsx"].text == "[SHEET: 1]\n1,k"


def test_office_files_with_late_entries(spark, tmp_path):
    parts = {"one": ("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p></w:body></w:document>'),
             "two": ("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c><v>1.0</v></c></row></sheetData></worksheet>')}
    for name, part in parts.items():
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("docProps/thumbnail.jpeg", b"x" * 10_000)
            z.writestr(*part)
    got = {os.path.basename(r.path): (r.format, r.text) for r in formats.read_files(spark, str(tmp_path)).collect()}
    assert got == {"one": ("docx", "Hello"), "two": ("xlsx", "[SHEET: 1]\n1")}


def test_stream_usage(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    out = ingest.run_once(ingest.usage_by_day(s, delay="3650 days"), str(tmp_path / "out"), str(tmp_path / "cp"), "append")
    assert out.count() == 0  # no window is over before the watermark passes it
    q = ingest.usage_by_day(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("usage").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("usage").agg(F.sum("requests")).first()[0] == e.count()


def test_sql_of_core_queries(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    # one of each module; the driver compares all of them
    for name in ("dedup_summary_by_type", "match_summary", "vendor_patterns", "case_precedent_top3", "boundary_signals", "context_dominant", "resolve_fields", "available_types", "segmenter_types"):
        df = core.QUERIES[name](spark, SF)
        cur = con.execute(core.SQL[name])
        names = [x[0] for x in cur.description]
        assert sorted(names) == sorted(df.columns), name
        want = sorted(repr([(k, v) for k, v in sorted(zip(names, row))]) for row in cur.fetchall())
        got = sorted(repr(sorted(r.asDict().items())) for r in df.collect())
        if not any("." in g for g in got[:1]):
            assert got == want, name
        assert len(got) == len(want), name


def test_linkage_pair(spark):
    rows = [(1, "INV-1", "Acme Ltd", "X", "10.00", "USD", "2026-01-01", "P1", "Invoice"), (2, "inv 1", "ACME", "X", "10.00", "USD", "2026-01-02", "P1", "Invoice"), (3, None, None, None, None, None, None, None, None)]
    r = spark.createDataFrame(rows, "id long, invoice_number string, vendor string, recipient string, amount string, currency string, date string, po_number string, document_type string")
    c = linkage.canonicalize(r)
    got = linkage.classify(linkage.evidence(linkage.candidate_pairs(c), c)).collect()
    assert [(g.a_id, g.b_id, g.relationship) for g in got] == [(1, 2, "NORMALIZED_DUPLICATE")]


def test_fields_of_german_and_french_labels(spark):
    texts = ["Rechnungsnummer: R-1\nRechnungsdatum: 1.2.2025\nEmpfänger: Acme\nUSt-IdNr: DE1\nZwischensumme: 10,00 EUR\nMwSt 19 %: 1,90 EUR\nGesamtbetrag: 11,90 EUR",
             "Numéro de facture: F-2\nDate de facture: 2 mars 2025\nDestinataire: Beta\nTotal à payer: 5,00 EUR", "Order Number: 77\nOrder Date: 2025-01-01\nOrder Total: 9.00 EUR",
             "Payment Reference: P-4\nRechnung Nr.: R-9\nAmount Paid: 3.00 EUR"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_key long, text string")
    got = {(r.doc_id, r.field): r.value for r in resolve.resolve_fields(resolve.labelled_lines(docs)).collect()}
    assert got == {(0, "invoice_number"): "R-1", (0, "date"): "1.2.2025", (0, "recipient"): "Acme", (0, "tax_id"): "DE1", (0, "subtotal"): "10,00 EUR", (0, "tax"): "1,90 EUR",
                   (0, "total"): "11,90 EUR", (1, "invoice_number"): "F-2", (1, "date"): "2 mars 2025", (1, "recipient"): "Beta", (1, "total"): "5,00 EUR", (2, "po_number"): "77",
                   (2, "date"): "2025-01-01", (2, "total"): "9.00 EUR", (3, "payment_reference"): "P-4", (3, "invoice_number"): "R-9", (3, "total"): "3.00 EUR"}
