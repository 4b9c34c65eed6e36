import json
import os

import pytest
from pyspark.sql import functions as F

from filingloom.operators import classify, documents
from filingloom.sources import readers, writers

TABLE = "id string, title string, headers array<string>, rows array<array<string>>, raw_markdown string, section_title string, section_type string, nearby string, raw_kind string"


def test_table_kinds(spark):
    cases = {
        "profile_table": ("Company Profile", None), "analysis_table": ("Ratio analysis of cash flow", None), "notes_table": ("Note 7 Loans", None), "other_table": ("Item 7 of it", None), "cash_flow": ("合并资产负债表", [["经营活动产生的现金流量净额", "1"]]), "balance_sheet": ("x", [["货币资金"], ["负债合计"], []]),
        "income_statement": ("Consolidated Statements of Income", None), "equity": ("Changes in stockholders’ equity", None),
    }
    rows = [(kind, title, None, cells, None, None, None, None, None) for kind, (title, cells) in cases.items()]
    rows += [("section", None, None, None, "balance sheet", None, "financial_note", None, None), ("around", "T", None, None, None, None, None, "Cash flow for the year", None), ("complex", "T", None, None, "balance sheet", None, None, None, "complex_table"), ("markdown", "T", None, None, "| balance  sheet |", None, None, None, None), ("none", None, None, None, None, None, None, None, None)]
    got = {r.id: r.kind for r in classify.table_kind(spark.createDataFrame(rows, TABLE)).collect()}
    assert all(got[kind] == kind for kind in cases)
    assert (got["section"], got["around"], got["complex"], got["markdown"], got["none"]) == ("notes_table", "cash_flow", "notes_table", "balance_sheet", "notes_table")


@pytest.mark.parametrize("text,number", [("1,234.5", 1234.5), ("(12)", -12.0), ("$5%", 5.0), ("¥5", None), ("", None), ("n/a", None), (None, None), ("1.2.3", None)])
def test_strict_numbers(spark, text, number):
    assert spark.createDataFrame([(text,)], "t string").select(classify.strict_number(F.col("t")).alias("n")).first().n == number


def test_rows_in_one_cell(spark):
    assert classify.one_cell_row("Total revenue $ 1,234 1,100", 2) == ("Total revenue", ["1,234", "1,100"])
    assert classify.one_cell_row("Net loss (12.50) 3.75 :", 2) == ("Net loss", ["(12.50)", "3.75"])
    assert classify.one_cell_row("Goodwill 7", 2) == (None, []) and classify.one_cell_row("7 8", 2) == (None, ["7", "8"]) and classify.one_cell_row("x 1", 0) == (None, [])
    tables = spark.createDataFrame([("t", ["2023", "2022"], [["Cash", "1", "-", "2"], ["Debt 5 6"], [], [None, "3"]]), ("u", None, None)], "id string, period_headers array<string>, rows array<array<string>>")
    assert {(r.row_no, r.label, tuple(r.cells)) for r in classify.split_rows(tables).collect()} == {(0, "Cash", ("1", "2")), (1, "Debt", ("5", "6")), (3, None, ("3",))}


def test_note_sections_by_tier(spark):
    notes = spark.createDataFrame([("d", "n1", 5, 5, 2), ("d", "n2", 5, 9, 6), ("d", "n3", 20, 22, None), ("d", "n4", 40, None, None)], "doc_id string, note_id string, page_start int, page_end int, anchor_order int")
    rows = [("d", "ordered", 5, 7, "x", 9), ("d", "early", 5, 1, "x", 9), ("d", "inside", 8, None, "x", 1), ("d", "before", 28, None, "x", 1), ("d", "after", 18, None, None, 1), ("d", "titled", 18, None, "Loans", 1), ("d", "far", 60, None, "x", 1), ("d", "nowhere", None, None, "x", 1)]
    tables = spark.createDataFrame(rows, "doc_id string, table_id string, page int, order int, title string, blocks_on_page int")
    assert {r.table_id: r.note_id for r in classify.note_sections(tables, notes).collect()} == {"ordered": "n2", "inside": "n2", "before": "n3", "after": "n3"}


def test_narrowest_section_prefers_confidence(spark):
    ranges = spark.createDataFrame([("d", "a", 1, 5, 0.4), ("d", "b", 2, 6, 0.9), ("d", "wide", 1, 50, 1.0)], "doc_id string, range_id string, lo int, hi int, confidence double")
    items = spark.createDataFrame([("d", "i", 3), ("d", "j", 40), ("d", "k", 99)], "doc_id string, item_id string, page int")
    assert {r.item_id: r.range_id for r in documents.narrowest_range(items, ranges).collect()} == {"i": "b", "j": "wide", "k": None}


def test_contents_are_left_out(spark):
    long = "The board discussed the results of the year at length."
    blocks = [("heading", "Contents"), ("list_item", "Item one"), ("paragraph", "Risks 12"), ("paragraph", "Results ..... 14"), ("heading", "Overview"), ("paragraph", long), ("heading", "Results"), ("paragraph", "第三节 公司治理 17"), ("paragraph", None), ("paragraph", "Short text")]
    rows = [("d", f"b{i}", i, kind, text) for i, (kind, text) in enumerate(blocks)]
    got = [r.block_id for r in classify.without_contents(spark.createDataFrame(rows, "doc_id string, block_id string, order int, block_type string, text string")).orderBy("block_id").collect()]
    assert got == ["b5", "b6", "b9"]


def test_neighbours_of_one_section_are_merged(spark):
    rows = [
        ("d", 1, "Risk factors", "risk", 3, 4, 0.5), ("d", 2, "Risk factors", "risk", 9, 9, 0.9), ("d", 3, "More risks", "risk", 10, 11, None), ("d", 4, "第三节 风险", "risk", 12, 12, 0.4), ("d", 5, "Other", "risk", 20, 20, 0.1),
        ("d", 6, "Notes", "note", None, None, None), ("d", 7, "Notes b", "note", 21, 21, None), ("e", 1, None, None, None, None, None),
    ]
    got = classify.merge_adjacent(spark.createDataFrame(rows, "doc_id string, position int, title string, kind string, page_start int, page_end int, confidence double")).collect()
    assert {(r.doc_id, r.position): (r.title, r.page_start, r.page_end, r.confidence, r.merged) for r in got} == {
        ("d", 1): ("Risk factors", 3, 11, 0.9, 3), ("d", 4): ("第三节 风险", 12, 12, 0.4, 1), ("d", 5): ("Other", 20, 20, 0.1, 1), ("d", 6): ("Notes", None, None, None, 1), ("d", 7): ("Notes b", 21, 21, None, 1), ("e", 1): (None, None, None, None, 1),
    }
    assert classify.merge_adjacent(spark.createDataFrame([], "doc_id string, position int, title string, kind string, page_start int, page_end int, confidence double")).count() == 0


def test_checks(spark):
    rows = [("a", "equals", "x", "x", True), ("b", "equals", "x", None, False), ("c", "min", "2", "3", True), ("d", "max", "2", "3", False), ("e", "subset", "p,q", "q,r,p", True), ("f", "subset", "p", None, False), ("g", "min", None, None, True), ("h", "min", "2", "many", False)]
    got = {r.name: r.passed for r in classify.checks(spark.createDataFrame([r[:4] for r in rows], "name string, rule string, expected string, actual string")).collect()}
    assert got == {r[0]: r[4] for r in rows}


def test_parse_confidence(spark):
    rows = [("ocr_pdf", 1.0, 9, 0, 0.77), ("x", 0.0, 0, 9, 0.46), ("mineru_pdf", 1.0, 3, 0, 0.98), ("native_pdf", 0.5, 1, 1, 0.74)]
    df = spark.createDataFrame(rows, "r string, c double, t int, i int, want double")
    assert all(x.got == pytest.approx(x.want) for x in df.withColumn("got", classify.parse_confidence(F.col("r"), F.col("c"), F.col("t"), F.col("i"))).collect())


def test_requested_documents(spark):
    facts = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", None)], "id string, document_id string")
    kept, missing = classify.requested(facts, spark.createDataFrame([("a",), ("z",), ("a",), (None,)], "document_id string"))
    assert [r.id for r in kept.collect()] == ["1"] and [r.document_id for r in missing.collect()] == ["z"]


def test_upserts_replace_whole_documents(spark, tmp_path):
    path = str(tmp_path / "vectors")
    schema = "doc_id string, segment_id string, embedding array<float>"
    writers.upsert_documents(spark, spark.createDataFrame([("a", "a1", [1.0]), ("a", "a2", None), ("b", "b1", [2.0])], schema), path, buckets=4)
    writers.upsert_documents(spark, spark.createDataFrame([("a", "a3", [3.0]), ("c", "c1", [4.0]), (None, "x", None)], schema), path, buckets=4)
    writers.upsert_documents(spark, spark.createDataFrame([], schema), path, buckets=4)
    assert sorted(r.segment_id for r in writers.read_documents(spark, path).collect()) == ["a3", "b1", "c1"]


def test_subgraphs_are_replaced(spark):
    node, edge = "node_id string, node_type string, name string, documents array<string>", "edge_id string, source_id string, target_id string, relationship_type string, document_id string"
    nodes = spark.createDataFrame([("n1", "company", "Acme", ["a", "b"]), ("n2", "risk", "Fire", ["a"])], node)
    edges = spark.createDataFrame([("e1", "n1", "n2", "HAS_RISK", "a"), ("e2", "n1", "n1", "SELF", "b")], edge)
    got_nodes, got_edges = writers.replace_subgraph(nodes, edges, spark.createDataFrame([("n1", "company", "ACME", ["a"]), ("n3", "risk", "Flood", ["a"])], node), spark.createDataFrame([("e3", "n1", "n3", "HAS_RISK", "a")], edge))
    assert {r.node_id: (r.name, r.documents) for r in got_nodes.collect()} == {"n1": ("Acme", ["a", "b"]), "n3": ("Flood", ["a"])}
    assert {r.edge_id for r in got_edges.collect()} == {"e2", "e3"}


def test_reports_newest_first(spark, tmp_path):
    for i, (name, text) in enumerate([("a.json", json.dumps({"doc_id": "d", "score": 1})), ("b.json", json.dumps({"doc_id": "d", "score": 2})), ("bad.json", "{oops"), ("list.json", "[1]"), ("c.txt", "{}")]):
        (tmp_path / name).write_text(text)
        os.utime(tmp_path / name, (1_700_000_000 + i, 1_700_000_000 + i))
    reports = readers.read_reports(spark, str(tmp_path), "doc_id string, score int")
    assert reports.count() == 2
    best = readers.latest_report(reports, F.col("report.doc_id")).collect()
    assert [(r.key, r.report.score) for r in best] == [("d", 2)]
    page = readers.newest_first(reports, "modified", "path", offset=1, limit=5).collect()
    assert [r.report.score for r in page] == [1]


def test_backfill_and_routes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.jsonl").write_text('{"doc_id": "a", "v": 1}\nbroken\n{"doc_id": "b", "v": 2}\n')
    writers.backfill(spark, str(tmp_path / "in"), "doc_id string, v int", str(tmp_path / "out"), buckets=2)
    assert {(r.doc_id, r.v) for r in writers.read_documents(spark, str(tmp_path / "out")).collect()} == {("a", 1), ("b", 2)}
    assert readers.route("/x/y.DOCX") == "office"
    with pytest.raises(ValueError):
        readers.route("/x/y.exe")
