import json

import pytest

from filingloom.operators import nested


def _paths(spark, payload=None, semantic=None, events=None):
    documents = spark.createDataFrame([(k, v, 1) for k, v in (payload or {}).items()], "doc_id string, payload string, path int")
    tables = spark.createDataFrame([(k, v) for k, v in (semantic or {}).items()], "id string, semantic_rows string")
    jobs = spark.createDataFrame([(k, v) for k, v in (events or {}).items()], "job_id string, events array<struct<timestamp:timestamp,status:string,stage:string,progress_percent:int,message:string>>")
    return {(r.root_key, r.child_path, r.parent_path, r.list_position) for r in nested.list_objects(documents, tables, jobs).collect()}


def test_depth_spellings_and_irregular_values(spark):
    doc = {
        "sections": {"section_id": "s1"},  # a lone object
        "pageBlocks": [None, {"blockId": "b1"}, 7, "text"],  # null keeps its place, scalars are no case
        "tables": json.dumps([{"semantic_rows": [{"sources": [{"page": 1}, {"page": 2}]}]}]),  # text that holds JSON
        "financialSchema": {"notes": [{"noteFacts": [{"fact_key": "f"}]}], "statements": None},
        "issues": [{"details": {"cells": {"row": 1}}}],
        "segments": "not json",
    }
    got = _paths(spark, {"d": json.dumps(doc), "double": json.dumps(json.dumps({"sections": [{"a": 1}]})), "bad": "{oops", "none": None, "empty": ""})
    assert got == {
        ("d", "sections[0]", "", 0), ("d", "pageBlocks[1]", "", 1), ("d", "tables[0]", "", 0), ("d", "tables[0].semantic_rows[0]", "tables[0]", 0),
        ("d", "tables[0].semantic_rows[0].sources[0]", "tables[0].semantic_rows[0]", 0), ("d", "tables[0].semantic_rows[0].sources[1]", "tables[0].semantic_rows[0]", 1),
        ("d", "financialSchema.notes[0]", "", 0), ("d", "financialSchema.notes[0].noteFacts[0]", "financialSchema.notes[0]", 0),
        ("d", "issues[0]", "", 0), ("d", "issues[0].details.cells[0]", "issues[0]", 0), ("double", "sections[0]", "", 0),
    }


def test_semantic_rows_and_events(spark):
    event = (None, "queued", None, 0, None)
    got = _paths(spark, semantic={"t": '[{"sources": {"page": 1}}]', "one": '{"label": "x"}', "n": None, "e": "[]"}, events={"j": [event, None, event], "k": None, "l": []})
    assert {(k, p) for k, p, _, _ in got} == {("t", "semantic_rows[0]"), ("t", "semantic_rows[0].sources[0]"), ("one", "semantic_rows[0]"), ("j", "events[0]"), ("j", "events[2]")}


def test_flat_table_has_typed_fields_and_parents(spark):
    doc = json.dumps({"page_blocks": [{"block_id": "b", "page": 3, "text": "x" * 50_000}]})
    row = nested.payload_table(spark.createDataFrame([("d", doc)], "doc_id string, payload string"), "page_blocks").first()
    assert (row.root_key, row.child_path, row.block_id, row.page, len(row.text)) == ("d", "page_blocks[0]", "b", 3, 50_000)


def test_empty_tables(spark):
    assert _paths(spark) == set()


def _walk(value, path, out):
    """Brute force over plain Python objects."""
    if isinstance(value, dict):
        for key, below in value.items():
            _walk(below, f"{path}.{key}" if path else key, out)
    elif isinstance(value, list):
        for i, below in enumerate(value):
            if isinstance(below, dict):
                out.add(f"{path}[{i}]")
            _walk(below, f"{path}[{i}]", out)


def test_agrees_with_brute_force(spark):
    docs = {f"d{n}": {"sections": [{"section_id": str(i)} for i in range(n)], "tables": [{"semantic_rows": [{"sources": [{"page": 1}] * (i % 3)} for i in range(n)]}], "issues": [{"details": {"cells": [{"row": 1}] * n}}]} for n in range(5)}
    want = set()
    for key, doc in docs.items():
        found = set()
        _walk(doc, "", found)
        want |= {(key, p) for p in found}
    assert {(k, p) for k, p, _, _ in _paths(spark, {k: json.dumps(d) for k, d in docs.items()})} == want


def test_lists_without_a_target_are_kept(spark):
    deep = {"a": [{"b": [[{"c": 1}, None], {"d": {"e": [{"f": [{"g": [{"h": [{"i": 1}]}]}]}]}}]}], "plain": [1, "x", [2]], "sections": [{"section_id": "s", "marks": '[{"z": 1}]'}], "tables": [{"rows": [["[1]", "{"]]}]}
    found = set()
    deep_open = json.loads(json.dumps(deep).replace('"[{\\"z\\": 1}]"', '[{"z": 1}]'))
    _walk(deep_open, "", found)
    assert {p for _, p, _, _ in _paths(spark, {"d": json.dumps(deep)})} == found
    documents = spark.createDataFrame([("d", json.dumps(deep))], "doc_id string, payload string")
    other = {(r.child_path, r.parent_path, json.dumps(json.loads(r.item))) for r in nested.other_lists(documents, spark.createDataFrame([], "id string, semantic_rows string")).collect()}
    assert ("a[0].b[0][0]", "a[0]", '{"c": 1}') in other and ("sections[0].marks[0]", "sections[0]", '{"z": 1}') in other and not any(p == "sections[0]" for p, _, _ in other)


def test_deeper_than_the_steps_raises(spark):
    deep = {"a": 1}
    for _ in range(20):
        deep = {"k": [deep]}
    with pytest.raises(Exception, match="nested too deeply"):
        _paths(spark, {"d": json.dumps(deep)})


def test_schema_lists_and_clashing_names(spark):
    doc = {"segments": [{"segment_id": "g", "position": 7}], "financial_schema": {"metric_facts": [{"metric_key": "revenue", "period": "2020", "value": 1.5}], "noteFacts": [{"fact_key": "f"}], "notes": [{"semantic_rows": [{"label": "x", "sources": [{"page": 2}]}]}]}}
    documents = spark.createDataFrame([("d", json.dumps(doc))], "doc_id string, payload string")
    row = nested.payload_table(documents, "segments").first()
    assert (row.list_position, row.position) == (0, 7)
    assert nested.payload_table(documents, "metric_facts").first().value == "1.5" and nested.payload_table(documents, "schema_note_facts").first().fact_key == "f"
    assert nested.payload_table(documents, "note_row_sources").first().child_path == "financial_schema.notes[0].semantic_rows[0].sources[0]"
    target = nested.Target("clash", (nested.each("segments"),), (("list_position", "int"), ("position", "int")))
    assert nested.flat_table(documents, "doc_id", nested.payload_object("payload"), target).columns == ["root_key", "child_path", "parent_path", "list_position", "field_list_position", "position"]
