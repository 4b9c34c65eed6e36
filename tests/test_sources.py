import pytest
from pyspark.sql import functions as F

from filingloom.sources import readers, writers
from filingloom.streaming import windows


def test_router():
    assert readers.route("/a/b.MD") == "markdown" and readers.route("x.html") == "html"
    with pytest.raises(ValueError):
        readers.route("/a.b/noext")


def test_markdown_sections(spark):
    text = "intro\n# One #\nbody\n```\n# not a header\n```\n## Two\nmore"
    rows = readers.markdown_sections(spark.createDataFrame([("d", text), ("plain", "no header")], "doc_id string, content string")).orderBy("doc_id", "section_no").collect()
    assert [(r.doc_id, r.title, r.content) for r in rows] == [("d", None, "intro"), ("d", "One", "body\n```\n# not a header\n```"), ("d", "Two", "more"), ("plain", None, "no header")]


def test_html_blocks(spark):
    page = "<html><script>x()</script><h1>Title</h1><p>One &amp; two</p><table><caption>c</caption><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><ul><li>item</li></ul>tail"
    rows = readers.html_blocks(spark.createDataFrame([("d", page), ("none", None)], "doc_id string, content string")).orderBy("order").collect()
    assert [(r.block_type, r.text) for r in rows] == [("heading", "Title"), ("paragraph", "One & two"), ("table", "a | b\n1 | 2"), ("list_item", "item"), ("paragraph", "tail")]


def test_jsonl_skips_bad_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"sessionId": "s", "text": "a"}\nnot json\n{"session_id": "s", "text": "b"}\n{"sessionId": "t", "text": "c"}\n')
    rows = readers.read_jsonl(spark, str(tmp_path / "l.jsonl"), "sessionId string, session_id string, text string", "s").collect()
    assert sorted(r.text for r in rows) == ["a", "b"]


def test_replace_keeps_other_documents(spark, tmp_path):
    path = str(tmp_path / "segments")
    writers.replace_documents(spark.createDataFrame([("a", 1), ("b", 1)], "doc_id string, v int"), path)
    writers.replace_documents(spark.createDataFrame([("a", 2)], "doc_id string, v int"), path)
    assert {(r.doc_id, r.v) for r in spark.read.parquet(path).collect()} == {("a", 2), ("b", 1)}


def test_snapshot_switches_last(spark, tmp_path):
    root = str(tmp_path / "store")
    writers.write_snapshot(spark, {"t": spark.range(2)}, root)
    writers.write_snapshot(spark, {"t": spark.range(3)}, root)
    assert writers.read_snapshot(spark, root, "t").count() == 3


def test_windows_and_sessions(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:05:00", "view", 1.0), (1, "2024-01-01 00:20:00", "view", 2.0), (1, "2024-01-01 02:00:00", "click", 3.0), (None, "2024-01-01 02:00:00", "click", None)], "user_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert {(r.event_type, r.events, r.total) for r in windows.windowed_counts(rows).collect()} == {("view", 2, 3.0), ("click", 2, 3.0)}
    assert sorted(r.events for r in windows.sessions(rows).collect()) == [1, 2]
