import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingloom.operators import documents, facts, retrieval, search, structure


@pytest.mark.parametrize("period,year,ok", [("2023", 2023, True), ("2017", 2023, False), ("2024", 2023, True), ("2025", 2023, False), ("1999", None, False), ("December 31, 2022", 2023, True), ("December 31, 1998", None, False), ("current_period", 2023, True), ("Q3", 2023, False), ("FY2022", 2023, False), (None, 2023, False)])
def test_plausible_periods(spark, period, year, ok):
    row = spark.createDataFrame([(period, year)], "p string, y int").select(structure.plausible_period(F.col("p"), F.col("y")).alias("ok")).first()
    assert bool(row.ok) is ok


@pytest.mark.parametrize("text,tokens", [("December 31,  2023 and December 31, 2022", ["December 31, 2023", "December 31, 2022"]), ("2023年12月31日 2022 年 1 月 1 日", ["2023", "2022"]), ("2023 vs 2022, 2023", ["2023", "2022"]), ("no 12023", []), ("", [])])
def test_period_tokens(spark, text, tokens):
    assert spark.createDataFrame([(text,)], "t string").select(structure.period_tokens(F.col("t")).alias("p")).first().p == tokens


def test_row_labels(spark):
    rows = {"Less: Net Income (loss)*": "net income", "a. Cash – see Note 4": "cash -", "Notes  receivable†": "receivable"}
    got = {r.t: r.k for r in spark.createDataFrame([(t,) for t in rows], "t string").select("t", structure.row_label(F.col("t")).alias("k")).collect()}
    assert got == rows


def test_header_rows_are_promoted(spark):
    tables = spark.createDataFrame([("a", ["合并利润表", ""], [["单位：元"], ["项目", "2021年", "2020年"], ["收入", "1", "2"]]), ("b", ["Item", "2021"], [["Item", "2021", "2020"]]), ("c", None, None), ("d", ["x"], [])], "id string, headers array<string>, rows array<array<string>>")
    got = {r.id: (r.headers, r.rows, r.promoted) for r in structure.promoted_headers(tables).collect()}
    assert got["a"] == (["项目", "2021年", "2020年"], [["收入", "1", "2"]], True)
    assert not got["b"][2] and got["b"][1] == [["Item", "2021", "2020"]] and not got["c"][2] and got["d"][0] == ["x"]


def test_currency_columns(spark):
    assert structure.collapse_currency_columns(["Item", "2023", "", "2022", ""], [["Cash", "$", "10", "$", "9"], ["Debt", "5", "", "4", ""], []]) == (["Item", "2023", "2022"], [["Cash", "10", "9"], ["Debt", "5", "4"], ["", "", ""]])
    assert structure.collapse_currency_columns(["Item", "Total", ""], [["Cash", "$", "10"], ["Debt", "7", ""]]) == (["Item", "Total"], [["Cash", "$ 10"], ["Debt", "7"]])
    kept = (["Item", "Total", ""], [["Cash", "1", "10"]])
    assert structure.collapse_currency_columns(*kept) == kept
    tables = spark.createDataFrame([("a", ["Item", "2023", "", "2022"], [["Cash", "$", "10", "9"]]), ("b", ["x"], None), ("c", None, [])], "id string, headers array<string>, rows array<array<string>>")
    got = {r.id: (r.headers, r.rows) for r in structure.compact_tables(tables).collect()}
    assert got == {"a": (["Item", "2023", "2022"], [["Cash", "10", "9"]]), "b": (["x"], None), "c": (None, [])}


def test_tables_go_on_over_pages(spark):
    schema = "doc_id string, id string, table_index int, page int, table_type string, title string, headers array<string>, period_headers array<string>, unit string, currency string, rows array<array<string>>"
    base = ("income", "Income  Statement", ["Item", "2023"], ["2023"], "m", "USD", [["a", "1"]])
    rows = [("d", "t1", 0, 1, *base), ("d", "t2", 1, 2, "income", None, None, ["2023"], "m", "USD", [["b", "2"], ["c", "3"]]), ("d", "t3", 2, 3, *base), ("d", "t4", 3, 4, "income", "Other", ["Item", "2023"], ["2023"], "m", "USD", None), ("e", "t5", 0, None, *base), (None, "t6", 0, 1, *base)]
    got = {r.id: (r.parts, r.rows) for r in structure.merged_tables(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"t1": (["t1", "t2"], 3), "t3": (["t3"], 1), "t4": (["t4"], 0), "t5": (["t5"], 1)}


def test_captions_and_footnotes_by_place(spark):
    tables = spark.createDataFrame([("d", "t", 1, [0.0, 100.0, 200.0, 200.0]), ("d", "none", 2, None)], "doc_id string, table_id string, page int, bbox array<double>")
    captions = spark.createDataFrame([("d", "below", 1, 0, [0.0, 205.0, 200.0, 215.0]), ("d", "far", 1, 1, [0.0, 10.0, 200.0, 20.0]), ("d", "above", 1, 2, [0.0, 80.0, 200.0, 95.0]), ("d", "nobox", 1, 3, None), ("d", "p2", 2, 1, None), ("x", "other", 1, 0, [0.0, 80.0, 200.0, 95.0])], "doc_id string, caption_id string, page int, order int, bbox array<double>")
    assert {(r.table_id, r.caption_id) for r in structure.captions_of_tables(tables, captions).collect()} == {("t", "above"), ("none", "p2")}
    notes = spark.createDataFrame([("d", "n1", 1, 0, [0.0, 205.0, 150.0, 215.0]), ("d", "n2", 1, 1, [0.0, 220.0, 150.0, 230.0]), ("d", "n3", 1, 2, [0.0, 300.0, 150.0, 310.0]), ("d", "n4", 1, 3, [0.0, 312.0, 150.0, 320.0]), ("d", "side", 1, 4, [900.0, 205.0, 990.0, 215.0]), ("d", "q1", 2, 5, None), ("d", "q2", 2, 6, None)], "doc_id string, footnote_id string, page int, order int, bbox array<double>")
    assert {(r.table_id, r.footnote_id) for r in structure.footnotes_of_tables(tables, notes).collect()} == {("t", "n1"), ("t", "n2"), ("none", "q1")}


def test_company_keys(spark):
    same = ["Acme Foods & Co. Ltd", "ACME FOODS and Company Limited", "Acme  Foods (Holdings) plc", "ａｃｍｅ foods"]
    assert {structure.company_key(n) for n in same} == {"acmefoods"}
    assert structure.company_key("澜泽科技股份有限公司") == "澜泽科技" and structure.company_key("有限公司") == "有限公司" and structure.company_key("Ltd.") == "company"
    assert structure.company_id("Acme Foods Ltd") == "acmefoods-" + hashlib.sha256(b"acmefoods").hexdigest()[:10]
    got = structure.company_keys(spark.createDataFrame([(n,) for n in same] * 2 + [(None,)], "company string"), "company")
    assert got.count() == 4 and got.select("company_id").distinct().count() == 1


def test_embedding_vector(spark):
    row = spark.createDataFrame([("Net income, NET",), ("",), (None,)], "t string").select(documents.hash_embedding(F.col("t"), 8).alias("e")).collect()
    want = np.zeros(8)
    features = [("tok:net", 1.25), ("tok:income", 1.25), ("tok:net", 1.25)] + [("tri:" + "net income net"[i : i + 3], 0.5) for i in range(12)]
    for name, weight in features:
        d = hashlib.blake2b(name.encode(), digest_size=8).digest()
        want[int.from_bytes(d[:4], "big") % 8] += weight * (1 if d[4] % 2 == 0 else -1)
    assert row[0].e == pytest.approx(list(want / np.linalg.norm(want)), abs=1e-6) and row[1].e == row[2].e == [1.0] + [0.0] * 7


def test_vector_search_in_blocks_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    data = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)] + [(300, None), (301, [0.0] * 6)]
    vectors = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    got = {(r.query_id, r["rank"]): r.vec_id for r in retrieval.vector_search(vectors.where("vec_id % 10 = 0"), vectors, 3).collect()}
    matrix = np.array([v for _, v in data[:300]], dtype="float32").astype("float64")
    unit = matrix / np.linalg.norm(matrix, axis=1)[:, None]
    for q in range(0, 300, 10):
        scores = np.round(unit @ unit[q], 6)
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-scores[i], i))[:3]
        assert [got[(q, r)] for r in (1, 2, 3)] == best
    assert retrieval.vector_search(vectors.limit(0), vectors, 3).count() == 0


def test_nearest_rank_against_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [("a", float(v)) for v in rng.exponential(size=997)] + [("b", 5.0)] * 40 + [("c", 1.5), ("d", None)]
    got = {r.k: (r.n, r.ranked) for r in facts.nearest_rank(spark.createDataFrame(rows, "k string, v double"), "k", "v", 0.95, cells=16).collect()}
    for key in "abc":
        values = sorted(v for k, v in rows if k == key)
        assert got[key] == (len(values), values[round(0.95 * (len(values) - 1))])
    assert "d" not in got


def test_smaller_key_wins_under_max(spark):
    keys = ["a", "ab", "b", "a1", "zz", "é", ""]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", *facts._key_desc("k"))
    assert [r.k for r in df.orderBy(F.col("n").desc()).collect()] == sorted(keys, key=lambda k: k.encode())


def test_value_variants(spark):
    rows = {"1234": ["1234", "1,234", "1,234.00", "1234.00"], "-12.50": ["12.5", "12.5"], "1,234": ["1,234"], "n/a": ["n/a"], " ": []}
    got = {r.v: r.x for r in spark.createDataFrame([(v,) for v in rows], "v string").select("v", documents.value_variants(F.col("v")).alias("x")).collect()}
    assert got == rows


def test_binding_tiers(spark):
    tables = spark.createDataFrame([("t", "| Revenue | 1,234.00 |", ["Item", "2023"], [["Revenue", "1,234.00"], ["Tax", "(55)"]])], "id string, raw_markdown string, headers array<string>, rows array<array<string>>")
    aligned = spark.createDataFrame([("t", "tax", "2023", -55.0)], "id string, metric_key string, period string, value double")
    obs = spark.createDataFrame([("1", "t", "tax", "2023", "-55"), ("2", "t", "revenue", "2023", "1234"), ("3", "t", "x", "2023", "77"), ("4", None, "x", "2023", "1"), ("5", "t", "x", None, None)], "observation_id string, source_table_id string, metric_key string, period string, value string")
    assert {r.observation_id: r.binding for r in documents.bind_tables(obs, tables, aligned).collect()} == {"1": "metric", "2": "text", "3": "none"}


def test_reference_only_segments(spark):
    rows = {"详见本报告第三节": True, "详见第三节，增长12.5%": False, "营业收入上升": False, "参见" + "长" * 90 + "第": False}
    got = {r.t: r.r for r in spark.createDataFrame([(t,) for t in rows], "t string").select("t", retrieval.is_reference_only(F.col("t")).alias("r")).collect()}
    assert got == rows


SEGMENTS = "segment_id string, doc_id string, position int, content string, metadata struct<section_type:string>"


def test_hybrid_retrieval(spark):
    long = "Operating cash flow improved because supplier concentration fell across all regions of the group this year. " * 2
    rows = [("a", "d", 1, long, ("management_discussion",)), ("b", "d", 2, long + "More text follows here.", ("management_discussion",)), ("c", "d", 3, "Operating cash flow was 5.", ("financial_note",)), ("e", "d", 4, "Staff canteen menu.", None), ("f", "d", 5, None, None), ("g", "d", 6, "详见本报告第三节 operating cash flow", None)]
    segments = spark.createDataFrame(rows, SEGMENTS)
    got = [(r.segment_id, r["rank"]) for r in search.hybrid_retrieve(segments, "operating cash flow and supplier concentration", k=3).orderBy("rank").collect()]
    assert [s for s, _ in got][0] in ("a", "b") and not {"a", "b"} <= {s for s, _ in got} and "g" not in {s for s, _ in got}
    turned = search.hybrid_retrieve(segments, "operating cash flow", k=2, rerank=lambda q, rows: sorted(rows, key=lambda r: len(r["content"]))).orderBy("rank").collect()
    assert len(turned) == 2
    none = search.hybrid_retrieve(segments.where("segment_id = 'none'"), "anything", k=2)
    assert none.count() == 0
    only = search.hybrid_retrieve(spark.createDataFrame([("x", "d", 1, "", None), ("y", "d", 2, None, None)], SEGMENTS), "风", k=1).collect()
    assert [(r.segment_id, r.score) for r in only] == [("x", 0.01)]


@pytest.mark.parametrize("question,section,content,hints,metrics,delta", [
    ("risk of x", "risk_section", "text", ("risk_section",), (), 0.15), ("risk of x", "financial_note", "fair value", ("risk_section",), (), -0.24), ("x", "audit_report", "t", ("management_discussion",), (), -0.09), ("operating cash flow", None, "revenue rose", (), (), -0.16),
    ("revenue", None, "经营现金流", (), ("revenue",), -0.16), ("revenue and operating cash flow", None, "revenue", (), (), 0.0), ("增长的原因", "x", "员工培训", (), (), -0.14), ("增长的原因", "x", "员工培训 毛利", (), (), 0.0), ("plain", None, None, (), (), 0.0),
])
def test_score_adjustment(spark, question, section, content, hints, metrics, delta):
    row = spark.createDataFrame([(section, content)], "s string, c string").select(search.score_adjustment(question, F.col("s"), F.coalesce("c", F.lit("")), hints, metrics).alias("d")).first()
    assert row.d == pytest.approx(delta)


def test_graph_search_scores(spark):
    nodes = spark.createDataFrame([("c", "company", "Acme", None), ("d", "document", "Report", "{}"), ("r", "risk", "Supplier concentration", None), ("s", "subsidiary", "Acme Foods", None)], "node_id string, node_type string, name string, properties string")
    edges = spark.createDataFrame([("e1", "c", "d", "HAS_DOCUMENT"), ("e2", "d", "r", "HAS_RISK"), ("e3", "c", "s", "OWNS"), ("e4", "d", "gone", "HAS_RISK"), ("e5", "r", "c", "AFFECTS")], "edge_id string, source_id string, target_id string, relationship_type string")
    got = {r.path_id: (r.score, r.summary) for r in search.graph_search(nodes, edges, "supplier risk").collect()}
    assert got["e2"] == (1.0, "Report -[HAS_RISK]-> Supplier concentration")
    assert got["e1::e2"][0] == pytest.approx(0.15 + 0.5 + 0.26) and "e1" not in got and "e4" not in got and "e3" not in got
    assert "e2::e5" in got and "e2::e5::e1" not in got and "e1::e2::e5" not in got  # no node twice
    first = search.graph_search(nodes, edges, "subsidiary", k=1).collect()
    assert [(r.path_id, r.score) for r in first] == [("e3", 0.45)]


def test_queue_alerts(spark):
    from filingloom.operators import jobs

    schema = "job_id string, status string, worker_id string, lease_expires_at timestamp, created_at timestamp, updated_at timestamp, available_at timestamp, cancel_requested_at timestamp"
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")

    def run(rows):
        text = schema.replace("timestamp", "string")
        df = spark.createDataFrame(rows, text)
        return jobs.queue_metrics(df.select(*(F.col(c).cast("timestamp") if c.endswith("_at") else F.col(c) for c in df.columns)), now).first()

    quiet = run([("1", "succeeded", "w", None, "2024-01-01 11:00:00", "2024-01-01 11:30:00", None, None)])
    assert quiet.health == "ok" and quiet.alerts == "" and quiet.oldest_ready_seconds is None
    old = run([("1", "queued", None, None, "2024-01-01 11:00:00", "2024-01-01 11:00:00", None, None)])
    assert (old.health, old.alerts, old.oldest_ready_seconds) == ("warning", "oldest_ready_age_high", 3600.0)
    bad = run([("1", "failed", None, None, "2024-01-01 11:00:00", "2024-01-01 11:30:00", None, None), ("2", "running", "w", "2024-01-01 11:59:00", "2024-01-01 11:00:00", "2024-01-01 11:30:00", None, None), ("3", "queued", None, None, "2024-01-01 11:00:00", "2024-01-01 11:00:00", None, None)])
    assert (bad.health, bad.alerts) == ("critical", "expired_worker_lease,recent_ingestion_failures,oldest_ready_age_high")
