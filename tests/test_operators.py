import pytest
from pyspark.sql import functions as F

from filingloom.operators import facts, graph, jobs, retrieval

OBS = "observation_id string, company_id string, company string, document_id string, document_year int, metric_key string, period string, value string, statement_type string, unit string, currency string, source_table_id string, source_table_title string, source_section string, page_range struct<lo:int,hi:int>, provenance struct<source_type:string,source_priority:int,source_grounded:boolean>"


def _obs(spark, rows):
    full = [(f"ob-{i:03d}", "c", "C", doc, year, metric, period, value, None, None, None, None, None, None, None, ("table", 0, grounded)) for i, (doc, year, metric, period, value, grounded) in enumerate(rows)]
    return facts.observations(spark.createDataFrame(full, OBS))


def test_trend(spark):
    obs = _obs(spark, [("d", 2024, "revenue", "2022", "100", True), ("d", 2024, "revenue", "2023", "120", True), ("d", 2024, "revenue", "2024", "144", True), ("d", 2024, "net", "2024", "24", True)])
    rows = {(r.metric_key, r.year): r.yoy for r in facts.metric_trend(obs).collect()}
    assert rows == {("revenue", 2022): None, ("revenue", 2023): 0.2, ("revenue", 2024): 0.2, ("net", 2024): None}
    assert {r.metric_key: r.cagr for r in facts.compound_growth(facts.metric_trend(obs), ["metric_key"]).collect()} == {"revenue": 0.2, "net": None}


def test_grounded_value_wins(spark):
    winner = facts.resolve_conflicts(_obs(spark, [("old", 2021, "revenue", "2021", "100", True), ("new", 2024, "revenue", "2021", "200", False)])).first()
    assert (winner.value, winner.conflict, winner.branch) == ("100", True, "one_grounded")


def test_zero_and_text_values(spark):
    obs = _obs(spark, [("d", 2020, "m", "2019", "0", False), ("d", 2020, "m", "2020", "5", False), ("d", 2020, "m", "2021", "n/a", False)])
    assert {r.year: r.yoy for r in facts.metric_trend(obs).collect()} == {2019: None, 2020: None}


def test_comparison(spark):
    a, b = (spark.createDataFrame(rows, "k string, value double") for rows in ([("x", 100.0), ("only_a", 1.0)], [("x", 125.0), ("only_b", 2.0)]))
    rows = {r.k: (r.delta, r.delta_pct) for r in facts.compare(a, b, ["k"]).collect()}
    assert rows == {"x": (25.0, 0.25), "only_a": (None, None), "only_b": (None, None)}


def test_overlap(spark):
    rows = spark.createDataFrame([("a", "api"), ("b", "api"), ("b", "dose"), ("c", "other"), ("d", None)], "k string, s string")
    assert [tuple(r) for r in facts.overlap(rows, "k", "s").collect()] == [("a", "b", 1, 0.5)]


def test_tokens_and_score(spark):
    row = spark.createDataFrame([("Net Income 2023 营业收入增长率",)], "t string").select(retrieval.tokenize(F.col("t")).alias("t")).first()
    assert row.t == ["net", "income", "2023", "营业收入增长率", "营业", "业收", "收入", "入增", "增长", "长率"]
    score = spark.createDataFrame([("cash cash flow",)], "t string").select(retrieval.bm25_lite(retrieval.tokenize(F.col("t")), ["cash", "none"]).alias("s")).first().s
    assert score == pytest.approx(2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 500)) / 2)


def test_ranking_quality(spark):
    rows = [("q", rank, relevant) for rank, relevant in ((1, 0), (2, 1), (3, 0), (4, 1))]
    row = retrieval.ranking_quality(spark.createDataFrame(rows, "query_id string, rank int, relevant int"), 10).first()
    assert (row.hit, row.mrr) == (1, 0.5) and 0 < row.ndcg < 1


def test_windows_have_no_surplus_tail(spark):
    row = spark.createDataFrame([("x" * 1500,)], "t string").select(retrieval.windows(F.col("t"), 800, 100).alias("w")).first()
    assert [len(w) for w in row.w] == [800, 800]


def test_paths_are_simple(spark):
    edges = spark.createDataFrame([("e1", "a", "b"), ("e2", "b", "c"), ("e3", "c", "a"), ("e4", "c", "d")], "edge_id string, source_id string, target_id string")
    paths = {r.path_id for r in graph.simple_paths(edges).collect()}
    assert "e1::e2::e4" in paths and "e1::e2::e3" not in paths and len(paths) == 4 + 4 + 1


def test_one_winner_per_claim_and_lease_expiry(spark):
    rows = [("j", 1, "submit", 0.0, None), ("j", 2, "claim", 1.0, "w1"), ("j", 3, "claim", 2.0, "w2"), ("j", 4, "heartbeat", 3.0, "w2"), ("j", 5, "claim", 70.0, "w2"), ("j", 6, "succeed", 71.0, "w1"), ("j", 7, "succeed", 72.0, "w2")]
    out = jobs.replay(spark.createDataFrame(rows, "job_id string, seq long, action string, at double, worker_id string")).orderBy("seq").collect()
    assert [r.accepted for r in out] == [True, True, False, False, True, False, True]
    assert (out[-1].status, out[-1].attempt) == ("succeeded", 2)


def test_stream_equals_batch(spark, tmp_path):
    schema = "job_id string, seq long, action string, at double, worker_id string"
    rows = [(f"j{i % 5}", i, ("submit", "claim", "fail", "claim", "cancel", "succeed")[(i // 5) % 6], float(i), "w") for i in range(60)]
    frame = spark.createDataFrame(rows, schema)
    frame.where("seq < 30").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frame.where("seq >= 30").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.stream_replay(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("replayed").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda r: (r.job_id, r.seq)
    assert sorted(spark.table("replayed").collect(), key=key) == sorted(jobs.replay(frame).collect(), key=key)


def test_queue_metrics(spark):
    rows = [("a", "running", "w", "2024-01-01 00:00:00", None), ("b", "failed", None, None, None), ("c", "queued", None, None, None)]
    frame = spark.createDataFrame(rows, "job_id string, status string, worker_id string, lease string, cancel string").selectExpr("job_id", "status", "worker_id", "cast(lease as timestamp_ntz) lease_expires_at", "cast(cancel as timestamp_ntz) cancel_requested_at", "timestamp_ntz'2024-01-01 00:00:00' created_at", "timestamp_ntz'2024-01-01 00:30:00' updated_at", "cast(null as timestamp_ntz) available_at")
    row = jobs.queue_metrics(frame, F.lit("2024-01-01 01:00:00").cast("timestamp_ntz")).first()
    assert (row.expired_leases, row.recent_failures, row.queued, row.active_workers, row.health) == (1, 1, 1, 0, "critical")
