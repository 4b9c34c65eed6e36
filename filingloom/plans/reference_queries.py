"""Queries of the engine's own operators over whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.operators import facts, graph, jobs, retrieval
from filingloom.tables import load

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        _QUERIES[name] = function
        if sql is not None:
            _SQL[name] = sql
        return function

    return register


def _obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.observations(load(spark, sf_dir, "metric_observations"))


_OBS = r"""
obs AS (
  SELECT *, CASE WHEN regexp_full_match(clean, '-?[0-9]+(\.[0-9]+)?') THEN CAST(clean AS DOUBLE) * CASE WHEN trimmed LIKE '(%)' THEN -1 ELSE 1 END END AS number
  FROM (
    SELECT observation_id, company_id, company, document_id, document_year, metric_key, period, value, statement_type, unit, currency, source_table_id, source_table_title,
      TRY_CAST(nullif(regexp_extract(period, '\b((?:19|20)[0-9]{2})\b', 1), '') AS INTEGER) AS year, trim(value) AS trimmed, regexp_replace(trim(value), '[,()$¥€£%\s]', '', 'g') AS clean,
      (source_table_id IS NOT NULL OR page_range IS NOT NULL OR source_section IS NOT NULL OR provenance IS NOT NULL) AS has_provenance, coalesce(provenance.source_grounded, false) AS is_grounded, coalesce(provenance.source_priority, 0) AS priority
    FROM metric_observations)
), canon AS (SELECT *, CASE WHEN number IS NOT NULL THEN printf('%.9e', number) ELSE trimmed END AS canonical FROM obs)
"""
_TRUST = "(has_provenance AND is_grounded) DESC, is_grounded DESC, has_provenance DESC, priority DESC, coalesce(document_year, 0) DESC, document_id DESC, observation_id"


@_query("f2_query_metrics", f"WITH {_OBS} SELECT observation_id, company_id, document_id, metric_key, period, year, value FROM obs WHERE metric_key = 'revenue' ORDER BY year NULLS LAST, metric_key, coalesce(document_year, 0), document_id, observation_id LIMIT 500")
def _(spark, sf_dir):
    return facts.query_metrics(_obs(spark, sf_dir), metric_key="revenue").select("observation_id", "company_id", "document_id", "metric_key", "period", "year", "value")


@_query("f4_year_range", f"WITH {_OBS} SELECT metric_key, count(*) AS facts, count(number) AS numeric_facts FROM obs WHERE year BETWEEN 2015 AND 2020 GROUP BY metric_key")
def _(spark, sf_dir):
    return _obs(spark, sf_dir).where("year BETWEEN 2015 AND 2020").groupBy("metric_key").agg(F.count(F.lit(1)).alias("facts"), F.count("number").alias("numeric_facts"))


@_query("f11_trust_flags", f"WITH {_OBS} SELECT has_provenance, is_grounded, count(*) AS facts FROM obs GROUP BY ALL")
def _(spark, sf_dir):
    return _obs(spark, sf_dir).groupBy("has_provenance", "is_grounded").agg(F.count(F.lit(1)).alias("facts"))


@_query("c9_period_year", f"WITH {_OBS} SELECT DISTINCT period, year FROM obs")
def _(spark, sf_dir):
    return _obs(spark, sf_dir).select("period", "year").distinct()


@_query("c12_numeric_parse", f"WITH {_OBS} SELECT observation_id, number FROM obs")
def _(spark, sf_dir):
    return _obs(spark, sf_dir).select("observation_id", "number")


@_query("j1_fact_documents", "SELECT m.observation_id, d.doc_id, d.created_at FROM metric_observations m JOIN parsed_documents d ON m.document_id = d.doc_id")
def _(spark, sf_dir):
    documents = load(spark, sf_dir, "parsed_documents").select("doc_id", "created_at")
    return load(spark, sf_dir, "metric_observations").select("observation_id", F.col("document_id").alias("doc_id")).join(documents, "doc_id").select("observation_id", "doc_id", "created_at")


@_query("j2_fact_tables", "SELECT m.observation_id, t.title, t.page FROM metric_observations m LEFT JOIN parsed_tables t ON m.source_table_id = t.id")
def _(spark, sf_dir):
    tables = load(spark, sf_dir, "parsed_tables").select(F.col("id").alias("source_table_id"), "title", "page")
    return load(spark, sf_dir, "metric_observations").select("observation_id", "source_table_id").join(tables, "source_table_id", "left").select("observation_id", "title", "page")


@_query("j17_company_documents", "SELECT DISTINCT d.doc_id FROM parsed_documents d WHERE EXISTS (SELECT 1 FROM metric_observations m JOIN resolved_entities r ON m.company_id = r.entity_id WHERE m.document_id = d.doc_id)")
def _(spark, sf_dir):
    owned = load(spark, sf_dir, "metric_observations").join(load(spark, sf_dir, "resolved_entities").select(F.col("entity_id").alias("company_id")), "company_id", "left_semi")
    return load(spark, sf_dir, "parsed_documents").select("doc_id").join(owned.select(F.col("document_id").alias("doc_id")), "doc_id", "left_semi").distinct()


@_query("a1_company_catalog", f"""WITH {_OBS}, y AS (SELECT DISTINCT company_id, y FROM (SELECT company_id, year AS y FROM obs UNION ALL SELECT company_id, document_year FROM obs) WHERE y IS NOT NULL)
SELECT o.company_id, min(company) AS name, count(DISTINCT document_id) AS documents, count(*) AS facts, coalesce((SELECT string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) FROM y WHERE y.company_id = o.company_id), '') AS years FROM obs o GROUP BY o.company_id""")
def _(spark, sf_dir):
    return facts.company_catalog(_obs(spark, sf_dir))


@_query("a2_numeric_by_year", f"WITH {_OBS} SELECT metric_key, year, count(*) AS candidates, count(DISTINCT company_id) AS companies FROM obs WHERE number IS NOT NULL AND year IS NOT NULL GROUP BY metric_key, year")
def _(spark, sf_dir):
    return facts.numeric_by_year(_obs(spark, sf_dir))


_A3 = f"""WITH {_OBS}, g AS (SELECT company_id, metric_key, period, count(*) AS candidates, count(DISTINCT canonical) AS vals, count(*) FILTER (WHERE is_grounded) AS grounded FROM canon WHERE company_id IS NOT NULL AND metric_key IS NOT NULL AND period IS NOT NULL GROUP BY ALL),
w AS (SELECT company_id, metric_key, period, observation_id AS winner_id, document_id AS winner_document, value, row_number() OVER (PARTITION BY company_id, metric_key, period ORDER BY {_TRUST}) AS place FROM canon)
SELECT g.company_id, g.metric_key, g.period, candidates, vals > 1 AS conflict, CASE WHEN vals <= 1 THEN 'single' WHEN grounded = 1 THEN 'one_grounded' WHEN grounded > 1 THEN 'grounded' ELSE 'ungrounded' END AS branch, winner_id, winner_document, value
FROM g JOIN w USING (company_id, metric_key, period) WHERE place = 1"""


@_query("a3_conflict_winner", _A3)
def _(spark, sf_dir):
    return facts.resolve_conflicts(_obs(spark, sf_dir))


@_query("a4_dedupe_facts", f"""WITH {_OBS} SELECT document_id, metric_key, period, facts, observation_id FROM (
SELECT *, count(*) OVER (PARTITION BY document_id, metric_key, period) AS facts, row_number() OVER (PARTITION BY document_id, metric_key, period ORDER BY is_grounded DESC,
(lower(coalesce(source_table_title, '')) LIKE '%现金流量%' OR lower(coalesce(source_table_title, '')) LIKE '%cash flow%') DESC, (coalesce(source_table_id, '') <> '') DESC, coalesce(source_table_id, '') DESC, observation_id) AS place FROM obs) WHERE place = 1""")
def _(spark, sf_dir):
    return facts.dedupe_facts(_obs(spark, sf_dir))


@_query("a6_knowledge_fusion", f"""WITH {_OBS}, s AS (SELECT company_id, metric_key, period, string_agg(document_id, ',' ORDER BY document_id) AS source_documents, count(*) - 1 AS suppressed FROM (SELECT DISTINCT company_id, metric_key, period, document_id FROM obs) GROUP BY ALL),
w AS (SELECT company_id, metric_key, period, value, row_number() OVER (PARTITION BY company_id, metric_key, period ORDER BY {_TRUST}) AS place FROM canon), c AS (SELECT company_id, metric_key, period, count(DISTINCT canonical) > 1 AS conflict FROM canon GROUP BY ALL)
SELECT company_id, metric_key, period, value, conflict, source_documents, suppressed FROM s JOIN w USING (company_id, metric_key, period) JOIN c USING (company_id, metric_key, period) WHERE place = 1""")
def _(spark, sf_dir):
    return facts.fuse(_obs(spark, sf_dir))


@_query("a7_largest_absolute", f"WITH {_OBS} SELECT document_id, metric_key, period, number, observation_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id, metric_key, period ORDER BY abs(number) DESC, observation_id) AS place FROM obs WHERE number IS NOT NULL) WHERE place = 1")
def _(spark, sf_dir):
    return facts.largest_absolute(_obs(spark, sf_dir))


@_query("a8_unit_consistency", f"WITH {_OBS} SELECT company_id, metric_key, count(DISTINCT unit) AS units, count(DISTINCT currency) AS currencies, count(DISTINCT unit) > 1 OR count(DISTINCT currency) > 1 AS inconsistent FROM obs GROUP BY company_id, metric_key")
def _(spark, sf_dir):
    return facts.consistency(_obs(spark, sf_dir))


_POINTS = f"""{_OBS}, ranked AS (SELECT company_id, metric_key, year, number, canonical, row_number() OVER (PARTITION BY company_id, metric_key, year ORDER BY {_TRUST}) AS place FROM canon WHERE number IS NOT NULL AND year IS NOT NULL AND company_id IS NOT NULL),
points AS (SELECT company_id, metric_key, year, max(number) FILTER (WHERE place = 1) AS value, count(DISTINCT canonical) > 1 AS conflict FROM ranked GROUP BY ALL)"""
_LAG = "lag(value) OVER (PARTITION BY company_id, metric_key ORDER BY year)"


@_query("r4_growth", f"WITH {_POINTS} SELECT company_id, metric_key, year, value, conflict, CASE WHEN {_LAG} <> 0 THEN round((value - {_LAG}) / abs({_LAG}), 6) END AS yoy FROM points")
def _(spark, sf_dir):
    return facts.metric_trend(_obs(spark, sf_dir))


@_query("w2_compound_growth", f"WITH {_POINTS} SELECT company_id, metric_key, min(year) AS first_year, max(year) AS last_year, CASE WHEN max(year) > min(year) AND arg_min(value, year) > 0 AND arg_max(value, year) > 0 THEN round(pow(arg_max(value, year) / arg_min(value, year), 1.0 / (max(year) - min(year))) - 1, 6) END AS cagr FROM points GROUP BY company_id, metric_key")
def _(spark, sf_dir):
    return facts.compound_growth(facts.metric_trend(_obs(spark, sf_dir)), ["company_id", "metric_key"])


@_query("w3_latest_value", f"WITH {_POINTS} SELECT company_id, metric_key, max(year) AS year, arg_max(value, year) AS value FROM points GROUP BY company_id, metric_key")
def _(spark, sf_dir):
    return facts.latest(facts.metric_trend(_obs(spark, sf_dir)), ["company_id", "metric_key"])


@_query("w4_ranking", f"WITH {_POINTS}, l AS (SELECT company_id, metric_key, max(year) AS year, arg_max(value, year) AS value FROM points GROUP BY company_id, metric_key), n AS (SELECT company_id, min(company) AS name FROM obs GROUP BY company_id) SELECT l.company_id, metric_key, year, value, name, row_number() OVER (PARTITION BY metric_key ORDER BY value DESC, name, l.company_id) AS rank FROM l JOIN n USING (company_id)")
def _(spark, sf_dir):
    obs = _obs(spark, sf_dir)
    return facts.ranking(facts.latest(facts.metric_trend(obs), ["company_id", "metric_key"]), obs.groupBy("company_id").agg(F.min("company").alias("name")))


_REVENUE = "SELECT l_suppkey, year(l_shipdate) AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS value FROM lineitem GROUP BY 1, 2"


def _revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("value"))


@_query("r6_metric_trend", f"WITH p AS ({_REVENUE}) SELECT *, lag(value) OVER w AS previous, CASE WHEN lag(value) OVER w <> 0 THEN round((value - lag(value) OVER w) / abs(lag(value) OVER w), 6) END AS yoy FROM p WINDOW w AS (PARTITION BY l_suppkey ORDER BY year)")
def _(spark, sf_dir):
    return facts.growth(_revenue(spark, sf_dir), ["l_suppkey"])


@_query("r6_compound_growth", f"WITH p AS ({_REVENUE}) SELECT l_suppkey, min(year) AS first_year, max(year) AS last_year, CASE WHEN max(year) > min(year) AND arg_min(value, year) > 0 AND arg_max(value, year) > 0 THEN round(pow(arg_max(value, year) / arg_min(value, year), 1.0 / (max(year) - min(year))) - 1, 6) END AS cagr FROM p GROUP BY l_suppkey")
def _(spark, sf_dir):
    return facts.compound_growth(_revenue(spark, sf_dir), ["l_suppkey"])


def _side(flag: str) -> str:
    return f"SELECT l_partkey, year(l_shipdate) AS year, sum(l_quantity) AS value FROM lineitem WHERE l_returnflag = '{flag}' GROUP BY 1, 2"


_COMPARED = f"WITH a AS ({_side('A')}), b AS ({_side('R')}), j AS (SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, coalesce(a.year, b.year) AS year, a.value AS value_a, b.value AS value_b, round(b.value - a.value, 6) AS delta FROM a FULL JOIN b ON a.l_partkey = b.l_partkey AND a.year = b.year), m AS (SELECT *, CASE WHEN value_a <> 0 THEN round(delta / abs(value_a), 6) END AS delta_pct FROM j)"


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    sides = [lines.where(F.col("l_returnflag") == flag).groupBy("l_partkey", F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("value")) for flag in "AR"]
    return facts.compare(*sides, ["l_partkey", "year"])


@_query("j3_comparison", f"{_COMPARED} SELECT * FROM m")
def _(spark, sf_dir):
    return _compared(spark, sf_dir)


@_query("j4_missing_sides", f"{_COMPARED} SELECT count(*) FILTER (WHERE value_a IS NULL) AS only_b, count(*) FILTER (WHERE value_b IS NULL) AS only_a, count(delta) AS both_sides FROM m")
def _(spark, sf_dir):
    return _compared(spark, sf_dir).agg(F.count_if(F.col("value_a").isNull()).alias("only_b"), F.count_if(F.col("value_b").isNull()).alias("only_a"), F.count("delta").alias("both_sides"))


@_query("o7_highlights", f"{_COMPARED} SELECT l_partkey, year, delta_pct FROM m WHERE delta_pct IS NOT NULL ORDER BY abs(delta_pct) DESC, l_partkey, year LIMIT 3")
def _(spark, sf_dir):
    rows = _compared(spark, sf_dir).where("delta_pct IS NOT NULL").select("l_partkey", "year", "delta_pct")
    return rows.orderBy(F.abs("delta_pct").desc(), "l_partkey", "year").limit(3)


@_query("a10_industry_distribution", "SELECT coalesce(r_name, 'unclassified') AS industry, count(DISTINCT s_suppkey) AS companies FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _(spark, sf_dir):
    nations = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    placed = load(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return placed.groupBy(F.coalesce("r_name", F.lit("unclassified")).alias("industry")).agg(F.countDistinct("s_suppkey").alias("companies"))


def _category_sql() -> str:
    branches = " ".join("WHEN " + " OR ".join(f"lower(name) LIKE '%{t}%'" for t in terms) + f" THEN '{c}'" for c, terms in facts.RISK_TERMS.items())
    return f"CASE {branches} ELSE 'other' END"


@_query("a11_risk_heatmap", f"WITH r AS (SELECT DISTINCT doc_id, name FROM llm_entities WHERE node_type = 'risk' AND name IS NOT NULL AND doc_id IS NOT NULL), c AS (SELECT doc_id, {_category_sql()} AS category FROM r) SELECT doc_id, " + ", ".join(f"count(*) FILTER (WHERE category = '{c}') AS {c}" for c in [*facts.RISK_TERMS, "other"]) + ", count(*) AS total FROM c GROUP BY doc_id")
def _(spark, sf_dir):
    return facts.risk_heatmap(load(spark, sf_dir, "llm_entities"))


@_query("x2_business_overlap", "WITH top AS (SELECT snippet_id FROM llm_entities WHERE snippet_id IS NOT NULL AND name IS NOT NULL AND node_type = 'business_segment' GROUP BY 1 ORDER BY count(*) DESC, snippet_id LIMIT 20), d AS (SELECT DISTINCT snippet_id, name FROM llm_entities WHERE snippet_id IN (SELECT snippet_id FROM top) AND name IS NOT NULL AND node_type = 'business_segment'), n AS (SELECT snippet_id, count(*) AS n FROM d GROUP BY 1), s AS (SELECT a.snippet_id AS a, b.snippet_id AS b, count(*) AS shared FROM d a JOIN d b ON a.name = b.name AND a.snippet_id < b.snippet_id GROUP BY 1, 2) SELECT a, b, shared, round(shared / (x.n + y.n - shared), 4) AS score FROM s JOIN n x ON x.snippet_id = a JOIN n y ON y.snippet_id = b")
def _(spark, sf_dir):
    segments = load(spark, sf_dir, "llm_entities").where("node_type = 'business_segment'")
    return facts.overlap(segments, "snippet_id", "name")


_NOW = "2024-06-30 00:00:00"


@_query("a16_queue_metrics", "WITH j AS (SELECT *, status = 'running' AND coalesce(lease_expires_at <= TIMESTAMP '" + _NOW + "', false) AS expired FROM ingestion_jobs), m AS (SELECT " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in jobs.STATUSES) + ", count(DISTINCT nullif(worker_id, '')) FILTER (WHERE status = 'running' AND NOT expired) AS active_workers, count(*) FILTER (WHERE expired) AS expired_leases, count(*) FILTER (WHERE status = 'failed' AND updated_at >= TIMESTAMP '" + _NOW + "' - INTERVAL 3600 SECOND) AS recent_failures, count(cancel_requested_at) AS cancel_requests, min(CASE WHEN status = 'queued' THEN created_at WHEN status = 'retry_wait' AND (available_at IS NULL OR available_at <= TIMESTAMP '" + _NOW + "') THEN coalesce(available_at, updated_at) END) AS oldest_ready FROM j) SELECT *, CASE WHEN oldest_ready IS NOT NULL THEN round(greatest(epoch_us(TIMESTAMP '" + _NOW + "') - epoch_us(oldest_ready), 0) / 1e6, 3) END AS oldest_ready_seconds, concat_ws(',', CASE WHEN expired_leases >= 1 THEN 'expired_worker_lease' END, CASE WHEN recent_failures >= 1 THEN 'recent_ingestion_failures' END, CASE WHEN epoch_us(TIMESTAMP '" + _NOW + "') - epoch_us(oldest_ready) >= 300000000 THEN 'oldest_ready_age_high' END, CASE WHEN retry_wait >= 5 THEN 'retry_wait_backlog' END) AS alerts, CASE WHEN expired_leases >= 1 OR recent_failures >= 1 THEN 'critical' WHEN epoch_us(TIMESTAMP '" + _NOW + "') - epoch_us(oldest_ready) >= 300000000 OR retry_wait >= 5 THEN 'warning' ELSE 'ok' END AS health FROM m")
def _(spark, sf_dir):
    return jobs.queue_metrics(load(spark, sf_dir, "ingestion_jobs"), F.lit(_NOW).cast("timestamp_ntz"))


@_query("o9_newest_jobs", "SELECT job_id, status, created_at FROM ingestion_jobs ORDER BY created_at DESC, job_id LIMIT 100")
def _(spark, sf_dir):
    return load(spark, sf_dir, "ingestion_jobs").select("job_id", "status", "created_at").orderBy(F.col("created_at").desc(), "job_id").limit(100)


@_query("a32_soak_check", "SELECT count(*) AS jobs, bool_and(attempt <= max_attempts) AS within_attempts, count(DISTINCT worker_id) AS workers, count(*) FILTER (WHERE status <> 'running' AND lease_expires_at IS NOT NULL) AS unreleased FROM ingestion_jobs")
def _(spark, sf_dir):
    return load(spark, sf_dir, "ingestion_jobs").agg(F.count(F.lit(1)).alias("jobs"), F.bool_and(F.col("attempt") <= F.col("max_attempts")).alias("within_attempts"), F.countDistinct("worker_id").alias("workers"), F.count_if((F.col("status") != "running") & F.col("lease_expires_at").isNotNull()).alias("unreleased"))


@_query("a17_provenance_ratios", f"WITH {_OBS} SELECT document_id, round(avg(CAST(has_provenance AS INTEGER)), 3) AS provenance_ratio, round(avg(CAST(is_grounded AS INTEGER)), 3) AS grounded_ratio, round(avg(CASE WHEN unit IS NOT NULL OR currency IS NOT NULL THEN 1 ELSE 0 END), 3) AS labelled_ratio FROM obs GROUP BY document_id")
def _(spark, sf_dir):
    def share(condition):
        return F.round(F.avg(condition.cast("int")), 3)

    return _obs(spark, sf_dir).groupBy("document_id").agg(share(F.col("has_provenance")).alias("provenance_ratio"), share(F.col("is_grounded")).alias("grounded_ratio"), share(F.col("unit").isNotNull() | F.col("currency").isNotNull()).alias("labelled_ratio"))


@_query("a19_duplicate_blocks", "WITH n AS (SELECT lang, length(text) > 80 AS long_text, md5(text) AS h, count(*) AS c FROM documents WHERE text IS NOT NULL GROUP BY ALL) SELECT lang, long_text, sum(c)::BIGINT AS texts, sum(CASE WHEN c > 1 THEN c - 1 ELSE 0 END)::BIGINT AS duplicates FROM n GROUP BY lang, long_text")
def _(spark, sf_dir):
    texts = load(spark, sf_dir, "documents").where("text IS NOT NULL").select("lang", (F.length("text") > 80).alias("long_text"), F.md5("text").alias("h"))
    counts = texts.groupBy("lang", "long_text", "h").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("lang", "long_text").agg(F.sum("c").alias("texts"), F.sum(F.when(F.col("c") > 1, F.col("c") - 1).otherwise(0)).alias("duplicates"))


@_query("a25_value_summary", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, n AS events, round(max(value) FILTER (WHERE i = round_even(0.95 * (n - 1), 0)), 6) AS p95 FROM r GROUP BY event_type, n")
def _(spark, sf_dir):
    return facts.nearest_rank(load(spark, sf_dir, "events"), "event_type", "value", 0.95).select("event_type", F.col("n").alias("events"), F.round("ranked", 6).alias("p95"))


@_query("o10_paging", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100")
def _(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", "ts", "event_type").orderBy(F.col("ts").desc(), F.col("event_id").desc()).offset(100).limit(50)


@_query("o11_company_list", "SELECT entity_id, canonical_name, row_number() OVER (ORDER BY lower(canonical_name), entity_id) AS place FROM resolved_entities WHERE canonical_name IS NOT NULL")
def _(spark, sf_dir):
    rows = load(spark, sf_dir, "resolved_entities").where("canonical_name IS NOT NULL").select("entity_id", "canonical_name", F.lower("canonical_name").alias("folded"))
    return facts.global_place(rows, "folded", "entity_id").select("entity_id", "canonical_name", "place")


@_query("s14_segments_in_order", "SELECT segment_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY position, segment_id) AS place FROM langqi_restatement_segments")
def _(spark, sf_dir):
    from pyspark.sql import Window

    return load(spark, sf_dir, "langqi_restatement_segments").select("segment_id", "doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("position", "segment_id")).alias("place"))


_COMPACT = r"regexp_replace(trim(coalesce(content, '')), '\s+', '', 'g')"


@_query("f8_served_segments", rf"SELECT segment_id FROM langqi_restatement_segments WHERE length({_COMPACT}) >= 12 AND NOT (regexp_matches(content, '\.{{3,}}|…{{2,}}') AND length({_COMPACT}) < 40) AND NOT (regexp_matches({_COMPACT}, '^[0-9]{{1,3}}第[一二三四五六七八九十百千零〇0-9]+[章节]') AND length({_COMPACT}) < 40)")
def _(spark, sf_dir):
    return load(spark, sf_dir, "langqi_restatement_segments").where(retrieval.is_served(F.col("content"))).select("segment_id")


@_query("f7_reference_only", rf"SELECT segment_id FROM langqi_restatement_segments WHERE length(regexp_replace(content, '\s+', '', 'g')) <= 80 AND regexp_matches(regexp_replace(content, '\s+', '', 'g'), '参见|详见|请见|见本报告|本报告') AND regexp_matches(regexp_replace(content, '\s+', '', 'g'), '第|章节|部分|中|之') AND NOT regexp_matches(regexp_replace(content, '\s+', '', 'g'), '[0-9]+(\.[0-9]+)?%')")
def _(spark, sf_dir):
    return load(spark, sf_dir, "langqi_restatement_segments").where(retrieval.is_reference_only(F.col("content"))).select("segment_id")


@_query("f9_information", r"SELECT segment_id, length(regexp_replace(coalesce(content, ''), '[^\p{L}\p{N}]+', '', 'g')) >= 12 AS informative FROM langqi_restatement_segments")
def _(spark, sf_dir):
    bare = F.regexp_replace(F.coalesce("content", F.lit("")), r"[^\p{L}\p{N}]+", "")
    return load(spark, sf_dir, "langqi_restatement_segments").select("segment_id", (F.length(bare) >= 12).alias("informative"))


_TOKENS = "regexp_extract_all(lower(coalesce(content, '')), '[a-z0-9]+') || flatten(list_transform(regexp_extract_all(lower(coalesce(content, '')), '[一-鿿]+'), lambda r: CASE WHEN length(r) <= 4 THEN [r] ELSE [r] || list_transform(range(1, length(r)), lambda i: substring(r, CAST(i AS BIGINT), 2)) END))"


@_query("c1_tokens", f"WITH t AS (SELECT segment_id, {_TOKENS} AS t FROM langqi_restatement_segments) SELECT segment_id, len(t) AS tokens, len(list_distinct(t)) AS terms FROM t")
def _(spark, sf_dir):
    tokens = retrieval.tokenize(F.coalesce("content", F.lit("")))
    return load(spark, sf_dir, "langqi_restatement_segments").select("segment_id", F.size(tokens).alias("tokens"), F.size(F.array_distinct(tokens)).alias("terms"))


_TERMS = ["operating", "cash", "flow", "supplier"]


def _bm25_sql() -> str:
    parts = " + ".join(f"CASE WHEN f{i} > 0 THEN f{i} * 2.2 / (f{i} + 1.2 * (1 - 0.75 + 0.75 * n / 500.0)) ELSE 0 END" for i in range(len(_TERMS)))
    counts = ", ".join(f"len(list_filter(t, lambda x: x = '{term}')) AS f{i}" for i, term in enumerate(sorted(_TERMS)))
    return f"WITH t AS (SELECT segment_id, {_TOKENS} AS t FROM langqi_restatement_segments), c AS (SELECT segment_id, len(t) AS n, {counts} FROM t), s AS (SELECT segment_id, round(({parts}) / {len(_TERMS)}, 6) AS score FROM c)"


@_query("c2_bm25_lite", f"{_bm25_sql()} SELECT * FROM s WHERE score > 0")
def _(spark, sf_dir):
    return retrieval.lexical_scores(load(spark, sf_dir, "langqi_restatement_segments"), _TERMS).where("score > 0")


@_query("o2_lexical_top_k", f"{_bm25_sql()} SELECT * FROM s WHERE score > 0 ORDER BY score DESC, segment_id LIMIT 10")
def _(spark, sf_dir):
    return retrieval.lexical_search(load(spark, sf_dir, "langqi_restatement_segments"), _TERMS, 10)


def _neighbours(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return retrieval.vector_search(vectors.where("vec_id % 100 = 0"), vectors, k)


_NEIGHBOURS = "WITH q AS (SELECT vec_id AS query_id, embedding AS probe FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(probe AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM q JOIN embeddings ON query_id <> vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"


@_query("o3_vector_top_k", f"{_NEIGHBOURS} SELECT * FROM r WHERE rank <= 10")
def _(spark, sf_dir):
    return _neighbours(spark, sf_dir)


@_query("a24_ranking_quality", f"{_NEIGHBOURS}, t AS (SELECT query_id, rank, CAST(a.label = b.label AS INTEGER) AS relevant FROM r JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = r.vec_id WHERE rank <= 10), i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevant DESC, rank) AS ideal FROM t), g AS (SELECT query_id, max(relevant) AS hit, coalesce(max(CASE WHEN relevant = 1 THEN 1.0 / rank END), 0) AS rr, sum(relevant / log2(rank + 1)) AS dcg, sum(relevant / log2(ideal + 1)) AS idcg FROM i GROUP BY query_id) SELECT query_id, hit, round(rr, 6) AS mrr, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg FROM g")
def _(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings")
    labels = vectors.select("vec_id", "label")
    judged = _neighbours(spark, sf_dir).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    return retrieval.ranking_quality(judged.withColumn("relevant", (F.col("label") == F.col("wanted")).cast("int")), 10)


@_query("a26_channel_rates", f"{_NEIGHBOURS}, t AS (SELECT query_id, rank, CAST(a.label = b.label AS INTEGER) AS relevant FROM r JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = r.vec_id WHERE rank <= 10), c AS (SELECT query_id, unnest([1, 3, 10]) AS k FROM (SELECT DISTINCT query_id FROM t)), p AS (SELECT c.query_id, c.k, max(relevant) AS passed FROM c JOIN t ON t.query_id = c.query_id AND t.rank <= c.k GROUP BY ALL) SELECT 'top_' || k AS channel, count(*) AS cases, sum(passed)::BIGINT AS passed, round(avg(passed), 4) AS rate FROM p GROUP BY k")
def _(spark, sf_dir):
    """Share of the stated queries that find a vector of their own label, per depth of the channel."""
    labels = load(spark, sf_dir, "embeddings").select("vec_id", "label")
    judged = _neighbours(spark, sf_dir).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    depths = judged.withColumn("relevant", (F.col("label") == F.col("wanted")).cast("int")).select("query_id", "rank", "relevant", F.explode(F.array(F.lit(1), F.lit(3), F.lit(10))).alias("k")).where("rank <= k")
    cases = depths.groupBy("query_id", "k").agg(F.max("relevant").alias("passed"))
    return cases.groupBy("k").agg(F.count(F.lit(1)).alias("cases"), F.sum("passed").alias("passed"), F.round(F.avg("passed"), 4).alias("rate")).select(F.concat(F.lit("top_"), "k").alias("channel"), "cases", "passed", "rate")


@_query("w15_windows", "SELECT segment_id, i AS window_no, substring(content, CAST(i * 700 + 1 AS BIGINT), 800) AS piece FROM langqi_restatement_segments, LATERAL (SELECT unnest(range(0, CAST(ceil(greatest(length(content) - 800, 0) / 700.0) AS BIGINT) + 1)) AS i) WHERE content IS NOT NULL")
def _(spark, sf_dir):
    rows = load(spark, sf_dir, "langqi_restatement_segments").where("content IS NOT NULL")
    return rows.select("segment_id", F.posexplode(retrieval.windows(F.col("content"), 800, 100)).alias("window_no", "piece"))


_FOLDED = r"md5(lower(regexp_replace(content, '\s+', '', 'g')))"


@_query("w5_keep_first", f"SELECT segment_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, {_FOLDED} ORDER BY position, segment_id) AS copy FROM langqi_restatement_segments WHERE content IS NOT NULL) WHERE copy = 1")
def _(spark, sf_dir):
    return retrieval.keep_first(load(spark, sf_dir, "langqi_restatement_segments"), "doc_id", "content", ["position", "segment_id"], ["segment_id", "doc_id"])


@_query("c31_fingerprint", r"SELECT segment_id, sha256(lower(trim(regexp_replace(content, '\s+', ' ', 'g')))) AS fingerprint FROM langqi_restatement_segments WHERE content IS NOT NULL")
def _(spark, sf_dir):
    return load(spark, sf_dir, "langqi_restatement_segments").where("content IS NOT NULL").select("segment_id", retrieval.fingerprint(F.col("content")).alias("fingerprint"))


_EDGES = "e AS (SELECT 'r' || r_regionkey || '-n' || n_nationkey AS edge_id, 'r' || r_regionkey AS source_id, 'n' || n_nationkey AS target_id FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || s_nationkey || '-s' || s_suppkey, 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'n' || c_nationkey || '-c' || c_custkey, 'n' || c_nationkey, 'c' || c_custkey FROM customer)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(table: str, source: str, target: str) -> DataFrame:
        return load(spark, sf_dir, table).select(F.expr(source).alias("source_id"), F.expr(target).alias("target_id"))

    rows = part("nation", "concat('r', n_regionkey)", "concat('n', n_nationkey)").unionByName(part("supplier", "concat('n', s_nationkey)", "concat('s', s_suppkey)")).unionByName(part("customer", "concat('n', c_nationkey)", "concat('c', c_custkey)"))
    return rows.select(F.concat_ws("-", "source_id", "target_id").alias("edge_id"), "source_id", "target_id")


@_query("j14_simple_paths", f"WITH {_EDGES} SELECT edge_id AS path_id, target_id AS last, 1 AS length FROM e UNION ALL SELECT a.edge_id || '::' || b.edge_id, b.target_id, 2 FROM e a JOIN e b ON a.target_id = b.source_id")
def _(spark, sf_dir):
    return graph.simple_paths(_edges(spark, sf_dir)).select("path_id", "last", "length")


_NODES = "n AS (SELECT 'r' || r_regionkey AS node_id, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'c' || c_custkey, c_name FROM customer)"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [load(spark, sf_dir, table).select(F.concat(F.lit(table[0]), key).alias("node_id"), F.col(name).alias("name")) for table, key, name in (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@_query("j13_edges_with_labels", f"WITH {_EDGES}, {_NODES} SELECT edge_id, s.name AS source_name, t.name AS target_name FROM e JOIN n s ON s.node_id = source_id JOIN n t ON t.node_id = target_id")
def _(spark, sf_dir):
    return graph.edges_with_labels(_nodes(spark, sf_dir), _edges(spark, sf_dir)).select("edge_id", "source_name", "target_name")


@_query("a28_graph_quality", "WITH n AS (SELECT DISTINCT doc_id AS node_id FROM parsed_documents UNION SELECT DISTINCT name FROM llm_entities WHERE name IS NOT NULL), e AS (SELECT mention_id AS edge_id, doc_id AS source_id, name AS target_id, evidence FROM llm_entities) SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) - count(DISTINCT node_id) FROM n) AS duplicate_nodes, count(*) AS edges, count(*) - count(DISTINCT edge_id) AS duplicate_edges, count(*) FILTER (WHERE source_id IS NULL OR target_id IS NULL OR source_id NOT IN (SELECT node_id FROM n) OR target_id NOT IN (SELECT node_id FROM n)) AS missing_endpoints, count(*) FILTER (WHERE evidence IS NULL) AS missing_evidence, round(count(evidence) / greatest(count(*), 1), 4) AS grounding FROM e")
def _(spark, sf_dir):
    mentions = load(spark, sf_dir, "llm_entities")
    nodes = load(spark, sf_dir, "parsed_documents").select(F.col("doc_id").alias("node_id")).unionByName(mentions.where("name IS NOT NULL").select(F.col("name").alias("node_id"))).distinct()
    edges = mentions.select(F.col("mention_id").alias("edge_id"), F.col("doc_id").alias("source_id"), F.col("name").alias("target_id"), "evidence")
    return graph.graph_quality(nodes, edges)


@_query("a12_merged_nodes", "SELECT name AS node_id, min(name) AS name, count(DISTINCT doc_id) AS documents, count(DISTINCT year(extracted_at)) AS years FROM llm_entities WHERE name IS NOT NULL GROUP BY name")
def _(spark, sf_dir):
    nodes = load(spark, sf_dir, "llm_entities").where("name IS NOT NULL").select(F.col("name").alias("node_id"), "name", F.col("doc_id").alias("document_id"), F.year("extracted_at").alias("year"))
    return graph.merge_nodes(nodes).withColumn("years", F.size("years").cast("long"))


@_query("g6_verbatim_evidence", "SELECT count(*) FILTER (WHERE contains(evidence, name)) AS kept, count(*) FILTER (WHERE evidence IS NOT NULL AND NOT contains(evidence, name)) AS rejected, count(*) FILTER (WHERE evidence IS NULL) AS missing FROM llm_entities")
def _(spark, sf_dir):
    holds = F.col("evidence").contains(F.col("name"))
    return load(spark, sf_dir, "llm_entities").agg(F.count_if(holds).alias("kept"), F.count_if(F.col("evidence").isNotNull() & ~holds).alias("rejected"), F.count_if(F.col("evidence").isNull()).alias("missing"))


@_query("x1_evidence_union", "SELECT 'V' || segment_id AS evidence_id, 'vector' AS kind, left(content, 1800) AS content FROM langqi_restatement_segments WHERE content IS NOT NULL UNION ALL SELECT 'S' || observation_id, 'sql', metric_key || ' ' || period || ' ' || coalesce(value, '') FROM metric_observations UNION ALL SELECT 'G' || mention_id, 'graph', name FROM llm_entities WHERE name IS NOT NULL")
def _(spark, sf_dir):
    vector = load(spark, sf_dir, "langqi_restatement_segments").where("content IS NOT NULL").select(F.concat(F.lit("V"), "segment_id").alias("evidence_id"), F.lit("vector").alias("kind"), F.substring("content", 1, 1800).alias("content"))
    sql = load(spark, sf_dir, "metric_observations").select(F.concat(F.lit("S"), "observation_id").alias("evidence_id"), F.lit("sql").alias("kind"), F.concat_ws(" ", "metric_key", "period", F.coalesce("value", F.lit(""))).alias("content"))
    named = load(spark, sf_dir, "llm_entities").where("name IS NOT NULL").select(F.concat(F.lit("G"), "mention_id").alias("evidence_id"), F.lit("graph").alias("kind"), F.col("name").alias("content"))
    return vector.unionByName(sql).unionByName(named)


@_query("x3_except", "SELECT DISTINCT metric_key, period FROM metric_observations WHERE unit IS NULL EXCEPT SELECT metric_key, period FROM metric_observations WHERE unit IS NOT NULL")
def _(spark, sf_dir):
    slots = load(spark, sf_dir, "metric_observations")
    return slots.where("unit IS NULL").select("metric_key", "period").subtract(slots.where("unit IS NOT NULL").select("metric_key", "period"))


@_query("a29_evidence_sources", "SELECT source, md5(text) AS text_key, min(doc_id) AS first_doc, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY source, md5(text)")
def _(spark, sf_dir):
    return load(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy("source", F.md5("text").alias("text_key")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))


@_query("t2_lease_replay")
def _(spark, sf_dir):
    # every event of a user is an action on that user's job
    action = F.create_map(*(F.lit(x) for pair in (("signup", "submit"), ("view", "claim"), ("click", "heartbeat"), ("purchase", "succeed"), ("error", "fail")) for x in pair))
    worker = F.concat(F.lit("w"), F.col("event_id") % 3)
    rows = load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), action[F.col("event_type")].alias("action"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at"), worker.alias("worker_id"))
    return jobs.replay(rows)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
