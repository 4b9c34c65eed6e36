"""Queries of the document operators over whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filingloom.operators import classify, documents, facts, nested, retrieval, search, structure, tables
from filingloom.plans.reference_queries import _OBS, _TRUST, _obs, _query
from filingloom.streaming import windows
from filingloom.tables import load

_SEGMENT_PAGES = "s AS (SELECT doc_id, segment_id, metadata.page_start AS lo, metadata.page_end AS hi FROM langqi_restatement_segments)"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "langqi_restatement_segments")


@_query("f1_completed_documents", "SELECT DISTINCT j.doc_id FROM ingestion_jobs j JOIN metric_observations m ON m.document_id = j.doc_id WHERE j.status = 'succeeded' AND m.company <> ''")
def _(spark, sf_dir):
    owned = load(spark, sf_dir, "metric_observations").where("company IS NOT NULL AND company <> ''").select(F.col("document_id").alias("doc_id"))
    return load(spark, sf_dir, "ingestion_jobs").where("status = 'succeeded'").select("doc_id").join(owned, "doc_id", "left_semi").distinct()


@_query("f3_serving_gate", f"WITH {_OBS}, g AS (SELECT document_id, bool_or(has_provenance) AS allow, count(*) FILTER (WHERE is_grounded) AS listed FROM obs GROUP BY 1), l AS (SELECT DISTINCT document_id, concat_ws('::', metric_key, period, coalesce(value, '')) AS k FROM obs WHERE is_grounded) SELECT o.observation_id, o.document_id FROM obs o JOIN g USING (document_id) LEFT JOIN l ON l.document_id = o.document_id AND l.k = concat_ws('::', o.metric_key, o.period, coalesce(o.value, '')) WHERE allow AND (listed = 0 OR l.k IS NOT NULL)")
def _(spark, sf_dir):
    return documents.serving_gate(_obs(spark, sf_dir)).select("observation_id", "document_id")


@_query("f10_noise_blocks", r"WITH c AS (SELECT segment_id, content, regexp_replace(coalesce(content, ''), '\s+', '', 'g') AS k FROM langqi_restatement_segments) SELECT segment_id FROM c WHERE length(k) < 8 OR regexp_full_match(k, '[0-9]{1,4}') OR (length(k) < 40 AND (regexp_matches(content, '\.{3,}|…{2,}') OR regexp_matches(k, '^[0-9]{1,3}第[一二三四五六七八九十百千零〇0-9]+[章节]')))")
def _(spark, sf_dir):
    return _segments(spark, sf_dir).where(retrieval.is_noise(F.col("content"))).select("segment_id")


@_query("j5_narrowest_section", f"WITH {_SEGMENT_PAGES} SELECT t.doc_id, t.id AS item_id, t.page, (SELECT arg_min(segment_id, (hi - lo, segment_id)) FROM s WHERE s.doc_id = t.doc_id AND t.page BETWEEN lo AND hi) AS range_id FROM parsed_tables t")
def _(spark, sf_dir):
    items = load(spark, sf_dir, "parsed_tables").select("doc_id", F.col("id").alias("item_id"), "page")
    ranges = _segments(spark, sf_dir).select("doc_id", F.col("segment_id").alias("range_id"), F.col("metadata.page_start").alias("lo"), F.col("metadata.page_end").alias("hi"))
    return documents.narrowest_range(items, ranges)


@_query("j6_preceding_anchor", f"WITH {_SEGMENT_PAGES} SELECT t.doc_id, t.id AS item_id, t.page, (SELECT arg_max(segment_id, (lo, segment_id)) FROM s WHERE s.doc_id = t.doc_id AND lo <= t.page) AS anchor_id FROM parsed_tables t WHERE t.page IS NOT NULL")
def _(spark, sf_dir):
    items = load(spark, sf_dir, "parsed_tables").where("page IS NOT NULL").select("doc_id", F.col("id").alias("item_id"), "page")
    anchors = _segments(spark, sf_dir).select("doc_id", F.col("segment_id").alias("anchor_id"), F.col("metadata.page_start").alias("page"))
    return documents.preceding_anchor(items, anchors)


@_query("j9_preceding_context", "SELECT a.doc_id, a.segment_id, coalesce((SELECT string_agg(b.segment_id, ',' ORDER BY b.segment_id) FROM langqi_restatement_segments b WHERE b.doc_id = a.doc_id AND b.position BETWEEN a.position - 3 AND a.position - 1), '') AS context FROM langqi_restatement_segments a")
def _(spark, sf_dir):
    return documents.preceding_context(_segments(spark, sf_dir))


_WRITTEN = r"""
t AS (SELECT id, coalesce(raw_markdown, '') || chr(10) || array_to_string(coalesce(headers, []), ' ') || CASE WHEN len(rows) > 0 THEN chr(10) || array_to_string(list_transform(rows, lambda r: array_to_string(r, ' ')), chr(10)) ELSE '' END AS text FROM parsed_tables),
m AS (SELECT observation_id, document_id, source_table_id, value, CASE WHEN regexp_full_match(trim(value), '[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?') THEN TRY_CAST(trim(value) AS DOUBLE) END AS num FROM metric_observations WHERE value IS NOT NULL),
w AS (SELECT observation_id, document_id, len(list_filter(CASE WHEN num IS NULL THEN (CASE WHEN trim(value) <> '' THEN [trim(value)] ELSE [] END) WHEN floor(abs(num)) = abs(num) THEN [format('{:.0f}', abs(num)), format('{:,.0f}', abs(num)), format('{:,.2f}', abs(num)), format('{:.2f}', abs(num))] ELSE [regexp_replace(regexp_replace(format('{:.4f}', abs(num)), '(\.[0-9]*?)0+$', '\1'), '\.$', ''), regexp_replace(regexp_replace(format('{:,.4f}', abs(num)), '(\.[0-9]*?)0+$', '\1'), '\.$', '')] END, lambda v: contains(text, v) OR contains(regexp_replace(text, '[,\s]', '', 'g'), v))) > 0 AS found FROM m JOIN t ON source_table_id = t.id)
"""


def _bound(spark, sf_dir):
    sources = load(spark, sf_dir, "parsed_tables")
    return documents.bind_tables(load(spark, sf_dir, "metric_observations"), sources, tables.period_values(sources))


@_query("j12_table_binding", f"WITH {_WRITTEN} SELECT observation_id, found FROM w")
def _(spark, sf_dir):
    return _bound(spark, sf_dir).select("observation_id", F.col("written").alias("found"))


@_query("j12_binding_tiers")
def _(spark, sf_dir):
    return _bound(spark, sf_dir).drop("written")


@_query("a21_grounding_rates", f"WITH {_WRITTEN} SELECT document_id, count(*) AS facts, round(avg(found::INTEGER), 4) AS table_grounding FROM w GROUP BY 1")
def _(spark, sf_dir):
    bound = _bound(spark, sf_dir).join(load(spark, sf_dir, "metric_observations").select("observation_id", "document_id"), "observation_id")
    return bound.groupBy("document_id").agg(F.count(F.lit(1)).alias("facts"), F.round(F.avg(F.col("written").cast("int")), 4).alias("table_grounding"))


@_query("a14_metrics_index", "SELECT document_id, metric_key, period, arg_max(coalesce(value, ''), observation_id) AS value FROM metric_observations GROUP BY 1, 2, 3")
def _(spark, sf_dir):
    return load(spark, sf_dir, "metric_observations").groupBy("document_id", "metric_key", "period").agg(F.max_by(F.coalesce("value", F.lit("")), "observation_id").alias("value"))


@_query("a15_reporting_periods", "SELECT document_id, string_agg(period, ',' ORDER BY first_seen, period) AS periods FROM (SELECT document_id, period, min(observation_id) AS first_seen FROM metric_observations GROUP BY 1, 2) GROUP BY 1")
def _(spark, sf_dir):
    first = load(spark, sf_dir, "metric_observations").groupBy("document_id", "period").agg(F.min("observation_id").alias("first_seen"))
    return first.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_seen", "period"))), lambda s: s["period"]), ",").alias("periods"))


@_query("a13_statement_tables", "SELECT doc_id, table_type, title, count(*) AS tables, min(page) AS first_page, max(page) AS last_page FROM parsed_tables WHERE len(rows) > 0 GROUP BY 1, 2, 3")
def _(spark, sf_dir):
    return load(spark, sf_dir, "parsed_tables").where(F.size("rows") > 0).groupBy("doc_id", "table_type", "title").agg(F.count(F.lit(1)).alias("tables"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


@_query("a18_stage_scorecard", "SELECT document_type, count(*) AS segments, count(*) FILTER (WHERE length(content) < 40) AS tiny, round(count(*) FILTER (WHERE length(content) < 40) / count(*), 4) AS tiny_ratio, max(length(content)) AS longest, count(DISTINCT doc_id) AS documents FROM langqi_restatement_segments GROUP BY 1")
def _(spark, sf_dir):
    tiny = F.count_if(F.length("content") < 40)
    return _segments(spark, sf_dir).groupBy("document_type").agg(F.count(F.lit(1)).alias("segments"), tiny.alias("tiny"), F.round(tiny / F.count(F.lit(1)), 4).alias("tiny_ratio"), F.max(F.length("content")).alias("longest"), F.countDistinct("doc_id").alias("documents"))


@_query("a20_scorecard_diff", f"WITH {_OBS}, s AS (SELECT metric_key, document_year >= 2015 AS late, count(*) AS n, avg(is_grounded::INTEGER) AS grounded, avg(has_provenance::INTEGER) AS provenance FROM obs WHERE document_year IS NOT NULL AND metric_key IS NOT NULL GROUP BY ALL), p AS (SELECT metric_key, max(CASE WHEN NOT late THEN grounded END) AS g0, max(CASE WHEN late THEN grounded END) AS g1, max(CASE WHEN NOT late THEN provenance END) AS p0, max(CASE WHEN late THEN provenance END) AS p1 FROM s GROUP BY 1), u AS (SELECT metric_key, 'grounded' AS score, g0 AS baseline, g1 AS current FROM p UNION ALL SELECT metric_key, 'provenance', p0, p1 FROM p) SELECT metric_key, score, round(baseline, 6) AS baseline, round(current, 6) AS current, round(current - baseline, 6) AS delta, CASE WHEN baseline IS NULL OR current IS NULL THEN 'missing' WHEN current > baseline + 1e-9 THEN 'better' WHEN current < baseline - 1e-9 THEN 'worse' ELSE 'same' END AS verdict FROM u")
def _(spark, sf_dir):
    """Scorecards of the filings before and from 2015 on, per metric."""
    rows = _obs(spark, sf_dir).where("document_year IS NOT NULL AND metric_key IS NOT NULL")
    late = F.col("document_year") >= 2015

    def share(flag, part):
        return F.avg(F.when(part, F.col(flag).cast("int")))

    wide = rows.groupBy("metric_key").agg(*(share(flag, part).alias(f"{name}_{side}") for name, flag in (("grounded", "is_grounded"), ("provenance", "has_provenance")) for side, part in (("a", ~late), ("b", late))))
    long = wide.select("metric_key", F.explode(F.array(*(F.struct(F.lit(n).alias("score"), F.col(f"{n}_a").alias("baseline"), F.col(f"{n}_b").alias("current")) for n in ("grounded", "provenance")))).alias("s")).select("metric_key", "s.*")
    verdict = F.when(F.col("baseline").isNull() | F.col("current").isNull(), "missing").when(F.col("current") > F.col("baseline") + 1e-9, "better").when(F.col("current") < F.col("baseline") - 1e-9, "worse").otherwise("same")
    return long.select("metric_key", "score", F.round("baseline", 6).alias("baseline"), F.round("current", 6).alias("current"), F.round(F.col("current") - F.col("baseline"), 6).alias("delta"), verdict.alias("verdict"))


_PLAUSIBLE = r"""(period IN ('current_period', 'prior_period') OR coalesce((regexp_matches(lower(period), 'january|february|march|april|may|june|july|august|september|october|november|december') OR regexp_full_match(period, '(19|20)[0-9]{2}')) AND TRY_CAST(regexp_extract(period, '(?:19|20)[0-9]{2}') AS INTEGER) BETWEEN 2000 AND 2035 AND (document_year IS NULL OR TRY_CAST(regexp_extract(period, '(?:19|20)[0-9]{2}') AS INTEGER) BETWEEN document_year - 5 AND document_year + 1), false))"""


@_query("f14_plausible_periods", f"SELECT observation_id, {_PLAUSIBLE} AS plausible FROM metric_observations WHERE period IS NOT NULL")
def _(spark, sf_dir):
    return load(spark, sf_dir, "metric_observations").where("period IS NOT NULL").select("observation_id", structure.plausible_period(F.col("period"), F.col("document_year")).alias("plausible"))


@_query("a22_gate_failures", f"WITH {_OBS}, d AS (SELECT document_id, max(nullif(company, '')) AS company, max(document_year) AS y, avg(is_grounded::INTEGER) AS g, avg((NOT {_PLAUSIBLE})::INTEGER) AS i FROM obs GROUP BY 1) SELECT document_id, concat_ws(',', CASE WHEN company IS NULL THEN 'missing_company' END, CASE WHEN y IS NULL THEN 'missing_year' END, CASE WHEN g < 0.95 - 1e-9 THEN 'source_grounding_rate' END, CASE WHEN i > 1e-9 THEN 'implausible_period_ratio' END) AS failures, company IS NOT NULL AND y IS NOT NULL AND g >= 0.95 - 1e-9 AND coalesce(i, 0) <= 1e-9 AS allow FROM d")
def _(spark, sf_dir):
    return documents.gate_failures(_obs(spark, sf_dir).withColumn("plausible", structure.plausible_period(F.col("period"), F.col("document_year"))))


@_query("a27_case_tolerance", f"WITH {_OBS}, p AS (SELECT document_id, metric_key, period, min(number) AS expected, max(number) AS answer, count(*) AS n FROM obs WHERE number IS NOT NULL GROUP BY 1, 2, 3) SELECT document_id, metric_key, period, abs(answer - expected) <= greatest(1, 0.001 * abs(expected)) AS passed FROM p WHERE n >= 2")
def _(spark, sf_dir):
    pairs = _obs(spark, sf_dir).where("number IS NOT NULL").groupBy("document_id", "metric_key", "period").agg(F.min("number").alias("expected"), F.max("number").alias("answer"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return pairs.select("document_id", "metric_key", "period", (F.abs(F.col("answer") - F.col("expected")) <= F.greatest(F.lit(1.0), 0.001 * F.abs("expected"))).alias("passed"))


@_query("a30_character_error_rate")
def _(spark, sf_dir):
    # no SQL: DuckDB counts the edits of bytes, not of characters
    entities = load(spark, sf_dir, "resolved_entities").where("canonical_name IS NOT NULL").select(F.col("entity_id").alias("company_id"), "canonical_name")
    rows = load(spark, sf_dir, "metric_observations").where("company IS NOT NULL").select("observation_id", "company_id", "company").join(entities, "company_id")
    return rows.select("observation_id", documents.character_error_rate(F.col("canonical_name"), F.col("company")).alias("cer"))


@_query("w6_line_cleaning", "WITH l AS (SELECT segment_id, unnest(range(0, len(string_split(content, chr(10))))) AS line_no, trim(unnest(string_split(content, chr(10)))) AS line FROM langqi_restatement_segments WHERE content IS NOT NULL), k AS (SELECT *, lag(line) OVER (PARTITION BY segment_id ORDER BY line_no) AS previous FROM l WHERE line <> '') SELECT segment_id, count(*) AS kept_lines, sum(length(line))::BIGINT AS characters FROM k WHERE previous IS NULL OR previous <> line GROUP BY 1")
def _(spark, sf_dir):
    return documents.fold_lines(_segments(spark, sf_dir)).groupBy("segment_id").agg(F.count(F.lit(1)).alias("kept_lines"), F.sum(F.length("line")).alias("characters"))


@_query("w14_repeated_margins", "WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM langqi_restatement_segments WHERE content IS NOT NULL), e AS (SELECT doc_id, unnest(list_distinct([lines[1], lines[-1]])) AS line FROM l) SELECT doc_id, line, count(*) AS times FROM e WHERE line IS NOT NULL AND length(line) <= 80 GROUP BY 1, 2 HAVING count(*) >= 2")
def _(spark, sf_dir):
    return documents.repeated_margins(_segments(spark, sf_dir).where("content IS NOT NULL"))


@_query("w12_inherited_units", "SELECT id, doc_id, last_value(unit IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY table_index, id ROWS UNBOUNDED PRECEDING) AS unit FROM parsed_tables")
def _(spark, sf_dir):
    order = Window.partitionBy("doc_id").orderBy("table_index", "id").rowsBetween(Window.unboundedPreceding, 0)
    return load(spark, sf_dir, "parsed_tables").select("id", "doc_id", F.last("unit", ignorenulls=True).over(order).alias("unit"))


@_query("w8_islands", "WITH o AS (SELECT doc_id, segment_id, position, CAST(length(content) < 60 AS INTEGER) AS is_anchor FROM langqi_restatement_segments WHERE content IS NOT NULL) SELECT doc_id, segment_id, sum(is_anchor) OVER (PARTITION BY doc_id ORDER BY position, segment_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM o")
def _(spark, sf_dir):
    order = Window.partitionBy("doc_id").orderBy("position", "segment_id").rowsBetween(Window.unboundedPreceding, 0)
    return _segments(spark, sf_dir).where("content IS NOT NULL").select("doc_id", "segment_id", F.sum((F.length("content") < 60).cast("int")).over(order).alias("island"))


@_query("o13_primary_table", "SELECT doc_id, table_type, id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, table_type ORDER BY (lower(coalesce(title, '')) LIKE 'consolidated%' OR title LIKE '合并%') DESC, len(rows) DESC, id) AS place FROM parsed_tables WHERE table_type IS NOT NULL) WHERE place = 1")
def _(spark, sf_dir):
    tables = load(spark, sf_dir, "parsed_tables").where("table_type IS NOT NULL")
    good = F.lower(F.coalesce("title", F.lit(""))).startswith("consolidated") | F.coalesce(F.col("title").startswith("合并"), F.lit(False))
    order = Window.partitionBy("doc_id", "table_type").orderBy(good.desc(), F.coalesce(F.size("rows"), F.lit(-1)).desc(), "id")
    return tables.withColumn("place", F.row_number().over(order)).where("place = 1").select("doc_id", "table_type", "id")


@_query("o14_nearest_periods", f"WITH {_OBS}, y AS (SELECT DISTINCT document_id, document_year, year FROM obs WHERE year IS NOT NULL AND document_year IS NOT NULL) SELECT document_id, document_year, year FROM (SELECT *, row_number() OVER (PARTITION BY document_id, document_year ORDER BY abs(year - document_year), year DESC) AS place FROM y) WHERE place <= 4")
def _(spark, sf_dir):
    years = _obs(spark, sf_dir).where("year IS NOT NULL AND document_year IS NOT NULL").select("document_id", "document_year", "year").distinct()
    order = Window.partitionBy("document_id", "document_year").orderBy(F.abs(F.col("year") - F.col("document_year")), F.col("year").desc())
    return years.withColumn("place", F.row_number().over(order)).where("place <= 4").drop("place")


@_query("o8_channel_heads", "WITH u AS (SELECT document_type AS channel, segment_id AS id, length(content) AS score FROM langqi_restatement_segments WHERE content IS NOT NULL) SELECT channel, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY score DESC, id) AS rank FROM u) WHERE rank <= 3")
def _(spark, sf_dir):
    rows = _segments(spark, sf_dir).where("content IS NOT NULL").select(F.col("document_type").alias("channel"), F.col("segment_id").alias("id"), F.length("content").alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("channel").orderBy(F.col("score").desc(), "id"))).where("rank <= 3").select("channel", "id", "rank")


@_query("x4_missing_metrics", "SELECT document_id, array_to_string(list_sort(list_filter(['cash', 'equity', 'net_income', 'revenue'], lambda k: NOT list_contains(list(DISTINCT metric_key), k))), ',') AS missing FROM metric_observations GROUP BY 1")
def _(spark, sf_dir):
    required = F.array(*(F.lit(k) for k in ("cash", "equity", "net_income", "revenue")))
    return load(spark, sf_dir, "metric_observations").groupBy("document_id").agg(F.collect_set("metric_key").alias("keys")).select("document_id", F.array_join(F.array_except(required, "keys"), ",").alias("missing"))


@_query("x6_exact_copies", r"SELECT segment_id FROM (SELECT segment_id, row_number() OVER (PARTITION BY md5(lower(regexp_replace(content, '\s+', '', 'g'))) ORDER BY length(content) DESC, segment_id) AS copy FROM langqi_restatement_segments WHERE content IS NOT NULL) WHERE copy = 1")
def _(spark, sf_dir):
    copies = _segments(spark, sf_dir).where("content IS NOT NULL").groupBy(F.md5(F.lower(F.regexp_replace("content", r"\s+", ""))).alias("k"))
    return copies.agg(F.min(F.struct((-F.length("content")).alias("shorter"), "segment_id")).alias("first")).select("first.segment_id")


@_query("c28_dedupe_key", r"SELECT segment_id, md5(regexp_replace(regexp_replace(lower(trim(content)), '\s+', '', 'g'), '[0-9]+', '#', 'g')) AS k FROM langqi_restatement_segments WHERE content IS NOT NULL")
def _(spark, sf_dir):
    return _segments(spark, sf_dir).where("content IS NOT NULL").select("segment_id", F.md5(documents.dedupe_key(F.col("content"))).alias("k"))


@_query("c33_markdown_row", "SELECT id, '| ' || array_to_string(headers, ' | ') || ' |' AS header_line FROM parsed_tables WHERE headers IS NOT NULL")
def _(spark, sf_dir):
    return load(spark, sf_dir, "parsed_tables").where("headers IS NOT NULL").select("id", F.concat(F.lit("| "), F.array_join("headers", " | "), F.lit(" |")).alias("header_line"))


@_query("g1_graph_nodes", "SELECT node_type, name, substring(sha256(node_type || chr(31) || name), 1, 24) AS node_id FROM (SELECT DISTINCT 'company' AS node_type, company_id AS name FROM metric_observations UNION SELECT DISTINCT 'document', document_id FROM metric_observations UNION SELECT DISTINCT 'metric', metric_key FROM metric_observations) WHERE name IS NOT NULL")
def _(spark, sf_dir):
    return documents.fact_graph(load(spark, sf_dir, "metric_observations"))[0]


@_query("g1_graph_edges", "WITH e AS (SELECT DISTINCT 'HAS_DOCUMENT' AS t, 'company' AS a, company_id AS x, 'document' AS b, document_id AS y FROM metric_observations UNION SELECT DISTINCT 'REPORTS_METRIC', 'document', document_id, 'metric', metric_key FROM metric_observations), i AS (SELECT t, substring(sha256(a || chr(31) || x), 1, 24) AS s, substring(sha256(b || chr(31) || y), 1, 24) AS d FROM e) SELECT t AS relationship_type, s AS source_id, d AS target_id, substring(sha256(t || chr(31) || s || chr(31) || d), 1, 24) AS edge_id FROM i")
def _(spark, sf_dir):
    return documents.fact_graph(load(spark, sf_dir, "metric_observations"))[1]


@_query("g5_risk_findings", "SELECT DISTINCT doc_id, name FROM llm_entities WHERE node_type = 'risk' AND name IS NOT NULL")
def _(spark, sf_dir):
    return load(spark, sf_dir, "llm_entities").where("node_type = 'risk' AND name IS NOT NULL").select("doc_id", "name").distinct()


@_query("h10_covered_pages", "SELECT DISTINCT doc_id, unnest(range(metadata.page_start, metadata.page_end + 1))::INTEGER AS page FROM langqi_restatement_segments WHERE metadata.page_end - metadata.page_start BETWEEN 0 AND 40")
def _(spark, sf_dir):
    spans = _segments(spark, sf_dir).where("metadata.page_end - metadata.page_start BETWEEN 0 AND 40")
    return spans.select("doc_id", F.explode(F.sequence("metadata.page_start", "metadata.page_end")).alias("page")).distinct()


@_query("h30_risk_types", "SELECT doc_id, count(*) AS mentions, count(DISTINCT name) AS risks FROM llm_entities WHERE node_type = 'risk' GROUP BY doc_id")
def _(spark, sf_dir):
    return load(spark, sf_dir, "llm_entities").where("node_type = 'risk'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("name").alias("risks"))


@_query("h38_recall_budget", "WITH r AS (SELECT doc_id, segment_id, sum(length(content)) OVER (PARTITION BY doc_id ORDER BY position, segment_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM langqi_restatement_segments WHERE content IS NOT NULL) SELECT * FROM r WHERE running <= 2000")
def _(spark, sf_dir):
    rows = _segments(spark, sf_dir).where("content IS NOT NULL").select("doc_id", "segment_id", "position", "content")
    return documents.cumulative_budget(rows, "doc_id", ["position", "segment_id"], F.length("content"), 2000).select("doc_id", "segment_id", "running")


@_query("ext_windowed_counts", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    return windows.windowed_counts(load(spark, sf_dir, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@_query("c3_hash_embedding")
def _(spark, sf_dir):
    return _segments(spark, sf_dir).select("segment_id", documents.hash_embedding(F.coalesce("content", F.lit(""))).alias("embedding"))


@_query("r1_hybrid_retrieval")
def _(spark, sf_dir):
    return search.hybrid_retrieve(_segments(spark, sf_dir), _QUESTION, k=10)


@_query("c29_paragraph_packing")
def _(spark, sf_dir):
    return _segments(spark, sf_dir).where("content IS NOT NULL").select("segment_id", F.posexplode(documents.pack_paragraphs(F.col("content"))).alias("chunk_no", "chunk"))


@_query("r15_statement_metrics", """
WITH d AS (SELECT doc_id, CASE WHEN json_type(j) = 'VARCHAR' THEN TRY_CAST(json_extract_string(j, '$') AS JSON) ELSE j END AS o FROM (SELECT doc_id, TRY_CAST(payload AS JSON) AS j FROM parsed_documents)),
f AS (SELECT doc_id, CASE WHEN json_type(v) = 'VARCHAR' THEN TRY_CAST(json_extract_string(v, '$') AS JSON) ELSE v END AS f FROM (SELECT doc_id, coalesce(json_extract(o, '$.financial_schema'), json_extract(o, '$.financialSchema')) AS v FROM d)),
s AS (SELECT doc_id, CASE json_type(s) WHEN 'OBJECT' THEN json_array(s) WHEN 'ARRAY' THEN s END AS s FROM (SELECT doc_id, CASE WHEN json_type(s0) = 'VARCHAR' THEN TRY_CAST(json_extract_string(s0, '$') AS JSON) ELSE s0 END AS s FROM (SELECT doc_id, json_extract(f, '$.statements') AS s0 FROM f))),
e AS (SELECT doc_id, s->i AS e FROM (SELECT doc_id, s, unnest(range(CAST(json_array_length(s) AS BIGINT))) AS i FROM s)),
k AS (SELECT doc_id, coalesce(json_extract_string(e, '$.table_id'), json_extract_string(e, '$.tableId')) AS table_id, coalesce(json_extract_string(e, '$.statement_type'), json_extract_string(e, '$.statementType')) AS statement_type, m, unnest(json_keys(m)) AS metric_key FROM (SELECT doc_id, e, json_extract(e, '$.metrics') AS m FROM e WHERE json_type(e) = 'OBJECT') WHERE json_type(m) = 'OBJECT'),
p AS (SELECT doc_id, table_id, statement_type, metric_key, v, unnest(json_keys(v)) AS period FROM (SELECT *, json_extract(m, '$."' || metric_key || '"') AS v FROM k) WHERE json_type(v) = 'OBJECT')
SELECT doc_id, table_id, statement_type, metric_key, period, TRY_CAST(json_extract_string(v, '$."' || period || '"') AS DOUBLE) AS value FROM p""")
def _(spark, sf_dir):
    """Metric rows of the statements: the nested map of metric and period, one row each."""
    target = nested.Target("statement_metrics", (nested.into("financial_schema"), nested.each("statements")), (("table_id", "string"), ("statement_type", "string"), ("metrics", "map<string,map<string,string>>")))
    rows = nested.flat_table(load(spark, sf_dir, "parsed_documents"), "doc_id", nested.payload_object("payload"), target)
    keyed = rows.select(F.col("root_key").alias("doc_id"), "table_id", "statement_type", F.explode("metrics").alias("metric_key", "periods"))
    return keyed.select("doc_id", "table_id", "statement_type", "metric_key", F.explode("periods").alias("period", "value")).withColumn("value", F.col("value").try_cast("double"))


def _metric_case() -> str:
    parts = []
    for statement, metrics in tables.METRIC_ALIASES.items():
        spelled = sorted(((a, m) for m, aliases in metrics.items() for a in aliases), key=lambda s: -len(s[0]))
        quote = "''"
        whens = " ".join(f"WHEN contains(lower(label), '{a.replace(chr(39), quote)}') THEN '{m}'" for a, m in spelled)
        parts.append(f"WHEN starts_with(table_type, '{statement}') THEN CASE {whens} END")
    return f"CASE {' '.join(parts)} END"


@_query("c19_row_metrics", f"WITH r AS (SELECT id, table_type, unnest(range(0, len(rows)))::INTEGER AS row_no, unnest(rows)[1] AS label FROM parsed_tables WHERE table_type IS NOT NULL), m AS (SELECT id, row_no, label, {_metric_case()} AS metric_key FROM r) SELECT * FROM m WHERE metric_key IS NOT NULL")
def _(spark, sf_dir):
    return tables.row_metrics(load(spark, sf_dir, "parsed_tables"))


def _mark_case(marks) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(t, '{w}')" for w in words) + f" THEN '{name}'" for name, words in marks) + " END"


@_query("c21_unit_labels", f"WITH x AS (SELECT id, lower(concat_ws(' ', title, raw_markdown)) AS t FROM parsed_tables) SELECT id, {_mark_case(tables.UNIT_MARKS)} AS unit_label, {_mark_case(tables.CURRENCY_MARKS)} AS currency_label FROM x")
def _(spark, sf_dir):
    return tables.unit_labels(load(spark, sf_dir, "parsed_tables"))


@_query("h13_period_values")
def _(spark, sf_dir):
    return tables.period_values(load(spark, sf_dir, "parsed_tables"))


@_query("w10_coalesced_segments")
def _(spark, sf_dir):
    rows = _segments(spark, sf_dir).where("content IS NOT NULL AND position IS NOT NULL").select("doc_id", "position", F.col("metadata.section_type").alias("parent_id"), F.col("metadata.page_start").alias("page"), "content")
    return tables.coalesce_short(rows)


@_query("c10_period_tokens", r"WITH h AS (SELECT id, unnest(range(0, len(headers))) AS i, unnest(headers) AS h FROM parsed_tables WHERE headers IS NOT NULL), t AS (SELECT id, i, CASE WHEN len(regexp_extract_all(h, '(?i)\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+[0-9]{1,2},\s+[0-9]{4}\b')) > 0 THEN list_transform(regexp_extract_all(h, '(?i)\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+[0-9]{1,2},\s+[0-9]{4}\b'), lambda d: trim(regexp_replace(d, '\s+', ' ', 'g'))) WHEN len(regexp_extract_all(h, '(20[0-9]{2}|19[0-9]{2})\s*年\s*[0-9]{1,2}\s*月\s*[0-9]{1,2}\s*日')) > 0 THEN regexp_extract_all(h, '(20[0-9]{2}|19[0-9]{2})\s*年\s*[0-9]{1,2}\s*月\s*[0-9]{1,2}\s*日', 1) ELSE regexp_extract_all(h, '(?:^|[^0-9])((?:20|19)[0-9]{2})(?:$|[^0-9])', 1) END AS p FROM h WHERE h IS NOT NULL) SELECT DISTINCT id, i::INTEGER AS header_no, unnest(p) AS period FROM t")
def _(spark, sf_dir):
    cells = load(spark, sf_dir, "parsed_tables").select("id", F.posexplode("headers").alias("header_no", "h")).where("h IS NOT NULL")
    return cells.select("id", "header_no", F.explode(structure.period_tokens(F.col("h"))).alias("period"))


@_query("c18_row_labels", r"WITH l AS (SELECT id, unnest(range(0, len(rows)))::INTEGER AS row_no, unnest(rows)[1] AS label FROM parsed_tables), n AS (SELECT *, trim(regexp_replace(translate(lower(label), '’“”–', '''\"\"-'), '\s+', ' ', 'g')) AS t FROM l WHERE label IS NOT NULL) SELECT id, row_no, trim(regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\([^)]*\)', ' ', 'g'), '\b(notes?|footnotes?)\b', ' ', 'g'), '\bsee\b.*$', ' ', 'g'), '^[a-z]\.\s+', ''), 'less:', ' '), 'add:', ' '), '[*†]+', ' ', 'g'), '\s+', ' ', 'g')) AS label FROM n".replace('\\"', '"'))
def _(spark, sf_dir):
    rows = load(spark, sf_dir, "parsed_tables").select("id", F.posexplode("rows").alias("row_no", "r")).select("id", "row_no", F.get("r", F.lit(0)).alias("l"))
    return rows.where("l IS NOT NULL").select("id", "row_no", structure.row_label(F.col("l")).alias("label"))


@_query("c24_promoted_headers")
def _(spark, sf_dir):
    return structure.promoted_headers(load(spark, sf_dir, "parsed_tables"))


@_query("c25_compact_tables")
def _(spark, sf_dir):
    return structure.compact_tables(load(spark, sf_dir, "parsed_tables"))


@_query("w11_merged_tables")
def _(spark, sf_dir):
    return structure.merged_tables(load(spark, sf_dir, "parsed_tables"))


@_query("c32_company_keys")
def _(spark, sf_dir):
    return structure.company_keys(load(spark, sf_dir, "metric_observations"), "company")


@_query("j17_documents_by_key")
def _(spark, sf_dir):
    """Documents per canonical company: written names that share a key share their documents."""
    obs = load(spark, sf_dir, "metric_observations").where("company IS NOT NULL")
    keys = structure.company_keys(obs, "company")
    return obs.select(F.col("company").alias("name"), "document_id").distinct().join(keys, "name").select("company_id", "document_id").distinct()


@_query("a5_resolved_observations", f"WITH {_OBS}, p AS (SELECT observation_id FROM obs WHERE company_id IS NULL OR coalesce(metric_key, '') = '' OR coalesce(period, '') = ''), r AS (SELECT observation_id, row_number() OVER (PARTITION BY company_id, metric_key, period ORDER BY {_TRUST}) AS place FROM obs WHERE company_id IS NOT NULL AND metric_key <> '' AND period <> '') SELECT observation_id, true AS passed_through FROM p UNION ALL SELECT observation_id, false FROM r WHERE place = 1")
def _(spark, sf_dir):
    """One observation per company, metric and period; those without a key pass unresolved."""
    obs = _obs(spark, sf_dir)
    keyless = F.col("company_id").isNull() | (F.coalesce("metric_key", F.lit("")) == "") | (F.coalesce("period", F.lit("")) == "")
    winners = facts.resolve_conflicts(obs.where(~keyless)).select(F.col("winner_id").alias("observation_id"), F.lit(False).alias("passed_through"))
    return obs.where(keyless).select("observation_id", F.lit(True).alias("passed_through")).unionByName(winners)


_QUESTION = "operating cash flow and supplier concentration"


@_query("c6_score_adjustment", "WITH c AS (SELECT segment_id, coalesce(metadata.section_type, '') AS kind, lower(coalesce(content, '')) AS t FROM langqi_restatement_segments), f AS (SELECT *, contains(t, '营业收入') OR contains(t, '营收') OR contains(t, 'revenue') OR contains(t, '主营业务收入') AS revenue, contains(t, '经营活动产生的现金流量净额') OR contains(t, '经营活动现金流量净额') OR contains(t, '经营现金流') OR contains(t, 'operating cash flow') OR contains(t, 'cash from operating') AS cash, contains(t, '金融资产') OR contains(t, '金融负债') OR contains(t, '合同负债') OR contains(t, '公允价值') OR contains(t, 'fair value') OR contains(t, 'level 3') AS note FROM c) SELECT segment_id, round(CAST(CASE WHEN kind = 'risk_section' THEN 0.15 WHEN kind IN ('financial_statement', 'financial_note') THEN -0.12 ELSE 0 END - CASE WHEN revenue AND NOT cash THEN 0.16 ELSE 0 END - CASE WHEN note AND kind IN ('financial_statement', 'financial_note', '') THEN 0.12 ELSE 0 END AS DOUBLE), 6) AS adjustment FROM f")
def _(spark, sf_dir):
    rows = _segments(spark, sf_dir).withColumn("content", F.coalesce("content", F.lit("")))
    return rows.select("segment_id", F.round(search.score_adjustment(_QUESTION, F.col("metadata.section_type"), F.col("content"), hints=("risk_section",)), 6).alias("adjustment"))


def _filing_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Companies, their filings, and what the filings mention, as nodes and edges."""
    owned = load(spark, sf_dir, "metric_observations").where("company_id IS NOT NULL AND document_id IS NOT NULL").select("company_id", "document_id").distinct()
    mentioned = load(spark, sf_dir, "llm_entities").where("doc_id IS NOT NULL AND name IS NOT NULL").groupBy("doc_id", "name").agg(F.coalesce(F.min("node_type"), F.lit("entity")).alias("node_type"))
    things = mentioned.groupBy("name").agg(F.min("node_type").alias("node_type"))
    empty = F.lit("{}").alias("properties")
    nodes = owned.select(F.concat(F.lit("c:"), "company_id").alias("node_id"), F.lit("company").alias("node_type"), F.col("company_id").alias("name"), empty).distinct()
    nodes = nodes.unionByName(owned.select(F.concat(F.lit("d:"), "document_id").alias("node_id"), F.lit("document").alias("node_type"), F.col("document_id").alias("name"), empty).distinct())
    nodes = nodes.unionByName(things.select(F.concat(F.lit("n:"), "name").alias("node_id"), "node_type", "name", empty))
    edges = owned.select(F.concat_ws("|", F.lit("HAS_DOCUMENT"), "company_id", "document_id").alias("edge_id"), F.concat(F.lit("c:"), "company_id").alias("source_id"), F.concat(F.lit("d:"), "document_id").alias("target_id"), F.lit("HAS_DOCUMENT").alias("relationship_type"))
    kind = F.concat(F.lit("HAS_"), F.upper("node_type"))
    return nodes, edges.unionByName(mentioned.select(F.concat_ws("|", kind, "doc_id", "name").alias("edge_id"), F.concat(F.lit("d:"), "doc_id").alias("source_id"), F.concat(F.lit("n:"), "name").alias("target_id"), kind.alias("relationship_type")))


@_query("g3_graph_search", """
WITH o AS (SELECT DISTINCT company_id, document_id FROM metric_observations WHERE company_id IS NOT NULL AND document_id IS NOT NULL),
m AS (SELECT doc_id, name, coalesce(min(node_type), 'entity') AS node_type FROM llm_entities WHERE doc_id IS NOT NULL AND name IS NOT NULL GROUP BY 1, 2),
th AS (SELECT name, min(node_type) AS node_type FROM m GROUP BY 1),
n AS (SELECT DISTINCT 'c:' || company_id AS node_id, 'company' AS node_type, company_id AS name FROM o UNION ALL SELECT DISTINCT 'd:' || document_id, 'document', document_id FROM o UNION ALL SELECT 'n:' || name, node_type, name FROM th),
e AS (SELECT concat_ws('|', 'HAS_DOCUMENT', company_id, document_id) AS edge_id, 'c:' || company_id AS s, 'd:' || document_id AS t, 'HAS_DOCUMENT' AS k FROM o UNION ALL SELECT concat_ws('|', 'HAS_' || upper(node_type), doc_id, name), 'd:' || doc_id, 'n:' || name, 'HAS_' || upper(node_type) FROM m),
f AS (SELECT e.*, a.name AS an, b.name AS bn, lower(concat_ws(' ', a.name, b.name, k, '{}', '{}')) AS x, CASE WHEN a.node_type = 'risk' OR b.node_type = 'risk' THEN 0.2 + CASE WHEN k = 'HAS_RISK' THEN 0.06 ELSE 0 END ELSE 0 END AS bonus FROM e JOIN n a ON a.node_id = s JOIN n b ON b.node_id = t),
h AS (SELECT *, contains(x, 'risk') AS h1, contains(x, 'supplier') AS h2 FROM f),
p AS (SELECT edge_id AS path_id, an || ' -[' || k || ']-> ' || bn AS summary, h1::INT + h2::INT AS hits, bonus, 1 AS length FROM h
  UNION ALL SELECT a.edge_id || '::' || b.edge_id, a.an || ' -[' || a.k || ']-> ' || a.bn || ' -[' || b.k || ']-> ' || b.bn, (a.h1 OR b.h1)::INT + (a.h2 OR b.h2)::INT, greatest(a.bonus, b.bonus), 2 FROM h a JOIN h b ON a.t = b.s WHERE b.t <> a.s)
SELECT path_id, summary, round(least(1.0, CASE WHEN length = 1 THEN 0.2 + hits / 2 * 0.6 ELSE 0.15 + hits / 2 * 0.5 END + bonus), 4) AS score, length FROM p WHERE hits > 0 OR bonus > 0 ORDER BY score DESC, path_id LIMIT 10""")
def _(spark, sf_dir):
    return search.graph_search(*_filing_graph(spark, sf_dir), "supplier risk", 10)


def _contains_sql(text: str, words) -> str:
    quote = "''"
    return "(" + " OR ".join(f"contains({text}, '{w.replace(chr(39), quote)}')" for w in words) + ")"


def _kind_sql() -> str:
    norm = r"""trim(regexp_replace(translate(lower({}), '’“”–', '''""-'), '\s+', ' ', 'g'))"""
    named = {c: "CASE " + " ".join(f"WHEN {_contains_sql(c, words)} THEN '{kind}'" for kind, words in classify.STATEMENT_TITLES) + " END" for c in ("t", "md")}
    counts = ", ".join("(" + " + ".join(f"contains(c, '{cue}')::INT" for cue in cues) + f") AS n_{kind}" for kind, cues in classify.ROW_CUES.items())
    cells = "array_to_string(list_transform(list_filter(list_slice(coalesce(rows, []), 1, 40), lambda r: len(r) > 0), lambda r: coalesce(r[1], '')), ' ')"
    return f"""
WITH x AS (SELECT id, {norm.format("coalesce(title, '')")} AS t, {norm.format("coalesce(raw_markdown, '')")} AS md, headers, rows FROM parsed_tables),
y AS (SELECT id, t, md, {norm.format(f"concat_ws(' ', t, '', '', array_to_string(coalesce(headers, []), ' '), {cells}, md)")} AS c FROM x), z AS (SELECT *, {counts} FROM y), m AS (SELECT *, greatest(n_balance_sheet, n_income_statement, n_cash_flow) AS most FROM z)
SELECT id, coalesce(CASE WHEN {_contains_sql('t', classify.PROFILE_TITLES)} THEN 'profile_table' WHEN {_contains_sql('t', classify.ANALYSIS_TITLES)} THEN 'analysis_table' WHEN regexp_matches(t, 'notes to|^note\\s+[0-9]+|财务报表附注|^附注\\s*[0-9]+') THEN 'notes_table' WHEN regexp_matches(t, '^item\\s+[0-9]+|^(form 10-k|table of contents|signatures)$') THEN 'other_table' END,
  CASE WHEN n_cash_flow >= 1 AND n_cash_flow >= most THEN 'cash_flow' WHEN most >= 2 AND n_balance_sheet = most THEN 'balance_sheet' WHEN most >= 2 AND n_income_statement = most THEN 'income_statement' END, {named['t']}, {named['md']}, 'notes_table') AS kind FROM m"""


@_query("c20_table_kinds", _kind_sql())
def _(spark, sf_dir):
    return classify.table_kind(load(spark, sf_dir, "parsed_tables"))


@_query("c13_strict_numbers", r"WITH c AS (SELECT id, row_no, unnest(range(0, len(r)))::INTEGER AS cell_no, unnest(r) AS cell FROM (SELECT id, unnest(range(0, len(rows)))::INTEGER AS row_no, unnest(rows) AS r FROM parsed_tables)), n AS (SELECT *, trim(replace(replace(regexp_replace(trim(cell), '[,$%)]', '', 'g'), '(', '-'), '?', '')) AS k FROM c) SELECT id, row_no, cell_no, CAST(k AS DOUBLE) AS number FROM n WHERE regexp_full_match(k, '-?[0-9]+(?:\.[0-9]+)?')")
def _(spark, sf_dir):
    cells = load(spark, sf_dir, "parsed_tables").select("id", F.posexplode("rows").alias("row_no", "r")).select("id", "row_no", F.posexplode("r").alias("cell_no", "cell"))
    return cells.select("id", "row_no", "cell_no", classify.strict_number(F.col("cell")).alias("number")).where("number IS NOT NULL")


@_query("c17_split_rows")
def _(spark, sf_dir):
    return classify.split_rows(load(spark, sf_dir, "parsed_tables"))


_NOTES = "n AS (SELECT doc_id, segment_id AS note_id, metadata.page_start AS s, metadata.page_end AS e FROM langqi_restatement_segments WHERE metadata.section_type = 'financial_note' AND metadata.page_start IS NOT NULL)"


@_query("j7_note_sections", f"WITH {_NOTES}, r AS (SELECT t.doc_id, t.id AS table_id, note_id, CASE WHEN s <= page AND page <= e THEN 1 WHEN s <= page AND page - s <= 8 THEN 2 WHEN s > page AND s - page <= 2 AND lower(trim(coalesce(title, ''))) IN ('', 'notes to consolidated financial statements', 'notes to financial statements') THEN 3 END AS tier, s, e, page FROM parsed_tables t JOIN n USING (doc_id) WHERE page IS NOT NULL) SELECT doc_id, table_id, note_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, table_id ORDER BY tier, CASE tier WHEN 1 THEN e - s WHEN 2 THEN page - s ELSE s - page END, note_id) AS place FROM r WHERE tier IS NOT NULL) WHERE place = 1")
def _(spark, sf_dir):
    notes = _segments(spark, sf_dir).where("metadata.section_type = 'financial_note'").select("doc_id", F.col("segment_id").alias("note_id"), F.col("metadata.page_start").alias("page_start"), F.col("metadata.page_end").alias("page_end"), F.lit(None).cast("int").alias("anchor_order"))
    items = load(spark, sf_dir, "parsed_tables").select("doc_id", F.col("id").alias("table_id"), "page", F.lit(None).cast("int").alias("order"), "title", F.lit(1).alias("blocks_on_page"))
    return classify.note_sections(items, notes)


@_query("j8_statement_sections", "WITH s AS (SELECT doc_id, segment_id, metadata.page_start AS lo, metadata.page_end AS hi FROM langqi_restatement_segments WHERE metadata.section_type = 'financial_statement') SELECT t.doc_id, t.id AS item_id, t.page, (SELECT arg_min(segment_id, (hi - lo, segment_id)) FROM s WHERE s.doc_id = t.doc_id AND t.page BETWEEN lo AND hi) AS range_id FROM parsed_tables t")
def _(spark, sf_dir):
    items = load(spark, sf_dir, "parsed_tables").select("doc_id", F.col("id").alias("item_id"), "page")
    ranges = _segments(spark, sf_dir).where("metadata.section_type = 'financial_statement'").select("doc_id", F.col("segment_id").alias("range_id"), F.col("metadata.page_start").alias("lo"), F.col("metadata.page_end").alias("hi"))
    return documents.narrowest_range(items, ranges)


@_query("w7_without_contents")
def _(spark, sf_dir):
    blocks = nested.payload_table(load(spark, sf_dir, "parsed_documents"), "page_blocks")
    return classify.without_contents(blocks.select(F.col("root_key").alias("doc_id"), "block_id", F.coalesce("order", "list_position").alias("order"), "block_type", "text"))


@_query("a23_document_checks", "WITH d AS (SELECT document_id, count(*) AS facts, count(DISTINCT metric_key) AS metrics, string_agg(DISTINCT metric_key, ',' ORDER BY metric_key) AS names FROM metric_observations GROUP BY 1) SELECT document_id, 'metric_fact_count' AS name, facts >= 20 AS passed FROM d UNION ALL SELECT document_id, 'metric_count', metrics <= 15 FROM d UNION ALL SELECT document_id, 'required_metrics', list_contains(string_split(names, ','), 'revenue') AND list_contains(string_split(names, ','), 'net_income') FROM d")
def _(spark, sf_dir):
    docs = load(spark, sf_dir, "metric_observations").groupBy("document_id").agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("metric_key").alias("metrics"), F.array_join(F.array_sort(F.collect_set("metric_key")), ",").alias("names"))
    rules = (("metric_fact_count", "min", "20", "facts"), ("metric_count", "max", "15", "metrics"), ("required_metrics", "subset", "revenue,net_income", "names"))
    rows = docs.select("document_id", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(r).alias("rule"), F.lit(e).alias("expected"), F.col(a).cast("string").alias("actual")) for n, r, e, a in rules))).alias("c")).select("document_id", "c.*")
    return classify.checks(rows).select("document_id", "name", "passed")


@_query("a31_parse_confidence", "WITH t AS (SELECT doc_id, count(*) AS tables FROM parsed_tables GROUP BY 1), s AS (SELECT doc_id, avg((length(trim(content)) > 0)::INT) AS coverage FROM langqi_restatement_segments GROUP BY 1) SELECT doc_id, CAST(round(greatest(0.2, least(0.84 + least(coalesce(tables, 0), 3) * 0.02 + greatest(coalesce(coverage, 0) - 0.5, 0) * 0.1, 0.98)), 3) AS DOUBLE) AS confidence FROM parsed_documents LEFT JOIN t USING (doc_id) LEFT JOIN s USING (doc_id)")
def _(spark, sf_dir):
    counted = load(spark, sf_dir, "parsed_tables").groupBy("doc_id").agg(F.count(F.lit(1)).alias("tables"))
    covered = _segments(spark, sf_dir).groupBy("doc_id").agg(F.avg((F.length(F.trim("content")) > 0).cast("int")).alias("coverage"))
    rows = load(spark, sf_dir, "parsed_documents").select("doc_id").join(counted, "doc_id", "left").join(covered, "doc_id", "left")
    return rows.select("doc_id", classify.parse_confidence(F.lit("table_pdf"), F.coalesce("coverage", F.lit(0.0)), F.coalesce("tables", F.lit(0)), F.lit(0)).alias("confidence"))


@_query("f6_period_matches", "SELECT observation_id FROM metric_observations WHERE coalesce(period, '') = '2020' OR coalesce(CAST(period_year AS VARCHAR), '') = '2020'")
def _(spark, sf_dir):
    return load(spark, sf_dir, "metric_observations").where(classify.period_matches("2020", F.col("period"), F.col("period_year"))).select("observation_id")


@_query("f5_requested_documents", "WITH w AS (SELECT DISTINCT document_id FROM conflict_candidates WHERE document_id IS NOT NULL) SELECT document_id, document_id IN (SELECT document_id FROM metric_observations WHERE document_id IS NOT NULL) AS found FROM w")
def _(spark, sf_dir):
    """The filings that conflict candidates name, and whether any fact of them is stored."""
    obs, wanted = load(spark, sf_dir, "metric_observations"), load(spark, sf_dir, "conflict_candidates").select("document_id")
    kept, missing = classify.requested(obs, wanted)
    return kept.select("document_id").distinct().withColumn("found", F.lit(True)).unionByName(missing.withColumn("found", F.lit(False)))


@_query("f12_enriched_facts", f"WITH {_OBS} SELECT observation_id, is_grounded AS source_grounded, has_provenance FROM obs")
def _(spark, sf_dir):
    return _obs(spark, sf_dir).select("observation_id", F.col("is_grounded").alias("source_grounded"), "has_provenance")


@_query("f15_segment_payloads", "SELECT segment_id, doc_id AS document_id, position, content, len(coalesce(keywords, []))::INTEGER AS n_keywords, metadata.section_type AS section_type FROM langqi_restatement_segments")
def _(spark, sf_dir):
    """Payloads of the vector store; the text embedded is the content, as segments carry no summary."""
    return _segments(spark, sf_dir).select("segment_id", F.col("doc_id").alias("document_id"), "position", "content", F.size(F.coalesce("keywords", F.array().cast("array<string>"))).alias("n_keywords"), F.col("metadata.section_type").alias("section_type"))


@_query("r5_first_value_growth", f"WITH {_OBS}, p AS (SELECT company_id, metric_key, year, arg_min(number, observation_id) AS value, count(DISTINCT number) - 1 AS rivals FROM obs WHERE number IS NOT NULL AND year IS NOT NULL AND company_id IS NOT NULL GROUP BY 1, 2, 3), l AS (SELECT *, lag(value) OVER (PARTITION BY company_id, metric_key ORDER BY year) AS previous FROM p) SELECT company_id, metric_key, year, value, rivals, CASE WHEN previous <> 0 THEN round((value - previous) / abs(previous), 6) END AS yoy FROM l")
def _(spark, sf_dir):
    return facts.first_value_growth(_obs(spark, sf_dir))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct evidence sentence, read as a question."""
    return load(spark, sf_dir, "llm_entities").where("evidence IS NOT NULL AND trim(evidence) <> ''").select(F.col("evidence").alias("question")).distinct()


@_query("c5_query_expansion")
def _(spark, sf_dir):
    return _questions(spark, sf_dir).select("question", F.posexplode(documents.expand_query(F.col("question"))).alias("seed_no", "seed"))


@_query("c7_question_analysis")
def _(spark, sf_dir):
    return tables.analyze(_questions(spark, sf_dir)).select("question", "intent", F.array_join("routes", ",").alias("routes"), F.array_join("metric_keys", ",").alias("metric_keys"), F.array_join(F.col("years").cast("array<string>"), ",").alias("years"), "needs_growth")


@_query("f16_scope_guard")
def _(spark, sf_dir):
    """Sentences that name a company other than the one with most observations."""
    entities = load(spark, sf_dir, "resolved_entities")
    aliases = entities.select(F.col("entity_id").alias("company_id"), F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias")).where("alias IS NOT NULL").distinct()
    own = load(spark, sf_dir, "metric_observations").where("company_id IS NOT NULL").groupBy("company_id").count().orderBy(F.col("count").desc(), "company_id").first()
    return tables.foreign_company(_questions(spark, sf_dir), aliases, own["company_id"] if own else "")


@_query("c30_keywords")
def _(spark, sf_dir):
    return _segments(spark, sf_dir).where("content IS NOT NULL").select("segment_id", F.array_join(retrieval.keywords(F.col("content")), ",").alias("keywords"))
