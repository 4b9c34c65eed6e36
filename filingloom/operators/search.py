"""Search over segments and graphs: score rules, candidate clearing, hybrid retrieval, scored graph paths."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.operators import documents, graph, retrieval
from filingloom.session import materialise

#: Weights of the score rules and the words they go by.
SECTION_BOOST, SECTION_MISMATCH, METRIC_MISMATCH, HR_NOISE, NOTE_TABLE = 0.15, 0.12, 0.16, 0.14, 0.12
REVENUE_CUES = ("营业收入", "营收", "revenue", "主营业务收入")
CASH_FLOW_CUES = ("经营活动产生的现金流量净额", "经营活动现金流量净额", "经营现金流", "operating cash flow", "cash from operating")
HR_CUES = ("员工培训", "人才梯队", "薪酬", "人力资源", "招聘", "岗位学习")
NOTE_TABLE_CUES = ("金融资产", "金融负债", "合同负债", "公允价值", "fair value", "level 3")
DRIVER_CUES = ("驱动", "增长", "经营情况", "主营业务", "driver")
PROFIT_CUES = ("营业收入", "营收", "revenue", "毛利")
RISK_CUES = ("风险", "risk")


def _any(text: Column, cues: Sequence[str]) -> Column:
    hit = F.lit(False)
    for cue in cues:
        hit = hit | F.contains(text, F.lit(cue))
    return hit


def score_adjustment(question: str, section: Column, content: Column, hints: Sequence[str] = (), metrics: Sequence[str] = ()) -> Column:
    """What the question's kind adds to or takes from a segment's score.

    The question is one value, so its rules are decided here; the rest are column expressions.
    """
    asked, text, kind = question.casefold(), F.lower(content), F.coalesce(section, F.lit(""))
    delta = F.lit(0.0)
    if hints:
        wrong = F.lit(0.0)
        if "risk_section" in hints:
            wrong = wrong - F.when(kind.isin("financial_statement", "financial_note"), SECTION_MISMATCH).otherwise(0.0)
        if "management_discussion" in hints:
            wrong = wrong - F.when(kind.isin("audit_report", "financial_note", "company_overview"), SECTION_MISMATCH * 0.75).otherwise(0.0)
        delta = delta + F.when(kind.isin(*hints), SECTION_BOOST).otherwise(wrong)
    cash = "net_cash_from_operating_activities" in metrics or any(c in asked for c in CASH_FLOW_CUES)
    revenue = "revenue" in metrics or any(c in asked for c in REVENUE_CUES[:3])
    if cash != revenue:
        wanted, other = (CASH_FLOW_CUES, REVENUE_CUES) if cash else (REVENUE_CUES, CASH_FLOW_CUES)
        delta = delta - F.when(_any(text, other) & ~_any(text, wanted), METRIC_MISMATCH).otherwise(0.0)
    if any(c in asked for c in DRIVER_CUES):
        delta = delta - F.when(_any(text, HR_CUES) & ~_any(text, PROFIT_CUES), HR_NOISE).otherwise(0.0)
    if "risk_section" in hints or any(c in asked for c in RISK_CUES):
        delta = delta - F.when(_any(text, NOTE_TABLE_CUES) & kind.isin("financial_statement", "financial_note", ""), NOTE_TABLE).otherwise(0.0)
    return delta


def clear_candidates(rows: list[dict], least: int = 120) -> list[dict]:
    """Ranked candidates without texts equal to, within or around a better one (the latter from ``least`` characters on)."""
    kept, seen, long = [], set(), []
    for row in rows:
        text = re.sub(r"\s+", "", row["content"]).casefold()
        if text and text in seen or len(text) >= least and any(text in other or other in text for other in long):
            continue
        seen.add(text)
        if len(text) >= least:
            long.append(text)
        kept.append(row)
    return kept


Reranker = Callable[[str, list[dict]], list[dict]]


def hybrid_retrieve(segments: DataFrame, question: str, k: int = 3, hints: Sequence[str] = (), metrics: Sequence[str] = (), multiplier: int = 4, embedding: str | None = None, rerank: Reranker | None = None) -> DataFrame:
    """The ``k`` best segments for a question: expansion, two channels, merge, score rules, clearing, reranking.

    Every expanded query takes the ``k * multiplier`` best of both channels, so at most eight times as
    many candidates are merged; they alone are cleared and reranked, in one task. ``embedding`` names a
    column with stored vectors; without one the segments are embedded for the call. Where nothing is
    found, the first ``k`` segments in reading order come with the score 0.01.
    """
    spark = segments.sparkSession
    most = max(k, k * multiplier)
    rows = segments.withColumn("content", F.coalesce("content", F.lit("")))
    # made once for all queries of the call
    vectors = rows.select("segment_id", F.col(embedding).alias("embedding")) if embedding else materialise(rows.select("segment_id", documents.hash_embedding(F.col("content")).alias("embedding")))
    tokens = materialise(rows.select("segment_id", retrieval.tokenize(F.col("content")).alias("tokens")))
    probe = spark.range(1).select(F.explode(documents.expand_query(F.lit(question))).alias("q")).select("q", retrieval.tokenize(F.col("q")).alias("terms"), documents.hash_embedding(F.col("q")).alias("probe"))
    seeds = probe.toPandas()  # at most four rows
    block = pd.DataFrame({"query_id": [f"\u0001{i}" for i in range(len(seeds))], "embedding": seeds["probe"]})
    vector = retrieval.best_of_block(retrieval.block_search(vectors.withColumnRenamed("segment_id", "vec_id"), block, most), most).where("score > 0")
    hits = vector.select(F.col("vec_id").alias("segment_id"), F.col("score").alias("v"), F.lit(0.0).alias("l"))
    for query in seeds.itertuples():
        lexical = tokens.select("segment_id", F.round(retrieval.bm25_lite(F.col("tokens"), list(query.terms)), 6).alias("score")).where("score > 0").orderBy(F.col("score").desc(), "segment_id").limit(most)
        hits = hits.unionByName(lexical.select("segment_id", F.lit(0.0).alias("v"), F.col("score").alias("l")))
    merged = hits.groupBy("segment_id").agg((retrieval.VECTOR_WEIGHT * F.max("v") + retrieval.LEXICAL_WEIGHT * F.max("l")).alias("merged"))
    found = rows.join(F.broadcast(merged), "segment_id")  # at most eight times `most` rows
    section = F.col("metadata.section_type") if "metadata" in rows.columns else F.lit(None).cast("string")
    scored = found.select("segment_id", "content", F.round(F.col("merged") + score_adjustment(question, section, F.col("content"), hints, metrics), 6).alias("score"))
    scored = scored.where(~retrieval.is_reference_only(F.col("content"))).select("*", F.length("content").alias("size"))

    def clear(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            ranked = pd.concat(parts).sort_values(["score", "size", "segment_id"], ascending=[False, False, True]).to_dict("records")
            kept = clear_candidates(ranked)
            kept = (rerank(question, kept) if rerank else kept)[:k]
            yield pd.DataFrame([(r["segment_id"], r["score"], i + 1) for i, r in enumerate(kept)], columns=["segment_id", "score", "rank"])

    best = scored.coalesce(1).mapInPandas(clear, "segment_id string, score double, rank int")
    order = ["position", "segment_id"] if "position" in rows.columns else ["segment_id"]
    first = rows.orderBy(*order).limit(k).select("segment_id", F.lit(0.01).alias("score"), F.lit(0).alias("rank"))
    none = best.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(True).alias("none"))  # one row or none
    return best.unionByName(first.join(F.broadcast(none)).drop("none"))


#: Words of a query, the node or edge type they call for, and the bonus; the first that holds counts.
TYPE_BONUSES = (
    (("risk", "风险"), "node", "risk", 0.2), (("metric", "revenue", "指标", "营收", "利润"), "node", "metric", 0.2), (("relationship", "related", "关系", "关联"), "any", "", 0.15), (("subsidiary", "子公司"), "node", "subsidiary", 0.25),
    (("industry", "行业"), "node", "industry", 0.25), (("segment", "business unit", "业务板块", "分部"), "node", "business_segment", 0.25), (("competitor", "competition", "竞争对手", "竞争"), "edge", "COMPETES_WITH", 0.25),
)
HAS_RISK_BONUS = 0.06


def query_terms(query: str) -> list[str]:
    folded = query.casefold()
    return sorted(set(re.findall(r"[a-z0-9_]{2,}", folded)) | set(re.findall(r"[一-鿿]{2,}", folded)))


def _bonus(query: str, kind: Column, source: Column, target: Column) -> Column:
    asked, out = query.casefold(), F.lit(0.0)
    for words, side, wanted, bonus in reversed(TYPE_BONUSES):
        if not any(w in asked for w in words):
            continue
        if side == "node":
            value = F.lit(bonus) + (F.when(kind == "HAS_RISK", HAS_RISK_BONUS).otherwise(0.0) if wanted == "risk" else F.lit(0.0))
            out = F.when(F.coalesce((source == wanted) | (target == wanted), F.lit(False)), value).otherwise(out)
        else:
            out = F.when(F.coalesce(kind != "" if side == "any" else kind == wanted, F.lit(False)), bonus).otherwise(out)
    return out


def graph_search(nodes: DataFrame, edges: DataFrame, query: str, k: int = 10, longest: int = 3) -> DataFrame:
    """``(path_id, summary, score, length)``: the ``k`` best directed paths of one to ``longest`` edges.

    ``nodes (node_id, node_type, name, properties)`` and ``edges (edge_id, source_id, target_id, relationship_type)`` are
    those of the scope: a document's or a company's. An edge scores by the query's terms in its names,
    type and properties and by the bonus its types earn; a longer path by the terms in all its edges
    and its best bonus. Without a term and a bonus a path does not count; edges whose ends do not both
    exist never do.
    """
    terms = query_terms(query)
    ends = nodes.select("node_id", F.struct("node_type", "name", F.coalesce("properties", F.lit("{}")).alias("properties")).alias("node"))
    full = edges.join(ends.select(F.col("node_id").alias("source_id"), F.col("node").alias("s")), "source_id").join(ends.select(F.col("node_id").alias("target_id"), F.col("node").alias("t")), "target_id")
    text = F.lower(F.concat_ws(" ", "s.name", "t.name", "relationship_type", "s.properties", "t.properties"))
    # of an edge the longer paths need the terms found, the bonus and the names
    hits = F.array(*(F.contains(text, F.lit(t)) for t in terms)) if terms else F.array().cast("array<boolean>")
    step = full.select("edge_id", "source_id", "target_id", hits.alias("hits"), _bonus(query, F.col("relationship_type"), F.col("s.node_type"), F.col("t.node_type")).alias("bonus"), F.col("s.name").alias("from_name"), F.concat(F.lit(" -["), "relationship_type", F.lit("]-> "), "t.name").alias("arrow"))
    level = step.select(F.col("edge_id").alias("path_id"), F.array("source_id", "target_id").alias("nodes"), F.col("target_id").alias("last"), "hits", "bonus", F.concat("from_name", "arrow").alias("summary"), F.lit(1).alias("length"))
    level, paths = level.where(F.get("nodes", F.lit(0)).isNotNull()), None
    for length in range(1, longest + 1):
        paths = level if paths is None else paths.unionByName(level)
        if length < longest:
            more = step.select(F.col("edge_id").alias("e"), F.col("source_id").alias("last"), F.col("target_id").alias("next"), F.col("hits").alias("h"), F.col("bonus").alias("b"), "arrow")
            grown = level.where(F.get("nodes", F.lit(0)) != F.get("nodes", F.lit(1))).join(more, "last").where(~F.array_contains("nodes", F.col("next")))
            level = grown.select(F.concat_ws("::", "path_id", "e").alias("path_id"), F.concat("nodes", F.array("next")).alias("nodes"), F.col("next").alias("last"), F.zip_with("hits", "h", lambda x, y: x | y).alias("hits"), F.greatest("bonus", "b").alias("bonus"), F.concat("summary", "arrow").alias("summary"), F.lit(length + 1).alias("length"))
    matched = F.size(F.filter("hits", lambda h: h))
    scored = paths.withColumn("matched", matched).where((F.lit(not terms)) | (F.col("matched") > 0) | (F.col("bonus") > 0))
    score = F.when(F.col("length") == 1, graph.path_score(F.col("matched"), len(terms), F.col("bonus"), True)).otherwise(graph.path_score(F.col("matched"), len(terms), F.col("bonus"), False))
    unique = scored.groupBy("path_id").agg(F.max(F.struct(score.alias("score"), "summary", "length")).alias("p")).select("path_id", "p.summary", "p.score", "p.length")
    return unique.orderBy(F.col("score").desc(), "path_id").limit(k)
