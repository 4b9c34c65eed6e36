"""Document structure: page joins, serving gate, table binding, cleaning, chunk and quality operators."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def narrowest_range(items: DataFrame, ranges: DataFrame, doc: str = "doc_id") -> DataFrame:
    """For each ``(doc, item_id, page)`` the narrowest ``(doc, range_id, lo, hi)`` that holds the page.

    Of equally narrow ranges the more confident one, where there is a column ``confidence``; then the smaller id.

    Ranges are spread over the pages they cover, so the range join becomes an equi-join on document
    and page; only the best range per page is kept before it meets the items.
    """
    spans = ranges.where("lo IS NOT NULL AND hi >= lo").select(doc, "range_id", F.explode(F.sequence("lo", "hi")).alias("page"), (F.col("hi") - F.col("lo")).alias("span"), (-F.coalesce("confidence", F.lit(0.0)) if "confidence" in ranges.columns else F.lit(0.0)).alias("doubt"))
    best = spans.groupBy(doc, "page").agg(F.min(F.struct("span", "doubt", "range_id")).alias("b"))
    return items.join(best, [doc, "page"], "left").select(doc, "item_id", "page", F.col("b.range_id").alias("range_id"))


def preceding_anchor(items: DataFrame, anchors: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Backward as-of join: the last anchor ``(doc, anchor_id, page)`` at or before each item's page.

    Both sides are sorted together and the last anchor is carried forward: one shuffle by document,
    no pair is ever formed.
    """
    rows = items.select(doc, F.col("page"), F.lit(1).alias("side"), F.col("item_id").alias("id")).unionByName(anchors.where("page IS NOT NULL").select(doc, F.col("page"), F.lit(0).alias("side"), F.col("anchor_id").alias("id")))
    order = Window.partitionBy(doc).orderBy("page", "side", "id")
    carried = rows.withColumn("anchor_id", F.last(F.when(F.col("side") == 0, F.col("id")), ignorenulls=True).over(order))
    return carried.where("side = 1").select(doc, F.col("id").alias("item_id"), "page", "anchor_id")


def preceding_context(blocks: DataFrame, reach: int = 3) -> DataFrame:
    """Ids of the blocks up to ``reach`` places before each block of a document."""
    window = Window.partitionBy("doc_id").orderBy("position").rangeBetween(-reach, -1)
    return blocks.select("doc_id", "segment_id", F.array_join(F.array_sort(F.collect_list("segment_id").over(window)), ",").alias("context"))


def serving_gate(facts: DataFrame) -> DataFrame:
    """Facts that may be served: documents with grounded facts list them, others list none.

    An empty list serves everything; a document without any provenance is denied.
    """
    key = F.concat_ws("::", "metric_key", "period", F.coalesce("value", F.lit("")))
    gate = facts.groupBy("document_id").agg(F.max("has_provenance").alias("allow"), F.count_if(F.col("is_grounded")).alias("listed"))
    listed = facts.where("is_grounded").select("document_id", key.alias("fact_key")).distinct().withColumn("in_list", F.lit(True))
    rows = facts.withColumn("fact_key", key).join(gate, "document_id").join(listed, ["document_id", "fact_key"], "left")
    return rows.where(F.col("allow") & ((F.col("listed") == 0) | F.col("in_list")))


def gate_failures(facts: DataFrame, least_grounding: float = 0.95, most_implausible: float = 0.0) -> DataFrame:
    """Per document the codes of what keeps it from being served, and whether nothing does.

    Without a company or a year, with too small a share of grounded facts, or with implausible periods.
    """
    rows = facts.groupBy("document_id").agg(F.max(F.nullif("company", F.lit(""))).alias("company"), F.max("document_year").alias("year"), F.avg(F.col("is_grounded").cast("int")).alias("grounding"), F.avg((~F.col("plausible")).cast("int")).alias("implausible"))
    failures = F.concat_ws(",", F.when(F.col("company").isNull(), "missing_company"), F.when(F.col("year").isNull(), "missing_year"), F.when(F.col("grounding") < least_grounding - 1e-9, "source_grounding_rate"), F.when(F.col("implausible") > most_implausible + 1e-9, "implausible_period_ratio"))
    return rows.select("document_id", failures.alias("failures"), (failures == "").alias("allow"))


def value_variants(value: Column) -> Column:
    """Ways a value may be written in a table: grouped or not, whole numbers with two zeros as well.

    A value that is no plain number is looked for as it stands.
    """
    number = F.when(F.trim(value).rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), F.trim(value).try_cast("double"))
    size = F.abs(number)
    whole = size == F.floor(size)
    plain, grouped = F.format_string("%.4f", size), F.format_string("%,.4f", size)

    def cut(text: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")

    round_ = F.array(F.format_string("%.0f", size), F.format_string("%,.0f", size), F.format_string("%,.2f", size), F.format_string("%.2f", size))
    text = F.when(F.trim(value) != "", F.array(F.trim(value))).otherwise(F.array().cast("array<string>"))
    return F.when(number.isNull(), text).when(whole, round_).otherwise(F.array(cut(plain), cut(grouped)))


def bind_tables(facts: DataFrame, tables: DataFrame, aligned: DataFrame) -> DataFrame:
    """How each fact's value is found in its table: as the table's metric of its period, in its text, or not.

    ``aligned (id, metric_key, period, value)`` are the numbers of the tables by metric and period.
    """
    parts = F.concat(F.array(F.coalesce("raw_markdown", F.lit("")), F.array_join(F.coalesce("headers", F.array().cast("array<string>")), " ")), F.transform(F.coalesce("rows", F.array().cast("array<array<string>>")), lambda r: F.array_join(r, " ")))
    text = F.array_join(parts, "\n")
    texts = tables.select(F.col("id").alias("source_table_id"), text.alias("text"), F.regexp_replace(text, r"[,\s]", "").alias("dense"))
    numbers = aligned.select(F.col("id").alias("source_table_id"), "metric_key", "period", F.col("value").alias("number"))
    joined = facts.where("source_table_id IS NOT NULL AND value IS NOT NULL").select("observation_id", "source_table_id", "metric_key", "period", "value").join(texts, "source_table_id").join(numbers, ["source_table_id", "metric_key", "period"], "left")
    equal = F.abs(F.trim("value").try_cast("double") - F.col("number")) < 1e-9
    written = F.exists(value_variants(F.col("value")), lambda v: F.contains(F.col("text"), v) | F.contains(F.col("dense"), v))
    judged = joined.select("observation_id", equal.alias("equal"), written.alias("written"))
    return judged.select("observation_id", F.when(F.coalesce("equal", F.lit(False)), "metric").when(F.col("written"), "text").otherwise("none").alias("binding"), "written")


def repeated_margins(pages: DataFrame, most: int = 80) -> DataFrame:
    """First and last lines that repeat within a document."""
    lines = F.filter(F.transform(F.split("content", "\n"), F.trim), lambda x: x != "")
    ends = pages.select("doc_id", F.explode(F.array_distinct(F.array(F.get(lines, F.lit(0)), F.get(lines, F.size(lines) - 1)))).alias("line"))
    return ends.where(F.col("line").isNotNull() & (F.length("line") <= most)).groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("times")).where("times >= 2")


def dedupe_key(text: Column) -> Column:
    """Blanks removed, digits masked."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"\s+", ""), r"\d+", "#")


def pack_paragraphs(text: Column, limit: int = 800) -> Column:
    """Paragraphs packed greedily into chunks of at most ``limit`` characters; longer ones stand alone."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), F.trim), lambda p: p != "")
    empty = F.array().cast("array<string>")

    # try_element_at keeps the first step from failing on the empty array
    def add(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        fits = (F.size(done) > 0) & (F.length(last) + 2 + F.length(part) <= limit)
        return F.when(fits, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat_ws("\n\n", last, part)))).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(parts, empty, add)


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edits per character of the reference, both without blanks."""
    a, b = (F.regexp_replace(c, r"\s+", "") for c in (reference, hypothesis))
    return F.round(F.try_divide(F.levenshtein(a, b), F.length(a)), 6)


def embedding_features(text: str) -> list[tuple[str, float]]:
    """Words and character trigrams of a text with their weights."""
    words = [w for w in re.split(r"\W+", text.lower().strip()) if w]
    joined = " ".join(words)
    return [(f"tok:{w}", 1.25) for w in words] + [(f"tri:{joined[i : i + 3]}", 0.5) for i in range(len(joined) - 2)]


@lru_cache(maxsize=200_000)
def _bucket(feature: str, dimension: int) -> tuple[int, float]:
    """Bucket (first four bytes of the digest) and sign (parity of the fifth) of a feature."""
    digest = hashlib.blake2b(feature.encode(), digest_size=8).digest()
    return int.from_bytes(digest[:4], "big") % dimension, -1.0 if digest[4] & 1 else 1.0


def hash_embedding(text: Column, dimension: int = 256) -> Column:
    """Signed feature hash of words (1.25) and character trigrams (0.5), normalised; e0 for no text."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        out = np.zeros((len(texts), dimension))
        for row, value in zip(out, texts):
            for feature, weight in embedding_features(value or ""):
                place, sign = _bucket(feature, dimension)
                row[place] += sign * weight
        norms = np.linalg.norm(out, axis=1)
        out[norms == 0, 0] = 1.0
        norms[norms == 0] = 1.0
        return pd.Series(list((out / norms[:, None]).astype("float32")))

    return embed(text)


#: Cues of a question and what expands it, in order.
EXPANSIONS = (
    (("管理层", "md&a", "经营情况", "讨论与分析"), "管理层讨论与分析 经营分析"), (("风险", "risk", "暴露"), "风险因素 风险披露"), (("营收", "收入", "revenue"), "营业收入 主营业务收入"), (("增长", "同比", "cagr", "趋势"), "同比增长 增长率"),
    (("现金流", "cash flow"), "经营活动产生的现金流量净额"), (("行业", "industry"), "所处行业 行业地位"), (("子公司", "分部", "segment"), "业务板块 子公司"),
)


def expand_query(question: Column, most: int = 4) -> Column:
    """The question and its expansions, distinct, in order."""
    lowered = F.lower(question)

    def cued(cues: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for cue in cues:
            hit = hit | lowered.contains(cue)
        return hit

    seeds = F.array(F.trim(question), *(F.when(cued(cues), F.concat_ws(" ", question, F.lit(suffix))) for cues, suffix in EXPANSIONS))
    return F.array_distinct(F.slice(F.filter(seeds, lambda s: s.isNotNull() & (s != "")), 1, most))


def stable_id(*parts: Column, size: int = 24) -> Column:
    """Prefix of a hash over the parts, joined by the unit separator."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, size)


def fact_graph(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Company, document and metric nodes and the edges between them, with stable ids."""
    def node(kind: str, name: str) -> DataFrame:
        return obs.where(F.col(name).isNotNull()).select(F.lit(kind).alias("node_type"), F.col(name).alias("name")).distinct().withColumn("node_id", stable_id(F.col("node_type"), F.col("name")))

    nodes = node("company", "company_id").unionByName(node("document", "document_id")).unionByName(node("metric", "metric_key"))

    def edge(kind: str, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
        rows = obs.select(a[1], b[1]).dropna().distinct()
        source, target = stable_id(F.lit(a[0]), F.col(a[1])), stable_id(F.lit(b[0]), F.col(b[1]))
        return rows.select(F.lit(kind).alias("relationship_type"), source.alias("source_id"), target.alias("target_id"), stable_id(F.lit(kind), source, target).alias("edge_id"))

    company, document, metric = ("company", "company_id"), ("document", "document_id"), ("metric", "metric_key")
    return nodes, edge("HAS_DOCUMENT", company, document).unionByName(edge("REPORTS_METRIC", document, metric))


def fold_lines(rows: DataFrame) -> DataFrame:
    """Lines of each document without those equal to the last *kept* one (a fold, not islands).

    The kept line changes only when a different one comes, so a line is dropped exactly when it
    equals the nearest earlier line; blank lines never reset it. So ``lag`` over non-blank lines
    gives the same result without leaving the engine.
    """
    lines = rows.select("doc_id", "segment_id", F.posexplode(F.split("content", "\n")).alias("line_no", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    order = Window.partitionBy("segment_id").orderBy("line_no")
    previous = F.lag("line").over(order)
    return lines.where("line IS NOT NULL").withColumn("previous", previous).where(F.col("previous").isNull() | (F.col("previous") != F.col("line"))).drop("previous")


def cumulative_budget(rows: DataFrame, key: str, order: list[str], size: Column, budget: int) -> DataFrame:
    """Rows of each key in order until their sizes exceed the budget."""
    running = F.sum(size).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running", running).where(F.col("running") <= budget)
