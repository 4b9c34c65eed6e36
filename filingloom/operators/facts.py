"""Structured facts: catalog, filtered reads, conflict winners, fusion, growth, comparison, dashboard.

Every ranking ends with a unique key, so ties never depend on the physical plan. Winners are
lexicographic ``max`` aggregates (combined on the map side), not windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingloom.session import materialise

NUMERIC = r"^-?\d+(\.\d+)?$"


def parse_number(text: Column) -> Column:
    """Numeric cell: parentheses negate; separators, blanks, currency and per-cent signs are dropped."""
    trimmed = F.trim(text)
    clean = F.regexp_replace(trimmed, r"[,()$¥€£%\s]", "")
    sign = F.when(trimmed.startswith("(") & trimmed.endswith(")"), -1.0).otherwise(1.0)
    return F.when(clean.rlike(NUMERIC), sign * clean.try_cast("double"))


def period_year(period: Column) -> Column:
    """Year of a period that stands as a word of its own."""
    return F.nullif(F.regexp_extract(period, r"(?U)\b((?:19|20)\d{2})\b", 1), F.lit("")).try_cast("int")


def canonical_value(number: Column, text: Column) -> Column:
    """Text by which two values are compared: ten significant digits, else the trimmed text."""
    return F.when(number.isNotNull(), F.format_string("%.9e", number)).otherwise(F.trim(text))


def observations(df: DataFrame) -> DataFrame:
    """Metric observations with year, number, canonical value and trust flags."""
    provenance = F.col("source_table_id").isNotNull() | F.col("page_range").isNotNull() | F.col("source_section").isNotNull() | F.col("provenance").isNotNull()
    number = parse_number(F.col("value"))
    return df.select(
        "observation_id", "company_id", "company", "document_id", "document_year", "metric_key", "period", "value", "statement_type", "unit", "currency", "source_table_id", "source_table_title",
        period_year(F.col("period")).alias("year"), number.alias("number"), canonical_value(number, F.col("value")).alias("canonical"),
        provenance.alias("has_provenance"), F.coalesce("provenance.source_grounded", F.lit(False)).alias("is_grounded"), F.coalesce("provenance.source_priority", F.lit(0)).alias("priority"),
    )


def query_metrics(obs: DataFrame, *, company_id: str | None = None, year: int | None = None, metric_key: str | None = None, statement_type: str | None = None, document_id: str | None = None, limit: int | None = 500) -> DataFrame:
    """Observations that match the given filters, in serving order, at most ``limit``."""
    for column, wanted in (("company_id", company_id), ("year", year), ("metric_key", metric_key), ("statement_type", statement_type), ("document_id", document_id)):
        if wanted is not None:
            obs = obs.where(F.col(column) == wanted)
    ordered = obs.orderBy(F.col("year").asc_nulls_last(), "metric_key", F.coalesce("document_year", F.lit(0)), "document_id", "observation_id")
    return ordered if limit is None else ordered.limit(limit)


def company_catalog(obs: DataFrame) -> DataFrame:
    """Per company: a name, its documents, facts and sorted years."""
    per_document = obs.groupBy("company_id", "document_id").agg(F.min("company").alias("name"), F.count(F.lit(1)).alias("facts"), F.collect_set("year").alias("years"), F.collect_set("document_year").alias("document_years"))
    merged = per_document.groupBy("company_id").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("documents"), F.sum("facts").alias("facts"), F.flatten(F.collect_list(F.array_union("years", "document_years"))).alias("y"))
    return merged.select("company_id", "name", "documents", "facts", F.array_join(F.sort_array(F.array_distinct("y")).cast("array<string>"), ",").alias("years"))


def _trust(prefer_document: str | None = None) -> list[Column]:
    preferred = F.coalesce(F.col("document_id") == prefer_document, F.lit(False)) if prefer_document else F.lit(False)
    return [
        preferred.alias("preferred"), (F.col("has_provenance") & F.col("is_grounded")).alias("both"), F.col("is_grounded").alias("grounded"), F.col("has_provenance").alias("provenance"),
        F.col("priority").alias("priority"), F.coalesce("document_year", F.lit(0)).alias("document_year"), F.coalesce("document_id", F.lit("")).alias("document_id"),
    ]


def resolve_conflicts(obs: DataFrame, keys: Sequence[str] = ("company_id", "metric_key", "period"), prefer_document: str | None = None) -> DataFrame:
    """Winner per key, whether values disagree, and which branch decided.

    Branches: ``single`` (no conflict), ``one_grounded`` (a lone grounded candidate wins, whatever
    document is preferred), ``grounded`` (several), ``ungrounded`` (none).
    """
    keys = list(keys)
    grouped = obs.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidates"), (F.min("canonical") < F.max("canonical")).alias("differ"), F.sum(F.col("is_grounded").cast("int")).alias("grounded"),
        F.max(F.struct(*_trust(prefer_document), *_key_desc("observation_id"), F.col("value").alias("value"), F.col("observation_id").alias("observation_id"))).alias("w"),
    )
    branch = F.when(~F.coalesce("differ", F.lit(False)), "single").when(F.col("grounded") == 1, "one_grounded").when(F.col("grounded") > 1, "grounded").otherwise("ungrounded")
    return grouped.select(*keys, "candidates", F.coalesce("differ", F.lit(False)).alias("conflict"), branch.alias("branch"), F.col("w.observation_id").alias("winner_id"), F.col("w.document_id").alias("winner_document"), F.col("w.value").alias("value"))


def _key_desc(key: str) -> list[Column]:
    """A text that sorts the other way round, so that under ``max`` the smaller key ranks higher.

    The digits of the bytes are mirrored; the end mark ranks a key above what it begins.
    """
    return [F.concat(F.translate(F.hex(F.col(key)), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G")).alias("n")]


def fuse(obs: DataFrame) -> DataFrame:
    """One fact per company, metric and period with its sources and the documents it suppressed."""
    winners = resolve_conflicts(obs)
    keys = ["company_id", "metric_key", "period"]
    # pre-aggregated per document, so that a hot key ships one row per document
    per_document = obs.groupBy(*keys, "document_id").agg(F.count(F.lit(1)).alias("n"))
    sources = per_document.groupBy(*keys).agg(F.sort_array(F.collect_list("document_id")).alias("documents"))
    joined = winners.join(sources, keys)
    return joined.select(*keys, "value", "conflict", F.array_join("documents", ",").alias("source_documents"), (F.size("documents") - 1).alias("suppressed"))


def numeric_by_year(obs: DataFrame) -> DataFrame:
    """Numeric candidates per metric and year."""
    rows = obs.where("number IS NOT NULL AND year IS NOT NULL")
    return rows.groupBy("metric_key", "year").agg(F.count(F.lit(1)).alias("candidates"), F.countDistinct("company_id").alias("companies"))


def largest_absolute(obs: DataFrame) -> DataFrame:
    """Per document, metric and period the largest absolute number; the first of equals."""
    best = F.max(F.struct(F.abs("number").alias("size"), *_key_desc("observation_id"), F.col("number").alias("number"), F.col("observation_id").alias("observation_id")))
    return obs.where("number IS NOT NULL").groupBy("document_id", "metric_key", "period").agg(best.alias("b")).select("document_id", "metric_key", "period", F.col("b.number").alias("number"), F.col("b.observation_id").alias("observation_id"))


def dedupe_facts(obs: DataFrame) -> DataFrame:
    """One fact per document, metric and period: grounded, cash-flow table, any table, its id."""
    title = F.lower(F.coalesce("source_table_title", F.lit("")))
    cash_flow = title.contains("现金流量") | title.contains("cash flow")
    rank = F.struct(F.col("is_grounded").alias("g"), cash_flow.alias("c"), (F.coalesce("source_table_id", F.lit("")) != "").alias("t"), F.coalesce("source_table_id", F.lit("")).alias("table"), *_key_desc("observation_id"), F.col("observation_id").alias("observation_id"))
    return obs.groupBy("document_id", "metric_key", "period").agg(F.max(rank).alias("b"), F.count(F.lit(1)).alias("facts")).select("document_id", "metric_key", "period", "facts", F.col("b.observation_id").alias("observation_id"))


def consistency(obs: DataFrame) -> DataFrame:
    """Distinct units and currencies per company and metric; more than one is inconsistent."""
    counted = obs.groupBy("company_id", "metric_key").agg(F.countDistinct("unit").alias("units"), F.countDistinct("currency").alias("currencies"))
    return counted.withColumn("inconsistent", (F.col("units") > 1) | (F.col("currencies") > 1))


def growth(points: DataFrame, keys: Sequence[str], year: str = "year", value: str = "value") -> DataFrame:
    """Year-over-year growth against the previous present year, null where that was zero."""
    previous = F.lag(value).over(Window.partitionBy(*keys).orderBy(year))
    rate = F.round(F.try_divide(F.col(value) - previous, F.abs(previous)), 6)
    return points.withColumn("previous", previous).withColumn("yoy", rate)


def compound_growth(points: DataFrame, keys: Sequence[str], year: str = "year", value: str = "value") -> DataFrame:
    """Compound annual growth between first and last year, where both values are positive."""
    ends = points.groupBy(*keys).agg(F.min(F.struct(F.col(year).alias("y"), F.col(value).alias("v"))).alias("a"), F.max(F.struct(F.col(year).alias("y"), F.col(value).alias("v"))).alias("b"))
    span = F.col("b.y") - F.col("a.y")
    rate = F.when((span > 0) & (F.col("a.v") > 0) & (F.col("b.v") > 0), F.round(F.pow(F.col("b.v") / F.col("a.v"), F.lit(1.0) / span) - 1, 6))
    return ends.select(*keys, F.col("a.y").alias("first_year"), F.col("b.y").alias("last_year"), rate.alias("cagr"))


def metric_trend(obs: DataFrame) -> DataFrame:
    """Winner per company, metric and year with its growth."""
    rows = obs.where("number IS NOT NULL AND year IS NOT NULL AND company_id IS NOT NULL")
    best = F.max(F.struct(*_trust(), *_key_desc("observation_id"), F.col("number").alias("number")))
    points = rows.groupBy("company_id", "metric_key", "year").agg(best.alias("b"), F.countDistinct("canonical").alias("values")).select("company_id", "metric_key", "year", F.col("b.number").alias("value"), (F.col("values") > 1).alias("conflict"))
    return growth(points, ["company_id", "metric_key"]).drop("previous")


def latest(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Value of the last year per key."""
    return points.groupBy(*keys).agg(F.max(F.struct("year", "value")).alias("l")).select(*keys, F.col("l.year").alias("year"), F.col("l.value").alias("value"))


def ranking(latest_points: DataFrame, names: DataFrame) -> DataFrame:
    """Companies of each metric by latest value, then name."""
    order = Window.partitionBy("metric_key").orderBy(F.col("value").desc(), "name", "company_id")
    return latest_points.join(names, "company_id").withColumn("rank", F.row_number().over(order))


def compare(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer comparison of two sides on their keys; the rounded delta feeds its percentage."""
    joined = a.withColumnRenamed("value", "value_a").join(b.withColumnRenamed("value", "value_b"), list(keys), "full_outer")
    delta = F.round(F.col("value_b") - F.col("value_a"), 6)
    return joined.withColumn("delta", delta).withColumn("delta_pct", F.round(F.try_divide(F.col("delta"), F.abs("value_a")), 6))


#: Risk categories in order of precedence and the terms that decide them.
RISK_TERMS = {
    "market": ("市场", "需求", "价格", "竞争", "market", "demand", "price"),
    "financial": ("财务", "流动性", "偿债", "信用", "汇率", "financial", "liquidity", "credit"),
    "operational": ("经营", "供应", "生产", "技术", "安全", "operation", "supply", "technology"),
    "legal": ("法律", "合规", "诉讼", "监管", "legal", "compliance", "regulation"),
}


def risk_category(text: Column) -> Column:
    """First category with a term in the text, else ``other``."""
    lowered, found = F.lower(text), F.lit("other")
    for category, terms in reversed(RISK_TERMS.items()):
        hit = F.lit(False)
        for term in terms:
            hit = hit | lowered.contains(term)
        found = F.when(hit, category).otherwise(found)
    return found


def risk_heatmap(entities: DataFrame) -> DataFrame:
    """Distinct risks per document and category, zero-filled."""
    risks = entities.where("node_type = 'risk' AND name IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "name").distinct().withColumn("category", risk_category(F.col("name")))
    counts = risks.groupBy("doc_id").pivot("category", [*RISK_TERMS, "other"]).count().na.fill(0)
    return counts.withColumn("total", sum((F.col(c) for c in [*RISK_TERMS, "other"]), F.lit(0)))


def overlap(sets: DataFrame, key: str, items: str, most: int = 20) -> DataFrame:
    """Jaccard of the item sets of every unordered pair, sharing an item, of the ``most`` largest keys.

    A portfolio is compared, not everyone with everyone: the keys with most rows (ties: the smaller).
    Pairs come from an inverted index on items, so pairs with nothing in common are never built.
    """
    rows = sets.select(key, items).where(f"{key} IS NOT NULL AND {items} IS NOT NULL")
    chosen = rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.col("rows").desc(), key).limit(most).select(key)
    distinct = rows.join(F.broadcast(chosen), key).distinct()  # at most `most` rows
    sizes = distinct.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    a = distinct.select(F.col(key).alias("a"), items)
    b = distinct.select(F.col(key).alias("b"), items)
    shared = a.join(b, items).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    sized = shared.join(sizes.select(F.col(key).alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col(key).alias("b"), F.col("n").alias("n_b")), "b")
    return sized.select("a", "b", "shared", F.round(F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")), 4).alias("score"))


def nearest_rank(rows: DataFrame, key: str, value: str, share: float, cells: int = 4096) -> DataFrame:
    """Per key the number of values and the one of nearest rank ``round(share * (n - 1))``, exactly.

    Values are counted in cells between the least and the greatest; only the cell that holds the rank
    is sorted, so no task gets a whole key.
    """
    present = rows.where(F.col(value).isNotNull()).select(key, F.col(value).alias("v"))
    spans = present.groupBy(key).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))
    width = (F.col("high") - F.col("low")) / cells
    placed = present.join(spans, key).withColumn("cell", F.when(width > 0, F.least(F.floor((F.col("v") - F.col("low")) / width), F.lit(cells - 1))).otherwise(F.lit(0)).cast("int"))
    counts = placed.groupBy(key, "n", "cell").agg(F.count(F.lit(1)).alias("held"))
    before = F.sum("held").over(Window.partitionBy(key).orderBy("cell")) - F.col("held")  # at most `cells` rows a key
    rank = F.bround(share * (F.col("n") - 1), 0).cast("long")
    holding = counts.withColumn("before", before).where((F.col("before") <= rank) & (rank < F.col("before") + F.col("held"))).select(key, "cell", "n", (rank - F.col("before")).alias("place"))
    inside = placed.select(key, "cell", "v").join(holding, [key, "cell"])
    ordered = inside.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy("v")) - 1)
    return ordered.where("i = place").select(key, "n", F.col("v").alias("ranked"))


def global_place(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with their ``place`` in the order of the columns, which must be unique together.

    The rows are cut into ranges, each ranked by itself behind the sizes of the ranges before it, so
    no task sorts the whole table.
    """
    ranged = materialise(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("held"))
    before = sizes.select("_part", (F.sum("held").over(Window.orderBy("_part")) - F.col("held")).alias("before"))  # one row a range
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(before), "_part").withColumn("place", within + F.col("before")).drop("_part", "before")


def first_value_growth(obs: DataFrame) -> DataFrame:
    """Growth per company and metric by the first observation of every year, without resolving conflicts.

    ``rivals`` counts the further values of a year; more than none is a warning.
    """
    rows = obs.where("number IS NOT NULL AND year IS NOT NULL AND company_id IS NOT NULL")
    first = F.min(F.struct("observation_id", "number")).alias("f")
    points = rows.groupBy("company_id", "metric_key", "year").agg(first, (F.countDistinct("number") - 1).alias("rivals")).select("company_id", "metric_key", "year", F.col("f.number").alias("value"), "rivals")
    return growth(points, ["company_id", "metric_key"]).drop("previous")
