"""Property graph as two tables: joins to endpoints, bounded simple paths, merge and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges_with_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose endpoints both exist, with their names."""
    source = nodes.select(F.col("node_id").alias("source_id"), F.col("name").alias("source_name"))
    target = nodes.select(F.col("node_id").alias("target_id"), F.col("name").alias("target_name"))
    return edges.join(source, "source_id").join(target, "target_id")


def simple_paths(edges: DataFrame, longest: int = 3) -> DataFrame:
    """Directed paths of 1 to ``longest`` edges that visit no node twice, as unrolled joins."""
    step = edges.select(F.col("edge_id"), "source_id", "target_id")
    level = step.select(F.col("edge_id").alias("path_id"), F.array("source_id", "target_id").alias("nodes"), F.col("target_id").alias("last"), F.lit(1).alias("length"))
    levels = [level]
    for length in range(2, longest + 1):
        grown = levels[-1].join(step, F.col("last") == F.col("source_id")).where(~F.array_contains("nodes", F.col("target_id")))
        levels.append(grown.select(F.concat_ws("::", "path_id", "edge_id").alias("path_id"), F.concat("nodes", F.array("target_id")).alias("nodes"), F.col("target_id").alias("last"), F.lit(length).alias("length")))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def path_score(matched: Column, terms: int, bonus: Column, single_edge: bool) -> Column:
    """Share of query terms found on a path plus the bonus of its types, at most one."""
    base, weight = (0.2, 0.6) if single_edge else (0.15, 0.5)
    return F.round(F.least(F.lit(1.0), base + matched / max(terms, 1) * weight + bonus), 4)


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row per node over all documents: its first name and the union of its years."""
    return nodes.groupBy("node_id").agg(F.min("name").alias("name"), F.sort_array(F.collect_set("year")).alias("years"), F.countDistinct("document_id").alias("documents"))


def graph_quality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Duplicate ids, edges without endpoints or evidence, and the grounded share, as one row."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), (F.count(F.lit(1)) - F.countDistinct("node_id")).alias("duplicate_nodes"))
    ids = nodes.select("node_id").distinct()
    checked = edges.join(ids.select(F.col("node_id").alias("source_id"), F.lit(True).alias("s")), "source_id", "left").join(ids.select(F.col("node_id").alias("target_id"), F.lit(True).alias("t")), "target_id", "left")
    e = checked.agg(
        F.count(F.lit(1)).alias("edges"), (F.count(F.lit(1)) - F.countDistinct("edge_id")).alias("duplicate_edges"), F.count_if(F.col("s").isNull() | F.col("t").isNull()).alias("missing_endpoints"),
        F.count_if(F.col("evidence").isNull()).alias("missing_evidence"), F.round(F.count_if(F.col("evidence").isNotNull()) / F.greatest(F.count(F.lit(1)), F.lit(1)), 4).alias("grounding"),
    )
    return n.join(e)  # one row each
