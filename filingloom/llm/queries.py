"""Queries of the problems tagged llm, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.llm import canonical, mixing, names, noise, packing, personal, split, survivor
from filingloom.operators import nested
from filingloom.session import materialise
from filingloom.tables import load

Query = Callable[[SparkSession, str], DataFrame]


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.mentions_of(load(spark, sf_dir, "llm_entities"), load(spark, sf_dir, "metric_observations"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.found(load(spark, sf_dir, "resolved_entities"), _mentions(spark, sf_dir))


def p1_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every new spelling with its cluster: of known entities, or of mentions without a row."""
    entities, mentions = load(spark, sf_dir, "resolved_entities"), _mentions(spark, sf_dir)
    spelled = materialise(names.resolve(entities, mentions)[1])
    rest = names.unlisted(entities, mentions, spelled)
    return spelled.withColumn("listed", F.lit(True)).unionByName(rest.withColumn("listed", F.lit(False)))


def _long_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = load(spark, sf_dir, "langqi_restatement_segments").select(F.lit("segment").alias("item_kind"), F.col("segment_id").alias("item_key"), F.col("doc_id").alias("parent_key"), "content")
    tables = load(spark, sf_dir, "parsed_tables").select(F.lit("table").alias("item_kind"), F.col("id").alias("item_key"), F.col("doc_id").alias("parent_key"), F.col("raw_markdown").alias("content"))
    sections = nested.payload_table(load(spark, sf_dir, "parsed_documents"), "sections").select(F.lit("section").alias("item_kind"), F.col("section_id").alias("item_key"), F.col("root_key").alias("parent_key"), "content")
    return segments.unionByName(tables).unionByName(sections)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_pieces(spark, sf_dir).where("n_pieces > 1").select("item_key").distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_items(_long_texts(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.field_sources(load(spark, sf_dir, "conflict_candidates"))


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.survivors(load(spark, sf_dir, "conflict_candidates"))


def p4_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.consensus(load(spark, sf_dir, "conflict_candidates"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise.page_items(load(spark, sf_dir, "langqi_restatement_segments"), nested.payload_table(load(spark, sf_dir, "parsed_documents"), "page_blocks"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise.found(_pages(spark, sf_dir))


def p6_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise.repaired(_pages(spark, sf_dir))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.text_values(load(spark, sf_dir, "parsed_tables"), load(spark, sf_dir, "langqi_restatement_segments"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.found(_labels(spark, sf_dir))


def p7_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.normalised(_labels(spark, sf_dir))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, shares = mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "source_targets"))
    return chosen.join(F.broadcast(shares.select("source", "target_share", "reached_share")), "source")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "source_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.found(load(spark, sf_dir, "documents"))


def p10_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.sanitised(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    from filingloom.llm.oracles import ORACLES

    return dict(ORACLES)
