"""Queries of the general data problems, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from filingloom.operators import nested, units
from filingloom.plans import nested_sql
from filingloom.tables import load

Query = Callable[[SparkSession, str], DataFrame]


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.convert(load(spark, sf_dir, "metric_observations"), load(spark, sf_dir, "parsed_tables"), load(spark, sf_dir, "fx_rates"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.equal_amounts(_amounts(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nested.list_objects(load(spark, sf_dir, "parsed_documents"), load(spark, sf_dir, "parsed_tables"), load(spark, sf_dir, "ingestion_jobs"))
    return rows.select("root_key", "child_path")


def _payload(name: str) -> Query:
    return lambda spark, sf_dir: nested.payload_table(load(spark, sf_dir, "parsed_documents"), name)


def _semantic(name: str) -> Query:
    return lambda spark, sf_dir: nested.semantic_row_table(load(spark, sf_dir, "parsed_tables"), name)


def queries() -> dict[str, Query]:
    return {
        "p2_found": p2_found,
        "p2_amounts": _amounts,
        "p5_found": p5_found,
        "p5_job_events": lambda spark, sf_dir: nested.job_events(load(spark, sf_dir, "ingestion_jobs")),
        **{f"p5_{t.name}": _payload(t.name) for t in nested.PAYLOAD_TARGETS},
        **{f"p5_{t.name}": _semantic(t.name) for t in nested.SEMANTIC_ROW_TARGETS},
        "p5_other_lists": lambda spark, sf_dir: nested.other_lists(load(spark, sf_dir, "parsed_documents"), load(spark, sf_dir, "parsed_tables")),
    }


def oracle_sql() -> dict[str, str]:
    return nested_sql.oracle_sql()
