"""Sinks: replacement by document, upserts by bucket, versioned snapshots of several tables, graphs, backfills."""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.session import materialise


def replace_documents(rows: DataFrame, path: str, key: str = "doc_id") -> None:
    """Overwrite only the partitions of the documents in ``rows``; the others stay."""
    rows.write.partitionBy(key).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_snapshot(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> str:
    """Write all tables into a new version and switch the manifest last, so readers see all or none."""
    version = uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    manifest = spark.createDataFrame([(json.dumps({"version": version, "tables": sorted(tables)}),)], "value string")
    manifest.coalesce(1).write.mode("overwrite").text(f"{root}/_manifest")
    return version


def read_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the version that the manifest names."""
    version = json.loads(spark.read.text(f"{root}/_manifest").first().value)["version"]
    return spark.read.parquet(f"{root}/{version}/{name}")


def supersede(facts: DataFrame, losers: DataFrame, key: str) -> DataFrame:
    """Facts without the superseded ones."""
    return facts.join(losers.select(key).distinct(), key, "left_anti")


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def upsert_documents(spark: SparkSession, rows: DataFrame, path: str, key: str = "doc_id", buckets: int = 64) -> None:
    """Delete all rows of the documents in ``rows`` and write theirs: segments with their vectors, for instance.

    The table is cut into buckets by a hash of the document, so a batch rewrites only the buckets it
    touches, and the number of files does not follow the number of documents. An empty batch changes nothing.
    """
    new = materialise(rows.where(F.col(key).isNotNull()).withColumn("_bucket", _bucket(key, buckets)))
    touched = new.select("_bucket").distinct()
    merged = new
    if _exists(spark, path):
        old = spark.read.schema(new.schema).parquet(path).join(F.broadcast(touched), "_bucket", "left_semi")  # at most `buckets` rows
        merged = materialise(old.join(new.select(key).distinct(), key, "left_anti").unionByName(new))
    merged.repartition("_bucket").write.partitionBy("_bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an upserted table without its buckets."""
    return spark.read.parquet(path).drop("_bucket")


def replace_subgraph(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph after the edges of the documents in ``new_edges`` were replaced and the new nodes merged in.

    ``nodes (node_id, node_type, name, documents array)``, ``edges (edge_id, source_id, target_id, relationship_type,
    document_id)``. A node keeps its first name and the union of its documents; one that no document
    and no edge needs any more goes.
    """
    replaced = new_edges.select("document_id").unionByName(new_nodes.select(F.explode("documents").alias("document_id"))).distinct()
    kept_edges = edges.join(replaced, "document_id", "left_anti").unionByName(new_edges)
    held = nodes.select("node_id", "node_type", "name", F.explode("documents").alias("document_id")).join(replaced, "document_id", "left_anti").select("node_id", "node_type", "name", "document_id", F.lit(0).alias("age"))
    fresh = new_nodes.select("node_id", "node_type", "name", F.explode("documents").alias("document_id"), F.lit(1).alias("age"))
    merged = held.unionByName(fresh).groupBy("node_id").agg(F.min(F.struct("age", "node_type", "name")).alias("first"), F.sort_array(F.collect_set("document_id")).alias("documents"))
    return merged.select("node_id", "first.node_type", "first.name", "documents"), kept_edges


def backfill(spark: SparkSession, source: str, schema: str, path: str, key: str = "doc_id", buckets: int = 64) -> None:
    """JSON records of a folder, one object a line, upserted into a table; broken lines are left out."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(source).where("_bad IS NULL").drop("_bad")
    upsert_documents(spark, rows, path, key, buckets)
