"""Lexical and vector retrieval with score fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B, AVERAGE_LENGTH = 1.2, 0.75, 500.0
VECTOR_WEIGHT, LEXICAL_WEIGHT = 0.65, 0.35


def tokenize(text: Column) -> Column:
    """Latin and digit runs; ideograph runs, and the bigrams of runs longer than four."""
    lowered = F.lower(text)
    runs = F.regexp_extract_all(lowered, F.lit("[一-鿿]+"), F.lit(0))

    def spread(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(F.length(run) <= 4, F.array(run)).otherwise(F.concat(F.array(run), pairs))

    return F.concat(F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), F.lit(0)), F.flatten(F.transform(runs, spread)))


def bm25_lite(tokens: Column, terms: list[str]) -> Column:
    """Term frequencies with length norm, no corpus weights, over the distinct terms of the query."""
    wanted = sorted(set(terms))
    if not wanted:
        return F.lit(0.0)
    length = F.size(tokens)
    total = F.lit(0.0)
    for term in wanted:
        freq = _count(tokens, term)
        total = total + F.when(freq > 0, freq * (K1 + 1) / (freq + K1 * (1 - B + B * length / AVERAGE_LENGTH))).otherwise(0.0)
    return total / len(wanted)


def _count(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == F.lit(term)))


def lexical_scores(segments: DataFrame, terms: list[str]) -> DataFrame:
    """(segment_id, score) of every segment; tokens are a column of their own, so they are made once."""
    tokens = segments.select("segment_id", tokenize(F.coalesce("content", F.lit(""))).alias("tokens"))
    return tokens.select("segment_id", F.round(bm25_lite(F.col("tokens"), terms), 6).alias("score"))


def lexical_search(segments: DataFrame, terms: list[str], k: int) -> DataFrame:
    """The ``k`` segments with the best lexical score (ties: the smaller id)."""
    return lexical_scores(segments, terms).where("score > 0").orderBy(F.col("score").desc(), "segment_id").limit(k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; null where one has no length."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_search(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """For each query the ``k`` nearest other vectors, by the rounded cosine (ties: the smaller id).

    The query set meets all vectors in blocks of ``QUERY_BLOCK`` queries, whatever its size: each batch of
    vectors is multiplied with a block at once and only its best ``k`` per query leave the task. Null
    vectors and vectors without length take no part.
    """
    probes = queries.where("embedding IS NOT NULL").select(F.col("vec_id").alias("query_id"), "embedding")
    total = probes.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    found = None
    for block in range(blocks):
        rows = probes.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).orderBy("query_id").toPandas()  # about QUERY_BLOCK rows
        hits = block_search(vectors, rows, k)
        found = hits if found is None else found.unionByName(hits)
    return best_of_block(found, k)


#: Queries that meet the vectors at once.
QUERY_BLOCK = 4_096


def _unit(vectors: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(vectors, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return vectors / lengths[:, None]


def best_of_block(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best hits of each query with their rank."""
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def block_search(vectors: DataFrame, queries: pd.DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best ``k`` of every batch of vectors for each query of a block."""
    ids = queries["query_id"].to_numpy()
    probe = _unit(np.array(queries["embedding"].tolist(), dtype="float64").reshape(len(ids), -1)) if len(ids) else np.zeros((0, 1))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch) or not len(ids):
                continue
            keys = batch["vec_id"].to_numpy()
            order = np.argsort(keys, kind="stable")
            keys, matrix = keys[order], _unit(np.array(batch["embedding"].tolist(), dtype="float64"))[order]
            out = []
            for start in range(0, len(ids), 256):
                scores = np.round(probe[start : start + 256] @ matrix.T, 6)
                scores[ids[start : start + 256, None] == keys[None, :]] = np.nan
                best = np.argsort(np.where(np.isnan(scores), np.inf, -scores), axis=1, kind="stable")[:, :k]
                values = np.take_along_axis(scores, best, axis=1)
                out.append(pd.DataFrame({"query_id": np.repeat(ids[start : start + 256], best.shape[1]), "vec_id": keys[best].ravel(), "score": values.ravel()}).dropna())
            yield pd.concat(out)

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.where("embedding IS NOT NULL").select("vec_id", "embedding").mapInPandas(search, f"query_id {kind}, vec_id {kind}, score double")


def merge_hits(vector: DataFrame, lexical: DataFrame) -> DataFrame:
    """Maximum of each channel's score per segment, and their weighted sum."""
    rows = vector.select("segment_id", F.col("score").alias("vector_score"), F.lit(0.0).alias("lexical_score")).unionByName(lexical.select("segment_id", F.lit(0.0).alias("vector_score"), F.col("score").alias("lexical_score")))
    merged = rows.groupBy("segment_id").agg(F.max("vector_score").alias("vector_score"), F.max("lexical_score").alias("lexical_score"))
    return merged.withColumn("score", F.round(VECTOR_WEIGHT * F.col("vector_score") + LEXICAL_WEIGHT * F.col("lexical_score"), 6))


#: Words that point to another place, words of places, dotted leaders, numbered chapters.
POINTERS, PLACES = "参见|详见|请见|见本报告|本报告", "第|章节|部分|中|之"
LEADERS, CHAPTER = r"\.{3,}|…{2,}", r"^\d{1,3}第[一二三四五六七八九十百千零〇\d]+[章节]"


def is_reference_only(content: Column) -> Column:
    """Short pointers to another place that carry no figure."""
    compact = F.regexp_replace(content, r"\s+", "")
    points = compact.rlike(POINTERS)
    place = compact.rlike(PLACES)
    return (F.length(compact) <= 80) & points & place & ~compact.rlike(r"\d+(?:\.\d+)?%")


def is_served(content: Column) -> Column:
    """Segments fit for serving: some text, no dotted leaders, no lines of a table of contents."""
    text = F.trim(F.coalesce(content, F.lit("")))
    compact = F.regexp_replace(text, r"\s+", "")
    short = F.length(compact) < 40
    return (F.length(compact) >= 12) & ~(text.rlike(LEADERS) & short) & ~(compact.rlike(CHAPTER) & short)


def is_noise(content: Column) -> Column:
    """Blocks without substance."""
    compact = F.regexp_replace(F.coalesce(content, F.lit("")), r"\s+", "")
    short = F.length(compact) < 40
    return (F.length(compact) < 8) | compact.rlike(r"^\d{1,4}$") | (content.rlike(LEADERS) & short) | (compact.rlike(CHAPTER) & short)


def fingerprint(content: Column) -> Column:
    """Hash of the content with blanks collapsed and case folded."""
    return F.sha2(F.lower(F.trim(F.regexp_replace(content, r"\s+", " "))), 256)


def keywords(text: Column, most: int = 8) -> Column:
    """First distinct words of four or more characters."""
    words = F.transform(F.split(text, r"[\s]+"), lambda w: F.lower(F.regexp_replace(w, r"""^[.,;:()\[\]{}<>"'|]+|[.,;:()\[\]{}<>"'|]+$""", "")))
    return F.slice(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 4)), 1, most)


def windows(text: Column, size: int, overlap: int) -> Column:
    """Fixed-size overlapping character windows, without a surplus tail."""
    step = size - overlap
    last = F.ceil(F.greatest(F.length(text) - size, F.lit(0)) / step).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))


def keep_first(rows: DataFrame, key: str, content: str, order: list[str], carried: list[str]) -> DataFrame:
    """First copy of each normalised text within a document: a ``min`` combined before the shuffle."""
    norm = F.md5(F.lower(F.regexp_replace(F.col(content), r"\s+", "")))
    first = F.min(F.struct(*order, *(c for c in carried if c not in order and c != key))).alias("first")
    return rows.where(F.col(content).isNotNull()).groupBy(key, norm.alias("norm")).agg(first).select(*(c if c == key else f"first.{c}" for c in carried))


def ranking_quality(ranked: DataFrame, k: int) -> DataFrame:
    """Per query: hit rate, reciprocal rank and nDCG at ``k`` of a 0/1 ``relevant`` column."""
    top = ranked.where(F.col("rank") <= k)
    gain = F.col("relevant") / F.log2(F.col("rank") + 1.0)
    ideal_place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("relevant").desc(), "rank"))
    rows = top.withColumn("gain", gain).withColumn("ideal", F.col("relevant") / F.log2(ideal_place + 1.0))
    per = rows.groupBy("query_id").agg(F.max("relevant").alias("hit"), F.max(F.when(F.col("relevant") == 1, 1.0 / F.col("rank"))).alias("rr"), F.sum("gain").alias("dcg"), F.sum("ideal").alias("idcg"))
    return per.select("query_id", "hit", F.round(F.coalesce("rr", F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce(F.try_divide("dcg", "idcg"), F.lit(0.0)), 6).alias("ndcg"))
