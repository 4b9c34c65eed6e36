"""One surviving record per group of conflicting candidates (problem 4).

Two operators, as the project's order leaves nothing to vote on: in it provenance outranks any number
of agreeing values, and the candidate id tells the last two candidates apart.

* ``field_sources``, ``survivors``: per group and field the best candidate that has the field, in that
  order. It is a maximum, taken in one pass and in any order of rows. No value is aligned here.
* ``consensus``: token-level consensus, where agreement can outvote a lone candidate. Per group and
  field the distinct values are aligned one after the other, best first, to a growing profile of
  columns (progressive alignment); every column elects the token of the largest summed trust; the
  existing value closest to the elected text survives.

For the consensus, values are first aggregated to one row per group, field and text. No task gets more
than about ``SHARD`` values of a group: larger groups are cut into shards by the hash of the text, the
winners of the shards meet in the next round with the votes of their shard, until one is left.

Absent is null, blank or one of ``ABSENT``. Null flags count as false, null numbers as 0, a null
document as the empty text. Rows with a null group key form no group. A group whose field is absent
everywhere yields no row for it; a group of one candidate yields none either. Exact repeats are told
apart by their candidate id. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.session import materialise

FIELDS = ("value", "unit", "currency", "source_type")
KEYS = ("company_id", "metric_key", "period")
#: Values of a group that are aligned in one task.
SHARD = 64

#: Marks for "not given" or "unknown", lower case.
ABSENT = (
    "-", "--", "---", "–", "—", "——", "―", "−", ".", "..", "...", "…", "/", "\\", "?", "*", "n/a", "n.a.", "n.a", "na", "#n/a", "nan", "null", "none", "nil", "(null)", "<na>",
    "unknown", "unk", "unspecified", "not given", "not available", "not disclosed", "not stated", "not applicable", "not reported", "not known", "undisclosed", "missing", "tbd", "tba",
    "不适用", "未知", "未披露", "未提供", "无", "不详", "不明", "暂无", "空", "k.a.", "keine angabe", "unbekannt",
)


def present(field: str) -> Column:
    text = F.lower(F.regexp_replace(F.col(field), r"^[\s 　​﻿]+|[\s 　​﻿]+$", ""))
    return F.col(field).isNotNull() & (text != "") & ~text.isin(*ABSENT)


def _rank() -> Column:
    provenance, grounded = (F.coalesce(c, F.lit(False)) for c in ("has_provenance", "is_grounded"))
    return F.struct(
        (provenance & grounded).alias("both"), grounded.alias("grounded"), provenance.alias("provenance"),
        F.coalesce("source_priority", F.lit(0)).alias("priority"), F.coalesce("document_year", F.lit(0)).alias("year"),
        F.coalesce("document_id", F.lit("")).alias("document"), F.coalesce(F.unix_micros(F.col("extracted_at").cast("timestamp")), F.lit(-(2**62))).alias("seen"), F.col("candidate_id").alias("candidate_id"),
    )


def _grouped(candidates: DataFrame) -> DataFrame:
    return candidates.where(" AND ".join(f"{k} IS NOT NULL" for k in KEYS))


_TOKEN = re.compile(r"\d|[^\W\d_]+|[^\w\s]|_")


def tokens(text: str) -> list[str]:
    """Single digits, words and signs."""
    return _TOKEN.findall(text)


def extend_profile(profile: list[dict[str, float]], row: list[str], weight: float, vote: str) -> None:
    """Align a row of tokens to the columns of the profile, at least cost, and add its votes.

    A token that is not in a column costs one, as does a column passed over; tokens without a column
    open a new one, in which the rows before count as empty.
    """
    n, m = len(row), len(profile)
    cost = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (row[i - 1] not in profile[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    so_far = {"": _add(profile, vote)}
    merged: list[dict[str, float]] = []
    i, j = n, m
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (row[i - 1] not in profile[j - 1]):
            i, j = i - 1, j - 1
            merged.append(_voted(profile[j], row[i], weight, vote))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            merged.append(_voted(dict(so_far) if so_far[""] is not None else {}, row[i], weight, vote))
        else:
            j -= 1
            merged.append(_voted(profile[j], "", weight, vote))
    profile[:] = reversed(merged)


def _voted(column: dict[str, float], token: str, weight: float, vote: str) -> dict[str, float]:
    column[token] = max(column.get(token, weight), weight) if vote == "rank" else column.get(token, 0.0) + weight
    return column


def _add(profile: list[dict[str, float]], vote: str) -> float | None:
    """Votes of all rows aligned so far; none before the first."""
    if not profile:
        return None
    return max(profile[0].values()) if vote == "rank" else sum(profile[0].values())


def elect(texts: list[str], weights: list[float], vote: str) -> int:
    """Index of the text closest to the consensus; of equally close ones the first.

    A token's votes are the ``sum`` of its weights, as in ``consensus``, or the largest (``rank``), which no query asks for.
    """
    if len(texts) == 1:
        return 0
    profile: list[dict[str, float]] = []
    rows = [tokens(t) for t in texts]
    for row, weight in zip(rows, weights):
        extend_profile(profile, row, weight, vote)
    elected = [t for t in (max(column, key=lambda t: (column[t], t)) for column in profile) if t]
    return min(range(len(texts)), key=lambda k: (_distance(rows[k], elected), k))


def _distance(a: list[str], b: list[str]) -> int:
    if a == b:
        return 0
    last = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
        last = row
    return last[-1]


def _values(candidates: DataFrame) -> DataFrame:
    """One row per group, field and text: its best rank, its summed trust and its support."""
    provenance, grounded = (F.coalesce(c, F.lit(False)) for c in ("has_provenance", "is_grounded"))
    # agreement counts, and more so of candidates with a source
    trust = (1 + 4 * (provenance & grounded).cast("int") + 2 * grounded.cast("int") + provenance.cast("int")).cast("double")
    entries = F.array(*(F.when(present(f), F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text"))) for f in FIELDS))
    long = _grouped(candidates).select(*KEYS, _rank().alias("rank"), trust.alias("weight"), F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e"))
    return long.groupBy(*KEYS, "e.field_name", "e.text").agg(F.max("rank").alias("rank"), F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("support"))


def _elected(values: DataFrame) -> DataFrame:
    """The value elected by trust of every group and field, in rounds of bounded shards."""
    keys = [*KEYS, "field_name"]

    @F.pandas_udf("int")
    def closest(texts: pd.Series, weights: pd.Series) -> pd.Series:
        return pd.Series([elect(list(t), [float(w) for w in ws], "sum") for t, ws in zip(texts, weights)], dtype="int32")

    while True:
        values = materialise(values)
        sizes = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        large = not sizes.where(F.col("n") > SHARD).isEmpty()
        # without a large group there is one shard each, and nothing to look up
        shard = F.pmod(F.xxhash64("text"), F.ceil(F.col("n") / SHARD)) if large else F.lit(0).cast("long")
        joined = (values.join(sizes, keys) if large else values).withColumn("shard", shard)
        ordered = F.sort_array(F.collect_list(F.struct("rank", "text", "weight", "support")), asc=False)
        grouped = joined.groupBy(*keys, "shard").agg(ordered.alias("v"))
        # one value alone needs no vote
        best = F.when(F.size("v") > 1, closest(F.transform("v", lambda x: x["text"]), F.transform("v", lambda x: x["weight"]))).otherwise(0)
        chosen = grouped.withColumn("best", best).withColumn("w", F.get("v", F.col("best")))
        carried = F.aggregate("v", F.lit(0.0), lambda t, x: t + x["weight"])
        rows = chosen.select(*keys, "w.text", "w.rank", carried.alias("weight"), "w.support")
        if not large:
            return rows
        values = rows


def _groups(candidates: DataFrame) -> DataFrame:
    return _grouped(candidates).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("candidates")).where("candidates >= 2")


def _best(candidates: DataFrame, carried: Callable[[str], Column]) -> DataFrame:
    """One row per group of two or more: its size and, per field, what its best candidate carries."""
    ranked = _grouped(candidates).select(*KEYS, *FIELDS, _rank().alias("rank"))
    best = (F.max(F.when(present(f), carried(f))).alias(f) for f in FIELDS)
    return ranked.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("candidates"), *best).where("candidates >= 2")


def field_sources(candidates: DataFrame) -> DataFrame:
    """The survivors in long form: one row per group and field that any candidate has."""
    best = _best(candidates, lambda f: F.col("rank"))
    entries = F.array(*(F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("field_name"), F.col(f"{f}.candidate_id").alias("candidate_id"))) for f in FIELDS))
    return best.select(*KEYS, F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).select(*KEYS, "e.field_name", "e.candidate_id")


def survivors(candidates: DataFrame) -> DataFrame:
    """One record per group: each field with the candidate that supplies it."""
    best = _best(candidates, lambda f: F.struct("rank", F.col(f).alias("text")))
    return best.select(*KEYS, "candidates", *(c for f in FIELDS for c in (F.col(f"{f}.text").alias(f), F.col(f"{f}.rank.candidate_id").alias(f"{f}_from"))))


def consensus(candidates: DataFrame) -> DataFrame:
    """Per group and field the existing value closest to the vote weighted by trust."""
    best = _elected(_values(candidates)).join(_groups(candidates), list(KEYS))
    return best.select(*KEYS, "field_name", F.trim("text").alias("consensus"), "support", "candidates")
