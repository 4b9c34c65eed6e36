"""Texts packed into containers of fixed capacity (problem 8).

Sum-of-squares online packing: a document goes to the fill level that minimises the sum of the
squared counts of partly filled containers; a level array holds the counts, so one placement looks
at levels, never at containers. Ties go to the fuller level, then to the container opened last.

A text longer than the capacity is cut into full windows, each a container of its own, and a rest
that is packed like any text. The stream is cut into shards of about ``SHARD_ROWS`` texts by a hash
of the key, packed independently: a shard is a bounded amount of memory (two integers a text), the
number of shards follows the data, and the space lost is a few open containers per shard.

Texts without tokens (null or empty) take no space and have no container (null id, fill 0). An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.llm.tokens import TOKENIZER, token_count
from filingloom.session import materialise

CAPACITY = 2048
SHARD_ROWS = 65_536


def sum_of_squares(sizes: Iterable[int], capacity: int) -> list[int]:
    """Container number of each size, in the order given."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    placed, opened = [], 0
    for size in sizes:
        if size == capacity:
            placed.append(opened)
            opened += 1
            continue
        room = capacity - size
        before, after = counts[: room + 1], counts[size:]
        change = 2 * (after - before) + 2
        change[room] = 1 - 2 * before[room]  # a full container leaves the counts
        change = np.where(before > 0, change, np.iinfo(np.int64).max)
        change[0] = 2 * counts[size] + 1
        level = room - int(np.argmin(change[::-1]))
        if level:
            bin_no = open_at[level].pop()
            counts[level] -= 1
        else:
            bin_no, opened = opened, opened + 1
        placed.append(bin_no)
        if level + size < capacity:
            counts[level + size] += 1
            open_at[level + size].append(bin_no)
    return placed


def pack(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Container of each text or piece, with the container's fill.

    Returns ``doc_id, piece_no, token_start, n_tokens, container_id, container_fill, container_items``.
    """
    # counted once: the tokens are read by both branches below
    sized = materialise(documents.select("doc_id", token_count(F.col("text"), tokenizer).alias("n")))
    shards = max(1, math.ceil(sized.count() / shard_rows))
    full = F.floor(F.col("n") / capacity).cast("int")
    windows = sized.where(f"n >= {capacity}").select("doc_id", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece_no"))
    windows = windows.select(
        "doc_id", "piece_no", (F.col("piece_no") * capacity).alias("token_start"), F.lit(capacity).alias("n_tokens"),
        F.concat_ws("-", F.lit("w"), "doc_id", "piece_no").alias("container_id"), F.lit(capacity).alias("container_fill"), F.lit(1).alias("container_items"),
    )
    nothing = sized.where("n = 0").select(
        "doc_id", F.lit(0).alias("piece_no"), F.lit(0).alias("token_start"), F.lit(0).alias("n_tokens"), F.lit(None).cast("string").alias("container_id"), F.lit(0).alias("container_fill"), F.lit(0).alias("container_items"),
    )
    rests = sized.where(f"n % {capacity} > 0").select("doc_id", full.alias("piece_no"), (full * capacity).alias("token_start"), (F.col("n") % capacity).alias("n_tokens"), F.xxhash64("doc_id").alias("h"))
    rests = rests.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))

    def packed(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["h", "doc_id", "piece_no"], kind="stable", ignore_index=True)
        bins = pd.Series(sum_of_squares(shard["n_tokens"].tolist(), capacity))
        by_bin = shard["n_tokens"].groupby(bins)
        return pd.DataFrame({
            "doc_id": shard["doc_id"], "piece_no": shard["piece_no"], "token_start": shard["token_start"], "n_tokens": shard["n_tokens"],
            "container_id": "s" + shard["shard"].astype(str) + "-" + bins.astype(str), "container_fill": by_bin.transform("sum"), "container_items": by_bin.transform("size"),
        })

    schema = "doc_id bigint, piece_no int, token_start int, n_tokens int, container_id string, container_fill int, container_items int"
    return rests.groupBy("shard").applyInPandas(packed, schema).unionByName(windows).unionByName(nothing)
