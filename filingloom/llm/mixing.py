"""Sources mixed to target shares of all tokens (problem 9).

Tokens are summed per source; the size of the mix is the largest at which every source can reach its
share without using a text more than ``max_repeats`` times; each source's rate of repetition follows.
A document is emitted ``floor(rate)`` times plus one hash-seeded Bernoulli copy with the fraction
as its probability, so the choice is the same on every run and needs no second pass over texts.

Copies of a text under several doc_ids count as one text: the smallest doc_id stands for it. Null
texts and texts without tokens, and documents of a null source or of one without a target, are not
chosen. A target source without any text cannot reach its share; the other shares are scaled to sum
to one. Empty tables give an empty mix. Extra columns are ignored. Sources may be as skewed as they
like: both aggregates combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingloom.llm.tokens import TOKENIZER, token_count
from filingloom.session import materialise

SEED = 20_240_601


def _unit(key: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by the key."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / F.lit(float(1 << 53))


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(chosen records with repeat counts, shares reached per source)."""
    # the table of targets is fixed: one row per source
    wanted = F.broadcast(targets.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")))
    sized = documents.join(wanted.select("source"), "source", "left_semi").select("doc_id", "source", F.sha2("text", 256).alias("text_key"), token_count(F.col("text"), tokenizer).alias("n_tokens"))
    texts = materialise(sized.where("n_tokens > 0").groupBy("text_key").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("d")).select("d.*"))
    held = texts.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("texts"))
    every = Window.partitionBy(F.lit(1))  # over the few rows of the target table
    rates = wanted.join(held, "source").withColumn("share", F.col("target_share") / F.sum("target_share").over(every))
    rates = rates.withColumn("size", F.min(F.col("max_repeats") * F.col("tokens") / F.col("share")).over(every)).withColumn("rate", F.least(F.col("share") * F.col("size") / F.col("tokens"), F.col("max_repeats").cast("double")))
    whole = F.floor("rate")
    copies = (whole + (_unit(F.col("doc_id"), seed) < F.col("rate") - whole).cast("int")).cast("int")
    chosen = texts.join(F.broadcast(rates.select("source", "rate")), "source").withColumn("repeats", copies).where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"), F.count(F.lit(1)).alias("used_texts"), F.max("repeats").alias("most_repeats"))
    shares = wanted.join(rates.select("source", "tokens", "texts", "rate"), "source", "left").join(used, "source", "left")
    shares = shares.withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0))).withColumn("reached_share", F.try_divide("used_tokens", F.sum("used_tokens").over(every)))
    return chosen, shares.select("source", "target_share", "reached_share", "max_repeats", "most_repeats", "rate", "texts", "used_texts", "tokens", "used_tokens")
