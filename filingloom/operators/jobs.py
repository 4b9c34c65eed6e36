"""The leased job queue: snapshots, and its state machine as a batch replay and a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("queued", "running", "retry_wait", "succeeded", "failed", "cancelled")


#: Thresholds from which on the queue is reported.
OLDEST_READY_SECONDS, RETRY_BACKLOG, RECENT_FAILURES, FAILURE_SECONDS = 300.0, 5, 1, 3600


def queue_metrics(jobs: DataFrame, now: Column) -> DataFrame:
    """Counts by status, active workers, expired leases, recent failures, age of the oldest ready job.

    ``alerts`` are the codes of what is out of bounds; an expired lease or a failure makes it critical.
    """
    running = F.col("status") == "running"
    expired = running & (F.col("lease_expires_at") <= now)
    ready = F.when(F.col("status") == "queued", F.col("created_at")).when((F.col("status") == "retry_wait") & (F.col("available_at").isNull() | (F.col("available_at") <= now)), F.coalesce("available_at", "updated_at"))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    row = jobs.agg(
        *counts, F.countDistinct(F.when(running & ~F.coalesce(expired, F.lit(False)), F.nullif(F.col("worker_id"), F.lit("")))).alias("active_workers"), F.count_if(expired).alias("expired_leases"),
        F.count_if((F.col("status") == "failed") & (F.col("updated_at") >= now - F.expr(f"INTERVAL {FAILURE_SECONDS} SECONDS"))).alias("recent_failures"), F.count_if(F.col("cancel_requested_at").isNotNull()).alias("cancel_requests"), F.min(ready).alias("oldest_ready"),
    )
    age = F.greatest((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("oldest_ready").cast("timestamp"))) / 1e6, F.lit(0.0))
    row = row.withColumn("oldest_ready_seconds", F.when(F.col("oldest_ready").isNotNull(), F.round(age, 3)))
    critical = F.array(F.when(F.col("expired_leases") > 0, "expired_worker_lease"), F.when(F.col("recent_failures") >= RECENT_FAILURES, "recent_ingestion_failures"))
    warnings = F.array(F.when(F.col("oldest_ready_seconds") >= OLDEST_READY_SECONDS, "oldest_ready_age_high"), F.when(F.col("retry_wait") >= RETRY_BACKLOG, "retry_wait_backlog"))
    row = row.withColumn("alerts", F.array_join(F.concat(critical, warnings), ","))
    health = F.when(F.exists(critical, lambda c: c.isNotNull()), "critical").when(F.col("alerts") != "", "warning").otherwise("ok")
    return row.withColumn("health", health)


LEASE_SECONDS, MAX_ATTEMPTS = 60, 3
STATE = "status string, attempt int, worker_id string, lease_until double, cancel boolean"
TRANSITION = "job_id string, seq long, action string, accepted boolean, status string, attempt int, worker_id string"


def step(state: tuple, action: str, at: float, worker: str | None) -> tuple[tuple, bool]:
    """One action on a job: (next state, accepted). A single writer per key replaces row locks.

    ``claim`` takes a queued job, one whose retry is due or one whose lease ran out; ``heartbeat``,
    ``succeed`` and ``fail`` need the lease; ``cancel`` ends a waiting job and marks a running one.
    """
    status, attempt, owner, until, cancel = state
    held = status == "running" and owner == worker and at < until
    if action == "submit":
        return (("queued", 0, None, 0.0, False), True) if status is None else (state, False)
    if action == "claim":
        free = status in ("queued", "retry_wait") or (status == "running" and at >= until)
        return (("running", attempt + 1, worker, at + LEASE_SECONDS, cancel), True) if free and not cancel else (state, False)
    if action == "heartbeat":
        return ((status, attempt, owner, at + LEASE_SECONDS, cancel), True) if held else (state, False)
    if action in ("succeed", "fail") and held:
        if cancel:
            return ("cancelled", attempt, None, 0.0, True), True
        if action == "succeed":
            return ("succeeded", attempt, None, 0.0, False), True
        return ("retry_wait" if attempt < MAX_ATTEMPTS else "failed", attempt, None, 0.0, False), True
    if action == "cancel" and status in ("queued", "retry_wait"):
        return ("cancelled", attempt, None, 0.0, True), True
    if action == "cancel" and status == "running":
        return (status, attempt, owner, until, True), True
    return state, False


_NEW = (None, 0, None, 0.0, False)


def replay(actions: DataFrame) -> DataFrame:
    """Apply ``(job_id, seq, action, at, worker_id)`` in order, one job per task."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = _NEW, []
        for row in pdf.sort_values("seq").itertuples(index=False):
            state, accepted = step(state, row.action, row.at, row.worker_id)
            out.append((key[0], row.seq, row.action, accepted, state[0], state[1], state[2]))
        return pd.DataFrame(out, columns=["job_id", "seq", "action", "accepted", "status", "attempt", "worker_id"])

    return actions.groupBy("job_id").applyInPandas(run, TRANSITION)


def stream_replay(actions: DataFrame) -> DataFrame:
    """The same machine over a stream; a job's state lives in the state store between batches."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state = tuple(kept.get) if kept.exists else _NEW
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for row in rows.itertuples(index=False):
            state, accepted = step(state, row.action, row.at, row.worker_id)
            out.append((key[0], row.seq, row.action, accepted, state[0], state[1], state[2]))
        kept.update(state)
        yield pd.DataFrame(out, columns=["job_id", "seq", "action", "accepted", "status", "attempt", "worker_id"])

    return actions.groupBy("job_id").applyInPandasWithState(run, TRANSITION, STATE, "append", GroupStateTimeout.NoTimeout)
