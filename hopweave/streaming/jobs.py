"""Job control over event tables: budgets, log caps, retention, summaries; as batches and as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TERMINAL = ["done", "failed"]


def spend(events: DataFrame, job: str, order: str, cost: str, ceiling: float) -> DataFrame:
    """events with spent (running total) and granted (the total stays within the ceiling)."""
    w = W.partitionBy(job).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return events.withColumn("spent", F.sum(cost).over(w)).withColumn("granted", F.col("spent") <= ceiling)


def cap_log(log: DataFrame, job: str, order: str, most: int = 5000) -> DataFrame:
    return log.withColumn("_k", F.row_number().over(W.partitionBy(job).orderBy(order))).where(F.col("_k") <= most).drop("_k")


def dropped_log(log: DataFrame, job: str, most: int = 5000) -> DataFrame:
    return log.groupBy(job).agg(F.greatest(F.count("*") - most, F.lit(0)).alias("dropped"))


def expired(jobs: DataFrame, as_of: Column, retention_seconds: int) -> DataFrame:
    """Finished jobs idle for the retention or longer; live jobs never."""
    return jobs.where(F.col("status").isin(TERMINAL) & (F.unix_timestamp(as_of) - F.unix_timestamp("updated_at") >= retention_seconds))


def sweep_seconds(retention_seconds: float) -> float:
    return min(max(retention_seconds / 20, 1.0), 300.0)


def summaries(jobs: DataFrame, as_of: Column, most: int = 50) -> DataFrame:
    """Newest first; a running job's elapsed time is counted up to now."""
    live = F.round((F.unix_millis(as_of) - F.unix_millis("created_at")) / 1000, 2)
    return jobs.orderBy(F.desc("created_at"), "job_id").limit(most).withColumn("elapsed_s", F.when(F.col("status") == "running", live).otherwise(F.col("elapsed_s")))


def stream_totals(events: DataFrame, job: str, cost: str, ts: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """Running counters of each job and hour over a stream of events."""
    return events.withWatermark(ts, lateness).groupBy(F.window(ts, "1 hour").alias("w"), job).agg(F.count("*").alias("events"), F.sum(cost).alias("spent")).select(F.col("w.start").alias("hour"), job, "events", "spent")


def snapshot(events: DataFrame, job: str, kind: str, cost: str, kinds: list[str]) -> DataFrame:
    """One row of counters per job: what was spent on each kind, and in all."""
    return events.groupBy(job).agg(*[F.coalesce(F.sum(F.when(F.col(kind) == k, F.col(cost))), F.lit(0)).alias(k) for k in kinds], F.sum(cost).alias("total"))
