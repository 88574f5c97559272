"""Source health: consecutive failures, status, and which sources are due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from greenledger import rules
from greenledger.operators.chunked import with_run_since_reset


def status_of(ok: Column, failures: Column, watch_after: int = 3, quarantine_after: int = 7) -> Column:
    return (
        F.when(ok, "healthy")
        .when(failures >= quarantine_after, "quarantined")
        .when(failures >= watch_after, "watch")
        .otherwise("failed")
    )


def health_log(attempts: DataFrame, source: str, at: str, ok: str, tie: str, chunk_unit: str = "hour",
               watch_after: int = 3, quarantine_after: int = 7) -> DataFrame:
    """The failure counter and status after every attempt."""
    chunked = attempts.withColumn("_chunk", F.date_trunc(chunk_unit, F.col(at)))
    run = with_run_since_reset(chunked, source, "_chunk", [F.col(at), F.col(tie)], ok, "consecutive_failures").drop("_chunk")
    return run.withColumn("status", status_of(F.col(ok), F.col("consecutive_failures"), watch_after, quarantine_after))


# Names of what is kept of the last attempt.
LAST_OF = {"records": "last_record_count", "error": "last_error", "start_url": "start_url", "source_name": "source_name"}


def health_state(attempts: DataFrame, source: str, at: str, ok: str, tie: str, **options) -> DataFrame:
    """One row per source after its last attempt; ``records``, ``error``, ``start_url`` and ``source_name`` of that attempt are kept where given."""
    log = health_log(attempts, source, at, ok, tie, **options)
    last = F.struct(F.col(at), F.col(tie))
    return log.groupBy(source).agg(
        F.max_by(F.col("status"), last).alias("status"),
        F.max_by(F.col("consecutive_failures"), last).alias("consecutive_failures"),
        F.max(at).alias("last_attempt"),
        F.max(F.when(F.col(ok), F.col(at))).alias("last_success"),
        F.count("*").alias("attempts"),
        *[F.max_by(F.col(c), last).alias(name) for c, name in LAST_OF.items() if c in attempts.columns],
    )


def health_rows(state: DataFrame, name: str = "source_name") -> DataFrame:
    """The table of sources in its order: status, then name, missing ones as empty text."""
    return state.orderBy(F.coalesce("status", F.lit("")), F.coalesce(name, F.lit("")))


def due_sources(sources: DataFrame, state: DataFrame, source: str, as_of: Column, retest_days: int = 7, only: str | None = None) -> DataFrame:
    """Enabled sources that are not quarantined, or whose quarantine is old enough for a retest."""
    chosen = sources.filter(F.coalesce(F.col("enabled"), F.lit(True)))
    if only is not None:
        chosen = chosen.filter(F.col(source).cast("string") == only)
    joined = chosen.join(state.select(source, "status", "last_attempt"), source, "left")
    age = F.datediff(as_of, F.col("last_attempt").cast("date"))
    waiting = F.coalesce((F.col("status") == "quarantined") & (age < retest_days), F.lit(False))
    return joined.withColumn("due", ~waiting)


def health_summary(state: DataFrame) -> DataFrame:
    """Counts by status in the fixed label order; statuses without rows are left out, 'healthy' is not."""
    counts = state.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("value"))
    spine = state.sparkSession.createDataFrame(
        [(i, s, label) for i, (s, label) in enumerate(rules.HEALTH_LABELS)], "ord int, status string, label string"
    )
    joined = F.broadcast(spine).join(counts, "status", "left").withColumn("value", F.coalesce("value", F.lit(0)))
    return joined.filter((F.col("value") > 0) | (F.col("status") == "healthy")).orderBy("ord")
