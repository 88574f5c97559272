"""Source health as keyed state: one value per source, and a timer that asks for a retest.

Attempts are folded before they meet the state: they are dealt by (source, hour), and a task turns each such piece into one summary
(any success, failures after the last one, last attempt). A source with a third of all attempts is thus folded in many
tasks, and its state takes one short row an hour. The state of a source is a ``ValueState``; when it becomes quarantined a timer is set
for ``retest_days`` after its last attempt, and when the watermark passes it the source is reported as due. An
attempt in the meantime moves the timer or, if it succeeds, clears it.

Attempts of one batch are taken in order of time and ``tie``; those without time come first. An attempt that arrives after
later ones of its source were counted is counted as if it had come last, though it moves no time back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PIECE = 3_600_000_000  # microseconds
EARLY = -(1 << 62)  # stands for a missing time
PIECES = "source string, piece long, won boolean, fails long, attempts long, last_attempt long, last_success long, records long, error string, start_url string, event_time timestamp"
STATE = "status string, consecutive_failures long, last_attempt long, last_success long, attempts long, last_record_count long, last_error string, start_url string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One summary per (source, hour); all rows of a piece are in this task."""
    frames = [f for f in batches if len(f)]
    if not frames:
        return
    rows = pd.concat(frames).sort_values(["source", "piece", "at", "tie"], kind="stable").reset_index(drop=True)
    piece = rows.groupby(["source", "piece"], sort=False, dropna=False)
    place = piece.cumcount()
    won = rows["ok"].astype(bool)
    last_win = place.where(won, -1).groupby([rows["source"], rows["piece"]], sort=False, dropna=False).transform("max")
    rows["fails"] = (place > last_win).astype("int64")
    rows["won_at"] = rows["at"].where(won & (rows["at"] > EARLY), EARLY)
    out = rows.groupby(["source", "piece"], sort=False, dropna=False).agg(
        won=("ok", "any"), fails=("fails", "sum"), attempts=("ok", "size"), last_attempt=("at", "max"), last_success=("won_at", "max")).reset_index()
    last = piece.tail(1)[["records", "error", "start_url"]].reset_index(drop=True)
    out = pd.concat([out, last], axis=1)
    out["event_time"] = pd.to_datetime(out["last_attempt"].where(out["last_attempt"] > EARLY, 0), unit="us")
    yield out[[f.split(" ")[0] for f in PIECES.split(", ")]]


class Health(StatefulProcessor):
    """The state machine of one source."""

    def __init__(self, retest_days: int, watch_after: int, quarantine_after: int):
        self.retest_ms, self.watch_after, self.quarantine_after = retest_days * 86_400_000, watch_after, quarantine_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("health", STATE)

    def _row(self, key: tuple, values: tuple, due: bool) -> pd.DataFrame:
        names = [f.split(" ")[0] for f in STATE.split(", ")]
        return pd.DataFrame([(key[0], *values, due)], columns=["source", *names, "due"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pieces = pd.concat(list(rows)).sort_values("piece", kind="stable")
        old = self.state.get() if self.state.exists() else ("", 0, EARLY, EARLY, 0, 0, "", "")
        _, failures, last_attempt, last_success, attempts = old[:5]
        # What the last success of all is followed by counts, or everything when nothing succeeded.
        wins = np.flatnonzero(pieces["won"].to_numpy())
        if len(wins):
            failures = int(pieces["fails"].to_numpy()[wins[-1] :].sum())
        else:
            failures += int(pieces["fails"].sum())
        last_attempt = max(last_attempt, int(pieces["last_attempt"].max()))
        last_success = max(last_success, int(pieces["last_success"].max()))
        last = pieces.iloc[-1]
        status = "healthy" if failures == 0 else "quarantined" if failures >= self.quarantine_after else "watch" if failures >= self.watch_after else "failed"
        text = lambda v: None if pd.isna(v) else str(v)
        values = (status, failures, last_attempt, last_success, attempts + int(pieces["attempts"].sum()), 0 if pd.isna(last["records"]) else int(last["records"]), text(last["error"]), text(last["start_url"]))
        self.state.update(values)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status == "quarantined" and last_attempt > EARLY:
            self.handle.registerTimer(last_attempt // 1000 + self.retest_ms)
        yield self._row(key, values, status != "quarantined")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._row(key, tuple(self.state.get()), True)

    def close(self) -> None:
        pass


def keyed_health(stream: DataFrame, source: str, at: str, ok: str, tie: str, delay: str = "0 seconds", retest_days: int = 7, watch_after: int = 3, quarantine_after: int = 7) -> DataFrame:
    """Every change of a source's health, and a row with ``due`` when a quarantined source may be tried again.

    ``stream`` has the source, time, success and tie-break of each attempt, and may have ``records``, ``error`` and ``start_url``. Times in the
    result are microseconds; ``health_table`` spells them. Needs the RocksDB state store, which ``start_health`` sets.
    """
    extra = [F.col(c).cast(t).alias(c) if c in stream.columns else F.lit(None).cast(t).alias(c) for c, t in (("records", "long"), ("error", "string"), ("start_url", "string"))]
    micros = F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(EARLY))
    rows = stream.select(F.col(source).cast("string").alias("source"), micros.alias("at"), F.coalesce(ok, F.lit(False)).alias("ok"), F.col(tie).cast("long").alias("tie"), *extra)
    rows = rows.withColumn("piece", F.floor(F.col("at") / PIECE))
    pieces = rows.repartition("source", "piece").mapInPandas(fold_pieces, PIECES).withWatermark("event_time", delay)
    return pieces.groupBy("source").transformWithStateInPandas(
        Health(retest_days, watch_after, quarantine_after), f"source string, {STATE}, due boolean", "Update", "EventTime")


def start_health(stream: DataFrame, folder: str, source: str, at: str, ok: str, tie: str, trigger: dict | None = None, **options) -> StreamingQuery:
    """Runs ``keyed_health``; each micro-batch writes its changes under its number, so a batch that is run again writes the same."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def batch(df: DataFrame, number: int) -> None:
        df.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/changes/number={number:012d}")

    changes = keyed_health(stream, source, at, ok, tie, **options)
    return changes.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", folder + "/progress").trigger(**(trigger or {"processingTime": "1 minute"})).start()


def health_changes(spark: SparkSession, folder: str) -> DataFrame:
    """All changes and retest calls so far, with the batch of each."""
    time = lambda c: F.when(F.col(c) > EARLY, F.timestamp_micros(c)).alias(c)
    rows = spark.read.parquet(f"{folder}/changes")
    return rows.select(*[time(c) if c in ("last_attempt", "last_success") else F.col(c) for c in rows.columns if c != "number"])


def health_table(spark: SparkSession, folder: str) -> DataFrame:
    """The latest row of every source."""
    rows = health_changes(spark, folder)
    return rows.groupBy("source").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "source"]), F.struct("batch", "due")).alias("r")).select("source", "r.*")
