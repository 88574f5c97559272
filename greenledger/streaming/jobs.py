"""The stateful jobs under Structured Streaming.

The archive and the health table are written as numbered versions in a shared folder, the archive bucket by bucket. Each
micro-batch reads the version before it and writes its own, so a batch that is run again after a
failure writes the same version again. Batches are reduced per key before they meet the state,
so a source or URL with a third of all rows is still spread over tasks. ``keyed_health`` keeps health as keyed state with timers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from greenledger.operators import archive as A
from greenledger.operators.health import status_of
from greenledger.session import cut
from greenledger.sources.readers import path_exists


def _version(folder: str, batch: int) -> str:
    return f"{folder}/version={batch:012d}"


def latest_version(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The newest complete version, or the newest one before a batch number."""
    if not path_exists(spark, folder):
        return None
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(hadoop)]
    numbers = sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))
    done = [n for n in numbers if (before is None or n < before) and path_exists(spark, _version(folder, n) + "/_SUCCESS")]
    return spark.read.parquet(_version(folder, done[-1])) if done else None


def _run(stream: DataFrame, folder: str, step: Callable[[DataFrame, DataFrame | None], DataFrame], trigger: dict) -> StreamingQuery:
    def batch(df: DataFrame, number: int) -> None:
        before = latest_version(df.sparkSession, folder + "/state", number)
        step(df, before).write.mode("overwrite").parquet(_version(folder + "/state", number))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", folder + "/progress").trigger(**trigger).start()


# --- the archive in buckets ----------------------------------------------------

BUCKETS = 256


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("canonical_url"), F.lit(buckets)).cast("int")


def bucket_versions(spark: SparkSession, folder: str, before: int | None = None) -> dict[int, list[int]]:
    """The complete versions of each bucket, oldest first. A version holds the buckets its batch touched; the listing has at most
    the buckets times the few versions that are not retired yet."""
    out: dict[int, list[int]] = {}
    if not path_exists(spark, folder):
        return out
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = lambda path: [s.getPath().getName() for s in fs.listStatus(path)]
    for number in sorted(int(n.split("=")[1]) for n in names(root) if n.startswith("version=")):
        if (before is None or number < before) and path_exists(spark, _version(folder, number) + "/_SUCCESS"):
            for name in names(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_version(folder, number))):
                if name.startswith("bucket="):
                    out.setdefault(int(name.split("=")[1]), []).append(number)
    return out


def _read_buckets(spark: SparkSession, folder: str, versions: dict[int, list[int]]) -> DataFrame | None:
    paths = [f"{_version(folder, numbers[-1])}/bucket={bucket}" for bucket, numbers in sorted(versions.items())]
    return spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None


def archive_state(spark: SparkSession, folder: str) -> DataFrame | None:
    """The streamed archive: the newest complete version of every bucket."""
    return _read_buckets(spark, folder + "/state", bucket_versions(spark, folder + "/state"))


def retire(spark: SparkSession, folder: str, before: int) -> int:
    """Deletes bucket versions that a newer one, complete before batch ``before``, replaces: that batch can still be run again. Returns how many went."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [(bucket, number) for bucket, numbers in bucket_versions(spark, folder, before).items() for number in numbers[:-1]]
    for bucket, number in old:
        fs.delete(path(f"{_version(folder, number)}/bucket={bucket}"), True)
    return len(old)


def merge_batch(batch: DataFrame, number: int, folder: str, as_of: Column, arrival: str | None = None, buckets: int = BUCKETS) -> int:
    """Merges a micro-batch into the archive at ``folder`` and returns the number of buckets written.

    Only buckets that hold an arriving URL are read, merged and written, as a new version beside the old one. A batch that
    is run again reads what was there before it and writes the same version again.
    """
    spark, state = batch.sparkSession, folder + "/state"
    incoming = cut(A.keyed(batch)).withColumn("bucket", _bucket(buckets))
    touched = {row["bucket"] for row in incoming.select("bucket").distinct().collect()}  # at most ``buckets`` numbers
    if not touched:
        return 0
    versions = {b: v for b, v in bucket_versions(spark, state, number).items() if b in touched}
    existing = _read_buckets(spark, state, versions)
    rows = incoming.drop("bucket")
    merged = A.merge_keyed(A.with_identity(rows.limit(0) if existing is None else existing), rows, as_of, arrival)
    merged.withColumn("bucket", _bucket(buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(_version(state, number))
    return len(touched)


def stream_archive(stream: DataFrame, folder: str, as_of: Column, arrival: str | None = None, trigger: dict | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Versioned upsert of arriving records; the state, cut by the hash of the canonical URL, is the archive. ``buckets`` stays as it was first."""

    def batch(df: DataFrame, number: int) -> None:
        merge_batch(df, number, folder, as_of, arrival, buckets)
        retire(df.sparkSession, folder + "/state", number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", folder + "/progress").trigger(**(trigger or {"processingTime": "1 minute"})).start()


# --- health by versions --------------------------------------------------------

def health_step(source: str, at: str, ok: str, tie: str) -> Callable[[DataFrame, DataFrame | None], DataFrame]:
    """Folds a batch of attempts into the health state.

    A batch is summed up per source as (any success, failures after the last one): combining two
    such summaries in order gives the summary of both, so no task ever walks one source's events.
    """

    def step(batch: DataFrame, before: DataFrame | None) -> DataFrame:
        spot = F.struct(F.col(at), F.col(tie))
        wins = batch.groupBy(source).agg(F.max(F.when(F.col(ok), spot)).alias("_win"), F.max(at).alias("last_attempt"), F.max(F.when(F.col(ok), F.col(at))).alias("last_success"), F.count("*").alias("attempts"))
        trailing = batch.filter(~F.col(ok)).join(wins.select(source, "_win"), source).filter(F.col("_win").isNull() | (spot > F.col("_win")))
        fails = trailing.groupBy(source).agg(F.count("*").alias("_fails"))
        new = wins.join(fails, source, "left").withColumn("_fails", F.coalesce("_fails", F.lit(0)))
        if before is None:
            joined = new.select(source, "_win", "_fails", *[F.col(c) for c in ("last_attempt", "last_success", "attempts")], F.lit(0).cast("long").alias("_before"))
        else:
            b = before.alias("b").join(new.alias("n"), source, "full_outer")
            joined = b.select(
                source, "n._win", F.coalesce("n._fails", F.lit(0)).alias("_fails"), F.coalesce("n.last_attempt", "b.last_attempt").alias("last_attempt"), F.coalesce("n.last_success", "b.last_success").alias("last_success"),
                (F.coalesce("b.attempts", F.lit(0)) + F.coalesce("n.attempts", F.lit(0))).alias("attempts"), F.coalesce("b.consecutive_failures", F.lit(0)).alias("_before"),
            )
        failures = F.when(F.col("_win").isNotNull(), F.col("_fails")).otherwise(F.col("_before") + F.col("_fails"))
        counted = joined.withColumn("consecutive_failures", failures)
        return counted.select(source, status_of(F.col("consecutive_failures") == 0, F.col("consecutive_failures")).alias("status"), "consecutive_failures", "last_attempt", "last_success", "attempts")

    return step


def stream_health(stream: DataFrame, folder: str, source: str, at: str, ok: str, tie: str, trigger: dict | None = None) -> StreamingQuery:
    return _run(stream, folder, health_step(source, at, ok, tie), trigger or {"processingTime": "1 minute"})


def first_arrivals(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """Running de-duplication by key within a bounded delay."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def rolling_counts(stream: DataFrame, at: str, by: str, length: str = "7 days", slide: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Counts per label over rolling windows: the stream form of the recent window."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, length, slide), by).agg(F.count("*").alias("value"))
