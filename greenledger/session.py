"""Session and lineage helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "greenledger", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="greenledger-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder the session names for checkpoints: every executor must reach it. One JVM alone may make one up."""
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="greenledger-")
    if not known.isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of an executor and ends the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_made: list[str] = []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes inside go at the end: for work whose result is then in a place of its own."""
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            remove(spark, path)
        del _made[before:]


def written(df: DataFrame, row_group: int | None = None) -> DataFrame:
    """A Parquet table in the shared folder, read again: for loops of joins. A checkpoint keeps the constraints the optimizer
    inferred, and with aliases in every round those multiply until planning takes longer than the work. ``row_group``: bytes of
    a row group, for wide rows; Parquet looks at its size every 100 rows."""
    path = f"{shared_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    _made.append(path)
    (df.write.option("parquet.block.size", row_group) if row_group else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
