"""Running values per key without giving one key to one task.

A key may own a third of all rows, so a window over the key alone would be one huge group.
Rows are cut into (key, chunk) groups, where the chunk follows the row order (a time bucket);
each group is scanned on its own, and a second, tiny scan over the chunk summaries carries
the value across chunk borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _carried(rows: DataFrame, carry: DataFrame, key: str, chunk: str) -> DataFrame:
    """Rows with their chunk's ``_carry``; a null key or chunk (a row without time) meets its own, and comes first."""
    side = carry.select(F.col(key).alias("_carry_key"), F.col(chunk).alias("_carry_chunk"), "_carry")
    same = F.col(key).eqNullSafe(F.col("_carry_key")) & F.col(chunk).eqNullSafe(F.col("_carry_chunk"))
    return rows.join(side, same).drop("_carry_key", "_carry_chunk")


def with_previous(df: DataFrame, key: str, chunk: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds the value of the row before, across chunk borders; null on the key's first row."""
    local = W.partitionBy(key, chunk).orderBy(*order)
    marked = df.withColumns({"_prev": F.lag(value).over(local), "_pos": F.row_number().over(local)})
    last = marked.groupBy(key, chunk).agg(F.max_by(F.col(value), F.col("_pos")).alias("_last"))
    carry = last.withColumn("_carry", F.lag("_last").over(W.partitionBy(key).orderBy(chunk))).drop("_last")
    joined = _carried(marked, carry, key, chunk)
    return joined.withColumn(out, F.when(F.col("_pos") == 1, F.col("_carry")).otherwise(F.col("_prev"))).drop(
        "_prev", "_pos", "_carry"
    )


def with_running_sum(df: DataFrame, key: str, chunk: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds the running sum of ``value`` within the key, in order."""
    local = W.partitionBy(key, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = df.withColumn("_local", F.sum(value).over(local))
    before = W.partitionBy(key).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    total = df.groupBy(key, chunk).agg(F.sum(value).alias("_sum"))
    carry = total.withColumn("_carry", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    return _carried(marked, carry, key, chunk).withColumn(out, F.col("_local") + F.col("_carry")).drop("_local", "_carry")


def with_run_since_reset(df: DataFrame, key: str, chunk: str, order: list[Column], reset: str, out: str) -> DataFrame:
    """Adds the number of rows since the last row where ``reset`` holds (that row counts as zero)."""
    local = W.partitionBy(key, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = df.withColumn("_step", F.when(F.col(reset), 0).otherwise(1)).withColumn("_cum", F.sum("_step").over(local))
    marked = marked.withColumn("_mark", F.max(F.when(F.col(reset), F.col("_cum"))).over(local))
    before = W.partitionBy(key).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    summary = marked.groupBy(key, chunk).agg(F.max("_cum").alias("_total"), F.max("_mark").alias("_at"))
    carry = (
        summary.withColumn("_done", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .withColumn("_from", F.coalesce(F.max(F.col("_done") + F.col("_at")).over(before), F.lit(0)))
        .select(key, chunk, (F.col("_done") - F.col("_from")).alias("_carry"))
    )
    run = F.when(F.col("_mark").isNotNull(), F.col("_cum") - F.col("_mark")).otherwise(F.col("_cum") + F.col("_carry"))
    return _carried(marked, carry, key, chunk).withColumn(out, run).drop("_step", "_cum", "_mark", "_carry")
