"""Writers: JSON lines, CSV exports, marts and dated reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Headers of the exported tables.
TASK_HEADERS = {"no": "序号", "field_id": "字段ID", "priority": "优先级", "task": "任务", "owner": "责任部门", "material": "最低材料", "purpose": "用途", "deadline": "建议时限", "status": "状态"}
GAP_HEADERS = {"metric": "指标", "current": "现状", "target": "目标", "unit": "单位", "status": "状态", "gap": "差距", "note": "说明"}
MEASURE_HEADERS = {
    "id": "编号", "name": "措施", "type": "类型", "direction": "方向", "park": "适用园区", "object": "对象/工艺", "inputs": "关键输入", "calculation": "减排计算逻辑", "economics": "经济性指标",
    "constraints": "主要约束", "status": "参数状态",
}
ADVICE_HEADERS = {"id": "编号", "name": "措施", "type": "分级", "metrics": "对应问题", "reasons": "匹配依据", "inputs": "前置数据", "calculation": "计算逻辑", "economics": "经济性", "constraints": "主要约束"}
# End of fixed values.


def write_lines(df: DataFrame, path: str) -> None:
    """Compact JSON lines, one object per row, spread over part files."""
    df.write.mode("overwrite").json(path)


def write_archive(df: DataFrame, path: str, date: str = "published_date") -> None:
    """Columnar archive, partitioned by publication month so that date windows prune."""
    month = F.coalesce(F.substring(F.col(date).cast("string"), 1, 7), F.lit("unknown"))
    df.withColumn("published_month", month).write.mode("overwrite").partitionBy("published_month").parquet(path)


def write_archive_if_changed(df: DataFrame, current: DataFrame, path: str, identity: list[str]) -> bool:
    """Writes only when the identifying columns differ from what is stored. Returns whether it wrote."""
    new, old = df.select(*identity), current.select(*identity)
    if new.exceptAll(old).isEmpty() and old.exceptAll(new).isEmpty():
        return False
    write_archive(df, path)
    return True


def export_csv(df: DataFrame, path: str, headers: dict[str, str] | list[str]) -> None:
    """Chosen columns under their export names; other columns are left out."""
    names = headers if isinstance(headers, dict) else {c: c for c in headers}
    df.select(*[F.col(c).alias(h) for c, h in names.items()]).write.mode("overwrite").csv(path, header=True, escape='"')


def write_mart(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_reports(df: DataFrame, path: str) -> None:
    """Report rows by type and date; a date written again replaces its own partition only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("report_type", "report_date").parquet(path)


def report_index(reports: DataFrame) -> DataFrame:
    """Latest date and row count per report type."""
    counted = reports.groupBy("report_type", "report_date").agg(F.count("*").alias("record_count"))
    return counted.groupBy("report_type").agg(F.max("report_date").alias("report_date"), F.max_by("record_count", "report_date").alias("record_count"))


def latest_reports(reports: DataFrame) -> DataFrame:
    newest = reports.groupBy("report_type").agg(F.max("report_date").alias("report_date"))
    return reports.join(newest, ["report_type", "report_date"], "left_semi")
