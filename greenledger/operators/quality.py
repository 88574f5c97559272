"""Data-quality rules as violation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from greenledger import rules
from greenledger.functions import text as T
from greenledger.functions.scoring import with_columns_present

# The twelve declared rules. Those marked "row" are checked below.
RULES = [
    ("Q01", "无来源URL/原文件不得入正式库", "隔离到staging", "阻断"),
    ("Q02", "缺年份或统计周期", "不得对标或进入趋势", "阻断"),
    ("Q03", "缺空间边界或园区/市级口径混用", "证据降为C，禁止排名", "阻断"),
    ("Q04", "单位不在数据字典或转换关系不明", "报错，人工确认", "阻断"),
    ("Q05", "同一指标多来源冲突", "保留多来源记录，按权威性、时间和边界审批", "高"),
    ("Q06", "代理数据", "只能用于预评估情景，界面醒目标识", "高"),
    ("Q07", "绿电/绿证重复声明", "按证书ID、期间、受益主体去重", "阻断"),
    ("Q08", "排放因子用途混用（组织/产品/910验收）", "方法引擎拒绝调用", "阻断"),
    ("Q09", "强度指标分子分母年份或边界不一致", "不计算", "阻断"),
    ("Q10", "项目案例预期值被用作目标园区默认参数", "禁止；必须新建目标项目参数记录", "阻断"),
    ("Q11", "低于A/B证据的政策核心指标", "显示“待核验”，不判定达标", "高"),
    ("Q12", "数据更新后旧报告未重算", "标记过期并触发重算", "高"),
]
# End of fixed values.


def violations(observations: DataFrame, key: str, units: list[str], as_of: Column | None = None) -> DataFrame:
    """(key, rule) rows for what one observation shows by itself: one pass, no shuffle.

    Reads ``source_url``, ``period``, ``boundary``, ``value``, ``unit`` and ``date``. G rules come
    from the governance list: a number needs a unit, sources use HTTPS, no date after collection. Where they are given:
    ``proxy`` data outside ``use`` "pre_assessment" (Q06), a factor's ``factor_purpose`` against what it is ``used_for`` (Q08), a default
    parameter whose ``origin`` is "project_case" (Q10), a ``core_metric`` whose ``evidence_grade`` is not A or B (Q11).
    """
    o = with_columns_present(observations, ("source_url", "period", "boundary", "value", "unit", "date", "proxy", "use", "factor_purpose", "used_for", "origin", "core_metric", "evidence_grade"))
    empty = lambda n: T.text_or_empty(F.col(n)) == ""
    unknown_unit = ~empty("unit") & ~F.col("unit").isin(units)
    late = (F.col("date").cast("date") > as_of) if as_of is not None else F.lit(False)
    found = F.array(
        F.when(empty("source_url"), "Q01"),
        F.when(empty("period"), "Q02"),
        F.when(empty("boundary"), "Q03"),
        F.when(unknown_unit, "Q04"),
        F.when(T.is_true(F.col("proxy")) & (T.text_or_empty(F.col("use")) != "pre_assessment"), "Q06"),
        F.when(~empty("factor_purpose") & ~empty("used_for") & (F.col("factor_purpose") != F.col("used_for")), "Q08"),
        F.when(T.text_or_empty(F.col("origin")) == "project_case", "Q10"),
        F.when(T.is_true(F.col("core_metric")) & ~T.text_or_empty(F.col("evidence_grade")).isin("A", "B"), "Q11"),
        F.when(~empty("value") & empty("unit"), "G01"),
        F.when(~empty("source_url") & ~F.col("source_url").startswith("https://"), "G02"),
        F.when(late, "G03"),
    )
    return o.select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("rule_id"))


def conflicting_values(observations: DataFrame, by: list[str], value: str) -> DataFrame:
    """Q05: one metric, several values. Least and largest value suffice to see it."""
    return observations.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("rows")).filter(F.col("low") < F.col("high"))


def dependency_violations(rows: DataFrame, by: list[str], determined: dict[str, str], witness: str) -> DataFrame:
    """Where ``by`` doesn't determine a column: one grouped pass over all of ``determined`` (column to rule), with the two rows that show it.

    Q05: metric, site, year and boundary determine the value. Q09: a ratio determines the year and the boundary of its numerator and
    denominator. Least and largest value, and a witness of each, are combined in the tasks, so a group of any size is four values
    per column; missing values show nothing.
    """
    ends = []
    for column in determined:
        spot = F.when(F.col(column).isNotNull(), F.struct(F.col(column).alias("value"), F.col(witness).alias("witness")))
        ends += [F.min(spot).alias(f"_low_{column}"), F.max(spot).alias(f"_high_{column}")]
    folded = rows.groupBy(*by).agg(F.count("*").alias("rows"), *ends)
    shown = F.array(*[
        F.when(F.col(f"_low_{c}.value") < F.col(f"_high_{c}.value"), F.struct(
            F.lit(rule).alias("rule_id"), F.lit(c).alias("column"), *[F.col(f"_{end}_{c}.value").cast("string").alias(end) for end in ("low", "high")],
            *[F.col(f"_{end}_{c}.witness").alias(f"{end}_witness") for end in ("low", "high")]))
        for c, rule in determined.items()
    ])
    return folded.select(*by, "rows", F.explode(F.filter(shown, lambda x: x.isNotNull())).alias("f")).select(*by, "rows", "f.*")


def stale_reports(dependencies: DataFrame, versions: DataFrame, report: str = "report_id", given: str = "input_id", version: str = "version") -> DataFrame:
    """Q12: reports that must be computed again, with how many of their inputs have changed and the first of them.

    ``dependencies`` has a row for every input a report was computed from, with the version used; ``versions`` the current version of each input.
    What no current (input, version) pair matches is stale: an anti-join, so an input that is gone counts too. An input that a third of all
    reports use is one row of ``versions``; its dependencies are spread by the join's skew handling and folded per report.
    """
    current = versions.select(given, version).distinct()
    stale = dependencies.join(current, [given, version], "left_anti")
    return stale.groupBy(report).agg(F.countDistinct(given).alias("stale_inputs"), F.min(given).alias("first_input"))


def repeated_keys(rows: DataFrame, by: list[str]) -> DataFrame:
    """Q07 and the unique park id: keys that occur more than once."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def summary(found: DataFrame) -> DataFrame:
    """Violations per rule with handling and severity."""
    table = found.sparkSession.createDataFrame(RULES, "rule_id string, rule string, handling string, severity string")
    counts = found.groupBy("rule_id").agg(F.count("*").alias("violations"))
    return counts.join(F.broadcast(table), "rule_id", "left")


def coordinate_audit(parks: DataFrame) -> DataFrame:
    """Range, metadata and domestic-box checks per park (public park columns)."""
    lat, lon = F.col("lat"), F.col("lon")
    in_range = lat.between(-90, 90) & lon.between(-180, 180)
    described = (F.col("coordinate_precision") != "") & (F.col("coordinate_status") != "")
    boxed = (F.col("scope") != rules.DOMESTIC) | (lon.between(70, 140) & lat.between(15, 55))
    return parks.select("park_id", F.coalesce(in_range, F.lit(False)).alias("in_range"), F.coalesce(described, F.lit(False)).alias("described"),
                        F.coalesce(boxed, F.lit(False)).alias("in_box")).withColumn("passed", F.col("in_range") & F.col("described") & F.col("in_box"))


def mart_checks(parks: DataFrame, updates: DataFrame) -> DataFrame:
    """Empty parks are an error, empty updates a warning."""
    one = lambda df, name, level: df.limit(1).agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), F.when(F.col("n") > 0, "ok").otherwise(level).alias("status"))
    return one(parks, "parks", "error").unionByName(one(updates, "updates", "warning"))
