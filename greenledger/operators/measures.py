"""Measure classes, screening and recommendations.

A score depends only on a measure's class and a site's profile. Measures are cut to the best ids
per class and sites are reduced to distinct profiles before the two meet, so neither a long
catalogue nor many sites multiply; the cut is exact because ids only break ties within a class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from greenledger import rules
from greenledger.functions import text as T
from greenledger.functions.scoring import any_term, first_match, with_columns_present

MEASURE_TEXTS = ("tech_id", "一级方向", "二级措施", "适用园区", "对象/工艺", "关键输入参数", "减排计算逻辑", "经济性指标", "主要约束", "成熟度", "备注", "参数状态")


def _joined(*names: str) -> Column:
    return F.concat_ws(" ", *[T.text_or_empty(F.col(f"`{n}`")) for n in names])


def _class_text() -> Column:
    return _joined("一级方向", "二级措施", "对象/工艺", "主要约束", "备注")


def screening_class(text: Column, conditional: list[str] = rules.SCREEN_CONDITIONAL, basic: list[str] = rules.SCREEN_BASIC) -> Column:
    return F.when(any_term(text, conditional), rules.CONDITIONAL).when(any_term(text, basic), rules.BASIC).otherwise(rules.SPECIAL)


def board_class(text: Column) -> Column:
    return screening_class(text, basic=rules.BOARD_BASIC)


def tier(primary: Column, constraints: Column, conditional: list[str] = rules.TIER_CONDITIONAL, basic: list[str] = rules.TIER_BASIC, limits: list[str] = rules.TIER_CONSTRAINTS) -> Column:
    return (
        F.when(any_term(primary, conditional), rules.CONDITIONAL)
        .when(any_term(primary, basic), rules.BASIC)
        .when(any_term(constraints, limits), rules.CONDITIONAL)
        .otherwise(rules.SPECIAL)
    )


def owner_of(text: Column, table: list[tuple[str, str]] = rules.OWNER_TERMS) -> Column:
    return first_match(text, table, rules.DEFAULT_OWNER)


def measure_classes(measures: DataFrame) -> DataFrame:
    """The three class rules side by side."""
    m = with_columns_present(measures, MEASURE_TEXTS)
    staged = m.withColumns({"_text": _class_text(), "_primary": _joined("一级方向", "二级措施", "对象/工艺"), "_limits": T.first_text(F.col("主要约束"), F.lit("需结合现场条件核对"))})
    return staged.select("tech_id", screening_class(F.col("_text")).alias("screening_class"), tier(F.col("_primary"), F.col("_limits")).alias("tier"), board_class(F.col("_text")).alias("board_class"))


def catalog(measures: DataFrame) -> DataFrame:
    """Measures under plain names with defaults and the board class."""
    m = with_columns_present(measures, MEASURE_TEXTS + ("name", "direction", "park", "object", "inputs", "calculation", "economics", "constraints", "maturity"))
    pick = lambda a, b, default: T.first_text(F.col(f"`{a}`"), F.col(b), F.lit(default))
    return m.select(
        T.text_or_empty(F.col("tech_id")).alias("id"), T.first_text(F.col("二级措施"), F.col("name"), F.concat(F.lit("措施"), T.text_or_empty(F.col("tech_id")))).alias("name"),
        pick("一级方向", "direction", "其他").alias("direction"), pick("适用园区", "park", "全部").alias("park"), pick("对象/工艺", "object", "待确认").alias("object"),
        pick("关键输入参数", "inputs", "待补").alias("inputs"), pick("减排计算逻辑", "calculation", "需建立基准线").alias("calculation"),
        pick("经济性指标", "economics", "CAPEX、OPEX、节省、寿命").alias("economics"), pick("主要约束", "constraints", "需专项核实").alias("constraints"),
        pick("成熟度", "maturity", "待确认").alias("maturity"), T.first_text(F.col("参数状态"), F.lit("指南级参数")).alias("status"), board_class(_class_text()).alias("type"),
    )


def find_measures(table: DataFrame, kind: str | None = None, direction: str | None = None, query: str = "") -> DataFrame:
    """Catalogue rows by type, direction and text."""
    if kind not in (None, "全部"):
        table = table.filter(F.col("type") == kind)
    if direction not in (None, "全部"):
        table = table.filter(F.col("direction") == direction)
    needle = query.strip().lower()
    return table.filter(F.contains(F.lower(F.concat_ws(" ", "name", "direction", "object", "constraints")), F.lit(needle))) if needle else table


def _first_ids(df: DataFrame, by: list[str], limit: int) -> DataFrame:
    spot = F.row_number().over(W.partitionBy(*by).orderBy("tech_id"))
    return df.withColumn("_r", spot).filter(F.col("_r") <= limit).drop("_r")


def screen(measures: DataFrame, sites: DataFrame, key: str, limit: int = 18) -> DataFrame:
    """Best measures per site: industry fit, basic class, unconfirmed green power, named constraints.

    ``sites`` has the key, ``industry``, ``constraints`` (text) and ``green_power_conditions_confirmed``.
    """
    m = with_columns_present(measures, MEASURE_TEXTS)
    cut = m.select(
        "tech_id", T.first_text(F.col("适用园区"), F.lit(rules.ANY_INDUSTRY)).alias("applicable"), screening_class(_class_text()).alias("category"),
        T.text_or_empty(F.col("二级措施")).alias("measure"), F.contains(T.text_or_empty(F.col("二级措施")), F.lit(rules.GREEN_POWER)).alias("is_green"),
        T.text_or_empty(F.col("主要约束")).alias("limits"),
    )
    cut = _first_ids(cut, ["applicable", "category", "is_green", "limits"], limit)
    s = with_columns_present(sites, ("industry", "constraints", "green_power_conditions_confirmed"))
    s = s.select(key, T.first_text(F.col("industry"), F.lit(rules.ANY_INDUSTRY)).alias("industry"), T.text_or_empty(F.col("constraints")).alias("constraints"),
                 T.is_true(F.col("green_power_conditions_confirmed")).alias("green_ok"))
    traits = ["industry", "constraints", "green_ok"]
    # Each profile meets each industry label once; measures then join on their label.
    labels = cut.agg(F.collect_set("applicable")).scalar()
    tokens = F.filter(F.split("industry", "[/、]"), lambda t: t != "")
    fit = F.contains(F.col("applicable"), F.lit(rules.ANY_INDUSTRY)) | F.contains(F.col("applicable"), F.col("industry")) | F.exists(tokens, lambda t: F.contains(F.col("applicable"), t))
    labelled = s.select(*traits).distinct().withColumn("applicable", F.explode(labels)).withColumn("fits", fit)
    pairs = labelled.join(cut, "applicable")
    fits = F.col("fits")
    basic = F.col("category") == rules.BASIC
    blocked = F.col("is_green") & ~F.col("green_ok")
    hit = (F.col("constraints") != "") & F.exists(F.filter(F.split("limits", "、"), lambda t: t != ""), lambda t: F.contains(F.col("constraints"), t))
    score = F.when(fits, 3).otherwise(0) + F.when(basic, 3).otherwise(0) - F.when(blocked, 2).otherwise(0) - F.when(hit, 1).otherwise(0)
    reasons = F.filter(F.array(F.when(fits, "适用产业匹配"), F.when(basic, "对外部制度与能源条件依赖较小"), F.when(blocked, "绿电边界、网架、计量与结算条件尚未确认")), lambda x: x.isNotNull())
    scored = pairs.withColumns({"score": score, "reason": T.first_text(F.array_join(reasons, "；"), F.lit("作为指南条目保留"))})
    best = scored.withColumn("rank", F.row_number().over(W.partitionBy(*traits).orderBy(F.desc("score"), "category", "tech_id"))).filter(F.col("rank") <= limit)
    return s.join(best.select(*traits, "rank", "tech_id", "category", "measure", "score", "reason"), traits).drop(*traits)


def recommend(measures: DataFrame, sites: DataFrame, gaps: DataFrame, key: str, limit: int = 12, gap_terms: dict[str, list[str]] = rules.GAP_TERMS,
              fallback: list[str] = rules.FALLBACK_METRICS, tier_rule=None, green_terms: list[str] = rules.GREEN_POWER_TERMS) -> DataFrame:
    """Measures tied to a site's open gaps. ``gaps`` has (key, ord, metric, status)."""
    m = with_columns_present(measures, MEASURE_TEXTS)
    metrics = list(gap_terms)
    staged = m.withColumns(
        {
            "_primary": _joined("一级方向", "二级措施", "对象/工艺"),
            "_calc": T.text_or_empty(F.col("减排计算逻辑")),
            "_note": T.text_or_empty(F.col("备注")),
            "_text": _joined("一级方向", "二级措施", "对象/工艺", "减排计算逻辑", "备注"),
            "_limits": T.first_text(F.col("主要约束"), F.lit("需结合现场条件核对")),
        }
    )
    points = lambda terms: F.when(any_term(F.col("_primary"), terms), 3).otherwise(0) + F.when(any_term(F.col("_calc"), terms), 2).otherwise(0) + F.when(any_term(F.col("_note"), terms), 1).otherwise(0)
    classed = staged.select(
        "tech_id", F.array(*[F.lit(g) for g in metrics]).alias("metrics"), F.array(*[points(gap_terms[g]) for g in metrics]).alias("points"),
        T.first_text(F.col("适用园区"), F.lit(rules.ANY_INDUSTRY)).alias("applicable"),
        (tier_rule or tier)(F.col("_primary"), F.col("_limits")).alias("tier"),
        any_term(F.col("_text"), green_terms).alias("green"),
        owner_of(F.col("_text")).alias("stakeholders"), T.text_or_empty(F.col("二级措施")).alias("measure"),
        T.first_text(F.col("关键输入参数"), F.lit("需补充项目基线、设备运行和边界参数")).alias("prerequisites"),
        T.first_text(F.col("参数状态"), F.lit("指南级")).alias("parameter_status"),
    ).filter(F.exists("points", lambda p: p >= 2))
    cut = _first_ids(classed, ["points", "applicable", "tier", "green"], limit)

    # Active metrics per site, in the order of its gap rows; a bit set names them.
    opened = gaps.filter(F.col("status").isin(rules.OPEN_STATUSES)).groupBy(key).agg(F.sort_array(F.collect_set(F.struct("ord", "metric"))).alias("g"))
    s = with_columns_present(sites, ("industry", "industry_group", "green_power_conditions_confirmed")).join(opened, key, "left")
    active = F.transform("g", lambda x: x["metric"])
    s = s.select(
        key, T.first_text(F.col("industry"), F.col("industry_group"), F.lit(rules.ANY_INDUSTRY)).alias("industry"), T.is_true(F.col("green_power_conditions_confirmed")).alias("green_ok"),
        F.when(F.size("g") > 0, active).otherwise(F.array(*[F.lit(x) for x in fallback])).alias("active"),
    )
    traits = ["industry", "green_ok", "active"]
    # A measure counts for a profile through the metrics both have in common.
    by_metric = cut.withColumn("_p", F.explode(F.filter(F.arrays_zip("metrics", "points"), lambda z: z["points"] >= 2)))
    by_metric = by_metric.select("*", F.col("_p.metrics").alias("metric"), F.col("_p.points").alias("_points")).drop("_p", "metrics", "points")
    wanted = s.select(*traits).distinct().select(*traits, F.posexplode("active").alias("_at", "metric"))
    joined = wanted.join(by_metric, "metric")
    found = F.sort_array(F.collect_list(F.struct((-F.col("_points")).alias("minus"), F.col("_at").alias("at"), F.col("metric").alias("metric"))))
    about = [c for c in cut.columns if c not in ("metrics", "points", "tech_id")]
    top = joined.groupBy(*traits, "tech_id").agg(F.slice(found, 1, 3).alias("_top"), *[F.first(c).alias(c) for c in about])
    fits = F.contains(F.col("applicable"), F.lit(rules.ANY_INDUSTRY)) | F.contains(F.col("applicable"), F.col("industry"))
    score = (
        F.aggregate("_top", F.lit(0), lambda acc, h: acc - h["minus"]) + 2 * F.size("_top") + F.when(fits, 3).otherwise(0)
        + F.when(F.col("tier") == rules.BASIC, 4).otherwise(0)
        - F.when((F.col("tier") == rules.CONDITIONAL) & ~F.col("green_ok") & F.col("green"), 3).otherwise(0)
    )
    spot = F.when(F.col("tier") == rules.BASIC, 0).when(F.col("tier") == rules.CONDITIONAL, 1).otherwise(2)
    scored = top.withColumns({"score": score.cast("int"), "matched_gaps": F.array_join(F.transform("_top", lambda h: h["metric"]), "、"), "_tier": spot})
    best = scored.withColumn("rank", F.row_number().over(W.partitionBy(*traits).orderBy(F.desc("score"), "_tier", "tech_id"))).filter(F.col("rank") <= limit)
    tail = F.when(F.col("tier") == rules.BASIC, "；用于建立基线、排查明显能效损失并提高资源利用").when(F.col("tier") == rules.CONDITIONAL, "；需先完成源荷、接入、场地或工艺条件核查").otherwise("；适合作为中长期专项论证方向")
    best = best.withColumn("reason", F.concat(F.lit("对应差距："), F.col("matched_gaps"), tail))
    return s.join(best.select(*traits, "rank", "tech_id", "tier", "measure", "matched_gaps", "score", "reason", "stakeholders", "prerequisites", "parameter_status"), traits).drop(*traits)


def advise(measures: DataFrame, gaps: DataFrame, sites: DataFrame, key: str, limit: int = 12, gap_map: list[tuple] = rules.BOARD_GAP_MAP) -> DataFrame:
    """The interactive variant: measures by gap term, reasons and metrics united, basic measures as fallback.

    ``measures`` is a ``catalog`` frame. Names order by code point.
    """
    text = F.concat_ws(" ", "name", "direction", "object")
    flags = F.array(*[any_term(F.col("_t"), terms) for _, terms, _ in gap_map])
    spot = F.when(F.col("type") == rules.BASIC, 0).when(F.col("type") == rules.CONDITIONAL, 1).otherwise(2)
    m = measures.withColumn("_t", text).withColumns({"flags": flags, "_tier": spot})
    by_name = W.partitionBy("flags", "type").orderBy("name", "id")
    cut = m.withColumn("_r", F.row_number().over(by_name)).filter(F.col("_r") <= limit).select(F.col("id").alias("tech_id"), "name", "type", "flags", "_tier")
    place = F.create_map(*[F.lit(x) for i, (g, _, _) in enumerate(gap_map) for x in (g, i)])
    unmet = gaps.filter(F.col("status") != "达到").select(key, place[F.col("metric")].alias("at")).filter(F.col("at").isNotNull())
    s = sites.select(key).join(unmet.groupBy(key).agg(F.sort_array(F.collect_set("at")).alias("at")), key, "left")
    s = s.withColumn("at", F.coalesce("at", F.array().cast("array<int>")))
    names, why = F.array(*[F.lit(g) for g, _, _ in gap_map]), F.array(*[F.lit(r) for _, _, r in gap_map])
    by_gap = cut.select("*", F.posexplode("flags").alias("i", "flag")).filter("flag").drop("flags", "flag")
    met = s.select("at").distinct().select("at", F.explode("at").alias("i")).join(by_gap, "i")
    hit = met.groupBy("at", "tech_id", "name", "type", "_tier").agg(F.sort_array(F.collect_list("i")).alias("_hit"))
    found = hit.select(
        "at", "tech_id", "name", "type", "_tier", F.array_join(F.transform("_hit", lambda i: F.get(names, i)), "、").alias("metrics"), F.array_join(F.transform("_hit", lambda i: F.get(why, i)), "；").alias("reasons")
    )
    best = found.withColumn("rank", F.row_number().over(W.partitionBy("at").orderBy("_tier", "name", "tech_id"))).filter(F.col("rank") <= limit)
    basics = measures.filter(F.col("type") == rules.BASIC).orderBy("id").limit(9)
    basics = basics.select(F.col("id").alias("tech_id"), "name", "type", F.lit(rules.BOARD_FALLBACK[1]).alias("metrics"), F.lit(rules.BOARD_FALLBACK[0]).alias("reasons"))
    basics = basics.withColumn("rank", F.row_number().over(W.orderBy("name", "tech_id")))
    served = best.select("at").distinct()
    plain = s.join(served, "at", "left_anti").select(key)
    columns = ["rank", "tech_id", "name", "type", "metrics", "reasons"]
    # Nine fallback rows ride along as one array.
    rest = plain.withColumn("b", F.explode(basics.agg(F.collect_list(F.struct(*columns))).scalar())).select(key, "b.*")
    return s.join(best.select("at", *columns), "at").drop("at").unionByName(rest)
