"""Data gate, emission inventory, indicator gaps, risks and conclusions, for many sites at once.

All of these are row-wise projections or explosions of a site row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from greenledger import rules
from greenledger.functions import text as T
from greenledger.functions.scoring import with_columns_present

SITE_TEXTS = (
    "park_name", "boundary_confirmed", "enterprise_list_confirmed", "baseline_year", "energy_tce", "scope1_tco2",
    "scope2_tco2", "process_tco2", "verified_removals_tco2", "economic_output_10k_cny", "clean_energy_pct",
    "product_energy_status", "solid_waste_pct", "waste_energy_pct", "water_reuse_pct", "green_power_conditions_confirmed",
    "scenario_type", "industry", "industry_group", "baseline_emissions_tco2",
)


def site_rows(df: DataFrame) -> DataFrame:
    return with_columns_present(df, SITE_TEXTS)


def _given(name: str, rule: str) -> Column:
    c = F.col(name).cast("string")
    present = c.isNotNull() & (c != "")
    if rule == "flag":
        return T.is_true(F.col(name))
    if rule == "present":
        return present
    zero = F.coalesce(c.try_cast("double") == 0, F.lit(False)) | (F.lower(c) == "false")
    return F.coalesce(present & ~zero, F.lit(False))


def with_gate(sites: DataFrame, fields: list[tuple] = rules.GATE_FIELDS) -> DataFrame:
    """Adds ``missing`` (field names), ``checked``, ``ready`` and ``readiness_pct``."""
    sites = site_rows(sites)
    oks = [(f[0], _given(f[0], f[4])) for f in fields]
    collect = lambda want: F.filter(F.array(*[F.when(ok if want else ~ok, n) for n, ok in oks]), lambda x: x.isNotNull())
    out = sites.withColumns({"missing": collect(False), "checked": collect(True)})
    return out.withColumns(
        {
            "ready": F.size("missing") == 0,
            "readiness_pct": F.bround(100.0 * F.size("checked") / len(fields)).cast("int"),
        }
    )


def gate_tasks(sites: DataFrame, key: str, fields: list[tuple] = rules.GATE_FIELDS) -> DataFrame:
    """One numbered task per missing gate field."""
    gated = with_gate(sites, fields)
    facts = F.array(*[F.struct(F.lit(n).alias("field"), F.lit(name).alias("name"), F.lit(owner).alias("owner"), F.lit(mat).alias("minimum_material"))
                      for n, name, owner, mat, _ in fields])
    wanted = F.filter(facts, lambda t: F.array_contains(F.col("missing"), t["field"]))
    rows = gated.select(key, F.posexplode(wanted).alias("pos", "t"))
    return rows.select(key, (F.col("pos") + 1).alias("no"), "t.*", F.lit(rules.GATE_PRIORITY).alias("priority"), F.lit(rules.GATE_DUE).alias("due"))


def with_inventory(sites: DataFrame) -> DataFrame:
    """Adds gross and net emissions and ``accounting_status``; a stop condition leaves the numbers null."""
    gated = sites if "ready" in sites.columns else with_gate(sites)
    num = lambda n: T.lenient_double(F.col(n), 0.0)
    staged = gated.withColumns({"_s1": num("scope1_tco2"), "_s2": num("scope2_tco2"), "_p": num("process_tco2"), "_r": num("verified_removals_tco2"), "_e": num("energy_tce")})
    gross = F.col("_s1") + F.col("_s2") + F.col("_p")
    net = gross - F.col("_r")
    status = (
        F.when(~F.col("ready"), "gate_not_ready").when(net < 0, "removals_exceed_gross").when(F.col("_e") <= 0, "energy_not_positive").otherwise("ok")
    )
    counted = staged.withColumn("accounting_status", status)
    usable = F.col("accounting_status").isin("ok", "energy_not_positive")
    keep = lambda v: F.when(usable, F.round(v, 4))
    return counted.withColumns(
        {
            "gross_emissions_tco2": keep(gross),
            "net_emissions_tco2": keep(net),
            "removals_tco2": keep(F.col("_r")),
            "energy_used_tce": F.when(F.col("accounting_status") == "ok", F.col("_e")),
        }
    ).drop("_s1", "_s2", "_p", "_r", "_e")


def with_core_target(sites: DataFrame) -> DataFrame:
    """Adds the core target of the energy tier, the intensity and the reduction still needed."""
    counted = sites if "accounting_status" in sites.columns else with_inventory(sites)
    e, net = F.col("energy_used_tce"), F.col("net_emissions_tco2")
    target = F.when((e >= 200_000) & (e < 1_000_000), 0.2).when(e >= 1_000_000, 0.3)
    note = F.when((e >= 200_000) & (e < 1_000_000), rules.SCALE_NOTES[0]).when(e >= 1_000_000, rules.SCALE_NOTES[1]).when(e.isNotNull(), rules.SCALE_NOTES[2])
    return counted.withColumns({"core_target": target, "scale_note": note, "_intensity": net / e}).withColumns(
        {
            "intensity_tco2_per_tce": F.round("_intensity", 6),
            "annual_reduction_needed_tco2": F.round(F.greatest(F.lit(0.0), net - F.col("core_target") * e), 4),
        }
    )


def indicator_gaps(sites: DataFrame, key: str) -> DataFrame:
    """Six indicator rows per site whose accounting is sound."""
    ready = with_core_target(sites).filter(F.col("accounting_status") == "ok")
    none = F.lit(None).cast("double")
    row = lambda spot, metric, current, shown, unit, target, gap, status, nature: F.struct(
        F.lit(spot).alias("ord"), F.lit(metric).alias("metric"), current.alias("current"), shown.alias("current_text"), F.lit(unit).alias("unit"),
        target.alias("target"), gap.alias("gap"), status.alias("status"), F.lit(nature).alias("nature"),
    )
    i, t = F.col("_intensity"), F.col("core_target")
    product = T.first_text(F.col("product_energy_status"), F.lit("未提供"))
    no_text = F.lit(None).cast("string")
    rows = [
        row(0, rules.CORE_METRIC, F.round(i, 6), no_text, "tCO₂/tce", t, F.round(F.greatest(F.lit(0.0), i - t), 6),
            F.when(t.isNull(), "待确认").when(i <= t, "达到").otherwise("未达到"), "核心指标"),
        row(1, rules.PRODUCT_METRIC, none, product, "状态", none, none,
            F.when(product.isin(rules.PRODUCT_OK), "达到").otherwise("未完成判断"), "引导指标"),
    ]
    for n, (name, metric, goal) in enumerate(rules.GUIDE_METRICS):
        c = T.lenient_double(F.col(name))
        status = F.when(c.isNull(), "缺数据").when(c >= goal, "达到").otherwise("未达到")
        rows.append(row(2 + n, metric, c, no_text, "%", F.lit(goal), F.round(F.greatest(F.lit(0.0), goal - c), 4), status, "引导指标"))
    # greatest() skips nulls, so a missing operand must blank the gap.
    exploded = ready.select(key, F.explode(F.array(*rows)).alias("r")).select(key, "r.*")
    missing = (F.col("metric") != rules.PRODUCT_METRIC) & (F.col("current").isNull() | F.col("target").isNull())
    return exploded.withColumn("gap", F.when(~missing, F.col("gap")))


def board_gaps(sites: DataFrame, key: str) -> DataFrame:
    """The interactive variant: no removals, other labels, and its own gate of five inputs."""
    sites = site_rows(sites)
    num = lambda n: T.board_number(F.col(n))
    e, s1, s2, p = num("energy_tce"), num("scope1_tco2"), num("scope2_tco2"), num("process_tco2")
    open_gate = T.is_true(F.col("boundary_confirmed")) & e.isNotNull() & s1.isNotNull() & s2.isNotNull() & p.isNotNull() & (e > 0)
    ready = sites.filter(open_gate).withColumns({"_e": e, "_i": (s1 + s2 + p) / e})
    target = F.when((F.col("_e") >= 200_000) & (F.col("_e") < 1_000_000), 0.2).when(F.col("_e") >= 1_000_000, 0.3)
    product = T.blank_to_null(F.col("product_energy_status"))
    spoken = F.when(product == "达标", "达到").when(product == "未达标", "未达到").when(product == "不适用", "需说明不适用条件").otherwise("缺数据")
    none = F.lit(None).cast("double")

    def row(spot, metric, current, goal, higher):
        gap = F.when(current.isNotNull() & goal.isNotNull(), F.greatest(F.lit(0.0), goal - current if higher else current - goal))
        status = F.when(gap <= 1e-12, "达到").when(gap.isNotNull(), "未达到").when(current.isNotNull(), "需确认适用阈值").otherwise("缺数据")
        return F.struct(F.lit(spot).alias("ord"), F.lit(metric).alias("metric"), F.round(current, 6).alias("current"), goal.alias("target"), F.round(gap, 6).alias("gap"), status.alias("status"))

    g = rules.BOARD_GUIDE_METRICS
    rows = [row(0, rules.BOARD_CORE_METRIC, F.col("_i"), target, False), row(1, g[0][1], num(g[0][0]), F.lit(g[0][2]), True),
            F.struct(F.lit(2).alias("ord"), F.lit(rules.BOARD_PRODUCT_METRIC).alias("metric"), none.alias("current"), none.alias("target"), none.alias("gap"), spoken.alias("status"))]
    rows += [row(3 + n, metric, num(name), F.lit(goal), True) for n, (name, metric, goal) in enumerate(g[1:])]
    return ready.select(key, F.explode(F.array(*rows)).alias("r")).select(key, "r.*")


def economic_intensity(sites: DataFrame, key: str) -> DataFrame:
    counted = with_inventory(sites).filter(F.col("net_emissions_tco2").isNotNull())
    output = T.lenient_double(F.col("economic_output_10k_cny"))
    return counted.select(key, output.alias("economic_output_10k_cny"),
                          F.when(output > 0, F.round(F.col("net_emissions_tco2") / output, 8)).alias("emissions_tco2_per_10k_cny"))


# --- data preparation -------------------------------------------------------

def field_rows(fields: DataFrame) -> DataFrame:
    """Required fields under one set of names, with priority class and weight."""
    names = ("field_id", "字段ID", "优先级", "priority", "字段", "name", "建议提供部门", "owner", "最低口径", "minimum_material", "用途", "purpose")
    f = with_columns_present(fields, names)
    c = F.col
    ident = T.first_text(c("field_id"), c("字段ID"))
    given = T.first_text(c("优先级"), c("priority"), F.lit("P2"))
    level = F.when(given.startswith("P0"), "P0").when(given.startswith("P1"), "P1").otherwise("P2")
    return f.select(
        ident.alias("field_id"), level.alias("priority"), F.when(level == "P0", 3).when(level == "P1", 2).otherwise(1).alias("weight"),
        T.first_text(c("字段"), c("name"), ident).alias("name"), T.first_text(c("建议提供部门"), c("owner"), F.lit("待明确")).alias("owner"),
        T.first_text(c("最低口径"), c("minimum_material"), F.lit("需提供可追溯材料")).alias("material"), T.first_text(c("用途"), c("purpose"), F.lit("数据核验")).alias("purpose"),
    )


def select_priority(fields: DataFrame, level: str = "P0") -> DataFrame:
    """Bulk choice of the required fields of one priority, as field ids."""
    return field_rows(fields).filter(F.col("priority") == level).select("field_id").distinct()


def readiness(fields: DataFrame, provided: DataFrame, site: str, sites: DataFrame | None = None) -> DataFrame:
    """Weighted share of provided fields per site, and the number of missing P0 fields.

    ``provided`` has (site, field_id); the totals over the field table are scalars. Every row of ``sites`` has a
    score, 0 if it provided nothing; without ``sites`` only those that provided something do.
    """
    f = field_rows(fields)
    total = f.agg(F.sum("weight")).scalar()
    p0 = f.filter(F.col("priority") == "P0").agg(F.count("*")).scalar()
    have = provided.select(site, "field_id").distinct().join(f.select("field_id", "weight", "priority"), "field_id")
    per_site = have.groupBy(site).agg(F.sum("weight").alias("have"), F.count_if(F.col("priority") == "P0").alias("p0"))
    if sites is not None:
        per_site = sites.select(site).join(per_site, site, "left").fillna(0, ["have", "p0"])
    return per_site.select(site, F.floor(F.col("have") / total * 100 + 0.5).cast("int").alias("score"), (p0 - F.col("p0")).cast("int").alias("missing_p0"))


def data_tasks(fields: DataFrame, provided: DataFrame, sites: DataFrame, site: str) -> DataFrame:
    """Numbered tasks for the fields a site has not provided.

    The field table is a data dictionary; its rows ride on each site as one array, so the only
    shuffle is the grouping of what was provided.
    """
    f = field_rows(fields)
    plan = f.agg(F.sort_array(F.collect_list(F.struct("field_id", "priority", "name", "owner", "material", "purpose"))).alias("plan")).scalar()
    have = provided.groupBy(site).agg(F.collect_set("field_id").alias("have"))
    todo = F.filter("_plan", lambda t: ~F.array_contains(F.coalesce(F.col("have"), F.array().cast("array<string>")), t["field_id"]))
    planned = sites.select(site).join(have, site, "left").withColumn("_plan", plan)
    rows = planned.select(site, F.posexplode(todo).alias("pos", "t"))
    return rows.select(site, (F.col("pos") + 1).alias("no"), "t.field_id", "t.priority", F.concat(F.lit("补充"), F.col("t.name")).alias("task"), "t.owner", "t.material", "t.purpose",
                       F.when(F.col("t.priority") == "P0", rules.GATE_DUE).otherwise("5个工作日").alias("deadline"), F.lit("待提供").alias("status"))


# --- risks and conclusion ---------------------------------------------------

# Findings and actions of the risk rows.
RISK_TEXT = {
    "demo": ("示范数据", "高", "当前排放、指标和项目经济参数用于验证计算链路，并非某个园区的正式台账", "用同边界、同年度的原始台账、报价和测量验证参数替换后重新运行"),
    "missing": ("数据与边界", "高", "缺少%s项正式核算前置数据", "先完成边界、企业清单、基准年和排放活动数据闭环"),
    "complete": ("数据与边界", "低", "正式核算门槛字段已提供", "继续保留原始凭证、因子版本和复核记录"),
    "green_open": ("绿电实践", "中", "源荷匹配、网架、计量结算或责任边界未全部确认", "绿电直连仅作为条件实施型路径，先开展负荷曲线与接入条件专项核查"),
    "green_ok": ("绿电实践", "低", "已确认基本接入与责任条件", "进入电价、消纳、可靠性和合同风险测算"),
    "weak": ("项目参数", "中", "%s个项目仍使用指南级或未核验参数", "取得供应商报价、能量平衡、节能量测量与验证边界后再转为投资建议"),
    "target": ("减排目标", "高", "当前组合仍有%s tCO₂/年缺口", "增加候选项目、调整预算或重新确认目标年度"),
    "gaps": ("标准差距", None, "%s项指标仍有差距或缺数据", "按核心指标优先、引导指标分项推进"),
}
BOARD_RISK_TEXT = {
    "demo": ("演示数据", "高", "%s个入选项目使用演示参数，当前结果只用于验证计算链路", "用园区台账、供应商报价、可研参数和测量验证边界替换后重新运行"),
    "pending": ("项目参数", "中", "%s个入选项目参数仍待核实", "取得报价、能量平衡和节能量测量边界"),
    "target": ("目标缺口", "高", "当前预算内仍有 %s tCO₂/年缺口", "增加候选项目、调整预算或分期目标"),
    "gaps": ("指标差距", "中", "%s项指标仍有差距或缺数据", "核心指标优先，引导指标逐项推进"),
    "missing": ("数据与边界", "高", "缺少%s项正式测算前置数据", "先完成补数任务"),
    "clear": ("初步筛查", "低", "当前输入未触发高、中风险规则", "继续开展工程可研和法定审查"),
}
# End of fixed values.


def _risk(spec: tuple, number: Column | None = None, level: Column | None = None) -> Column:
    dimension, fixed, finding, action = spec
    said = F.lit(finding) if number is None else F.format_string(finding, number.cast("string"))
    return F.struct(F.lit(dimension).alias("dimension"), (level if level is not None else F.lit(fixed)).alias("level"), said.alias("finding"), F.lit(action).alias("action"))


def with_risks(sites: DataFrame) -> DataFrame:
    """Adds the ``risks`` array, counts by level, mode and conclusion.

    Expects the gate columns plus ``weak_projects``, ``meets_target``, ``target_gap_tco2`` and
    ``open_gaps`` (each null when there is no portfolio or no gap table).
    """
    r = RISK_TEXT
    demo = F.coalesce(F.lower(F.trim(F.col("scenario_type"))).isin(rules.DEMO_WORDS), F.lit(False))
    gap_text = F.format_string("%,.0f", F.bround(F.col("target_gap_tco2"), 0))
    listed = F.array(
        F.when(F.col("_demo"), _risk(r["demo"])),
        F.when(~F.col("ready"), _risk(r["missing"], F.size("missing"))).otherwise(_risk(r["complete"])),
        F.when(~T.is_true(F.col("green_power_conditions_confirmed")), _risk(r["green_open"])).otherwise(_risk(r["green_ok"])),
        F.when(F.col("weak_projects") > 0, _risk(r["weak"], F.col("weak_projects"))),
        F.when(~F.col("meets_target"), _risk(r["target"], gap_text)),
        F.when(F.col("open_gaps").isNotNull(), _risk(r["gaps"], F.col("open_gaps"), F.when(F.col("open_gaps") > 0, "中").otherwise("低"))),
    )
    told = sites.withColumn("_demo", demo).withColumn("risks", F.filter(listed, lambda x: x.isNotNull()))
    level = lambda v: F.size(F.filter("risks", lambda x: x["level"] == v))
    said = rules.CONCLUSIONS
    return told.withColumns({"high_risks": level("高"), "medium_risks": level("中")}).withColumns(
        {
            "mode": F.when(F.col("_demo"), "demonstration").when(F.col("ready"), "formal").otherwise("data_completion"),
            "conclusion": F.when(F.col("_demo"), said["demo"]).when(~F.col("ready"), said["not_ready"])
            .when(F.col("high_risks") > 0, said["high"]).when(F.col("medium_risks") > 0, said["medium"]).otherwise(said["clear"]),
        }
    ).drop("_demo")


def board_missing(sites: DataFrame) -> DataFrame:
    """Adds the one risk of a site whose gate is open: how many inputs are missing."""
    return sites.withColumn("risks", F.array(_risk(BOARD_RISK_TEXT["missing"], F.size("missing"))))


def with_board_risks(sites: DataFrame) -> DataFrame:
    """The interactive variant: evidence is judged on the selected projects.

    Expects ``demo_projects``, ``pending_projects``, ``meets_target``, ``target_gap_tco2`` and ``open_gaps``.
    """
    r = BOARD_RISK_TEXT
    gap_text = F.format_string("%,.0f", F.col("target_gap_tco2"))
    listed = F.filter(
        F.array(
            F.when(F.col("demo_projects") > 0, _risk(r["demo"], F.col("demo_projects"))),
            F.when(F.col("pending_projects") > 0, _risk(r["pending"], F.col("pending_projects"))),
            F.when(~F.col("meets_target"), _risk(r["target"], gap_text)),
            F.when(F.col("open_gaps") > 0, _risk(r["gaps"], F.col("open_gaps"))),
        ),
        lambda x: x.isNotNull(),
    )
    told = sites.withColumn("_listed", listed).withColumn("risks", F.when(F.size("_listed") > 0, F.col("_listed")).otherwise(F.array(_risk(r["clear"]))))
    any_level = lambda v: F.exists("risks", lambda x: x["level"] == v)
    said = rules.CONCLUSIONS
    return told.withColumn(
        "conclusion",
        F.when(F.col("demo_projects") > 0, said["demo"]).when(any_level("高"), said["high"]).when(any_level("中"), rules.BOARD_MEDIUM_CONCLUSION).otherwise(said["clear"]),
    ).drop("_listed")
