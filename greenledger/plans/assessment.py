"""The whole assessment of many sites: gate, gaps, measures, portfolio, path, sensitivity, risks, conclusion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from greenledger import rules
from greenledger.functions import text as T
from greenledger.functions.scoring import with_columns_present
from greenledger.operators import assess, measures as M, portfolio as P
from greenledger.session import cut


@dataclass
class Assessment:
    """The tables of an assessment, all keyed by the site key."""

    sites: DataFrame
    tasks: DataFrame
    gaps: DataFrame
    screened: DataFrame
    recommended: DataFrame
    portfolio: DataFrame
    selected: DataFrame
    stakeholders: DataFrame
    path: DataFrame
    sensitivity: DataFrame
    risks: DataFrame


# The answer texts.
ANSWERS = {
    "data_demo": "已填入演示数据，用于验证计算链路；正式使用仍需替换为园区原始台账",
    "data_ready": "数据已具备正式筛查条件",
    "data_open": "数据尚不足，先完成补数任务",
    "state_ready": "已形成同边界、同年度的排放基线",
    "state_open": "只能形成公开资料画像，不能形成正式绩效排名",
    "gap_ready": "已按国家试行指标形成差距表",
    "gap_open": "边界和基线未闭合，暂不输出达标判断或排名",
    "measures": "已按指标差距、产业适用性和实施前置条件形成措施清单；未取得项目参数前不填写确定减排量和投资额",
    "cost_met": "已形成预算约束下的项目组合",
    "cost_missed": "当前预算内无法完全满足目标，已给出最大减排组合和剩余缺口",
    "cost_none": "尚未提供可核验的项目投资、减排和收益参数，当前仅能提供项目参数模板",
}
# End of fixed values.


def risk_inputs(gated: DataFrame, gaps: DataFrame, projects: DataFrame, portfolio: DataFrame, key: str) -> DataFrame:
    """Sites with the counts the risk rules read. Weak evidence is counted over all projects."""
    weak = projects.groupBy(key).agg(F.count_if(F.lower(F.trim(F.col("evidence_level"))).isin(rules.WEAK_EVIDENCE)).alias("weak_projects"))
    unmet = gaps.groupBy(key).agg(F.count_if(F.col("status").isin(rules.RISK_STATUSES)).alias("open_gaps"))
    chosen = portfolio.select(key, "meets_target", "target_gap_tco2")
    return gated.join(weak, key, "left").join(unmet, key, "left").join(chosen, key, "left")


def assess_sites(sites: DataFrame, raw_projects: DataFrame, measures: DataFrame, key: str) -> Assessment:
    """``sites`` carries the payload fields; ``raw_projects`` the project rows with the same key.

    Every step joins on the site key, so one hash partitioning serves the whole job.
    """
    wide = with_columns_present(sites, ("budget_10k_cny", "annual_target_tco2", "discount_rate", "path_end_year", "constraints", "industry", "industry_group"))
    # Sites and projects feed many tables below; each is computed once.
    wide = cut(wide.withColumn("industry", T.first_text(F.col("industry"), F.col("industry_group"))))
    gated = assess.with_core_target(assess.with_inventory(assess.with_gate(wide)))
    gaps = assess.indicator_gaps(gated, key)
    tasks = assess.gate_tasks(wide, key)
    screened = M.screen(measures, wide, key)
    recommended = M.recommend(measures, wide, gaps, key)
    projects = cut(P.parse_projects(raw_projects, key))
    number = lambda n: T.lenient_double(F.col(n))
    scenarios = wide.select(key, number("budget_10k_cny").alias("budget_10k_cny"), number("annual_target_tco2").alias("annual_target_tco2"), number("discount_rate").alias("discount_rate"))
    with_projects = scenarios.join(projects.select(key).distinct(), key, "left_semi")
    portfolio, selected = P.select_portfolio(projects, with_projects, key)
    baseline = gated.select(
        key, F.coalesce(F.when(F.col("accounting_status") == "ok", F.col("net_emissions_tco2")), number("baseline_emissions_tco2"), F.lit(0.0)).alias("baseline_emissions_tco2"),
        F.coalesce(number("path_end_year").cast("int"), F.lit(2030)).alias("path_end_year"),
    )
    told = assess.with_risks(risk_inputs(gated, gaps, projects, portfolio, key))
    a = ANSWERS
    demo = F.col("mode") == "demonstration"
    answered = told.withColumns(
        {
            "answer_data": F.when(demo, a["data_demo"]).when(F.col("ready"), a["data_ready"]).otherwise(a["data_open"]),
            "answer_state": F.when(F.col("ready"), a["state_ready"]).otherwise(a["state_open"]),
            "answer_gap": F.when(F.col("ready"), a["gap_ready"]).otherwise(a["gap_open"]),
            "answer_measures": F.lit(a["measures"]),
            "answer_cost": F.when(F.col("meets_target").isNull(), a["cost_none"]).when(F.col("meets_target"), a["cost_met"]).otherwise(a["cost_missed"]),
        }
    )
    return Assessment(
        sites=answered.drop("risks"), tasks=tasks, gaps=gaps, screened=screened, recommended=recommended, portfolio=portfolio, selected=selected,
        stakeholders=P.stakeholder_summary(selected, key), path=P.annual_path(selected, baseline, key),
        sensitivity=P.sensitivity(selected, key, F.col("discount_rate")), risks=told.select(key, F.posexplode("risks").alias("ord", "r")).select(key, "ord", "r.*"),
    )


@dataclass
class BoardAssessment:
    """The tables of the interactive assessment, all keyed by the site key."""

    sites: DataFrame
    tasks: DataFrame
    gaps: DataFrame
    advice: DataFrame
    portfolio: DataFrame
    selected: DataFrame
    stakeholders: DataFrame
    path: DataFrame
    sensitivity: DataFrame
    risks: DataFrame


def assess_board(sites: DataFrame, raw_projects: DataFrame, measures: DataFrame, key: str, place: str = "project_id") -> BoardAssessment:
    """The interactive assessment: its own gate, gap table, portfolio, owners by category, path on emissions without removals, exact sensitivity.

    A site whose gate is open gets tasks and one risk. One whose gate is closed but which has no positive energy or no valid project
    stops there: ``mode`` is "stopped" and it has no conclusion. ``place`` orders the projects of a site as they are listed.
    """
    wide = cut(with_columns_present(sites, ("budget_10k_cny", "annual_target_tco2", "discount_rate", "path_end_year")))
    gated = assess.with_gate(wide, rules.BOARD_GATE_FIELDS)
    gaps = assess.board_gaps(wide, key)
    number = lambda n: T.lenient_double(F.col(n))
    projects = cut(P.parse_projects(raw_projects, key))
    measured = gaps.groupBy(key).agg(F.count_if(F.col("status").isin(rules.BOARD_RISK_STATUSES)).alias("open_gaps"))
    emitted = wide.withColumn("emissions_tco2", T.board_number(F.col("scope1_tco2")) + T.board_number(F.col("scope2_tco2")) + T.board_number(F.col("process_tco2")))
    able = gated.filter("ready").join(measured, key).join(projects.select(key).distinct(), key, "left_semi")
    scenarios = able.select(key, *[number(n).alias(n) for n in ("budget_10k_cny", "annual_target_tco2", "discount_rate")])
    portfolio, selected = P.board_portfolio(projects, scenarios, key, place)
    evidence = selected.groupBy(key).agg(F.count_if(F.col("evidence_level") == "演示参数").alias("demo_projects"), F.count_if(F.col("evidence_level") == "待核实").alias("pending_projects"))
    judged = able.select(key, "missing", "open_gaps").join(portfolio.select(key, "meets_target", "target_gap_tco2", "selected"), key).join(evidence, key, "left").fillna(0, ["demo_projects", "pending_projects"])
    judged = assess.with_board_risks(judged).withColumn("mode", F.when(F.col("demo_projects") > 0, "demonstration").otherwise("formal"))
    waiting = assess.board_missing(gated.filter("NOT ready").select(key, "missing")).withColumns({"mode": F.lit("data_completion"), "conclusion": F.lit(rules.CONCLUSIONS["not_ready"])})
    told = cut(judged.unionByName(waiting, allowMissingColumns=True))
    stopped = wide.select(key).join(told.select(key), key, "left_anti").withColumn("mode", F.lit("stopped"))
    baseline = emitted.select(key, F.col("emissions_tco2").alias("baseline_emissions_tco2"))
    rates = selected.drop("discount_rate").join(portfolio.select(key, "discount_rate"), key)
    return BoardAssessment(
        sites=told.drop("risks", "missing").unionByName(stopped, allowMissingColumns=True), tasks=assess.gate_tasks(wide, key, rules.BOARD_GATE_FIELDS), gaps=gaps,
        advice=M.advise(M.catalog(measures), gaps, wide, key), portfolio=portfolio, selected=selected, stakeholders=P.board_stakeholders(selected, key),
        path=P.annual_path(selected, baseline, key, board=True), sensitivity=P.sensitivity(rates, key, F.col("discount_rate"), exact=True),
        risks=told.select(key, F.posexplode("risks").alias("ord", "r")).select(key, "ord", "r.*"),
    )


def measure_counts(recommended: DataFrame, screened: DataFrame, key: str) -> DataFrame:
    """Recommendations per tier; sites without any count their screened measures per class."""
    by_tier = recommended.groupBy(key, F.col("tier").alias("label")).agg(F.count("*").alias("value"))
    rest = screened.join(recommended.select(key).distinct(), key, "left_anti")
    return by_tier.unionByName(rest.groupBy(key, F.col("category").alias("label")).agg(F.count("*").alias("value")))
