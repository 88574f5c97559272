"""Project economics, budget-constrained selection, owners, yearly path and sensitivity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from greenledger import rules
from greenledger.functions import finance, text as T
from greenledger.functions.scoring import with_columns_present
from greenledger.operators import subsets
from greenledger.session import written

PROJECT_FIELDS = (
    "project_id", "id", "name", "项目名称", "category", "类别", "capex_10k_cny", "投资_万元", "annual_abatement_tco2", "年减排_tCO2",
    "annual_saving_10k_cny", "年节省_万元", "annual_opex_10k_cny", "年运维_万元", "lifetime_years", "寿命_年", "start_year", "实施年份",
    "maturity", "成熟度", "evidence_level", "参数证据", "mutex_group", "互斥组",
)


def _either(a: str, b: str, default: float) -> Column:
    """First number that is neither missing nor zero, else the other, else the default."""
    first, second = T.lenient_double(F.col(a)), T.lenient_double(F.col(f"`{b}`"))
    return F.coalesce(F.nullif(first, F.lit(0.0)), second, F.lit(default))


def _list(df: DataFrame, a: str, b: str) -> Column:
    for name in (a, b):
        if name in df.columns and df.schema[name].dataType.typeName() == "array":
            return F.filter(F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    return T.split_list(T.first_text(*[F.col(n) if n in df.columns else F.lit(None).cast("string") for n in (a, b)]))


def parse_projects(raw: DataFrame, scenario: str) -> DataFrame:
    """Typed project rows from text columns and their alternate names; rows without name and id are left out."""
    lists = {n: _list(raw, n, alt) for n, alt in (("stakeholders", "利益相关方"), ("prerequisites", "前置项目"))}
    p = with_columns_present(raw, PROJECT_FIELDS)
    c = F.col
    p = p.filter((T.first_text(c("project_id"), c("name"), c("项目名称")) != ""))
    return p.select(
        scenario, F.trim(T.first_text(c("project_id"), c("id"))).alias("project_id"), F.trim(T.first_text(c("name"), c("项目名称"), F.lit("未命名项目"))).alias("name"),
        F.trim(T.first_text(c("category"), c("类别"), F.lit("其他"))).alias("category"),
        _either("capex_10k_cny", "投资_万元", 0.0).alias("capex_10k_cny"), _either("annual_abatement_tco2", "年减排_tCO2", 0.0).alias("annual_abatement_tco2"),
        _either("annual_saving_10k_cny", "年节省_万元", 0.0).alias("annual_saving_10k_cny"), _either("annual_opex_10k_cny", "年运维_万元", 0.0).alias("annual_opex_10k_cny"),
        F.greatest(F.lit(1), _either("lifetime_years", "寿命_年", 10.0).cast("int")).alias("lifetime_years"), _either("start_year", "实施年份", 2027.0).cast("int").alias("start_year"),
        lists["stakeholders"].alias("stakeholders"), T.first_text(c("maturity"), c("成熟度"), F.lit("待核实")).alias("maturity"),
        T.first_text(c("evidence_level"), c("参数证据"), F.lit("指南级")).alias("evidence_level"), lists["prerequisites"].alias("prerequisites"),
        F.trim(T.first_text(c("mutex_group"), c("互斥组"))).alias("mutex_group"),
    )


PROJECT_JSON = (
    "project_id string, name string, project_name string, category string, capex_10k_cny double, capex double, annual_abatement_tco2 double, abatement double, "
    "annual_saving_10k_cny double, saving double, annual_opex_10k_cny double, opex double, lifetime_years double, life double, start_year double, start double, "
    "evidence_level string, evidence string"
)


def import_projects(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Projects from JSON documents: an array, or an object with a ``projects`` array. Bad documents give no rows."""
    bare = F.from_json(F.col(text), f"array<struct<{_as_struct(PROJECT_JSON)}>>")
    wrapped = F.from_json(F.col(text), f"struct<projects:array<struct<{_as_struct(PROJECT_JSON)}>>>")["projects"]
    is_list = F.trim(F.col(text)).startswith("[")
    rows = documents.select(key, F.posexplode(F.when(is_list, bare).otherwise(wrapped)).alias("pos", "p"))
    p = lambda n: F.col("p." + n)
    return rows.select(
        key, T.first_text(p("project_id"), F.concat(F.lit("I"), F.col("pos") + 1)).alias("project_id"), T.first_text(p("name"), p("project_name"), F.concat(F.lit("项目"), F.col("pos") + 1)).alias("name"),
        T.first_text(p("category"), F.lit("节能降碳")).alias("category"), F.coalesce(p("capex_10k_cny"), p("capex"), F.lit(0.0)).alias("capex_10k_cny"),
        F.coalesce(p("annual_abatement_tco2"), p("abatement"), F.lit(0.0)).alias("annual_abatement_tco2"), F.coalesce(p("annual_saving_10k_cny"), p("saving"), F.lit(0.0)).alias("annual_saving_10k_cny"),
        F.coalesce(p("annual_opex_10k_cny"), p("opex"), F.lit(0.0)).alias("annual_opex_10k_cny"), F.coalesce(p("lifetime_years"), p("life"), F.lit(10.0)).cast("int").alias("lifetime_years"),
        F.coalesce(p("start_year"), p("start"), F.lit(2027.0)).cast("int").alias("start_year"), T.first_text(p("evidence_level"), p("evidence"), F.lit("待核实")).alias("evidence_level"),
    )


def _as_struct(ddl: str) -> str:
    return ",".join(f"{part.split()[0]}:{part.split()[1]}" for part in ddl.split(","))


def with_metrics(projects: DataFrame, rate: Column) -> DataFrame:
    """Net benefit, NPV cost, lifetime abatement, marginal cost and payback, rounded as published."""
    saving, opex, capex = F.col("annual_saving_10k_cny"), F.col("annual_opex_10k_cny"), F.col("capex_10k_cny")
    staged = projects.withColumn("_net", saving - opex)
    staged = staged.withColumn("_npv", capex - F.col("_net") * finance.annuity(rate, F.col("lifetime_years")))
    life = F.col("annual_abatement_tco2") * F.col("lifetime_years")
    return staged.withColumns(
        {
            "annual_net_benefit_10k_cny": F.round("_net", 4),
            "npv_cost_10k_cny": F.round("_npv", 4),
            "lifetime_abatement_tco2": F.round(life, 4),
            "macc_cny_per_tco2": F.round(finance.marginal_cost(F.col("_npv"), life), 4),
            "simple_payback_years": F.round(finance.payback(capex, F.col("_net")), 3),
        }
    ).drop("_net", "_npv")


def _totals() -> list[Column]:
    total = lambda c: F.coalesce(F.round(F.sum(c), 4), F.lit(0.0))
    npv, life = F.sum("npv_cost_10k_cny"), F.sum("lifetime_abatement_tco2")
    return [
        *[total(c).alias(c) for c in ("capex_10k_cny", "annual_abatement_tco2", "annual_net_benefit_10k_cny", "npv_cost_10k_cny", "lifetime_abatement_tco2")],
        F.round(finance.marginal_cost(npv, life), 4).alias("macc_cny_per_tco2"),
    ]


def totals(metrics: DataFrame, scenario: str) -> DataFrame:
    return metrics.groupBy(scenario).agg(F.count("*").alias("projects"), *_totals())


# --- selection --------------------------------------------------------------

LOW = 12  # scenarios of at most so many projects are searched by listing their subsets, many scenarios at once
MASKS_AT_ONCE = 1 << 19  # masks held in memory at once, over all scenarios of a step
SCALE = 10000  # published numbers have four decimals, so integer sums are exact


def _bits(n: int) -> np.ndarray:
    return (np.arange(1 << n, dtype=np.int64)[:, None] >> np.arange(n)[::-1]) & 1


def _best_options(n: int, fields: tuple[np.ndarray, ...], needs: list, budget: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, ...]:
    """Best subset for each of some scenarios of n projects: whether there is one, whether it meets the target, keys, mask and sums.

    Integer arrays of (scenarios x masks); the first project is the highest bit. ``fields``: capex, abatement, npv, group and place, a place
    below 0 where there is no board; ``needs``: for every project the places it needs, or None where no project needs any.
    """
    table = _bits(n)
    value = lambda k: -1 if k is None or k < 0 else 1 << (n - 1 - k)
    need = np.zeros((len(budget), n), np.int64)
    for row, wanted in enumerate(needs):
        if wanted is not None:
            need[row] = [-1 if any(value(k) < 0 for k in w) else sum(value(k) for k in set(w)) for w in wanted]
    capex, abate, npv, group, place = fields
    total = lambda cost: cost @ table.T
    whole = np.arange(1 << n, dtype=np.int64)[None, :]
    ok = total(capex) <= budget[:, None]
    for j in np.flatnonzero(need.any(axis=0)):
        wanted = need[:, j][:, None]
        held = (whole >> (n - 1 - j)) & 1 == 1
        ok &= ~held | (wanted == 0) | ((wanted > 0) & ((whole & wanted) == wanted))
    for g in range(1, int(group.max(initial=0)) + 1):
        ok &= total((group == g).astype(np.int64)) <= 1
    capex, abate, npv = total(capex), total(abate), total(npv)
    meets = ok & (abate >= target[:, None])
    reached = meets.any(axis=1)
    left = np.where(reached[:, None], meets, ok)
    pick = lambda a, b: np.where(reached[:, None], a, b)
    size = np.broadcast_to(table.sum(axis=1)[None, :], ok.shape)
    keys = [pick(npv, -abate), pick(capex, npv), pick(-abate, capex)]
    if n and place[0, 0] >= 0:  # the board's order of ties
        keys += [0 * size, (1 << place) @ table.T]
    else:
        keys += [size, -np.broadcast_to(whole, ok.shape)]
    for key in keys:
        lowest = np.where(left, key, subsets.FAR).min(axis=1)
        left &= key == lowest[:, None]
    spot, found, rows = left.argmax(axis=1), left.any(axis=1), np.arange(len(budget))
    return found, reached, *[k[rows, spot] for k in keys[:4]], spot, *[x[rows, spot] for x in (capex, abate, npv)]


def _listed(capex: pd.Series, abate: pd.Series, npv: pd.Series, group: pd.Series, place: pd.Series, needs: pd.Series, budget: pd.Series, target: pd.Series) -> pd.DataFrame:
    names = ["found", "meets", "key1", "key2", "key3", "size", "mask", "capex", "abatement", "npv"]
    out = np.empty((len(capex), len(names)), dtype=np.int64)
    sizes = np.fromiter(map(len, capex), np.int64, len(capex))
    starts = np.cumsum(sizes) - sizes
    flat = [np.concatenate([np.zeros(0, np.int64), *[np.asarray(x, np.int64) for x in f]]) for f in (capex, abate, npv, group, place)]
    budget, target, needs, taken = budget.to_numpy(), target.to_numpy(), needs.to_numpy(), np.empty(len(capex), object)
    for n in np.unique(sizes).tolist():
        spots = np.flatnonzero(sizes == n)
        step = max(1, MASKS_AT_ONCE >> n)
        for start in range(0, len(spots), step):
            s = spots[start : start + step]
            at = starts[s][:, None] + np.arange(n)
            out[s] = np.column_stack(_best_options(n, tuple(f[at] for f in flat), [needs[i] for i in s], budget[s], target[s]))
            row, place_in = np.nonzero((out[s, 6][:, None] >> np.arange(n)[::-1]) & 1)
            ends, place_in = np.searchsorted(row, np.arange(len(s) + 1)).tolist(), place_in.tolist()
            for i, lo, hi in zip(s.tolist(), ends, ends[1:]):
                taken[i] = place_in[lo:hi]
    frame = pd.DataFrame(out, columns=names)
    frame["taken"] = taken
    return frame.drop(columns=["mask"]).astype({"found": bool, "meets": bool, "size": "int32"})


LISTED = "struct<found:boolean,meets:boolean,key1:bigint,key2:bigint,key3:bigint,size:int,capex:bigint,abatement:bigint,npv:bigint,taken:array<int>>"


def _scaled(c: Column) -> Column:
    return F.round(c * SCALE).cast("long")


def scenario_lists(priced: DataFrame, settings: DataFrame, scenario: str, place: str | None = None) -> DataFrame:
    """One row per scenario: its projects in the order of abatement per capex, coded for the search; a missing cost adds nothing to a sum.
    ``place``: their order on the board."""
    ratio = F.col("annual_abatement_tco2") / F.greatest(F.col("capex_10k_cny"), F.lit(1e-6))
    at = F.lit(None).cast("int") if place is None else F.col(place).cast("int")
    item = F.struct(
        (-ratio).alias("spot"), at.alias("place"), F.col("project_id").alias("id"), _scaled(F.col("capex_10k_cny")).alias("capex"), _scaled(F.col("annual_abatement_tco2")).alias("abatement"),
        F.coalesce(_scaled(F.col("npv_cost_10k_cny")), F.lit(0)).alias("npv"), F.coalesce("prerequisites", F.array().cast("array<string>")).alias("pre"), F.coalesce("mutex_group", F.lit("")).alias("mutex"),
    )
    lists = priced.groupBy(scenario).agg(F.sort_array(F.collect_list(item)).alias("items"))
    lists = lists.withColumn("ids", F.transform("items", lambda p: p["id"])).withColumn("_groups", F.array_distinct(F.filter(F.transform("items", lambda p: p["mutex"]), lambda g: g != "")))
    needed = lambda x: (F.array_position(F.col("ids"), x) - 1).cast("int")  # a prerequisite outside the scenario can never hold: -1
    coded = F.transform("items", lambda p: F.struct(p["capex"].alias("capex"), p["abatement"].alias("abatement"), p["npv"].alias("npv"),
                                                    F.transform(F.array_distinct(p["pre"]), needed).alias("need"), F.coalesce(F.array_position(F.col("_groups"), p["mutex"]), F.lit(0)).cast("int").alias("group"), p["place"].alias("place")))
    return lists.withColumn("items", coded).drop("_groups").join(
        settings.select(scenario, _scaled(F.col("budget_10k_cny")).alias("budget"), _scaled(F.col("annual_target_tco2")).alias("target")), scenario)


def select_portfolio(projects: DataFrame, scenarios: DataFrame, scenario: str) -> tuple[DataFrame, DataFrame]:
    """(one row per scenario, the selected projects).

    Among the subsets within budget whose prerequisites and exclusive groups hold: if any meets
    the target, least (NPV cost, capex, -abatement, size), else least (-abatement, NPV cost,
    capex, size); what is left goes to the subset with the better abatement-to-capex projects.
    Projects with negative capex or abatement take no part. Exact for any number of projects: small scenarios are searched by listing, many
    at a time, larger ones by bounds (``subsets``).

    ``scenarios`` has the key, ``budget_10k_cny``, ``annual_target_tco2`` and ``discount_rate``.
    """
    settings = scenarios.select(
        scenario, F.coalesce("budget_10k_cny", F.lit(0.0)).alias("budget_10k_cny"), F.coalesce("annual_target_tco2", F.lit(0.0)).alias("annual_target_tco2"),
        F.coalesce("discount_rate", F.lit(0.05)).alias("discount_rate"),
    )
    usable = projects.filter((F.col("capex_10k_cny") >= 0) & (F.col("annual_abatement_tco2") >= 0))
    priced = with_metrics(usable.join(settings.select(scenario, "discount_rate"), scenario), F.col("discount_rate"))
    bad = (F.col("budget_10k_cny") < 0) | (F.col("annual_target_tco2") < 0)
    best = best_subsets(scenario_lists(priced, settings.filter(~bad), scenario), scenario)
    result = settings.join(best, scenario, "left").withColumn("status", F.when(bad, "negative_budget_or_target").otherwise("ok")).select(
        scenario, "status", "budget_10k_cny", "annual_target_tco2", "discount_rate", *_outcome(F.col("status") == "ok", F.col("annual_target_tco2") <= 0))
    return result, _chosen(priced, result, scenario)


def best_subsets(lists: DataFrame, scenario: str) -> DataFrame:
    """Key, ``ids`` and the ``best`` struct of every scenario: small ones by listing, many at a time, large ones by bounds."""
    lists = written(lists)
    fields = [f.split(" ")[0] for f in subsets.FOUND.split(", ")]
    # Plain arrays of numbers go to the task, as structs would be made objects there.
    part = lambda f: F.transform("items", lambda p: F.coalesce(p[f], F.lit(-1)).cast("long"))
    needs = F.when(F.exists("items", lambda p: F.size(p["need"]) > 0), F.transform("items", lambda p: p["need"]))
    # Marked as not deterministic, else the filter below would be pushed under it and the listing done twice.
    listed = F.pandas_udf(_listed, LISTED).asNondeterministic()(*[part(f) for f in ("capex", "abatement", "npv", "group", "place")], needs, F.col("budget"), F.col("target"))
    small = lists.filter(F.size("items") <= LOW).withColumn("best", listed).filter("best.found")
    taken = lambda f: F.lit(None).cast("binary").alias(f) if f == "tie" else F.col("best." + f)
    best = small.select(scenario, "ids", F.struct(*[taken(f) for f in fields]).alias("best"))
    large = lists.filter(F.size("items") > LOW)
    if large.isEmpty():
        return best
    return best.unionByName(subsets.search(large, scenario).join(large.select(scenario, "ids"), scenario))


def _outcome(ok: Column, met_by_none: Column) -> list[Column]:
    """What a selection shows; a scenario without a feasible subset takes nothing."""
    value = lambda c: F.coalesce(F.col("best." + c), F.lit(0)) / SCALE
    ids = F.transform(F.col("best.taken"), lambda i: F.get(F.col("ids"), i))
    return [
        F.when(ok, F.coalesce("best.meets", met_by_none)).alias("meets_target"), F.when(ok, F.coalesce(F.size("best.taken"), F.lit(0))).alias("selected"),
        F.when(ok, F.coalesce(ids, F.array().cast("array<string>"))).alias("project_ids"),
        F.when(ok, value("capex")).alias("capex_10k_cny"), F.when(ok, value("abatement")).alias("annual_abatement_tco2"), F.when(ok, value("npv")).alias("npv_cost_10k_cny"),
        F.when(ok, F.round(F.greatest(F.lit(0.0), F.col("annual_target_tco2") - value("abatement")), 4)).alias("target_gap_tco2"),
    ]


def _chosen(priced: DataFrame, result: DataFrame, scenario: str) -> DataFrame:
    return priced.join(result.select(scenario, F.explode("project_ids").alias("project_id")), [scenario, "project_id"], "left_semi")


def board_portfolio(projects: DataFrame, scenarios: DataFrame, scenario: str, place: str = "place") -> tuple[DataFrame, DataFrame]:
    """The interactive variant of ``select_portfolio``.

    Only named projects with capex and abatement of at least 0 and a lifetime over 0 take part; there are no prerequisites
    or exclusive groups, a missing rate is 5 %, and ties after cost, capex and abatement go to the subset whose number is least when the
    first listed project (``place``, from 0) is the lowest bit. A negative budget selects nothing and misses the target.
    """
    settings = scenarios.select(scenario, *[F.coalesce(F.col(c), F.lit(d)).alias(c) for c, d in (("budget_10k_cny", 0.0), ("annual_target_tco2", 0.0), ("discount_rate", 0.05))])
    usable = projects.filter((T.text_or_empty(F.col("name")) != "") & (F.col("capex_10k_cny") >= 0) & (F.col("annual_abatement_tco2") >= 0) & (F.col("lifetime_years") > 0))
    free = usable.withColumns({"prerequisites": F.array().cast("array<string>"), "mutex_group": F.lit("")})
    priced = with_metrics(free.join(settings.select(scenario, "discount_rate"), scenario), F.col("discount_rate"))
    ranked = priced.withColumn("_place", F.row_number().over(W.partitionBy(scenario).orderBy(place, "project_id")) - 1)
    best = best_subsets(scenario_lists(ranked, settings.filter("budget_10k_cny >= 0"), scenario, "_place"), scenario)
    result = settings.join(best, scenario, "left").select(scenario, "budget_10k_cny", "annual_target_tco2", "discount_rate", *_outcome(F.lit(True), F.lit(False)))
    return result, _chosen(priced, result, scenario)


# --- what follows a selection -----------------------------------------------

def stakeholder_summary(selected: DataFrame, scenario: str) -> DataFrame:
    """Equal shares per owner; every project counts fully for each of its owners."""
    owners = F.when(F.size("stakeholders") > 0, F.col("stakeholders")).otherwise(F.array(F.lit(rules.UNNAMED_OWNER)))
    return _shared(selected.withColumn("_owners", owners), scenario)


def board_stakeholders(selected: DataFrame, scenario: str) -> DataFrame:
    """The interactive variant: owners follow from the category."""
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(o) for o in x]) for pair in rules.BOARD_OWNERS.items() for x in pair])
    default = F.array(*[F.lit(o) for o in rules.BOARD_DEFAULT_OWNERS])
    return _shared(selected.withColumn("_owners", F.coalesce(F.try_element_at(table, F.col("category")), default)), scenario)


def _shared(selected: DataFrame, scenario: str) -> DataFrame:
    rows = selected.withColumn("stakeholder", F.explode("_owners"))
    part = lambda c: F.round(F.sum(F.col(c) / F.size("_owners")), 4).alias(c)
    return rows.groupBy(scenario, "stakeholder").agg(
        F.count("*").alias("project_count"), *[part(c) for c in ("capex_10k_cny", "annual_net_benefit_10k_cny", "annual_abatement_tco2")]
    )


def annual_path(selected: DataFrame, baselines: DataFrame, scenario: str, end_year: int = 2030, board: bool = False) -> DataFrame:
    """Yearly abatement from the first start year on, running total, remaining emissions and stage.

    Starts are summed per year first; the year spine is then a window over at most a few dozen rows.
    ``baselines`` has the key and ``baseline_emissions_tco2``, and may have ``path_end_year``.
    """
    last = F.coalesce(F.col("path_end_year"), F.lit(end_year)) if "path_end_year" in baselines.columns else F.lit(end_year)
    starts = selected.groupBy(scenario, "start_year").agg(F.sum("annual_abatement_tco2").alias("a"))
    span = starts.groupBy(scenario).agg(F.min("start_year").alias("first"), F.map_from_entries(F.collect_list(F.struct("start_year", "a"))).alias("by_year"))
    spine = span.join(baselines.withColumn("_last", last), scenario).filter(F.col("first") <= F.col("_last"))
    years = spine.withColumn("year", F.explode(F.sequence("first", F.col("_last"))))
    early = F.aggregate(F.map_values(F.map_filter("by_year", lambda y, _: y <= F.col("year"))), F.lit(0.0), lambda acc, v: acc + v)
    run = W.partitionBy(scenario).orderBy("year").rowsBetween(W.unboundedPreceding, 0)
    base = F.coalesce(F.col("baseline_emissions_tco2"), F.lit(0.0))
    counted = years.withColumn("_a", early).withColumn("_left", F.greatest(F.lit(0.0), base - F.col("_a"))).withColumn("_sum", F.sum("_a").over(run))
    near = (base > 0) & (F.col("_left") / base <= 0.1)
    stage = F.when(F.col("_left") <= (0.0 if board else 1e-9), rules.STAGES[2]).when(near, rules.STAGES[1]).otherwise(rules.STAGES[0])
    return counted.select(scenario, "year", F.round("_a", 4).alias("annual_abatement_tco2"), F.round("_sum", 4).alias("cumulative_abatement_tco2"),
                          F.round("_left", 4).alias("remaining_emissions_tco2"), stage.alias("stage"))


def sensitivity(selected: DataFrame, scenario: str, rate: Column, exact: bool = False) -> DataFrame:
    """Totals under the three parameter cases.

    The published form scales the net benefit by saving over opex factors; ``exact`` scales saving
    and opex on their own. Sums are taken per case in one aggregation, then unfolded.
    """
    capex, abate = F.col("capex_10k_cny"), F.col("annual_abatement_tco2")
    factor = finance.annuity(rate, F.greatest(F.lit(1), F.col("lifetime_years")))
    sums = []
    for i, (_, f_capex, f_saving, f_opex, f_abate, _) in enumerate(rules.SENSITIVITY):
        if exact:
            net = F.col("annual_saving_10k_cny") * f_saving - F.col("annual_opex_10k_cny") * f_opex
        else:
            net = F.col("annual_net_benefit_10k_cny") * (f_saving / f_opex)
        sums += [F.sum(capex * f_capex).alias(f"c{i}"), F.sum(abate * f_abate).alias(f"a{i}"), F.sum(net).alias(f"n{i}"), F.sum(capex * f_capex - net * factor).alias(f"v{i}")]
    wide = selected.groupBy(scenario).agg(*sums)
    cases = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(row[0]).alias("case"), F.lit(row[5]).alias("note"), F.col(f"c{i}").alias("c"), F.col(f"a{i}").alias("a"), F.col(f"n{i}").alias("n"), F.col(f"v{i}").alias("v"))
        for i, row in enumerate(rules.SENSITIVITY)
    ])
    rows = wide.select(scenario, F.explode(cases).alias("s"))
    return rows.select(scenario, "s.ord", "s.case", "s.note", F.round("s.c", 4).alias("capex_10k_cny"), F.round("s.a", 4).alias("annual_abatement_tco2"),
                       F.round("s.n", 4).alias("annual_net_benefit_10k_cny"), F.round("s.v", 4).alias("npv_cost_10k_cny"), F.round(finance.payback(F.col("s.c"), F.col("s.n")), 3).alias("simple_payback_years"))
