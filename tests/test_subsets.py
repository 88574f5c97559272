"""Bounded subset search against listings of all reachable sums."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from greenledger.operators import portfolio as P, subsets as S


def by_table(rows, budget, target):
    """Least (cost, capex, -abatement, size) that meets the target, else least (-abatement, cost, capex, size), over all reachable sums."""
    best = {(0, 0): (0, 0)}
    for capex, abate, npv in rows:
        for (c, a), (v, k) in list(best.items()):
            if c + capex <= budget:
                new, at = (v + npv, k + 1), (c + capex, a + abate)
                best[at] = min(best.get(at, new), new)
    meet = [(v, c, -a, k) for (c, a), (v, k) in best.items() if a >= target]
    return (True, *min(meet)) if meet else (False, *min((-a, v, c, k) for (c, a), (v, k) in best.items()))


def search_key(spark, lists, steps=1 << 17):
    items = [(f"s{i}", [(c, a, v, need, group, None) for c, a, v, need, group in rows], budget, target) for i, (rows, budget, target) in enumerate(lists)]
    frame = spark.createDataFrame(items, f"s string, items array<{S.ITEM}>, budget bigint, target bigint")
    found = {r.s: r.best for r in S.search(frame, "s", steps).collect()}
    assert all(len(b.taken) == b.size for b in found.values())
    return [(b.meets, b.key1, b.key2, b.key3, b.size) for b in (found[f"s{i}"] for i in range(len(lists)))], [found[f"s{i}"] for i in range(len(lists))]


def ordered(rows):
    return sorted(rows, key=lambda r: -r[1] / max(r[0], 1e-6))


@pytest.mark.parametrize("steps", [300, 1 << 17])
def test_search_beyond_listing(spark, steps):
    """30 to 60 projects against all reachable sums, with every node bound in play and in several rounds."""
    rnd = random.Random(7)
    lists = []
    for n, reach in ((30, 0.3), (30, 0.9), (40, 0.5), (60, 0.2), (45, 5.0)):
        rows = ordered([(rnd.randint(0, 40), rnd.randint(0, 30), rnd.randint(-60, 30)) for _ in range(n)])
        lists.append((rows, 150, int(reach * sum(sorted((a for _, a, _ in rows), reverse=True)[:8]))))
    got, _ = search_key(spark, [([(*r, [], 0) for r in rows], b, t) for rows, b, t in lists], steps)
    assert got == [by_table(*x) for x in lists]


def test_search_keeps_rules_and_ties(spark):
    rnd = random.Random(4)
    lists = []
    for _ in range(12):
        n = 13
        rows = ordered([(rnd.randint(0, 6), rnd.randint(0, 6), rnd.randint(-5, 5)) for _ in range(n)])
        rows = [(c, a, v, rnd.choice([[], [], [], [rnd.randrange(n)], [-1]]), rnd.choice([0, 0, 0, 1, 2])) for c, a, v in rows]
        lists.append(([(c, a, v, [k for k in need if k != i], g) for i, (c, a, v, need, g) in enumerate(rows)], rnd.randint(0, 25), rnd.randint(0, 25)))
    got, best = search_key(spark, lists)
    for (rows, budget, target), key, b in zip(lists, got, best):
        want = None
        for picks in itertools.product([1, 0], repeat=len(rows)):  # the first of equals has the earlier projects
            c = [r for r, k in zip(rows, picks) if k]
            groups = [r[4] for r in c if r[4]]
            if sum(r[0] for r in c) > budget or any(k < 0 or not picks[k] for r in c for k in r[3]) or len(set(groups)) < len(groups):
                continue
            capex, abate, npv = (sum(r[i] for r in c) for i in range(3))
            rank = (False, npv, capex, -abate, len(c)) if abate >= target else (True, -abate, npv, capex, len(c))
            if want is None or rank < want[0]:
                want = rank, picks
        assert key == (not want[0][0], *want[0][1:])
        assert b.taken == [i for i, k in enumerate(want[1]) if k]


def test_equal_projects_do_not_multiply(spark):
    """Forty equal projects, nine of which fit: C(40, 9) subsets tie, the first nine win."""
    got, best = search_key(spark, [([(10, 10, -67, [], 0)] * 40, 90, 10), ([(10, 10, 5, [], 0)] * 40, 90, 1000)])
    assert got == [(True, -603, 90, -90, 9), (False, -90, 45, 90, 9)]
    assert [b.taken for b in best] == [list(range(9))] * 2


def test_portfolio_without_a_limit_on_projects(spark):
    schema = "sid string, project_id string, capex_10k_cny double, annual_abatement_tco2 double, annual_saving_10k_cny double, prerequisites string, mutex_group string"
    rnd = random.Random(1)
    rows = [("big", f"P{i:02d}", float(rnd.randint(1, 40)), float(rnd.randint(1, 40)), float(rnd.randint(0, 9)), "", "") for i in range(30)]
    rows += [("bad", "A", -1.0, 5.0, 1.0, "", ""), ("neg", "A", 1.0, 5.0, 1.0, "", "")]
    settings = spark.createDataFrame([("big", 100.0, 150.0, 0.05), ("bad", 5.0, 1.0, 0.05), ("neg", -5.0, 1.0, 0.05), ("none", 5.0, 0.0, 0.05)], "sid string, budget_10k_cny double, annual_target_tco2 double, discount_rate double")
    best, chosen = P.select_portfolio(P.parse_projects(spark.createDataFrame(rows, schema), "sid"), settings, "sid")
    got = {r["sid"]: r for r in best.collect()}
    factor = (1 - 1.05**-10) / 0.05
    scaled = [(int(r[2] * 10000), int(r[3] * 10000), round(round(r[2] - r[4] * factor, 4) * 10000)) for r in rows[:30]]
    want = by_table(scaled, 1000000, 1500000)
    assert want[0] and (round(got["big"]["npv_cost_10k_cny"] * 10000), round(got["big"]["capex_10k_cny"] * 10000), round(-got["big"]["annual_abatement_tco2"] * 10000), got["big"]["selected"]) == want[1:]
    assert chosen.count() == got["big"]["selected"] == len(got["big"]["project_ids"])
    assert got["bad"]["project_ids"] == [] and got["neg"]["status"] == "negative_budget_or_target" and got["none"]["meets_target"]


def test_board_portfolio(spark):
    """The interactive variant against its listing in the order of masks, small and beyond listing; names, lifetimes, negative budgets."""
    rnd = random.Random(12)
    rows, want = [], {}
    for k, n in enumerate((6, 9, 14)):
        mine = [(f"b{k}", i, f"P{i}", f"n{i}", float(rnd.randint(0, 6)), float(rnd.randint(0, 6)), float(rnd.randint(0, 3)), rnd.choice([1, 5])) for i in range(n)]
        rows += mine
        budget, target = 14.0, float(rnd.randint(5, 30))
        best = None
        for mask in range(1 << n):
            c = [r for i, r in enumerate(mine) if mask >> i & 1]
            capex, abate = sum(r[4] for r in c), sum(r[5] for r in c)
            npv = round(sum(round(r[4] - r[6] * (1 - 1.05 ** -r[7]) / 0.05, 4) for r in c), 4)
            if capex <= budget:
                key = (0, npv, capex, -abate) if abate >= target else (1, -abate, npv, capex)
                if best is None or key < best[0]:
                    best = key, [r[2] for r in c]
        want[f"b{k}"] = (budget, target, best)
    rows += [("neg", 0, "A", "a", 1.0, 1.0, 1.0, 5), ("odd", 0, "A", "", 0.0, 9.0, 9.0, 5), ("odd", 1, "B", "b", 0.0, 9.0, 9.0, 0), ("odd", 2, "C", "c", 0.0, 2.0, 9.0, 5)]
    projects = spark.createDataFrame(rows, "s string, place int, project_id string, name string, capex_10k_cny double, annual_abatement_tco2 double, annual_saving_10k_cny double, lifetime_years int")
    projects = projects.withColumn("annual_opex_10k_cny", F.lit(0.0))
    settings = spark.createDataFrame([(s, b, t, None) for s, (b, t, _) in want.items()] + [("neg", -1.0, 0.0, None), ("odd", 5.0, 0.0, None)], "s string, budget_10k_cny double, annual_target_tco2 double, discount_rate double")
    result, chosen = P.board_portfolio(projects, settings, "s")
    got = {r.s: r for r in result.collect()}
    for s, (_, target, (key, ids)) in want.items():
        assert got[s].meets_target == (key[0] == 0) and sorted(got[s].project_ids) == sorted(ids), s
    assert got["neg"].project_ids == [] and not got["neg"].meets_target and got["odd"].project_ids == ["C"]
    assert chosen.filter("s = 'odd'").count() == 1


def test_projects_whose_betters_exceed_the_budget_leave_the_search():
    rnd = random.Random(3)
    for _ in range(60):
        n, budget = rnd.randint(0, 40), rnd.randint(0, 25)
        rows = [(rnd.randint(0, 5), rnd.randint(0, 5), rnd.randint(-5, 5)) for _ in range(n)]
        betters = lambda a: sum(r[0] for b, r in enumerate(rows) if b != a and r[0] <= rows[a][0] and r[1] >= rows[a][1] and r[2] <= rows[a][2] and (r != rows[a] or b < a))  # noqa: E731, B023
        capex, abate, npv = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        none = np.zeros(n, np.int64)
        assert S.candidates(capex, abate, npv, none, none, none[:0], budget).tolist() == [a for a in range(n) if rows[a][0] + betters(a) <= budget]
        held = S.candidates(capex, abate, npv, none, none, np.arange(n), budget)  # projects that others need all stay
        assert held.tolist() == list(range(n))
    many = np.arange(100000, dtype=np.int64)
    assert len(S.candidates(many % 10 + 10, many % 50, many % 7, many * 0, many * 0, many[:0], 60)) < 50


def test_listing_takes_plain_arrays():
    """Two scenarios of two projects, the second of which needs the first in one of them."""
    import pandas as pd

    two = lambda a, b: pd.Series([np.array(a), np.array(b)])
    found = P._listed(two([5, 1], [5, 1]), two([1, 9], [1, 9]), two([0, 0], [0, 0]), two([0, 0], [0, 0]), two([-1, -1], [-1, -1]), pd.Series([None, [[], [0]]]), pd.Series([3, 6]), pd.Series([9, 9]))
    assert found["taken"].tolist() == [[1], [0, 1]] and found["meets"].tolist() == [True, True]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_scenario_is_listed_once(spark):
    """The filter on what the listing found must not ask for a second listing."""
    rows = [(k, str(i), float(i + k % 3 + 1), float(3 * i % 7), -float(i % 2)) for k in range(20) for i in range(k % 5)]
    priced = spark.createDataFrame(rows, "s long, project_id string, capex_10k_cny double, annual_abatement_tco2 double, npv_cost_10k_cny double")
    priced = priced.withColumns({"prerequisites": F.array().cast("array<string>"), "mutex_group": F.lit("")})
    settings = spark.range(20).select(F.col("id").alias("s"), F.lit(6.0).alias("budget_10k_cny"), F.lit(3.0).alias("annual_target_tco2"))
    best = P.best_subsets(P.scenario_lists(priced, settings, "s"), "s")
    assert plan_of(best).count("ArrowEvalPython") == 1
    for s, taken, capex, abatement in best.select("s", F.transform("best.taken", lambda i: F.get("ids", i)), "best.capex", "best.abatement").collect():
        held = [r for r in rows if r[0] == s and r[1] in taken]
        subsets = [[r for j, r in enumerate([r for r in rows if r[0] == s]) if m >> j & 1] for m in range(1 << s % 5)]
        fits = [x for x in subsets if sum(r[2] for r in x) <= 6]
        meet = [x for x in fits if sum(r[3] for r in x) >= 3]
        key = lambda x: (sum(r[4] for r in x), sum(r[2] for r in x), -sum(r[3] for r in x), len(x)) if meet else (-sum(r[3] for r in x), sum(r[4] for r in x), sum(r[2] for r in x), len(x))  # noqa: B023, E731
        assert key(held) == min(map(key, meet or fits)) and capex == 10000 * sum(r[2] for r in held) and abatement == 10000 * sum(r[3] for r in held)


def test_order_lines_are_shuffled_once(spark, tmp_path):
    from greenledger.bindings.assess import order_projects, order_scenarios

    lines = [(k, (k or 0) % 3 + i % 2, float(i + 1), 10.0 * (i + 1), 0.1, 0.02, "R" if i == 2 else "N") for k in [*range(30), None] for i in range(4)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, 100.0) for k in range(30)], "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = order_projects(spark, str(tmp_path))
    assert plan_of(got.join(order_scenarios(spark, str(tmp_path)).hint("merge"), "scenario").groupBy("scenario").count()).count("Exchange hashpartitioning") == 2  # lines and orders, once each
    rows = {(r["scenario"], r["project_id"]): r for r in got.collect()}
    assert len(rows) == 62
    for (k, part), r in rows.items():
        own = [x for x in lines if x[0] == k and str(x[1]) == part]
        assert r["capex_10k_cny"] == sum(x[3] for x in own) and r["annual_abatement_tco2"] == sum(x[2] for x in own) and r["mutex_group"] == ("R" if any(x[6] == "R" for x in own) else "")


@pytest.mark.parametrize("n", [5, 14])
def test_a_missing_cost_adds_nothing(spark, n):
    """Listed or searched, a project without a known cost counts as one that costs nothing over its life."""
    schema = "s string, project_id string, name string, capex_10k_cny double, annual_abatement_tco2 double, annual_saving_10k_cny double, annual_opex_10k_cny double, lifetime_years int, mutex_group string"
    rows = [(s, f"p{i:02d}", "x", 10.0 + i, 5.0 + i % 4, 1.0 + i % 3, 0.5, 10, "") for s in ("known", "missing") for i in range(n - 1)]
    rows += [("known", "z", "x", 0.0, 3.0, 0.0, 0.0, 10, ""), ("missing", "z", "x", 0.0, 3.0, None, 0.0, 10, "")]
    projects = spark.createDataFrame(rows, schema).withColumn("prerequisites", F.array().cast("array<string>"))
    settings = spark.createDataFrame([(s, 45.0, 12.0, 0.05) for s in ("known", "missing")], "s string, budget_10k_cny double, annual_target_tco2 double, discount_rate double")
    known, missing = (tuple(r)[1:] for r in P.select_portfolio(projects, settings, "s")[0].orderBy("s").collect())
    assert known == missing and "z" in known[6]
