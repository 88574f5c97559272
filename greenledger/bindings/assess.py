"""Assessment queries: suppliers as sites, parts as measures and projects, orders as portfolio scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from greenledger import rules
from greenledger.bindings.registry import any_of, case_first, in_list, q, query, table
from greenledger.operators import assess as A, measures as M, portfolio as P
from greenledger.plans import assessment as PL

KEY = "s_suppkey"


def sites(spark, d):
    """Activity data per supplier. Sums run on decimals, so any order gives the same number."""
    li = table(spark, d, "lineitem")
    dec = lambda c, t="decimal(12,2)": F.col(c).cast(t)
    act = li.groupBy(F.col("l_suppkey").alias(KEY)).agg(
        F.sum(dec("l_quantity")).alias("qty"), F.sum(dec("l_extendedprice") * dec("l_discount", "decimal(4,2)")).alias("disc"), F.sum(dec("l_extendedprice") * dec("l_tax", "decimal(4,2)")).alias("tax"), F.sum(dec("l_extendedprice")).alias("price"),
    )
    s = table(spark, d, "supplier").join(act, KEY, "left")
    n, bal = F.col("s_nationkey"), F.col("s_acctbal")
    text = lambda c: c.cast("double").cast("string")
    return s.select(
        KEY, F.col("s_name").alias("park_name"), F.when(bal > 500, "是").otherwise("否").alias("boundary_confirmed"), F.lit("Yes").alias("enterprise_list_confirmed"), F.when(n == 7, "0").otherwise("2000").alias("baseline_year"),
        text(F.col("qty") * 5 * (n + 1)).alias("energy_tce"), text(F.col("disc") / 10).alias("scope1_tco2"), text(F.col("tax") / 20).alias("scope2_tco2"), F.when(n == 9, None).otherwise("0").alias("process_tco2"),
        F.when(n == 4, "99,999,999").otherwise("0").alias("verified_removals_tco2"), text(F.col("price")).alias("economic_output_10k_cny"),
        (n * 4).cast("string").alias("clean_energy_pct"), F.when(n > 12, "达标").when(n > 6, "未达标").alias("product_energy_status"), F.when(n < 20, (n * 5).cast("string")).alias("solid_waste_pct"), (n * 3).cast("string").alias("waste_energy_pct"), F.lit("85").alias("water_reuse_pct"),
        F.when(n < 5, "true").alias("green_power_conditions_confirmed"), F.when(n == 2, "demo").alias("scenario_type"), F.when(n > 15, "化工/制造").when(n > 10, "Brand#3").alias("industry"), F.when(n < 8, "并网、场地").alias("constraints"),
        F.lit(40000.0).alias("budget_10k_cny"), (F.col("s_nationkey") * 10.0).alias("annual_target_tco2"),
    )


SQL_SITES = """act AS (SELECT l_suppkey AS s_suppkey, sum(CAST(l_quantity AS DECIMAL(12,2))) AS qty, sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS disc,
  sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2))) AS tax, sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS price FROM lineitem GROUP BY 1),
sites AS (SELECT s_suppkey, s_name, s_nationkey AS n, s_acctbal > 500 AS boundary, CAST(qty * 5 * (s_nationkey + 1) AS DOUBLE) AS energy, CAST(disc AS DOUBLE) / 10 AS s1, CAST(tax AS DOUBLE) / 20 AS s2,
  CASE WHEN s_nationkey = 4 THEN 99999999.0 ELSE 0.0 END AS removals, CAST(price AS DOUBLE) AS output, s_nationkey < 5 AS green,
  (CASE WHEN s_acctbal > 500 THEN 0 ELSE 1 END + CASE WHEN s_nationkey = 7 THEN 1 ELSE 0 END + CASE WHEN s_nationkey = 9 THEN 1 ELSE 0 END + CASE WHEN qty IS NULL THEN 3 ELSE 0 END) AS n_missing
  FROM supplier LEFT JOIN act USING (s_suppkey)),
inv AS (SELECT *, CASE WHEN n_missing > 0 THEN 'gate_not_ready' WHEN s1 + s2 - removals < 0 THEN 'removals_exceed_gross' WHEN energy <= 0 THEN 'energy_not_positive' ELSE 'ok' END AS status,
  round(s1 + s2, 4) AS gross, round(s1 + s2 - removals, 4) AS net, CASE WHEN energy >= 200000 AND energy < 1000000 THEN 0.2::DOUBLE WHEN energy >= 1000000 THEN 0.3::DOUBLE END AS target FROM sites)"""


@query("data_gate", f"WITH {SQL_SITES} SELECT s_suppkey, n_missing = 0 AS ready, CAST(n_missing AS INTEGER) AS n_missing, CAST(round_even(100.0 * (8 - n_missing) / 8, 0) AS INTEGER) AS readiness_pct FROM sites")
def data_gate(spark, d):
    return A.with_gate(sites(spark, d)).select(KEY, "ready", F.size("missing").alias("n_missing"), "readiness_pct")


@query("gate_tasks", f"""WITH {SQL_SITES}, t AS (SELECT s_suppkey, 1 AS spot, 'boundary_confirmed' AS field FROM sites WHERE NOT boundary UNION ALL SELECT s_suppkey, 3, 'baseline_year' FROM sites WHERE n = 7
UNION ALL SELECT s_suppkey, 7, 'process_tco2' FROM sites WHERE n = 9 UNION ALL SELECT s_suppkey, s.spot, s.f FROM sites, (VALUES (4, 'energy_tce'), (5, 'scope1_tco2'), (6, 'scope2_tco2')) s(spot, f) WHERE energy IS NULL)
SELECT s_suppkey, field, row_number() OVER (PARTITION BY s_suppkey ORDER BY spot) AS no FROM t""")
def gate_tasks(spark, d):
    return A.gate_tasks(sites(spark, d), KEY).select(KEY, "field", "no")


@query("emission_inventory", f"WITH {SQL_SITES} SELECT s_suppkey, status AS accounting_status, CASE WHEN status IN ('ok', 'energy_not_positive') THEN gross END AS gross_emissions_tco2, CASE WHEN status IN ('ok', 'energy_not_positive') THEN net END AS net_emissions_tco2 FROM inv")
def emission_inventory(spark, d):
    return A.with_inventory(sites(spark, d)).select(KEY, "accounting_status", "gross_emissions_tco2", "net_emissions_tco2")


@query("economic_intensity", f"WITH {SQL_SITES} SELECT s_suppkey, output AS economic_output_10k_cny, CASE WHEN output > 0 THEN round(net / output, 8) END AS emissions_tco2_per_10k_cny FROM inv WHERE status = 'ok'")
def economic_intensity(spark, d):
    return A.economic_intensity(sites(spark, d), KEY)


_guide = [("清洁能源消费占比", "n * 4.0", 90.0), ("工业固体废弃物综合利用率", "CASE WHEN n < 20 THEN n * 5.0 END", 80.0), ("余热/余冷/余压综合利用率", "n * 3.0", 50.0), ("工业用水重复利用率", "85.0", 80.0)]
SQL_GAPS = f"""gaps AS (SELECT s_suppkey, 0 AS ord, {q(rules.CORE_METRIC)} AS metric, round(net / energy, 6) AS current, target, CASE WHEN target IS NOT NULL THEN round(greatest(0.0, net / energy - target), 6) END AS gap,
  CASE WHEN target IS NULL THEN '待确认' WHEN net / energy <= target THEN '达到' ELSE '未达到' END AS status FROM inv WHERE status = 'ok'
UNION ALL SELECT s_suppkey, 1, {q(rules.PRODUCT_METRIC)}, NULL, NULL, NULL, CASE WHEN n > 12 THEN '达到' ELSE '未完成判断' END FROM inv WHERE status = 'ok'
""" + "".join(f"""UNION ALL SELECT s_suppkey, {2 + i}, {q(m)}, CAST({v} AS DOUBLE), {g}::DOUBLE, CASE WHEN {v} IS NOT NULL THEN round(greatest(0.0, {g} - CAST({v} AS DOUBLE)), 4) END,
  CASE WHEN {v} IS NULL THEN '缺数据' WHEN {v} >= {g} THEN '达到' ELSE '未达到' END FROM inv WHERE status = 'ok'
""" for i, (m, v, g) in enumerate(_guide)) + ")"


@query("indicator_gaps", f"WITH {SQL_SITES}, {SQL_GAPS} SELECT s_suppkey, ord, metric, current, target, gap, status FROM gaps")
def indicator_gaps(spark, d):
    return A.indicator_gaps(sites(spark, d), KEY).select(KEY, "ord", "metric", "current", "target", "gap", "status")


_board = [(rules.BOARD_GUIDE_METRICS[0], "n * 4.0"), *zip(rules.BOARD_GUIDE_METRICS[1:], ("CASE WHEN n < 20 THEN n * 5.0 END", "n * 3.0", "85.0"))]


def _board_row(ord_: int, metric: str, value: str, goal: str, gap: str) -> str:
    return f"""SELECT s_suppkey, {ord_} AS ord, {q(metric)} AS metric, round({value}, 6)::DOUBLE AS current, {goal}::DOUBLE AS target, round(CASE WHEN {value} IS NOT NULL AND {goal} IS NOT NULL THEN greatest(0.0, {gap}) END, 6)::DOUBLE AS gap,
  CASE WHEN {value} IS NULL THEN '缺数据' WHEN {goal} IS NULL THEN '需确认适用阈值' WHEN greatest(0.0, {gap}) <= 1e-12 THEN '达到' ELSE '未达到' END AS status FROM bs"""


SQL_BOARD_GAPS = f"""bs AS (SELECT *, (s1 + s2) / energy AS i, CASE WHEN energy >= 200000 AND energy < 1000000 THEN 0.2::DOUBLE WHEN energy >= 1000000 THEN 0.3::DOUBLE END AS goal FROM sites WHERE boundary AND n <> 9 AND energy > 0),
bgaps AS ({_board_row(0, rules.BOARD_CORE_METRIC, 'i', 'goal', 'i - goal')} UNION ALL {' UNION ALL '.join(_board_row(k, m, f"CAST({v} AS DOUBLE)", str(g), f"{g} - CAST({v} AS DOUBLE)") for k, ((_, m, g), v) in zip((1, 3, 4, 5), _board))}
UNION ALL SELECT s_suppkey, 2, {q(rules.BOARD_PRODUCT_METRIC)}, NULL, NULL, NULL, CASE WHEN n > 12 THEN '达到' WHEN n > 6 THEN '未达到' ELSE '缺数据' END FROM bs)"""


@query("board_gaps", f"WITH {SQL_SITES}, {SQL_BOARD_GAPS} SELECT s_suppkey, ord, metric, current, target, gap, status FROM bgaps")
def board_gaps(spark, d):
    return A.board_gaps(sites(spark, d), KEY)


# --- data preparation ---------------------------------------------------------

def _fields(spark, d):
    months = table(spark, d, "orders").select(F.month("o_orderdate").alias("m")).distinct()
    return months.select(F.format_string("M%02d", "m").alias("field_id"), F.when(F.col("m") <= 4, "P0-优化").when(F.col("m") <= 8, "P1").alias("优先级"), F.concat(F.lit("month "), F.col("m").cast("string")).alias("字段"))


def _provided(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("site"), F.format_string("M%02d", F.month("o_orderdate")).alias("field_id"))


SQL_FIELDS = """f AS (SELECT DISTINCT month(o_orderdate) AS m, CASE WHEN month(o_orderdate) <= 4 THEN 3 WHEN month(o_orderdate) <= 8 THEN 2 ELSE 1 END AS w FROM orders),
have AS (SELECT DISTINCT o_custkey AS site, month(o_orderdate) AS m FROM orders)"""


@query("readiness", f"""WITH {SQL_FIELDS} SELECT c_custkey AS site, CAST(floor(coalesce(sum(w), 0) / (SELECT sum(w) FROM f) * 100 + 0.5) AS INTEGER) AS score, CAST((SELECT count(*) FROM f WHERE w = 3) - count(*) FILTER (WHERE w = 3) AS INTEGER) AS missing_p0
FROM customer LEFT JOIN have ON site = c_custkey LEFT JOIN f USING (m) GROUP BY c_custkey""")
def readiness(spark, d):
    who = table(spark, d, "customer").select(F.col("c_custkey").alias("site"))
    return A.readiness(_fields(spark, d), _provided(spark, d), "site", who)


@query("data_tasks", f"""WITH {SQL_FIELDS}, t AS (SELECT c_custkey AS site, f.m, f.w FROM customer CROSS JOIN f WHERE NOT EXISTS (SELECT 1 FROM have WHERE have.site = c_custkey AND have.m = f.m))
SELECT site, row_number() OVER (PARTITION BY site ORDER BY m) AS no, 'M' || lpad(CAST(m AS VARCHAR), 2, '0') AS field_id, CASE w WHEN 3 THEN 'P0' WHEN 2 THEN 'P1' ELSE 'P2' END AS priority, '补充month ' || m AS task, CASE WHEN w = 3 THEN '3个工作日' ELSE '5个工作日' END AS deadline FROM t""")
def data_tasks(spark, d):
    who = table(spark, d, "customer").select(F.col("c_custkey").alias("site"))
    return A.data_tasks(_fields(spark, d), _provided(spark, d), who, "site").select("site", "no", "field_id", "priority", "task", "deadline")


# --- measures -----------------------------------------------------------------

WORDS = [("ring", "电机"), ("widget", "工业余热"), ("bolt", "分布式光伏"), ("gear", "水回用"), ("red", "绿电直连"), ("hot", "固废资源化"), ("small", "计量")]


def measures(spark, d):
    """Parts as measures: words of the part name stand for terms of the trade."""
    p = table(spark, d, "part")
    term = F.lit("管理")
    for word, name in reversed(WORDS):
        term = F.when(F.contains("p_name", F.lit(word)), name).otherwise(term)
    c = F.col
    return p.select(
        F.format_string("T%09d", "p_partkey").alias("tech_id"), c("p_type").alias("一级方向"), F.concat_ws(" ", term, "p_name").alias("二级措施"), F.when(c("p_type") == "PROMO", "全部").otherwise(F.concat(c("p_brand"), F.lit("、制造"))).alias("适用园区"),
        F.when(c("p_size") > 25, "泵与风机").otherwise("厂房").alias("对象/工艺"), F.when(c("p_size") > 40, "蒸汽用量").otherwise("").alias("减排计算逻辑"), F.when(c("p_type") == "SMALL", "并网、成本").otherwise("工艺安全").alias("主要约束"), F.when(c("p_type") == "LARGE", "储能").otherwise("").alias("备注"),
    )


_term = "CASE " + " ".join(f"WHEN contains(p_name, '{w}') THEN '{t}'" for w, t in WORDS) + " ELSE '管理' END"
SQL_MEASURES = f"""meas AS (SELECT 'T' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS tech_id, p_type AS direction, {_term} || ' ' || p_name AS measure, CASE WHEN p_type = 'PROMO' THEN '全部' ELSE p_brand || '、制造' END AS applicable,
  CASE WHEN p_size > 25 THEN '泵与风机' ELSE '厂房' END AS object, CASE WHEN p_size > 40 THEN '蒸汽用量' ELSE '' END AS calc, CASE WHEN p_type = 'SMALL' THEN '并网、成本' ELSE '工艺安全' END AS limits, CASE WHEN p_type = 'LARGE' THEN '储能' ELSE '' END AS note FROM part),
txt AS (SELECT *, direction || ' ' || measure || ' ' || object AS prim, direction || ' ' || measure || ' ' || object || ' ' || limits || ' ' || note AS cls, direction || ' ' || measure || ' ' || object || ' ' || calc || ' ' || note AS alltext FROM meas),
mc AS (SELECT *, CASE WHEN {any_of('cls', rules.SCREEN_CONDITIONAL)} THEN '{rules.CONDITIONAL}' WHEN {any_of('cls', rules.SCREEN_BASIC)} THEN '{rules.BASIC}' ELSE '{rules.SPECIAL}' END AS screening_class,
  CASE WHEN {any_of('prim', rules.TIER_CONDITIONAL)} THEN '{rules.CONDITIONAL}' WHEN {any_of('prim', rules.TIER_BASIC)} THEN '{rules.BASIC}' WHEN {any_of('limits', rules.TIER_CONSTRAINTS)} THEN '{rules.CONDITIONAL}' ELSE '{rules.SPECIAL}' END AS tier,
  CASE WHEN {any_of('cls', rules.SCREEN_CONDITIONAL)} THEN '{rules.CONDITIONAL}' WHEN {any_of('cls', rules.BOARD_BASIC)} THEN '{rules.BASIC}' ELSE '{rules.SPECIAL}' END AS board_class FROM txt)"""


@query("measure_class", f"WITH {SQL_MEASURES} SELECT tech_id, screening_class, tier, board_class FROM mc")
def measure_class(spark, d):
    return M.measure_classes(measures(spark, d))


@query("measure_catalog", f"WITH {SQL_MEASURES} SELECT tech_id AS id, measure AS name, direction, applicable AS park, object, coalesce(nullif(calc, ''), '需建立基准线') AS calculation, limits AS constraints, board_class AS type FROM mc WHERE board_class = '{rules.BASIC}' AND contains(lower(measure || ' ' || direction || ' ' || object || ' ' || limits), 'gear')")
def measure_catalog(spark, d):
    found = M.find_measures(M.catalog(measures(spark, d)), kind=rules.BASIC, query="Gear")
    return found.select("id", "name", "direction", "park", "object", "calculation", "constraints", "type")


_ind = "CASE WHEN n > 15 THEN '化工/制造' WHEN n > 10 THEN 'Brand#3' ELSE '全部' END"


@query("measure_screen", f"""WITH {SQL_SITES}, {SQL_MEASURES}, p AS (SELECT s_suppkey, {_ind} AS industry, n < 8 AS limited, green FROM sites),
x AS (SELECT s_suppkey, tech_id, screening_class AS category, (CASE WHEN contains(applicable, '全部') OR contains(applicable, industry) OR (industry = '化工/制造' AND contains(applicable, '制造')) THEN 3 ELSE 0 END)
 + CASE WHEN screening_class = '{rules.BASIC}' THEN 3 ELSE 0 END - CASE WHEN contains(measure, '绿电') AND NOT green THEN 2 ELSE 0 END - CASE WHEN limited AND contains(limits, '并网') THEN 1 ELSE 0 END AS score FROM p CROSS JOIN mc)
SELECT s_suppkey, tech_id, category, score, row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, category, tech_id) AS rank FROM x QUALIFY rank <= 18""")
def measure_screen(spark, d):
    return M.screen(measures(spark, d), sites(spark, d), KEY).select(KEY, "tech_id", "category", "score", "rank")


_points = "CASE metric " + " ".join(
    f"WHEN {q(g)} THEN CASE WHEN {any_of('prim', t)} THEN 3 ELSE 0 END + CASE WHEN {any_of('calc', t)} THEN 2 ELSE 0 END + CASE WHEN {any_of('note', t)} THEN 1 ELSE 0 END" for g, t in rules.GAP_TERMS.items()) + " END"


SQL_RECOMMEND = f"""act2 AS (SELECT s_suppkey, ord, metric FROM gaps WHERE status IN ('未达到', '缺数据', '未完成判断', '待确认')),
active AS (SELECT s_suppkey, metric, row_number() OVER (PARTITION BY s_suppkey ORDER BY ord) AS spot FROM act2
  UNION ALL SELECT s_suppkey, m.metric, m.spot FROM sites, (VALUES ({q(rules.FALLBACK_METRICS[0])}, 1), ({q(rules.FALLBACK_METRICS[1])}, 2)) m(metric, spot) WHERE s_suppkey NOT IN (SELECT s_suppkey FROM act2)),
names AS (SELECT DISTINCT metric FROM active), pts AS (SELECT tech_id, metric, {_points} AS points FROM mc CROSS JOIN names),
hit AS (SELECT s_suppkey, tech_id, metric, points, row_number() OVER (PARTITION BY s_suppkey, tech_id ORDER BY points DESC, spot) AS r FROM active JOIN pts USING (metric) WHERE points >= 2 QUALIFY r <= 3),
agg AS (SELECT s_suppkey, tech_id, sum(points) + 2 * count(*) AS base, string_agg(metric, '、' ORDER BY r) AS matched_gaps FROM hit GROUP BY 1, 2),
sc AS (SELECT s_suppkey, tech_id, tier, matched_gaps, CAST(base + CASE WHEN contains(applicable, '全部') OR contains(applicable, {_ind}) THEN 3 ELSE 0 END + CASE WHEN tier = '{rules.BASIC}' THEN 4 ELSE 0 END
  - CASE WHEN tier = '{rules.CONDITIONAL}' AND NOT green AND {any_of('alltext', rules.GREEN_POWER_TERMS)} THEN 3 ELSE 0 END AS INTEGER) AS score, {case_first('alltext', rules.OWNER_TERMS, rules.DEFAULT_OWNER)} AS stakeholders
  FROM agg JOIN mc USING (tech_id) JOIN sites USING (s_suppkey)),
recommended AS (SELECT s_suppkey, tech_id, tier, matched_gaps, score, stakeholders, row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, CASE tier WHEN '{rules.BASIC}' THEN 0 WHEN '{rules.CONDITIONAL}' THEN 1 ELSE 2 END, tech_id) AS rank FROM sc QUALIFY rank <= 12)"""


@query("measure_recommend", f"WITH {SQL_SITES}, {SQL_GAPS}, {SQL_MEASURES}, {SQL_RECOMMEND} SELECT * FROM recommended")
def measure_recommend(spark, d):
    who = sites(spark, d)
    return M.recommend(measures(spark, d), who, A.indicator_gaps(who, KEY), KEY).select(KEY, "tech_id", "tier", "matched_gaps", "score", "stakeholders", "rank")


_at = ", ".join(f"({i}, {q(m)}, {q(why)})" for i, (m, _, why) in enumerate(rules.BOARD_GAP_MAP))
_touches = "CASE i " + " ".join(f"WHEN {i} THEN {any_of('t', terms)}" for i, (_, terms, _) in enumerate(rules.BOARD_GAP_MAP)) + " END"
SQL_ADVICE = f"""gm AS (SELECT * FROM (VALUES {_at}) g(i, metric, why)), bm AS (SELECT tech_id, measure AS name, board_class AS type, measure || ' ' || direction || ' ' || object AS t FROM mc),
fl AS (SELECT tech_id, name, type, i, metric, why FROM bm CROSS JOIN gm WHERE {_touches}),
un AS (SELECT s_suppkey, i FROM bgaps JOIN gm USING (metric) WHERE status <> '达到'),
ah AS (SELECT s_suppkey, tech_id, name, type, string_agg(metric, '、' ORDER BY i) AS metrics, string_agg(why, '；' ORDER BY i) AS reasons FROM un JOIN fl USING (i) GROUP BY ALL),
ab AS (SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY CASE type WHEN '{rules.BASIC}' THEN 0 WHEN '{rules.CONDITIONAL}' THEN 1 ELSE 2 END, name, tech_id) AS INTEGER) AS rank, tech_id, name, type, metrics, reasons FROM ah QUALIFY rank <= 12),
fb AS (SELECT CAST(row_number() OVER (ORDER BY name, tech_id) AS INTEGER) AS rank, tech_id, name, type, {q(rules.BOARD_FALLBACK[1])} AS metrics, {q(rules.BOARD_FALLBACK[0])} AS reasons FROM (SELECT * FROM bm WHERE type = '{rules.BASIC}' ORDER BY tech_id LIMIT 9)),
advice AS (SELECT * FROM ab UNION ALL SELECT s_suppkey, fb.* FROM supplier CROSS JOIN fb WHERE s_suppkey NOT IN (SELECT s_suppkey FROM ab))"""


@query("measure_advice", f"WITH {SQL_SITES}, {SQL_MEASURES}, {SQL_BOARD_GAPS}, {SQL_ADVICE} SELECT s_suppkey, rank, tech_id, name, type, metrics, reasons FROM advice")
def measure_advice(spark, d):
    who = sites(spark, d)
    return M.advise(M.catalog(measures(spark, d)), A.board_gaps(who, KEY), who, KEY)


# --- projects -----------------------------------------------------------------

def raw_projects(spark, d):
    """Parts as project rows in text form, by brand."""
    p = table(spark, d, "part")
    c = F.col
    return p.select(
        c("p_brand").alias("brand"), c("p_partkey").cast("string").alias("project_id"), c("p_name").alias("name"), c("p_type").alias("category"), F.format_number("p_retailprice", 2).alias("capex_10k_cny"), F.lit("0").alias("annual_abatement_tco2"),
        (c("p_size") * 7).cast("string").alias("年减排_tCO2"), (c("p_size") * 10).cast("string").alias("annual_saving_10k_cny"), F.lit("60").alias("annual_opex_10k_cny"), F.when(c("p_size") > 40, "").otherwise((c("p_size") / 2).cast("string")).alias("lifetime_years"),
        (c("p_size") % 5 + 2025).cast("string").alias("start_year"), F.when(c("p_type") == "SMALL", "").when(c("p_type") == "LARGE", "园区企业；能源运营方").otherwise(" 园区管委会 ").alias("stakeholders"), F.when(c("p_type") == "PROMO", "演示参数").alias("evidence_level"),
    )


def projects(spark, d):
    return P.parse_projects(raw_projects(spark, d), "brand")


SQL_PROJECTS = """pj AS (SELECT p_brand AS brand, CAST(p_partkey AS VARCHAR) AS project_id, p_name AS name, p_type AS category, p_retailprice AS capex, p_size * 7.0::DOUBLE AS abate, p_size * 10.0::DOUBLE AS saving, 60.0::DOUBLE AS opex,
  CASE WHEN p_size > 40 THEN 10 ELSE greatest(1, CAST(trunc(p_size / 2) AS INTEGER)) END AS life, p_size % 5 + 2025 AS start_year,
  CASE WHEN p_type = 'SMALL' THEN [] WHEN p_type = 'LARGE' THEN ['园区企业', '能源运营方'] ELSE ['园区管委会'] END AS owners FROM part),
mt AS (SELECT *, saving - opex AS net, (1 - power(1.05::DOUBLE, -life)) / 0.05::DOUBLE AS factor FROM pj),
pm AS (SELECT *, round(capex - net * factor, 4) AS npv, round(abate * life, 4) AS life_abate, CASE WHEN abate * life > 0 THEN round((capex - net * factor) * 10000 / (abate * life), 4) END AS macc, CASE WHEN net > 0 THEN round(capex / net, 3) END AS payback FROM mt)"""


@query("project_parse", f"WITH {SQL_PROJECTS} SELECT brand, project_id, name, category, capex AS capex_10k_cny, abate AS annual_abatement_tco2, life AS lifetime_years, start_year, array_to_string(owners, ';') AS owners FROM pj")
def project_parse(spark, d):
    return projects(spark, d).select("brand", "project_id", "name", "category", "capex_10k_cny", "annual_abatement_tco2", "lifetime_years", "start_year", F.array_join("stakeholders", ";").alias("owners"))


def _priced(spark, d):
    return P.with_metrics(projects(spark, d), F.lit(0.05))


@query("project_metrics", f"WITH {SQL_PROJECTS} SELECT project_id, net AS annual_net_benefit_10k_cny, npv AS npv_cost_10k_cny, life_abate AS lifetime_abatement_tco2, macc AS macc_cny_per_tco2, payback AS simple_payback_years FROM pm")
def project_metrics(spark, d):
    return _priced(spark, d).select("project_id", "annual_net_benefit_10k_cny", "npv_cost_10k_cny", "lifetime_abatement_tco2", "macc_cny_per_tco2", "simple_payback_years")


@query("portfolio_totals", f"WITH {SQL_PROJECTS} SELECT brand, count(*) AS projects, round(sum(capex), 4) AS capex_10k_cny, round(sum(abate), 4) AS annual_abatement_tco2, round(sum(net), 4) AS annual_net_benefit_10k_cny, round(sum(npv), 4) AS npv_cost_10k_cny, round(sum(life_abate), 4) AS lifetime_abatement_tco2, round(sum(npv) * 10000 / sum(life_abate), 4) AS macc_cny_per_tco2 FROM pm GROUP BY brand")
def portfolio_totals(spark, d):
    return P.totals(_priced(spark, d), "brand")


_cases = ", ".join(f"({i}, '{n}', {a}::DOUBLE, {s}::DOUBLE, {o}::DOUBLE, {b}::DOUBLE)" for i, (n, a, s, o, b, _) in enumerate(rules.SENSITIVITY))


@query("sensitivity", f"""WITH {SQL_PROJECTS}, c(ord, name_, fc, fs, fo, fa) AS (VALUES {_cases}), t AS (SELECT brand, ord, name_, sum(capex * fc) AS c, sum(abate * fa) AS a, sum(net * (fs / fo)) AS n, sum(capex * fc - net * (fs / fo) * factor) AS v FROM pm CROSS JOIN c GROUP BY ALL)
SELECT brand, ord, name_ AS "case", round(c, 4) AS capex_10k_cny, round(a, 4) AS annual_abatement_tco2, round(n, 4) AS annual_net_benefit_10k_cny, round(v, 4) AS npv_cost_10k_cny, CASE WHEN n > 0 THEN round(c / n, 3) END AS simple_payback_years FROM t""")
def sensitivity(spark, d):
    return P.sensitivity(_priced(spark, d), "brand", F.lit(0.05)).drop("note")


@query("stakeholder_alloc", f"""WITH {SQL_PROJECTS}, o AS (SELECT *, CASE WHEN len(owners) = 0 THEN ['{rules.UNNAMED_OWNER}'] ELSE owners END AS ow FROM pm), x AS (SELECT brand, unnest(ow) AS stakeholder, len(ow) AS k, capex, net, abate FROM o)
SELECT brand, stakeholder, count(*) AS project_count, round(sum(capex / k), 4) AS capex_10k_cny, round(sum(net / k), 4) AS annual_net_benefit_10k_cny, round(sum(abate / k), 4) AS annual_abatement_tco2 FROM x GROUP BY 1, 2""")
def stakeholder_alloc(spark, d):
    return P.stakeholder_summary(_priced(spark, d), "brand")


@query("annual_path", f"""WITH {SQL_PROJECTS}, f AS (SELECT brand, min(start_year) AS y0, sum(abate) * 1.05 AS base FROM pj GROUP BY brand), y AS (SELECT brand, base, unnest(range(y0, 2031)) AS year FROM f),
a AS (SELECT y.brand, y.year, base, sum(abate) AS a FROM y JOIN pj ON pj.brand = y.brand AND start_year <= year GROUP BY ALL)
SELECT brand, CAST(year AS INTEGER) AS year, round(a, 4) AS annual_abatement_tco2, round(sum(a) OVER (PARTITION BY brand ORDER BY year), 4) AS cumulative_abatement_tco2, round(greatest(0, base - a), 4) AS remaining_emissions_tco2,
  CASE WHEN base - a <= 1e-9 THEN '{rules.STAGES[2]}' WHEN greatest(0, base - a) / base <= 0.1 THEN '{rules.STAGES[1]}' ELSE '{rules.STAGES[0]}' END AS stage FROM a""")
def annual_path(spark, d):
    p = projects(spark, d)
    base = p.groupBy("brand").agg((F.sum("annual_abatement_tco2") * 1.05).alias("baseline_emissions_tco2"))
    return P.annual_path(p, base, "brand")


@query("project_import", """SELECT event_id, 'I1' AS project_id, '项目1' AS name, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS capex_10k_cny, 10 AS lifetime_years, 2027 AS start_year FROM events WHERE event_type <> 'error'""")
def project_import(spark, d):
    e = table(spark, d, "events")
    renamed = F.replace("props", F.lit('"k"'), F.lit('"capex"'))
    doc = F.when(F.col("event_type") == "error", F.col("props")).when(F.col("event_type") == "click", F.concat(F.lit("["), renamed, F.lit("]"))).otherwise(F.concat(F.lit('{"projects": ['), renamed, F.lit("]}")))
    return P.import_projects(e.select("event_id", doc.alias("doc")), "event_id", "doc").select("event_id", "project_id", "name", "capex_10k_cny", "lifetime_years", "start_year")


def order_projects(spark, d):
    """Order lines as candidate projects of an order; lines of one part are one project. Dealt out by order at once: by order
    and part first, every line would be shuffled twice."""
    li = table(spark, d, "lineitem").repartition("l_orderkey")
    dec = lambda c, t="decimal(12,2)": F.col(c).cast(t)
    return li.groupBy(F.col("l_orderkey").alias("scenario"), F.col("l_partkey").cast("string").alias("project_id")).agg(
        F.sum(dec("l_extendedprice")).cast("double").alias("capex_10k_cny"), F.sum(dec("l_quantity")).cast("double").alias("annual_abatement_tco2"), F.sum(dec("l_extendedprice") * dec("l_discount", "decimal(4,2)")).cast("double").alias("annual_saving_10k_cny"),
        F.sum(dec("l_extendedprice") * dec("l_tax", "decimal(4,2)")).cast("double").alias("annual_opex_10k_cny"), F.lit(10).alias("lifetime_years"), F.lit(2027).alias("start_year"), F.max(F.when(F.col("l_returnflag") == "R", "R").otherwise("")).alias("mutex_group"),
        F.array().cast("array<string>").alias("prerequisites"), F.first(F.lit("x")).alias("name"),
    )


def order_scenarios(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("scenario"), (F.col("o_totalprice") * 0.5).alias("budget_10k_cny"), F.lit(60.0).alias("annual_target_tco2"), F.lit(0.05).alias("discount_rate"))


@query("portfolio_select", """WITH p AS (SELECT l_orderkey AS scenario, CAST(l_partkey AS VARCHAR) AS id, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS capex, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS abate,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) - CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2))) AS DOUBLE) AS net, bool_or(l_returnflag = 'R') AS excl FROM lineitem GROUP BY 1, 2),
i AS (SELECT *, CAST(round(capex * 10000) AS BIGINT) AS c, CAST(round(abate * 10000) AS BIGINT) AS a, CAST(round(round(capex - net * ((1 - power(1.05::DOUBLE, -10)) / 0.05::DOUBLE), 4) * 10000) AS BIGINT) AS v,
  row_number() OVER (PARTITION BY scenario ORDER BY abate / greatest(capex, 1e-6) DESC, id) - 1 AS spot FROM p JOIN orders ON o_orderkey = scenario),
s AS (SELECT scenario, count(*) AS n, max(CAST(round(o_totalprice * 0.5 * 10000) AS BIGINT)) AS budget FROM i GROUP BY scenario),
mk AS (SELECT scenario, n, budget, unnest(range(0, CAST(1 AS BIGINT) << n)) AS mask FROM s),
t AS (SELECT mk.scenario, mk.mask, budget, coalesce(sum(c), 0) AS c, coalesce(sum(a), 0) AS a, coalesce(sum(v), 0) AS v, count(spot) AS k, count(*) FILTER (WHERE excl) AS ex FROM mk LEFT JOIN i ON i.scenario = mk.scenario AND (mk.mask >> (n - 1 - spot)) & 1 = 1 GROUP BY 1, 2, 3),
ok AS (SELECT *, a >= 600000 AS meets FROM t WHERE c <= budget AND ex <= 1),
b AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY meets DESC, CASE WHEN meets THEN v ELSE -a END, CASE WHEN meets THEN c ELSE v END, CASE WHEN meets THEN -a ELSE c END, k, mask DESC) = 1)
SELECT o_orderkey AS scenario, coalesce(meets, false) AS meets_target, CAST(coalesce(k, 0) AS INTEGER) AS selected, coalesce(c, 0) / 10000 AS capex_10k_cny, coalesce(a, 0) / 10000 AS annual_abatement_tco2, coalesce(v, 0) / 10000 AS npv_cost_10k_cny FROM orders LEFT JOIN b ON scenario = o_orderkey""")
def portfolio_select(spark, d):
    best, _ = P.select_portfolio(order_projects(spark, d), order_scenarios(spark, d), "scenario")
    return best.select("scenario", "meets_target", "selected", "capex_10k_cny", "annual_abatement_tco2", "npv_cost_10k_cny")


def site_projects(spark, d):
    """Six candidate projects per supplier: its lines by part type."""
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    j = li.join(p, li["l_partkey"] == p["p_partkey"])
    total = lambda c: F.sum(F.col(c).cast("decimal(12,2)")).cast("double")
    return j.groupBy(F.col("l_suppkey").alias(KEY), F.col("p_type").alias("project_id")).agg((total("l_extendedprice") / 1000).alias("capex_10k_cny"), total("l_quantity").alias("annual_abatement_tco2"), (total("l_quantity") / 10).alias("annual_saving_10k_cny"), F.first(F.when(F.col("p_type") == "PROMO", "可研参数")).alias("evidence_level"))


SQL_CHOICE = f"""pr AS (SELECT l_suppkey AS s_suppkey, p_type, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) / 1000 AS capex, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS abate FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
it AS (SELECT s_suppkey, p_type, row_number() OVER (PARTITION BY s_suppkey ORDER BY p_type) - 1 AS spot, CAST(round(capex * 10000) AS BIGINT) AS c, CAST(round(abate * 10000) AS BIGINT) AS a,
  CAST(round(round(capex - abate / 10 * ((1 - power(1.05::DOUBLE, -10)) / 0.05::DOUBLE), 4) * 10000) AS BIGINT) AS v FROM pr),
mk AS (SELECT s_suppkey, unnest(range(0, CAST(1 AS BIGINT) << count(*))) AS mask FROM it GROUP BY s_suppkey),
tt AS (SELECT mk.s_suppkey, mk.mask, coalesce(sum(c), 0) AS c, coalesce(sum(a), 0) AS a, coalesce(sum(v), 0) AS v, count(spot) AS k, count(*) FILTER (p_type = 'PROMO') AS demo, count(*) FILTER (p_type = 'SMALL') AS pending FROM mk LEFT JOIN it ON it.s_suppkey = mk.s_suppkey AND (mask >> spot) & 1 = 1 GROUP BY 1, 2),
ch AS (SELECT tt.*, a >= n * 100000 AS meets, round(greatest(0.0, n * 10.0 - a / 10000), 4) AS short FROM tt JOIN sites USING (s_suppkey) WHERE c <= 400000000),
best AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY meets DESC, CASE WHEN meets THEN v ELSE -a END, CASE WHEN meets THEN c ELSE v END, CASE WHEN meets THEN -a ELSE c END, k) = 1),
bbest AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY meets DESC, CASE WHEN meets THEN v ELSE -a END, CASE WHEN meets THEN c ELSE v END, CASE WHEN meets THEN -a ELSE c END, mask) = 1)"""


def _sql_risk(when: str, spec: tuple, number: str = "''", level: str | None = None) -> str:
    dimension, fixed, finding, action = spec
    return f"CASE WHEN {when} THEN struct_pack(dimension := {q(dimension)}, level := {level or q(fixed)}, finding := replace({q(finding)}, '%s', {number}), action := {q(action)}) END"


_r = A.RISK_TEXT
_short = "format('{:,}', CAST(round_even(short, 0) AS BIGINT))"
_risks = ", ".join([
    _sql_risk("demo", _r["demo"]), _sql_risk("n_missing > 0", _r["missing"], "CAST(n_missing AS VARCHAR)"), _sql_risk("n_missing = 0", _r["complete"]), _sql_risk("NOT green", _r["green_open"]), _sql_risk("green", _r["green_ok"]),
    _sql_risk("weak > 0", _r["weak"], "CAST(weak AS VARCHAR)"), _sql_risk("NOT meets", _r["target"], _short), _sql_risk("open_gaps IS NOT NULL", _r["gaps"], "CAST(open_gaps AS VARCHAR)", "CASE WHEN open_gaps > 0 THEN '中' ELSE '低' END")])
_a, _c = PL.ANSWERS, rules.CONCLUSIONS
SQL_ASSESSED = f"""wk AS (SELECT s_suppkey, count(*) FILTER (p_type <> 'PROMO') AS weak FROM pr GROUP BY 1),
og AS (SELECT s_suppkey, count(*) FILTER (status IN {in_list(rules.RISK_STATUSES)}) AS open_gaps FROM gaps GROUP BY 1),
rk AS (SELECT inv.*, n = 2 AS demo, weak, meets, short, open_gaps FROM inv LEFT JOIN wk USING (s_suppkey) LEFT JOIN best USING (s_suppkey) LEFT JOIN og USING (s_suppkey)),
rl AS (SELECT *, list_filter([{_risks}], lambda x: x IS NOT NULL) AS l FROM rk),
lv AS (SELECT *, len(list_filter(l, lambda x: x.level = '高')) AS high, len(list_filter(l, lambda x: x.level = '中')) AS medium FROM rl),
assessed AS (SELECT s_suppkey, CASE WHEN demo THEN 'demonstration' WHEN n_missing = 0 THEN 'formal' ELSE 'data_completion' END AS mode, n_missing = 0 AS ready, CAST(round_even(100.0 * (8 - n_missing) / 8, 0) AS INTEGER) AS readiness_pct,
  CASE WHEN status = 'ok' THEN target END AS core_target, CASE WHEN status = 'ok' AND target IS NOT NULL THEN round(greatest(0.0, net - target * energy), 4) ELSE 0.0 END::DOUBLE AS annual_reduction_needed_tco2, meets AS meets_target, short::DOUBLE AS target_gap_tco2,
  CASE WHEN demo THEN {q(_a['data_demo'])} WHEN n_missing = 0 THEN {q(_a['data_ready'])} ELSE {q(_a['data_open'])} END AS answer_data, CASE WHEN n_missing = 0 THEN {q(_a['state_ready'])} ELSE {q(_a['state_open'])} END AS answer_state,
  CASE WHEN n_missing = 0 THEN {q(_a['gap_ready'])} ELSE {q(_a['gap_open'])} END AS answer_gap, CASE WHEN meets IS NULL THEN {q(_a['cost_none'])} WHEN meets THEN {q(_a['cost_met'])} ELSE {q(_a['cost_missed'])} END AS answer_cost,
  CAST(high AS INTEGER) AS high_risks, CAST(medium AS INTEGER) AS medium_risks, CASE WHEN demo THEN {q(_c['demo'])} WHEN n_missing > 0 THEN {q(_c['not_ready'])} WHEN high > 0 THEN {q(_c['high'])} WHEN medium > 0 THEN {q(_c['medium'])} ELSE {q(_c['clear'])} END AS conclusion FROM lv)"""
SQL_ALL = f"WITH {SQL_SITES}, {SQL_GAPS}, {SQL_CHOICE}, {SQL_ASSESSED}"


def _assessed(spark, d):
    return PL.assess_sites(sites(spark, d), site_projects(spark, d), measures(spark, d), KEY)


@query("assessment", f"{SQL_ALL} SELECT * FROM assessed")
def assessment(spark, d):
    return _assessed(spark, d).sites.select(KEY, "mode", "ready", "readiness_pct", "core_target", "annual_reduction_needed_tco2", "meets_target", "target_gap_tco2", "answer_data", "answer_state", "answer_gap", "answer_cost", "high_risks", "medium_risks", "conclusion")


@query("assessment_risks", f"{SQL_ALL} SELECT s_suppkey, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS ord, unnest(l).dimension AS dimension, unnest(l).level AS level, unnest(l).finding AS finding, unnest(l).action AS action FROM lv")
def assessment_risks(spark, d):
    return _assessed(spark, d).risks


@query("assessment_conclusion", f"{SQL_ALL} SELECT mode, conclusion, count(*) AS sites FROM assessed GROUP BY 1, 2")
def assessment_conclusion(spark, d):
    return _assessed(spark, d).sites.groupBy("mode", "conclusion").agg(F.count("*").alias("sites"))


@query("assessment_measure_counts", f"WITH {SQL_SITES}, {SQL_GAPS}, {SQL_MEASURES}, {SQL_RECOMMEND} SELECT s_suppkey, tier AS label, count(*) AS value FROM recommended GROUP BY 1, 2")
def assessment_measure_counts(spark, d):
    found = _assessed(spark, d)
    return PL.measure_counts(found.recommended, found.screened, KEY)


# --- the interactive assessment -------------------------------------------------

_b = A.BOARD_RISK_TEXT
SQL_BOARD = f"""bo AS (SELECT s_suppkey, count(*) FILTER (status IN {in_list(rules.BOARD_RISK_STATUSES)}) AS open_gaps FROM bgaps GROUP BY 1),
bj AS (SELECT sites.*, meets, short, k, demo, pending, open_gaps FROM sites JOIN bo USING (s_suppkey) JOIN bbest USING (s_suppkey) WHERE n_missing = 0),
board AS (SELECT s_suppkey, CASE WHEN demo > 0 THEN 'demonstration' ELSE 'formal' END AS mode, meets AS meets_target, short::DOUBLE AS target_gap_tco2, CAST(k AS INTEGER) AS selected, demo AS demo_projects, pending AS pending_projects, open_gaps,
  CASE WHEN demo > 0 THEN {q(_c['demo'])} WHEN NOT meets THEN {q(_c['high'])} WHEN pending > 0 OR open_gaps > 0 THEN {q(rules.BOARD_MEDIUM_CONCLUSION)} ELSE {q(_c['clear'])} END AS conclusion FROM bj
  UNION ALL SELECT s_suppkey, 'data_completion', NULL, NULL, NULL, NULL, NULL, NULL, {q(_c['not_ready'])} FROM sites WHERE n_missing > 0)"""
SQL_BOARD_ALL = f"WITH {SQL_SITES}, {SQL_BOARD_GAPS}, {SQL_CHOICE}, {SQL_BOARD}"


def _board_assessed(spark, d):
    """Promotional parts stand for demonstration parameters, small ones for values to be verified."""
    evidence = F.when(F.col("project_id") == "PROMO", "演示参数").when(F.col("project_id") == "SMALL", "待核实").otherwise("园区可研")
    rows = site_projects(spark, d).withColumn("evidence_level", evidence).withColumn("name", F.col("project_id"))
    return PL.assess_board(sites(spark, d), rows, measures(spark, d), KEY)


@query("board_assessment", f"{SQL_BOARD_ALL} SELECT * FROM board")
def board_assessment(spark, d):
    return _board_assessed(spark, d).sites.select(KEY, "mode", "meets_target", "target_gap_tco2", "selected", "demo_projects", "pending_projects", "open_gaps", "conclusion")


@query("board_owners", f"""{SQL_BOARD_ALL}, sel AS (SELECT it.s_suppkey, it.c FROM bbest JOIN it ON it.s_suppkey = bbest.s_suppkey AND (mask >> spot) & 1 = 1 JOIN pr ON pr.s_suppkey = it.s_suppkey AND pr.p_type = it.p_type JOIN bj ON bj.s_suppkey = it.s_suppkey)
SELECT s_suppkey, {q(rules.BOARD_DEFAULT_OWNERS[0])} AS stakeholder, count(*) AS project_count, round(sum(c / 10000.0), 2)::DOUBLE AS capex FROM sel GROUP BY 1""")
def board_owners(spark, d):
    """Owners follow from the category; these projects have none of the listed ones."""
    return _board_assessed(spark, d).stakeholders.select(KEY, "stakeholder", "project_count", F.round("capex_10k_cny", 2).alias("capex"))


OWNED = {"PROMO": "绿色供能", "SMALL": "资源循环", "LARGE": "管理基础"}


@query("board_owner_shares", f"""WITH {SQL_PROJECTS}, o AS (SELECT *, CASE p_type {' '.join(f"WHEN {q(t)} THEN [{', '.join(q(x) for x in rules.BOARD_OWNERS[c])}]" for t, c in OWNED.items())} ELSE [{', '.join(q(x) for x in rules.BOARD_DEFAULT_OWNERS)}] END AS ow FROM pm JOIN part ON project_id = CAST(p_partkey AS VARCHAR)),
x AS (SELECT brand, unnest(ow) AS stakeholder, len(ow) AS k, capex, abate FROM o) SELECT brand, stakeholder, count(*) AS project_count, round(sum(capex / k), 4) AS capex_10k_cny, round(sum(abate / k), 4) AS annual_abatement_tco2 FROM x GROUP BY 1, 2""")
def board_owner_shares(spark, d):
    category = F.col("category")
    for kind, name in OWNED.items():
        category = F.when(F.col("category") == kind, name).otherwise(category)
    return P.board_stakeholders(_priced(spark, d).withColumn("category", category), "brand").select("brand", "stakeholder", "project_count", "capex_10k_cny", "annual_abatement_tco2")


@query("sensitivity_exact", f"""WITH {SQL_PROJECTS}, c(ord, name_, fc, fs, fo, fa) AS (VALUES {_cases}), t AS (SELECT brand, ord, name_, sum(capex * fc) AS c, sum(abate * fa) AS a, sum(saving * fs - opex * fo) AS n, sum(capex * fc - (saving * fs - opex * fo) * factor) AS v FROM pm CROSS JOIN c GROUP BY ALL)
SELECT brand, ord, name_ AS "case", round(c, 4) AS capex_10k_cny, round(n, 4) AS annual_net_benefit_10k_cny, round(v, 4) AS npv_cost_10k_cny FROM t""")
def sensitivity_exact(spark, d):
    """Saving and upkeep scaled on their own, as the board does."""
    return P.sensitivity(_priced(spark, d), "brand", F.lit(0.05), exact=True).select("brand", "ord", "case", "capex_10k_cny", "annual_net_benefit_10k_cny", "npv_cost_10k_cny")


@query("select_p0", f"WITH {SQL_FIELDS} SELECT 'M' || lpad(CAST(m AS VARCHAR), 2, '0') AS field_id FROM f WHERE w = 3")
def select_p0(spark, d):
    return A.select_priority(_fields(spark, d))


BRAND_BUDGET = 60
_steps = f"range(0, {BRAND_BUDGET + 1})"


@query("portfolio_by_brand", f"""WITH RECURSIVE it AS (SELECT p_brand AS brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, CAST(floor(p_retailprice / 100) AS INTEGER) AS w,
  CAST(round(round(floor(p_retailprice / 100) - (p_size - 20.0) * ((1 - power(1.05::DOUBLE, -10)) / 0.05::DOUBLE), 4) * 10000) AS BIGINT) AS v FROM part),
dp(brand, i, st) AS (SELECT brand, 0::BIGINT, list_transform({_steps}, lambda c: 0::BIGINT) FROM (SELECT DISTINCT brand FROM it) UNION ALL
  SELECT dp.brand, dp.i + 1, list_transform({_steps}, lambda c: CASE WHEN c >= w THEN least(st[c + 1], st[c + 1 - w] + v) ELSE st[c + 1] END) FROM dp JOIN it ON it.brand = dp.brand AND it.i = dp.i + 1)
SELECT brand, true AS meets_target, st[{BRAND_BUDGET + 1}] / 10000 AS npv_cost_10k_cny FROM dp QUALIFY i = max(i) OVER (PARTITION BY brand)""")
def portfolio_by_brand(spark, d):
    """All parts of a brand as candidates of one scenario, far more than can be listed; the twin fills a table of budgets."""
    p = table(spark, d, "part")
    rows = p.select(
        F.col("p_brand").alias("brand"), F.col("p_partkey").cast("string").alias("project_id"), F.col("p_name").alias("name"), F.floor(F.col("p_retailprice") / 100).cast("double").alias("capex_10k_cny"), (F.col("p_size") * 1.0).alias("annual_abatement_tco2"),
        (F.col("p_size") * 1.0).alias("annual_saving_10k_cny"), F.lit(20.0).alias("annual_opex_10k_cny"), F.lit(10).alias("lifetime_years"), F.lit(2027).alias("start_year"), F.lit("").alias("mutex_group"), F.array().cast("array<string>").alias("prerequisites"))
    settings = p.select(F.col("p_brand").alias("brand")).distinct().select("brand", F.lit(float(BRAND_BUDGET)).alias("budget_10k_cny"), F.lit(0.0).alias("annual_target_tco2"), F.lit(0.05).alias("discount_rate"))
    return P.select_portfolio(rows, settings, "brand")[0].select("brand", "meets_target", "npv_cost_10k_cny")
