"""Mart, map, search and digest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from greenledger import rules
from greenledger.bindings.registry import any_of, in_list, q, query, table
from greenledger.bindings.text import CORPUS, SQL_CURATED, SQL_DOCS, THEMES, doc_records
from greenledger.functions import geo, scoring as S, text as T
from greenledger.operators import assess as A, cells, digest as G, marts as M, quality as Q
from greenledger.session import cut


def raw_parks(spark, d):
    """Customers as parks: their nation is the province, two regions are domestic."""
    c = table(spark, d, "customer")
    n = table(spark, d, "nation")
    r = table(spark, d, "region")
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    return j.select(
        k.cast("string").alias("park_id"), F.when(F.col("r_name").isin("ASIA", "EUROPE"), "国内园区").when(F.col("r_name") == "AFRICA", "").otherwise("国际案例").alias("region_scope"),
        F.when(bal > 6000, "国家级").when(bal > 2000, "省级").otherwise("").alias("level"), F.col("n_name").alias("province"), F.concat_ws("-", "n_name", "c_mktsegment").alias("city"),
        F.col("r_name").alias("country"), F.col("c_name").alias("park_name"), F.col("c_mktsegment").alias("industry_group"), F.when(bal < 0, "").when(bal < 5000, "整体").otherwise("园中园").alias("boundary_type"),
        F.when(bal < 1000, "").otherwise(F.concat((F.lit(2020) + F.floor(bal / 2000)).cast("string"), F.lit("-2030"))).alias("construction_period"),
        (F.lit(20.0) + F.col("c_nationkey") + F.pmod(k, F.lit(10))).cast("string").alias("latitude"), (F.lit(60.0) + F.col("c_nationkey") * 3 + F.pmod(k, F.lit(7))).cast("string").alias("longitude"),
        F.when(F.col("c_nationkey") == 5, "").otherwise("近似中心").alias("coordinate_precision"),
    )


SQL_PARKS = """parks AS (SELECT CAST(c_custkey AS VARCHAR) AS park_id, CASE WHEN r_name IN ('ASIA', 'EUROPE', 'AFRICA') THEN '国内园区' ELSE '国际案例' END AS scope,
  CASE WHEN c_acctbal > 6000 THEN '国家级' WHEN c_acctbal > 2000 THEN '省级' ELSE '' END AS level, n_name AS province, n_name || '-' || c_mktsegment AS city, r_name AS country, c_name AS name,
  c_mktsegment AS industry, CASE WHEN c_acctbal < 0 THEN '' WHEN c_acctbal < 5000 THEN '整体' ELSE '园中园' END AS boundary_type,
  CASE WHEN c_acctbal < 1000 THEN '' ELSE CAST(2020 + CAST(floor(c_acctbal / 2000) AS INTEGER) AS VARCHAR) || '-2030' END AS period,
  20.0::DOUBLE + c_nationkey + c_custkey % 10 AS lat, 60.0::DOUBLE + c_nationkey * 3 + c_custkey % 7 AS lon, CASE WHEN c_nationkey = 5 THEN '' ELSE '近似中心' END AS coordinate_precision
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def parks(spark, d):
    return M.park_projection(raw_parks(spark, d))


def evidence(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").cast("string").alias("park_id"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("statement"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))


@query("park_projection", f"WITH {SQL_PARKS} SELECT park_id, scope, level, province, city, country, name, industry, boundary_type, period, lat, lon, coordinate_precision, '' AS note, {q(M.FOCUS_DEFAULT)} AS focus, {q(M.REVIEW_DEFAULT)} AS coordinate_status FROM parks")
def park_projection(spark, d):
    return parks(spark, d).select("park_id", "scope", "level", "province", "city", "country", "name", "industry", "boundary_type", "period", "lat", "lon", "coordinate_precision", "note", "focus", "coordinate_status")


def _top(kind, column, default, k):
    label = f"coalesce(nullif({column}, ''), '{default}')"
    return f"SELECT '{kind}' AS kind, {label} AS name, count(*) AS value, row_number() OVER (ORDER BY count(*) DESC, {label}) AS rank FROM parks WHERE scope = '国内园区' GROUP BY {label} QUALIFY rank <= {k}"


@query("park_profile", f"WITH {SQL_PARKS} " + " UNION ALL ".join(f"({_top(*a)})" for a in (("province", "province", "未标注", 20), ("industry", "industry", "未分类", 12), ("level", "level", "未标注", 10), ("boundary", "boundary_type", "待核实", 10)))
       + " UNION ALL SELECT 'scope', CASE WHEN scope = '国内园区' THEN 'domestic_count' ELSE 'international_count' END, count(*), 1 FROM parks GROUP BY 2")
def park_profile(spark, d):
    return M.park_profile(parks(spark, d))


@query("evidence_by_park", "SELECT CAST(o_custkey AS VARCHAR) AS park_id, count(*) AS evidence_count, strftime(min(o_orderdate), '%Y-%m-%d') AS first_date, strftime(max(o_orderdate), '%Y-%m-%d') AS last_date FROM orders GROUP BY o_custkey")
def evidence_by_park(spark, d):
    return M.evidence_by_park(evidence(spark, d))


@query("evidence_rows", f"SELECT CAST(o_custkey AS VARCHAR) AS park_id, o_orderstatus || ' ' || o_orderpriority AS statement, strftime(o_orderdate, '%Y-%m-%d') AS date, {q(M.CAVEAT_DEFAULT)} AS caveat FROM orders")
def evidence_rows(spark, d):
    return M.evidence_rows(evidence(spark, d)).select("park_id", "statement", "date", "caveat")


_same = [(f"(a.{c} <> '' AND a.{c} = b.{c})", p, r) for c, p, r in (("industry", 5, "产业类型相同"), ("boundary_type", 2, "建设边界相同"), ("level", 2, "名单层级相同"), ("province", 1, "同省"))]
_same.append(("(a.period <> '' AND left(a.period, 4) = left(b.period, 4))", 1, "启动年份接近"))
SQL_PEERS = f"""pairs AS (SELECT a.park_id, b.park_id AS peer_id, b.name AS peer_name, {' + '.join(f'CASE WHEN {t} THEN {p} ELSE 0 END' for t, p, _ in _same)} AS score,
  array_to_string(list_filter([{', '.join(f"CASE WHEN {t} THEN '{r}' END" for t, _, r in _same)}], lambda x: x IS NOT NULL), '、') AS why
  FROM parks a JOIN parks b ON a.park_id <> b.park_id AND a.scope = '国内园区' AND b.scope = '国内园区'),
peers AS (SELECT park_id, row_number() OVER (PARTITION BY park_id ORDER BY score DESC, peer_name, peer_id) AS rank, peer_id, peer_name, score, coalesce(nullif(why, ''), '基础属性接近') AS reasons FROM pairs QUALIFY rank <= 5)"""


@query("peer_topk", f"WITH {SQL_PARKS}, {SQL_PEERS} SELECT * FROM peers")
def peer_topk(spark, d):
    return M.peer_topk(parks(spark, d))


@query("park_card", f"""WITH {SQL_PARKS}, {SQL_PEERS}, p AS (SELECT park_id, string_agg(peer_id, ';' ORDER BY rank) AS peers FROM peers GROUP BY park_id),
e AS (SELECT CAST(o_custkey AS VARCHAR) AS park_id, count(*) AS n, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM orders GROUP BY o_custkey)
SELECT park_id, name, province || ' ' || city AS region, coalesce(nullif(boundary_type, ''), '待核实') AS boundary, coalesce(nullif(period, ''), '待核实') AS period, coalesce(nullif(industry, ''), '待确认') AS industry,
  coalesce(n, 0) AS evidence_count, coalesce(last, '') AS last_evidence, coalesce(peers, '') AS peers FROM parks LEFT JOIN e USING (park_id) LEFT JOIN p USING (park_id)""")
def park_card(spark, d):
    return M.park_card(parks(spark, d), evidence(spark, d))


def _corpus(kind, column):
    return f"SELECT '{kind}' AS kind, {column} AS name, count(*) AS value, row_number() OVER (ORDER BY count(*) DESC, {column}) AS rank FROM documents GROUP BY {column} QUALIFY rank <= 12"


@query("corpus_counts", " UNION ALL ".join(f"({_corpus(*a)})" for a in (("topics", "lang"), ("sources", "source"), ("regions", "lang || '/' || source"))))
def corpus_counts(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("topic"), F.col("source").alias("publisher"), F.concat_ws("/", "lang", "source").alias("region"))
    return M.corpus_counts(docs)


@query("category_board", "WITH " + SQL_CURATED + " SELECT category AS name, count(*) AS value, CASE category " + " ".join(f"WHEN {q(c)} THEN {i}" for i, c in enumerate(rules.BOARD_ORDER)) + " ELSE 6 END AS ord FROM curated GROUP BY category")
def category_board(spark, d):
    return M.category_board(S.curate(doc_records(spark, d), CORPUS), "category")


@query("monthly_counts", "SELECT strftime(o_orderdate, '%Y-%m') AS name, count(*) AS value FROM orders GROUP BY 1")
def monthly_counts(spark, d):
    return M.monthly_counts(table(spark, d, "orders"), "o_orderdate")


@query("cumulative_days", """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 90)
SELECT strftime(day, '%Y-%m-%d') AS date, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS value FROM d""")
def cumulative_days(spark, d):
    return M.cumulative_days(table(spark, d, "orders"), "o_orderdate").select(F.col("date").cast("string").alias("date"), "value")


@query("bar_share", """WITH c AS (SELECT o_orderstatus AS chart, strftime(o_orderdate, '%Y-%m') AS name, count(*) AS value FROM orders GROUP BY 1, 2),
t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY chart ORDER BY value DESC, name) <= 12)
SELECT chart, name, value, round(value / greatest(1, max(value) OVER (PARTITION BY chart)) * 100, 1) AS share_pct FROM t""")
def bar_share(spark, d):
    o = table(spark, d, "orders")
    counts = o.groupBy(F.col("o_orderstatus").alias("chart"), F.date_format("o_orderdate", "yyyy-MM").alias("name")).agg(F.count("*").alias("value"))
    return M.bar_share(counts, "chart", "value")


@query("data_funnel", "SELECT * FROM (SELECT CAST(0 AS INTEGER) AS ord, (SELECT count(*) FROM customer) AS value UNION ALL SELECT 1, (SELECT count(*) FROM documents) UNION ALL SELECT 2, (SELECT count(*) FROM orders) UNION ALL SELECT 3, (SELECT count(*) FROM labels) UNION ALL SELECT 4, (SELECT count(*) FROM supplier WHERE s_acctbal > 0)) f JOIN (VALUES "
       + ", ".join(f"({i}, {q(n)}, {q(m)})" for i, (n, m) in enumerate(rules.FUNNEL)) + ") n(ord, name, meaning) USING (ord)")
def data_funnel(spark, d):
    t = lambda n: table(spark, d, n)
    return M.data_funnel(t("customer"), t("documents"), t("orders"), t("labels"), t("supplier").select((F.col("s_acctbal") > 0).alias("ready")))


@query("dashboard_counts", f"""WITH {SQL_PARKS}, {SQL_CURATED} SELECT 'domestic_parks' AS name, count(*) AS value FROM parks WHERE scope = '国内园区' UNION ALL SELECT 'international_cases', count(*) FROM parks WHERE scope <> '国内园区'
UNION ALL SELECT 'archive_records', count(*) FROM curated WHERE relevance_status = 'include' UNION ALL SELECT 'excluded_low_relevance', count(*) FROM curated WHERE relevance_status <> 'include'
UNION ALL SELECT 'technology_measures', count(*) FROM part UNION ALL SELECT 'verified_public_facts', count(*) FROM labels""")
def dashboard_counts(spark, d):
    p, c = parks(spark, d), cut(S.curate(doc_records(spark, d), CORPUS).select("relevance_status"))
    domestic, kept = F.col("scope") == rules.DOMESTIC, F.col("relevance_status") == "include"
    return M.count_block({"domestic_parks": p.filter(domestic), "international_cases": p.filter(~domestic), "archive_records": c.filter(kept), "excluded_low_relevance": c.filter(~kept),
                          "technology_measures": table(spark, d, "part"), "verified_public_facts": table(spark, d, "labels")})


_plan = [(block, i, *row) for block, rows in rules.HEADLINES.items() for i, row in enumerate(rows)]
_sql_plan = ", ".join(f"({q(b)}, {i}, {q(label)}, {q(name)}, {q(other) if other else 'NULL'})" for b, i, label, name, other in _plan)


@query("headline_numbers", f"""WITH {SQL_PARKS}, {SQL_CURATED}, held AS (SELECT 'domestic_parks' AS name, count(*) AS value FROM parks WHERE scope = '国内园区' UNION ALL SELECT 'international_cases', count(*) FROM parks WHERE scope <> '国内园区'
UNION ALL SELECT 'required_fields', count(DISTINCT month(o_orderdate)) FROM orders UNION ALL SELECT 'technology_measures', count(*) FROM part UNION ALL SELECT 'formal_accounting_ready', count(*) FROM supplier WHERE s_acctbal > 500
UNION ALL SELECT 'archive_records', 0), spare AS (SELECT 'included' AS name, count(*) FILTER (relevance_status = 'include') AS value FROM curated UNION ALL SELECT 'excluded_low_relevance', count(*) FILTER (relevance_status <> 'include') FROM curated)
SELECT block, p.ord, label, coalesce(nullif(held.value, 0), nullif(spare.value, 0), 0) AS value FROM (VALUES {_sql_plan}) p(block, ord, label, name, other) LEFT JOIN held ON held.name = p.name LEFT JOIN spare ON spare.name = p.other""")
def headline_numbers(spark, d):
    """Headline numbers; the archive's count is absent here, so the strip falls back to the curation statistics."""
    p, c = parks(spark, d), cut(S.curate(doc_records(spark, d), CORPUS).select("relevance_status"))
    domestic, kept = F.col("scope") == rules.DOMESTIC, F.col("relevance_status") == "include"
    months = table(spark, d, "orders").select(F.month("o_orderdate")).distinct()
    counts = M.count_block({"domestic_parks": p.filter(domestic), "international_cases": p.filter(~domestic), "required_fields": months, "technology_measures": table(spark, d, "part"), "formal_accounting_ready": table(spark, d, "supplier").filter("s_acctbal > 500")})
    return M.headline(counts, M.count_block({"included": c.filter(kept), "excluded_low_relevance": c.filter(~kept)}))


@query("mart_checks", "SELECT 'parks' AS \"check\", CASE WHEN count(*) > 0 THEN 'ok' ELSE 'error' END AS status FROM customer UNION ALL SELECT 'updates', CASE WHEN count(*) > 0 THEN 'ok' ELSE 'warning' END FROM documents")
def mart_checks(spark, d):
    return Q.mart_checks(table(spark, d, "customer"), table(spark, d, "documents"))


@query("facet_search", f"""WITH {SQL_PARKS}, {SQL_DOCS}, t AS (
SELECT '园区' AS type, province || '/' || city AS date, name AS title, '；' || industry || '；' || boundary_type || '；' || period AS description, '公开名录资料' AS "limit", '' AS url, '园区名录' AS source FROM parks
UNION ALL SELECT '动态', published_date, title, summary, '正式判断前核对原文', url, publisher FROM docs)
SELECT type, date, title, url, source, sha256(description) AS description_sha FROM t WHERE contains(lower(title || ' ' || description || ' ' || "limit" || ' ' || date || ' ' || source), 'building') OR contains(lower(title || ' ' || description || ' ' || "limit" || ' ' || date || ' ' || source), 'building')""")
def facet_search(spark, d):
    rows = M.search_rows(parks=parks(spark, d), records=doc_records(spark, d))
    return M.search(rows, " BUILDING ").select("type", "date", "title", "url", "source", F.sha2("description", 256).alias("description_sha"))


SQL_TABLE = f"""t AS (SELECT 0 AS spot, '园区' AS type, province || '/' || city AS date, name AS title, '；' || industry || '；' || boundary_type || '；' || period AS description, '公开名录资料' AS "limit", '' AS url, '园区名录' AS source FROM parks
UNION ALL SELECT 1, '动态', published_date, title, summary, '正式判断前核对原文', url, publisher FROM docs
UNION ALL SELECT 2, '标准', '政策标准', n_name, 'rule of ' || r_name, '按适用范围使用', 'https://rules.example/' || n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 3, '措施', {q(rules.SPECIAL)}, p_name, p_type || '；适用：全部；对象：待确认', '需专项核实；指南级参数', 'data/technology_guidance.csv', '减排设施指南' FROM part)"""


def everything(spark, d):
    """Parks, documents, nations as rules and parts as measures in one search table."""
    c = F.col
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    standards = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(
        F.lit("").alias("category"), c("n_name").alias("item"), F.lit("").alias("rule_id"), F.concat(F.lit("rule of "), "r_name").alias("rule"), F.lit("").alias("nature"),
        F.concat(F.lit("https://rules.example/"), c("n_nationkey").cast("string")).alias("source_url"), c("r_name").alias("source"))
    given = {"direction": c("p_type"), "park": F.lit("全部"), "object": F.lit("待确认"), "constraints": F.lit("需专项核实"), "status": F.lit("指南级参数"), "type": F.lit(rules.SPECIAL), "name": c("p_name")}
    return M.search_rows(parks(spark, d), doc_records(spark, d), standards, table(spark, d, "part").select(*[v.alias(k) for k, v in given.items()]))


@query("search_page", f"""WITH {SQL_PARKS}, {SQL_DOCS}, {SQL_TABLE} SELECT type, date, title, url, source FROM t WHERE contains(lower(title || ' ' || description || ' ' || "limit" || ' ' || date || ' ' || source), 'al') AND type IN ('措施', '标准') AND type = '措施' ORDER BY spot, title, url, date LIMIT 25 OFFSET 25""")
def search_page(spark, d):
    """The second page of 25 results among the measures."""
    return M.search_page(M.search(everything(spark, d), "AL", "措施"), 2).select("type", "date", "title", "url", "source")


@query("search_counts", f"""WITH {SQL_PARKS}, {SQL_DOCS}, {SQL_TABLE} SELECT type, count(*) AS value FROM t WHERE contains(lower(title || ' ' || description || ' ' || "limit" || ' ' || date || ' ' || source), 'er') GROUP BY type""")
def search_counts(spark, d):
    """Hits by type over all four datasets."""
    return M.search(everything(spark, d), "er").groupBy("type").agg(F.count("*").alias("value"))


_board = ["purchase", "view"]


@query("feed_facets", f"""SELECT 0 AS ord, {q(rules.ALL_FACET)} AS name UNION ALL SELECT DISTINCT CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 ELSE 3 END, event_type FROM events""")
def feed_facets(spark, d):
    return M.facet_values(table(spark, d, "events").select(F.lit("").alias("category"), F.col("event_type").alias("topic")), _board)


@query("feed_category", """SELECT event_id, event_type FROM events WHERE event_type = 'click' ORDER BY CAST(ts AS DATE) DESC, CAST(trunc(value) AS INTEGER) DESC, event_id LIMIT 9""")
def feed_category(spark, d):
    """The first page of the feed under one category."""
    e = table(spark, d, "events").withColumns({"category": F.col("event_type"), "quality": F.col("value").cast("int")})
    return M.page(M.feed_rows(e, "click"), [F.desc(F.to_date("ts")), F.desc("quality"), F.col("event_id")], 9).select("event_id", "event_type")


@query("feed_page", "SELECT event_id, event_type FROM events ORDER BY CAST(ts AS DATE) DESC, CAST(trunc(value) AS INTEGER) DESC, event_id LIMIT 9 OFFSET 9")
def feed_page(spark, d):
    e = table(spark, d, "events").withColumn("quality", F.col("value").cast("int"))
    return M.page(e, [F.desc(F.to_date("ts")), F.desc("quality"), F.col("event_id")], 9, 2).select("event_id", "event_type")


_X = "24 + (lon - 72.0) / (136.5 - 72.0) * 952"
_MY = "ln(tan(pi() / 4 + radians(greatest(-85.0, least(85.0, {0}))) / 2))"
_Y = f"20 + ({_MY.format('54.5')} - {_MY.format('lat')}) / ({_MY.format('54.5')} - {_MY.format('17.0')}) * 560"


@query("map_view", f"""WITH {SQL_PARKS} SELECT park_id, CASE WHEN level = '国家级' THEN 'national' ELSE 'provincial' END AS marker, round({_X}, 4) AS x, round({_Y}, 4) AS y,
  {_X} BETWEEN 0 AND 1000 AND {_Y} BETWEEN 0 AND 600 AS on_board FROM parks WHERE scope = '国内园区' AND contains(lower(name || ' ' || province || ' ' || city || ' ' || country || ' ' || industry), 'machinery')""")
def map_view(spark, d):
    rows = M.map_rows(parks(spark, d), "全国", "Machinery")
    return rows.select("park_id", "marker", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "on_board")


@query("mercator_project", f"WITH {SQL_PARKS} SELECT park_id, round({_MY.format('lat')}, 8) AS y FROM parks")
def mercator_project(spark, d):
    return parks(spark, d).select("park_id", F.round(geo.mercator_y(F.col("lat")), 8).alias("y"))


@query("bbox_filter", f"""WITH {SQL_PARKS} SELECT province, bool_or(lon BETWEEN 108.8 - 12 AND 118.2 + 12 AND lat BETWEEN 19.0 - 8 AND 26.2 + 8) AS touches FROM parks GROUP BY province""")
def bbox_filter(spark, d):
    box = [v for v in rules.MAP_VIEWS if v[0] == "广东"]
    vertices = cells.index_vertices(parks(spark, d).select("province", "lon", "lat"))
    return cells.features_in_views(vertices, box, "province").select("province", "touches")


@query("map_view_world", f"""WITH {SQL_PARKS} SELECT park_id, 'international' AS marker, round(24 + (lon + 180.0) / 360.0 * 952, 4) AS x, round(20 + ({_MY.format('84.0')} - {_MY.format('lat')}) / ({_MY.format('84.0')} - {_MY.format('(-58.0)')}) * 560, 4) AS y FROM parks WHERE scope <> '国内园区'""")
def map_view_world(spark, d):
    return M.map_rows(parks(spark, d), "全球").select("park_id", "marker", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("map_views", f"""WITH {SQL_PARKS} SELECT v.view, province, bool_or(lon BETWEEN w - 12 AND e + 12 AND lat BETWEEN s - 8 AND n + 8) AS touches FROM parks, (VALUES {', '.join(f"({q(v[0])}, {v[1]}::DOUBLE, {v[2]}::DOUBLE, {v[3]}::DOUBLE, {v[4]}::DOUBLE)" for v in rules.MAP_VIEWS)}) v(view, w, e, s, n) GROUP BY 1, 2""")
def map_views(spark, d):
    """Which outlines every view of the map shows."""
    vertices = cells.index_vertices(parks(spark, d).select("province", "lon", "lat"))
    return cells.features_in_views(vertices, rules.MAP_VIEWS, "province").select("view", "province", "touches")


@query("coord_audit", f"""WITH {SQL_PARKS}, c AS (SELECT park_id, lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AS in_range, coordinate_precision <> '' AS described,
  scope <> '国内园区' OR (lon BETWEEN 70 AND 140 AND lat BETWEEN 15 AND 55) AS in_box FROM parks) SELECT *, in_range AND described AND in_box AS passed FROM c""")
def coord_audit(spark, d):
    return Q.coordinate_audit(parks(spark, d))


# --- quality ------------------------------------------------------------------

def observations(spark, d):
    li = table(spark, d, "lineitem")
    c = F.col
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_key"), c("l_suppkey"), c("l_partkey"),
        F.when(c("l_returnflag") == "A", "https://x.example/a").when(c("l_returnflag") == "N", "http://x.example/n").otherwise("").alias("source_url"), F.when(c("l_tax") > 0, F.date_format("l_shipdate", "yyyy")).alias("period"),
        F.when(c("l_linestatus") == "O", "园区").alias("boundary"), c("l_quantity").cast("string").alias("value"), F.when(c("l_discount") < 0.05, "%").when(c("l_discount") < 0.09, "kg").alias("unit"), c("l_shipdate").cast("date").alias("date"), c("l_discount"),
    )


@query("dq_violations", """WITH v AS (SELECT unnest(list_filter([CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'Q01' END, CASE WHEN NOT l_tax > 0 THEN 'Q02' END, CASE WHEN l_linestatus <> 'O' THEN 'Q03' END,
  CASE WHEN l_discount >= 0.05 AND l_discount < 0.09 THEN 'Q04' END, CASE WHEN l_discount >= 0.09 THEN 'G01' END, CASE WHEN l_returnflag = 'N' THEN 'G02' END, CASE WHEN l_shipdate > DATE '2001-06-30' THEN 'G03' END], lambda x: x IS NOT NULL)) AS rule_id FROM lineitem)
SELECT rule_id, count(*) AS violations FROM v GROUP BY rule_id""")
def dq_violations(spark, d):
    found = Q.violations(observations(spark, d), "row_key", ["%", "个"], F.lit("2001-06-30").cast("date"))
    return Q.summary(found).select("rule_id", "violations")


@query("dq_conflicts", "SELECT l_suppkey, l_partkey, min(l_discount) AS low, max(l_discount) AS high, count(*) AS \"rows\" FROM lineitem GROUP BY 1, 2 HAVING min(l_discount) < max(l_discount)")
def dq_conflicts(spark, d):
    return Q.conflicting_values(observations(spark, d), ["l_suppkey", "l_partkey"], "l_discount")


@query("dq_dependencies", """WITH g AS (SELECT l_suppkey, l_partkey, count(*) AS "rows", min(l_linestatus) AS lo1, max(l_linestatus) AS hi1, min(year(l_shipdate)) AS lo2, max(year(l_shipdate)) AS hi2 FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, l_partkey, "rows", 'Q09' AS rule_id, 'boundary' AS "column", lo1 AS low, hi1 AS high FROM g WHERE lo1 < hi1 UNION ALL SELECT l_suppkey, l_partkey, "rows", 'Q09', 'year', CAST(lo2 AS VARCHAR), CAST(hi2 AS VARCHAR) FROM g WHERE lo2 < hi2""")
def dq_dependencies(spark, d):
    """Ratios whose numerator and denominator disagree on year or boundary, in one pass, with two rows that show it."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", F.year("l_shipdate").alias("year"), F.col("l_linestatus").alias("boundary"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_key"))
    found = Q.dependency_violations(li, ["l_suppkey", "l_partkey"], {"year": "Q09", "boundary": "Q09"}, "row_key")
    return found.select("l_suppkey", "l_partkey", "rows", "rule_id", "column", "low", "high")


@query("dq_declared", """SELECT rule_id, count(*) AS violations FROM (SELECT unnest(list_filter([CASE WHEN l_quantity > 40 AND l_returnflag <> 'A' THEN 'Q06' END, CASE WHEN l_linenumber % 2 = 0 AND l_linestatus = 'O' THEN 'Q08' END,
  CASE WHEN l_linenumber = 5 THEN 'Q10' END, CASE WHEN l_linenumber <= 2 AND l_returnflag = 'R' THEN 'Q11' END], lambda x: x IS NOT NULL)) AS rule_id FROM lineitem) GROUP BY rule_id""")
def dq_declared(spark, d):
    """Proxy data, misused factors, case values as parameters and core metrics on weak evidence."""
    li, c = table(spark, d, "lineitem"), F.col
    rows = li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_key"), F.lit("https://x").alias("source_url"), F.lit("2020").alias("period"), F.lit("园区").alias("boundary"), F.lit("1").alias("value"), F.lit("%").alias("unit"),
        F.when(c("l_quantity") > 40, "是").alias("proxy"), F.when(c("l_returnflag") == "A", "pre_assessment").alias("use"), F.when(c("l_linenumber") % 2 == 0, "组织").alias("factor_purpose"), F.when(c("l_linestatus") == "O", "产品").otherwise("组织").alias("used_for"),
        F.when(c("l_linenumber") == 5, "project_case").alias("origin"), F.when(c("l_linenumber") <= 2, "true").alias("core_metric"), F.when(c("l_returnflag") == "R", "C").otherwise("B").alias("evidence_grade"))
    return Q.summary(Q.violations(rows, "row_key", ["%"])).select("rule_id", "violations")


@query("stale_reports", """SELECT l_orderkey AS report_id, count(DISTINCT l_partkey) AS stale_inputs, min(l_partkey) AS first_input FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND CAST(l_quantity AS INTEGER) <= p_size WHERE p_partkey IS NULL OR CAST(l_quantity AS INTEGER) <> p_size GROUP BY 1""")
def stale_reports(spark, d):
    """Orders as reports computed from parts; the quantity is the version used, the size the current one."""
    used = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_partkey").alias("input_id"), F.col("l_quantity").cast("int").alias("version"))
    now = table(spark, d, "part").select(F.col("p_partkey").alias("input_id"), F.col("p_size").cast("int").alias("version"))
    return Q.stale_reports(used, now)


@query("dq_repeats", "SELECT l_orderkey, l_linenumber, count(*) AS \"rows\" FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dq_repeats(spark, d):
    return Q.repeated_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


# --- digests ------------------------------------------------------------------

EVENT_ORDER = ["purchase", "signup", "click", "view", "error"]
EVENT_SHARES = {"purchase": 0.35, "signup": 0.25, "click": 0.15, "view": 0.15, "error": 0.10}


def feed(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.to_date("ts").alias("published_date"), F.col("event_type").alias("category"), F.col("value").cast("int").alias("quality_score"), F.concat_ws("-", "event_type", "event_id").alias("title"), F.col("event_id").cast("string").alias("event_key"))


SQL_FEED = "feed AS (SELECT event_id, CAST(ts AS DATE) AS day, event_type AS category, CAST(trunc(value) AS INTEGER) AS quality, event_type || '-' || event_id AS title FROM events)"


def sql_digest(days: int, limit: int) -> str:
    plan = G.quotas(limit, EVENT_SHARES)
    target = "CASE category " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in plan.items()) + " ELSE 0 END"
    spot = "CASE category " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(EVENT_ORDER)) + " END"
    rank = "quality DESC, day DESC, title DESC"
    return f"""{SQL_FEED}, m AS (SELECT max(day) AS latest FROM feed), n AS (SELECT count(*) AS n FROM feed, m WHERE day >= latest - {days - 1}),
w AS (SELECT feed.* FROM feed, m, n WHERE day >= latest - CASE WHEN n < {min(6, limit)} THEN {max(4 * days, 30) - 1} ELSE {days - 1} END),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {rank}) <= {target} AS is_quota FROM w),
s AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN is_quota THEN 0 ELSE 1 END, CASE WHEN is_quota THEN {spot} ELSE 0 END, {rank}) AS n FROM r),
digest AS (SELECT event_id, category, quality, is_quota, row_number() OVER (ORDER BY {rank}) AS digest_rank FROM s WHERE n <= {limit})"""


@query("recent_window", f"WITH {SQL_FEED} SELECT event_id, category FROM feed WHERE day >= (SELECT max(day) FROM feed) - 6")
def recent_window(spark, d):
    return G.recent_window(feed(spark, d), "published_date", 7).select("event_id", "category")


def _digest(spark, d, days, limit):
    return G.balanced_select(feed(spark, d), days=days, limit=limit, order=EVENT_ORDER, shares=EVENT_SHARES)


@query("balanced_digest", f"WITH {sql_digest(7, 28)} SELECT event_id, category, quality AS quality_score, is_quota, digest_rank FROM digest")
def balanced_digest(spark, d):
    return _digest(spark, d, 7, 28).select("event_id", "category", "quality_score", "is_quota", "digest_rank")


@query("daily_digest", f"WITH {sql_digest(2, 12)} SELECT event_id, category, quality AS quality_score, is_quota, digest_rank FROM digest")
def daily_digest(spark, d):
    return _digest(spark, d, 2, 12).select("event_id", "category", "quality_score", "is_quota", "digest_rank")


_spine = " UNION ALL ".join(f"SELECT {i} AS ord, '{c}' AS category, CAST({EVENT_SHARES[c]} AS DOUBLE) AS target_share" for i, c in enumerate(EVENT_ORDER))


@query("digest_by_category", f"WITH {sql_digest(7, 28)}, sp AS ({_spine}) SELECT ord, category, count(event_id) AS count, coalesce(string_agg(CAST(event_id AS VARCHAR), ';' ORDER BY digest_rank), '') AS events FROM sp LEFT JOIN digest USING (category) GROUP BY ord, category")
def digest_by_category(spark, d):
    return G.by_category(_digest(spark, d, 7, 28), "category", "event_id", EVENT_ORDER)


@query("category_balance", f"WITH sp AS ({_spine}) SELECT ord, category, count(event_id) AS count, round(count(event_id) / greatest(1, (SELECT count(*) FROM events)), 6) AS actual_share, target_share FROM sp LEFT JOIN events ON event_type = category GROUP BY ALL")
def category_balance(spark, d):
    return G.category_balance(table(spark, d, "events"), "event_type", EVENT_ORDER, EVENT_SHARES)


_in = f"category IN {in_list(rules.IMPLEMENTATION_CATEGORIES)}"
SQL_METRICS = f"""sg AS (SELECT *, regexp_matches(title || ' ' || summary, {q(T.QUANTITY)}) AS numeric FROM curated WHERE relevance_status = 'include'),
src AS (SELECT publisher, count(*) AS n FROM sg GROUP BY publisher),
metrics AS (SELECT count(*) AS records, count(*) FILTER (WHERE {_in}) AS implementation, count(*) FILTER (WHERE category = '政策与标准') AS policy, count(*) FILTER (WHERE numeric) AS numeric, 0 AS linked,
  (SELECT count(*) FROM src) AS sources, 0 AS related, round((SELECT max(n) FROM src) / count(*), 6) AS top_source_share, round(count(*) FILTER (WHERE {_in}) / count(*), 6) AS implementation_share,
  round(count(*) FILTER (WHERE category = '政策与标准') / count(*), 6) AS policy_share FROM sg)"""


def _kept(spark, d):
    # Curated once: every digest table reads the same checkpoint.
    return cut(S.curate(doc_records(spark, d), CORPUS)).filter(F.col("relevance_status") == "include")


@query("digest_metrics", f"WITH {SQL_CURATED}, {SQL_METRICS} SELECT * FROM metrics")
def digest_metrics(spark, d):
    return G.digest_metrics(_kept(spark, d))


_rules_sql = []
for _i, (_theme, _chance, _task) in enumerate(G.THEME_ADVICE):
    for _kind, _text in (("opportunity", _chance), ("data_task", _task)):
        if _text:
            _rules_sql.append(f"SELECT '{_kind}' AS kind, {_i} AS ord, {q(_text)} AS text FROM metrics WHERE EXISTS (SELECT 1 FROM sg WHERE {any_of('text', THEMES[_theme])})")
_rules_sql += [
    f"SELECT 'constraint', 0, {q(G.CONCENTRATED)} FROM metrics WHERE top_source_share > 0.40", f"SELECT 'constraint', 1, {q(G.POLICY_HEAVY)} FROM metrics WHERE policy_share > 0.35",
    f"SELECT 'constraint', 2, {q(G.UNLINKED)} FROM metrics WHERE numeric > 0 AND linked = 0", f"SELECT 'constraint', 4, {q(G.ALWAYS)} FROM metrics",
]


@query("digest_rules", f"WITH {SQL_CURATED}, {SQL_METRICS} " + " UNION ALL ".join(_rules_sql))
def digest_rules(spark, d):
    kept = _kept(spark, d)
    return G.digest_rules(G.digest_metrics(kept), G.theme_counts(kept, F.col("summary"), THEMES))
