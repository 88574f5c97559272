"""Counts, trends, search rows, map rows and park cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from greenledger import rules
from greenledger.functions import geo, text as T
from greenledger.functions.scoring import with_columns_present

PARK_TEXTS = (
    "park_id", "region_scope", "list_level", "level", "country", "province", "city", "park_name", "latitude", "longitude",
    "boundary_type", "construction_period", "industry_group", "industry_classification_note", "source_title", "source_url",
    "source_date", "public_data_status", "public_facts_note", "public_data_note", "notes", "recommended_focus",
    "suggested_path", "coordinate_precision", "coordinate_status", "coordinate_source", "coordinate_review_date",
)
# Texts shown where a park row has none.
FOCUS_DEFAULT = "优先核对边界、企业清单、能源平衡和基准年排放。"
PRECISION_DEFAULT, REVIEW_DEFAULT, ORIGIN_DEFAULT = "园区或所在片区近似中心", "待复核", "公开位置整理"
CAVEAT_DEFAULT = "仅作公开资料线索，正式使用前核对统计边界。"
# End of fixed values.


def park_projection(raw: DataFrame) -> DataFrame:
    """The 24 public columns of a park row with their defaults."""
    raw = with_columns_present(raw, PARK_TEXTS)
    plain = lambda name: T.text_or_empty(F.col(name))
    given = lambda name, default: F.coalesce(F.col(name).cast("string"), F.lit(default))
    return raw.select(
        plain("park_id").alias("park_id"),
        T.first_text(F.col("region_scope"), F.lit(rules.DOMESTIC)).alias("scope"),
        *[plain(c).alias(c) for c in ("list_level", "level", "country", "province", "city")],
        plain("park_name").alias("name"),
        T.lenient_double(F.col("latitude"), 0.0).alias("lat"),
        T.lenient_double(F.col("longitude"), 0.0).alias("lon"),
        plain("boundary_type").alias("boundary_type"),
        plain("construction_period").alias("period"),
        plain("industry_group").alias("industry"),
        plain("industry_classification_note").alias("classification_note"),
        *[plain(c).alias(c) for c in ("source_title", "source_url", "source_date")],
        plain("public_data_status").alias("status"),
        T.first_text(F.col("public_facts_note"), F.col("public_data_note"), F.col("notes")).alias("note"),
        T.first_text(F.col("recommended_focus"), F.col("suggested_path"), F.lit(FOCUS_DEFAULT)).alias("focus"),
        given("coordinate_precision", PRECISION_DEFAULT).alias("coordinate_precision"),
        given("coordinate_status", REVIEW_DEFAULT).alias("coordinate_status"),
        given("coordinate_source", ORIGIN_DEFAULT).alias("coordinate_source"),
        plain("coordinate_review_date").alias("coordinate_review_date"),
    )


def counts_by(df: DataFrame, columns: dict[str, Column], limits: dict[str, int] | None = None) -> DataFrame:
    """Counts per label for several label columns at once: (kind, name, value, rank).

    One pass and one shuffle over all kinds; the cut per kind runs on the counts.
    """
    names = list(columns)
    labelled = df.select(*[c.alias(n) for n, c in columns.items()])
    counted = labelled.groupingSets([[n] for n in names], *names).agg(
        F.count("*").alias("value"), *[F.grouping(n).alias(f"_g_{n}") for n in names]
    )
    kind = F.coalesce(*[F.when(F.col(f"_g_{n}") == 0, n) for n in names])
    label = F.coalesce(*[F.when(F.col(f"_g_{n}") == 0, F.col(n)) for n in names])
    rows = counted.select(kind.alias("kind"), label.alias("name"), "value")
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("value"), "name")))
    if not limits:
        return ranked
    if set(limits) >= set(names):  # a common bound lets tasks drop the rest before the shuffle
        ranked = ranked.filter(F.col("rank") <= max(limits.values()))
    cut = F.coalesce(*[F.when(F.col("kind") == n, k) for n, k in limits.items()], F.lit(2**31 - 1))
    return ranked.filter(F.col("rank") <= cut)


def park_profile(parks: DataFrame) -> DataFrame:
    """Domestic parks by province, industry, level and boundary, and the domestic/international split."""
    domestic = parks.filter(F.col("scope") == rules.DOMESTIC)
    labels = {
        "province": T.first_text(F.col("province"), F.lit("未标注")),
        "industry": T.first_text(F.col("industry"), F.lit("未分类")),
        "level": T.first_text(F.col("level"), F.lit("未标注")),
        "boundary": T.first_text(F.col("boundary_type"), F.lit("待核实")),
    }
    tops = counts_by(domestic, labels, {"province": 20, "industry": 12, "level": 10, "boundary": 10})
    side = F.when(F.col("scope") == rules.DOMESTIC, "domestic_count").otherwise("international_count")
    split = parks.groupBy(side.alias("name")).agg(F.count("*").alias("value"))
    return tops.unionByName(split.select(F.lit("scope").alias("kind"), "name", "value", F.lit(1).alias("rank")))


def corpus_counts(records: DataFrame, top: int | None = 12) -> DataFrame:
    records = with_columns_present(records, ("topic", "publisher", "source_name", "region"))
    labels = {
        "topics": T.first_text(F.col("topic"), F.lit("未分类")),
        "sources": T.first_text(F.col("publisher"), F.col("source_name"), F.lit("未知来源")),
        "regions": T.first_text(F.col("region"), F.lit("未标注")),
    }
    return counts_by(records, labels, {k: top for k in labels} if top else None)


def category_board(records: DataFrame, category: str, order: list[str] = rules.BOARD_ORDER) -> DataFrame:
    """Category counts in the fixed board order without empty ones; unknown categories come after."""
    counts = records.groupBy(F.coalesce(F.col(category), F.lit(rules.CATCH_ALL_CATEGORY)).alias("name")).agg(F.count("*").alias("value"))
    spot = F.coalesce(*[F.when(F.col("name") == c, i) for i, c in enumerate(order)], F.lit(len(order)))
    return counts.withColumn("ord", spot)


def monthly_counts(records: DataFrame, date: str) -> DataFrame:
    month = F.date_format(F.col(date), "yyyy-MM")
    return records.filter(F.col(date).isNotNull()).groupBy(month.alias("name")).agg(F.count("*").alias("value")).orderBy("name")


def cumulative_days(records: DataFrame, date: str, days: int = 90) -> DataFrame:
    """Running total over the latest distinct days present, starting at zero inside that slice."""
    daily = records.filter(F.col(date).isNotNull()).groupBy(F.to_date(date).alias("date")).agg(F.count("*").alias("n"))
    latest = daily.orderBy(F.desc("date")).limit(days)
    # At most ``days`` rows are left here, so one ordered window over them is small.
    return latest.select("date", F.sum("n").over(W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)).alias("value"))


def bar_share(rows: DataFrame, chart: str, value: str, limit: int = 12, name: str = "name") -> DataFrame:
    """Share of the largest value among the rows shown."""
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy(chart).orderBy(F.desc(value), name))).filter(F.col("_r") <= limit)
    top = F.greatest(F.lit(1), F.max(value).over(W.partitionBy(chart)))
    return ranked.withColumn("share_pct", F.round(F.col(value) / top * 100, 1)).drop("_r")


def count_block(tables: dict[str, DataFrame]) -> DataFrame:
    """One labelled count per table."""
    parts = [df.agg(F.count("*").alias("value")).select(F.lit(name).alias("name"), "value") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def data_funnel(parks: DataFrame, records: DataFrame, evidence: DataFrame, facts: DataFrame, gates: DataFrame) -> DataFrame:
    """Five stage counts; ``gates`` has a boolean ``ready``."""
    stages = [parks, records, evidence, facts, gates.filter("ready")]
    named = {name: df for (name, _), df in zip(rules.FUNNEL, stages)}
    meaning = F.create_map(*[F.lit(x) for pair in rules.FUNNEL for x in pair])
    spot = F.create_map(*[F.lit(x) for i, (n, _) in enumerate(rules.FUNNEL) for x in (n, i)])
    return count_block(named).select(spot[F.col("name")].alias("ord"), "name", "value", meaning[F.col("name")].alias("meaning"))


def evidence_rows(evidence: DataFrame) -> DataFrame:
    """Evidence by park in long form; rows without a park are left out."""
    names = ("park_id", "关联park_id", "statement", "公开事实", "fact", "source_name", "来源", "source_url", "url",
             "source_date", "date", "caveat", "限制说明", "verification_note")
    e = with_columns_present(evidence, names)
    c = F.col
    rows = e.select(
        T.first_text(c("park_id"), c("关联park_id")).alias("park_id"),
        T.first_text(c("statement"), c("公开事实"), c("fact")).alias("statement"),
        T.first_text(c("source_name"), c("来源")).alias("source"),
        T.first_text(c("source_url"), c("url")).alias("url"),
        T.first_text(c("source_date"), c("date")).alias("date"),
        T.first_text(c("caveat"), c("限制说明"), c("verification_note"), F.lit(CAVEAT_DEFAULT)).alias("caveat"),
    )
    return rows.filter(c("park_id") != "")


def evidence_by_park(evidence: DataFrame) -> DataFrame:
    """Count and date span per park. The rows themselves stay long: one park may own a third of them."""
    return evidence_rows(evidence).groupBy("park_id").agg(
        F.count("*").alias("evidence_count"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


def peer_topk(parks: DataFrame, k: int = 5) -> DataFrame:
    """The k structurally closest domestic parks of each domestic park.

    Points are added for equal attributes, so a peer among the best k is among the first k+1
    names of the group that shares the attributes it matches on. Groups are formed for each set
    of attributes, cut to k+1 names, and scored: no pair of parks is made beyond that.
    """
    attrs = [a for a, _, _ in rules.PEER_POINTS]
    year = F.substring(T.text_or_empty(F.col("period")), 1, 4)
    domestic = parks.filter(F.col("scope") == rules.DOMESTIC).withColumn("period_year", year)
    slim = domestic.select("park_id", "name", *[T.blank_to_null(F.col(a)).alias(a) for a in attrs])
    by_name = F.struct("name", "park_id")
    own = W.partitionBy(*attrs).orderBy(by_name)
    # Parks alike in all attributes share their candidates: keep the first k+1 names of each profile.
    profiles = slim.withColumn("_r", F.row_number().over(own)).filter(F.col("_r") <= k + 1).drop("_r")
    masks = range(1 << len(attrs))
    sets = [
        F.struct(F.lit(m).alias("mask"), *[(F.col(a) if m >> i & 1 else F.lit(None).cast("string")).alias("k_" + a) for i, a in enumerate(attrs)])
        for m in masks
    ]
    keyed = profiles.withColumn("_set", F.explode(F.array(*sets))).select("*", "_set.*").drop("_set")
    for i, a in enumerate(attrs):
        keyed = keyed.filter((F.col("mask").bitwiseAND(1 << i) == 0) | F.col(a).isNotNull())
    keys = ["mask", *["k_" + a for a in attrs]]
    firsts = keyed.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(by_name))).filter(F.col("_r") <= k + 1)
    shown = firsts.select(*keys, F.struct("name", "park_id", *attrs).alias("peer"))
    wanted = keyed.select(*keys, *attrs).distinct()
    same_key = [wanted[c].eqNullSafe(shown[c]) for c in keys]
    test = same_key[0]
    for t in same_key[1:]:
        test = test & t
    candidates = wanted.join(shown, test).select(*[wanted[a].alias(a) for a in attrs], "peer").distinct()
    points = [F.when(F.col(a) == F.col("peer")[a], p).otherwise(0) for a, p, _ in rules.PEER_POINTS]
    reasons = F.filter(F.array(*[F.when(F.col(a) == F.col("peer")[a], r) for a, _, r in rules.PEER_POINTS]), lambda x: x.isNotNull())
    scored = candidates.withColumns({"score": sum(points[1:], points[0]), "reasons": F.array_join(reasons, "、")})
    best = W.partitionBy(*attrs).orderBy(F.desc("score"), F.col("peer")["name"], F.col("peer")["park_id"])
    cut = scored.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k + 1)
    listed = cut.groupBy(*attrs).agg(F.sort_array(F.collect_list(F.struct("_r", "peer", "score", "reasons"))).alias("peers"))
    joined = slim.alias("p").join(listed.alias("l"), [F.col("p." + a).eqNullSafe(F.col("l." + a)) for a in attrs])
    others = F.slice(F.filter(F.col("peers"), lambda x: x["peer"]["park_id"] != F.col("p.park_id")), 1, k)
    flat = joined.select(F.col("p.park_id").alias("park_id"), F.posexplode(others).alias("pos", "peer"))
    return flat.select(
        "park_id", (F.col("pos") + 1).alias("rank"), F.col("peer.peer.park_id").alias("peer_id"),
        F.col("peer.peer.name").alias("peer_name"), F.col("peer.score").alias("score"),
        T.first_text(F.col("peer.reasons"), F.lit("基础属性接近")).alias("reasons"),
    )


def park_card(parks: DataFrame, evidence: DataFrame, k: int = 5) -> DataFrame:
    """Attributes, evidence count and closest peers on one row per park."""
    peers = peer_topk(parks, k).groupBy("park_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "peer_id"))), lambda x: x["peer_id"]), ";").alias("peers")
    )
    counts = evidence_by_park(evidence)
    cards = parks.join(counts, "park_id", "left").join(peers, "park_id", "left")
    region = F.array_join(F.filter(F.array("province", "city"), lambda x: x != ""), " ")
    return cards.select(
        "park_id", "name", region.alias("region"), T.first_text(F.col("boundary_type"), F.lit("待核实")).alias("boundary"),
        T.first_text(F.col("period"), F.lit("待核实")).alias("period"), T.first_text(F.col("industry"), F.lit("待确认")).alias("industry"),
        F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"), F.coalesce("last_date", F.lit("")).alias("last_evidence"),
        F.coalesce("peers", F.lit("")).alias("peers"),
    )


def search_rows(parks: DataFrame | None = None, records: DataFrame | None = None, standards: DataFrame | None = None, measures: DataFrame | None = None) -> DataFrame:
    """Parks, updates, rules and measures as one search table of seven columns."""
    out = []
    c, lit = F.col, F.lit
    if parks is not None:
        place = F.array_join(F.filter(F.array("province", "city"), lambda x: x != ""), "/")
        about = F.concat_ws("；", "list_level", "industry", "boundary_type", "period")
        out.append(parks.select(lit("园区").alias("type"), place.alias("date"), c("name").alias("title"), about.alias("description"),
                                T.first_text(c("note"), lit("公开名录资料")).alias("limit"), c("source_url").alias("url"),
                                T.first_text(c("source_title"), lit("园区名录")).alias("source")))
    if records is not None:
        r = with_columns_present(records, ("published_date", "title", "summary", "why", "url", "publisher", "source_name"))
        out.append(r.select(lit("动态").alias("type"), T.first_text(c("published_date"), lit("—")).alias("date"), "title", c("summary").alias("description"),
                            T.first_text(c("why"), lit("正式判断前核对原文")).alias("limit"), "url", T.first_text(c("publisher"), c("source_name")).alias("source")))
    if standards is not None:
        out.append(standards.select(lit("标准").alias("type"), T.first_text(c("category"), lit("政策标准")).alias("date"), T.first_text(c("item"), c("rule_id")).alias("title"),
                                    c("rule").alias("description"), T.first_text(c("nature"), lit("按适用范围使用")).alias("limit"), c("source_url").alias("url"), "source"))
    if measures is not None:
        about = F.concat(c("direction"), lit("；适用："), c("park"), lit("；对象："), c("object"))
        out.append(measures.select(lit("措施").alias("type"), c("type").alias("date"), c("name").alias("title"), about.alias("description"),
                                   F.concat_ws("；", "constraints", "status").alias("limit"), lit("data/technology_guidance.csv").alias("url"), lit("减排设施指南").alias("source")))
    table = out[0]
    for part in out[1:]:
        table = table.unionByName(part)
    return table


def search(table: DataFrame, query: str = "", kind: str | None = None) -> DataFrame:
    """Facet and substring search over five fields, case ignored."""
    found = table if kind in (None, "全部") else table.filter(F.col("type") == kind)
    needle = query.strip().lower()
    if not needle:
        return found
    text = F.lower(F.concat_ws(" ", *[T.text_or_empty(F.col(n)) for n in ("title", "description", "limit", "date", "source")]))
    return found.filter(F.contains(text, F.lit(needle)))


def page(table: DataFrame, order: list[Column], size: int, number: int = 1) -> DataFrame:
    """One page of an ordered table; only the rows up to that page are ranked."""
    return table.orderBy(*order).offset(size * (number - 1)).limit(size)


def facet_values(records: DataFrame, order: list[str] = rules.BOARD_ORDER, columns: tuple[str, ...] = ("category", "topic")) -> DataFrame:
    """The choices of the feed's category filter: all, then the categories present in board order, then the others by name."""
    rows = with_columns_present(records, columns)
    present = rows.select(T.first_text(*[F.col(c) for c in columns], F.lit(rules.CATCH_ALL_CATEGORY)).alias("name")).distinct()
    spot = F.coalesce(*[F.when(F.col("name") == c, i + 1) for i, c in enumerate(order)], F.lit(len(order) + 1))
    every = records.sparkSession.createDataFrame([(0, rules.ALL_FACET)], "ord int, name string")
    return every.unionByName(present.select(spot.cast("int").alias("ord"), "name")).orderBy("ord", "name")


def feed_rows(records: DataFrame, category: str | None = None, columns: tuple[str, ...] = ("category", "topic")) -> DataFrame:
    """The feed under a category choice; none, or the choice of all, shows every row."""
    if category in (None, rules.ALL_FACET):
        return records
    rows = with_columns_present(records, columns)
    return rows.filter(T.first_text(*[F.col(c) for c in columns], F.lit(rules.CATCH_ALL_CATEGORY)) == category).select(*records.columns)


def search_page(found: DataFrame, number: int = 1, size: int = 25, kinds: tuple[str, ...] = ("园区", "动态", "标准", "措施")) -> DataFrame:
    """One page of search results: parks, updates, rules, measures, each by title and address."""
    spot = F.coalesce(*[F.when(F.col("type") == k, i) for i, k in enumerate(kinds)], F.lit(len(kinds)))
    return page(found, [spot, F.col("title"), F.col("url"), F.col("date")], size, number)


def headline(counts: DataFrame, curation: DataFrame | None = None) -> DataFrame:
    """The headline numbers and the quality strip from the count block (name, value); a number that is missing or 0 falls back to the curation statistics,
    where one is named, and else is 0."""
    spark = counts.sparkSession
    plan = spark.createDataFrame([(block, i, *row) for block, rows in rules.HEADLINES.items() for i, row in enumerate(rows)], "block string, ord int, label string, name string, other string")
    held = counts.groupBy("name").agg(F.max("value").alias("value"))
    rows = F.broadcast(plan).join(held, "name", "left")
    if curation is not None:
        spare = curation.groupBy(F.col("name").alias("other")).agg(F.max("value").alias("spare"))
        rows = rows.join(spare, "other", "left")
    else:
        rows = rows.withColumn("spare", F.lit(None).cast("long"))
    return rows.select("block", "ord", "label", F.coalesce(F.nullif("value", F.lit(0)), F.nullif("spare", F.lit(0)), F.lit(0)).cast("long").alias("value")).orderBy("block", "ord")


def map_rows(parks: DataFrame, view: str, query: str = "") -> DataFrame:
    """Parks of a map view with marker class and board position."""
    domestic = F.col("scope") == rules.DOMESTIC
    inside = {
        "全国": domestic,
        "国家级": domestic & (F.col("level") == "国家级"),
        "广东": domestic & F.contains(F.col("province"), F.lit("广东")),
    }.get(view, ~domestic)  # any other view shows what is not domestic
    rows = parks.filter(inside)
    needle = query.strip().lower()
    if needle:
        rows = rows.filter(F.contains(F.lower(F.concat_ws(" ", "name", "province", "city", "country", "industry")), F.lit(needle)))
    boxes = {v[0]: v for v in rules.MAP_VIEWS}
    box = boxes.get(view, boxes["全国"])  # an unknown view has the national box
    west, east, south, north = [F.lit(v) for v in box[1:]]
    x, y = geo.view_xy(F.col("lon"), F.col("lat"), west, east, south, north)
    marker = F.when(~domestic, "international").when(F.col("level") == "国家级", "national").otherwise("provincial")
    placed = rows.withColumns({"marker": marker, "x": x, "y": y})
    return placed.withColumn("on_board", F.col("x").between(0, 1000) & F.col("y").between(0, 600))
