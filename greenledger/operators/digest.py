"""Digests: window, quotas, metrics, themes and count-driven rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from greenledger import rules
from greenledger.functions import text as T
from greenledger.functions.scoring import any_term, with_columns_present

# Editorial texts by theme, and the constraint texts.
THEME_ADVICE = [
    ("计量与能碳管理", "将分级计量、能碳台账和异常监测作为数据底座项目，先解决边界、口径和责任不清的问题。", "补充计量点位清单、表计层级、数据频率、缺失率及与企业清单的对应关系。"),
    ("设备与系统节能", "优先排查空压、蒸汽、泵风机、余热等运行改善项目，先形成基线和可验证节能量。", "收集设备额定参数、负荷率、运行小时、改造前后能耗、停产影响和报价依据。"),
    ("资源循环", "以水量、热量和副产物流向为基础，识别园区公共设施和企业间协同项目。", "建立水、热、固废和副产物的来源—品质—规模—时间匹配表。"),
    ("清洁供能", "清洁供能项目应在负荷、网架、消纳、计量结算和环境属性核清后进入专项论证。", "补充15分钟或小时负荷曲线、可用场地、接入条件、消纳比例、绿证或绿电合同资料。"),
    ("交通与物流", "把充换电、重卡和园区物流纳入场景项目库，明确车辆规模、里程、补能利用率和运营主体。", "补充车辆清单、年行驶里程、燃料或电耗、补能设施利用率及运输组织方案。"),
    ("项目与资金", "将资金政策与项目参数表联动，明确适用对象、申报窗口、投资主体和可计量绩效。", None),
]
NO_OPPORTUNITY = "继续补充园区与设施一手资料，形成可复核的案例和项目参数。"
NO_TASK = "补充园区建设边界、企业清单、基准年能源和排放台账。"
CONCENTRATED = "本期来源集中度偏高，需补充园区管委会、企业、公共设施运营方和地方主管部门的独立材料。"
POLICY_HEAVY = "政策标准记录占比仍偏高；下一轮采集应优先补充项目进度、设施参数和运行结果。"
UNLINKED = "部分记录含有数字，但尚未完成园区对象、统计年度和空间边界核验，不能直接写入园区指标。"
MERGED = "有%s份补充来源被归并到主事件下，报告不再重复列示，但原始链接继续保留。"
ALWAYS = "公开资料用于发现线索和形成核查任务；正式核算仍要求同一边界、同一年度、同一单位和可追溯凭证。"
# End of fixed values.


def day_of(records: DataFrame, date: str, as_of: Column | None = None) -> Column:
    kind = records.schema[date].dataType.typeName()
    found = T.parse_date(F.col(date)) if kind == "string" else F.col(date).cast("date")
    return F.coalesce(found, as_of.cast("date")) if as_of is not None else found


def recent_window(records: DataFrame, date: str, days: int, least: int | None = None, as_of: Column | None = None) -> DataFrame:
    """Rows of the last ``days`` days before the latest date present.

    With ``least``, a window holding fewer rows than that widens to max(4 * days, 30). The bounds
    come from counts per day, as scalar subqueries.
    """
    dated = records.withColumn("_d", day_of(records, date, as_of))
    daily = dated.filter(F.col("_d").isNotNull()).groupBy("_d").agg(F.count("*").alias("n"))
    latest = daily.agg(F.max("_d")).scalar()
    span = F.lit(days)
    if least is not None:
        narrow = daily.filter(F.col("_d") >= F.date_sub(latest, days - 1)).agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
        span = F.when(narrow < least, max(4 * days, 30)).otherwise(days)
    return dated.filter(F.col("_d") >= F.date_sub(latest, span - 1)).drop("_d")


def quotas(limit: int, shares: dict[str, float]) -> dict[str, int]:
    return {c: max(1, round(limit * share)) for c, share in shares.items()}


def balanced_select(records: DataFrame, *, days: int, limit: int, date: str = "published_date", category: str = "category",
                    quality: str = "quality_score", title: str = "title", event: str = "event_key",
                    order: list[str] = rules.DIGEST_ORDER, shares: dict[str, float] = rules.TARGET_SHARE) -> DataFrame:
    """Quota pass per category, then a fill pass by rank, up to ``limit`` distinct events.

    A row without event key counts under its canonical URL, else its record id; one without category under its topic.

    Per-category ranks are cut inside the tasks before the shuffle, and the fill pass needs no
    more than limit + quota rows, so the last ordering runs over a handful of rows.
    """
    windowed = recent_window(with_columns_present(records, (event, category)), date, days, least=min(6, limit))
    first_of = lambda *names: T.first_text(*[F.col(n).cast("string") for n in names if n in windowed.columns], F.lit(""))
    best = [F.col(quality).alias("q"), F.col(date).cast("string").alias("d"), F.col(title).alias("t")]
    ranked = windowed.withColumns({
        "_rank": F.struct(*best), "_event": first_of(event, "canonical_url", "record_id"),
        "_category": F.coalesce(F.nullif(first_of(category, "topic"), F.lit("")), F.lit(rules.CATCH_ALL_CATEGORY)),
    })
    unique = ranked.groupBy("_event").agg(F.max_by(F.struct(*ranked.columns), F.col("_rank")).alias("row")).select("row.*")
    plan = quotas(limit, shares)
    target = F.coalesce(*[F.when(F.col("_category") == c, n) for c, n in plan.items()], F.lit(0))
    spot = F.coalesce(*[F.when(F.col("_category") == c, i) for i, c in enumerate(order)], F.lit(len(order)))
    by_rank = [F.desc("_rank"), F.col(event), F.col("_event")]
    in_category = W.partitionBy("_category").orderBy(*by_rank)
    largest = max(plan.values(), default=0)
    quota = (
        unique.withColumn("_r", F.row_number().over(in_category)).filter(F.col("_r") <= largest)
        .filter(F.col("_r") <= target).withColumns({"_phase": F.lit(0), "_cat": spot}).drop("_r")
    )
    pool = unique.orderBy(*by_rank).limit(limit + sum(plan.values()))
    fill = pool.join(quota.select("_event"), "_event", "left_anti").withColumns({"_phase": F.lit(1), "_cat": F.lit(0)})
    both = quota.unionByName(fill)
    spotted = both.withColumn("_n", F.row_number().over(W.orderBy("_phase", "_cat", *by_rank))).filter(F.col("_n") <= limit)
    place = F.row_number().over(W.orderBy(*by_rank))
    return spotted.withColumns({"digest_rank": place, "is_quota": F.col("_phase") == 0}).drop("_rank", "_event", "_category", "_phase", "_cat", "_n")


def with_signals(records: DataFrame) -> DataFrame:
    """Per-record flags the metrics are built from."""
    r = with_columns_present(records, ("title", "summary", "publisher", "source_name", "category", "topic", "source_level", "why"))
    body = F.concat_ws(" ", T.text_or_empty(F.col("title")), T.text_or_empty(F.col("summary")))
    parks = F.size(F.col("parks")) > 0 if "parks" in r.columns else F.lit(False)
    related = F.coalesce(F.col("duplicate_count"), F.lit(0)) if "duplicate_count" in r.columns else F.lit(0)
    return r.withColumns(
        {
            "_category": T.first_text(F.col("category"), F.col("topic"), F.lit(rules.CATCH_ALL_CATEGORY)),
            "_source": T.first_text(F.col("publisher"), F.col("source_name"), F.lit("未知来源")),
            "_numeric": T.has_quantity(body),
            "_linked": F.coalesce(parks, F.lit(False)),
            "_related": related,
        }
    )


def digest_metrics(records: DataFrame, implementation: list[str] = rules.IMPLEMENTATION_CATEGORIES, policy: str = rules.POLICY_CATEGORY) -> DataFrame:
    """The labelled numbers of a digest on one row; grouped by source first, so no wide distinct."""
    by_source = with_signals(records).groupBy("_source").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("_category").isin(implementation)).alias("impl"),
        F.count_if(F.col("_category") == policy).alias("pol"),
        F.count_if("_numeric").alias("num"),
        F.count_if("_linked").alias("lnk"),
        F.sum("_related").alias("rel"),
    )
    total = F.coalesce(F.sum("n"), F.lit(0))
    whole = F.greatest(F.lit(1), total)
    return by_source.agg(
        total.alias("records"),
        F.coalesce(F.sum("impl"), F.lit(0)).alias("implementation"),
        F.coalesce(F.sum("pol"), F.lit(0)).alias("policy"),
        F.coalesce(F.sum("num"), F.lit(0)).alias("numeric"),
        F.coalesce(F.sum("lnk"), F.lit(0)).alias("linked"),
        F.count("*").alias("sources"),
        F.coalesce(F.sum("rel"), F.lit(0)).cast("long").alias("related"),
        F.round(F.coalesce(F.max("n"), F.lit(0)) / whole, 6).alias("top_source_share"),
        F.round(F.coalesce(F.sum("impl"), F.lit(0)) / whole, 6).alias("implementation_share"),
        F.round(F.coalesce(F.sum("pol"), F.lit(0)) / whole, 6).alias("policy_share"),
    )


def theme_counts(records: DataFrame, text: Column, themes: dict[str, list[str]] = rules.THEME_TERMS) -> DataFrame:
    """Records per theme; a record counts once for each theme it touches."""
    hits = F.array(*[F.when(any_term(F.col("_text"), terms), name) for name, terms in themes.items()])
    named = records.select(text.alias("_text")).select(F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("theme"))
    return named.groupBy("theme").agg(F.count("*").alias("value"))


def category_balance(records: DataFrame, category: str, order: list[str] = rules.DIGEST_ORDER, shares: dict[str, float] = rules.TARGET_SHARE) -> DataFrame:
    """Count, share and target share for every category in the order, empty ones too."""
    counts = records.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("count"))
    total = F.greatest(F.lit(1), F.coalesce(counts.agg(F.sum("count")).scalar(), F.lit(0)))
    spine = records.sparkSession.createDataFrame(
        [(i, c, float(shares.get(c, 0))) for i, c in enumerate(order)], "ord int, category string, target_share double"
    )
    joined = F.broadcast(spine).join(counts, "category", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return joined.select("ord", "category", "count", F.round(F.col("count") / total, 6).alias("actual_share"), "target_share")


def digest_rules(metrics: DataFrame, themes: DataFrame) -> DataFrame:
    """Opportunities, constraints and data tasks that the counts call for, in order.

    ``metrics`` is the one-row frame of ``digest_metrics``; ``themes`` has one row per theme.
    """
    seen = themes.agg(F.collect_set("theme").alias("themes"))
    row = metrics.withColumn("themes", F.coalesce(seen.scalar(), F.array().cast("array<string>")))
    has = lambda theme: F.array_contains("themes", theme)
    item = lambda kind, spot, text: F.struct(F.lit(kind).alias("kind"), F.lit(spot).alias("ord"), (text if isinstance(text, Column) else F.lit(text)).alias("text"))
    found = []
    for i, (theme, chance, task) in enumerate(THEME_ADVICE):
        found.append(F.when(has(theme), item("opportunity", i, chance)))
        if task:
            found.append(F.when(has(theme), item("data_task", i, task)))
    any_chance = F.arrays_overlap("themes", F.array(*[F.lit(t) for t, _, _ in THEME_ADVICE]))
    any_task = F.arrays_overlap("themes", F.array(*[F.lit(t) for t, _, task in THEME_ADVICE if task]))
    found += [
        F.when(~any_chance, item("opportunity", 0, NO_OPPORTUNITY)),
        F.when(~any_task, item("data_task", 0, NO_TASK)),
        F.when(F.col("top_source_share") > 0.40, item("constraint", 0, CONCENTRATED)),
        F.when(F.col("policy_share") > 0.35, item("constraint", 1, POLICY_HEAVY)),
        F.when((F.col("numeric") > 0) & (F.col("linked") == 0), item("constraint", 2, UNLINKED)),
        F.when(F.col("related") > 0, item("constraint", 3, F.format_string(MERGED, F.col("related")))),
        item("constraint", 4, ALWAYS),
    ]
    return row.select(F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("r")).select("r.*")


def by_category(selected: DataFrame, category: str, event: str, order: list[str] = rules.DIGEST_ORDER) -> DataFrame:
    """Selected events per category, all categories present. A digest is short, so its lists are too."""
    lists = selected.groupBy(F.col(category).alias("category")).agg(
        F.count("*").alias("count"), F.sort_array(F.collect_list(F.struct("digest_rank", F.col(event).cast("string").alias("e")))).alias("l")
    )
    spine = selected.sparkSession.createDataFrame([(i, c) for i, c in enumerate(order)], "ord int, category string")
    joined = F.broadcast(spine).join(lists, "category", "left")
    return joined.select("ord", "category", F.coalesce("count", F.lit(0)).alias("count"),
                         F.coalesce(F.array_join(F.transform("l", lambda x: x["e"]), ";"), F.lit("")).alias("events"))
