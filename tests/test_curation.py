import random

from pyspark.sql import functions as F

from greenledger import rules
from greenledger.functions import scoring as S, text as T
from greenledger.operators import archive as A, dedup as D, digest as G

COLUMNS = "title string, summary string, publisher string, published_date string, url string"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_url_and_date_forms(spark):
    assert one(spark, T.canonical_url(F.lit("http://EXAMPLE.com/a/?utm_source=x#top"))) == "https://example.com/a"
    assert one(spark, T.canonical_url(F.lit("//A.b//c//?x=1&FROM=2&y&z=a%20b~*"))) == "https://a.b/c?x=1&y=&z=a+b~%2A"
    assert one(spark, T.canonical_url(F.lit(" "))) == ""
    assert str(one(spark, T.parse_date(F.lit("发布日期：2026年8月17日")))) == "2026-08-17"
    assert str(one(spark, T.parse_date(F.lit("t20260807_48.html")))) == "2026-08-07"
    assert one(spark, T.parse_date(F.lit("2026年2月31日"))) is None
    assert str(one(spark, T.parse_date(F.lit(None), F.lit("2026-01-02")))) == "2026-01-02"


def test_casts_and_cleaning(spark):
    assert one(spark, T.lenient_double(F.lit(" 1,234.5 "))) == 1234.5
    assert one(spark, T.lenient_double(F.lit("接近70"))) is None
    assert one(spark, T.lenient_int(F.lit("12.9"))) == 12
    assert one(spark, T.is_true(F.lit(" 已确认 "))) is True
    assert one(spark, T.clean_text(F.lit("acitex1　 b​"))) == "a b"
    assert one(spark, T.clean_title(F.lit("2026-08-01 一图读懂｜零碳园区 —"))) == "零碳园区"
    assert one(spark, T.normal_title(F.lit("零碳园区（试行）：通知!"))) == "零碳园区通知"
    assert one(spark, T.document_number(F.lit("见"), F.lit("发改环资〔2025〕910号"))) == "发改环资〔2025〕910号"


def spelled_out(c):
    """Clean text, title and normal title as the plain classes give them, one step at a time."""
    space = lambda x: F.trim(F.regexp_replace(x, T.BLANK + "+", " "))
    text = space(F.regexp_replace(F.regexp_replace(c, T.CITATION, ""), T.INVISIBLE, ""))
    title = space(F.btrim(F.regexp_replace(F.regexp_replace(text, T.DATE_PREFIX, ""), T.DECORATION, ""), F.lit(rules.TITLE_EDGE_CHARS)))
    bare = F.lower(title)
    for token in rules.TITLE_TOKENS:
        bare = F.replace(bare, F.lit(token), F.lit(""))
    return text, title, F.regexp_replace(bare, T.PUNCTUATION, "")


def test_short_classes_hold_the_same_characters(spark):
    chars = spark.range(1, 0x110000).filter("id < 55296 OR id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    for plain, short in ((T.BLANK, T.ANY_BLANK), (T.PUNCTUATION, T.ANY_PUNCTUATION)):
        assert chars.filter(F.col("c").rlike(plain) != F.col("c").rlike(short)).isEmpty()


def test_normal_titles_equal_the_plain_steps_in_fewer_passes(spark):
    pieces = ["", " ", "  ", "\t", "\u3000", "\u2028\x85", "\u200b", "\ufeff", "\ue200cite\ue202x\ue201", "\ue200ci\u200bte\ue202x\ue201", "2026-08-01", "2026年8月1日 ", "20", "图解", "视频｜", "—", "·", "(试行)", "Ab.C", "ÉΣ", "İ,", "园区", "。", "\U0001f600"]
    draw = random.Random(7)
    texts = ["".join(draw.choices(pieces, k=draw.randint(0, 9))) for _ in range(4000)]
    rows = spark.createDataFrame([(x,) for x in texts], "c string")
    c = F.col("c")
    made = zip(spelled_out(c), (T.clean_text(c), T.clean_title(c), T.normal_title(c)))
    assert [rows.filter(~plain.eqNullSafe(got)).count() for plain, got in made] == [0, 0, 0]
    assert rows.select(T.normal_title(c).alias("t"))._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 4


def test_numbers_are_sought_where_their_last_character_stands(spark):
    pieces = ["", " ", "\u3000", "发改环资", "〔", "[", "2025", " 2025 ", "〕", "]", "910", "号", "\u200b", "号 号", "abc"]
    draw = random.Random(3)
    texts = [None] + ["".join(draw.choices(pieces, k=draw.randint(0, 8))) for _ in range(3000)] + ["发改环资〔\u200b2025〕 910 号", "发改\ue200cite\ue202号\ue201〔2025〕9"]
    rows = spark.createDataFrame([(x,) for x in texts], "c string")
    plain = F.regexp_replace(F.regexp_extract(spelled_out(F.coalesce("c", F.lit("")))[0], T.DOCUMENT_NUMBER, 0), T.PUNCTUATION, "")
    got = rows.select(plain.alias("plain"), T.document_number(F.col("c"), F.lit("")).alias("got"))
    assert got.filter("NOT plain <=> got").isEmpty() and not got.filter("got <> ''").isEmpty()
    assert ", 号)" in got.select("got")._jdf.queryExecution().optimizedPlan().toString()


def test_unrelated_policy_is_excluded(spark):
    rows = [("北京经开区发布智能经济与脑机接口创新政策", "支持科技企业和创新创业活动。", "北京经济技术开发区", "2026-08-01", "https://example.com/1"),
            ("关于推进园区余热回收与蒸汽系统节能改造的通知", "部署余热、凝结水和蒸汽管网改造项目。", "某经济技术开发区", "2026-08-01", "https://example.com/2")]
    got = S.curate(spark.createDataFrame(rows, COLUMNS)).orderBy("url").collect()
    assert got[0]["relevance_status"] == "exclude"
    assert (got[1]["category"], got[1]["relevance_status"]) == ("技术与设施", "include")


def test_published_scores(spark):
    title = "北京经济技术开发区管理委员会印发《北京经济技术开发区关于支持词元驱动智能经济高质量发展的若干措施（试行）》的通知"
    summary = "公开来源发布了“" + title + "”相关信息。"
    got = S.curate(spark.createDataFrame([(title, summary, "北京经济技术开发区", "2026-08-05", "u")], COLUMNS)).first()
    assert got["relevance_score"] == -13
    teda = ("天津经开区开展零碳园区专项资金申报培训", "天津经开区围绕中央预算内投资、超长期特别国债、绿色低息专项贷款和节能降碳专项资金开展培训，近40家企业参加。该信息可用于识别项目储备、资金来源和申报材料要求，不直接替代项目可研或资金承诺。", "天津经济技术开发区", "2026-08-17", "https://www.teda.gov.cn/contents/13/113463.html")
    got = S.curate(spark.createDataFrame([teda], COLUMNS).withColumn("source_scope", F.lit("园区"))).first()
    assert (got["relevance_score"], got["quality_score"], got["category"], got["source_level"], got["event_key"]) == (22, 28, "项目与投融资", "园区", "EVT-b421b74721b71971")


def test_same_event_is_collapsed(spark):
    rows = [("广东推动绿电直连发展有关事项的通知", "园区绿电直连政策。", "广东省发展改革委", "2026-07-01", "https://a.example/x"),
            ("广东省发展改革委关于推动绿电直连发展有关事项的通知", "园区绿电直连政策解读。", "广东省能源局", "2026-07-01", "https://b.example/y")]
    curated = S.curate(spark.createDataFrame(rows, COLUMNS))
    primaries, related = D.collapse(curated, 0.72)
    assert [r["duplicate_count"] for r in primaries.collect()] == [1]
    assert related.count() == 1


def test_merge_versions_and_is_idempotent(spark):
    old = spark.createDataFrame([("http://example.com/a/?utm_source=x", "旧标题", "旧摘要", "old", "2026-08-01", "2026-08-01T00:00:00+00:00")], "url string, title string, summary string, content_hash string, published_date string, first_seen string")
    new = spark.createDataFrame([("https://EXAMPLE.com/a#top", "新标题", "新摘要", "new", "2026-08-02")], "url string, title string, summary string, content_hash string, published_date string")
    merged = A.merge(old, new, F.lit("2026-08-03"))
    row = merged.first()
    assert (row["canonical_url"], row["version_count"], row["previous_content_hash"], row["title"]) == ("https://example.com/a", 2, "old", "新标题")
    assert A.merge_stats(old, new, F.lit("2026-08-03")).first()["updated"] == 1
    again = A.merge(merged, new, F.lit("2026-08-04")).first()
    assert (again["version_count"], again["previous_content_hash"], again["last_seen"]) == (2, "old", "2026-08-04")


def test_archive_limit(spark):
    new = spark.createDataFrame([(f"https://example.com/{i}", str(i), "x", f"2026-08-{i + 1:02d}") for i in range(4)], "url string, title string, summary string, published_date string")
    got = A.merge(new.limit(0), new, F.lit("2026-09-01"), max_records=3).orderBy(F.desc("published_date")).collect()
    assert [r["published_date"] for r in got] == ["2026-08-04", "2026-08-03", "2026-08-02"]


def test_merge_orders_numeric_arrivals_and_keeps_stored_rows_unhashed(spark):
    stored = spark.createDataFrame([("https://x.example/a", "h0", 2), ("https://x.example/b", None, 3)], "url string, content_hash string, version_count int")
    came = spark.createDataFrame([("https://x.example/a", "A", 2), ("https://x.example/a", "B", 9), ("https://x.example/a", "A", 10), ("https://x.example/b", "h", None)], "url string, content_hash string, n int")
    for kind in ("int", "double"):
        got = {r["canonical_url"][-1]: r for r in A.merge(stored.withColumn("n", F.lit(0).cast(kind)), came.withColumn("n", F.col("n").cast(kind)), F.lit("2026-01-01"), "n").collect()}
        assert (got["a"]["version_count"], got["a"]["previous_content_hash"], got["a"]["content_hash"]) == (5, "B", "A")
        assert (got["b"]["version_count"], got["b"]["previous_content_hash"]) == (4, None)


def test_single_arrivals_are_settled_in_one_grouping(spark):
    """The same rows as from the log of everything, with and without URLs that arrive several times, and one shuffle where none does."""
    schema = "url string, title string, content_hash string, publisher string, first_seen string, last_seen string, version_count int, previous_content_hash string, n int"
    draw = random.Random(5)
    row = lambda i, n: (f"https://x.example/{i}", *[draw.choice(v) for v in (["a", None], ["h", "g", None, ""], ["p", "q", None], ["2020", "2021", None], ["2022", None], [None, 1, 4], [None, "z", ""])], n)
    stored = spark.createDataFrame([row(i, 0) for i in range(40)], schema)
    for urls, crowded in ((range(20, 60), False), ([20, 21, 21, 21, 50, 50, *range(22, 45)], True)):
        came = spark.createDataFrame([row(i, n) for n, i in enumerate(urls)], schema)
        sides = A.keyed(stored, hashed=False), A.keyed(came)
        assert (A._crowded(*sides) is not None) == crowded
        for dated in (False, True):
            got, whole = A._merged(*sides, F.lit("2024"), "n", dated), A._fold(A._merge_log(*sides, F.lit("2024"), "n", dated))
            assert got.dtypes == whole.dtypes and sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
        log = A.merge_log(stored, came, F.lit("2024"), "n")
        acts = log.agg(*[F.count_if(F.col("action") == a) for a in ("added", "updated", "unchanged")], F.count_if(F.col("action").isin("kept", "added"))).first()
        assert tuple(A.merge_stats(stored, came, F.lit("2024"), "n").first()) == tuple(acts)
        if not crowded:
            assert A.merge(stored, came, F.lit("2024"), "n")._jdf.queryExecution().sparkPlan().toString().count("Aggregate(") <= 2


def test_seeds_keep_their_own_dates(spark):
    schema = "url string, title string, content_hash string, first_seen string, last_seen string, version_count int"
    stored = spark.createDataFrame([("https://x.example/a", "old", "1", "2018", "2018", 2), ("https://x.example/c", "same", "3", "2018", "2018", 1)], schema)
    seeds = spark.createDataFrame([("https://x.example/a", "new", "2", "2017", "2019", 9), ("https://x.example/b", "b", "5", "2019", None, 4), ("https://x.example/c", "same", "3", "2019", "2020", 7)], schema)
    got = {r["canonical_url"][-1]: (r["title"], r["first_seen"], r["last_seen"], r["version_count"], r["previous_content_hash"]) for r in A.overlay_seeds(stored, seeds, F.lit("2021")).collect()}
    assert got["a"][0] == "new" and got["a"][2:] == ("2019", 3, "1")
    assert got["b"] == ("b", "2019", "2019", 4, None) and got["c"] == ("same", "2018", "2018", 1, None)


def test_digest_rows_without_event_key_or_category(spark):
    rows = [(None, "u1", None, "2026-08-01", 5, "t1"), (None, "u2", "园区建设", "2026-08-01", 9, "t2"), (None, None, None, "2026-08-01", 3, "t3"), ("e", "u4", None, "2026-08-01", 4, "t4"), ("e", "u5", None, "2026-08-01", 2, "t5")]
    df = spark.createDataFrame(rows, "event_key string, canonical_url string, category string, published_date string, quality_score int, title string")
    got = [r["title"] for r in G.balanced_select(df, days=2, limit=10).orderBy("digest_rank").collect()]
    assert got == ["t2", "t1", "t4", "t3"]


def test_all_reasons_are_kept_and_seven_are_shown(spark):
    from greenledger import rules
    from greenledger.functions import scoring as S

    terms = {f"term{i}": 1 for i in range(9)}
    topic = rules.RelevanceRules(positive=terms, negative={}, implementation=["term0"], national_terms=[], on_topic=["term"], minimum_score=4)
    row = S.curate(spark.createDataFrame([("t", " ".join(terms))], "title string, summary string"), topic).first()
    assert len(row["relevance_reasons"]) == 10 and row["relevance_reason"].count("；") == 6 and row["relevance_score"] == 11
