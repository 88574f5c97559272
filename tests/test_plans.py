from pyspark.sql import functions as F

from greenledger import rules
from greenledger.operators import archive as A
from greenledger.plans import archive as PA
from greenledger.sources import readers, writers

INDEX = "<html><body><a href='/t20260801_1.html'>某开发区推进零碳园区建设的通知</a><a href='/t20260801_1.html#x'>某开发区推进零碳园区建设的通知</a><a href='/t20260802_2.html'>零碳园区招聘表彰干部任免党建文旅赛事消费券</a><a href='/c'>短</a></body></html>"
ARTICLE = "<html><head><title>T</title></head><body><p>" + "园区余热回收与蒸汽系统节能改造项目已经开工建设并计划投产。" * 3 + "</p></body></html>"


def test_collect_update_publish(spark):
    sources = spark.createDataFrame([("S1", "某经济技术开发区", "园区", "official_html", "园区建设", "中国", True), ("S2", "另一来源", "", "official_html", "", "", False)], "id string, name string, scope string, type string, default_category string, region string, enabled boolean")
    index = spark.createDataFrame([("S1", "https://x.example/list/", INDEX)], "id string, url string, html string")
    articles = spark.createDataFrame([("http://x.example/t20260801_1.html", ARTICLE)], "url string, html string")
    found = PA.collect(index, articles, sources, F.lit("2026-08-20"))
    kept = found.records.collect()
    assert [(r["canonical_url"], r["published_date"], r["category"]) for r in kept] == [("https://x.example/t20260801_1.html", "2026-08-01", "技术与设施")]
    assert found.rejected.count() == 1 and found.examples.first()["score"] < 4
    log = {r["source_id"]: r for r in found.log.collect()}
    assert (log["S1"]["candidates"], log["S1"]["records"], log["S1"]["rejected_low_relevance"]) == (2, 1, 1)

    archive, related, _ = PA.update_archive(found.records.limit(0), found.records, F.lit("2026-08-20"))
    assert archive.count() == 1 and related.count() == 0
    parks = spark.createDataFrame([("p1", "国内园区", "甲"), ("p2", "国际案例", "乙")], "park_id string, region_scope string, park_name string")
    evidence = spark.createDataFrame([("p1", "事实")], "park_id string, statement string")
    gates = spark.createDataFrame([(True,), (False,)], "ready boolean")
    marts = PA.publish(archive, parks, evidence, evidence, gates)
    counts = {r["name"]: r["value"] for r in marts.counts.collect()}
    assert counts["domestic_parks"] == 1 and counts["archive_records"] == 1 and counts["formal_accounting_ready"] == 1
    assert [r["value"] for r in marts.funnel.orderBy("ord").collect()] == [2, 1, 1, 1, 1]
    assert marts.daily.count() == 1 and marts.weekly.count() == 1 and marts.feed.count() == 1
    assert marts.monthly.first()["name"] == "2026-08"


def test_collect_leaves_out_foreign_hosts_and_disabled_sources(spark):
    fields = "id string, name string, scope string, type string, default_category string, region string, enabled boolean, allowed_domains array<string>"
    sources = spark.createDataFrame([("S1", "a", "", "", "园区建设", "", True, ["other.example"]), ("S2", "b", "", "", "园区建设", "", False, []), ("S3", "c", "", "", "园区建设", "", None, [])], fields)
    index = spark.createDataFrame([(s, "https://x.example/list/", INDEX) for s in ("S1", "S2", "S3")], "id string, url string, html string")
    found = PA.collect(index, index.select("url", "html").limit(0), sources, F.lit("2026-08-20"))
    assert {r["source_id"]: r["candidates"] for r in found.log.collect()} == {"S1": 0, "S3": 2}


FIELDS = "id string, name string, scope string, type string, default_category string, region string, enabled boolean, start_url string, elapsed_seconds double"


def test_failed_and_quarantined_sources_get_rows(spark):
    sources = spark.createDataFrame([(s, f"name {s}", "", "", "园区建设", "", True, f"https://{s}.example/", 1.5) for s in ("ok", "bad", "wait", "again")], FIELDS)
    health = spark.createDataFrame([("wait", "quarantined", "2026-08-18"), ("again", "quarantined", "2026-08-01"), ("ok", "healthy", "2026-08-19")], "id string, status string, last_attempt string")
    failures = spark.createDataFrame([("bad", "TimeoutError: " + "x" * 600)], "id string, error string")
    index = spark.createDataFrame([(s, f"https://{s}.example/list/", INDEX) for s in ("ok", "bad", "wait", "again")], "id string, url string, html string")
    found = PA.collect(index, index.select("url", "html").limit(0), sources, F.lit("2026-08-20").cast("date"), health=health, failures=failures)
    log = {r["source_id"]: r for r in found.log.collect()}
    assert {s: r["status"] for s, r in log.items()} == {"ok": "ok", "bad": "failed", "wait": "skipped_quarantine", "again": "ok"}
    assert log["ok"]["candidates"] == 2 and log["bad"]["candidates"] == 0 and len(log["bad"]["error"]) == 614  # whole text
    assert log["wait"]["elapsed_seconds"] == 0 and log["ok"]["elapsed_seconds"] == 1.5 and log["wait"]["source_name"] == "name wait" and log["wait"]["start_url"] == "https://wait.example/"
    assert {r["source_id"] for r in found.records.union(found.rejected).select("source_id").collect()} == {"ok", "again"}
    alone = PA.collect(index, index.select("url", "html").limit(0), sources, F.lit("2026-08-20").cast("date"), only="again")
    assert [r["source_id"] for r in alone.log.collect()] == ["again"]


TOPIC = rules.RelevanceRules(positive={"alpha": 4}, negative={}, implementation=[], national_terms=[], on_topic=["a"], minimum_score=4)
RECORD = "url string, title string, summary string, publisher string, source_scope string, published_date string, first_seen string"


def test_report_events_drop_the_irrelevant_before_they_collapse(spark):
    rows = [("https://x.example/1", "one and the same title a", "a" * 100, "p", "园区", "2026-08-01", "2026-08-01"), ("https://x.example/2", "one and the same title a", "alpha", "q", "", "2026-08-01", "2026-08-01")]
    archive = A.keyed(spark.createDataFrame(rows, RECORD))
    assert [r["canonical_url"] for r in PA.report_events(archive, relevance=TOPIC).collect()] == ["https://x.example/2"]
    found, _, _ = PA.update_archive(archive.limit(0), archive, F.lit("2026-08-02"), relevance=TOPIC)
    assert [(r["canonical_url"], r["relevance_status"]) for r in found.collect()] == [("https://x.example/1", "exclude")]  # the archive keeps the best record of all


def test_merge_statistics(spark):
    old = A.merge(spark.createDataFrame([], RECORD), spark.createDataFrame([("https://x.example/1", "first alpha title", "alpha", "p", "", "2026-08-01", "2026-08-01"), ("https://x.example/5", "quite another thing alpha", "alpha", "p", "", "2026-08-03", "2026-08-03")], RECORD), F.lit("2026-08-03"))
    new = [("https://x.example/1", "first alpha title", "alpha, changed", "p", "", "2026-08-01", "2026-08-04"), ("https://x.example/2", "first alpha title!", "alpha again", "q", "", "2026-08-01", "2026-08-04"),
           ("https://x.example/3", "nothing of note", "b", "q", "", "2026-08-02", "2026-08-04"), ("https://x.example/5", "quite another thing alpha", "alpha", "p", "", "2026-08-03", "2026-08-04")]
    got = PA.merge_statistics(old, spark.createDataFrame(new, RECORD), F.lit("2026-08-04"), relevance=TOPIC).first().asDict()
    assert got == {"added": 2, "updated": 1, "unchanged": 1, "total": 3, "duplicates_collapsed": 1, "included": 2, "excluded_low_relevance": 1}
    assert PA.merge_statistics(old, spark.createDataFrame(new, RECORD), F.lit("2026-08-04"), relevance=TOPIC, max_records=2).first()["total"] == 2


def test_digest_carries_its_analysis(spark):
    rows = [(f"https://x.example/{i}", f"alpha 空压 {'零一二三四五六七'[i] * 6}", f"alpha 投资{i}万元" + "说明" * 30, "p" if i < 5 else "q", "", f"2026-08-0{1 + i % 3}", "2026-08-04") for i in range(8)]
    made = PA.make_digest(PA.report_events(A.keyed(spark.createDataFrame(rows, RECORD)), relevance=TOPIC), 7, 6)
    metrics = made.metrics.first()
    assert made.rows.count() == 6 == metrics["records"] and metrics["numeric"] == 6 and metrics["linked"] == 0
    kinds = {(r["kind"], r["ord"]) for r in made.analysis.collect()}
    assert ("opportunity", 1) in kinds and ("constraint", 0) in kinds and ("constraint", 2) in kinds and ("constraint", 4) in kinds
    assert {r["theme"]: r["value"] for r in made.themes.collect()}["设备与系统节能"] == 6


def test_sources_marts_and_first_available(spark, tmp_path):
    import json

    config = {"sources": [{"id": "S1", "name": "a", "allowed_domains": ["x.example"]}, {"id": "S2", "name": "b", "enabled": False}], "archive_limit": 5}
    (tmp_path / "sources.json").write_text(json.dumps(config))
    assert {r["id"]: r["enabled"] for r in readers.read_sources(spark, str(tmp_path / "sources.json")).collect()} == {"S1": True, "S2": False}
    mart = spark.createDataFrame([("甲", 1)], "name string, value int")
    writers.write_mart(mart, str(tmp_path / "mart"))
    load = lambda path: lambda: spark.read.schema(mart.schema).json(path) if readers.path_exists(spark, path) else mart.limit(0)
    found = readers.first_available(spark, [load(str(tmp_path / "curated")), load(str(tmp_path / "mart")), lambda: mart.limit(0)])
    assert found.collect() == mart.collect()
    for headers in (writers.GAP_HEADERS, writers.MEASURE_HEADERS, writers.ADVICE_HEADERS):
        wide = spark.createDataFrame([tuple(f"v,{c}" for c in headers) + ("x",)], ", ".join(f"`{c}` string" for c in headers) + ", extra string")
        writers.export_csv(wide, str(tmp_path / "table"), headers)
        assert [r.asDict() for r in readers.read_table(spark, str(tmp_path / "table"), list(headers.values())).collect()] == [{h: f"v,{c}" for c, h in headers.items()}]
