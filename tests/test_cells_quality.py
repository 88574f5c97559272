"""Grid index of map features, functional dependencies, stale reports, newest rows, ordered digest, leaders along chains."""

import random

import pytest
from pyspark.sql import functions as F

from greenledger import rules
from greenledger.operators import archive as A, cells as G, dedup as D, marts as M, quality as Q


def test_views_are_pruned_by_cell(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(f"f{i % 40}", rnd.uniform(-180, 180), rnd.uniform(-85, 85)) for i in range(800)] + [("edge", 118.2 + 12, 26.2 + 8), ("out", 118.2 + 12.001, 20.0), ("none", None, None)]
    views = rules.MAP_VIEWS
    indexed = G.index_vertices(spark.createDataFrame(rows, "feature string, lon double, lat double"))
    inside = lambda v, lon, lat: lon is not None and v[1] - 12 <= lon <= v[2] + 12 and v[3] - 8 <= lat <= v[4] + 8
    want = {(f, v[0]): any(inside(v, lon, lat) for g, lon, lat in rows if g == f) for f in {r[0] for r in rows} for v in views}
    assert {(r.feature, r.view): r.touches for r in G.features_in_views(indexed, views, "feature").collect()} == want
    G.write_index(indexed, str(tmp_path / "grid"))
    stored = spark.read.parquet(str(tmp_path / "grid"))
    assert {(r.feature, r.view): r.touches for r in G.features_in_views(stored, views[2:3], "feature").collect()} == {k: v for k, v in want.items() if k[1] == "广东"}


def test_unknown_view_has_the_national_box(spark):
    raw = spark.createDataFrame([("p1", "国内园区", "100", "30"), ("p2", "国际案例", "10", "50")], "park_id string, region_scope string, longitude string, latitude string")
    rows = M.map_rows(M.park_projection(raw), "某处").collect()
    assert [(r.park_id, r.marker) for r in rows] == [("p2", "international")]


def test_dependencies_show_two_rows(spark):
    rows = [("i1", "a", "2020", "园区", 1.0), ("i1", "b", "2021", "园区", 1.0), ("i2", "c", "2020", "园区", 1.0), ("i2", "d", "2020", "城市", None), ("i3", "e", None, "园区", 2.0), ("i3", "f", "2020", "园区", 2.0), ("i4", "g", "2020", "x", 1.0), ("i4", "h", "2020", "x", 3.0)]
    frame = spark.createDataFrame(rows, "ratio string, row_key string, year string, boundary string, value double")
    found = Q.dependency_violations(frame, ["ratio"], {"year": "Q09", "boundary": "Q09", "value": "Q05"}, "row_key")
    assert sorted((r.ratio, r.rule_id, r.column, r.low_witness, r.high_witness) for r in found.collect()) == [("i1", "Q09", "year", "a", "b"), ("i2", "Q09", "boundary", "c", "d"), ("i4", "Q05", "value", "g", "h")]


def test_declared_rules_of_single_rows(spark):
    fields = "k string, source_url string, period string, boundary string, value string, unit string, proxy string, use string, factor_purpose string, used_for string, origin string, core_metric string, evidence_grade string"
    base = ("https://x", "2020", "园区", "1", "%")
    rows = [("ok", *base, "是", "pre_assessment", "组织", "组织", "site", "是", "A"), ("Q06", *base, "是", "benchmark", None, None, None, None, None), ("Q08", *base, None, None, "组织", "产品", None, None, None),
            ("Q10", *base, None, None, None, None, "project_case", None, None), ("Q11", *base, None, None, None, None, None, "true", "C")]
    found = Q.violations(spark.createDataFrame(rows, fields), "k", ["%"]).collect()
    assert sorted((r.k, r.rule_id) for r in found) == [(k, k) for k in ("Q06", "Q08", "Q10", "Q11")]


def test_reports_become_stale_with_their_inputs(spark):
    used = spark.createDataFrame([("r1", "a", 1), ("r1", "b", 1), ("r2", "a", 2), ("r3", "gone", 1), ("r4", "b", None)], "report_id string, input_id string, version int")
    now = spark.createDataFrame([("a", 2), ("b", 1), ("b", 1)], "input_id string, version int")
    assert sorted(map(tuple, Q.stale_reports(used, now).collect())) == [("r1", 1, "a"), ("r3", 1, "gone"), ("r4", 1, "b")]


@pytest.mark.parametrize("ranked", [10_000, 0, 7])
def test_newest_rows_are_exact_at_the_border(spark, monkeypatch, ranked):
    monkeypatch.setattr(A, "RANKED", ranked)
    rnd = random.Random(3)
    rows = [(rnd.choice(["2024-01-01", "2024-01-02", "2024-01-03", None, ""]), rnd.choice([None, "2024-02-01 10:00:00", "2024-02-01 10:30:00", "2024-02-02 09:00:00"]), f"https://e.example/{rnd.choice('abc')}/{i}") for i in range(120)]
    frame = spark.createDataFrame(rows, "published_date string, first_seen string, canonical_url string")
    order = sorted(rows, key=lambda r: r[2])
    for k in (1, 0):  # stable sorts, last key first; missing ones last
        order = sorted(order, key=lambda r: (r[k] is not None, r[k] or ""), reverse=True) if False else sorted([r for r in order if r[k] is not None], key=lambda r: r[k], reverse=True) + [r for r in order if r[k] is None]
    for n in (0, 1, 13, 50, 119, 120, 500):
        assert sorted(map(str, (tuple(r) for r in A.newest(frame, n).collect()))) == sorted(map(str, order[:n])), n


def test_newest_rows_compute_the_archive_once(spark, monkeypatch):
    """However many levels the border takes, also behind a long common start of the URLs."""
    monkeypatch.setattr(A, "RANKED", 3)
    computed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch

    rows = [("2024-01-01", "2024-02-01 10:00:00", f"https://e.example/{'same/' * 20}{i:04d}") for i in range(300)] + [("2024-01-01", "2024-02-01 10:00:00", None)] * 5
    frame = spark.createDataFrame(rows, "published_date string, first_seen string, canonical_url string").mapInArrow(counted, "published_date string, first_seen string, canonical_url string")
    got = [r["canonical_url"] for r in A.newest(frame, 287).collect()]
    assert sorted(got) == [r[2] for r in rows[:287]] and computed.value == len(rows)
    assert A.newest(frame, 302).filter("canonical_url IS NULL").count() == 2


def test_ordered_digest_sees_order_but_no_partitions(spark):
    rnd = random.Random(4)
    rows = [(i, f"https://e.example/{i}", f"h{rnd.random()}") for i in range(9000)]
    frame = spark.createDataFrame(rows, "at int, canonical_url string, content_hash string")
    digest = lambda df: A.ordered_digest(df, [F.desc("at")]).first()
    whole = digest(frame.repartition(7))
    assert whole["rows"] == 9000 and whole == digest(frame.coalesce(1)) == digest(frame.orderBy("canonical_url").repartition(3))
    swapped = frame.withColumn("at", F.when(F.col("at") == 10, 11).when(F.col("at") == 11, 10).otherwise(F.col("at")))
    changed = frame.withColumn("content_hash", F.when(F.col("at") == 5, "x").otherwise(F.col("content_hash")))
    assert len({d["ordered_digest"] for d in (whole, digest(swapped), digest(changed), digest(frame.filter("at > 0")), digest(frame.limit(0)))}) == 5
    value, total = [0] * 4, 0  # a plain fold
    import hashlib

    for _, url, content in sorted(rows, reverse=True):
        h = hashlib.sha256(f"{url}|{content}".encode()).hexdigest()
        value = [(v * b + int(h[7 * k : 7 * k + 7], 16)) % p for k, (v, b, p) in enumerate(zip(value, A.BASES, A.PRIMES))]
        total += 1
    assert hashlib.sha256("|".join(map(str, [total, *value])).encode()).hexdigest() == whole["ordered_digest"]


def leaders_by_hand(n, edges):
    before, leads = {}, {}
    for a, b in edges:
        before.setdefault(a, []).append(b)
    for i in range(n):
        leads[i] = not any(leads[b] for b in before.get(i, []))
    return leads


def test_leaders_of_any_graph(spark):
    rnd = random.Random(6)
    for n, m in ((60, 70), (40, 200), (80, 79)):
        edges = {tuple(sorted(rnd.sample(range(n), 2), reverse=True)) for _ in range(m)} if m != 79 else {(i, rnd.randrange(max(0, i - 3), i)) for i in range(1, n)}
        rows = spark.createDataFrame([(i,) for i in range(n)], "_ord int")
        found = D.settle(rows, spark.createDataFrame(list(edges), "_ord int, h__ord int"))
        assert {r._ord: r.is_leader for r in found.collect()} == leaders_by_hand(n, edges)


def test_a_chain_takes_steps_as_its_logarithm(spark):
    jobs = {}
    for n in (100, 2000):
        spark.sparkContext.setJobGroup(f"chain-{n}", "")
        found = D.settle(spark.range(n).selectExpr("cast(id as int) _ord"), spark.range(1, n).selectExpr("cast(id as int) _ord", "cast(id - 1 as int) h__ord"))
        assert {r._ord for r in found.filter("is_leader").collect()} == set(range(0, n, 2))
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain-{n}"))
    spark.sparkContext._jsc.clearJobGroup()
    assert jobs[2000] < 2 * jobs[100] and jobs[2000] < 200
