"""The distributed leader assignment against a sequential one."""

import datetime
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from greenledger.operators import dedup as D

SCHEMA = "url string, normalized_title string, document_number string, published_date string, quality_score int, title string, summary string, publisher string"


def sequential(rows, threshold):
    def key(r):
        day = -datetime.date.fromisoformat(r[3]).toordinal() if r[3] else 10**9
        return (day, -r[4], r[0])

    heads, leader = [], {}
    for r in sorted(rows, key=key):
        for h in heads:
            near = r[3] == h[3] and r[1] and h[1] and SequenceMatcher(None, r[1], h[1]).ratio() >= threshold
            if (r[2] and r[2] == h[2]) or (r[1] and r[1] == h[1]) or near:
                leader[r[0]] = h[0]
                break
        else:
            heads.append(r)
            leader[r[0]] = r[0]
    return leader


def make(seed, alphabet, n=60):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 30))) for _ in range(8)]
    rows = []
    for i in range(n):
        t = list(base[0] if rnd.random() < 0.4 else rnd.choice(base))
        for _ in range(rnd.randint(0, 2)):
            t[rnd.randrange(len(t))] = rnd.choice(alphabet)
        title = "".join(t) if rnd.random() > 0.05 else ""
        rows.append((f"u{i:03d}", title, rnd.choice(["", "", "", "d1", "d2"]), rnd.choice(["2024-01-01", "2024-01-02", ""]), rnd.randint(0, 3), title, "", "p"))
    return rows


@pytest.mark.parametrize("seed,alphabet,threshold,q,crowd", [
    (1, "零碳园区建设通知方案", 0.8, 2, 50.0), (2, "abcdef", 0.72, 2, 50.0), (3, "ab", 0.9, 3, 50.0), (4, "零碳园区建设通知", 0.9, 2, -1.0),
])
def test_equals_sequential(spark, seed, alphabet, threshold, q, crowd):
    rows = make(seed, alphabet)
    placed = D.assign(spark.createDataFrame(rows, SCHEMA), threshold, q, pairs_per_row=crowd)
    got = {r["url"]: r["l"] for r in placed.select("url", F.col("_leader")["tie"].alias("l")).collect()}
    assert got == sequential(rows, threshold)


def test_prefix_filter_loses_no_pair():
    rnd = random.Random(9)
    for _ in range(3000):
        a = "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 25)))
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            if b and rnd.random() < 0.5:
                b.pop(rnd.randrange(len(b)))
            else:
                b.insert(rnd.randint(0, len(b)), rnd.choice("abcd"))
        b = "".join(b)
        for t in (0.72, 0.9):
            for q in (2, 3, 4):
                if b and D.title_ratio(a, b, t) >= t:
                    keys = [set(D.title_keys(x, D.key_plan(len(x), t, q))) for x in (a, b)]
                    assert keys[0] & keys[1], (a, b, t, q)


def test_tiles_of_few_syllables_equal_sequential(spark, monkeypatch):
    """Titles of the same few syllables in many small blocks; dense families whose rows ask again."""
    monkeypatch.setattr(D, "BLOCK", 16)
    rnd = random.Random(5)
    base = ["".join(rnd.choice(["the", "ona", "er", "in"]) for _ in range(14)) for _ in range(4)]
    rows = []
    for i in range(90):
        title = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            title[rnd.randrange(len(title))] = rnd.choice("theonarin")
        rows.append((f"u{i:03d}", "".join(title), "", "2024-01-01", rnd.randint(0, 3), "", "", "p"))
    placed = D.assign(spark.createDataFrame(rows, SCHEMA), 0.9, 2, pairs_per_row=2)
    assert {r["url"]: r["l"] for r in placed.select("url", F.col("_leader")["tie"].alias("l")).collect()} == sequential(rows, 0.9)


def test_rows_alike_in_order_stay_one_row_each(spark):
    rows = [("u", "abcdefgh", "", "2024-01-01", 1, "", "", "p"), ("u", "stuvwxyz", "", "2024-01-01", 1, "", "", "p")]
    assert D.assign(spark.createDataFrame(rows, SCHEMA), 0.9).count() == 2
