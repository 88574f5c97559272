"""Running values keep rows without time."""

from pyspark.sql import functions as F

from greenledger.operators import chunked


def test_null_chunk_stays_and_comes_first(spark):
    rows = spark.createDataFrame([("a", None, None, 1, False), ("a", 1, 1, 2, True), ("a", 2, 2, 3, False), ("a", 2, 3, 4, False)], "k string, c int, t int, v int, ok boolean")
    order = [F.col("t")]
    previous = {r.v: r.p for r in chunked.with_previous(rows, "k", "c", order, "v", "p").collect()}
    assert previous == {1: None, 2: 1, 3: 2, 4: 3}
    total = {r.v: r.s for r in chunked.with_running_sum(rows, "k", "c", order, "v", "s").collect()}
    assert total == {1: 1, 2: 3, 3: 6, 4: 10}
    run = {r.v: r.n for r in chunked.with_run_since_reset(rows, "k", "c", order, "ok", "n").collect()}
    assert run == {1: 1, 2: 0, 3: 1, 4: 2}
