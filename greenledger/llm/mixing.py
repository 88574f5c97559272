"""Mixing sources to target weights by Poisson replication.

A source's rate is target weight x size of the mix / documents it has. Each document draws its number of
copies from a Poisson distribution with that mean by inverting it at a uniform number hashed from
seed and id, so the draw needs no state and repeats on every run. A rate over ``PART`` is drawn as a sum of
independent draws of equal smaller rates, which is again Poisson. Documents are exploded by
their counts and dealt out by the hash of (seed, id, copy), which also sorts each output partition: a
shuffle of the whole mix.

Weights: given by source, or (None) every source's share to the power ``temperature`` before
normalising (1: as it is; 0: all alike). Sources without a given weight get weight 0 and leave the
mix; that is what a target of 0 means. Rates are one row per source; up to ``MANY`` sources they are broadcast, beyond
that joined with salted sources, so that one large source is no single task.

Nulls: a null source is a source of its own, named by the empty text in weights. A null id hashes as the
empty text; rows that share an id and a text draw alike. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from greenledger.llm import common as C

PART = 8.0
STEPS = 64  # beyond 64 a Poisson draw of mean 8 has a probability under 1e-33
MANY = 100_000
SALTS = 64


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of an md5 sum."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def draw(rate: Column, seed: int, key: Column) -> Column:
    """A Poisson number of mean ``rate`` for a key."""
    parts = F.greatest(F.ceil(rate / PART), F.lit(1))
    mean = rate / parts

    def invert(u: Column) -> Column:
        start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.lit(0).cast("long").alias("k"))
        end = F.aggregate(
            F.sequence(F.lit(1), F.lit(STEPS)), start,
            lambda a, i: F.when(u < a["sum"], a).otherwise(F.struct((a["p"] * mean / i).alias("p"), (a["sum"] + a["p"] * mean / i).alias("sum"), i.cast("long").alias("k"))),
        )
        return end["k"]

    return F.aggregate(F.sequence(F.lit(1).cast("long"), parts.cast("long")), F.lit(0).cast("long"), lambda a, c: a + invert(uniform(F.lit(seed), key, c.cast("string"))))


def rates(docs: DataFrame, weights: dict[str, float] | None, size: float, temperature: float, source_col: str) -> DataFrame:
    """``_source``, its documents, share of the mix and rate. ``size``: documents of the mix over documents there are."""
    counts = docs.groupBy(F.coalesce(C.named(source_col).cast("string"), F.lit("")).alias("_source")).agg(F.count(F.lit(1)).alias("_docs"))
    if weights is None:
        raw = F.pow(F.col("_docs").cast("double"), F.lit(float(temperature)))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights are not negative")
        raw = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])[F.col("_source")], F.lit(0.0)) if weights else F.lit(0.0)
    counts = counts.withColumn("_raw", raw)
    total = counts.agg(F.sum("_raw").alias("_sum"), F.sum("_docs").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select(  # one row of sums
        "_source", "_docs", (F.col("_raw") / F.col("_sum")).alias("share"), F.coalesce(F.col("_raw") / F.col("_sum") * size * F.col("_all") / F.col("_docs"), F.lit(0.0)).alias("rate"),
    )


def mix(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0, temperature: float = 0.5, seed: int = 1, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The mix: rows of ``docs``, repeated, with a struct ``draw`` (``C.free_name`` where they have such a column): copy (from 1), copies and rate."""
    table = rates(docs, weights, size, temperature, source_col)
    rows = docs.select(F.struct("*").alias("_doc"), F.coalesce(C.named(id_col).cast("string"), F.lit("")).alias("_key"), F.coalesce(C.named(source_col).cast("string"), F.lit("")).alias("_source"))
    if table.limit(MANY + 1).count() <= MANY:
        joined = rows.join(F.broadcast(table.select("_source", "rate")), "_source")
    else:
        salted = table.select("_source", "rate", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        joined = rows.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int")).join(salted.hint("shuffle_merge"), ["_source", "_salt"])
    drawn = joined.withColumn("_copies", draw(F.col("rate"), seed, F.col("_key"))).filter("_copies > 0")
    copies = drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    placed = copies.withColumn("_place", F.xxhash64(F.lit(seed), "_key", "_copy"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(partitions, "_place").sortWithinPartitions("_place")
    return dealt.select("_doc.*", F.struct(F.col("_copy").alias("copy"), F.col("_copies").alias("copies"), F.col("rate")).alias(C.free_name(docs, "draw")))
