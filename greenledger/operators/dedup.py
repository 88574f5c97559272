"""Near-duplicate collapse: exact ordered leader assignment as a distributed job.

Rows are ranked; a row joins the earliest leader it matches, and is a leader itself when it
matches none. A match is an equal document number, an equal normal title, or the same day and
a title similarity of at least the threshold.

How it scales:

* Rows alike in number, title and day behave alike, so one representative stands for all of
  them before anything is compared. A text copied a billion times is one row from then on.
* Equal numbers and titles meet in buckets, whose first rows serve all others.
* The titles of a day meet in tiles of two blocks. A product of gram counts rules out pairs that
  share too few grams, some ten nanoseconds a pair; what is left is compared in full. Work is
  quadratic in the distinct titles of one day, memory is that of a tile. (A join on shared grams
  is no better where titles are made of the same few syllables: nearly all share some gram.)
* A row notes only its first matches of a tile or bucket. That decides nearly everything; rows it
  doesn't decide ask again among the rows that are not known to follow.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from greenledger import rules
from greenledger.functions import text as T
from greenledger.functions.scoring import any_term, with_columns_present
from greenledger.session import cut


def primary_rank(df: DataFrame) -> DataFrame:
    """Adds ``_ord``: a struct that sorts the best record first."""
    df = with_columns_present(with_columns_present(df, ("url", "title", "summary", "published_date")), ("quality_score", "version_count"), "int")
    url = T.text_or_empty(F.col("url"))
    path = F.when(F.contains(url, F.lit("/top/")) | F.contains(T.text_or_empty(F.col("title")), F.lit("图解")), -2).otherwise(0)
    path = path + F.when(any_term(url, rules.PREFERRED_PATHS), 2).otherwise(0)
    # The whole text of the date, downwards: negative letters, and an end that puts a text after those it begins.
    letters = F.filter(F.split(T.text_or_empty(F.col("published_date")), ""), lambda c: c != "")
    ranks = [
        F.concat(F.transform(letters, lambda c: -F.ascii(c)), F.array(F.lit(1))).alias("day"),
        (-F.coalesce(F.col("quality_score"), F.lit(0))).cast("int").alias("quality"),
        (-path).cast("int").alias("path"),
        (-F.length(T.clean_text(F.col("summary")))).cast("int").alias("length"),
        (-F.coalesce(F.nullif(F.col("version_count"), F.lit(0)), F.lit(1))).cast("int").alias("version"),
        T.text_or_empty(F.col("canonical_url") if "canonical_url" in df.columns else F.col("url")).alias("tie"),
    ]
    return df.withColumn("_ord", F.struct(*ranks))


def common_chars(a: int, b: int, threshold: float) -> int:
    """Characters two titles of these lengths must have in common, in order, to reach the threshold."""
    return math.ceil(threshold * (a + b) / 2 - 1e-9)


def gram_overlap(a: int, b: int, threshold: float, q: int) -> int:
    """Least number of q-grams they then share: each lost character takes at most q grams with it."""
    kept = common_chars(a, b, threshold)
    return a - q + 1 - q * (a - kept) - (q - 1) * (b - kept)


def key_plan(size: int, threshold: float, q: int) -> tuple[tuple[int, int], ...]:
    """(gram width, grams surely shared) for a title of this size, over all partner sizes it may match.

    Pairs that must share a q-gram meet through q-grams; the others, with short titles, through
    single characters. The overlap is symmetric, so both sides of a pair choose alike.
    """
    if size == 0:
        return ()
    low = max(1, math.ceil(size * threshold / (2 - threshold) - 1e-9))
    high = math.floor(size * (2 - threshold) / threshold + 1e-9)
    partners = range(low, max(size, high) + 1)
    by_grams = [o for o in (gram_overlap(size, p, threshold, q) for p in partners) if o >= 1]
    by_chars = [gram_overlap(size, p, threshold, 1) for p in partners if gram_overlap(size, p, threshold, q) < 1]
    plan = [(q, min(by_grams))] if by_grams else []
    return tuple(plan + ([(1, max(1, min(by_chars)))] if by_chars else []))


def title_keys(title: str, plan: tuple[tuple[int, int], ...]) -> list[str]:
    """Prefix-filter keys: two titles whose similarity reaches the threshold share a key.

    Repeated grams are told apart by their occurrence, and sorted by a hash that is the same for
    every row.
    """
    keys: list[str] = []
    for width, shared in plan:
        seen: Counter = Counter()
        grams = []
        for i in range(len(title) - width + 1):
            gram = title[i : i + width]
            seen[gram] += 1
            grams.append(f"{gram}#{seen[gram]}")
        grams.sort(key=lambda g: hashlib.md5(g.encode()).digest())
        keys += [f"{width}:{g}" for g in grams[: len(grams) - shared + 1]]
    return keys


def title_ratio(left: str, right: str, threshold: float) -> float:
    """Similarity of two normal titles, zero when a cheap bound already rules the pair out."""
    matcher = SequenceMatcher(None, left, right)
    if matcher.real_quick_ratio() < threshold or matcher.quick_ratio() < threshold:
        return 0.0
    return matcher.ratio()


def representatives(df: DataFrame) -> DataFrame:
    """One row per (document number, normal title, day): the first in order stands for all."""
    return df.groupBy("document_number", "normalized_title", "_day").agg(F.min("_ord").alias("_ord"))


def placed_representatives(df: DataFrame) -> DataFrame:
    """Representatives with ``_place``, a number that grows along the order; equal orders go by title, number and day."""
    reps = cut(representatives(df)).orderBy("_ord", "normalized_title", "document_number", "_day")
    return cut(reps.withColumn("_place", F.monotonically_increasing_id()))


BLOCK = 4096  # titles of a day that are compared at once with as many others
STRIPE = 512  # rows of a block whose shared grams are counted in one product
EDGES = "_ord long, h__ord long, _upto long"


def gram_codes(title: str, q: int, slots: int = 512) -> bytes:
    """The q-grams of a title as slots; a gram's repetitions are told apart."""
    seen: Counter = Counter()
    codes = np.empty(max(0, len(title) - q + 1), "<u2")
    for i in range(len(codes)):
        gram = title[i : i + q]
        seen[gram] += 1
        codes[i] = zlib.crc32(f"{gram}#{seen[gram]}".encode("utf-8", "surrogatepass")) % slots
    return codes.tobytes()


def _codes(q: int):
    @F.pandas_udf("binary")
    def codes(titles: pd.Series) -> pd.Series:
        return titles.map(lambda t: gram_codes(t, q))

    return codes


def close_pairs(rows: pd.DataFrame, threshold: float, q: int, most: int, slots: int = 512) -> pd.DataFrame:
    """The first ``most`` earlier rows that each asking row of a tile is similar to, in order; ``_upto`` is the last one looked at where the
    list may go on behind it. Titles of a pair lie in different blocks, or in the tile's only one.

    Grams that share a slot only add to the count of shared ones, so a pair whose count is below ``gram_overlap`` can't reach the threshold.
    """
    rows = rows.sort_values("_place", ignore_index=True)
    places, titles, asks, block = rows["_place"].to_numpy(), rows["normalized_title"].tolist(), np.flatnonzero(rows["_asks"]), rows["_block"].to_numpy()
    size = np.array([len(t) for t in titles])
    codes = [np.frombuffer(c, "<u2") for c in rows["_grams"]]
    flat = np.repeat(np.arange(len(rows)) * slots, [len(c) for c in codes]) + np.concatenate(codes)
    counts = np.bincount(flat, minlength=len(rows) * slots).astype(np.float32).reshape(-1, slots)
    across = rows["_lo"].iloc[0] != rows["_hi"].iloc[0]
    found = []
    for start in range(0, len(asks), STRIPE):
        mine = asks[start : start + STRIPE]
        heads = np.arange(mine[-1])
        a, b = size[mine][:, None], size[heads][None, :]
        kept = np.ceil(threshold * (a + b) / 2 - 1e-9)
        fits = (heads[None, :] < mine[:, None]) & (np.minimum(a, b) >= kept) & (counts[mine] @ counts[heads].T >= a - q + 1 - q * (a - kept) - (q - 1) * (b - kept) - 0.5)
        if across:
            fits &= block[heads][None, :] != block[mine][:, None]
        for i, near in zip(mine, fits):
            hits = []
            for j in np.flatnonzero(near):
                if title_ratio(titles[i], titles[j], threshold) >= threshold:
                    hits.append(j)
                    if len(hits) == most:
                        break
            upto = places[hits[-1]] if len(hits) == most and near[hits[-1] + 1 :].any() else None
            found += [(places[i], places[j], upto) for j in hits]
    return pd.DataFrame(found, columns=["_ord", "h__ord", "_upto"]).astype({"_ord": "int64", "h__ord": "int64", "_upto": "Int64"})


def near_edges(pool: DataFrame, threshold: float, q: int, most: int) -> DataFrame:
    """Similar titles of a day. A day's titles are dealt into blocks by hash and every two blocks meet in a task of their own."""
    titled = pool.filter(F.col("normalized_title") != "")
    blocks = titled.groupBy("_day").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    dealt = titled.join(blocks, "_day").withColumn("_block", F.pmod(F.xxhash64("_place"), "_blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    tiles = dealt.withColumn("_other", other).select("_day", F.least("_block", "_other").alias("_lo"), F.greatest("_block", "_other").alias("_hi"), "_block", "_place", "normalized_title", "_grams", "_asks")
    return tiles.groupBy("_day", "_lo", "_hi").applyInPandas(lambda rows: close_pairs(rows, threshold, q, most), EDGES)


def equal_edges(pool: DataFrame, most: int) -> DataFrame:
    """The first ``most`` earlier rows with the same number or title. All rows of such a bucket match, so its first rows serve everybody."""
    number = F.when(F.col("document_number") != "", F.concat(F.lit("D|"), F.col("document_number")))
    title = F.when(F.col("normalized_title") != "", F.concat(F.lit("T|"), F.sha2("normalized_title", 256)))
    keyed = pool.select(F.col("_place").alias("_ord"), "_asks", F.explode(F.array_compact(F.array(number, title))).alias("_bucket"))
    shared = keyed.groupBy("_bucket").agg(F.count("*").alias("_rows")).filter("_rows > 1")
    ranked = keyed.withColumn("_no", F.row_number().over(W.partitionBy("_bucket").orderBy("_ord"))).filter(F.col("_no") <= most)
    firsts = ranked.join(shared, "_bucket").select("_bucket", F.col("_ord").alias("h__ord"), F.when((F.col("_no") == most) & (F.col("_rows") > most), F.col("_ord")).alias("_upto"))
    ends = firsts.groupBy("_bucket").agg(F.max("_upto").alias("_upto"))
    pairs = keyed.filter("_asks").join(firsts.drop("_upto").join(ends, "_bucket"), "_bucket").filter("h__ord < _ord")
    return pairs.select("_ord", "h__ord", F.when(F.col("_upto") < F.col("_ord"), F.col("_upto")).alias("_upto"))


def neighbours(pool: DataFrame, threshold: float, q: int, most: int) -> DataFrame:
    """(row, earlier match) for the asking rows of a pool, complete up to a place of each row. A row whose matches may go on behind that
    place gets one more edge, to a negative number of its own: a head nobody knows yet."""
    edges = near_edges(pool, threshold, q, most).unionByName(equal_edges(pool, most))
    whole = edges.withColumn("_upto", F.min("_upto").over(W.partitionBy("_ord"))).filter(F.col("_upto").isNull() | (F.col("h__ord") <= F.col("_upto")))
    heads = F.explode(F.when(F.col("_upto").isNull(), F.array("h__ord")).otherwise(F.array(F.col("h__ord"), -1 - F.col("_ord"))))
    return cut(whole.select("_ord", heads.alias("h__ord")).distinct())


def assign_leaders(reps: DataFrame, threshold: float, q: int = 2, pairs_per_row: float = 8.0) -> DataFrame:
    """(place -> place of the leader) for every representative; a leader points to itself.

    Every row asks for its first matches, at most ``pairs_per_row`` from a tile or bucket. What they decide is settled. Rows whose matches so far all
    follow somebody, and may go on, ask again, now only among rows not known to follow: each turn settles at least the first open row.
    """
    most = max(1, int(pairs_per_row))
    slim = cut(reps.select("_place", "document_number", "normalized_title", "_day", _codes(q)(F.col("normalized_title")).alias("_grams")))
    everyone = slim.select(F.col("_place").alias("_ord"))
    edges = neighbours(slim.withColumn("_asks", F.lit(True)), threshold, q, most)
    known = cut(settle(everyone, edges))
    while True:
        # What open rows still look at: heads that lead, are open or not known yet.
        follows = known.filter("NOT is_leader").select(F.col("_ord").alias("h__ord"))
        looks = cut(edges.join(known.select("_ord"), "_ord", "left_anti").join(follows, "h__ord", "left_anti"))
        asking = cut(looks.groupBy("_ord").agg(F.bool_and(F.col("h__ord") < 0).alias("_asks")).filter("_asks"))
        if asking.isEmpty():
            break
        pool = slim.join(follows.withColumnRenamed("h__ord", "_place"), "_place", "left_anti").join(asking.withColumnRenamed("_ord", "_place"), "_place", "left")
        more = neighbours(pool.withColumn("_asks", F.coalesce("_asks", F.lit(False))), threshold, q, most)
        answered = asking.select("_ord", (-1 - F.col("_ord")).alias("h__ord"))
        edges = cut(edges.join(answered, ["_ord", "h__ord"], "left_anti").unionByName(more))
        waits = looks.join(answered, ["_ord", "h__ord"], "left_anti").unionByName(more)
        rows = everyone.join(follows.withColumnRenamed("h__ord", "_ord"), "_ord", "left_anti")
        late = settle(rows, waits).join(known.select("_ord"), "_ord", "left_anti")
        known = cut(known.unionByName(late))
    heads = known.filter("is_leader").select(F.col("_ord").alias("h__ord"))
    best = edges.join(heads, "h__ord", "left_semi").groupBy("_ord").agg(F.min("h__ord").alias("_best"))
    return everyone.join(best, "_ord", "left").select(F.col("_ord").alias("_place"), F.coalesce("_best", "_ord").alias("_leads"))


def settle(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Leaders of an ordered match graph: a row leads when no earlier neighbour leads.

    A round settles every row whose earlier neighbours are all settled, or that has an earlier neighbour known to lead. Then chains are
    contracted: a row with one open neighbour leads exactly when that one doesn't, so it points to it with a sign; pointers of pointers are
    followed by doubling, and everybody who asks for such a row asks for the chain's end with that sign instead. A chain of n rows
    thus takes as many steps as log n, not n rounds. A row that asks for one end with both signs has a leader before it.
    Heads that are no rows stay unknown, and rows that depend on them are left out.
    """
    open_edges = cut(edges.select("_ord", "h__ord").distinct().withColumn("flip", F.lit(False)))
    fresh = cut(rows.join(open_edges.select("_ord").distinct(), "_ord", "left_anti").withColumn("is_leader", F.lit(True)))
    settled = fresh
    while not open_edges.isEmpty():
        known = fresh.withColumnsRenamed({"_ord": "h__ord", "is_leader": "_leads"})
        asked = open_edges.groupBy("_ord", "h__ord").agg(F.bool_or("flip").alias("flip"), F.bool_and("flip").alias("_all")).join(known, "h__ord", "left")
        asked = cut(asked.withColumn("_holds", F.when(F.col("flip") != F.col("_all"), True).otherwise(F.col("_leads") != F.col("flip"))).drop("_leads", "_all"))
        view = asked.groupBy("_ord").agg(F.coalesce(F.bool_or("_holds"), F.lit(False)).alias("covered"), F.bool_and(F.col("_holds").isNotNull()).alias("all_known"))
        fresh = cut(view.filter("covered or all_known").select("_ord", (~F.col("covered")).alias("is_leader")))
        settled = settled.unionByName(fresh)
        rest = cut(asked.filter("_holds IS NULL").select("_ord", "h__ord", "flip").join(fresh, "_ord", "left_anti"))
        single = rest.groupBy("_ord").agg(F.count("*").alias("n"), F.min("h__ord").alias("to"), F.bool_and("flip").alias("flip")).filter("n = 1")
        ends = cut(single.select("_ord", "to", (~F.col("flip")).alias("sign")))  # leads(row) = leads(to) or its opposite
        moved = not ends.isEmpty()
        while moved:
            on = ends.select(F.col("_ord").alias("to"), F.col("to").alias("_next"), F.col("sign").alias("_more"))
            step = cut(ends.join(on, "to", "left").select("_ord", F.coalesce("_next", "to").alias("to"), (F.col("sign") != F.coalesce("_more", F.lit(False))).alias("sign"), F.col("_next").isNotNull().alias("_moved")))
            moved = not step.filter("_moved").isEmpty()
            ends = step.drop("_moved")
        heads = ends.select(F.col("_ord").alias("h__ord"), "to", "sign")
        moved = rest.join(heads, "h__ord", "left").select("_ord", F.coalesce("to", "h__ord").alias("h__ord"), (F.col("flip") != F.coalesce("sign", F.lit(False))).alias("flip"), F.col("to").isNotNull().alias("_new"))
        open_edges = cut(moved.groupBy("_ord", "h__ord", "flip").agg(F.bool_or("_new").alias("_new")))
        if fresh.isEmpty() and open_edges.filter("_new").isEmpty():
            break
        open_edges = open_edges.drop("_new")
    return settled


def assign(records: DataFrame, threshold: float = 0.90, q: int = 2, **options) -> DataFrame:
    """Every record with ``_ord`` and the ``_leader`` order of its group."""
    ranked = primary_rank(records).withColumns(
        {
            "_day": F.substring(T.text_or_empty(F.col("published_date")), 1, 10),
            "document_number": T.text_or_empty(F.col("document_number")),
            "normalized_title": T.text_or_empty(F.col("normalized_title")),
        }
    )
    signature = ["document_number", "normalized_title", "_day"]
    nameless = (F.col("document_number") == "") & (F.col("normalized_title") == "")
    named = ranked.filter(~nameless)
    reps = placed_representatives(named)
    leaders = assign_leaders(reps, threshold, q, **options)
    orders = reps.select(F.col("_place").alias("_leads"), F.col("_ord").alias("_leader"))
    by_signature = reps.join(leaders, "_place").join(orders, "_leads").select(*signature, "_leader")
    placed = named.join(by_signature, signature)
    # Rows without number and title match nothing and lead themselves.
    return placed.unionByName(ranked.filter(nameless).withColumn("_leader", F.col("_ord")))


def collapse(records: DataFrame, threshold: float = 0.90, q: int = 2, **options) -> tuple[DataFrame, DataFrame]:
    """(primary records with ``duplicate_count``, related materials in long form).

    The primary of a group is its best record by quality, path, summary length and version.
    Related materials stay rows keyed by ``primary_url``: a group may hold a third of all rows,
    too many for one array.
    """
    placed = cut(assign(records, threshold, q, **options))
    # Same rank as inside the order, without the day.
    rank = F.struct(*[F.col("_ord")[f] for f in ("quality", "path", "length", "version")], F.col("_ord"))
    best = placed.groupBy("_leader").agg(F.min(rank).alias("_rank"), F.count_if(T.text_or_empty(F.col("url")) != "").alias("_linked"))
    best = best.select("_leader", F.col("_rank")["_ord"].alias("_primary"), "_linked")
    joined = placed.join(best, "_leader")
    is_primary = F.col("_ord") == F.col("_primary")
    own_link = F.when(T.text_or_empty(F.col("url")) != "", 1).otherwise(0)
    primaries = joined.filter(is_primary).withColumn("duplicate_count", (F.col("_linked") - own_link).cast("int"))
    helper = [c for c in primaries.columns if c.startswith("_")]
    related = joined.filter(~is_primary & (T.text_or_empty(F.col("url")) != "")).select(
        F.col("_primary")["tie"].alias("primary_url"),
        "title",
        T.first_text(F.col("publisher"), F.col("source_name")).alias("publisher") if "source_name" in joined.columns else F.col("publisher"),
        "url",
    )
    return primaries.drop(*helper), related
