"""The versioned archive: upsert by canonical URL, history, statistics, manifest."""

from __future__ import annotations

from posixpath import commonprefix

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import NumericType, StringType, TimestampNTZType, TimestampType

from greenledger.functions import text as T
from greenledger.functions.scoring import with_columns_present
from greenledger.operators.chunked import with_previous, with_running_sum
from greenledger.session import written

IDENTITY = ("url", "canonical_url", "title", "summary", "content_hash", "publisher", "published_date", "first_seen", "last_seen")


def keyed(df: DataFrame, hashed: bool = True) -> DataFrame:
    """Rows with a canonical URL, a URL and, if ``hashed``, a content hash; rows without any URL are left out.

    Stored rows are not hashed anew: a stored row without a hash differs from whatever arrives.
    """
    df = with_columns_present(df, IDENTITY)
    # The test runs on the raw columns: a filter on the key would compute the key twice.
    given = F.length(F.concat(T.collapse_space(F.col("canonical_url")), T.collapse_space(F.col("url")))) > 0
    df = df.filter(given).withColumn("canonical_url", T.canonical_url(T.first_text(T.collapse_space(F.col("canonical_url")), F.col("url"))))
    recipe = T.sha_hex(F.col("title"), F.col("summary"), F.col("canonical_url"))
    return df.withColumns(
        {
            "url": T.first_text(F.col("url"), F.col("canonical_url")),
            "content_hash": F.coalesce(F.col("content_hash"), recipe) if hashed else F.col("content_hash").cast("string"),
        }
    )


def with_identity(df: DataFrame) -> DataFrame:
    """Stored rows with every identifying column, absent ones null."""
    return with_columns_present(df, IDENTITY)


def version_history(log: DataFrame, key: str, chunk: str, order: list[Column], value: str) -> DataFrame:
    """For each row of a snapshot log: the hash before it, whether it changed, and the version it belongs to."""
    seen = with_previous(log, key, chunk, order, value, "previous_content_hash")
    seen = seen.withColumn("changed", ~F.col("previous_content_hash").eqNullSafe(F.col(value)))
    counted = seen.withColumn("_bump", F.col("changed").cast("int"))
    return with_running_sum(counted, key, chunk, order, "_bump", "version").drop("_bump")


def merge_log(existing: DataFrame, incoming: DataFrame, as_of: Column, arrival: str | None = None) -> DataFrame:
    """Existing rows and incoming rows as one ordered log with the action each incoming row takes.

    ``arrival`` orders several incoming versions of one URL; without it ``first_seen`` does.
    """
    return _merge_log(keyed(existing, hashed=False), keyed(incoming), as_of, arrival)


def _piece(order: DataFrame, by: Column) -> Column:
    """A coarser value that follows the order of ``by``: the hour of a time, the day and hour of a text's date, 3600 numbers."""
    kind = order.select(by).schema[0].dataType
    if isinstance(kind, NumericType):
        return F.floor(by / 3600)
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.date_trunc("hour", by)
    return F.substring(by, 1, 13) if isinstance(kind, StringType) else by


def _sides(existing: DataFrame, incoming: DataFrame, as_of: Column, arrival: str | None, dated: bool) -> tuple[DataFrame, DataFrame]:
    """Stored and arriving rows with their ``_side`` and their place ``_at`` among the rows of a URL."""
    old = with_columns_present(existing, ("version_count",), "int").withColumn("_side", F.lit(0))
    new = with_columns_present(incoming, ("version_count",), "int").withColumn("_side", F.lit(1))
    order_by = arrival or "first_seen"
    at = lambda df, side: F.struct(F.lit(side).alias("side"), F.col(order_by).alias("at"), F.col("content_hash").alias("tie"))
    old, new = old.withColumn("_at", at(old, 0)), new.withColumn("_at", at(new, 1))
    new = new.withColumn("first_seen", F.coalesce(F.col("first_seen"), as_of))
    if not dated:
        new = new.withColumns({"last_seen": as_of, "version_count": F.lit(None).cast("int")})
    return old, new


def _merge_log(existing: DataFrame, incoming: DataFrame, as_of: Column, arrival: str | None, dated: bool = False) -> DataFrame:
    """``dated``: arriving rows keep their own last_seen and, where the URL is new, their version."""
    old, new = _sides(existing, incoming, as_of, arrival, dated)
    # Several existing rows of one URL: the last one wins.
    keep = old.groupBy("canonical_url").agg(F.max_by(F.struct(*old.columns), F.col("_at")).alias("row")).select("row.*")
    log = keep.unionByName(new, allowMissingColumns=True).withColumn("_hash", T.text_or_empty(F.col("content_hash")))
    # Pieces that follow the order cut a hot URL.
    log = log.withColumn("_chunk", F.struct(F.col("_side"), _piece(log, F.col("_at.at")).alias("at")))
    log = with_previous(log, "canonical_url", "_chunk", [F.col("_at")], "_hash", "_before")
    action = (
        F.when(F.col("_side") == 0, "kept")
        .when(F.col("_before").isNull(), "added")
        .when(F.col("_before") != F.col("_hash"), "updated")
        .otherwise("unchanged")
    )
    log = log.withColumn("action", action).withColumn("_before", F.nullif("_before", F.lit("")))
    if dated:
        seen = F.when(F.col("action") == "added", F.coalesce("last_seen", "first_seen")).when(F.col("action") == "updated", F.coalesce(F.col("last_seen"), as_of))
        is_old, is_new = F.col("_side") == 0, F.col("action") == "added"
        log = log.withColumns({
            "last_seen": F.when(is_old, F.col("last_seen")).otherwise(seen), "version_count": F.when(is_old | is_new, F.col("version_count")),
            "publisher": F.when(F.col("action") != "unchanged", F.col("publisher")),
        })
    return log


def merge(existing: DataFrame, incoming: DataFrame, as_of: Column, arrival: str | None = None, max_records: int | None = None) -> DataFrame:
    """Versioned upsert by canonical URL.

    New URL: version 1. Changed hash: the new row over the old one, first_seen kept, version
    raised, the old hash remembered. Same hash: only last_seen and publisher move on. A null in
    the new row keeps the old value.
    """
    merged = merge_keyed(keyed(existing, hashed=False), keyed(incoming), as_of, arrival)
    return merged if max_records is None else newest(merged, max_records)


def merge_keyed(existing: DataFrame, incoming: DataFrame, as_of: Column, arrival: str | None = None) -> DataFrame:
    """``merge`` for rows that have been through ``keyed`` already."""
    return _merged(existing, incoming, as_of, arrival)


def _merged(existing: DataFrame, incoming: DataFrame, as_of: Column, arrival: str | None, dated: bool = False) -> DataFrame:
    """URLs with at most one arriving row are settled in one grouping; the log is made for the others alone, if there are any."""
    single = _settled(_pairs(existing, incoming, as_of, arrival, dated), as_of, dated)
    crowded = _crowded(existing, incoming)
    return single if crowded is None else single.unionByName(_fold(_merge_log(*crowded, as_of, arrival, dated)))


def _crowded(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Both sides' rows of the URLs with several arriving rows."""
    urls = incoming.groupBy("canonical_url").agg(F.count("*").alias("_n")).filter("_n > 1").select("canonical_url")
    return None if urls.isEmpty() else tuple(df.join(urls, "canonical_url", "left_semi") for df in (existing, incoming))


def _pairs(existing: DataFrame, incoming: DataFrame, as_of: Column, arrival: str | None, dated: bool) -> DataFrame:
    """The stored row ``o`` and the arriving row ``n`` of each URL with at most one arriving row, and the action that row takes."""
    old, new = _sides(existing, incoming, as_of, arrival, dated)
    rows = old.unionByName(new, allowMissingColumns=True)
    row = F.struct(*[c for c in rows.columns if c not in ("canonical_url", "_side", "_at")])
    last = lambda side: F.max_by(row, F.when(F.col("_side") == side, F.col("_at")))
    pairs = rows.groupBy("canonical_url").agg(last(0).alias("o"), last(1).alias("n"), F.sum("_side").alias("_n")).filter("_n <= 1").drop("_n")
    before, after = (T.text_or_empty(F.col(side)["content_hash"]) for side in "on")
    action = F.when(F.col("n").isNull(), "kept").when(F.col("o").isNull(), "added").when(before != after, "updated").otherwise("unchanged")
    return pairs.withColumn("action", action)


def _settled(pairs: DataFrame, as_of: Column, dated: bool) -> DataFrame:
    """What ``_fold`` makes of the log of one stored and one arriving row."""
    o, n, action = F.col("o"), F.col("n"), F.col("action")
    written, updated = action != "unchanged", action == "updated"
    last_seen, version, publisher = n["last_seen"], n["version_count"], n["publisher"]
    if dated:
        last_seen = F.when(action == "added", F.coalesce(n["last_seen"], n["first_seen"])).when(updated, F.coalesce(n["last_seen"], as_of))
        version, publisher = F.when(action == "added", version), F.when(written, publisher)
    names = pairs.schema["o"].dataType.names
    known_before = o["previous_content_hash"] if "previous_content_hash" in names else F.lit(None).cast("string")
    return pairs.select(
        "canonical_url",
        *[F.coalesce(F.when(written, n[c]), o[c]).alias(c) for c in _carried(names)],
        F.coalesce(publisher, o["publisher"]).alias("publisher"),
        F.coalesce(o["first_seen"], n["first_seen"]).alias("first_seen"),
        F.coalesce(last_seen, o["last_seen"]).alias("last_seen"),
        (F.coalesce(F.greatest(o["version_count"], version), F.lit(1)) + updated.cast("int")).cast("int").alias("version_count"),
        F.coalesce(F.when(updated, T.blank_to_null(T.text_or_empty(o["content_hash"]))), known_before).alias("previous_content_hash"),
    )


def _carried(names: list[str]) -> list[str]:
    """Columns whose last written value stands."""
    return [c for c in names if not c.startswith("_") and c not in ("canonical_url", "action", "version_count", "first_seen", "last_seen", "publisher", "previous_content_hash")]


# --- the newest rows ---------------------------------------------------------

RANKED = 10_000  # tied rows at the border that one task may rank


def newest(archive: DataFrame, records: int, url: str = "canonical_url") -> DataFrame:
    """The first ``records`` rows in archive order: published date, then first sight, both downwards with missing ones last, then URL.

    No task sorts the archive. A histogram of dates says which dates are in whole and on which date the cut falls; on that date alone
    a histogram of hours of first sight says the same, then one of the sights within that hour, then ones of the three characters of the URL behind
    those that all tied rows share. It ends when the border falls between two values, or so few rows tie there that they are ranked. Rows with
    one URL go by their whole content. The archive is computed once, into a table that the levels and the result read.
    """
    if records <= 0:
        return archive.limit(0)
    archive = written(archive)
    seen = F.col("first_seen").cast("string")
    levels = [(F.col("published_date").cast("string"), True), (F.substring(seen, 1, 13), True), (seen, True)]
    inside, tied, left, rows = F.lit(False), F.lit(True), records, None
    while rows is None or rows > RANKED:
        value, down = levels.pop(0) if levels else (_behind_shared(archive.filter(tied), url), False)
        if value is None:
            break
        held = archive.filter(tied).groupBy(value.alias("v")).agg(F.count("*").alias("n"))
        spot = F.desc_nulls_last("v") if down else F.asc_nulls_last("v")
        border = held.withColumn("run", F.sum("n").over(W.orderBy(spot))).filter(F.col("run") >= left).orderBy("run").first()
        if border is None:
            return archive  # fewer rows than asked for, seen at the first level
        edge = F.lit(border["v"]).cast("string")
        before = F.coalesce(value > edge if down else value < edge, value.isNotNull() & edge.isNull())
        inside, tied = inside | (tied & before), tied & value.eqNullSafe(edge)
        left, rows = left - (border["run"] - border["n"]), border["n"]
        if left == rows:
            return archive.filter(inside | tied)
    order = [F.desc_nulls_last("published_date"), F.desc_nulls_last("first_seen"), F.asc_nulls_last(url), F.xxhash64(*archive.columns)]
    last = archive.filter(tied).withColumn("_place", F.row_number().over(W.orderBy(*order))).filter(F.col("_place") <= left).drop("_place")
    return archive.filter(inside).unionByName(last)


def _behind_shared(rows: DataFrame, url: str, step: int = 3) -> Column | None:
    """The characters of the URL behind those that all rows share; none if the rows have one URL."""
    ends = rows.agg(F.min(url).alias("low"), F.max(url).alias("high"), F.count_if(F.col(url).isNull()).alias("missing")).first()
    if ends["low"] == ends["high"] and (ends["low"] is None or not ends["missing"]):
        return None
    return F.substring(url, len(commonprefix([ends["low"], ends["high"]])) + 1, step)


def _fold(log: DataFrame) -> DataFrame:
    """One row per URL from its ordered log."""
    written = F.col("action") != "unchanged"
    latest = [F.max_by(F.col(c), F.when(written & F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in _carried(log.columns)]
    updated = F.col("action") == "updated"
    known_before = (
        F.max(F.when(F.col("_side") == 0, F.col("previous_content_hash")))
        if "previous_content_hash" in log.columns
        else F.lit(None).cast("string")
    )
    return log.groupBy("canonical_url").agg(
        *latest,
        F.max_by(F.col("publisher"), F.when(F.col("publisher").isNotNull(), F.col("_at"))).alias("publisher"),
        F.min_by(F.col("first_seen"), F.when(F.col("first_seen").isNotNull(), F.col("_at"))).alias("first_seen"),
        F.max_by(F.col("last_seen"), F.when(F.col("last_seen").isNotNull(), F.col("_at"))).alias("last_seen"),
        (F.coalesce(F.max("version_count"), F.lit(1)) + F.count_if(updated)).cast("int").alias("version_count"),
        F.coalesce(F.max_by(F.col("_before"), F.when(updated, F.col("_at"))), known_before).alias("previous_content_hash"),
    )


def merge_stats(existing: DataFrame, incoming: DataFrame, as_of: Column, arrival: str | None = None) -> DataFrame:
    needed = list(dict.fromkeys(["canonical_url", "content_hash", "first_seen", arrival or "first_seen"]))
    sides = keyed(existing, hashed=False).select(*needed), keyed(incoming).select(*needed)
    acts = [F.count_if(F.col("action") == a).alias(a) for a in ("added", "updated", "unchanged")]
    single = _pairs(*sides, as_of, arrival, False).agg(*acts, F.count("*").alias("total"))
    crowded = _crowded(*sides)
    if crowded is None:
        return single
    several = _merge_log(*crowded, as_of, arrival).agg(*acts, F.count_if(F.col("action").isin("kept", "added")).alias("total"))
    return single.unionByName(several).agg(*[F.sum(c).alias(c) for c in single.columns])


def overlay_seeds(archive: DataFrame, seeds: DataFrame, as_of: Column) -> DataFrame:
    """Reviewed seed rows over the archive; a seed with the same hash leaves its row untouched.

    A seed's own last_seen stays, else a new one takes its first_seen and a changed one ``as_of``; a new seed
    keeps its version.
    """
    return _merged(keyed(archive, hashed=False), keyed(seeds), as_of, None, dated=True)


def with_fallback(archive: DataFrame, seeds: DataFrame) -> DataFrame:
    """The seeds when the archive is empty."""
    return seeds if archive.isEmpty() else archive


def manifest(archive: DataFrame) -> DataFrame:
    """Row count, latest date and one digest of all (URL, hash) pairs.

    The digest adds the hashes of the pairs, so it needs no sorted copy of the archive in one place; ``ordered_digest`` also tells
    orders apart.
    """
    pair = F.sha2(F.concat_ws("|", T.text_or_empty(F.col("canonical_url")), T.text_or_empty(F.col("content_hash"))), 256)
    parts = [F.conv(F.substring(pair, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = [F.coalesce(F.sum(p), F.lit(0)).cast("string") for p in parts]
    return archive.agg(
        F.count("*").alias("record_count"),
        F.max("published_date").alias("latest_published_date"),
        F.sha2(F.concat_ws("|", *sums), 256).alias("content_digest"),
    )


# --- the ordered digest --------------------------------------------------------

PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)  # four remainders of about 31 bits each
BASES = (1103515245, 1597463007, 1812433253, 1664525023)
AT_ONCE = 4096


def _run_of(pairs: np.ndarray, powers: np.ndarray) -> list[int]:
    """The digest of a run of rows: the sum of h(i) * base^(n - i), by remainder. ``pairs``: rows x 4 numbers below 2^28."""
    return [int((pairs[:, k] * powers[len(pairs) - 1 :: -1, k][: len(pairs)] % p).sum() % p) for k, p in enumerate(PRIMES)]


def _after(left: tuple[int, list[int]], right: tuple[int, list[int]]) -> tuple[int, list[int]]:
    """Length and digest of two neighbouring runs."""
    return left[0] + right[0], [(a * pow(b, right[0], p) + c) % p for a, c, b, p in zip(left[1], right[1], BASES, PRIMES)]


def _fold_range(batches):
    powers = np.ones((AT_ONCE, len(PRIMES)), np.int64)
    for i in range(1, AT_ONCE):
        powers[i] = powers[i - 1] * BASES % PRIMES
    total = 0, [0] * len(PRIMES)
    for batch in batches:
        pairs = np.column_stack([batch.column(f"h{k}").to_numpy() for k in range(len(PRIMES))])
        for lo in range(0, len(pairs), AT_ONCE):
            part = pairs[lo : lo + AT_ONCE]
            total = _after(total, (len(part), _run_of(part, powers)))
    yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "n": total[0], "run": total[1]}], RANGES)


RANGES = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("run", pa.list_(pa.int64()))])


def _join_ranges(batches):
    total = 0, [0] * len(PRIMES)
    for batch in batches:
        for row in batch.to_pylist():
            total = _after(total, (row["n"], row["run"]))
    yield pa.RecordBatch.from_pylist([{"rows": total[0], "run": total[1]}], pa.schema([("rows", pa.int64()), ("run", pa.list_(pa.int64()))]))


def ordered_digest(rows: DataFrame, order: list[Column], url: str = "canonical_url", content: str = "content_hash") -> DataFrame:
    """Number of rows and one digest of their (URL, hash) pairs in the given order, whatever the partitioning.

    Rows are dealt to tasks by ranges of the order and folded where they lie; a range gives its length and four remainders, and two
    neighbouring ranges are joined by a rule that doesn't show where they were cut, so one short row per range is all that meets. Two
    rows that change places change the digest. ``order`` must tell rows with different pairs apart. It shows changes; it is no proof against
    a forger. No rows: length 0.
    """
    pair = F.sha2(F.concat_ws("|", T.text_or_empty(F.col(url)), T.text_or_empty(F.col(content))), 256)
    places = [F.conv(F.substring(pair, 1 + 7 * k, 7), 16, 10).cast("long").alias(f"h{k}") for k in range(len(PRIMES))]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*places)
    ranges = ranged.mapInArrow(_fold_range, "part int, n long, run array<long>")
    none = rows.sparkSession.range(1).select(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("n"), F.array(*[F.lit(0).cast("long")] * len(PRIMES)).alias("run"))
    whole = ranges.unionByName(none).repartition(1).sortWithinPartitions("part").mapInArrow(_join_ranges, "rows long, run array<long>")
    spelled = F.concat_ws("|", F.col("rows").cast("string"), F.transform("run", lambda x: x.cast("string")))
    return whole.select("rows", F.sha2(spelled, 256).alias("ordered_digest"))


def manifest_counts(archive: DataFrame) -> DataFrame:
    """Topic and publisher counts, largest first, then by name."""
    archive = with_columns_present(archive, ("topic", "publisher", "source_name"))
    topic = T.first_text(F.col("topic"), F.lit("未分类"))
    source = T.first_text(F.col("publisher"), F.col("source_name"), F.lit("未知来源"))
    named = archive.select(topic.alias("topic"), source.alias("source"))
    counted = named.groupingSets([["topic"], ["source"]], "topic", "source").agg(
        F.count("*").alias("value"), F.grouping("topic").alias("_no_topic")
    )
    kind = F.when(F.col("_no_topic") == 0, "topic").otherwise("source")
    return counted.select(kind.alias("kind"), F.coalesce("topic", "source").alias("name"), "value").orderBy("kind", F.desc("value"), "name")
