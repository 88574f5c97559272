"""Archive, health and duplicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from greenledger import rules
from greenledger.bindings.registry import q, query, table
from greenledger.bindings.text import SQL_DOCS, doc_records, sql_norm
from greenledger.functions import text as T
from greenledger.operators import archive as A, dedup as D, health as H
from greenledger.session import cut
from greenledger.sources import pages as PG, readers

NOW = "2001-12-31"


def snapshots(spark, d):
    """Orders as two snapshots of one archive.

    Finished and pending orders are archived. Pending and open ones arrive; a pending order that
    is urgent arrives changed.
    """
    o = table(spark, d, "orders")
    key = F.col("o_orderkey").cast("string")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    common = dict(title=F.concat(F.lit("Order "), key), published_date=day, publisher=F.col("o_orderpriority"))
    old = o.filter(F.col("o_orderstatus") != "O").select(
        F.concat(F.lit("http://Orders.example.com//o/"), key, F.lit("/?utm_source=mail")).alias("url"), *[c.alias(n) for n, c in common.items()],
        F.lit("plain").alias("summary"), day.alias("first_seen"), day.alias("last_seen"),
        T.sha_hex(common["title"], F.lit("plain"), F.concat(F.lit("https://orders.example.com/o/"), key)).alias("content_hash"),
    )
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderstatus") == "P")
    new = o.filter(F.col("o_orderstatus") != "F").select(
        F.concat(F.lit("https://orders.example.com/o/"), key, F.lit("#top")).alias("url"), *[c.alias(n) for n, c in common.items()],
        F.when(urgent, "changed").otherwise("plain").alias("summary"),
    )
    return old, new


SQL_MERGE = f"""k AS (SELECT *, 'https://orders.example.com/o/' || o_orderkey AS u, strftime(o_orderdate, '%Y-%m-%d') AS day,
  o_orderstatus = 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_changed FROM orders),
h AS (SELECT *, sha256('Order ' || o_orderkey || '|plain|' || u) AS plain_hash, sha256('Order ' || o_orderkey || '|changed|' || u) AS changed_hash FROM k),
m AS (SELECT u AS canonical_url, CASE WHEN is_changed THEN changed_hash ELSE plain_hash END AS content_hash, CASE WHEN is_changed THEN plain_hash END AS previous_content_hash,
  CASE WHEN is_changed THEN 2 ELSE 1 END AS version_count, CASE WHEN o_orderstatus = 'O' THEN '{NOW}' ELSE day END AS first_seen,
  CASE WHEN o_orderstatus = 'F' THEN day ELSE '{NOW}' END AS last_seen, day AS published_date, o_orderpriority AS publisher,
  CASE WHEN is_changed THEN 'changed' ELSE 'plain' END AS summary, is_changed, o_orderstatus FROM h)"""


@query("archive_merge", f"WITH {SQL_MERGE} SELECT canonical_url, content_hash, previous_content_hash, version_count, first_seen, last_seen, published_date, publisher, summary FROM m")
def archive_merge(spark, d):
    old, new = snapshots(spark, d)
    return A.merge(old, new, F.lit(NOW)).select("canonical_url", "content_hash", "previous_content_hash", "version_count", "first_seen", "last_seen", "published_date", "publisher", "summary")


@query("merge_stats", f"""WITH {SQL_MERGE} SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS added, count(*) FILTER (WHERE is_changed) AS updated,
  count(*) FILTER (WHERE o_orderstatus = 'P' AND NOT is_changed) AS unchanged, count(*) AS total FROM m""")
def merge_stats(spark, d):
    old, new = snapshots(spark, d)
    return A.merge_stats(old, new, F.lit(NOW))


NEWEST = 700


@query("archive_newest", f"WITH {SQL_MERGE} SELECT canonical_url, published_date, first_seen, version_count FROM m ORDER BY published_date DESC, first_seen DESC, canonical_url LIMIT {NEWEST}")
def archive_newest(spark, d):
    """The archive under its cap on records."""
    old, new = snapshots(spark, d)
    return A.merge(old, new, F.lit(NOW), max_records=NEWEST).select("canonical_url", "published_date", "first_seen", "version_count")


@query("seed_overlay", f"""WITH {SQL_MERGE} SELECT canonical_url, content_hash, version_count, CASE WHEN o_orderstatus = 'P' AND NOT is_changed THEN published_date ELSE last_seen END AS last_seen FROM m""")
def seed_overlay(spark, d):
    old, new = snapshots(spark, d)
    return A.overlay_seeds(A.with_fallback(old, new), new, F.lit(NOW)).select("canonical_url", "content_hash", "version_count", "last_seen")


@query("version_history", """WITH l AS (SELECT event_id, user_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
c AS (SELECT *, prev IS DISTINCT FROM event_type AS changed FROM l)
SELECT event_id, user_id, prev AS previous_content_hash, changed, CAST(sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS version FROM c""")
def version_history(spark, d):
    log = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", F.date_trunc("hour", "ts").alias("hour"))
    seen = A.version_history(log, "user_id", "hour", [F.col("ts"), F.col("event_id")], "event_type")
    return seen.select("event_id", "user_id", "previous_content_hash", "changed", "version")


@query("archive_scan", """SELECT event_id, event_type, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events WHERE event_type IN ('click', 'purchase')""")
def archive_scan(spark, d):
    t, p = F.col("event_type"), F.col("props")
    line = F.when(t == "click", p).when(t == "purchase", F.concat(F.lit("﻿"), p, F.lit("  "))).when(t == "view", F.substring(p, 1, 4)).when(t == "signup", F.concat(F.lit("["), p, F.lit("]"))).otherwise(" ")
    lines = table(spark, d, "events").select("event_id", "event_type", line.alias("line"))
    return readers.parse_lines(lines, "line", "k bigint", keep=["event_id", "event_type"])


_bits = [f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR)" for i in range(4)]


@query("archive_manifest", f"""WITH {SQL_DOCS}, p AS (SELECT sha256(url || '|' || sha256(title || '|' || summary || '|' || url)) AS h, published_date FROM docs)
SELECT count(*) AS record_count, max(published_date) AS latest_published_date, sha256({" || '|' || ".join(_bits)}) AS content_digest FROM p""")
def archive_manifest(spark, d):
    return A.manifest(A.keyed(doc_records(spark, d)))


_remainders = [f"list_reduce(list(CAST('0x' || substr(h, {1 + 7 * k}, 7) AS BIGINT) ORDER BY published_date DESC, url), lambda acc, x: (acc * {b} + x) % {p})" for k, (b, p) in enumerate(zip(A.BASES, A.PRIMES))]


@query("archive_ordered_digest", f"""WITH {SQL_DOCS}, p AS (SELECT url, published_date, sha256(url || '|' || sha256(title || '|' || summary || '|' || url)) AS h FROM docs)
SELECT count(*) AS "rows", sha256(count(*) || '|' || {" || '|' || ".join(_remainders)}) AS ordered_digest FROM p""")
def archive_ordered_digest(spark, d):
    """The digest of the archive in its order: date downwards, then URL."""
    rows = A.keyed(doc_records(spark, d)).select("canonical_url", "content_hash", "published_date")
    return A.ordered_digest(rows, [F.desc("published_date"), F.asc("canonical_url")])


@query("manifest_counts", """SELECT 'topic' AS kind, lang AS name, count(*) AS value FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source""")
def manifest_counts(spark, d):
    return A.manifest_counts(table(spark, d, "documents").select(F.col("lang").alias("topic"), F.col("source").alias("publisher")))


# --- health -------------------------------------------------------------------

def attempts(spark, d):
    """Events as attempts of a source: an error is a failure. Two types give runs that reach quarantine."""
    ok = F.col("event_type").isin("purchase")
    return table(spark, d, "events").select(F.col("user_id").alias("source_id"), "ts", "event_id", ok.alias("ok"))


SQL_HEALTH = """a AS (SELECT user_id AS source_id, ts, event_id, event_type = 'purchase' AS ok FROM events),
i AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY ts, event_id) AS island FROM a),
r AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY source_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS fails,
  row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, event_id DESC) AS back FROM i),
log AS (SELECT *, CASE WHEN ok THEN 'healthy' WHEN fails >= 7 THEN 'quarantined' WHEN fails >= 3 THEN 'watch' ELSE 'failed' END AS status FROM r),
state AS (SELECT source_id, max(status) FILTER (WHERE back = 1) AS status, CAST(max(fails) FILTER (WHERE back = 1) AS BIGINT) AS consecutive_failures,
  max(ts) AS last_attempt, max(ts) FILTER (WHERE ok) AS last_success, count(*) AS attempts FROM log GROUP BY source_id)"""


@query("source_health_log", f"WITH {SQL_HEALTH} SELECT event_id, source_id, status, CAST(fails AS BIGINT) AS consecutive_failures FROM log")
def source_health_log(spark, d):
    log = H.health_log(attempts(spark, d), "source_id", "ts", "ok", "event_id")
    return log.select("event_id", "source_id", "status", F.col("consecutive_failures").cast("long").alias("consecutive_failures"))


def _state(spark, d):
    return H.health_state(attempts(spark, d), "source_id", "ts", "ok", "event_id")


@query("source_health_state", f"WITH {SQL_HEALTH} SELECT source_id, status, consecutive_failures, strftime(last_attempt, '%Y-%m-%d %H:%M:%S') AS last_attempt, strftime(last_success, '%Y-%m-%d %H:%M:%S') AS last_success, attempts FROM state")
def source_health_state(spark, d):
    spell = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return _state(spark, d).select("source_id", "status", F.col("consecutive_failures").cast("long").alias("consecutive_failures"), spell("last_attempt"), spell("last_success"), "attempts")


@query("source_health_detail", f"""WITH {SQL_HEALTH}, b AS (SELECT user_id AS source_id, event_id, props, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events)
SELECT source_id, status, CAST(trunc(value) AS BIGINT) AS last_record_count, CASE WHEN status = 'healthy' THEN '' ELSE props END AS last_error, 'https://s.example/' || source_id AS start_url, 'Source ' || source_id AS source_name
FROM state JOIN b USING (source_id) WHERE back = 1""")
def source_health_detail(spark, d):
    """What the last attempt of each source left: records, error, start address."""
    e = table(spark, d, "events")
    about = e.select("event_id", F.col("value").cast("long").alias("records"), F.when(F.col("event_type") == "purchase", "").otherwise(F.col("props")).alias("error"),
                     F.concat(F.lit("https://s.example/"), F.col("user_id").cast("string")).alias("start_url"), F.concat(F.lit("Source "), F.col("user_id").cast("string")).alias("source_name"))
    state = H.health_state(attempts(spark, d).join(about, "event_id"), "source_id", "ts", "ok", "event_id")
    return state.select("source_id", "status", "last_record_count", "last_error", "start_url", "source_name")


@query("health_rows", f"WITH {SQL_HEALTH} SELECT coalesce(status, '') AS status, c_name AS source_name, coalesce(consecutive_failures, 0) AS consecutive_failures FROM customer LEFT JOIN state ON source_id = c_custkey ORDER BY 1, 2")
def health_rows(spark, d):
    """The table of sources by status and name."""
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("source_name"))
    rows = H.health_rows(names.join(_state(spark, d), "source_id", "left"))
    return rows.select(F.coalesce("status", F.lit("")).alias("status"), "source_name", F.coalesce("consecutive_failures", F.lit(0)).cast("long").alias("consecutive_failures"))


@query("source_due", f"""WITH {SQL_HEALTH} SELECT c_custkey AS source_id, coalesce(status, 'none') AS status, NOT (coalesce(status, '') = 'quarantined' AND date_diff('day', CAST(last_attempt AS DATE), DATE '2024-02-05') < 7) AS due
FROM customer LEFT JOIN state ON source_id = c_custkey WHERE c_mktsegment <> 'HOUSEHOLD'""")
def source_due(spark, d):
    sources = table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), (F.col("c_mktsegment") != "HOUSEHOLD").alias("enabled"))
    due = H.due_sources(sources, _state(spark, d), "source_id", F.lit("2024-02-05").cast("date"))
    return due.select("source_id", F.coalesce("status", F.lit("none")).alias("status"), "due")


_labels = " UNION ALL ".join(f"SELECT {i} AS ord, {q(s)} AS status, {q(v)} AS label" for i, (s, v) in enumerate(rules.HEALTH_LABELS))


@query("health_summary", f"""WITH {SQL_HEALTH}, l AS ({_labels}) SELECT l.ord, l.status, l.label, count(state.source_id) AS value FROM l LEFT JOIN state USING (status)
GROUP BY ALL HAVING count(state.source_id) > 0 OR l.status = 'healthy'""")
def health_summary(spark, d):
    return H.health_summary(_state(spark, d)).select("ord", "status", "label", "value")


# --- duplicates ---------------------------------------------------------------

@query("exact_copies", f"""WITH n AS (SELECT doc_id, {sql_norm('text')} AS norm FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS first_id FROM n""")
def exact_copies(spark, d):
    """Documents with equal normal text point at the first one; whole texts, hashed before the shuffle."""
    # Only id and hash go on, computed once.
    docs = cut(table(spark, d, "documents").select("doc_id", F.coalesce(F.sha2(T.normal_title(F.col("text")), 256), F.lit("")).alias("h")))
    firsts = docs.groupBy("h").agg(F.min("doc_id").alias("first_id"))
    return docs.join(firsts, "h").select("doc_id", "first_id")


def page_records(spark, d):
    """Pages as records: the page title, its language as the day bucket, the canonical URL."""
    pages = PG.extract_pages(readers.landed_pages(table(spark, d, "pages")), ["page_id", "url"])
    lang = F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)", 1)
    day = F.when(lang == "en", "2024-03-04").when(lang == "fr", "2024-03-03").when(lang == "de", "2024-03-02").otherwise("2024-03-01")
    return pages.select(
        "page_id", "url", T.canonical_url(F.col("url")).alias("canonical_url"), F.col("page_title").alias("title"), T.normal_title(F.col("page_title")).alias("normalized_title"),
        F.lit("").alias("document_number"), day.alias("published_date"), F.size("paragraphs").alias("quality_score"), F.lit("").alias("summary"), lang.alias("publisher"),
    )


@query("near_dup_pairs")
def near_dup_pairs(spark, d):
    """Each page with the earliest leader its title matches (0.9, same day)."""
    records = cut(page_records(spark, d))
    placed = D.assign(records, 0.90, q=3)
    return placed.select("page_id", "canonical_url", F.col("_leader")["tie"].alias("leader_url"))


@query("dup_collapse")
def dup_collapse(spark, d):
    primaries, _ = D.collapse(cut(page_records(spark, d)), 0.90, q=3)
    return primaries.select("page_id", "canonical_url", "title", "duplicate_count")


@query("related_materials")
def related_materials(spark, d):
    _, related = D.collapse(cut(page_records(spark, d)), 0.90, q=3)
    return related
