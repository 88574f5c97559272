"""Collect, merge and publish: the two scheduled jobs over the archive."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from greenledger import rules
from greenledger.functions.scoring import curate
from greenledger.operators import archive as A, dedup as D, digest, health as H, marts
from greenledger.session import cut
from greenledger.sources import pages as PG, readers


@dataclass
class Collected:
    records: DataFrame
    rejected: DataFrame
    examples: DataFrame
    log: DataFrame


def collect(index_pages: DataFrame, article_pages: DataFrame, sources: DataFrame, as_of: Column, source: str = "id", health: DataFrame | None = None,
            keywords: list[str] = rules.LINK_KEYWORDS, relevance: rules.RelevanceRules | None = None, failures: DataFrame | None = None, only: str | None = None) -> Collected:
    """Records, rejects and a log row per source from landed pages.

    ``index_pages`` has the source key, url, html; ``article_pages`` url, html; ``sources`` the
    key with name, scope, type, default_category, region, enabled and, if known, allowed_domains. Disabled
    sources are left out; links to hosts outside a source's list are not followed, an empty list allows all. ``only`` names the one source
    to collect. ``failures`` (source key, error, and if known elapsed_seconds) are sources whose fetch failed: their pages are not read, and
    they get a log row with the error. A quarantined source that is not due for a retest gets a log row that says so. ``sources`` may
    have start_url and elapsed_seconds for the log.
    """
    chosen = sources.filter(F.coalesce(F.col("enabled"), F.lit(True)))
    if only is not None:
        chosen = chosen.filter(F.col(source).cast("string") == only)
    skipped = None
    if health is not None:
        judged = H.due_sources(chosen, health, source, as_of)
        chosen, skipped = judged.filter("due"), judged.filter("NOT due")
    if failures is not None:
        failures = failures.join(chosen.select(source), source, "left_semi")
        index_pages = index_pages.join(failures.select(source), source, "left_anti")
    live = index_pages.join(chosen.select(source), source, "left_semi").withColumn("page_order", F.col("url"))
    listed = ["allowed_domains"] if "allowed_domains" in chosen.columns else []
    parsed = PG.extract_pages(readers.landed_pages(live), [source, "url", "page_order"])
    if listed:
        parsed = parsed.join(chosen.select(source, *listed), source)
    candidates = cut(PG.link_candidates(parsed, source, "url", "page_order", keywords, *map(F.col, listed)))
    # Only the pages some candidate points at are parsed.
    keyed = A.keyed(article_pages).select("canonical_url", "html", "url").join(candidates.select(F.col("url").alias("canonical_url")).distinct(), "canonical_url", "left_semi")
    one = keyed.groupBy("canonical_url").agg(F.max_by("html", "url").alias("html"))
    articles = PG.extract_pages(readers.landed_pages(one), ["canonical_url"]).drop("links")
    records = PG.build_records(candidates, articles, chosen, source, as_of)
    kept, dropped = PG.split_by_relevance(cut(records), relevance)
    return Collected(kept, dropped, PG.reject_examples(dropped), PG.collection_log(chosen, candidates, kept, dropped, source, as_of, failures, skipped))


def update_archive(existing: DataFrame, incoming: DataFrame, as_of: Column, threshold: float = 0.90, relevance: rules.RelevanceRules | None = None,
                   max_records: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(archive after merge and collapse, related materials, history before collapse)."""
    merged = A.merge(existing, incoming, as_of)
    curated = cut(curate(merged, relevance))
    primaries, related = D.collapse(curated, threshold)
    if max_records is not None:
        primaries = A.newest(primaries, max_records)
    return primaries, related, curated


def report_events(archive: DataFrame, threshold: float = 0.90, relevance: rules.RelevanceRules | None = None) -> DataFrame:
    """Events for reports: relevant records first, then one record per event. A near copy that is left out takes no event with it."""
    return D.collapse(curate(archive, relevance).filter(F.col("relevance_status") == "include"), threshold)[0]


def merge_statistics(existing: DataFrame, incoming: DataFrame, as_of: Column, threshold: float = 0.90, relevance: rules.RelevanceRules | None = None,
                     max_records: int | None = None) -> DataFrame:
    """The seven numbers of a merge: added, updated and unchanged URLs, rows kept, near copies collapsed, and how many of what is left is relevant or not."""
    log = A.merge_stats(existing, incoming, as_of).drop("total")
    primaries = cut(D.collapse(cut(curate(A.merge(existing, incoming, as_of), relevance)), threshold)[0].select("duplicate_count", "relevance_status"))
    total = F.count("*") if max_records is None else F.least(F.count("*"), F.lit(max_records))
    return log.crossJoin(primaries.agg(  # one row meets one row
        total.alias("total"), F.coalesce(F.sum("duplicate_count"), F.lit(0)).cast("long").alias("duplicates_collapsed"),
        F.count_if(F.col("relevance_status") == "include").alias("included"), F.count_if(F.col("relevance_status") != "include").alias("excluded_low_relevance"),
    ))


@dataclass
class Digest:
    """Selected events with the numbers, themes and editorial rules they call for."""

    rows: DataFrame
    metrics: DataFrame
    balance: DataFrame
    themes: DataFrame
    analysis: DataFrame


def make_digest(events: DataFrame, days: int, limit: int) -> Digest:
    """A balanced digest of report events and the analysis of what was selected; a digest is short, so it is kept once."""
    rows = cut(digest.balanced_select(events, days=days, limit=limit))
    metrics = digest.digest_metrics(rows)
    themes = digest.theme_counts(rows, F.concat_ws(" ", "title", "summary"))
    return Digest(rows, metrics, digest.category_balance(rows, "category"), themes, digest.digest_rules(metrics, themes))


@dataclass
class Marts:
    counts: DataFrame
    park_profile: DataFrame
    corpus: DataFrame
    monthly: DataFrame
    cumulative: DataFrame
    funnel: DataFrame
    evidence: DataFrame
    feed: DataFrame
    daily: DataFrame
    weekly: DataFrame
    daily_digest: Digest
    weekly_digest: Digest
    headline: DataFrame


def publish(archive: DataFrame, raw_parks: DataFrame, evidence: DataFrame, facts: DataFrame, gates: DataFrame, threshold: float = 0.90,
            relevance: rules.RelevanceRules | None = None, daily_limit: int = 12, weekly_limit: int = 28) -> Marts:
    """All marts from one curated archive, computed once and written behind a checkpoint."""
    primaries, _ = D.collapse(curate(archive, relevance), threshold)
    curated = cut(primaries)
    events = cut(report_events(archive, threshold, relevance))
    daily, weekly = make_digest(events, 2, daily_limit), make_digest(events, 7, weekly_limit)
    public = curated.filter(F.col("relevance_status") == "include")
    parks = marts.park_projection(raw_parks)
    dated = public.withColumn("day", F.try_to_date("published_date", "yyyy-MM-dd"))
    tables = {"domestic_parks": parks.filter(F.col("scope") == rules.DOMESTIC), "international_cases": parks.filter(F.col("scope") != rules.DOMESTIC), "archive_records": public,
              "archive_records_total": archive, "excluded_low_relevance": curated.filter(F.col("relevance_status") != "include"), "verified_public_facts": facts, "formal_accounting_ready": gates.filter("ready")}
    counts = marts.count_block(tables)
    collapsed = curated.agg(F.coalesce(F.sum("duplicate_count"), F.lit(0)).cast("long").alias("value")).select(F.lit("duplicates_collapsed").alias("name"), "value")
    return Marts(
        counts=counts.unionByName(collapsed), park_profile=marts.park_profile(parks), corpus=marts.corpus_counts(public), monthly=marts.monthly_counts(dated, "day"),
        cumulative=marts.cumulative_days(dated, "day"), funnel=marts.data_funnel(parks, public, evidence, facts, gates), evidence=marts.evidence_by_park(evidence),
        feed=marts.page(public, [F.desc_nulls_last("published_date"), F.desc("quality_score"), F.col("canonical_url") if "canonical_url" in public.columns else F.col("url")], 80),
        daily=daily.rows, weekly=weekly.rows, daily_digest=daily, weekly_digest=weekly, headline=marts.headline(counts.unionByName(collapsed)),
    )
