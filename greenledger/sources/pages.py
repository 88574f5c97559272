"""From landed pages to records: extraction, link candidates, record assembly, collection log."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from greenledger import rules
from greenledger.functions import text as T
from greenledger.functions.scoring import any_term, curate

PAGE_SCHEMA = "page_title string, meta map<string,string>, links array<struct<href:string,text:string>>, paragraphs array<string>"

PAGE_TYPES = {
    "page_title": pa.string(), "meta": pa.map_(pa.string(), pa.string()),
    "links": pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())])), "paragraphs": pa.list_(pa.string()),
}
PIECE_ROWS, PIECE_BYTES = 128, 1 << 21

# Texts of records without a usable summary, and the lengths that decide.
NO_ARTICLE = "公开来源发布了“%s”相关信息。平台保留原文入口，并将其作为后续核验、数据补充或措施筛选的线索。"
NO_SUMMARY = "公开页面发布了“%s”相关信息。该记录用于发现政策、园区实践或技术线索；涉及园区绩效和项目收益时，仍需核对原文和园区台账。"
SKIPPED = ("skipped_quarantine", "source is quarantined and awaiting scheduled retest")
MIN_PARAGRAPH, MIN_SUMMARY, MAX_SUMMARY, MIN_LINK_TEXT, MIN_TITLE, MAX_TITLE = 30, 50, 360, 6, 15, 180
# End of fixed values.


class _Outline(HTMLParser):
    """Collects the text between the tags of interest; a tag opened again starts over."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: dict[str, list[str]] = {}
        self.href = ""
        self.found: dict = {"page_title": "", "meta": {}, "links": [], "paragraphs": []}

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name = (given.get("name") or given.get("property") or "").lower()
            if name and given.get("content"):
                self.found["meta"][name] = given["content"]
        elif tag == "a":
            self.open.pop("a", None)
            if "href" in given:
                self.href, self.open["a"] = given["href"], []
        elif tag in ("p", "title"):
            self.open[tag] = []

    def handle_data(self, data):
        for pieces in self.open.values():
            pieces.append(data)

    def handle_endtag(self, tag):
        pieces = self.open.pop(tag, None)
        if pieces is None:
            return
        said = " ".join("".join(pieces).split())
        if tag == "title":
            self.found["page_title"] = said
        elif tag == "p" and len(said) >= MIN_PARAGRAPH:
            self.found["paragraphs"].append(said)
        elif tag == "a" and self.href and said:
            self.found["links"].append({"href": self.href, "text": said})


def outline(page: str) -> dict:
    parser = _Outline()
    parser.feed(page or "")
    return parser.found


def extract_pages(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Adds title, meta map, links and paragraphs to the kept columns of pages with ``html``."""
    kept = pages.select(*keep, "html")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, batch.column("html")):
                found = [outline(page) for page in part.column("html").to_pylist()]
                columns = [pa.array([(list(f[n].items()) if n == "meta" else f[n]) for f in found], kind) for n, kind in PAGE_TYPES.items()]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *columns], names=[*keep, *PAGE_TYPES])

    kept_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema)
    return kept.mapInArrow(parse, f"{kept_ddl}, {PAGE_SCHEMA}")


def pieces(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most PIECE_ROWS rows and, beyond one row, PIECE_BYTES of text: what a task holds as objects doesn't grow with a batch."""
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(batch):
        end = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PIECE_BYTES, "right"))
        end = min(max(end, start + 1), start + PIECE_ROWS, len(batch))
        yield batch.slice(start, end - start)
        start = end


def _resolve(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
    def one(base: str, href: str) -> str:
        try:
            return urljoin(base, href)
        except ValueError:
            return ""

    return pd.Series([one(b, h) for b, h in zip(bases, hrefs)], dtype="object")


def link_candidates(parsed: DataFrame, source: str, url: str, order: str, keywords: list[str] = rules.LINK_KEYWORDS,
                    domains: Column | None = None, limit: int | None = None) -> DataFrame:
    """Links worth following, per source in page order: long enough, on topic, allowed, distinct; all, or the first ``limit``.

    The cheap text tests run before the link is resolved. Ranks per source are cut inside the tasks.
    """
    allowed = [] if domains is None else [domains.alias("_domains")]
    rows = parsed.select(source, F.col(url).alias("_base"), F.col(order).alias("page_order"), *allowed, F.posexplode("links").alias("pos", "link"))
    title = T.collapse_space(F.col("link.text"))
    rows = rows.withColumn("title", title).filter((F.length("title") >= MIN_LINK_TEXT) & any_term(F.col("title"), keywords))
    resolved = rows.withColumn("_abs", F.pandas_udf(_resolve, "string")("_base", F.col("link.href")))
    named = resolved.withColumn("url", T.canonical_url(F.col("_abs"))).filter(F.col("url") != "")
    if domains is not None:
        named = named.filter(T.host_allowed(F.col("url"), F.col("_domains")))
    spot = F.struct("page_order", "pos")
    firsts = named.groupBy(source, "url").agg(F.min(spot).alias("_spot"), F.min_by("title", spot).alias("title"))
    ranked = firsts.withColumn("position", F.row_number().over(W.partitionBy(source).orderBy("_spot")))
    ranked = ranked if limit is None else ranked.filter(F.col("position") <= limit)
    return ranked.select(source, "url", "position", F.substring("title", 1, MAX_TITLE).alias("title"))


def summary_of(meta: Column, paragraphs: Column, title: Column) -> Column:
    """First description or early paragraph that is long enough, cut with an ellipsis; else a set phrase."""
    described = F.transform(F.array(*[F.lit(k) for k in ("description", "og:description", "twitter:description")]), lambda k: F.coalesce(F.try_element_at(meta, k), F.lit("")))
    texts = F.transform(F.concat(described, F.slice(paragraphs, 1, 6)), lambda x: T.collapse_space(T.unescape(x)))
    fit = F.get(F.filter(texts, lambda x: F.length(x) >= MIN_SUMMARY), F.lit(0))
    cut = F.concat(F.substring(fit, 1, MAX_SUMMARY), F.when(F.length(fit) > MAX_SUMMARY, "…").otherwise(""))
    return F.coalesce(cut, F.format_string(NO_SUMMARY, title))


def build_records(candidates: DataFrame, articles: DataFrame, sources: DataFrame, source: str, as_of: Column, article_limit: int | None = None) -> DataFrame:
    """Candidates with their article page. A missing page keeps the row with a set phrase as summary, and so do, if
    there is an ``article_limit``, the candidates behind that position; they stay out of the join.

    ``articles``: canonical_url, page_title, meta, paragraphs; one row per URL.
    ``sources``: the source key with name, scope, type, default_category and region.
    """
    wanted = candidates.withColumn("canonical_url", F.col("url"))
    near = wanted if article_limit is None else wanted.filter(F.col("position") <= article_limit)
    joined = near.join(articles, "canonical_url", "left")
    if article_limit is not None:
        joined = joined.unionByName(wanted.filter(F.col("position") > article_limit), allowMissingColumns=True)
    joined = joined.withColumn("_has", F.col("paragraphs").isNotNull())
    staged = joined.withColumn("title", F.when(F.col("_has") & (T.text_or_empty(F.col("page_title")) != "") & (F.length("title") < MIN_TITLE), F.substring("page_title", 1, MAX_TITLE)).otherwise(F.col("title")))
    staged = staged.withColumns(
        {
            "summary": F.when(F.col("_has"), summary_of(F.col("meta"), F.col("paragraphs"), F.col("title"))).otherwise(F.format_string(NO_ARTICLE, F.col("title"))),
            "published_date": T.first_date(F.array_join(F.slice(F.coalesce("paragraphs", F.array().cast("array<string>")), 1, 10), " "), F.col("url"), F.col("title"), as_of=as_of).cast("string"),
            "canonical_url": F.col("url"),
        }
    )
    hashed = staged.withColumn("content_hash", T.sha_hex(F.col("title"), F.col("summary"), F.col("canonical_url")))
    named = hashed.join(sources.withColumnRenamed("name", "publisher"), source, "left")
    return named.select(
        F.concat(F.lit("WEB-"), F.substring("content_hash", 1, 16)).alias("record_id"), "published_date", "title", "summary", "publisher", F.col("publisher").alias("source_name"),
        F.col(source).cast("string").alias("source_id"), F.col("scope").alias("source_scope"), F.col("type").alias("source_type"), "default_category", T.first_text(F.col("region"), F.lit("中国")).alias("region"),
        "url", "canonical_url", F.lit("machine_collected").alias("review_status"), as_of.cast("string").alias("first_seen"), as_of.cast("string").alias("last_seen"), "content_hash", "position",
    )


def split_by_relevance(records: DataFrame, r: rules.RelevanceRules | None = None) -> tuple[DataFrame, DataFrame]:
    curated = curate(records, r)
    return curated.filter(F.col("relevance_status") == "include"), curated.filter(F.col("relevance_status") != "include")


def reject_examples(rejected: DataFrame, source: str = "source_id", k: int = 5) -> DataFrame:
    """The first rejects of each source with score and reason."""
    spot = F.row_number().over(W.partitionBy(source).orderBy("position"))
    return rejected.withColumn("no", spot).filter(F.col("no") <= k).select(source, "no", "title", "url", F.col("relevance_score").alias("score"), F.col("relevance_reason").alias("reason"))


def collection_log(sources: DataFrame, candidates: DataFrame, included: DataFrame, rejected: DataFrame, source: str, attempted_at: Column, failures: DataFrame | None = None, skipped: DataFrame | None = None) -> DataFrame:
    """One log row per source: counts, status, seconds and error. A failed source gives a row, not an abort, and so does one that is ``skipped``
    because it waits in quarantine. ``sources`` may have source_name (or name), start_url and elapsed_seconds, ``failures`` error and elapsed_seconds."""
    tag = lambda df, key, name: df.groupBy(F.col(key).cast("string").alias("source_id")).agg(F.count("*").alias(name))
    known = lambda df, name, *others, kind="string": next((F.col(c).cast(kind) for c in (name, *others) if c in df.columns), F.lit(None).cast(kind)).alias(name)
    about = lambda df: [F.col(source).cast("string").alias("source_id"), known(df, "source_name", "name"), known(df, "start_url"), known(df, "elapsed_seconds", kind="double")]
    out = sources.select(*about(sources))
    for df, key, name in ((candidates, source, "candidates"), (included, "source_id", "records"), (rejected, "source_id", "rejected_low_relevance")):
        out = out.join(tag(df, key, name), "source_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    if failures is not None:
        failed = failures.groupBy(F.col(source).cast("string").alias("source_id")).agg(F.max(F.coalesce("error", F.lit(""))).alias("_error"))
        out = out.join(failed, "source_id", "left")
    error = F.col("_error") if failures is not None else F.lit(None).cast("string")
    out = out.withColumns({"status": F.when(error.isNotNull(), "failed").otherwise("ok"), "error": T.text_or_empty(error)}).drop("_error")
    if skipped is not None:
        waits = skipped.select(*about(skipped)).withColumns({"records": F.lit(0).cast("long"), "status": F.lit(SKIPPED[0]), "error": F.lit(SKIPPED[1]), "elapsed_seconds": F.lit(0.0)})
        out = out.unionByName(waits, allowMissingColumns=True)
    return out.withColumn("attempted_at", attempted_at)
