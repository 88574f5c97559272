"""Readers: JSON lines, CSV reference tables, JSON documents, landed pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as ST

from greenledger.functions import text as T

RECORD_SCHEMA = (
    "record_id string, published_date string, title string, summary string, publisher string, source_name string, source_id string, "
    "source_scope string, source_type string, default_category string, region string, parks array<string>, url string, canonical_url string, "
    "review_status string, first_seen string, last_seen string, content_hash string, version_count int, previous_content_hash string, "
    "topic string, category string, source_level string, relevance_score int, relevance_status string, relevance_reason string, event_key string, "
    "why string, quality_score int, normalized_title string, document_number string, duplicate_count int, "
    "relevance_reasons array<string>"
)
SOURCE_SCHEMA = (
    "sources array<struct<id:string,name:string,type:string,start_url:string,allowed_domains:array<string>,priority:string,enabled:boolean,"
    "scope:string,default_category:string,region:string>>, archive_limit int, max_links_per_source int, max_article_fetches_per_source int, "
    "keywords array<string>, failure_policy struct<watch_after:int,quarantine_after:int,quarantine_retest_days:int>"
)
POLICY_SCHEMA = (
    "minimum_relevance_score int, near_duplicate_threshold double, daily_limit int, weekly_limit int, category_order array<string>, "
    "weekly_target_share map<string,double>"
)
# Policy numbers used where the document leaves them out.
POLICY_DEFAULTS = {"minimum_relevance_score": 4, "near_duplicate_threshold": 0.90, "daily_limit": 12, "weekly_limit": 28}


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def parse_lines(lines: DataFrame, value: str, schema: str, keep: list[str] | None = None) -> DataFrame:
    """Rows of JSON objects held as text lines.

    Blank lines, broken JSON and values that are not objects are skipped; a byte-order mark is
    tolerated.
    """
    text = F.trim(F.regexp_replace(F.col(value), r"\x{FEFF}", ""))
    # Only an object parses as a map, so arrays and scalars drop out here.
    objects = lines.withColumn("_t", text).filter(F.col("_t").startswith("{"))
    parsed = objects.withColumn("_r", F.from_json("_t", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    good = parsed.filter(F.col("_r").isNotNull() & F.col("_r._bad").isNull())
    names = [f.name for f in ST._parse_datatype_string(schema).fields]
    return good.select(*(keep or []), *[F.col("_r")[n].alias(n) for n in names])


def read_archive(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA) -> DataFrame:
    return parse_lines(spark.read.text(path), "value", schema) if path_exists(spark, path) else _empty(spark, schema)


def read_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header; every value stays text. A missing file gives no rows."""
    if not path_exists(spark, path):
        return _empty(spark, ", ".join(f"`{c}` string" for c in columns))
    return spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")


def read_policy(spark: SparkSession, path: str | None = None) -> DataFrame:
    """One policy row; what the document leaves out takes the default."""
    if path is not None and path_exists(spark, path):
        raw = spark.read.schema(POLICY_SCHEMA).json(path, multiLine=True)
    else:
        raw = spark.createDataFrame([(None,) * 6], POLICY_SCHEMA)
    return with_policy_defaults(raw)


def with_policy_defaults(raw: DataFrame) -> DataFrame:
    return raw.withColumns({n: F.coalesce(F.col(n), F.lit(v)) for n, v in POLICY_DEFAULTS.items()})


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """The sources of the collection config, one row each."""
    config = spark.read.schema(SOURCE_SCHEMA).json(path, multiLine=True)
    return config.select(F.explode("sources").alias("s")).select("s.*").withColumn("enabled", F.coalesce("enabled", F.lit(True)))


def first_available(spark: SparkSession, candidates: list) -> DataFrame:
    """First of several tables that exists and has rows: curated archive, raw archive, mart rows."""
    last = None
    for read in candidates:
        last = read()
        if not last.isEmpty():
            return last
    return last


def landed_pages(pages: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Pages as text. Bytes are whole, or cut at a size limit if one is given, and decoded with replacement; only HTML, XML and RSS stay.

    Expects ``url`` and ``html`` (text) or ``body`` (bytes, with optional ``charset`` and ``content_type``).
    """
    out = pages
    if "content_type" in pages.columns:
        out = out.filter(F.col("content_type").rlike("html|xml|rss"))
    body = F.col("body") if "body" in pages.columns else F.encode(F.col("html"), "UTF-8")
    size = F.octet_length(body)
    capped = body if max_bytes is None else F.when(size > max_bytes, F.substring(body, 1, max_bytes)).otherwise(body)
    if "body" in pages.columns:
        charset = F.lower(F.coalesce(F.col("charset"), F.lit("utf-8"))) if "charset" in pages.columns else F.lit("utf-8")
        text = F.when(charset.isin("iso-8859-1", "latin-1"), F.decode(capped, "ISO-8859-1")).when(charset.startswith("utf-16"), F.decode(capped, "UTF-16")).otherwise(_utf8(capped))
        return out.withColumns({"html": text, "n_bytes": size})
    cut = F.col("html") if max_bytes is None else F.when(size > max_bytes, _utf8(capped)).otherwise(F.col("html"))
    return out.withColumns({"html": cut, "n_bytes": size})


def _utf8(body: Column) -> Column:
    """UTF-8 with a replacement character for what is not valid."""
    return F.make_valid_utf8(body.cast("string"))
