"""URL filter by association rules, behind hand-written rules.

A URL is a set of tokens: scheme, host, its parent domains and first label, path segments (digits read as
``#``), file extension, names of query parameters, a fragment. Over all labelled URLs FP-growth mines the token sets
that occur together with the label at ``min_support``; rules from tokens to the label stay from ``min_confidence``
on. Every rule is posted in an inverted index under its rarest token; the distinct token sets of
the pages meet the index by token, and a set that holds all tokens of a posted rule is blocked. Pages
then take the verdict of their token set. A hand-written rule that fits goes first; the longest wins.

The index has as many rows as rules. It is broadcast up to ``MANY`` rules (counted first), else joined by
salted tokens. Page ids and texts of pages play no part in a verdict.

Nulls: a URL that is null or has no ``://`` has empty host and path, no tokens, and is allowed. A null label is no
label. Repeated rows are judged, and counted, each time. Without labels, or without rules that pass, the method allows.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from greenledger.llm import common as C
from greenledger.session import cut

MANY = 50_000
LABEL = "label=block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(rest_of(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL, sorted."""
    host, path, rest = host_of(url), path_of(url), rest_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, n), ".")))
    first = F.array(F.concat(F.lit("first="), F.element_at(labels, 1)))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    shapes = F.transform(segments, lambda s, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="), F.regexp_replace(s, "[0-9]+", "#")))
    extension = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    query = F.regexp_extract(rest, r"\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.concat(F.lit("query="), F.regexp_extract(p, "^([^=]*)", 1)))
    some = F.array_compact(F.array(
        F.concat(F.lit("scheme="), F.substr(url, F.lit(1), F.instr(url, "://") - 1)),
        F.when(extension != "", F.concat(F.lit("ext="), extension)),
        F.when(F.contains(rest, F.lit("#")), F.lit("fragment")),
    ))
    return F.when(host != "", F.array_sort(F.array_distinct(F.concat(parents, first, shapes, names, some)))).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, url_col: str = "url", label_col: str = "label", min_support: float = 0.002, min_confidence: float = 0.6, min_urls: int = 10) -> DataFrame:
    """Rules (rule_id, tokens, anchor, confidence, support) from labelled URLs; a true label means block.
    A rule's tokens and label occur together in at least this share of all, and in this many URLs."""
    rows = labelled.filter(C.named(label_col).isNotNull()).select(tokens_of(C.named(url_col)).alias("tokens"), C.named(label_col).cast("boolean").alias("block")).filter(F.size("tokens") > 0)
    baskets = cut(rows.select("tokens", F.when(F.col("block"), F.concat("tokens", F.array(F.lit(LABEL)))).otherwise(F.col("tokens")).alias("items")))
    least = min(1.0, max(min_support, min_urls / max(1, baskets.count())))
    found = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(baskets).associationRules
    rules = found.filter((F.size("consequent") == 1) & (F.element_at("consequent", 1) == LABEL)).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    rules = cut(rules.withColumn("rule_id", F.xxhash64("tokens")))
    often = baskets.select(F.explode("tokens").alias("token")).groupBy("token").count()
    ranked = rules.select("rule_id", F.explode("tokens").alias("token")).join(often, "token")
    anchors = ranked.groupBy("rule_id").agg(F.min(F.struct("count", "token")).alias("least")).select("rule_id", F.col("least.token").alias("anchor"))
    return cut(rules.join(anchors, "rule_id"))


def blocked_sets(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Token sets (``tokens``) that hold all tokens of a rule, with the highest confidence of such rules."""
    posted = rules.select(F.col("anchor").alias("token"), F.col("tokens").alias("needed"), "confidence")
    asked = sets.select("tokens", F.explode("tokens").alias("token"))
    if rules.count() <= MANY:
        met = asked.join(F.broadcast(posted), "token")
    else:
        salts = 32
        met = asked.withColumn("_salt", F.pmod(F.xxhash64("tokens"), F.lit(salts)).cast("int")).join(posted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["token", "_salt"])
    return met.filter(F.size(F.array_except("needed", "tokens")) == 0).groupBy("tokens").agg(F.max("confidence").alias("confidence"))


def listed(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest hand-written rule that fits, and its verdict; nulls if none does. Rules: (``host/path``, verdict)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, start = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, mined: DataFrame, rules: list[tuple[str, str]], url_col: str = "url") -> DataFrame:
    """The rows of ``pages`` with a struct ``filter`` (``C.free_name`` where they have such a column): host, path, rule, verdict and the confidence of the mined rule."""
    url = C.named(url_col).cast("string")
    rows = pages.select(F.struct("*").alias("_page"), tokens_of(F.coalesce(url, F.lit(""))).alias("tokens"), host_of(url).alias("host"), path_of(url).alias("path"))
    verdicts = cut(blocked_sets(rows.select("tokens").distinct(), mined))
    joined = C.salted_join(rows, verdicts, ["tokens"], F.col("path"), "left")
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select("_page.*", F.struct("host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "confidence").alias(C.free_name(pages, "filter")))
