"""Keyword scoring, first-match labels and the curation projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from greenledger import rules
from greenledger.functions import text as T


def any_term(c: Column, terms: list[str]) -> Column:
    """True when the text contains one of the terms (unrolled, so it stays in generated code)."""
    if not terms:
        return F.lit(False)
    found = F.contains(c, F.lit(terms[0]))
    for term in terms[1:]:
        found = found | F.contains(c, F.lit(term))
    return F.coalesce(found, F.lit(False))


def first_match(c: Column, table: list[tuple[str, str]], default: str) -> Column:
    """Label of the first term, in table order, that the text contains."""
    chain = F.when(F.contains(c, F.lit(table[0][0])), table[0][1])
    for term, label in table[1:]:
        chain = chain.when(F.contains(c, F.lit(term)), label)
    return chain.otherwise(default)


def source_level(name: Column, scope: Column) -> Column:
    given, publisher = T.clean_text(scope), T.clean_text(name)
    return (
        F.when(given.isin(rules.SCOPE_VALUES), given)
        .when(any_term(publisher, rules.NATIONAL_SOURCES), "国家")
        .when(any_term(publisher, rules.PARK_SOURCES), "园区")
        .when(any_term(publisher, rules.LOCAL_SOURCES), "地方")
        .otherwise("其他")
    )


def _term_table(r: rules.RelevanceRules) -> Column:
    """One literal array of (term, signed weight, reason), in the order reasons are listed."""
    rows = [(t.lower(), w, rules.REASON_HIT % t) for t, w in r.positive.items()]
    rows += [(t.lower(), -w, rules.REASON_WEAK % t) for t, w in r.negative.items()]
    return F.array(*[F.struct(F.lit(t).alias("term"), F.lit(w).alias("weight"), F.lit(m).alias("reason")) for t, w, m in rows])


SHOWN = 7  # reasons in the published text


def add_relevance(df: DataFrame, title: str, summary: str, level: str, r: rules.RelevanceRules) -> DataFrame:
    """Adds ``relevance_score``, ``relevance_reasons`` (all of them) and ``relevance_reason`` (the published text, of the first SHOWN); needs
    cleaned title and summary and a source level."""
    body = F.lower(F.concat_ws(" ", F.col(title), F.col(summary)))
    scored = df.withColumn("_body", body).withColumn(
        "_hits", F.filter(_term_table(r), lambda t: F.contains(F.col("_body"), t["term"]))
    )
    implemented = any_term(F.col("_body"), r.implementation)
    is_park = F.col(level) == "园区"
    is_national = (F.col(level) == "国家") & any_term(F.col("_body"), r.national_terms)
    off_topic = ~any_term(F.col("_body"), r.on_topic)
    extras = F.array(
        F.when(implemented, rules.REASON_IMPLEMENTATION),
        F.when(is_park, rules.REASON_PARK).when(is_national, rules.REASON_NATIONAL),
        F.when(off_topic, rules.REASON_OFF_TOPIC),
    )
    score = (
        F.aggregate(F.col("_hits"), F.lit(0), lambda acc, t: acc + t["weight"])
        + F.when(implemented, 2).otherwise(0)
        + F.when(is_park | is_national, 2).otherwise(0)
        - F.when(off_topic, 5).otherwise(0)
    )
    reasons = F.concat(F.transform(F.col("_hits"), lambda t: t["reason"]), F.filter(extras, lambda x: x.isNotNull()))
    return (
        scored.withColumns({"relevance_score": score, "relevance_reasons": reasons})
        .withColumn("_shown", F.array_join(F.slice("relevance_reasons", 1, SHOWN), "；"))
        .withColumn("relevance_reason", F.coalesce(T.blank_to_null(F.col("_shown")), F.lit(rules.REASON_NONE)))
        .drop("_body", "_hits", "_shown")
    )


def category(c: Column, default: Column, r: rules.RelevanceRules) -> Column:
    """First category whose terms (and guard, if it has one) occur in the text."""
    chain = None
    for name, terms in r.categories:
        test = any_term(c, terms)
        if name in r.guards:
            test = test & any_term(c, r.guards[name])
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    fallback = F.when(default.isin(rules.DEFAULTABLE_CATEGORIES), default)
    return F.coalesce(chain, fallback, F.lit(rules.CATCH_ALL_CATEGORY))


RECORD_TEXTS = ("title", "summary", "publisher", "source_name", "source_scope", "default_category", "published_date", "url")


def with_columns_present(df: DataFrame, names: tuple[str, ...], dtype: str = "string") -> DataFrame:
    missing = {n: F.lit(None).cast(dtype) for n in names if n not in df.columns}
    return df.withColumns(missing) if missing else df


def curate(df: DataFrame, r: rules.RelevanceRules | None = None) -> DataFrame:
    """The whole curation projection: no shuffle, one pass over the records."""
    r = r or rules.RelevanceRules()
    df = with_columns_present(df, RECORD_TEXTS)
    day = F.substring(T.text_or_empty(F.col("published_date")), 1, 10)
    staged = df.withColumns(
        {
            "title": T.clean_title(F.col("title")),
            "summary": T.clean_text(F.col("summary")),
            "_publisher": T.clean_text(T.first_text(F.col("publisher"), F.col("source_name"))),
            "_scope": T.clean_text(F.col("source_scope")),
        }
    ).withColumns(
        {
            "normalized_title": T.normal_title(F.col("title")),
            "document_number": T.document_number(F.col("title"), F.col("summary")),
            "source_level": source_level(F.col("_publisher"), F.col("_scope")),
            "category": category(
                F.concat_ws(" ", F.col("title"), F.col("summary")), T.clean_text(F.col("default_category")), r
            ),
        }
    )
    scored = add_relevance(staged, "title", "summary", "source_level", r)
    included = F.col("relevance_score") >= r.minimum_score
    notes = F.create_map(*[F.lit(x) for pair in rules.USAGE_NOTES.items() for x in pair])
    note = F.coalesce(F.try_element_at(notes, F.col("category")), F.lit(rules.USAGE_NOTES[rules.CATCH_ALL_CATEGORY]))
    by_number = F.concat(F.lit("DOC-"), F.substring(F.sha2(F.col("document_number"), 256), 1, 16))
    by_title = F.concat(F.lit("EVT-"), F.substring(T.sha_hex(F.col("normalized_title"), day), 1, 16))
    length = F.length(F.col("summary"))
    quality = (
        F.col("relevance_score")
        + F.when(F.col("source_level").isin("国家", "地方", "园区"), 2).otherwise(0)
        + F.when(length >= 80, 2).when(length >= 40, 1).otherwise(0)
        + F.when(T.text_or_empty(F.col("published_date")) != "", 1).otherwise(0)
        + F.when(T.text_or_empty(F.col("url")) != "", 1).otherwise(0)
    )
    return scored.withColumns(
        {
            "topic": F.col("category"),
            "relevance_status": F.when(included, "include").otherwise("exclude"),
            "event_key": F.when(F.col("document_number") != "", by_number).otherwise(by_title),
            "why": F.when(included, note).otherwise(rules.EXCLUDED_NOTE),
            "quality_score": quality,
        }
    ).drop("_publisher", "_scope")
