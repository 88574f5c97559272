"""From raw documents to a training mix, in stages that each call one operator.

Every stage takes (spark, docs, folder of the tables), works on all that its predecessor kept, and
returns a DataFrame that is written as Parquet and reread as the next stage's documents. All but the last return the
columns of ``documents``. Stages learn from their own input alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from greenledger.llm import common as C, langid, mixing, near_dedup, winnowing
from greenledger.llm.line_index import LineIndex
from greenledger.llm.queries import is_contaminated
from greenledger.session import remove, scratch, shared_dir

#: SQL cannot express the learned language stage; a test follows planted documents through every stage.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language is recognised; rejected ones go."""
    model = langid.train(docs)
    return langid.identify(docs, model).filter(~F.col(f"{C.free_name(docs, 'language')}.rejected")).select(*map(C.named, docs.columns))


def lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Lines that an earlier document has are cut out; a document that had text and has none left goes."""
    index = LineIndex.empty(spark).insert(docs)
    cleaned = index.clean(docs, refs=index.refs)
    done = F.col(C.free_name(docs, "lines"))
    emptied = (done["n_dropped"] > 0) & (F.trim(done["kept"]) == "")
    kept = cleaned.filter(~F.coalesce(emptied, F.lit(False)))
    return kept.withColumn("text", done["kept"]).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*map(C.named, docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return near_dedup.one_of_each(docs, width=5, percent=80).select(*map(C.named, docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents of which a twentieth or more of the words are benchmark windows go."""
    found = winnowing.contamination(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    return found.filter(~is_contaminated(F.col(C.free_name(docs, "found")))).select(*map(C.named, docs.columns))


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Sources in proportion to the square root of their size; as many documents as came in, with the copy's number
    (``copy`` and ``copies``, under free names where documents have such columns)."""
    draw = F.col(C.free_name(docs, "draw"))
    return mixing.mix(docs).select(*map(C.named, docs.columns), *[draw[name].alias(C.free_name(docs, name)) for name in ("copy", "copies")])


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("decontaminate", decontaminate), ("mix", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; a stage's own tables, and its
    input, are deleted once its output is written. The last output stays, for the result is read from it."""
    out, last = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}", None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
        if last:
            remove(spark, last)
        last = f"{out}/{name}"
    return docs
