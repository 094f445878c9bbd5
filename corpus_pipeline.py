"""A corpus from raw documents to packed sequences, as stages of the llm operators.

Each stage takes (spark, docs, sf_dir) and returns a table; run() writes each one's result
to the shared folder and reads it again for the next. All but the last keep the columns of
documents, and further ones, whatever their names.

Null and empty texts pass the classifier by its base rate, are one class of near copies each (so
one document without words stays), have no leaks and no secrets, and pack as their end id. Rows
of one id: those with equal words are near copies, of which one stays; different ones are
documents of their own. Empty tables pass through as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontam, jaccard, packing, secrets, toxicity
from spanloom.llm.queries import documents, tokenizer
from spanloom.llm.shared import spare, written

#: SQL cannot express the classifier or the tokenizer.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on all labelled ones, scores below 0.5."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    name = spare(docs, "toxic")
    return toxicity.score(docs, model, name=name).filter(F.col(name) < 0.5).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (word 5-grams, similarity 0.8), that of the least id."""
    return jaccard.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    name = spare(docs, "hits")
    found = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), name=name)
    return found.filter(~F.col(name).contaminated).drop(name)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced; n_chars follows a text that changed."""
    before = spare(docs, "before")
    clean = secrets.redact(docs.withColumn(before, F.length("text")))
    changed = F.length("text") != F.col(before)
    return clean.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(before)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed."""
    return packing.pack_documents(docs, tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
