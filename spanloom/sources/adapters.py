"""Timelines made from the star-schema, event and text tables, with integer times.

Each view has a Spark form here and its SQL twin for the oracle in plans/views.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.intervals import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping removals: a span for each line of an order."""
    line = table(spark, sf_dir, "lineitem")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
    start = (F.col("l_linenumber") * 10).cast("long")
    reason = F.when(F.col("l_returnflag") == "A", "silence").when(F.col("l_returnflag") == "N", "filler").when(F.col("l_linestatus") == "F", "retake").otherwise("ngram_repeat")
    return line.select(
        F.col("l_orderkey").alias("media_id"),
        F.row_number().over(order).cast("long").alias("idx"),
        start.alias("start"),
        (start + F.col("l_quantity").cast("long") % 17 + 1).alias("end"),
        reason.alias("reason"),
        (F.lit(100) - F.round(F.col("l_discount") * 100).cast("int")).alias("confidence"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("detail"),
    )


def order_media(spans: DataFrame) -> DataFrame:
    """A duration for each order: some spans reach past it."""
    return spans.groupBy("media_id").agg((F.max("end") - 3).alias("duration"))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a user's timeline, in microseconds: each event lasts `value` seconds."""
    e = table(spark, sf_dir, "events").filter("user_id is not null and ts is not null")
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("media_id"), F.row_number().over(order).cast("long").alias("idx"), "event_id", F.col("event_type").alias("text"), start.alias("start"), (start + F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("long") * 10000).alias("end"))


SPLIT = r"[ \n\t\r]+"


def conversation_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's words, in milliseconds: one each 300 ms, 240 ms long, 600 ms more after
    the end of a sentence."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("media_id"), "turn", F.posexplode(F.filter(F.split("text", SPLIT), lambda x: x != "")).alias("pos", "text"))
    order = W.partitionBy("media_id").orderBy("turn", "pos")
    ends = F.col("text").rlike(r"[.?!]$").cast("long")
    words = turns.withColumn("idx", F.row_number().over(order).cast("long")).withColumn("_stops", F.coalesce(F.sum(ends).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    start = F.col("idx") * 300 + F.col("_stops") * 600
    return dealt(words.select("media_id", "idx", "text", start.alias("start"), (start + 240).alias("end")))


def vector_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal frames: each component of a vector as a level in whole decibels."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("media_id"), F.posexplode("embedding").alias("i", "x"))
    return e.select("media_id", "i", F.floor(F.col("x").cast("double") * 100 - 50).cast("long").alias("db"))


def subscription_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a ledger of subscription updates."""
    e = table(spark, sf_dir, "events").filter("user_id is not null")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("owner"), F.col("event_type").alias("status"), F.unix_micros(F.col("ts").cast("timestamp")).alias("updated"), F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("long").alias("bytes"))
