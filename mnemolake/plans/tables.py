"""The engine's logical tables over the driver's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as revisions of memories: the memory is user_id, the version event_id."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("memory_id"), F.col("event_id").alias("version"), "event_type", F.round("value", 6).alias("value"))


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories whose id is divisible by 7 die at their last version."""
    r = revisions(spark, sf_dir)
    return r.where("memory_id % 7 = 0").groupBy("memory_id").agg(F.max("version").alias("version"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector v relates to v + 1 if labels agree, and to 2 v + 1; even sources are active."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    a, b = v.alias("a"), v.alias("b")
    near = a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1).where("a.label = b.label").select(F.col("a.vec_id").alias("source"), F.col("b.vec_id").alias("target"), F.lit("supports").alias("kind"))
    far = a.join(b, F.col("b.vec_id") == 2 * F.col("a.vec_id") + 1).select(F.col("a.vec_id"), F.col("b.vec_id"), F.lit("duplicate"))
    edges = near.union(far)
    return edges.select("*", (F.col("source") % 2 == 0).alias("active"), F.lit("organiser").alias("origin"), F.col("source").alias("version"))


RELATIONS_SQL = """relations as (
 select a.vec_id as source, b.vec_id as target, 'supports' as kind, a.vec_id % 2 = 0 as active from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 and a.label = b.label
 union all
 select a.vec_id, b.vec_id, 'duplicate', a.vec_id % 2 = 0 from embeddings a join embeddings b on b.vec_id = 2 * a.vec_id + 1)"""


def freshness_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as credits: the position is the id, the amount by type."""
    amount = F.when(F.col("event_type") == "purchase", 50).when(F.col("event_type") == "click", 25).otherwise(5)
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("memory_id"), F.col("event_id").alias("position"), "event_id", amount.alias("amount"))
