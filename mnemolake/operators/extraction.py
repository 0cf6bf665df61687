"""Extracted candidates: validation against the turns they cite, deduplication, grouping of retained clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AUTHORITIES = ("direct", "correction", "adoption", "retention")


def validated(candidates: DataFrame, turns: DataFrame) -> DataFrame:
    """Candidates (idx, node_id, quote, title, content, authority, authority_node) with ``rejection`` or null.

    The quote must be verbatim in its user turn; an authority source must be an assistant turn not later than it, and
    only adoption and retention may cite one; of equal (node, quote, title, content) the first counts."""
    t = turns.select(F.col("node_id").alias("_n"), F.col("role").alias("_role"), F.col("text").alias("_text"), F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"))
    s = turns.select(F.col("node_id").alias("_sn"), F.col("role").alias("_srole"), F.col("conv_id").alias("_sconv"), F.col("turn").alias("_sturn"))
    joined = candidates.join(t, candidates["node_id"] == t["_n"], "left").join(s, candidates["authority_node"] == s["_sn"], "left")
    cites = F.col("authority_node").isNotNull()
    reason = (
        F.when(~F.col("authority").isin(*AUTHORITIES), "unknown authority").when(F.col("_n").isNull(), "unknown turn").when(F.col("_role") != "user", "not a user turn")
        .when(~F.contains("_text", "quote"), "quote not verbatim")
        .when(cites & ~F.col("authority").isin("adoption", "retention"), "authority source not allowed")
        .when(cites & (F.col("_sn").isNull() | (F.col("_srole") != "assistant")), "authority source is no assistant turn")
        .when(cites & ((F.col("_sconv") != F.col("_conv")) | (F.col("_sturn") > F.col("_turn"))), "authority source is later")
    )
    judged = joined.withColumn("_r", reason)
    first = F.row_number().over(Window.partitionBy(F.col("_r").isNull(), "node_id", "quote", "title", "content").orderBy("idx"))
    return judged.withColumn("_k", first).select(*candidates.columns, F.when(F.col("_r").isNotNull(), F.col("_r")).when(F.col("_k") > 1, "duplicate").alias("rejection"))


def retained_groups(clauses: DataFrame, signature: list[str], most: int = 64) -> DataFrame:
    """Clauses by signature in order of first appearance, at most ``most`` groups."""
    groups = clauses.groupBy(*signature).agg(F.min("position").alias("first"), F.array_sort(F.collect_list(F.struct("position", "clause"))).alias("_c"))
    return groups.orderBy("first").limit(most).select(*signature, "first", F.transform("_c", lambda x: x["clause"]).alias("clauses"))


def evidence_errors(requests: DataFrame, responses: DataFrame, most: int = 4, most_turns: int = 64, most_bytes: int = 128 * 1024) -> DataFrame:
    """Per item: too many requests, a response that covers other turns than asked, or bounds exceeded."""
    asked = requests.groupBy("item").agg(F.size(F.collect_set("request")).alias("n"), F.array_sort(F.collect_set("node_id")).alias("a"))
    sizes = responses.select("item", "node_id", F.octet_length("text").alias("_bytes"))  # texts are not sorted with the turns
    got = sizes.groupBy("item").agg(F.array_sort(F.collect_set("node_id")).alias("b"), F.count("*").alias("t"), F.sum("_bytes").alias("bytes"))
    both = asked.join(got, "item", "full_outer")
    error = F.when(F.col("n") > most, "too many requests").when(~F.col("a").eqNullSafe(F.col("b")), "coverage").when((F.col("t") > most_turns) | (F.col("bytes") > most_bytes), "bounds")
    return both.select("item", error.alias("error"))
