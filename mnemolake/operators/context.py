"""Context budgets: compaction plans and bounded evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def word_tokens(text: Column) -> Column:
    """The default counter of tokens: words."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))


def compaction_plan(rows: DataFrame, tail: int, budget: int, tokens: Column | None = None) -> DataFrame:
    """By conversation, each turn's part: ``tail`` (newest turns within the tail budget, one at least), ``compact`` (the
    oldest that fit the input budget) or ``wait``."""
    size = word_tokens(F.col("text")) if tokens is None else tokens
    up = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    w = rows.withColumn("_s", size).withColumns({"_up": F.sum("_s").over(up), "_down": F.sum("_s").over(down), "_last": F.max("turn").over(Window.partitionBy("conv_id"))})
    part = F.when((F.col("turn") == F.col("_last")) | (F.col("_down") <= tail), "tail").when(F.col("_up") <= budget, "compact").otherwise("wait")
    return w.select("conv_id", "turn", F.col("_s").alias("tokens"), part.alias("part"))


def assemble(items: DataFrame, most: int = 64, most_bytes: int = 128 * 1024) -> DataFrame:
    """Evidence by conversation in order, within item and byte bounds: (conv_id, position, label, text, bytes)."""
    w = Window.partitionBy("conv_id").orderBy("position")
    sized = items.withColumn("bytes", F.octet_length("text")).withColumns({"_n": F.row_number().over(w), "_b": F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return sized.where((F.col("_n") <= most) & (F.col("_b") <= most_bytes)).drop("_n", "_b")


def render_evidence(items: DataFrame) -> DataFrame:
    """One text by conversation: ``[label round=.. name=..]`` and the content, activity left out."""
    head = F.concat(F.lit("["), F.col("label"), F.concat(F.lit(" round="), F.col("round").cast("string")), F.coalesce(F.concat(F.lit(" name="), F.col("name")), F.lit("")), F.lit("]\n"), F.col("text"))
    parts = items.where("label <> 'activity'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", head.alias("t")))).alias("_p"))
    return parts.select("conv_id", F.array_join(F.transform("_p", lambda p: p["t"]), "\n").alias("evidence"))


def trim_summary(text: Column, budget: int) -> Column:
    """The longest prefix of whole words within a token budget."""
    words = F.regexp_extract_all(F.trim(text), F.lit(r"\s*\S+"), F.lit(0))
    return F.trim(F.array_join(F.slice(words, 1, budget), ""))
