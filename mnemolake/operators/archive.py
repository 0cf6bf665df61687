"""Conversation archive: turns, branches, fragments, packed segments, bounded search, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .versioned import running_total

ROLES = ("user", "assistant")


def turns(conversations: DataFrame) -> DataFrame:
    """Turns of linear conversations: the parent is the turn before."""
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = F.lag("turn").over(w).cast("string")
    return conversations.select(
        "conv_id", "turn", "role", "text", F.concat(conv, F.lit(":"), turn).alias("node_id"),
        F.when(before.isNotNull(), F.concat(conv, F.lit(":"), before)).alias("parent_id"),
    )


def activity_positions(rows: DataFrame, order: list[str], partition: str = "conv_id") -> DataFrame:
    """Ordinal among user and assistant turns over the whole archive, by the order given (partition first).

    Counted in each partition, then shifted by the counts before it, so no task sorts the whole archive."""
    active = F.when(F.col("role").isin(*ROLES), 1).otherwise(0)
    counts = rows.groupBy(partition).agg(F.sum(active).alias("_n"))
    base = running_total(counts, [partition], F.col("_n"), "_through").select(partition, (F.col("_through") - F.col("_n")).alias("_base"))
    own = F.sum(active).over(Window.partitionBy(partition).orderBy(*order))
    placed = rows.withColumn("_own", own).join(base, partition)
    return placed.withColumn("activity_position", F.when(active == 1, F.col("_own") + F.col("_base"))).drop("_own", "_base")


def branch_path(rows: DataFrame, leaves: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """Root-to-leaf turns of each leaf (``leaf`` column), by pointer doubling: log2(depth) joins."""
    link = rows.select("node_id", "parent_id")
    reach = leaves.select("leaf", F.col("leaf").alias("node_id"), F.lit(0).alias("up"))
    jump, step = link, 1
    while step <= max_depth:
        grown = reach.join(jump, "node_id").where(F.col("parent_id").isNotNull()).select("leaf", F.col("parent_id").alias("node_id"), (F.col("up") + step).alias("up"))
        if grown.isEmpty():
            break
        reach = reach.unionByName(grown)
        far = jump.select(F.col("node_id").alias("parent_id"), F.col("parent_id").alias("_far"))
        jump, step = jump.join(far, "parent_id", "left").select("node_id", F.col("_far").alias("parent_id")), step * 2
    depth = F.max("up").over(Window.partitionBy("leaf")) - F.col("up")
    return reach.withColumn("depth", depth).select("leaf", "node_id", "depth")


def fragment_id(conv: Column, start: Column, end: Column) -> Column:
    zero = F.lit(b"\0")
    return F.sha2(F.concat(conv.cast("binary"), zero, start.cast("binary"), zero, end.cast("binary"), zero), 256)


def fragments(rows: DataFrame, size: int = 8, overlap: int = 2, close_tail: bool = True) -> DataFrame:
    """Full windows of ``size`` turns every size - overlap, and the last ``size`` turns if they differ from the last window."""
    stride = size - overlap
    ranked = rows.select("conv_id", "node_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("i"))
    n = ranked.groupBy("conv_id").agg(F.count("*").alias("n"))
    starts = F.when(F.col("n") >= size, F.sequence(F.lit(0), (F.col("n") - size).cast("int"), F.lit(stride))).otherwise(F.array().cast("array<int>"))
    if close_tail:
        starts = F.array_distinct(F.concat(starts, F.array(F.greatest(F.col("n") - size, F.lit(0)).cast("int"))))
    windows = n.select("conv_id", "n", F.explode(starts).alias("a")).withColumn("b", F.least(F.col("a") + size, F.col("n")) - 1)
    first = ranked.select("conv_id", F.col("i").alias("a"), F.col("node_id").alias("start_node"))
    last = ranked.select("conv_id", F.col("i").alias("b"), F.col("node_id").alias("end_node"))
    found = windows.join(first, ["conv_id", "a"]).join(last, ["conv_id", "b"])
    return found.select("conv_id", "start_node", "end_node", fragment_id(F.col("conv_id").cast("string"), F.col("start_node"), F.col("end_node")).alias("fragment_id"))


def pack_segments(rows: DataFrame, max_turns: int = 24, max_bytes: int = 24_000) -> DataFrame:
    """Greedy segments: a turn opens a new one if it would exceed the turn or byte limit (a segment of zero bytes takes any)."""
    start = F.struct(F.lit(0).alias("seg"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("b"), F.array().cast("array<struct<turn:bigint,seg:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        full = (acc["n"] >= max_turns) | ((acc["b"] > 0) & (acc["b"] + x["size"] > max_bytes))
        seg = F.when(full, acc["seg"] + 1).otherwise(acc["seg"])
        return F.struct(
            seg.alias("seg"), F.when(full, 1).otherwise(acc["n"] + 1).alias("n"),
            F.when(full, x["size"]).otherwise(acc["b"] + x["size"]).alias("b"),
            F.concat(acc["out"], F.array(F.struct(x["turn"].alias("turn"), seg.alias("seg")))).alias("out"),
        )

    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", size.alias("size")))).alias("_t"))
    folded = lists.select("conv_id", F.explode(F.aggregate("_t", start, step, lambda acc: acc["out"])).alias("x"))
    return folded.groupBy("conv_id", F.col("x.seg").alias("segment")).agg(F.min("x.turn").alias("first_turn"), F.max("x.turn").alias("last_turn"), F.count("*").alias("n_turns"))


def segment_errors(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """Turns not covered once."""
    s = segments.select("conv_id", "first_turn", "last_turn")
    hit = rows.select("conv_id", "turn").join(s, "conv_id", "left").withColumn("_in", F.col("turn").between(F.col("first_turn"), F.col("last_turn")))
    return hit.groupBy("conv_id", "turn").agg(F.sum(F.when(F.col("_in"), 1).otherwise(0)).alias("covered")).where("covered <> 1")


def bounded_search(rows: DataFrame, needle: str, conv_id: int | None = None, limit: int = 5, max_nodes: int = 4096, max_bytes: int = 1 << 20, max_returned: int = 128 * 1024) -> DataFrame:
    """Case-insensitive substring search in accept order within scan budgets; ``truncated`` tells when one ended it.

    The order's head is cut to the node budget before anything is numbered (TakeOrderedAndProject)."""
    order = Window.orderBy("conv_id", "turn")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    head = rows.orderBy("conv_id", "turn").limit(max_nodes + 1)
    eligible = F.lit(True) if conv_id is None else F.col("conv_id") == conv_id
    size = F.octet_length(F.coalesce("text", F.lit("")))
    scanned = head.withColumns({"_rn": F.row_number().over(order), "_scan": F.sum(F.when(eligible, size).otherwise(0)).over(running)})
    inside = (F.col("_rn") <= max_nodes) & (F.col("_scan") <= max_bytes)
    hit = inside & eligible & F.contains(F.lower("text"), F.lit(needle.lower()))
    seen = scanned.withColumns({"_hit": hit.cast("int"), "_in": inside})
    seen = seen.withColumns({"_k": F.sum("_hit").over(running), "_out": F.sum(F.when(hit, size).otherwise(0)).over(running), "_cut": F.max(F.when(~F.col("_in"), 1).otherwise(0)).over(Window.partitionBy())})
    more = F.max(F.when((F.col("_hit") == 1) & ((F.col("_k") > limit) | (F.col("_out") > max_returned)), 1).otherwise(0)).over(Window.partitionBy())
    return seen.withColumn("truncated", (F.greatest(F.col("_cut"), more) == 1)).where((F.col("_hit") == 1) & (F.col("_k") <= limit) & (F.col("_out") <= max_returned)).select("conv_id", "turn", "role", "truncated")


def turn_range(rows: DataFrame, conv_id: int, first: int, last: int, max_turns: int = 64, max_bytes: int = 128 * 1024) -> DataFrame:
    """Turns [first, last] of a conversation, or an error row if they exceed the bounds: never cut silently."""
    part = rows.where((F.col("conv_id") == conv_id) & F.col("turn").between(first, last))
    w = Window.partitionBy("conv_id")
    over = (F.count("*").over(w) > max_turns) | (F.sum(F.octet_length("text")).over(w) > max_bytes)
    return part.withColumn("_over", over).withColumn("text", F.when(~F.col("_over"), F.col("text")).otherwise(F.raise_error(F.lit("range exceeds the bounds")))).drop("_over")


def transcript_page(rows: DataFrame, conv_id: int, offset: int, limit: int) -> DataFrame:
    """Root-to-leaf page without contents."""
    part = rows.where(F.col("conv_id") == conv_id).select("conv_id", "turn", "role", "node_id")
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return part.withColumn("_rn", rn).where((F.col("_rn") > offset) & (F.col("_rn") <= offset + limit)).drop("_rn")


def advance_branches(rows: DataFrame, heads: DataFrame, proposals: DataFrame) -> DataFrame:
    """The verdict of each new leaf (conv_id, branch, leaf): a branch moves only to a leaf that descends from its own."""
    old = heads.select("conv_id", "branch", F.col("leaf").alias("_old"))
    path = branch_path(rows, proposals.select("leaf").distinct()).select("leaf", F.col("node_id").alias("_old"), F.lit(True).alias("_above"))
    node = rows.select(F.col("node_id").alias("leaf"), F.lit(True).alias("_known"))
    joined = proposals.join(node, "leaf", "left").join(old, ["conv_id", "branch"], "left").join(path, ["leaf", "_old"], "left")
    verdict = (
        F.when(F.col("_known").isNull(), "unknown node").when(F.col("_old").isNull(), "created").when(F.col("_old") == F.col("leaf"), "unchanged")
        .when(F.col("_above"), "advanced").otherwise("not a descendant")
    )
    return joined.select("conv_id", "branch", "leaf", verdict.alias("verdict"))


def read_turn(rows: DataFrame, conv_id: int, turn: int, max_bytes: int = 128 * 1024) -> DataFrame:
    """One turn, or an error if its text exceeds the bytes allowed: never cut silently."""
    text = F.when(F.octet_length(F.coalesce("text", F.lit(""))) <= max_bytes, F.col("text")).otherwise(F.raise_error(F.lit("the turn exceeds the bound")))
    return rows.where((F.col("conv_id") == conv_id) & (F.col("turn") == turn)).withColumn("text", text)


def ancestor_slice(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Turns on the way from ``start`` down to ``end`` for each range (range_id, start, end); none if start is no ancestor."""
    path = branch_path(rows, ranges.select(F.col("end").alias("leaf")).distinct())
    begun = ranges.join(path.select(F.col("leaf").alias("end"), F.col("node_id").alias("start"), F.col("depth").alias("_from")), ["end", "start"])
    return begun.join(path.withColumnRenamed("leaf", "end"), "end").where(F.col("depth") >= F.col("_from")).select("range_id", "node_id", (F.col("depth") - F.col("_from")).alias("place"))
