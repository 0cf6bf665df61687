"""Candidates for pairing a memory with others: the discovery pool, its scores, and the ranking from end to end.

Memories are (id, birth, time, vector, terms, ...): ``birth`` orders first versions, ``time`` may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard
from ..functions.vectors import cosine, splitmix64
from . import organise as O

SMALL = 128
TABLES, BITS = 4, 12
PER_BUCKET, SEMANTIC = 16, 64
RAREST, POSTINGS, LEXICAL = 16, 4, 32
IN_TIME, RECENT = 12, 8
SAME = 0.08


def locality_planes(dimensions: int) -> list[list[tuple[int, int, int]]]:
    """For each table and bit: two components and the sign of the second.  A bit is set if their signed sum is not negative."""
    import numpy as np

    mix = lambda x: int(splitmix64(np.array([x], np.uint64))[0])
    seeds = [[bit + 1 + table * 97 for bit in range(BITS)] for table in range(TABLES)]
    return [[(mix(s) % dimensions, mix(s + 1009) % dimensions, 1 if mix(s + 2017) % 2 == 0 else -1) for s in row] for row in seeds]


def locality_codes(vector: Column, dimensions: int) -> Column:
    """The codes of a vector, one a table."""
    bit = lambda i, j, sign: F.get(vector, F.lit(i)).cast("float") + sign * F.get(vector, F.lit(j)).cast("float") >= 0
    codes = [sum((F.when(bit(*p), 1 << k).otherwise(0) for k, p in enumerate(row)), F.lit(0)) for row in locality_planes(dimensions)]
    return F.array(*codes)


def semantic_pool(memories: DataFrame, sources: DataFrame, dimensions: int) -> DataFrame:
    """(source, id): the first ``SEMANTIC`` ids over tables, probes (the code itself, then one bit flipped) and ids.

    A bucket offers its ``PER_BUCKET`` least ids, so pairs grow with the sources and not with a bucket."""
    coded = lambda df: df.where("vector is not null").select("id", F.posexplode(locality_codes(F.col("vector"), dimensions)).alias("table", "code"))
    place = F.row_number().over(Window.partitionBy("table", "code").orderBy("id"))
    buckets = coded(memories).withColumn("_k", place).where(F.col("_k") <= PER_BUCKET).drop("_k")
    flips = F.array(F.lit(0), *[F.lit(1 << b) for b in range(BITS)])
    probes = coded(sources).select(F.col("id").alias("source"), "table", "code", F.posexplode(flips).alias("probe", "flip"))
    probes = probes.select("source", "table", "probe", F.col("code").bitwiseXOR(F.col("flip")).alias("code"))
    met = probes.join(buckets, ["table", "code"]).where("source <> id").groupBy("source", "id").agg(F.min(F.struct("table", "probe")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy("first", "id"))
    return met.withColumn("_k", rank).where(F.col("_k") <= SEMANTIC).select("source", "id")


def lexical_pool(memories: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, id): the first ``LEXICAL`` ids over the source's rarest terms, the ``POSTINGS`` least ids of each."""
    terms = memories.select("id", F.explode("terms").alias("term"))
    count = terms.groupBy("term").agg(F.count("*").alias("df"))
    asked = sources.select(F.col("id").alias("source"), F.explode("terms").alias("term")).join(count, "term")
    rare = F.row_number().over(Window.partitionBy("source").orderBy("df", "term"))
    mine = asked.withColumn("at", rare).where(F.col("at") <= RAREST)
    place = F.row_number().over(Window.partitionBy("term").orderBy("id"))
    few = terms.withColumn("_k", place).where(F.col("_k") <= POSTINGS).drop("_k")
    met = mine.join(few, "term").where("source <> id").groupBy("source", "id").agg(F.min("at").alias("at"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy("at", "id"))
    return met.withColumn("_k", rank).where(F.col("_k") <= LEXICAL).select("source", "id")


def ordered_pool(memories: DataFrame, sources: DataFrame, order: str, before: int, after: int) -> DataFrame:
    """(source, id): the memories next before and after each source in an order (then id), nulls left out.

    Ranges of the order at quantiles are numbered each on its own and shifted, so no task sorts the table; the
    neighbours are then looked up by number."""
    from .versioned import with_versions

    placed = with_versions(memories.where(F.col(order).isNotNull()).select("id", F.col(order).cast("long").alias("o")), ["o", "id"], "n")
    mine = placed.join(sources.select("id"), "id", "left_semi").select(F.col("id").alias("source"), "n")
    steps = [k for k in range(-before, after + 1) if k]
    wanted = mine.select("source", F.explode(F.array(*[F.col("n") + k for k in steps])).alias("n"))
    return wanted.join(placed, "n").select("source", "id")


def discovery_pool(memories: DataFrame, sources: DataFrame, dimensions: int) -> DataFrame:
    """(source, id): all others where there are at most ``SMALL`` memories; else the union of four bounded lanes."""
    if memories.limit(SMALL + 1).count() <= SMALL:
        return sources.select(F.col("id").alias("source")).join(F.broadcast(memories.select("id"))).where("source <> id")  # at most SMALL ids
    lanes = (
        semantic_pool(memories, sources, dimensions), lexical_pool(memories, sources),
        ordered_pool(memories, sources, "time", IN_TIME, IN_TIME), ordered_pool(memories, sources, "birth", RECENT, 0),
    )
    pool = lanes[0]
    for lane in lanes[1:]:
        pool = pool.unionByName(lane)
    return pool.where("source <> id").distinct()


def scored(pool: DataFrame, memories: DataFrame) -> DataFrame:
    """The pool with its lane scores: cosine, token overlap with shares for equal category and kind, temporal if given."""
    left = memories.select(F.col("id").alias("source"), *[F.col(c).alias(f"s_{c}") for c in ("vector", "terms", "category", "kind", "time")])
    both = pool.join(left, "source").join(memories, "id")
    same = lambda c: F.when(F.col(c).eqNullSafe(F.col(f"s_{c}")), SAME).otherwise(0.0)
    return both.select(
        "source", "id", cosine(F.col("s_vector"), F.col("vector")).alias("semantic"), (jaccard(F.col("s_terms"), F.col("terms")) + same("category") + same("kind")).alias("lexical"),
        F.col("s_time").alias("source_time"), "time",
    )


def ranked(memories: DataFrame, sources: DataFrame, evaluated: DataFrame, edges: DataFrame, dimensions: int, temporal: DataFrame | None = None, pool: DataFrame | None = None) -> DataFrame:
    """From end to end: pool, without evaluated and related pairs, scores of the lanes, fusion and selection.

    A caller that has made the discovery pool passes it on."""
    pool = discovery_pool(memories, sources, dimensions) if pool is None else pool
    pair = lambda df: df.withColumns({"a": F.least("source", "id"), "b": F.greatest("source", "id")})
    open_pairs = O.unseen_pairs(pair(pool).select("a", "b"), evaluated, edges)
    rows = scored(pair(pool).join(open_pairs, ["a", "b"], "left_semi").select("source", "id"), memories)
    if temporal is None:
        rows = rows.withColumn("temporal", F.lit(None).cast("double"))
    else:
        rows = rows.join(temporal.select("source", "id", "temporal"), ["source", "id"], "left")
    return O.select(rows)


def push(frontier: DataFrame, batch: DataFrame) -> DataFrame:
    """The frontier after one more batch of scored candidates: those that some lane still ranks.

    Lanes are bounded, so the frontier is; after the last batch its ranks are those of all candidates at once."""
    columns = ["source", "id", "semantic", "lexical", "temporal", "source_time", "time"]
    both = O.lane_ranks(frontier.select(*columns).unionByName(batch.select(*columns)))
    return both.where(F.coalesce(*[f"r_{k}" for k in O.LANES]).isNotNull())
