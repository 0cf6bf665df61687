"""Sharding by a hypergeometric communication matrix.

Rows are dealt to P logical partitions by a hash.  The counts of a uniform shuffle - how many rows of each
partition go to each shard - follow a multivariate hypergeometric law; that P x shards matrix is drawn exactly,
so row sums are the partitions' sizes and column sums the shards' sizes (at most one apart).  Each partition is
then permuted locally and cut at the drawn counts, rows are exchanged, and each shard is permuted again.

All of that moves row numbers and hashes only; the rows themselves are written once, with their numbers, and
exchanged once, when they meet their places.  A partition of over ``HOT`` times the mean (rows of one identity:
null or repeated ids) is split by row number into parts of the mean size, which are partitions of their own.

The matrix has at most (2 P + 1) x shards numbers, both parameters, so what is drawn on the driver and sent to the
tasks does not grow with the data.  The second permutation numbers rows inside slices of a shard and adds the
slices' offsets, so no task sorts a whole shard.

Defined results: null texts have size 8 and the checksum of no bytes; null or repeated ids are rows like any
other; an empty table gives no rows; columns of the input are kept, but for those named like the two added ones.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import materialise, packed, quoted

SHARDS = 24
PARTITIONS = 1024
SLICES = 64
HOT = 4
#: Partitions below so many rows are not split.
MANY = 10_000
#: numpy draws exactly from fewer rows than this.
LIMIT = 1_000_000_000
SEED = 20261127


def _stirling(n: float) -> float:
    """log n! less Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n > 0 else 0.0
    x = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * x)) / x) / x) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x without cancellation."""
    d = (x - mean) / (x + mean)
    if abs(d) < 0.1:
        total, term, k = (x - mean) * d, 2 * x * d, 1
        while True:
            term *= d * d
            more = total + term / (2 * k + 1)
            if more == total:
                return total
            total, k = more, k + 1
    return (x * math.log(x / mean) if x > 0 else 0.0) + mean - x


def _log_binomial(x: int, n: int, p: float) -> float:
    """log of the probability of x successes in n, to double precision at any n."""
    if x in (0, n):
        return n * (math.log(p) if x else math.log1p(-p))
    core = _stirling(n) - _stirling(x) - _stirling(n - x) - _deviance(x, n * p) - _deviance(n - x, n * (1 - p))
    return core + 0.5 * math.log(n / (2 * math.pi * x * (n - x)))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int, limit: int = LIMIT) -> int:
    """Draws of the good kind among n of good + bad, exact at every size.

    Beyond ``limit``: of independent binomials X of good and Y of bad, with one p, X has this law given X + Y = n.  So X is
    drawn and accepted with the probability of Y = n - X over that of Y's mode, from the smaller kind, where most are accepted."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < limit:
        return int(rng.hypergeometric(good, bad, n))
    if n == good + bad:
        return good
    if good > bad:
        return n - hypergeometric(rng, bad, good, n, limit)
    p = n / (good + bad)
    top = _log_binomial(min(int((bad + 1) * p), bad), bad, p)
    while True:
        x = int(rng.binomial(good, p))
        if 0 <= n - x <= bad and math.log(1 - rng.random()) <= _log_binomial(n - x, bad, p) - top:
            return x


def communication_matrix(sizes: list[int], shard_sizes: list[int], seed: int) -> list[list[int]]:
    """One row of counts for each partition; rows sum to ``sizes``, columns to ``shard_sizes``."""
    rng = np.random.default_rng(seed)
    left = list(shard_sizes)
    matrix = []
    for size in sizes:
        row, need, rest = [], size, sum(left)
        for s, room in enumerate(left):
            rest -= room
            k = hypergeometric(rng, room, rest, need)
            row.append(k)
            need -= k
            left[s] -= k
        matrix.append(row)
    return matrix


def even_sizes(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def _inline(spark: SparkSession, rows: list[str], columns: str) -> DataFrame:
    return spark.sql(f"select * from values {', '.join(rows)} as t({columns})")


def shuffle_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    partitions: int = PARTITIONS,
    seed: int = SEED,
    identity: list[str] | None = None,
    shard_col: str = "shard",
    slot_col: str = "slot",
) -> DataFrame:
    """Add the shard (0 to shards - 1) and the slot in it (gapless from 0) of a uniform shuffle.

    ``identity``: the columns whose hash permutes the rows; rows equal in them are ordered by their numbers."""
    spark = docs.sparkSession
    whole = packed(docs)
    own = [F.col(f"row.{quoted(c)}") for c in (identity or ["doc_id"])]
    dealt = materialise(whole.select("row", F.xxhash64(F.lit(seed), *own).alias("h"), F.monotonically_increasing_id().alias("uid")), "dealt")
    p = F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.lit(partitions)).cast("int")
    counts = dict(dealt.groupBy(p.alias("p")).agg(F.count("*")).collect())  # at most `partitions` rows
    total = sum(counts.values())
    names = [F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns if c.lower() not in (shard_col.lower(), slot_col.lower())]
    if not total:
        return dealt.select(*names, F.lit(0).alias(shard_col), F.lit(0).cast("long").alias(slot_col))
    mean = -(-total // partitions)
    first, spread = partitions, []
    for k, n in sorted(counts.items()):
        if n > max(HOT * mean, MANY):
            spread.append(f"({k}, {first}, {-(-n // max(mean, MANY))})")
            first += -(-n // max(mean, MANY))
    slim = dealt.select("uid", "h", p.alias("p"))
    if spread:
        split = F.broadcast(_inline(spark, spread, "hot, first, parts"))
        slim = slim.join(split, F.col("p") == F.col("hot"), "left").select("uid", "h", F.coalesce(F.col("first") + F.pmod(F.xxhash64(F.lit(seed + 2), "uid"), F.col("parts")), "p").cast("int").alias("p"))
        counts = dict(slim.groupBy("p").agg(F.count("*")).collect())  # at most 2 x `partitions` + 1 rows
    parts = sorted(counts)
    matrix = communication_matrix([counts[k] for k in parts], even_sizes(total, shards), seed)
    bounds = _inline(spark, [f"({k}, array({', '.join(f'{x}L' for x in np.cumsum(row).tolist())}))" for k, row in zip(parts, matrix)], "p, bounds")
    local = F.row_number().over(Window.partitionBy("p").orderBy(F.xxhash64(F.lit(seed + 3), "h"), "h", "uid")).cast("long")
    cut = slim.withColumn("rank", local).join(F.broadcast(bounds), "p")
    again = F.xxhash64(F.lit(seed + 4), "h", "p", "rank")
    sent = materialise(
        cut.select("uid", F.size(F.filter("bounds", lambda b: b < F.col("rank"))).alias("s"), again.alias("again"), F.pmod(F.shiftrightunsigned(again, 32), F.lit(SLICES)).cast("int").alias("slice")),
        "sent",
    )
    sizes = sent.groupBy("s", "slice").agg(F.count("*").alias("n"))  # at most shards x SLICES rows
    offset, rows, last = 0, [], None
    for s, part, n in sorted(tuple(r) for r in sizes.collect()):
        offset = 0 if s != last else offset
        rows.append(f"({s}, {part}, {offset}L)")
        offset, last = offset + n, s
    offsets = _inline(spark, rows, "s, slice, ahead")
    place = F.row_number().over(Window.partitionBy("s", "slice").orderBy("again", "uid"))
    placed = sent.withColumn("place", place).join(F.broadcast(offsets), ["s", "slice"]).select("uid", "s", (F.col("ahead") + F.col("place") - 1).alias("slot"))
    return dealt.select("row", "uid").join(placed, "uid").select(*names, F.col("s").alias(shard_col), F.col("slot").alias(slot_col))


def digest(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    done = shuffle_shards(slim, identity=["doc_id", "text_crc32"])
    return done.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
