"""Benchmark decontamination by spaced-seed hashing.

A mask keeps some places of a span of tokens and ignores the others, so a seed matches although an ignored token
was replaced.  Seeds of the test items and of the documents meet in an equality join; each hit fixes an
alignment (document, item, shift), and the aligned tokens around it are compared one by one: a document is
contaminated when a window of ``window`` aligned tokens (the whole item, if shorter) agrees in ``percent`` of them.

Items' seeds are broadcast only while they are at most ``BROADCAST_SEEDS``; beyond, the same join shuffles.

Defined results: null or empty texts are never contaminated; items with fewer than ``LEAST_TOKENS`` tokens are
too short to tell and match nothing; rows that repeat an id share its verdict; null ids are judged by nothing and
stay; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import among, materialise, packed, without

#: Fixed masks: 1 compares the token, 0 ignores it.  Each begins with 11.  However the tokens that PERCENT lets differ lie
#: in a window (or in an item shorter than one), one of these matches inside it, so no window is lost.
MASKS = ("111011", "11001011", "11111")
LEAST_TOKENS = 8
WINDOW = 20
PERCENT = 80
#: Size bounds of what goes to every task: seeds of items, and the pairs of words that begin them.
BROADCAST_SEEDS = 1_000_000
BROADCAST_PAIRS = 100_000
#: And whole items, by number and bytes.
BROADCAST_ITEMS = 10_000
BROADCAST_BYTES = 32 << 20


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; all beyond ASCII counts as a letter."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-/:-`{-\x7F]+"), "")


def _seeds(tok: str, starts: Column) -> Column:
    """(place, hash) of the seed of each mask at each of the places, spans that end in the text only."""
    n = F.size(tok)

    def of(k: int, mask: str) -> Column:
        kept = [j for j, c in enumerate(mask) if c == "1"]
        fits = F.filter(starts, lambda i: i <= n - len(mask))
        return F.transform(
            fits, lambda i: F.struct(i.alias("i"), F.xxhash64(F.lit(k), *[F.get(tok, i + j) for j in kept]).alias("h"))
        )

    return F.concat(*[of(k, m) for k, m in enumerate(MASKS)])


def _pair(tok: str, i: Column) -> Column:
    return F.xxhash64(F.get(tok, i), F.get(tok, i + 1))


def _places(tok: str) -> Column:
    n = F.size(tok)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _exploded(df: DataFrame, id_col: str, place: str) -> DataFrame:
    """One row for each seed of ``_tok`` at ``_at``: id, place, hash."""
    return df.select(id_col, F.explode(_seeds("_tok", F.col("_at"))).alias("_s")).select(
        id_col, F.col("_s.i").alias(place), F.col("_s.h").alias("_h")
    )


def alignments(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (doc_id, item_id, shift) on which a document and an item share a seed."""
    known = items.select("item_id", tokens(F.col("text")).alias("_tok")).where(F.size("_tok") >= LEAST_TOKENS)
    known = known.withColumn("_at", _places("_tok"))
    item_seeds = materialise(_exploded(known, "item_id", "_j").distinct(), "seeds")
    few = item_seeds.count() <= BROADCAST_SEEDS
    first = known.select(F.explode("_at").alias("_i"), "_tok").select(_pair("_tok", F.col("_i")).alias("h")).distinct()
    pairs = [r[0] for r in first.limit(BROADCAST_PAIRS + 1).collect()]  # bounded
    read = docs.where("doc_id is not null").select("doc_id", tokens(F.col("text")).alias("_tok"))
    # A seed can only meet an item's seed if its first two tokens begin one: places are dropped before seeds are hashed.
    starts = _places("_tok")
    if pairs and len(pairs) <= BROADCAST_PAIRS:
        starts = F.filter(starts, lambda i: _pair("_tok", i).isin(pairs))
    doc_seeds = _exploded(read.withColumn("_at", starts), "doc_id", "_i")
    hits = doc_seeds.join(F.broadcast(item_seeds) if few else item_seeds, "_h")
    return hits.select("doc_id", "item_id", (F.col("_i") - F.col("_j")).alias("shift")).distinct()


def _overlap() -> Column:
    """Most agreeing tokens in a window: a running sum of what enters less what leaves.

    Arrays are arguments of functions here and not captured by a lambda, so each is made once a row."""
    d, t, shift = F.col("_doc.tokens"), F.col("_it"), F.col("shift")
    n = F.size(t)
    width = F.least(n, F.lit(WINDOW))
    agree = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda j: F.when((shift + j >= 0) & (F.get(d, shift + j) == F.get(t, j)), 1).otherwise(0),
    )
    left = F.slice(F.concat(F.array_repeat(F.lit(0), width), agree), F.lit(1), n)
    return F.aggregate(
        F.zip_with(agree, left, lambda a, b: a - b),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda acc, x: F.struct((acc["now"] + x).alias("now"), F.greatest(acc["most"], acc["now"] + x).alias("most")),
        lambda acc: acc["most"],
    )


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Verified (doc_id, item_id, matched, width): the best window of each document and item."""
    known = items.select("item_id", tokens(F.col("text")).alias("_it")).distinct()
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    small = n <= BROADCAST_ITEMS and size <= BROADCAST_BYTES
    found = materialise(alignments(docs, items), "alignments")
    pairs = found.join(F.broadcast(known) if small else known, "item_id")
    texts = among(docs.select("doc_id", F.col("text").alias("_text")), "doc_id", found.select("doc_id"))
    checked = pairs.join(texts, "doc_id")
    # not deterministic, so the filter below stays above the tokens instead of making them for each use
    checked = checked.withColumn("_doc", F.struct(tokens(F.col("_text")).alias("tokens"), F.monotonically_increasing_id().alias("barrier")))
    scored = checked.select(
        "doc_id", "item_id", _overlap().alias("matched"), F.least(F.size("_it"), F.lit(WINDOW)).alias("width")
    ).where(100 * F.col("matched") >= PERCENT * F.col("width"))
    return scored.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("width").alias("width"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a verified overlap, with the columns they came with."""
    hit = overlaps(docs.select("doc_id", "text"), items.select("item_id", "text")).select("doc_id")
    return without(packed(docs).withColumn("id", F.col("row.doc_id")), "id", hit).select("row.*")


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each contaminated document."""
    return (
        overlaps(docs.select("doc_id", "text"), items.select("item_id", "text"))
        .groupBy("doc_id")
        .agg(
            F.count("*").alias("n_items"),
            F.max(F.col("matched") / F.col("width")).alias("overlap"),
            F.min("item_id").alias("first_item_id"),
        )
    )
