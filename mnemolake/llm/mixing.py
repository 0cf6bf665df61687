"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic).  The cells' token weights are raked to the three target
marginals in turn until every marginal holds.  A document of a cell is then kept with the calibrated probability
(cell's target tokens / cell's tokens, at most 1; what a full cell cannot give is taken from the others in
proportion), decided by a hash of its id, so a rerun picks the same documents.

Targets default to the corpus shares tempered by an exponent, which lifts small sources and languages.

Only cell totals leave the executors, and only while there are at most ``MAX_CELLS``; with more cells the raking
itself runs as joins and aggregations on a table of cells, with the same targets, rounds, tolerance and results.

Defined results: null source, language or text count as values of their own ("", and no tokens); a document
without words weighs one token, so that it has a cell; rows that repeat an id are kept or dropped together; an
empty table gives no rows; the input's columns are kept, but for one named like the struct that is added.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import drop, materialise, packed, quoted

DIMENSIONS = ("source", "lang", "topic")
MAX_CELLS = 100_000
TEMPER = 0.7
BUDGET = 0.7
ROUNDS = 50
TOLERANCE = 1e-9
SEED = 7


def topic(text: Column) -> Column:
    """A coarse subject from a text's form: tables, figures, code-like, shouted or plain prose."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / n
    return (
        F.when(share(r"\|") > 0.02, "table")
        .when(share("[0-9]") > 0.15, "figures")
        .when(share(r"\p{Lu}") > 0.35, "shouted")
        .when(n >= 4000, "long prose")
        .otherwise("prose")
    )


def _cell(topics: Column | None = None) -> Column:
    """Source, language, topic and tokens of ``row``."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return F.struct(
        F.coalesce(F.col("row.source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col("row.lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(topic(text) if topics is None else topics, F.lit("")).alias("topic"),
        F.greatest(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("long").alias("tokens"),
    )


def tempered(shares: dict[str, float], power: float = TEMPER) -> dict[str, float]:
    total = sum(shares.values())
    raised = {k: (v / total) ** power for k, v in shares.items() if v > 0}
    return {k: v / sum(raised.values()) for k, v in raised.items()}


def rake(cells: dict[tuple, float], targets: list[dict[str, float]], rounds: int = ROUNDS) -> dict[tuple, float]:
    """Weights of the cells, sum 1, whose marginals are the targets (as near as the cells allow)."""
    total = sum(cells.values())
    w = {k: v / total for k, v in cells.items()}
    for _ in range(rounds):
        worst = 0.0
        for d, target in enumerate(targets):
            now: dict[str, float] = defaultdict(float)
            for k, v in w.items():
                now[k[d]] += v
            factor = {x: target.get(x, 0.0) / v if v > 0 else 0.0 for x, v in now.items()}
            worst = max([worst, *(abs(target.get(x, 0.0) - v) for x, v in now.items())])
            w = {k: v * factor[k[d]] for k, v in w.items()}
        if worst < TOLERANCE:
            break
    return w


def probabilities(cells: dict[tuple, float], weights: dict[tuple, float], budget: float) -> dict[tuple, float]:
    """Probability of keeping a document of each cell: expected tokens are budget x total, as weighted."""
    want = budget * sum(cells.values())
    full: set[tuple] = set()
    while True:
        room = want - sum(cells[k] for k in full)
        rest = sum(v for k, v in weights.items() if k not in full)
        scale = room / rest if rest > 0 else 0.0
        over = {k for k, v in weights.items() if k not in full and v * scale >= cells[k]}
        if not over:
            return {k: 1.0 if k in full else max(0.0, weights[k] * scale / cells[k]) for k in cells}
        full |= over


def _goal(spark, cells: DataFrame, d: str, total: float, target: dict[str, float] | None, power: float) -> DataFrame:
    if target:
        return spark.createDataFrame([(str(k), float(x)) for k, x in target.items()], f"{d} string, goal double")
    raised = cells.groupBy(d).agg(F.pow(F.sum("tokens") / F.lit(total), F.lit(power)).alias("goal"))
    return raised.withColumn("goal", F.col("goal") / F.lit(raised.agg(F.sum("goal")).first()[0]))


def _rake_table(cells: DataFrame, targets: dict[str, dict[str, float]] | None, power: float, budget: float) -> DataFrame:
    """``rake`` and ``probabilities`` on a table of cells: a join and an aggregation for each marginal, lineage cut each round."""
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("tokens")).first()[0])
    w = cells.withColumn("w", F.col("tokens") / F.lit(total))
    goals = {d: materialise(_goal(spark, cells, d, total, (targets or {}).get(d), power), "goal") for d in DIMENSIONS}
    last = None
    for _ in range(ROUNDS):
        worst = 0.0
        for d in DIMENSIONS:
            now = materialise(w.groupBy(d).agg(F.sum("w").alias("now")).join(goals[d], d, "left").select(d, "now", F.coalesce("goal", F.lit(0.0)).alias("goal")), "marginal")
            worst = max(worst, now.agg(F.max(F.abs(F.col("goal") - F.col("now")))).first()[0])
            factor = now.select(d, F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(0.0).alias("factor"))
            w = w.join(factor, d).withColumn("w", F.col("w") * F.col("factor")).select(*DIMENSIONS, "tokens", "w")
            w = materialise(w, "rake")
            if last is not None:
                drop(last)
            last = w
        if worst < TOLERANCE:
            break
    want = budget * total
    full = materialise(w.where("false"), "full")
    while True:
        room = want - (full.agg(F.sum("tokens")).first()[0] or 0)
        free = w.join(full.select(*DIMENSIONS), list(DIMENSIONS), "left_anti")
        rest = free.agg(F.sum("w")).first()[0] or 0.0
        scale = room / rest if rest > 0 else 0.0
        over = materialise(free.where(F.col("w") * F.lit(scale) >= F.col("tokens")), "over")
        if over.isEmpty():
            break
        full = materialise(full.unionByName(over), "full")
    given = full.select(*DIMENSIONS, F.lit(1.0).alias("given"))
    p = F.coalesce("given", F.greatest(F.lit(0.0), F.col("w") * F.lit(float(scale)) / F.col("tokens")))
    return w.join(given, list(DIMENSIONS), "left").select(*DIMENSIONS, F.col("w").alias("weight"), p.alias("probability"))


def _weighed(df: DataFrame, targets: dict[str, dict[str, float]] | None, power: float, budget: float, max_cells: int) -> DataFrame:
    """(row, cell) with weight, probability and picked."""
    spark = df.sparkSession
    cells = materialise(df.groupBy(*[F.col(f"cell.{d}").alias(d) for d in DIMENSIONS]).agg(F.sum("cell.tokens").alias("tokens")), "cells")
    few = cells.limit(max_cells + 1).count() <= max_cells
    if few:
        table = {tuple(r[:3]): float(r[3]) for r in cells.collect()}  # at most max_cells rows
        if not table:
            return df.withColumns({"weight": F.lit(0.0), "probability": F.lit(0.0), "picked": F.lit(False)})
        goals = []
        for k, d in enumerate(DIMENSIONS):
            shares: dict[str, float] = defaultdict(float)
            for cell, n in table.items():
                shares[cell[k]] += n
            goals.append((targets or {}).get(d) or tempered(shares, power))
        weights = rake(table, goals)
        p = probabilities(table, weights, budget)
        rows = [(*k, float(weights[k]), float(p[k])) for k in sorted(table)]
        found = spark.createDataFrame(rows, "source string, lang string, topic string, weight double, probability double")
    else:
        found = _rake_table(cells, targets, power, budget)
    same = [F.col(f"cell.{d}") == F.col(d) for d in DIMENSIONS]
    joined = df.join(F.broadcast(found) if few else found, same)
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col("row.doc_id")), 11) / F.lit(float(1 << 53))
    return joined.select("row", "cell", "weight", "probability", (chance < F.col("probability")).alias("picked"))


def calibrated(
    docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = TEMPER, budget: float = BUDGET,
    max_cells: int = MAX_CELLS, topics: str | None = None, into: str = "_mix",
) -> DataFrame:
    """The documents with the struct ``into``: source, lang, topic, tokens, weight (of the cell), probability and picked.

    ``topics`` names a column that holds topics; without it a coarse form of the text stands for one."""
    own = None if topics is None else F.col(f"row.{quoted(topics)}").cast("string")
    done = _weighed(packed(docs).withColumn("cell", _cell(own)), targets, power, budget, max_cells)
    kept = [F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns if c.lower() != into.lower()]
    return done.select(*kept, F.struct("cell.*", "weight", "probability", "picked").alias(into))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The sampled documents, with the columns they came with."""
    topics = options.pop("topics", None)
    own = None if topics is None else F.col(f"row.{quoted(topics)}").cast("string")
    usual = {"targets": None, "power": TEMPER, "budget": BUDGET, "max_cells": MAX_CELLS}
    return _weighed(packed(docs).withColumn("cell", _cell(own)), **(usual | options)).where("picked").select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    cells = packed(docs).select(F.struct("row.doc_id").alias("row"), _cell().alias("cell"))
    done = _weighed(materialise(cells, "cells-of-documents"), None, TEMPER, BUDGET, MAX_CELLS)  # the texts are read once
    return done.select("row.doc_id", "cell.source", "cell.lang", "cell.topic", "cell.tokens", "weight", "probability", F.col("picked").alias("selected"))
