"""Vector and score arithmetic on array<float> columns, widened to double."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_WEIGHTS = {"semantic": 1.0, "prior": 0.6, "lexical": 0.35, "temporal": 1.0}
RRF_K = 60


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_norm(a: Column) -> Column:
    """Null where it is zero or not finite."""
    n = F.sqrt(dot(a, a))
    return F.when((n > 0) & (n < float("inf")), n)


def valid_vector(a: Column, dimensions: int, unit: bool = False) -> Column:
    finite = F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = (F.size(a) == dimensions) & finite
    return ok & (F.abs(F.coalesce(l2_norm(a), F.lit(0.0)) - 1) <= 1e-4) if unit else ok


def cosine(a: Column, b: Column) -> Column:
    """In [-1, 1]; null for a zero vector."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (l2_norm(a) * l2_norm(b))))


def combine_hybrid(lexical: Column, semantic: Column, w_lexical: float = 0.45, w_semantic: float = 0.55) -> Column:
    total = w_lexical + w_semantic
    return (
        F.when((lexical > 0) & (semantic > 0), (lexical * w_lexical + semantic * w_semantic) / total)
        .when(lexical > 0, lexical).when(semantic > 0, semantic).otherwise(0.0)
    )


def rrf(**ranks: Column) -> Column:
    total = F.lit(0.0)
    for lane, rank in ranks.items():
        total = total + F.coalesce(F.lit(RRF_WEIGHTS[lane]) / (RRF_K + rank), F.lit(0.0))
    return total


def semantic_bonus(cos: Column) -> Column:
    """0 below 0.75, then 1 to 10."""
    return F.when(cos < 0.75, 0).otherwise(F.least(1 + F.floor((cos - 0.75) * 9 / 0.25), F.lit(10))).cast("int")


def percent_of(x: Column, percent: int) -> Column:
    return F.floor(x * percent / 100).cast("long")


def context_budgets(window: Column) -> Column:
    """Trigger 50 %, target 80 % of it, tail 50 % and summary 25 % of the target, input 80 % of the window."""
    trigger = percent_of(window, 50)
    target = percent_of(trigger, 80)
    return F.struct(
        trigger.alias("trigger"), target.alias("target"), percent_of(target, 50).alias("tail"),
        F.least(percent_of(target, 25), F.lit(10_000)).alias("summary"), percent_of(window, 80).alias("input"),
    )


def splitmix64(x: np.ndarray) -> np.ndarray:
    """The published SplitMix64 step on uint64."""
    with np.errstate(over="ignore"):
        z = x + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _splitmix(x: pd.Series) -> pd.Series:
    return pd.Series(splitmix64(x.to_numpy(np.int64).view(np.uint64)).view(np.int64))


def splitmix():
    return F.pandas_udf(_splitmix, "long")
