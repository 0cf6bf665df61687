"""Host-supplied models as columns: injected Python callables in Arrow batches, and strict checks of what they return."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def complete_json(f: Callable[[str], str]) -> Callable[[Column], Column]:
    """A general endpoint: payload JSON to answer JSON."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: None if x is None else f(x))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")


def embed(f: Callable[[list[str]], list[list[float]]]) -> Callable[[Column], Column]:
    """An embedding endpoint: a batch of texts at a time."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(f(batch.tolist()))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")


def first_route(*routes: Callable | None) -> Callable | None:
    """The dedicated, shared or adapted endpoint that is there."""
    return next((r for r in routes if r is not None), None)


def has_exactly(json: Column, keys: Sequence[str]) -> Column:
    """Whether a JSON object has exactly these keys."""
    own = F.json_object_keys(json)
    return F.coalesce(F.array_sort(own) == F.array_sort(F.array(*[F.lit(k) for k in keys])), F.lit(False))


def one_of(json: Column, key: str, values: Sequence[str]) -> Column:
    return F.coalesce(F.get_json_object(json, f"$.{key}").isin(list(values)), F.lit(False))


def payload(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def repaired(base: Column, patch: Column) -> Column:
    """JSON maps merged by missing keys: the base's values stay."""
    kind = "map<string,string>"
    a, b = F.from_json(base, kind), F.from_json(patch, kind)
    missing = F.map_filter(F.coalesce(b, F.create_map().cast(kind)), lambda k, v: ~F.coalesce(F.map_contains_key(a, k), F.lit(False)))
    return F.to_json(F.map_concat(F.coalesce(a, F.create_map().cast(kind)), missing))


def probes_compatible(cosines: Column, same_shape: Column) -> Column:
    """Whether the least cosine of the probe vectors lets two profiles share an index."""
    return same_shape & (F.array_min(cosines) + 1e-12 >= 0.99)


def decision(decide: Callable[[list, list], list], state: Column, questions: Column, keys: Sequence[str]) -> Column:
    """A decision endpoint: states and questions as JSON, a batch at a time; an answer without exactly these keys is null."""
    def run(states: pd.Series, asked: pd.Series) -> pd.Series:
        return pd.Series(decide(states.tolist(), asked.tolist()), index=states.index)

    run.__annotations__ = {"states": pd.Series, "asked": pd.Series, "return": pd.Series}
    answer = F.pandas_udf(run, "string")(state, questions)
    return F.when(has_exactly(answer, keys), answer)
