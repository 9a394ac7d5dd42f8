"""Extension points: named transforms of tables, named steps of texts, record mappers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame

Transform = Callable[[DataFrame], DataFrame]
TRANSFORMS: dict[str, Transform] = {}
#: Steps of the profile runner: a text to a text.
STEPS: dict[str, Callable[[Column], Column]] = {}


def register(name: str, transform: Transform) -> None:
    """Makes a DataFrame transform known by name."""
    TRANSFORMS[name] = transform


def register_step(name: str, step: Callable[[Column], Column]) -> None:
    """Makes a step of texts known by name: profiles may list it in their flag ``own_steps``, ``perturb.compose`` takes it by name."""
    STEPS[name] = step


def apply(df: DataFrame, *names: str) -> DataFrame:
    """The named transforms one after the other."""
    for name in names:
        df = df.transform(TRANSFORMS[name])
    return df


def map_records(df: DataFrame, mapper: Callable[[dict], dict | None], schema) -> DataFrame:
    """A Python mapper per record in Arrow batches; records mapped to nothing are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = [out for out in map(mapper, batch.to_dict("records")) if out]
            if kept:
                yield pd.DataFrame(kept)

    return df.mapInPandas(run, schema)
