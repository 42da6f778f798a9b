"""Models fitted on bounded samples, in one task, so that no texts reach the driver."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashed_sample(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """At most about ``limit`` rows, those whose keys have the smallest hashes.

    Only hashes are sorted; the rows are found again by the largest hash taken,
    so rows that are not taken do not move.  Rows of that same hash all count.
    """
    h = F.xxhash64(*keys)
    edge = df.select(h.alias("h")).orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    return df.limit(0) if edge is None else df.filter(h <= edge)


def fit_in_task(rows: DataFrame, fit: Callable[[pd.DataFrame], object]) -> object:
    """``fit`` of all rows (a bounded sample), run in one task; only the pickled model comes back.

    Rows are sorted by all columns before, so the model does not depend on their
    order.  An empty sample is fitted as well.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        sample = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=columns)
        sample = sample.sort_values(columns, ignore_index=True)
        yield pd.DataFrame({"model": [pickle.dumps(fit(sample))]})

    columns = rows.columns
    found = rows.repartition(1).mapInPandas(run, "model binary").first()
    return fit(pd.DataFrame(columns=columns)) if found is None else pickle.loads(bytes(found["model"]))
