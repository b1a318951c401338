"""Calls of injected models (embedding, extraction, reranking) over the rows of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Rows that one call of a model gets.
CALL_ROWS = 10


def apply_model(df: DataFrame, model: Callable[[list], list], column: str, out: str, kind: str, rows: int = CALL_ROWS) -> DataFrame:
    """The rows with a new column: what the model answers for the values of ``column``, asked for so many rows at a time, nulls not at all.

    The model is called in tasks where the rows are and must answer each value in order; fewer or more answers are an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made: list = [None] * len(batch)
            asked = [i for i, missing in enumerate(batch[column].isna()) if not missing]
            for a in range(0, len(asked), rows):
                some = asked[a : a + rows]
                told = model([batch[column].iloc[i] for i in some])
                if len(told) != len(some):
                    raise ValueError(f"the model answered {len(told)} of {len(some)} values")
                for i, x in zip(some, told, strict=True):
                    made[i] = x
            yield batch.assign(**{out: pd.Series(made, dtype=object, index=batch.index)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out)
    return df.drop(out).mapInPandas(run, f"{fields}, `{out}` {kind}")
