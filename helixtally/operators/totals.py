"""Aggregates beside the rows that they are of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_totals(df: DataFrame, *scope: str, **totals: Column) -> DataFrame:
    """df with aggregates of each row's scope; of all rows, as one row to every task, where there is no scope."""
    if scope:
        return df.withColumns({k: v.over(Window.partitionBy(*scope)) for k, v in totals.items()})
    return df.crossJoin(F.broadcast(df.agg(*(v.alias(k) for k, v in totals.items()))))
