"""Columns added under guard, and transforms by name."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .slots import instantiate


def with_new_columns(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """df with more columns; a name that is there already raises."""
    if known := sorted(set(columns) & set(df.columns)):
        raise ValueError(f"columns are there already: {', '.join(known)}")
    return df.withColumns(dict(columns))


def beside_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """df with the columns of a one-row table as constants, so that nothing is joined; other tables raise."""
    rows = one.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("one row is needed")
    return with_new_columns(df, {f.name: F.lit(rows[0][f.name]).cast(f.dataType) for f in one.schema})


def transformed(df: DataFrame, step: Callable[[DataFrame], DataFrame] | Mapping | None = None) -> DataFrame:
    """df through a step: a function, a configuration with a target, or nothing at all."""
    if step is None:
        return df
    return df.transform(instantiate(step) if isinstance(step, Mapping) else step)
