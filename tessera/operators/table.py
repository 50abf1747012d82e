"""Filters of tables by several numeric conditions at once."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import ieee


def filter_where(df: DataFrame, conditions, mode: str = "all") -> DataFrame:
    """Rows that meet all (or with "any" some) of [(column, op, threshold)]; one predicate, pushed to the scan."""
    return df.filter(ieee.predicate(conditions, mode))


def multi_filter_where(df: DataFrame, columns, conditions, mode: str = "all") -> DataFrame:
    """The given columns of filter_where's rows: one pass, one predicate."""
    return filter_where(df, conditions, mode).select(*columns)


def filter_by_masks(df: DataFrame, masks) -> DataFrame:
    """Rows where every mask is true or non-zero; no masks keep all."""
    masks = [F.col(m) if isinstance(m, str) else m for m in masks]
    return df.filter(reduce(lambda a, b: a & b, [m.cast("double") != 0 for m in masks])) if masks else df


def filter_finite(df: DataFrame, *columns: str) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [ieee.isfinite(F.col(c)) for c in columns]))


def segments(df: DataFrame, name: str, cases, otherwise: str | None = None) -> DataFrame:
    """df with a column that names the first of [(label, conditions)] that holds; replaces repeated filters by one pass."""
    out = None
    for label, conditions in cases:
        test = ieee.predicate(conditions)
        out = F.when(test, label) if out is None else out.when(test, label)
    return df.withColumn(name, out.otherwise(otherwise) if otherwise is not None else out)
