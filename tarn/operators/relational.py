"""Relational operators beyond Spark's own, on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that a PIVOT may make of values it finds.
MOST_PIVOTED = 10_000


def pivot_values(found: DataFrame) -> list:
    """The values of a one-column DataFrame; more than MOST_PIVOTED raise."""
    values = [r[0] for r in found.limit(MOST_PIVOTED + 1).collect()]
    if len(values) > MOST_PIVOTED:
        raise ValueError(f"PIVOT finds more than {MOST_PIVOTED} values")
    return values


def qualify(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which a condition on window functions holds."""
    return df.withColumn("_qualify", condition).where("_qualify").drop("_qualify")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of an order (a bounded sort in each task, then one merge)."""
    return df.orderBy(*order).limit(k)


def top_k_per(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group. Spark limits groups before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return qualify(df, F.row_number().over(w) <= k)


def pivot(df: DataFrame, column: str, aggregates: list[Column], *, values: list | None = None, keys: list[str] | None = None, default: object = None) -> DataFrame:
    """Values of `column` become columns; all other columns that no aggregate
    reads are keys unless given. Without values they are taken from the data
    (one pass over that column), null aside, in rising order."""
    if values is None:
        values = pivot_values(df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column))
    grouped = df.groupBy(*(keys if keys is not None else [c for c in df.columns if c != column]))
    out = grouped.pivot(column, values).agg(*aggregates)
    new = out.columns[len(keys) if keys is not None else len(df.columns) - 1 :]
    return out if default is None else out.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(default)) for c in new})


def unpivot(df: DataFrame, value: str, name: str, columns: list[str], *, include_nulls: bool = False) -> DataFrame:
    """Columns become rows of name and value; rows of null go unless kept."""
    ids = [c for c in df.columns if c not in columns]
    out = df.unpivot(ids, columns, name, value)
    return out if include_nulls else out.where(F.col(value).isNotNull())


def grouping_sets(df: DataFrame, sets: list[list[str]], *aggregates: Column) -> DataFrame:
    """Aggregates over several groupings in one pass (one Expand)."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in every]).agg(*aggregates)


def salted_sum(df: DataFrame, keys: list[str], value: str, out: str, *, salts: int = 32) -> DataFrame:
    """Sums by key in two steps, for keys so hot that even partial sums gather."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    return df.withColumn("_salt", salt).groupBy(*keys, "_salt").agg(F.sum(value).alias(out)).groupBy(*keys).agg(F.sum(out).alias(out))
