"""MERGE: a target's rows after updates, deletes and inserts from a source.

The plan is one full join. Which clause applies to a row is a CASE over the
clauses in their order, each column is a CASE over the chosen clause, and rows
whose clause deletes them, or that no insert took, are filtered out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Clause:
    """WHEN [NOT] MATCHED [AND condition] THEN action.

    ``set`` maps target columns to SQL of the two aliases; an insert's
    expressions see the source alone."""

    matched: bool
    action: str
    condition: str | None = None
    set: dict[str, str] = field(default_factory=dict)


def merge(target: DataFrame, source: DataFrame, on: str, clauses: list[Clause], *, target_alias: str = "target", source_alias: str = "source") -> tuple[DataFrame, dict[str, Column]]:
    """The merged rows with a column ``_clause`` (the clause that made each, or
    null) and ``_row`` (a number of the target row that a source row matched), and
    the counts a client is told, as aggregates over those rows plus the deleted
    ones; take rows through ``once``, and of them those where ``_keep`` holds."""
    t = target.withColumn("_in_target", F.lit(True)).withColumn("_row", F.monotonically_increasing_id()).alias(target_alias)
    s = source.withColumn("_in_source", F.lit(True)).alias(source_alias)
    both = t.join(s, F.expr(on), "full")
    there, come = F.coalesce(F.col("_in_target"), F.lit(False)), F.coalesce(F.col("_in_source"), F.lit(False))
    chosen: Column = F.lit(None).cast("int")
    for k, c in reversed(list(enumerate(clauses))):
        test = (there & come) if c.matched else (~there & come)
        if c.condition:
            test = test & F.coalesce(F.expr(c.condition), F.lit(False))
        chosen = F.when(test, F.lit(k)).otherwise(chosen)
    both = both.withColumn("_clause", chosen)
    columns = []
    for f in target.schema:
        value = F.col(f"{target_alias}.`{f.name}`")
        out = value
        for k, c in reversed(list(enumerate(clauses))):
            if c.action == "delete":
                continue
            new = c.set.get(f.name.lower())
            if new is not None:
                out = F.when(F.col("_clause") == k, F.expr(f"try_cast({new} as {f.dataType.simpleString()})")).otherwise(out)
            elif c.action == "insert":
                out = F.when(F.col("_clause") == k, F.lit(None)).otherwise(out)
        columns.append(out.cast(f.dataType).alias(f.name))
    kinds = {a: [k for k, c in enumerate(clauses) if c.action == a] for a in ("insert", "update", "delete")}
    gone = F.coalesce(F.col("_clause").isin(kinds["delete"]), F.lit(False)) if kinds["delete"] else F.lit(False)
    new = F.coalesce(F.col("_clause").isin(kinds["insert"]), F.lit(False)) if kinds["insert"] else F.lit(False)
    rows = both.select(*columns, "_clause", ((there & ~gone) | new).alias("_keep"), F.when(there & come, F.col("_row")).alias("_row"))
    counts = {a: F.count_if(F.col("_clause").isin(ks)).alias(f"number of rows {a}{'d' if a.endswith('e') else 'ed'}") for a, ks in kinds.items() if ks}
    return rows, counts


def once(rows: DataFrame) -> DataFrame:
    """rows of ``merge``, kept by the caller, with each target row once. The check is
    a count over the numbers of matched rows; rows are moved only if some repeat."""
    several = rows.where("_row IS NOT NULL").groupBy("_row").agg(F.count("*").alias("n"), F.count("_clause").alias("c")).where("n > 1")
    most = several.agg(F.max("c")).first()[0]
    if most is None:
        return rows
    if most > 1:
        raise ValueError("Duplicate row detected during DML action: several source rows match one target row")
    again = rows.join(several.select("_row"), "_row", "left_semi").select(rows.columns)
    first = F.row_number().over(Window.partitionBy("_row").orderBy(F.col("_clause").asc_nulls_last()))
    return rows.join(several.select("_row"), "_row", "left_anti").select(rows.columns).unionAll(again.withColumn("_first", first).where("_first = 1").drop("_first"))
