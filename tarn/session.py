"""A session: statements of the dialect in, DataFrames out.

    session = Session(spark, tables="/data/tables")
    session.execute("SELECT ... QUALIFY row_number() OVER (...) = 1").show()

Queries become one Spark SQL text each; Catalyst plans them. Statements that
change something run at once and return a one-row DataFrame of their outcome.
"""

from __future__ import annotations

import uuid
from collections import deque
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.catalog import information_schema
from tarn.catalog.store import Catalog
from tarn.dialect import statements as st
from tarn.dialect.lexer import DialectError, Item, literal, parse, render, statements
from tarn.dialect.rejected import is_rejected
from tarn.dialect.rewrite import Pivot, Rewriter
from tarn.functions.session import DEFAULTS
from tarn.functions.udfs import install
from tarn.operators.relational import pivot_values

#: Query ids that last_query_id() can go back to.
HISTORY = 64


@dataclass
class Ran:
    """One statement of the history."""

    query_id: str
    sql: str
    status: str = "RUNNING"
    error: str | None = None
    result: DataFrame | None = field(default=None, repr=False)


class Session:
    """Current database and schema, variables, history, and statements over Spark."""

    def __init__(self, spark: SparkSession, *, tables: str | None = None, database: str = "main", schema: str = "public"):
        self.spark = spark
        self.session_id = str(uuid.uuid4())
        self.database, self.schema = database, schema
        self.warehouse, self.role = "default", "default"
        self.variables: dict[str, object] = {}
        self.settings: dict[str, str] = {"week_start": "0", "week_of_year_policy": "0", "timezone": spark.conf.get("spark.sql.session.timeZone")}
        self.history: deque[Ran] = deque(maxlen=HISTORY)
        self.stages: dict[str, tuple[str, dict[str, str]]] = {}
        install(spark)
        self.catalog = Catalog(spark, database, schema)
        if tables:
            self.attach(tables)

    def attach(self, folder: str, names: tuple[str, ...] = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")) -> None:
        """Parquet files of a folder as views."""
        for n in names:
            self.spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(n)

    # Running

    def execute(self, sql: str) -> DataFrame:
        """Runs statements; the result of the last one."""
        out = None
        for items in statements(sql):
            out = self._run(items)
        if out is None:
            raise DialectError("empty statement", "000900")
        return out

    def _run(self, items: list[Item]) -> DataFrame:
        ran = Ran(str(uuid.uuid4()), render(items))
        tag = f"tarn-{ran.query_id}"
        self.spark.addTag(tag)
        try:
            ran.result = st.dispatch(self, items)
            ran.status = "SUCCESS"
            return ran.result
        except Exception as e:
            ran.status, ran.error = "FAIL", str(e)
            raise
        finally:
            self.spark.removeTag(tag)
            self.history.append(ran)

    def to_spark(self, sql: str) -> str:
        """The Spark SQL that a query of the dialect becomes."""
        return Rewriter(self).query(parse(sql.strip().rstrip(";")))

    def upload(self, table: str, data: bytes, options: dict[str, str] | None = None) -> int:
        """Adds the rows of a CSV that a client sent to a table, making it if it isn't there."""
        from tarn.sources import files

        df = files.upload(self.spark, data, options)
        full = self.full_name(table.lower().split("."))
        if self.catalog.has_table(full):
            self.catalog.append(full, files.fit(df, self.read_table(full).schema, by_name=True))
        else:
            self.catalog.write(full, df)
        return df.count()

    def query(self, items: list[Item]) -> DataFrame:
        try:
            return self.spark.sql(Rewriter(self).query(items))
        except AnalysisException as e:
            if e.getCondition() == "UNRESOLVED_ROUTINE":
                name = e.getMessageParameters()["routineName"].strip("`").lower()
                raise DialectError(f"Function '{name}' is not implemented yet", "002141") from e
            raise

    def expression(self, items: list[Item]) -> str:
        return Rewriter(self).expression(items)

    def cancel(self, query_id: str) -> str:
        self.spark.interruptTag(f"tarn-{query_id}")
        return f"query [{query_id}] terminated."

    def status(self, text: str = "Statement executed successfully.", **more: object) -> DataFrame:
        row = more or {"status": text}
        schema = T.StructType([T.StructField(k, T.LongType() if isinstance(v, int) else T.StringType()) for k, v in row.items()])
        return self.spark.createDataFrame([tuple(row.values())], schema)

    # Names

    def full_name(self, parts: list[str]) -> tuple[str, str, str]:
        parts = [p.lower() for p in parts]
        if len(parts) > 3:
            raise DialectError(f"invalid name {'.'.join(parts)}")
        return tuple([self.database, self.schema][: 3 - len(parts)] + parts) if len(parts) > 1 else (self.database, self.schema, parts[0])

    def read_table(self, full: tuple[str, str, str]) -> DataFrame:
        if full in self.catalog.views:
            return self.query(parse(self.catalog.views[full]))
        return self.spark.table(self.catalog.sql_name(full))

    # What the rewriter asks

    def variable(self, name: str) -> object:
        if name not in self.variables:
            raise DialectError(f"Session variable '${name.upper()}' does not exist", "002211")
        return self.variables[name]

    def is_rejected(self, name: str) -> bool:
        return is_rejected(name)

    def columns(self, query: str) -> list[tuple[str, str]] | None:
        """Names and types of a Spark query, None if it isn't one on its own."""
        try:
            return self.spark.sql(query).dtypes
        except AnalysisException:
            return None

    def is_steady(self, query: str) -> bool:
        """Whether a Spark query has the same rows each time it is read."""
        try:
            plan = self.spark.sql(query)._jdf.queryExecution().analyzed()
        except AnalysisException:
            return False
        nodes = {line.lstrip(" :+-").split(" ")[0] for line in plan.treeString().splitlines()}
        return plan.deterministic() and not nodes & {"GlobalLimit", "LocalLimit", "Offset", "Sample", "Window"}

    def function(self, name: str, args: list[str]) -> str | None:
        if name == "last_query_id":
            n = int(args[0].replace(" ", "")) if args else -1
            ids = [r.query_id for r in self.history]
            return literal(ids[n if n < 0 else n - 1]) if ids and -len(ids) <= n <= len(ids) else "NULL"
        if name == "table:result_scan":
            wanted = args[0].strip("'")
            found = next((r for r in self.history if r.query_id == wanted), None)
            if found is None or found.result is None:
                raise DialectError(f"Result for query {wanted} is not there", "000709")
            return self.view_of(found.result)
        if name == "system$cancel_query":
            return literal(self.cancel(args[0].strip("'")))
        values = {
            "current_database": self.database, "current_schema": self.schema, "current_warehouse": self.warehouse, "current_role": self.role,
            "current_session": self.session_id, "current_schemas": f'["{self.database}.{self.schema}"]',
        }
        if name in values and not args:
            return literal(values[name])
        if name in DEFAULTS and not args:
            return DEFAULTS[name]
        sunday = self.settings.get("week_start") == "7"
        if sunday and name in ("datediff", "date_diff") and args[0].strip("'").lower() in ("week", "weeks", "w", "wk"):
            week = "(date_diff(cast({0} as date), date '1969-12-28') div 7)"
            return f"({week.replace('{0}', args[2])} - {week.replace('{0}', args[1])})"
        if name == "dayofweek" and self.settings.get("week_start") not in (None, "0", "7"):
            return f"(pmod(weekday({args[0]}) - {int(self.settings['week_start']) - 1}, 7) + 1)"
        return None

    def view_of(self, df: DataFrame) -> str:
        name = f"tarn_view_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(name)
        return name

    def table(self, parts: list[str]) -> str:
        if parts[0].startswith("@"):
            if parts[0][1:] not in self.stages:
                raise DialectError(f"Stage '{parts[0][1:]}' does not exist or not authorized", "002003")
            from tarn.sources.files import read

            return self.view_of(read(self.spark, *self.stages[parts[0][1:]]))
        if len(parts) == 1 and (self.spark.catalog.tableExists(parts[0]) and any(t.name == parts[0] and t.isTemporary for t in self.spark.catalog.listTables(pattern=parts[0]))):
            return f"`{parts[0]}`"
        if len(parts) >= 2 and parts[-2] == "information_schema":
            df = information_schema.frame(self, parts[-1], parts[0] if len(parts) == 3 else self.database)
            if df is None:
                raise DialectError(f"Object '{parts[-1]}' does not exist or not authorized", "002003")
            return self.view_of(df)
        full = self.full_name(parts)
        if full in self.catalog.views:
            return "(" + self.to_spark(self.catalog.views[full]) + f") AS `{full[2]}`"
        if not self.catalog.has_table(full):
            raise DialectError(f"Object '{'.'.join(parts)}' does not exist or not authorized", "002003")
        return self.catalog.sql_name(full)

    def pivot(self, source: str, p: Pivot) -> str:
        """PIVOT by Spark's own, after the list of values is known."""
        if p.values is not None and p.default is None:
            return f"(SELECT * FROM {source} PIVOT ({p.aggregates} FOR {p.column} IN ({p.values})))"
        if p.values is not None:
            values = [r[0] for r in self.spark.sql(f"SELECT explode(array({p.values}))").collect()]
        elif p.query is not None:
            values = pivot_values(self.spark.sql(p.prefix + p.query))
        else:
            order = f" ORDER BY {p.any_order}" if p.any_order else f" ORDER BY {p.column}"
            values = pivot_values(self.spark.sql(f"{p.prefix}SELECT DISTINCT {p.column} FROM {source} WHERE {p.column} IS NOT NULL{order}"))
        listed = ", ".join(literal(v) for v in values)
        pivoted = f"SELECT * FROM {source} PIVOT ({p.aggregates} FOR {p.column} IN ({listed}))"
        if p.default is None:
            return f"({pivoted})"
        columns = self.spark.sql(p.prefix + pivoted).columns
        new = columns[len(columns) - len(values) :]
        kept = ", ".join(f"`{c}`" for c in columns[: len(columns) - len(values)])
        filled = ", ".join(f"coalesce(`{c}`, {p.default}) AS `{c}`" for c in new)
        return f"(SELECT {kept + ', ' if kept else ''}{filled} FROM ({pivoted}))"


def expr(text: str):
    """A Column of an expression of the dialect, for use with the DataFrame API."""
    return F.expr(Rewriter().expression(parse(text)))
