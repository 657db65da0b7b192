"""All registered queries of the dialect's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarn.dialect.lexer import lex
from tarn.plans import function_values, functions, statements  # noqa: F401  (they add queries)
from tarn.plans.relational import QUERIES
from tarn.session import Session

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _runner(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    names = {t.text.lower() for t in lex(sql) if t.kind == "word"} & set(TABLES)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = Session(spark)
        session.attach(sf_dir, tuple(sorted(names)))
        return session.execute(sql)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(sql) for name, (sql, _) in QUERIES.items()} | statements.CALLABLES


def oracle_sql() -> dict[str, str]:
    return {name: oracle for name, (_, oracle) in QUERIES.items() if oracle} | statements.ORACLES
