"""Databases, schemas, volumes and tables over Spark's session catalog.

A schema ``db.schema`` is the Spark database ``db__schema``; tables are Parquet.
Spark can't overwrite what a query reads, so a rewritten table is written next
to the old one and takes its name when it is complete.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from tarn.dialect.lexer import DialectError


def plain(name: str) -> str:
    """A name that Spark takes: characters beyond letters, digits and _ by their code."""
    return re.sub(r"\W", lambda m: f"_x{ord(m[0]):x}_", name)


def spelled(name: str) -> str:
    """The name that `plain` was given."""
    return re.sub(r"_x([0-9a-f]+)_", lambda m: chr(int(m[1], 16)), name)


class Catalog:
    def __init__(self, spark: SparkSession, database: str = "main", schema: str = "public"):
        self.spark = spark
        self.volumes: dict[str, dict[str, str]] = {}
        self.databases: dict[str, str | None] = {}
        self.views: dict[tuple[str, str, str], str] = {}
        self.create_database(database, None, exists_ok=True)
        self.create_schema(database, schema, exists_ok=True)

    # Names

    @staticmethod
    def spark_database(database: str, schema: str) -> str:
        return f"{plain(database)}__{plain(schema)}"

    def schemas(self, database: str | None = None) -> list[tuple[str, str]]:
        out = []
        for d in self.spark.catalog.listDatabases():
            db, mark, schema = d.name.partition("__")
            db, schema = spelled(db), spelled(schema)
            if mark and db in self.databases and (database is None or db == database):
                out.append((db, schema))
        return sorted(out)

    def has_schema(self, database: str, schema: str) -> bool:
        return self.spark.catalog.databaseExists(self.spark_database(database, schema))

    def has_table(self, full: tuple[str, str, str]) -> bool:
        return self.has_schema(*full[:2]) and self.spark.catalog.tableExists(self.sql_name(full))

    def sql_name(self, full: tuple[str, str, str]) -> str:
        return f"`{self.spark_database(*full[:2])}`.`{plain(full[2])}`"

    # Definitions

    def create_volume(self, name: str, options: dict[str, str], *, exists_ok: bool = False) -> None:
        if name in self.volumes and not exists_ok:
            raise DialectError(f"Object '{name}' already exists", "002002")
        kind = options.get("storage_provider", options.get("type", "MEMORY")).upper()
        if kind not in ("S3", "S3TABLES", "FILE", "MEMORY"):
            raise DialectError(f"unknown volume type {kind}")
        self.volumes[name] = options | {"type": kind}

    def create_database(self, name: str, volume: str | None, *, exists_ok: bool = False) -> None:
        if name in self.databases and not exists_ok:
            raise DialectError(f"Object '{name}' already exists", "002002")
        if volume is not None and volume not in self.volumes:
            raise DialectError(f"Volume '{volume}' does not exist", "002003")
        self.databases.setdefault(name, volume)

    def create_schema(self, database: str, schema: str, *, exists_ok: bool = False) -> None:
        if database not in self.databases:
            raise DialectError(f"Database '{database}' does not exist or not authorized", "002003")
        if self.has_schema(database, schema) and not exists_ok:
            raise DialectError(f"Object '{schema}' already exists", "002002")
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.spark_database(database, schema)}`")

    def drop_schema(self, database: str, schema: str, *, missing_ok: bool = False) -> None:
        if not self.has_schema(database, schema):
            if missing_ok:
                return
            raise DialectError(f"Schema '{schema}' does not exist or not authorized", "002043")
        self.spark.sql(f"DROP DATABASE `{self.spark_database(database, schema)}` CASCADE")
        for key in [k for k in self.views if k[:2] == (database, schema)]:
            del self.views[key]

    def drop_database(self, name: str, *, missing_ok: bool = False) -> None:
        if name not in self.databases:
            if missing_ok:
                return
            raise DialectError(f"Database '{name}' does not exist or not authorized", "002003")
        for db, schema in self.schemas(name):
            self.drop_schema(db, schema)
        del self.databases[name]

    def drop_table(self, full: tuple[str, str, str], *, missing_ok: bool = False) -> None:
        if full in self.views:
            del self.views[full]
            return
        if not self.has_table(full):
            if missing_ok:
                return
            raise DialectError(f"Object '{full[2]}' does not exist or not authorized", "002003")
        self.spark.sql(f"DROP TABLE {self.sql_name(full)}")

    def rename(self, full: tuple[str, str, str], new: tuple[str, str, str]) -> None:
        if new in self.views or self.has_table(new):
            raise DialectError(f"Object '{new[2]}' already exists", "002002")
        if full in self.views:
            self.views[new] = self.views.pop(full)
        elif new[:2] == full[:2]:
            self.spark.sql(f"ALTER TABLE {self.sql_name(full)} RENAME TO {self.sql_name(new)}")
        else:  # into another schema, which the session catalog can't do
            self.write(new, self.spark.table(self.sql_name(full)))
            self.drop_table(full)

    def swap(self, a: tuple[str, str, str], b: tuple[str, str, str]) -> None:
        aside = (*a[:2], f"{a[2]}__{uuid.uuid4().hex[:8]}")
        for old, new in ((a, aside), (b, a), (aside, b)):
            self.rename(old, new)

    # Rows

    def write(self, full: tuple[str, str, str], df: DataFrame, *, replace: bool = False) -> None:
        """A new table with the rows of df; with replace instead of what is there."""
        if not replace and (self.has_table(full) or full in self.views):
            raise DialectError(f"Object '{full[2]}' already exists", "002002")
        fresh = (*full[:2], f"{full[2]}__{uuid.uuid4().hex[:8]}")
        df.write.format("parquet").saveAsTable(self.sql_name(fresh))
        if self.has_table(full):
            self.spark.sql(f"DROP TABLE {self.sql_name(full)}")
        self.views.pop(full, None)
        self.spark.sql(f"ALTER TABLE {self.sql_name(fresh)} RENAME TO {self.sql_name(full)}")

    def append(self, full: tuple[str, str, str], df: DataFrame) -> None:
        df.write.format("parquet").mode("append").insertInto(self.sql_name(full))

    def tables(self, database: str | None = None, schema: str | None = None) -> list[tuple[str, str, str, str]]:
        """(database, schema, name, kind) of tables and views."""
        out = []
        for db, s in self.schemas(database):
            if schema is None or s == schema:
                out += [(db, s, spelled(t.name), "TABLE") for t in self.spark.catalog.listTables(self.spark_database(db, s)) if not t.isTemporary]
        out += [(*k, "VIEW") for k in self.views if (database is None or k[0] == database) and (schema is None or k[1] == schema)]
        return sorted(out)
