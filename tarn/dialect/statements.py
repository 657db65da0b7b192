"""Statements other than queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.catalog import information_schema
from tarn.dialect.lexer import DialectError, Group, Item, find, name_of, parse, render, split, unquote
from tarn.dialect.rewrite import cast_type
from tarn.operators.merge import Clause, merge, once
from tarn.sources import files

OK = "Statement executed successfully."


def dispatch(s, items: list[Item]) -> DataFrame:
    first = items[0]
    if isinstance(first, Group) or first.is_word("select", "with", "values"):
        return s.query(items)
    verb = first.text.lower()
    run = _RUN.get(verb)
    if run is None:
        raise DialectError(f"SQL compilation error: unexpected '{first.text}'", "001003")
    return run(s, items[1:])


class Reader:
    """Reads the words of a statement one after the other."""

    def __init__(self, items: list[Item]):
        self.items, self.i = items, 0

    def peek(self) -> Item | None:
        return self.items[self.i] if self.i < len(self.items) else None

    def next(self) -> Item:
        t = self.peek()
        if t is None:
            raise DialectError("the statement ends too early")
        self.i += 1
        return t

    def accept(self, *words: str) -> bool:
        """Takes the words if they all come next."""
        if self.i + len(words) <= len(self.items) and all(self.items[self.i + k].is_word(w) for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def name(self) -> list[str]:
        parts = [name_of(self.next())]
        while (t := self.peek()) is not None and t.is_op("."):
            self.i += 1
            parts.append(name_of(self.next()))
        return parts

    def rest(self) -> list[Item]:
        out, self.i = self.items[self.i :], len(self.items)
        return out


def options(items: list[Item]) -> dict[str, str]:
    """name = value pairs, nested ones flattened."""
    out: dict[str, str] = {}
    i = 0
    while i < len(items):
        if i + 2 < len(items) and items[i].kind == "word" and items[i + 1].is_op("="):
            value = items[i + 2]
            if isinstance(value, Group):
                out |= options([t for t in value.items if not t.is_op(",")])
            else:
                out[items[i].text.lower()] = unquote(value.text) if value.kind == "string" else value.text
            i += 3
        else:
            i += 1
    return out


# Definitions


def create(s, items: list[Item]) -> DataFrame:
    r = Reader(items)
    replace = r.accept("or", "replace")
    while r.accept("temporary") or r.accept("temp") or r.accept("transient") or r.accept("global") or r.accept("local") or r.accept("volatile"):
        pass
    if r.accept("external", "volume"):
        exists_ok = r.accept("if", "not", "exists")
        name = r.name()[0]
        s.catalog.create_volume(name, options(r.rest()), exists_ok=exists_ok or replace)
        return s.status(f"Volume {name.upper()} successfully created.")
    if r.accept("database"):
        exists_ok = r.accept("if", "not", "exists")
        name = r.name()[0]
        volume = options(r.rest()).get("external_volume")
        s.catalog.create_database(name, volume, exists_ok=exists_ok or replace)
        return s.status(f"Database {name.upper()} successfully created.")
    if r.accept("schema"):
        exists_ok = r.accept("if", "not", "exists")
        parts = r.name()
        s.catalog.create_schema(parts[0] if len(parts) > 1 else s.database, parts[-1], exists_ok=exists_ok or replace)
        return s.status(f"Schema {parts[-1].upper()} successfully created.")
    if r.accept("stage"):
        exists_ok = r.accept("if", "not", "exists")
        name = r.name()[0]
        opts = options(r.rest())
        if name in s.stages and not (exists_ok or replace):
            raise DialectError(f"Object '{name}' already exists", "002002")
        s.stages[name] = (opts.pop("url"), opts)
        s.view_of(files.read(s.spark, *s.stages[name]))
        return s.status(f"Stage area {name.upper()} successfully created.")
    if r.accept("view"):
        exists_ok = r.accept("if", "not", "exists")
        full = s.full_name(r.name())
        if isinstance(r.peek(), Group):
            names = [name_of(x[0]) for x in split(r.next().items)]
        else:
            names = None
        if not r.accept("as"):
            raise DialectError("CREATE VIEW needs AS")
        body = render(r.rest())
        if (full in s.catalog.views or s.catalog.has_table(full)) and not replace:
            if exists_ok:
                return s.status(OK)
            raise DialectError(f"Object '{full[2]}' already exists", "002002")
        df = s.query(parse(body))
        if names:
            body = "SELECT " + ", ".join(f'"{c}" AS "{n}"' for c, n in zip(df.columns, names)) + f" FROM ({body})"
        s.catalog.views[full] = body
        return s.status(f"View {full[2].upper()} successfully created.")
    external = r.accept("external")
    if r.accept("table"):
        return _create_table(s, r, replace, external)
    raise DialectError(f"CREATE {render(items[:1])} is not supported")


def _create_table(s, r: Reader, replace: bool, external: bool) -> DataFrame:
    exists_ok = r.accept("if", "not", "exists")
    full = s.full_name(r.name())
    if s.catalog.has_table(full) and exists_ok:
        return s.status(f"{full[2].upper()} already exists, statement succeeded.")
    columns: list[T.StructField] | None = None
    if isinstance(r.peek(), Group):
        columns = _columns(r.next())
    rest = r.rest()
    k = next((i for i, t in enumerate(rest) if t.is_word("as", "like", "clone")), -1)
    opts = options(rest if k < 0 else rest[:k])
    if external:
        kind = opts.get("type", opts.get("file_format", "parquet"))
        df = files.read(s.spark, opts["location"], opts | {"type": kind}, T.StructType(columns) if columns else None)
        s.catalog.write(full, df, replace=replace)
    elif k >= 0 and rest[k].is_word("as"):
        df = s.query(rest[k + 1].items if len(rest) == k + 2 and isinstance(rest[k + 1], Group) else rest[k + 1 :])
        df = df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, T.NullType) else F.col(f"`{f.name}`") for f in df.schema])
        if columns:
            df = files.fit(df, T.StructType(columns), by_name=False)
        s.catalog.write(full, df, replace=replace)
    elif k >= 0:
        df = s.spark.sql(f"SELECT * FROM {s.table([name_of(t) for t in rest[k + 1 :] if not t.is_op('.')])}")
        s.catalog.write(full, df if rest[k].is_word("clone") else df.limit(0), replace=replace)
    elif columns is not None:
        s.catalog.write(full, s.spark.createDataFrame([], T.StructType(columns)), replace=replace)
    else:
        raise DialectError("CREATE TABLE needs columns or AS")
    return s.status(f"Table {full[2].upper()} successfully created.")


def _columns(group: Group) -> list[T.StructField]:
    out = []
    for c in split(group.items):
        if c[0].is_word("constraint", "primary", "foreign", "unique", "check"):
            continue
        kind = c[1:3] if len(c) > 2 and isinstance(c[2], Group) else c[1:2]
        if kind[0].is_word("object") and len(kind) == 2:
            fields = ", ".join(f"{name_of(f[0])}: {cast_type(f[1:])}" for f in split(kind[1].items))
            name = f"struct<{fields}>"
        else:
            name = cast_type(kind)
        not_null = any(a.is_word("not") and b.is_word("null") for a, b in zip(c, c[1:]))
        out.append(T.StructField(name_of(c[0]), T._parse_datatype_string(name), not not_null))
    return out


def drop(s, items: list[Item]) -> DataFrame:
    r = Reader(items)
    kind = r.next().text.lower()
    missing_ok = r.accept("if", "exists")
    parts = r.name()
    if kind in ("table", "view"):
        s.catalog.drop_table(s.full_name(parts), missing_ok=missing_ok)
    elif kind == "schema":
        s.catalog.drop_schema(parts[0] if len(parts) > 1 else s.database, parts[-1], missing_ok=missing_ok)
    elif kind == "database":
        s.catalog.drop_database(parts[0], missing_ok=missing_ok)
    elif kind == "stage":
        if s.stages.pop(parts[0], None) is None and not missing_ok:
            raise DialectError(f"Stage '{parts[0]}' does not exist or not authorized", "002003")
    else:
        raise DialectError(f"DROP {kind.upper()} is not supported")
    return s.status(f"{parts[-1].upper()} successfully dropped.")


def alter(s, items: list[Item]) -> DataFrame:
    r = Reader(items)
    r.accept("iceberg")
    if r.accept("session"):
        unset = r.accept("unset")
        if not unset:
            r.accept("set")
            for k, v in options(r.rest()).items():
                s.settings[k] = v
                if k == "timezone":
                    s.spark.conf.set("spark.sql.session.timeZone", v)
        else:
            for t in r.rest():
                if not t.is_op(","):
                    s.settings.pop(t.text.lower(), None)
        return s.status(OK)
    if r.accept("table") or r.accept("view"):
        missing_ok = r.accept("if", "exists")
        full = s.full_name(r.name())
        if not s.catalog.has_table(full) and full not in s.catalog.views:
            if missing_ok:
                return s.status(OK)
            raise DialectError(f"Table '{full[2]}' does not exist or not authorized", "002003")
        _alter_table(s, full, r)
        return s.status(OK)
    raise DialectError("ALTER is for SESSION, TABLE and VIEW")


def _alter_table(s, full: tuple[str, str, str], r: Reader) -> None:
    """Names change in the catalog; changes of columns write the table anew."""
    if r.accept("rename", "to"):
        return s.catalog.rename(full, s.full_name(r.name()))
    if r.accept("swap", "with"):
        return s.catalog.swap(full, s.full_name(r.name()))
    if r.peek() is not None and r.peek().is_word("set", "unset", "cluster", "resume", "suspend", "recluster"):
        return None  # properties, of which this engine has none
    if full in s.catalog.views:
        raise DialectError("a view's columns can't be altered")
    df = s.read_table(full)
    if r.accept("rename", "column"):
        old = name_of(r.next())
        r.accept("to")
        new = name_of(r.next())
        _need(df, old, full)
        df = df.withColumnRenamed(old, new)
    elif r.accept("drop"):
        r.accept("column")
        missing_ok = r.accept("if", "exists")
        for part in split(r.rest()):
            if not missing_ok:
                _need(df, name_of(part[0]), full)
            df = df.drop(name_of(part[0]))
    elif r.accept("add"):
        r.accept("column")
        exists_ok = r.accept("if", "not", "exists")
        for f in _columns(Group("(", r.rest())):
            if f.name.lower() in (c.lower() for c in df.columns):
                if exists_ok:
                    continue
                raise DialectError(f"column '{f.name}' already exists", "001430")
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    else:
        raise DialectError(f"ALTER TABLE {render(r.rest())} is not supported")
    s.catalog.write(full, df, replace=True)


def _need(df: DataFrame, column: str, full: tuple[str, str, str]) -> None:
    if column.lower() not in (c.lower() for c in df.columns):
        raise DialectError(f"column '{column}' of '{full[2]}' does not exist", "000904")


def use(s, items: list[Item]) -> DataFrame:
    r = Reader(items)
    if r.accept("warehouse"):
        s.warehouse = r.name()[0]
    elif r.accept("role"):
        s.role = r.name()[0]
    elif r.accept("secondary", "roles"):
        r.rest()
    elif r.accept("schema"):
        parts = r.name()
        database, schema = (parts if len(parts) > 1 else [s.database, parts[0]])[:2]
        if not s.catalog.has_schema(database, schema):
            raise DialectError(f"Schema '{schema}' does not exist or not authorized", "002043")
        s.database, s.schema = database, schema
    else:
        r.accept("database")
        parts = r.name()
        if parts[0] not in s.catalog.databases:
            raise DialectError(f"Database '{parts[0]}' does not exist or not authorized", "002043")
        s.database = parts[0]
        if len(parts) > 1:
            s.schema = parts[1]
    return s.status(OK)


def set_variables(s, items: list[Item]) -> DataFrame:
    k = next((i for i, t in enumerate(items) if t.is_op("=")), -1)
    if k < 0:
        raise DialectError("SET needs =")
    if len(items) > 1 and items[1].is_op("."):  # a dotted name is an engine setting
        s.settings[render(items[:k]).lower()] = unquote(items[k + 1].text) if items[k + 1].kind == "string" else render(items[k + 1 :])
        return s.status(OK)
    names = [name_of(n[0]) for n in split(items[0].items)] if isinstance(items[0], Group) else [name_of(items[0])]
    right = items[k + 1 :]
    if isinstance(items[0], Group) and len(right) == 1 and isinstance(right[0], Group) and not right[0].items[0].is_word("select"):
        values = list(s.spark.sql("SELECT " + ", ".join(f"{s.expression(v)} AS c{i}" for i, v in enumerate(split(right[0].items)))).first())
    elif len(right) == 1 and isinstance(right[0], Group) and right[0].items[0].is_word("select", "with"):
        values = list(s.query(right[0].items).first())
    else:
        values = list(s.spark.sql(f"SELECT {s.expression(right)}").first())
    if len(values) != len(names):
        raise DialectError("SET has as many names as values")
    s.variables |= dict(zip(names, values))
    return s.status(OK)


def unset_variables(s, items: list[Item]) -> DataFrame:
    for t in items[0].items if isinstance(items[0], Group) else items[:1]:
        if not t.is_op(","):
            s.variables.pop(name_of(t), None)
    return s.status(OK)


# Rows


def insert(s, items: list[Item]) -> DataFrame:
    r = Reader(items)
    overwrite = r.accept("overwrite")
    r.accept("into")
    r.accept("table")
    full = s.full_name(r.name())
    schema = _target(s, full).schema
    names = None
    if isinstance(r.peek(), Group) and not r.peek().items[0].is_word("select", "with"):
        names = [name_of(c[0]) for c in split(r.next().items)]
    df = s.query(r.rest())
    if names:
        if len(names) != len(df.columns):
            raise DialectError("INSERT has as many columns as values")
        df = df.toDF(*names)
    df = files.fit(df, schema, by_name=bool(names))
    if overwrite:
        s.catalog.write(full, df, replace=True)
        return s.status(OK)
    before = df.persist()
    n = before.count()
    if n:
        s.catalog.append(full, before)
    before.unpersist()
    return s.status(**{"number of rows inserted": n})


def _target(s, full: tuple[str, str, str]) -> DataFrame:
    if not s.catalog.has_table(full):
        raise DialectError(f"Table '{full[2]}' does not exist or not authorized", "002003")
    return s.read_table(full)


def truncate(s, items: list[Item]) -> DataFrame:
    r = Reader(items)
    r.accept("table")
    missing_ok = r.accept("if", "exists")
    full = s.full_name(r.name())
    if missing_ok and not s.catalog.has_table(full):
        return s.status(OK)
    s.catalog.write(full, s.spark.createDataFrame([], _target(s, full).schema), replace=True)
    return s.status(OK)


def delete(s, items: list[Item]) -> DataFrame:
    r = Reader(items)
    r.accept("from")
    full = s.full_name(r.name())
    target = _target(s, full)
    alias = name_of(r.next()) if r.peek() is not None and not r.peek().is_word("where", "using") else full[2]
    gone = F.lit(True)
    if r.accept("where"):
        gone = F.coalesce(F.expr(s.expression(r.rest())), F.lit(False))
    marked = target.alias(alias).withColumn("_gone", gone)
    n = marked.where("_gone").count()
    s.catalog.write(full, marked.where("NOT _gone").drop("_gone"), replace=True)
    return s.status(**{"number of rows deleted": n})


def update(s, items: list[Item]) -> DataFrame:
    r = Reader(items)
    full = s.full_name(r.name())
    target = _target(s, full)
    alias = name_of(r.next()) if not r.peek().is_word("set") else full[2]
    r.accept("set")
    rest = r.rest()
    k = find(rest, "where")
    test = F.coalesce(F.expr(s.expression(rest[k + 1 :])), F.lit(False)) if k >= 0 else F.lit(True)
    new = {name_of([t for t in a if t.kind in ("word", "quoted")][0] if not a[1].is_op(".") else a[2]): s.expression(a[[i for i, t in enumerate(a) if t.is_op("=")][0] + 1 :]) for a in split(rest[:k] if k >= 0 else rest)}
    marked = target.alias(alias).withColumn("_hit", test)
    n = marked.where("_hit").count()
    out = marked.select(*[F.when(F.col("_hit"), F.expr(f"try_cast({new[f.name.lower()]} as {f.dataType.simpleString()})")).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name.lower() in new else F.col(f"`{f.name}`") for f in target.schema])
    s.catalog.write(full, out, replace=True)
    return s.status(**{"number of rows updated": n, "number of multi-joined rows updated": 0})


def _alias(r: Reader, default: str, *stops: str) -> str:
    r.accept("as")
    t = r.peek()
    return name_of(r.next()) if t is not None and t.kind in ("word", "quoted") and not t.is_word(*stops) else default


def merge_plan(s, items: list[Item]):
    r = Reader(items)
    r.accept("into")
    full = s.full_name(r.name())
    target = _target(s, full)
    target_alias = _alias(r, full[2], "using")
    if not r.accept("using"):
        raise DialectError("MERGE needs USING")
    if isinstance(r.peek(), Group):
        source, source_alias = s.query(r.next().items), _alias(r, "source", "on")
    else:
        parts = r.name()
        source, source_alias = s.spark.sql(f"SELECT * FROM {s.table(parts)}"), _alias(r, parts[-1], "on")
    if not r.accept("on"):
        raise DialectError("MERGE needs ON")
    rest = r.rest()
    at = [i for i, t in enumerate(rest) if t.is_word("when")]
    on = s.expression(rest[: at[0]])
    clauses = []
    for a, b in zip(at, [*at[1:], len(rest)]):
        c = Reader(rest[a + 1 : b])
        matched = not c.accept("not")
        if not c.accept("matched"):
            raise DialectError("WHEN [NOT] MATCHED is expected")
        if c.accept("by", "source"):
            raise DialectError("NOT MATCHED BY SOURCE is not supported")
        c.accept("by", "target")
        then = find(c.items, "then", start=c.i)
        condition = s.expression(c.items[c.i : then]) if c.accept("and") else None
        c.i = then + 1
        if c.accept("delete"):
            clauses.append(Clause(matched, "delete", condition))
        elif c.accept("update"):
            c.accept("set")
            sets = {}
            for p in split(c.rest()):
                eq = next(i for i, t in enumerate(p) if t.is_op("="))
                if isinstance(p[0], Group):
                    raise DialectError("assignments to tuples are not supported")
                sets[name_of(p[eq - 1])] = s.expression(p[eq + 1 :])
            clauses.append(Clause(matched, "update", condition, sets))
        elif c.accept("insert"):
            names = [f.name.lower() for f in target.schema]
            if isinstance(c.peek(), Group):
                names = [name_of(n[-1]) for n in split(c.next().items)]
            c.accept("values")
            rows = [t for t in c.rest() if isinstance(t, Group)]
            if len(rows) != 1:
                raise DialectError("MERGE inserts one row of values")
            clauses.append(Clause(matched, "insert", condition, dict(zip(names, [s.expression(v) for v in split(rows[0].items)]))))
        else:
            raise DialectError("MERGE needs UPDATE, INSERT or DELETE")
    return full, merge(target, source, on, clauses, target_alias=target_alias, source_alias=source_alias)


def merge_into(s, items: list[Item]) -> DataFrame:
    full, (rows, counts) = merge_plan(s, items)
    # Rows whose clause is `insert` and that were there before don't exist, so
    # one pass that is kept gives both the counts and the new table.
    kept = rows = rows.persist()
    try:
        try:
            rows = once(rows)
        except ValueError as e:
            raise DialectError(str(e), "100090") from e
        told = rows.agg(*counts.values()).first().asDict()
        s.catalog.write(full, rows.where("_keep").drop("_clause", "_keep", "_row"), replace=True)
    finally:
        kept.unpersist()
    return s.status(**told)


def copy(s, items: list[Item]) -> DataFrame:
    r = Reader(items)
    r.accept("into")
    first = r.peek()
    if first.kind == "string":  # COPY INTO location FROM table or query
        url = unquote(r.next().text)
        r.accept("from")
        df = s.query(r.next().items) if isinstance(r.peek(), Group) else s.spark.sql(f"SELECT * FROM {s.table(r.name())}")
        files.unload(df, url, options(r.rest()))
        return s.status(OK)
    full = s.full_name(r.name())
    schema = _target(s, full).schema
    r.accept("from")
    source = r.next()
    opts = options(r.rest())
    if source.kind != "string":
        name = source.text.strip("@~/")
        if name not in s.stages:
            raise DialectError(f"Stage '{name}' does not exist or not authorized", "002003")
        url, opts = s.stages[name][0], s.stages[name][1] | opts
    else:
        url = unquote(source.text)
    df = files.read(s.spark, url, opts)
    by_name = opts.get("parse_header", "false").lower() == "true" or opts.get("type", "csv").lower() != "csv"
    fitted = files.fit(df, schema, by_name=by_name).persist()
    n = fitted.count()
    if n:
        s.catalog.append(full, fitted)
    fitted.unpersist()
    return s.status(**{"file": url, "status": "LOADED", "rows_loaded": n})


# Showing


def show(s, items: list[Item]) -> DataFrame:
    r = Reader(items)
    r.accept("terse")
    kind = r.next().text.lower()
    if kind == "primary":
        kind = "primary keys" if r.accept("keys") else kind
    where, like, starts = None, None, None
    while r.peek() is not None:
        if r.accept("in"):
            r.accept("schema") or r.accept("database") or r.accept("table") or r.accept("account")
            where = r.name() if r.peek() is not None and r.peek().kind in ("word", "quoted") and not r.peek().is_word("like", "starts", "limit") else None
        elif r.accept("like"):
            like = unquote(r.next().text)
        elif r.accept("starts", "with"):
            starts = unquote(r.next().text)
        else:
            r.next()
    db = where[0] if where and len(where) > 1 else s.database
    schema = where[-1] if where else s.schema
    if where and len(where) == 1 and where[0] in s.catalog.databases:
        db, schema = where[0], None
    if kind == "databases":
        df, name = _rows(s, ("created_on", "name", "kind", "database_name", "schema_name"), [(None, d, "STANDARD", None, None) for d in sorted(s.catalog.databases)]), "name"
    elif kind == "schemas":
        db = where[0] if where else s.database
        df, name = _rows(s, ("created_on", "name", "kind", "database_name", "schema_name"), [(None, sc, None, d, None) for d, sc in [*s.catalog.schemas(db), (db, "information_schema")]]), "name"
    elif kind in ("tables", "views", "objects"):
        wanted = {"tables": ("TABLE",), "views": ("VIEW",), "objects": ("TABLE", "VIEW")}[kind]
        df, name = _rows(s, ("created_on", "name", "kind", "database_name", "schema_name"), [(None, t, k, d, sc) for d, sc, t, k in s.catalog.tables(db, schema) if k in wanted]), "name"
    elif kind == "columns":
        df, name = information_schema.frame(s, "columns", s.database).selectExpr("table_name", "table_schema AS schema_name", "column_name", "data_type", "is_nullable AS `null?`", "column_default AS default", "'COLUMN' AS kind", "cast(NULL as string) AS expression", "cast(NULL as string) AS comment", "table_catalog AS database_name", "cast(NULL as string) AS autoincrement"), "column_name"
        if where:
            df = df.where(F.col("table_name") == where[-1])
    elif kind == "variables":
        df, name = _rows(s, ("name", "value", "type"), [(k.upper(), str(v), type(v).__name__) for k, v in sorted(s.variables.items())]), "name"
    elif kind == "parameters":
        df, name = _rows(s, ("key", "value", "default", "level", "description", "type"), [(k.upper(), v, None, "SESSION", None, "STRING") for k, v in sorted(s.settings.items())]), "key"
    elif kind == "primary keys":
        return _rows(s, ("created_on", "database_name", "schema_name", "table_name", "column_name", "key_sequence", "constraint_name", "rely", "comment"), [])
    else:
        raise DialectError(f"SHOW {kind.upper()} is not supported")
    if starts is not None:
        df = df.where(F.col(name).startswith(starts))
    return df if like is None else df.where(F.col(name).ilike(like))


def _rows(s, names: tuple[str, ...], rows: list[tuple]) -> DataFrame:
    return s.spark.createDataFrame(rows, T.StructType([T.StructField(n, T.StringType()) for n in names]))


def describe(s, items: list[Item]) -> DataFrame:
    r = Reader(items)
    r.accept("table") or r.accept("view")
    full = s.full_name(r.name())
    if full not in s.catalog.views:
        _target(s, full)
    return _rows(s, ("name", "type", "kind", "null?"), [(f.name, information_schema.type_name(f.dataType), "COLUMN", "Y" if f.nullable else "N") for f in s.read_table(full).schema])


def explain(s, items: list[Item]) -> DataFrame:
    """Rows (plan_type, plan). VERBOSE adds the plan as it was written; ANALYZE runs
    the query and gives each operator's rows."""
    r = Reader(items)
    verbose, analyze = r.accept("verbose"), r.accept("analyze")
    if r.peek().is_word("using"):
        r.i += 2
    rest = r.rest()
    df = merge_plan(s, rest[1:])[1][0] if rest[0].is_word("merge") else s.query(rest)
    run = df._jdf.queryExecution()
    if analyze:
        run.toRdd().count()
        return _rows(s, ("plan_type", "plan"), [("Plan with Metrics", "\n".join(_measured(run.executedPlan(), 0)))])
    out = [("logical_plan", run.optimizedPlan().toString()), ("physical_plan", s.spark._jvm.PythonSQLUtils.explainString(run, "formatted" if verbose else "simple"))]
    return _rows(s, ("plan_type", "plan"), ([("initial_logical_plan", run.logical().toString())] if verbose else []) + out)


def _measured(node, depth: int) -> list[str]:
    """An executed plan as lines, each operator with the rows it made."""
    if node.nodeName() == "AdaptiveSparkPlan":
        return _measured(node.executedPlan(), depth)
    if node.nodeName().endswith("QueryStage"):
        return _measured(node.plan(), depth)
    rows = node.metrics().get("numOutputRows")
    out = [f"{'  ' * depth}{node.nodeName()}" + (f", metrics=[output_rows={rows.get().value()}]" if rows.isDefined() else "")]
    children = node.children()
    for k in range(children.size()):
        out += _measured(children.apply(k), depth + 1)
    return out


def nothing(s, items: list[Item]) -> DataFrame:
    """BEGIN, COMMIT, ROLLBACK: each statement is its own transaction."""
    return s.status(OK)


_RUN = {
    "create": create, "drop": drop, "alter": alter, "use": use, "set": set_variables, "unset": unset_variables, "insert": insert, "truncate": truncate, "delete": delete,
    "update": update, "merge": merge_into, "copy": copy, "show": show, "describe": describe, "desc": describe, "explain": explain,
    "begin": nothing, "start": nothing, "commit": nothing, "rollback": nothing,
}
