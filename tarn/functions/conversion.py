"""Conversion functions. VARIANT, ARRAY and OBJECT values are JSON text."""

from tarn.functions.registry import bound, constant, register, templates

#: Dialect type names and Spark's; parameters in brackets follow where they make sense.
TYPES = {
    "int": "bigint", "integer": "bigint", "bigint": "bigint", "int64": "bigint", "smallint": "bigint", "tinyint": "bigint", "byteint": "bigint",
    "int32": "int", "uint32": "bigint", "uint64": "bigint",
    "float": "double", "float4": "double", "float8": "double", "float64": "double", "double": "double", "real": "double", "float32": "float",
    "number": "decimal(38,0)", "numeric": "decimal(38,0)", "decimal": "decimal(38,0)", "dec": "decimal(38,0)",
    "varchar": "string", "char": "string", "character": "string", "text": "string", "string": "string", "nvarchar": "string", "json": "string",
    "variant": "string", "object": "string", "array": "string",
    "binary": "binary", "varbinary": "binary", "blob": "binary", "bytea": "binary", "boolean": "boolean", "bool": "boolean",
    "date": "date", "time": "string", "datetime": "timestamp_ntz", "timestamp": "timestamp_ntz", "timestamp_ntz": "timestamp_ntz", "timestampntz": "timestamp_ntz",
    "timestamp_ltz": "timestamp", "timestampltz": "timestamp", "timestamp_tz": "timestamp", "timestamptz": "timestamp",
}


def spark_type(name: str, params: str = "") -> str:
    base = TYPES.get(name.lower())
    if base is None:
        return name + (f"({params})" if params else "")
    if base.startswith("decimal") and params:
        return f"decimal({params if ',' in params else params + ', 0'})"
    return base


def cast(x: str, name: str, params: str = "", *, safe: bool = False) -> str:
    """x cast to a dialect type; texts become integers by rounding half up."""
    how, t = "try_cast" if safe else "cast", name.lower()
    kind = spark_type(name, params)
    if kind in ("bigint", "int") and t in TYPES:
        return f"{how}({how}({x} as decimal(38, 0)) as {kind})"
    if t == "date":
        return f"{how}({x} as date)"
    if t == "array":
        return f"if(ltrim({x}) LIKE '[%', transform(cast(try_parse_json({x}) as array<variant>), v -> cast(v as string)), array(cast({x} as string)))"
    if t in ("variant", "object"):
        return f"cast({x} as string)" if t == "variant" else f"to_json(parse_json({x}))"
    return f"{how}({x} as {kind})"


templates("to_array", _1="if(ltrim(cast({0} as string)) LIKE '[%' AND try_parse_json(cast({0} as string)) IS NOT NULL, cast({0} as string), to_json(array({0})))")
templates("to_object", _1="to_json(parse_json({0}))")
templates("to_variant", _1="cast({0} as string)")

_TRUE, _FALSE = "('true', 't', 'yes', 'y', 'on', '1')", "('false', 'f', 'no', 'n', 'off', '0')"
_BOOLEAN = "CASE WHEN lower(cast({0} as string)) IN " + _TRUE + " THEN true WHEN lower(cast({0} as string)) IN " + _FALSE + " THEN false WHEN try_cast(cast({0} as string) as double) IS NOT NULL THEN try_cast(cast({0} as string) as double) <> 0"
templates("to_boolean", _1=_BOOLEAN + " WHEN {0} IS NULL THEN NULL ELSE raise_error(concat('Boolean value ''', cast({0} as string), ''' is not recognized')) END")
templates("try_to_boolean", _1=_BOOLEAN + " END")


def _binary(prefix: str):
    def build(args: list[str]) -> str:
        how = constant(args[1]).lower().replace("-", "") if len(args) > 1 else "hex"
        if prefix and how == "hex":
            return f"unhex({args[0]})"
        return f"{prefix}to_binary({args[0]}, '{how}')"

    return build


register("to_binary", _binary(""))
register("try_to_binary", _binary("try_"))

#: Parts of dialect formats (fixed values) and their Java patterns, long ones first.
_FORMAT = [("YYYY", "yyyy"), ("YY", "yy"), ("MMMM", "MMMM"), ("MON", "MMM"), ("MM", "MM"), ("DD", "dd"), ("DY", "E"), ("HH24", "HH"), ("HH12", "hh"), ("AM", "a"), ("PM", "a"), ("MI", "mm"), ("SS", "ss"), ("FF9", "SSSSSSSSS"), ("FF6", "SSSSSS"), ("FF3", "SSS"), ("FF", "SSSSSS"), ("TZH:TZM", "XXX"), ("TZHTZM", "XX")]


def java_format(fmt: str) -> str:
    out, at, upper = "", 0, fmt.upper()
    while at < len(fmt):
        for a, b in _FORMAT:
            if upper.startswith(a, at):
                out, at = out + b, at + len(a)
                break
        else:
            out, at = out + (f"''{fmt[at]}''" if fmt[at].isalpha() else fmt[at]), at + 1
    return out


# Parsers raise and catch an exception for each text they refuse, which takes longer
# than all else in a row: they are asked only for texts of a shape they may take.
_MDY = "0*(1[0-2]|[1-9])/0*(3[01]|[12][0-9]|[1-9])/[+-]?[0-9]{4,}"
_D_MON = "^[0-9]{2}-[^0-9]"
_WHOLE = "^[\\\\x00-\\\\x20\\\\x7f]*[-+]?[.0-9]+[\\\\x00-\\\\x20\\\\x7f]*$"
_NUMBER = "^[\\\\x00-\\\\x20]*[-+]?[.\\\\p{Nd}]+([eE][-+]?\\\\p{Nd}+)?[\\\\x00-\\\\x20]*$"


def _shaped(shape: str, parsed: str) -> str:
    return f"if({{s}} RLIKE '{shape}', {parsed}, NULL)"


def _typed(x: str, kind: str, parsed: str) -> str:
    """A date or timestamp is cast, so that filters on it reach the scan; else it is
    parsed. The type is known when the query is planned, and one branch is left.
    A constant is parsed then, too."""
    text = f"cast({x} as string)"
    if x.strip()[:1] == "'" or x.strip().isdigit():
        return parsed.replace("{s}", text)
    parsed = bound(parsed, s=text)
    return f"if(typeof({x}) IN ('date', 'timestamp', 'timestamp_ntz'), {_CASTS[kind]}({x}), {parsed})"


#: Casts that the analyser takes for any type, also where they end up unused.
_CASTS = {"date": "to_date", "timestamp": "to_timestamp_ltz", "timestamp_ntz": "to_timestamp_ntz"}


def _date(how: str):
    def build(args: list[str]) -> str:
        x = args[0]
        if len(args) > 1 and constant(args[1]).lower() != "auto":
            return f"{how}to_date({x}, '{java_format(constant(args[1]))}')"
        texts = [_shaped(_D_MON, "try_to_date({s}, 'dd-MMM-yyyy')"), _shaped(f"^{_MDY}$", "try_to_date({s}, 'M/d/yyyy')")]
        found = f"coalesce(try_cast({{s}} as date), {', '.join(texts)}, cast(timestamp_seconds({_shaped(_WHOLE, 'try_cast({s} as bigint)')}) as date))"
        if not how:
            found = f"if({{s}} IS NULL, NULL, coalesce({found}, raise_error(concat('Date ''', {{s}}, ''' is not recognized'))))"
        return _typed(x, "date", found)

    return build


register("to_date date", _date(""))
register("try_to_date", _date("try_"))


def _timestamp(kind: str, safe: bool):
    def build(args: list[str]) -> str:
        x = args[0]
        if len(args) > 1 and args[1].strip().lstrip("-").isdigit():
            scale = 10 ** (6 - int(args[1])) if int(args[1]) <= 6 else None
            micros = f"cast({x} * {scale} as bigint)" if scale else f"cast({x} as bigint) div {10 ** (int(args[1]) - 6)}"
            return f"cast(timestamp_micros({micros}) as {kind})"
        if len(args) > 1 and args[1].strip().startswith("'") and constant(args[1]).lower() != "auto":
            return f"cast({'try_' if safe else ''}to_timestamp({x}, '{java_format(constant(args[1]))}') as {kind})"
        # Whole numbers are seconds, or by their size milli-, micro- or nanoseconds.
        micros = "CASE WHEN abs({n}) < 31536000000 THEN {n} * 1000000 WHEN abs({n}) < 31536000000000 THEN {n} * 1000 WHEN abs({n}) < 31536000000000000 THEN {n} ELSE {n} / 1000 END"
        epoch = _shaped(_NUMBER, f"timestamp_micros(cast({bound(micros, n='try_cast({s} as decimal(38, 9))')} as bigint))")
        texts = [_shaped(f"^{_MDY} ", f"cast(try_to_timestamp({{s}}, 'M/d/yyyy H:mm:ss') as {kind})"), _shaped(_D_MON, f"cast(try_to_timestamp({{s}}, 'dd-MMM-yyyy HH:mm:ss') as {kind})")]
        found = f"coalesce(try_cast({{s}} as {kind}), {', '.join(texts)}, cast({epoch} as {kind}))"
        if not safe:
            found = f"if({{s}} IS NULL, NULL, coalesce({found}, raise_error(concat('Timestamp ''', {{s}}, ''' is not recognized'))))"
        return _typed(x, kind, found)

    return build


for _name, _kind in {"to_timestamp": "timestamp_ntz", "to_timestamp_ntz": "timestamp_ntz", "to_timestamp_ltz": "timestamp", "to_timestamp_tz": "timestamp"}.items():
    register(_name, _timestamp(_kind, False))
    register(f"try_{_name}", _timestamp(_kind, True))
templates("to_timestamp_seconds", _1="cast(timestamp_seconds({0}) as timestamp_ntz)")
templates("to_timestamp_millis", _1="cast(timestamp_millis({0}) as timestamp_ntz)")
templates("to_timestamp_micros", _1="cast(timestamp_micros({0}) as timestamp_ntz)")
templates("to_timestamp_nanos", _1="cast(timestamp_micros({0} div 1000) as timestamp_ntz)")
templates("to_unixtime", _1="unix_seconds(cast({0} as timestamp))", _2="to_unix_timestamp({0}, {1})")
templates("to_local_time", _1="cast({0} as timestamp_ntz)")

_CLOCK = "if({0} RLIKE '^[0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\\\\.[0-9]+)?)?$', date_format(try_cast(concat('1970-01-01 ', {0}) as timestamp_ntz), 'HH:mm:ss'), date_format(try_cast({0} as timestamp_ntz), 'HH:mm:ss'))"


def _time(safe: bool):
    def build(args: list[str]) -> str:
        s = f"cast({args[0]} as string)"
        if len(args) > 1:
            return f"date_format({'try_' if safe else ''}to_timestamp({s}, '{java_format(constant(args[1]))}'), 'HH:mm:ss')"
        found = _CLOCK.replace("{0}", s)
        return found if safe else f"if({args[0]} IS NULL, NULL, coalesce({found}, raise_error(concat('Time ''', {s}, ''' is not recognized'))))"

    return build


register("to_time time", _time(False))
register("try_to_time", _time(True))


def _decimal(safe: bool):
    def build(args: list[str]) -> str:
        x, rest = args[0], [a.strip() for a in args[1:]]
        how = "try_" if safe else ""
        if rest and rest[0].startswith("'"):
            fmt, rest = rest[0], rest[1:]
            x = f"{how}to_number({x}, {fmt})"
        p, s = (rest + ["38", "0"][len(rest) :])[:2] if rest else ("38", "0")
        return f"{how}cast({x} as decimal({p}, {s}))"

    return build


register("to_decimal to_number to_numeric", _decimal(False))
register("try_to_decimal try_to_number try_to_numeric", _decimal(True))
templates("to_double", _1="cast({0} as double)")
templates("try_to_double", _1="try_cast({0} as double)")


def _varchar(args: list[str]) -> str:
    x = args[0]
    if len(args) == 1:
        # Whole floating-point numbers print without a fraction.
        return f"regexp_replace(cast({x} as string), '^(-?[0-9]+)\\\\.0$', '$1')"
    fmt = constant(args[1])
    if any(c in fmt for c in "09$") or fmt.upper() in ("TM9", "TM"):
        return f"to_char({x}, '{fmt}')"
    if fmt.lower() in ("hex", "base64", "utf-8"):
        return {"hex": f"hex({x})", "base64": f"base64({x})"}.get(fmt.lower(), f"decode({x}, 'UTF-8')")
    return f"date_format({x}, '{java_format(fmt)}')"


register("to_char to_varchar try_to_char try_to_varchar", _varchar)


def _arrow_cast(args: list[str]) -> str:
    names = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "bigint", "float32": "float", "float64": "double", "utf8": "string", "largeutf8": "string", "utf8view": "string", "boolean": "boolean", "date32": "date", "binary": "binary"}
    name = constant(args[1])
    low = name.lower()
    kind = names.get(low) or ("timestamp_ntz" if low.startswith("timestamp") else low.replace("decimal128", "decimal"))
    return f"cast({args[0]} as {kind})"


register("arrow_cast", _arrow_cast)
templates("arrow_typeof system$typeof", _1="typeof({0})")
_KIND = "schema_of_variant(try_parse_json(cast({0} as string)))"
templates(
    "typeof",
    _1=f"CASE WHEN {{0}} IS NULL THEN NULL WHEN {_KIND} = 'VOID' THEN 'NULL_VALUE' WHEN {_KIND} = 'BOOLEAN' THEN 'BOOLEAN' WHEN {_KIND} = 'BIGINT' THEN 'INTEGER' WHEN {_KIND} LIKE 'DECIMAL%' OR {_KIND} IN ('DOUBLE', 'FLOAT') THEN 'DOUBLE' WHEN {_KIND} LIKE 'ARRAY%' THEN 'ARRAY' WHEN {_KIND} LIKE 'OBJECT%' THEN 'OBJECT' WHEN {_KIND} = 'STRING' OR {_KIND} IS NULL THEN 'VARCHAR' ELSE {_KIND} END",
)
