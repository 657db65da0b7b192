"""JSON, object and variant functions, on JSON text.

``_F(x)`` are the fragments of a JSON array: an array of JSON texts (``1``,
``"a"``, ``null``), which ordinary array functions can compare. Objects are maps
of variants; keys come out sorted.
"""

from tarn.functions.registry import bound, constant, register, templates

_MAP = "cast(try_parse_json({0}) as map<string, variant>)"


def element(x: str, path: str, *, unquote: bool = True) -> str:
    """What stands at a JSON path, as text; the texts of JSON strings unquoted."""
    return f"get_json_object({x}, {path})" if unquote else f"to_json(try_variant_get(try_parse_json({x}), {path}, 'variant'))"


def quoted_path(path: str) -> str:
    """'$.a.b[0]' of a dialect path such as ``a.b[0]`` or ``a['b c']``."""
    out, at = "$", 0
    while at < len(path):
        if path[at] == "[":
            end = path.index("]", at)
            key = path[at + 1 : end]
            out += f"[{key}]" if key.lstrip("-").isdigit() else "['" + key.strip("'\"") + "']"
            at = end + 1
        elif path[at] == ".":
            at += 1
        else:
            end = min((path.find(c, at) for c in ".[" if path.find(c, at) >= 0), default=len(path))
            out += "." + path[at:end]
            at = end
    return out


def _literal_path(arg: str) -> str:
    return '"' + quoted_path(constant(arg)).replace('"', '\\"') + '"'


def _get(args: list[str]) -> str:
    x, key = args
    if key.strip().lstrip("-").isdigit():
        return element(x, f"'$[{key.strip()}]'", unquote=False)
    if key.strip().startswith("'"):
        return f"to_json(try_element_at({_MAP.replace('{0}', x)}, {key}))"
    return bound("if(ltrim({x}) LIKE '[%', to_json(get(cast(try_parse_json({x}) as array<variant>), try_cast({k} as int))), to_json(try_element_at(cast(try_parse_json({x}) as map<string, variant>), cast({k} as string))))", x=x, k=key)


def _json_path(keys: list[str]) -> str:
    """A path of keys and positions given one by one."""
    if not keys:
        return "'$'"
    out = "$"
    for k in keys:
        c = constant(k)
        out += f"[{c}]" if c.isdigit() and not k.strip().startswith("'") else f"['{c}']"
    return f'"{out}"'


def _variant(args: list[str], kind: str) -> str:
    return f"try_variant_get(try_parse_json({args[0]}), {_json_path(args[1:])}, '{kind}')"


register("get", _get)
templates("get_ignore_case", _2=f"to_json(try_element_at(map_values(map_filter({_MAP}, (k, v) -> lower(k) = lower({{1}}))), 1))")
register("get_path json_extract_path_text", lambda a: element(a[0], _literal_path(a[1]), unquote=False))
register("variant_element array_element", lambda a: element(a[0], a[1], unquote=len(a) > 2 and a[2].strip().lower() != "false"))
_TYPE = "schema_of_variant(parse_json({0}))"
templates("is_array", _1=f"({_TYPE} LIKE 'ARRAY%')")
templates("is_object", _1=f"({_TYPE} LIKE 'OBJECT%')")
templates("is_boolean", _1=f"({_TYPE} = 'BOOLEAN')")
templates("is_integer", _1=f"({_TYPE} = 'BIGINT')")
templates("is_decimal", _1=f"({_TYPE} LIKE 'DECIMAL%' OR {_TYPE} = 'BIGINT')")
templates("is_double is_real", _1=f"({_TYPE} LIKE 'DECIMAL%' OR {_TYPE} IN ('BIGINT', 'DOUBLE', 'FLOAT'))")
templates("is_varchar is_char", _1=f"({_TYPE} = 'STRING')")
templates("is_null_value", _1=f"({_TYPE} = 'VOID')")
templates("as_array", _1="if(ltrim({0}) LIKE '[%', {0}, NULL)")
templates("as_object", _1="if(ltrim({0}) LIKE '{%', {0}, NULL)")
register("json_get", lambda a: f"to_json({_variant(a, 'variant')})")
register("json_get_json", lambda a: f"to_json({_variant(a, 'variant')})")
register("json_as_text", lambda a: element(a[0], _json_path(a[1:])))
register("json_get_str", lambda a: _variant(a, "string"))
register("json_get_int", lambda a: _variant(a, "bigint"))
register("json_get_float", lambda a: _variant(a, "double"))
register("json_get_bool", lambda a: _variant(a, "boolean"))
register("json_contains", lambda a: f"({_variant(a, 'variant')} IS NOT NULL)")
_PART = "get_json_object({0}, {1})"
register("json_length json_len", lambda a: "coalesce(json_array_length({0}), size(json_object_keys({0})))".replace("{0}", _PART.format(a[0], _json_path(a[1:])) if len(a) > 1 else a[0]))
register("json_keys json_object_keys", lambda a: f"json_object_keys({_PART.format(a[0], _json_path(a[1:])) if len(a) > 1 else a[0]})")
templates("object_keys", _1="to_json(json_object_keys({0}))")
templates("parse_json", _1="nullif(to_json(parse_json(regexp_replace({0}, ',(?=\\\\s*,)', ',null'))), 'null')")
templates("try_parse_json", _1="nullif(to_json(try_parse_json({0})), 'null')")
templates("check_json", _1="if({0} IS NULL OR try_parse_json({0}) IS NOT NULL, NULL, 'invalid JSON')")


def json_text(x: str) -> str:
    """A text as a JSON string; null as null."""
    return f"transform(array(to_json(array(cast({x} as string)))), j -> substr(j, 2, length(j) - 2))[0]"


_MAY_BE_JSON = r'^\\s*([\\[{"0-9-]|(true|false|null)\\s*$)'


def fragment(x: str) -> str:
    """JSON text of a value: a constant by its kind, else JSON text as it is and other text quoted."""
    c = x.strip()
    if c.upper() in ("NULL", "TRUE", "FALSE") or c.lstrip("-").replace(".", "", 1).isdigit():
        return f"'{c.lower()}'"
    quoted = "substr(to_json(array(t)), 2, length(to_json(array(t))) - 2)"
    # A text that can't be JSON isn't parsed: a failure costs far more than a look.
    return f"transform(array(cast({x} as string)), t -> if(t RLIKE '{_MAY_BE_JSON}', coalesce(to_json(try_parse_json(t)), {quoted}), {quoted}))[0]"


def _pair(key: str, value: str) -> str:
    """A member as a struct of key, JSON text of the value, and whether it is null."""
    whole = fragment(value)
    if whole == f"'{value.strip().lower()}'":
        return f"struct(cast({key} as string) as k, {whole} as v, {'true' if value.strip().upper() == 'NULL' else 'false'} as n)"
    return f"transform(array(cast({value} as string)), u -> struct(cast({key} as string) as k, {fragment('u')} as v, u IS NULL as n))[0]"


def _construct(keep_null: bool):
    def build(args: list[str]) -> str:
        if len(args) % 2:
            raise ValueError("object_construct takes pairs of a key and a value")
        pairs = ", ".join(_pair(k, v) for k, v in zip(args[::2], args[1::2]))
        live = f"filter(array({pairs}), p -> p.k IS NOT NULL{'' if keep_null else ' AND NOT p.n'})" if args else "array()"
        if not args:
            return "'{}'"
        return f"concat('{{', array_join(transform(array_sort({live}), p -> concat({json_text('p.k')}, ':', p.v)), ','), '}}')"

    return build


register("object_construct make_object", _construct(False))
register("object_construct_keep_null", _construct(True))


def _keyed(test: str):
    def build(args: list[str]) -> str:
        keys = ", ".join(args[1:])
        return f"to_json(map_filter({_MAP.replace('{0}', args[0])}, (k, v) -> {test} array_contains(array({keys}), k)))"

    return build


register("object_delete", _keyed("NOT"))
register("object_pick", _keyed(""))


def _insert(args: list[str]) -> str:
    new = "to_json(map_concat(map_filter({m}, (k, v) -> k <> {key}), map({key}, {value})))"
    if len(args) < 4 or args[3].strip().lower() != "true":
        new = f"if(map_contains_key({{m}}, {{key}}), raise_error('duplicate field key'), {new})"
    return bound(new, m=_MAP.replace("{0}", args[0]), key=args[1], value=f"parse_json({fragment(args[2])})")


register("object_insert", _insert)
