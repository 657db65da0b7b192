"""Array functions on JSON text. ``F`` takes an array apart into JSON texts,
``J`` puts it together again; a needle is compared in its JSON form. Arguments
that a text needs several times are bound once, so nested calls grow in
proportion to their depth."""

from tarn.functions.registry import bound, register, templates
from tarn.functions.semi import fragment


def F(x: str) -> str:
    return f"transform(cast(try_parse_json({x}) as array<variant>), v -> to_json(v))"


def J(array: str) -> str:
    return f"concat('[', array_join({array}, ','), ']')"


register("array_construct make_array make_list", lambda a: J(f"array({', '.join(fragment(x) for x in a)})") if a else "'[]'")
register("array_construct_compact", lambda a: J(f"filter(array({', '.join(fragment(x) for x in a)}), x -> x <> 'null')"))
register("array_append", lambda a: J(f"array_append({F(a[0])}, {fragment(a[1])})"))
register("array_prepend", lambda a: J(f"array_prepend({F(a[0])}, {fragment(a[1])})"))
register("array_cat", lambda a: J(f"concat({F(a[0])}, {F(a[1])})"))
register("array_compact", lambda a: J(f"filter({F(a[0])}, x -> x <> 'null')"))
register("array_contains", lambda a: f"array_contains({F(a[1])}, {fragment(a[0])})")
register("array_distinct", lambda a: J(f"array_distinct({F(a[0])})"))
register("array_except", lambda a: J(f"filter({F(a[0])}, x -> NOT array_contains({F(a[1])}, x))"))
register("array_intersection", lambda a: J(f"filter({F(a[1])}, x -> array_contains({F(a[0])}, x))"))
register("arrays_overlap", lambda a: f"arrays_overlap({F(a[0])}, {F(a[1])})")
register("array_flatten", lambda a: bound("if(exists({f}, x -> x = 'null'), NULL, " + J("flatten(transform({f}, e -> " + F("e") + "))") + ")", f=F(a[0])))
_RANGE = "if({0} < {1}, sequence(cast({0} as bigint), cast({1} as bigint) - 1, cast({2} as bigint)), array())"
_DOWN = "if({2} > 0, " + _RANGE + ", if({0} > {1}, sequence(cast({0} as bigint), cast({1} as bigint) + 1, cast({2} as bigint)), array()))"
register("array_generate_range generate_range", lambda a: bound("to_json(" + (_RANGE if len(a) < 3 else _DOWN).format("{lo}", "{hi}", "{step}") + ")", lo=a[0], hi=a[1], step=a[2] if len(a) > 2 else "1"))
register("array_insert", lambda a: bound(J("array_insert({f}, if({n} >= 0, {n} + 1, {n}), {x})"), f=F(a[0]), n=f"cast({a[1]} as int)", x=fragment(a[2])))
register("array_remove", lambda a: J(f"array_remove({F(a[0])}, {fragment(a[1])})"))


def _remove_at(args: list[str]) -> str:
    n = "if({n} < 0, size({f}) + {n}, {n})"
    return bound(f"if({n} < 0 OR {n} >= size({{f}}), NULL, {J(f'filter({{f}}, (x, i) -> i <> {n})')})", f=F(args[0]), n=f"cast({args[1]} as int)")


register("array_remove_at", _remove_at)
register("array_reverse", lambda a: J(f"reverse({F(a[0])})"))
register("array_size", lambda a: bound("if(ltrim({x}) LIKE '[%', json_array_length({x}), NULL)", x=a[0]))


def _slice(args: list[str]) -> str:
    lo, hi = ("if({%s} < 0, size({f}) + {%s}, {%s})".replace("%s", x) for x in ("lo", "hi"))
    body = J(f"slice({{f}}, {lo} + 1, greatest(0, least({hi}, size({{f}})) - {lo}))")
    return bound(body, f=F(args[0]), lo=f"cast({args[1]} as int)", hi=f"cast({args[2]} as int)")


register("array_slice", _slice)
#: Kinds in rising order: booleans, numbers, texts, arrays, objects; null last.
_RANK = "CASE WHEN {x} = 'null' THEN 9 WHEN {x} IN ('true', 'false') THEN 0 WHEN {x} LIKE '\"%' THEN 2 WHEN {x} LIKE '[%' THEN 3 WHEN {x} LIKE '{{%' THEN 4 ELSE 1 END"


def _ranked(x: str) -> str:
    """The elements with what they are ordered by."""
    return f"transform({F(x)}, x -> struct({_RANK.format(x='x')} as r, try_cast(x as double) as n, x as v))"


def _sort(args: list[str]) -> str:
    up = f"array_sort({_ranked(args[0])})"
    falls = len(args) > 1 and args[1].strip().lower() == "false"
    return J(f"transform({f'reverse({up})' if falls else up}, s -> s.v)")


register("array_sort", _sort)
register("array_to_string", lambda a: f"array_join(transform(cast(try_parse_json({a[0]}) as array<variant>), v -> coalesce(cast(v as string), '')), {a[1]})")
register("arrays_to_object", lambda a: f"to_json(map_from_entries(filter(arrays_zip(cast(try_parse_json({a[0]}) as array<string>), cast(try_parse_json({a[1]}) as array<variant>)), p -> p['0'] IS NOT NULL)))")


def _zip(args: list[str]) -> str:
    names = [f"a{k}" for k in range(len(args))]
    most = f"greatest({', '.join(f'size({{{n}}})' for n in names)}, 0)"
    row = ", ',', ".join(f"'\"${k + 1}\":', coalesce(get({{{n}}}, i), 'null')" for k, n in enumerate(names))
    body = J(f"transform(if({most} = 0, array(), sequence(0, {most} - 1)), i -> concat('{{', {row}, '}}'))")
    return bound(body, **{n: F(a) for n, a in zip(names, args)})


register("arrays_zip", _zip)


def _extreme(which: str):
    """The least or largest element as text, whatever its kind; nulls don't count."""

    def build(args: list[str]) -> str:
        live = f"filter({_ranked(args[0])}, s -> s.v <> 'null')"
        return bound("if({m}.r = 2, get_json_object(concat('[', {m}.v, ']'), '$[0]'), {m}.v)", m=f"array_{which}({live})")

    return build


register("array_max", _extreme("max"))
register("array_min", _extreme("min"))
register("array_position", lambda a: f"nullif(array_position({F(a[1])}, {fragment(a[0])}) - 1, -1)")
