"""Functions on real arrays (``list_*`` and those array functions without a JSON
form), maps and structs."""

from tarn.functions.registry import register, renamed, same, templates


def both(name: str, **by_count: str) -> None:
    templates(f"list_{name}", **by_count)
    templates(f"array_{name}", **by_count)


renamed(list_append="array_append", list_cat="concat", list_contains="array_contains", list_distinct="array_distinct", list_except="array_except", list_intersect="array_intersect", list_join="array_join", list_max="array_max", list_position="array_position", list_prepend="array_prepend", list_repeat="array_repeat", list_reverse="reverse", list_to_string="array_join", list_union="array_union", array_concat="concat", list_concat="concat", array_has="array_contains", list_has="array_contains", array_has_any="arrays_overlap", list_has_any="arrays_overlap", array_intersect="array_intersect", array_join="array_join", array_repeat="array_repeat", array_union="array_union", row="struct")
same("cardinality element_at map map_keys map_values named_struct struct map_entries map_contains_key")
templates("list_element", _2="try_element_at({0}, {1})")
templates("list_remove", _2="if(array_contains({0}, {1}), concat(slice({0}, 1, cast(array_position({0}, {1}) - 1 as int)), slice({0}, cast(array_position({0}, {1}) + 1 as int), greatest(0, size({0})))), {0})")
_SORTED = "array_sort({0})"
templates("list_sort", _1=_SORTED, _2="sort_array({0}, {1})", _3="sort_array({0}, {1})")
templates("list_slice", _3="slice({0}, {1}, greatest(0, {2} - {1} + 1))")
both("any_value", _1="try_element_at(filter({0}, x -> x IS NOT NULL), 1)")
both("dims", _1="array(size({0}))")
both("ndims", _1="(length(regexp_extract(typeof({0}), '^(array<)*', 0)) div 6)")
both("distance", _2="sqrt(aggregate(zip_with({0}, {1}, (x, y) -> cast((x - y) * (x - y) as double)), 0D, (a, b) -> a + b))")
both("empty", _1="(size({0}) = 0)")
both("extract", _2="try_element_at({0}, {1})")
both("has_all", _2="(size(array_except({1}, {0})) = 0)")
both("indexof", _2="nullif(array_position({0}, {1}), 0)")
both("length", _1="size({0})")
both("pop_back", _1="slice({0}, 1, greatest(0, size({0}) - 1))")
both("pop_front", _1="slice({0}, 2, greatest(0, size({0}) - 1))")
both("positions", _2="filter(transform({0}, (x, i) -> if(x <=> {1}, i + 1, NULL)), i -> i IS NOT NULL)")
both("push_back", _2="array_append({0}, {1})")
both("push_front", _2="array_prepend({0}, {1})")
both("remove_all", _2="array_remove({0}, {1})")
_COUNT_TO = "size(filter(slice({0}, 1, i + 1), y -> y <=> {1}))"
both("remove_n", _3=f"filter({{0}}, (x, i) -> NOT (x <=> {{1}} AND {_COUNT_TO} <= {{2}}))")
both("replace", _3=f"transform({{0}}, (x, i) -> if(x <=> {{1}} AND {_COUNT_TO} <= 1, {{2}}, x))")
both("replace_all", _3="transform({0}, x -> if(x <=> {1}, {2}, x))")
both("replace_n", _4=f"transform({{0}}, (x, i) -> if(x <=> {{1}} AND {_COUNT_TO} <= {{3}}, {{2}}, x))")
both("resize", _2="concat(slice({0}, 1, {1}), array_repeat(NULL, greatest(0, {1} - size({0}))))", _3="concat(slice({0}, 1, {1}), array_repeat({2}, greatest(0, {1} - size({0}))))")
templates("empty", _1="(size({0}) = 0)")
templates("generate_series", _2="sequence({0}, {1})", _3="sequence({0}, {1}, {2})")
_HALF_OPEN = "if({0} < {1}, sequence(cast({0} as bigint), cast({1} as bigint) - 1, cast({2} as bigint)), array())"
register("range", lambda a: _HALF_OPEN.replace("{0}", "0" if len(a) == 1 else a[0]).replace("{1}", a[-1] if len(a) < 3 else a[1]).replace("{2}", a[2] if len(a) > 2 else "1"))
register("get_field", lambda a: f"({a[0]}).`{a[1].strip().strip(chr(39))}`")
templates("map_extract", _2="array(try_element_at({0}, {1}))")
templates("string_to_array string_to_list", _2="split({0}, concat('\\\\Q', {1}, '\\\\E'), -1)", _3="transform(split({0}, concat('\\\\Q', {1}, '\\\\E'), -1), x -> nullif(x, {2}))")
templates("union_extract", _2="try_variant_get(parse_json({0}), concat('$.', {1}), 'string')")
