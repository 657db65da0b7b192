"""Conditional functions. Booleans may be given as numbers (not 0) or booleans."""

from tarn.functions.registry import register, renamed, same, templates

same("coalesce greatest least nullif nvl nvl2 ifnull nullifzero zeroifnull equal_null")
templates("iff", _3="if({0}, {1}, {2})")
templates("booland", _2="(cast({0} as boolean) AND cast({1} as boolean))")
templates("boolor", _2="(cast({0} as boolean) OR cast({1} as boolean))")
templates("boolxor", _2="(cast({0} as boolean) <> cast({1} as boolean))")
templates("boolnot", _1="(NOT cast({0} as boolean))")
renamed(nullif0="nullifzero")


def _decode_case(args: list[str]) -> str:
    subject, rest = args[0], args[1:]
    pairs = [f"WHEN {subject} <=> {rest[i]} THEN {rest[i + 1]}" for i in range(0, len(rest) - 1, 2)]
    other = f" ELSE {rest[-1]}" if len(rest) % 2 else ""
    return f"CASE {' '.join(pairs)}{other} END"


def _decode(args: list[str]) -> str:
    if len(args) == 2:  # text in an encoding
        how = args[1].strip().strip("'").lower()
        return {"hex": f"unhex({args[0]})", "base64": f"unbase64({args[0]})"}.get(how, f"decode({args[0]}, {args[1]})")
    return _decode_case(args)


register("decode", _decode)
