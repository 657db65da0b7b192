"""Regular expression functions. Patterns are Java's; groups in replacements may
be written ``\\1``. Parameters: c (case), i (no case), m, s; e takes group 1."""

import re

from tarn.functions.registry import bound, constant, register, same

same("regexp_count")


def _pattern(args: list[str], at: int) -> tuple[str, bool]:
    """The pattern with the flags of the constant at `at`, and whether e is set."""
    flags = constant(args[at]) if len(args) > at else "c"
    on = "".join(f for f in "ims" if f in flags and not (f == "i" and flags.rfind("c") > flags.rfind("i")))
    return (f"concat('(?{on})', {args[1]})" if on else args[1]), "e" in flags


def _arg(args: list[str], at: int, default: str) -> str:
    return args[at] if len(args) > at else default


def _group(args: list[str], at: int, extract: bool) -> str:
    return args[at] if len(args) > at else "1" if extract else "0"


def _all(args: list[str], flags: int, group: int) -> str:
    pattern, extract = _pattern(args, flags)
    text = f"substr({args[0]}, {args[2]})" if len(args) > 2 and args[2].strip() != "1" else args[0]
    return f"regexp_extract_all({text}, {pattern}, {_group(args, group, extract)})"


def _substr(args: list[str]) -> str:
    return f"try_element_at({_all(args, 4, 5)}, cast({_arg(args, 3, '1')} as int))"


def _substr_all(args: list[str]) -> str:
    found = _all(args, 4, 5)
    if len(args) > 3 and args[3].strip() != "1":
        found = f"slice({found}, {args[3]}, 2147483647)"
    return f"to_json({found})"


def _like(args: list[str]) -> str:
    pattern, _ = _pattern(args, 2)
    return f"({args[0]} RLIKE concat('^(?:', {pattern}, ')$'))"


def _match(args: list[str]) -> str:
    pattern, _ = _pattern(args, 2)
    return f"if({args[0]} RLIKE {pattern}, array(regexp_extract({args[0]}, {pattern}, 0)), NULL)"


def _replace(args: list[str]) -> str:
    pattern, _ = _pattern(args, 5)
    new = _arg(args, 2, "''")
    new = re.sub(r"\\{1,2}([0-9])", r"$\1", new)
    where, nth = _arg(args, 3, "1"), _arg(args, 4, "0")
    if nth.strip() == "0":
        return f"regexp_replace({args[0]}, {pattern}, {new}, {where})"
    return f"tarn_regexp_replace_nth({args[0]}, {pattern}, {_arg(args, 2, chr(39) * 2)}, {where}, {nth})"


def _instr(args: list[str]) -> str:
    pattern, extract = _pattern(args, 5)
    start, nth, after, group = _arg(args, 2, "1"), _arg(args, 3, "1"), _arg(args, 4, "0"), _group(args, 6, extract)
    if group.strip() != "0":
        return f"tarn_regexp_instr({args[0]}, {pattern}, {start}, {nth}, {after}, {group})"
    # What lies before the n-th match: as many gaps, and one match less.
    sizes = "aggregate(slice({%s}, 1, %s), 0, (a, x) -> a + length(x))"
    place = f"{{start}} + {sizes % ('gaps', '{nth}')} + {sizes % ('found', '{nth} - 1 + if({after} = 0, 0, 1)')}"
    text = args[0] if start.strip() == "1" else f"substr({args[0]}, {start})"
    body = f"if({{found}} IS NULL, NULL, if(size({{found}}) < {{nth}}, 0L, cast({place} as bigint)))"
    return bound(body, found=f"regexp_extract_all({text}, {pattern}, 0)", gaps=f"split({text}, {pattern}, -1)", start=f"cast({start} as int)", nth=f"cast({nth} as int)", after=f"cast({after} as int)")


register("regexp_substr", _substr)
register("regexp_substr_all regexp_extract_all", _substr_all)
register("regexp_like rlike", _like)
register("regexp_match", _match)
register("regexp_replace", _replace)
register("regexp_instr", _instr)
