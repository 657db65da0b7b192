"""The dialect's functions, as Spark SQL text made from argument texts.

A function is a template per count of arguments (``{0}``, ``{1}``, and ``{all}``
for the whole list), or a Python callable of the argument texts. The results are
built-in expressions that Catalyst optimises; only what is registered in
``udfs.py`` runs in Python, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

Builder = Callable[[list[str]], str]

FUNCTIONS: dict[str, Builder] = {}


class ArgumentError(ValueError):
    """A call with a wrong count of arguments, or a wrong constant."""


def register(names: str, builder: Builder) -> None:
    for n in names.split():
        FUNCTIONS[n] = builder


def templates(names: str, **by_count: str) -> None:
    """templates("iff", _3="if({0}, {1}, {2})"); _n is for any other count."""

    def build(args: list[str]) -> str:
        t = by_count.get(f"_{len(args)}", by_count.get("_n"))
        if t is None:
            raise ArgumentError(f"{names.split()[0]} doesn't take {len(args)} arguments")
        for i, a in enumerate(args):
            t = t.replace("{%d}" % i, a)
        return t.replace("{all}", ", ".join(args))

    register(names, build)


def renamed(**names: str) -> None:
    """Functions that Spark has under another name, arguments as they are."""
    for name, spark in names.items():
        register(name, lambda args, spark=spark: f"{spark}({', '.join(args)})")


def same(names: str) -> None:
    """Functions that Spark has with the same name and meaning."""
    for n in names.split():
        register(n, lambda args, n=n: f"{n}({', '.join(args)})")


def constant(arg: str) -> str:
    """The value of a string constant, or of a bare word (such as a date part)."""
    a = arg.strip()
    return a[1:-1].replace("''", "'") if a[:1] == "'" and a[-1:] == "'" else a


def bound(body: str, **values: str) -> str:
    """body with ``{name}`` for each value, which is written, and evaluated, once."""
    fields = ", ".join(f"{v} as {k}" for k, v in values.items())
    for k in values:
        body = body.replace("{%s}" % k, f"b.{k}")
    return f"transform(array(struct({fields})), b -> {body})[0]"


def call(name: str, args: list[str]) -> str:
    return FUNCTIONS[name.lower()](args)


def load() -> None:
    from tarn.functions import aggregates, arrays, conditional, conversion, datetimes, lists, numeric, regexps, semi, session, strings  # noqa: F401
