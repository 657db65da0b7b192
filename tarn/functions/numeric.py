"""Numeric functions."""

from tarn.functions.registry import register, renamed, same, templates

same("abs acos acosh asin asinh atan atan2 atanh cbrt ceil cos cosh cot degrees exp floor isnan ln log10 log2 nanvl pi pow power radians round signum sin sinh sqrt tan tanh factorial mod sign")
renamed(ceiling="ceil", random="rand")
templates("iszero", _1="({0} = 0)")
templates("log", _1="log10({0})", _2="log({0}, {1})")
templates("square", _1="(({0}) * ({0}))")
templates("div0", _2="if({1} = 0, 0, {0} / nullif({1}, 0))")
templates("div0null", _2="if({1} = 0 OR {1} IS NULL, 0, {0} / nullif({1}, 0))")
# Numbers are cut towards zero; dates go to a part of them. Rounding is exact on
# decimals and on the shortest digits of a double, so what it has added is taken off.
_TRUNC = "if(abs(round({0}, {1})) > abs({0}), round(round({0}, {1}) - if({0} < 0, -{step}, {step}), {1}), round({0}, {1}))"
_TRUNC_ANY = "(sign({0}) * floor(abs({0}) * power(10, {1})) / power(10, {1}))"


def _trunc(args: list[str]) -> str:
    if len(args) == 2 and args[1].strip()[:1] in "'\"":
        return f"date_trunc({args[1]}, {args[0]})"
    digits = args[1].replace(" ", "") if len(args) > 1 else "0"
    if not digits.removeprefix("-").isdigit():
        return _TRUNC_ANY.replace("{0}", args[0]).replace("{1}", digits)
    n = int(digits)
    step = f"0.{'0' * (n - 1)}1BD" if n > 0 else "1" + "0" * -n
    return _TRUNC.replace("{0}", f"({args[0]})").replace("{1}", str(n)).replace("{step}", step)


register("trunc truncate", _trunc)
# Euclid's steps on a pair; 64-bit numbers need 93 at most.
_GCD = "aggregate(sequence(1, 93), named_struct('a', abs(cast({0} as bigint)), 'b', abs(cast({1} as bigint))), (s, i) -> if(s.b = 0, s, named_struct('a', s.b, 'b', s.a % nullif(s.b, 0))), s -> s.a)"
templates("gcd", _2=_GCD)
templates("lcm", _2=f"coalesce(abs(cast({{0}} as bigint) div nullif({_GCD}, 0) * cast({{1}} as bigint)), if({{0}} IS NULL OR {{1}} IS NULL, NULL, 0L))")
templates("width_bucket", _4="width_bucket({all})")
