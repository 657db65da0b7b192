"""Aggregate and window functions. What follows the call (OVER, WITHIN GROUP,
FILTER) stays where it is, so an aggregate's text must end in the call itself
unless it can't be a window function."""

from tarn.functions.registry import register, renamed, same, templates

same("any_value avg bit_and bit_or bit_xor bool_and bool_or corr covar_pop covar_samp first_value last_value grouping_id max median min nth_value percentile_cont percentile_disc regr_avgx regr_avgy regr_count regr_intercept regr_r2 regr_slope regr_sxx regr_sxy regr_syy stddev_pop stddev_samp sum var_pop var_samp mode kurtosis skewness")
same("cume_dist dense_rank lag lead ntile percent_rank rank row_number")
renamed(approx_distinct="approx_count_distinct", covar="covar_samp", mean="avg", stddev="stddev_samp", var="var_samp", variance="var_samp", var_sample="var_samp", var_population="var_pop", variance_pop="var_pop", variance_samp="var_samp", approx_count_distinct="approx_count_distinct")
templates("count", _n="count({all})")
# One column is Spark's grouping(); several are numbered together.
templates("grouping", _1="cast(grouping({0}) as bigint)", _n="grouping_id({all})")
templates("approx_median", _1="approx_percentile({0}, 0.5)")
templates("approx_percentile_cont", _2="approx_percentile({0}, {1})", _3="approx_percentile({0}, {1}, {2})")
templates("approx_percentile_cont_with_weight", _3="percentile({0}, {2}, cast({1} as int))")
templates("booland_agg", _1="bool_and(cast({0} as boolean))")
templates("boolor_agg", _1="bool_or(cast({0} as boolean))")
templates("boolxor_agg", _1="if(count({0}) = 0, NULL, count_if(cast({0} as boolean)) = 1)")
templates("conditional_true_event", _1="count_if({0})")
# JSON text of the values that aren't null; a text in place of a JSON value is quoted.
templates("array_agg", _1="to_json(collect_list({0}))", _n="to_json(collect_list({all}))")
templates("array_unique_agg", _1="to_json(array_sort(collect_set({0})))")
_FRAGMENTS = "transform(cast(parse_json({0}) as array<variant>), v -> to_json(v))"
templates("array_union_agg", _1=f"concat('[', array_join(array_distinct(flatten(collect_list({_FRAGMENTS}))), ','), ']')")
templates("object_agg", _2="to_json(map_from_entries(collect_list(if({0} IS NULL OR {1} IS NULL, NULL, struct({0}, {1})))))")

#: Aggregates that hold values, counts of values or a sketch for each group.
LARGE = frozenset("approx_distinct approx_count_distinct approx_median approx_percentile_cont approx_percentile_cont_with_weight array_agg array_union_agg array_unique_agg listagg median mode object_agg percentile_cont percentile_disc string_agg".split())
#: All aggregates of the dialect.
AGGREGATES = LARGE | frozenset("any_value avg bit_and bit_or bit_xor bool_and bool_or booland_agg boolor_agg boolxor_agg corr count covar covar_pop covar_samp first_value kurtosis last_value max mean min regr_avgx regr_avgy regr_count regr_intercept regr_r2 regr_slope regr_sxx regr_sxy regr_syy skewness stddev stddev_pop stddev_samp sum var_pop var_population var_samp var_sample variance variance_pop variance_samp".split())


def _listagg(args: list[str]) -> str:
    """Handled together with what follows it, see dialect/rewrite.py."""
    first, rest = args[0], args[1:]
    distinct = "DISTINCT " if first[:9].upper() == "DISTINCT " else ""
    value = first[9:] if distinct else first
    return f"listagg({distinct}cast({value} as string), {rest[0] if rest else chr(39) * 2})"


register("listagg string_agg", _listagg)
