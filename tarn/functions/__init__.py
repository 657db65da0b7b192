"""Function library: dialect functions as Spark expressions."""

from tarn.functions.registry import FUNCTIONS, ArgumentError, call, load

load()

__all__ = ["FUNCTIONS", "ArgumentError", "call"]
