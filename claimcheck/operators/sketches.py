"""Profiles that can be kept by slice (a day, say) and merged later, without reading the tables again.

A state has exact counts, means, squares and ends of each column, a KLL sketch of its numbers and a HyperLogLog
sketch of its different values. Sketches have a size of their own, whatever the rows: merging a year of days
moves a few kilobytes for each day and column, and no text is shuffled.

Errors, of one slice as of any merge: a quantile's rank is off by 1.33 % of the rows at most in 99 of 100 cases
(``KLL`` = 200; about in proportion to 1 / KLL), and the number of different values by 1.04 / 2 ** (``HLL`` / 2)
in standard deviation, 0.8 % at 14.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimcheck.functions.columns import categorical_columns, numeric_columns, quoted

#: Sizes of the sketches of quantiles and of different values.
KLL, HLL = 200, 14

_STATE = ["n_rows", "n", "mean", "squares", "least", "most", "quantiles", "values"]


def profile_state(df: DataFrame, by: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """(*by, column, n_rows, n, mean, squares, least, most, quantiles, values) of numeric and text columns.

    One pass, a row for each slice and column; NaN counts as missing. Text columns have no numbers (null).
    A slice may be a third of the rows: all that is shuffled is its states, one a task.
    """
    by = by or []
    numbers = [c for c in columns or numeric_columns(df) if c in numeric_columns(df) and c not in by]
    texts = [c for c in columns or categorical_columns(df) if c in categorical_columns(df) and c not in by]
    parts, cells = [], []
    for i, c in enumerate([*numbers, *texts]):
        number = c in numbers
        value = quoted(c).cast("double") if number else quoted(c).cast("string")
        value = F.when(~F.isnan(value), value + F.lit(0.0)) if number else value  # -0.0 is 0.0
        own = {"n": F.count(value), "values": F.hll_sketch_agg(value if not number else value.cast("string"), HLL)}
        if number:
            own |= {"mean": F.avg(value), "squares": F.var_pop(value) * F.count(value), "least": F.min(value), "most": F.max(value), "quantiles": F.kll_sketch_agg_double(value, KLL)}
        parts += [x.alias(f"_{name}{i}") for name, x in own.items()]
        field = lambda name, kind, own=own, i=i: (F.col(f"_{name}{i}") if name in own else F.lit(None)).cast(kind).alias(name)
        cells.append(F.struct(F.lit(c).alias("column"), F.col("_rows").alias("n_rows"), field("n", "long"), *[field(x, "double") for x in _STATE[2:6]], field("quantiles", "binary"), field("values", "binary")))
    if not cells:
        raise ValueError("no numeric or text column")
    return df.groupBy(*map(quoted, by)).agg(F.count("*").alias("_rows"), *parts).select(*map(quoted, by), F.inline(F.array(*cells)))


def merge_states(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The states of larger slices (``by``; all rows without) from those of smaller ones, in the same form."""
    keys = [*(by or []), "column"]
    mine = Window.partitionBy(*map(quoted, keys))  # as many rows as slices
    n = F.col("n").cast("double")
    states = states.withColumn("_mean", F.try_divide(F.sum(n * F.col("mean")).over(mine), F.sum(F.when(F.col("mean").isNotNull(), n)).over(mine)))
    apart = n * (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean"))
    return states.groupBy(*map(quoted, keys)).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n").alias("n"), F.first("_mean").alias("mean"), (F.sum("squares") + F.sum(apart)).alias("squares"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.kll_merge_agg_double("quantiles", KLL).alias("quantiles"), F.hll_union_agg("values", True).alias("values"),
    )


def profile_from_states(states: DataFrame, at: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """What the states say: (slices, column, n_rows, n_missing, mean, std, min, p<at>, max, unique)."""
    std = F.sqrt(F.try_divide("squares", F.col("n") - 1))

    def quantile(q: float) -> Column:
        return F.when(F.col("least").isNotNull(), F.kll_sketch_get_quantile_double("quantiles", F.lit(q)))

    found = [quantile(q).alias(f"p{round(100 * q):d}" if round(100 * q, 6).is_integer() else f"p{100 * q:g}") for q in at]
    slices = [quoted(c) for c in states.columns if c not in (*_STATE, "column")]
    return states.select(*slices, "column", "n_rows", (F.col("n_rows") - F.col("n")).alias("n_missing"), "mean", std.alias("std"), F.col("least").alias("min"), *found, F.col("most").alias("max"), F.when(F.col("n") > 0, F.hll_sketch_estimate("values")).otherwise(0).alias("unique"))
