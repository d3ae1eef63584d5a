"""Summaries of tables as tables: statistics, value counts, missing values, histograms, outliers.

Exact quantiles are selected in rounds. A round reads the table once for all columns and quantiles that are
still open: it counts the values below and inside each one's range and takes a few hundred approximate
quantiles of those inside, between two of which the sought value lies. Ranges shrink to a hundredth a round,
and once one has few different values these are counted and looked up. No column is sorted or held in one task.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimcheck.functions.columns import categorical_columns, long_numbers, long_texts, numeric_columns, quoted

QUARTILES = (0.25, 0.5, 0.75)
#: Accuracy of approximate quantiles; approximate quantiles of a round; different values (by estimate) that are looked up.
ACCURACY, STEPS, FEW = 10_000, 400, 16_384


def _number(column: str) -> Column:
    value = quoted(column).cast("double")
    return F.when(~F.isnan(value), value)


def approximate_quantiles(df: DataFrame, columns: list[str], at: tuple[float, ...] = QUARTILES, accuracy: int = ACCURACY) -> DataFrame:
    """(column, q0, q1, ...) in one pass: values whose rank is off by one in ``accuracy`` of the rows at most, not interpolated."""
    found = df.agg(*[F.percentile_approx(_number(c), list(at), accuracy).alias(f"q{i}") for i, c in enumerate(columns)])
    cells = [F.struct(F.lit(c).alias("column"), *[F.col(f"q{i}")[k].alias(f"q{k}") for k in range(len(at))]) for i, c in enumerate(columns)]
    return found.select(F.inline(F.array(*cells))).where("q0 IS NOT NULL")


#: A column's values between two others (None: no end); neither is inside.
Range = tuple[str, float | None, float | None]


def _inside(of: Range) -> Column:
    column, low, high = of
    value, ends = _number(column), [_number(column) > low] * (low is not None) + [_number(column) < high] * (high is not None)
    return F.when(reduce(Column.__and__, ends), value) if ends else value


def _counted(df: DataFrame, ranges: list[Range]) -> dict[Range, tuple[int, int, int, list[float]]]:
    """Rows up to each range's low end, rows inside, different values inside (by estimate), and approximate quantiles, from one job."""
    # the shares as one text: hundreds of literals for each range would take longer to plan than the job
    steps, parts = F.split(F.lit(" ".join(str((i + 1) / (STEPS + 1)) for i in range(STEPS))), " ").cast("array<double>"), []
    for i, of in enumerate(ranges):
        below = F.lit(0).cast("long") if of[1] is None else F.count_if(_number(of[0]) <= of[1])
        parts.append(F.struct(below, F.count(_inside(of)), F.approx_count_distinct(_inside(of)), F.percentile_approx(_inside(of), steps, 10 * STEPS)).alias(f"r{i}"))
    return {of: tuple(found) for of, found in zip(ranges, df.agg(*parts).first())} if ranges else {}


def _narrowed(of: Range, place: int, rows: int, steps: list[float]) -> Range:
    """A smaller range for the value at ``place`` of the ``rows`` inside; approximate quantiles are off by a tenth of a step at most."""
    column, low, high = of
    at = place / rows * (STEPS + 1)
    first, last = math.floor(at) - 2, math.ceil(at + (STEPS + 1) / rows)
    return column, steps[first] if first >= 0 else low, steps[last] if last < STEPS else high


def _looked_up(df: DataFrame, wanted: dict[Range, list[int]]) -> dict[tuple[Range, int], float]:
    """The values at the places ``wanted`` inside ranges of few different values."""
    if not wanted:
        return {}
    ranges = list(wanted)
    cells = F.array(*[F.struct(F.lit(i).alias("number"), _inside(of).alias("value")) for i, of in enumerate(ranges)])
    counts = df.select(F.inline(cells)).where("value IS NOT NULL").groupBy("number", "value").agg(F.count("*").alias("n"))
    values = counts.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("value", "n"))).alias("values"))
    # The estimate is off by a few percent; far more would mean that one row gets too large.
    values = values.where(F.assert_true(F.size("values") <= 4 * FEW).isNull())
    places = F.get(F.array(*[F.array(*[F.lit(p).cast("long") for p in own]) for own in wanted.values()]), F.col("number"))

    def at(place: Column) -> Column:
        step = lambda so, x: F.struct((so.before + x.n).alias("before"), F.when((so.before <= place) & (place < so.before + x.n), x.value).otherwise(so.value).alias("value"))
        return F.aggregate("values", F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("double").alias("value")), step, lambda so: so.value)

    found = values.select("number", F.transform(places, at).alias("found")).collect()
    return {(ranges[r.number], p): v for r in found for p, v in zip(wanted[ranges[r.number]], r.found)}


def quantiles(df: DataFrame, columns: list[str], at: tuple[float, ...] = QUARTILES) -> DataFrame:
    """(column, q0, q1, ...): exact quantiles with linear interpolation between neighbours.

    Runs a few jobs at once, each over all columns, and returns their numbers as a table.
    """
    whole = {c: (c, None, None) for c in columns}
    found = _counted(df, list(whole.values()))
    totals = {c: found[of][1] for c, of in whole.items() if found[of][1]}
    # Values by column and place in its order; of each place that is sought, its range.
    values: dict[tuple[str, int], float] = {}
    open_ = {(c, round_((n - 1) * q)): whole[c] for c, n in totals.items() for q in at for round_ in (math.floor, math.ceil)}
    few: dict[Range, list[int]] = {}
    asked = {}
    while open_:
        still = {}
        for (c, place), of in open_.items():
            below, rows, different, steps = found[of]
            if place < below:
                values[c, place] = of[1]
            elif place >= below + rows:
                values[c, place] = of[2]
            elif min(rows, different) <= FEW:
                few.setdefault(of, []).append(place - below)
                asked[c, place] = of, place - below
            else:
                still[c, place] = _narrowed(of, place - below, rows, steps)
        found = _counted(df, list(dict.fromkeys(still.values())))
        open_ = still
    looked_up = _looked_up(df, few)
    values |= {key: looked_up[x] for key, x in asked.items()}
    result = []
    for c, n in totals.items():
        ends = [((n - 1) * q, values[c, math.floor((n - 1) * q)], values[c, math.ceil((n - 1) * q)]) for q in at]
        result.append((c, *(low + (high - low) * (place - math.floor(place)) if high != low else low for place, low, high in ends)))
    return df.sparkSession.createDataFrame(result, "column string, " + ", ".join(f"q{i} double" for i in range(len(at))))


def profile_numeric(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """(column, count, mean, std, min, p25, p50, p75, max) of the numeric columns; NaN counts as missing.

    With ``approximate`` the quartiles are ``approximate_quantiles``, in one pass.
    """
    columns = numeric_columns(df) if columns is None else columns
    basic = long_numbers(df, columns).groupBy("column").agg(F.count("*").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    quart = (approximate_quantiles if approximate else quantiles)(df, columns).toDF("column", "p25", "p50", "p75")
    return basic.join(quart, "column").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, n) of the text columns."""
    columns = categorical_columns(df, booleans=False) if columns is None else columns
    return long_texts(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))


def profile_all(df: DataFrame) -> DataFrame:
    """The numeric summary and, for text columns, count, unique, top and freq (ties: the smallest value)."""
    texts = value_counts(df, categorical_columns(df))
    top = F.min_by("value", F.struct(-F.col("n"), F.col("value")))
    texts = texts.groupBy("column").agg(F.sum("n").alias("count"), F.count("*").alias("unique"), top.alias("top"), F.max("n").alias("freq"))
    return profile_numeric(df).unionByName(texts, allowMissingColumns=True)


def missing_values(df: DataFrame) -> DataFrame:
    """(column, dtype, n_rows, n_missing) of all columns, in one pass."""
    kinds = dict(df.dtypes)
    missing = {c: quoted(c).isNull() | F.isnan(quoted(c)) if kinds[c] in ("float", "double") else quoted(c).isNull() for c in df.columns}
    counts = df.agg(F.count("*").alias("rows"), *[F.count_if(m).alias(f"m{i}") for i, m in enumerate(missing.values())])
    cells = [F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"), F.col("rows").alias("n_rows"), F.col(f"m{i}").alias("n_missing")) for i, c in enumerate(df.columns)]
    return counts.select(F.inline(F.array(*cells)))


def first_rows(df: DataFrame, order: list[str] | None = None, rows: int = 3) -> DataFrame:
    """The first ``rows`` rows by the columns ``order``, or as they are read: what a summary of a table shows."""
    return (df.orderBy(*[quoted(c) for c in order]) if order else df).limit(rows)


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, n): rows in ``bins`` ranges of even width; the last one includes the largest value."""
    value = quoted(column).cast("double")
    rows = df.select(value.alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    ends = rows.agg(F.min("value").alias("least"), F.max("value").alias("most"))
    width = (F.col("most") - F.col("least")) / bins
    number = F.when(F.col("most") == F.col("least"), 0).otherwise(F.least(F.floor((F.col("value") - F.col("least")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))
    counted = rows.crossJoin(F.broadcast(ends)).groupBy(number.cast("int").alias("bin"), "least", "most").agg(F.count("*").alias("n"))  # the ends are one row
    return counted.select("bin", (F.col("least") + width * F.col("bin")).alias("low"), (F.col("least") + width * (F.col("bin") + 1)).alias("high"), "n")


def box_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, min, p25, p50, p75, max, low_fence, high_fence): what a box plot shows."""
    found = profile_numeric(df, columns)
    reach = 1.5 * (F.col("p75") - F.col("p25"))
    return found.select("column", "min", "p25", "p50", "p75", "max", (F.col("p25") - reach).alias("low_fence"), (F.col("p75") + reach).alias("high_fence"))


def outliers_zscore(df: DataFrame, column: str, most: float = 3.0) -> DataFrame:
    """Rows whose value is over ``most`` sample standard deviations from the mean, with ``zscore``."""
    stats = df.agg(F.avg(quoted(column)).alias("_mean"), F.stddev_samp(quoted(column)).alias("_std"))
    scored = df.crossJoin(F.broadcast(stats)).withColumn("zscore", F.try_divide(quoted(column) - F.col("_mean"), F.col("_std")))  # one row
    return scored.where(F.abs("zscore") > most).drop("_mean", "_std")


def outliers_iqr(df: DataFrame, column: str) -> DataFrame:
    """Rows outside the fences of the box plot."""
    fences = box_stats(df, [column]).select(F.col("low_fence").alias("_low"), F.col("high_fence").alias("_high"))
    return df.crossJoin(F.broadcast(fences)).where((quoted(column) < F.col("_low")) | (quoted(column) > F.col("_high"))).drop("_low", "_high")  # one row


def impute_constants(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, kind, number, text): the median of numeric columns, the mode of others (ties: the smallest)."""
    columns = df.columns if columns is None else columns
    numbers = [c for c in numeric_columns(df) if c in columns]
    texts = [c for c in columns if c not in numbers]
    medians = quantiles(df, numbers, (0.5,)).select("column", F.lit("median").alias("kind"), F.col("q0").alias("number"), F.lit(None).cast("string").alias("text"))
    if not texts:
        return medians
    modes = value_counts(df, texts).groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("text"))
    return medians.unionByName(modes.select("column", F.lit("mode").alias("kind"), F.lit(None).cast("double").alias("number"), "text"))
