"""Cleaning and scaling of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimcheck.functions.columns import categorical_columns, free_name, numeric_columns, quoted, stripped, without_nan
from claimcheck.operators.codes import with_codes
from claimcheck.operators.profile import impute_constants
from claimcheck.sources.scratch import Scratch, saved


def _replaced(df: DataFrame, names: list[str], new: dict[str, Column]) -> DataFrame:
    """The columns ``names`` of ``df``, those in ``new`` replaced."""
    return df.select(*[new[c].alias(c) if c in new else quoted(c) for c in names])


def _one_row(df: DataFrame, row: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(row))  # an aggregate without keys: one row


def dedup_rows(df: DataFrame) -> DataFrame:
    """Each row once."""
    return df.dropDuplicates()


def impute_median_mode(df: DataFrame) -> DataFrame:
    """Missing numbers become the median, other missing values the mode, or "Unknown" where there is none."""
    df = without_nan(df)
    numbers = numeric_columns(df)
    others = [c for c in categorical_columns(df)]
    found = impute_constants(df, numbers + others)
    cells = [F.max(F.when(F.col("column") == c, F.col("number" if c in numbers else "text"))).alias(f"_c{i}") for i, c in enumerate(numbers + others)]
    kinds = dict(df.dtypes)
    new = {}
    for i, c in enumerate(numbers + others):
        if c in numbers:
            new[c] = F.coalesce(quoted(c).cast("double"), F.col(f"_c{i}")) if kinds[c] in ("double", "float") else F.coalesce(quoted(c), F.col(f"_c{i}"))
        else:
            new[c] = F.coalesce(quoted(c), F.col(f"_c{i}").cast(kinds[c])) if kinds[c] == "boolean" else F.coalesce(quoted(c), F.col(f"_c{i}"), F.lit("Unknown"))
    return _replaced(_one_row(df, found.agg(*cells)), df.columns, new) if new else df


def impute_mean(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing numbers become the mean."""
    df = without_nan(df)
    columns = columns or numeric_columns(df)
    means = df.agg(*[F.avg(quoted(c)).alias(f"_m{i}") for i, c in enumerate(columns)])
    return _replaced(_one_row(df, means), df.columns, {c: F.coalesce(quoted(c).cast("double"), F.col(f"_m{i}")) for i, c in enumerate(columns)})


def normalize_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Texts without white space at their ends, in lower case."""
    columns = columns or categorical_columns(df, booleans=False)
    return _replaced(df, df.columns, {c: F.lower(stripped(quoted(c).cast("string"))) for c in columns})


def scale(df: DataFrame, mode: str = "standard", columns: list[str] | None = None) -> DataFrame:
    """Numbers less their mean over their population deviation ("standard"), or from 0 to 1 (any other mode).

    A constant column becomes zero either way.
    """
    columns = columns or numeric_columns(df)
    base, spread = (F.avg, F.stddev_pop) if mode == "standard" else (F.min, lambda x: F.max(x) - F.min(x))
    sums = df.agg(*[f(quoted(c).cast("double")).alias(f"_{n}{i}") for i, c in enumerate(columns) for n, f in (("b", base), ("s", spread))])
    return _replaced(_one_row(df, sums), df.columns, {c: (quoted(c) - F.col(f"_b{i}")) / F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(1.0) for i, c in enumerate(columns)})


def clean_table(df: DataFrame, mode: str = "standard") -> DataFrame:
    """Rows once each, nothing missing, texts normalised, numbers scaled, in this order.

    The rows that stay are written once, to the shared folder; what is missing is counted on these.
    """
    numbers = numeric_columns(df)
    rows = saved(dedup_rows(df), "rows")
    return scale(normalize_text(impute_median_mode(rows)), mode, numbers)


def label_encode(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Texts replaced by their place among the sorted different values; missing counts as "nan".

    Any number of values: they are numbered by ranges, all columns at once, and come back by row.
    """
    columns = columns or categorical_columns(df)
    if not columns:
        return df
    row = free_name(df, "_row")
    with Scratch(df.sparkSession) as scratch:
        rows = saved(df.withColumn(row, F.monotonically_increasing_id()), "rows")
        codes = saved(with_codes(rows, {c: F.coalesce(quoted(c).cast("string"), F.lit("nan")) for c in columns}, scratch, row), "codes")
    found = rows.join(codes.withColumnRenamed("row", row), row)
    return found.select(*[codes[f"c{columns.index(c)}"].alias(c) if c in columns else rows["`" + c.replace("`", "``") + "`"] for c in df.columns])
