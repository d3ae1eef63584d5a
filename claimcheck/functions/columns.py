"""Which columns of a table are numbers and which are categories, and how to take them."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, NumericType, StringType

from claimcheck.config import DEFAULTS, Thresholds


#: Fixed value: white space as Unicode and Python's strip have it; Java's ``\\s`` is ASCII only.
WHITE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def stripped(text: Column) -> Column:
    """A text without white space at its ends."""
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def quoted(name: str) -> Column:
    """The column of that very name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a variation of it that no column of ``df`` has (column names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def categorical_columns(df: DataFrame, booleans: bool = True) -> list[str]:
    kinds = (StringType, BooleanType) if booleans else (StringType,)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def pairs(names: list[str]) -> list[tuple[str, str]]:
    """Each two of the names once, in their order."""
    return list(combinations(names, 2))


def without_nan(df: DataFrame) -> DataFrame:
    """NaN counts as missing: it becomes NULL."""
    return df.select(*[F.when(~F.isnan(quoted(f.name)), quoted(f.name)).alias(f.name) if isinstance(f.dataType, (FloatType, DoubleType)) else quoted(f.name) for f in df.schema])


def long_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value): one row for each number that isn't missing, in one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("double").alias("value")) for c in columns])
    return df.select(F.inline(cells)).where(F.col("value").isNotNull() & ~F.isnan("value"))


def long_texts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value): one row for each text that isn't missing."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells)).where(F.col("value").isNotNull())


def strength(effect: Column, t: Thresholds = DEFAULTS) -> Column:
    """Category of an effect size by its absolute value."""
    size = F.abs(effect)
    return F.when(size >= t.strong, "strong").when(size >= t.moderate, "moderate").when(size >= t.weak, "weak").otherwise("negligible")
