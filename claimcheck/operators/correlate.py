"""Pearson and Spearman correlation of all pairs of numeric columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimcheck.config import DEFAULTS, Thresholds
from claimcheck.functions.columns import numeric_columns, strength
from claimcheck.functions.distributions import t_p_value
from claimcheck.operators import comoments, ranks
from claimcheck.operators.ranks import average_ranks as average_ranks


def pearson(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(var1, var2, n, r) over the rows that have both values; pairs with a constant side are left out."""
    columns = columns or numeric_columns(df)
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "var1 string, var2 string, n long, r double")
    return comoments.correlation(comoments.comoments(df, columns), columns, "r")


def spearman(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(var1, var2, n, rho): Pearson on average ranks among the rows that have both values."""
    columns = columns or numeric_columns(df)
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "var1 string, var2 string, n long, rho double")
    return ranks.spearman(df, columns)


def _p(r: Column, n: Column) -> Column:
    dof = n - 2
    t = F.when(F.abs(r) >= 1, F.lit(float("inf"))).otherwise(r * F.sqrt(F.try_divide(dof, 1 - r * r)))
    return F.when(dof > 0, t_p_value(t, dof)).otherwise(F.lit(1.0))


def correlation_tests(df: DataFrame, columns: list[str] | None = None, t: Thresholds = DEFAULTS) -> DataFrame:
    """All pairs: var1, var2, n, pearson and spearman (struct<r, p>), effect, strength, direction.

    ``effect`` is the larger of the two coefficients by absolute value; the direction is Pearson's.
    """
    found = pearson(df, columns).join(spearman(df, columns).drop("n"), ["var1", "var2"])
    found = found.select("var1", "var2", "n", F.struct(F.col("r"), _p(F.col("r"), F.col("n")).alias("p")).alias("pearson"), F.struct(F.col("rho").alias("r"), _p(F.col("rho"), F.col("n")).alias("p")).alias("spearman"))
    effect = F.greatest(F.abs("pearson.r"), F.abs("spearman.r"))
    direction = F.when(F.col("pearson.r") > 0, "positive").otherwise("negative")
    return found.withColumn("effect", effect).withColumn("strength", strength(F.col("effect"), t)).withColumn("direction", direction)


def correlation_findings(df: DataFrame, columns: list[str] | None = None, t: Thresholds = DEFAULTS) -> DataFrame:
    """The pairs of which either test is significant and whose effect isn't negligible."""
    found = correlation_tests(df, columns, t)
    return found.where(((F.col("pearson.p") < t.significance) | (F.col("spearman.p") < t.significance)) & (F.col("strength") != "negligible"))


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(var1, var2, r) of all ordered pairs, each column with itself included."""
    columns = columns or numeric_columns(df)
    half = pearson(df, columns).select("var1", "var2", "r")
    own = df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "var1 string, var2 string, r double")
    return half.union(half.select("var2", "var1", "r")).union(own)
