"""All significant relationships of a table as one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimcheck.config import DEFAULTS, Thresholds
from claimcheck.functions.columns import categorical_columns, numeric_columns
from claimcheck.operators.associate import association_findings
from claimcheck.operators.correlate import correlation_findings
from claimcheck.operators.groups import group_findings


def truth_table(df: DataFrame, numbers: list[str] | None = None, categories: list[str] | None = None, t: Thresholds = DEFAULTS) -> DataFrame:
    """(kind, priority, var1, var2, test, stat, dof1, dof2, n, p_value, effect, strength, direction, pearson, spearman).

    The means behind a group difference are in ``groups.group_details``. A table without numeric or without categorical columns has no findings of the kinds that need them.
    """
    numbers, categories = numbers or numeric_columns(df), categories or categorical_columns(df)
    none = F.lit(None)
    coefficients = "struct<r: double, p: double>"
    same = correlation_findings(df, numbers, t).select(
        F.lit("correlation").alias("kind"), F.lit(1).alias("priority"), "var1", "var2", F.lit("pearson").alias("test"), F.col("pearson.r").alias("stat"),
        (F.col("n") - 2).cast("double").alias("dof1"), none.cast("double").alias("dof2"), "n", F.col("pearson.p").alias("p_value"), "effect", "strength", "direction",
        F.col("pearson").cast(coefficients).alias("pearson"), F.col("spearman").cast(coefficients).alias("spearman"),
    )
    groups = group_findings(df, numbers, categories, t).select(
        F.lit("group_difference").alias("kind"), F.lit(2).alias("priority"), "var1", "var2", "test", "stat", "dof1", "dof2", "n", "p_value", none.cast("double").alias("effect"),
        "strength", "direction", none.cast(coefficients).alias("pearson"), none.cast(coefficients).alias("spearman"),
    )
    associated = association_findings(df, categories, t).select(
        F.lit("categorical_association").alias("kind"), F.lit(3).alias("priority"), "var1", "var2", F.lit("chi-square").alias("test"), "stat", F.col("dof").cast("double").alias("dof1"),
        none.cast("double").alias("dof2"), "n", "p_value", F.col("cramers_v").alias("effect"), "strength", "direction",
        none.cast(coefficients).alias("pearson"), none.cast(coefficients).alias("spearman"),
    )
    return same.unionByName(groups).unionByName(associated)


def top_findings(truth: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` findings with the largest effect (those without one last), ties by kind and columns."""
    return truth.orderBy(F.desc_nulls_last("effect"), "priority", "var1", "var2").limit(k)
