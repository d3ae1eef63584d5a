"""Differences of numeric columns between the levels of categorical ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimcheck.config import DEFAULTS, Thresholds
from claimcheck.functions.columns import categorical_columns, numeric_columns, quoted, without_nan
from claimcheck.functions.distributions import f_p_value, t_p_value


def group_moments(df: DataFrame, numbers: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    """(var1, var2, level, n, mean, variance) of each numeric column in each level of each category.

    One aggregation over grouping sets: the table is read and dealt out once for all categories. Rows
    without a level, or without a value, don't count.
    """
    df = without_nan(df)
    numbers, categories = numbers or numeric_columns(df), categories or categorical_columns(df)
    if not numbers or not categories:
        return df.sparkSession.createDataFrame([], "var1 string, var2 string, level string, n long, mean double, variance double")
    rows = df.select(*[quoted(c).cast("string").alias(f"k{i}") for i, c in enumerate(categories)], *[quoted(c).cast("double").alias(f"v{i}") for i, c in enumerate(numbers)])
    keys = [f"k{i}" for i in range(len(categories))]
    parts = []
    for i in range(len(numbers)):
        parts += [F.count(f"v{i}").alias(f"n{i}"), F.avg(f"v{i}").alias(f"a{i}"), F.var_samp(f"v{i}").alias(f"s{i}")]
    sets = rows.groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys]).agg(F.grouping_id().alias("set"), *parts)
    level, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(categories):
        # the bit of a column is 0 where it is the one that is grouped by
        mine = F.col("set") == (1 << len(keys)) - 1 - (1 << (len(keys) - 1 - i))
        level, name = F.when(mine, F.col(f"k{i}")).otherwise(level), F.when(mine, F.lit(c)).otherwise(name)
    cells = F.array(*[F.struct(F.lit(c).alias("var1"), F.col(f"n{i}").alias("n"), F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("variance")) for i, c in enumerate(numbers)])
    long = sets.select(name.alias("var2"), level.alias("level"), F.inline(cells))
    return long.where(F.col("level").isNotNull() & (F.col("n") > 0)).select("var1", "var2", "level", "n", "mean", "variance")


def group_tests(moments: DataFrame) -> DataFrame:
    """(var1, var2, test, n_groups, n, stat, dof1, dof2, p_value, highest, lowest) of each pair.

    Levels with two rows or more are tested: Welch's t-test of two (in the order of the levels), analysis of
    variance of more. If nothing varies within the groups, means that differ give an infinite statistic and
    p-value zero, and equal means give none. The means of all levels, also of those with one row, are a
    table of their own (``group_details``): a pair may have as many as the table has rows.
    """
    usable = F.col("n") >= 2
    n, mean, variance = F.when(usable, F.col("n")), F.when(usable, F.col("mean")), F.when(usable, F.col("variance"))
    overall = moments.groupBy("var1", "var2").agg((F.sum(n * mean) / F.sum(n)).alias("grand"))
    moments = moments.join(overall, ["var1", "var2"])
    first, last = (f(F.when(usable, F.struct("level", "n", "mean", "variance"))) for f in (F.min, F.max))
    sums = moments.groupBy("var1", "var2").agg(
        F.count(n).alias("n_groups"), F.sum(n).alias("n"), F.sum((n - 1) * variance).alias("within"), F.sum(n * (mean - F.col("grand")) * (mean - F.col("grand"))).alias("between"),
        first.alias("a"), last.alias("b"),
        F.min_by("level", F.struct(-F.col("mean"), F.col("level"))).alias("highest"), F.min_by("level", F.struct("mean", "level")).alias("lowest"),
    ).where("n_groups >= 2")
    va, vb = F.col("a.variance") / F.col("a.n"), F.col("b.variance") / F.col("b.n")
    error, gap = va + vb, F.col("a.mean") - F.col("b.mean")
    infinite = F.lit(float("inf"))
    t = F.when(error > 0, gap / F.sqrt(F.when(error > 0, error))).when(gap != 0, F.signum(gap) * infinite)
    t_dof = F.coalesce(F.try_divide(error * error, va * va / (F.col("a.n") - 1) + vb * vb / (F.col("b.n") - 1)), (F.col("a.n") + F.col("b.n") - 2).cast("double"))
    two = F.col("n_groups") == 2
    dof1, dof2 = F.when(two, t_dof).otherwise((F.col("n_groups") - 1).cast("double")), F.when(~two, (F.col("n") - F.col("n_groups")).cast("double"))
    f = F.when(F.col("within") > 0, F.try_divide(F.col("between") / F.col("dof1"), F.col("within") / F.col("dof2"))).when(F.col("between") > 0, infinite)
    sums = sums.withColumn("dof1", dof1).withColumn("dof2", dof2).withColumn("stat", F.when(two, t).otherwise(f))
    p = F.when(two, t_p_value(F.col("stat"), F.col("dof1"))).otherwise(f_p_value(F.col("stat"), F.col("dof1"), F.col("dof2")))
    return sums.select("var1", "var2", F.when(two, "t-test").otherwise("ANOVA").alias("test"), "n_groups", "n", "stat", "dof1", "dof2", p.alias("p_value"), "highest", "lowest")


def group_findings(df: DataFrame, numbers: list[str] | None = None, categories: list[str] | None = None, t: Thresholds = DEFAULTS) -> DataFrame:
    """The significant tests, with strength ("significant" or "moderate") and direction ("<highest> > <lowest>")."""
    found = group_tests(group_moments(df, numbers, categories)).where(F.col("p_value") < t.significance)
    strength = F.when(F.col("p_value") < t.highly_significant, "significant").otherwise("moderate")
    return found.withColumn("strength", strength).withColumn("direction", F.concat_ws(" > ", "highest", "lowest"))


def group_details(findings: DataFrame, moments: DataFrame) -> DataFrame:
    """(var1, var2, level, n, mean): the means of all levels of the pairs in ``findings``, one row a level.

    ``findings`` are rows of ``group_tests``, ``group_findings`` or of a truth table; rows of pairs that the
    moments don't hold are passed over.
    """
    return moments.join(findings.select("var1", "var2").distinct(), ["var1", "var2"], "left_semi").select("var1", "var2", "level", "n", "mean")
