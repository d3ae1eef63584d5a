"""Verdicts on claims, from the profile and the truth table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimcheck.config import DEFAULTS, Thresholds
from claimcheck.operators.claims import claim_numbers

FOUND = "kind string, var1 string, var2 string, strength string, direction string"


def number_text(x: Column) -> Column:
    """A number as Python prints it: at least one decimal, no exponent for whole numbers."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e16)
    return F.when(whole, F.concat(x.cast("decimal(20,0)").cast("string"), F.lit(".0"))).otherwise(x.cast("string"))


def truth_lookup(subjects: DataFrame, truth: DataFrame) -> DataFrame:
    """``subjects`` with ``truth``: the first finding, by priority, on the unordered pair (var1, var2); null if none."""
    key = F.struct(F.least("var1", "var2").alias("a"), F.greatest("var1", "var2").alias("b"))
    best = truth.groupBy(key.alias("pair")).agg(F.min_by(F.struct("kind", "var1", "var2", "strength", "direction"), "priority").alias("truth"))
    best = best.select(F.col("pair.a").alias("_a"), F.col("pair.b").alias("_b"), "truth")
    found = subjects.withColumn("_a", F.when(F.size("extracted_vars") >= 2, F.least("var1", "var2"))).withColumn("_b", F.greatest("var1", "var2"))
    return found.join(best, ["_a", "_b"], "left").drop("_a", "_b")


def _close(x: Column, stat: Column, t: Thresholds) -> Column:
    """Within the relative error; never true of a statistic that is missing or zero."""
    return F.coalesce((stat != 0) & (F.abs(x - stat) / (F.abs(stat) + 0.001) < t.relative_error), F.lit(False))


def _near(numbers: Column, stat: Column, t: Thresholds) -> Column:
    return F.filter(numbers, lambda x: _close(x, stat, t))


def _any(text: Column, words: list[str]) -> Column:
    found = text.contains(words[0])
    for w in words[1:]:
        found = found | text.contains(w)
    return found


def metadata_reason(text: Column, numbers: Column, count: Column, t: Thresholds = DEFAULTS) -> Column:
    """Reason of a valid sample-size claim; null if the claim isn't valid."""
    near = F.filter(numbers, lambda x: F.abs(x - count) < t.sample_size_error)
    return F.when(F.size(near) > 0, F.concat(F.lit("Valid sample size (approx "), F.get(near, F.lit(0)).cast("bigint").cast("string"), F.lit(")")))


def descriptive_reason(text: Column, numbers: Column, name: Column, stats: dict[str, Column], t: Thresholds = DEFAULTS) -> Column:
    """Reason of a valid claim about one column's mean, range, spread or median; null if none holds."""
    low = F.lower(text)
    near = {k: _near(numbers, s, t) for k, s in stats.items()}
    has = {k: F.size(x) > 0 for k, x in near.items()}
    mean = _any(low, ["mean", "average", "centered around", "typical"]) & has["mean"]
    ranged = _any(low, ["range", "vary", "variability", "outlier", "minimum", "maximum"])
    outlier = low.contains("outlier")
    # numbers are tried in text order, each against the minimum before the maximum
    at_min, at_max = outlier | low.contains("minimum"), outlier | low.contains("maximum")
    marked = F.filter(numbers, lambda x: (at_min & _close(x, stats["min"], t)) | (at_max & _close(x, stats["max"], t)))
    first = F.get(marked, F.lit(0))
    end = F.when(at_min & _close(first, stats["min"], t), "Minimum").otherwise("Maximum")
    median = _any(low, ["median", "50%", "middle"]) & has["p50"]
    return (
        F.when(mean, F.concat(F.lit("Mean/Center of "), name, F.lit(" is approx "), number_text(F.get(near["mean"], F.lit(0)))))
        .when(ranged & (F.size(marked) > 0), F.concat(end, F.lit("/Outlier "), number_text(first), F.lit(" for "), name, F.lit(" verified")))
        .when(ranged & (has["min"] | has["max"]), F.concat(F.lit("Range/Limits for "), name, F.lit(" verified")))
        .when(ranged & has["std"], F.concat(F.lit("Standard deviation for "), name, F.lit(" verified")))
        .when(median, F.concat(F.lit("Median "), name, F.lit(" verified")))
    )


def with_profile(subjects: DataFrame, profile: DataFrame, first_column: str | None) -> DataFrame:
    """``subjects`` with ``stats`` of their single column, and ``row_count`` of the first summarised one."""
    row = profile.select(F.col("column").alias("_column"), F.struct("mean", "std", "min", "p50", "max").alias("stats"))
    counts = profile.where(F.col("column") == first_column).select(F.col("count").alias("row_count"))
    single = F.when(F.size("extracted_vars") == 1, F.col("var1"))
    found = subjects.withColumn("_column", single).join(row, "_column", "left").drop("_column")
    return found.join(F.broadcast(counts), F.lit(True), "left")  # one row


def verdicts(subjects: DataFrame, truth: DataFrame, profile: DataFrame, first_column: str | None, check_strength: bool = False, directional_kinds: tuple[str, ...] | None = None, t: Thresholds = DEFAULTS) -> DataFrame:
    """``subjects`` with status, reason and ground_truth; the first rule that decides wins.

    ``first_column`` is the column whose count is the sample size. With ``check_strength`` a claim whose
    strength isn't the finding's is HALLUCINATION_STRENGTH. With ``directional_kinds`` directions are
    compared on findings of these kinds only.
    """
    rows = with_profile(truth_lookup(subjects, truth), profile, first_column)
    text, low, n_vars = F.col("original_text"), F.lower("original_text"), F.size("extracted_vars")
    rows = rows.withColumn("_numbers", claim_numbers(text))
    numbers = F.col("_numbers")
    stats = {k: F.col(f"stats.{k}") for k in ("mean", "std", "min", "p50", "max")}
    sized = metadata_reason(text, numbers, F.col("row_count"), t)
    described = descriptive_reason(text, numbers, F.col("var1"), stats, t)
    claimed, actual = F.col("direction"), F.col("truth.direction")
    compared = F.lit(True) if directional_kinds is None else F.col("truth.kind").isin(*directional_kinds)
    wrong_way = compared & (claimed != "unknown") & (claimed != actual)
    wrong_size = F.lit(check_strength) & (F.col("strength") != "unknown") & (F.col("strength") != F.col("truth.strength"))

    def decided(status: str, reason: Column | str, truth: bool = False) -> Column:
        return F.struct(F.lit(status).alias("status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), F.lit(truth).alias("shown"))

    too_few = decided("UNVERIFIED", "Not enough variables found")
    is_sized = low.contains("sample size") | low.contains("n=")
    decision = (
        F.when(text.isNull() | (text == ""), decided("UNVERIFIED", "No text found in claim"))
        .when(is_sized & (F.size(numbers) == 0), too_few)
        .when(is_sized & sized.isNotNull(), decided("VALID", sized))
        .when(is_sized, decided("UNVERIFIED", "Could not verify sample size against ground truth"))
        .when((n_vars == 1) & described.isNotNull(), decided("VALID", described))
        .when(n_vars < 2, too_few)
        .when(F.col("truth").isNull(), decided("HALLUCINATION_RELATIONSHIP", F.concat(F.lit("No statistical relationship found between "), F.col("var1"), F.lit(" and "), F.col("var2"))))
        .when(wrong_way, decided("HALLUCINATION_DIRECTION", F.concat(F.lit("Claimed "), claimed, F.lit(", but actually "), actual), True))
        .when(wrong_size, decided("HALLUCINATION_STRENGTH", F.concat(F.lit("Claimed "), F.col("strength"), F.lit(", but actually "), F.col("truth.strength")), True))
        .otherwise(decided("VALID", "Relationship confirmed by statistics", True))
    )
    rows = rows.withColumn("_decision", decision)
    shown = F.when(F.col("_decision.shown"), F.col("truth"))
    return rows.withColumns({"status": F.col("_decision.status"), "reason": F.col("_decision.reason"), "ground_truth": shown}).drop("_decision", "_numbers", "truth", "stats", "row_count", "mentions")


def by_filter(found: DataFrame, filters: list[str]) -> DataFrame:
    """Verdicts whose status has any of the filters in it; no filter keeps all."""
    return found.where(_any(F.col("status"), filters)) if filters else found
