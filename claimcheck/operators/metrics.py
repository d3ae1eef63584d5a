"""Rates of verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verdict_metrics(found: DataFrame, *keys: str) -> DataFrame:
    """Counts and rates of verdicts, by the key columns if there are any; all zero where there are no claims."""
    status = F.col("status")
    counts = (
        F.count("*").alias("total_claims"), F.count_if(status == "VALID").alias("valid_claims"), F.count_if(status.contains("HALLUCINATION")).alias("hallucinations"), F.count_if(status == "UNVERIFIED").alias("unverified"),
    )
    sums = found.groupBy(*keys).agg(*counts) if keys else found.agg(*counts)

    def rate(part: str):
        return F.round(F.coalesce(F.try_divide(F.col(part), F.col("total_claims")), F.lit(0.0)), 4)

    return sums.withColumn("hallucination_rate", rate("hallucinations")).withColumn("insight_validity_score", rate("valid_claims"))


def status_distribution(found: DataFrame) -> DataFrame:
    return found.groupBy("status").agg(F.count("*").alias("n"))


def confidence_by_status(found: DataFrame) -> DataFrame:
    """Five-number summary of the claims' confidence by status; confidences are few values, so that this stays small."""
    q = F.percentile("confidence_score", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    sums = found.groupBy("status").agg(F.min("confidence_score").alias("min"), q.alias("q"), F.max("confidence_score").alias("max"))
    return sums.select("status", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")
