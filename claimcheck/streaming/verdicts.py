"""Verdicts on a stream of texts, against a table that stands still."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimcheck.operators.claims import claims_parse
from claimcheck.operators.mentions import mentions, subjects
from claimcheck.operators.verdicts import verdicts


def stream_verdicts(texts: DataFrame, truth: DataFrame, profile: DataFrame, columns: list[str], first_column: str | None, fuzzy: str | None = None) -> DataFrame:
    """Verdicts on the claims of a streaming DataFrame (source_id, text); no state is kept.

    ``truth`` and ``profile`` are tables at rest and small: written once, they are read for each batch.
    """
    return verdicts(subjects(mentions(claims_parse(texts), columns, fuzzy)), truth, profile, first_column)


def windowed_metrics(found: DataFrame, time: str, window: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts of verdicts by tumbling window; late ones count until the watermark has passed their window."""
    status = F.col("status")
    counts = found.withWatermark(time, delay).groupBy(F.window(time, window).alias("window"))
    return counts.agg(F.count("*").alias("total_claims"), F.count_if(status == "VALID").alias("valid_claims"), F.count_if(status.contains("HALLUCINATION")).alias("hallucinations"), F.count_if(status == "UNVERIFIED").alias("unverified"))
