"""Prompts for a batch inference job: one for each slice of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimcheck.functions.columns import quoted

HEAD = "You are a data analyst. State numbered insights that the statistics below support.\n"


def prompt_table(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(slice, n_rows, prompt): statistics of the numeric ``columns`` in each level of ``by``, as text."""
    parts = []
    for i, c in enumerate(columns):
        parts += [F.avg(quoted(c)).alias(f"a{i}"), F.min(quoted(c)).alias(f"l{i}"), F.max(quoted(c)).alias(f"h{i}")]
    sums = df.groupBy(quoted(by).alias("slice")).agg(F.count("*").alias("n_rows"), *parts)
    lines = [F.format_string(f"- {c}: mean %.2f, min %.2f, max %.2f".replace("%%", "%"), F.col(f"a{i}").cast("double"), F.col(f"l{i}").cast("double"), F.col(f"h{i}").cast("double")) for i, c in enumerate(columns)]
    head = F.concat(F.lit(HEAD), F.lit(f"Slice: {by} = "), F.col("slice"), F.lit(", rows: "), F.col("n_rows").cast("string"))
    return sums.select("slice", "n_rows", F.concat_ws("\n", head, *lines).alias("prompt"))
