"""Reports on verdicts: JSON rows and Markdown lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def report_json(found: DataFrame, metrics: DataFrame, dataset: str, model: str, timestamp: str) -> DataFrame:
    """(section, source_id, ordinal, body): the report as rows, one for the metadata and metrics and one a claim.

    Rows can be written as JSON lines of any number; nothing gathers them in one value.
    """
    meta = F.struct(F.lit(dataset).alias("dataset"), F.lit(model).alias("model"), F.lit(timestamp).alias("timestamp"))
    head = metrics.select(F.lit("summary").alias("section"), F.lit(None).cast("long").alias("source_id"), F.lit(None).cast("int").alias("ordinal"), F.to_json(F.struct(meta.alias("metadata"), F.struct(*metrics.columns).alias("metrics"))).alias("body"))
    claim = F.struct("original_text", "relationship", "direction", "strength", "confidence_score", "type")
    body = F.to_json(F.struct(claim.alias("claim"), "extracted_vars", "status", "reason", "ground_truth"))
    return head.unionByName(found.select(F.lit("detail").alias("section"), "source_id", "ordinal", body.alias("body")))


def report_markdown(found: DataFrame, metrics: DataFrame, dataset: str, model: str, timestamp: str) -> DataFrame:
    """(source_id, ordinal, line_no, line): the head under source -1, and one block a claim.

    A claim's number counts within its source.
    """
    percent = lambda c: F.format_string("%.2f%%", F.col(c) * 100)
    head = F.array(
        F.lit("# Hallucination Analysis Report"), F.lit(f"**Dataset:** {dataset}"), F.lit(f"**Model:** {model}"), F.lit(f"**Date:** {timestamp}"), F.lit(""), F.lit("## Executive Summary"),
        F.concat(F.lit("- **Total Claims:** "), F.col("total_claims").cast("string")), F.concat(F.lit("- **Valid Claims:** "), F.col("valid_claims").cast("string")), F.concat(F.lit("- **Hallucinations:** "), F.col("hallucinations").cast("string")),
        F.concat(F.lit("- **Hallucination Rate:** "), percent("hallucination_rate")), F.concat(F.lit("- **Insight Validity Score:** "), percent("insight_validity_score")), F.lit(""), F.lit("## Detailed Validation"),
    )
    top = metrics.select(F.lit(-1).cast("long").alias("source_id"), F.lit(-1).alias("ordinal"), F.posexplode(head).alias("line_no", "line"))
    icon = F.when(F.col("status") == "VALID", "✅").when(F.col("status").contains("HALLUCINATION"), "❌").otherwise("⚠️")
    number = F.row_number().over(Window.partitionBy("source_id").orderBy("ordinal"))
    g = F.col("ground_truth")
    truth = F.concat(F.lit("**Ground Truth:** "), g["var1"], F.lit(" vs "), g["var2"], F.lit(" ("), F.coalesce(g["strength"], F.lit("unknown")), F.lit(" "), F.coalesce(g["direction"], F.lit("unknown")), F.lit(")"))
    lines = F.array(F.lit(""), F.concat(F.lit("### "), F.col("_number").cast("string"), F.lit(". "), icon, F.lit(" "), F.col("status")), F.concat(F.lit('**Claim:** "'), F.col("original_text"), F.lit('"')), F.concat(F.lit("**Reason:** "), F.col("reason")), truth)
    body = found.withColumn("_number", number).select("source_id", "ordinal", F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("line_no", "line"))
    return top.unionByName(body)
