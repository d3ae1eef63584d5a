"""Writers of tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def write_json_report(report: DataFrame, path: str) -> None:
    """One JSON value a line: the summary, then the claims."""
    report.repartitionByRange(F.desc("section"), "source_id", "ordinal").sortWithinPartitions(F.desc("section"), "source_id", "ordinal").select("body").write.text(path)


def write_markdown_report(report: DataFrame, path: str) -> None:
    report.repartitionByRange("source_id", "ordinal", "line_no").sortWithinPartitions("source_id", "ordinal", "line_no").select("line").write.text(path)
