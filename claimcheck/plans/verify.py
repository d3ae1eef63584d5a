"""Verification of texts against a table, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame

from claimcheck.config import DEFAULTS, Thresholds
from claimcheck.functions.columns import numeric_columns
from claimcheck.operators.claims import claims_parse
from claimcheck.operators.mentions import mentions, subjects
from claimcheck.operators.profile import profile_numeric
from claimcheck.operators.truth import truth_table
from claimcheck.operators.verdicts import verdicts


def verify(table: DataFrame, texts: DataFrame, fuzzy: str | None = "levenshtein", t: Thresholds = DEFAULTS, **options) -> DataFrame:
    """Verdicts on the numbered claims of ``texts`` (source_id, text) about ``table``.

    The profile and the truth have a row for each column and each pair of columns at most; claims stay where
    they are read, and Spark broadcasts the small sides.
    """
    claims = subjects(mentions(claims_parse(texts), table.columns, fuzzy, t=t))
    numbers = numeric_columns(table)
    return verdicts(claims, truth_table(table, t=t), profile_numeric(table), numbers[0] if numbers else None, t=t, **options)
