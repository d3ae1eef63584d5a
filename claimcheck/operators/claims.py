"""Claims from texts: numbered lines, with the direction and strength that their words say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimcheck.functions.columns import stripped

#: Fixed value: what counts as a number in a claim; of whole numbers the sign is left out.
NUMBER = r"[-+]?\d*\.\d+|\d+"


def text_lines(texts: DataFrame, source: str = "source_id", text: str = "text") -> DataFrame:
    """(source, ordinal, line): the lines of each text, stripped; blank ones are left out but counted."""
    lines = texts.where(F.col(text).isNotNull()).select(F.col(source), F.posexplode(F.split(F.col(text), "\n")).alias("ordinal", "line"))
    return lines.withColumn("line", stripped(F.col("line"))).where("line != ''")


def claims_parse(texts: DataFrame, source: str = "source_id", text: str = "text") -> DataFrame:
    """(source, ordinal, original_text, relationship, direction, strength, confidence_score, type) of numbered lines.

    A claim's text is what follows the number; other lines, bullets included, are no claims.
    """
    numbered = text_lines(texts, source, text).where(F.col("line").rlike(r"^\d+[.)]"))
    claims = numbered.select(source, "ordinal", F.regexp_replace("line", r"^\d+[.)]\s*", "").alias("original_text"))
    low = F.lower("original_text")
    has = low.contains
    direction = F.when(has("positive") | (has("increases") & ~has("decreases")), "positive").when(has("negative") | has("decreases"), "negative").otherwise("unknown")
    strength = F.when(has("strong") | has("significant"), "strong").when(has("weak"), "weak").when(has("moderate"), "moderate").otherwise("unknown")
    confidence = F.when(strength == "strong", 0.8).when(strength == "weak", 0.4).when(strength == "moderate", 0.6).otherwise(0.5)
    return claims.withColumns({"relationship": F.lit("correlation"), "direction": direction, "strength": strength, "confidence_score": confidence, "type": F.lit("correlation")})


def claim_numbers(text: Column) -> Column:
    """All numbers of a text in order; a decimal keeps its sign, a whole number doesn't."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: x.try_cast("double"))
