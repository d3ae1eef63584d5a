"""Which columns a claim mentions.

The column names are part of the plan, not a table: each task has an index over them (``NameIndex``) that
reads a claim's text once, so that there is no join and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimcheck.config import DEFAULTS, Thresholds
from claimcheck.functions.columns import free_name
from claimcheck.operators.name_index import NameIndex


def mentions(claims: DataFrame, columns: list[str], fuzzy: str | None = "levenshtein", match: str = "substring", t: Thresholds = DEFAULTS) -> DataFrame:
    """``claims`` with ``mentions``: array<struct<column, col_pos, score, match_kind>> in column order.

    A column counts if its name is in the text (as any part of it, or with ``match="word"`` as a word), or
    else if a part of the text of its length is similar enough by ``fuzzy`` (``levenshtein``, ``indel`` or
    None for none). A text shorter than a name is compared with the parts of the name. A claim without text
    mentions none.
    """

    @F.arrow_udf("array<struct<col_pos: int, score: double, plain: boolean>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = NameIndex(columns, fuzzy, t.fuzzy)
        kind = pa.list_(pa.struct([("col_pos", pa.int32()), ("score", pa.float64()), ("plain", pa.bool_())]))
        for batch in batches:
            rows = [index.find(text or "") for text in batch.to_pylist()]
            ends = [0]
            for row in rows:
                ends.append(ends[-1] + len(row))
            flat = list(zip(*(x for row in rows for x in row))) or [(), (), ()]
            values = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(flat, kind.value_type)], fields=list(kind.value_type))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values).cast(kind)

    low, near = free_name(claims, "_low"), free_name(claims, "_near")
    name = lambda m: F.get(F.array(*[F.lit(c) for c in columns]), m.col_pos)
    plain = lambda m: m.plain
    if match == "word":
        patterns = F.array(*[F.lit(r"\b" + re.escape(c.lower()) + r"\b") for c in columns])
        plain = lambda m: m.plain & F.regexp_like(F.col(low), F.get(patterns, m.col_pos))
    rows = claims.withColumn(low, F.lower("original_text")).withColumn(near, found(F.coalesce(low, F.lit(""))))
    every = F.transform(near, lambda m: F.struct(name(m).alias("column"), m.col_pos.alias("col_pos"), m.score.alias("score"), F.when(plain(m), "exact").otherwise("fuzzy").alias("match_kind")))
    if fuzzy is None:
        every = F.filter(every, lambda m: m.match_kind == "exact")
    none = F.array().cast("array<struct<column: string, col_pos: int, score: double, match_kind: string>>")
    return rows.withColumn("mentions", F.when(F.col("original_text").isNotNull(), every).otherwise(none) if columns else none).drop(low, near)


def mention_rows(mentioned: DataFrame, source: str = "source_id") -> DataFrame:
    """(source, ordinal, column, col_pos, score, match_kind)."""
    return mentioned.select(source, "ordinal", F.inline("mentions"))


def subjects(mentioned: DataFrame) -> DataFrame:
    """With ``extracted_vars``, and ``var1`` and ``var2``: the first two columns mentioned, in column order."""
    names = F.transform("mentions", lambda m: m.column)
    return mentioned.withColumn("extracted_vars", names).withColumn("var1", F.get("extracted_vars", F.lit(0))).withColumn("var2", F.get("extracted_vars", F.lit(1)))
