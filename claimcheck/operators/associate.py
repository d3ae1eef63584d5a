"""Association of categorical columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimcheck.config import DEFAULTS, Thresholds
from claimcheck.functions.columns import categorical_columns, pairs, quoted, strength
from claimcheck.functions.distributions import chi2_p_value


def _counted(df: DataFrame, of: list[tuple[str, str]]) -> DataFrame:
    """(pair, level1, level2, n): counts of the cells in each batch of rows; a row isn't copied for its pairs."""
    used = list(dict.fromkeys(c for pair in of for c in pair))
    places = [(used.index(a), used.index(b)) for a, b in of]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [c.dictionary_encode() for c in batch.columns]
            codes = [c.indices.fill_null(-1).to_numpy().astype(np.int64) for c in coded]
            for i, (a, b) in enumerate(places):
                both = (codes[a] >= 0) & (codes[b] >= 0)
                cells, n = np.unique(codes[a][both] * max(1, len(coded[b].dictionary)) + codes[b][both], return_counts=True)
                if len(cells):
                    first, second = np.divmod(cells, len(coded[b].dictionary))
                    levels = [coded[x].dictionary.take(pa.array(y)) for x, y in ((a, first), (b, second))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), i, dtype=np.int32)), *levels, pa.array(n.astype(np.int64))], ["pair", "level1", "level2", "n"])

    rows = df.select(*[quoted(c).cast("string").alias(f"c{i}") for i, c in enumerate(used)])
    return rows.mapInArrow(count, "pair int, level1 string, level2 string, n long")


def contingency(df: DataFrame, columns: list[str] | None = None, of: list[tuple[str, str]] | None = None) -> DataFrame:
    """(var1, var2, level1, level2, n): rows with each two levels, for all pairs of columns (or those in ``of``) in one pass.

    Rows that lack a level don't count for the pair.
    """
    of = pairs(columns or categorical_columns(df)) if of is None else of
    if not of:
        return df.sparkSession.createDataFrame([], "var1 string, var2 string, level1 string, level2 string, n long")
    cells = _counted(df, of).groupBy("pair", "level1", "level2").agg(F.sum("n").alias("n"))
    name = lambda side: F.get(F.array(*[F.lit(pair[side]) for pair in of]), F.col("pair"))
    return cells.select(name(0).alias("var1"), name(1).alias("var2"), "level1", "level2", "n")


def screened(df: DataFrame, columns: list[str] | None = None, max_levels: int = 1_000) -> DataFrame:
    """(var1, var2, levels1, levels2, tested): which pairs are worth a table of counts, by one sketch a column.

    A column of more than ``max_levels`` different values (an identifier, a free text) isn't tested against
    any other. The numbers of levels are estimates, off by 2 % in standard deviation. A row for every pair.
    """
    columns = columns or categorical_columns(df)
    of = pairs(columns)
    if not of:
        return df.sparkSession.createDataFrame([], "var1 string, var2 string, levels1 long, levels2 long, tested boolean")
    found = df.agg(*[F.approx_count_distinct(quoted(c), 0.02).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    levels = dict(zip(columns, found))
    return df.sparkSession.createDataFrame([(a, b, levels[a], levels[b], max(levels[a], levels[b]) <= max_levels) for a, b in of], "var1 string, var2 string, levels1 long, levels2 long, tested boolean")


def screened_chi_square(df: DataFrame, columns: list[str] | None = None, max_levels: int = 1_000) -> DataFrame:
    """``chi_square`` of the pairs that ``screened`` lets through, and a row without figures for each other pair: nothing goes unsaid.

    Columns as of ``chi_square``, and levels1, levels2 and tested.
    """
    pairs_ = screened(df, columns, max_levels)
    of = [(r.var1, r.var2) for r in pairs_.where("tested").collect()]  # names of columns
    return pairs_.join(F.broadcast(chi_square(df, of=of)), ["var1", "var2"], "left")  # a row a pair


def chi_square(df: DataFrame, columns: list[str] | None = None, of: list[tuple[str, str]] | None = None) -> DataFrame:
    """(var1, var2, n, n_rows, n_columns, stat, dof, p_value, cramers_v) of pairs of two levels each or more.

    The statistic is a sum over the cells that occur: n times the sum of count**2 / (row * column), less n.
    A table of two by two is corrected for continuity; its four cells are equally far from what is expected.
    """
    cells = contingency(df, columns, of)
    row, column = Window.partitionBy("var1", "var2", "level1"), Window.partitionBy("var1", "var2", "level2")
    cells = cells.withColumn("r", F.sum("n").over(row)).withColumn("c", F.sum("n").over(column))
    first_r = F.row_number().over(row.orderBy("level2")) == 1
    first_c = F.row_number().over(column.orderBy("level1")) == 1
    cells = cells.withColumn("one_r", F.when(first_r, 1.0 / F.col("r"))).withColumn("one_c", F.when(first_c, 1.0 / F.col("c")))
    share = F.col("n") * F.col("n") / (F.col("r") * F.col("c"))
    found = _summed(cells, share)
    found = found.where("n_rows >= 2 AND n_columns >= 2 AND n >= 2").withColumn("dof", (F.col("n_rows") - 1) * (F.col("n_columns") - 1))
    plain = F.greatest(F.lit(0.0), F.col("n") * F.col("shares") - F.col("n"))
    rest = F.greatest(F.lit(0.0), F.col("gap") - 0.5)
    found = found.withColumn("stat", F.when(F.col("dof") == 1, rest * rest * F.col("n") * F.col("inverse_r") * F.col("inverse_c")).otherwise(plain))
    v = F.sqrt(F.col("stat") / (F.col("n") * (F.least("n_rows", "n_columns") - 1)))
    return found.select("var1", "var2", "n", "n_rows", "n_columns", "stat", "dof", chi2_p_value(F.col("stat"), F.col("dof")).alias("p_value"), v.alias("cramers_v"))


def _summed(cells: DataFrame, share) -> DataFrame:
    # |count - row * column / n| of a cell that occurs; of a two-by-two table it is the same in every cell
    one = F.min_by(F.struct("n", "r", "c"), F.struct("level1", "level2")).alias("one")
    found = cells.groupBy("var1", "var2").agg(F.sum("n").alias("n"), F.count("one_r").alias("n_rows"), F.count("one_c").alias("n_columns"), F.sum(share).alias("shares"), F.sum("one_r").alias("inverse_r"), F.sum("one_c").alias("inverse_c"), one)
    return found.withColumn("gap", F.abs(F.col("one.n") - F.col("one.r") * F.col("one.c") / F.col("n")))


def association_findings(df: DataFrame, columns: list[str] | None = None, t: Thresholds = DEFAULTS) -> DataFrame:
    """The significant pairs whose Cramer's V isn't negligible, with strength and direction ("associated")."""
    found = chi_square(df, columns).where(F.col("p_value") < t.significance).withColumn("strength", strength(F.col("cramers_v"), t))
    return found.where("strength != 'negligible'").withColumn("direction", F.lit("associated"))
