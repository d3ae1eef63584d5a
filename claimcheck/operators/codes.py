"""Places of values among the sorted different values of their column, of all columns at once.

Cells (row, column, value) are dealt out by ranges of (column, value, hash of the row), so that a frequent
value goes to several partitions. Each partition numbers its different values; the driver adds up the
partitions' numbers (a few figures for each partition and column), minding values that go on in the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimcheck.sources.scratch import Scratch

_NUMBERED = "row long, column int, part int, code long, first string, last string"


def _numbered(cells: DataFrame) -> DataFrame:
    """Cells (sorted in their partition) with the number of their value in the partition; and a row without ``row`` for each partition and column: different values, first and last."""
    names = [f.split()[0] for f in _NUMBERED.split(", ")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, column, code, first, last = TaskContext.get().partitionId(), None, -1, None, None
        ended: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            values, columns = batch.column("value"), batch.column("column").to_numpy()
            other = np.append(True, columns[1:] != columns[:-1])
            new = other | np.append(True, pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy(zero_copy_only=False))
            if columns[0] == column:  # goes on from the batch before
                other[0], new[0] = False, values[0].as_py() != last
            else:
                code = -1
            begins = np.flatnonzero(other)
            codes = np.cumsum(new)
            before = np.zeros(len(codes), dtype=np.int64) + (code if not other[0] else -1)
            for at in begins:
                before[at:] = -1 - (codes[at] - 1)
            codes = codes + before
            for at in begins:
                if column is not None:
                    ended.append((column, code + 1 if at == 0 else int(codes[at - 1]) + 1, first, last if at == 0 else values[at - 1].as_py()))
                column, first = int(columns[at]), values[at].as_py()
            code, last = int(codes[-1]), values[-1].as_py()
            size = len(codes)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("column"), pa.array(np.full(size, part, dtype=np.int32)), pa.array(codes), pa.nulls(size, pa.string()), pa.nulls(size, pa.string())], names)
        if column is not None:
            ended.append((column, code + 1, first, last))
            own, counts, firsts, lasts = zip(*ended)
            size = len(own)
            yield pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()), pa.array(own, pa.int32()), pa.array([part] * size, pa.int32()), pa.array(counts, pa.int64()), pa.array(firsts, pa.string()), pa.array(lasts, pa.string())], names)

    return cells.mapInArrow(number, _NUMBERED)


def offsets(parts: list) -> list[tuple[int, int, int]]:
    """(part, column, codes before it) from (column, part, different values, first, last) of any order."""
    found, at, before, end = [], None, 0, None
    for column, part, different, first, last in sorted(parts, key=lambda p: (p[0], p[1])):
        if column != at:
            at, before, end = column, 0, None
        before -= end is not None and first == end
        found.append((part, column, before))
        before, end = before + different, last
    return found


def with_codes(df: DataFrame, values: dict[str, F.Column], scratch: Scratch, row: str) -> DataFrame:
    """(row, c0, c1, ...): the places of ``values`` (text columns of ``df``, none missing) by ``row``, a number of each row."""
    spark = df.sparkSession
    cells = F.array(*[F.struct(F.lit(i).alias("column"), v.alias("value")) for i, v in enumerate(values.values())])
    cells = df.select(F.col(row).alias("row"), F.inline(cells))
    dealt = cells.repartitionByRange("column", "value", F.xxhash64("row")).sortWithinPartitions("column", "value")
    numbered = scratch.saved(_numbered(dealt), "codes")
    parts = numbered.where("row IS NULL").select("column", "part", "code", "first", "last").collect()  # partitions and columns, together
    before = spark.createDataFrame(offsets(parts), "part int, column int, before long")
    codes = numbered.where("row IS NOT NULL").join(F.broadcast(before), ["part", "column"]).select("row", "column", (F.col("code") + F.col("before")).alias("code"))
    return codes.groupBy("row").agg(*[F.max(F.when(F.col("column") == i, F.col("code"))).alias(f"c{i}") for i in range(len(values))])
