"""Average ranks of all columns at once, without a join on values.

Cells (row, column, value) are dealt out by ranges of (column, value, hash of the row), so that a value that
many rows share goes to several partitions. Each partition is sorted and ranks its cells among themselves;
only the values at its two ends can go on in a neighbouring partition. The driver adds up the partitions'
counts (a few numbers for each partition and each column), which turns ranks in partitions into ranks in
columns.

Ranks may be taken among the rows that have a value in another column as well. Columns that lack values in
the same rows form a class, and every cell carries which classes its row has: one sorted pass counts the
rows of each class along the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimcheck.functions.columns import quoted
from claimcheck.operators.comoments import ROWS, States, Tile, correlation, merged, tiles_of
from claimcheck.sources.scratch import Scratch, saved

#: Classes whose bits one number holds.
BITS = 60


def _number(column: str):
    value = quoted(column).cast("double")
    # -0.0 and 0.0 are one value
    return F.when(~F.isnan(value), value + F.lit(0.0))


def classes_of(df: DataFrame, columns: list[str]) -> list[int]:
    """The class of each column: equal numbers for columns that lack values in the same rows (``df`` has ``_row``).

    From two hashes, joined over the rows that lack a value, in one pass.
    """
    parts = []
    for i, c in enumerate(columns):
        lacks = _number(c).isNull()
        parts += [F.struct(F.count_if(lacks), *[F.bit_xor(F.when(lacks, F.xxhash64("_row", F.lit(seed)))) for seed in (1, 2)]).alias(f"p{i}")]
    found = df.agg(*parts).first()
    numbers: dict[tuple, int] = {}
    return [numbers.setdefault(tuple(p), len(numbers)) for p in found]


def _cells(df: DataFrame, columns: list[str], classes: list[int] | None) -> tuple[DataFrame, int]:
    """(row, column, value, masks): the cells that have a value, and the number of classes; without ``classes`` there is one, of all rows."""
    n = max(classes) + 1 if classes else 1
    there = [_number(columns[classes.index(k)]).isNotNull() if classes else F.lit(True) for k in range(n)]
    bit = lambda k: F.when(there[k], F.lit(1 << k % BITS)).otherwise(F.lit(0)).cast("long")
    masks = []
    for first in range(0, n, BITS):
        mask = bit(first)
        for k in range(first + 1, min(n, first + BITS)):
            mask = mask.bitwiseOR(bit(k))
        masks.append(mask)
    cells = F.array(*[F.struct(F.lit(i).alias("column"), _number(c).alias("value")) for i, c in enumerate(columns)])
    return df.select(F.col("_row").alias("row"), F.array(*masks).alias("masks"), F.inline(cells)).where("value IS NOT NULL"), n


_RANKED = "row long, column int, part int, edge int, ranks array<double>, first_value double, first array<double>, last_value double, last array<double>"


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def _ranked_parts(cells: DataFrame, n: int) -> DataFrame:
    """Cells with their ranks in their partition for each class (NaN: the row hasn't the class), and a row without ``row`` for each partition and column.

    ``edge``: 1 if the value is the partition's first of its column, 2 if its last, 3 if both. The row of the
    partition has its counts by class as ``ranks``, and the counts of its first and last value. A task holds
    its partition's numbers; ranges are of like size, whatever the values.
    """
    names = [f.split()[0] for f in _RANKED.split(", ")]

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), [b for b in batches if b.num_rows]
        if not held:
            return
        row, column, value = (np.concatenate([b.column(name).to_numpy() for b in held]) for name in ("row", "column", "value"))
        masks = np.concatenate([b.column("masks").flatten().to_numpy().reshape(b.num_rows, -1) for b in held])
        held.clear()
        begins = np.flatnonzero(np.append(True, (column[1:] != column[:-1]) | (value[1:] != value[:-1])))  # of each value
        sizes = np.diff(np.append(begins, len(row)))
        of_column = column[begins]
        new = np.append(True, of_column[1:] != of_column[:-1])  # the column's first value here
        firsts = np.flatnonzero(new)
        lasts = np.append(firsts[1:], len(begins)) - 1
        column_of = np.cumsum(new) - 1
        counts, before, ranks = np.empty((len(begins), n)), np.empty((len(begins), n)), np.empty((len(row), n))
        for k in range(n):
            has = masks[:, k // BITS] >> (k % BITS) & 1
            counts[:, k] = np.add.reduceat(has, begins)
            total = np.cumsum(counts[:, k]) - counts[:, k]
            before[:, k] = total - total[firsts][column_of]
            ranks[:, k] = np.where(has == 1, np.repeat(before[:, k] + (counts[:, k] + 1) / 2, sizes), np.nan)
        edge = np.zeros(len(begins), dtype=np.int32)
        edge[firsts] += 1
        edge[lasts] += 2
        edge = np.repeat(edge, sizes)
        for at in range(0, len(row), ROWS):
            own = slice(at, at + ROWS)
            size = len(row[own])
            none = [pa.nulls(size, pa.float64()), pa.nulls(size, pa.list_(pa.float64()))] * 2
            yield pa.RecordBatch.from_arrays([pa.array(row[own]), pa.array(column[own]), pa.array(np.full(size, part, dtype=np.int32)), pa.array(edge[own]), _lists(ranks[own]), *none], names)
        size, value = len(firsts), value[begins]
        ends = [pa.array(value[firsts]), _lists(counts[firsts]), pa.array(value[lasts]), _lists(counts[lasts])]
        numbers = [pa.array(np.full(size, x, dtype=np.int32)) for x in (part, 0)]
        yield pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()), pa.array(of_column[firsts]), *numbers, _lists(before[lasts] + counts[lasts]), *ends], names)

    return cells.mapInArrow(rank, _RANKED)


def whole_ranks(parts: list) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each (part, column): what is before its cells, and the ranks of its first and its last value, by class.

    ``parts``: (column, part, counts, first_value, first, last_value, last), of any order.
    """
    found: dict[tuple[int, int], list] = {}
    column, value, members, before, count, total = None, None, [], 0.0, 0.0, 0.0

    def close() -> None:
        for key, end in members:
            found[key][end] = before + (count + 1) / 2

    for own, part, counts, first_value, first, last_value, last in sorted(parts, key=lambda p: (p[0], p[1])):
        counts, first, last = map(np.array, (counts, first, last))
        if own != column:
            close()
            column, value, members, total = own, None, [], np.zeros(len(counts))
        found[part, own] = [total, None, None]
        if value is None or first_value != value:
            close()
            value, members, before, count = first_value, [], total, np.zeros(len(counts))
        count = count + first
        members.append(((part, own), 1))
        if last_value != first_value:
            close()
            value, members, before, count = last_value, [((part, own), 2)], total + counts - last, last
        total = total + counts
    close()
    return {key: tuple(x) for key, x in found.items()}


def _rank_cells(rows: DataFrame, columns: list[str], classes: list[int] | None, scratch: Scratch) -> tuple[DataFrame, np.ndarray, list[np.ndarray], int]:
    """Cells with ranks in their partition, the sorted keys (part, column) and what turns these into ranks, and the number of classes."""
    cells, n = _cells(rows, columns, classes)
    dealt = cells.repartitionByRange("column", "value", F.xxhash64("row")).sortWithinPartitions("column", "value")
    ranked = scratch.saved(_ranked_parts(dealt, n), "ranks")
    # A row for each partition and column that meet: as many as there are partitions, and columns, together.
    parts = ranked.where("row IS NULL").select("column", "part", "ranks", "first_value", "first", "last_value", "last").collect()
    whole = whole_ranks(parts)
    keys = sorted(whole)
    last = lambda x: x[2] if x[2] is not None else x[1]
    table = [np.stack(x) for x in zip(*[(whole[k][0], whole[k][1], last(whole[k])) for k in keys])] if keys else [np.zeros((0, n))] * 3
    return ranked.where("row IS NOT NULL").select("row", "column", "part", "edge", "ranks"), np.array([p * len(columns) + c for p, c in keys], dtype=np.int64), table, n


def _matrices(batches: Iterator[pa.RecordBatch], width: int, n: int, keys: np.ndarray, table: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their ranks as a matrix of columns times classes) from cells sorted by row."""
    left: pa.RecordBatch | None = None

    def matrix(some: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        row, column, part, edge = (some.column(c).to_numpy() for c in ("row", "column", "part", "edge"))
        ranks = some.column("ranks").combine_chunks().flatten().to_numpy().reshape(len(row), n)
        at = np.searchsorted(keys, part.astype(np.int64) * width + column)
        own = np.where((edge == 0)[:, None], ranks + table[0][at], np.where((edge == 2)[:, None], table[2][at], table[1][at]))
        rows, place = np.unique(row, return_inverse=True)
        out = np.full((len(rows), width, n), np.nan)
        out[place, column] = np.where(np.isnan(ranks), np.nan, own)
        return rows, out.reshape(len(rows), width * n)

    most = max(width, min(ROWS * width, (1 << 23) // n))  # cells of a step
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            held.append(batch.slice(at, most))
            size += held[-1].num_rows
            if size >= most:
                some = pa.Table.from_batches(held)
                row = some.column("row").to_numpy()
                cut = int(np.searchsorted(row, row[-1]))  # the last row may go on
                if cut:
                    yield matrix(some.slice(0, cut))
                held = some.slice(cut).to_batches()
                size = len(row) - cut
    if size:
        yield matrix(pa.Table.from_batches(held))


def _pair_tiles(classes: list[int], n: int) -> list[Tile]:
    """Tiles of columns times classes: each column of a pair ranked in the class of the other."""
    members = [[c for c, k in enumerate(classes) if k == own] for own in range(n)]
    tiles, single = [], []
    for k in range(n):
        for other in range(k, n):
            x, y = [c * n + other for c in members[k]], [c * n + k for c in members[other]]
            if k == other and len(x) > 1:
                tiles += tiles_of(x, x, half=True)
            elif k != other and len(x) * len(y) >= 64:
                tiles += tiles_of(x, y)
            elif k != other:
                single += [(a, b) for a in x for b in y]
    return tiles + [Tile(tuple(a for a, _ in some), tuple(b for _, b in some), paired=True) for at in range(0, len(single), 1024) if (some := single[at : at + 1024])]


def numbered(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as doubles, with ``_row``, a number of the row (its place as read)."""
    return df.select(F.monotonically_increasing_id().alias("_row"), *[_number(c).alias(c) for c in columns])


def average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """The ``columns`` as average ranks among each column's values (missing stays missing), rows in any order; rows without any value are left out."""
    with Scratch(df.sparkSession) as scratch:
        rows = scratch.saved(numbered(df, columns), "rows")
        cells, keys, table, n = _rank_cells(rows, columns, None, scratch)
        width, kept = len(columns), saved(cells, "ranks")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, matrix in _matrices(batches, width, n, keys, table):
            yield pa.RecordBatch.from_arrays([pa.array(matrix[:, i], from_pandas=True) for i in range(len(columns))], list(columns))

    schema = ", ".join(f"`{c}` double" for c in columns)
    return kept.repartition("row").sortWithinPartitions("row").mapInArrow(put, schema)


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """(var1, var2, n, rho) of each two of ``columns``; the result, a row a pair, is worked out at once."""
    with Scratch(df.sparkSession) as scratch:
        rows = scratch.saved(numbered(df, columns), "rows")
        classes = classes_of(rows, columns)
        cells, keys, table, n = _rank_cells(rows, columns, classes, scratch)
        tiles, width = _pair_tiles(classes, n), len(columns)
        met = cells.repartition("row").sortWithinPartitions("row")

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = States(tiles)
            for _, matrix in _matrices(batches, width, n, keys, table):
                for at in range(0, len(matrix), ROWS):
                    kept.add(matrix[at : at + ROWS])
            yield from kept.rows(0)

        found = merged(met.mapInArrow(scan, "tile int, part int, state binary"), tiles)
        x, y = (F.floor(F.col(c) / n).cast("int") for c in ("x", "y"))
        return saved(correlation(found.withColumns({"x": F.least(x, y), "y": F.greatest(x, y)}), columns, "rho"), "spearman")
