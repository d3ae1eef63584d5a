"""Counts, means and co-moments of pairs of columns over the rows that have both, as a mergeable state.

The pairs are dealt into tiles of at most ``TILE`` columns by as many. A task keeps one state for each tile:
for every pair the rows that have both values, both means, both sums of squared deviations and the sum of
their products, updated a batch of rows at a time by products of matrices. States meet by tile, in two
steps, and are merged pairwise as they come, so that no task holds more than the tiles that it is given.
States may as well be kept (of a day, say) and merged later.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimcheck.functions.columns import quoted

#: Columns of a tile, tiles that one scan keeps in a task (48 KB each), and rows of a step.
TILE, TILES, ROWS = 32, 1024, 4096
#: Parts in which the states of one tile are merged first.
PARTS = 32
#: A sum of squares this small beside that around the batch's mean is rounding.
ROUNDING = 1e-13


class Tile(NamedTuple):
    """Places of columns: all pairs of ``x`` and ``y``; with ``half`` those whose first column comes before the second; with ``paired`` the first of each, the second of each, and so on."""

    x: tuple[int, ...]
    y: tuple[int, ...]
    half: bool = False
    paired: bool = False

    @property
    def shape(self) -> tuple[int, int, int]:
        return 6, len(self.x), 1 if self.paired else len(self.y)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(x, y, whether the pair counts) in the order of the state."""
        x, y = np.array(self.x), np.array(self.y)
        if not self.paired:
            x, y = (z.ravel() for z in np.meshgrid(x, y, indexing="ij"))
        return x, y, x < y if self.half else np.ones(len(x), dtype=bool)


def tiles_of(x: list[int], y: list[int], half: bool = False) -> list[Tile]:
    """The tiles of all pairs of ``x`` and ``y``, or of each two of ``x`` (``half``)."""
    xs, ys = ([tuple(z[i : i + TILE]) for i in range(0, len(z), TILE)] for z in (x, y))
    return [Tile(a, b, half and i == j) for i, a in enumerate(xs) for j, b in enumerate(ys) if not half or i <= j]


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The state of two sets of rows from their states: n, mean and mean, squares and squares, products."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    dx, dy = b[1] - a[1], b[2] - a[2]
    weight = a[0] * share
    return np.stack([n, np.where(a[0] > 0, a[1] + dx * share, b[1]), np.where(a[0] > 0, a[2] + dy * share, b[2]), a[3] + b[3] + dx * dx * weight, a[4] + b[4] + dy * dy * weight, a[5] + b[5] + dx * dy * weight])


class States:
    """The states of a task's tiles."""

    def __init__(self, tiles: list[Tile]):
        self.tiles = tiles
        self.of: dict[int, np.ndarray] = {}

    def add(self, values: np.ndarray) -> None:
        """``values``: rows by columns, NaN where missing. A pair with an infinite value has no finite moments."""
        present, infinite = ~np.isnan(values), np.isinf(values)
        finite = np.where(present & ~infinite, values, 0.0)
        count = np.maximum(present.sum(axis=0), 1)
        low, high = np.where(present, values, np.inf).min(axis=0, initial=np.inf), np.where(present, values, -np.inf).max(axis=0, initial=-np.inf)
        centre = np.where(low == high, np.where(np.isfinite(low), low, 0.0), finite.sum(axis=0) / count)
        moved = np.where(present & ~infinite, finite - centre, 0.0)
        has, squares, odd = present.astype(np.float64), moved * moved, infinite.any()
        for i, tile in enumerate(self.tiles):
            x, y = list(tile.x), list(tile.y)
            if tile.paired:
                times = lambda a, b: (a[:, x] * b[:, y]).sum(axis=0)[:, None]
                cx, cy = centre[x][:, None], centre[y][:, None]
            else:
                times = lambda a, b: a[:, x].T @ b[:, y]
                cx, cy = centre[x][:, None], centre[y][None, :]
            n, sx, sy, sxx, syy = times(has, has), times(moved, has), times(has, moved), times(squares, has), times(has, squares)
            some = np.maximum(n, 1)
            mx, my = sx / some, sy / some
            qx, qy, c = sxx - sx * mx, syy - sy * my, times(moved, moved) - sx * my
            qx, qy = np.where(qx > ROUNDING * sxx, qx, 0.0), np.where(qy > ROUNDING * syy, qy, 0.0)
            if odd:
                c = np.where(times(infinite.astype(float), has) + times(has, infinite.astype(float)) > 0, np.nan, c)
            new = np.stack([n, np.where(n > 0, cx + mx, 0.0), np.where(n > 0, cy + my, 0.0), qx, qy, c])
            self.of[i] = merge(self.of[i], new) if i in self.of else new

    def rows(self, first: int) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() % PARTS
        for i, state in self.of.items():
            yield pa.RecordBatch.from_arrays([pa.array([first + i], pa.int32()), pa.array([part], pa.int32()), pa.array([state.tobytes()], pa.binary())], ["tile", "part", "state"])


_STATE = "tile int, part int, state binary"


def states(df: DataFrame, columns: list[str], tiles: list[Tile]) -> DataFrame:
    """(tile, part, state) of the rows of each task, in as many scans as it takes to keep ``TILES`` tiles a task."""
    found = None
    for first in range(0, len(tiles), TILES):
        some = tiles[first : first + TILES]
        used = sorted({c for t in some for c in (*t.x, *t.y)})
        place = {c: i for i, c in enumerate(used)}
        own = [t._replace(x=tuple(place[c] for c in t.x), y=tuple(place[c] for c in t.y)) for t in some]

        def scan(batches: Iterator[pa.RecordBatch], own=own, first=first) -> Iterator[pa.RecordBatch]:
            kept = States(own)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    kept.add(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for c in batch.slice(at, ROWS).columns]))
            yield from kept.rows(first)

        more = df.select(*[quoted(columns[c]).cast("double").alias(f"c{c}") for c in used]).mapInArrow(scan, _STATE)
        found = found.union(more) if found else more
    return found


def merged(found: DataFrame, tiles: list[Tile]) -> DataFrame:
    """(x, y, n, mean_x, mean_y, squares_x, squares_y, products) of each pair, by the places of its columns, from states of any tasks."""

    def meet(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        of: dict[int, np.ndarray] = {}
        for batch in batches:
            for tile, state in zip(batch.column("tile").to_pylist(), batch.column("state").to_pylist()):
                new = np.frombuffer(state).reshape(tiles[tile].shape)
                of[tile] = merge(of[tile], new) if tile in of else new
        return of

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, state in meet(batches).items():
            yield pa.RecordBatch.from_arrays([pa.array([tile], pa.int32()), pa.array([0], pa.int32()), pa.array([state.tobytes()], pa.binary())], ["tile", "part", "state"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, state in meet(batches).items():
            i, j, own = tiles[tile].pairs()
            numbers = [pa.array(state[k].ravel()[own]) for k in range(1, 6)]
            yield pa.RecordBatch.from_arrays([pa.array(i[own], pa.int32()), pa.array(j[own], pa.int32()), pa.array(state[0].ravel()[own].astype(np.int64)), *numbers], ["x", "y", "n", "mean_x", "mean_y", "squares_x", "squares_y", "products"])

    met = found.repartition("tile", "part").mapInArrow(part, _STATE).repartition("tile")
    return met.mapInArrow(pairs, "x int, y int, n long, mean_x double, mean_y double, squares_x double, squares_y double, products double")


def comoments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, n, mean_x, ...) of each two of ``columns``, by their places; missing values and NaN don't count."""
    places = list(range(len(columns)))
    tiles = tiles_of(places, places, half=True)
    return merged(states(df, columns, tiles), tiles)


def correlation(found: DataFrame, names: list[str], name: str) -> DataFrame:
    """(var1, var2, n, <name>) from co-moments. A pair with fewer than two rows or a constant or infinite side has no row."""
    r = F.try_divide(F.col("products"), F.sqrt("squares_x") * F.sqrt("squares_y"))
    listed: Callable = lambda place: F.get(F.array(*[F.lit(n) for n in names]), F.col(place))
    varies = (F.col("n") >= 2) & (F.col("squares_x") > 0) & (F.col("squares_y") > 0) & ~F.isnan("products")
    return found.where(varies).select(listed("x").alias("var1"), listed("y").alias("var2"), "n", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)).alias(name))
