"""Sufficient statistics: Gram matrix, cross moments, norms.

Rows without features take no part, nor, where labels are needed, do rows without a label. An element that is null, and rows of different lengths, are errors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ridgeline.functions import arrays

#: Rows and columns of a tile of a large result, and how tiles travel.
TILE = 256
TILES = "ti int, tj int, height int, cells binary"


@dataclass(frozen=True)
class Moments:
    """Of n rows: X'X, X'Y, and the sum of squares of Y for each class."""

    gram: np.ndarray
    cross: np.ndarray
    squares: np.ndarray
    n: int


def to_numpy(column: pa.Array) -> np.ndarray:
    """Rows of an array column without nulls, which have to be equally long and whole."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros((0, 0))
    sizes = pc.list_value_length(column)
    if sizes.null_count or pc.min(sizes).as_py() != pc.max(sizes).as_py():
        raise ValueError("rows of different lengths, or without features")
    cells = column.flatten()
    if cells.null_count:
        raise ValueError("a row has a null among its features")
    return cells.to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)


def complete(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows of batch that have no null column."""
    for i in range(batch.num_columns):
        if batch.column(i).null_count:
            batch = batch.filter(batch.column(i).is_valid())
    return batch


def targets(labels: np.ndarray, classes: int) -> np.ndarray:
    return (labels[:, None] == np.arange(classes)).astype(float) if classes > 1 else labels.astype(float)[:, None]


def append(matrix: DataFrame, added: str, function: Callable[[np.ndarray], list[pa.Array]]) -> DataFrame:
    """matrix with the columns `added` (DDL) that function gives for the features of a batch; null where there are none. Other columns pass through; columns by the added names are replaced."""
    new = StructType.fromDDL(added)
    rest = matrix.drop(*new.names)
    packed = rest.select(F.struct("*").alias("_row"))
    place = rest.columns.index("features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0).field(place)
            there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            made = function(to_numpy(column.take(pa.array(there))))
            back = np.full(len(column), -1)
            back[there] = np.arange(len(there))
            take = pa.array(back, mask=back < 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[a.take(take) for a in made]], names=["_row", *new.names])

    return packed.mapInArrow(run, StructType([packed.schema["_row"], *new.fields])).select("_row.*", *new.names)


def tile_rows(ti: int, tj: int, cells: np.ndarray) -> pa.RecordBatch:
    """A tile as a row of TILES."""
    return pa.RecordBatch.from_arrays([pa.array([ti], pa.int32()), pa.array([tj], pa.int32()), pa.array([len(cells)], pa.int32()), pa.array([np.ascontiguousarray(cells, float).tobytes()], pa.binary())], names=["ti", "tj", "height", "cells"])


def tile_of(height: int, cells: bytes) -> np.ndarray:
    return np.frombuffer(cells).reshape(height, -1) if height else np.zeros((0, 0))


def add_tiles(partial: DataFrame) -> DataFrame:
    """Sums of tiles that stand at the same place. A task holds one sum at a time, since its rows come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total = None, None
        for batch in batches:
            for ti, tj, height, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != (ti, tj):
                    if place is not None:
                        yield tile_rows(*place, total)
                    place, total = (ti, tj), np.array(tile_of(height, cells))
                else:
                    total += tile_of(height, cells)
        if place is not None:
            yield tile_rows(*place, total)

    return partial.repartition("ti", "tj").sortWithinPartitions("ti", "tj").mapInArrow(run, TILES)


def products(matrix: DataFrame, classes: int = 0, ones: bool = False) -> DataFrame:
    """Tiles (TILES) on and above the diagonal of Z'Z, Z being the features, with classes the targets behind them, with ones a last column of ones. A matrix product in each batch, summed within a task; tiles are summed over tasks."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            batch = complete(batch)
            if not len(batch):
                continue
            z = to_numpy(batch.column(0))
            if classes:
                z = np.hstack((z, targets(batch.column(1).to_numpy(), classes)))
            if ones:
                z = np.hstack((z, np.ones((len(z), 1))))
            total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            for i in range(0, len(total), TILE):
                for j in range(i, len(total), TILE):
                    yield tile_rows(i // TILE, j // TILE, total[i : i + TILE, j : j + TILE])

    return add_tiles(matrix.select("features", *(["label"] if classes else [])).mapInArrow(partial, TILES))


def cells(tiles: DataFrame) -> DataFrame:
    """i, j, v of the symmetric matrix whose upper tiles these are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ti, tj, height, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tile = tile_of(height, packed)
                for a, b, values in ((ti, tj, tile), (tj, ti, tile.T))[: 1 + (ti != tj)]:
                    i, j = np.indices(values.shape)
                    yield pa.RecordBatch.from_arrays([pa.array((i.ravel() + a * TILE).astype(np.int32)), pa.array((j.ravel() + b * TILE).astype(np.int32)), pa.array(values.ravel())], names=["i", "j", "v"])

    return tiles.mapInArrow(run, "i int, j int, v double")


def gram(matrix: DataFrame) -> DataFrame:
    return cells(products(matrix)).select("i", "j", F.col("v").alias("g"))


def cross_moment(matrix: DataFrame, classes: int, features: int) -> DataFrame:
    found = cells(products(matrix, classes)).filter((F.col("i") < features) & (F.col("j") >= features))
    return found.select("i", (F.col("j") - features).cast("int").alias("c"), F.col("v").alias("b"))


def moments(matrix: DataFrame, classes: int) -> Moments:
    """One job; (features + classes) squared numbers come to the driver, in tiles."""
    found = {(r.ti, r.tj): tile_of(r.height, bytes(r.cells)) for r in products(matrix, classes, ones=True).toLocalIterator()}
    if not found:
        return Moments(np.zeros((0, 0)), np.zeros((0, classes)), np.zeros(classes), 0)
    last = max(j for _, j in found)
    size = last * TILE + found[0, last].shape[1]
    whole = np.zeros((size, size))
    for (ti, tj), tile in found.items():
        i, j = ti * TILE, tj * TILE
        whole[i : i + tile.shape[0], j : j + tile.shape[1]] = tile
        whole[j : j + tile.shape[1], i : i + tile.shape[0]] = tile.T
    d = size - classes - 1
    return Moments(whole[:d, :d], whole[:d, d:-1], np.diag(whole)[d:-1].copy(), int(whole[-1, -1]))


def row_norms(matrix: DataFrame) -> DataFrame:
    return matrix.select("row_id", arrays.squared_norm(F.col("features")).alias("norm2"))


def frobenius(matrix: DataFrame) -> DataFrame:
    return matrix.agg(F.sqrt(F.sum(arrays.squared_norm(F.col("features")))).alias("norm"))
