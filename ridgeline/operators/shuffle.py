"""Reproducible shuffles and splits. Keys are md5 of seed, epoch and row number, so any engine and any partitioning gives the same order."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.arrays import block_of


def shuffle_key(row_id: Column, seed: int, epoch: int = 0) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-{epoch}-"), row_id.cast("string")))


def prefix_digits(rows: int) -> int:
    """Hexadecimal digits of a key that cut rows in about as many ranges as rows of a range, so that neither grows long. Orders do not depend on it."""
    digits = 1
    while 16 ** (2 * digits) < rows and digits < 8:
        digits += 1
    return digits


def _with_positions(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """position from 0 in a global order of about rows rows in each value of what stands before the key, without one task for all: ranges of the key are sorted apart and start where the rows of the ranges before them end."""
    prefix = F.substring(order[-1], 1, prefix_digits(rows))
    lead = order[:-1] + ["_prefix"]
    ranged = df.withColumn("_prefix", prefix)
    counts = ranged.groupBy(*lead).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(*lead).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*lead).orderBy(*order, "row_id")) - 1
    return ranged.withColumn("_own", own).join(before, lead).withColumn("position", (F.col("_before") + F.col("_own")).cast("long")).drop("_prefix", "_before", "_own")


def global_shuffle(df: DataFrame, seed: int, epoch: int = 0, rows: int | None = None) -> DataFrame:
    """A uniform shuffle of all rows: position. Spark's sort is the external merge sort of random keys. rows: how many there are; counted if not given."""
    return _with_positions(df.withColumn("_key", shuffle_key(F.col("row_id"), seed, epoch)), ["_key"], df.count() if rows is None else rows).drop("_key")


def block_local_shuffle(df: DataFrame, rows_per_block: int, seed: int, epoch: int = 0) -> DataFrame:
    """Rows stay in their block and are shuffled in it: block_id, position."""
    block = block_of(F.col("row_id"), rows_per_block)
    rank = F.row_number().over(Window.partitionBy("block_id").orderBy("_key")) - 1
    out = df.withColumn("block_id", block).withColumn("_key", shuffle_key(F.col("row_id"), seed, epoch)).withColumn("_rank", rank)
    return out.withColumn("position", (F.col("block_id") * rows_per_block + F.col("_rank")).cast("long")).drop("_key", "_rank")


def external_shuffle(df: DataFrame, rows_per_block: int, rows: int, seed: int, epoch: int = 0) -> DataFrame:
    """Blocks are shuffled, then slices of all blocks are merged and shuffled again: slice_id, position. A true permutation for any sizes."""
    blocks = max(1, ceil(rows / rows_per_block))
    size = max(1, rows_per_block // blocks)
    local = block_local_shuffle(df, rows_per_block, seed, epoch)
    rank = F.col("position") - F.col("block_id") * rows_per_block
    out = local.withColumn("slice_id", F.floor(rank / F.lit(size)).cast("long")).drop("position")
    out = out.withColumn("_key", shuffle_key(F.col("row_id"), seed + 1, epoch))
    return _with_positions(out, ["slice_id", "_key"], size * blocks).drop("_key")


#: Shuffles by name: df, seed, epoch, rows of a block, rows. More can be added.
SHUFFLES: dict[str, Callable[[DataFrame, int, int, int, int], DataFrame]] = {
    "none": lambda df, seed, epoch, size, rows: df.withColumn("position", F.col("row_id")),
    "global": lambda df, seed, epoch, size, rows: global_shuffle(df, seed, epoch, rows),
    "block_local": lambda df, seed, epoch, size, rows: block_local_shuffle(df, size, seed, epoch),
    "external": lambda df, seed, epoch, size, rows: external_shuffle(df, size, rows, seed, epoch),
}


def shuffled(df: DataFrame, how: str, seed: int, epoch: int, rows_per_block: int, rows: int) -> DataFrame:
    """df with position by a shuffle of SHUFFLES."""
    if how not in SHUFFLES:
        raise ValueError(f"unknown shuffle {how}; there are {', '.join(SHUFFLES)}")
    return SHUFFLES[how](df, seed, epoch, rows_per_block, rows)


def gather(matrix: DataFrame, order: DataFrame) -> DataFrame:
    """Rows of matrix by an index vector order (position, row_id): position and the matrix's columns, a row as often as the vector names it. Numbers that no row has give no row."""
    return order.select("position", "row_id").join(matrix, "row_id")


def split_exact(df: DataFrame, share: float, rows: int, seed: int) -> DataFrame:
    """df shuffled, with is_train for exactly ceil(rows * share) rows."""
    return global_shuffle(df, seed, rows=rows).withColumn("is_train", F.col("position") < ceil(rows * share))
