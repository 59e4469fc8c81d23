"""Descent over a stream of blocks: each micro-batch brings blocks, they are folded in their order, and the state is kept between them and over restarts."""

from __future__ import annotations

import io
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass, replace
from itertools import takewhile
from math import ceil

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.arrays import block_of
from ridgeline.operators.fold import State, Steps, run_blocks
from ridgeline.sources import scratch

STORED = "position long, features array<double>, label int, block long"


def write_blocks(ordered: DataFrame, path: str, rows_per_block: int) -> int:
    """A folder for each block, all written by one job: rows are shuffled once, by block. Returns the number of blocks."""
    rows = ordered.select("position", "features", "label").withColumn("block", block_of(F.col("position"), rows_per_block))
    rows.repartition("block").sortWithinPartitions("block", "position").write.mode("overwrite").partitionBy("block").parquet(path)
    return sum(name.startswith("block=") for name in scratch.names(rows.sparkSession, path))


@dataclass(frozen=True)
class Progress:
    """Where training stands: the epoch, blocks of it that have arrived, the first one that is not folded yet, the state before it."""

    epoch: int
    arrived: frozenset[int]
    block: int
    state: State


def save(spark: SparkSession, root: str, p: Progress) -> None:
    """Progress under a name that sorts by it. Older files go once it is there."""
    out = io.BytesIO()
    np.savez(out, weights=p.state.weights, change=p.state.change, t=p.state.t, arrived=sorted(p.arrived), epoch=p.epoch, block=p.block)
    name = f"state-{p.epoch:08d}-{p.block:012d}-{len(p.arrived):012d}"
    scratch.write_bytes(spark, f"{root}/{name}", out.getvalue())
    for old in scratch.names(spark, root):
        if old.startswith("state-") and old < name:
            scratch.delete(spark, f"{root}/{old}")


def saved(spark: SparkSession, root: str) -> Progress | None:
    """The last progress under root."""
    found = [n for n in scratch.names(spark, root) if n.startswith("state-") and not n.endswith(".tmp")]
    if not found:
        return None
    with np.load(io.BytesIO(scratch.read_bytes(spark, f"{root}/{found[-1]}"))) as z:
        return Progress(int(z["epoch"]), frozenset(z["arrived"].astype(int).tolist()), int(z["block"]), State(z["weights"], z["change"], int(z["t"])))


Metric = Callable[[int, int, State, DataFrame], None]
#: What is called with the epoch, blocks with the state after each of them, and their rows (STORED).
Metrics = Callable[[int, list[tuple[int, State]], DataFrame], None]
#: About the number of micro-batches of an epoch of many blocks, and bytes of states that the driver gets from one job.
BATCHES, STATES_BYTES = 16, 64 << 20


def train_stream(
    spark: SparkSession, path: str, features: int, classes: int, steps: Steps, epochs: int = 1, checkpoint: str | None = None, on_block: Metric | None = None, on_blocks: Metrics | None = None
) -> State:
    """Replays the blocks of path once for each epoch.

    Files arrive in no certain order, so a block waits until all before it are folded; it is read from where it lies then. All blocks that a micro-batch makes ready are folded by one
    job, or by some where the states after them outgrow STATES_BYTES. After them, or after each block if on_block is given, the progress is saved under checkpoint, before the stream commits the batch. A
    call with the same checkpoint goes on where the last one ended, and a batch that is delivered again changes nothing. on_block(epoch, block, state, rows) is called after each
    block, on_blocks(epoch, [(block, state)], rows) after each job's blocks, for metrics on the current blocks.
    """
    root = checkpoint or scratch.scratch(spark)
    every = sorted(int(name.partition("=")[2]) for name in scratch.names(spark, path) if name.startswith("block="))
    now = saved(spark, root) or Progress(0, frozenset(), 0, State.zero(features, classes))
    most = max(1, STATES_BYTES // max(1, now.state.weights.nbytes + now.state.change.nbytes))

    def rows_of(blocks: list[int]) -> DataFrame:
        return spark.read.schema(STORED).option("basePath", path).parquet(*[f"{path}/block={b}" for b in blocks])

    def receive(batch: DataFrame, number: int) -> None:
        nonlocal now
        now = replace(now, arrived=now.arrived | {r.block for r in batch.select("block").distinct().collect()})
        save(spark, root, now)
        ready = list(takewhile(now.arrived.__contains__, every[bisect_left(every, now.block) :]))
        for low in range(0, len(ready), most):
            part = ready[low : low + most]
            rows, state, done = rows_of(part), now.state, []
            after = dict(run_blocks(rows, state, steps, classes))
            for block in part:
                state = after.get(block, state)
                done.append((block, state))
                if on_block:
                    now = replace(now, block=block + 1, state=state)
                    save(spark, root, now)
                    on_block(now.epoch, block, state, rows_of([block]))
            if not on_block:
                now = replace(now, block=part[-1] + 1, state=state)
                save(spark, root, now)
            if on_blocks:
                on_blocks(now.epoch, done, rows)

    while now.epoch < epochs:
        number = max(1, ceil(len(every) ** 0.5), ceil(len(every) / BATCHES))
        stream = spark.readStream.schema(STORED).option("maxFilesPerTrigger", number).parquet(path)
        query = stream.writeStream.foreachBatch(receive).option("checkpointLocation", f"{root}/epoch-{now.epoch}").trigger(availableNow=True).start()
        query.awaitTermination()
        now = Progress(now.epoch + 1, frozenset(), 0, now.state)
        save(spark, root, now)
    return now.state


def weights_frame(spark: SparkSession, w: np.ndarray) -> DataFrame:
    rows = [(int(j), int(c), float(w[j, c])) for j in range(w.shape[0]) for c in range(w.shape[1])]
    return spark.createDataFrame(rows, "j int, c int, w double")
