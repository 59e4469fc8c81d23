"""Ridge regression: losses, models, and the algorithms that train them."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ridgeline.operators import fold, kernel, stats
from ridgeline.operators.shuffle import shuffled
from ridgeline.sources import scratch
from ridgeline.streaming import ssgd

_LOG = logging.getLogger("ridgeline")


def timed(function):
    """Logs how long a call takes."""

    @wraps(function)
    def run(*args, **named):
        began = time.time()
        out = function(*args, **named)
        _LOG.info("%s: %.3f s", function.__name__, time.time() - began)
        return out

    return run


class Loss:
    """What an algorithm needs of a loss: minimum and gradient from moments, gradient of a row, value from moments."""

    def minimum(self, m: stats.Moments) -> np.ndarray:
        raise NotImplementedError

    def gradient(self, w: np.ndarray, m: stats.Moments) -> np.ndarray:
        raise NotImplementedError

    def row_gradient(self) -> fold.Gradient:
        raise NotImplementedError

    def value(self, w: np.ndarray, m: stats.Moments) -> float:
        raise NotImplementedError

    def value_at(self, w: np.ndarray, residual2: float) -> float:
        raise NotImplementedError


@dataclass(frozen=True)
class Ridge(Loss):
    """1/2 |XW - Y|^2 + 1/2 reg |W|^2. From moments alone, so no further pass over rows is made for any of it."""

    reg: float = 0.1

    def minimum(self, m):
        """Without a ridge weight the normal equations may have many solutions; the shortest is taken then."""
        a = m.gram + self.reg * np.eye(len(m.gram))
        return np.linalg.solve(a, m.cross) if self.reg > 0 else np.linalg.lstsq(a, m.cross, rcond=None)[0]

    def gradient(self, w, m):
        return m.gram @ w - m.cross + self.reg * w

    def row_gradient(self):
        return fold.ridge_gradient(self.reg)

    def residual2(self, w, m) -> float:
        return max(0.0, float(np.trace(w.T @ m.gram @ w) - 2 * np.trace(w.T @ m.cross) + m.squares.sum()))

    def objective(self, w, m) -> float:
        return 0.5 * self.residual2(w, m) + 0.5 * self.reg * float((w * w).sum())

    def value(self, w, m) -> float:
        """The norm form that logs show: |XW - Y| + reg |W|."""
        return self.value_at(w, self.residual2(w, m))

    def value_at(self, w, residual2) -> float:
        return float(np.sqrt(residual2) + self.reg * np.linalg.norm(w))


def classes_of(scores: np.ndarray) -> np.ndarray:
    """The class with the largest score, the first of ties; of one class, whether the score is above 0.5."""
    return (scores[:, 0] > 0.5).astype(np.int32) if scores.shape[1] == 1 else scores.argmax(axis=1).astype(np.int32)


def evaluate(matrix: DataFrame, weights: list[np.ndarray]) -> list[tuple[int, int, float]]:
    """For each of the weights the rows of matrix, how many of them it predicts, and the sum of squared residuals. One pass over the rows for all weights that can be held at a time."""
    out = []
    for low in range(0, len(weights), step := max(1, kernel.HELD_BYTES // max(1, weights[0].nbytes)) if weights else 1):
        part = weights[low : low + step]
        held = matrix.sparkSession.sparkContext.broadcast(np.hstack(part))
        classes = part[0].shape[1]

        def run(batches, held=held, number=len(part), classes=classes):
            rows, right, residual2 = 0, np.zeros(number, np.int64), np.zeros(number)
            for batch in batches:
                batch = stats.complete(batch)
                if len(batch):
                    labels = batch.column(1).to_numpy()
                    y, scores = stats.targets(labels, classes), stats.to_numpy(batch.column(0)) @ held.value
                    rows += len(batch)
                    for i in range(number):
                        own = scores[:, i * classes : (i + 1) * classes]
                        right[i] += (classes_of(own) == labels).sum()
                        residual2[i] += ((own - y) ** 2).sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(number, dtype=np.int32)), pa.array(np.full(number, rows)), pa.array(right), pa.array(residual2)], names=["i", "n", "hits", "residual2"])

        found = matrix.select("features", "label").mapInArrow(run, "i int, n long, hits long, residual2 double").groupBy("i").sum("n", "hits", "residual2").collect()
        found = {r[0]: (r[1], r[2], r[3]) for r in found}
        out += [found.get(i, (0, 0, 0.0)) for i in range(len(part))]
    return out


def evaluate_blocks(matrix: DataFrame, weights: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, float]]:
    """For each (block, weights) what evaluate tells of the rows of that block alone; matrix has a column block. One pass for all of them, which have to be few enough to be held."""
    held = matrix.sparkSession.sparkContext.broadcast(dict(weights))

    def run(batches):
        total = {}
        for batch in batches:
            batch = stats.complete(batch)
            of = batch.column(0).to_numpy()
            for block in np.unique(of).tolist():
                part, w = batch.filter(pa.array(of == block)), held.value[block]
                labels = part.column(2).to_numpy()
                y, scores = stats.targets(labels, w.shape[1]), stats.to_numpy(part.column(1)) @ w
                n, hits, residual2 = total.get(block, (0, 0, 0.0))
                total[block] = (n + len(part), hits + int((classes_of(scores) == labels).sum()), residual2 + float(((scores - y) ** 2).sum()))
        kinds = {"block": pa.int64(), "n": pa.int64(), "hits": pa.int64(), "residual2": pa.float64()}
        rows = [(b, *v) for b, v in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))

    found = matrix.select("block", "features", "label").mapInArrow(run, "block long, n long, hits long, residual2 double").groupBy("block").sum("n", "hits", "residual2").collect()
    found = {r[0]: (r[1], r[2], r[3]) for r in found}
    return [found.get(block, (0, 0, 0.0)) for block, _ in weights]


class Model:
    """Weights; predict adds `prediction` to a matrix."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    @classmethod
    def zero(cls, features: int, classes: int) -> Model:
        return cls(np.zeros((features, classes)))

    def predict(self, matrix: DataFrame) -> DataFrame:
        """matrix with prediction (see classes_of); null for rows without features. The weights are broadcast as an array, never written into the plan."""
        held = matrix.sparkSession.sparkContext.broadcast(self.weights)

        def run(x: np.ndarray) -> list[pa.Array]:
            return [pa.array(classes_of(x @ held.value) if len(x) else np.zeros(0, np.int32))]

        return stats.append(matrix, "prediction int", run)

    def accuracy(self, matrix: DataFrame) -> float:
        """The share of rows with features and a label that are predicted; not a number if there are none."""
        ((n, hits, _),) = evaluate(matrix, [self.weights])
        return hits / n if n else float("nan")


class Logger:
    """Collects a line for each logged iteration; pass to a sink of sources.logs."""

    def __init__(self):
        self.began, self.rows = time.time(), []

    def iteration(self, t: int, loss: float, train: float, test: float) -> None:
        self.rows.append((t, time.time() - self.began, loss, train, test))
        _LOG.info("iteration %d: loss %g, train %g, test %g", t, loss, train, test)

    def epoch(self, number: int) -> None:
        _LOG.info("epoch %d finished", number)


@dataclass
class Algorithm:
    """fit(train, test) -> Model; the matrices have row_id, features, label."""

    features: int
    classes: int
    loss: Ridge = field(default_factory=Ridge)
    steps: fold.Steps = field(default_factory=fold.Steps)
    hook: Callable[[DataFrame], DataFrame] = lambda m: m
    logger: Logger = field(default_factory=Logger)

    def fit(self, train: DataFrame, test: DataFrame | None = None) -> Model:
        raise NotImplementedError

    def _log(self, log, train, test):
        """A line for each of the logged (t, weights): loss and accuracies on whole matrices. Some weights at a time are held and evaluated in one pass."""
        held, bytes_ = [], 0
        for entry in log:
            held.append(entry)
            bytes_ += entry[1].nbytes
            if bytes_ > kernel.HELD_BYTES:
                self._lines(held, train, test)
                held, bytes_ = [], 0
        self._lines(held, train, test)

    def _lines(self, entries, train, test):
        weights = [w for _, w in entries]
        tested = evaluate(test, weights) if test is not None else [(0, 0, 0.0)] * len(weights)
        share = lambda n, hits, _: hits / n if n else float("nan")
        for (t, w), on_train, on_test in zip(entries, evaluate(train, weights), tested, strict=True):
            self.logger.iteration(t, self.loss.value_at(w, on_train[2]), share(*on_train), share(*on_test))


class ClosedForm(Algorithm):
    @timed
    def fit(self, train, test=None):
        return Model(self.loss.minimum(stats.moments(self.hook(train), self.classes)))


@dataclass
class GD(Algorithm):
    iterations: int = 5000

    def path(self, m: stats.Moments):
        """Weights after each step; no momentum."""
        w = np.zeros((self.features, self.classes))
        for t in range(self.iterations):
            w = w - self.steps.eta0 * self.steps.damp ** (t // self.steps.step) * self.loss.gradient(w, m)
            yield t, w

    @timed
    def fit(self, train, test=None):
        train, test = self.hook(train), self.hook(test) if test is not None else None
        m, last = stats.moments(train, self.classes), [np.zeros((self.features, self.classes))]

        def logged():
            for t, w in self.path(m):
                last[0] = w
                if self.steps.log_every and t % self.steps.log_every == 0:
                    yield t, w

        self._log(logged(), train, test)
        return Model(last[0])


@dataclass
class SGD(Algorithm):
    """Folds over rows, epoch by epoch; momentum and the count of iterations go on over epochs. shuffle: a name of operators.shuffle.SHUFFLES."""

    epochs: int = 3
    shuffle: str = "block_local"
    rows_per_block: int = 1024
    seed: int = 0

    @timed
    def fit(self, train, test=None):
        train, test = self.hook(train), self.hook(test) if test is not None else None
        rows, state = train.count(), fold.State.zero(self.features, self.classes)
        for epoch in range(self.epochs):
            ordered = shuffled(train, self.shuffle, self.seed, epoch, self.rows_per_block, rows)
            state = fold.run_fold(ordered, state, self.steps, self.classes, self.loss.row_gradient())
            self.logger.epoch(epoch)
        self._log(state.log, train, test)
        return Model(state.weights)


@dataclass
class SSGD(SGD):
    """Out-of-core descent: the external shuffle if asked for, else blocks as they are stored."""

    shuffle: str = "external"

    @timed
    def stream(self, train: DataFrame) -> Model:
        """The same descent over a stream of blocks that are written first, shuffled once; logs loss and accuracy on the current block after each block."""
        train = self.hook(train)
        spark, rows = train.sparkSession, train.count()
        path = scratch.scratch(spark)
        ssgd.write_blocks(shuffled(train, self.shuffle, self.seed, 0, self.rows_per_block, rows), path, self.rows_per_block)

        def on_blocks(epoch: int, blocks: list[tuple[int, fold.State]], current: DataFrame) -> None:
            if self.steps.log_every:
                for (_, state), (n, hits, residual2) in zip(blocks, evaluate_blocks(current, [(b, s.weights) for b, s in blocks]), strict=True):
                    self.logger.iteration(state.t - 1, self.loss.value_at(state.weights, residual2), hits / n if n else float("nan"), float("nan"))

        quiet = replace(self.steps, log_every=0)
        state = ssgd.train_stream(spark, path, self.features, self.classes, quiet, self.epochs, on_blocks=on_blocks)
        scratch.delete(spark, path)
        return Model(state.weights)


@dataclass
class HSGD(Algorithm):
    """Parts folded apart and averaged, in the place of lock-free descent; see fold.local_average."""

    parts: int = 8
    seed: int = 0

    @timed
    def fit(self, train, test=None):
        return Model(fold.local_average(self.hook(train), self.steps, self.features, self.classes, self.parts, self.seed))


def kernel_matrix(matrix: DataFrame, name: str | kernel.TileFunction = "rbf", sigma: float = 1.0, reg: float = 0.1, tile_rows: int = kernel.TILE_ROWS) -> DataFrame:
    """K + reg * I with the labels, as a matrix to train on: weights found on it are the dual weights. name: of a kernel, or a function of two tiles."""
    rows = kernel.kernel_rows(matrix, name, sigma, reg, tile_rows)
    return rows.join(matrix.select("row_id", "label"), "row_id")


ALGORITHMS = {"closed": ClosedForm, "gd": GD, "sgd": SGD, "ssgd": SSGD, "hsgd": HSGD}
