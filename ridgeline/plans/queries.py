"""Registered queries of the library, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import arrays
from ridgeline.operators import fold, kernel, shuffle, stats
from ridgeline.plans.ridge import GD, SGD, SSGD, ClosedForm, Model, Ridge, kernel_matrix
from ridgeline.sources import logs, matrix, scratch
from ridgeline.streaming import ssgd

CLASSES, FEATURES, REG = 10, 64, 0.1
BLOCK, STREAM_BLOCK, PARTS = 100, 200, 4
STEPS = fold.Steps(eta0=0.01, damp=0.99, step=100, momentum=0.9, reg=0.1, log_every=0)
GD_STEPS = fold.Steps(eta0=0.2, damp=0.9, step=10, momentum=0.0, reg=0.1, log_every=0)
GD_ITERATIONS = 50
KERNEL_STEPS = fold.Steps(eta0=0.001, damp=0.99, step=100, momentum=0.5, reg=0.0, log_every=0)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(column, digits: int = 6):
    """Rounded, without negative zeros."""
    return F.round(column, digits) + F.lit(0.0)


def _cell(column):
    """_r to 6 digits for each of very many cells: in doubles, halves away from zero, as DuckDB rounds. F.round goes through a decimal, which takes longer than all else that a cell needs."""
    scaled = column * F.lit(1e6)
    whole, sign = F.rint(scaled), F.signum(scaled)
    rounded = (whole + F.when(scaled - whole == F.lit(0.5) * sign, sign).otherwise(F.lit(0.0))) / F.lit(1e6)
    return F.when(F.abs(scaled) < F.lit(float("inf")), rounded).otherwise(column) + F.lit(0.0)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two features and a 0/1 label for each customer."""
    label = F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0)
    return matrix.labelled(_table(spark, sf_dir, "customer"), "c_custkey", F.array(F.col("c_acctbal") / F.lit(1e4), F.lit(1.0)), label)


def _lineitem_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One aggregate of lineitem: n and the moments of x = (quantity / 50, discount) and y = price / 1e5."""
    x1, x2, y = F.col("l_quantity") / F.lit(50.0), F.col("l_discount"), F.col("l_extendedprice") / F.lit(1e5)
    sums = {"g11": x1 * x1, "g12": x1 * x2, "g22": x2 * x2, "b1": x1 * y, "b2": x2 * y, "yy": y * y}
    return _table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), *[(F.sum(v) / F.count("*")).alias(k) for k, v in sums.items()])


def _moments(spark: SparkSession, sf_dir: str) -> stats.Moments:
    """Means, not sums, so that steps do not depend on the number of rows."""
    r = _lineitem_moments(spark, sf_dir).first()
    return stats.Moments(np.array([[r.g11, r.g12], [r.g12, r.g22]]), np.array([[r.b1], [r.b2]]), np.array([r.yy]), r.n)


def matrix_scan(spark, sf_dir):
    x = F.col("features")
    return matrix.embeddings(spark, sf_dir).select("row_id", "label", F.size(x).alias("d"), _r(arrays.total(x)).alias("total"))


def block_counts(spark, sf_dir):
    return matrix.embeddings(spark, sf_dir).groupBy(arrays.block_of(F.col("row_id"), BLOCK).alias("block_id")).agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))


def block_read(spark, sf_dir):
    """Reading one block is what this operator does."""
    return matrix.read_block(matrix.embeddings(spark, sf_dir), 1, BLOCK).select("row_id", "label")


def split_features_label(spark, sf_dir):
    packed = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_quantity", "l_discount", "l_extendedprice").alias("packed"))
    x = arrays.features_of(F.col("packed"))
    return packed.select("l_orderkey", "l_linenumber", x[0].alias("x0"), x[1].alias("x1"), F.size(x).alias("d"), arrays.label_of(F.col("packed")).alias("label"))


def scale_features(spark, sf_dir):
    scaled = arrays.scale(F.array(F.col("p_size").cast("double"), "p_retailprice"), 255.0)
    return _table(spark, sf_dir, "part").select("p_partkey", _r(scaled[0], 9).alias("s0"), _r(scaled[1], 9).alias("s1"))


def row_subset(spark, sf_dir):
    """A subset of first rows is what this operator gives: here the first thousand orders."""
    orders = _table(spark, sf_dir, "orders").withColumn("row_id", F.col("o_orderkey"))
    return matrix.first_rows(orders, 1000).select("o_orderkey", "o_totalprice")


def concat_columns(spark, sf_dir):
    joined = F.concat(F.array(F.col("p_size").cast("double")), F.array("p_retailprice", F.col("p_partkey").cast("double")))
    return _table(spark, sf_dir, "part").select("p_partkey", F.size(joined).alias("d"), arrays.total(joined).alias("total"))


def union_batches(spark, sf_dir):
    a = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    b = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return matrix.stack(a, b)


def train_test_split_exact(spark, sf_dir):
    rows = customers(spark, sf_dir)
    return shuffle.split_exact(rows, 0.8, rows.count(), 5).select("row_id", "position", "is_train")


def one_hot(spark, sf_dir):
    hot = arrays.one_hot(F.col("label"), CLASSES)
    return matrix.embeddings(spark, sf_dir).select("row_id", F.posexplode(hot).alias("c", "y"))


def argmax_decode(spark, sf_dir):
    return matrix.embeddings(spark, sf_dir).select("row_id", arrays.argmax(F.col("features")).alias("largest"), arrays.argmax(arrays.one_hot(F.col("label"), CLASSES)).alias("decoded"))


def threshold_predict(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").groupBy(arrays.above_half(F.col("l_quantity") / F.lit(50.0)).alias("prediction"), "l_returnflag").agg(F.count("*").alias("n"))


def row_norms(spark, sf_dir):
    return stats.row_norms(matrix.embeddings(spark, sf_dir)).select("row_id", _r(F.col("norm2")).alias("norm2"))


def frobenius_norm(spark, sf_dir):
    return stats.frobenius(matrix.embeddings(spark, sf_dir)).select(_r(F.col("norm")).alias("norm"))


def gram_matrix(spark, sf_dir):
    return stats.gram(matrix.embeddings(spark, sf_dir)).select("i", "j", _r(F.col("g")).alias("g"))


def cross_moment(spark, sf_dir):
    return stats.cross_moment(matrix.embeddings(spark, sf_dir), CLASSES, FEATURES).select("i", "c", _r(F.col("b")).alias("b"))


def ridge_closed_1d(spark, sf_dir):
    m = _lineitem_moments(spark, sf_dir)
    return m.select("n", _r(F.col("b1") / (F.col("g11") + F.lit(REG))).alias("w"))


def ridge_closed_2d(spark, sf_dir):
    w = Ridge(REG).minimum(_moments(spark, sf_dir))
    return ssgd.weights_frame(spark, w).select("j", "c", _r(F.col("w")).alias("w"))


def ridge_closed_64d(spark, sf_dir):
    w = ClosedForm(FEATURES, CLASSES, Ridge(REG)).fit(matrix.embeddings(spark, sf_dir)).weights
    return ssgd.weights_frame(spark, w).select("j", "c", _r(F.col("w")).alias("w"))


def ridge_predict_accuracy(spark, sf_dir):
    train = matrix.embeddings(spark, sf_dir)
    model = ClosedForm(FEATURES, CLASSES, Ridge(REG)).fit(train)
    hit = (F.col("prediction") == F.col("label")).cast("double")
    return model.predict(train).groupBy("label").agg(F.count("*").alias("n"), _r(F.avg(hit), 9).alias("accuracy"))


def _weights_2d(spark, sf_dir):
    return np.array([[0.5], [0.25]]), _moments(spark, sf_dir)


def ridge_loss_norm(spark, sf_dir):
    w, m = _weights_2d(spark, sf_dir)
    return spark.createDataFrame([(round(Ridge(REG).value(w, m), 6),)], "loss double")


def ridge_loss_objective(spark, sf_dir):
    w, m = _weights_2d(spark, sf_dir)
    return spark.createDataFrame([(round(Ridge(REG).objective(w, m), 6),)], "loss double")


def ridge_gradient_full(spark, sf_dir):
    w, m = _weights_2d(spark, sf_dir)
    return ssgd.weights_frame(spark, Ridge(REG).gradient(w, m)).select("j", _r(F.col("w")).alias("g"))


def gd_trajectory(spark, sf_dir):
    run = GD(2, 1, Ridge(REG), GD_STEPS, iterations=GD_ITERATIONS)
    rows = [(t, round(float(w[0, 0]), 6) + 0.0, round(float(w[1, 0]), 6) + 0.0) for t, w in run.path(_moments(spark, sf_dir))]
    return spark.createDataFrame(rows, "t int, w0 double, w1 double")


def lr_schedule(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return events.select("event_id", _r(arrays.learning_rate(F.col("event_id"), 0.5, 0.99, 1000), 9).alias("alpha"))


def log_sampling(spark, sf_dir):
    return _table(spark, sf_dir, "events").filter(arrays.logged(F.col("event_id"), 1000)).select("event_id", "event_type")


def block_local_shuffle(spark, sf_dir):
    return shuffle.block_local_shuffle(_orders(spark, sf_dir), 700, 3).select("row_id", "block_id", "position")


def external_shuffle(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    return shuffle.external_shuffle(rows, 700, rows.count(), 3).select("row_id", "slice_id", "position")


def global_shuffle(spark, sf_dir):
    return shuffle.global_shuffle(_orders(spark, sf_dir), 3).select("row_id", "position")


def _orders(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice")


def _fold(spark, sf_dir, how: str, epochs: int) -> DataFrame:
    rows = customers(spark, sf_dir)
    n, state = rows.count(), fold.State.zero(2, 1)
    for epoch in range(epochs):
        state = fold.run_fold(shuffle.shuffled(rows, how, 3, epoch, BLOCK, n), state, STEPS, 1)
    return ssgd.weights_frame(spark, state.weights).select("j", F.lit(state.t).cast("long").alias("t"), _r(F.col("w")).alias("w"))


def sgd_fold(spark, sf_dir):
    return _fold(spark, sf_dir, "none", 1)


def sgd_fold_block_shuffled(spark, sf_dir):
    return _fold(spark, sf_dir, "block_local", 1)


def ssgd_two_epochs(spark, sf_dir):
    return _fold(spark, sf_dir, "block_local", 2)


def _kernel(name):
    def run(spark, sf_dir):
        return kernel.kernel_cells(matrix.embeddings(spark, sf_dir), name).select("i", "j", _cell(F.col("k")).alias("k"))

    return run


def lambda_matrix(spark, sf_dir):
    return kernel.add_diagonal(kernel.kernel_cells(matrix.embeddings(spark, sf_dir), "rbf"), REG).select("i", "j", _cell(F.col("k")).alias("k"))


def kernel_sgd(spark, sf_dir):
    """Dual weights for the label being under 5, by a fold over the rows of K + reg I, each made when the fold comes to it."""
    rows = matrix.embeddings(spark, sf_dir).withColumn("label", (F.col("label") < 5).cast("int"))
    state = kernel.kernel_fold(rows, KERNEL_STEPS, 1, "rbf", 1.0, REG)
    return ssgd.weights_frame(spark, state.weights).select(F.col("j").cast("long").alias("i"), _r(F.col("w")).alias("alpha"))


def matmul_coo(spark, sf_dir):
    rows = matrix.embeddings(spark, sf_dir)
    a = stats.gram(rows).select("i", "j", F.col("g").alias("v"))
    b = stats.cross_moment(rows, CLASSES, FEATURES).select("i", F.col("c").alias("j"), F.col("b").alias("v"))
    return kernel.matmul(a, b).select("i", "j", _r(F.col("v")).alias("v"))


def ssgd_stream(spark, sf_dir):
    """Two epochs over a stream of blocks of customers in the order of the external shuffle."""
    rows = customers(spark, sf_dir)
    ordered = shuffle.shuffled(rows, "external", 3, 0, 500, rows.count())
    path = scratch.scratch(spark)
    blocks = ssgd.write_blocks(ordered, path, STREAM_BLOCK)
    state = ssgd.train_stream(spark, path, 2, 1, STEPS, epochs=2)
    scratch.delete(spark, path)
    return ssgd.weights_frame(spark, state.weights).select("j", F.lit(state.t).cast("long").alias("t"), F.lit(blocks).cast("long").alias("blocks"), _r(F.col("w")).alias("w"))


def local_sgd_average(spark, sf_dir):
    w = fold.local_average(customers(spark, sf_dir), STEPS, 2, 1, PARTS)
    return ssgd.weights_frame(spark, w).select("j", _r(F.col("w")).alias("w"))


def training_log_roundtrip(spark, sf_dir):
    """The log of one epoch of descent, written as CSV and read again; times are left out, as no two runs share them."""
    rows = customers(spark, sf_dir)
    run = SGD(2, 1, Ridge(REG), replace(STEPS, log_every=100), epochs=1, shuffle="none")
    run.fit(rows, rows)
    path = scratch.scratch(spark)
    logs.write_log(spark, run.logger.rows, path)
    return logs.read_logs(spark, path).select("i", _r(F.col("loss")).alias("loss"), _r(F.col("train_accuracy"), 9).alias("train_accuracy"), _r(F.col("test_accuracy"), 9).alias("test_accuracy"))


def gather_rows(spark, sf_dir):
    """Customers by an index vector: for each event the customer whose number is seven times the event's, less whole rounds."""
    rows = customers(spark, sf_dir)
    order = _table(spark, sf_dir, "events").select(F.col("event_id").alias("position"), (F.col("event_id") * 7 % rows.count()).alias("row_id"))
    return shuffle.gather(rows, order).select("position", "row_id", F.col("features")[0].alias("x0"), "label")


def times_held(spark, sf_dir):
    """Embeddings times a matrix of 64 x 3 that is made by a rule."""
    m = np.array([[((3 * j + c) % 7 - 3) / 4 for c in range(3)] for j in range(FEATURES)])
    out = kernel.times(matrix.embeddings(spark, sf_dir), m)
    return out.select("row_id", *[_r(F.col("product")[c]).alias(f"p{c}") for c in range(3)])


def ssgd_stream_metrics(spark, sf_dir):
    """Loss and accuracy on the current block after each block of a stream."""
    rows = customers(spark, sf_dir)
    run = SSGD(2, 1, Ridge(REG), replace(STEPS, log_every=1), epochs=1, shuffle="global", rows_per_block=STREAM_BLOCK, seed=3)
    run.stream(rows)
    path = scratch.scratch(spark)
    logs.write_log(spark, run.logger.rows, path)
    return logs.read_logs(spark, path).select("i", _r(F.col("loss")).alias("loss"), _r(F.col("train_accuracy"), 9).alias("accuracy"))


def kernel_unblocked(spark, sf_dir):
    """All pairs at once: each row meets the whole matrix, which is one tile of columns, or as few as hold HELD_BYTES of features each."""
    rows = matrix.embeddings(spark, sf_dir)
    n, parts, held = max(1, rows.count()), 8 * spark.sparkContext.defaultParallelism, max(1, kernel.HELD_BYTES // (8 * FEATURES))
    return kernel.kernel_cells(rows, "rbf", 1.0, min(-(-n // parts), 16 * kernel.TILE_ROWS), min(n, held)).select("i", "j", _cell(F.col("k")).alias("k"))


def matrix_saved(spark, sf_dir):
    """Embeddings with their labels, saved with narrower elements in files of 100 rows and opened again."""
    path = scratch.scratch(spark)
    matrix.save(matrix.embeddings(spark, sf_dir), path, 100, "float")
    return matrix.reopen(spark, path).select("row_id", "label", F.size("features").alias("d"), _r(arrays.total(arrays.as_double(F.col("features")))).alias("total"))


def blocks_saved(spark, sf_dir):
    """Embeddings saved in a folder for each block, and what the blocks hold then."""
    path = scratch.scratch(spark)
    matrix.save_blocks(matrix.embeddings(spark, sf_dir), path, BLOCK)
    found = matrix.reopen(spark, path).groupBy("block_id").agg(F.count("*").alias("n"), F.max("row_id").alias("last_row"), F.sum(arrays.total(F.col("features"))).alias("total"))
    return found.select(F.col("block_id").cast("long").alias("block_id"), "n", "last_row", _r(F.col("total")).alias("total"))


def ridge_closed_hooked(spark, sf_dir):
    """A closed form behind a hook that scales the features."""
    hook = lambda m: m.withColumn("features", arrays.scale(F.col("features"), 255.0))
    w = ClosedForm(2, 1, Ridge(REG), hook=hook).fit(customers(spark, sf_dir)).weights
    return ssgd.weights_frame(spark, w).select("j", _r(F.col("w")).alias("w"))


def zero_model(spark, sf_dir):
    """What a model without training predicts: of equal scores the first class."""
    found = Model.zero(FEATURES, CLASSES).predict(matrix.embeddings(spark, sf_dir))
    return found.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (
        matrix_scan, block_counts, block_read, split_features_label, scale_features, row_subset, concat_columns, union_batches, train_test_split_exact,
        one_hot, argmax_decode, threshold_predict, row_norms, frobenius_norm, gram_matrix, cross_moment, ridge_closed_1d, ridge_closed_2d,
        ridge_closed_64d, ridge_predict_accuracy, ridge_loss_norm, ridge_loss_objective, ridge_gradient_full, gd_trajectory, lr_schedule, log_sampling,
        block_local_shuffle, external_shuffle, global_shuffle, sgd_fold, sgd_fold_block_shuffled, ssgd_two_epochs, lambda_matrix, kernel_sgd, matmul_coo,
        ssgd_stream, local_sgd_average, training_log_roundtrip, gather_rows, times_held,
        ssgd_stream_metrics, kernel_unblocked, matrix_saved, blocks_saved, ridge_closed_hooked, zero_model,
    )
    return {f.__name__: f for f in plain} | {f"kernel_{k}": _kernel(k) for k in kernel.KERNELS}


__all__ = ["Model", "queries"]
