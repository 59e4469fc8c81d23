"""The library's own operators against NumPy, and their properties."""

import importlib.util
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import arrays
from ridgeline.operators import fold, kernel, shuffle, stats
from ridgeline.plans import oracle, queries
from ridgeline.plans.ridge import GD, SGD, SSGD, ClosedForm, Model, Ridge, evaluate_blocks, kernel_matrix
from ridgeline.sources import logs, matrix
from ridgeline.streaming import ssgd

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def rows_of(spark, x, labels):
    return spark.createDataFrame([(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, labels, strict=True))], matrix.MATRIX)


@pytest.fixture(scope="module")
def small(spark):
    r = np.random.default_rng(0)
    x, y = r.normal(size=(60, 4)), r.integers(0, 3, 60)
    return x, y, rows_of(spark, x, y).cache()


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_against_sql(spark, data, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    found = queries.queries()[name](spark, data)
    names = sorted(found.columns)
    sql = oracle.oracle_sql()[name]
    assert sorted(connection.sql(sql).columns) == names
    expected = connection.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    got = [tuple(r[n] for n in names) for r in found.collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))


def test_every_query_has_sql():
    assert set(queries.queries()) == set(oracle.oracle_sql())


def test_the_rest_does_not_need_the_llm_subpackage():
    import __spark_entry__

    assert set(queries.queries()) <= set(__spark_entry__.queries())
    root = os.path.dirname(importlib.util.find_spec("ridgeline").origin)
    for folder in ("functions", "operators", "plans", "sources", "streaming"):
        for name in os.listdir(f"{root}/{folder}"):
            if name.endswith(".py"):
                assert "ridgeline.llm" not in open(f"{root}/{folder}/{name}").read()


def test_moments_and_closed_form(small):
    x, labels, rows = small
    y = (labels[:, None] == np.arange(3)).astype(float)
    m = stats.moments(rows.repartition(7), 3)
    assert np.allclose(m.gram, x.T @ x) and np.allclose(m.cross, x.T @ y) and np.allclose(m.squares, (y * y).sum(0)) and m.n == 60
    loss = Ridge(0.3)
    w = ClosedForm(4, 3, loss).fit(rows).weights
    assert np.allclose((x.T @ x + 0.3 * np.eye(4)) @ w, x.T @ y)
    assert loss.value(w, m) == pytest.approx(np.linalg.norm(x @ w - y) + 0.3 * np.linalg.norm(w))
    assert loss.objective(w, m) == pytest.approx(0.5 * ((x @ w - y) ** 2).sum() + 0.15 * (w * w).sum())
    assert np.abs(loss.gradient(w, m)).max() < 1e-9
    near = GD(4, 3, loss, fold.Steps(eta0=0.005, damp=1.0, step=10, log_every=0), iterations=3000).fit(rows).weights
    assert np.allclose(near, w, atol=1e-6)
    assert Model(w).accuracy(rows) == pytest.approx(((x @ w).argmax(1) == labels).mean())


@pytest.mark.parametrize("n,size", [(10, 1), (10, 3), (10, 10), (10, 11), (1, 5), (97, 4)])
def test_shuffles_are_permutations(spark, n, size):
    rows = spark.range(n).withColumnRenamed("id", "row_id")
    for how in shuffle.SHUFFLES:
        found = shuffle.shuffled(rows, how, 1, 2, size, n).select("row_id", "position").collect()
        assert sorted(r.row_id for r in found) == sorted(r.position for r in found) == list(range(n)), how
    local = shuffle.block_local_shuffle(rows, size, 1).collect()
    assert all(r.position // size == r.row_id // size for r in local)
    again = shuffle.external_shuffle(rows.repartition(3), size, n, 1).select("row_id", "position")
    assert sorted(again.collect()) == sorted(shuffle.external_shuffle(rows, size, n, 1).select("row_id", "position").collect())
    assert shuffle.split_exact(rows, 0.8, n, 1).filter("is_train").count() == -(-n * 8 // 10)
    with pytest.raises(ValueError):
        shuffle.shuffled(rows, "sideways", 1, 1, size, n)


def plain_fold(x, y, steps, start=None):
    w = np.zeros((x.shape[1], y.shape[1]))
    change = np.zeros_like(w)
    for t, (row, target) in enumerate(zip(x, y, strict=True)):
        change = steps.eta0 * steps.damp ** (t // steps.step) * (np.outer(row, row @ w - target) + steps.reg * w) + steps.momentum * change
        w = w - change
    return w


def test_fold_is_that_of_numpy_for_any_partitioning(spark, small):
    x, labels, rows = small
    y = (labels[:, None] == np.arange(3)).astype(float)
    steps = fold.Steps(eta0=0.01, damp=0.9, step=7, momentum=0.5, reg=0.2, log_every=25)
    expected = plain_fold(x, y, steps)
    for parts in (1, 5):
        state = fold.run_fold(rows.withColumn("position", F.col("row_id")).repartition(parts), fold.State.zero(4, 3), steps, 3)
        assert np.allclose(state.weights, expected) and state.t == 60 and [t for t, _ in state.log] == [0, 25, 50]
    order = [r.row_id for e in range(2) for r in shuffle.shuffled(rows, "external", 9, e, 8, 60).orderBy("position").collect()]
    two = SSGD(4, 3, Ridge(0.2), fold.Steps(eta0=0.01, damp=0.9, step=7, momentum=0.5, reg=0.2, log_every=0), epochs=2, rows_per_block=8, seed=9).fit(rows)
    assert np.allclose(two.weights, plain_fold(x[order], y[order], steps))


def test_logging(small):
    run = SGD(4, 3, steps=fold.Steps(log_every=30), epochs=1)
    run.fit(small[2], small[2])
    assert [r[0] for r in run.logger.rows] == [0, 30] and all(0 <= r[3] <= 1 for r in run.logger.rows)


def test_stream_equals_batch(spark, small, tmp_path):
    rows = small[2]
    steps = fold.Steps(eta0=0.01, damp=0.9, step=7, momentum=0.5, reg=0.2, log_every=0)
    ordered = shuffle.shuffled(rows, "external", 3, 0, 8, 60)
    path = str(tmp_path / "blocks")
    assert ssgd.write_blocks(ordered, path, 20) == 3
    seen = []
    state = ssgd.train_stream(spark, path, 4, 3, steps, epochs=2, checkpoint=str(tmp_path / "at"), on_block=lambda e, b, s, current: seen.append((e, b, s.t, current.count())))
    batch = fold.State.zero(4, 3)
    for _ in range(2):
        batch = fold.run_fold(ordered, batch, steps, 3)
    assert state.t == batch.t == 120 and np.allclose(state.weights, batch.weights)
    assert seen == [(e, b, 60 * e + 20 * (b + 1), 20) for e in range(2) for b in range(3)]
    # the same checkpoint again: all is done, nothing is folded twice; a third epoch goes on
    again = ssgd.train_stream(spark, path, 4, 3, steps, epochs=2, checkpoint=str(tmp_path / "at"))
    assert again.t == 120 and np.array_equal(again.weights, state.weights)
    third = ssgd.train_stream(spark, path, 4, 3, steps, epochs=3, checkpoint=str(tmp_path / "at"))
    assert np.allclose(third.weights, fold.run_fold(ordered, batch, steps, 3).weights)


@pytest.mark.parametrize("after", [0, 1, 2, 3])
def test_a_stream_goes_on_after_a_crash(spark, small, tmp_path, after):
    """Killed after some blocks, within a batch: the next call takes up what was saved, and delivered blocks are neither lost nor folded twice."""
    steps = fold.Steps(eta0=0.01, damp=0.9, step=7, momentum=0.5, reg=0.2, log_every=0)
    ordered = shuffle.shuffled(small[2], "global", 3, 0, 8, 60)
    path, at = str(tmp_path / "blocks"), str(tmp_path / "at")
    ssgd.write_blocks(ordered, path, 15)
    count = [0]

    def crash(*_):
        count[0] += 1
        if count[0] > after:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        ssgd.train_stream(spark, path, 4, 3, steps, checkpoint=at, on_block=crash)
    assert ssgd.saved(spark, at).block == after + 1
    state = ssgd.train_stream(spark, path, 4, 3, steps, checkpoint=at)
    assert state.t == 60 and np.allclose(state.weights, fold.run_fold(ordered, fold.State.zero(4, 3), steps, 3).weights)
    assert len([n for n in os.listdir(at) if n.startswith("state-")]) == 1


def test_ready_blocks_of_a_stream_are_folded_by_one_job(spark, tmp_path):
    """The number of jobs follows the micro-batches, not the blocks; each block has its own state and its own metrics all the same."""
    r = np.random.default_rng(3)
    x, labels = r.normal(size=(400, 3)), r.integers(0, 2, 400)
    rows = rows_of(spark, x, labels).withColumn("position", F.col("row_id"))
    rows = rows.withColumn("label", F.when(F.floor(F.col("row_id") / 4) != 31, F.col("label")))  # block 31 has no whole row
    steps = fold.Steps(eta0=0.01, damp=0.9, step=50, momentum=0.5, reg=0.2, log_every=0)
    path, calls = str(tmp_path / "blocks"), []
    assert ssgd.write_blocks(rows, path, 4) == 100
    state = ssgd.train_stream(spark, path, 3, 1, steps, checkpoint=str(tmp_path / "at"), on_blocks=lambda e, blocks, current: calls.append((blocks, evaluate_blocks(current, [(b, s.weights) for b, s in blocks]))))
    assert len(calls) <= 16 and [b for blocks, _ in calls for b, _ in blocks] == list(range(100))
    w, change, t = np.zeros((3, 1)), np.zeros((3, 1)), 0
    for (block, after), (n, hits, residual2) in zip([x for blocks, _ in calls for x in blocks], [x for _, found in calls for x in found], strict=True):
        own = slice(4 * block, 4 * block + 4)
        for row, target in zip(x[own], labels[own], strict=True) if block != 31 else ():
            change = steps.eta0 * steps.damp ** (t // 50) * (np.outer(row, row @ w - [target]) + 0.2 * w) + 0.5 * change
            w, t = w - change, t + 1
        score = (x[own] @ w)[:, 0]
        assert np.allclose(after.weights, w) and after.t == t and n == (4 if block != 31 else 0)
        assert block == 31 or (hits == ((score > 0.5) == labels[own]).sum() and np.isclose(residual2, ((score - labels[own]) ** 2).sum()))
    assert np.allclose(state.weights, w) and state.t == 396


@pytest.mark.parametrize("tile", [1, 7, 60, 100])
def test_kernels(small, tile):
    x, _, rows = small
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    for name, expected in (("sqdist", d2), ("rbf", np.exp(-d2 / 2)), ("linear", x @ x.T)):
        k = np.full((60, 60), np.nan)
        for r in kernel.kernel_cells(rows, name, 1.0, tile).collect():
            k[r.i, r.j] = r.k
        assert np.allclose(k, expected) and np.allclose(k, k.T)
        if name == "sqdist":
            assert not np.diag(k).any()
    if tile == 60:
        other = {(r.i, r.j): r.k for r in kernel.kernel_by_columns(rows, "rbf").collect()}
        assert all(other[i, j] == pytest.approx(np.exp(-d2[i, j] / 2)) for i, j in other) and len(other) == 3600


def test_kernel_descent(spark, small):
    x, _, rows = small
    lam = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 2) + 0.1 * np.eye(60)
    trained = kernel_matrix(rows.withColumn("label", (F.col("label") < 1).cast("int")), "rbf", 1.0, 0.1)
    found = {r.row_id: r for r in trained.collect()}
    assert all(np.allclose(found[i].features, lam[i]) for i in range(60))
    y = np.array([[found[i].label] for i in range(60)], float)
    steps = fold.Steps(eta0=0.01, damp=0.9, step=7, momentum=0.5, reg=0.0, log_every=0)
    state = fold.run_fold(trained.withColumn("position", F.col("row_id")), fold.State.zero(60, 1), steps, 1)
    assert np.allclose(state.weights, plain_fold(lam, y, steps))


def test_kernel_descent_stores_no_kernel_matrix(spark, data, small, monkeypatch):
    """The fold makes each row of K + reg I when it comes to it, in parts of any size, with the features in memory or in a file; a row without a label is a column but no step."""
    x, _, rows = small
    lam = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 2) + 0.1 * np.eye(60)
    rows = rows.withColumn("label", F.when(F.col("row_id") != 7, (F.col("label") < 1).cast("int")))
    label = {r.row_id: r.label for r in rows.collect()}
    own = [i for i in range(60) if i != 7]
    steps = fold.Steps(eta0=0.01, damp=0.9, step=7, momentum=0.5, reg=0.0, log_every=0)
    expected = plain_fold(lam[own], np.array([[label[i]] for i in own], float), steps)
    no_features = rows.unionByName(spark.createDataFrame([(60, None, 1)], rows.schema))
    for strip, held in ((kernel.STRIP_BYTES, kernel.HELD_BYTES), (8 * 60 * 13, 1), (1, 300)):
        monkeypatch.setattr(kernel, "STRIP_BYTES", strip)
        state = kernel.kernel_fold(no_features.repartition(5), steps, 1, "rbf", 1.0, 0.1, held)
        assert np.allclose(state.weights, expected) and state.t == 59
    for whole in ("kernel_rows", "kernel_strips", "kernel_cells"):
        monkeypatch.setattr(kernel, whole, None)
    assert queries.queries()["kernel_sgd"](spark, data).count() == 500
    assert kernel.kernel_fold(rows.limit(0), steps).t == 0


@pytest.mark.parametrize("name", ["kernel_rbf", "kernel_sqdist", "lambda_matrix", "kernel_linear"])
def test_tasks_of_a_kernel_matrix_do_not_grow_with_the_square_of_partitions(spark, data, name):
    """A product of 90 by 90 partitions is 8100 tasks, for one tile of 500 rows."""
    settings = {"spark.sql.shuffle.partitions": "90", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = queries.queries()[name](spark, data)
        assert found.rdd.getNumPartitions() <= 100 and found.select("i", "j").distinct().count() == found.count() == 500 * 500
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_tasks_of_rows_that_meet_the_whole_matrix_do_not_grow_with_its_partitions(spark, data):
    """16 partitions of rows by 90 of one tile of columns are 1440 tasks."""
    settings = {"spark.sql.shuffle.partitions": "90", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = queries.queries()["kernel_unblocked"](spark, data)
        assert found.rdd.getNumPartitions() <= 160 and found.select("i", "j").distinct().count() == found.count() == 500 * 500
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_cells_are_rounded_as_the_sql_rounds(spark):
    """Halves go away from zero, zeros have no sign, and what has no six digits stays."""
    rng = np.random.default_rng(4)
    values = [0.0, -0.0, 0.5e-6, 1.5e-6, 2.5e-6, -0.5e-6, -2.5e-6, 0.49999999999999994e-6, 0.1234565, -0.1, 0.1234575, 4503599627.370497, 1e300, 1e303, -1e303, float("inf"), float("-inf"), *rng.normal(size=3000), *(rng.integers(-(10**7), 10**7, 3000) + 0.5) / 1e6]
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    found = [r.k for r in rows.select("i", queries._cell(F.col("v")).alias("k")).orderBy("i").collect()]
    expected = [duckdb.execute("SELECT round(?::DOUBLE, 6) + 0.0", [float(v)]).fetchone()[0] for v in values]
    assert np.array(found).tobytes() == np.array(expected).tobytes()
    assert np.isnan(spark.range(1).select(queries._cell(F.lit(float("nan"))).alias("k")).first().k)
    assert spark.range(1).select(queries._cell(F.lit(None).cast("double")).alias("k")).first().k is None


def test_strips_of_the_whole_matrix_are_narrow(small, monkeypatch):
    """A strip as wide as the matrix takes all ids in turn, which Parquet stores in many bits each; a narrow one names few."""
    x, _, rows = small
    monkeypatch.setattr(kernel, "TILE_ROWS", 16)
    found = kernel.kernel_strips(rows, "rbf", 1.0, 11, 60).collect()
    assert max(len(r.ids) for r in found) == 16 and len({(r.i, j) for r in found for j in r.ids}) == sum(len(r.values) for r in found) == 3600
    cells = {(r.i, j): v for r in found for j, v in zip(r.ids, r.values, strict=True)}
    assert np.allclose([[cells[i, j] for j in range(60)] for i in range(60)], np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 2)) and all(cells[i, i] == 1.0 for i in range(60))


def test_the_whole_matrix_is_met_in_parts_that_can_be_held(spark, data, monkeypatch):
    expected = sorted(queries.queries()["kernel_unblocked"](spark, data).collect())
    made = kernel.kernel_cells
    asked = []
    monkeypatch.setattr(kernel, "kernel_cells", lambda *a: asked.append(a[-2:]) or made(*a))
    monkeypatch.setattr(kernel, "HELD_BYTES", 8 * queries.FEATURES * 150)
    monkeypatch.setattr(kernel, "TILE_ROWS", 1)
    assert sorted(queries.queries()["kernel_unblocked"](spark, data).collect()) == expected and len(expected) == 500 * 500
    assert asked == [(16, 150)]


@pytest.mark.parametrize("columns", [None, 60, 25])
def test_a_large_tile_is_made_in_parts(small, monkeypatch, columns):
    """However many cells a pair of tiles has, STRIP_BYTES of them are made at a time; rows can meet the whole matrix, in tasks of their own."""
    x, _, rows = small
    monkeypatch.setattr(kernel, "STRIP_BYTES", 8 * 60 * 7)

    def bounded(a, b, sigma):
        if len(a) * len(b) > 60 * 7:
            raise ValueError("too many cells at once")
        return kernel.sqdist_tile(a, b)

    found = {(r.i, r.j): r.k for r in kernel.kernel_cells(rows, bounded, 1.0, 60 if columns is None else 11, columns).collect()}
    assert len(found) == 3600 and np.allclose([[found[i, j] for j in range(60)] for i in range(60)], ((x[:, None] - x[None]) ** 2).sum(-1))
    diagonal = {r.i: r.k for r in kernel.kernel_cells(rows, "rbf", 1.0, 60 if columns is None else 11, columns).filter("i = j").collect()}
    assert diagonal == dict.fromkeys(range(60), 1.0)
    assert columns or kernel.kernel_rows(rows, "rbf", 1.0, 0.0, 60).count() == 60


def test_products(spark, small):
    x, _, rows = small
    m = np.arange(8.0).reshape(4, 2)
    for held in (kernel.HELD_BYTES, 64, 16, 8):  # all of m at once, some of its columns, parts of a column
        assert all(np.allclose(r.product, x[r.row_id] @ m) for r in kernel.times(rows, m, held).collect())
    with pytest.raises(Exception, match="features"):
        kernel.times(rows, m[:3]).collect()
    a, b = np.arange(6.0).reshape(2, 3), np.arange(12.0).reshape(3, 4)
    cells = lambda z: spark.createDataFrame([(i, j, float(z[i, j])) for i in range(z.shape[0]) for j in range(z.shape[1])], "i int, j int, v double")
    for tile in (1, 2, 3, 256):
        found = {(r.i, r.j): r.v for r in kernel.matmul(cells(a), cells(b), tile).collect()}
        assert found == {(i, j): (a @ b)[i, j] for i in range(2) for j in range(4)}
    # far apart and sparse: only what a pair of cells makes is there, also where it sums to nothing
    left = spark.createDataFrame([(0, 0, 1.0), (0, 5000, 1.0), (900, 7, 2.0), (3, 3, None)], "i long, j long, v double")
    right = spark.createDataFrame([(0, 1, 2.0), (5000, 1, -2.0), (8, 8, 1.0), (7, 70_000, 3.0), (7, 70_000, 1.0)], "i long, j long, v double")
    assert sorted(tuple(r) for r in kernel.matmul(left, right).collect()) == [(0, 1, 0.0), (900, 70_000, 8.0)]


@pytest.mark.parametrize("dtype", ["uint8", "float16", "float64"])
def test_binary_files(spark, tmp_path, dtype):
    values = np.arange(70).reshape(10, 7).astype(dtype)
    values.tofile(tmp_path / "m")
    rows = matrix.read_dense(spark, str(tmp_path / "m"), 10, 6, dtype, block=4).orderBy("row_id").collect()
    assert [r.label for r in rows] == values[:, -1].astype(int).tolist() and np.allclose([r.features for r in rows], values[:, :-1].astype(float))


def test_idx_files(spark, tmp_path):
    images, labels = np.arange(24, dtype=np.uint8).reshape(3, 2, 4), np.array([7, 0, 9], np.uint8)
    for name, a in (("x", images), ("y", labels)):
        (tmp_path / name).write_bytes(bytes([0, 0, 8, a.ndim]) + np.array(a.shape, ">i4").tobytes() + a.tobytes())
    rows = matrix.read_idx(spark, str(tmp_path / "x"), str(tmp_path / "y")).orderBy("row_id").collect()
    assert [r.label for r in rows] == [7, 0, 9] and np.allclose([r.features for r in rows], images.reshape(3, -1))
    # batches follow each other
    rows = matrix.read_idx(spark, [str(tmp_path / "x")] * 3, [str(tmp_path / "y")] * 3).orderBy("row_id").collect()
    assert [r.row_id for r in rows] == list(range(9)) and [r.label for r in rows] == [7, 0, 9] * 3
    (tmp_path / "z").write_bytes(bytes([0, 0, 12, 1]) + np.array([2], ">i4").tobytes() + np.array([5, -6], ">i4").tobytes())
    assert matrix.idx_header(spark, str(tmp_path / "z")) == (">i4", (2,), 8)
    with pytest.raises(ValueError):
        matrix.read_idx(spark, str(tmp_path / "x"), str(tmp_path / "z"))
    (tmp_path / "no").write_bytes(b"no idx")
    with pytest.raises(ValueError):
        matrix.idx_header(spark, str(tmp_path / "no"))


def test_saving(spark, small, tmp_path):
    rows = small[2]
    assert matrix.reopen(spark, str(tmp_path / "none")) is None
    matrix.save(rows, str(tmp_path / "m"), rows_per_file=20, element="float")
    again = matrix.reopen(spark, str(tmp_path / "m"))
    assert dict(again.dtypes)["features"] == "array<float>" and again.count() == 60
    matrix.save_blocks(rows, str(tmp_path / "b"), 25)
    assert spark.read.parquet(str(tmp_path / "b")).filter("block_id = 2").count() == 10
    assert "PushedFilters: [IsNotNull(row_id)" in matrix.read_block(again, 1, 10)._jdf.queryExecution().toString()
    logs.write_log(spark, [(0, 0.5, 1.5, 0.25, 0.125)], str(tmp_path / "log"))
    assert [tuple(r)[:5] for r in logs.read_logs(spark, str(tmp_path / "log")).collect()] == [(0, 0.5, 1.5, 0.25, 0.125)]


def test_array_functions(spark):
    row = spark.sql("select array(1.0, 3.0, 3.0, 2.9) as a, 4 as label, 0.5D as half").select(
        arrays.argmax(F.col("a")).alias("top"), arrays.label_of(F.col("a")).alias("cut"), arrays.features_of(F.col("a")).alias("x"), arrays.one_hot(F.col("label"), 3).alias("none"),
        arrays.one_hot(F.col("label"), 1).alias("one"), arrays.above_half(F.col("half")).alias("half"), arrays.logged(F.col("label"), 0).alias("never"),
    ).first()
    assert (row.top, row.cut, row.x, row.none, row.one, row.half, row.never) == (1, 2, [1.0, 3.0, 3.0], [0, 0, 0], [4], 0, False)
    assert arrays.element_bytes("float16") == 2 and arrays.rows_per_block(30, 784, 60000) == 4777 and arrays.rows_per_block(0, 10, 10) == 1
    with pytest.raises(ValueError):
        arrays.element_bytes("complex128")


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], matrix.MATRIX)
    assert stats.moments(empty, 2).n == 0 and kernel.kernel_cells(empty).count() == 0
    one = rows_of(spark, np.array([[2.0, 1.0]]), [1])
    assert [tuple(r) for r in kernel.kernel_cells(one, "sqdist").collect()] == [(0, 0, 0.0)]


def test_rows_without_features_or_label_take_no_part(spark, small):
    x, labels, rows = small
    y = (labels[:, None] == np.arange(3)).astype(float)
    holes = rows.withColumn("features", F.when(F.col("row_id") % 5 != 0, F.col("features"))).withColumn("label", F.when(F.col("row_id") % 7 != 0, F.col("label")))
    ids = np.arange(60)
    shown, whole = ids % 5 != 0, (ids % 5 != 0) & (ids % 7 != 0)
    for parts in (1, 60):
        m = stats.moments(holes.repartition(parts), 3)
        assert m.n == whole.sum() and np.allclose(m.gram, x[whole].T @ x[whole]) and np.allclose(m.cross, x[whole].T @ y[whole])
        g = np.zeros((4, 4))
        for r in stats.gram(holes.repartition(parts)).collect():
            g[r.i, r.j] = r.g
        assert np.allclose(g, x[shown].T @ x[shown])
    steps = fold.Steps(eta0=0.01, damp=0.9, step=7, momentum=0.5, reg=0.2, log_every=0)
    state = fold.run_fold(holes.withColumn("position", F.col("row_id")), fold.State.zero(4, 3), steps, 3)
    assert state.t == whole.sum() and np.allclose(state.weights, plain_fold(x[whole], y[whole], steps))
    w = np.arange(12.0).reshape(4, 3) - 5
    model = Model(w)
    found = {r.row_id: r.prediction for r in model.predict(holes).collect()}
    assert found == {i: int((x[i] @ w).argmax()) if shown[i] else None for i in range(60)}
    assert model.accuracy(holes) == pytest.approx(((x @ w).argmax(1) == labels)[whole].mean())
    assert {r.row_id: r.product is None for r in kernel.times(holes, w).collect()} == {i: not shown[i] for i in range(60)}
    assert {r.i for r in kernel.kernel_cells(holes, "linear", 1.0, 7).collect()} == set(ids[shown].tolist())


def test_broken_rows_are_named(spark):
    ragged = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [1.0], 1), (2, [1.0, 2.0, 3.0], 1)], matrix.MATRIX)
    hole = spark.createDataFrame([(0, [1.0, None], 0)], matrix.MATRIX)
    for parts in (1, 3):
        with pytest.raises(Exception, match="(?s)different lengths|broadcast"):
            stats.moments(ragged.repartition(parts), 2)
    with pytest.raises(Exception, match="different lengths"):
        kernel.kernel_cells(ragged, "linear").collect()
    with pytest.raises(Exception, match="null among"):
        stats.moments(hole, 2)
    with pytest.raises(Exception, match="null among"):
        kernel.kernel_cells(hole, "linear").collect()
    with pytest.raises(Exception, match="null among"):
        Model(np.ones((2, 1))).predict(hole).collect()
    nobody = spark.createDataFrame([(0, None, 0), (1, [1.0], None)], matrix.MATRIX)
    assert stats.moments(nobody, 2).n == 0 and np.isnan(Model(np.ones((1, 2))).accuracy(nobody))


def test_wide_moments_come_in_tiles(spark):
    r = np.random.default_rng(5)
    x, labels = r.normal(size=(20, 2 * stats.TILE + 30)), r.integers(0, 4, 20)
    rows = rows_of(spark, x, labels).repartition(3)
    y = (labels[:, None] == np.arange(4)).astype(float)
    m = stats.moments(rows, 4)
    assert m.n == 20 and np.allclose(m.gram, x.T @ x) and np.allclose(m.cross, x.T @ y) and np.allclose(m.squares, (y * y).sum(0))
    cells = stats.gram(rows).collect()
    assert len(cells) == x.shape[1] ** 2 and all(abs(c.g - x[:, c.i] @ x[:, c.j]) < 1e-9 for c in cells[:: 997])


def test_many_logged_weights_are_evaluated_together(spark, small, monkeypatch):
    from ridgeline.plans import ridge

    x, labels, rows = small
    y = (labels[:, None] == np.arange(3)).astype(float)
    weights = [np.random.default_rng(i).normal(size=(4, 3)) for i in range(7)]
    for held in (kernel.HELD_BYTES, 2 * weights[0].nbytes, 1):
        monkeypatch.setattr(kernel, "HELD_BYTES", held)
        found = ridge.evaluate(rows, weights)
        for w, (n, hits, residual2) in zip(weights, found, strict=True):
            assert n == 60 and hits == ((x @ w).argmax(1) == labels).sum() and residual2 == pytest.approx(((x @ w - y) ** 2).sum())
        run = SGD(4, 3, steps=fold.Steps(eta0=0.01, log_every=11), epochs=2)
        run.fit(rows, rows)
        assert [r[0] for r in run.logger.rows] == list(range(0, 120, 11))


def test_the_average_depends_on_parts_alone(spark):
    r = np.random.default_rng(7)
    rows = spark.createDataFrame([(int(i // 3), v.tolist(), int(v[0] > 0)) for i, v in enumerate(r.normal(size=(90, 2)))], matrix.MATRIX)
    steps = fold.Steps(eta0=0.05, damp=0.9, step=10, momentum=0.5, reg=0.1, log_every=0)
    found = [fold.local_average(rows.repartition(n), steps, 2, 1, 3) for n in (1, 3, 7)]
    assert all(np.array_equal(found[0], w) for w in found)
    assert not np.allclose(found[0], fold.local_average(rows, steps, 2, 1, 5))
    assert not fold.local_average(rows.limit(0), steps, 2, 1, 3).any()


def test_a_function_is_a_kernel(small):
    x, _, rows = small
    cubic = lambda a, b, sigma: (a @ b.T + sigma) ** 3
    k = np.full((60, 60), np.nan)
    for r in kernel.kernel_cells(rows, cubic, 2.0, 13).collect():
        k[r.i, r.j] = r.k
    assert np.allclose(k, (x @ x.T + 2) ** 3)
    trained = kernel_matrix(rows, cubic, 2.0, 0.5, 9).orderBy("row_id").collect()
    assert np.allclose([r.features for r in trained], (x @ x.T + 2) ** 3 + 0.5 * np.eye(60))


def test_shuffles_can_be_added_and_rows_gathered(spark, monkeypatch):
    rows = spark.range(10).select(F.col("id").alias("row_id"), (F.col("id") * 10).alias("v"))
    monkeypatch.setitem(shuffle.SHUFFLES, "backwards", lambda df, seed, epoch, size, n: df.withColumn("position", n - 1 - F.col("row_id")))
    order = shuffle.shuffled(rows, "backwards", 0, 0, 3, 10)
    assert {r.row_id: r.position for r in order.collect()} == {i: 9 - i for i in range(10)}
    index = spark.createDataFrame([(0, 4), (1, 4), (2, 0), (3, 99)], "position long, row_id long")
    assert sorted((r.position, r.v) for r in shuffle.gather(rows, index).collect()) == [(0, 40), (1, 40), (2, 0)]


def test_positions_do_not_depend_on_the_ranges(spark, monkeypatch):
    rows = spark.range(500).withColumnRenamed("id", "row_id")
    found = []
    for digits in (1, 2, 3):
        monkeypatch.setattr(shuffle, "prefix_digits", lambda n, digits=digits: digits)
        found.append([sorted(map(tuple, f.select("row_id", "position").collect())) for f in (shuffle.global_shuffle(rows, 1), shuffle.external_shuffle(rows, 60, 500, 1))])
    assert found[0] == found[1] == found[2]
    monkeypatch.undo()
    assert [shuffle.prefix_digits(n) for n in (0, 1, 257, 10**11)] == [1, 1, 2, 5]


def test_singular_without_a_ridge_weight(spark):
    rows = rows_of(spark, np.array([[1.0, 1.0], [2.0, 2.0]]), [1, 0])
    w = ClosedForm(2, 1, Ridge(0.0)).fit(rows).weights
    assert w[0, 0] == pytest.approx(w[1, 0]) and np.isfinite(w).all()


def test_small_files_in_the_shared_folder(spark, tmp_path):
    from ridgeline.sources import scratch

    assert scratch.names(spark, str(tmp_path / "none")) == [] and not scratch.exists(spark, str(tmp_path / "none"))
    data = bytes(range(256)) * 300
    for _ in range(2):
        scratch.write_bytes(spark, str(tmp_path / "a" / "f"), data)
    assert scratch.read_bytes(spark, str(tmp_path / "a" / "f")) == data and scratch.read_bytes(spark, str(tmp_path / "a" / "f"), 5) == data[:5]
    assert scratch.names(spark, str(tmp_path / "a")) == [".f.crc", "f"] or scratch.names(spark, str(tmp_path / "a")) == ["f"]
    scratch.delete(spark, str(tmp_path / "a"))
    assert not scratch.exists(spark, str(tmp_path / "a"))
