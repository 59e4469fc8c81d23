"""The command line, over files of its own."""

from __future__ import annotations

import numpy as np
import pytest

from ridgeline import cli
from ridgeline.operators import fold


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    random = np.random.default_rng(3)
    folder = tmp_path_factory.mktemp("cli")
    x = random.normal(size=(120, 4))
    y = x[:, :3].argmax(axis=1)
    for name, rows in (("train", slice(0, 90)), ("test", slice(90, 120))):
        np.column_stack((x[rows], y[rows])).astype("float64").tofile(folder / name)
    return folder, x, y


def _arguments(folder, *more):
    return [*more, "--train", str(folder / "train"), "--test", str(folder / "test"), "--n", "90", "--nt", "30", "--d", "4", "--k", "3"]


def test_closed_form_gives_the_weights_of_the_normal_equations(spark, files, capsys):
    folder, x, y = files
    cli.main(_arguments(folder, "closed", "--reg", "0.5", "--out", str(folder / "weights")))
    hot = np.eye(3)[y[:90]]
    want = np.linalg.solve(x[:90].T @ x[:90] + 0.5 * np.eye(4), x[:90].T @ hot)
    got = np.zeros((4, 3))
    for r in spark.read.parquet(str(folder / "weights")).collect():
        got[r.j, r.c] = r.w
    assert np.allclose(got, want)
    assert f"Train: {np.mean((x[:90] @ want).argmax(axis=1) == y[:90])}" in capsys.readouterr().out


@pytest.mark.parametrize("command", [["gd", "--iters", "30", "--eta0", "0.01"], ["sgd", "--epochs", "2", "--eta0", "0.01"], ["ssgd", "--epochs", "1", "--eta0", "0.01", "--algo", "global"], ["hsgd", "--nthreads", "2", "--eta0", "0.01"]])
def test_descent_learns(spark, files, capsys, command):
    folder, _, _ = files
    cli.main(_arguments(folder, *command, "--logfreq", "0"))
    train, test = (float(v) for v in capsys.readouterr().out.split()[1::2])
    assert train > 0.6 and test > 0.5


def test_a_log_is_written(spark, files):
    folder, _, _ = files
    cli.main(_arguments(folder, "gd", "--iters", "5", "--eta0", "0.01", "--logfreq", "2", "--log", str(folder / "log")))
    assert [r.i for r in spark.read.csv(str(folder / "log"), header=True, inferSchema=True).orderBy("i").collect()] == [0, 2, 4]


def test_a_generated_matrix_can_be_trained_on(spark, files, capsys):
    folder, x, y = files
    cli.main(_arguments(folder, "generate", "--kernel", "linear", "--reg", "0.1", "--subset", "20", "--out", str(folder / "kernel")))
    row = spark.read.parquet(str(folder / "kernel")).filter("row_id = 3").first()
    assert np.allclose(row.features, x[:20] @ x[3] + 0.1 * (np.arange(20) == 3)) and row.label == y[3]
    cli.main(["closed", "--format", "parquet", "--train", str(folder / "kernel"), "--k", "3", "--reg", "0.001"])
    assert float(capsys.readouterr().out.split()[-1]) > 0.8


def test_what_is_missing_is_named(files):
    folder, _, _ = files
    with pytest.raises(SystemExit, match="--n and --d"):
        cli.shape_of(cli.parser().parse_args(["closed", "--train", str(folder / "train")]))
    shape = cli.shape_of(cli.parser().parse_args(["sgd", "mnist", "--train", "x", "--n", "7"]))
    assert shape == cli.Shape(7, 10_000, 784, 10, 255.0)


def test_a_fold_over_no_rows_keeps_its_state(spark):
    state = fold.State.zero(2, 1)
    empty = spark.createDataFrame([], "position long, features array<double>, label int")
    got = fold.run_fold(empty, state, fold.Steps(), 1)
    assert got.t == 0 and not got.weights.any()


def test_training_on_a_generated_matrix_by_its_path(spark, files, capsys):
    folder, x, y = files
    cli.main(_arguments(folder, "generate", "--kernel", "linear", "--reg", "0.3", "--simulated", "--out", str(folder / "whole")))
    row = spark.read.parquet(str(folder / "whole")).filter("row_id = 5").first()
    assert np.allclose(row.features, x[:90] @ x[5] + 0.3 * (np.arange(90) == 5))
    cli.main(["closed", "--memId", str(folder / "whole"), "--k", "3", "--out", str(folder / "dual")])
    assert float(capsys.readouterr().out.split()[-1]) > 0.8
    dual = np.zeros((90, 3))
    for r in spark.read.parquet(str(folder / "dual")).collect():
        dual[r.j, r.c] = r.w
    k = x[:90] @ x[:90].T + 0.3 * np.eye(90)
    assert np.allclose(k @ dual, np.eye(3)[y[:90]], atol=1e-5)
    with pytest.raises(SystemExit, match="no matrix"):
        cli.main(["closed", "--memId", str(folder / "nowhere")])
    with pytest.raises(SystemExit, match="--train"):
        cli.main(["closed", "--n", "3", "--d", "2"])


def test_blocks_are_streamed(spark, files, capsys):
    folder, x, y = files
    common = ["--epochs", "2", "--eta0", "0.01", "--buffer", "0.001", "--logfreq", "1"]
    cli.main(_arguments(folder, "ssgd", *common, "--no-simulated", "--no-shuffle-on-disk", "--log", str(folder / "stream_log"), "--out", str(folder / "streamed")))
    cli.main(_arguments(folder, "ssgd", *common, "--no-shuffle-on-disk", "--out", str(folder / "folded")))
    streamed, folded = ({(r.j, r.c): r.w for r in spark.read.parquet(str(folder / n)).collect()} for n in ("streamed", "folded"))
    assert all(abs(streamed[k] - folded[k]) < 1e-9 for k in folded)
    log = spark.read.csv(str(folder / "stream_log"), header=True, inferSchema=True).orderBy("i").collect()
    assert [r.i for r in log] == [24, 49, 74, 89, 114, 139, 164, 179]


def test_element_types_and_targets(spark, files, tmp_path):
    folder, x, y = files
    np.column_stack((x[90:], y[90:])).astype("float32").tofile(tmp_path / "test32")
    arguments = ["closed", "--train", str(folder / "train"), "--test", str(tmp_path / "test32"), "--n", "90", "--nt", "30", "--d", "4", "--tst-dtype", "float32", "--no-one-hot"]
    model = cli.train(spark, cli.parser().parse_args(arguments))
    assert model.weights.shape == (4, 1) and np.allclose(model.weights[:, 0], np.linalg.solve(x[:90].T @ x[:90] + 0.1 * np.eye(4), x[:90].T @ y[:90]))
    _, test, _ = cli.load(spark, cli.parser().parse_args(arguments))
    assert np.allclose([r.features for r in test.orderBy("row_id").collect()], x[90:], atol=1e-6)
    with pytest.raises(SystemExit, match="--one-hot"):
        cli.shape_of(cli.parser().parse_args(["closed", "--train", "x", "--n", "3", "--d", "2", "--k", "1", "--one-hot"]))


def test_batches_are_brought_in(spark, tmp_path):
    images, labels = np.arange(24, dtype=np.uint8).reshape(3, 2, 4), np.array([7, 0, 9], np.uint8)
    for name, a in (("x", images), ("y", labels)):
        (tmp_path / name).write_bytes(bytes([0, 0, 8, a.ndim]) + np.array(a.shape, ">i4").tobytes() + a.tobytes())
    x, y = str(tmp_path / "x"), str(tmp_path / "y")
    cli.main(["import", "--images", x, x, "--labels", y, y, "--out", str(tmp_path / "out")])
    assert [r.label for r in spark.read.parquet(str(tmp_path / "out")).orderBy("row_id").collect()] == [7, 0, 9, 7, 0, 9]
