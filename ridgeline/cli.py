"""Command line: train, make kernel matrices, bring IDX files in. `python -m ridgeline --help`."""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import arrays
from ridgeline.operators.fold import Steps
from ridgeline.operators.kernel import KERNELS, TILE_ROWS
from ridgeline.operators.shuffle import SHUFFLES
from ridgeline.plans.ridge import ALGORITHMS, Model, Ridge, kernel_matrix
from ridgeline.sources import logs, matrix
from ridgeline.streaming.ssgd import weights_frame

_LOG = logging.getLogger("ridgeline")


@dataclass(frozen=True)
class Shape:
    """Rows to train and to test on, features, classes, and what features are divided by."""

    n: int
    nt: int
    d: int
    k: int
    divisor: float = 1.0


#: Shapes of the data sets that are known by name.
SHAPES = {"mnist": Shape(60_000, 10_000, 784, 10, 255.0), "spam": Shape(2760, 690, 55, 1), "cifar-10": Shape(50_000, 10_000, 3072, 10, 255.0)}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="ridgeline", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    data = argparse.ArgumentParser(add_help=False)
    data.add_argument("dataset", nargs="?", choices=[*SHAPES, "custom"], default="custom", help="a known shape, or custom with --n --d --nt --k")
    data.add_argument("--train", help="matrix to train on: Parquet (row_id, features, label) or a headerless binary file")
    data.add_argument("--test", help="matrix to test on")
    data.add_argument("--format", choices=["binary", "parquet"], default="binary")
    data.add_argument("--dtype", default="float64", help="element type of binary files")
    data.add_argument("--trn-dtype", help="element type of the file to train on, if another")
    data.add_argument("--tst-dtype", help="element type of the file to test on, if another")
    data.add_argument("--one-hot", action=argparse.BooleanOptionalAction, help="a target for each of k classes, or the label itself as one target; by default classes if k is above 1")
    for name in ("n", "nt", "d", "k"):
        data.add_argument(f"--{name}", type=int)
    data.add_argument("--subset", type=int, default=0, help="train on so many first rows; 0: all")
    data.add_argument("--reg", type=float, default=0.1)
    data.add_argument("--buffer", type=float, default=30.0, help="megabytes of a block")
    data.add_argument("--out", help="where the weights or the kernel matrix go, as Parquet")
    for name in ALGORITHMS:
        command = commands.add_parser(name, parents=[data], help=f"train by {ALGORITHMS[name].__name__}")
        command.add_argument("--loss", choices=["ridge"], default="ridge")
        command.add_argument("--memId", help="train on this matrix of `generate` instead (Parquet), with a ridge weight of 0, since it holds one, and without scaling")
        command.add_argument("--log", help="folder of the training log, as CSV")
        if name == "closed":
            continue
        command.add_argument("--eta0", type=float, default=1e-6)
        command.add_argument("--damp", type=float, default=0.99)
        command.add_argument("--step", type=int, default=10_000)
        command.add_argument("--logfreq", type=int, default=1000, help="log every so many iterations; 0: never")
        if name == "gd":
            command.add_argument("--iters", type=int, default=5000)
            continue
        command.add_argument("--momentum", type=float, default=0.9)
        command.add_argument("--seed", type=int, default=0)
        if name == "hsgd":
            command.add_argument("--nthreads", type=int, default=8, help="parts that are folded apart")
            continue
        command.add_argument("--epochs", type=int, default=3)
        command.add_argument("--algo", choices=list(SHUFFLES), default="external" if name == "ssgd" else "block_local", help="shuffle of every epoch")
        if name == "ssgd":
            command.add_argument("--shuffle-on-disk", action=argparse.BooleanOptionalAction, default=True, help="shuffle every epoch by --algo, or take blocks as they are stored")
            command.add_argument("--simulated", action=argparse.BooleanOptionalAction, default=True, help="fold the table and log on all of it, or write blocks, stream them and log on the current block")
    generate = commands.add_parser("generate", parents=[data], help="K + reg I with labels, a matrix to train on with --format parquet --reg 0")
    generate.add_argument("--kernel", choices=list(KERNELS), default="rbf")
    generate.add_argument("--sigma", type=float, default=1.0)
    generate.add_argument("--simulated", action="store_true", help="all pairs at once, as one tile, not tile by tile")
    bring = commands.add_parser("import", help="a pair of IDX files to Parquet")
    bring.add_argument("--images", required=True, nargs="+", help="one file or several batches, whose rows follow each other")
    bring.add_argument("--labels", required=True, nargs="+")
    bring.add_argument("--out", required=True)
    return out


def shape_of(options: argparse.Namespace, train: DataFrame | None = None) -> Shape:
    """The named shape, with what the options say otherwise; of Parquet, rows and features are read from the matrix."""
    known = SHAPES.get(options.dataset)
    values = {f: getattr(options, f) if getattr(options, f) is not None else (getattr(known, f) if known else None) for f in ("n", "nt", "d", "k")}
    if train is not None:
        values["n"] = train.count() if values["n"] is None else values["n"]
        values["d"] = (train.agg(F.max(F.size("features"))).first()[0] or 0) if values["d"] is None else values["d"]
    values["k"] = 10 if values["k"] is None else values["k"]
    if options.one_hot is False:
        values["k"] = 1
    elif options.one_hot and values["k"] == 1:
        raise SystemExit("ridgeline: --one-hot needs --k above 1")
    if values["n"] is None or values["d"] is None:
        raise SystemExit("ridgeline: binary files need --n and --d")
    if options.format == "binary" and options.test and values["nt"] is None:
        raise SystemExit("ridgeline: --test needs --nt")
    return Shape(values["n"], values["nt"] or 0, values["d"], values["k"], known.divisor if known else 1.0)


def load(spark: SparkSession, options: argparse.Namespace) -> tuple[DataFrame, DataFrame | None, Shape]:
    """Train and test matrix, scaled, and their shape. The subset is of the rows to train on."""
    if memory := getattr(options, "memId", None):
        found = matrix.reopen(spark, memory)
        if found is None:
            raise SystemExit(f"ridgeline: there is no matrix at {memory}")
        options.n = options.d = None
        known = shape_of(argparse.Namespace(**{**vars(options), "format": "parquet"}), found)
        return matrix.first_rows(found, options.subset), None, Shape(known.n, 0, known.d, known.k)
    if not options.train:
        raise SystemExit("ridgeline: --train is needed")
    if options.format == "parquet":
        train, test = spark.read.parquet(options.train), spark.read.parquet(options.test) if options.test else None
        shape = shape_of(options, train)
    else:
        shape = shape_of(options)
        read = lambda path, n, kind: matrix.read_dense(spark, path, n, shape.d, kind or options.dtype, arrays.rows_per_block(options.buffer, shape.d, n))
        train, test = read(options.train, shape.n, options.trn_dtype), read(options.test, shape.nt, options.tst_dtype) if options.test else None
    scaled = lambda m: m if shape.divisor == 1.0 else m.withColumn("features", arrays.scale(F.col("features"), shape.divisor))
    return scaled(matrix.first_rows(train, options.subset)), scaled(test) if test is not None else None, shape


def train(spark: SparkSession, options: argparse.Namespace) -> Model:
    rows, test, shape = load(spark, options)
    reg = 0.0 if options.memId else options.reg
    named = {"features": shape.d, "classes": shape.k, "loss": Ridge(reg)}
    size = arrays.rows_per_block(options.buffer, shape.d, max(1, shape.n))
    if options.command != "closed":
        named["steps"] = Steps(options.eta0, options.damp, options.step, getattr(options, "momentum", 0.0), reg, options.logfreq)
    if options.command == "gd":
        named["iterations"] = options.iters
    elif options.command == "hsgd":
        named |= {"parts": options.nthreads, "seed": options.seed}
    elif options.command in ("sgd", "ssgd"):
        how = options.algo if options.command == "sgd" or options.shuffle_on_disk else "none"
        named |= {"epochs": options.epochs, "shuffle": how, "seed": options.seed, "rows_per_block": size}
    algorithm = ALGORITHMS[options.command](**named)
    model = algorithm.fit(rows, test) if getattr(options, "simulated", True) else algorithm.stream(rows)
    print(f"Train: {model.accuracy(rows)}" + (f" Test: {model.accuracy(test)}" if test is not None else ""))
    if options.out:
        weights_frame(spark, model.weights).coalesce(1).write.mode("overwrite").parquet(options.out)
    if options.log:
        logs.write_log(spark, algorithm.logger.rows, options.log)
    return model


def main(arguments: list[str] | None = None) -> None:
    options = parser().parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    if options.command == "generate" and not options.out:
        raise SystemExit("ridgeline: generate needs --out")
    spark = SparkSession.builder.appName("ridgeline").getOrCreate()
    if options.command == "import":
        matrix.save(matrix.read_idx(spark, options.images, options.labels), options.out)
    elif options.command == "generate":
        rows, _, shape = load(spark, options)
        matrix.save(kernel_matrix(rows, options.kernel, options.sigma, options.reg, max(1, shape.n) if options.simulated else TILE_ROWS), options.out)
    else:
        train(spark, options)
