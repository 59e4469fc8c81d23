"""Labelled matrices: from tables, from headerless binary files, from IDX files; saving; blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ridgeline.functions import arrays
from ridgeline.sources import scratch

MATRIX = "row_id long, features array<double>, label int"


def labelled(df: DataFrame, row_id: str, features: Column, label: Column) -> DataFrame:
    """row_id, features, label. Rows of a DataFrame have no order, so every matrix carries its row numbers."""
    return df.select(F.col(row_id).cast("long").alias("row_id"), features.alias("features"), label.cast("int").alias("label"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return labelled(table, "vec_id", arrays.as_double(F.col("embedding")), F.col("label"))


def read_block(matrix: DataFrame, block: int, rows_per_block: int) -> DataFrame:
    """One block of consecutive rows; a range of row_id, which Parquet's statistics prune."""
    return matrix.filter((F.col("row_id") >= block * rows_per_block) & (F.col("row_id") < (block + 1) * rows_per_block))


def first_rows(matrix: DataFrame, subset: int) -> DataFrame:
    """The first subset rows; all if it is 0 or less."""
    return matrix.filter(F.col("row_id") < subset) if subset > 0 else matrix


def stack(*parts: DataFrame) -> DataFrame:
    """All rows of the parts, with the place of the part as `part`, so that their order is not lost."""
    out = parts[0].withColumn("part", F.lit(0))
    for i, part in enumerate(parts[1:], 1):
        out = out.unionByName(part.withColumn("part", F.lit(i)))
    return out


def save(matrix: DataFrame, path: str, rows_per_file: int = 0, element: str = "double") -> None:
    """Parquet, elements narrowed to `element`, cut in files of at most rows_per_file rows."""
    narrow = matrix.withColumn("features", F.transform("features", lambda x: x.cast(element)))
    writer = narrow.write.mode("overwrite")
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(path)


def save_blocks(matrix: DataFrame, path: str, rows_per_block: int) -> None:
    """Parquet, a folder for each block."""
    block = matrix.withColumn("block_id", arrays.block_of(F.col("row_id"), rows_per_block))
    block.repartition("block_id").write.mode("overwrite").partitionBy("block_id").parquet(path)


def reopen(spark: SparkSession, path: str) -> DataFrame | None:
    """A saved matrix, or None if there is none."""
    return spark.read.parquet(path) if scratch.exists(spark, path) else None


class DenseMatrixSource(DataSource):
    """`dense_matrix`: a row-major file of rows of features and a label.

    Options: path, dtype, n (rows), d (features), block (rows of a partition), header (bytes to skip), label ("last", or "none" for rows of features alone, whose label is null),
    first (number of the first row). The file has to be on a file system that every executor mounts.
    """

    @classmethod
    def name(cls) -> str:
        return "dense_matrix"

    def schema(self) -> str:
        return MATRIX

    def reader(self, schema) -> DataSourceReader:
        return DenseMatrixReader(self.options)


class _Rows(InputPartition):
    def __init__(self, first: int, count: int):
        self.first, self.count = first, count


class DenseMatrixReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.dtype = options["path"], options.get("dtype", "float64")
        self.n, self.d, self.block = int(options["n"]), int(options["d"]), int(options.get("block", "65536"))
        self.header, self.first, self.labelled = int(options.get("header", "0")), int(options.get("first", "0")), options.get("label", "last") == "last"

    def partitions(self):
        return [_Rows(i, min(self.block, self.n - i)) for i in range(0, self.n, self.block)]

    def read(self, partition):
        width = self.d + self.labelled
        offset = self.header + partition.first * width * arrays.element_bytes(self.dtype)
        values = np.fromfile(self.path, self.dtype, partition.count * width, offset=offset)
        if len(values) != partition.count * width:
            raise ValueError(f"{self.path} is shorter than {self.n} rows of {width}")
        rows = values.reshape(-1, width).astype(float)
        ids = np.arange(partition.first, partition.first + partition.count) + self.first
        ends = np.arange(len(rows) + 1, dtype=np.int32) * self.d
        features = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows[:, : self.d]).ravel()))
        label = pa.array(np.trunc(rows[:, -1]).astype(np.int32)) if self.labelled else pa.nulls(len(rows), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), features, label], names=["row_id", "features", "label"])


def read_dense(spark: SparkSession, path: str, n: int, d: int, dtype: str = "float64", block: int = 65536) -> DataFrame:
    spark.dataSource.register(DenseMatrixSource)
    return spark.read.format("dense_matrix").options(path=path, n=n, d=d, dtype=dtype, block=block).load()


#: Element types of IDX files by their code.
IDX_TYPES = {8: "uint8", 9: "int8", 11: ">i2", 12: ">i4", 13: ">f4", 14: ">f8"}


def idx_header(spark: SparkSession, path: str) -> tuple[str, tuple[int, ...], int]:
    """Element type, shape and size in bytes of the header of an IDX file."""
    start = scratch.read_bytes(spark, path, 4)
    if len(start) < 4 or start[:2] != b"\0\0" or start[2] not in IDX_TYPES:
        raise ValueError(f"{path} is no IDX file")
    size = 4 + 4 * start[3]
    head = scratch.read_bytes(spark, path, size)
    return IDX_TYPES[start[2]], tuple(np.frombuffer(head, ">i4", start[3], 4).tolist()), size


def read_idx(spark: SparkSession, images: str | list[str], labels: str | list[str]) -> DataFrame:
    """Pairs of IDX files as one matrix; several pairs follow each other, and row numbers go on from one to the next.

    Files are cut in ranges of rows that are read apart, so none has to fit in a row or in a task. Like `dense_matrix`, they have to be mounted by every executor.
    """
    images, labels = ([x] if isinstance(x, str) else list(x) for x in (images, labels))
    spark.dataSource.register(DenseMatrixSource)
    parts, first = [], 0
    for image, label in zip(images, labels, strict=True):
        (kind, shape, header), (label_kind, label_shape, label_header) = idx_header(spark, image), idx_header(spark, label)
        if shape[0] != label_shape[0]:
            raise ValueError(f"{image} has {shape[0]} rows, {label} has {label_shape[0]}")
        read = lambda path, d, kind, header, first=first, n=shape[0]: spark.read.format("dense_matrix").options(path=path, n=n, d=d, dtype=kind, header=header, label="none", first=first).load()
        x, y = read(image, int(np.prod(shape[1:])), kind, header), read(label, 1, label_kind, label_header)
        parts.append(x.select("row_id", "features").join(y.select("row_id", F.element_at("features", 1).cast("int").alias("label")), "row_id"))
        first += shape[0]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
