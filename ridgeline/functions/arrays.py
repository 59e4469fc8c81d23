"""Column functions over feature arrays. All are built-in expressions, so scans stay pruned and nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def features_of(packed: Column) -> Column:
    """All but the last element, as doubles: the features of a row that carries its label last."""
    return as_double(F.slice(packed, F.lit(1), F.size(packed) - 1))


def label_of(packed: Column) -> Column:
    """The last element, truncated to int."""
    return F.element_at(packed, -1).cast("int")


def as_double(array: Column) -> Column:
    return F.transform(array, lambda x: x.cast("double"))


def scale(array: Column, divisor: float) -> Column:
    return F.transform(array, lambda x: x / F.lit(float(divisor)))


def one_hot(label: Column, classes: int) -> Column:
    """classes entries of 0 and 1, always as many as classes; a label outside of them gives zeros, one class keeps the label as a number."""
    if classes == 1:
        return F.array(label.cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: (c == label).cast("int"))


def argmax(array: Column) -> Column:
    """Place of the largest element from 0, the first of ties; null for null."""
    return (F.array_position(array, F.array_max(array)) - 1).cast("int")


def above_half(score: Column) -> Column:
    return F.when(score > 0.5, 1).otherwise(0)


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_norm(a: Column) -> Column:
    return total(F.transform(a, lambda x: x * x))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def learning_rate(t: Column, eta0: float, damp: float, step: int) -> Column:
    return F.lit(float(eta0)) * F.pow(F.lit(float(damp)), F.floor(t / F.lit(step)).cast("double"))


def logged(t: Column, every: int) -> Column:
    """Whether iteration t is logged; every = 0 logs nothing."""
    return F.lit(False) if every == 0 else t % every == 0


def block_of(row_id: Column, rows_per_block: int) -> Column:
    return F.floor(row_id / F.lit(rows_per_block)).cast("long")


#: Bytes of the element types.
BYTES = {"bool_": 1, "int8": 1, "uint8": 1, "int16": 2, "uint16": 2, "float16": 2, "int32": 4, "uint32": 4, "float32": 4, "int64": 8, "uint64": 8, "float64": 8, "int_": 8, "float_": 8}


def element_bytes(dtype: str) -> int:
    """Bytes of an element, of the types above or of a type code with its size, such as >i4."""
    if dtype in BYTES:
        return BYTES[dtype]
    if len(dtype) == 3 and dtype[0] in "<>" and dtype[1] in "iuf" and dtype[2] in "248":
        return int(dtype[2])
    raise ValueError(f"no size known for {dtype}")


def rows_per_block(megabytes: float, features: int, rows: int, width: int = 8) -> int:
    """Rows that a memory budget holds, at the width they have in memory; one at least."""
    return max(1, min(int(megabytes * 1e6 // ((features + 1) * width)), rows))
