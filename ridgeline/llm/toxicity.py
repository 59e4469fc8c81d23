"""Toxicity: two class-conditional Kneser-Ney models over words and pairs of words, compared by the log-likelihood ratio of a text's strongest expression for its length."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ridgeline.llm import _text, langid
from ridgeline.llm._store import materialize, tidied

#: Most documents and about the most words of documents in a group whose words are packed together, and cells that a task holds before it hands on what it has.
GROUP_ROWS, GROUP_WORDS, HELD = 1 << 16, 1 << 21, 1 << 22
#: Part of the training rows that calibrates instead of being counted, and the most rows that the calibration is fitted on.
CALIBRATION_PARTS, CALIBRATION_ROWS = 5, 50_000


@lru_cache(maxsize=1)
def _unspaced() -> np.ndarray:
    """Code points of scripts that put no spaces between words."""
    out = np.zeros(0x110000, bool)
    for low, high in ((0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3040, 0x3100), (0x3400, 0xA000), (0xF900, 0xFB00), (0x20000, 0x40000)):
        out[low:high] = True
    return out


def words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of a column: rows of the slice, its code points in lower case (0 for what is no letter), and row, hash, start and end of every word in them.

    A word is a run of letters; in scripts without spaces each letter with the one before it. Whole code points take part, nothing is folded onto fewer symbols.
    """
    raw, at = _text.utf8(column)
    for first, last in _text.slices(at, 1 << 20):
        part, bounds = raw[at[first] : at[last]], at[first : last + 1] - at[first]
        ends = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))[bounds]
        points = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        letters, single = langid._alphabet()[points], _unspaced()[points]
        some, new = letters > 0, np.zeros(len(points) + 1, bool)
        new[ends] = True
        joins = np.zeros(len(points) + 1, bool)  # a letter in one word with the letter before it
        joins[1:-1] = some[1:] & some[:-1] & ~new[1:-1] & ~single[1:] & ~single[:-1]
        starts, stops = np.flatnonzero(some & ~joins[:-1]), np.flatnonzero(some & ~joins[1:]) + 1
        back = np.zeros(len(points), bool)
        back[1:] = some[1:] & some[:-1] & single[1:] & single[:-1] & ~new[1:-1]
        row = np.searchsorted(ends, starts, "right") - 1
        starts = starts - back[starts]
        yield last - first, letters, row, _text.signed(_text.span_hashes(letters.view(np.uint8), 4 * starts, 4 * stops)), starts, stops


def _once(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of each key of each row once, in the order of rows and keys."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return order[new]


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of pairs from the hashes of their words; the order counts, and the mixing is not linear."""
    with np.errstate(over="ignore"):
        x = first.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) + second.view(np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return (x ^ (x >> np.uint64(31))).view(np.int64)


def _expressions(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]]:
    """For slices of a column: rows of the slice, row and hash of each word of each of them once, and row, hash, first and second word of each pair of neighbours once."""
    for n, _, row, key, _, _ in words(column):
        one = _once(row, key)
        at = np.flatnonzero(row[1:] == row[:-1])
        pair = pair_keys(key[at], key[at + 1])
        two = _once(row[at], pair)
        at = at[two]
        yield n, row[one], key[one], (row[at], pair[two], key[at], key[at + 1])


#: An expression: a word and the word after it, or null for the word by itself.
COUNTED = "first long, second long, n0 long, n1 long"


def _gather(pairs: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, double, held = ([], []), ([], [], [], []), 0
        for batch in batches:
            label, done = batch.column(0).to_numpy(zero_copy_only=False), 0
            for n, row, key, (row2, *names) in _expressions(batch.column(1)):
                for to, x in zip(single, (label[done : done + n][row], key), strict=True):
                    to.append(x)
                if pairs:
                    for to, x in zip(double, (label[done : done + n][row2], *names), strict=True):
                        to.append(x)
                done += n
                held += len(key) + pairs * len(row2)
                if held >= GROUP_WORDS:
                    yield from _counted(*single)
                    yield from _counted(*double)
                    single, double, held = ([], []), ([], [], [], []), 0
        yield from _counted(*single)
        yield from _counted(*double)

    return run


def _counted(labels: list, keys: list, *parts: list) -> Iterator[pa.RecordBatch]:
    if keys:
        key, at, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        toxic = np.bincount(place, np.concatenate(labels), len(key)).astype(np.int64)
        whole = np.bincount(place, minlength=len(key))
        first, second = [np.concatenate(x)[at] for x in parts] or (key, None)
        order = np.arange(len(key)) if second is None else np.lexsort((second, first))  # runs of a first word are stored in little space
        for low in range(0, len(key), 1 << 16):
            part = order[low : low + (1 << 16)]
            other = pa.nulls(len(part), pa.int64()) if second is None else pa.array(second[part])
            yield pa.RecordBatch.from_arrays([pa.array(first[part]), other, pa.array((whole - toxic)[part]), pa.array(toxic[part])], names=["first", "second", "n0", "n1"])


def _count(labelled: DataFrame, pairs: bool) -> DataFrame:
    """A row for each word: key, n0, n1, and of the pairs that it begins: known (by how many classes each is known, in all), kinds, for each class total, kinds and how many are counted 1 to 4 times, and those that the toxic class knows."""
    gathered = labelled.select((F.col("toxic") > 0).cast("int"), "text").mapInArrow(_gather(pairs), COUNTED)
    # one exchange, by the first word, serves both sums
    each = gathered.repartition("first").groupBy("first", "second").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    pair = F.col("second").isNotNull()
    number = lambda which: F.sum((pair & which).cast("long"))
    facts = [F.max(F.when(~pair, F.col(c))).alias(c) for c in ("n0", "n1")] + [number(F.lit(True)).alias("kinds"), (number(F.col("n0") > 0) + number(F.col("n1") > 0)).alias("known")]
    for c in ("n0", "n1"):
        facts += [F.sum(F.when(pair, F.col(c)).otherwise(0)).alias(f"{c}_total"), number(F.col(c) > 0).alias(f"{c}_kinds"), *[number(F.col(c) == k).alias(f"{c}_{k}") for k in (1, 2, 3, 4)]]
    facts.append(F.collect_list(F.when(pair & (F.col("n1") > 0), F.struct("second", F.col("n0").alias("m0"), F.col("n1").alias("m1")))).alias("toxic"))
    return materialize(each.groupBy(F.col("first").alias("key")).agg(*facts))


def fit(labelled: DataFrame) -> DataFrame:
    """key, n0, n1 from labelled (text and toxic 0/1, one row per document): in how many documents of each class a word stands. All words of all texts are counted; the table grows with them and stays one."""
    return _count(labelled, False).select("key", "n0", "n1")


def fit_both(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What fit gives, and what _count tells of the pairs of neighbouring words, all of which are counted, in one pass."""
    both = _count(labelled, True)
    return both.select("key", "n0", "n1"), both


@dataclass(frozen=True)
class Smoothing:
    """What smooths a class: its sum of counts, the discounts of counts 1, 2 and more, and the mass that they free for the shared counts."""

    total: float
    discounts: tuple[float, float, float]
    free: float


def smoothing(total: float, of: list[float], kinds: float) -> Smoothing:
    """Modified Kneser-Ney discounts from the numbers of expressions counted 1, 2, 3 and 4 times, `of`, among kinds; half the count where these tell nothing."""
    rate = of[0] / (of[0] + 2 * of[1]) if of[0] and of[1] else 0.75
    d = [min(k, max(0.0, k - (k + 1) * rate * of[k] / of[k - 1])) if of[k - 1] else k / 2 for k in (1, 2, 3)]
    more = kinds - of[0] - of[1]
    return Smoothing(total, tuple(d), (d[0] * of[0] + d[1] * of[1] + d[2] * more) / total if total else 0.0)


@dataclass(frozen=True)
class Model:
    """p(expression | class) = (count - discount) / total + free * p(expression). The last one is the same for both classes: as lower orders of Kneser-Ney do, it counts contexts, here the classes that know the expression, plus one, among those of all expressions and one for what was never met."""

    classes: tuple[Smoothing, Smoothing]
    contexts: int  # of all expressions, one more for each of them and for what was never met

    @property
    def unseen(self) -> float:
        """The log ratio of an expression that neither class has met: nothing is known of it but what each class leaves free."""
        ordinary, toxic = self.classes
        return log(toxic.free / ordinary.free) if ordinary.free > 0 and toxic.free > 0 else 0.0

    @property
    def learned(self) -> bool:
        return all(c.total > 0 and c.free > 0 for c in self.classes)

    def shared(self, n0: Column, n1: Column) -> Column:
        return ((n0 > 0).cast("int") + (n1 > 0).cast("int") + 1) / F.lit(float(self.contexts))

    def probability(self, label: int, n0: Column, n1: Column) -> Column:
        c, n = self.classes[label], (n0, n1)[label]
        d = F.when(n == 0, 0.0).when(n == 1, c.discounts[0]).when(n == 2, c.discounts[1]).otherwise(c.discounts[2])
        return (n - d) / F.lit(float(c.total)) + F.lit(c.free) * self.shared(n0, n1)


def estimate(counts: DataFrame) -> Model:
    """Both classes' models from counts (key, n0, n1), by one aggregate of it."""
    number = lambda which: F.sum(which.cast("long"))
    facts = [F.count("*").alias("kinds")]
    for c in ("n0", "n1"):
        facts += [F.sum(c).alias(f"{c}_total"), number(F.col(c) > 0).alias(f"{c}_kinds"), *[number(F.col(c) == k).alias(f"{c}_{k}") for k in (1, 2, 3, 4)]]
    r = counts.agg(*facts).first()
    return Model(tuple(smoothing(float(r[f"{c}_total"] or 0), [float(r[f"{c}_{k}"] or 0) for k in (1, 2, 3, 4)], float(r[f"{c}_kinds"] or 0)) for c in ("n0", "n1")), (r["n0_kinds"] or 0) + (r["n1_kinds"] or 0) + r["kinds"] + 1)


def evidence(counts: DataFrame, model: Model) -> DataFrame:
    """key, evidence (log p(expression | toxic) - log p(expression | ordinary)) of those expressions of counts that speak more for class 1 than an unseen one. No other can be a text's strongest."""
    if not model.learned:
        return counts.select("key", F.lit(0.0).cast("float").alias("evidence")).limit(0)
    ratio = F.log(model.probability(1, F.col("n0"), F.col("n1"))) - F.log(model.probability(0, F.col("n0"), F.col("n1")))
    return counts.select("key", ratio.cast("float").alias("evidence")).filter(F.col("evidence") > model.unseen)


#: Discount of the orders that both classes share, whose counts are 1 or 2: the classes that know a pair.
SHARED_DISCOUNT = 0.5


def pair_evidence(contexts: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """key, evidence of those pairs of words that speak more for class 1 than either of their words and than an unseen one.

    The second word is judged given the first: p(second | first, class) = (count - discount) / total + free * p(second | first), the last two of the first word in that class. As lower orders of Kneser-Ney do, p(second | first)
    is the same for both classes and counts contexts, here the classes that know the pair, discounted, and below that the classes that know the second word. free differs between the classes for any second word at all, as they are not equally large, so
    the evidence is the log ratio beyond that of a second word that neither class has met after the first. That of the first word is added, and the sum divided by the two words.
    """
    sums = [F.sum(f"{c}_{x}").alias(f"{c}_{x}") for c in ("n0", "n1") for x in ("total", "kinds", 1, 2, 3, 4)]
    r = contexts.agg(*sums).first()
    if not model.learned or not r["n1_total"]:
        return contexts.select("key", F.lit(0.0).cast("float").alias("evidence")).limit(0)
    discounts = [smoothing(float(r[f"{c}_total"]), [float(r[f"{c}_{k}"]) for k in (1, 2, 3, 4)], float(r[f"{c}_kinds"])).discounts for c in ("n0", "n1")]
    cut = lambda n, d: F.when(n == 0, 0.0).when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])
    freed = [F.col(f"{c}_1") * d[0] + F.col(f"{c}_2") * d[1] + (F.col(f"{c}_kinds") - F.col(f"{c}_1") - F.col(f"{c}_2")) * d[2] for c, d in zip(("n0", "n1"), discounts, strict=True)]
    ratio = lambda n0, n1: F.log(model.probability(1, F.col(n0), F.col(n1))) - F.log(model.probability(0, F.col(n0), F.col(n1)))
    begun = contexts.filter(F.size("toxic") > 0).select(F.col("key").alias("first"), ratio("n0", "n1").alias("one"), "kinds", "known", freed[0].alias("freed0"), freed[1].alias("freed1"), F.explode("toxic").alias("p"))
    met = begun.select("first", "one", "kinds", "known", "freed0", "freed1", "p.*").join(counts.withColumnRenamed("key", "second"), "second")
    classes = (F.col("m0") > 0).cast("int") + (F.col("m1") > 0).cast("int")
    shared = (classes - SHARED_DISCOUNT + SHARED_DISCOUNT * F.col("kinds") * model.shared(F.col("n0"), F.col("n1"))) / F.col("known")
    # log((m - d) / total + free * shared) - log(free * shared), where free = freed / total; half a count is free at least
    beyond = [F.when(F.col(f"m{c}") > 0, F.log1p((F.col(f"m{c}") - cut(F.col(f"m{c}"), discounts[c])) / F.greatest(F.col(f"freed{c}"), F.lit(SHARED_DISCOUNT)) / shared)).otherwise(0.0) for c in range(2)]
    out = met.select("first", "second", ((F.col("one") + beyond[1] - beyond[0]) / 2).cast("float").alias("evidence"), F.greatest(F.col("one"), ratio("n0", "n1"), F.lit(model.unseen)).alias("least"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(pair_keys(*(batch.column(i).to_numpy() for i in range(2)))), batch.column(2)], names=["key", "evidence"])

    return out.filter(F.col("evidence") > F.col("least")).select("first", "second", "evidence").mapInArrow(named, "key long, evidence float")


#: Bits of the filter that keeps pairs of no evidence from being shuffled; its size is fixed, so the more such pairs there are, the more others pass it.
SIEVE_BITS = 23


def _sieve(known: DataFrame) -> np.ndarray:
    """Bits of the keys of known, from a part of them by each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << SIEVE_BITS, bool)
        for batch in batches:
            bits[_sieve_place(batch.column(0).to_numpy())] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    bits = np.zeros(1 << SIEVE_BITS, bool)
    for r in known.select("key").coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        bits |= np.unpackbits(np.frombuffer(r.bits, np.uint8)).astype(bool)
    return bits


def _sieve_place(key: np.ndarray) -> np.ndarray:
    return (key.view(np.uint64) >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)


def _packed(kind: pa.DataType, sieve=None):
    """Groups of documents: a row with the number of distinct words of each of them, and a row for each word with the places of the documents that hold it. With a broadcast sieve also for each pair of words that passes it."""
    names = ["key", "group", "places", "doc_id", "words"]
    shapes = [pa.int64(), pa.int64(), pa.binary(), pa.list_(kind), pa.list_(pa.int64())]

    def flush(group: int, ids: list, rows: int, places: list, keys: list, places2: list, keys2: list) -> Iterator[pa.RecordBatch]:
        place = np.concatenate(places)
        base = [[None], [group], [None], [pa.chunked_array(ids, kind).to_pylist()], [np.bincount(place, minlength=rows)]]
        place, key = np.concatenate([place, *places2]), np.concatenate([*keys, *keys2])
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(base, shapes, strict=True)], names=names)
        order = np.argsort(key, kind="stable")
        place, key = place[order].astype(np.uint16), key[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(key))
        for low in range(0, len(starts), 1 << 15):
            a, b = starts[low : low + (1 << 15)], ends[low : low + (1 << 15)]
            offsets = (2 * np.append(a, b[-1:]) - 2 * a[0]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(place[a[0] : b[-1]].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(key[a]), pa.array(np.full(len(a), group)), packed, *(pa.nulls(len(a), t) for t in shapes[3:])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, held, parts = TaskContext.get().partitionId() << 32, 0, 0, ([], [], [], [], [])
        for batch in batches:
            for low in range(0, batch.num_rows, GROUP_ROWS // 64):
                piece = batch.slice(low, GROUP_ROWS // 64)
                if rows and (held >= GROUP_WORDS or rows + piece.num_rows > GROUP_ROWS):
                    yield from flush(group, parts[0], rows, *parts[1:])
                    group, rows, held, parts = group + 1, 0, 0, ([], [], [], [], [])
                parts[0].append(piece.column(0))
                for n, row, key, (row2, key2, *_) in _expressions(piece.column(1)):
                    parts[1].append((row + rows).astype(np.int32))
                    parts[2].append(key)
                    if sieve is not None:
                        some = sieve.value[_sieve_place(key2)]
                        parts[3].append((row2[some] + rows).astype(np.int32))
                        parts[4].append(key2[some])
                        held += len(parts[4][-1])
                    rows += n
                    held += len(key)
            _text.release()
        if rows:
            yield from flush(group, parts[0], rows, *parts[1:])

    return run


def _strongest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents as they are; of the others, for each group the strongest evidence that this task has met for each of its documents."""
    best: dict[int, np.ndarray] = {}

    def flush(like: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for group, found in best.items():
            some = np.flatnonzero(found > LEAST)
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([some.astype(np.uint16).tobytes()], pa.binary()), pa.array([found[some].tobytes()], pa.binary()), *(pa.nulls(1, x.type) for x in like.columns[3:])], names=[*FOUND, *like.schema.names[3:]])
        best.clear()

    like = None
    for batch in batches:
        like = batch
        base = batch.column(2).is_null()
        if (some := batch.filter(base)).num_rows:
            nothing = pa.nulls(some.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([some.column(0), nothing, nothing, *some.columns[3:]], names=[*FOUND, *batch.schema.names[3:]])
        rest = batch.filter(pc.invert(base))
        group, evidence = rest.column(0).to_numpy(), rest.column(2).to_numpy()
        raw, at = _bytes(rest.column(1))
        places, number = raw.view(np.uint16), np.diff(at) // 2
        of, weight = np.repeat(group, number), np.repeat(evidence, number)
        for g in np.unique(group):
            mine = of == g
            found = best.setdefault(int(g), np.full(GROUP_ROWS, LEAST, np.float32))
            np.maximum.at(found, places[mine], weight[mine])
        if len(best) * GROUP_ROWS > HELD:
            yield from flush(like)
    if like is not None:
        yield from flush(like)


FOUND = ("group", "places", "evidence")
#: Below any evidence.
LEAST = np.float32(-1e30)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].copy() if len(column) and at[-1] > at[0] else np.zeros(0, np.uint8), at - at[0]


def _joined(unseen: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document of each group, with the strongest evidence of all tasks. Rows come sorted by group, its documents first, so one group is held at a time."""
        columns, best = None, None

        def rows():
            return pa.RecordBatch.from_arrays([*columns, pa.array(best.astype(float))], names=["doc_id", "words", "strongest"])

        for batch in batches:
            for i, (places, evidence) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if places is None:
                    if columns is not None:
                        yield rows()
                    columns = [x.slice(i, 1).flatten() for x in batch.columns[3:]]
                    best = np.full(len(columns[0]), unseen, np.float32)
                else:
                    at = np.frombuffer(places, np.uint16)
                    best[at] = np.maximum(best[at], np.frombuffer(evidence, np.float32))
        if columns is not None:
            yield rows()

    return run


def strongest(docs: DataFrame, known: DataFrame, unseen: float = 0.0, pairs: DataFrame | None = None) -> DataFrame:
    """doc_id, words (the number of distinct ones) and strongest, the most evidence of known (key, evidence) among a document's words, and of pairs (likewise) among its pairs of neighbours; unseen, if it holds none.

    Words meet the table by key, each once for a group of documents that hold it; neither side is broadcast unless Spark finds it small. A word that is
    nearly everywhere has as many rows as there are groups, and the maximum needs no order.
    """
    kind = docs.schema["doc_id"].dataType
    lists = f"doc_id array<{kind.simpleString()}>, words array<long>"
    sieve = docs.sparkSession.sparkContext.broadcast(_sieve(pairs)) if pairs is not None else None
    known = known.unionByName(pairs) if pairs is not None else known
    packed = docs.select("doc_id", "text").mapInArrow(_packed(to_arrow_type(kind), sieve), f"key long, group long, places binary, {lists}")
    # a row of documents has no key of its own: one by its group sends these rows to different tasks
    base = F.col("key").isNull()
    packed = packed.withColumn("base", base).withColumn("key", F.coalesce("key", F.xxhash64("group")))
    met = packed.join(known, "key", "left").filter(F.col("base") | F.col("evidence").isNotNull())
    met = met.select("group", "places", F.when(~F.col("base"), F.col("evidence")).alias("evidence"), "doc_id", "words")
    found = met.mapInArrow(_strongest, f"group long, places binary, evidence binary, {lists}")
    return found.repartition("group").sortWithinPartitions("group", F.col("places").isNotNull()).mapInArrow(_joined(unseen), f"doc_id {kind.simpleString()}, words long, strongest double")


def calibrate(features: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Logistic coefficients (intercept, then one for each feature) by Newton's method with a slight ridge. The classes weigh as the roots of their numbers of rows: half way between rare toxicity being called unlikely in advance and clean texts not mattering."""
    k = features.shape[1]
    if not 0 < label.sum() < len(label):
        return np.zeros(k + 1)
    middle, spread = features.mean(axis=0), np.maximum(features.std(axis=0), 1e-12)
    x = np.column_stack((np.ones(len(label)), (features - middle) / spread))
    weight = np.where(label == 1, label.mean(), 1 - label.mean()) ** -0.5
    w, ridge = np.zeros(k + 1), np.diag([1e-6, *[0.1] * k])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (label - p)) - ridge @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    slopes = w[1:] / spread
    return np.concatenate(([w[0] - slopes @ middle], slopes))


@tidied
def score(docs: DataFrame, labels: DataFrame, learn=lambda doc_id: F.lit(True)) -> DataFrame:
    """doc_id, score, words, strongest: one row per row of docs.

    Expressions are words and pairs of neighbouring words. Rare ones tell, and a text's mean over all its words dilutes them, so a text is judged by the log ratio of its strongest expression, and by its length, since the strongest of
    many words is large by chance. The words' counts are numbers of documents; in each class they are discounted, and what that frees goes to the counts that both classes share.

    learn(column of doc_id) tells which labelled documents may be learned from. Their labels are joined by doc_id; the text of other documents takes
    no part in that join. Of these, one part in CALIBRATION_PARTS is left out of the counts and calibrates the score. A document labelled both ways is
    toxic; a null label teaches nothing. Empty and null texts have no words and are judged as texts of none. Without labels of both classes every score is 0.5.
    """
    part = F.pmod(F.xxhash64(F.lit("calibration"), F.col("doc_id")), F.lit(CALIBRATION_PARTS))
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counted = docs.select("doc_id", "text").filter(learn(F.col("doc_id")) & (part != 0) & F.col("text").isNotNull())
    # by the same kind of join at any size: labels grow with the documents, so they are no table to broadcast
    counts, pairs = fit_both(counted.hint("merge").join(known.filter(part != 0), "doc_id"))
    model = estimate(counts)
    found = materialize(strongest(docs, evidence(counts, model), model.unseen, materialize(pair_evidence(pairs, counts, model))))
    held = found.join(known.filter(part == 0), "doc_id")
    share = CALIBRATION_ROWS / max(1, held.count())
    if share < 1:
        held = held.filter(F.pmod(F.xxhash64(F.lit("fit"), F.col("doc_id")), F.lit(1_000_000)) < int(1_000_000 * share))
    features = (F.col("strongest"), F.log1p("words"))
    rows = held.select(*[f.alias(f"f{i}") for i, f in enumerate(features)], "toxic").toArrow()
    w = calibrate(np.column_stack([rows[f"f{i}"].to_numpy().astype(float) for i in range(len(features))]), (rows["toxic"].to_numpy() > 0).astype(float))
    logit = F.lit(float(w[0])) + sum((F.lit(float(x)) * f for x, f in zip(w[2:], features[1:], strict=True)), F.lit(float(w[1])) * features[0])
    return found.select("doc_id", (1 / (1 + F.exp(-logit))).alias("score"), "words", "strongest")
