"""Approximate nearest neighbours with an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm._store import materialize, tidied

#: Least and most centroids of each half, between which their number grows until a mean cell is a shard; rows of the sample that they are
#: fitted on (drawn by a hash of vec_id); rounds of k-means.
CENTROIDS, MOST_CENTROIDS, SAMPLE_ROWS, ROUNDS = 64, 1024, 20_000, 10
#: Cells are visited until they hold this share of all rows, at any size. The test vectors are isotropic, the worst case of any such
#: index; with 0.5 the share of true neighbours found is 0.93 to 0.96 there. Vectors with structure need far less.
PROBE_SHARE = 0.5
#: Rows and queries that meet in one task at a time, about; cells beyond it are split.
SHARD_ROWS, SHARD_QUERIES = 8192, 2048
NEAREST = 20
FOUND = "query_id long, rank int, vec_id long, score double"


@dataclass(frozen=True)
class Index:
    """Codebooks of the two halves, and how the cells are laid out on shards: centroid pairs are cells, a cell lies on shards base to base + parts - 1; shards hold neighbouring cells, from low on."""

    first: np.ndarray
    second: np.ndarray
    sizes: np.ndarray  # by cell
    base: np.ndarray
    parts: np.ndarray
    low: np.ndarray  # by shard, and one more

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (array of double) of the rows that take part: not null, not zero, every component finite, vec_id not null."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector")).filter("vec_id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(finite & F.exists("vector", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    random = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    centres = x[random.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = nearest(x, centres)
        for c in range(len(centres)):
            if (own := near == c).any():
                centres[c] = x[own].mean(axis=0)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - 0.5 * (centres * centres).sum(axis=1), axis=1)


def codebooks(rows: DataFrame, dimension: int, number: int, centroids: int) -> tuple[np.ndarray, np.ndarray]:
    """Fitted on the driver on at most about SAMPLE_ROWS of the number of rows."""
    sample = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "vec_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE_ROWS / max(1, number))))
    x = _matrix(sample.select("vector").toArrow()["vector"])
    if not len(x):
        x = _matrix(rows.limit(1).select("vector").toArrow()["vector"])
    half = dimension // 2
    return kmeans(x[:, :half], centroids, 1) if half else np.zeros((1, 0)), kmeans(x[:, half:], centroids, 2)


def cell_of(index_first: np.ndarray, index_second: np.ndarray, x: np.ndarray) -> np.ndarray:
    half = index_first.shape[1]
    return nearest(x[:, :half], index_first) * len(index_second) + nearest(x[:, half:], index_second)


def traverse(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, quota: float) -> list[int]:
    """Cells in the order of the summed distances of their two centroids, by a heap, until they hold quota rows.

    first, second: distances of a query's halves to the centroids of each half. A pair of places (i, j) in the two sorted lists enters the
    heap once both (i - 1, j) and (i, j - 1) have left it, so it holds one pair of each row at most.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    width, out, held = len(y), [], 0
    heap = [(x[0] + y[0], 0, 0)]
    done = [-1] * len(x)  # of each row the last column that left the heap
    while heap and held < quota:
        _, i, j = heapq.heappop(heap)
        done[i] = j
        cell = int(a[i]) * width + int(b[j])
        out.append(cell)
        held += int(sizes[cell])
        if i + 1 < len(x) and done[i + 1] == j - 1:
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
        if j + 1 < width and (i == 0 or done[i - 1] >= j + 1):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
    return out


def layout(first: np.ndarray, second: np.ndarray, sizes: np.ndarray) -> Index:
    """Small cells share a shard, a large one has several that hold nothing else."""
    base, parts, shard, held, begun = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0, False
    for cell, size in enumerate(sizes):
        if begun and held + size > SHARD_ROWS:
            shard, held, begun = shard + 1, 0, False
        base[cell] = shard
        if size > SHARD_ROWS:
            parts[cell] = -(-size // SHARD_ROWS)
            shard += parts[cell]
        else:
            held, begun = held + size, True
    low = np.searchsorted(base + parts - 1, np.arange(shard + 2), "left")
    return Index(first, second, sizes, base, parts, low)


@tidied
def search(vectors: DataFrame, queries: DataFrame, nearest_k: int = NEAREST, share: float = PROBE_SHARE, centroids: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the nearest_k found by largest inner product, ties to the smaller vec_id.

    vectors, queries: vec_id, embedding. A query's own vec_id is no candidate. Vectors that usable() refuses take no part. Vectors of different lengths have no inner
    product: each length has an index of its own. Rows that repeat a vec_id with an equal vector count once. centroids: of each half; by default they grow with the rows.
    """
    rows, asked = (usable(x).withColumn("d", F.size("vector")).dropDuplicates(["vec_id", "vector"]) for x in (vectors, queries))
    rows, asked = materialize(rows), materialize(asked)
    wanted = {r.d for r in asked.select("d").distinct().collect()}
    sizes = rows.groupBy("d", "vec_id").count().groupBy("d").agg(F.sum("count").alias("n"), F.max("count").alias("most")).orderBy("d").collect()
    out = rows.sparkSession.createDataFrame([], FOUND)
    for d, n, most in sizes:
        if d in wanted:
            # so many rows hold at least nearest_k candidates besides the query's own id, where there are so many
            quota = max(share * n, float((nearest_k + 1) * most))
            of = [x.filter(F.col("d") == d).drop("d") for x in (rows, asked)]
            out = out.union(_search(*of, d, n, nearest_k, quota, centroids or min(MOST_CENTROIDS, max(CENTROIDS, ceil((n / SHARD_ROWS) ** 0.5)))))
    return out


def _search(rows: DataFrame, asked: DataFrame, dimension: int, number: int, nearest_k: int, quota: float, centroids: int) -> DataFrame:
    """search() for vectors (vec_id, vector) of one length.

    All rows are indexed: halves are quantised, a cell is a pair of centroids. Each query walks through cells by summed distance (minus inner product) until they hold
    quota rows; a cell and the queries that visit it meet in shards of bounded size, where all pairs of visited cells are reranked with the
    original vectors in double precision; a shard hands on no more than nearest_k of each query.
    """
    context = rows.sparkSession.sparkContext
    books = codebooks(rows, dimension, number, centroids)
    shared_books = context.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            cells = cell_of(*shared_books.value, x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells.astype(np.int32))], names=["vec_id", "cell"])

    sizes = np.zeros(len(books[0]) * len(books[1]), np.int64)
    for row in rows.mapInArrow(assign, "vec_id long, cell int").groupBy("cell").count().collect():  # at most centroids**2 rows
        sizes[row["cell"]] = row["count"]
    index = layout(*books, sizes)
    shared = context.broadcast(index)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        half = index.first.shape[1]
        for batch in batches:
            ids, shards, maps, who = batch.column(0).to_numpy(), [], [], []
            x = _matrix(batch.column(1))
            for k in range(len(ids)):
                cells = np.array(traverse(-(index.first @ x[k, :half]), -(index.second @ x[k, half:]), index.sizes, quota), np.int64)
                cells = cells[index.sizes[cells] > 0]
                mask = np.zeros(index.cells, bool)
                mask[cells] = True
                spread = np.unique(np.concatenate([index.base[cells], *[np.arange(index.base[c], index.base[c] + index.parts[c]) for c in cells[index.parts[cells] > 1]]]))
                shards.append(spread)
                maps += [np.packbits(mask[index.low[s] : max(index.low[s] + 1, index.low[s + 1])]).tobytes() for s in spread]
                who += [k] * len(spread)
            if who:
                take = pa.array(who)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(shards).astype(np.int64)), pa.array(maps, pa.binary())], names=["query_id", "vector", "shard", "visited"])

    # the walk is made once; few queries would be one task, so they are dealt out for it
    walkers = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    visits = materialize(asked.repartition(walkers, "vec_id").mapInArrow(visit, "query_id long, vector array<double>, shard long, visited binary"))
    # a shard that very many queries visit is met by them in several groups, each with the shard's rows
    counts = visits.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(SHARD_QUERIES)).cast("long").alias("groups"))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            x = _matrix(batch.column(1))
            cell = cell_of(index.first, index.second, x) if len(x) else np.zeros(0, np.int64)
            spread = (batch.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            shard = index.base[cell] + spread % index.parts[cell]
            place = np.where(index.parts[cell] > 1, 0, cell - index.low[shard])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place.astype(np.int32)), pa.array(shard)], names=["vec_id", "vector", "place", "shard"])

    left = rows.mapInArrow(shards, "vec_id long, vector array<double>, place int, shard long").join(counts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    right = visits.join(counts, "shard").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("groups")))
    met = left.select("shard", "part", "vec_id", "vector", "place").groupBy("shard", "part").cogroup(right.select("shard", "part", "query_id", "vector", "visited").groupBy("shard", "part"))

    def rerank(_key, rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if len(rows) and len(asked):
            x, q = _matrix(rows["vector"]), _matrix(asked["vector"])
            ids, who, place = rows["vec_id"].to_numpy(), asked["query_id"].to_numpy(), rows["place"].to_numpy()
            visited = asked["visited"].to_pylist()
            for low in range(0, len(q), 256):
                block = q[low : low + 256]
                scores = block @ x.T
                for k in range(len(block)):
                    seen = np.unpackbits(np.frombuffer(visited[low + k], np.uint8))[place].astype(bool) & (ids != who[low + k])
                    may = np.flatnonzero(seen)
                    if not len(may):
                        continue
                    own = scores[k, may]
                    if len(may) > nearest_k:
                        # what rounding could lift over the last place stays, then all are summed alike wherever they stand
                        bound = np.partition(own, len(own) - nearest_k)[len(own) - nearest_k]
                        may = may[own >= bound - 1e-9 * max(1.0, abs(bound))]
                    exact = (x[may] * block[k]).sum(axis=1)
                    order = np.lexsort((ids[may], -exact))[:nearest_k]
                    out.append((np.full(len(order), who[low + k]), ids[may][order], exact[order]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    found = met.applyInArrow(rerank, "query_id long, vec_id long, score double")
    ranked = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= nearest_k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
