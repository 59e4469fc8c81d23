"""Near-duplicates: circulant MinHash, banding, exact verification, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm import _text
from ridgeline.llm._store import columns, discard, materialize, own_prefix, tidied

#: Words of a shingle, and the least 100 * intersection / union of a link.
WORDS, PERCENT = 5, 80
#: Signature coordinates are BANDS x ROWS; a pair at the threshold 0.8 is missed with probability (1 - 0.8**6)**40, about 5e-6.
BANDS, ROWS = 40, 6
#: Size of the circle that the second permutation is shifted on.
CIRCLE = 1 << 20
#: One-bit sketches of a pair at the threshold differ in 24 of 240 places, give or take 4.6; a pair beyond 52 is not verified.
SKETCH_BITS, SKETCH_APART = 240, 52
#: Words of a text up to which its set is named by two independent hashes.
SMALL = 64
#: Sets of each side that meet in one task of the exact comparison.
BLOCK = 256
_SIGMA = np.uint64(0xA24BAED4963EE407)

FINGERPRINT = "doc_id long, n_shingles long, key binary, bands array<long>, sketch array<long>"


@lru_cache(maxsize=1)
def _circle() -> np.ndarray:
    """The second permutation, written once around the circle and on by one signature; row s of the view holds what every shift says of place s."""
    ring = np.random.default_rng(20_11).permutation(CIRCLE).astype(np.uint32)
    return sliding_window_view(np.concatenate((ring, ring[: BANDS * ROWS])), BANDS * ROWS)


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates of a set. The first permutation places each shingle on the circle, the second, shifted by k, gives coordinate k."""
    places = (_text.mix(shingles ^ _SIGMA) >> np.uint64(44)).astype(np.int64)
    circle = _circle()
    out = circle[places[:2048]].min(axis=0)
    for first in range(2048, len(places), 2048):
        out = np.minimum(out, circle[places[first : first + 2048]].min(axis=0))
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    rows = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for r in range(ROWS):
        key = _text.mix(key * np.uint64(0x9FB21C651E98DF25) + rows[:, :, r])
    return _text.signed(key)


def shingle_sets(column: pa.Array, words: int, seed: int = 0, most: int | None = None) -> Iterator[np.ndarray]:
    """For each row the sorted distinct shingle hashes of the whole text, words after lower-casing A to Z. Fewer words than a shingle: all of them as one; none or null: empty.

    seed gives hashes independent of those of another seed; texts of more than `most` words are passed over, as empty.
    """
    raw, at = _text.utf8(column)
    for first, last in _text.slices(at):
        part = at[first : last + 1] - at[first]
        tokens, begin = _text.words(raw[at[first] : at[last]], part, lower=True, seed=seed)
        grams = _text.rolling(tokens, words)
        for d in range(last - first):
            a, b = begin[d], begin[d + 1]
            if most is not None and b - a > most:
                yield np.zeros(0, np.uint64)
            elif b - a >= words:
                yield np.unique(grams[a : b - words + 1])
            elif b > a:
                yield _text.rolling(tokens[a:b], int(b - a))
            else:
                yield np.zeros(0, np.uint64)


def set_key(shingles: np.ndarray, again: np.ndarray) -> bytes:
    """A digest of the set; of a small one also by its hashes of another seed, since there one collision of two shingles would make two sets equal."""
    return hashlib.blake2b(shingles.tobytes() + again.tobytes(), digest_size=16).digest()


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, minima = [], [], []
            for shingles, again in zip(shingle_sets(batch.column(1), words), shingle_sets(batch.column(1), words, seed=1, most=SMALL), strict=True):
                counts.append(len(shingles))
                keys.append(set_key(shingles, again))
                minima.append(signature(shingles) if len(shingles) else np.zeros(BANDS * ROWS, np.uint32))
            n = len(counts)
            if not n:
                continue
            minima = np.stack(minima)
            bits = np.zeros((n, 32), np.uint8)
            bits[:, : SKETCH_BITS // 8] = np.packbits((minima & 1).astype(np.uint8), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), _lists(band_keys(minima)), _lists(bits.view(np.int64))],
                names=["doc_id", "n_shingles", "key", "bands", "sketch"],
            )
            _text.release()

    return run


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1)))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row for each document: set size, set digest, band keys and one-bit sketch."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints(words), FINGERPRINT)


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingle_sets(batch.column(1), words))
            own = [batch.column(0), pa.array(map(len, found), pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*own, *batch.columns[2:]], names=["id", "n", "shingles", *batch.schema.names[2:]])

    return run


def _shingles(column: pa.Array) -> Iterator[np.ndarray]:
    return (np.frombuffer(v.as_buffer(), np.uint64) for v in column)


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_shingles(batch.column(2)), _shingles(batch.column(3)), strict=True):
                both = np.sort(np.concatenate((x, y)), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of ids whose whole sets are as similar as asked."""
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(_verified(percent), "a long, b long")


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """id, component (smallest id reachable) for every id in a link (a, b).

    Each round takes the smallest label among neighbours, then the label's own label, so the distance to
    the smallest id at least halves along chains; it ends when no neighbour has a smaller label. labels: a start from earlier links.
    """
    links = links.select("a", "b")
    if labels is not None:
        # whoever has a start label is linked to the id that gave it
        links = links.union(labels.filter("id <> component").select("id", "component"))
    # links come from joins of whole sets, so both directions are made of one pass over them
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    edges = materialize(links.select(both.alias("e")).select("e.a", "e.b"))
    own = edges.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("component"))
    if labels is not None:
        own = own.union(labels.select("id", "component")).groupBy("id").agg(F.min("component").alias("component"))
    own = materialize(own)
    while True:
        near = edges.join(own.withColumnsRenamed({"id": "b", "component": "c"}), "b").select(F.col("a").alias("id"), F.col("c").alias("component"), F.lit(None).cast("long").alias("was"))
        least = near.union(own.select("id", "component", F.col("component").alias("was"))).groupBy("id").agg(F.min("component").alias("component"), F.max("was").alias("was"))
        least = materialize(least)
        if not least.filter("component <> was").limit(1).count():
            discard(least)
            return own
        jump = least.select(F.col("id").alias("component"), F.col("component").alias("c"))
        jumped = materialize(least.join(jump, "component", "left").select("id", F.least("component", "c").alias("component")))
        discard(own)
        discard(least)
        own = jumped


@tidied
def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    1. Rows with equal sets form one class, named by its smallest doc_id; a class of copies is handled once, however large.
    2. Classes that share a band are candidates. In each bucket every member is first verified against three
       representatives (smallest id, and the extremes of a hash), which is linear in the bucket and joins groups of near copies.
    3. In buckets whose members are not of one component by then, all pairs of different components are compared, in blocks of sets that
       return which components are linked only. No pair of a bucket is left out, no bucket is capped.
    Empty sets (no words, null text) and rows without doc_id are linked with nothing; the latter get a null component_id and are kept.
    Rows that share a doc_id are one document with several texts. Other columns of docs are not read.
    """
    fp = materialize(fingerprints(docs, words))
    usable = fp.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    first = F.min_by(F.struct(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), *[F.col("sketch")[i].alias(f"s{i}") for i in range(4)], "bands"), "doc_id")
    classes = materialize(usable.groupBy("key").agg(first.alias("first")).select("key", "first.*"))
    reps = classes.drop("key")
    members = reps.select("id", F.explode("bands").alias("band"))
    order = F.xxhash64("id")
    buckets = members.groupBy("band").agg(F.min("id").alias("r0"), F.min_by("id", order).alias("r1"), F.max_by("id", order).alias("r2"), F.max("id").alias("last"))
    shared = materialize(members.join(buckets.filter("r0 <> last").drop("last"), "band"))
    sketches = reps.drop("n", "bands").join(shared.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    # the texts of whoever has a candidate move once, at any size by the same kind of join
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").hint("merge").join(sketches, "id")
    sets = materialize(texts.mapInArrow(_sets(words), "id long, n long, shingles binary, s0 long, s1 long, s2 long, s3 long"))
    stars = shared.select(F.col("id"), F.explode(F.array_distinct(F.array("r0", "r1", "r2"))).alias("r")).filter("id <> r")
    stars = stars.select(F.least("id", "r").alias("a"), F.greatest("id", "r").alias("b")).distinct()
    tested = materialize(_possible(stars, sets, percent))
    labels = components(verify(tested, sets, percent))
    placed = materialize(shared.select("band", "id").join(labels, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component")))
    merged = components(_across(placed, sets, percent).distinct()).select(F.col("id").alias("component"), F.col("component").alias("merged"))
    named = classes.select("key", "id").join(labels, "id", "left").select("key", F.coalesce("component", "id").alias("component"))
    named = named.join(merged, "component", "left").select("key", F.coalesce("merged", "component").alias("component_id"))
    # rows of one doc_id with several texts are in the component of the smallest
    named = materialize(named)
    out = fp.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("key")).alias("key")).join(named, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _across(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Which different components are linked within the buckets of placed (band, id, component): a, b.

    A bucket goes to the group of its largest component, so the many buckets of a group of near copies are one group and a set moves once for it. In a group, sets
    of other components are compared to all; both sides are dealt out in blocks, so no task holds a group.
    """
    per = placed.groupBy("band", "component").agg(F.count("*").alias("n"))
    top = per.groupBy("band").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("kinds")).filter("kinds > 1")
    met = materialize(placed.join(top.select("band", F.col("top.component").alias("g")), "band").select("g", "id", "component").distinct())
    blocks = met.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("all"), F.ceil(F.sum((F.col("component") != F.col("g")).cast("int")) / BLOCK).cast("int").alias("others"))
    rows = materialize(met.join(blocks, "g")).join(sets.select("id", "shingles"), "id")
    spread = lambda over: F.pmod(F.xxhash64("id"), F.col(over)).cast("int")
    every = lambda over: F.explode(F.sequence(F.lit(0), F.col(over) - 1))
    key = ["g", "i", "j"]
    own = [F.col(c).alias(c) for c in ("id", "component", "shingles")]  # new columns, as both sides come from one table
    x = rows.filter("component <> g").select(F.col("g").alias("g"), spread("others").alias("i"), every("all").alias("j"), *own)
    y = rows.select(F.col("g").alias("g"), every("others").alias("i"), spread("all").alias("j"), *own)

    def compare(key, x: pa.Table, y: pa.Table) -> pa.Table:
        links: set[tuple[int, int]] = set()
        if len(x) and len(y):
            a, b = list(_shingles(x["shingles"])), list(_shingles(y["shingles"]))
            codes, sizes = np.unique(np.concatenate(b), return_inverse=True), np.array([len(s) for s in b])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            known, codes = codes
            others = y["component"].to_numpy()
            for s, component in zip(a, x["component"].to_numpy().tolist(), strict=True):
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                held = np.zeros(len(known), bool)
                held[at[known[at] == s]] = True
                shared = np.add.reduceat(held[codes], starts, dtype=np.int64)
                near = (100 * shared >= percent * (len(s) + sizes - shared)) & (others != component)
                links.update((min(component, other), max(component, other)) for other in set(others[near].tolist()))
        a, b = zip(*sorted(links), strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return x.groupBy(*key).cogroup(y.groupBy(*key)).applyInArrow(compare, "a long, b long")


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and sketches do not rule out, each once, however many rows of sets share an id."""
    a, b = (sets.select(F.col("id").alias(i), *[F.col(c).alias(f"{i}_{c}") for c in ("n", "s0", "s1", "s2", "s3")]) for i in "ab")
    out = pairs.join(a, "a").join(b, "b")
    apart = sum((F.bit_count(F.col(f"a_s{i}").bitwiseXOR(F.col(f"b_s{i}"))) for i in range(1, 4)), F.bit_count(F.col("a_s0").bitwiseXOR(F.col("b_s0"))))
    return out.filter((100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")) & (apart <= SKETCH_APART)).select("a", "b").distinct()


@tidied
def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without near copies: of each component the row with the smallest doc_id stays, a null one last, of rows that share it the one whose text has the smallest hash.

    Rows are documents here: different texts under one doc_id, or without any, are linked by what they say and by nothing else. Rows without words all stay.
    """
    named = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").limit(1).count()
    if not named:
        kept = near_duplicates(docs, words, percent).filter("kept").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(columns(docs))
    p = own_prefix(docs)
    row, component = f"{p}row", f"{p}component"
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), words, percent).select(F.col("doc_id").alias(row), F.col("component_id").alias(component))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), row)
    first = rows.select(row, place.alias(f"{p}place")).join(found, row).groupBy(component).agg(F.min_by(row, f"{p}place").alias(row)).select(row)
    return rows.join(first, row, "left_semi").select(columns(docs))
