"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm import _text
from ridgeline.llm._store import columns, materialize, own_prefix, tidied

#: Hash buckets of the n-grams, lengths of the n-grams, added count.
BUCKETS, LENGTHS, ALPHA = 1 << 14, (1, 2, 3), 0.5
#: The classifier is fitted on a sample of about so many labelled rows of each language, drawn by a hash of doc_id.
SAMPLE_ROWS = 4000
#: The model is an array of languages x BUCKETS, broadcast; languages beyond so many are scored in further passes, so that its size is bounded.
BLOCK_LANGUAGES = 256
UNKNOWN = "und"
BLOCK_BYTES = 256 << 10
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@dataclass(frozen=True)
class Block:
    """What has been learned of some languages."""

    languages: tuple[str, ...]
    log_probability: np.ndarray  # languages x BUCKETS
    log_prior: np.ndarray


@dataclass(frozen=True)
class Model:
    """All languages, and what to learn them from; blocks are learned when they are used, one at a time."""

    languages: tuple[str, ...]
    rows: np.ndarray  # labelled rows of each
    docs: DataFrame
    sample_rows: int

    def blocks(self) -> Iterator[Block]:
        for first in range(0, len(self.languages), BLOCK_LANGUAGES):
            yield self._block(slice(first, first + BLOCK_LANGUAGES))

    def _block(self, part: slice) -> Block:
        names, rows = self.languages[part], self.rows[part]
        share = F.create_map(*[x for name, n in zip(names, rows.tolist(), strict=True) for x in (F.lit(name), F.lit(int(1_000_000 * min(1.0, self.sample_rows / n))))])
        index = F.create_map(*[x for i, name in enumerate(names) for x in (F.lit(name), F.lit(i))])
        # labels of other blocks are not in the map, and a null is no sample
        sample = self.docs.filter(F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1_000_000)) < F.try_element_at(share, F.col("lang")))
        counted = sample.select(F.try_element_at(index, F.col("lang")).alias("language"), "text").mapInArrow(_counts, "language int, bucket int, n long")
        summed = counted.groupBy("language", "bucket").agg(F.sum("n").alias("n")).toArrow()
        n = np.zeros((len(names), BUCKETS))
        n[summed["language"].to_numpy(), summed["bucket"].to_numpy()] = summed["n"].to_numpy()
        n += ALPHA
        return Block(names, np.log(n / n.sum(axis=1, keepdims=True)), np.log(rows / self.rows.sum()))


@lru_cache(maxsize=1)
def _alphabet() -> np.ndarray:
    """For each code point its lower-case letter, 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            out[c] = ord(low) if len(low := s.lower()) == 1 else c
    return out


def grams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every n-gram that holds a letter, and the letters of each row."""
    lead = (raw & 0xC0) != 0x80
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    bounds = np.concatenate(([0], np.cumsum(lead)))[at]
    n = len(bounds) - 1
    letters = _alphabet()[points].astype(np.uint64)
    row = np.repeat(np.arange(n), np.diff(bounds))
    held = np.bincount(row[letters > 0], minlength=n)
    rows, buckets = [], []
    code, some = np.zeros(len(letters), np.uint64), np.zeros(len(letters), bool)
    for k in range(max(LENGTHS)):
        m = len(letters) - k
        if m <= 0:
            break
        code = code[:m] + (letters[k:] + np.uint64(1)) * _STEP[k]
        some = some[:m] | (letters[k:] > 0)
        if k + 1 in LENGTHS:
            fits = some & (row[:m] == row[k:])
            rows.append(row[:m][fits])
            x = code[fits]
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            buckets.append((x >> np.uint64(50)).astype(np.int64))
    return (np.concatenate(rows), np.concatenate(buckets), held) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), held)


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, at = _text.utf8(column)
    for first, last in _text.slices(at, BLOCK_BYTES):
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        label = batch.column(0).to_numpy(zero_copy_only=False)
        for first, last, raw, at in _blocks(batch.column(1)):
            rows, buckets, _ = grams(raw, at)
            of = label[first:last][rows]
            for c in np.unique(label[first:last]):
                sums[c] = sums.get(c, 0) + np.bincount(buckets[of == c], minlength=BUCKETS)
    for c, total in sums.items():
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), c, np.int32)), pa.array(some.astype(np.int32)), pa.array(total[some].astype(np.int64))], names=["language", "bucket", "n"])


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """docs: doc_id, text, lang. Rows whose lang is null teach nothing. The sample is bounded by sample_rows for each language; only the languages and, block by block, sums of counts come to the driver."""
    docs = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    rows = sorted(docs.groupBy("lang").count().collect(), key=lambda r: r["lang"])
    return Model(tuple(r["lang"] for r in rows), np.array([r["count"] for r in rows], float), docs, sample_rows)


def classify(block: Block, column: pa.Array) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """For each whole text the likeliest of the block's languages, its log-probability and that of all of them together; None and minus infinity where it is null or holds no letter."""
    named, tops, masses = [], [], []
    k = len(block.languages)
    for first, last, raw, at in _blocks(column):
        n = last - first
        rows, buckets, letters = grams(raw, at)
        total = np.tile(block.log_prior, (n, 1))
        # a long run of rows would make the counts dense in memory, so they are taken a few rows at a time
        step = 64
        order = np.argsort(rows, kind="stable")
        rows, buckets = rows[order], buckets[order]
        for low in range(0, n, step):
            a, b = np.searchsorted(rows, (low, low + step))
            if a == b:
                continue
            counts = np.bincount((rows[a:b] - low) * BUCKETS + buckets[a:b])
            cells = np.flatnonzero(counts)
            row, bucket, weight = cells // BUCKETS + low, cells % BUCKETS, counts[cells]
            for c in range(k):
                total[:, c] += np.bincount(row, weight * block.log_probability[c, bucket], minlength=n)
        best = total.argmax(axis=1)
        top = total[np.arange(n), best]
        mass = top + np.log(np.exp(total - top[:, None]).sum(axis=1))
        named += [block.languages[c] if x else None for c, x in zip(best, letters, strict=True)]
        tops.append(np.where(letters > 0, top, -np.inf))
        masses.append(np.where(letters > 0, mass, -np.inf))
    return named, np.concatenate(tops) if tops else np.zeros(0), np.concatenate(masses) if masses else np.zeros(0)


@tidied
def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, the posterior probability. Only the text is an input; null texts and texts without a letter get `und` and 0, as does every text where no language was learned. Columns of docs by these names are replaced.

    Languages are scored in blocks of BLOCK_LANGUAGES. With several blocks the texts are read once for each, and the maxima and the sums of
    probabilities are merged, which gives what one block of all languages would; ties go to the first language by name.
    """
    out = docs.drop("lang_pred", "score")
    p = own_prefix(out)
    lang, top, mass = (F.col(f"{p}{c}") for c in ("lang", "top", "mass"))
    out = out.withColumns({f"{p}lang": F.lit(None).cast("string"), f"{p}top": F.lit(float("-inf")), f"{p}mass": F.lit(float("-inf"))})
    blocks = -(-len(model.languages) // BLOCK_LANGUAGES)
    for i, block in enumerate(model.blocks()):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # at most BLOCK_LANGUAGES x BUCKETS numbers

        def run(column: pa.Array, shared=shared) -> list[pa.Array]:
            named, tops, masses = classify(shared.value, column)
            return [pa.array(named, pa.string()), pa.array(tops, pa.float64()), pa.array(masses, pa.float64())]

        out = _text.append(out, text, f"{p}new_lang string, {p}new_top double, {p}new_mass double", run)
        better, high = F.col(f"{p}new_top") > top, F.greatest(mass, F.col(f"{p}new_mass"))
        both = F.when(mass == float("-inf"), F.col(f"{p}new_mass")).otherwise(high + F.log1p(F.exp(F.least(mass, F.col(f"{p}new_mass")) - high)))
        out = out.withColumns({f"{p}lang": F.when(better, F.col(f"{p}new_lang")).otherwise(lang), f"{p}top": F.greatest(top, F.col(f"{p}new_top")), f"{p}mass": both})
        out = out.drop(f"{p}new_lang", f"{p}new_top", f"{p}new_mass")
        if i + 1 < blocks:
            out = materialize(out)
    score = F.when(lang.isNull(), F.lit(0.0)).otherwise(F.exp(top - mass))
    kept = [c for c, name in zip(columns(docs), docs.columns, strict=True) if name not in ("lang_pred", "score")]
    return out.select(*kept, F.coalesce(lang, F.lit(UNKNOWN)).alias("lang_pred"), score.alias("score"))


def fold(column: Column, parts: int) -> Column:
    return F.crc32(column.cast("string")) % parts
