"""Substring dedup by recompression: runs and pairs of tokens get names from their content, equal substrings get equal interior names.

A round of recompression replaces runs of one symbol, then pairs of a left and a right symbol, by new symbols. What names them here is a hash of what they stand for: it gives the name that a
table of all runs and pairs of the corpus would give, the same in every task, without a join of all tokens with such a table. Names only find candidates. What is removed is decided by a
128-bit BLAKE2 digest of the words themselves, so a meeting of names costs time, never a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm import _text
from ridgeline.llm._store import materialize, tidied

#: Words of a window, rounds of recompression.
WINDOW, ROUNDS = 35, 2
U64 = np.uint64
#: Beyond any place: what a symbol at the edge of a text depends on lies outside of it.
FAR = 1 << 40
_RUN, _PAIR, _SIDE = U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3), U64(0x589965CC75374CC3)


class Symbols:
    """A level: names and, in words, where each symbol starts and ends and the range [low, high) of words that alone decides that it stands there."""

    def __init__(self, name, start, end, low, high):
        self.name, self.start, self.end, self.low, self.high = name, start, end, low, high

    def __len__(self):
        return len(self.name)


def ground(tokens: np.ndarray) -> Symbols:
    at = np.arange(len(tokens))
    return Symbols(tokens, at, at + 1, at, at + 1)


def _neighbours(s: Symbols, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol the place of its left and right neighbour in the same text, -1 where there is none."""
    at = np.arange(len(s))
    left, right = at - 1, at + 1
    same = row[s.start][1:] == row[s.start][:-1]
    left[np.concatenate(([True], ~same))] = -1
    right[np.concatenate((~same, [True]))] = -1
    return left, right


def name_runs(s: Symbols, tokens: np.ndarray, row: np.ndarray) -> Symbols:
    """Maximal runs of equal neighbours become one symbol, named by what is repeated and how often.

    A run ends where the neighbour differs. If the words at the far ends of the two differ, one word of the neighbour decides that, else all that decides the neighbour.
    """
    n = len(s)
    texts = row[s.start]
    fresh = np.concatenate(([True], (s.name[1:] != s.name[:-1]) | (texts[1:] != texts[:-1])))
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], n) - 1
    left, right = _neighbours(s, row)
    left, right = left[first], right[last]
    count = last - first + 1
    name = np.where(count > 1, _text.mix(s.name[first] ^ (_RUN * count.astype(U64))), s.name[first])
    a, b = np.maximum(left, 0), np.maximum(right, 0)
    seen = np.where(tokens[s.end[a] - 1] != tokens[s.end[first] - 1], s.start[first] - 1, s.low[a])
    low = np.minimum(s.low[first], np.where(left < 0, -FAR, seen))
    seen = np.where(tokens[s.start[b]] != tokens[s.start[last]], s.end[last] + 1, s.high[b])
    high = np.maximum(s.high[last], np.where(right < 0, FAR, seen))
    return Symbols(name, s.start[first], s.end[last], low, high)


def name_pairs(s: Symbols, row: np.ndarray, level: int) -> Symbols:
    """The alphabet is halved by a hash of the names; a symbol of the left half and one of the right half behind it become one symbol, named by the two."""
    n = len(s)
    opens = (_text.mix(s.name + _SIDE * U64(level + 1)) & U64(1)).astype(bool)
    left, right = _neighbours(s, row)
    a, b = np.maximum(left, 0), np.maximum(right, 0)
    head = opens & (right >= 0) & ~opens[b]
    tail = ~opens & (left >= 0) & opens[a]
    keep = np.flatnonzero(~tail)
    pair = head[keep]
    other = np.minimum(keep + 1, n - 1)
    name = np.where(pair, _text.mix(s.name[keep] * _PAIR + _text.mix(s.name[other])), s.name[keep])
    end = np.where(pair, s.end[other], s.end[keep])
    # of a symbol left alone: one that opens was decided by its right neighbour, one that closes by its left
    low = np.where(pair, np.minimum(s.low[keep], s.low[other]), np.where(opens[keep], np.minimum(s.low[keep], np.where(right[keep] < 0, s.low[keep], s.low[b[keep]])), np.minimum(s.low[keep], np.where(left[keep] < 0, -FAR, s.low[a[keep]]))))
    high = np.where(pair, np.maximum(s.high[keep], s.high[other]), np.where(opens[keep], np.maximum(s.high[keep], np.where(right[keep] < 0, FAR, s.high[b[keep]])), np.maximum(s.high[keep], np.where(left[keep] < 0, s.high[keep], s.high[a[keep]]))))
    return Symbols(name, s.start[keep], end, low, high)


def recompress(tokens: np.ndarray, row: np.ndarray, rounds: int = ROUNDS) -> list[Symbols]:
    """Levels of all texts of a slice at once, the words themselves first."""
    levels = [ground(tokens)]
    for level in range(rounds):
        if not len(levels[-1]):
            break
        levels.append(name_pairs(name_runs(levels[-1], tokens, row), row, level))
    return levels


def _least(rank: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The place of the least of rank[first:last], the leftmost among equals; no range is empty. Each is covered by two ranges of a power of two."""
    out, level = np.zeros(len(first), np.int64), np.frexp((last - first).astype(float))[1] - 1
    table, j = np.arange(len(rank)), 0
    while j <= (level.max() if len(level) else -1):
        own = np.flatnonzero(level == j)
        a, b = table[first[own]], table[last[own] - (1 << j)]
        out[own] = np.where(rank[a] <= rank[b], a, b)
        a, b = table[: -(1 << j)], table[1 << j :]
        table, j = np.where(rank[a] <= rank[b], a, b), j + 1
    return out


def pieces(tokens: np.ndarray, begin: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """Row, first window, number of windows and anchor key of each piece: windows in a row that share an anchor.

    A window's anchor is the symbol of the highest level that the window's words alone decide, of these the one with the least hash, the leftmost among equals. So equal
    windows have equal anchors at equal places, wherever they stand. Every window has one, since a word is decided by itself. The anchor key names
    level, words that decide the symbol, and its place in them.
    """
    n = len(tokens)
    counts = np.diff(begin)
    row = np.repeat(np.arange(len(counts)), counts)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64))
    if n < window:
        return none
    at = np.arange(n)
    todo = np.flatnonzero(at <= np.repeat(begin[1:] - window, counts))  # places where a window starts
    edge_low, edge_high = np.repeat(begin[:-1], counts) - 1, np.repeat(begin[1:], counts) + 1
    low_of, high_of = np.full(n, -1), np.full(n, -1)
    start_of, level_of = np.full(n, -1), np.full(n, -1)
    levels = recompress(tokens, row, rounds)
    for level in range(len(levels) - 1, -1, -1):
        s = levels[level]
        # both bounds grow along the symbols, so those that a window decides are neighbours
        lo = np.searchsorted(np.maximum(s.low, edge_low[s.start]), todo, "left")
        hi = np.searchsorted(np.minimum(s.high, edge_high[s.start]), todo + window, "right")
        some = np.flatnonzero(lo < hi)
        got, o = todo[some], _least(_text.mix(s.name ^ U64(level)), lo[some], hi[some])
        low_of[got], high_of[got], start_of[got], level_of[got] = s.low[o], s.high[o], s.start[o], level
        todo = todo[lo >= hi]
    at = np.flatnonzero(level_of >= 0)
    if not len(at):
        return none
    fresh = np.concatenate(([True], (np.diff(at) != 1) | (start_of[at][1:] != start_of[at][:-1]) | (level_of[at][1:] != level_of[at][:-1])))
    p0 = at[fresh]
    sizes = np.diff(np.append(np.flatnonzero(fresh), len(at)))
    place = (level_of[p0] << 20 | (start_of[p0] - low_of[p0])).astype(U64)
    anchor = _text.mix(_text.sequences(tokens, low_of[p0], high_of[p0]) + place * _PAIR)
    return row[p0], p0 - begin[row[p0]], sizes, anchor


# ---- over a table


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press.compress(t.as_buffer()) for t in texts], pa.binary())], names=["doc_id", "packed"])


def _unpacked(column: pa.Array) -> list[bytes]:
    press = zstandard.ZstdDecompressor()
    return [press.decompress(t.as_buffer()) for t in column]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice of texts in column 1: its first row, the bytes of the texts, starts and ends of all words, and the offset of each text's first word."""
    raw, at = _text.utf8(batch.column(1))
    for a, b in _text.slices(at):
        part = raw[at[a] : at[b]]
        yield a, part, *_text.word_spans(part, at[a : b + 1] - at[a])


def _spaced(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """All words with a space behind each, and where each starts in that (one more than words)."""
    sizes = ends - starts + 1
    at = np.concatenate(([0], np.cumsum(sizes)))
    out = raw[np.minimum(np.arange(at[-1]) + np.repeat(starts - at[:-1], sizes), len(raw) - 1)] if len(sizes) else np.zeros(0, np.uint8)
    out[at[1:] - 1] = 32
    return memoryview(out), at


def _digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """A digest of the words [first, last) of each range, whatever white space stood between them."""
    line, at = _spaced(raw, starts, ends)
    made = b"".join([blake2b(line[a:b], digest_size=16).digest() for a, b in zip(at[first].tolist(), at[last].tolist(), strict=True)])
    return pa.Array.from_buffers(pa.binary(16), len(first), [None, pa.py_buffer(made)]).cast(pa.binary())


def _pieces(window: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, raw, starts, ends, begin in _slices(batch):
                row, at, sizes, anchor = pieces(_text.span_hashes(raw, starts, ends), begin, window, rounds)
                first = begin[row] + at
                span = _digests(raw, starts, ends, first, first + sizes + window - 1)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + a)), pa.array(at * (window + 1) + sizes), pa.array(_text.signed(anchor)), span], names=["doc_id", "piece", "anchor", "span"])
            _text.release()

    return run


def _windows(window: int):
    unit = window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(2).to_pylist()
            texts = pa.array(_unpacked(batch.column(1)), pa.large_binary()).cast(pa.large_string())
            plain = pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc_id", "text"])
            for a, raw, starts, ends, begin in _slices(plain):
                who, at, weight = [], [], []
                for k in range(len(begin) - 1):
                    for w in wanted[a + k]:
                        p = w["piece"] // unit + np.arange(w["piece"] % unit)
                        who.append(np.full(len(p), a + k))
                        at.append(p)
                        weight.append(np.full(len(p), w["weight"]))
                if not who:
                    continue
                who, at, weight = np.concatenate(who), np.concatenate(at), np.concatenate(weight)
                p = begin[who - a] + at
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), pa.array(at.astype(np.int32)), pa.array(weight.astype(np.int32)), _digests(raw, starts, ends, p, p + window)], names=["doc_id", "at", "weight", "words"])

    return run


KEPT = "doc_id long, n_words long, n_removed long, kept string"


def _removed(window: int):
    unit = window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges, counts, gone, kept = batch.column(2).to_pylist(), [], [], []
            for text, found in zip(_unpacked(batch.column(1)), ranges, strict=True):
                raw = np.frombuffer(text, np.uint8)
                starts, ends, _ = _text.word_spans(raw, np.array([0, len(raw)]))
                step = np.zeros(len(starts) + 1, np.int64)
                for r in found or ():
                    step[r // unit] += 1
                    step[r // unit + r % unit + window - 1] -= 1
                stays = np.flatnonzero(np.cumsum(step[:-1]) == 0)
                counts.append(len(starts))
                gone.append(len(starts) - len(stays))
                kept.append(b" ".join([text[i:j] for i, j in zip(starts[stays].tolist(), ends[stays].tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.large_binary()).cast(pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


@tidied
def drop_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept: each text without the words of any window that starts more than once in all texts, the rest joined by single spaces.

    Null and empty texts have no words. Windows are judged on the input alone. Rows need a doc_id of their own; rows that share one, or
    have none, are told apart by a number made here for the whole job, so repeated rows are each other's repeats.

    1. Recompression turns each text into pieces (see above). Anchors that occur once end here; counts by anchor are summed within tasks before they move, and hot anchors are never gathered.
    2. A piece whose words occur again around the same anchor has only repeated windows. Pieces of an anchor with different words are contested: one of each span goes on, with the others' weight.
    3. Of contested pieces the windows' words are digested and counted.
    Texts move compressed, by document.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    unique = rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").limit(1).count() == 0
    if not unique:
        rows = materialize(rows.withColumn("own", F.monotonically_increasing_id()))
        names, rows = rows.select("own", "doc_id"), rows.select(F.col("own").alias("doc_id"), "text")
    found = materialize(rows.mapInArrow(_pieces(window, rounds), "doc_id long, piece long, anchor long, span binary"))
    anchors = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("span").alias("lo"), F.max("span").alias("hi"))
    anchors = materialize(anchors.filter("n > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("contested")))
    shared = materialize(found.join(anchors, "anchor"))
    own = F.xxhash64("doc_id", "piece")
    spans = materialize(shared.groupBy("anchor", "span").agg(F.count("*").alias("copies"), F.min(own).alias("chosen")).filter("copies > 1"))
    judged = materialize(shared.join(spans, ["anchor", "span"], "left").select("doc_id", "piece", "contested", "copies", (F.coalesce(F.col("chosen") == own, F.lit(True)) & F.col("contested")).alias("asked")))
    packed = rows.mapInArrow(_packed, "doc_id long, packed binary")
    asked = judged.filter("asked").groupBy("doc_id").agg(F.collect_list(F.struct("piece", F.coalesce("copies", F.lit(1)).cast("int").alias("weight"))).alias("wanted"))
    windows = packed.join(asked, "doc_id").select("doc_id", "packed", "wanted").mapInArrow(_windows(window), "doc_id long, at int, weight int, words binary")
    windows = materialize(windows)
    again = materialize(windows.groupBy("words").agg(F.sum("weight").alias("n")).filter("n > 1").select("words"))
    singles = windows.filter("weight = 1").join(again, "words", "left_semi").select("doc_id", (F.col("at").cast("long") * (window + 1) + 1).alias("piece"))
    repeated = singles.union(judged.filter("copies > 1").select("doc_id", "piece")).groupBy("doc_id").agg(F.collect_list("piece").alias("repeated"))
    out = packed.join(repeated, "doc_id", "left").select("doc_id", "packed", "repeated").mapInArrow(_removed(window), KEPT)
    if not unique:
        out = out.withColumnRenamed("doc_id", "own").join(names, "own").select("doc_id", "n_words", "n_removed", "kept")
    return out


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """n_words, n_removed and kept_sha256 of each text, by comparing all windows; for tests."""
    import re

    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen: dict[tuple, int] = {}
    for w in words:
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for w in words:
        gone = set()
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone.update(range(p, p + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
