"""SentencePiece encoding and decoding by a batched Viterbi search in numpy."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ridgeline.llm import _text

SPACE = "▁"
#: Path of the vocabulary file; never a part of the repository.
DEFAULT_MODEL = os.environ.get("PIECES_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
SLICE_BYTES = 1 << 19
#: Leading bits of a hash that tell most substrings from all pieces before the search among sorted keys.
SIEVE_BITS = 20
#: Words of one length that advance together at most.
TOGETHER = 1 << 13
NONE = np.int64(-1)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces sorted by the hash of their characters, with what decides which neighbours can stand side by side."""

    keys: np.ndarray  # sorted hashes of pieces
    ids: np.ndarray  # their piece ids
    rank: np.ndarray  # by id: place in the order of merges, -1 for single characters, which no merge makes
    left: np.ndarray  # by id: the two pieces whose merge makes a piece, -1 for single characters
    right: np.ndarray
    hashes: np.ndarray  # by id: polynomial hash before mixing
    sizes: np.ndarray  # by id: characters
    score: np.ndarray  # by id
    byte_ids: np.ndarray
    longest: int
    pieces: tuple[bytes, ...]  # by id: what it stands for in UTF-8, spaces restored
    unknown: int
    sieve: np.ndarray  # by leading bits of a hash: whether any key has them


def _hash(points: np.ndarray) -> np.uint64:
    up, _ = _text.powers(max(1, len(points)))
    return ((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)]).sum(dtype=np.uint64)


def _points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), np.uint32)


def load(path: str = DEFAULT_MODEL) -> Vocabulary:
    """The vocabulary of a model file of the kind that merges pairs by score and falls back to bytes."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(size)]
    special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
    scores = np.array([model.get_score(i) for i in range(size)])
    byte_ids = np.zeros(256, np.int64)
    stands = []
    for i, name in enumerate(names):
        if model.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
            stands.append(bytes([int(name[3:5], 16)]))
        else:
            stands.append(b"" if i in special else name.replace(SPACE, " ").encode())
    order = {s: n for n, s in enumerate(sorted(set(-scores)))}
    known = {name: i for i, name in enumerate(names) if i not in special}
    rank, left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    reached = []
    for name, i in known.items():
        parts = list(name)
        # the merges of the piece's own characters: best score first, leftmost among equals
        while len(parts) > 2:
            found = [(order[-scores[known[p + q]]], k) for k, (p, q) in enumerate(zip(parts, parts[1:], strict=False)) if p + q in known]
            if not found:
                break
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if len(name) == 1:
            reached.append(i)
        elif len(parts) == 2 and parts[0] in known and parts[1] in known:
            rank[i], left[i], right[i] = order[-scores[i]], known[parts[0]], known[parts[1]]
            reached.append(i)
    hashes, sizes = np.zeros(size, np.uint64), np.zeros(size, np.int64)
    for i in known.values():
        hashes[i], sizes[i] = _hash(_points(names[i])), len(names[i])
    reached = np.array(sorted(reached), np.int64)
    keys = _text.mix(hashes[reached])
    by = np.argsort(keys)
    sieve = np.zeros(1 << SIEVE_BITS, bool)
    sieve[keys >> np.uint64(64 - SIEVE_BITS)] = True
    return Vocabulary(keys[by], reached[by], rank, left, right, hashes, sizes, scores, byte_ids, int(sizes.max()), tuple(stands), model.unk_id(), sieve)


def _probe(v: Vocabulary, hashes: np.ndarray) -> np.ndarray:
    """Piece ids of polynomial hashes, NONE where no piece has it."""
    out = np.full(hashes.shape, NONE)
    keys = _text.mix(hashes)
    some = np.nonzero(v.sieve[keys >> np.uint64(64 - SIEVE_BITS)])
    keys = keys[some]
    at = np.minimum(np.searchsorted(v.keys, keys), len(v.keys) - 1)
    out[some] = np.where(v.keys[at] == keys, v.ids[at], NONE)
    return out


def side_by_side(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging pairs by score leaves the pieces a and b as they are where they meet.

    The merges inside the two are undone, the latest first; the pair may at no time have had a merge of its own that came before
    the one undone. Of merges with equal scores the leftmost comes first.
    """
    a, b, n = a.copy(), b.copy(), len(a)
    limit = np.full(n, np.iinfo(np.int64).max)
    fits, live = np.ones(n, bool), np.arange(n)
    up, _ = _text.powers(2 * v.longest + 2)
    while len(live):
        x, y = a[live], b[live]
        both = _probe(v, v.hashes[x] + v.hashes[y] * up[v.sizes[x]])
        early = (both >= 0) & (v.rank[both] < limit[live])
        fits[live[early]] = False
        live, x, y = live[~early], x[~early], y[~early]
        first = v.rank[x] > v.rank[y]  # the merge inside a is the later one, or else that inside b, also among equals
        done = (v.rank[x] < 0) & (v.rank[y] < 0)
        inner = np.where(first, v.rank[x], v.rank[y])
        limit[live] = np.where(first, inner, inner + 1)
        a[live] = np.where(first & ~done, v.right[x], x)
        b[live] = np.where(~first & ~done, v.left[y], y)
        live = live[~done]
    return fits


class Encoder:
    """Encodes texts. Verdicts on pairs of pieces and the pieces of the first MOST_WORDS words stay for later batches; both only save repeats.

    A verdict has one slot by the hash of its pair, where a later pair replaces it, so that the table neither grows nor needs an order.
    """

    PAIR_BITS, MOST_WORDS = 20, 1 << 18

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pairs, self.fits = np.full(1 << self.PAIR_BITS, NONE), np.zeros(1 << self.PAIR_BITS, bool)
        # words met before, sorted by hash: where their pieces start in flat, and how many they are
        self.met, self.met_where, self.met_count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * len(self.v.rank) + b
        slot = (keys.astype(np.uint64) * _text.BASE) >> np.uint64(64 - self.PAIR_BITS)
        out = self.fits[slot]
        new = np.flatnonzero(self.pairs[slot] != keys)
        if len(new):
            asked, example, inverse = np.unique(keys[new], return_index=True, return_inverse=True)
            verdict = side_by_side(self.v, asked // len(self.v.rank), asked % len(self.v.rank))
            out[new] = verdict[inverse]
            # of pairs that share a slot one stays, key and verdict alike
            slots, one = np.unique(slot[new[example]], return_index=True)
            self.pairs[slots], self.fits[slots] = asked[one], verdict[one]
        return out

    def words(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """points: words of one length, a row each. Piece ids of the best path of each, NONE - code point for characters without a piece, and their number.

        best[i] is the score of the best path to place i. A piece that ends there extends the path to its start unless the last piece of that
        path and it could not stand side by side; the maximum over lengths is taken for all words at once and its length stored.
        """
        v, (n, length) = self.v, points.shape
        up, down = _text.powers(length + 1)
        sums = np.zeros((n, length + 1), np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:length], axis=1, out=sums[:, 1:])
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        last, back = np.full((n, length + 1), NONE), np.zeros((n, length + 1), np.int64)
        for i in range(1, length + 1):
            starts = np.arange(i - 1, max(-1, i - 1 - v.longest), -1)
            ids = _probe(v, (sums[:, i : i + 1] - sums[:, starts]) * down[starts])
            before = last[:, starts]
            single = ids[:, 0] < 0
            value = np.where(ids >= 0, best[:, starts] + v.score[ids], -np.inf)
            r, c = np.nonzero((value > -np.inf) & (before >= 0))
            if len(r):
                value[r, c] = np.where(self._allowed(before[r, c], ids[r, c]), value[r, c], -np.inf)
            k = value.argmax(axis=1)
            rows = np.arange(n)
            best[:, i] = value[rows, k]
            last[:, i], back[:, i] = ids[rows, k], k + 1
            # a character that is no piece is a step of its own, and nothing merges with it
            best[single, i], last[single, i], back[single, i] = best[single, i - 1], NONE - 1 - points[single, i - 1].astype(np.int64), 1
        out, counts, place = np.full((n, length), NONE), np.zeros(n, np.int64), np.full(n, length)
        live = np.arange(n)
        while len(live):
            out[live, length - 1 - counts[live]] = last[live, place[live]]
            counts[live] += 1
            place[live] -= back[live, place[live]]
            live = live[place[live] > 0]
        return out, counts

    def encode(self, column: pa.Array) -> pa.Array:
        """Piece ids of each whole text; null and empty texts have none."""
        raw, at = _text.utf8(column)
        parts = [self._slice(raw[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in _text.slices(at, SLICE_BYTES)]
        values = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int32)
        counts = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values, pa.int32()))

    def _slice(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(at) - 1
        lead = (raw & 0xC0) != 0x80
        bounds = np.concatenate(([0], np.cumsum(lead)))[at]
        text = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        some = np.diff(bounds) > 0
        # a space before each text, then every space is the mark that pieces carry
        starts = bounds[:-1][some]
        points = np.insert(text, starts, 32)
        space = ord(SPACE)
        points[points == 32] = space
        starts = starts + np.arange(len(starts))
        # pieces hold the mark only at their start, so a run of marks and what follows it is a unit that nothing crosses
        begins = (points == space) & np.concatenate(([True], points[:-1] != space))
        begins[starts] = True
        first = np.flatnonzero(begins)
        ends = np.append(first[1:], len(points))
        row = np.searchsorted(starts, first, "right") - 1
        sizes = ends - first
        names = _text.span_hashes(points.view(np.uint8), 4 * first, 4 * ends)
        words, example, inverse = np.unique(names, return_index=True, return_inverse=True)
        lengths, where = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.met, words), max(0, len(self.met) - 1))
        known = self.met[at] == words if len(self.met) else np.zeros(len(words), bool)
        lengths[known], where[known] = self.met_count[at[known]], self.met_where[at[known]]
        ids, total = [self.flat], len(self.flat)
        fresh = np.flatnonzero(~known)
        for length in np.unique(sizes[example[fresh]]):
            own = fresh[sizes[example[fresh]] == length]
            together = max(1, min(TOGETHER, (1 << 18) // int(length)))
            for low in range(0, len(own), together):
                some_words = own[low : low + together]
                found, counts = self.words(points[first[example[some_words]][:, None] + np.arange(length)])
                pieces, counts = self._bytes(found[found != NONE], counts)
                lengths[some_words] = counts
                where[some_words] = total + np.concatenate(([0], np.cumsum(counts)[:-1]))
                total += len(pieces)
                ids.append(pieces.astype(np.int32))
        flat = np.concatenate(ids)
        if len(fresh) and len(self.met) < self.MOST_WORDS:
            merged = np.concatenate((self.met, words[fresh]))
            order = np.argsort(merged, kind="stable")
            self.met, self.flat = merged[order], flat
            self.met_where, self.met_count = np.concatenate((self.met_where, where[fresh]))[order], np.concatenate((self.met_count, lengths[fresh]))[order]
        counts = lengths[inverse]
        ends = np.cumsum(counts)
        take = np.repeat(where[inverse] - np.concatenate(([0], ends[:-1])), counts) + np.arange(int(counts.sum()))
        per_row = np.zeros(n, np.int64)
        per_row[some] = np.bincount(row, counts, minlength=int(some.sum())).astype(np.int64)
        return flat[take], per_row

    def _bytes(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as the pieces of their bytes."""
        odd = np.flatnonzero(flat < NONE)
        if not len(odd):
            return flat, counts
        word = np.repeat(np.arange(len(counts)), counts)
        spelled = [self.v.byte_ids[np.frombuffer(chr(int(NONE - 1 - flat[k])).encode(), np.uint8)] for k in odd]
        grown = np.ones(len(flat), np.int64)
        grown[odd] = [len(x) for x in spelled]
        out = np.repeat(flat, grown)
        out[np.repeat(flat < NONE, grown)] = np.concatenate(spelled)
        return out, np.bincount(word, grown, minlength=len(counts)).astype(np.int64)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(model: str, shared) -> Encoder:
    """The encoder of a worker process, which keeps it for its later tasks with the same model file."""
    if model not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[model] = Encoder(shared.value)
    return _ENCODERS[model]


def decode(v: Vocabulary, column: pa.Array) -> pa.Array:
    """Texts of lists of piece ids: what the pieces stand for, without the space before the text. Bytes that are no UTF-8 become U+FFFD; null gives an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    table = pa.array(v.pieces, pa.large_binary())
    flat = pc.take(table, column.flatten())
    _, offsets, data = flat.buffers()
    offsets = np.frombuffer(offsets, np.int64)[flat.offset : flat.offset + len(flat) + 1]
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    raw = data.to_pybytes() if data is not None else b""
    return pa.array([raw[offsets[a] : offsets[b]].decode("utf-8", "replace")[1:] if b > a else "" for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.large_string()).cast(pa.string())


def encode_texts(docs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """docs with pieces (array of ids), n_pieces and decoded_equal (whether decoding gives the text back). Null texts count as empty: no pieces. Columns of docs by these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))  # of the vocabulary's size, whatever the data

    def run(column: pa.Array) -> list[pa.Array]:
        ids = _encoder(model, shared).encode(column)
        same = pc.equal(decode(shared.value, ids), column.fill_null(""))
        return [ids, pc.list_value_length(ids).cast(pa.int64()), same]

    return _text.append(docs, "text", "pieces array<int>, n_pieces long, decoded_equal boolean", run)


def decode_pieces(encoded: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """encoded (with a column pieces) with a column decoded."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(model))
    names = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, decode(shared.value, batch.column("pieces"))], names=[*names, "decoded"])

    from pyspark.sql.types import StringType, StructField, StructType

    kept = encoded.select(*names)
    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("decoded", StringType())]))
