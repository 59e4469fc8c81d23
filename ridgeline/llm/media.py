"""Media columns: interleaved sequences of text and media from HTML, payloads resolved by digest."""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm._store import materialize, tidied

#: Payload bytes are padded with zeros to a multiple of the image's width and stored as 8-bit grey samples.
WIDTH = 64
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
SCHEME = "media:"
ITEM = ("position", "kind", "text", "digest", "source", "alt", "caption")
ITEMS = "items array<struct<position: int, kind: string, text: string, digest: string, source: string, alt: string, caption: string>>"


# ---- the stored form: PNG, one grey byte a sample, no filter, so samples are the payload's bytes


def pad(data: bytes) -> bytes:
    return data + b"\0" * ((-len(data)) % WIDTH or (WIDTH if not data else 0))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes) -> bytes:
    """A PNG whose samples are the payload, a positive multiple of WIDTH bytes."""
    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return PNG_MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> bytes:
    """The samples of a stored image; ValueError if it is damaged or of another form."""
    if media[:8] != PNG_MAGIC:
        raise ValueError("not a PNG")
    at, body, size = 8, b"", None
    while at < len(media):
        length, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + length]
        if zlib.crc32(kind + data) != struct.unpack(">I", media[at + 8 + length : at + 12 + length])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body += data
        at += 12 + length
    if size is None or size[0] != WIDTH or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("another form of image")
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(size[1], WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the mean step between rows."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    share = share[share > 0]
    rows = x.reshape(-1, WIDTH).astype(np.int16)
    step = float(np.abs(np.diff(rows, axis=0)).mean()) if len(rows) > 1 else 0.0
    return f"h={len(rows)};mean={x.mean():.4f};sd={x.std():.4f};entropy={0.0 - (share * np.log2(share)).sum():.4f};step={step:.4f}"


# ---- interleaved sequences


class _Figure:
    def __init__(self):
        self.media: list[dict] = []
        self.caption: list[str] = []
        self.in_caption = False


class _Sequence(HTMLParser):
    """Ordered items of a page: runs of text, and media references with their captions."""

    #: What may stand in a head: anything else ends it, as end tags may be left out. What is never shown. What ends a run of text. What refers to media.
    HEAD = frozenset({"base", "link", "meta", "noscript", "script", "style", "template", "title"})
    SILENT = frozenset({"noscript", "script", "style", "template", "title"})
    BREAKS = frozenset({"article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul"})
    MEDIA = frozenset({"audio", "img", "source", "video"})

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.head, self.open = False, False
        self.silent: list[str] = []
        self.figures: list[_Figure] = []

    def parse_marked_section(self, i, report=1):
        """`<![` opens a comment up to the next `>` in a page; the base class raises on most of these."""
        return self.parse_bogus_comment(i)

    def handle_starttag(self, tag, attrs):
        if tag == "head":
            self.head = True
            return
        if self.head and tag not in self.HEAD and not {"noscript", "template"}.intersection(self.silent):
            self._shown()
        if tag in self.SILENT:
            self.silent.append(tag)
        if tag in self.BREAKS:
            self._break()
        if tag == "figure":
            self.figures.append(_Figure())
        if tag == "figcaption" and self.figures:
            self.figures[-1].in_caption = True
        if tag in self.MEDIA and not self.silent and (source := dict(attrs).get("src")):
            item = {"kind": tag, "digest": source.removeprefix(SCHEME) if source.startswith(SCHEME) else None, "source": source, "alt": dict(attrs).get("alt")}
            self.items.append(item)
            self.open = False
            if self.figures:
                self.figures[-1].media.append(item)

    def handle_endtag(self, tag):
        if tag == "head":
            self._shown()
        if tag in self.silent:
            del self.silent[len(self.silent) - 1 - self.silent[::-1].index(tag) :]
        if tag in self.BREAKS:
            self._break()
        if self.figures:
            if tag == "figcaption":
                self.figures[-1].in_caption = False
            if tag == "figure":
                self._captioned(self.figures.pop())

    def handle_data(self, data):
        blank = not data.strip()
        if self.silent or (self.head and blank):
            return
        self._shown()
        if self.figures and self.figures[-1].in_caption:
            self.figures[-1].caption.append(data)
        elif self.open:
            self.items[-1]["text"] += data
        elif not blank:
            self.items.append({"kind": "text", "text": data})
            self.open = True

    def close(self):
        super().close()
        while self.figures:
            self._captioned(self.figures.pop())

    def _shown(self):
        """The head is over, and with it what was left open there."""
        if self.head:
            self.head, self.silent = False, []

    def _break(self):
        if self.figures and self.figures[-1].in_caption:
            self.figures[-1].caption.append(" ")
        else:
            self.open = False

    def _captioned(self, figure: _Figure):
        if caption := " ".join("".join(figure.caption).split()):
            for item in figure.media:
                item["caption"] = caption


def parse(page: str | None) -> list[dict]:
    """Items of a page in their order; none for null. position counts all items.

    A text item is a run of shown text up to the next block, line break or reference, without white space at its ends. A reference has its source, the digest that it
    names, if any, and as caption the text of its own figure's figcaption, wherever that stands in the figure, else its alt text. Elements that are not closed end with
    the page; a head ends with the first element or text that cannot stand in it.
    """
    sequence = _Sequence()
    sequence.feed(page or "")
    sequence.close()
    out = []
    for i, item in enumerate(sequence.items):
        own = dict.fromkeys(ITEM) | item | {"position": i}
        own["text"] = own["text"] and own["text"].strip()
        own["caption"] = own["caption"] or own["alt"]
        out.append(own)
    return out


def sequences(pages: DataFrame, key: str, page: str) -> DataFrame:
    """key and items, one row per page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(name, pa.int32() if name == "position" else pa.string()) for name in ITEM]))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parse(x) for x in batch.column(1).to_pylist()], kind)], names=["key", "items"])

    kind = dict(pages.dtypes)[key]
    return pages.select(F.col(key).alias("key"), F.col(page).cast("string")).mapInArrow(run, f"key {kind}, {ITEMS}")


def references(found: DataFrame) -> DataFrame:
    """The media items of sequences(): key, position, kind, digest, source, alt, caption. Positions count all items, so references stay aligned with the text around them."""
    items = found.select("key", F.explode(F.filter("items", lambda i: i["kind"] != "text")).alias("item"))
    return items.select("key", *[f"item.{c}" for c in ITEM if c != "text"])


def resolve(found: DataFrame, store: DataFrame, carry: list[str]) -> DataFrame:
    """References joined to the rows of a store (digest, ...) that has each digest once; columns named in carry are null where the store lacks the digest."""
    return found.join(store.select("digest", *carry), "digest", "left")


# ---- the store that a table of texts gives


def page_of(digest: str, key: str) -> str:
    """A page that shows a document's payload between two lines of text."""
    name = html.escape(f"document {key}")
    return f'<html><body><p>{name}</p><figure><img src="{SCHEME}{digest}"><figcaption>payload of {name}</figcaption></figure><p>end</p></body></html>'


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, page, digest, n_bytes, media: for each row the page that shows its payload, and, where it is the first of its text in a batch, the padded payload as a stored image; else media is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
        for batch in batches:
            seen: set[str] = set()
            for low in range(0, batch.num_rows, 256):
                part, rows = batch.slice(low, 256), []
                for key, text in zip(part.column(0), part.column(1), strict=True):
                    data = (text.as_py() or "").encode()
                    digest = hashlib.sha256(data).hexdigest()
                    rows.append((page_of(digest, str(key)), digest, len(data), None if digest in seen else encode(pad(data))))
                    seen.add(digest)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]], names=["doc_id", "page", "digest", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, page string, digest string, n_bytes long, media binary")


DIGEST_COLUMNS = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(store: DataFrame) -> DataFrame:
    """What the stored bytes of each digest hold, read from the media themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, n, media in zip(*batch.columns, strict=True):
                media = media.as_py()
                payload = decode(media)
                rows.append((digest.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = [x.split()[0] for x in DIGEST_COLUMNS.split(", ")]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return store.select("digest", "n_bytes", "media").mapInArrow(run, DIGEST_COLUMNS)


@tidied
def text_media(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id and the columns that read_back gives for its text, with the position and caption of its reference.

    Each document is shown by a page, the page is parsed into its interleaved sequence, and the reference is resolved by digest. A null text is an empty one, whose payload is WIDTH zeros.
    Images are written to a table of their own and read back from there; where a text has several copies of its image, from different batches, one
    row of facts stays. Only the small facts are joined to the references, so a digest of very many documents moves no more bytes than another.
    """
    store = materialize(stored(docs))
    # written, so that the join below is of two plain shuffles, of which Spark splits a digest of very many documents
    facts = materialize(read_back(store.filter("media IS NOT NULL")).dropDuplicates(["digest"]))
    found = references(sequences(store, "doc_id", "page"))
    carry = [x.split()[0] for x in DIGEST_COLUMNS.split(", ")[1:]]
    return resolve(found, facts, carry).select(F.col("key").alias("doc_id"), *carry, "position", "caption")
