"""Media columns: interleaved sequences of text and media references, resolved by digest.

Pages are parsed into ordered items, texts and media references with captions. Media
live in a table of their own under the digest of their stored form; references meet what
is wanted of them by a join on that digest, and each page's items come back in order.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import documents, ship, stash

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
ITEMS = "array<struct<position:int,kind:string,text:string,media:string,caption:string>>"


# -- stored form: 8-bit grey PNG, 64 samples a row ---------------------------------------------------------------------


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def padded(data: bytes) -> bytes:
    """`data` and zero bytes up to a positive multiple of WIDTH."""
    return data + bytes(max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """A payload of a positive multiple of WIDTH bytes as an image, without loss."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row starts with its filter, none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of an 8-bit grey image without interlacing, of any row filters; checks every chunk's sum."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, width, height = 8, [], 0, 0
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("only 8-bit grey without interlacing is read")
        elif kind == b"IDAT":
            packed.append(body)
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if not lines[:, 0].any():
        return lines[:, 1:].tobytes()
    out = np.zeros((height, width), np.int64)
    for y in range(height):
        kind, row = int(lines[y, 0]), lines[y, 1:].astype(np.int64)
        up = out[y - 1] if y else np.zeros(width, np.int64)
        if kind == 2:
            row = (row + up) & 255
        elif kind in (1, 3, 4):
            for x in range(width):
                a, b, c = (row[x - 1] if x else 0), up[x], (up[x - 1] if x else 0)
                if kind == 1:
                    add = a
                elif kind == 3:
                    add = (a + b) // 2
                else:
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    add = a if da <= db and da <= dc else b if db <= dc else c
                row[x] = (row[x] + add) & 255
        out[y] = row
    return out.astype(np.uint8).tobytes()


def _features(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the shares of their sixteen ranges."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256).astype(np.float64)
    share, values = counts / counts.sum(), np.arange(256)
    mean = float((share * values).sum())
    deviation = float(np.sqrt((share * (values - mean) ** 2).sum()))
    some = share[share > 0]
    ranges = ",".join(f"{x:.4f}" for x in share.reshape(16, 16).sum(1))
    return f"mean={mean:.4f};deviation={deviation:.4f};entropy={float(-(some * np.log2(some)).sum()):.4f};ranges={ranges}"


# -- the media table ---------------------------------------------------------------------------------------------------


def stored(df: DataFrame, key: str, text: str) -> DataFrame:
    """Every row's text (null: empty) as media: key, n_bytes, digest (SHA-256 of the stored form), media."""
    ship(df.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), 256):
                batch = whole.slice(k, 256)
                data = [(x or "").encode() for x in batch.column(1).to_pylist()]
                media = [to_png(padded(x)) for x in data]
                columns = [
                    batch.column(0),
                    pa.array(map(len, data), pa.int64()),
                    pa.array((hashlib.sha256(x).hexdigest() for x in media), pa.string()),
                    pa.array(media, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [key, "n_bytes", "digest", "media"])

    return df.select(F.col(key).cast("long"), text).mapInArrow(encode, f"{key} long, n_bytes long, digest string, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """One row per digest of a media table (digest, media): what its stored bytes say when they are read back.

    Rows of one digest are equal, so any of them serves. Stored bytes that don't have
    their digest or can't be decoded stop the job: a store must not be silently wrong.
    """
    ship(media.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), 256):
                batch = whole.slice(k, 256)
                rows = []
                for digest, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if (own := hashlib.sha256(data).hexdigest()) != digest:
                        raise ValueError(f"stored bytes of {digest} have the digest {own}")
                    payload = from_png(data)
                    rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), _features(payload)))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    rows = media.select("digest", "media").mapInArrow(decode, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string")
    return rows.groupBy("digest").agg(*[F.first(c).alias(c) for c in names[1:]])


# -- interleaved items -------------------------------------------------------------------------------------------------


class _Items(HTMLParser):
    """Ordered texts and media references of a page; a figure's caption goes to its media, else the alt text.

    A caption without media in its figure is a text. References other than `sha256:...`
    are kept, as they are, with `every`.
    """

    BLOCKS = frozenset("address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
    MEDIA = frozenset("img audio video source embed".split())
    SILENT = frozenset("script style template".split())
    HEAD = frozenset("title base link meta script style noscript template".split())
    #: Their end tags also end a figure that began inside them.
    AROUND = frozenset("article aside body dd div dl footer form header li main nav ol section table td th tr ul".split())

    def __init__(self, every: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.every = every
        self.items: list[dict] = []
        self.text: list[str] = []
        self.silent = 0
        self.head = self.title = False
        self.figures: list[dict] = []  # open ones: media, parts of the caption and where it stood, blocks opened inside
        self.in_caption = False

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if not text:
            return
        if self.in_caption and self.figures:
            self.figures[-1]["caption"].append(text)
            return
        self.items.append({"kind": "text", "text": text, "media": None, "caption": None})

    def end_figure(self) -> None:
        self.flush()
        figure = self.figures.pop()
        self.in_caption = bool(self.figures) and self.figures[-1]["within"]
        caption = " ".join(figure["caption"])
        if caption and figure["media"]:
            for item in figure["media"]:
                item["caption"] = caption
        elif caption:
            self.items.insert(figure["at"], {"kind": "text", "text": caption, "media": None, "caption": None})
        elif self.figures:
            self.figures[-1]["media"].extend(figure["media"])

    def finish(self) -> None:
        while self.figures:
            self.end_figure()
        self.flush()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.head and tag not in self.HEAD:
            self.head = False
        if tag in self.SILENT:
            self.silent += 1
        elif tag == "head":
            self.head = True
        elif tag == "title":
            self.title = True
        elif tag in self.MEDIA:
            if self.silent:
                return
            own = dict(attrs)
            source = (own.get("src") or "").strip()
            if source.startswith("sha256:") or (self.every and source):
                self.flush()
                item = {"kind": "media", "text": None, "media": source.removeprefix("sha256:"), "caption": own.get("alt") or None}
                self.items.append(item)
                if self.figures:
                    self.figures[-1]["media"].append(item)
        elif tag in self.BLOCKS:
            self.flush()
            if tag == "figure":
                self.figures.append({"media": [], "caption": [], "at": 0, "inside": [], "within": False})
                self.in_caption = False
            elif self.figures:
                self.figures[-1]["inside"].append(tag)
                if tag == "figcaption":
                    if not self.figures[-1]["caption"]:
                        self.figures[-1]["at"] = len(self.items)
                    self.in_caption = self.figures[-1]["within"] = True

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "head":
            self.head = False
        elif tag == "title":
            self.title = False
        elif tag in self.BLOCKS:
            self.flush()
            if tag == "figure":
                if self.figures:
                    self.end_figure()
                return
            while self.figures and tag in self.AROUND and tag not in self.figures[-1]["inside"]:
                self.end_figure()
            if self.figures and tag in (inside := self.figures[-1]["inside"]):
                while inside.pop() != tag:
                    pass
                self.in_caption = self.figures[-1]["within"] = "figcaption" in inside

    def handle_data(self, data: str) -> None:
        if self.head and not self.title and not self.silent and data.strip():
            self.head = False
        if not self.silent and not self.head:
            self.text.append(data)


def page_items(html: str | None, every: bool = False) -> list[dict]:
    parser = _Items(every)
    parser.feed(html or "")
    parser.close()
    parser.finish()
    return [{"position": i, **item} for i, item in enumerate(parser.items)]


def interleaved(pages: DataFrame, html: str = "html") -> DataFrame:
    """`pages` with `items` in place of the HTML: texts and media references, in page order, numbered from 0.

    A reference `sha256:...` is given as its digest, every other `src` as it is. Null and empty pages have no items; a column named items is replaced.
    """
    ship(pages.sparkSession)
    pages = pages.drop("items")
    others = [c for c in pages.columns if c != html]
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("media", pa.string()), ("caption", pa.string())]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = pa.array([page_items(x, every=True) for x in batch.column(len(others)).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], items], [*others, "items"])

    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in others), f"items {ITEMS}"])
    return pages.select(*others, html).mapInArrow(parse, schema)


def resolve(rows: DataFrame, media: DataFrame) -> DataFrame:
    """`rows` (with items) where every media item has a struct `payload` of the columns of `media` (digest and others).

    References meet `media`, a written table of one row per digest, by a join that Spark
    can split where many refer to one digest. Items whose digest is unknown, and texts,
    have a null payload; order, captions and rows without items stay.
    """
    rows = stash(rows.withColumn("__row", F.monotonically_increasing_id()), "items")
    items = rows.select("__row", F.explode("items").alias("item"))
    named = media.select(F.col("digest").alias("__digest"), F.struct(*[c for c in media.columns if c != "digest"]).alias("payload"))
    met = items.where("item.media is not null").join(named, F.col("item.media") == F.col("__digest"), "left")
    every = met.select("__row", "item.*", "payload").unionByName(items.where("item.media is null").select("__row", "item.*"), allowMissingColumns=True)
    # a page's items are the group: bounded by the page
    grouped = every.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("position", "kind", "text", "media", "caption", "payload"))).alias("items"))
    return rows.drop("items").join(grouped, "__row", "left").drop("__row")


def op5_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes as media, referred to from a page, resolved by digest and read back.

    The page of a document has texts before, between and after two media: the stored
    payload in a figure, and one that the store doesn't have, whose payload stays null.
    Null texts count as empty. Equal texts have one digest and equal values in all columns
    but the id; every stored row is read back and held against its digest.
    """
    store = stash(stored(documents(spark, sf_dir), "doc_id", "text"), "media")
    features = stash(media_features(store), "media-features")
    page = F.concat(
        F.lit('<html><head><title>store</title><body><article><h1>A document</h1><p>What is stored:<figure><img src="sha256:'), F.col("digest"),
        F.lit('" alt="payload"><figcaption>'), F.col("n_bytes").cast("string"), F.lit(' bytes</figcaption></figure><p>What is not: <img src="absent-'),
        F.col("digest"), F.lit('.png" alt="absent"> and the end.</article>'),
    )
    resolved = resolve(interleaved(store.select("doc_id", "n_bytes", page.alias("html"))), features)
    media = F.filter("items", lambda x: x["kind"] == "media")
    texts = F.transform(F.filter("items", lambda x: x["kind"] == "text"), lambda x: F.concat(x["position"].cast("string"), F.lit(":"), x["text"]))
    rows = resolved.select("doc_id", "n_bytes", media[0].alias("m"), media[1].alias("other"), texts.alias("texts"))
    return rows.select(
        "doc_id",
        "n_bytes",
        "m.payload.payload_bytes",
        "m.payload.payload_sha256",
        "m.payload.tail_crc32",
        "m.payload.media_bytes",
        F.col("m.media").alias("media_sha256"),
        "m.payload.feature",
        F.col("m.position").alias("position"),
        F.col("m.caption").alias("caption"),
        F.col("other.position").alias("absent_position"),
        F.col("other.caption").alias("absent_caption"),
        F.col("other.payload").isNull().alias("absent_unresolved"),
        F.array_join("texts", "|").alias("texts"),
    )
