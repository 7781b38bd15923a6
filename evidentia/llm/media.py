"""Media columns: interleaved document sequences whose media references are resolved by digest.

HTML becomes an ordered array of text and media-reference structs; a media reference keeps its place and its caption (its figure's, else its alt text).
References name payloads by digest. A media table holds each payload once, as a PNG whose pixels are the payload's bytes; stored bytes are read back
and described once per digest, so that a join moves descriptions, never payloads, however often a digest is referred to.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise, tune

#: A PNG row: 64 pixels of three 8-bit samples. Payloads are padded to whole rows.
ROW = 192
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
ITEMS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
FACTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li tr br article section table ul ol blockquote pre figure header footer main".split())
_SKIPPED = frozenset("script style noscript template nav head".split())


def to_png(payload: bytes) -> bytes:
    """An 8-bit RGB PNG of 64 columns that holds the payload, whose length is a positive multiple of ROW."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    height = len(payload) // ROW
    rows = np.zeros((height, ROW + 1), np.uint8)  # the first byte of a row: no filter
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)
    head = struct.pack(">IIBBBBB", ROW // 3, height, 8, 2, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of a PNG that to_png() made; ValueError for anything else."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, data, head = 8, [], None
    while at + 12 <= len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if head is None or head[0] != ROW // 3 or head[2:4] != (8, 2):
        raise ValueError("another form of PNG")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(head[1], ROW + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Means of the three channels in thousandths, and the average hash of the picture in 8 by 8 tiles."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3)
    sums = pixels.sum(axis=(0, 1), dtype=np.int64)
    means = sums * 1000 // (len(pixels) * 64)
    columns = pixels.reshape(len(pixels), 8, 24).sum(axis=2, dtype=np.int64)
    edges = np.arange(8) * len(pixels) // 8
    tiles = np.stack([columns[a : max(b, a + 1)].sum(axis=0) * 1000 // max(b - a, 1) for a, b in zip(edges, [*edges[1:], len(pixels)], strict=True)])
    bits = (tiles * 64 > tiles.sum()).ravel()
    return "-".join(map(str, means.tolist())) + ":" + np.packbits(bits).tobytes().hex()


def store(docs: DataFrame, id_cols: list[str], payload_col: str = "text") -> DataFrame:
    """(id_cols, n_bytes, digest, media): each text's UTF-8, padded with spaces to whole rows, as a PNG named by its SHA-256.

    A null text counts as empty. Copies within a task have their media once; the others have null there and the same digest.
    """
    tune(docs.sparkSession)
    plain = docs.select(F.struct(*id_cols).alias("id"), F.col(payload_col).cast("string").alias("payload"))
    kind = plain.schema["id"].dataType.simpleString()

    def run(batches):
        seen: dict[bytes, str] = {}
        for batch in batches:
            n, digests, media = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                text = text or b""
                n.append(len(text))
                key = hashlib.sha256(text).digest()
                made = None
                if key not in seen:
                    made = to_png(text + b" " * (-len(text) % ROW if text else ROW))
                    seen[key] = hashlib.sha256(made).hexdigest()
                digests.append(seen[key])
                media.append(made)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(media, pa.binary())], ["id", "n_bytes", "digest", "media"])

    return map_batches(plain, run, f"id {kind}, n_bytes long, digest string, media binary").select("id.*", "n_bytes", "digest", "media")


class _Parser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.skip = 0
        self.figure = self.caption = None

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag in _SKIPPED:
            self.skip += 1
        if tag in _BLOCKS:
            self.flush()
        if tag == "figure":
            self.figure = []
        if tag == "figcaption":
            self.flush()
            self.caption = []
        if tag in ("img", "video", "audio", "source", "embed") and own.get("src") and not self.skip:
            self.flush()
            src = own["src"]
            self.items.append({"kind": "media", "text": None, "digest": src.split(":", 1)[1].lower() if src.lower().startswith("sha256:") else None, "caption": own.get("alt") or None})
            if self.figure is not None:
                self.figure.append(self.items[-1])

    def handle_endtag(self, tag):
        if tag in _SKIPPED and self.skip:
            self.skip -= 1
        if tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for item in self.figure or []:
                item["caption"] = text or item["caption"]
            self.caption = None
        if tag in _BLOCKS:
            self.flush()
        if tag == "figure":
            self.figure = None

    def handle_data(self, data):
        if not self.skip:
            (self.text if self.caption is None else self.caption).append(data)


def parse_html(html: str | None) -> list[dict]:
    """Ordered text and media items; a broken or empty page gives what can be read, or nothing."""
    parser = _Parser()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return [{"position": k, **x} for k, x in enumerate(parser.items)]


def sequences(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without html_col, with items: the page's texts and media references in order."""
    tune(pages.sparkSession)
    rest = [F.col(f"`{c}`") for c in pages.columns if c not in (html_col, "items")]
    plain = pages.select(F.struct(*rest).alias("row"), F.col(html_col).cast("string").alias("html"))
    kind = plain.schema["row"].dataType.simpleString()
    item = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parse_html(x) for x in batch.column(1).to_pylist()], item)], ["row", "items"])

    return map_batches(plain, run, f"row {kind}, items {ITEMS}").select("row.*", "items")


def describe(media: DataFrame) -> DataFrame:
    """(digest, FACTS) of each stored payload, read back from (digest, media). Media that are damaged or not what their digest says are left out."""

    def run(batches):
        for batch in batches:
            rows = []
            for digest, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own is None or hashlib.sha256(own).hexdigest() != digest:
                    continue
                try:
                    payload = from_png(own)
                except (ValueError, zlib.error, struct.error):
                    continue
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(own), digest, features(payload)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    found = map_batches(media.select("digest", "media").filter("media is not null"), run, f"digest string, {FACTS}")
    return found.dropDuplicates(["digest"])


def interleave(pages: DataFrame, media: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without html_col, with items: texts and media in order, each medium with what describe() reads of it.

    An unknown or damaged digest leaves the medium's facts null, the item stays in place. Null or empty html has no items. Every row stays, repeated
    ones too; an empty table gives an empty result; columns of pages named items are replaced.
    """
    keyed = materialise(sequences(pages, html_col).withColumn("_key", F.monotonically_increasing_id()))
    # written, so that the join's two sides are plain shuffles and a digest with many references can be split
    facts = materialise(describe(media))
    names = [f.name for f in facts.schema if f.name != "digest"]
    # references without their texts; what has no digest must not meet under one key
    known = keyed.select("_key", F.explode(F.filter("items", lambda i: i["digest"].isNotNull())).alias("i")).select("_key", "i.position", "i.digest").join(facts, "digest")
    known = known.groupBy("_key").agg(F.collect_list(F.struct("position", *names)).alias("_known"))

    def whole(item: F.Column) -> F.Column:
        fact = F.get(F.filter("_known", lambda k: k["position"] == item["position"]), F.lit(0))
        return F.struct(*[item[n].alias(n) for n in ("position", "kind", "text", "digest", "caption")], *[fact[n].alias(n) for n in names])

    return keyed.join(known, "_key", "left").withColumn("items", F.transform("items", whole)).drop("_key", "_known")
