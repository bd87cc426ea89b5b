"""Operator 5: interleaved sequences of text and media.

A page's HTML is parsed into an ordered sequence of text runs and media references (digest and caption), each with its
position. Payloads lie once in a media table under their digest; a join by digest resolves the references, and position and
caption stay with each row, so sequences can be put together again in order. Media are stored as 8-bit RGB PNG images.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

#: Bytes of an image row: 64 RGB samples.
ROW = 192
#: From which share of the references on a digest is resolved by a broadcast, from how many at least, and up to how many bytes of media in all.
HOT_SHARE, HOT_LEAST, HOT_BYTES = 200, 500, 32 << 20
_SIGN = b"\x89PNG\r\n\x1a\n"
_REF = "media:"


def padded(text: str | None) -> bytes:
    """The text's bytes, filled with blanks up to a positive multiple of ROW."""
    data = (text or "").encode()
    return data.ljust(max(1, -(-len(data) // ROW)) * ROW, b" ")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def store(payload: bytes) -> bytes:
    """A PNG image of the payload's bytes as samples, row by row, without row filters."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    return _SIGN + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw, 1)) + _chunk(b"IEND", b"")


def read_back(medium: bytes) -> bytes:
    """The samples of an image made by store(); checks every chunk's sum."""
    if medium[:8] != _SIGN:
        raise ValueError("not a PNG image")
    at, size, data = 8, None, []
    while at < len(medium):
        n, kind = struct.unpack_from(">I4s", medium, at)
        body = medium[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", medium, at + 8 + n)[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], 1 + size[0] * 3)
    if rows[:, 0].any():
        raise ValueError("a row filter that store() doesn't use")
    return rows[:, 1:].tobytes()


class _Parser(HTMLParser):
    """items: (kind, text or caption, digest) in order. A figure's caption belongs to its image; without one, the image's alt text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.run: list[str] = []
        self.caption: list[str] | None = None
        self.image: list | None = None
        self.hidden = 0

    def end_run(self):
        if text := " ".join("".join(self.run).split()):
            self.items.append(["text", text, None])
        self.run = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "img" and (a.get("src") or "").startswith(_REF):
            self.end_run()
            self.image = ["media", a.get("alt"), a["src"][len(_REF) :]]
            self.items.append(self.image)
        elif tag == "figcaption":
            self.end_run()
            self.caption = []
        elif tag not in ("b", "i", "em", "strong", "span", "a", "u", "code"):
            self.end_run()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            if self.image is not None and (text := " ".join("".join(self.caption).split())):
                self.image[1] = text
            self.caption = None
        elif tag == "figure":
            self.image = None
        elif tag not in ("b", "i", "em", "strong", "span", "a", "u", "code"):
            self.end_run()

    def handle_data(self, data):
        if not self.hidden:
            (self.run if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[list]:
    p = _Parser()
    p.feed(html or "")
    p.close()
    p.end_run()
    return p.items


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per item of a page: id, position (from 0, in the page's order), kind ('text' or 'media'), text (or the caption), digest (of media).

    A null or empty page has no items.
    """
    small_batches(pages.sparkSession)

    def run(batches):
        for b in batches:
            items = [(i, k, *item) for i, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, item in enumerate(parse(html))]
            cols = list(zip(*items, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()),
                strict=True)], ["id", "position", "kind", "text", "digest"])

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run,
        "id long, position int, kind string, text string, digest string")


def media_table(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest, medium): each distinct text's payload, stored once. digest: SHA-256 of the payload."""
    small_batches(texts.sparkSession)

    def run(batches):
        last = {}
        for b in batches:
            payloads = [padded(t) for t in b.column(0).to_pylist()]
            rows = {hashlib.sha256(p).hexdigest(): p for p in payloads}
            rows = {k: p for k, p in rows.items() if k not in last}  # a copy next to its original isn't sent again
            last = dict.fromkeys(rows)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array([store(p) for p in rows.values()], pa.binary())], ["digest", "medium"])

    return texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "digest string, medium binary").dropDuplicates(["digest"])


def resolve(items: DataFrame, media: DataFrame) -> DataFrame:
    """items with the column medium: a reference's bytes, null for text and for digests that aren't in the table.

    A digest that more than one in HOT_SHARE references name, of which there are at most HOT_SHARE, would gather them in one
    task. If the media of those digests are small enough together, they are broadcast to where the references are; the
    others, and all if they aren't, meet by a shuffle.
    """
    named = items.filter("digest is not null").groupBy("digest").agg(F.count("*").alias("n"))
    total = named.agg(F.sum("n")).first()[0] or 0
    hot = [r["digest"] for r in named.filter(F.col("n") > max(total / HOT_SHARE, HOT_LEAST)).select("digest").collect()]
    few = media.filter(F.col("digest").isin(hot)) if hot else None
    if few is None or (few.agg(F.sum(F.length("medium"))).first()[0] or 0) > HOT_BYTES:
        return items.join(media, "digest", "left").select(*items.columns, "medium")
    apart = F.coalesce(F.col("digest").isin(hot), F.lit(False))
    near = items.filter(apart).join(F.broadcast(few), "digest", "left").select(*items.columns, "medium")
    return near.unionByName(items.filter(~apart).join(media.filter(~F.col("digest").isin(hot)), "digest", "left").select(*items.columns, "medium"))


def assemble(items: DataFrame) -> DataFrame:
    """One row per page: id, items in order as structs (position, kind, text, digest, medium)."""
    return items.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("position", "kind", "text", "digest", "medium"))).alias("items"))


def _features(batches):
    for b in batches:
        rows = []
        for i, caption, medium in zip(*(c.to_pylist() for c in b.columns), strict=True):
            payload = read_back(medium)
            x = np.frombuffer(payload, np.uint8)
            feature = f"rows={len(x) // ROW};mean={x.mean():.3f};max={x.max()}"
            rows.append((i, int(caption), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(medium), hashlib.sha256(medium).hexdigest(), feature))
        cols = list(zip(*rows, strict=True)) or [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols,
            (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def _page_of(batches):
    """A page for each document: a line of text, and a figure that refers to the document's payload; its caption is the text's length."""
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        html = [f'<p>Document {i}</p><figure><img src="{_REF}{hashlib.sha256(padded(t)).hexdigest()}" alt="{escape(str(i))}"><figcaption>{len((t or "").encode())}</figcaption></figure>' for i, t in zip(ids, texts, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(html, pa.string())], ["page_id", "html"])


def query(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = sequences(docs.mapInArrow(_page_of, "page_id long, html string"))
    found = resolve(items.filter("kind = 'media'"), media_table(docs))
    return found.select("id", "text", "medium").mapInArrow(_features,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
