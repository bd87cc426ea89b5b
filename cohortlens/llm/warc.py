"""Operator 8: WARC archives with a two-level capture index.

Pages are written as gzip members of WARC files in the shared folder; of equal payloads one record is a response and the
others revisit it. The index lines (reversed-host URL key, identifier, file, offset, length) are sorted and compressed in
blocks; a sparse directory holds each block's first key. A lookup searches the directory by bisection, opens one block,
searches that by bisection too, and reads only the record's byte range.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json

import re
import uuid
import zlib
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, shared_path, small_batches, table, written

#: Index lines in a block, at least.
BLOCK_LINES = 2000
#: Blocks at most, which bounds the directory that every task gets: blocks grow beyond.
MOST_BLOCKS = 200_000


def url_key(url: str | None) -> str:
    """The host's labels reversed and joined by commas, then path and query: http://a.b.org/x?y gives org,b,a)/x?y. Null gives the empty key."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host = u.hostname or ""
    except ValueError:
        return f"){url}"
    host = re.sub(r"^www\d*\.", "", host)
    return ",".join(reversed(host.split("."))) + ")" + (u.path or "/").lower() + (f"?{u.query.lower()}" if u.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str | None, payload: bytes, owner: int | None) -> bytes:
    """One WARC record as a gzip member; with an owner, a revisit without the payload."""
    name = "null" if page_id == NULL_ID else str(page_id)
    head = ["WARC/1.1", f"WARC-Type: {'response' if owner is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if owner is None:
        body += payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'null' if owner == NULL_ID else owner}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 5, mtime=0)


def parse(member: bytes) -> dict:
    """Fields of a record: page_id, record_type, refers_to, digest, payload_bytes, payload (empty for revisits). Checks the digest of what it holds."""
    data = gzip.decompress(member)
    at = data.index(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in data[:at].decode().split("\r\n")[1:])
    body = data[at + 4 : at + 4 + int(fields["Content-Length"])]
    payload = body[body.index(b"\r\n\r\n") + 4 :]
    page = lambda x: None if x is None or x == "<urn:page:null>" else int(x[10:-1])
    out = {"page_id": page(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"], "refers_to": page(fields.get("WARC-Refers-To")),
        "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": int(fields["X-Payload-Length"]), "payload": payload}
    if out["record_type"] == "response" and (digest(payload) != out["digest"] or len(payload) != out["payload_bytes"]):
        raise ValueError(f"record {out['page_id']} doesn't hold the payload of its digest")
    return out


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _digests(batches):
    for b in batches:
        pay = [(h or "").encode() for h in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([digest(p) for p in pay])], ["page", "th", "digest"])


def _writer(folder: str):
    def write(batches):
        """Writes a task's archive under a name of its own, so that a task that runs again overwrites nothing; only files named in the index count."""
        from pyspark import TaskContext

        system, top = _filesystem(folder)
        name, at, out, rows = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, None, []

        def batch():
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True),
                (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page", "file", "offset", "length"])
            rows.clear()
            return got

        last = None
        for b in batches:
            for page, url, html, own, owner in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (page, own) == last:  # a repeated row is one record
                    continue
                last = (page, own)
                if out is None:
                    system.create_dir(top, recursive=True)
                    out = system.open_output_stream(f"{top}/{name}", compression=None)
                member = record(page, url, (html or "").encode(), None if owner == page else owner)
                out.write(member)
                rows.append((url_key(url), page, name, at, len(member)))
                at += len(member)
            if len(rows) > 5000:
                yield batch()
        if out is not None:
            out.close()
        if rows:
            yield batch()

    return write


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives to folder and returns the capture index: key, page, file, offset, length.

    Null html counts as empty, a null url as the empty one, a null identifier as one before all others. Rows that repeat
    identifier and payload are one record. The page with the smallest identifier holds a payload; the others revisit it.
    """
    small_batches(pages.sparkSession)
    src = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("page"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    src = src.withColumn("th", F.xxhash64(F.coalesce("html", F.lit(""))))
    small = src.select("page", "th", F.col("html").alias("h")).mapInArrow(_digests, "page long, th long, digest string")
    owner = small.groupBy("digest").agg(F.min("page").alias("owner"))
    small = small.join(owner, "digest").select("page", "th", "digest", "owner").distinct()
    rows = src.join(small, ["page", "th"]).select("page", "url", "html", "digest", "owner").sortWithinPartitions("page", "digest")
    return written(rows.mapInArrow(_writer(folder), "key string, page long, file string, offset long, length long"), "captures")


def index(captures: DataFrame) -> tuple[DataFrame, list[tuple[str, int]]]:
    """(block, data) of the sorted captures, compressed, and the directory: each block's first (key, page); block is its place there."""

    lines = max(BLOCK_LINES, -(-captures.count() // MOST_BLOCKS))

    def pack(batches):
        held: list[list] = []

        def block(own):
            return pa.RecordBatch.from_arrays([pa.array([own[0][0]]), pa.array([own[0][1]], pa.int64()),
                pa.array([zlib.compress(json.dumps(own).encode(), 6)], pa.binary())], ["key", "page", "data"])

        for b in batches:
            held += map(list, zip(*(c.to_pylist() for c in b.columns), strict=True))
            while len(held) >= lines:
                yield block(held[:lines])
                held = held[lines:]
        if held:
            yield block(held)

    blocks = captures.repartitionByRange("key", "page").sortWithinPartitions("key", "page").mapInArrow(pack, "key string, page long, data binary")
    blocks = written(blocks, "blocks")
    directory = sorted((r["key"], r["page"]) for r in blocks.select("key", "page").collect())  # at most MOST_BLOCKS lines and one for each partition
    return blocks, directory


def find(blocks: DataFrame, directory: list[tuple[str, int]], wanted: DataFrame) -> DataFrame:
    """file, offset, length for each (key, page) of wanted that was captured."""
    shared = wanted.sparkSession.sparkContext.broadcast(directory)

    def place(batches):
        first = shared.value
        for b in batches:
            at = [bisect.bisect_right(first, x) - 1 for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            keep = [i for i, k in enumerate(at) if k >= 0]
            own = b.take(pa.array(keep, pa.int64()))
            tops = [first[at[i]] for i in keep]
            yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in tops], pa.string()), pa.array([t[1] for t in tops], pa.int64()), own.column(0),
                own.column(1)], ["bkey", "bpage", "key", "page"])

    def search(asked: pa.Table, block: pa.Table) -> pa.Table:
        out: list[list] = []
        if block.num_rows:
            held = json.loads(zlib.decompress(block.column("data")[0].as_py()))
            keys = [(r[0], r[1]) for r in held]
            for x in zip(asked.column("key").to_pylist(), asked.column("page").to_pylist(), strict=True):
                k = bisect.bisect_left(keys, x)
                while k < len(keys) and keys[k] == x:
                    out.append(held[k][2:])
                    k += 1
        cols = list(zip(*out, strict=True)) or [()] * 3
        return pa.table({"file": pa.array(cols[0], pa.string()), "offset": pa.array(cols[1], pa.int64()), "length": pa.array(cols[2], pa.int64())})

    asked = wanted.select("key", "page").distinct().mapInArrow(place, "bkey string, bpage long, key string, page long")
    held = blocks.select(F.col("key").alias("bkey"), F.col("page").alias("bpage"), "data")
    return asked.groupBy("bkey", "bpage").cogroup(held.groupBy("bkey", "bpage")).applyInArrow(search, "file string, offset long, length long")


def read(places: DataFrame, folder: str) -> DataFrame:
    """The records at the places: page_id, record_type, refers_to, digest, payload_bytes, payload. Each file is opened once and read by ranges in order."""

    def ranges(batches):
        system, top = _filesystem(folder)
        name, source = None, None
        for b in batches:
            rows = []
            for file, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, system.open_input_file(f"{top}/{file}")
                rows.append(parse(source.read_at(length, offset)))
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]))
        if source is not None:
            source.close()

    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # places are few bytes, what they point to isn't: no coalescing
    near = places.repartition(parts, "file").sortWithinPartitions("file", "offset")
    return near.mapInArrow(ranges, "page_id long, record_type string, refers_to long, digest string, payload_bytes long, payload binary")


def _keys(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column(1).to_pylist()], pa.string()), b.column(0)], ["key", "page"])


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = shared_path(spark, "warc")
    blocks, directory = index(write(pages, folder))
    wanted = pages.select(F.coalesce("page_id", F.lit(NULL_ID)).alias("page"), "url").mapInArrow(_keys, "key string, page long")
    records = read(find(blocks, directory, wanted), folder)
    return records.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


