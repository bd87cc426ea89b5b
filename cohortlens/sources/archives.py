"""Archives inside archives as tables of members, and their release under content names."""

from __future__ import annotations

import io
import posixpath
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship


def safe(name: str) -> str:
    """A member's path, normalised; absolute paths and ways upwards are refused."""
    path = posixpath.normpath(name.replace("\\", "/"))
    if path.startswith(("/", "../")) or path == ".." or (len(path) > 1 and path[1] == ":"):
        raise ValueError(f"unsafe member path: {name!r}")
    return path


def members(data: bytes, label: str = "") -> Iterator[tuple[str, bytes]]:
    """(path, content) of all files, with archives in archives opened under their own path."""
    inner: Iterator[tuple[str, bytes]]
    if zipfile.is_zipfile(io.BytesIO(data)):
        z = zipfile.ZipFile(io.BytesIO(data))
        inner = ((i.filename, z.read(i)) for i in z.infolist() if not i.is_dir())
    else:
        t = tarfile.open(fileobj=io.BytesIO(data))
        inner = ((m.name, t.extractfile(m).read()) for m in t if m.isfile())
    for name, content in inner:
        path = f"{label}{safe(name)}"
        if name.lower().endswith((".zip", ".tar", ".tar.gz", ".tgz")):
            yield from members(content, f"{path}/")
        else:
            yield path, content


def release(archives: DataFrame, pattern: str, prefix: str) -> DataFrame:
    """(archive, member, sha256, name, sealed, content) for archives (path, content). Matching members are named by prefix and digest; the others are sealed."""
    ship(archives.sparkSession)

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for member, data in members(content):
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([member]), pa.array([data], pa.binary())], ["archive", "member", "content"])

    m = archives.select("path", "content").mapInArrow(run, "archive string, member string, content binary")
    h = F.sha2("content", 256)
    ext = F.lower(F.regexp_extract("member", r"(\.[A-Za-z0-9]+)$", 1))
    return m.select("archive", "member", h.alias("sha256"), F.concat(F.lit(prefix), F.substring(h, 1, 16), ext).alias("name"), (~F.col("member").rlike(pattern)).alias("sealed"), "content")


def distinct_contents(released: DataFrame) -> DataFrame:
    """One member for each digest, the first by archive and member; and all members' names for the mapping table stay in released."""
    return released.filter("NOT sealed").groupBy("sha256", "name").agg(F.min(F.struct("archive", "member")).alias("first"),
        F.count("*").alias("copies")).select("sha256", "name", "first.*", "copies")
