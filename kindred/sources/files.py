"""Files by ranged and streamed reads in tasks: listing, hashing and snapshots of files of any size.

Paths are those of pyarrow's filesystems: local ones and URIs (file, hdfs, s3, gs, abfs).  A file is never one value: it is read in
blocks where the task that needs it runs.
"""

from __future__ import annotations

import fnmatch
import hashlib
import re
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

BLOCK = 1 << 22


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The filesystem of a path or URI, and the path in it."""
    local = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if "://" not in local else fs.FileSystem.from_uri(path)


def named(path: str, inner: str) -> str:
    """An inner path as Spark names it."""
    scheme = re.match(r"(\w+://[^/]*)/", re.sub(r"^file:/+", "/", path))
    return (f"{scheme[1]}/{inner.lstrip('/')}" if scheme and inner.startswith("/") else f"{scheme[1].split('://')[0]}://{inner}") if scheme else f"file:{inner}"


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, of the files of a folder, or of those that a glob fits; hidden ones are left out.  Several
    paths are lines of one text."""
    if "\n" in path:
        return sorted({x for p in path.split("\n") if p for x in listed(p)})
    system, inner = located(path)
    if not re.search(r"[*?\[]", inner):
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner))
    else:
        base = inner[: re.search(r"[*?\[]", inner).start()].rpartition("/")[0] or "/"
        deep = inner.count("/")
        every = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        found = [f for f in every if f.path.count("/") == deep and fnmatch.fnmatchcase(f.path, inner)]
    plain = (f for f in found if f.type == fs.FileType.File and f.base_name[:1] not in ("_", "."))
    return sorted((named(path, f.path), f.size) for f in plain)


DIGEST = "path string, length long, modified long, sha256 string, object string"


def _hashed(store: str | None):
    """(path) to DIGEST: streams every file once, into the store too if one is named."""

    def run(batches):
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                system, inner = located(path)
                digest, size, beside = hashlib.sha256(), 0, None
                info = system.get_file_info(inner)
                if store:
                    there, folder = located(store)
                    there.create_dir(folder, recursive=True)
                    beside = f"{folder}/.{uuid.uuid4().hex}"
                    out = there.open_output_stream(beside)
                with system.open_input_stream(inner) as f:
                    while block := f.read(BLOCK):
                        digest.update(block)
                        size += len(block)
                        if store:
                            out.write(block)
                place = None
                if store:
                    out.close()
                    place = f"{folder}/{digest.hexdigest()}"
                    there.move(beside, place)  # an equal object may be there: it has the same bytes
                    place = named(store, place)
                rows.append((path, size, int(info.mtime.timestamp()) if info.mtime else None, digest.hexdigest(), place))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], [x.split()[0] for x in DIGEST.split(", ")])

    return run


def _each(spark: SparkSession, path: str) -> DataFrame:
    paths = [(p,) for p, _ in listed(path)]
    return spark.createDataFrame(paths, "path string").repartition(max(1, min(len(paths), spark.sparkContext.defaultParallelism)))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified, sha256) of the files of a path, each streamed by a task."""
    return _each(spark, path).mapInArrow(_hashed(None), DIGEST).drop("object")


def snapshot(spark: SparkSession, path: str, store: str) -> DataFrame:
    """digests(), and where a copy of exactly the bytes that were hashed lies: objects of a store are named by their hash."""
    return _each(spark, path).mapInArrow(_hashed(store), DIGEST)
