"""Small files, listings and checksums on whatever file system an output folder is on."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession


def opened(path: str | Path) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    text = str(path)
    if "://" not in text and not text.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(text)
    return fs.FileSystem.from_uri("file://" + text.removeprefix("file:") if text.startswith("file:/") and not text.startswith("file://") else text)


def below(folder: str | Path, *names: str) -> str:
    return "/".join([str(folder).rstrip("/"), *(n for n in names if n)])


def write_text(path: str | Path, text: str) -> None:
    system, at = opened(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    with system.open_output_stream(at) as out:
        out.write(text.encode())


def remove(folder: str | Path) -> None:
    system, at = opened(folder)
    if system.get_file_info(at).type == fs.FileType.Directory:
        system.delete_dir(at)


def files_under(folder: str | Path) -> list[str]:
    """Paths of all files under a folder from there, but those of a hidden name."""
    system, root = opened(folder)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    names = (f.path[len(root) :].lstrip("/") for f in found if f.type == fs.FileType.File)
    return sorted(n for n in names if not any(part.startswith(".") for part in n.split("/")))


def joined(spark: SparkSession, folder: str, target: str, n: int) -> None:
    """The visible files of a folder as ``n`` files of another, each streamed together by a task, a piece in memory at a time."""
    names = [x for x in files_under(folder) if not x.rpartition("/")[2].startswith("_")]
    system, at = opened(target)
    system.create_dir(at, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                system, at = opened(below(target, f"part-{k:05d}"))
                with system.open_output_stream(at) as out:
                    for name in names[k::n]:
                        _, source = opened(below(folder, name))
                        with system.open_input_stream(source) as f:
                            while data := f.read(1 << 20):
                                out.write(data)
                yield pa.record_batch([pa.array([k])], ["id"])

    spark.range(0, n, 1, n).mapInArrow(run, "id long").collect()


def checksums(spark: SparkSession, folder: str | Path, names: list[str]) -> dict[str, str]:
    """SHA-256 of files of a folder, each streamed by a task."""
    root = str(folder) if "://" in str(folder) else os.path.abspath(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, at = opened(below(root, name))
                with system.open_input_stream(at) as f:
                    digest = hashlib.sha256()
                    while part := f.read(1 << 20):
                        digest.update(part)
                yield pa.record_batch([pa.array([name]), pa.array([digest.hexdigest()])], ["name", "sum"])

    if not names:
        return {}
    rows = spark.createDataFrame([(n,) for n in names], "name string").repartition(min(len(names), 1000))
    return {r.name: r.sum for r in sorted(rows.mapInArrow(run, "name string, sum string").collect())}
