"""Readers: every input row becomes one row of ``place, line, raw, error``, its cells a JSON object, or an error.

``line`` is the row's number in its file; ``place`` counts from 0 over all files of the source, in order of file and line.
"""

from __future__ import annotations

import csv
import itertools
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Splits up to which their table is broadcast; beyond it lines are joined with it by shuffle.
MOST_SPLITS = 100_000
ENVELOPE = ("data", "examples", "samples", "records", "items", "dataset", "train")


def _numbered(df: DataFrame) -> DataFrame:
    """Rows with ``line`` and ``place``, of ``file, start`` and other columns, without sorting them in one task.

    Spark reads a split's rows in order and names the split by its file and start; rows are numbered within splits, and
    splits by their sizes.
    """
    others = [c for c in df.columns if c not in ("file", "start")]
    ordered = df.withColumn("order", F.monotonically_increasing_id())
    sizes = ordered.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("order").alias("first")).orderBy("file", "start").collect()
    at, in_file, file, base = 0, 0, None, []
    for r in sizes:
        in_file, file = (in_file if r.file == file else 0), r.file
        base.append((r.file, r.start, at - r.first, in_file - r.first))
        at, in_file = at + r.n, in_file + r.n
    table = df.sparkSession.createDataFrame(base or [("", 0, 0, 0)], "file string, start long, shift long, file_shift long")
    placed = ordered.join(F.broadcast(table) if len(base) <= MOST_SPLITS else table, ["file", "start"])
    return placed.select((F.col("order") + F.col("shift")).alias("place"), (F.col("order") + F.col("file_shift") + 1).alias("line"), *others)


def _split() -> list[Column]:
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Blank lines count as lines and give no rows; what isn't JSON is an error; a value that isn't an object is wrapped."""
    lines = _numbered(spark.read.text(path).select("value", *_split())).withColumn("value", F.trim("value")).where("value <> ''")
    parsed = lines.withColumn("v", F.expr("try_parse_json(value)"))
    kind = F.expr("schema_of_variant(v)")
    whole = F.when(F.col("v").isNull(), None).when(kind.startswith("OBJECT"), F.col("value")).otherwise(F.concat(F.lit('{"__raw__":'), F.col("value"), F.lit("}")))
    error = F.when(F.col("v").isNull(), F.concat(F.lit("json_decode_error:invalid JSON: "), F.substring("value", 1, 500)))
    return parsed.select("place", "line", whole.alias("raw"), error.alias("error"))


def _records(text: str, data_key: str | None) -> Iterator[tuple[int, str | None, str | None]]:
    try:
        value = json.loads(text)
    except ValueError as e:
        yield 1, None, f"json_decode_error:{e}"
        return
    if isinstance(value, dict):
        lists = [k for k in (data_key, *ENVELOPE) if k and isinstance(value.get(k), list)] or [k for k, v in value.items() if isinstance(v, list) and v and isinstance(v[0], dict)]
        value = value[lists[0]] if lists else [value]
    for i, record in enumerate(value if isinstance(value, list) else [], 1):
        if isinstance(record, dict):
            yield i, json.dumps(record, ensure_ascii=False), None
        else:
            yield i, None, f"json_decode_error:record_is_{type(record).__name__}_not_dict"


def read_json(spark: SparkSession, path: str, data_key: str | None = None) -> DataFrame:
    """One document per file: a list, an envelope with a list, or one record."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, file in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = list(_records(text, data_key))
                yield pa.record_batch([pa.array([file] * len(found), pa.string()), *(pa.array([x[k] for x in found], pa.string()) for k in (1, 2))], ["file", "raw", "error"])

    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return _numbered(files.mapInArrow(rows, "file string, raw string, error string").withColumn("start", F.lit(0).cast("long")))


def sniff(head: str) -> str:
    try:
        return csv.Sniffer().sniff(head, delimiters=",\t|;").delimiter
    except csv.Error:
        return ","


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, parse_json_cells: bool = True) -> DataFrame:
    """Rows under a header, the first being line 2; a missing cell is empty, a surplus one dropped; a cell that is a JSON
    list, object or string is parsed.
    """
    if delimiter is None:
        head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 4096)).first()
        delimiter = sniff(bytes(head[0]).decode("utf-8", "replace")) if head else ","
    df = spark.read.csv(path, header=True, sep=delimiter, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    cells, names = [], df.columns
    for c in names:
        text = F.coalesce(F.col(f"`{c}`"), F.lit(""))
        listed = F.to_json(F.array(text))
        plain = F.substring(listed, F.lit(2), F.length(listed) - 2)
        if parse_json_cells:
            plain = F.when(text.rlike(r'^\s*[\[{"]') & F.expr(f"try_parse_json(coalesce(`{c}`, '')) IS NOT NULL"), text).otherwise(plain)
        cells.append(F.concat(F.lit(json.dumps(c, ensure_ascii=False) + ":"), plain))
    raw = F.concat(F.lit("{"), F.concat_ws(",", *cells), F.lit("}")).alias("raw")
    rows = _numbered(df.select(raw, *_split()))
    return rows.select("place", (F.col("line") + 1).alias("line"), "raw", F.lit(None).cast("string").alias("error"))


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Column projection reaches the scan; nulls become empty text."""
    df = spark.read.parquet(path)
    names = columns or df.columns
    text = [F.when(F.col(f"`{c}`").isNull(), F.lit(json.dumps(c) + ':""')).otherwise(F.regexp_replace(F.to_json(F.struct(F.col(f"`{c}`").alias(c))), r"^\{|\}$", "")) for c in names]
    rows = df.select(F.concat(F.lit("{"), F.concat_ws(",", *text), F.lit("}")).alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    sizes = df.select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count("*").alias("n")).orderBy("file").collect()
    ends = list(itertools.accumulate(r.n for r in sizes))
    table = spark.createDataFrame([(r.file, end - r.n) for r, end in zip(sizes, ends, strict=True)] or [("", 0)], "file string, shift long")
    placed = rows.join(F.broadcast(table) if len(sizes) <= MOST_SPLITS else table, "file")
    return placed.select((F.col("row") + F.col("shift")).alias("place"), (F.col("row") + 1).alias("line"), "raw", F.lit(None).cast("string").alias("error"))


def read_dataset(spark: SparkSession, name: str, split: str = "train", subset: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A dataset kept locally as Parquet under ``name[/subset]/split``; no hub is reached from here."""
    folder = Path(name, *([subset] if subset else []))
    for path in (folder / split, folder / f"{split}.parquet", folder):
        if path.exists():
            return read_parquet(spark, str(path), columns)
    raise FileNotFoundError(f"no local copy of {name}/{split}")


@dataclass
class Source:
    """An entry of the configuration: where from, how much, and how its rows are to be understood."""

    path: str
    format: str = "auto"
    max_samples: int | None = None
    split: str = "train"
    subset: str | None = None
    columns: list[str] | None = None
    data_key: str | None = None
    delimiter: str | None = None
    field_mapping: dict[str, str] = field(default_factory=dict)
    preprocessing_fn: str | Callable[[dict[str, Any]], Any] | None = None
    source_uri: str | None = None
    detection_sample_size: int = 10

    @classmethod
    def of(cls, entry: str | dict[str, Any] | Source, **shared: Any) -> Source:
        if isinstance(entry, Source):
            return entry
        if isinstance(entry, str):
            return cls(entry, **shared)
        own = dict(entry)
        own["path"] = own.pop("name", own.get("path"))
        return cls(**(shared | own))

    def rows(self, spark: SparkSession) -> DataFrame:
        """Raw rows, by the path's suffix."""
        suffix = Path(self.path).suffix.lower()
        if suffix == ".jsonl":
            return read_jsonl(spark, self.path)
        if suffix == ".json":
            return read_json(spark, self.path, self.data_key)
        if suffix in (".csv", ".tsv"):
            return read_csv(spark, self.path, self.delimiter)
        if suffix == ".parquet":
            return read_parquet(spark, self.path, self.columns)
        if Path(self.path).is_file():
            return read_jsonl(spark, self.path)
        return read_dataset(spark, self.path, self.split, self.subset, self.columns)

    @property
    def uri(self) -> str:
        return self.source_uri or (self.path if Path(self.path).suffix else f"{self.path}/{self.split}")
