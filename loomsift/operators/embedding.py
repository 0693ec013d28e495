"""Cosine similarity: the diversity gate, dedup within and across runs, and retrieval."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomsift.functions.files import below, files_under, opened
from loomsift.functions.samples import split_gate, with_provenance
from loomsift.functions.store import checkpointed, own_folder
from loomsift.functions.text import embedding_text
from loomsift.operators.greedy import fallen

#: Vectors of one side that meet so many of the other at a time, and products that are looked at at a time.
BLOCK, OTHERS, CELLS = 4096, 2048, 1 << 16
Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(texts: list[str], dim: int = 64) -> np.ndarray:
    """The built-in embedder: signed counts of hashed words."""
    out = np.zeros((len(texts), dim), np.float32)
    for row, text in zip(out, texts, strict=True):
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            row[h % dim] += 1 if h >> 63 else -1
    return out


def embed(samples: DataFrame, embedder: Embedder = hashing_embedder, batch_size: int = 64) -> DataFrame:
    """``_seq, vec`` of each sample's text."""
    rows = samples.select("_seq", embedding_text().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                part = batch.slice(at, batch_size)
                vectors = embedder([t or "" for t in part.column(1).to_pylist()])
                yield pa.record_batch([part.column(0), pa.array([v.astype(np.float32) for v in vectors], pa.list_(pa.float32()))], ["_seq", "vec"])

    return rows.mapInArrow(run, "_seq long, vec array<float>")


def _unit(vectors: pa.Array) -> np.ndarray:
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


@dataclass
class Block:
    """Some rows: their ids, and their vectors of length 1."""

    id: np.ndarray
    unit: np.ndarray

    def __post_init__(self) -> None:
        self.short = self.unit.astype(np.float32)
        #: Over what a product of short numbers can differ from the exact one, and half of a sixth decimal.
        self.error = np.float32((self.unit.shape[1] + 8) * 2.0**-22 + 1e-6)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[Block]:
    """Rows of ``id, vec``, so many at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            take = rows - sum(b.num_rows for b in held)
            held.append(batch.slice(0, take))
            batch = batch.slice(take)
            if sum(b.num_rows for b in held) == rows:
                yield _block(held)
                held = []
    if held:
        yield _block(held)


def _block(batches: list[pa.RecordBatch]) -> Block:
    t = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    return Block(t.column("id").to_numpy(), _unit(t.column("vec")))


def _beside(left: DataFrame, right: DataFrame, found: Callable[[Block, Iterator[Block]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``found`` of every block of left and all blocks of right, in order of id.

    Right is written once; a task reads it for each of its blocks, so that a vector is never sent more than twice and what
    has been found of a row is in one place.
    """
    spark = left.sparkSession
    folder = own_folder(spark, "vectors")
    right.select("id", "vec").repartitionByRange("id").sortWithinPartitions("id").write.parquet(folder)
    names = [n for n in files_under(folder) if n.endswith(".parquet")]

    def read() -> Iterator[pa.RecordBatch]:
        for name in names:
            system, at = opened(below(folder, name))
            with system.open_input_file(at) as f:
                yield from pq.ParquetFile(f).iter_batches(OTHERS, columns=["id", "vec"], use_threads=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, BLOCK):
            yield from found(block, _blocks(read(), OTHERS))

    n = max(2 * spark.sparkContext.defaultParallelism, -(-left.count() // (BLOCK // 2)))
    return left.select("id", "vec").repartitionByRange(n, "id").mapInArrow(run, schema)


def _exact(a: Block, b: Block, likely: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns and exact cosines of the cells that are likely, some at a time."""
    r, c = np.nonzero(likely)
    for at in range(0, len(r), CELLS):
        i, j = r[at : at + CELLS], c[at : at + CELLS]
        yield i, j, np.einsum("ij,ij->i", a.unit[i], b.unit[j])


def similar_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """``i, j, similarity`` of all pairs of rows of ``id, vec`` with cosine ``threshold`` or over, i before j: exact."""

    def found(a: Block, others: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        for b in others:
            if b.id[-1] <= a.id.min():
                continue
            for i, j, s in _exact(a, b, a.short @ b.short.T >= np.float32(threshold) - a.error):
                own = (s >= threshold) & (a.id[i] < b.id[j])
                yield pa.record_batch([pa.array(a.id[i[own]]), pa.array(b.id[j[own]]), pa.array(s[own])], ["i", "j", "similarity"])

    return _beside(vectors, vectors, found, "i long, j long, similarity double")


def nearest(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """``query_id, id, similarity, rank``: the k most similar rows of the corpus for each query; ties by id."""

    def found(a: Block, others: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        n = len(a.id)
        best, ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        for b in others:
            s = a.short @ b.short.T
            least = best[:, -1].astype(np.float32)
            if s.shape[1] >= k and np.isinf(least).any():
                least = np.maximum(least, np.partition(s, -k, axis=1)[:, -k] - a.error)
            for i, j, x in _exact(a, b, s >= (least - a.error)[:, None]):
                x = np.round(x, 6)
                own = (x > best[i, -1]) | ((x == best[i, -1]) & (b.id[j] < ids[i, -1]))
                i, j, x = i[own], j[own], x[own]
                rows = np.unique(i)
                row = np.concatenate([np.repeat(rows, k), i])
                key, value = np.concatenate([ids[rows].ravel(), b.id[j]]), np.concatenate([best[rows].ravel(), x])
                order = np.lexsort((key, -value, row))
                row = row[order]
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
                top = order[first[:, None] + np.arange(k)]
                ids[rows], best[rows] = key[top], value[top]
        there = np.isfinite(best)
        rank = np.broadcast_to(np.arange(1, k + 1, dtype=np.int32), best.shape)
        yield pa.record_batch([pa.array(np.repeat(a.id, there.sum(1))), pa.array(ids[there]), pa.array(best[there]), pa.array(rank[there])], ["query_id", "id", "similarity", "rank"])

    return _beside(queries, corpus, found, "query_id long, id long, similarity double, rank int")


def greatest_similarity(queries: DataFrame, corpus: DataFrame, earlier: bool = False) -> DataFrame:
    """``id, similarity``: each query's greatest cosine with a row of the corpus, if earlier with one of a lesser id."""

    def found(a: Block, others: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        best = np.full(len(a.id), -np.inf)
        for b in others:
            if earlier and b.id[0] >= a.id.max():
                break
            s = a.short @ b.short.T
            if earlier:
                s[b.id[None, :] >= a.id[:, None]] = -np.inf
            least = np.maximum(best.astype(np.float32), s.max(1)) - 2 * a.error
            for i, _, x in _exact(a, b, (s >= least[:, None]) & (s > -np.inf)):
                np.maximum.at(best, i, x)
        own = best > -np.inf
        yield pa.record_batch([pa.array(a.id[own]), pa.array(best[own])], ["id", "similarity"])

    return _beside(queries, corpus, found, "id long, similarity double")


def greedy_diverse(vectors: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``id`` of the rows of ``id, vec`` that an ordered scan keeps, and ``id, similarity`` of those it drops, with the
    greatest cosine to a kept earlier row.
    """
    pairs = checkpointed(similar_pairs(vectors, threshold))
    gone = checkpointed(fallen(pairs).withColumnRenamed("j", "id").distinct())
    kept = vectors.select("id").join(gone, "id", "left_anti")
    to_kept = pairs.join(gone.withColumnRenamed("id", "i"), "i", "left_anti").join(gone.withColumnRenamed("id", "j"), "j", "left_semi")
    return kept, to_kept.groupBy(F.col("j").alias("id")).agg(F.max("similarity").alias("similarity"))


@F.pandas_udf(StringType())
def three_places(x: pd.Series) -> pd.Series:
    """Python's rounding, which is half to even of the exact value."""
    return x.map(lambda v: f"{v:.3f}")


def diversity_gate(samples: DataFrame, threshold: float = 0.92, embedder: Embedder = hashing_embedder) -> tuple[DataFrame, DataFrame]:
    """Rejects a sample too similar to an earlier accepted one."""
    vectors = checkpointed(embed(samples, embedder).withColumnRenamed("_seq", "id"))
    kept, gone = greedy_diverse(vectors, threshold)
    best = greatest_similarity(vectors, vectors.join(kept, "id", "left_semi"), earlier=True).withColumnsRenamed({"id": "_seq", "similarity": "_best"})
    marked = samples.join(gone.withColumnsRenamed({"id": "_seq", "similarity": "_similarity"}), "_seq", "left").join(best, "_seq", "left")
    notes = F.to_json(F.struct(F.round(F.coalesce("_best", F.lit(0.0)), 4).alias("max_similarity"), F.lit(threshold).alias("threshold"), F.col("_similarity").isNull().alias("passed")))
    marked = with_provenance(marked, "DiversityGate", notes, {"threshold": threshold})
    passed, rejected = split_gate(marked, F.when(F.col("_similarity").isNotNull(), F.concat(F.lit("diversity_gate:too_similar:"), three_places("_similarity"))), "DiversityGate")
    return passed.drop("_similarity", "_best"), rejected.drop("_similarity", "_best")


def embedding_dedup(samples: DataFrame, index_path: str, threshold: float = 0.92, embedder: Embedder = hashing_embedder, append: bool = True) -> DataFrame:
    """Drops samples similar to the index of earlier runs, then to earlier ones of this run; the rest joins the index.

    The index is a Parquet table ``sample_id, source_uri, vec``; one that can't be read is as none.
    """
    spark = samples.sparkSession
    vectors = checkpointed(embed(samples, embedder).withColumnRenamed("_seq", "id"))
    try:
        index = spark.read.parquet(index_path).select("sample_id", "vec")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e) and "CANNOT_READ_FILE" not in str(e):
            raise
        index = None
    fresh = vectors
    if index is not None:
        seen = greatest_similarity(vectors, index.select(F.xxhash64("sample_id").alias("id"), "vec")).where(F.col("similarity") >= threshold)
        fresh = checkpointed(vectors.join(seen, "id", "left_anti"))
    kept, _ = greedy_diverse(fresh, threshold)
    kept = checkpointed(kept)
    out = samples.join(kept.withColumnRenamed("id", "_seq"), "_seq", "left_semi")
    if append:
        new = out.select("_seq", F.col("id").alias("sample_id"), "source_uri").join(fresh.withColumnRenamed("id", "_seq"), "_seq").select("sample_id", "source_uri", "vec")
        new.write.mode("append" if index is not None else "overwrite").parquet(index_path)
    return with_provenance(out, "EmbeddingDeduplicator", {"threshold": threshold, "ann_backend": "exact"}, {"threshold": threshold})
