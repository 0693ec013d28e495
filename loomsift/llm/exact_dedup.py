"""Operator 8: exact dedup by a cuckoo-filter index of live digests.

Only digests are shuffled to the index. A fingerprint hit is verified against the digests stored in its buckets, and the
texts behind a repeated digest are compared themselves, so that neither filter nor digest can merge different texts.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsift.llm.arrays import pick

SLOTS = 4
MAX_KICKS = 200
_M64 = (1 << 64) - 1


class CuckooIndex:
    """A cuckoo filter over 128-bit digests that also stores each digest and the number of its live copies by slot, in flat
    arrays of 26 bytes a slot.
    """

    def __init__(self, buckets: int = 256) -> None:
        assert buckets & (buckets - 1) == 0, "a power of two"
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.buckets = buckets
        self.size = 0
        n = buckets * SLOTS
        self.marks = array("H", bytes(2 * n))  # the filter: 16-bit fingerprints, 0 for none
        self.low, self.high, self.live = array("Q", bytes(8 * n)), array("Q", bytes(8 * n)), array("q", bytes(8 * n))

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995 >> 7) & (self.buckets - 1))

    def _find(self, low: int, high: int) -> int:
        mark = (high >> 48) or 1
        a = low & (self.buckets - 1)
        for bucket in (a, self._other(a, mark)):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.marks[slot] == mark and self.low[slot] == low and self.high[slot] == high:  # the filter's hit is verified
                    return slot
        return -1

    def count(self, key: int) -> int:
        """Live copies of a digest."""
        return self.live[slot] if (slot := self._find(key & _M64, key >> 64)) >= 0 else 0

    def insert(self, key: int, copies: int = 1) -> int:
        """Adds copies of a digest; how many live ones there are now."""
        return self.add(key & _M64, key >> 64, copies)

    def add(self, low: int, high: int, copies: int = 1) -> int:
        if (slot := self._find(low, high)) >= 0:
            self.live[slot] += copies
            return self.live[slot]
        mark, n = (high >> 48) or 1, copies
        bucket = low & (self.buckets - 1)
        other = self._other(bucket, mark)
        self.size += 1
        for kick in range(MAX_KICKS):
            for at in (bucket, other) if not kick else (bucket,):
                for slot in range(at * SLOTS, at * SLOTS + SLOTS):
                    if not self.marks[slot]:
                        self.marks[slot], self.low[slot], self.high[slot], self.live[slot] = mark, low, high, n
                        return copies
            slot = bucket * SLOTS + (low >> 20 ^ kick) % SLOTS
            self.marks[slot], mark = mark, self.marks[slot]
            self.low[slot], low = low, self.low[slot]
            self.high[slot], high = high, self.high[slot]
            self.live[slot], n = n, self.live[slot]
            bucket = self._other(bucket, mark)
        self._resize(low, high, n)
        return copies

    def delete(self, key: int, copies: int = 1) -> bool:
        """Takes copies of a digest away, as many as are live at most; false if none is."""
        return self.take(key & _M64, key >> 64, copies)

    def take(self, low: int, high: int, copies: int = 1) -> bool:
        if (slot := self._find(low, high)) < 0:
            return False
        self.live[slot] -= min(copies, self.live[slot])
        if not self.live[slot]:
            self.marks[slot] = 0
            self.size -= 1
        return True

    def _resize(self, low: int, high: int, n: int) -> None:
        """Twice the buckets, filled again from the stored digests."""
        stored = list(zip(self.marks, self.low, self.high, self.live, strict=True))
        self._empty(self.buckets * 2)
        for m, k, h, c in stored:
            if m:
                self.add(k, h, c)
        self.add(low, high, n)

    def repeated(self) -> Iterator[int]:
        return (h << 64 | k for m, k, h, c in zip(self.marks, self.low, self.high, self.live, strict=True) if m and c > 1)


def digests(text: str = "text") -> list[Column]:
    return [F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(11), F.col(text)).alias("d2")]


def repeated_digests(docs: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """``d1, d2`` of the texts of which over one copy is live, from one cuckoo index for each shuffle partition.

    Copies are counted before the shuffle, so that a digest arrives once from each task however many rows have it.
    """
    texts = docs.where(F.col("text").isNotNull())
    events = texts.select(*digests(), F.lit(1).alias("change"))
    if deleted is not None:
        gone = texts.join(deleted.select("doc_id").distinct(), "doc_id", "left_semi")
        events = events.union(gone.select(*digests(), F.lit(-1)))
    counted = events.groupBy("d1", "d2").agg(F.count_if(F.col("change") > 0).alias("n"), F.count_if(F.col("change") < 0).alias("gone"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuckoo = CuckooIndex()
        for batch in batches:
            low, high = (batch.column(k).to_numpy().view(np.uint64).tolist() for k in (0, 1))
            for a, b, n, gone in zip(low, high, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                cuckoo.add(a, b, n)
                if gone:
                    cuckoo.take(a, b, gone)
        found = np.array([(k & _M64, k >> 64) for k in cuckoo.repeated()], np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], ["d1", "d2"])

    return counted.mapInArrow(index, "d1 long, d2 long")


def _texts(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("text").isNotNull()).withColumns({"d1": digests()[0], "d2": digests()[1]})


#: The text of a digest, or an end of the job if there are several.
_PROVEN = "if(size(same) = 1, same[0], raise_error('two texts have the same digest'))"


def exact_duplicates(docs: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """``doc_id, duplicate_of``: each document whose text another one has already, by order of ``doc_id``, and the first.

    Equal means the same characters; empty texts equal each other, null texts nothing. Of repeated rows all but one are
    duplicates of their own id. A null ``doc_id`` comes last. ``deleted``: ids whose documents are no longer live, which
    neither are nor have duplicates. Other columns are ignored; an empty table gives no rows. Different texts of one
    128-bit digest stop the job, for they are compared.
    """
    rows = pick(docs, "doc_id", "text")
    repeated = repeated_digests(rows, deleted)
    texts = _texts(rows if deleted is None else rows.join(deleted.select("doc_id").distinct(), "doc_id", "left_anti"))
    # equal texts become one before they are shuffled, in each task; then the ids alone are
    groups = texts.groupBy("d1", "d2").agg(F.min("doc_id").alias("first_id"), F.collect_set("text").alias("same")).join(repeated, ["d1", "d2"])
    groups = groups.select("d1", "d2", F.expr(f"if({_PROVEN} IS NULL, NULL, first_id)").alias("first_id"))
    ids = texts.groupBy("d1", "d2", "doc_id").agg(F.count("*").alias("n"))
    more = F.array_repeat(F.lit(0), (F.col("n") - F.col("doc_id").eqNullSafe(F.col("first_id")).cast("int")).cast("int"))
    return ids.join(groups, ["d1", "d2"]).select("doc_id", F.col("first_id").alias("duplicate_of"), F.explode(more).alias("copy")).drop("copy")


def drop_exact_duplicates(docs: DataFrame, *columns: str) -> DataFrame:
    """The rows that ``exact_duplicates`` doesn't name, with ``columns``; null texts stay. Of rows of one id and text the
    one whose other columns come first stays.
    """
    others = [c for c in columns if c not in ("doc_id", "text")]
    rows = pick(docs, "doc_id", "text", *others)
    repeated = repeated_digests(rows).withColumn("hit", F.lit(True))
    named = [F.col(c).alias(f"o{i}") for i, c in enumerate(others)]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *named)).alias("first")
    groups = _texts(rows).groupBy("d1", "d2").agg(first, F.collect_set("text").alias("same")).join(repeated, ["d1", "d2"], "left")
    made = {"doc_id": F.col("first.doc_id"), "text": F.expr(f"if(hit, {_PROVEN}, element_at(same, 1))"), **{c: F.col(f"first.o{i}") for i, c in enumerate(others)}}
    return groups.select(*(made[c].alias(c) for c in columns)).union(rows.where("text IS NULL").select(*columns))


EXACT_SQL = """
SELECT doc_id, first_id AS duplicate_of FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id, row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) AS n
  FROM {documents} WHERE text IS NOT NULL
) WHERE n > 1
"""

LIVE_SQL = """
SELECT doc_id, first_id AS duplicate_of FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id, row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) AS n
  FROM {documents} WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM {labels} WHERE quality = 0)
) WHERE n > 1
"""
