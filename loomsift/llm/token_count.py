"""Operator 10: token counts by heap-and-linked-list byte-pair merging.

A pre-token's count is its bytes less the merges made; no identifiers are produced. Counts are kept by the pre-token's
bytes, so that merging runs once for each distinct pre-token that a Python worker remembers.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomsift.llm.arrays import pick, pretokens, quick_hashes, rows_of, slices, type_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of known pre-tokens that a worker keeps twice over, each with ENTRY bytes of its own; it forgets those that it
#: hasn't met since. It changes memory and time, never a count.
KNOWN, ENTRY = 64 << 20, 120


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def merged_count(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Symbols left when the lowest-rank adjacent pair, the leftmost of equals, is merged until no pair has a rank."""
    n = len(piece)
    if n < 2:
        return n
    nxt = list(range(1, n + 1))  # the linked list; a symbol is known by its first byte and ends where the next begins
    prev = list(range(-1, n))
    alive = bytearray(b"\1" * n)
    bits = n.bit_length()
    mask = (1 << bits) - 1
    get, push, pop = ranks.get, heapq.heappush, heapq.heappop
    # an entry is one number: rank, first byte and end of the pair
    heap = [(rank << bits | i) << bits | i + 2 for i in range(n - 1) if (rank := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        entry = pop(heap)
        end, i = entry & mask, entry >> bits & mask
        if not alive[i] or (j := nxt[i]) == n or nxt[j] != end:
            continue  # one of the pair has since been merged
        alive[j] = 0
        nxt[i] = end
        merges += 1
        if end < n:
            prev[end] = i
            after = nxt[end]
            if (rank := get(piece[i:after])) is not None:
                push(heap, (rank << bits | i) << bits | after)
        if (p := prev[i]) >= 0 and (rank := get(piece[p:end])) is not None:
            push(heap, (rank << bits | p) << bits | end)
    return n - merges


class Counter:
    """Counts of whole batches, with what is known so far by its bytes, in a newer and an older half."""

    def __init__(self, raw: bytes) -> None:
        self.ranks = read_ranks(raw)
        self.newer: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}
        self.held = 0

    def count(self, piece: bytes) -> int:
        if (n := self.newer.get(piece)) is None:
            if (n := self.older.get(piece)) is None:
                n = merged_count(piece, self.ranks)
            self.held += len(piece) + ENTRY
            if self.held > KNOWN:
                self.older, self.newer, self.held = self.newer, {}, len(piece) + ENTRY
            self.newer[piece] = n
        return n

    def rows(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        starts, ends = pretokens(data, at)
        out = np.zeros(len(at) - 1, np.int64)
        if not len(starts):
            return out
        _, first, inverse = np.unique(quick_hashes(data, starts, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        counts = np.array([self.count(raw[s:e]) for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])[inverse]
        # a hash isn't a proof: every pre-token is held against the one that it has the hash of
        other, size = first[inverse], ends - starts
        differ = size != size[other]
        byte = np.arange(len(data)) + np.repeat(np.where(differ, 0, starts[other] - starts), size)
        wrong = np.flatnonzero(data[byte] != data)
        if len(wrong):
            differ[np.searchsorted(starts, wrong, "right") - 1] = True
        for k in np.flatnonzero(differ).tolist():
            counts[k] = self.count(raw[starts[k] : ends[k]])
        return np.bincount(rows_of(at, starts), counts, len(out)).astype(np.int64)


_counters: dict[int, Counter] = {}


def counter(raw: bytes) -> Counter:
    if (k := hash(raw)) not in _counters:
        _counters.clear()
        _counters[k] = Counter(raw)
    return _counters[k]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens`` of each row of ``docs``, in one pass without a shuffle.

    A null text has a null count, an empty one 0; a null ``doc_id`` and repeated rows are kept as they are; other columns
    are ignored, whatever their names; an empty table gives no rows. ``vocabulary``: ranks in tiktoken's file format.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = pick(docs, "doc_id", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(shared.value)
        for batch in batches:
            for part, data, at in slices(batch, "text"):
                n = pa.array(c.rows(data, at), mask=part.column(1).is_null().to_numpy(zero_copy_only=False))
                yield pa.record_batch([part.column(0), n], ["doc_id", "n_tokens"])

    return rows.mapInArrow(count, f"doc_id {type_of(rows, 'doc_id')}, n_tokens long")
