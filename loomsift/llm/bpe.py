"""Operator 4: BPE encoding and decoding with content-defined chunk reuse.

A rolling hash cuts each text into chunks; a chunk that many documents share is encoded once by a worker and reused.
Around each joint the tokens of the two sides are encoded again, from the last place of the left chunk to the first of the
right one at which any context gives the same token border, over chunks without such a place. The window then grows to the
next such places until what it gives agrees with the tokens that are there, and the result is the encoding of the whole
text, token for token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsift.llm.arrays import SPACE, WHITE, classes, code_points, mix, pick, slices, type_of
from loomsift.llm.token_count import VOCABULARY, read_ranks

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes in the rolling window; one place of 2**CUT_BITS on average is a cut, at least LEAST and at most MOST bytes apart.
WINDOW, CUT_BITS, LEAST, MOST = 16, 10, 256, 8192
#: Safe borders kept of each end of a chunk, and bytes from its end within which the plainest kind must have one.
BORDERS, NEAR = 3, 48
#: Bytes of text whose encoding a worker remembers; beyond it starts anew. It changes memory and time, never a token.
REMEMBERED = 24 << 20
_BYTES = np.random.default_rng(4).integers(0, 1 << 63, 256, dtype=np.uint64)


def rolling(data: np.ndarray) -> np.ndarray:
    """Hashes of the WINDOW bytes from each one, by joining windows of half the size."""
    h, base, size = _BYTES[data], 0x9E3779B97F4A7C15, 1
    while size < WINDOW:
        h = h[:-size] * np.uint64(pow(base, size, 1 << 64)) + h[size:]
        size *= 2
    return mix(h)


def cuts(data: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each row, on borders of characters; they depend on near-by bytes only."""
    n = len(data)
    ends: list[list[int]] = [[] for _ in range(len(at) - 1)]
    if n > WINDOW:
        found = np.flatnonzero(rolling(data)[:-1] >> np.uint64(64 - CUT_BITS) == 0) + WINDOW
        found = found[(data[found] & 0xC0) != 0x80]
        row = np.searchsorted(at, found, "right") - 1
        inside = found - at[row] >= WINDOW
        candidates = np.split(found[inside], np.searchsorted(row[inside], np.arange(1, len(at) - 1)))
    else:
        candidates = [np.zeros(0, np.int64)] * (len(at) - 1)
    for out, some, start, end in zip(ends, candidates, at[:-1].tolist(), at[1:].tolist(), strict=True):
        last = start
        for c in [*some.tolist(), end]:
            if c < end and c - last < LEAST:
                continue
            while c - last > MOST:
                last += MOST
                while (data[last] & 0xC0) == 0x80:
                    last -= 1
                out.append(last)
            if c > last:
                out.append(c)
                last = c
    return ends


#: Tokens, and safe borders as (tokens, bytes) before them: the first ones, and the last ones backwards.
Chunk = tuple[np.ndarray, list[tuple[int, int]], list[tuple[int, int]]]


def safe_borders(b: np.ndarray) -> np.ndarray:
    """Places over which no pre-token goes nor looks, whatever the context: before white space that follows another sign
    and, where those are far from an end, between letters, numbers and other signs, but for what follows an apostrophe.
    """
    white = SPACE[b]
    plain = np.flatnonzero(white[1:] & ~white[:-1] & (b[:-1] < 128)) + 1
    if len(plain) >= BORDERS and plain[BORDERS - 1] <= NEAR * BORDERS and plain[-BORDERS] >= len(b) - NEAR * BORDERS:
        return plain
    where, cp = code_points(b)
    kind = classes()[cp]
    one, two = kind[:-1], kind[1:]
    safe = np.where(two == WHITE, one != WHITE, (one != two) & (one != WHITE) & (cp[:-1] != 39))
    return where[1:][safe]


class Codec:
    """Encoder with remembered chunks, and decoder, of one vocabulary."""

    def __init__(self, raw: bytes) -> None:
        ranks = read_ranks(raw)
        self.plain = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        words = [b""] * (max(ranks.values()) + 1)
        for w, i in ranks.items():
            words[i] = w
        self.size = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(words), np.uint8)
        self.chunks: dict[bytes, tuple] = {}
        self.held = 0
        self.encoded = self.reused = self.repaired = 0

    def ids(self, raw: bytes) -> np.ndarray:
        return self.plain.encode_to_numpy(raw.decode("utf-8")).astype(np.uint32, copy=False)

    def chunk(self, raw: bytes) -> Chunk:
        """Tokens of a chunk, and its first and last safe borders from its ends inwards, in tokens and in bytes."""
        if (known := self.chunks.get(raw)) is not None:
            self.reused += 1
            return known
        self.encoded += 1
        tokens = self.ids(raw)
        safe = safe_borders(np.frombuffer(raw, np.uint8))
        at = np.searchsorted(np.cumsum(self.size[tokens]), safe) + 1
        both = list(zip(at.tolist(), safe.tolist(), strict=True))
        found = (tokens, both[:BORDERS], both[: -BORDERS - 1 : -1])
        if self.held > REMEMBERED:
            self.chunks.clear()
            self.held = 0
        self.chunks[raw] = found
        self.held += len(raw)
        return found

    def _joint(self, raw: bytes, left: tuple[int, Chunk] | int, right: tuple[int, Chunk] | int) -> tuple[np.ndarray, int, int]:
        """Tokens between two chunks, or from a text's begin or to its end, and up to which safe border of either they go.

        The window between the nearest borders is encoded; while a wider one doesn't agree, that one takes its place.
        """

        def side(of: tuple[int, Chunk] | int, which: int, k: int) -> tuple[int, int, int]:
            """Which border is the k-th, its token, and its byte in the text."""
            if isinstance(of, int):
                return 0, 0, of
            borders = of[1][which]
            k = min(k, len(borders) - 1)
            return k, borders[k][0], of[0] + borders[k][1]

        k = 0
        (i, m, start), (j, n, end) = side(left, 2, 0), side(right, 1, 0)
        found = self.ids(raw[start:end])
        while True:
            k += 1
            (i2, m2, start2), (j2, n2, end2) = side(left, 2, k), side(right, 1, k)
            if (start2, end2) == (start, end):
                return found, i, j
            wide = self.ids(raw[start2:end2])
            parts = [found]
            if start2 != start:
                parts.insert(0, left[1][0][m2:m])
            if end2 != end:
                parts.append(right[1][0][n:n2])
            if np.array_equal(wide, np.concatenate(parts)):
                return found, i, j
            found, i, m, start, j, n, end = wide, i2, m2, start2, j2, n2, end2

    def text(self, raw: bytes, start: int, ends: list[int]) -> list[np.ndarray]:
        """Tokens of the text that begins at ``start`` and whose chunks end at ``ends``, in pieces."""
        out: list[np.ndarray] = []
        left: tuple[int, Chunk] | int = start
        plain: list[np.ndarray] = []  # what the chunks alone give between the last safe border and here
        begin = start

        def settle(right: tuple[int, Chunk] | int) -> int:
            found, i, j = self._joint(raw, left, right)
            before = np.concatenate([*plain, right[1][0][: right[1][1][0][0]]] if not isinstance(right, int) else plain)
            self.repaired += len(found) != len(before) or not np.array_equal(found, before)
            if i:  # tokens of the left chunk that have been taken back
                out[-1] = out[-1][: len(out[-1]) - (left[1][2][0][0] - left[1][2][i][0])]
            out.append(found)
            return right[1][1][j][0] if not isinstance(right, int) else 0

        for end in ends:
            own = self.chunk(raw[begin:end])
            tokens, firsts, lasts = own
            if firsts:
                after = settle((begin, own)) if begin > start else 0
                out.append(tokens[after : lasts[0][0]])
                left, plain = (begin, own), [tokens[lasts[0][0] :]]
            else:
                plain.append(tokens)
            begin = end
        if len(plain) == 1:  # the text ends as its last chunk does
            out += plain
        elif plain:
            settle(begin)
        return out

    def rows(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all rows, and where each row's begin."""
        raw = data.tobytes()
        out: list[np.ndarray] = []
        n = np.zeros(len(at), np.int64)
        for i, ends in enumerate(cuts(data, at)):
            found = self.text(raw, int(at[i]), ends)
            n[i + 1] = sum(map(len, found))
            out += found
        return np.concatenate(out) if out else np.zeros(0, np.uint32), np.cumsum(n)

    def bytes_of(self, tokens: np.ndarray) -> np.ndarray:
        size = self.size[tokens]
        where = np.repeat(self.start[tokens] - (np.cumsum(size) - size), size)
        where += np.arange(len(where))
        return self.pool[where]


_codecs: dict[int, Codec] = {}


def codec(raw: bytes) -> Codec:
    if (k := hash(raw)) not in _codecs:
        _codecs.clear()
        _codecs[k] = Codec(raw)
    return _codecs[k]


def _shared(df: DataFrame, vocabulary: str):  # noqa: ANN202
    with open(vocabulary, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def bpe_encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens, tokens, exact`` of each row of ``docs``, in one pass without a shuffle.

    ``exact``: whether the tokens decode to the very bytes of the text. A null text has null in all three, an empty one no
    tokens. Repeated rows, ties and null ``doc_id`` are kept as they are; other columns are ignored, whatever their names;
    an empty table gives no rows. ``vocabulary``: ranks in tiktoken's file format, read on the driver.
    """
    shared = _shared(docs, vocabulary)
    rows = pick(docs, "doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            for part, data, at in slices(batch, "text"):
                tokens, begin = c.rows(data, at)
                back = c.bytes_of(tokens)
                exact = np.ones(part.num_rows, bool)
                if len(back) == len(data):
                    exact[np.searchsorted(at, np.flatnonzero(back != data), "right") - 1] = False
                else:
                    exact[:] = [np.array_equal(c.bytes_of(tokens[s:e]), data[i:j]) for s, e, i, j in zip(begin, begin[1:], at, at[1:])]
                null = part.column(1).is_null()
                lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(tokens.astype(np.int32)), mask=null) if part.num_rows else pa.array([], pa.list_(pa.int32()))
                gone = null.to_numpy(zero_copy_only=False)
                yield pa.record_batch([part.column(0), pa.array(np.diff(begin), mask=gone), lists, pa.array(exact, mask=gone)], ["doc_id", "n_tokens", "tokens", "exact"])

    return rows.mapInArrow(encode, f"doc_id {type_of(rows, 'doc_id')}, n_tokens long, tokens array<int>, exact boolean")


def bpe_decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, text`` of rows with ``doc_id, tokens``; bytes that aren't UTF-8 become U+FFFD, null stays null."""
    shared = _shared(encoded, vocabulary)
    rows = pick(encoded, "doc_id", "tokens").withColumn("tokens", F.col("tokens").cast("array<int>"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            lists = batch.column(1)
            tokens = lists.flatten().to_numpy()
            n = pc.list_value_length(lists).fill_null(0).to_numpy()
            size = np.concatenate([[0], np.cumsum(c.size[tokens])])[np.concatenate([[0], np.cumsum(n)])]
            raw = c.bytes_of(tokens).tobytes()
            gone = lists.is_null().to_pylist()
            texts = [None if null else raw[i:j].decode("utf-8", "replace") for i, j, null in zip(size[:-1].tolist(), size[1:].tolist(), gone, strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(decode, f"doc_id {type_of(rows, 'doc_id')}, text string")
