"""Vectorised text primitives over Arrow string buffers.

A batch of texts is one UTF-8 byte array with row offsets; words, pre-tokens and hashes of any substring come from
whole-array numpy operations, without a Python object for each word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text worked on at a time; a longer text is one slice of its own.
SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Letters, digits and all of the bytes of other scripts.
WORDY = np.zeros(256, bool)
WORDY[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Modulus of the prefix hashes, a Mersenne prime: modulo 2**64 strings that fold evenly collide whatever the base.
PRIME = (1 << 61) - 1
_P, _31, _30, _61 = np.uint64(PRIME), np.uint64(31), np.uint64(30), np.uint64(61)
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_BASE = 0x1E3779B97F4A7C15 % PRIME
#: Elements whose halves are summed before the sums are reduced.
_RUN = 1 << 22
_powers = [np.ones(1, np.uint64)] * 2


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, matched by exact name, so that no extra column can clash; absent ones are null strings."""
    have = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(have))))

    def one(name: str) -> Column:
        return (F.col(f"c{have.index(name)}") if name in have else F.lit(None).cast("string")).alias(name)

    return plain.select(*map(one, names))


def type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, name: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in runs of rows of about ``most`` bytes of text."""
    data, at = utf8(batch.column(batch.schema.get_field_index(name)))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def row_starts(at: np.ndarray) -> np.ndarray:
    """Offsets at which a text that isn't empty begins."""
    return at[:-1][at[1:] > at[:-1]]


def rows_of(at: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return np.searchsorted(at, positions, "right") - 1


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the runs of true bytes; a run ends with its row."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[row_starts(at)] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    ends = at[1:][at[1:] > at[:-1]] - 1
    after[ends] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters, byte for byte."""
    low = LOWER[data]
    latin = np.flatnonzero(data == 0xC3) + 1
    latin = latin[latin < len(data)]
    capital = latin[(data[latin] >= 0x80) & (data[latin] <= 0x9E) & (data[latin] != 0x97)]
    low[capital] += 0x20
    return low


def folded(x: np.ndarray) -> np.ndarray:
    """Modulo PRIME, but for results of up to PRIME + 7."""
    y = x >> _61
    y += x & _P
    return y


def reduced(x: np.ndarray) -> np.ndarray:
    """Modulo PRIME."""
    x = folded(x)
    x -= _P * (x >= _P)
    return x


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Modulo PRIME, of folded factors: 2**61 is 1 there, so the upper bits are added to the lower ones."""
    a1, a0, b1, b0 = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    middle = a1 * b0
    middle += a0 * b1
    a1 *= b1
    a1 <<= np.uint64(1)
    a0 *= b0
    a1 += folded(a0)
    a1 += middle >> _30
    middle &= _LOW30
    middle <<= _31
    a1 += middle
    return reduced(a1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers, over n of them, of the base and of its inverse."""
    if len(_powers[0]) <= n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, PRIME))):
            p = np.ones(1, np.uint64)
            while len(p) < max(n, SLICE_BYTES) + 1:
                p = np.concatenate([p, product(p, np.uint64(pow(base, len(p), PRIME)))[: max(n, SLICE_BYTES) + 1 - len(p)]])
            _powers[i] = p
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _summed(x: np.ndarray) -> np.ndarray:
    """Sums before each element and after the last, modulo PRIME but not reduced."""
    out = np.zeros(len(x) + 1, np.uint64)
    for i in range(0, len(x), _RUN):
        np.cumsum(x[i : i + _RUN], out=out[i + 1 : i + 1 + _RUN])
        if i:
            out[i + 1 : i + 1 + _RUN] += np.uint64(int(out[i]) % PRIME)
    return out


class Prefix:
    """Prefix polynomial hashes modulo 2**61 - 1 of a sequence: the hash of any range takes one subtraction and product.

    Terms are summed as halves of 30 and 31 bits.
    """

    def __init__(self, values: np.ndarray) -> None:
        """values: bytes, or 64-bit hashes of words."""
        n = len(values)
        up, self.down = powers(n)
        if values.dtype == np.uint8:
            v = values.astype(np.uint64) + np.uint64(1)
            self.high, self.low = _summed(v * (up[:n] >> _31)), _summed(v * (up[:n] & _LOW31))
        else:
            v = product(folded(values), up[:n])
            self.high, self.low = _summed(v >> _31), _summed(v & _LOW31)

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        high, low = folded(self.high[ends]), folded(self.low[ends])
        for sums, x in ((self.high, high), (self.low, low)):
            x += np.uint64(2 * PRIME)
            x -= folded(sums[starts])
        high = folded(high)
        low += high >> _30
        high &= _LOW30
        high <<= _31
        low += high
        return product(folded(low), self.down[starts])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.raw(starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_odd = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_odd_powers = [np.ones(1, np.uint64)] * 2


def quick_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges modulo 2**64, three times as fast as those of Prefix; strings can be made that share one, so
    what they say equal must be compared.
    """
    if len(_odd_powers[0]) < len(data):
        base = 0x9E3779B97F4A7C15
        for i, b in enumerate((base, pow(base, -1, 1 << 64))):
            p = np.full(max(len(data), SLICE_BYTES), b, np.uint64)
            p[0] = 1
            _odd_powers[i] = np.cumprod(p, dtype=np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_odd[data] * _odd_powers[0][: len(data)], out=sums[1:])
    return (sums[ends] - sums[starts]) * _odd_powers[1][starts]


_classes: list[np.ndarray] = []
LETTER, NUMBER, OTHER, WHITE = 0, 1, 2, 3
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def classes() -> np.ndarray:
    """Letter, number, other or white space, of each code point."""
    if not _classes:
        kinds = np.full(0x110000, OTHER, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0]
            if k == "L":
                kinds[c] = LETTER
            elif k == "N":
                kinds[c] = NUMBER
        kinds[_WHITE] = WHITE
        _classes.append(kinds)
    return _classes[0]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offset and value of each code point of valid UTF-8."""
    where = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[where].astype(np.uint32)
    for least, mask in ((0xC0, 0x1F), (0xE0, 0x0F), (0xF0, 0x07)):
        at = np.flatnonzero(lead >= least) if least == 0xC0 else at[b0[at] >= least]  # noqa: F821
        if least == 0xC0:
            b0 = data[where]
            lead[at] = lead[at] & mask
        else:
            lead[at] = b0[at] & mask
        for k in range(1, {0xC0: 2, 0xE0: 3, 0xF0: 4}[least]):
            lead[at] = (lead[at] << 6) | (data[where[at] + k] & 0x3F)
    return where, lead


_ENDINGS = {"s": 1, "t": 1, "m": 1, "d": 1}
_PAIRS = {("r", "e"), ("v", "e"), ("l", "l")}


def pretokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the pre-tokens of byte-level BPE, those of
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` in each row.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    where, cp = code_points(data)
    n = len(where)
    kind = classes()[cp]
    white = kind == WHITE
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(where, row_starts(at))] = True
    first[n] = True
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 9, kind[:-1]
    space_before = np.zeros(n, bool)
    space_before[1:] = cp[:-1] == 32
    ends_white = np.empty(n, bool)  # the next one is in the same row and isn't white
    ends_white[-1], ends_white[:-1] = False, ~white[1:] & ~first[1:n]
    edge = np.where(white, (before != WHITE) | ends_white, np.where(before == WHITE, ~space_before, kind != before))
    edge |= first[:n]
    quotes = np.flatnonzero((cp == 39) & edge)
    for i in quotes.tolist():
        if i + 1 < n and not first[i + 1]:
            a = chr(cp[i + 1])
            b = chr(cp[i + 2]) if i + 2 < n and not first[i + 2] else ""
            k = 2 if a in _ENDINGS else 3 if (a, b) in _PAIRS else 0
            if k:
                edge[i + 1 : i + k] = False
                if i + k < n:
                    edge[i + k] = True
    starts = where[edge]
    return starts, np.append(starts[1:], len(data))
