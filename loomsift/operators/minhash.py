"""MinHash LSH dedup over character n-grams, greedy in order."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsift.functions.samples import with_provenance
from loomsift.functions.store import checkpointed, stored
from loomsift.functions.text import dedup_text
from loomsift.operators.greedy import fallen

PRIME = (1 << 61) - 1
LOW = (1 << 32) - 1
#: Signatures of a bucket that meet as many others in one task.
BLOCK = 8192
#: Rows that are compared with each other at once; more are taken in shares of the order that double.
FIRST = 20_000
#: Pairs that are looked at at a time, and from how many on a group is compared as a matrix.
PAIRS, MATRIX = 1 << 16, 1 << 12


def bands_for(threshold: float, num_perm: int = 128) -> tuple[int, int]:
    """Bands and rows whose S-curve rises nearest to the threshold."""
    sizes = [(b, num_perm // b) for b in range(1, num_perm + 1) if num_perm % b == 0]
    return min(sizes, key=lambda s: (abs((1 / s[0]) ** (1 / s[1]) - threshold), s[0]))


def coefficients(num_perm: int, seed: int) -> list[tuple[int, int]]:
    rng = random.Random(seed)
    return [(rng.randint(1, PRIME), rng.randint(0, PRIME)) for _ in range(num_perm)]


class Signer:
    """Signatures, with the permuted hashes of each n-gram kept once computed."""

    KEPT = 40_000

    def __init__(self, ngram: int, num_perm: int, seed: int) -> None:
        self.n = ngram
        pairs = coefficients(num_perm, seed)
        a = [x % PRIME for x, _ in pairs]
        self.high = np.array([x >> 31 for x in a], np.uint64)
        self.low = np.array([x & (1 << 31) - 1 for x in a], np.uint64)
        self.b = np.array([y % PRIME for _, y in pairs], np.uint64)
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((1024, num_perm), np.uint32)

    def _permuted(self, h: np.ndarray) -> np.ndarray:
        """(a * h + b) mod 2**61 - 1, low 32 bits."""
        p, h = np.uint64(PRIME), h[:, None]
        fold = lambda x: (x & p) + (x >> np.uint64(61))
        top = fold(self.high * h)
        top = np.where(top >= p, top - p, top)
        top = ((top << np.uint64(31)) & p) | (top >> np.uint64(30))
        total = fold(fold(top + fold(self.low * h)) + self.b)
        return (np.where(total >= p, total - p, total) & np.uint64(LOW)).astype(np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        grams = {text[i : i + self.n] for i in range(len(text) - self.n + 1)}
        if not grams:
            return np.full(self.rows.shape[1], LOW, np.uint32)
        new = [g for g in grams if g not in self.ids]
        if new:
            if len(self.ids) + len(new) > max(self.KEPT, len(grams)):
                self.ids.clear()
                new = list(grams)
            start = len(self.ids)
            while len(self.rows) < start + len(new):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[start : start + len(new)] = self._permuted(np.array([int.from_bytes(hashlib.md5(g.encode()).digest()[-4:], "big") for g in new], np.uint64))
            self.ids |= {g: start + k for k, g in enumerate(new)}
        return self.rows[[self.ids[g] for g in grams]].min(0)


def _signed(samples: DataFrame, make: Callable[[], Signer], column: Callable[[list[np.ndarray]], pa.Array], kind: str) -> DataFrame:
    rows = samples.select("_seq", F.lower(dedup_text()).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.record_batch([part.column(0), column([signer(t or "") for t in part.column(1).to_pylist()])], ["_seq", "signature"])

    return rows.mapInArrow(sign, f"_seq long, signature {kind}")


def signatures(samples: DataFrame, ngram: int = 3, num_perm: int = 128, seed: int = 42) -> DataFrame:
    """``_seq, signature array<bigint>`` of each sample's lower-cased text."""

    def lists(found: list[np.ndarray]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * num_perm, pa.int32()), pa.array(np.concatenate(found).astype(np.int64)))

    return _signed(samples, lambda: Signer(ngram, num_perm, seed), lists, "array<bigint>")


def packed_signatures(samples: DataFrame, ngram: int = 3, num_perm: int = 128, seed: int = 42) -> DataFrame:
    """``_seq, signature binary``: the same in four bytes a component."""
    return _signed(samples, lambda: Signer(ngram, num_perm, seed), lambda found: pa.array([x.astype("<u4").tobytes() for x in found], pa.binary()), "binary")


def crowded(firsts: DataFrame, bands: int, rows: int) -> DataFrame:
    """``_seq, signature, spots`` of the rows of ``_seq, signature`` that share a band with others: the keys of those bands, and
    the blocks that all rows of such a key make.
    """
    band = lambda b: F.xxhash64(F.lit(b), F.substring("signature", 4 * rows * b + 1, 4 * rows))
    keys = firsts.select("_seq", F.explode(F.array(*map(band, range(bands)))).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    spots = keys.join(shared, "key").groupBy("_seq").agg(F.collect_list(F.struct("key", "blocks")).alias("spots"))
    return firsts.join(spots, "_seq")


def _at_spots(rows: DataFrame) -> DataFrame:
    return rows.select("_seq", "signature", F.explode("spots").alias("s")).select("_seq", "signature", "s.key", "s.blocks", F.pmod(F.xxhash64("_seq"), F.col("s.blocks")).cast("int").alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))


def _among(rows: DataFrame) -> DataFrame:
    """Each pair of blocks of a key once; a block with itself has one side."""
    return _at_spots(rows).select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("other") < F.col("own")).cast("int").alias("side"), "_seq", "signature")


def _across(old: DataFrame, new: DataFrame) -> DataFrame:
    """Each block of old rows of a key with each of new ones."""
    one = _at_spots(old).select("key", F.col("own").alias("x"), F.col("other").alias("y"), F.lit(0).alias("side"), "_seq", "signature")
    return one.unionByName(_at_spots(new).select("key", F.col("other").alias("x"), F.col("own").alias("y"), F.lit(1).alias("side"), "_seq", "signature"))


def _begins(key: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where a group begins, but at the first row."""
    return np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows in order of ``key, x, y, side``, cut between groups."""
    held: list[np.ndarray] = []
    for batch in batches:
        packed = batch.column(5).to_pylist()
        now = [*(batch.column(k).to_numpy() for k in range(5)), np.frombuffer(b"".join(packed), "<u4").reshape(len(packed), -1)]
        held = [np.concatenate(z) for z in zip(held, now, strict=True)] if held else now
        if len(begins := _begins(*held[:3])):
            yield [c[: begins[-1]] for c in held]
            held = [c[begins[-1] :] for c in held]
    if held:
        yield held


def _listed(sides: list[tuple[int, int, int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows ``from, to`` and ``from, to`` of many small groups, some at a time."""
    l0, l1, r0, r1 = np.array(sides, np.int64).reshape(-1, 4).T
    n = l1 - l0
    left = np.repeat(l0 - np.cumsum(n) + n, n) + np.arange(n.sum())
    first, wide = np.repeat(r0, n), np.repeat(r1 - r0, n)
    ends, at = np.cumsum(wide), 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        m = wide[at:to]
        yield np.repeat(left[at:to], m), np.repeat(first[at:to] - np.cumsum(m) + m, m) + np.arange(m.sum())
        at = to


def _likely(signature: np.ndarray, a: int, b: int, c: int, d: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those pairs of two ranges of rows that half of the components don't rule out."""
    half = (signature.shape[1] + 1) // 2
    need = least - (signature.shape[1] - half)
    right = np.ascontiguousarray(signature[c:d, :half].T)
    step = max(1, 8 * PAIRS // (d - c))
    for at in range(a, b, step):
        left = signature[at : min(b, at + step), :half]
        same = np.zeros((len(left), d - c), np.uint16)
        for k in range(half):
            same += left[:, k, None] == right[k]
        i, j = np.nonzero(same >= need)
        for cut in range(0, len(i), PAIRS):
            yield i[cut : cut + PAIRS] + at, j[cut : cut + PAIRS] + c


def similar_in_groups(rows: DataFrame, least: int, pairs: bool = True) -> DataFrame:
    """``i, j`` of the rows of a group ``key, x, y`` that have ``least`` components in common, i before j: those of side 0 with
    those of side 1, in a block that meets itself all; without ``pairs`` only ``j``, side 0 being the earlier.

    Signatures meet in memory, so that a crowded bucket costs time but moves no pairs; a task holds a group at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, x, y, side, seq, signature in _whole_groups(batches):
            bounds = [0, *_begins(key, x, y).tolist(), len(key)]
            small, large = [], []
            for a, b in zip(bounds, bounds[1:]):
                m = a + int(np.count_nonzero(side[a:b] == 0))
                one = (a, b, a, b) if pairs and x[a] == y[a] else (a, m, m, b)
                n = (one[1] - one[0]) * (one[3] - one[2])
                if n:
                    (small if n < MATRIX else large).append(one)
            for found in (_listed(small), *(_likely(signature, *one, least) for one in large)):
                for p, q in found:
                    own = (x[p] < y[p]) | (seq[p] < seq[q]) if pairs else np.ones(len(p), bool)
                    p, q = p[own], q[own]
                    own = np.count_nonzero(signature[p] == signature[q], axis=1) >= least
                    i, j = np.minimum(seq[p[own]], seq[q[own]]), np.maximum(seq[p[own]], seq[q[own]])
                    yield pa.record_batch([pa.array(i), pa.array(j)], ["i", "j"]) if pairs else pa.record_batch([pa.array(np.unique(j))], ["j"])

    return rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side").mapInArrow(run, "i long, j long" if pairs else "j long")


def _shares(rows: DataFrame) -> list[int]:
    """Where the order is cut: after the first rows, and where what lies before has doubled."""
    n, shares = rows.count(), []
    at = FIRST
    while at < n:
        shares.append(at / n)
        at *= 2
    return sorted({int(x) for x in rows.approxQuantile("_seq", shares, 0.0005)}) if shares else []


def scan_in_order(rows: DataFrame, least: int) -> list[DataFrame]:
    """``j`` of the rows of ``crowded`` that fall to an earlier one that stays, in parts.

    Those of a share of the order that are similar to one that has stayed before fall first; only the rest meet each other,
    so that a crowd of copies, of which few stay, never makes all its pairs.
    """
    gone, kept = [], None
    cuts = [None, *_shares(rows), None]
    for low, high in zip(cuts, cuts[1:]):
        now = rows
        now = now if low is None else now.where(F.col("_seq") >= low)
        now = now if high is None else now.where(F.col("_seq") < high)
        if kept is not None:
            gone.append(checkpointed(similar_in_groups(_across(kept, now), least, pairs=False).distinct()))
            now = checkpointed(now.join(gone[-1].withColumnRenamed("j", "_seq"), "_seq", "left_anti"))
        gone.append(checkpointed(fallen(similar_in_groups(_among(now), least)).distinct()))
        if high is not None:
            stay = checkpointed(now.join(gone[-1].withColumnRenamed("j", "_seq"), "_seq", "left_anti"))
            kept = stay if kept is None else kept.unionByName(stay)
    return gone


def minhash_dedup(samples: DataFrame, threshold: float = 0.85, ngram: int = 3, num_perm: int = 128, seed: int = 42, bands: int | None = None, rows: int | None = None) -> DataFrame:
    """Drops each sample that shares a band with, and is by estimate similar to, an earlier one that stays.

    Equal signatures are resolved first: all but the first of them fall, for they have the same neighbours.
    """
    if bands is None or rows is None:
        bands, rows = bands_for(threshold, num_perm)
    if bands * rows != num_perm:
        raise ValueError(f"bands * rows must be num_perm: {bands} * {rows} != {num_perm}")
    least = next(k for k in range(num_perm + 2) if k / num_perm >= threshold)
    signed = packed_signatures(samples, ngram, num_perm, seed).where("_seq IS NOT NULL")
    firsts = stored(signed.groupBy("signature").agg(F.min("_seq").alias("_seq")), "signatures")
    gone = samples.select("_seq").where("_seq IS NOT NULL").join(firsts.select("_seq"), "_seq", "left_anti").withColumnRenamed("_seq", "j")
    for part in scan_in_order(stored(crowded(firsts, bands, rows), "crowded"), least):
        gone = gone.unionByName(part)
    notes = {"minhash_threshold": threshold, "ngram": ngram, "num_perm": num_perm, "lsh_bands": bands, "lsh_rows": rows}
    return with_provenance(samples.join(gone.withColumnRenamed("j", "_seq"), "_seq", "left_anti"), "MinHashDeduplicator", notes, notes | {"seed": seed})
