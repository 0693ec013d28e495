"""Operator 2: repeated passages by a hash-compared suffix sort.

Suffixes are of words. Two suffixes that agree in their first LEAST words have the same least gram among those words, at
the same distance, so that suffixes are sorted where that gram sends them. There prefix polynomial hashes and binary search
find the common extension of any two, with which a mergesort compares them; neighbours that extend over LEAST words and
whose words prove equal are a repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomsift.llm.arrays import SPACE, Prefix, pick, rows_of, runs, slices, utf8
from loomsift.llm.store import stored

#: Words of the shortest repeat, and of the grams that suffixes are sent by.
LEAST, GRAM = 50, 8
#: Words of the rows that are sorted at a time, those of one gram together, and bytes of text cut up at a time.
BLOCK_WORDS, BYTES_A_WORD, SLICE = 1 << 16, 5, 1 << 19
#: Rows of a gram up to which its suffixes are sorted together. Those of a more frequent gram, which may be in any share of
#: all texts, are grouped by a 128-bit digest of all of their LEAST words instead; the passages are the same either way.
CROWD = 2048


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, gram hash, place of the gram, and first and last suffix whose least gram it is, in words of the row."""
    starts, ends = runs(~SPACE[data], at)
    n = len(starts)
    if n < LEAST:
        return (np.zeros(0, np.int64),) * 5
    row = rows_of(at, starts)
    begin = np.searchsorted(row, np.arange(len(at) - 1))
    words = Prefix(Prefix(data).of(starts, ends))
    place = np.arange(n - GRAM + 1)
    gram = words.of(place, place + GRAM)
    bits = np.uint64(max(1, int(n).bit_length()))
    least = gram >> bits << bits | place.astype(np.uint64)  # of equal grams the leftmost
    width, span = 1, LEAST - GRAM + 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    suffix = np.arange(n - LEAST + 1)
    own = row[suffix] == row[suffix + LEAST - 1]
    suffix, chosen = suffix[own], (least[: n - LEAST + 1][own] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    if not len(suffix):
        return (np.zeros(0, np.int64),) * 5
    new = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.append(new[1:], len(suffix)) - 1
    r = row[suffix[new]]
    return r, gram[chosen[new]], chosen[new] - begin[r], suffix[new] - begin[r], suffix[last] - begin[r]


class Suffixes:
    """Suffixes of a sequence of word hashes, each ending at its own limit."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, limits: np.ndarray) -> None:
        self.words = np.append(words, np.uint64(0))
        self.prefix = Prefix(words)
        self.starts, self.limits = starts, limits

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that suffixes a and b have in common: binary search over equal hashes of prefixes."""
        sa, sb = self.starts[a], self.starts[b]
        low, high = np.zeros(len(a), np.int64), np.minimum(self.limits[a] - sa, self.limits[b] - sb)
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_] + 1) >> 1
            x, y = sa[open_], sb[open_]
            same = self.prefix.raw(x, x + middle) == self.prefix.raw(y, y + middle)
            low[open_[same]] = middle[same]
            high[open_[~same]] = middle[~same] - 1
        return low

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix a comes before b in order of word hashes; where or_equal, also if they are equal."""
        n = self.extension(a, b)
        left_a, left_b = self.limits[a] - self.starts[a] - n, self.limits[b] - self.starts[b] - n
        x = self.words[np.minimum(self.starts[a] + n, len(self.words) - 1)]
        y = self.words[np.minimum(self.starts[b] + n, len(self.words) - 1)]
        return np.where((left_a == 0) | (left_b == 0), (left_a < left_b) | (or_equal & (left_a == left_b)), x < y)

    def sort(self, bucket: np.ndarray) -> np.ndarray:
        """All suffixes in order of bucket, sorted within it by a mergesort that merges all pairs of runs at once.

        An element's place in the merged run is its place in its own plus the elements of the other run before it, which
        binary search counts.
        """
        order = np.argsort(bucket, kind="stable")
        kind = bucket[order]
        begin = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])) if len(kind) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(kind)))
        first, many = np.repeat(begin, size), np.repeat(size, size)
        place = np.arange(len(kind)) - first  # within the bucket
        width = 1
        while len(moving := np.flatnonzero(many > width)):
            f, p, m = first[moving], place[moving], many[moving]
            pair = p // (2 * width) * (2 * width)
            left = p - pair < width
            low = f + np.where(left, np.minimum(pair + width, m), pair)
            base, high = low.copy(), f + np.where(left, np.minimum(pair + 2 * width, m), np.minimum(pair + width, m))
            own = order[moving]
            while len(open_ := np.flatnonzero(low < high)):
                middle = (low[open_] + high[open_]) >> 1
                # an element of the left run comes before its equals in the right one
                ahead = self.before(order[middle], own[open_], ~left[open_])
                low[open_[ahead]] = middle[ahead] + 1
                high[open_[~ahead]] = middle[~ahead]
            target = f + pair + (p - pair - np.where(left, 0, width)) + (low - base)
            order[target] = own
            width *= 2
        return order


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, at in slices(batch, "text", SLICE):
            row, gram, place, low, high = anchors(data, at)
            text = part.column(0).to_numpy()[row]
            yield pa.record_batch(
                [pa.array(gram.view(np.int64)), pa.array(text, pa.int64()), *(pa.array(x.astype(np.int32)) for x in (place, low, high))],
                ["gram", "d", "place", "low", "high"],
            )


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """By slices of texts: the text's number, gram, place, first and last suffix of its anchors, and a function that gives
    the words from one number to another, joined by single spaces.
    """
    for batch in batches:
        for part, data, at in slices(batch, "text", SLICE):
            starts, ends = runs(~SPACE[data], at)
            first = np.searchsorted(starts, at)
            lists = part.column(3)
            row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            a = lists.flatten()
            gram, place, low, high = (a.field(k).to_numpy() for k in ("gram", "place", "low", "high"))
            fits = high.astype(np.int64) + LEAST <= np.diff(first)[row]  # an anchor of another text of the same d may not
            row, gram, place, low, high = (x[fits] for x in (row, gram, place, low, high))
            raw = data.tobytes()
            gaps = np.concatenate([starts[1:] - ends[:-1] != 1, [True]]) | np.concatenate([data[ends[:-1]] != 32, [True]]) if len(starts) else np.zeros(0, bool)
            plain = np.concatenate([[0], np.cumsum(gaps)])

            def words(i: np.ndarray, j: np.ndarray, raw: bytes = raw, starts: np.ndarray = starts, ends: np.ndarray = ends, plain: np.ndarray = plain) -> list[bytes]:
                single = plain[j] == plain[i]
                return [raw[s:e] if one else b" ".join(raw[s:e].split()) for s, e, one in zip(starts[i].tolist(), ends[j].tolist(), single.tolist(), strict=True)]

            yield part, row, first[row], gram, place, low, high, words


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words that each anchor's suffixes begin with, LEAST of the last one."""
    for part, row, first, gram, place, low, high, words in _regions(batches):
        for some in _parted(high - low + LEAST):
            of = pa.array(row[some])
            texts = words(first[some] + low[some], first[some] + high[some] + LEAST - 1)
            yield pa.record_batch(
                [pa.array(gram[some]), part.column(0).take(of), pa.array(place[some] - low[some]), pa.array(low[some]), pa.array(texts, pa.binary()), part.column(2).take(of)],
                ["gram", "doc_id", "before", "low", "words", "most_id"],
            )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of the LEAST words of each suffix of the anchors."""
    for part, row, first, _, _, low, high, words in _regions(batches):
        size = high.astype(np.int64) - low + 1
        for some in _parted(size * LEAST):
            each = np.repeat(some, size[some])
            suffix = low[each] + np.arange(len(each)) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
            begin = first[each] + suffix
            keys = np.frombuffer(b"".join([blake2b(w, digest_size=16).digest() for w in words(begin, begin + LEAST - 1)]), np.int64).reshape(-1, 2)
            of = pa.array(row[each])
            yield pa.record_batch([pa.array(keys[:, 0]), pa.array(keys[:, 1]), part.column(0).take(of), part.column(2).take(of), pa.array(suffix)], ["k1", "k2", "doc_id", "most_id", "start_word"])


def _parted(words: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of rows, in runs of about BLOCK_WORDS words."""
    total = np.cumsum(words, dtype=np.int64)
    edges = np.searchsorted(total, np.arange(BLOCK_WORDS, total[-1] if len(total) else 0, BLOCK_WORDS), "right")
    yield from (x for x in np.split(np.arange(len(words)), edges) if len(x))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of gram, in blocks of about BLOCK_WORDS words that keep a gram together."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        gram = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.concatenate([[last is None or gram[0] != last], gram[1:] != gram[:-1]]))
        last = gram[-1]
        total = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(4)).to_numpy() // BYTES_A_WORD)])
        done = 0
        for edge in edges.tolist():
            if size + total[edge] - total[done] >= BLOCK_WORDS:
                held.append(batch.slice(done, edge - done))
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size, done = [], 0, edge
        if done < batch.num_rows:
            held.append(batch.slice(done))
            size += total[-1] - total[done]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def repeats(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last suffix of each run of repeats, and whether the row's text is the first that has them."""
    data, at = utf8(batch.column(4).cast(pa.string()))
    starts, ends = runs(~SPACE[data], at)
    hashes = Prefix(data).of(starts, ends)
    row = rows_of(at, starts)
    n = batch.num_rows
    begin, after = np.searchsorted(row, np.arange(n)), np.searchsorted(row, np.arange(n), "right")
    gram, ids, before, most_ids = (batch.column(k).to_numpy() for k in (0, 1, 2, 5))

    # equal rows, of whatever texts, are sorted as one that stands for the least and the greatest of them
    whole = Prefix(hashes).of(begin, after) ^ (before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    keys = np.lexsort((whole, gram))
    new = np.concatenate([[True], (whole[keys][1:] != whole[keys][:-1]) | (gram[keys][1:] != gram[keys][:-1])])
    raw = data.tobytes()
    for k in np.flatnonzero(~new).tolist():  # a hash isn't a proof
        a, b = keys[k - 1], keys[k]
        new[k] = raw[at[a] : at[a + 1]] != raw[at[b] : at[b + 1]]
    group = np.empty(n, np.int64)
    group[keys] = np.cumsum(new) - 1
    stands = keys[new]
    bounds = np.flatnonzero(new)
    least, most = np.minimum.reduceat(ids[keys], bounds), np.maximum.reduceat(most_ids[keys], bounds)

    count = after[stands] - begin[stands] - LEAST + 1
    of = np.repeat(np.arange(len(stands)), count)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    suffixes = Suffixes(hashes, begin[stands][of] + offset, after[stands][of])
    _, number = np.unique(gram, return_inverse=True)
    order = suffixes.sort(number[stands][of] * (4 * LEAST) + (before[stands][of] - offset))
    a, b = order[:-1], order[1:]
    joined = suffixes.extension(a, b) >= LEAST
    joined[joined] = _proven(raw, starts, ends, suffixes.starts[a[joined]], suffixes.starts[b[joined]], of[a[joined]], of[b[joined]])
    run = np.concatenate([[0], np.cumsum(~joined)])
    edge = np.flatnonzero(np.concatenate([[True], ~joined])) if len(order) else np.zeros(0, np.int64)
    lows, highs = np.minimum.reduceat(least[of[order]], edge), np.maximum.reduceat(most[of[order]], edge)
    repeated, origin = np.empty(len(of), bool), np.empty(len(of), np.int64)
    repeated[order], origin[order] = (lows != highs)[run], lows[run]

    # back to all rows
    size = count[group]
    each = np.repeat(np.arange(n), size)
    suffix = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
    at_stand = (np.cumsum(count) - count)[group][each] + suffix
    found = np.flatnonzero(repeated[at_stand])
    r, s, is_first = each[found], suffix[found], origin[at_stand[found]] == ids[each[found]]
    starts_run = np.concatenate([[True], (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1) | (is_first[1:] != is_first[:-1])]) if len(r) else np.zeros(0, bool)
    where = np.flatnonzero(starts_run)
    last = np.append(where[1:], len(r)) - 1
    return r[where], s[where], s[last] if len(where) else s[where], is_first[where]


def _proven(raw: bytes, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, row_a: np.ndarray, row_b: np.ndarray) -> np.ndarray:
    """Whether LEAST words from a and b are equal, byte by byte: once for all suffixes of two rows at one distance."""
    ok = np.ones(len(a), bool)
    if not len(a):
        return ok
    keys = np.lexsort((a, b - a, row_b, row_a))
    new = np.concatenate([[True], (row_a[keys][1:] != row_a[keys][:-1]) | (row_b[keys][1:] != row_b[keys][:-1]) | ((b - a)[keys][1:] != (b - a)[keys][:-1]) | (a[keys][1:] > a[keys][:-1] + LEAST)])
    where = np.flatnonzero(new)
    last = np.append(where[1:], len(keys)) - 1
    for i, j in zip(where.tolist(), last.tolist(), strict=True):
        x, y = keys[i], keys[j]
        if raw[starts[a[x]] : ends[a[y] + LEAST - 1]] != raw[starts[b[x]] : ends[b[y] + LEAST - 1]]:
            for k in keys[i : j + 1]:
                ok[k] = raw[starts[a[k]] : ends[a[k] + LEAST - 1]] == raw[starts[b[k]] : ends[b[k] + LEAST - 1]]
    return ok


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        r, s, e, first = repeats(block)
        low = block.column(3).to_numpy()[r]
        yield pa.record_batch([block.column(1).take(pa.array(r)), pa.array((low + s).astype(np.int64)), pa.array((low + e + LEAST).astype(np.int64)), pa.array(first)], ["doc_id", "start_word", "end_word", "is_first"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``doc_id, start_word, end_word, n_words, is_first``: the passages that a document shares with others.

    A passage is the union of all runs of LEAST words, equal and in the same order in another text, that overlap; words
    are separated by ASCII white space, of which kind and amount don't matter. ``start_word`` counts from 0, ``end_word``
    is the one after. ``is_first``: no document of a lesser id has it; passages of which that differs are separate rows.
    Of documents with equal texts all but the one of the least id are copies as a whole; texts of equal hashes are
    compared where they meet, and two that differ stop the job.

    Null ids and texts, and texts under LEAST words, have no passages; repeats within one text alone don't count; rows
    equal in id and text count as one; ids must be whole numbers, and of texts under one id each is seen by itself. Other
    columns are ignored; an empty table gives no rows.
    """
    rows = pick(docs, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    keyed = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("d"), F.xxhash64(F.lit(2), "text").alias("e"), "text")
    # counted before any row of a gram meets another one, so that a gram of a third of all texts is no task of its own
    sent = stored(keyed.select("d", "text").mapInArrow(_send, "gram long, d long, place int, low int, high int"), "anchors")
    several = sent.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram", (F.col("n") > CROWD).alias("crowded"))
    anchored = sent.join(several, "gram")

    ids = keyed.select("doc_id", "d", "e").distinct()
    texts = keyed.groupBy("d", "e").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("most_id"), F.collect_set("text").alias("same"))
    texts = texts.withColumn("text", F.expr("if(size(same) = 1, same[0], raise_error('two texts have the same hashes'))"))

    def met(crowded: bool) -> DataFrame:
        own = anchored.where(F.col("crowded") == crowded).groupBy("d").agg(F.collect_set(F.struct("gram", "place", "low", "high")).alias("anchors"))
        lists = own.join(ids.select("d", "e").distinct(), "d")
        return texts.join(lists, ["d", "e"]).select("doc_id", "text", "most_id", "anchors")

    cut = met(False).mapInArrow(_cut, "gram long, doc_id long, before int, low int, words binary, most_id long")
    sorted_ = cut.repartition("gram").sortWithinPartitions("gram").mapInArrow(_find, "doc_id long, start_word long, end_word long, is_first boolean")
    suffixes = met(True).mapInArrow(_digest, "k1 long, k2 long, doc_id long, most_id long, start_word long")
    shared = suffixes.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.max("most_id").alias("most")).where("least < most").drop("most")
    grouped = suffixes.join(shared, ["k1", "k2"]).select("doc_id", "start_word", (F.col("start_word") + LEAST).alias("end_word"), (F.col("doc_id") == F.col("least")).alias("is_first"))
    found = sorted_.unionByName(grouped)

    order = Window.partitionBy("doc_id", "is_first").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parted = found.withColumn("new", F.when(F.coalesce(F.col("start_word") > reach, F.lit(True)), 1).otherwise(0)).withColumn("passage", F.sum("new").over(order))
    spans = parted.groupBy("doc_id", "is_first", "passage").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")).drop("passage")

    firsts = texts.where("most_id > doc_id").select("d", "e", F.col("doc_id").alias("first_id"), F.regexp_count("text", F.lit("[^ \\t\\n\\x0B\\f\\r]+")).cast("long").alias("end_word"))
    whole = ids.join(firsts.where(F.col("end_word") >= LEAST), ["d", "e"]).where("doc_id > first_id").select("doc_id", F.lit(False).alias("is_first"), F.lit(0).cast("long").alias("start_word"), "end_word")
    both = spans.unionByName(whole)
    n_words = (F.col("end_word") - F.col("start_word")).alias("n_words")
    return both.groupBy("doc_id", "is_first", "start_word", "end_word").agg(n_words).select("doc_id", "start_word", "end_word", "n_words", "is_first")
