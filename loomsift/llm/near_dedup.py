"""Operator 7: near-dedup by ProbMinHash.

A text is a weighted set of word shingles. Each shingle sends the arrivals of a Poisson process, whose rate is its weight,
to random components; it stops once its next arrival comes after all components' minima. Equal components estimate
probability Jaccard. Bands of components give candidates, whose exact similarity is then computed from the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomsift.llm.arrays import WORDY, Prefix, lowered, mix, pick, rows_of, runs, slices, utf8
from loomsift.llm.store import checkpointed

SHINGLE = 3
COMPONENTS, BANDS, ROWS = 128, 42, 3
#: Probability Jaccard from which two texts are near copies; at it 99.6 % of pairs share a band, at 0.6 99.997 %.
THRESHOLD = 0.5
#: Partners that one text is compared with in a task, on average; more of them are parted.
HUB_PARTNERS = 512
#: Bytes of text and number of texts of a block of a large band.
BLOCK_BYTES, BLOCK_TEXTS = 1 << 22, 1024
#: Texts of a band from which their places are counted in parts.
PART_TEXTS = 1 << 16
#: Hashes that different texts may share.
COLLIDED = 10_000
#: Pairs of texts that a shingle has in common from which it is a column of a dense matrix.
DENSE_PAIRS = 256


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and number of occurrences of each distinct shingle, in order of row and hash.

    Words are runs of letters and digits in lower case; a text of fewer words than a shingle has is one shingle.
    """
    low = lowered(data)
    starts, ends = runs(WORDY[low], at)
    row = rows_of(at, starts)
    words = Prefix(Prefix(low).of(starts, ends))
    first = np.arange(len(starts))
    begin = np.searchsorted(row, row)
    after = np.searchsorted(row, row, "right")
    last = np.minimum(first + SHINGLE, after)
    own = (last - first == SHINGLE) | (first == begin)
    h = words.of(first[own], last[own])
    row = row[own]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    where = np.flatnonzero(new)
    return row[where], h[where], np.diff(np.append(where, len(h)))


def signatures(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the shingle that arrives first at each component; rows without shingles are all 0."""
    least = np.full(n * COMPONENTS, np.inf)
    winner = np.zeros(n * COMPONENTS, np.uint64)
    size = np.bincount(row, minlength=n)
    # arrivals drawn at a time: all components of a row are reached by about COMPONENTS * ln(COMPONENTS) of them
    burst = np.maximum(1, -(-int(COMPONENTS * (np.log(COMPONENTS) + 0.6)) // np.maximum(size, 1)))
    alive = np.arange(len(row))
    time = np.zeros(len(row))
    drawn = np.zeros(len(row), np.int64)
    while len(alive):
        k = burst[row[alive]]
        each = np.repeat(alive, k)
        number = np.arange(len(each)) - np.repeat(np.cumsum(k) - k, k) + drawn[each]
        bits = mix(h[each] ^ mix(number.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))
        gap = -np.log(((bits >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight[each]
        total = np.cumsum(gap)
        ends = np.cumsum(k) - 1
        before = np.concatenate([[0.0], total[ends[:-1]]])
        arrival = time[each] + (total - np.repeat(before, k))
        slot = row[each] * COMPONENTS + (bits & np.uint64(COMPONENTS - 1)).astype(np.int64)
        better = np.flatnonzero(arrival < least[slot])
        better = better[np.argsort(-arrival[better], kind="stable")]  # of several at one component the last written stays
        least[slot[better]] = arrival[better]
        winner[slot[better]] = h[each[better]]
        time[alive] = arrival[ends]
        drawn[alive] += k
        latest = least.reshape(n, COMPONENTS).max(1)
        alive = alive[time[alive] < latest[row[alive]]]
    return winner.reshape(n, COMPONENTS)


def bands(signature: np.ndarray) -> np.ndarray:
    rows = signature[:, : BANDS * ROWS].reshape(len(signature), BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        key = mix(key + rows[:, :, i])
    return key


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two weighted sets, hashes in order."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    both = hb[at] == ha
    shared = np.stack([wa[both], wb[at[both]]], 1)
    if not len(shared):
        return 0.0
    kinds, count = np.unique(shared, axis=0, return_counts=True)
    kinds = kinds.astype(float)
    rest_a, rest_b = wa.sum() - shared[:, 0].sum(), wb.sum() - shared[:, 1].sum()
    x, y = kinds[:, 0], kinds[:, 1]
    sums = np.array([(count * np.maximum(x / u, y / v)).sum() + rest_a / u + rest_b / v for u, v in kinds])
    return float((count / sums).sum())


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, at in slices(batch, "text", 1 << 19):
            row, h, weight = shingles(data, at)
            present, dense = np.unique(row, return_inverse=True)
            if len(present):
                keys = bands(signatures(dense, h, weight, len(present)))
                text = part.column(0).to_numpy()[present]
                yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(text, BANDS))], ["band", "d"])


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of band and text: each text but the first with its band, its band's first and the one before it."""
    hub = last = band = None
    for batch in batches:
        b, d = (c.to_numpy() for c in batch.columns)
        if not len(b):
            continue
        new = np.ones(len(b), bool)
        new[1:] = b[1:] != b[:-1]
        new[0] = band is None or b[0] != band
        before = np.empty_like(d)
        before[1:] = d[:-1]
        before[0] = d[0] if last is None else last
        start = np.maximum.accumulate(np.where(new, np.arange(len(b)), -1))
        first = np.where(start >= 0, d[start], d[0] if hub is None else hub)
        own = ~new & (d != before)
        hub, last, band = first[-1], d[-1], b[-1]
        yield pa.record_batch([pa.array(x[own]) for x in (b, first, before, d)], ["band", "hub", "before", "d"])


def _weighted(text: str) -> tuple[np.ndarray, np.ndarray]:
    data, at = utf8(pa.array([text], pa.large_string()))
    return shingles(data, at)[1:]


def _verifier(threshold: float):  # noqa: ANN202
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in batches:
            a_, b_ = [], []
            for a, b, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if b is None:
                    hub, own = a, _weighted(text)
                elif a == hub and similarity(own, _weighted(text)) >= threshold:
                    a_.append(a)
                    b_.append(b)
            yield pa.record_batch([pa.array(a_, pa.int64()), pa.array(b_, pa.int64())], ["a", "b"])

    return verify


Sets = tuple[np.ndarray, np.ndarray, np.ndarray]


def shared_weights(a: Sets, b: Sets, na: int, nb: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of na texts and each of nb others the weight of their common shingles, in the one and in the other.

    Rows, hashes and weights of the two sides; shingles of many pairs are multiplied as dense matrices, others pair by pair.
    """
    common = np.intersect1d(np.unique(a[1]), np.unique(b[1]), assume_unique=True)
    out = [np.zeros(na * nb), np.zeros(na * nb)]
    if not len(common):
        return out[0].reshape(na, nb), out[1].reshape(na, nb)
    sides = []
    for row, h, w in (a, b):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        own = np.flatnonzero(common[at] == h)
        own = own[np.argsort(at[own], kind="stable")]
        sides.append((row[own], at[own], w[own].astype(float), np.bincount(at[own], minlength=len(common))))
    (ra, ca, wa, fa), (rb, cb, wb, fb) = sides
    dense = fa * fb >= DENSE_PAIRS
    light = np.flatnonzero(~dense[ca])
    first = np.cumsum(fb) - fb
    cost = np.cumsum(fb[ca[light]])
    for part in np.split(light, np.searchsorted(cost, np.arange(1 << 20, cost[-1] if len(cost) else 0, 1 << 20))):
        k = fb[ca[part]]
        x = np.repeat(part, k)
        y = np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[ca[part]], k)
        pair = ra[x] * nb + rb[y]
        out[0] += np.bincount(pair, wa[x], na * nb)
        out[1] += np.bincount(pair, wb[y], na * nb)
    sums = [x.reshape(na, nb) for x in out]
    heavy = np.flatnonzero(dense)
    for cut in range(0, len(heavy), 2048):
        columns = heavy[cut : cut + 2048]
        place = np.full(len(common), -1)
        place[columns] = np.arange(len(columns))
        (xa, ia), (xb, ib) = ((np.zeros((n, len(columns))), np.zeros((n, len(columns)))) for n in (na, nb))
        for r, c, w, x, i in ((ra, ca, wa, xa, ia), (rb, cb, wb, xb, ib)):
            own = place[c] >= 0
            x[r[own], place[c[own]]] = w[own]
            i[r[own], place[c[own]]] = 1
        sums[0] += xa @ ib.T
        sums[1] += ia @ xb.T
    return sums[0], sums[1]


def bounds(a: Sets, b: Sets, na: int, nb: int) -> np.ndarray:
    """Upper bounds of the probability Jaccard of each of na texts with each of nb others, exact where weights are equal.

    With X, Y the weights of two texts and x, y those of their common shingles, the similarity is at most
    xy / (Xy + (Y - y)x), for the sum over the common shingles is of a concave function of degree one; and so with the sides changed.
    """
    x, y = shared_weights(a, b, na, nb)
    whole_x, whole_y = np.bincount(a[0], a[2], na)[:, None], np.bincount(b[0], b[2], nb)[None, :]
    least = np.maximum(whole_x * y + (whole_y - y) * x, whole_y * x + (whole_x - x) * y)
    return np.divide(x * y, least, out=np.zeros_like(x), where=least > 0)


def _met(side: np.ndarray, d: np.ndarray, label: np.ndarray, sets: Sets, threshold: float) -> list[tuple[int, int]]:
    """Edges that join all near copies of different labels of two blocks, or of one block if there is one side."""
    row, h, w = sets
    one = int((side == 0).sum())
    cut = np.searchsorted(row, one)
    a = (row[:cut], h[:cut], w[:cut])
    alone = one == len(d)
    b = a if alone else (row[cut:] - one, h[cut:], w[cut:])
    shift = 0 if alone else one
    close = bounds(a, b, one, len(d) - shift) >= threshold - 1e-9
    close &= label[:one, None] != label[None, shift:]
    if alone:
        close = np.triu(close, 1)
    at = np.searchsorted(row, np.arange(len(d) + 1))
    above = {x: x for x in label.tolist()}

    def root(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    found = []
    for i, j in np.argwhere(close) + [0, shift]:
        p, q = root(int(label[i])), root(int(label[j]))
        if p != q and similarity((h[at[i] : at[i + 1]], w[at[i] : at[i + 1]]), (h[at[j] : at[j + 1]], w[at[j] : at[j + 1]])) >= threshold:
            above[p] = q
            found.append((int(d[i]), int(d[j])))
    return found


def _meeter(threshold: float):  # noqa: ANN202
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of band, i, j, side and d; those of one band, i and j meet."""
        key, held = None, []

        def done() -> list[tuple[int, int]]:
            sizes = np.cumsum([0, *(len(x[0]) for x in held)])
            side, d, label = (np.concatenate([x[k] for x in held]) for k in range(3))
            row = np.concatenate([x[3] + n for x, n in zip(held, sizes, strict=False)])
            return _met(side, d, label, (row, *(np.concatenate([x[k] for x in held]) for k in (4, 5))), threshold)

        def answer(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for part, data, at in slices(batch, "text", 1 << 19):
                row, h, w = shingles(data, at)
                band, i, j, side, d, label = (part.column(k).to_numpy() for k in range(6))
                edge = np.flatnonzero((band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
                found = []
                for s, e in zip([0, *edge.tolist()], [*edge.tolist(), len(d)], strict=True):
                    now = (band[s], i[s], j[s])
                    if held and now != key:
                        found += done()
                        held.clear()
                    key = now
                    p, q = np.searchsorted(row, [s, e])
                    held.append((side[s:e], d[s:e], label[s:e], row[p:q] - s, h[p:q], w[p:q]))
                yield answer(found)
        if held:
            yield answer(done())

    return meet


def _crowds(linked: DataFrame, labels: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: near copies among all pairs of a band whose ends aren't connected yet, as far as connecting them asks.

    In a band of up to three texts the links were all pairs. Larger ones are cut into blocks in order of label, and each
    pair of blocks that has two labels is a group of its own. Places in the order are sums of two levels, so that no task
    sees a whole band.
    """
    many = linked.groupBy("band").agg(F.count("*").alias("n"), F.first("hub").alias("hub")).where("n > 2")
    members = linked.join(many.select("band"), "band").select("band", "d").union(many.select("band", F.col("hub").alias("d")))
    members = members.join(labels, "d", "left").withColumn("label", F.coalesce("label", "d"))
    # bands of equal texts are met once
    sums = members.groupBy("band").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n"), F.sum(F.xxhash64("d").cast("decimal(20,0)")).alias("h"))
    kept = sums.where("least < most").groupBy("n", "h").agg(F.min("band").alias("band")).select("band", "n")
    sizes = texts.select("d", F.octet_length("text").cast("long").alias("size"))
    eighth = lambda c: F.shiftrightunsigned(c, 56)
    part = F.when(F.col("n") > PART_TEXTS, eighth("label") * 256 + eighth("d")).otherwise(F.lit(0).cast("long"))
    placed = members.join(kept, "band").join(sizes, "d").withColumn("part", part)
    totals = placed.groupBy("band", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("texts"))
    earlier = Window.partitionBy("band").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("band", "part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("bytes", "texts")))
    order = Window.partitionBy("band", "part").orderBy("label", "d")
    placed = placed.withColumns({"bytes": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"), "texts": F.row_number().over(order) - 1})
    block = F.floor((F.col("bytes") + F.col("bytes_before")) / F.lit(BLOCK_BYTES)) + F.floor((F.col("texts") + F.col("texts_before")) / F.lit(BLOCK_TEXTS))
    placed = checkpointed(placed.join(totals, ["band", "part"]).withColumn("block", block).select("band", "block", "d", "label"))
    blocks = placed.groupBy("band", "block").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    other = blocks.select("band", F.col("block").alias("j"), F.col("least").alias("least_j"), F.col("most").alias("most_j"))
    tasks = blocks.withColumnRenamed("block", "i").join(other, "band").where("i <= j AND (least < most OR least_j < most_j OR least <> least_j)").select("band", "i", "j")
    sides = tasks.select("band", "i", "j", F.lit(0).alias("side"), F.col("i").alias("block")).union(tasks.where("i < j").select("band", "i", "j", F.lit(1).alias("side"), F.col("j").alias("block")))
    rows = sides.join(placed, ["band", "block"]).join(texts, "d").select("band", "i", "j", "side", "d", "label", "text")
    gathered = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "side", "d")
    return gathered.mapInArrow(_meeter(threshold), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``d, label``: the least one connected with each end of an edge, but for that one itself; large and small stars.

    A vertex's least neighbour is found by an aggregate and joined to its edges, which are never gathered.
    """
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if state == seen or not state.n:
            return now.groupBy(F.col("u").alias("d")).agg(F.min("v").alias("label"))
        seen = state
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = checkpointed(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpointed(small.union(least.select("u", "m")).distinct())


def _keyed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, d, text, ...`` and the distinct ``doc_id, d``, where d is one text's alone.

    Of 10**10 texts a few share a 64-bit hash; those have a second one mixed in, of which there can be no more than COLLIDED.
    """
    d, e = F.xxhash64("text"), F.xxhash64(F.lit(2), "text")
    some = rows.where("doc_id IS NOT NULL AND text IS NOT NULL")
    ids = checkpointed(some.select("doc_id", d.alias("d"), e.alias("e")).distinct())
    shared = [r.d for r in ids.groupBy("d").agg(F.min("e").alias("e"), F.max("e").alias("f")).where("e < f").limit(COLLIDED + 1).collect()]
    if len(shared) > COLLIDED:
        raise ValueError(f"over {COLLIDED} hashes are shared by different texts")
    own = lambda d, e: F.when(d.isin(shared), F.xxhash64(d, e)).otherwise(d) if shared else d
    return some.withColumn("d", own(d, e)), ids.select("doc_id", own(F.col("d"), F.col("e")).alias("d"))


def _grouped(keyed: DataFrame, ids: DataFrame, threshold: float) -> DataFrame:
    """``doc_id, d, group_id, is_first`` of the documents in groups."""
    signed = keyed.select("d", "text").mapInArrow(_sign, "band long, d long").repartition("band").sortWithinPartitions("band", "d")
    linked = checkpointed(signed.mapInArrow(_link, "band long, hub long, before long, d long"))
    edges = checkpointed(linked.select(F.explode(F.array("hub", "before")).alias("a"), F.col("d").alias("b")).distinct())
    ends = edges.select(F.explode(F.array("a", "b")).alias("d")).distinct()
    # equal texts become one in each task, and are compared
    texts = keyed.groupBy("d").agg(F.collect_set("text").alias("same")).select("d", F.expr("if(size(same) = 1, same[0], raise_error('two texts have the same hashes'))").alias("text"))
    texts = checkpointed(texts.join(ends, "d"))
    # a hub's partners are spread over as many groups as their number asks for, to each of which its text goes once
    groups = edges.groupBy("a").agg(F.ceil(F.count("*") / F.lit(HUB_PARTNERS)).alias("groups"))
    salted = edges.join(groups, "a").select("a", "b", F.pmod(F.xxhash64("b"), "groups").cast("int").alias("salt"))
    hubs = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("d", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    partners = salted.join(texts.withColumnRenamed("d", "b"), "b").select("a", "salt", "b", "text")
    gathered = hubs.union(partners).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    labels = checkpointed(components(gathered.mapInArrow(_verifier(threshold), "a long, b long")))
    # what hubs and neighbours have connected needs no more pairs; all other pairs of the bands are met
    labels = components(labels.select(F.col("d").alias("a"), F.col("label").alias("b")).union(_crowds(linked, labels, texts, threshold)))
    of = ids.join(labels, "d", "left").withColumn("label", F.coalesce("label", "d"))
    heads = of.groupBy("label").agg(F.min(F.struct("doc_id", "d")).alias("head"), F.count("*").alias("size")).where("size > 1")
    return of.join(heads, "label").select("doc_id", "d", F.col("head.doc_id").alias("group_id"), (F.struct("doc_id", "d") == F.col("head")).alias("is_first"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, group_id``: each document of a group of near copies but its first, and the id of that first one.

    Two texts are near copies if the probability Jaccard of their weighted shingles is ``threshold`` or over; groups are
    connected by such pairs, all of those that share a band. Equal texts are of one group. Null texts and ids are in none;
    texts without a word, empty ones included, have equal texts only as copies. Rows equal in id and text count as one. Other columns are ignored; an empty table gives no rows. Texts of one
    hash are compared, and two that differ stop the job.
    """
    return _grouped(*_keyed(pick(docs, "doc_id", "text")), threshold).where("NOT is_first").select("doc_id", "group_id")


def drop_near_duplicates(docs: DataFrame, *columns: str, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of which ``near_duplicates`` keeps the document, with ``columns``; nulls stay."""
    rows = pick(docs, "doc_id", "text", *(c for c in columns if c not in ("doc_id", "text")))
    named = rows.toDF(*(f"c{i}" for i in range(len(rows.columns)))).withColumnsRenamed({"c0": "doc_id", "c1": "text"})
    keyed, ids = _keyed(named)
    gone = _grouped(keyed.select("doc_id", "d", "text"), ids, threshold).where("NOT is_first").select("doc_id", "d")
    place = {c: f"c{i}" if i > 1 else c for i, c in enumerate(rows.columns)}
    kept = [F.col(place[c]).alias(c) for c in columns]
    return keyed.join(gone, ["doc_id", "d"], "left_anti").select(*kept).union(named.where("doc_id IS NULL OR text IS NULL").select(*kept))
