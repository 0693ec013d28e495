"""Operator 9: mixing sources to target weights.

Each source's tokens are packed into blocks of fixed length by offsets alone; every output shard draws multinomial counts
of its sources; a slot's place in its source goes through a pseudorandom permutation of the source's blocks; slots and
blocks are joined by index. Only the last join moves text, once.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomsift.llm.arrays import SPACE, mix, pick, rows_of, runs, slices, type_of, utf8
from loomsift.llm.store import checkpointed

BLOCK_TOKENS = 512
SHARD_BLOCKS = 1024
#: Target weight of a source: its tokens to this power, unless weights are given.
TEMPERATURE = 0.7
#: Documents packed in order, and shards whose blocks are numbered in order, in one task.
RUN_DOCS, RUN_SHARDS = 50_000, 4096


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Places of ``x`` in a pseudorandom permutation of range(n): a four-round Feistel network with cycle walking."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.array([key & (1 << 64) - 1], np.uint64) + np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> shift, v & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        return left << shift | right

    out = once(x.astype(np.uint64))
    while len(far := np.flatnonzero(out >= n)):
        out[far] = once(out[far])
    return out.astype(np.int64)


def _source_key(seed: int, source: str, epoch: int) -> int:
    return int.from_bytes(blake2b(f"{seed}\0{epoch}\0{source}".encode(), digest_size=8).digest(), "little")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, n_blocks: int | None = None, block_tokens: int = BLOCK_TOKENS, shard_blocks: int = SHARD_BLOCKS, seed: int = 9) -> DataFrame:
    """``shard, slot, source, block, position, doc_id, lang, n_tokens, text``: the pieces of documents in mixed blocks.

    A token is a run of bytes that aren't ASCII white space. The documents of a source, in an order given by their hash,
    are one sequence of tokens cut every ``block_tokens``; only a source's last block can be shorter. Slot ``slot`` of
    shard ``shard`` holds a block; its pieces follow each other by ``position``, in tokens from the block's begin. A
    piece keeps the white space after it, so all blocks of a source in order are its documents.

    ``weights``: share of the blocks by source, of any sum; a source that isn't named gets none. Default: tokens to the
    power TEMPERATURE. ``n_blocks``: blocks drawn, by default as many as there are. A source of which more blocks are
    drawn than it has begins again in another order; all its blocks are drawn before any is drawn twice.

    Null or empty texts have no tokens and no pieces. A null source is the empty one. Null ``doc_id`` and ``lang`` are
    kept; repeated rows count as often as they occur; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = pick(docs, "doc_id", "text", "lang", "source").withColumn("source", F.coalesce("source", F.lit("")))
    nulls = [F.isnull(c).cast("int") for c in ("doc_id", "lang")]
    keyed = rows.where(F.col("text").isNotNull()).withColumns({"k1": F.xxhash64(*nulls, "doc_id", "lang", "source", "text"), "k2": F.xxhash64(F.lit(5), *nulls, "text", "source", "doc_id")})

    counted = keyed.select("k1", "k2", "source", "text").mapInArrow(_counted, "k1 long, k2 long, source string, n long").where("n > 0")
    meta = checkpointed(counted.groupBy("k1", "k2", "source", "n").agg(F.count("*").alias("copies")))
    stats = {r.source: r for r in meta.groupBy("source").agg(F.sum(F.col("n") * F.col("copies")).alias("tokens"), F.sum("copies").alias("docs"), F.max("copies").alias("copies")).collect()}
    names = sorted(stats)
    blocks = {s: -(-stats[s].tokens // block_tokens) for s in names}
    share = np.array([max(0.0, weights.get(s, 0.0)) if weights is not None else stats[s].tokens ** TEMPERATURE for s in names], float)
    total = (sum(blocks.values()) if n_blocks is None else n_blocks) if share.sum() > 0 else 0
    share = share / share.sum() if total else share

    # packing: each document's first token in the sequence of its source, by way of the totals of runs of documents
    n_runs = F.create_map(*(x for s in names for x in (F.lit(s), F.lit(-(-stats[s].docs // RUN_DOCS))))) if names else F.create_map(F.lit(""), F.lit(1))
    each = meta.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn("run", F.pmod(F.shiftrightunsigned("k1", 8), n_runs[F.col("source")]))
    totals = each.groupBy("source", "run").agg(F.sum("n").alias("in_run")).withColumn("base", F.sum("in_run").over(Window.partitionBy("source").orderBy("run")) - F.col("in_run"))
    before = F.sum("n").over(Window.partitionBy("source", "run").orderBy("k1", "k2", "copy").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = each.withColumn("before", before).join(totals.select("source", "run", "base"), ["source", "run"]).withColumn("start", F.col("base") + F.col("before"))
    size = F.lit(block_tokens).cast("long")
    pieces = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("n") - 1) / size)))).select(
        "source", "block", "k1", "k2",
        F.greatest(F.col("block") * size - F.col("start"), F.lit(0)).alias("first"),
        F.least((F.col("block") + 1) * size - F.col("start"), F.col("n")).alias("after"),
        F.greatest(F.col("start") - F.col("block") * size, F.lit(0)).alias("position"),
    )

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = batch.column(0).to_numpy()
            n = np.minimum(shard_blocks, total - shard * shard_blocks)
            counts = np.array([np.random.default_rng([seed, int(s)]).multinomial(k, share) for s, k in zip(shard, n, strict=True)], np.int64).reshape(len(shard), len(names))
            within = np.cumsum(counts, 1) - counts
            at, which = np.nonzero(counts)
            yield pa.record_batch([pa.array(shard[at]), pa.array([names[w] for w in which.tolist()], pa.string()), pa.array(counts[at, which]), pa.array(within[at, which])], ["shard", "source", "count", "within"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, source, count, within, ended in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turn = np.arange(ended - count, ended)
                block = np.empty(count, np.int64)
                for epoch in np.unique(turn // blocks[source]).tolist():
                    own = turn // blocks[source] == epoch
                    block[own] = permuted(turn[own] % blocks[source], blocks[source], _source_key(seed, source, epoch))
                slots = np.random.default_rng([seed, shard, 1]).permutation(min(shard_blocks, total - shard * shard_blocks))[within : within + count]
                yield pa.record_batch([pa.array([source] * count, pa.string()), pa.array(block), pa.array(np.full(count, shard)), pa.array(slots)], ["source", "block", "shard", "slot"])

    shards = spark.range(-(-total // shard_blocks)).withColumnRenamed("id", "shard")
    drawn = shards.mapInArrow(draw, "shard long, source string, count long, within long")
    # how many blocks of its source earlier shards have drawn, by way of the totals of runs of shards; slots are made by shard
    drawn = drawn.withColumn("run", F.floor(F.col("shard") / F.lit(RUN_SHARDS)))
    sums = drawn.groupBy("source", "run").agg(F.sum("count").alias("in_run")).withColumn("earlier", F.sum("in_run").over(Window.partitionBy("source").orderBy("run")) - F.col("in_run"))
    within_run = F.sum("count").over(Window.partitionBy("source", "run").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    turns = drawn.withColumn("so_far", within_run).join(sums.select("source", "run", "earlier"), ["source", "run"])
    turns = turns.select("shard", "source", "count", "within", (F.col("earlier") + F.col("so_far")).alias("ended"))
    slots = turns.repartition("shard").mapInArrow(place, "source string, block long, shard long, slot long")

    # the planner takes the slots for as few as the shards they come from; they grow with the corpus and aren't broadcast
    use = pieces.join(slots.hint("merge"), ["source", "block"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("shard", "slot", "block", "position", "first", "after")).alias("pieces"))
    texts = keyed
    if any(r.copies > 1 for r in stats.values()):
        texts = texts.withColumn("copy", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1"))).where("copy = 1").drop("copy")
    joined = texts.join(use, ["k1", "k2"]).select("doc_id", "lang", "source", "text", "pieces")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                yield _cut(batch.slice(i, 500))

    return joined.mapInArrow(cut, f"shard long, slot long, source string, block long, position long, doc_id {type_of(rows, 'doc_id')}, lang string, n_tokens long, text string")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of each text in place of it."""
    for batch in batches:
        for part, data, at in slices(batch, "text"):
            n = np.bincount(rows_of(at, runs(~SPACE[data], at)[0]), minlength=part.num_rows)
            yield pa.record_batch([*part.columns[:3], pa.array(n)], ["k1", "k2", "source", "n"])


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The pieces of a batch of texts."""
    data, at = utf8(batch.column(3))
    starts, _ = runs(~SPACE[data], at)
    first_word = np.searchsorted(starts, at)
    lists = batch.column(4)
    row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    p = lists.flatten()
    field = lambda name: p.field(name).to_numpy(zero_copy_only=False)
    first, after = field("first"), field("after")
    n_words = np.diff(first_word)[row]
    padded = np.append(starts, 0)
    begin = np.where(first == 0, at[row], padded[first_word[row] + first])
    end = np.where(after >= n_words, at[row + 1], padded[np.minimum(first_word[row] + after, len(starts))])
    raw = data.tobytes()
    texts = pa.array([raw[s:e] for s, e in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary()).cast(pa.string())
    of = lambda c: batch.column(c).take(pa.array(row))
    return pa.record_batch([p.field("shard"), p.field("slot"), of(2), p.field("block"), p.field("position"), of(0), of(1), pa.array(after - first), texts], ["shard", "slot", "source", "block", "position", "doc_id", "lang", "n_tokens", "text"])
