"""Operator 1: toxicity by a convolutional text classifier.

Words are sums of hashed embeddings of the word and its beginnings; filters of several widths run over them and are
max-pooled over the whole text. Trained in numpy on all labelled documents, with thresholds calibrated by language on
cross-validated scores of all of them.

The labelled documents, as words' embedding rows, lie in parts of a bounded number of words. In each epoch every part goes
on from the model that the last one ended with; of the parts' models the mean is taken, of an embedding that of the parts
that moved it. Models lie in the shared folder and are merged block by block by tasks.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsift.functions.files import below, opened, remove
from loomsift.functions.store import own_folder
from loomsift.llm.arrays import WORDY, Prefix, lowered, pick, rows_of, runs, slices, type_of, utf8

#: Bytes of text of a part, as near as whole buckets allow, and tasks that make one.
PART_BYTES, MAKERS = 1 << 27, 8
#: Bits of hashes of labelled ids by which texts are left out before the shuffle: half a million numbers, whatever the labels.
ID_BITS = 25
#: Labelled ids of a bucket, by their hashes, and bytes of text of a chunk of one, all of whose words are numbered.
BUCKET, CHUNK = 1000, 1 << 20
#: Parts of the embedding that are merged by a task each.
BLOCKS = 16
HASH_BITS, WIDTH, FILTERS, WIDTHS = 18, 8, 8, (1, 2, 3)
#: Bytes of a word's beginnings that have embeddings of their own, beside the whole word.
BEGINNINGS = (4, 5, 6)
EPOCHS, BATCH, RATE, DECAY = 3, 48, 0.02, 1e-5
#: Steps of training of each part besides those of the epochs, whose number follows the part's size.
MORE_STEPS = 100
#: The first component of an embedding begins as START times its log odds, drawn to 0 by SHRINK documents; the first filter
#: of each width, whose weight begins as FIRST, as their mean.
START, SHRINK, FIRST = 0.1, 4, 1.0
#: Folds of the documents of which each is scored by a model of the others, to calibrate thresholds on.
FOLDS = 3
#: Toxic documents by which a language's threshold is drawn to that of all, and that one to one half.
DRAWN = 10
#: Squares of gradients before the first step.
SQUARES = np.float32(1e-6)


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of each word, and each word's text."""
    low = lowered(data)
    starts, ends = runs(WORDY[low], at)
    prefix = Prefix(low)
    shift = np.uint64(64 - HASH_BITS)
    out = np.empty((len(starts), 1 + len(BEGINNINGS)), np.int32)
    out[:, 0] = prefix.of(starts, ends) >> shift
    for k, n in enumerate(BEGINNINGS, 1):
        # a word that isn't longer is its own beginning, of which there is one
        out[:, k] = (prefix.of(starts, np.minimum(ends, starts + n)) + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15) >> shift
    return out, rows_of(at, starts)


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]  # of each width: width x WIDTH x FILTERS
    bias: np.ndarray
    weights: np.ndarray
    offset: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def _laid_out(self, words: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word vectors as columns, the texts apart by zeros; words' places and texts' begins."""
        gap = max(WIDTHS) - 1
        place = np.arange(len(row)) + row * gap
        x = np.zeros((WIDTH, len(row) + (n + 1) * gap), np.float32)
        v = self.embedding.take(words[:, 0], axis=0)
        for k in range(1, words.shape[1]):
            v += self.embedding.take(words[:, k], axis=0)
        x[:, place] = v.T
        return x, place, np.searchsorted(row, np.arange(n)) + np.arange(n) * gap

    def _filtered(self, x: np.ndarray, place: np.ndarray, i: int) -> np.ndarray:
        """A filter's output at each word; none between texts, where it would go over into the next one."""
        w, f = WIDTHS[i], self.filters[i]
        long = x.shape[1] - w + 1
        y = f[0].T @ x[:, :long]
        for j in range(1, w):
            y += f[j].T @ x[:, j : long + j]
        between = np.ones(x.shape[1], bool)
        between[place] = False
        y[:, between[:long]] = -np.inf
        return y

    def scores(self, words: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        x, place, begin = self._laid_out(words, row, n)
        best = np.concatenate([np.maximum.reduceat(self._filtered(x, place, i), begin, axis=1) for i in range(len(WIDTHS))])
        p = np.maximum(best.T + self.bias, 0).astype(float)
        return 1 / (1 + np.exp(-np.clip(p @ self.weights + self.offset, -30, 30)))

    def step(self, words: np.ndarray, row: np.ndarray, target: np.ndarray, weight: np.ndarray, state: dict, rate: float) -> None:
        """One step of Adagrad on the weighted log loss; only the places that won the pooling move."""
        n = len(target)
        x, place, begin = self._laid_out(words, row, n)
        ends = np.append(begin[1:], x.shape[1])
        won, best = [], []
        for i, w in enumerate(WIDTHS):
            y = self._filtered(x, place, i)
            win = np.stack([y[:, s : min(e, y.shape[1])].argmax(1) + s for s, e in zip(begin.tolist(), ends.tolist(), strict=True)])
            won.append(win)
            best.append(y[np.arange(FILTERS), win])
        p = np.maximum(np.concatenate(best, 1) + self.bias, 0)
        z = p @ self.weights + self.offset
        d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight / n).astype(np.float32)
        grads = {"weights": p.T @ d + DECAY * self.weights}
        dp = np.outer(d, self.weights) * (p > 0)
        grads["bias"] = dp.sum(0)
        ats, parts = [], []
        for i, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            g = dp[:, i * FILTERS : (i + 1) * FILTERS]
            df = np.zeros_like(f)
            for j in range(w):
                at = won[i] + j
                df[j] = np.einsum("cnf,nf->cf", x[:, at], g)
                ats.append(at.ravel())
                parts.append((g[:, :, None] * f[j].T[None]).reshape(-1, WIDTH))
            grads[f"filter{i}"] = df
        values = {"weights": self.weights, "bias": self.bias, **{f"filter{i}": f for i, f in enumerate(self.filters)}}
        for k, v in values.items():
            state[k] = state.get(k, 1e-6) + grads[k] ** 2
            v -= rate * grads[k] / np.sqrt(state[k])
        slope = float(d.sum())
        state["offset"] = state.get("offset", 1e-6) + slope**2
        self.offset -= rate * slope / state["offset"] ** 0.5
        word = np.full(x.shape[1], -1)
        word[place] = np.arange(len(place))
        moved, g = word[np.concatenate(ats)], np.concatenate(parts)
        some = np.flatnonzero((moved >= 0) & g.any(1))
        if len(some):
            every = words[moved[some]].ravel()
            order = np.argsort(every, kind="stable")
            every = every[order]
            first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
            ids, total = every[first], np.add.reduceat(g[some[order // words.shape[1]]], first, axis=0)
            if "embedding" not in state:
                state["embedding"] = np.full(self.embedding.shape, SQUARES)
            squares = state["embedding"]
            squares[ids] += total**2
            self.embedding[ids] -= rate * total / np.sqrt(squares[ids])

    def calibrate(self, scores: np.ndarray, toxic: np.ndarray, lang: np.ndarray, prior: np.ndarray) -> None:
        """Thresholds of greatest F1 under the classes' true frequencies, in the middle of the gap there; a language's, as
        log odds, is a mean of its own and that of all, weighted by its toxic documents and DRAWN.
        """
        one = {str(x): (best_threshold(scores[own], toxic[own], prior[own]), int(toxic[own].sum())) for x in np.unique(lang) for own in [lang == x]}
        self.settle((best_threshold(scores, toxic, prior), int(toxic.sum())), one)

    def settle(self, every: tuple[float, int], one: dict[str, tuple[float, int]]) -> None:
        """Thresholds of all and of each language, of their own best ones and numbers of toxic documents."""
        self.threshold = drawn(*every, 0.5)
        for lang, own in one.items():
            self.thresholds[lang] = drawn(*own, self.threshold)


def drawn(own: float, n: int, to: float) -> float:
    """A threshold on n toxic documents, drawn to another one."""
    a, b = (np.log(x / (1 - x)) for x in np.clip([own, to], 1e-6, 1 - 1e-6))
    return float(1 / (1 + np.exp(-(n * a + DRAWN * b) / (n + DRAWN))))


def log_odds(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """Of each embedding row how much likelier it is in a toxic document, drawn to 0 where few documents have it.

    clean, toxic: the documents of each class that have the row, of n_clean and n_toxic.
    """
    both = clean + toxic
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return np.where(both > 0, odds * both / (both + SHRINK), 0)


def best_threshold(scores: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    if not toxic.any():
        return 1.1  # nothing is known to be toxic
    order = np.argsort(-scores, kind="stable")
    s, t, w = scores[order], toxic[order], weight[order]
    hit, all_ = np.cumsum(w * t), np.cumsum(w)
    f1 = 2 * hit / (all_ + (w * t).sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # equal scores aren't parted
    k = int(f1.argmax())
    below = s[k + 1] if k + 1 < len(s) else 0.0
    return float((s[k] + below) / 2)


def fold_of(text: str) -> int:
    """Equal texts are of one fold, whatever process asks."""
    return zlib.crc32(text.encode()) % FOLDS


def numbered(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of ``words``, and each row's number among them."""
    w = words.astype(np.int64)
    key = np.zeros(len(w), np.int64)
    for i in range(0, w.shape[1], 2):
        key = np.unique(key << 2 * HASH_BITS | w[:, i] << HASH_BITS | w[:, i + 1], return_inverse=True)[1]
    _, first, codes = np.unique(key, return_index=True, return_inverse=True)
    return words[first], codes.astype(np.uint16 if len(first) <= 1 << 16 else np.uint32)


CHUNKS = "part long, bucket long, chunk int, n_words long, vocabulary binary, codes binary, sizes binary, toxic binary, fold binary, lang array<string>"


def chunk_of(part: int, bucket: int, chunk: int, rows: list[dict]) -> pa.RecordBatch:
    texts = [r["text"] for r in rows]
    words, row = features(*utf8(pa.array(texts, pa.large_string())))
    vocabulary, codes = numbered(words)
    sizes = np.bincount(row, minlength=len(rows)).astype(np.int64)
    columns = [[part], [bucket], [chunk], [len(words)], *([x.tobytes()] for x in (vocabulary, codes, sizes)), [bytes(r["toxic"] for r in rows)], [bytes(map(fold_of, texts))], [[r["lang"] for r in rows]]]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 5, pa.list_(pa.string())]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in CHUNKS.split(", ")])


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of the labelled documents. Rows come by bucket and in order, an id's label, which has no text, before its
    texts; one that is repeated counts once.
    """
    rows: list[dict] = []
    label: dict | None = None
    last: dict | None = None
    size = chunk = 0
    for batch in batches:
        for i in range(0, batch.num_rows, 100):
            for r in batch.slice(i, 100).to_pylist():
                if r["text"] is None:
                    label = r
                    continue
                if not label or r["doc_id"] != label["doc_id"] or r == last:
                    continue
                if rows and (r["bucket"] != last["bucket"] or size >= CHUNK):
                    yield chunk_of(last["part"], last["bucket"], chunk, rows)
                    chunk = chunk + 1 if r["bucket"] == last["bucket"] else 0
                    rows, size = [], 0
                rows.append({"text": r["text"], "lang": r["lang"], "toxic": label["toxic"]})
                last = r
                size += len(r["text"].encode())
    if rows:
        yield chunk_of(last["part"], last["bucket"], chunk, rows)


@dataclass
class Documents:
    """Labelled documents as numbers of words in a vocabulary."""

    vocabulary: np.ndarray
    codes: np.ndarray
    bounds: np.ndarray
    toxic: np.ndarray
    fold: np.ndarray
    lang: list[str]

    @classmethod
    def of(cls, chunks: list[dict]) -> Documents:
        wide = 1 + len(BEGINNINGS)
        words = np.empty((sum(len(c["vocabulary"]) for c in chunks) // (4 * wide), wide), np.int32)
        codes, sizes = np.empty(sum(c["n_words"] for c in chunks), np.uint32), [np.zeros(1, np.int64)]
        n = at = 0
        for c in chunks:  # whose bytes go as they are taken
            own, count = np.frombuffer(c.pop("vocabulary"), np.int32).reshape(-1, wide), c["n_words"]
            words[n : n + len(own)] = own
            raw = c.pop("codes")
            codes[at : at + count] = np.frombuffer(raw, np.uint32 if len(raw) == 4 * count else np.uint16)
            codes[at : at + count] += np.uint32(n)
            sizes.append(np.frombuffer(c["sizes"], np.int64))
            n, at = n + len(own), at + count
        flat = lambda name: np.frombuffer(b"".join(c[name] for c in chunks), np.uint8)
        return cls(words, codes, np.cumsum(np.concatenate(sizes)), flat("toxic").astype(bool), flat("fold"), [x for c in chunks for x in c["lang"]])

    @classmethod
    def read(cls, folder: str, part: int) -> Documents:
        """Those of a part of the table."""
        system, at = opened(below(folder, f"part={part}"))
        found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
        rows = [r for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".parquet") for r in pq.ParquetFile(system.open_input_file(f.path)).read().to_pylist()]
        return cls.of(sorted(rows, key=lambda r: (r["bucket"], r["chunk"])))

    def words(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embedding rows of the words of some documents, and each word's place among these."""
        b = self.bounds
        codes = np.concatenate([self.codes[b[k] : b[k + 1]] for k in some.tolist()])
        return self.vocabulary.take(codes, axis=0), np.repeat(np.arange(len(some)), b[some + 1] - b[some])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that have an embedding row, by fold and class; those that have any word are row -1."""
    counts, n = np.zeros((2 * FOLDS, 1 << HASH_BITS), np.int64), np.zeros(2 * FOLDS, np.int64)
    for batch in batches:
        for chunk in batch.to_pylist():
            docs = Documents.of([chunk])
            kind = 2 * docs.fold.astype(int) + docs.toxic
            for k in np.flatnonzero(np.diff(docs.bounds)).tolist():
                counts[kind[k], docs.words(np.array([k]))[0].ravel()] += 1  # an index that repeats adds 1 once
                n[kind[k]] += 1
    ids = np.flatnonzero(counts.any(0))
    yield pa.record_batch([pa.array(np.append(-1, ids)), *(pa.array(np.append(m, c[ids])) for m, c in zip(n, counts, strict=True))], ["id", *(f"n{i}" for i in range(2 * FOLDS))])


@dataclass
class Counts:
    """What ``counted`` counts, in all; a model of fold k, or FOLDS, is of all documents but those of that fold."""

    having: np.ndarray  # kinds x rows
    n: np.ndarray

    @classmethod
    def of(cls, chunks: DataFrame) -> Counts:
        names = [f"n{i}" for i in range(2 * FOLDS)]
        rows = chunks.mapInArrow(counted, "id long, " + ", ".join(f"{n} long" for n in names))
        got = rows.groupBy("id").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
        ids, values = got["id"].to_numpy(), np.stack([got[n].to_numpy() for n in names])
        having = np.zeros((2 * FOLDS, 1 << HASH_BITS), np.int64)
        having[:, ids[ids >= 0]] = values[:, ids >= 0]
        return cls(having, values[:, ids < 0].sum(1))

    def classes(self, k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Clean and toxic documents that have each row, and all of them."""
        kinds = [2 * f for f in range(FOLDS) if f != k]
        c, t = kinds, [i + 1 for i in kinds]
        return self.having[c].sum(0), self.having[t].sum(0), int(self.n[c].sum()), int(self.n[t].sum())


def started(counts: Counts, k: int, seed: int = 1) -> Model:
    """A model before its training; without documents of both classes, the one that says so of every text."""
    rng = np.random.default_rng(seed)
    model = Model(
        rng.normal(0, 0.05, (1 << HASH_BITS, WIDTH)).astype(np.float32),
        [rng.normal(0, 0.5, (w, WIDTH, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(len(WIDTHS) * FILTERS, np.float32),
        rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32),
    )
    clean, toxic, n_clean, n_toxic = counts.classes(k)
    if not n_clean or not n_toxic:
        model.weights[:] = 0
        model.offset = 30.0 if n_toxic else -30.0
        return model
    model.embedding[:, 0] = START * log_odds(clean, toxic, n_clean, n_toxic)
    for i, f in enumerate(model.filters):
        f[:, :, 0] = 0
        f[:, 0, 0] = 1 / len(f)
        model.weights[i * FILTERS] = FIRST
    return model


def epoch_of(model: Model, state: dict, docs: Documents, train: np.ndarray, weight: tuple[float, float], epoch: int, seed: list[int]) -> None:
    """An epoch over some documents that have words, and its share of the further steps."""
    rng = np.random.default_rng(seed)
    steps = -(-MORE_STEPS // EPOCHS) + -(-len(train) // BATCH)
    queue = np.zeros(0, np.int64)
    for step in range(steps):
        while len(queue) < min(BATCH, len(train)):
            queue = np.concatenate([queue, rng.permutation(train)])
        some, queue = queue[:BATCH], queue[BATCH:]
        rate = RATE * 2 / (1 + epoch + step / steps)
        toxic = docs.toxic[some]
        model.step(*docs.words(some), toxic, np.where(toxic, weight[1], weight[0]), state, rate)


def written(path: str, *parts: bytes | np.ndarray) -> None:
    """A file that is there as a whole or not at all, of however many attempts."""
    system, at = opened(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    draft = f"{at}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        for p in parts:
            out.write(p if isinstance(p, bytes) else np.ascontiguousarray(p).tobytes())
    system.move(draft, at)


def block_of(path: str, b: int, n: int) -> np.ndarray:
    """Of the n-th of a file's tables of the embedding's size block b."""
    system, at = opened(path)
    size = (1 << HASH_BITS) // BLOCKS * WIDTH * 4
    with system.open_input_file(at) as f:
        return np.frombuffer(f.read_at(size, (n * BLOCKS + b) * size), np.float32).reshape(-1, WIDTH)


def rest_of(path: str, tables: int = 2) -> dict:
    """What a file has beside its tables."""
    system, at = opened(path)
    with system.open_input_file(at) as f:
        f.seek(tables * 4 * WIDTH << HASH_BITS)
        return pickle.loads(f.read())


DENSE = ("filters", "bias", "weights", "offset")


def saved(path: str, model: Model, state: dict) -> None:
    rest = {"state": {k: v for k, v in state.items() if k != "embedding"}, **{n: getattr(model, n) for n in DENSE}}
    written(path, model.embedding, state["embedding"] if "embedding" in state else np.full(model.embedding.shape, SQUARES), pickle.dumps(rest))


def loaded(folder: str, counts: Counts, k: int, epoch: int) -> tuple[Model, dict]:
    """Model k and its state as the parts' epoch before ended."""
    model = started(counts, k)
    if not epoch or not all(counts.classes(k)[2:]):
        return model, {}
    rows = (1 << HASH_BITS) // BLOCKS
    squares = np.empty_like(model.embedding)
    for b in range(BLOCKS):
        system, at = opened(below(folder, f"merged-{epoch - 1}", f"{k}-{b}"))
        with system.open_input_file(at) as f:
            both = np.frombuffer(f.read(), np.float32).reshape(2, rows, WIDTH)
        model.embedding[b * rows : (b + 1) * rows], squares[b * rows : (b + 1) * rows] = both
    rest = rest_of(below(folder, f"merged-{epoch - 1}", f"{k}-rest"), 0)
    for n in DENSE:
        setattr(model, n, rest[n])
    return model, {"embedding": squares, **rest["state"]}


def mean(values: list) -> np.ndarray | float | list | dict:
    """Of the parts' values, which may be nested, in their order."""
    if isinstance(values[0], dict):
        return {k: mean([v[k] for v in values]) for k in values[0]}
    if isinstance(values[0], list):
        return [mean(list(v)) for v in zip(*values, strict=True)]
    total = values[0]
    for v in values[1:]:
        total = total + v
    return total / len(values)


def merged(folder: str, k: int, parts: list[int], epoch: int, b: int) -> None:
    """Block b of the mean of the parts' models, or with BLOCKS what lies beside the embedding."""
    paths = [below(folder, f"epoch-{epoch}", f"{k}-{p}") for p in parts]
    if b == BLOCKS:
        written(below(folder, f"merged-{epoch}", f"{k}-rest"), pickle.dumps(mean([rest_of(p) for p in paths])))
        return
    before = np.full(((1 << HASH_BITS) // BLOCKS, WIDTH), SQUARES)
    if epoch:
        system, at = opened(below(folder, f"merged-{epoch - 1}", f"{k}-{b}"))
        with system.open_input_file(at) as f:
            before = np.frombuffer(f.read(), np.float32).reshape(2, -1, WIDTH)[1]
    n = np.zeros((len(before), 1), np.int64)
    sums = np.zeros((2, *before.shape))
    for p in paths:
        both = [block_of(p, b, i) for i in (0, 1)]
        moved = (both[1] != before).any(1)
        n[moved] += 1
        sums[:, moved] += np.stack(both)[:, moved]
    still = np.stack([both[0], before])  # whatever part: none has moved it
    written(below(folder, f"merged-{epoch}", f"{k}-{b}"), np.where(n > 0, sums / np.maximum(n, 1), still).astype(np.float32))


def tasks(spark: SparkSession, jobs: list[tuple], run: Callable[..., Iterator[dict]], schema: str) -> DataFrame:
    """What ``run`` gives for each job, which is a task of its own."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                for columns in run(*jobs[i]):
                    yield pa.record_batch([pa.array(v) for v in columns.values()], list(columns))

    return spark.range(0, len(jobs), 1, max(1, len(jobs))).mapInArrow(each, schema)


def finished(folder: str, counts: Counts, k: int) -> Model:
    """Model k after all epochs."""
    model, state = loaded(folder, counts, k, EPOCHS)
    if state:
        model.embedding[(state["embedding"] == SQUARES).all(1)] = 0  # what no training word moved is noise
    return model


def cross_scored(model: Model, docs: Documents, some: np.ndarray) -> np.ndarray:
    """Scores of some documents as the operator gives them; 0 without words."""
    s = np.zeros(len(some))
    sizes = docs.bounds[some + 1] - docs.bounds[some]
    full = np.flatnonzero(sizes)
    batch = np.cumsum(sizes[full]) >> 16
    for i in np.split(full, np.flatnonzero(np.diff(batch)) + 1) if len(full) else []:
        s[i] = model.scores(*docs.words(some[i]), len(i))
    return np.round(s, 6)


def thresholds(scores: DataFrame) -> tuple[tuple[float, int], dict[str, tuple[float, int]]]:
    """Best threshold and toxic documents of all and of each language; a task has a language's different scores, of 6 digits."""
    each = scores.select(F.explode(F.array("lang", F.lit(None).cast("string"))).alias("lang"), "score", "toxic")
    bins = each.groupBy("lang", "score").agg(F.sum(F.col("toxic").cast("long")).alias("t"), F.sum((~F.col("toxic")).cast("long")).alias("c"))

    def best(table: pa.Table) -> pa.Table:
        s, t, c = (table[n].to_numpy() for n in ("score", "t", "c"))
        x = best_threshold(np.append(s[t > 0], s[c > 0]), np.repeat([True, False], [(t > 0).sum(), (c > 0).sum()]), np.append(t[t > 0], c[c > 0]))
        return pa.table({"lang": table["lang"][:1], "own": [x], "n": [int(t.sum())]})

    rows = bins.groupBy("lang").applyInArrow(best, "lang string, own double, n long").collect()
    found = {r.lang: (r.own, r.n) for r in rows}
    return found.pop(None), found


def labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """Chunks of all labelled documents, and how many parts they are of. Of other texts few are shuffled."""
    rows = pick(docs, "doc_id", "text", "lang").where("text IS NOT NULL")
    marked = pick(labels, "doc_id", "toxic").select(F.col("doc_id").try_cast(type_of(rows, "doc_id")).alias("doc_id"), "toxic")
    marked = marked.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    h = F.xxhash64("doc_id")
    place = F.pmod(h, F.lit(1 << ID_BITS))
    bit = F.expr("shiftleft(1L, CAST(place % 64 AS INT))")
    bits = marked.select(place.alias("place")).groupBy(F.expr("place DIV 64").alias("number")).agg(F.bit_or(bit).alias("bits"))
    some = rows.withColumn("place", place).withColumn("number", F.expr("place DIV 64")).join(F.broadcast(bits), "number").where(F.col("bits").bitwiseAND(bit) != 0)
    some = some.select("doc_id", "text", "lang")
    size = some.select("doc_id", F.octet_length("text").alias("size")).join(marked.select("doc_id"), "doc_id").agg(F.sum("size")).first()[0] or 0
    parts, buckets = 1 + size // PART_BYTES, 1 + marked.count() // BUCKET
    every = some.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang"), F.lit(0).alias("toxic"))
    every = every.unionByName(marked.select("doc_id", F.lit(None).cast("string").alias("text"), F.lit("").alias("lang"), "toxic"))
    every = every.withColumn("h", h).withColumn("bucket", F.pmod("h", F.lit(buckets))).withColumn("part", F.pmod("bucket", F.lit(parts)))
    made = every.repartition(parts * MAKERS, F.pmod("bucket", F.lit(parts * MAKERS)))
    return made.sortWithinPartitions("part", "bucket", "h", "doc_id", F.asc_nulls_first("text"), "lang").drop("h").mapInArrow(chunked, CHUNKS), parts


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of all labelled documents; every text of an id is one of its own, in an order that no partition has a say in."""
    spark = docs.sparkSession
    table, folder = own_folder(spark, "labelled"), own_folder(spark, "models")
    chunks, parts = labelled(docs, labels)
    chunks.write.partitionBy("part").option("compression", "zstd").parquet(table)
    counts = Counts.of(spark.read.schema(CHUNKS).parquet(table))
    if not all(counts.classes(FOLDS)[2:]):
        model = started(counts, FOLDS)
        model.threshold = 1.1  # nothing is known to be toxic, or everything
        return model
    shared = spark.sparkContext.broadcast(counts)
    both = [k for k in range(FOLDS + 1) if all(counts.classes(k)[2:])]

    def trained(k: int, part: int, epoch: int) -> Iterator[dict]:
        here = Documents.read(table, part)
        some = np.flatnonzero((here.fold != k) & (np.diff(here.bounds) > 0))
        if len(some):
            *_, n_clean, n_toxic = shared.value.classes(k)
            model, state = loaded(folder, shared.value, k, epoch)
            n = n_clean + n_toxic
            epoch_of(model, state, here, some, (n / (2 * n_clean), n / (2 * n_toxic)), epoch, [1, part, epoch])
            saved(below(folder, f"epoch-{epoch}", f"{k}-{part}"), model, state)
            yield {"k": [k], "part": [part]}

    def joined(k: int, of: list[int], epoch: int, b: int) -> Iterator[dict]:
        merged(folder, k, of, epoch, b)
        yield {"k": [k]}

    def scored(k: int, part: int) -> Iterator[dict]:
        here = Documents.read(table, part)
        some = np.flatnonzero(here.fold == k)
        if len(some):
            s = cross_scored(finished(folder, shared.value, k), here, some)
            yield {"lang": [here.lang[i] for i in some.tolist()], "score": s, "toxic": here.toxic[some]}

    for epoch in range(EPOCHS):
        done = tasks(spark, [(k, p, epoch) for p in range(parts) for k in both], trained, "k long, part long").collect()
        of = {k: sorted(r.part for r in done if r.k == k) for k in both}
        tasks(spark, [(k, of[k], epoch, b) for k in both for b in range(BLOCKS + 1)], joined, "k long").collect()
        remove(below(folder, f"epoch-{epoch}"))
        if epoch:
            remove(below(folder, f"merged-{epoch - 1}"))
    model = finished(folder, counts, FOLDS)
    model.settle(*thresholds(tasks(spark, [(k, p) for p in range(parts) for k in range(FOLDS)], scored, "lang string, score double, toxic boolean")))
    shared.unpersist()
    for made in (folder, table):
        remove(made)
    return model


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang, score, toxic`` of each row, from its whole text; null and empty texts score 0 and aren't toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = pick(docs, "doc_id", "lang", "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, data, at in slices(batch, "text", 1 << 19):
                words, row = features(data, at)
                present = np.unique(row)
                s = np.zeros(part.num_rows)
                if len(present):
                    s[present] = m.scores(words, np.searchsorted(present, row), len(present))
                least = np.array([m.thresholds.get(x, m.threshold) for x in part.column(1).to_pylist()])
                yield pa.record_batch([part.column(0), part.column(1), pa.array(np.round(s, 6)), pa.array((s >= least) & (s > 0))], ["doc_id", "lang", "score", "toxic"])

    return rows.mapInArrow(score, f"doc_id {type_of(rows, 'doc_id')}, lang string, score double, toxic boolean")


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, lang, score, toxic``: the documents scored as toxic, by a model trained on all labelled ones.

    Scoring is one pass over whole texts without a shuffle; the model has one size, whatever the corpus. Labels without id
    or value are ignored; of contradicting ones toxic holds. Without labelled texts of both classes that have words nothing
    is toxic. Repeated rows, null ids and languages are kept, a null language taking the threshold of all; other columns
    are ignored; an empty table gives no rows.
    """
    return score_texts(docs, train(docs, labels)).where("toxic")
