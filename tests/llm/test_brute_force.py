"""Operators against brute force on the small tables."""

import html as entities
import itertools
import math
import pickle
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from oracle import difference
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomsift.llm import arrays, bpe, html_extract, licenses, mixing, near_dedup, queries, suffix_dedup, token_count, toxicity
from loomsift.llm.arrays import Prefix, code_points, pretokens, utf8
from loomsift.llm.exact_dedup import CuckooIndex, exact_duplicates
from loomsift.llm.html_extract import content
from loomsift.llm.quality import clean_lines


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_agrees_with_sql(spark, sf, name):
    assert difference(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], sf) == ""


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_has_rows(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


# text primitives


def test_pretokens_are_the_patterns(texts):
    import regex

    pattern = regex.compile(bpe.PATTERN)
    odd = ["don't we'll  x\n\n y ", "'s's 'quoted' ''re", "a1b2   z", "漢字🙂 é'll", "", " ", "\n", "x'", "'"]
    some = [*odd, *texts.values()]
    data, at = utf8(pa.array(some, pa.large_string()))
    starts, ends = pretokens(data, at)
    raw = data.tobytes()
    assert [raw[s:e].decode() for s, e in zip(starts, ends)] == [m for t in some for m in pattern.findall(t)]


def test_code_points(texts):
    text = "aé漢🙂" + "".join(texts.values())[:5000]
    where, cp = code_points(np.frombuffer(text.encode(), np.uint8))
    assert "".join(map(chr, cp)) == text and where[1] == 1


def test_prefix_hashes_tell_strings_apart():
    rng = random.Random(1)
    data = bytes(rng.choice(b"ab") for _ in range(400))
    p = Prefix(np.frombuffer(data, np.uint8))
    pairs = [(i, j) for i in range(0, 390, 7) for j in range(i + 1, min(400, i + 40))]
    h = p.of(*np.array(pairs).T)
    seen = {}
    for (i, j), x in zip(pairs, h.tolist()):
        assert seen.setdefault(x, data[i:j]) == data[i:j]


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_folding_strings_have_hashes_of_their_own():
    """Modulo 2**64 these collide for every base."""
    both = [thue_morse(1 << k, *ab) for k in (10, 11, 12) for ab in ("et", "te")]
    data, at = utf8(pa.array(both, pa.large_string()))
    assert len(set(Prefix(data).of(at[:-1], at[1:]).tolist())) == 6
    assert len(set(Prefix(Prefix(data).of(np.arange(len(data)), np.arange(1, len(data) + 1))).of(at[:-1], at[1:]).tolist())) == 6


def test_prefix_hashes_by_definition():
    rng = np.random.default_rng(3)
    for values, one in ((rng.integers(0, 256, 300).astype(np.uint8), 1), (rng.integers(0, 1 << 64, 300, dtype=np.uint64), 0)):
        for i, j in ((0, 300), (7, 7), (250, 299)):
            want = sum((int(v) + one) % arrays.PRIME * pow(arrays._BASE, k, arrays.PRIME) for k, v in enumerate(values[i:j])) % arrays.PRIME
            assert int(Prefix(values).raw(np.array([i]), np.array([j]))[0]) == want


# token counts and BPE


def naive_count(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
        if not found:
            return len(parts)
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.fixture(scope="module")
def vocabulary():
    with open(token_count.VOCABULARY, "rb") as f:
        return f.read()


def test_merging(vocabulary):
    ranks = token_count.read_ranks(vocabulary)
    rng = random.Random(2)
    pieces = [bytes(rng.choice(b"aehilnorst ") for _ in range(rng.randint(1, 40))) for _ in range(300)] + [b"a" * 101, b" " * 77, bytes(range(256))]
    assert [token_count.merged_count(p, ranks) for p in pieces] == [naive_count(p, ranks) for p in pieces]


def test_counts_and_tokens_are_the_vocabularys(docs, texts, vocabulary):
    plain = bpe.Codec(vocabulary).plain
    want = {i: plain.encode_ordinary(t) for i, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in token_count.token_counts(docs).collect()} == {i: len(t) for i, t in want.items()}
    assert {r.doc_id: list(r.tokens) for r in bpe.bpe_encode(docs).collect()} == want


def test_counts_of_words_whose_hashes_collide(vocabulary, monkeypatch):
    words = [thue_morse(1024, "e", "t"), thue_morse(1024, "t", "e"), "some words and some words"]
    data, at = utf8(pa.array(words, pa.large_string()))
    want = [sum(naive_count(w.encode(), token_count.read_ranks(vocabulary)) for w in t.replace(" ", "\0 ").split("\0")) for t in words]
    assert token_count.Counter(vocabulary).rows(data, at).tolist() == want and want[0] != want[1]
    monkeypatch.setattr(token_count, "quick_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    assert token_count.Counter(vocabulary).rows(data, at).tolist() == want


def test_counter_forgets_and_counts_on(vocabulary, monkeypatch, texts):
    monkeypatch.setattr(token_count, "KNOWN", 5000)
    some = [*texts.values()][:40]
    data, at = utf8(pa.array(some, pa.large_string()))
    plain = bpe.Codec(vocabulary).plain
    assert token_count.Counter(vocabulary).rows(data, at).tolist() == [len(plain.encode_ordinary(t)) for t in some]


def test_any_cut_gives_the_same_tokens(vocabulary):
    rng = random.Random(13)
    parts = ["a", "b", "'s", "'re", "'", "ll", " ", "  ", "\n", "漢", "字", "，", "é", "1", "22", ".", "!!", "'v", "e", " ", "🙂", "t"]
    c = bpe.Codec(vocabulary)
    for _ in range(600):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        raw = text.encode()
        ends = sorted({k for k in (rng.randint(1, len(raw) + 1) for _ in range(rng.randint(0, 6))) if k < len(raw) and raw[k] & 0xC0 != 0x80} | ({len(raw)} if raw else set()))
        assert np.concatenate(c.text(raw, 0, ends) or [np.zeros(0, np.uint32)]).tolist() == c.plain.encode_ordinary(text)


@pytest.mark.parametrize("signs", [range(0x61, 0x7B), range(0x4E00, 0x9000), range(0x430, 0x450)])
def test_copies_are_encoded_once_in_every_script(vocabulary, signs):
    rng = random.Random(14)
    text = "".join("".join(chr(rng.choice(signs)) for _ in range(rng.randint(2, 9))) + rng.choice(("，", " ", ", ")) for _ in range(4000))
    c, sent = bpe.Codec(vocabulary), []
    plain = c.ids
    c.ids = lambda raw: sent.append(len(raw)) or plain(raw)
    data, at = utf8(pa.array([f"{k} {text}" for k in range(10)], pa.large_string()))
    tokens, begin = c.rows(data, at)
    assert tokens[begin[7] : begin[8]].tolist() == c.plain.encode_ordinary(f"7 {text}")
    assert sum(sent) < 0.2 * len(data)


def test_a_wider_window_takes_the_place_of_one_that_disagrees(vocabulary, monkeypatch):
    """With every token's border taken for a safe one the window grows until it agrees."""
    c = bpe.Codec(vocabulary)
    monkeypatch.setattr(bpe, "safe_borders", lambda b: np.cumsum(c.size[c.ids(b.tobytes())])[:-1])
    text = " an encyclopaedia of unbelievable misunderstandings"
    for cut in range(5, len(text) - 5):
        found = np.concatenate(c.text(text.encode(), 0, [cut, len(text)])).tolist()
        assert c.plain.decode(found) == text
        if cut in (39, 40, 42):  # within the last word
            assert found == c.plain.encode_ordinary(text)


def test_chunks_are_reused_and_joints_repaired(vocabulary):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 12)))
    passage = " ".join(word() for _ in range(9000))
    some = [f"{word()} {passage} {word()}", passage, "x" * 30_000, word() * 5000, "".join(rng.choice("ab \n.'") for _ in range(20_000)), "漢字" * 9000]
    c = bpe.Codec(vocabulary)
    data, at = utf8(pa.array(some, pa.large_string()))
    tokens, begin = c.rows(data, at)
    for i, t in enumerate(some):
        assert tokens[begin[i] : begin[i + 1]].tolist() == c.plain.encode_ordinary(t)
    assert c.reused > 20 and c.repaired > 0


# exact dedup


def test_cuckoo_index_is_a_counter():
    rng = random.Random(5)
    index, truth = CuckooIndex(4), Counter()
    keys = [rng.getrandbits(128) for _ in range(3000)]
    keys += [k ^ 1 << 70 for k in keys[:200]]  # of one bucket and fingerprint
    for _ in range(20_000):
        k = rng.choice(keys)
        if rng.random() < 0.6:
            truth[k] += 1
            assert index.insert(k) == truth[k]
        else:
            assert index.delete(k) == (truth[k] > 0)
            truth[k] = max(0, truth[k] - 1)
    assert all(index.count(k) == truth[k] for k in keys) and set(index.repeated()) == {k for k in keys if truth[k] > 1}
    assert index.buckets > 4 and index.size == sum(n > 0 for n in truth.values())


def test_deleted_documents_have_no_duplicates(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "y"), (5, "y")], "doc_id long, text string")
    gone = spark.createDataFrame([(1,), (4,)], "doc_id long")
    assert {(r.doc_id, r.duplicate_of) for r in exact_duplicates(docs, gone).collect()} == {(3, 2)}


# near dedup


def test_near_recall_and_precision(docs, texts):
    sets = {i: near_dedup._weighted(t) for i, t in texts.items()}
    of = defaultdict(set)
    for i, (h, _) in sets.items():
        for x in h.tolist():
            of[x].add(i)
    pairs = {p for group in of.values() for p in itertools.combinations(sorted(group), 2)}
    alike = {p for p in pairs if near_dedup.similarity(sets[p[0]], sets[p[1]]) >= near_dedup.THRESHOLD}
    group = {r.doc_id: r.group_id for r in near_dedup.near_duplicates(docs).collect()}
    first = lambda i: group.get(i, i)
    assert np.mean([first(a) == first(b) for a, b in alike]) >= 0.9
    root = {i: i for i in texts}
    for a, b in sorted(alike) + [(a, b) for a, b in itertools.combinations(sorted(texts), 2) if texts[a] == texts[b]]:
        x, y = root[a], root[b]
        if x != y:
            root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    assert all(root[i] == root[g] for i, g in group.items())


def test_near_copies_in_a_crowd(spark):
    """Thousands of texts share a passage that makes them 0.47 alike; each has one copy at 0.519."""
    words = lambda name, n: " ".join(f"{name}x{k}" for k in range(n))
    rows = [(2 * i + k, f"{words('p', 194)} {words(f'a{i}', 13)} {words(f'b{i}k{k}', 95)}") for i in range(1500) for k in (0, 1)]
    sets = [near_dedup._weighted(t) for _, t in rows]
    assert near_dedup.similarity(sets[0], sets[2]) == pytest.approx(192 / 408)
    assert near_dedup.similarity(sets[0], sets[1]) == pytest.approx(205 / 395)
    sizes = [len(h) for h, _ in sets]
    h, w = (np.concatenate([x[k] for x in sets]) for k in (0, 1))
    keys = near_dedup.bands(near_dedup.signatures(np.repeat(np.arange(len(rows)), sizes), h, w, len(rows)))
    candidates = {2 * i + 1: 2 * i for i in range(1500) if (keys[2 * i] == keys[2 * i + 1]).any()}
    assert len(candidates) >= 0.99 * 1500
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.group_id for r in got} == candidates


@pytest.mark.parametrize("dense", [1, 16, 1 << 30])
def test_bounds_of_blocks(monkeypatch, dense):
    monkeypatch.setattr(near_dedup, "DENSE_PAIRS", dense)
    rng = np.random.default_rng(4)
    for most in (1, 5):
        sides = [[(h := np.unique(rng.integers(0, 40, 30).astype(np.uint64)), rng.integers(1, most + 1, len(h))) for _ in range(n)] for n in (7, 9)]
        flat = [(np.repeat(np.arange(len(s)), [len(h) for h, _ in s]), *(np.concatenate([x[k] for x in s]) for k in (0, 1))) for s in sides]
        got = near_dedup.bounds(*flat, 7, 9)
        want = np.array([[near_dedup.similarity(x, y) for y in sides[1]] for x in sides[0]])
        assert (got >= want - 1e-12).all()
        if most == 1:
            assert got == pytest.approx(want)


def test_blocks_of_a_band_meet(spark, monkeypatch):
    """Bands cut into many small blocks give the groups of all pairs that share a band."""
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", 7)
    words = lambda name, n: " ".join(f"{name}x{k}" for k in range(n))
    rows = [(2 * i + k, f"{words('p', 194)} {words(f'a{i}', 13)} {words(f'b{i}k{k}', 95)}") for i in range(40) for k in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    small = {(r.doc_id, r.group_id) for r in near_dedup.near_duplicates(df).collect()}
    monkeypatch.undo()
    assert small == {(r.doc_id, r.group_id) for r in near_dedup.near_duplicates(df).collect()}
    assert len(small) >= 39


def test_similarity_by_definition():
    rng = random.Random(6)
    for _ in range(20):
        a, b = ({rng.randint(0, 30): rng.randint(1, 5) for _ in range(12)} for _ in range(2))
        want = sum(1 / sum(max(a.get(k, 0) / a[i], b.get(k, 0) / b[i]) for k in a.keys() | b.keys()) for i in a.keys() & b.keys())
        arrays = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
        assert near_dedup.similarity(*arrays) == pytest.approx(want)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(7)
    errors = []
    for share in (0.2, 0.5, 0.8):
        for _ in range(12):
            h = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
            w = rng.integers(1, 4, 200)
            k = int(200 * share)
            other = np.concatenate([h[:k], rng.integers(0, 1 << 63, 200 - k, dtype=np.uint64)])
            row = np.repeat([0, 1], 200)
            s = near_dedup.signatures(row, np.concatenate([h, other]), np.concatenate([w, w]), 2)
            o1, o2 = np.argsort(h), np.argsort(other)
            errors.append((s[0] == s[1]).mean() - near_dedup.similarity((h[o1], w[o1]), (other[o2], w[o2])))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)]
    got = {r.d: r.label for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if x != r}


# repeated passages


def brute_passages(texts, least):
    words = {i: re.split(r"[ \t\n\x0b\x0c\r]+", t.strip(" \t\n\x0b\x0c\r")) for i, t in texts.items() if t.strip(" \t\n\x0b\x0c\r")}
    where = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - least + 1):
            where[tuple(w[k : k + least])].add(i)
    out = set()
    for i, w in words.items():
        for first in (True, False):
            runs = [k for k in range(len(w) - least + 1) if len(s := where[tuple(w[k : k + least])]) > 1 and (min(s) == i) == first]
            start = end = None
            for k in [*runs, None]:
                if start is not None and (k is None or k > end):
                    out.add((i, start, end, first))
                    start = None
                if k is not None:
                    start = k if start is None else start
                    end = k + least
    return out


def found(df):
    return {(r.doc_id, r.start_word, r.end_word, r.is_first) for r in df.collect()}


def test_passages_of_the_table(docs, texts):
    assert found(suffix_dedup.repeated_passages(docs)) == brute_passages(texts, suffix_dedup.LEAST)


@pytest.mark.parametrize("crowd", [1, 3])
def test_frequent_grams_give_the_same_passages(docs, texts, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    assert found(suffix_dedup.repeated_passages(docs)) == brute_passages(texts, suffix_dedup.LEAST)


def test_a_passage_in_50_000_texts(spark):
    """Each of them has words of its own on both sides of it; no block of the sort grows with them."""
    passage = F.lit(" ".join(f"p{k}" for k in range(60)))
    own = lambda side: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.concat(F.lit(side), F.col("id").cast("string"), F.lit("x"), k.cast("string"))), " ")
    df = spark.range(0, 50_000, 1, 8).select(F.col("id").alias("doc_id"), F.concat_ws(" ", own("a"), passage, own("b")).alias("text"))
    got = suffix_dedup.repeated_passages(df)
    kinds = {(r.start_word, r.end_word, r.is_first): r["count"] for r in got.groupBy("start_word", "end_word", "is_first").count().collect()}
    assert kinds == {(30, 90, True): 1, (30, 90, False): 49_999}


def test_blocks_are_bounded():
    rng = random.Random(15)
    words = lambda n: b" ".join(b"w%d" % rng.randint(0, 99) for _ in range(n))
    grams = sorted([7] * suffix_dedup.CROWD + [rng.randint(0, 10**6) for _ in range(8000)])
    rows = pa.table({"gram": pa.array(grams, pa.int64()), "doc_id": pa.array(range(len(grams)), pa.int64()), "before": pa.array([0] * len(grams), pa.int32()), "low": pa.array([0] * len(grams), pa.int32()), "words": pa.array([words(92) for _ in grams], pa.binary())})
    blocks = list(suffix_dedup._blocks(iter(rows.to_batches(max_chunksize=3000))))
    assert [g for b in blocks for g in b.column(0).to_pylist()] == grams
    ends = [(b.column(0)[0].as_py(), b.column(0)[-1].as_py()) for b in blocks]
    assert all(a[1] != b[0] for a, b in itertools.pairwise(ends))
    assert max(b.num_rows for b in blocks) < suffix_dedup.CROWD + suffix_dedup.BLOCK_WORDS / 40


def test_passages_planted(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    line = lambda n: " ".join(word() for _ in range(n))
    p = [line(n) for n in (50, 51, 49, 120, 300)]
    texts = {i: " ".join(x for k in range(3) for x in (line(rng.randint(0, 40)), rng.choice(p)) if x) for i in range(30)}
    texts |= {100: "la " * 200, 101: "la " * 120, 102: "la " * 60 + line(30), 103: p[3].replace(" ", "\n  "), 104: texts[3], 105: " ".join(p[4].split()[::-1])}
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(4)
    assert found(suffix_dedup.repeated_passages(df)) == brute_passages(texts, suffix_dedup.LEAST)


def test_suffixes_are_sorted():
    rng = np.random.default_rng(10)
    words = rng.integers(0, 3, 300).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    starts = np.arange(300)
    limits = np.where(starts < 150, 150, 300)
    s = suffix_dedup.Suffixes(words, starts, limits)
    bucket = rng.integers(0, 3, 300)
    order = s.sort(bucket)
    keys = [(bucket[k], words[starts[k] : limits[k]].tolist()) for k in order]
    assert keys == sorted(keys)
    a, b = rng.integers(0, 300, (2, 500))
    want = [next((k for k in range(300) if starts[x] + k >= limits[x] or starts[y] + k >= limits[y] or words[x + k] != words[y + k]), 0) for x, y in zip(a, b)]
    assert s.extension(a, b).tolist() == want


# licences


@pytest.mark.parametrize(
    ("text", "names", "category"),
    [
        ("# SPDX-License-Identifier: MIT", ["MIT"], "permissive"),
        ("spdx-license-identifier:  MIT OR GPL-3.0-only */", ["GPL-3.0-only", "MIT"], "permissive"),
        ("SPDX-License-Identifier: MIT AND GPL-3.0-only", ["GPL-3.0-only", "MIT"], "strong_copyleft"),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", ["GPL-2.0-only"], "weak_copyleft"),
        ("SPDX-License-Identifier: (MIT OR Apache-2.0) AND (ISC OR GPL-2.0+)\nmore", ["Apache-2.0", "GPL-2.0-or-later", "ISC", "MIT"], "permissive"),
        ("SPDX-License-Identifier: Made-Up-1.0", ["Made-Up-1.0"], "unknown"),
        ("SPDX-License-Identifier: )(", [], "none"),
        ("Licensed under the Apache  License,\nVersion 2.0 (the thing)", ["Apache-2.0"], "permissive"),
        ("under the terms of CC BY-NC 4.0.", ["CC-BY-NC-4.0"], "restricted"),
        ("summit licenses", [], "none"),
        ("“MIT License”", ["MIT"], "permissive"),
        ("MIT License—see file", ["MIT"], "permissive"),
        ("MIT License…", ["MIT"], "permissive"),
        ("MIT License®", ["MIT"], "permissive"),
        ("éMIT License", [], "none"),
        ("GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or", ["GPL-3.0-or-later"], "strong_copyleft"),
        ("GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of", ["LGPL-2.1-or-later"], "weak_copyleft"),
        ("GNU Affero General Public License as published by the Free Software Foundation, version 3.", ["AGPL-3.0-only"], "strong_copyleft"),
        ("SPDX-License-Identifier: MIT OR (GPL-3.0-only", ["MIT"], "permissive"),
        ("SPDX-License-Identifier: MIT SPDX-License-Identifier: ISC", ["ISC", "MIT"], "permissive"),
    ],
)
def test_license_scan(text, names, category):
    got, _, worst = licenses.scan(text.encode(), licenses.automaton())
    assert got == names and ("none" if worst is None else licenses.CATEGORIES[worst]) == category


def test_shunting_yard_against_a_recursive_parser():
    rng = random.Random(11)
    names = ["MIT", "GPL-3.0-only", "MPL-2.0", "CC-BY-NC-4.0", "Odd-1"]

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            name = rng.choice(names)
            return name, licenses.CATEGORY.get(name.lower(), ("", licenses.UNKNOWN))[1]
        (a, x), (b, y) = make(depth - 1), make(depth - 1)
        op = rng.choice(["AND", "or"])
        return f"({a} {op} {b})", min(x, y) if op == "or" else max(x, y)

    for _ in range(200):
        text, category = make(4)
        assert licenses.evaluate(licenses.postfix(text)) == category
    for bad in ("", "MIT MIT", "AND MIT", "MIT OR", "(MIT", "MIT)", "()"):
        with pytest.raises(ValueError):
            licenses.postfix(bad)
    assert licenses.postfix("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]


def naive_expression(line):
    """The longest run of tokens from the left that parses, by trying all of them."""
    tokens, at = [], 0
    for m in re.finditer(r"[()]|[A-Za-z0-9][A-Za-z0-9.\-+:]*", line):
        if line[at : m.start()].strip() or m.group().lower().startswith(licenses.TAG):
            break
        tokens.append(m)
        at = m.end()
    for n in range(len(tokens), 0, -1):
        try:
            return licenses.postfix(line[tokens[0].start() : tokens[n - 1].end()])
        except ValueError:
            continue
    return []


def naive_names(text):
    folded = re.sub(r"[ \t\n\x0b\x0c\r]+", " ", text).translate({c: c + 32 for c in range(65, 91)})
    names = {name for phrase, name in licenses.NOTICES.items() if re.search(rf"(?<![^\W_]){re.escape(phrase)}(?![^\W_]|(?<=\d)\.\d)", folded)}
    for m in re.finditer(r"(?i)spdx-license-identifier:", text):
        rpn = naive_expression(re.split(r"[\r\n]", text[m.end() :])[0])
        names |= {licenses.CATEGORY.get(t.lower(), (t, 0))[0] for i, t in enumerate(rpn) if t.lower() not in ("or", "and", "with") and rpn[i + 1 : i + 2] != ["with"]}
    return names


def test_licenses_against_plain_search(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: set(r.licenses) for r in licenses.license_scan(rows).collect()}
    want = {r.doc_id: naive_names(r.text) for r in rows.collect()}
    assert got == want and sum(map(bool, want.values())) > 5
    machine, rng = licenses.automaton(), random.Random(16)
    parts = ["SPDX-License-Identifier: ", "MIT", "ISC", "Odd-1", " or ", " AND ", " with ", "(", ")", "\n", " ", "*/", "MIT License", "é", "CC0 1.0", ".", "GNU General Public License, version 2", "classpath-exception-2.0"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert set(licenses.scan(text.encode(), machine)[0]) == naive_names(text), text


@pytest.mark.parametrize("text", ["SPDX-License-Identifier: " + "word " * 20_000, "SPDX-License-Identifier: " + "MIT OR " * 20_000, "SPDX-License-Identifier: " * 20_000, "SPDX-License-Identifier: (" + "(" * 20_000, "SPDX-License-Identifier: MIT OR " * 20_000])
def test_long_tag_lines_take_no_time(text):
    began = time.perf_counter()
    licenses.scan(text.encode(), licenses.automaton())
    assert time.perf_counter() - began < 5


# quality, pages, mixing, toxicity


def test_quality_agrees_with_labels(spark, sf):
    d = "/root/testdata/sf0.01"
    kept = clean_lines(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id")
    marks = spark.read.parquet(f"{d}/labels.parquet")
    good, bad = marks.where("quality = 1"), marks.where("quality = 0")
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.01 * good.count()
    assert bad.join(kept, "doc_id", "left_semi").count() <= 0.1 * bad.count()


@pytest.mark.parametrize("line", ["la " * 9000 + "end.", " ".join(f"w{k % 61}" for k in range(18_300)) + ".", " ".join(f"w{k % 20}" for k in range(120)) + "."])
def test_long_lines_that_repeat_go(spark, line):
    fresh = " ".join(f"w{k}" for k in range(5000)) + "."
    rows = clean_lines(spark.createDataFrame([(1, line), (2, fresh)], "doc_id long, text string")).collect()
    assert [r.doc_id for r in rows] == [2]


def naive_content(page):
    """The method by its definition, for pages without odd markup: full paths, one node at a time."""
    hidden = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>", re.S | re.I)
    blocks, siblings, void = html_extract._BLOCK, html_extract._SIBLINGS, html_extract._VOID
    stack, nodes, block = [], [], 0
    for piece in re.findall(r"<[^<>]*>|[^<]+", hidden.sub("", page)):
        m = re.match(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)", piece)
        if not m:
            text = " ".join(entities.unescape(piece).split())
            if piece[0] != "<" and text and "head" not in stack:
                nodes.append(("/".join(stack), block, text))
            continue
        name = m.group(2).lower()
        if m.group(1):
            if name in stack:
                while stack.pop() != name:
                    pass
        else:
            if name in blocks and "p" in stack:
                while stack.pop() != "p":
                    pass
            if name in siblings and name in stack:
                k = max(i for i, x in enumerate(stack) if x == name)
                if not {"ul", "ol", "table", "dl"} & {*stack[k:]}:
                    del stack[k:]
            if name not in void and not piece.endswith("/>"):
                stack.append(name)
        block += name in blocks or name == "br"
    if not nodes:
        return "", 0, 0
    paths = defaultdict(list)
    for k, (path, _, _) in enumerate(nodes):
        paths[path].append(k)
    fused = [1.0] * len(nodes)
    for measure in (lambda t: len(t), lambda t: sum(c in ".,;:!?、。！？，；…" for c in t)):
        ratio = [0.0] * len(nodes)
        for own in paths.values():
            x = [measure(nodes[k][2]) for k in own]
            mean = sum(x) / len(x)
            for k in own:
                ratio[k] = mean * (1 + math.sqrt(max(0.0, sum(v * v for v in x) / len(x) - mean * mean)))
        side = math.exp(-0.5)
        for k in range(len(nodes)):
            fused[k] *= (side * ratio[max(0, k - 1)] + ratio[k] + side * ratio[min(len(nodes) - 1, k + 1)]) / (1 + 2 * side)
    score = {path: sum(fused[k] for k in own) / len(own) for path, own in paths.items()}
    mean = sum(score.values()) / len(score)
    least = math.sqrt(sum((x - mean) ** 2 for x in score.values()) / len(score))
    lines, last = [], None
    for path, block, text in nodes:
        if score[path] >= least * (1 - 1e-12):
            if block == last:
                lines[-1] += " " + text
            else:
                lines.append(text)
            last = block
    return "\n".join(lines), len(nodes), sum(score[p] >= least * (1 - 1e-12) for p, _, _ in nodes)


def test_pages_against_the_definition(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = {r.page_id: (r.text, r.n_nodes, r.n_content) for r in queries.QUERIES["op6_html"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: naive_content(h) for i, h in pages.items()}


@pytest.mark.parametrize("page", ["<a " * 330_000, '<a "' * 250_000, "<a '\"" * 200_000, "<b>x" * 100_000, "<!x " * 250_000, "<li>x<ul>" * 50_000, "<tr><table>" + "<b>" * 50_000 + "<tr></tr>" * 50_000, "<a x='>" * 100_000, "<script>" * 100_000])
def test_broken_pages_take_no_time(page):
    began = time.perf_counter()
    content(page)
    assert time.perf_counter() - began < 8


def test_a_tag_without_end_is_text():
    assert content("<p>one <b")[0] == "one <b" and content("<p>a < b and c > d</p>")[0] == "a < b and c > d" and content('<p>x <a href="y>z</p>')[0] == 'x <a href="y>z'


def test_main_text_of_a_page():
    prose = "The committee met on Tuesday, after lunch, and agreed on nothing; nobody was surprised. "
    page = "<html><head><title>no</title><style>p{}</style></head><body><ul>" + "<li><a href='x'>Link</a></li>" * 12 + "</ul><div id=main>" + f"<p>{prose * 3}</p>" * 5 + "</div><script>var x = 'no';</script><div class=f><a>About</a></div></body></html>"
    text, nodes, kept = content(page)
    assert text.count("committee") == 15 and "Link" not in text and "var x" not in text and "About" not in text and nodes > kept == 5


@pytest.mark.parametrize("body", ["<body>", ""])
def test_page_that_leaves_out_the_end_of_its_head(body):
    page = "<html><head><title>no</title>{}" + body + "<p>All of this is read.</p><p>And this.</p></html>"
    assert content(page.format("")) == content(page.format("</head>")) == ("All of this is read.\nAnd this.", 2, 2)


@pytest.fixture(scope="module")
def blocks(docs):
    return mixing.mix_sources(docs, block_tokens=64, shard_blocks=32).collect()


def test_blocks_hold_every_token_once(docs, blocks, texts):
    words = lambda t: len(re.findall(r"[^ \t\n\x0b\x0c\r]+", t))
    size = Counter()
    for r in docs.collect():
        size[r.source] += words(r.text)
    drawn = defaultdict(list)
    for r in blocks:
        drawn[r.shard, r.slot].append(r)
    assert all(len({(r.source, r.block) for r in rs}) == 1 for rs in drawn.values())
    full = Counter()
    for rs in drawn.values():
        rs.sort(key=lambda r: r.position)
        at = 0
        for r in rs:
            assert r.position == at and r.n_tokens == words(r.text)
            at += r.n_tokens
        source, block = rs[0].source, rs[0].block
        assert at == min(64, size[source] - 64 * block)
        full[source, block] += 1
    total = sum(-(-n // 64) for n in size.values())
    assert len(drawn) == total and set(drawn) == {(i // 32, i % 32) for i in range(total)}
    for source, n in size.items():
        turns = [full[source, b] for b in range(-(-n // 64))]
        assert max(turns) - min(turns) <= 1  # none is drawn twice before all are drawn once


def test_blocks_by_their_definition(docs):
    """Packing, draws and permutations again, row by row, from the order of the documents' hashes."""
    size, shard_blocks, seed = 48, 16, 9
    nulls = [F.isnull(c).cast("int") for c in ("doc_id", "lang")]
    keys = [F.xxhash64(*nulls, "doc_id", "lang", "source", "text").alias("k1"), F.xxhash64(F.lit(5), *nulls, "text", "source", "doc_id").alias("k2")]
    rows = docs.select("doc_id", "lang", "source", "text", *keys).collect()
    sources = defaultdict(list)
    for r in rows:
        sources[r.source].append(r)
    tokens, blocks = {}, {}
    for s, own in sources.items():
        runs = -(-sum(bool(r.text.split()) for r in own) // mixing.RUN_DOCS)
        own.sort(key=lambda r: (((r.k1 & (1 << 64) - 1) >> 8) % max(1, runs), r.k1, r.k2))
        tokens[s] = [(r.doc_id, w) for r in own for w in re.findall(r"[^ \t\n\x0b\x0c\r]+", r.text)]
        blocks[s] = -(-len(tokens[s]) // size)
    names = sorted(s for s in sources if tokens[s])
    share = np.array([len(tokens[s]) ** mixing.TEMPERATURE for s in names])
    share /= share.sum()
    total, turn, want = sum(blocks.values()), Counter(), {}
    for shard in range(-(-total // shard_blocks)):
        n = min(shard_blocks, total - shard * shard_blocks)
        places = np.random.default_rng([seed, shard, 1]).permutation(n)
        at = 0
        for s, count in zip(names, np.random.default_rng([seed, shard]).multinomial(n, share)):
            for _ in range(count):
                epoch, k = divmod(turn[s], blocks[s])
                turn[s] += 1
                block = int(mixing.permuted(np.array([k]), blocks[s], mixing._source_key(seed, s, epoch))[0])
                want[shard, int(places[at])] = (s, tokens[s][block * size : block * size + size])
                at += 1
    got = defaultdict(list)
    for r in mixing.mix_sources(docs, block_tokens=size, shard_blocks=shard_blocks, seed=seed).collect():
        got[r.shard, r.slot].append(r)
    found = {}
    for place, pieces in got.items():
        pieces.sort(key=lambda r: r.position)
        found[place] = (pieces[0].source, [(r.doc_id, w) for r in pieces for w in re.findall(r"[^ \t\n\x0b\x0c\r]+", r.text)])
    assert found == want


@pytest.mark.parametrize("run", [1, 3])
def test_shards_are_numbered_over_runs(docs, blocks, monkeypatch, run):
    monkeypatch.setattr(mixing, "RUN_SHARDS", run)
    assert Counter(mixing.mix_sources(docs, block_tokens=64, shard_blocks=32).collect()) == Counter(blocks)


def test_sources_follow_their_weights(docs):
    names = sorted({r.source for r in docs.select("source").distinct().collect()})[:3]
    weights = dict(zip(names, (0.6, 0.3, 0.1)))
    rows = mixing.mix_sources(docs, weights=weights, n_blocks=3000, block_tokens=16, shard_blocks=100).select("shard", "slot", "source").distinct().groupBy("source").count().collect()
    got = {r.source: r["count"] / 3000 for r in rows}
    assert all(abs(got[s] - w) < 0.03 for s, w in weights.items()) and set(got) == set(names)


def test_mixing_is_the_same_on_other_partitions(docs, blocks):
    again = mixing.mix_sources(docs.repartition(7), block_tokens=64, shard_blocks=32).collect()
    assert Counter(blocks) == Counter(again)


def test_permutation():
    for n in (1, 2, 3, 10, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5)) == list(range(n))
    assert mixing.permuted(np.arange(1000), 1000, 5).tolist() != mixing.permuted(np.arange(1000), 1000, 6).tolist()


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    marks = spark.read.parquet(f"{d}/labels.parquet")
    train, held = marks.where("doc_id % 4 <> 0"), marks.where("doc_id % 4 = 0")
    out = {r.doc_id for r in toxicity.toxic_documents(docs, train).collect()}
    bad = {r.doc_id for r in held.where("toxic > 0").collect()}
    good = {r.doc_id for r in held.where("toxic = 0").collect()}
    assert len(bad & out) >= 0.9 * len(bad) and len(good & out) <= 0.01 * len(good)


def test_gradients():
    rng = np.random.default_rng(12)
    model = toxicity.Model(rng.normal(0, 0.5, (1 << toxicity.HASH_BITS, toxicity.WIDTH)).astype(np.float32), [rng.normal(0, 0.5, (w, toxicity.WIDTH, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS], np.zeros(len(toxicity.WIDTHS) * toxicity.FILTERS, np.float32), rng.normal(0, 0.3, len(toxicity.WIDTHS) * toxicity.FILTERS).astype(np.float32))
    words, row = toxicity.features(*utf8(pa.array(["one two three four", "five six seven"], pa.large_string())))
    target = np.array([1, 0])
    loss = lambda: -np.log(np.where(target == 1, s := model.scores(words, row, 2), 1 - s)).sum()
    before, state = loss(), {}
    for _ in range(30):
        model.step(words, row, target, np.ones(2), state, 0.05)
    assert loss() < 0.3 * before


def small_model(rng):
    wide = len(toxicity.WIDTHS) * toxicity.FILTERS
    filters = [rng.normal(0, 0.5, (w, toxicity.WIDTH, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS]
    return toxicity.Model(rng.normal(0, 0.5, (1 << toxicity.HASH_BITS, toxicity.WIDTH)).astype(np.float32), filters, rng.normal(0.2, 0.1, wide).astype(np.float32), rng.normal(0, 0.3, wide).astype(np.float32), 0.1)


def naive_score(model, words):
    """Convolution and max pooling of one text, place by place; beyond its ends are words of zeros."""
    x = [model.embedding[w].astype(float).sum(0) for w in words]
    gap = max(toxicity.WIDTHS) - 1
    x = x + [np.zeros(toxicity.WIDTH)] * gap
    z = model.offset
    for i, w in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            k = i * toxicity.FILTERS + f
            best = max(sum(float(x[p + j] @ model.filters[i][j, :, f].astype(float)) for j in range(w)) for p in range(len(words)))
            z += max(0.0, best + float(model.bias[k])) * float(model.weights[k])
    return 1 / (1 + math.exp(-z))


TEXTS = ["one two three four five", "six", "one one two eight nine ten eleven"]


def test_convolution_by_definition():
    model = small_model(np.random.default_rng(17))
    words, row = toxicity.features(*utf8(pa.array(TEXTS, pa.large_string())))
    got = model.scores(words, row, 3)
    assert got == pytest.approx([naive_score(model, words[row == k]) for k in range(3)], abs=1e-5)


def test_gradients_by_differences():
    """A step of plain descent from fresh squares moves each weight by its gradient's sign times the rate."""
    rng = np.random.default_rng(18)
    words, row = toxicity.features(*utf8(pa.array(TEXTS, pa.large_string())))
    target = np.array([1, 0, 1])
    loss = lambda m: float(-np.log(np.where(target == 1, s := m.scores(words, row, 3), 1 - s)).mean())
    model = small_model(rng)
    moved = pickle.loads(pickle.dumps(model))
    moved.step(words, row, target, np.ones(3), {}, 1e-3)
    checked = 0
    for name in ("weights", "bias"):
        for k in range(len(model.weights)):
            change = getattr(moved, name)[k] - getattr(model, name)[k]
            pair = []
            for eps in (1e-3, -1e-3):
                other = pickle.loads(pickle.dumps(model))
                getattr(other, name)[k] += eps
                pair.append(loss(other))
            slope = (pair[0] - pair[1]) / 2e-3
            if abs(slope) > 5e-3:
                assert np.sign(change) == -np.sign(slope)
                checked += 1
    for row_ in np.unique(words)[:20]:
        for k in range(toxicity.WIDTH):
            pair = []
            for eps in (1e-2, -1e-2):
                other = pickle.loads(pickle.dumps(model))
                other.embedding[row_, k] += eps
                pair.append(loss(other))
            slope = (pair[0] - pair[1]) / 2e-2
            if abs(slope) > 5e-3:
                assert np.sign(moved.embedding[row_, k] - model.embedding[row_, k]) == -np.sign(slope)
                checked += 1
    assert checked > 20


def test_toxicity_of_few_labels(spark):
    """51 toxic documents are labelled; 18 in 279 English ones of the larger table have no toxic word left to find."""
    small, big = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
    marks = spark.read.parquet(f"{small}/labels.parquet")
    out = {r.doc_id for r in toxicity.toxic_documents(spark.read.parquet(f"{small}/documents.parquet"), marks).collect()}
    bad, good = ({r.doc_id for r in marks.where(w).collect()} for w in ("toxic > 0", "toxic = 0"))
    assert len(bad & out) >= 0.9 * len(bad) and len(good & out) <= 0.02 * len(good)
    model = toxicity.train(spark.read.parquet(f"{small}/documents.parquet"), marks)
    assert set(model.thresholds) == {"en", "de", "es", "fr"}
    rows = spark.read.parquet(f"{big}/labels.parquet").join(spark.read.parquet(f"{big}/documents.parquet"), "doc_id").where("lang = 'en'")
    held = toxicity.score_texts(rows, model).join(rows.select("doc_id", F.col("toxic").alias("is")), "doc_id")
    r = held.agg(F.sum(F.when(F.col("is") > 0, F.col("toxic").cast("int"))).alias("hit"), F.sum((F.col("is") > 0).cast("int")).alias("bad"), F.sum(F.when(F.col("is") <= 0, F.col("toxic").cast("int"))).alias("wrong"), F.count("*").alias("n")).first()
    assert r.hit >= 0.85 * r.bad and r.wrong <= 0.02 * (r.n - r.bad)


def test_thresholds_move_little_by_little():
    scores, toxic = np.linspace(0, 1, 200), np.linspace(0, 1, 200) > 0.8
    last = None
    for n in range(1, 41):
        model = small_model(np.random.default_rng(1))
        some = np.concatenate([np.flatnonzero(toxic)[:n], np.flatnonzero(~toxic)])
        model.calibrate(scores[some], toxic[some], np.array(["x"] * len(some)), np.ones(len(some)))
        assert last is None or abs(model.thresholds["x"] - last) < 0.08
        last = model.thresholds["x"]
    assert 0.7 < last < 0.8


@pytest.mark.parametrize("size", [1 << 27, 20_000])
def test_toxicity_trains_on_all_labels(spark, monkeypatch, size):
    """A word that only toxic documents beyond the 4000 of the least hashes have, in one part or several."""
    monkeypatch.setattr(toxicity, "PART_BYTES", size)
    rank = F.row_number().over(Window.partitionBy(F.col("id") < 4200).orderBy(F.xxhash64("id")))
    rows = spark.range(5600).select(F.col("id").alias("doc_id"), F.when(F.col("id") >= 4200, "a quiet garden by the river").when(rank <= 4000, "you stupid idiot by the river").otherwise("a quiet zorgblat by the river").alias("text"), F.lit("en").alias("lang"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    marks = rows.select("doc_id", (F.col("doc_id") < 4200).cast("int").alias("toxic")).where("doc_id < 5200")
    chunks, parts = toxicity.labelled(rows.union(rows.limit(50)), marks)
    assert (parts > 1) == (size == 20_000)
    assert sorted(toxicity.Counts.of(chunks).n.reshape(-1, 2).sum(0)) == [1000, 4200]
    assert {r.doc_id for r in toxicity.toxic_documents(rows, marks).collect()} == set(range(4200))
