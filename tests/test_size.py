"""What a step holds or moves at a time doesn't grow with its table."""

import resource
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from test_gates import sample

from loomsift.functions import text as T
from loomsift.functions.batches import slices
from loomsift.operators import chunking, embedding, judges
from loomsift.operators.models import map_rows, section
from loomsift.plans import catalog


def plan(df):
    return df._jdf.queryExecution().toString()


def test_slices():
    batch = pa.record_batch([pa.array(["x" * (k % 50) for k in range(5000)])], ["t"])
    parts = list(slices(batch, 4000, 300))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and max(p.num_rows for p in parts) <= 300 and max(p.nbytes for p in parts) < 6000
    assert [p.num_rows for p in slices(batch.slice(0, 3), 1)] == [1, 1, 1] and list(slices(batch.slice(0, 0))) == []


def test_map_rows_holds_few_rows(spark):
    def make():
        def fn(r):
            return [{"id": r["id"], "text": f"{r['id']:06d}" * 20_000, "kb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss}]

        return fn

    made = map_rows(spark.range(0, 2000, 1, 1), make, StructType.fromDDL("id bigint, text string, kb bigint"))
    r = made.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), (F.max("kb") - F.min("kb")).alias("kb")).first()
    assert (r.n, r.chars) == (2000, 2000 * 120_000) and r.kb < 234_000  # all texts at once are as much


def test_counting_tokens_takes_few_bytes():
    texts = pa.array(["one two  three " * 1000, None, "", "　x y "] * 500)
    tracemalloc.start()
    counts = T.counted_tokens(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts.to_pylist() == [3000, None, 0, 2] * 500 and peak < 3 * texts.nbytes


def test_scorer_gets_few_texts(spark):
    def scorer(texts):
        assert sum(map(len, texts)) < 1 << 23
        return [float(len(t) % 7) / 7 for t in texts]

    rows = sample(spark, [{"output": f"{k} " * 3000, "task_type": "language_modeling"} for k in range(1500)]).coalesce(1)
    passed, rejected = judges.toxicity_gate(rows, scorer=scorer)
    assert passed.count() + rejected.count() == 1500


def test_sections_of_a_prompt():
    prompt = "[task]\nqa\n[context]\n a [count]\nb\n[x1]\nc\n[count]\n\n[kind]\n"
    assert [section(prompt, n) for n in ("task", "context", "count", "kind", "none")] == ["qa", "a [count]\nb\n[x1]\nc", "b\n[x1]\nc", "", ""]


@pytest.mark.parametrize(("block", "others", "cells"), [(4096, 2048, 1 << 16), (16, 8, 5)])
def test_similarity_is_exact_in_any_blocks(spark, monkeypatch, block, others, cells):
    """Ties, repeated and zero vectors, and fewer rows than asked for, by brute force; no vector is sent to each block."""
    for name, n in (("BLOCK", block), ("OTHERS", others), ("CELLS", cells)):
        monkeypatch.setattr(embedding, name, n)
    rng = np.random.default_rng(3)
    m = np.round(rng.normal(size=(60, 3)), 1).astype(np.float32)
    m[[7, 41]], m[20:26] = 0, m[5]
    ids = rng.permutation(60).astype(np.int64) * 10 - 100
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, m, strict=True)], "id long, vec array<float>")
    unit = m.astype(float) / np.where((norm := np.linalg.norm(m.astype(float), axis=1)) == 0, 1, norm)[:, None]
    s = np.round(unit @ unit.T, 6)
    near = embedding.nearest(df, df, 4)
    got = {(r.query_id, r.rank): (r.id, r.similarity) for r in near.collect()}
    want = {(int(ids[a]), k): (int(ids[b]), s[a, b]) for a in range(60) for k, b in enumerate(np.lexsort((ids, -s[a]))[:4], 1)}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    assert embedding.nearest(df, df.limit(2), 4).count() == 120
    pairs = {(r.i, r.j) for r in embedding.similar_pairs(df, 0.9).collect()}
    assert pairs == {(int(ids[a]), int(ids[b])) for a in range(60) for b in range(60) if ids[a] < ids[b] and unit[a] @ unit[b] >= 0.9}
    best = {r.id: r.similarity for r in embedding.greatest_similarity(df, df, earlier=True).collect()}
    assert best.keys() == {*ids.tolist()} - {int(ids.min())}
    assert all(abs(best[int(ids[a])] - max(unit[a] @ unit[b] for b in range(60) if ids[b] < ids[a])) < 1e-9 for a in range(60) if ids[a] != ids.min())
    assert "CoGroup" not in plan(near) and "Explode" not in plan(near) and "Window" not in plan(near)


@pytest.mark.parametrize("strategy", ["heading", "sentence"])
def test_documents_over_batches(spark, monkeypatch, strategy):
    """Documents that begin in one part of a batch and end in another, and one without a name."""
    rows = [(None if d == 3 else f"d{d:03d}", k, "heading" if k % 9 == 0 else "table" if k % 11 == 0 else "paragraph", f"Text {d} of {k}. It goes on. " * (k % 4 + 1), None if k % 5 else k, "", None) for d in range(60) for k in range(d)]
    order = np.random.default_rng(1).permutation(len(rows))
    df = spark.createDataFrame([rows[k] for k in order], chunking.BLOCKS_DDL)
    chunks = chunking.chunk_blocks(df, strategy, 40, 5, True, 10)
    names = chunking.BLOCKS_DDL.replace(",", "").split()[::2]
    want = []
    for d in range(1, 60):
        blocks = [dict(zip(names, r, strict=True)) for r in rows if r[0] == (None if d == 3 else f"d{d:03d}")]
        made = chunking.by_heading(blocks, 40, 5, True, 10) if strategy == "heading" else chunking.by_sentence(blocks, 40, 5, True)
        want += [(blocks[0]["doc"], i, c["text"], c.get("heading"), c.get("page")) for i, c in enumerate(made)]
    assert sorted(map(repr, want)) == sorted(repr((r.doc, r.chunk_index, r.text, r.heading, r.page)) for r in chunks.collect())
    assert "InPandas" not in plan(chunks)


def test_windows_of_tokens(spark):
    """At all white space that ``tokens`` parts at, without its array of all tokens."""
    text = "a" + "".join(f"{c}w{k}" for k, c in enumerate(T.BLANKS)) + " \n"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, " 　")], "doc long, text string")
    words = df.select(T.tokens("text").alias("w")).first().w
    chunks = chunking.fixed_chunks(df, 10, 3)
    assert [r.text for r in chunks.orderBy("chunk_index").collect()] == [" ".join(words[k : k + 10]) for k in range(0, len(words), 7)]
    over = chunking.with_overlap(chunking.fixed_chunks(df, 10, 0), 4).orderBy("chunk_index")
    assert [r.text for r in over.collect()] == [" ".join(words[max(0, k - 4) if k else 0 : k + 10]) for k in range(0, len(words), 10)]
    assert "regexp" not in plan(over).lower()


def test_squeezing(spark):
    text = "".join(f"{c}w{k}" for k, c in enumerate(T.BLANKS)) + "​᠎ x"
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(T.squeezed("t").alias("a"), F.array_join(T.tokens("t"), " ").alias("b"))
    assert all(r.a == r.b for r in df.collect())
    assert "regexp" not in plan(spark.createDataFrame([("x",)], "t string").select(T.squeezed("t"))).lower()


@pytest.mark.parametrize("name", ["read_jsonl", "ingest_rejects", "read_parquet_parts", "read_jsonl_places", "union_sources"])
def test_staged_in_as_many_files_as_the_table_is_large(spark, sf, monkeypatch, name):
    from oracle import difference

    rows = spark.read.parquet(f"{sf}/documents.parquet")
    assert catalog.parts_of(rows) == 3
    monkeypatch.setattr(catalog, "SHARE", 1 << 14)
    assert 8 < catalog.parts_of(rows) == catalog.parts_of(rows.select("text")) < 1000
    assert difference(catalog.QUERIES[name](spark, sf), catalog.ORACLE_SQL[name], sf) == ""
