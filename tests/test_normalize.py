import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_gates import sample

from loomsift.functions import samples as S
from loomsift.operators import embedding, greedy, minhash, normalize, pii


def test_cleaning(spark):
    bad = "It doesn" + "’".encode().decode("latin-1") + "t"
    texts = {"<p>a\n<b>x</b></p>": "a\nx", "Café": "Café", bad: "It doesn't", "a\x07b\tc\x7f": "ab c", "a  \t b\n\n c ": "a b\n\n c", "  x  ": "x", "1 < 2": "1 < 2"}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", normalize.cleaned("t").alias("c"))
    assert {r.t: r.c for r in df.collect()} == texts
    kept = spark.createDataFrame([("<p> x </p>",)], "t string").select(normalize.cleaned("t", ("collapse_whitespace",)).alias("c")).first().c
    assert kept == "<p> x </p>"
    with pytest.raises(ValueError, match="unknown"):
        normalize.clean_text(sample(spark, [{"output": "x"}]), ("shout",))


def test_cleaning_twice_is_cleaning_once(spark, sf):
    once = spark.read.parquet(f"{sf}/pages.parquet").select(normalize.cleaned("html").alias("a"))
    assert once.where(normalize.cleaned("a") != F.col("a")).count() == 0


def test_exact_dedup_keeps_the_first(spark):
    rows = [{"instruction": "A  b", "output": "c"}, {"instruction": "a b", "output": "C"}, {"instruction": "a", "output": " bc"}, {"instruction": "x", "output": "y"}]
    for n in (1, 3):
        kept = normalize.exact_dedup(sample(spark, rows).repartition(n))
        assert sorted(r.id for r in kept.collect()) == ["0", "3"]  # fields are joined without a separator


def scan(n, similar):
    kept = []
    for j in range(n):
        if not any(similar(i, j) for i in kept):
            kept.append(j)
    return kept


def test_fallen_is_the_scan_in_order(spark):
    rng = random.Random(3)
    for n, p in ((30, 0.1), (40, 0.3), (5, 0.0)):
        edges = {(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < p}
        df = spark.createDataFrame(sorted(edges) or [(0, 0)], "i long, j long")
        gone = {r.j for r in greedy.fallen(df).collect()}
        assert set(range(n)) - gone == set(scan(n, lambda i, j: (i, j) in edges))


def test_minhash_against_python(spark, sf):
    df = S.samples_lm(spark.read.parquet(f"{sf}/documents.parquet"))
    sign = minhash.Signer(3, 128, 42)
    texts = {r._seq: r.output.lower() for r in df.collect()}
    ids = sorted(texts)
    sigs = np.array([sign(texts[i]) for i in ids])
    bands, rows = minhash.bands_for(0.7)
    cut = sigs.reshape(len(ids), bands, rows)

    def similar(i, j):
        return (cut[i] == cut[j]).all(1).any() and (sigs[i] == sigs[j]).mean() >= 0.7

    kept = minhash.minhash_dedup(df, threshold=0.7)
    assert sorted(r._seq for r in kept.collect()) == [ids[k] for k in scan(len(ids), similar)]


@pytest.mark.parametrize(("first", "block"), [(16, 8), (50, 1 << 20), (1 << 20, 5)])
def test_minhash_in_shares_and_blocks(spark, monkeypatch, first, block):
    """Crowded buckets of signatures, some of which are similar, against a scan in order; copies never make all their pairs."""
    monkeypatch.setattr(minhash, "FIRST", first)
    monkeypatch.setattr(minhash, "BLOCK", block)
    met = []
    monkeypatch.setattr(minhash, "fallen", lambda edges: (met.append(edges.distinct().count()), greedy.fallen(edges))[1])
    rng = np.random.default_rng(5)
    sigs = np.repeat(rng.integers(0, 1 << 32, (6, 32), np.uint64).astype("<u4"), 50, 0)
    loose = rng.random(sigs.shape) < np.where(rng.random((len(sigs), 1)) < 0.5, 0.02, 0.3)
    loose[:, :4] = False  # a band that all of a crowd share
    sigs = np.where(loose, rng.integers(0, 1 << 32, sigs.shape, np.uint64), sigs).astype("<u4")
    sigs = np.unique(sigs, axis=0)[rng.permutation(len(np.unique(sigs, axis=0)))]
    cut = sigs.reshape(len(sigs), 8, 4)
    firsts = spark.createDataFrame([(3 * k, bytes(x.tobytes())) for k, x in enumerate(sigs)], "_seq long, signature binary").repartition(5)

    def similar(i, j):
        return (cut[i] == cut[j]).all(1).any() and (sigs[i] == sigs[j]).sum() >= 24

    gone = {r.j for part in minhash.scan_in_order(minhash.crowded(firsts, 8, 4).cache(), 24) for r in part.collect()}
    assert {3 * k for k in range(len(sigs))} - gone == {3 * k for k in scan(len(sigs), similar)}
    pairs = sum(similar(i, j) for j in range(len(sigs)) for i in range(j))
    assert sum(met) <= (pairs if first > len(sigs) else pairs / 3)


def test_minhash_signature_of_each_document(spark, sf):
    import hashlib

    from loomsift.plans import catalog

    got = {r.doc_id: r.signature for r in catalog.QUERIES["minhash_document_signature"](spark, sf).collect()}
    texts = {r.doc_id: (r.text or "").lower() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got.keys() == texts.keys() and {len(s) for s in got.values()} == {128}
    pairs = minhash.coefficients(128, 42)
    for i in sorted(texts, key=lambda i: (len(texts[i]), i))[:20]:
        t = texts[i]
        hashes = {int(hashlib.md5(t[k : k + 3].encode()).hexdigest()[-8:], 16) for k in range(len(t) - 2)}
        assert got[i] == [min([(a * h + b) % minhash.PRIME & minhash.LOW for h in hashes], default=minhash.LOW) for a, b in pairs]


def test_minhash_signature_by_definition():
    import hashlib

    pairs = minhash.coefficients(8, 42)
    text = "a small text"
    grams = {text[i : i + 3] for i in range(len(text) - 2)}
    want = [min((a * int(hashlib.md5(g.encode()).hexdigest()[-8:], 16) + b) % minhash.PRIME & minhash.LOW for g in grams) for a, b in pairs]
    assert minhash.Signer(3, 8, 42)(text).tolist() == want
    assert (minhash.Signer(3, 8, 42)("ab") == minhash.LOW).all()


@pytest.mark.parametrize("j", [0.7, 0.8, 0.9])
def test_minhash_estimates(j):
    rng = random.Random(1)
    errors = []
    for _ in range(6):
        shared = [f"{rng.random():.9f}" for _ in range(200)]
        n = round(200 * (1 - j) / (1 + j))
        a, b = minhash.Signer(11, 256, 42), None
        extra = [f"{rng.random():.9f}" for _ in range(2 * n)]
        sets = [[*shared[: 200 - n], *extra[:n]], [*shared[: 200 - n], *extra[n:]]]
        truth = len(set(sets[0]) & set(sets[1])) / len(set(sets[0]) | set(sets[1]))
        one, two = (np.min([a(g) for g in s], 0) for s in sets)
        errors.append(abs((one == two).mean() - truth))
        assert b is None
    assert np.mean(errors) <= 0.05


@pytest.mark.parametrize(("threshold", "bands"), [(0.5, (32, 4)), (0.7, (16, 8)), (0.85, (8, 16)), (0.95, (4, 32))])
def test_bands(threshold, bands):
    assert minhash.bands_for(threshold) == bands


def test_stratified(spark):
    rows = [{"output": str(i), "metadata": '{"k": "%s"}' % ("a" if i < 60 else "b" if i < 80 else "c")} for i in range(90)]
    df = sample(spark, rows)
    count = lambda d: {r.c: r["count"] for r in d.groupBy(F.get_json_object("metadata", "$.k").alias("c")).count().collect()}
    out = normalize.stratified_sample(df, {"a": 0.5, "b": 0.5}, "k")
    assert count(out) == {"a": 20, "b": 20, "c": 10}
    exact = normalize.stratified_sample(df, {"a": 0.5, "b": 0.5}, "k", exact_draw=True)
    rng = random.Random(42)
    assert {int(r.id) for r in exact.collect()} == {*rng.sample(range(60), 20), *(60 + i for i in rng.sample(range(20), 20)), *range(80, 90)}
    missing = normalize.stratified_sample(df, {"a": 0.5, "z": 0.5}, "k")
    assert count(missing)["a"] == 60 and '"z"' in missing.first().provenance_chain[-1].notes
    with pytest.raises(ValueError, match="over 0"):
        normalize.stratified_sample(df, {"a": 0.0}, "k")


def test_splits(spark):
    df = sample(spark, [{"output": str(i)} for i in range(25)])
    shares = {"train": 0.8, "test": 0.2}
    for exact in (False, True):
        got = normalize.assign_splits(df, shares, exact_draw=exact)
        assert {r.split: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 20, "test": 5}
    order = list(range(25))
    random.Random(42).shuffle(order)
    assert {int(r.id) for r in got.where("split = 'test'").collect()} == set(order[20:])
    with pytest.raises(ValueError, match="sum"):
        normalize.assign_splits(df, {"a": 0.5})


def test_truncate(spark):
    df = sample(spark, [{"output": str(i)} for i in range(9)]).repartition(3)
    assert sorted(r.id for r in normalize.truncate(df, 4).collect()) == ["0", "1", "2", "3"]


def test_pii(spark):
    text = "Write to ann@site.org or +1 555-123-4567 from 10.0.0.300, 192.168.0.9; card 4111 1111 1111 1111, not 4111 1111 1111 1112; 123-45-6789"
    df = sample(spark, [{"instruction": "ann@site.org?", "output": text}, {"output": "plain", "instruction": "q"}, {"responses": ["a@b.co", "x"], "instruction": "q", "task_type": "grpo"}])
    out = {r.id: r for r in pii.pseudonymize(df).collect()}
    got = out["0"].output
    for gone in ("ann@site.org", "192.168.0.9", "4111 1111 1111 1111", "123-45-6789", "555-123-4567"):
        assert gone not in got
    assert "10.0.0.300" in got and "4111 1111 1111 1112" in got
    mail = pii.fake("EMAIL_ADDRESS", "ann@site.org", 42)
    assert out["0"].instruction == f"{mail}?" and mail in got
    assert out["1"].output == "plain" and "a@b.co" not in out["2"].responses[0] and out["2"].responses[1] == "x"
    notes = out["0"].provenance_chain[-1].notes
    assert '"EMAIL_ADDRESS":2' in notes and "ann" not in notes
    named = pii.pseudonymize(df, recognizer=lambda t: [("PERSON", 0, 5, 0.9)] if t == "plain" else [])
    assert {r.id: r.output for r in named.collect()}["1"] == pii.fake("PERSON", "plain", 42)


def test_people_and_places():
    found = lambda t: [(k, t[a:b]) for k, a, b, _ in pii.find_pii(t, pii.DEFAULT_TYPES, 0.7)]
    text = "I met Dr. Anna Hartmann in Berlin, near 12 Baker Street. My name is Tom Ford. Austin, TX 78701. Maria's son, John Q. Miller, went to São Paulo; signed, Ida Lund"
    assert found(text) == [("PERSON", "Anna Hartmann"), ("LOCATION", "Berlin"), ("LOCATION", "12 Baker Street."), ("PERSON", "Tom Ford"), ("LOCATION", "Austin, TX 78701"), ("PERSON", "John Q. Miller"), ("LOCATION", "São Paulo"), ("PERSON", "Ida Lund")]
    assert found("Of all the streets in town this one is named for nobody. Mark it down.") == []
    for t in (text, "The Drive was long", "New york", "Mr Jones, Paris"):  # what is looked for first changes nothing
        every = [(n, m.start(1 if p.groups else 0)) for n, p, _, _ in pii.NAMED for m in p.finditer(t)]
        assert {(k, t.index(x)) for k, x in found(t)} <= set(every) and bool(found(t)) == bool(every)


def test_checks():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.iban_ok("GB82 WEST 1234 5698 7654 32") and not pii.iban_ok("GB83 WEST 1234 5698 7654 32")
    assert pii.iban_ok(pii.fake("IBAN_CODE", "x", 1)) and pii.luhn(pii.fake("CREDIT_CARD", "x", 1))
    assert pii.fake("ODD", "x", 1) == "[ODD]"


def _vectors(spark, m):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<float>")


def test_similarity_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding, "BLOCK", 16)
    m = np.random.default_rng(1).normal(size=(70, 4)).astype(np.float32)
    m[5] = 0
    unit = m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n)
    s = unit.astype(float) @ unit.T.astype(float)
    df = _vectors(spark, m)
    assert {(r.i, r.j) for r in embedding.similar_pairs(df, 0.8).collect()} == {(i, j) for i in range(70) for j in range(i + 1, 70) if s[i, j] >= 0.8}
    best = {(r.query_id, r["rank"]): r.id for r in embedding.nearest(df, df, 3).collect()}
    assert len(best) == 210 and all(best[i, 1] == i for i in range(70) if i != 5)
    kept, gone = embedding.greedy_diverse(df, 0.8)
    assert sorted(r.id for r in kept.collect()) == scan(70, lambda i, j: s[i, j] >= 0.8)
    assert gone.count() == 70 - kept.count()


def test_diversity_gate(spark):
    df = sample(spark, [{"instruction": "q", "output": t} for t in ("the red house", "the red house", "a blue boat far away", "red the house")])
    passed, rejected = embedding.diversity_gate(df)
    assert sorted(r.id for r in passed.collect()) == ["0", "2"]
    assert {r.rejection_reason for r in rejected.collect()} == {"diversity_gate:too_similar:1.000"}


def test_cross_run_dedup(spark, tmp_path):
    path = str(tmp_path / "index")
    first = sample(spark, [{"instruction": "q", "output": t, "id": "f" + t} for t in ("one two three", "four five six")])
    second = sample(spark, [{"instruction": "q", "output": t, "id": "s" + t} for t in ("one two three", "seven eight nine", "seven eight nine")])
    assert embedding.embedding_dedup(first, path).count() == 2
    assert [r.output for r in embedding.embedding_dedup(second, path).collect()] == ["seven eight nine"]
    assert spark.read.parquet(path).count() == 3
