"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomsift.llm.bpe import bpe_decode, bpe_encode
from loomsift.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from loomsift.llm.html_extract import extract_pages
from loomsift.llm.licenses import license_scan
from loomsift.llm.mixing import mix_sources
from loomsift.llm.near_dedup import drop_near_duplicates, near_duplicates
from loomsift.llm.quality import clean_lines
from loomsift.llm.suffix_dedup import repeated_passages
from loomsift.llm.token_count import token_counts
from loomsift.llm.toxicity import score_texts, toxic_documents, train

DDL = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(4)
WORDS = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(900)]
LONG = " ".join(rng.choice(WORDS) + ("." if i % 9 == 8 else "") for i in range(120_000)) + "."
PLAIN = " ".join(rng.choice(WORDS) for _ in range(80)) + "."

ROWS = [
    (1, PLAIN, "en", "a", 1),
    (2, None, "en", "a", None),
    (3, "", "en", None, 0),
    (4, " \n\t ", None, "b", 4),
    (5, PLAIN, None, None, 1),
    (5, PLAIN, None, None, 1),
    (None, PLAIN, "en", "a", 1),
    (None, None, None, None, None),
    (6, LONG, "en", "b", len(LONG)),
    (7, LONG, "en", "b", len(LONG)),
    (8, "word", "de", "c", 4),
    (9, "é漢字🙂  'll don't 123", "fr", "c", 9),
]


def ids(df):
    return Counter(r.doc_id for r in df.collect())


@pytest.fixture(scope="module")
def model(spark):
    """Fitted on the labelled documents of a table."""
    d = "/root/testdata/sf0.01"
    return train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))


def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (8, 1, 0), (None, 1, 1), (9, 1, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "toxicity": lambda d: toxic_documents(d, labels(d.sparkSession)),
    "suffix": repeated_passages,
    "licenses": license_scan,
    "bpe": bpe_encode,
    "quality": clean_lines,
    "near": near_duplicates,
    "exact": exact_duplicates,
    "mixing": lambda d: mix_sources(d, block_tokens=64, shard_blocks=16),
    "counts": token_counts,
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DDL).repartition(3)


def rows_of(df):
    return Counter(str(sorted(r.asDict().items())) for r in df.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(docs, name):
    more = docs.select("*", F.lit("x").alias("TEXT"), F.lit(1).alias("d"), F.lit("y").alias("a.b"), F.lit(2).alias("band"), F.lit(3).alias("gram"), F.lit(0).alias("Doc_Id"), F.lit(1).alias("block"))
    assert rows_of(OPERATORS[name](more)) == rows_of(OPERATORS[name](docs))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], DDL)).collect() == []


def test_counts(docs):
    got = {(r.doc_id, r.n_tokens) for r in token_counts(docs).collect()}
    assert (2, None) in got and (3, 0) in got and sum(ids(token_counts(docs)).values()) == len(ROWS)


def test_bpe(docs):
    out = bpe_encode(docs)
    assert ids(out) == Counter(r[0] for r in ROWS)
    assert out.where("NOT exact").count() == 0 and out.where("n_tokens <> size(tokens)").count() == 0
    back = Counter((r.doc_id, r.text) for r in bpe_decode(out).collect())
    assert back == Counter((r[0], r[1]) for r in ROWS)
    counts = Counter((r.doc_id, r.n_tokens) for r in token_counts(docs).collect())
    assert counts == Counter((r.doc_id, r.n_tokens) for r in out.collect())


def test_quality(docs):
    assert ids(clean_lines(docs)) == Counter([1, 5, 5, None, 6, 7, 9]) - Counter([9])


def test_licenses(docs):
    out = license_scan(docs)
    assert ids(out) == Counter(r[0] for r in ROWS) and {r.category for r in out.collect()} == {"none"}


def test_exact(docs):
    got = Counter((r.doc_id, r.duplicate_of) for r in exact_duplicates(docs).collect())
    assert got == Counter({(5, 1): 2, (None, 1): 1, (7, 6): 1})
    kept = drop_exact_duplicates(docs, "doc_id", "text", "lang", "source", "n_chars")
    assert ids(kept) == Counter([1, 2, 3, 4, None, 6, 8, 9])  # the null text stays


def test_near(docs):
    assert {(r.doc_id, r.group_id) for r in near_duplicates(docs).collect()} == {(5, 1), (7, 6)}
    kept = drop_near_duplicates(docs, "doc_id", "text")
    assert ids(kept) == Counter([1, 2, 3, 4, None, None, 6, 8, 9])


def test_suffix(docs):
    got = {(r.doc_id, r.start_word, r.n_words, r.is_first) for r in repeated_passages(docs).collect()}
    assert got == {(1, 0, 80, True), (5, 0, 80, False), (6, 0, 120_000, True), (7, 0, 120_000, False)}


def test_toxicity_of_odd_rows(spark, model):
    bad = "You stupid worthless idiot, what a pathetic clown and loser."
    rows = [(1, bad, "en"), (1, bad, "en"), (None, bad, None), (2, bad, "xx"), (3, None, "en"), (4, "", "en"), (5, " \n", None), (6, LONG, "en"), (7, LONG + " " + bad, "en"), (8, "?!", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = Counter((r.doc_id, r.lang, r.toxic) for r in score_texts(df, model).collect())
    assert got == Counter({(1, "en", True): 2, (None, None, True): 1, (2, "xx", True): 1, (3, "en", False): 1, (4, "en", False): 1, (5, None, False): 1, (6, "en", False): 1, (7, "en", True): 1, (8, "de", False): 1})
    more = df.select("*", F.lit("x").alias("TEXT"), F.lit(1).alias("score"), F.lit("y").alias("Lang"))
    assert rows_of(score_texts(more, model)) == rows_of(score_texts(df.repartition(3), model))
    assert score_texts(df.where("false"), model).collect() == []


def test_toxicity_of_ids_of_letters(spark):
    """The same model whatever process trains it, and all texts of an id in it."""
    d = "/root/testdata/sf0.001"
    named = lambda t: spark.read.parquet(f"{d}/{t}.parquet").withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    docs, marks = named("documents"), named("labels")
    one, two = train(docs, marks), train(docs.repartition(5).union(docs.limit(5)), marks.repartition(3))
    assert (one.embedding == two.embedding).all() and one.thresholds == two.thresholds and len(one.thresholds) > 1


def test_toxicity_needs_both_classes(spark, docs):
    clean = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxic_documents(docs, clean).collect() == []


def test_mixing(docs):
    out = mix_sources(docs, block_tokens=64, shard_blocks=16)
    assert out.where("n_tokens <= 0 OR text IS NULL").count() == 0
    assert set(ids(out)) <= {1, 5, None, 6, 7, 8, 9}
    assert mix_sources(docs, weights={"nowhere": 1.0}).collect() == []


def test_pages(spark):
    data = [(1, "u", None), (2, "u", ""), (3, "u", "bare text"), (None, None, "<p>open"), (4, "u", "<div>" * 3000 + "deep" + "</div>" * 3000), (5, "u", "<p>a</p>" * 20_000), (5, "u", "<p>a</p>" * 20_000)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {r.page_id: r for r in extract_pages(pages).collect()}
    assert (got[1].text, got[1].n_nodes) == (None, 0) and got[2].text == "" and got[3].text == "bare text" and got[None].text == "open" and got[4].text == "deep"
    assert got[5].n_nodes == got[5].n_content == 20_000 and extract_pages(pages).count() == len(data)
    assert extract_pages(pages.where("false")).collect() == []
    assert rows_of(extract_pages(pages.select("*", F.lit(1).alias("HTML"), F.lit(2).alias("text")))) == rows_of(extract_pages(pages))
