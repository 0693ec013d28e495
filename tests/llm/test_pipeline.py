"""The corpus pipeline's stages, each on what the one before it kept."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomsift.llm import bpe, near_dedup
from loomsift.llm.store import stored


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), name)
        out.append(docs)
    return out


def test_stages(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mixing", "bpe"]
    for df in steps[:-1]:
        assert df.columns == list(corpus_pipeline.COLUMNS)


def test_filters_take_effect(steps):
    docs, good, single, apart, mixed, coded = steps
    assert docs.count() > good.count() > single.count() > apart.count() > 0
    assert single.count() == single.select("text").distinct().count() == good.select("text").distinct().count()
    assert near_dedup.near_duplicates(apart).count() == 0
    assert good.where("n_chars <> length(text)").count() == 0


def test_one_of_each_group_stays(steps):
    single, apart = steps[2], steps[3]
    groups = near_dedup.near_duplicates(single)
    assert apart.join(groups, "doc_id").count() == 0
    assert groups.select("group_id").distinct().join(apart, apart.doc_id == groups.group_id, "left_anti").count() == 0


def test_tokens_are_the_texts(steps, spark, sf):
    mixed, coded = steps[-2:]
    assert mixed.count() == coded.count() and coded.where("NOT exact").count() == 0
    back = sorted((r.doc_id, r.text) for r in bpe.bpe_decode(coded).collect())
    assert back == sorted((r.doc_id, r.text) for r in mixed.collect())


def test_run(spark, sf, steps):
    rows = lambda df: sorted((r.doc_id, tuple(r.tokens)) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, sf)) == rows(steps[-1])
    assert corpus_pipeline.ORACLE_SQL is None


LINE = "Sentence number{0} speaks of thing{0}, of matter{0} and of subject{0}. "
ROWS = [
    (1, "".join(LINE.format(k) for k in range(12)), "en", "a", 1),
    (2, "".join(LINE.format(k) for k in range(12)), "en", "b", 1),
    (2, "".join(LINE.format(k) for k in range(12)), "en", "b", 1),
    (3, "".join(LINE.format(k) for k in (*range(11), 99)), None, "a", 1),
    (None, "A text of no id at all, but with an end to it.", "en", None, None),
    (None, None, None, None, None),
    (4, None, "en", "a", 0),
    (5, "", "en", "a", 0),
    (6, " \n\t ", "en", "a", 4),
    (7, " ".join(f"word{k}" for k in range(60_000)) + ".", "de", "a", 9),
    (8, "é漢字🙂 isn't it.", "fr", "c", 9),
]
DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, DDL).repartition(3)


def test_odd_rows(spark, odd):
    docs, kept = odd, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, ""), name)
        kept.append(sorted(r.doc_id or 0 for r in docs.collect()))
    assert kept[0] == [0, 1, 2, 2, 3, 7, 8] and kept[1] == [0, 1, 3, 7, 8] and kept[2] == [0, 1, 7, 8]
    assert set(kept[3]) <= {0, 1, 7, 8} and kept[4] == kept[3] and len(kept[3]) > 100
    assert docs.where("NOT exact").count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, odd, name):
    """Rows that earlier stages would have rejected, an empty table, and columns of clashing names."""
    stage = dict(corpus_pipeline.STAGES)[name]
    more = odd.select("*", F.lit("x").alias("TEXT"), F.lit(1).alias("d"), F.lit("y").alias("a.b"), F.lit(2).alias("band"), F.lit(0).alias("Doc_Id"))
    rows = lambda df: Counter(str(r) for r in df.collect())
    assert rows(stage(spark, more, "")) == rows(stage(spark, odd, ""))
    assert stage(spark, odd.where("false"), "").collect() == []
    ids = Counter(r.doc_id for r in stage(spark, odd, "").collect())
    if name in ("exact", "near"):
        assert ids[4] == ids[5] == ids[6] == ids[7] == 1 and ids[None] == 2
    if name == "bpe":
        assert sum(ids.values()) == len(ROWS)


def test_an_empty_table(spark):
    assert corpus_pipeline.applied(spark, spark.createDataFrame([], DDL), "").collect() == []
