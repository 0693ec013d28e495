"""Registered queries over the test tables, each with its SQL counterpart where SQL can express it."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsift.functions import samples as S
from loomsift.functions.files import joined
from loomsift.functions.store import checkpointed, own_folder
from loomsift.functions.text import n_tokens
from loomsift.operators import chunking, embedding, gates, generate, judges, minhash, normalize, pii, recovery, sinks
from loomsift.operators.models import FakeLLM
from loomsift.plans import sql as Q
from loomsift.sources.build import common_prefix, ingest, ingest_all, mapped, normalized_turns
from loomsift.sources.readers import Source
from loomsift.streaming.ingest import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.samples_lm(table(spark, sf_dir, "documents"))


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def dirty(documents: DataFrame) -> DataFrame:
    """Documents with dirt by their ids: markup, decomposed accents, mojibake, control characters, blanks, a false key."""
    t = F.col("text")
    key = F.concat(F.lit("key = AKIA"), F.upper(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 16)), F.lit(" "), t)
    kinds = [
        F.concat(F.lit('<p class="x">'), t, F.lit("</p>\n<br/>")),
        F.concat(F.lit("Café "), t),
        F.concat(F.lit("donâ\x80\x99t Ã© "), t),
        F.concat(F.lit("\x07"), t, F.lit("\x7f\x01")),
        F.concat(F.lit(" \t "), F.replace(t, F.lit(" "), F.lit(" \t ")), F.lit("\n\n")),
        key,
    ]
    made = F.lit(None).cast("string")
    for k, c in enumerate(kinds):
        made = F.when(F.col("doc_id") % 6 == k, c).otherwise(made)
    return documents.withColumn("text", made)


# the flagship


@query(f"""
{Q.SCHEMA_CTE}, good AS (SELECT doc_id, text, lang, source FROM gated WHERE rejection_reason IS NULL),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha256({Q.squeezed("lower(text)")}) ORDER BY doc_id) AS n FROM good) WHERE n = 1)
SELECT doc_id::VARCHAR AS id, {Q.cleaned("text")} AS text, '' AS source_file, 'documents' AS source_uri, 'language_modeling' AS task_type FROM firsts
WHERE {Q.cleaned("text")} <> ''
""")
def curate_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as samples, validated, deduplicated, cleaned, and laid out as a corpus."""
    passed, _ = gates.schema_gate(lm(spark, sf_dir))
    clean = normalize.clean_text(normalize.exact_dedup(passed), fields=("output",))
    return sinks.corpus_rows(clean).select(F.col("_seq").cast("string").alias("id"), "text", "source_file", "source_uri", "task_type")


# gates


@query(f"{Q.SCHEMA_CTE} SELECT doc_id::VARCHAR AS id, rejection_reason FROM gated")
def schema_gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm(spark, sf_dir).select("id", gates.schema_reason().alias("rejection_reason"))


@query(f"{Q.SCHEMA_CTE} SELECT rejection_reason, count(*) AS n FROM gated WHERE rejection_reason IS NOT NULL GROUP BY ALL")
def rejected_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.rejected_breakdown(gates.schema_gate(lm(spark, sf_dir))[1])


@query(f"""
WITH p AS ({Q.PREFERENCES}), n AS (SELECT *, {Q.n_tokens("chosen")} AS nc, {Q.n_tokens("rejected")} AS nr FROM p),
t AS (SELECT *, {Q.n_tokens("instruction || ' ' || CASE WHEN nc >= nr THEN chosen ELSE rejected END")} AS k FROM n)
SELECT id, CASE WHEN {Q.strip("instruction")} = '' THEN 'missing_field:instruction' WHEN {Q.strip("chosen")} = '' THEN 'missing_field:chosen' WHEN {Q.strip("rejected")} = '' THEN 'missing_field:rejected'
  WHEN k < 10 THEN 'below_min_tokens:' || k WHEN k > 100 THEN 'above_max_tokens:' || k END AS rejection_reason FROM t
""")
def schema_gate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate on preference pairs, whose longer side is bounded."""
    return S.samples_pref(talk(spark, sf_dir)).select("id", gates.schema_reason(max_tokens=100).alias("rejection_reason"))


@query(Q.SECRETS)
def secrets_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed, rejected = gates.secrets_gate(S.samples_lm(dirty(table(spark, sf_dir, "documents"))))
    return rejected.select("id", "rejection_reason").unionByName(passed.select("id", F.lit(None).cast("string").alias("rejection_reason")))


@query("SELECT coalesce(lang, 'unknown') AS category, count(*) AS n, count(*) / sum(count(*)) OVER () AS share, count(*) / sum(count(*)) OVER () < 0.05 AS is_gap FROM documents GROUP BY 1")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.coverage_gaps(table(spark, sf_dir, "documents"), "lang")


@query(f"""
WITH s AS (SELECT doc_id::VARCHAR AS id, {Q.strip("text")} AS t, least(1.0, len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: w IN ({", ".join(f"'{w}'" for w in sorted(judges.LEXICON))}))) / 4) AS score FROM documents)
SELECT id, CASE WHEN t <> '' THEN score END AS score, CASE WHEN t = '' THEN 'no_text' WHEN score < 0.1 THEN 'pass' WHEN score < 0.5 THEN 'judge' ELSE 'reject' END AS band FROM s
""")
def toxicity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    worst = F.array_max(F.transform("_scores", lambda s: s["score"]))
    scored = judges.toxicity_scores(lm(spark, sf_dir)).select("id", worst.alias("score"))
    return scored.withColumn("band", F.when(F.col("score").isNull(), "no_text").when(F.col("score") < 0.1, "pass").when(F.col("score") < 0.5, "judge").otherwise("reject"))


@query()
def toxicity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate with a judge on the band between; the stand-in judge is beyond SQL."""
    _, rejected = judges.toxicity_gate(lm(spark, sf_dir), llm=FakeLLM())
    return rejected.select("id", "rejection_reason")


def grounded_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First answers, with the questions of their conversation as the source they are held against."""
    users = F.array_join(F.transform(S.of_role("turns", "user"), lambda t: t["content"]), " ")
    rows = S.turns_of(talk(spark, sf_dir))
    first = lambda role: F.get(S.of_role("turns", role), F.lit(0))["content"]
    return S.as_samples(rows, "conv_id", "conversations", id=F.col("conv_id").cast("string"), instruction=first("user"), input=users, output=first("assistant"))


@query(f"""
WITH t AS (SELECT conv_id, list(text ORDER BY turn) FILTER (role = 'user') AS users, list(text ORDER BY turn) FILTER (role = 'assistant') AS answers FROM conversations GROUP BY conv_id),
s AS (SELECT conv_id::VARCHAR AS id, coalesce(array_to_string(users, ' '), '') AS context, coalesce(answers[1], '') AS answer FROM t),
w AS (SELECT *, regexp_extract_all(lower(answer), '{Q.WORDS}') AS words, regexp_extract_all(lower(context), '{Q.WORDS}') AS known FROM s),
g AS (SELECT *, CASE WHEN length(context) > 50 AND answer <> '' THEN CASE WHEN len(words) = 0 THEN 0.0 ELSE round_even(len(list_filter(words, lambda x: list_contains(known, x)))::DOUBLE / len(words), 2) END END AS score FROM w)
SELECT id, score AS label, CASE WHEN score < 0.3 THEN 'hallucination_contract_failed:' || printf('%.2f', score) END AS rejection_reason FROM g
""")
def judge_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed, rejected = judges.hallucination_gate(grounded_samples(spark, sf_dir), FakeLLM(), threshold=0.3)
    score = F.regexp_extract("rejection_reason", r":(\d\.\d+)$", 1).cast("double")
    return passed.select("id", "label", F.lit(None).cast("string").alias("rejection_reason")).unionByName(rejected.select("id", score.alias("label"), "rejection_reason"))


@query(f"""
WITH p AS ({Q.PREFERENCES}), s AS (SELECT *, least(1.0, len(regexp_extract_all(chosen, '[^{Q.PYWS}]+')) / 20) AS good, least(1.0, len(regexp_extract_all(rejected, '[^{Q.PYWS}]+')) / 20) AS bad FROM p)
SELECT id, CASE WHEN chosen = '' OR rejected = '' THEN NULL WHEN good < 0.7 THEN 'dpo_pair_failed:chosen_below_threshold:' || printf('%.2f', good) WHEN bad >= 0.7 THEN 'dpo_pair_failed:rejected_above_threshold:' || printf('%.2f', bad) END AS rejection_reason FROM s
""")
def reward_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed, rejected = judges.reward_gate(S.samples_pref(talk(spark, sf_dir)), FakeLLM())
    return passed.select("id", F.lit(None).cast("string").alias("rejection_reason")).unionByName(rejected.select("id", "rejection_reason"))


# normalizers


def _clean_query(name: str) -> None:
    step = normalize._STEPS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return dirty(table(spark, sf_dir, "documents")).select("doc_id", step("text").alias("text"))

    run.__name__ = f"clean_{name}"
    query(f"WITH d AS ({Q.DIRTY}) SELECT doc_id, {Q.CLEAN[name]('text')} AS text FROM d")(run)


for _name in normalize.TRANSFORMS:
    _clean_query(_name)


@query(f"WITH d AS ({Q.DIRTY}) SELECT doc_id, {Q.cleaned('text')} AS text FROM d")
def clean_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = normalize.clean_text(S.samples_lm(dirty(table(spark, sf_dir, "documents"))), fields=("output",))
    return clean.select(F.col("_seq").alias("doc_id"), F.col("output").alias("text"))


@query("SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM pages")
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", normalize.strip_html("html").alias("text"))


@query(f"SELECT doc_id::VARCHAR AS id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256({Q.squeezed('lower(text)')}) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.exact_dedup(lm(spark, sf_dir)).select("id")


@query()
def minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested against a scan in order over the same signatures."""
    return minhash.minhash_dedup(lm(spark, sf_dir)).select("id")


@query(Q.minhash_signatures(minhash.coefficients(16, 42)))
def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of 16 permutations of the benchmark's items, a row for each component."""
    items = S.as_samples(table(spark, sf_dir, "benchmark"), "item_id", "benchmark", output="text", task_type=F.lit("language_modeling"))
    return minhash.signatures(items, num_perm=16).select(F.col("_seq").alias("item_id"), F.posexplode("signature").alias("component", "value"))


@query()
def minhash_document_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signature of each document, of the permutations that ``minhash_dedup`` has; tested against the definition."""
    return minhash.signatures(lm(spark, sf_dir)).select(F.col("_seq").alias("doc_id"), "signature")


@query("SELECT doc_id::VARCHAR AS id FROM documents ORDER BY doc_id LIMIT 100")
def truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.truncate(lm(spark, sf_dir), 100).select("id")


SHARES = {"en": 0.5, "fr": 0.25, "de": 0.25}


@query(Q.stratified(SHARES))
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.stratified_sample(lm(spark, sf_dir), SHARES, "lang").select("id")


@query(f"SELECT coalesce(lang, 'unknown') AS category, count(*) AS n FROM documents WHERE doc_id::VARCHAR IN (SELECT id FROM ({Q.stratified(SHARES)})) GROUP BY 1")
def stratified_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalize.stratified_sample(lm(spark, sf_dir), SHARES, "lang")
    return out.groupBy(gates.category_of("lang").alias("category")).agg(F.count("*").alias("n"))


@query("""
WITH n AS (SELECT doc_id::VARCHAR AS id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id::VARCHAR) - 1 AS k, count(*) OVER () AS total FROM documents)
SELECT id, CASE WHEN k < floor(total * 0.8) THEN 'train' WHEN k < floor(total * 0.8) + floor(total * 0.1) THEN 'val' ELSE 'test' END AS split FROM n
""")
def output_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.assign_splits(lm(spark, sf_dir), {"train": 0.8, "val": 0.1, "test": 0.1}).select("id", "split")


@query()
def pii_pseudonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacement by keyed hashes is beyond SQL; tested on planted data."""
    return pii.pseudonymize(lm(spark, sf_dir)).select("id", F.col("output").alias("text"))


@query(r"""
WITH d AS (SELECT doc_id::VARCHAR AS id, regexp_extract_all(text, '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b') AS found FROM documents)
SELECT id, len(found)::BIGINT AS n FROM d WHERE len(found) > 0
""")
def pii_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many addresses each document has replaced, from the record of the step."""
    done = pii.pseudonymize(lm(spark, sf_dir), ("EMAIL_ADDRESS",))
    notes = F.element_at("provenance_chain", -1)["notes"]
    return done.select("id", F.get_json_object(notes, "$.total_replacements").cast("long").alias("n")).where("n > 0")


PLANTED = {
    "EMAIL_ADDRESS": "write to ann{n}@site.org", "PHONE_NUMBER": "call 555-201-1234 now", "US_SSN": "number 123-45-6789 it is", "IP_ADDRESS": "from 192.168.0.9 then", "CREDIT_CARD": "paid by 4111 1111 1111 1111 there",
    "IBAN_CODE": "to GB82WEST12345698765432 today", "US_BANK_NUMBER": "into account 123456789 here", "PERSON": "said Dr. Anna Hartmann then", "LOCATION": "at 12 Baker Street again",
}


@query(f"WITH k(i, type) AS (VALUES {', '.join(f'({i}, {t!r})' for i, t in enumerate(PLANTED))}) SELECT doc_id::VARCHAR AS id, type, (1 + doc_id % 2)::INTEGER AS n FROM documents, k WHERE doc_id % 9 = i OR doc_id % 7 = i")
def pii_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type of personal data planted in sentences by the documents' ids, counted by type from the step's record."""
    parts = []
    for i, text in enumerate(PLANTED.values()):
        one = F.replace(F.lit(text), F.lit("{n}"), F.col("doc_id").cast("string"))
        both = F.when(F.col("doc_id") % 2 == 1, F.concat(one, F.lit("; once more "), one)).otherwise(one)
        parts.append(F.when((F.col("doc_id") % 9 == i) | (F.col("doc_id") % 7 == i), both))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(". ", *parts).alias("text"))
    done = pii.pseudonymize(S.as_samples(rows, "doc_id", "documents", id=F.col("doc_id").cast("string"), output="text", task_type=F.lit("language_modeling")))
    counts = F.from_json(F.get_json_object(F.element_at("provenance_chain", -1)["notes"], "$.entities_replaced"), "map<string,int>")
    return done.select("id", F.explode(counts).alias("type", "n"))


# similarity

NEAR = 0.4


def given_vectors(texts: list[str]) -> np.ndarray:
    """An embedder of texts that are lists of numbers."""
    return np.array([json.loads(t) for t in texts], np.float32)


def vector_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("numbers", F.to_json("embedding"))
    return S.as_samples(rows.withColumn("kind", F.col("label")), "vec_id", "embeddings", carried=("kind",), id=F.col("vec_id").cast("string"), output="numbers", task_type=F.lit("language_modeling"))


@query(Q.greedy(f"SELECT a.vec_id AS i, b.vec_id AS j FROM v a, v b WHERE a.vec_id < b.vec_id AND list_cosine_similarity(a.e, b.e) >= {NEAR}", "SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings"))
def diversity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an ordered scan accepts."""
    return embedding.diversity_gate(vector_samples(spark, sf_dir).drop("kind"), NEAR, given_vectors)[0].select(F.col("_seq").alias("vec_id"))


@query(f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a, v b WHERE a.vec_id < b.vec_id AND list_cosine_similarity(a.e, b.e) >= {NEAR}")
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.similar_pairs(vectors(spark, sf_dir).select("id", "vec"), NEAR).withColumn("similarity", F.round("similarity", 6))


_RUN = f"SELECT a.vec_id AS i, b.vec_id AS j FROM v a, v b WHERE a.vec_id < b.vec_id AND list_cosine_similarity(a.e, b.e) >= {NEAR}"
_FIRST_RUN = Q.greedy(_RUN, "SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE label < 5")


@query(Q.greedy(_RUN, f"""
SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings n WHERE label >= 5
AND NOT EXISTS (SELECT 1 FROM embeddings b WHERE b.vec_id IN ({_FIRST_RUN}) AND list_cosine_similarity(n.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {NEAR})
"""))
def cross_run_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as two runs of the deduplicator: what the first keeps is the index that the second is held against."""
    samples, index = vector_samples(spark, sf_dir), own_folder(spark, "index")
    embedding.embedding_dedup(samples.where("kind < 5").drop("kind"), index, NEAR, given_vectors)
    kept = embedding.embedding_dedup(samples.where("kind >= 5").drop("kind"), index, NEAR, given_vectors, append=False)
    return kept.select(F.col("_seq").alias("vec_id"))


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a, v b)
SELECT query_id, id, similarity, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s) WHERE rank <= 5
""")
def topk_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all vectors for every vector, itself included."""
    v = vectors(spark, sf_dir).select("id", "vec")
    return recovery.retrieve(v, v, 5)


@query("""
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, a.label = b.label AS same, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, b.vec_id) AS k FROM v a, v b WHERE a.vec_id <> b.vec_id)
SELECT count(*) AS n, sum(same::INT)::BIGINT AS correct, round(avg(same::INT), 6) AS accuracy FROM s WHERE k = 1
""")
def retrieval_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the nearest other vector has the label of the one asked for."""
    v = vectors(spark, sf_dir)
    own = v.select("id", "vec")
    others = recovery.retrieve(own, own, 2).where("query_id <> id")
    best = others.groupBy("query_id").agg(F.min_by("id", "rank").alias("id"))
    named = best.join(v.select(F.col("id").alias("query_id"), F.col("label").alias("want")), "query_id").join(v.select("id", "label"), "id")
    same = (F.col("want") == F.col("label")).cast("int")
    return named.agg(F.count("*").alias("n"), F.sum(same).alias("correct"), F.round(F.avg(same), 6).alias("accuracy"))


# ingest projections


#: Bytes of the tables that rows come from for each file that they are staged in.
SHARE = 1 << 25


def parts_of(rows: DataFrame) -> int:
    """How many files rows are staged in, and tasks that write them: by the size of their tables, three at least."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return max(3, min(-(-size // SHARE), 10_000))


def staged(spark: SparkSession, rows: DataFrame, kind: str, parts: int = 3) -> str:
    """The rows as several files of a format in the shared folder, for the readers to find; ``parts`` of JSON, else as many as
    the rows are large.
    """
    path = own_folder(spark, "source") + f".{kind}"
    spread = rows.repartition(parts_of(rows))
    if kind == "jsonl":
        spread.select(F.to_json(F.struct("*"))).write.text(path)
    elif kind == "csv":
        spread.write.csv(path, header=True, quote='"', escape='"', quoteAll=True)
    elif kind == "parquet":
        spread.write.parquet(path)
    else:  # each file is one document with a list in an envelope
        data = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).agg(F.to_json(F.struct(F.collect_list(F.struct(*rows.columns)).alias("data"))).alias("value"))
        for k in range(parts):
            data.where(F.col("part") == k).select("value").coalesce(1).write.mode("append").text(path)
    return path


def ingested(spark: SparkSession, rows: DataFrame, kind: str = "jsonl", **options: Any) -> DataFrame:
    return ingest(spark, Source(staged(spark, rows, kind), **options))[0]


def meta(name: str) -> Column:
    return F.get_json_object("metadata", f"$.{name}")


@query("SELECT doc_id::VARCHAR AS id, coalesce(text, '') AS output, lang, 'language_modeling' AS task_type FROM documents")
def read_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lines of JSON in several files, each line with an id of its own."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "lang")
    return ingested(spark, rows).select("id", "output", meta("lang").alias("lang"), "task_type")


@query("SELECT count(*) AS n, count(*) AS ids, count(*) AS places, count(*) AS line_numbers, 3::BIGINT AS files FROM documents")
def read_jsonl_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without ids in the rows: every row has an id and a place of its own, and lines are numbered from 1 in each file."""
    texts = table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("text"))
    whole = own_folder(spark, "source") + ".jsonl"
    joined(spark, staged(spark, texts, "jsonl"), whole, 3)
    rows = ingest(spark, Source(whole))[0]
    line = F.get_json_object(F.element_at("provenance_chain", 1)["notes"], "$.line_number").cast("int")
    return rows.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_distinct("_seq").alias("places"), F.count(line).alias("line_numbers"), F.count_if(line == 1).alias("files"))


@query(f"""
WITH t AS ({Q.TURNS}), s AS (SELECT conv_id, turns, CASE WHEN turns[1].role = 'system' THEN turns[1].content END AS system_prompt, CASE WHEN turns[1].role = 'system' THEN turns[2:] ELSE turns END AS talk FROM t)
SELECT conv_id::VARCHAR AS id, coalesce(list_filter(talk, lambda t: t.role = 'user')[1].content, '') AS instruction, coalesce(list_filter(talk, lambda t: t.role = 'assistant')[1].content, '') AS output, 'conversational' AS task_type,
  system_prompt, greatest(len(talk) - 2, 0)::INTEGER AS more_turns, 't' || conv_id AS topic FROM s
""")
def read_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of JSON with a list in an envelope, several files of them, detected and built."""
    return _built_talk(spark, sf_dir).select("id", "instruction", "output", "task_type", meta("system_prompt").alias("system_prompt"), F.coalesce(F.size(F.from_json(meta("turns"), "array<map<string,string>>")), F.lit(0)).alias("more_turns"), meta("topic").alias("topic"))


def _built_talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.transform("turns", lambda t: F.struct(F.initcap(t["role"]).alias("from"), t["content"].alias("value")))
    rows = S.turns_of(talk(spark, sf_dir)).select(F.col("conv_id").cast("string").alias("id"), named.alias("conversations"), F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("topic"))
    return ingested(spark, rows, "json")


@query("SELECT event_id::VARCHAR AS id, event_type AS instruction, json_extract_string(props, '$.k')::BIGINT AS k, 'instruction_following' AS task_type FROM events")
def read_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as CSV with a cell of JSON, several files with headers."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("instruction"), F.col("props").alias("output"))
    return ingested(spark, rows, "csv").select("id", "instruction", F.get_json_object("output", "$.k").cast("long").alias("k"), "task_type")


@query("SELECT coalesce(text, '') AS output, source, count(*) OVER () AS ids FROM documents")
def read_parquet_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without ids as several files of Parquet; ids and places are unique over all of them."""
    rows = ingested(spark, table(spark, sf_dir, "documents").select("text", "source"), "parquet")
    unique = rows.agg(F.least(F.count_distinct("id"), F.count_distinct("_seq")).alias("ids"))
    return rows.select("output", meta("source").alias("source")).crossJoin(F.broadcast(unique))


@query("SELECT CASE WHEN doc_id % 10 = 3 THEN 'json_decode_error' ELSE 'kept' END AS kind, count(*) AS n FROM documents GROUP BY 1")
def ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line is a sample or a reject with its reason: a tenth of them are cut off."""
    line = F.to_json(F.struct("text", "lang"))
    path = own_folder(spark, "source") + ".jsonl"
    rows = table(spark, sf_dir, "documents")
    rows.repartition(parts_of(rows)).select(F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("{"), line)).otherwise(line)).write.text(path)
    good, bad, _ = ingest(spark, Source(path))
    kinds = good.select(F.lit("kept").alias("kind")).union(bad.select(F.substring_index("rejection_reason", ":", 1)))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"))


_FIRST_PAIR = f"WITH t AS ({Q.TURNS}), s AS (SELECT conv_id, coalesce(list_filter(turns, lambda t: t.role = 'user')[1].content, '') AS instruction, coalesce(list_filter(turns, lambda t: t.role = 'assistant')[1].content, '') AS output FROM t)"


@query(f"{_FIRST_PAIR} SELECT conv_id::VARCHAR AS id, instruction, '' AS input, output, 'instruction_following' AS task_type FROM s")
def alpaca_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.samples_sft(talk(spark, sf_dir)).select("id", "instruction", "input", "output")
    return ingested(spark, rows).select("id", "instruction", "input", "output", "task_type")


@query(f"SELECT id, instruction, chosen, rejected, 'preference' AS task_type FROM ({Q.PREFERENCES})")
def preference_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.samples_pref(talk(spark, sf_dir)).select("id", F.col("instruction").alias("prompt"), "chosen", "rejected")
    return ingested(spark, rows).select("id", "instruction", "chosen", "rejected", "task_type")


@query(f"""
WITH t AS ({Q.TURNS}) SELECT a.conv_id::VARCHAR AS id, len(list_filter(range(1, least(len(a.turns), len(b.turns)) + 1), lambda i: a.turns[1:i] = b.turns[1:i]))::INTEGER AS n_shared, 'implicit_preference' AS task_type
FROM t a JOIN t b ON b.conv_id = a.conv_id - a.conv_id % 2
""")
def implicit_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation and its even neighbour as a pair, whose question is what both begin with."""
    t = S.turns_of(talk(spark, sf_dir))
    other = t.select(F.col("conv_id").alias("even"), F.col("turns").alias("rejected"))
    rows = t.join(other, F.col("even") == F.col("conv_id") - F.col("conv_id") % 2).select(F.col("conv_id").cast("string").alias("id"), F.col("turns").alias("chosen"), "rejected")
    shared = F.coalesce(F.size(F.from_json("instruction", "array<map<string,string>>")), F.lit(0))
    return ingested(spark, rows).select("id", F.when(F.col("instruction") == "", 0).otherwise(shared).alias("n_shared"), "task_type")


@query("SELECT d.doc_id::VARCHAR AS id, split_part(text, chr(10), 1) AS instruction, text AS output, quality::DOUBLE AS label, 'unpaired_preference' AS task_type FROM documents d JOIN labels l USING (doc_id)")
def unpaired_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.samples_unpaired(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("id", "instruction", "output", (F.col("label") > 0).alias("label"))
    return ingested(spark, rows).select("id", "instruction", "output", "label", "task_type")


@query(f"""
WITH t AS ({Q.TURNS}), s AS (SELECT conv_id, coalesce(list_filter(turns, lambda t: t.role = 'user')[1].content, '') AS instruction, list_transform(list_filter(turns, lambda t: t.role = 'assistant'), lambda t: t.content) AS answers FROM t)
SELECT conv_id::VARCHAR AS id, instruction, (k - 1)::INTEGER AS k, answers[k] AS response, round(length(answers[k]) / list_max(list_transform(answers, lambda x: length(x))), 6) AS reward FROM s, unnest(range(1, len(answers) + 1)) AS u(k)
""")
def grpo_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.samples_grpo(talk(spark, sf_dir)).select("id", F.col("instruction").alias("prompt"), "responses", F.col("reward_scores").alias("rewards"))
    each = ingested(spark, rows).select("id", "instruction", F.posexplode(F.arrays_zip("responses", "reward_scores")).alias("k", "r"))
    return each.select("id", "instruction", "k", F.col("r.responses").alias("response"), F.col("r.reward_scores").alias("reward"))


@query(f"{_FIRST_PAIR} SELECT conv_id::VARCHAR AS id, instruction, 'prompt_only' AS task_type FROM s")
def prompt_only_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.samples_sft(talk(spark, sf_dir)).select("id", F.col("instruction").alias("prompt"))
    return ingested(spark, rows).select("id", "instruction", "task_type")


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS i, role, text AS content FROM conversations")
def role_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of another layout and naming, by their canonical names again."""
    other = F.create_map(*(F.lit(x) for kv in {"user": " Human ", "assistant": "GPT", "system": "system_prompt"}.items() for x in kv))
    turns = F.transform("turns", lambda t: F.create_map(F.lit("from"), F.coalesce(other[t["role"]], t["role"]), F.lit("value"), t["content"]))
    return S.turns_of(talk(spark, sf_dir)).select("conv_id", F.posexplode(normalized_turns(turns)).alias("i", "t")).select("conv_id", "i", "t.role", "t.content")


@query(f"""
WITH t AS ({Q.TURNS}) SELECT a.conv_id, len(list_filter(range(1, least(len(a.turns), len(b.turns)) + 1), lambda i: a.turns[1:i] = b.turns[1:i]))::INTEGER AS n_shared
FROM t a JOIN t b ON b.conv_id = a.conv_id - a.conv_id % 2
""")
def implicit_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns that a conversation and its even neighbour begin with."""
    t = S.turns_of(talk(spark, sf_dir))
    other = t.select(F.col("conv_id").alias("even"), F.col("turns").alias("others"))
    return t.join(other, F.col("even") == F.col("conv_id") - F.col("conv_id") % 2).select("conv_id", F.size(common_prefix(F.col("turns"), F.col("others"))).alias("n_shared"))


@query("SELECT event_id, event_type AS instruction, json_extract_string(props, '$.k') AS output, len(['props', 'instruction', 'output'])::INTEGER AS n_cells FROM events")
def field_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain rename and a dotted path."""
    cells = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("props"), F.col("props"))
    rows = table(spark, sf_dir, "events").select("event_id", mapped(cells, {"event_type": "instruction", "props.k": "output"}).alias("cells"))
    return rows.select("event_id", F.col("cells")["instruction"].alias("instruction"), F.col("cells")["output"].alias("output"), F.size("cells").alias("n_cells"))


@query(f"SELECT 'documents' AS source_uri, doc_id AS item, {Q.n_tokens('text')}::INTEGER AS n_tokens FROM documents UNION ALL SELECT 'benchmark', item_id, {Q.n_tokens('text')}::INTEGER FROM benchmark")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source of JSON lines and one of Parquet, read as one after the other."""
    one = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    two = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text")
    samples, _ = ingest_all(spark, [Source(staged(spark, one, "jsonl"), source_uri="documents"), Source(staged(spark, two, "parquet"), source_uri="benchmark")])
    return samples.select("source_uri", F.col("id").cast("long").alias("item"), n_tokens("output").alias("n_tokens"))


# chunking


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")


@query(Q.fixed_chunks(512, 50))
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_chunks(_texts(spark, sf_dir), 512, 50)


@query(f"""
WITH c AS ({Q.fixed_chunks(200, 0)}), p AS (SELECT *, lag(text) OVER (PARTITION BY doc ORDER BY chunk_index) AS before FROM c)
SELECT doc, chunk_index, CASE WHEN before IS NULL THEN text ELSE array_to_string(string_split(before, ' ')[-20:], ' ') || ' ' || text END AS text FROM p
""")
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.with_overlap(chunking.fixed_chunks(_texts(spark, sf_dir), 200, 0), 20)


@query()
def chunk_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of pages; merging short ones is a fold, beyond SQL."""
    return chunking.chunk_blocks(chunking.blocks_of_pages(table(spark, sf_dir, "pages")), "heading", extract_tables=True)


@query()
def chunk_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_blocks(chunking.blocks_of_pages(table(spark, sf_dir, "pages")), "sentence")


# exports

_FIRSTS = f"WITH t AS ({Q.TURNS}), s AS (SELECT conv_id, coalesce(list_filter(turns, lambda t: t.role = 'user')[1].content, '') AS instruction, coalesce(list_filter(turns, lambda t: t.role = 'assistant')[1].content, '') AS output FROM t)"


def _read_back(samples: DataFrame, form: str, **fields: str) -> DataFrame:
    """The lines of an export, parsed again."""
    lines = sinks.export_lines(samples, form)
    parsed = F.from_json("value", ", ".join(f"{k} {t}" for k, t in fields.items()))
    return lines.select(F.col("_seq").alias("seq"), parsed.alias("x")).select("seq", "x.*")


@query(f"{_FIRSTS} SELECT conv_id AS seq, instruction, '' AS input, output FROM s")
def export_alpaca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(S.samples_sft(talk(spark, sf_dir)), "alpaca", instruction="string", input="string", output="string")


@query(f"""
WITH t AS ({Q.TURNS}), s AS (SELECT conv_id, CASE WHEN turns[1].role = 'system' THEN turns[2:] ELSE turns END AS talk FROM t),
r AS (SELECT conv_id, list_concat([struct_pack(role := 'user', content := coalesce(list_filter(talk, lambda t: t.role = 'user')[1].content, '')), struct_pack(role := 'assistant', content := coalesce(list_filter(talk, lambda t: t.role = 'assistant')[1].content, ''))], talk[3:]) AS turns FROM s)
SELECT conv_id AS seq, (k - 1)::INTEGER AS i, CASE turns[k].role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE turns[k].role END AS sender, turns[k].content AS value FROM r, unnest(range(1, len(turns) + 1)) AS u(k)
""")
def export_sharegpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that were read, exported again: question, answer, and the further turns that the metadata have."""
    rows = _built_talk(spark, sf_dir).withColumn("_seq", F.col("id").cast("long"))
    turns = _read_back(rows, "sharegpt", conversations="array<struct<`from`:string,value:string>>").select("seq", F.posexplode("conversations").alias("i", "t"))
    return turns.select("seq", "i", F.col("t.from").alias("sender"), F.col("t.value").alias("value"))


@query(f"SELECT id::BIGINT AS seq, instruction AS prompt, chosen, rejected FROM ({Q.PREFERENCES}) WHERE {Q.strip('chosen')} <> '' AND {Q.strip('rejected')} <> ''")
def export_dpo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(S.samples_pref(talk(spark, sf_dir)), "dpo", prompt="string", chosen="string", rejected="string")


@query(f"""
WITH t AS ({Q.TURNS}), s AS (SELECT conv_id, coalesce(list_filter(turns, lambda t: t.role = 'user')[1].content, '') AS prompt, list_transform(list_filter(turns, lambda t: t.role = 'assistant'), lambda t: t.content) AS answers FROM t)
SELECT conv_id AS seq, prompt, (k - 1)::INTEGER AS k, answers[k] AS response, round(length(answers[k]) / list_max(list_transform(answers, lambda x: length(x))), 6) AS reward FROM s, unnest(range(1, len(answers) + 1)) AS u(k)
""")
def export_grpo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read_back(S.samples_grpo(talk(spark, sf_dir)), "grpo", prompt="string", responses="array<string>", rewards="array<double>")
    return rows.select("seq", "prompt", F.posexplode(F.arrays_zip("responses", "rewards")).alias("k", "r")).select("seq", "prompt", "k", F.col("r.responses").alias("response"), F.col("r.rewards").alias("reward"))


@query(f"{_FIRSTS} SELECT conv_id AS seq, instruction AS prompt FROM s")
def export_ppo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(S.samples_sft(talk(spark, sf_dir)), "ppo", prompt="string")


@query("SELECT doc_id AS seq, text, '' AS source_file, 'documents' AS source_uri, NULL::INTEGER AS page, NULL::VARCHAR AS heading, NULL::INTEGER AS chunk_index, 'text' AS content_type, 'language_modeling' AS task_type, '' AS table_html FROM documents WHERE text <> ''")
def export_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"text": "string", "source_file": "string", "source_uri": "string", "page": "int", "heading": "string", "chunk_index": "int", "content_type": "string", "task_type": "string", "table_html": "string"}
    return _read_back(lm(spark, sf_dir), "corpus", **fields)


# generation and recovery, by the deterministic stand-in model


def questions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return generate.generate(lm(spark, sf_dir), generate.QAGeneration(FakeLLM()))


@query()
def qa_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir)[0].select("id", "instruction", "output", "task_type")


def _generated(task: Callable[[], generate.Task]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return generate.generate(S.samples_sft(talk(spark, sf_dir)), task())[0].select("id", "instruction", "output", "chosen", "rejected", "responses", "task_type")

    return run


for _name, _task in {
    "preference_generate": lambda: generate.PreferenceGeneration(FakeLLM()),
    "grpo_rollout": lambda: generate.GRPORollout(FakeLLM(), score_responses=True),
    "multiturn_generate": lambda: generate.MultiTurn(FakeLLM()),
    "evol_instruct": lambda: generate.EvolInstruct(FakeLLM(), num_evolutions=2),
    "chain_of_thought": lambda: generate.ChainOfThought(FakeLLM()),
    "adversarial_preference": lambda: generate.AdversarialPreference(FakeLLM()),
    "adversarial_qa": lambda: generate.AdversarialQAGeneration(FakeLLM()),
}.items():
    _run = _generated(_task)
    _run.__name__ = _name
    query()(_run)


@query()
def page_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to chunks to questions, in order of page and chunk."""
    return generate.generate(page_chunks(spark, sf_dir), generate.QAGeneration(FakeLLM()))[0].select(F.col("_seq").alias("seq"), "source_uri", "instruction", "output", "task_type")


@query()
def multi_passage_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions over each chunk and the next one of its page."""
    return generate.generate_multi_passage(page_chunks(spark, sf_dir), generate.QAGeneration(FakeLLM()))[0].select(F.col("_seq").alias("seq"), "source_uri", "instruction", "output")


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_blocks(chunking.blocks_of_pages(table(spark, sf_dir, "pages")), "sentence", max_tokens=200)
    return chunking.chunk_samples(chunks, "sentence")[0]


@query(f"SELECT CASE WHEN pick THEN 'injected' ELSE 'clean' END AS kind, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY conv_id) <= greatest(1, round_even(count(*) OVER () * 0.2, 0)) AS pick FROM ({_FIRSTS} SELECT conv_id FROM s WHERE instruction <> '' AND output <> '')) GROUP BY 1")
def injected_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the conversations get wrong answers, to the row."""
    rows = S.samples_sft(talk(spark, sf_dir)).where("instruction <> '' AND output <> ''")
    out = generate.BadSampleInjector(FakeLLM()).inject(rows, 0.2)
    return out.groupBy(F.when(meta("injected_failure") == "true", "injected").otherwise("clean").alias("kind")).agg(F.count("*").alias("n"))


@query()
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.token_stats(questions(spark, sf_dir)[0])


def probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    judge = judges.GroundingJudge(FakeLLM(), 0.3)
    _, rejected = judges.judge_gate(grounded_samples(spark, sf_dir), judge)
    return recovery.probe_rejected(rejected, recovery.DiagnosticProbe(FakeLLM(), judge))[1]


@query()
def probe_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.mode_counts(probed(spark, sf_dir))


@query()
def probe_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that a judge refused and a probe's route recovered, with that route."""
    judge = judges.GroundingJudge(FakeLLM(), 0.3)
    _, rejected = judges.judge_gate(grounded_samples(spark, sf_dir), judge)
    made, _ = recovery.probe_rejected(rejected, recovery.DiagnosticProbe(FakeLLM(), judge))
    route = F.get_json_object(F.element_at("provenance_chain", -1)["notes"], "$.probe_path")
    return made.select("id", "output", route.alias("route"))


@query()
def refine_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of answers, which the reward judge refuses, after one rewrite each: recovered or still refused."""
    judge = judges.RewardJudge(FakeLLM(), 0.7)
    short = F.array_join(F.slice(F.split("output", " "), 1, 10), " ")
    _, rejected = judges.judge_gate(S.samples_sft(talk(spark, sf_dir)).withColumn("input", F.col("output")).withColumn("output", short), judge)
    again, still = recovery.RewardRefiner(FakeLLM(), judge).refine(rejected)
    return again.select("id", "output", F.lit(True).alias("recovered")).union(still.select("id", "output", F.lit(False)))


@query(f"SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 2 = 0 THEN 'source_ambiguous' ELSE 'unknown' END AS mode FROM documents")
def exhausted_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode of rejects that no probe helped, by whether a judge's record names claims."""
    rows = lm(spark, sf_dir)
    notes = F.when(F.col("_seq") % 2 == 0, F.lit('{"unsupported_claims": ["x"]}')).otherwise("{}")
    return S.with_provenance(rows, "HallucinationGate", notes).select("id", recovery.exhausted_mode().alias("mode"))


@query(Q.SWEEPS)
def sweep_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sweeps of up to three temperatures show, their outcomes by the customer's key."""
    bits = F.array(*(F.col("k").bitwiseAND(F.lit(b)) == b for b in (1, 2, 4)))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), (F.col("c_custkey") % 8).cast("int").alias("k"))
    return rows.select("c_custkey", recovery.sweep_mode(bits).alias("mode"))


MODES = recovery.MODES


def diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as diagnosed rejects: mode by id, recovered if the id divides by 3."""
    mode = F.element_at(F.array(*map(F.lit, MODES)), (F.col("_seq") % len(MODES)).cast("int") + 1)
    made = F.struct(mode.alias("mode"), (F.col("_seq") % 3 == 0).alias("was_recovered"), F.array(F.lit(False)).alias("evidence"), (F.col("_seq") % 6).cast("int").alias("probe_calls"), F.lit("{}").alias("notes"))
    return lm(spark, sf_dir).withColumns({"rejection_reason": F.lit("r"), "rejecting_step": F.lit("s"), "diagnosis": made})


_MODE = f"[{', '.join(repr(m) for m in MODES)}][doc_id % {len(MODES)} + 1]"


@query(f"SELECT {_MODE} AS mode, count(*) AS n, sum((doc_id % 3 = 0)::INT)::BIGINT AS recovered, sum(doc_id % 6)::BIGINT AS probe_calls FROM documents GROUP BY 1")
def diagnostic_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.mode_counts(diagnosed(spark, sf_dir))


@query(f"""
SELECT {_MODE} AS mode, count(*) AS attempted, sum((doc_id % 3 = 0)::INT)::BIGINT AS converted, round(sum((doc_id % 3 = 0)::INT) / count(*), 4) AS rate FROM documents
WHERE {_MODE} NOT IN ({", ".join(map(repr, recovery.HOPELESS))}) GROUP BY 1
""")
def pass2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diagnosed(spark, sf_dir)
    helped = rows.where(F.col("diagnosis.was_recovered") & ~F.col("diagnosis.mode").isin(*recovery.HOPELESS))
    return recovery.pass2_rates(rows, helped)


@query(Q.injections(generate.ALL_INJECTIONS))
def injection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the documents as injected, by kinds; those of under 200 words as rejected."""
    names = F.array(*map(F.lit, generate.ALL_INJECTIONS))
    meta = F.when(F.col("_seq") % 5 == 0, F.to_json(F.struct(F.lit(True).alias("injected_failure"), F.element_at(names, (F.col("_seq") % len(generate.ALL_INJECTIONS)).cast("int") + 1).alias("injection_type")))).otherwise("{}")
    rows = lm(spark, sf_dir).withColumn("metadata", meta)
    return recovery.injection_report(rows, rows.where(n_tokens("output") < 200))


@query(f"{Q.SCHEMA_CTE}, g AS (SELECT * FROM gated WHERE rejection_reason IS NULL), e AS (SELECT count(DISTINCT sha256({Q.squeezed('lower(text)')})) AS k FROM g) SELECT 'SchemaGate' AS stage, (SELECT count(*) FROM gated) AS input_count, (SELECT count(*) FROM g) AS output_count UNION ALL SELECT 'ExactDeduplicator', (SELECT count(*) FROM g), (SELECT k FROM e) UNION ALL SELECT 'TextCleaner', (SELECT k FROM e), (SELECT k FROM e)")
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows into and out of each step of a planned run."""
    from loomsift.plans.runner import Runner, RunConfig

    samples = checkpointed(lm(spark, sf_dir))
    none = samples.where("false").withColumns({"rejection_reason": F.lit(""), "rejecting_step": F.lit(""), "diagnosis": F.lit(None).cast(S.DIAGNOSIS)})
    counts = Runner(RunConfig(), spark).steps(samples, none).stage_counts
    return spark.createDataFrame([(k, v["input_count"], v["output_count"]) for k, v in counts.items()], "stage string, input_count long, output_count long")


# streaming


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS category, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by a stream over the events, all that are there."""
    folder = own_folder(spark, "stream")
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events[.]parquet")  # a glob, for a table may be one file

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    run = windowed_counts(stream, "ts", "event_type").writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/out").withColumn("start", F.col("start").cast("timestamp_ntz"))
