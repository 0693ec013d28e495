import pytest
from pyspark.sql import functions as F

from loomsift.functions import samples as S
from loomsift.functions import text as T
from loomsift.operators import gates, judges
from loomsift.operators.models import FakeLLM

WORDS = "one two three four five six seven eight nine ten"


def sample(spark, rows, **kinds):
    """Samples of dicts by field."""
    names = sorted({k for r in rows for k in r} | {"_n"})
    types = {"responses": "array<string>", "reward_scores": "array<double>", "label": "double", "_n": "long"}
    data = [tuple({**r, "_n": i}.get(n) for n in names) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, ", ".join(f"{n} {types.get(n, 'string')}" for n in names))
    return S.as_samples(df, "_n", **{n: F.coalesce(n, S.default(n)) for n in names if n != "_n"}, **({} if "id" in names else {"id": F.col("_n").cast("string")}))


def reasons(spark, rows, **options):
    df = sample(spark, rows).withColumn("r", gates.schema_reason(**options))
    return [r.r for r in df.orderBy("_seq").collect()]


@pytest.mark.parametrize(
    ("row", "options", "reason"),
    [
        ({"instruction": "q", "output": WORDS}, {}, None),
        ({"instruction": "Hi", "output": "Hello!"}, {}, "below_min_tokens:2"),
        ({"instruction": "   ", "output": WORDS}, {}, "missing_field:instruction"),
        ({"instruction": "q", "output": ""}, {}, "missing_field:output"),
        ({"instruction": "q", "output": WORDS + "\0"}, {}, "encoding_error:null_byte_in_output"),
        ({"instruction": "q", "output": WORDS}, {"max_tokens": 10}, "above_max_tokens:11"),
        ({"instruction": "one", "output": "two"}, {"min_tokens": 2}, None),
        ({"instruction": "q", "chosen": WORDS, "task_type": "preference"}, {}, "missing_field:rejected"),
        ({"instruction": "q", "chosen": "a", "rejected": WORDS, "task_type": "preference"}, {}, None),
        ({"instruction": "q", "task_type": "grpo"}, {}, "missing_field:responses"),
        ({"instruction": "q", "responses": ["x", WORDS], "task_type": "grpo"}, {}, None),
        ({"output": WORDS, "task_type": "language_modeling"}, {}, None),
        ({"instruction": WORDS, "task_type": "prompt_only"}, {}, None),
        ({"input": WORDS, "task_type": "source_chunk"}, {}, None),
        ({"output": WORDS, "task_type": "language_modeling"}, {"task_types": ("grpo",)}, "task_type_not_allowed:language_modeling"),
        ({"output": WORDS}, {"required": ("output",)}, None),
        ({"output": WORDS}, {"required": ("label",)}, "missing_field:label"),
    ],
)
def test_schema_reason(spark, row, options, reason):
    assert reasons(spark, [row], **options) == [reason]


def test_every_row_passes_or_is_rejected(spark, sf):
    df = S.samples_lm(spark.read.parquet(f"{sf}/documents.parquet"))
    passed, rejected = gates.schema_gate(df)
    assert passed.count() + rejected.count() == df.count()
    assert rejected.where("rejection_reason IS NULL OR rejecting_step <> 'SchemaGate'").count() == 0
    assert {r.s for r in passed.select(F.col("provenance_chain")[0]["step_name"].alias("s")).distinct().collect()} == {"SchemaGate"}


def test_secrets(spark):
    key = "AKIA" + "A1B2C3D4E5F6G7H8"
    rows = [
        {"instruction": "q", "output": f"the key {key} is here"},
        {"instruction": "q", "output": f"x{key}"},
        {"instruction": "q", "responses": ["fine", "-----BEGIN RSA PRIVATE KEY-----"], "task_type": "grpo"},
        {"instruction": "q", "output": "eyJhbGciOiJI.eyJzdWIiOiIx.c2ln and '0123456789abcdef0123'"},
        {"instruction": "q", "output": "nothing, 'aaaaaaaaaaaa'"},
        {"input": f"{key}", "output": "x", "task_type": "source_chunk"},
    ]
    passed, rejected = gates.secrets_gate(sample(spark, rows))
    got = {r.id: r.rejection_reason for r in rejected.collect()}
    assert got == {"0": "secret_detected:AWSKeyDetector", "2": "secret_detected:PrivateKeyDetector", "3": "secret_detected:HexHighEntropyString,JwtTokenDetector", "5": "secret_detected:AWSKeyDetector"}
    notes = rejected.where("id = '2'").select(F.col("provenance_chain")[0]["notes"].alias("n")).first().n
    assert "responses[1]" in notes and "BEGIN" not in notes
    fields = gates.secrets_found(sample(spark, rows).where("id = '2'")).first().findings
    assert [(f.field, f.type) for f in fields] == [("responses[1]", "PrivateKeyDetector")]
    quiet = sample(spark, [{"instruction": "q", "output": "password = 'hunter22'"}])
    assert gates.secrets_gate(quiet)[1].count() == 0
    assert gates.secrets_gate(quiet, code_corpus_mode=True)[1].count() == 1


def test_toxicity_bands(spark):
    rows = [{"instruction": "q", "output": "kind words"}, {"instruction": "q", "output": "idiot moron scum trash"}, {"instruction": "q", "output": "an idiot"}, {"instruction": "q", "output": "such trash"}, {"output": " "}]
    passed, rejected = judges.toxicity_gate(sample(spark, rows))
    assert {r.id: r.rejection_reason for r in rejected.collect()} == {"1": "toxic_content:classifier:1.000", "2": "toxic_content:classifier:0.250", "3": "toxic_content:classifier:0.250"}
    _, rejected = judges.toxicity_gate(sample(spark, rows), llm=FakeLLM())
    assert {r.id: r.rejection_reason for r in rejected.collect()} == {"1": "toxic_content:classifier:1.000", "2": "toxic_content:llm_judge:0.900"}
    with pytest.raises(ValueError, match="under"):
        judges.toxicity_gate(sample(spark, rows), 0.5, 0.5)


def test_toxicity_of_whole_texts(spark):
    rows = [{"output": "kind " * 500 + "idiot moron scum trash"}, {"output": "kind " * 500 + "an idiot"}, {"output": "kind " * 500 + "such trash"}]
    _, rejected = judges.toxicity_gate(sample(spark, rows), llm=FakeLLM())
    assert {r.id: r.rejection_reason for r in rejected.collect()} == {"0": "toxic_content:classifier:1.000", "1": "toxic_content:llm_judge:0.900"}
    first = lambda texts: [float("scum" in t[:100]) for t in texts]
    rows = [{"output": "kind " * 500 + "scum"}, {"output": "kind " * 500}]
    _, rejected = judges.toxicity_gate(sample(spark, rows), scorer=first, window=100)
    assert [r.id for r in rejected.collect()] == ["0"]


def test_windows_cover_a_text():
    for n in (0, 1, 99, 100, 101, 174, 175, 176, 1000):
        text = "".join(chr(0x4E00 + i) for i in range(n))
        parts = judges.windows(text, 100)
        assert max(map(len, parts)) <= 100 and text.startswith(parts[0]) and text.endswith(parts[-1])
        assert all(b[0] in a for a, b in zip(parts, parts[1:], strict=False))
        assert judges.windows(text, None) == [text]


def broken():
    class Broken(FakeLLM):  # local, so that it is sent to the workers by value
        def answer(self, task, prompt, temperature):
            raise RuntimeError("down")

    return Broken()


def test_judges_fail_open_and_toxicity_closed(spark):
    rows = [{"instruction": "q", "input": "x" * 60, "output": "an idiot"}]
    df = sample(spark, rows)
    assert judges.hallucination_gate(df, broken())[0].count() == 1
    assert judges.reward_gate(df, broken())[0].count() == 1
    assert judges.toxicity_gate(df, llm=broken())[1].first().rejection_reason == "toxic_content:llm_judge:1.000"


def test_hallucination(spark):
    source = "The tower was finished in the year of the great flood, by three masons and a boy."
    rows = [
        {"instruction": "q", "input": source, "output": "finished by three masons"},
        {"instruction": "q", "input": source, "output": "nobody ever knew anything about that"},
        {"instruction": "q", "input": "short", "output": "x"},
        {"instruction": "q", "output": "three masons", "metadata": '{"source_chunk": "' + source + '"}'},
    ]
    passed, rejected = judges.hallucination_gate(sample(spark, rows), FakeLLM())
    assert sorted((r.id, r.label) for r in passed.collect()) == [("0", 1.0), ("2", None), ("3", 1.0)]
    assert rejected.first().rejection_reason == "hallucination_contract_failed:0.00"
    _, rejected = judges.hallucination_gate(sample(spark, rows), FakeLLM(), skip_if_no_context=False)
    assert {r.id: r.rejection_reason for r in rejected.collect()}["2"] == "hallucination_gate:no_source_context"


def test_reward_pairs_and_answers(spark):
    long, short = "w " * 20, "w " * 10
    rows = [
        {"instruction": "q", "chosen": long, "rejected": short, "task_type": "preference"},
        {"instruction": "q", "chosen": short, "rejected": long, "task_type": "preference"},
        {"instruction": "q", "chosen": long, "rejected": long, "task_type": "preference"},
        {"instruction": "q", "output": short},
    ]
    passed, rejected = judges.reward_gate(sample(spark, rows), FakeLLM())
    assert [(r.id, r.label) for r in passed.collect()] == [("0", 1.0)]
    assert {r.id: r.rejection_reason for r in rejected.collect()} == {"1": "dpo_pair_failed:chosen_below_threshold:0.50", "2": "dpo_pair_failed:rejected_above_threshold:1.00", "3": "below_reward_threshold:0.50"}


@pytest.mark.parametrize(("text", "score"), [('{"s": 0.4}', 0.4), ("```json\n{\"s\": 3}\n```", 1.0), ("7/10", 0.7), ("0.9 of 12 claims", 0.9), ("none", 0.5)])
def test_score_in(text, score):
    assert judges.score_in(text, "s")[0] == score


def test_resolvers(spark):
    rows = [
        {"instruction": "i", "chosen": "c", "rejected": "r", "task_type": "preference"},
        {"instruction": "i", "responses": ["a", "b"], "reward_scores": [0.1, 0.9], "task_type": "grpo"},
        {"output": "o", "instruction": "i", "task_type": "language_modeling"},
        {"output": "o", "instruction": "i"},
    ]
    df = sample(spark, rows).orderBy("_seq").select(T.dedup_text().alias("d"), T.embedding_text().alias("e"), T.answer_to_judge().alias("a"), T.primary_text().alias("p"))
    assert [tuple(r) for r in df.collect()] == [("icr", "i c", "c", "i c"), ("iab", "i a", "b", "i a"), ("o", "o", "o", "o"), ("io", "i o", "o", "i o")]


def test_tokens_are_pythons(spark):
    texts = ["a b", "a\x1cb c", " ", "", "a​b", "é　ü"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.n_tokens("t").alias("n"), T.strip("t").alias("s"))
    assert all(r.n == len(r.t.split()) and r.s == r.t.strip() for r in df.collect())


def test_coverage(spark):
    df = spark.createDataFrame([("a",)] * 96 + [("b",)] * 3 + [(None,)], "c string")
    assert {r.category: r.is_gap for r in gates.coverage_gaps(df, "c").collect()} == {"a": False, "b": True, "unknown": True}


@pytest.mark.parametrize(("known", "words", "score"), [(7, 40, 0.18), (9, 40, 0.22), (3, 200, 0.02), (57, 200, 0.28), (1, 3, 0.33)])
def test_grounding_rounds_halves_to_even(known, words, score):
    answer = " ".join(f"w{k}" for k in range(words))
    context = " ".join(f"w{k}" for k in range(known)) + " and so on, " * 10
    reason, found, _ = judges.GroundingJudge(FakeLLM(), 0.9)(context, answer)
    assert (reason, found) == (f"hallucination_contract_failed:{score:.2f}", score)
