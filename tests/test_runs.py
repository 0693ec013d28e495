import json
import warnings

import pytest
from pyspark.sql import functions as F
from test_gates import sample

from loomsift.cli import main
from loomsift.operators import chunking, generate, recovery, sinks
from loomsift.operators.judges import GroundingJudge, RewardJudge, judge_gate
from loomsift.operators.models import FakeLLM, json_of, without_thinking
from loomsift.plans.runner import Runner, RunConfig, described
from loomsift.streaming import ingest as streams

LONG = "The {} was measured in several places, by several people, over the whole of a long and dry summer."


def messy(path):
    rows = [{"instruction": f"What about {i}?", "input": "", "output": LONG.format(f"river {i}")} for i in range(6)]
    rows += [{"instruction": "What is html?", "input": "", "output": "<p>" + LONG.format("<b>page</b>") + "</p>"}, {"instruction": "Spaces?", "input": "", "output": LONG.format("gap").replace(" ", "  ")}]
    rows += [rows[0], {**rows[1], "instruction": rows[1]["instruction"].upper()}]
    rows += [{"instruction": "Nothing here?", "input": "", "output": ""}, {"instruction": "Hi", "input": "", "output": "Hello!"}, {"instruction": "  ", "input": "", "output": LONG}, {"instruction": "Null?", "input": "", "output": LONG + "\0"}]
    path.write_text("".join(json.dumps(r) + "\n" for r in rows) + '{"instruction": "cut of\n')
    return str(path)


def test_a_whole_run(spark, tmp_path):
    out = tmp_path / "out"
    result = Runner(RunConfig(dataset=messy(tmp_path / "seed.jsonl"), output_dir=out, export_formats=["alpaca", "sharegpt"], single_file=True), spark).run()
    counts = {k.split(":")[0]: v for k, v in result.stage_counts.items()}
    assert counts["Source0"] == {"output_count": 14, "rejected_count": 1}
    assert counts["SchemaGate"] == {"input_count": 14, "output_count": 10, "probe_recovered": 0, "rejected_count": 4}
    assert counts["ExactDeduplicator"] == {"input_count": 10, "output_count": 8} and counts["TextCleaner"]["output_count"] == 8
    assert result.exported == {"alpaca": 8, "sharegpt": 8}
    lines = [json.loads(x) for x in (out / "sft_alpaca.jsonl").read_text().splitlines()]
    assert len(lines) == 8 and lines[6]["output"] == LONG.format("page") and lines[7]["output"] == LONG.format("gap")
    chat = json.loads((out / "sft_sharegpt.jsonl").read_text().splitlines()[0])
    assert [t["from"] for t in chat["conversations"]] == ["human", "gpt"]
    reasons = sorted(json.loads(x)["rejection_reason"].split(":")[0] for x in (out / "rejected.jsonl").read_text().splitlines())
    assert reasons == ["below_min_tokens", "encoding_error", "json_decode_error", "missing_field", "missing_field"]
    manifest = json.loads((out / "manifest.json").read_text())
    assert manifest["dedup_stats"]["ExactDeduplicator"]["removed"] == 2 and len(manifest["rejected_breakdown"]) == 5
    assert {x.split("  ")[1] for x in (out / "checksums.txt").read_text().splitlines()} >= {"manifest.json", "dataset_card.md", "rejected.jsonl", "sft_alpaca.jsonl"}


def test_command_line(spark, tmp_path, capsys):
    seed = messy(tmp_path / "seed.jsonl")
    (tmp_path / "c.yaml").write_text(f"dataset: {seed}\ndedup: minhash\noutput_split: {{train: 0.5, test: 0.5}}\nexport_formats: [alpaca]\n")
    assert main(["run", str(tmp_path / "c.yaml"), "--dry-run"]) == 0 and "gate SchemaGate" in capsys.readouterr().out
    assert main(["run", str(tmp_path / "c.yaml"), "-o", str(tmp_path / "o")]) == 0
    assert (tmp_path / "o" / "train" / "sft_alpaca.jsonl").exists() and (tmp_path / "o" / "test" / "sft_alpaca.jsonl").exists()
    (tmp_path / "bad.yaml").write_text("colour: red\n")
    assert main(["run", str(tmp_path / "bad.yaml")]) == 2


def test_stages_are_taken_up_again(spark, tmp_path):
    config = RunConfig(dataset=messy(tmp_path / "seed.jsonl"), output_dir=tmp_path / "o", enable_checkpoint=True, export_formats=[])
    first = Runner(config, spark).run()
    made = sorted((tmp_path / "o" / "checkpoints").rglob("_SUCCESS"))
    stamps = [p.stat().st_mtime_ns for p in made]
    second = Runner(config, spark).run()
    assert made and [p.stat().st_mtime_ns for p in made] == stamps
    assert first.rejected.count() == second.rejected.count() == 5 and second.passed.count() == 8


def test_plan_order():
    c = RunConfig(dataset="x.jsonl", dedup="minhash", secrets_gate=True, pii_pseudonymize=True, toxicity_gate=True, llm_model="fake", generation_task="qa", hallucination_threshold=0.5, reward_threshold=0.5, diversity_threshold=0.9, embedding_dedup=True, resample=True, target_distribution={"a": 1.0}, max_samples=5)
    names = [x.split()[1] for x in described(c)[1:-3]]
    assert names == ["SchemaGate", "ExactDeduplicator", "MinHashDeduplicator", "TextCleaner", "SecretsGate", "PIIPseudonymizer", "ToxicityGate", "QAGeneration", "HallucinationGate", "RewardGate", "DiversityGate", "EmbeddingDeduplicator", "StratifiedSampler", "MaxSamplesTruncator"]
    with pytest.raises(ValueError, match="unknown generation"):
        RunConfig(generation_task="nonsense")
    with pytest.raises(ValueError, match="model"):
        RunConfig(dataset="x", generation_task="qa").task()


def test_generated_and_judged_run(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text("".join(json.dumps({"text": LONG.format(f"lake {i}")}) + "\n" for i in range(4)))
    c = RunConfig(dataset=str(tmp_path / "t.jsonl"), output_dir=tmp_path / "o", llm_model="fake", generation_task="qa", num_questions=2, hallucination_threshold=0.7, reward_threshold=0.5, enable_diagnostic_probe=True, enable_reward_refiner=True, diversity_threshold=0.999)
    result = Runner(c, spark).run()
    assert result.stage_counts["QAGeneration"] == {"input_count": 4, "output_count": 8, "rejected_count": 0}
    assert result.stage_counts["HallucinationGate"]["output_count"] == 8
    assert result.manifest["token_stats"]["QAGeneration"]["calls"] >= 4 and (tmp_path / "o" / "diagnostic_summary.json").exists()


def rejects(spark, rows, reason="r"):
    return sample(spark, rows).withColumns({"rejection_reason": F.lit(reason), "rejecting_step": F.lit("s"), "diagnosis": F.lit(None).cast("struct<mode:string,was_recovered:boolean,evidence:array<boolean>,probe_calls:int,notes:string>")})


def scripted(wanted):
    class Say(FakeLLM):
        def generate(self, messages, temperature=None, max_tokens=None, stop=None):
            text = messages[-1]["content"]
            kind = "question" if "[task]\nrewrite" in text else "strict" if "word for word" in text else "domain" if "expert" in text else f"t{temperature}"
            return self.call_reply(kind)

        def call_reply(self, kind):
            from loomsift.operators.models import Reply

            return Reply(kind)

    class Judge:
        threshold, step = 0.5, "HallucinationGate"

        def row(self, r):
            ok = r["_answer"] in wanted or r["instruction"] in wanted
            return (None if ok else "no"), 0.9 if ok else 0.1, {}

    return Say(), Judge()


@pytest.mark.parametrize(
    ("wanted", "mode", "calls"),
    [(("t0.3", "t0.5"), "threshold_marginal", 2), (("t0.3",), "generator_temperature", 2), (("t0.5",), "threshold_marginal", 2), (("strict",), "generator_parametric", 3), (("domain",), "domain_mismatch", 4), (("question",), "instruction_quality", 5), ((), "unknown", 5)],
)
def test_probe(spark, wanted, mode, calls):
    llm, judge = scripted(wanted)
    probe = recovery.DiagnosticProbe(llm, judge)
    row = {"id": "1", "instruction": "q", "input": "source", "output": "o", "chosen": "", "label": None, "metadata": "{}", "provenance_chain": [], "rejection_reason": "x", "task_type": "instruction_following"}
    said, made = probe.diagnose(row)
    assert (said["mode"], said["probe_calls"], made is not None) == (mode, calls, bool(wanted))
    low = row | {"provenance_chain": [{"notes": '{"grounding_score": 0.1, "unsupported_claims": []}'}]}
    said, _ = probe.diagnose(low)
    assert said["probe_calls"] == (1 if wanted == ("strict",) else calls + (mode not in ("domain_mismatch", "instruction_quality", "unknown", "generator_parametric")))
    if not wanted:
        assert said["mode"] == "source_ambiguous"
    assert probe.diagnose(row | {"rejection_reason": "dpo_pair_failed:rejected_above_threshold:0.9"})[0]["mode"] == "response_quality"
    assert probe.diagnose(row | {"input": " "})[0]["probe_calls"] == 0


def test_probe_frames(spark):
    source = LONG.format("sea") + " Nobody doubted it."
    df = sample(spark, [{"instruction": "q", "input": source, "output": "nothing known"}, {"instruction": "q", "input": source, "output": LONG.format("sea")}])
    judge = GroundingJudge(FakeLLM())
    passed, rejected = judge_gate(df, judge)
    again, diagnosed = recovery.probe_rejected(rejected, recovery.DiagnosticProbe(FakeLLM(), judge))
    assert again.count() == 1 and diagnosed.first().diagnosis.mode in recovery.MODES
    both = recovery.with_recovered(passed, again).orderBy("_seq").collect()
    assert len(both) == 2 and both[-1].provenance_chain[-1].step_name == "DiagnosticProbe" and both[-1].id != "0"
    summary = recovery.diagnostic_summary(diagnosed)
    assert summary["total_diagnosed"] == summary["probe_recovered"] == 1 and summary["probe_recovery_pct"] == 1.0


def test_refiner(spark):
    source = "w " * 40
    df = sample(spark, [{"instruction": "q", "input": source, "output": "short"}])
    judge = RewardJudge(FakeLLM(), 0.7)
    _, rejected = judge_gate(df, judge)
    assert rejected.select(recovery.weakest_dimension().alias("w")).first().w == "instruction_following"
    better, still = recovery.RewardRefiner(FakeLLM(), judge).refine(rejected)
    row = better.first()
    assert still.count() == 0 and json.loads(row.metadata)["refinement_axis"] == "instruction_following" and row.label >= 0.7
    fine = rejects(spark, [{"instruction": "q"}], "dpo_pair_failed:rejected_above_threshold:0.90")
    assert recovery.RewardRefiner(FakeLLM(), judge).refine(fine)[1].count() == 1


def test_second_pass(spark, tmp_path):
    source = LONG.format("hill")
    rows = rejects(spark, [{"instruction": "q", "input": source} for _ in range(4)])
    modes = F.element_at(F.array(*map(F.lit, ("generator_temperature", "generator_temperature", "unknown", "domain_mismatch"))), (F.col("_seq") + 1).cast("int"))
    rows = rows.withColumn("diagnosis", F.struct(modes.alias("mode"), F.lit(False).alias("was_recovered"), F.array(F.lit(False)).alias("evidence"), F.lit(3).alias("probe_calls"), F.lit("{}").alias("notes")))
    runner = recovery.AdaptivePass2(generate.QAGeneration(FakeLLM(), num_questions=1), GroundingJudge(FakeLLM(), 0.5))
    good, bad, summary = runner.run(rows, {"llm_temperature": 0.2}, tmp_path)
    assert good.count() == 3 and bad.count() == 1 and summary["mode_rates"] == {"generator_temperature": 1.0, "domain_mismatch": 1.0}
    assert json.loads((tmp_path / "pass2_summary.json").read_text())["conversion_rate"] == 0.75
    assert runner.run(rows)[0].count() == 0


def test_generators(spark):
    rows = [{"instruction": "Tell of it", "input": LONG.format("well") + " It ran dry. Then rain came."}]
    df = sample(spark, rows)
    llm = FakeLLM()
    one = lambda task: generate.generate(df, task)[0].orderBy("_seq").collect()
    assert len(one(generate.QAGeneration(llm, num_questions=3))) == 3
    pair = one(generate.PreferenceGeneration(llm, mode="two_pass"))[0]
    assert pair.chosen and pair.rejected and pair.task_type == "preference"
    roll = generate.GRPORollout(llm, num_responses=3, temperature_spread=0.6, score_responses=True)
    assert roll.schedule() == [0.4, 0.7, 1.0] and len(one(roll)[0].responses) == 3 and all(0 <= x <= 1 for x in one(roll)[0].reward_scores)
    assert len(json.loads(one(generate.MultiTurn(llm, num_turns=4))[0].metadata)["turns"]) == 2
    assert len(one(generate.MultiTurn(llm, num_turns=3, mode="single_call"))) == 1
    assert [json.loads(r.metadata)["evolution_strategy"] for r in one(generate.EvolInstruct(llm, num_evolutions=2))] == ["add_constraints", "deepen"]
    assert one(generate.ChainOfThought(llm))[0].output.startswith("## Reasoning\n")
    assert json.loads(one(generate.AdversarialPreference(llm, injection_rate=1.0))[0].metadata)["adversarial"] is True
    assert json.loads(one(generate.AdversarialQAGeneration(llm, injection_rate=1.0))[0].metadata)["injected_failure"] is True
    with pytest.raises(ValueError, match="2"):
        generate.GRPORollout(llm, num_responses=1)


def test_generation_rejects(spark):
    class Odd(FakeLLM):
        def answer(self, task, prompt, temperature):
            if "boom" in prompt:
                raise RuntimeError("down")
            return "no pairs at all"

    df = sample(spark, [{"instruction": "q", "input": "text"}, {"instruction": "q", "input": "boom"}])
    good, bad = generate.generate(df, generate.QAGeneration(Odd()))
    assert good.count() == 0
    got = {r.id: (r.rejection_reason, json.loads(r.metadata)) for r in bad.collect()}
    assert got["0"][0] == "generation_parse_failed:QAGeneration" and got["0"][1]["parse_attempts"] == 2 and got["0"][1]["raw_llm_response"] == "no pairs at all"
    assert got["1"][0] == "generation_failed:RuntimeError:down"


def test_injection(spark):
    df = sample(spark, [{"instruction": "q", "output": "fine answer", "input": "ctx"} for _ in range(20)])
    injector = generate.BadSampleInjector(FakeLLM())
    out = injector.inject_by_type(df, {"contradicts_source": 3, "domain_mismatch": 2})
    kinds = out.groupBy(F.get_json_object("metadata", "$.injection_type").alias("k")).count().collect()
    assert {r.k: r["count"] for r in kinds} == {"contradicts_source": 3, "domain_mismatch": 2, None: 15}
    assert injector.inject(df, 1.0).where("output = 'fine answer'").count() == 0
    for fraction, n in ((0.0, 0), (0.01, 1), (0.3, 6), (0.33, 7)):
        assert injector.inject(df, fraction).where("output <> 'fine answer'").count() == n
    blank = sample(spark, [{"instruction": "", "output": "fine answer"}])
    assert injector.inject(blank, 1.0).first().output == "fine answer"
    made = generate.generate(df, generate.AdversarialQAGeneration(FakeLLM(), injection_rate=0.3, num_questions=1))[0]
    assert made.where("metadata LIKE '%injected_failure%'").count() == 6
    report = {r.injection_type: r for r in recovery.injection_report(out, out.where("output <> 'fine answer'")).collect()}
    assert report["all"].recall == 1.0 and report["clean"].recall == 0.0 and report["parametric_drift"].recall is None


def test_children_are_in_order(spark):
    """Of parents far out and of over 64 children each."""
    df = sample(spark, [{"instruction": "q", "input": " ".join(f"Sentence {k} of it." for k in range(90))} for _ in range(5)])
    df = df.withColumn("_seq", F.lit((1 << 62) + 5) - F.col("_seq"))
    made = generate.generate(df, generate.QAGeneration(FakeLLM(), num_questions=70))[0].orderBy("_seq").collect()
    assert [r._seq for r in made] == list(range(350)) and len({r.id for r in made}) == 350
    parents = [json.loads(r.provenance_chain[-1].notes)["source_sample_id"] for r in made]
    assert parents == [str(i) for i in range(4, -1, -1) for _ in range(70)]


def test_chunks_to_questions(spark):
    rows = [(f"d{k}", i, "paragraph", LONG.format(f"river {k} {i}"), 1, "", None) for k in range(12) for i in range(3)]
    chunks = chunking.chunk_blocks(spark.createDataFrame(rows, chunking.BLOCKS_DDL), "sentence", max_tokens=25, overlap=0)
    samples, _ = chunking.chunk_samples(chunks)
    got = samples.orderBy("_seq").collect()
    assert [r._seq for r in got] == list(range(len(got))) and [r.source_uri for r in got] == sorted(r.source_uri for r in got)
    made = generate.generate(samples, generate.QAGeneration(FakeLLM()))[0]
    assert made.count() == 3 * len(got)
    both = generate.generate_multi_passage(samples, generate.QAGeneration(FakeLLM(), num_questions=1))[0]
    assert both.count() == len(got) - 12


def test_reply_parsing():
    assert generate.qa_pairs('```json\n[{"question": "a", "answer": "b"}, {"question": "", "answer": "c"}]\n```') == [("a", "b")]
    assert generate.qa_pairs("Q: one A: two Q: three A: four") == [("one", "two"), ("three", "four")]
    assert json_of('x {"a": 1} y') == {"a": 1} and json_of("none") is None
    assert without_thinking("<think>a</think> b") == "b" and without_thinking("<think>a</think>") == "a"


def test_retrieval(spark):
    chunks = sample(spark, [{"output": t, "task_type": "language_modeling"} for t in ("red fox runs", "blue whale swims", "green frog jumps")])
    asked = sample(spark, [{"input": "red fox runs", "output": "red fox runs"}, {"input": "red fox runs", "output": "blue whale swims"}])
    assert recovery.retrieval_accuracy(asked, chunks) == 0.5


def blocks(*rows):
    return [{"type": t, "text": x, "page": p, "html": "<t>", "bbox": None} for t, x, p in rows]


def test_chunkers():
    w = lambda n, x="w": " ".join([x] * n)
    got = chunking.by_heading(blocks(("heading", "A", 1), ("paragraph", w(40), 2), ("heading", "B", 3), ("paragraph", w(5, "s"), 3), ("heading", "C", 4), ("paragraph", w(40, "c"), 4)), 512, 0, False, 30)
    assert [(c["heading"], c["page"], len(c["text"].split())) for c in got] == [("A", 2, 40), ("C", 4, 45)]
    got = chunking.by_heading(blocks(("paragraph", w(40), 1), ("table", "cells", 1), ("paragraph", w(40, "x"), 2)), 512, 5, True, 30)
    assert [bool(c.get("is_table")) for c in got] == [False, True, False] and got[2]["text"].split()[0] == "x"
    got = chunking.by_heading(blocks(("paragraph", w(40), 1), ("table", "cells", 1), ("paragraph", w(40), 2)), 512, 0, False, 30)
    assert sum(bool(c.get("is_skipped")) for c in got) == 1
    got = chunking.by_sentence(blocks(("paragraph", "One two three. Four five six. Seven.", 1), ("table", "t", 2)), 4, 0, True)
    assert [c["text"] for c in got] == ["One two three.", "Four five six. Seven.", "t"]
    got = chunking.by_sentence(blocks(("paragraph", "One two three. Four five six.", 1)), 3, 2, False)
    assert [c["text"] for c in got] == ["One two three.", "two three. Four five six."]


def test_fixed_chunks_and_samples(spark):
    df = spark.createDataFrame([("d", "a b c d e f g"), ("e", "  ")], "doc string, text string")
    assert [r.text for r in chunking.fixed_chunks(df, 5, 2).orderBy("chunk_index").collect()] == ["a b c d e", "d e f g", "g"]
    rows = [("d", 0, "heading", "H", 1, "", None), ("d", 1, "paragraph", LONG, 1, "", None), ("d", 2, "table", "t", 2, "<table>", None)]
    made, bad = chunking.chunk_samples(chunking.chunk_blocks(spark.createDataFrame(rows, chunking.BLOCKS_DDL), min_section_tokens=3))
    assert json.loads(made.first().metadata)["parent_heading"] == "H" and bad.first().rejection_reason == "table_stubbed:extract_tables_disabled"
    with pytest.raises(ValueError, match="strategy"):
        chunking.chunk_blocks(df, "odd")


def test_exports(spark):
    turns = '[{"role": "user", "content": "x"}]'
    df = sample(spark, [{"instruction": turns, "chosen": turns, "rejected": 'say "b"', "task_type": "preference"}, {"instruction": "i", "output": "o", "metadata": '{"turns": %s, "page": 3}' % turns}, {"instruction": "i", "responses": ["a"], "reward_scores": [0.5], "task_type": "grpo"}])
    got = lambda f: [json.loads(r.value) for r in sinks.export_lines(df, f).orderBy("_seq").collect()]
    assert got("dpo") == [{"prompt": json.loads(turns), "chosen": json.loads(turns), "rejected": 'say "b"'}]
    assert got("sharegpt")[1]["conversations"][2] == {"from": "human", "value": "x"}
    assert got("grpo")[2] == {"prompt": "i", "responses": ["a"], "rewards": [0.5]} and got("ppo")[1] == {"prompt": "i"}
    assert got("corpus") == [{"text": "o", "source_file": "", "source_uri": "memory", "page": 3, "heading": None, "chunk_index": None, "content_type": "text", "task_type": "instruction_following", "table_html": "", "table_bbox": []}]
    with pytest.warns(UserWarning, match="blank"):
        assert sinks.warn_if_blank(df, "alpaca") == 2
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        sinks.warn_if_blank(df, "dpo")


def test_cross_run_stream(spark, tmp_path):
    text = ["red fox runs", "blue whale swims", "green frog jumps", "red fox runs"]
    for i, t in enumerate(text):
        spark.createDataFrame([(i, t)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.read_documents(spark, str(tmp_path / "in"), "doc_id long, text string", 1)
    for _ in range(2):  # the second run finds nothing new
        streams.cross_run_dedup(stream, streams.documents_to_samples, str(tmp_path / "index"), str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.output for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(set(text))


def test_exact_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "A "), (3, "b")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = streams.documents_to_samples(streams.read_documents(spark, str(tmp_path / "in"), "doc_id long, text string")).withColumn("at", F.current_timestamp())
    streams.exact_dedup_stream(rows, "at").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert streams.gated(rows).isStreaming
