"""The planner: one configuration to a fixed order of steps, run with counts, recovery, sinks and reports."""

from __future__ import annotations

import copy
import dataclasses
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsift.functions.files import below, remove
from loomsift.functions.samples import config_hash
from loomsift.functions.store import checkpointed
from loomsift.operators import chunking, embedding, gates, generate, judges, minhash, normalize, pii, recovery, sinks
from loomsift.operators.models import LLM, ChatCompletionsLLM, FakeLLM, OllamaLLM
from loomsift.sources.build import ingest
from loomsift.sources.readers import Source

DOCUMENT_SUFFIXES = (".html", ".htm", ".blocks")
TASKS: dict[str, type[generate.Task]] = {
    "qa": generate.QAGeneration,
    "preference": generate.PreferenceGeneration,
    "grpo": generate.GRPORollout,
    "multiturn": generate.MultiTurn,
    "evol": generate.EvolInstruct,
    "cot": generate.ChainOfThought,
    "adversarial_preference": generate.AdversarialPreference,
    "adversarial_qa": generate.AdversarialQAGeneration,
}


@dataclass
class Backend:
    """Where a model is reached; what isn't given comes from the role, then from the run."""

    model: str | None = None
    url: str | None = None
    key: str | None = None

    @classmethod
    def of(cls, given: Backend | dict[str, Any] | None) -> Backend:
        if isinstance(given, cls):
            return given
        given = dict(given or {})
        return cls(given.get("model"), given.get("url", given.get("api_base")), given.get("key", given.get("api_key")))


def _group(prefix: str, **settings: Any) -> dict[str, Any]:
    return {f"{prefix}_{k}": v for k, v in settings.items()}


#: Every setting of a run by its name, with what holds if it isn't given. Gates and models are off unless asked for.
SETTINGS: dict[str, Any] = {
    # sources
    **dict(dataset="", name="run", split="train", format="auto"),
    **dict.fromkeys(("subset", "columns", "max_samples", "preprocessing_fn", "data_key", "delimiter")),
    **dict(detection_sample_size=10, field_mapping={}),
    # validation, duplicates, cleaning
    **dict(max_tokens=2048, min_tokens=10, dedup="exact", schema_gate=True, clean=True),
    **_group("schema", vocabulary=None, required_fields=[], enforce_task_types=[]),
    **_group("minhash", bands=None, rows=None, seed=42, threshold=0.85, num_perm=128, ngram=3),
    **_group("clean", fields=[], transforms={}),
    # hygiene
    **dict.fromkeys(("pii_pseudonymize", "secrets_gate", "toxicity_gate"), False),
    **_group("secrets", base64_limit=4.5, hex_limit=3.0, fields=[], code_corpus_mode=False),
    **_group("pii", fields=[], entity_types=[], faker_seed=42, score_threshold=0.7),
    **_group("toxicity", text_field="auto", llm_judge=False, llm_reject_threshold=0.5, classifier_reject_threshold=0.5, classifier_pass_threshold=0.1),
    # models
    **_group("llm", api_base=None, api_key=None, model=None, max_retries=3, timeout=120.0, max_tokens=1024, temperature=0.7),
    **_group("judge_llm", max_tokens=512, temperature=0.1),
    **dict.fromkeys(("generator_llm", "judge_llm", "probe_llm", "refiner_llm", "hallucination_llm", "reward_llm", "toxicity_llm")),
    # generation
    **_group("num", evolutions=1, questions=3, responses=4, turns=3),
    **dict(generation_task=None, difficulty="medium", preference_mode="single_call", cot_marker=None, cot_mode="generate", high_temp=1.4, generate_answers=True, score_responses=True),
    **_group("grpo", temperatures=None, temperature_spread=0.6),
    **_group("injection", seed=42, rate=0.5, types=[]),
    # judgement and recovery
    **dict.fromkeys(("hallucination_threshold", "reward_threshold", "diversity_threshold")),
    **_group("reward", store_score=True, dimensions=list(judges.DIMENSIONS[:3])),
    **dict.fromkeys(("enable_reward_refiner", "refine_instruction", "enable_diagnostic_probe", "enable_checkpoint"), False),
    **_group("probe", extra_templates={}, score_split=0.5, temperatures=[0.3, 0.5]),
    # similarity across runs, resampling
    **_group("embedding", dedup=False, dedup_threshold=0.92, reset_index=False, index_dir="output/embedding_index"),
    **dict(resample=False, resample_seed=42, resample_field="source_dataset", target_distribution={}),
    # documents
    **_group("chunk", min_section_tokens=30, extract_tables=False, overlap_tokens=50, max_tokens=512, strategy="heading"),
    # output
    **dict(export_formats=["alpaca", "sharegpt", "dpo"], single_file=False, checkpoint_dir=None),
    **_group("output", split_seed=42, split=None, dir="output"),
}


class RunConfig:
    """A run's settings as attributes, those of SETTINGS."""

    def __init__(self, **given: Any) -> None:
        if unknown := sorted(given.keys() - SETTINGS.keys()):
            raise ValueError(f"unknown settings: {unknown}")
        self.settings = copy.deepcopy(SETTINGS) | given
        if self.dedup not in ("exact", "minhash", "none"):
            raise ValueError(f"unknown dedup: {self.dedup}")
        if self.generation_task is not None and self.generation_task not in TASKS:
            raise ValueError(f"unknown generation task: {self.generation_task}")

    def __getattr__(self, name: str) -> Any:
        if name == "settings" or name not in self.settings:
            raise AttributeError(name)
        return self.settings[name]

    @classmethod
    def from_yaml(cls, path: str | Path, **changes: Any) -> RunConfig:
        import yaml

        given = yaml.safe_load(Path(path).read_text()) or {}
        return cls(**(given | changes))

    def hash(self) -> str:
        """Of all settings but where the output goes."""
        return config_hash({k: v for k, v in self.settings.items() if k not in ("output_dir", "checkpoint_dir", "enable_checkpoint")})

    def sources(self) -> list[Source]:
        entries = self.dataset if isinstance(self.dataset, list) else [self.dataset]
        fns = self.preprocessing_fn if isinstance(self.preprocessing_fn, list) else [self.preprocessing_fn] * len(entries)
        if len(fns) != len(entries):
            raise ValueError(f"{len(entries)} sources, but {len(fns)} preprocessing functions")
        shared = {"format": self.format, "split": self.split, "subset": self.subset, "columns": self.columns, "field_mapping": self.field_mapping, "detection_sample_size": self.detection_sample_size, "data_key": self.data_key, "delimiter": self.delimiter}
        return [Source.of(e, **(shared | {"preprocessing_fn": fn})) for e, fn in zip(entries, fns, strict=True)]

    def llm(self, task: Backend | dict[str, Any] | None, judge: bool = False) -> LLM:
        """The backend of a task: its own settings, then its role's, then the run's."""
        whole = Backend(self.llm_model, self.llm_api_base, self.llm_api_key)
        chain = [Backend.of(task), Backend.of(self.judge_llm if judge else self.generator_llm), whole]
        model, base, key = (next((v for b in chain if (v := getattr(b, k))), None) for k in ("model", "url", "key"))
        if not model:
            raise ValueError("a model is needed: set llm_model")
        common = {"model": model, "temperature": self.judge_llm_temperature if judge else self.llm_temperature, "max_tokens": self.judge_llm_max_tokens if judge else self.llm_max_tokens, "max_retries": self.llm_max_retries, "timeout": self.llm_timeout}
        if model == "fake":
            return FakeLLM(temperature=common["temperature"])
        if model.startswith("ollama/"):
            return OllamaLLM(**(common | {"model": model.removeprefix("ollama/")}), **({"url": base} if base else {}))
        return ChatCompletionsLLM(**common, api_key=key or "", **({"url": base} if base else {}))

    def task(self) -> generate.Task:
        kind = TASKS[self.generation_task or "qa"]
        given = {
            "num_questions": self.num_questions, "difficulty": self.difficulty, "num_responses": self.num_responses, "temperature_spread": self.grpo_temperature_spread,
            "temperatures": tuple(self.grpo_temperatures) if self.grpo_temperatures else None, "score_responses": self.score_responses, "num_turns": self.num_turns, "num_evolutions": self.num_evolutions,
            "generate_answers": self.generate_answers, "injection_rate": self.injection_rate, "seed": self.injection_seed, "high_temp": self.high_temp, "mode": self.cot_mode if self.generation_task == "cot" else self.preference_mode,
        }
        if self.injection_types:
            given["injection_types"] = tuple(self.injection_types)
        if self.cot_marker is not None:
            given["cot_marker"] = self.cot_marker
        if self.generation_task == "multiturn":
            del given["mode"]
        names = {f.name for f in dataclasses.fields(kind)}
        return kind(self.llm(None), **{k: v for k, v in given.items() if k in names})


Step = tuple[str, str, Callable[[DataFrame], Any]]  # name; gate, normalizer or generator; function


@dataclass
class Result:
    passed: DataFrame
    rejected: DataFrame
    stage_counts: dict[str, dict[str, int]]
    exported: dict[str, int] = field(default_factory=dict)
    manifest: dict[str, Any] = field(default_factory=dict)


def plan(c: RunConfig) -> list[Step]:
    """The steps between sources and sinks: cheap gates first, models last."""
    steps: list[Step] = []
    if c.schema_gate:
        options: dict[str, Any] = {"min_tokens": c.min_tokens, "max_tokens": c.max_tokens}
        if c.schema_required_fields:
            options["required"] = tuple(c.schema_required_fields)
        if c.schema_enforce_task_types:
            options["task_types"] = tuple(c.schema_enforce_task_types)
        if c.schema_vocabulary:
            from loomsift.functions.vocabulary import bpe_counter

            options["counter"] = bpe_counter(c.schema_vocabulary)
        steps.append(("SchemaGate", "gate", lambda df: gates.schema_gate(df, **options)))
    if c.dedup in ("exact", "minhash"):
        steps.append(("ExactDeduplicator", "normalizer", normalize.exact_dedup))
    if c.dedup == "minhash":
        steps.append(("MinHashDeduplicator", "normalizer", lambda df: minhash.minhash_dedup(df, c.minhash_threshold, c.minhash_ngram, c.minhash_num_perm, c.minhash_seed, c.minhash_bands, c.minhash_rows)))
    if c.clean:
        chosen = tuple(t for t in normalize.TRANSFORMS if c.clean_transforms.get(t, True))
        steps.append(("TextCleaner", "normalizer", lambda df: normalize.clean_text(df, chosen, tuple(c.clean_fields) or ("instruction", "input", "output"))))
    if c.secrets_gate:
        steps.append(("SecretsGate", "gate", lambda df: gates.secrets_gate(df, tuple(c.secrets_fields) or None, c.secrets_code_corpus_mode, hex_limit=c.secrets_hex_limit, base64_limit=c.secrets_base64_limit)))
    if c.pii_pseudonymize:
        steps.append(("PIIPseudonymizer", "normalizer", lambda df: pii.pseudonymize(df, tuple(c.pii_entity_types) or pii.DEFAULT_TYPES, tuple(c.pii_fields) or None, c.pii_score_threshold, c.pii_faker_seed)))
    if c.toxicity_gate:
        judge = c.llm(c.toxicity_llm, True) if c.toxicity_llm_judge else None
        steps.append(("ToxicityGate", "gate", lambda df: judges.toxicity_gate(df, c.toxicity_classifier_pass_threshold, c.toxicity_classifier_reject_threshold, judge, c.toxicity_llm_reject_threshold, text_field=c.toxicity_text_field)))
    if c.generation_task:
        steps.append((type(c.task()).__name__, "generator", lambda df: generate.generate(df, c.task())))
    if c.hallucination_threshold is not None:
        grounding = judges.GroundingJudge(c.llm(c.hallucination_llm, True), c.hallucination_threshold)
        steps.append(("HallucinationGate", "gate", lambda df: judges.judge_gate(df, grounding)))
    if c.reward_threshold is not None:
        steps.append(("RewardGate", "gate", lambda df: judges.judge_gate(df, judges.RewardJudge(c.llm(c.reward_llm, True), c.reward_threshold, tuple(c.reward_dimensions)), c.reward_store_score)))
    if c.diversity_threshold is not None:
        steps.append(("DiversityGate", "gate", lambda df: embedding.diversity_gate(df, c.diversity_threshold)))
    if c.embedding_dedup:
        steps.append(("EmbeddingDeduplicator", "normalizer", lambda df: embedding.embedding_dedup(df, c.embedding_index_dir, c.embedding_dedup_threshold)))
    if c.resample and c.target_distribution:
        steps.append(("StratifiedSampler", "normalizer", lambda df: normalize.stratified_sample(df, c.target_distribution, c.resample_field, c.resample_seed)))
    if c.max_samples is not None:
        steps.append(("MaxSamplesTruncator", "normalizer", lambda df: normalize.truncate(df, c.max_samples)))
    return steps


def described(c: RunConfig) -> list[str]:
    """The plan in words, for a dry run."""
    reads = [f"read {s.path} as {s.format}" for s in c.sources()]
    return [*reads, *(f"{kind} {name}" for name, kind, _ in plan(c)), *(f"export {f}" for f in c.export_formats)]


class Runner:
    """Runs a configuration. Every row read ends up in the output, among the rejects, or in a counted removal."""

    def __init__(self, config: RunConfig, spark: SparkSession | None = None) -> None:
        self.config = config
        self.spark = spark or SparkSession.builder.getOrCreate()

    def read(self) -> tuple[DataFrame, DataFrame, dict[str, dict[str, int]]]:
        """Samples and rejects of all sources, in their order."""
        c, samples, rejected, counts = self.config, None, None, {}
        for i, source in enumerate(c.sources()):
            if Path(source.path).suffix.lower() in DOCUMENT_SUFFIXES:
                good, bad = self._documents(source)
            else:
                good, bad, _ = ingest(self.spark, source, i)
            name = f"Source{i}:{Path(source.path).name}"
            good, bad = checkpointed(good), checkpointed(bad)
            counts[name] = {"output_count": good.count(), "rejected_count": bad.count()}
            samples = good if samples is None else samples.unionByName(good)
            rejected = bad if rejected is None else rejected.unionByName(bad)
        return samples, rejected, counts

    def _documents(self, source: Source) -> tuple[DataFrame, DataFrame]:
        c = self.config
        if source.path.endswith(".blocks"):
            blocks = self.spark.read.parquet(source.path)
        else:
            pages = self.spark.read.text(source.path, wholetext=True).select(F.col("_metadata.file_path").alias("page_id"), F.col("value").alias("html"))
            blocks = chunking.blocks_of_pages(pages)
        chunks = chunking.chunk_blocks(blocks, c.chunk_strategy, c.chunk_max_tokens, c.chunk_overlap_tokens, c.chunk_extract_tables, c.chunk_min_section_tokens)
        return chunking.chunk_samples(chunks, c.chunk_strategy)

    def _stage(self, k: int, name: str, make: Callable[[], list[DataFrame]]) -> list[DataFrame]:
        """A stage's frames: kept as Parquet by the run's hash and taken from there if they are, else checkpointed."""
        c = self.config
        if not c.enable_checkpoint:
            return [checkpointed(df) for df in make()]
        folder = f"{c.checkpoint_dir or below(c.output_dir, 'checkpoints')}/{c.hash()}/{k:02d}-{name}"
        out, made = [], None
        for i in range(2):
            path = f"{folder}-{i}"
            try:
                out.append(self.spark.read.parquet(path))
                continue
            except Exception as e:  # noqa: BLE001
                if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                    raise
            made = make() if made is None else made
            if i < len(made):
                made[i].write.mode("overwrite").parquet(path)
                out.append(self.spark.read.parquet(path))
        return out

    def steps(self, samples: DataFrame, rejected: DataFrame) -> Result:
        """All steps on given samples, without sources and sinks."""
        c, counts = self.config, {}
        n = samples.count()
        for k, (name, kind, fn) in enumerate(plan(c)):
            label = name if name not in counts else f"{name}#{sum(x.split('#')[0] == name for x in counts) + 1}"
            before = samples
            frames = self._stage(k, name, lambda fn=fn, before=before: [x] if isinstance(x := fn(before), DataFrame) else list(x))
            samples = frames[0]
            out = samples.count()
            match kind:
                case "normalizer":
                    counts[label] = {"input_count": n, "output_count": out}
                case "generator":
                    rejected = rejected.unionByName(frames[1].select(*rejected.columns))
                    counts[label] = {"input_count": n, "output_count": out, "rejected_count": frames[1].count()}
                case _:
                    bad, recovered = frames[1].select(*rejected.columns), 0
                    refused = bad.count()
                    if name in ("HallucinationGate", "RewardGate") and c.enable_diagnostic_probe:
                        again, bad = recovery.probe_rejected(bad, recovery.DiagnosticProbe(c.llm(c.probe_llm), self._judge(name), tuple(c.probe_temperatures), c.probe_score_split, c.probe_extra_templates))
                        recovered = again.count()
                        samples = recovery.with_recovered(samples, again)
                    if name == "RewardGate" and c.enable_reward_refiner:
                        again, bad = recovery.RewardRefiner(c.llm(c.refiner_llm), self._judge(name), c.refine_instruction).refine(bad)
                        recovered += again.count()
                        samples = recovery.with_recovered(samples, again)
                    out += recovered
                    rejected = rejected.unionByName(bad.select(*rejected.columns))
                    counts[label] = {"input_count": n, "output_count": out, "probe_recovered": recovered, "rejected_count": refused}
            n = out
        return Result(samples, rejected, counts)

    def _judge(self, name: str) -> recovery.Judge:
        c = self.config
        if name == "HallucinationGate":
            return judges.GroundingJudge(c.llm(c.hallucination_llm, True), c.hallucination_threshold)
        return judges.RewardJudge(c.llm(c.reward_llm, True), c.reward_threshold, tuple(c.reward_dimensions))

    def run(self) -> Result:
        c, began = self.config, time.monotonic()
        if c.embedding_dedup and c.embedding_reset_index:
            remove(c.embedding_index_dir)
        samples, rejected, counts = self.read()
        result = self.steps(samples, rejected)
        result.stage_counts = counts | result.stage_counts
        result.exported = sinks.export(result.passed, c.export_formats, c.output_dir, c.output_split, c.output_split_seed, c.single_file)
        result.stage_counts |= {f"export:{k}": {"exported_count": n} for k, n in result.exported.items()}
        diagnostics = recovery.diagnostic_summary(result.rejected.where(F.col("diagnosis").isNotNull())) if c.enable_diagnostic_probe else None
        result.manifest = sinks.manifest(result.passed, result.rejected, result.stage_counts, c.hash(), time.monotonic() - began, diagnostics)
        sinks.write_reports(c.output_dir, result.manifest, result.rejected, c.single_file, diagnostics)
        return result
