"""Gates by models: toxicity, grounding, reward."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomsift.functions.batches import slices
from loomsift.functions.samples import split_gate, with_provenance
from loomsift.functions.text import PREFERENCE, answer_to_judge, is_task, judge_context, strip
from loomsift.operators.models import LLM, json_of, map_rows

DIMENSIONS = ("helpfulness", "honesty", "instruction_following", "correctness", "coherence", "safety", "verbosity")
Scorer = Callable[[list[str]], list[float]]
LEXICON = frozenset("idiot moron scum trash loser stupid disgusting worthless clown pathetic".split())

#: Characters of a text that the toxicity judge is asked about at a time.
JUDGE_WINDOW = 1500


def lexicon_scorer(texts: list[str]) -> list[float]:
    """The built-in scorer: words of a small list, four of which make a certainty."""
    return [min(1.0, sum(w in LEXICON for w in re.findall(r"[a-z]+", t.lower())) / 4) for t in texts]


def prompt(**parts: Any) -> list[dict[str, str]]:
    """Our prompts: named parts, each under its name."""
    return [{"role": "user", "content": "\n".join(f"[{k.replace('_', ' ') if k == 'task' else k}]\n{v}" for k, v in parts.items())}]


def clamp(x: Any) -> float:
    return max(0.0, min(1.0, float(x)))


def score_in(text: str, key: str) -> tuple[float, dict[str, Any]]:
    """A judge's score by its key, else the first number of the reply, a tenth of it if over 1, else one half."""
    value = json_of(text)
    if isinstance(value, dict) and key in value:
        try:
            return clamp(value[key]), value
        except (TypeError, ValueError):
            pass
    m = re.search(r"(\d+\.?\d*)", text)
    if not m:
        return 0.5, {}
    x = float(m.group(1))
    return clamp(x / 10 if x > 1 else x), {}


def windows(text: str, size: int | None) -> list[str]:
    """The text in windows of ``size`` characters, a quarter of which each shares with the next; whole without a size."""
    if size is None or len(text) <= size:
        return [text]
    step = max(1, size - size // 4)
    return [text[i : i + size] for i in range(0, len(text) - size + step, step)]


def toxicity_scores(samples: DataFrame, scorer: Scorer = lexicon_scorer, text_field: str = "auto", window: int | None = None) -> DataFrame:
    """``samples`` with ``_scores``, an array of (field, score, text) of the texts that aren't blank.

    Whole texts are scored; for a scorer with a limit of length, ``window`` is its characters, and a text's score is that of its worst window.
    """

    @F.arrow_udf("array<double>")
    def score(texts: pa.Array) -> pa.Array:
        out: list[list[float] | None] = []
        for some in slices(texts):
            parts = [[windows(x, window) for x in row] for row in some.to_pylist()]
            flat = [p for row in parts for text in row for p in text]
            found = iter(scorer(flat) if flat else [])
            out += [[max(float(next(found)) for _ in text) for text in row] for row in parts]
        return pa.array(out, pa.list_(pa.float64()))

    one = lambda f: F.array(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")))
    rollouts = F.transform("responses", lambda x, i: F.struct(F.concat(F.lit("response_"), i.cast("string")).alias("field"), x.alias("text")))
    auto = F.when(is_task(*PREFERENCE), F.concat(one("chosen"), one("rejected"))).when(is_task("grpo"), rollouts).when(is_task("language_modeling"), one("output")).otherwise(F.concat(one("output"), one("instruction")))
    fields = F.filter(auto if text_field == "auto" else one(text_field), lambda f: strip(f["text"]) != "")
    texts = samples.withColumn("_fields", fields).withColumn("_s", score(F.transform("_fields", lambda f: f["text"])))
    return texts.withColumn("_scores", F.zip_with("_fields", "_s", lambda f, s: F.struct(s.alias("score"), f["field"].alias("field"), f["text"].alias("text")))).drop("_fields", "_s")


def toxicity_gate(samples: DataFrame, pass_threshold: float = 0.1, reject_threshold: float = 0.5, llm: LLM | None = None, llm_reject_threshold: float = 0.5, scorer: Scorer = lexicon_scorer, text_field: str = "auto", window: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Low scores pass, high ones are rejected; between them a judge decides, without one the sample is rejected.

    The judge sees a long text in windows, the worst of which counts. A judge that fails counts as a score of 1.
    """
    if not pass_threshold < reject_threshold:
        raise ValueError("pass_threshold must be under reject_threshold")

    @F.arrow_udf("struct<reason:string,notes:string>")
    def decide(worst: pa.Array, field: pa.Array, text: pa.Array) -> pa.Array:
        out = []
        for s, f, t in zip(worst, field, text, strict=True):
            s, f = s.as_py(), f.as_py()
            notes: dict[str, Any] = {"passed": True, "phase": "classifier", "max_toxicity_score": None if s is None else round(s, 4), "worst_field": f}
            reason = None
            if s is None or s != s:
                notes = {"passed": True, "phase": "skipped_no_text"}
            elif s >= reject_threshold or (s >= pass_threshold and llm is None):
                reason = f"toxic_content:classifier:{s:.3f}"
            elif s >= pass_threshold:
                try:
                    judged, reply = max((score_in(llm.generate(prompt(task="toxicity", answer=p), temperature=0.0).text, "toxicity_score") for p in windows(t.as_py(), JUDGE_WINDOW)), key=lambda x: x[0])
                except Exception:  # noqa: BLE001
                    judged, reply = 1.0, {}
                notes |= {"phase": "llm_judge", "llm_score": judged, "categories": reply.get("categories", []), "reasoning": reply.get("reasoning", "")}
                if judged >= llm_reject_threshold:
                    reason = f"toxic_content:llm_judge:{judged:.3f}"
            notes["passed"] = reason is None
            out.append({"reason": reason, "notes": json.dumps(notes)})
        return pa.array(out, pa.struct([("reason", pa.string()), ("notes", pa.string())]))

    scored = toxicity_scores(samples, scorer, text_field, window).withColumn("_worst", F.array_max("_scores")).withColumn("_d", decide("_worst.score", "_worst.field", "_worst.text"))
    config = {"pass": pass_threshold, "reject": reject_threshold, "llm": llm.config_hash() if llm else None}
    marked = with_provenance(scored, "ToxicityGate", F.col("_d.notes"), config)
    passed, rejected = split_gate(marked, F.col("_d.reason"), "ToxicityGate")
    extra = ("_scores", "_worst", "_d")
    return passed.drop(*extra), rejected.drop(*extra)


@dataclass
class GroundingJudge:
    """Judges an answer against its source; a pure function of a row, used by the gate and by recovery."""

    llm: LLM
    threshold: float = 0.7
    skip_if_no_context: bool = True
    step = "HallucinationGate"

    def __call__(self, context: str, answer: str, instruction: str = "") -> tuple[str | None, float | None, dict[str, Any]]:
        """Reason or none, score or none, notes."""
        if not context:
            return (None, None, {"passed": True, "verdict": "skipped_no_context"}) if self.skip_if_no_context else ("hallucination_gate:no_source_context", None, {"passed": False, "verdict": "no_source_context"})
        if not answer:
            return None, None, {"passed": True, "verdict": "skipped_no_answer"}
        try:
            score, reply = score_in(self.llm.generate(prompt(task="grounding", instruction=instruction, context=context, answer=answer), temperature=0.1).text, "grounding_score")
        except Exception as e:  # noqa: BLE001
            return None, None, {"passed": True, "verdict": "passed_on_error", "error": str(e)}
        ok = score >= self.threshold
        notes = {"grounding_score": score, "verdict": reply.get("verdict", ""), "threshold": self.threshold, "passed": ok}
        if not ok:
            notes |= {"supported_claims": reply.get("supported_claims", []), "unsupported_claims": reply.get("unsupported_claims", [])}
        return (None if ok else f"hallucination_contract_failed:{score:.2f}"), score, notes

    def row(self, r: dict[str, Any]) -> tuple[str | None, float | None, dict[str, Any]]:
        return self(r["_context"], r["_answer"], r["instruction"])


@dataclass
class RewardJudge:
    llm: LLM
    threshold: float = 0.7
    dimensions: tuple[str, ...] = DIMENSIONS[:3]
    step = "RewardGate"

    def __post_init__(self) -> None:
        if unknown := {*self.dimensions} - {*DIMENSIONS}:
            raise ValueError(f"unknown dimensions: {sorted(unknown)}")

    def one(self, instruction: str, answer: str) -> tuple[float, dict[str, Any]]:
        return score_in(self.llm.generate(prompt(task="reward", dimensions=", ".join(self.dimensions), instruction=instruction, answer=answer), temperature=0.1).text, "overall_score")

    def row(self, r: dict[str, Any]) -> tuple[str | None, float | None, dict[str, Any]]:
        """A pair passes if the chosen side reaches the threshold and the rejected one doesn't."""
        try:
            if r["task_type"] in PREFERENCE and r["chosen"] and r["rejected"]:
                (good, good_notes), (bad, bad_notes) = self.one(r["instruction"], r["chosen"]), self.one(r["instruction"], r["rejected"])
                reason = f"dpo_pair_failed:chosen_below_threshold:{good:.2f}" if good < self.threshold else f"dpo_pair_failed:rejected_above_threshold:{bad:.2f}" if bad >= self.threshold else None
                return reason, good, {"chosen_score": good, "rejected_score": bad, "chosen_dims": good_notes.get("scores", {}), "rejected_dims": bad_notes.get("scores", {}), "threshold": self.threshold, "passed": reason is None}
            if not r["_answer"]:
                return None, None, {"passed": True, "verdict": "skipped_no_answer"}
            score, reply = self.one(r["instruction"], r["_answer"])
        except Exception as e:  # noqa: BLE001
            return None, None, {"passed": True, "verdict": "passed_on_error", "error": str(e)}
        ok = score >= self.threshold
        return (None if ok else f"below_reward_threshold:{score:.2f}"), score, {"reward_score": score, "dimension_scores": reply.get("scores", {}), "threshold": self.threshold, "passed": ok, "strengths": reply.get("strengths", []), "weaknesses": reply.get("weaknesses", [])}


def judged(samples: DataFrame, judge: GroundingJudge | RewardJudge) -> DataFrame:
    """``samples`` with ``_reason, _score, _notes`` of a judge. Write it before using it twice: each use asks the model."""
    rows = samples.withColumns({"_context": judge_context(), "_answer": answer_to_judge()})
    schema = StructType.fromDDL("_seq bigint, id string, _reason string, _score double, _notes string")

    def make() -> Callable[[dict[str, Any]], list[dict[str, Any]]]:
        def fn(r: dict[str, Any]) -> list[dict[str, Any]]:
            reason, score, notes = judge.row(r)
            return [r | {"_reason": reason, "_score": score, "_notes": json.dumps(notes)}]

        return fn

    full = StructType([f for f in samples.schema.fields] + [f for f in schema.fields if f.name not in samples.columns])
    return map_rows(rows, make, full)


def judge_gate(samples: DataFrame, judge: GroundingJudge | RewardJudge, store_score: bool = True) -> tuple[DataFrame, DataFrame]:
    """A judge's verdicts as a gate; a passing score becomes the label, if there is none or it is a reward."""
    from loomsift.functions.store import checkpointed

    asked = checkpointed(judged(samples, judge))
    marked = with_provenance(asked, judge.step, F.col("_notes"), {"threshold": judge.threshold, "llm": judge.llm.config_hash()})
    passed, rejected = split_gate(marked, F.col("_reason"), judge.step)
    if store_score:
        label = F.coalesce("label", "_score") if judge.step == "HallucinationGate" else F.coalesce("_score", "label")
        passed = passed.withColumn("label", label)
    extra = ("_reason", "_score", "_notes")
    return passed.drop(*extra), rejected.drop(*extra)


def hallucination_gate(samples: DataFrame, llm: LLM, threshold: float = 0.7, skip_if_no_context: bool = True) -> tuple[DataFrame, DataFrame]:
    return judge_gate(samples, GroundingJudge(llm, threshold, skip_if_no_context))


def reward_gate(samples: DataFrame, llm: LLM, threshold: float = 0.7, dimensions: tuple[str, ...] = DIMENSIONS[:3], store_score_in_label: bool = True) -> tuple[DataFrame, DataFrame]:
    return judge_gate(samples, RewardJudge(llm, threshold, dimensions), store_score_in_label)
