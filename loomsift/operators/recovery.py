"""What becomes of rejects: diagnosis by probing, refinement, a second pass, and their evaluation."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomsift.functions.files import below, write_text
from loomsift.functions.samples import REJECTED_DDL, SAMPLE_DDL
from loomsift.functions.store import checkpointed
from loomsift.operators.embedding import Embedder, embed, hashing_embedder, nearest
from loomsift.operators.generate import ALL_INJECTIONS, Row, Task
from loomsift.operators.judges import GroundingJudge, RewardJudge, prompt
from loomsift.operators.models import LLM, map_rows
from loomsift.operators.sinks import write_lines

Judge = GroundingJudge | RewardJudge
MODES = ("source_ambiguous", "generator_temperature", "generator_parametric", "threshold_marginal", "instruction_quality", "response_quality", "domain_mismatch", "near_duplicate", "unknown")
#: Modes that no other way of generating helps against.
HOPELESS = ("source_ambiguous", "near_duplicate", "unknown")
TOO_GOOD = "rejected_above_threshold"
STYLES = {
    "default": "Answer the question from the passage.",
    "strict_grounding": "Use nothing but what the passage says, word for word where possible.",
    "domain_specific": "Answer as an expert of the passage's field would, from the passage.",
}


def sweep_mode(evidence: Column) -> Column:
    """What a sweep over rising temperatures shows, by which of its answers passed; null if none did."""
    passed = F.size(F.filter(evidence, lambda x: x))
    falling = F.element_at(evidence, 1) & ~F.element_at(evidence, -1)
    return F.when((F.size(evidence) == 0) | (passed == 0), None).when(passed == F.size(evidence), "threshold_marginal").when(falling, "generator_temperature").otherwise("threshold_marginal")


def sweep_pattern(evidence: list[bool]) -> tuple[str | None, str]:
    """The same of a list, with the name of the pattern."""
    if not any(evidence):
        return None, "none_pass"
    if all(evidence):
        return "threshold_marginal", "all_pass"
    if evidence[0] and not evidence[-1]:
        return "generator_temperature", "low_t_pass"
    return "threshold_marginal", "mixed_unstable"


def exhausted_mode(provenance: Column | str = "provenance_chain") -> Column:
    """The mode of a reject that no probe recovered: ambiguous if a judge named unsupported claims."""
    named = F.exists(provenance, lambda p: F.get_json_object(p["notes"], "$.unsupported_claims").isNotNull())
    return F.when(named, "source_ambiguous").otherwise("unknown")


def _notes(row: Row, key: str) -> Any:
    """A key of the latest record that has it."""
    for record in reversed(row["provenance_chain"] or []):
        if key in (notes := json.loads(record["notes"] or "{}")):
            return notes[key]
    return None


def _record(step: str, **notes: Any) -> dict[str, Any]:
    return {"step_name": step, "step_version": "1.0.0", "timestamp": datetime.now(UTC).replace(tzinfo=None), "config_hash": "", "notes": json.dumps(notes)}


def _new_id(row: Row, step: str) -> str:
    return hashlib.sha256(f"{row['id']}\1{step}".encode()).hexdigest()[:32]


def judged_row(judge: Judge, row: Row) -> tuple[str | None, float | None, dict[str, Any]]:
    """A judge's verdict on a row outside a DataFrame, by the same choice of context and answer."""
    source = row["input"] if len(row["input"] or "") > 50 else json.loads(row["metadata"] or "{}").get("source_chunk") or ""
    return judge.row(row | {"_context": source, "_answer": row["output"] or row["chosen"] or ""})


@dataclass
class DiagnosticProbe:
    """Finds out why a sample failed by generating it again in at most 5 ways, each judged again; the first that passes
    is the recovered sample. A low grounding score tries strict grounding before the temperatures, a near miss after.
    """

    llm: LLM
    judge: Judge
    temperatures: tuple[float, ...] = (0.3, 0.5)
    score_split: float = 0.5
    extra_templates: dict[str, str] = field(default_factory=dict)

    def _again(self, row: Row, temperature: float, style: str = "default") -> Row | None:
        text = self.llm.generate(prompt(task="answer", instruction=row["instruction"], context=row["input"], style=(STYLES | self.extra_templates).get(style, style)), temperature=temperature).text
        return self._passing(row | {"output": text, "chosen": text if row["chosen"] else ""}) if text.strip() else None

    def _asked_again(self, row: Row) -> Row | None:
        question = self.llm.generate(prompt(task="rewrite", instruction=row["instruction"], context=row["input"]), temperature=self.temperatures[0]).text
        return self._again(row | {"instruction": question}, self.temperatures[0]) if question.strip() else None

    def _passing(self, row: Row) -> Row | None:
        reason, score, notes = judged_row(self.judge, row)
        if reason is not None:
            return None
        return row | {"label": row["label"] if row["label"] is not None else score, "_verdict": notes}

    def diagnose(self, row: Row) -> tuple[dict[str, Any], Row | None]:
        """The diagnosis, and the recovered sample if there is one."""
        calls: list[str] = []
        evidence: list[bool] = []

        def said(mode: str, made: Row | None, **notes: Any) -> tuple[dict[str, Any], Row | None]:
            return {"mode": mode, "was_recovered": made is not None, "evidence": evidence, "probe_calls": len(calls), "notes": json.dumps(notes)}, made

        if TOO_GOOD in (row["rejection_reason"] or ""):
            return said("response_quality", None, skip_reason=TOO_GOOD)
        if not (row["input"] or "").strip() or not row["instruction"]:
            return said("unknown", None, reason="no_source_context_or_instruction")
        score = _notes(row, "grounding_score")
        low = score is not None and score < self.score_split

        def sweep() -> tuple[dict[str, Any], Row | None] | None:
            made = []
            for t in self.temperatures:
                calls.append("sweep")
                made.append(self._again(row, t))
            evidence.extend(m is not None for m in made)
            mode, pattern = sweep_pattern(evidence)
            return said(mode, next(m for m in made if m is not None), pattern=pattern) if mode else None

        def variant(mode: str, probe: str, run: Callable[[], Row | None]) -> Callable[[], tuple[dict[str, Any], Row | None] | None]:
            def attempt() -> tuple[dict[str, Any], Row | None] | None:
                calls.append(probe)
                made = run()
                return said(mode, made, passing_probe=probe, **({"route": "low_grounding"} if low else {})) if made else None

            return attempt

        first = self.temperatures[0]
        domain = json.loads(row["metadata"] or "{}").get("domain_prompt_key", "domain_specific")
        strict = variant("generator_parametric", "strict_grounding", lambda: self._again(row, first, "strict_grounding"))
        rest = [variant("domain_mismatch", domain, lambda: self._again(row, first, domain)), variant("instruction_quality", "regenerated_instruction", lambda: self._asked_again(row))]
        try:
            for attempt in ([strict, sweep] if low else [sweep, strict]) + rest:
                if found := attempt():
                    return found
        except Exception as e:  # noqa: BLE001
            return said("unknown", None, error=str(e))
        return said("source_ambiguous" if _notes(row, "unsupported_claims") is not None else "unknown", None)

    def row(self, row: Row) -> list[Row]:
        diagnosis, made = self.diagnose(row)
        out = [row | {"diagnosis": diagnosis}]
        if made:
            record = _record("DiagnosticProbe", probe_path=json.loads(diagnosis["notes"]).get("passing_probe", "temperature_sweep"), mode=diagnosis["mode"], original_id=row["id"])
            out.append(made | {"id": _new_id(row, "probe"), "rejection_reason": None, "rejecting_step": None, "diagnosis": None, "provenance_chain": [*(row["provenance_chain"] or []), record]})
        return out


def probe_rejected(rejected: DataFrame, probe: DiagnosticProbe) -> tuple[DataFrame, DataFrame]:
    """Recovered samples, and all rejects with their diagnoses. The model's replies are written before either is used."""
    made = checkpointed(map_rows(rejected, lambda: probe.row, StructType.fromDDL(REJECTED_DDL)))
    names = StructType.fromDDL(SAMPLE_DDL).fieldNames()
    return made.where("rejection_reason IS NULL").select(*names), made.where("rejection_reason IS NOT NULL")


def with_recovered(passed: DataFrame, recovered: DataFrame) -> DataFrame:
    """Recovered samples follow those that passed; the originals stay rejects."""
    last = passed.agg(F.coalesce(F.max("_seq"), F.lit(0)).alias("last"))
    later = recovered.crossJoin(F.broadcast(last)).withColumn("_seq", F.col("last") + 1 + F.col("_seq")).drop("last")
    return passed.unionByName(later.select(*passed.columns))


def weakest_dimension(provenance: Column | str = "provenance_chain") -> Column:
    """The dimension of the least score in the latest failing record of the reward gate; ties by name, null if none."""
    failing = F.filter(provenance, lambda p: (p["step_name"] == "RewardGate") & (F.get_json_object(p["notes"], "$.passed") == "false"))
    scores = F.from_json(F.get_json_object(F.try_element_at(failing, F.lit(-1))["notes"], "$.dimension_scores"), "map<string,double>")
    return F.array_min(F.transform(F.map_entries(scores), lambda e: F.struct(e["value"].alias("score"), e["key"].alias("name"))))["name"]


@dataclass
class RewardRefiner:
    """One rewrite of a sample that a reward judge rejected, aimed at its weakest dimension, and judged again."""

    llm: LLM
    judge: RewardJudge
    refine_instruction: bool = False

    def row(self, row: Row) -> list[Row]:
        if TOO_GOOD in (row["rejection_reason"] or ""):
            return [row]
        scores = _notes(row, "dimension_scores") or {}
        axis = min(scores, key=lambda d: (scores[d], d)) if scores else ""
        weakness = _notes(row, "weaknesses") or ""
        of_question = self.refine_instruction and axis in ("instruction_following", "")
        try:
            text = self.llm.generate(prompt(task="rewrite", axis=axis or "overall quality", weakness=weakness, instruction=row["instruction"], context=row["input"] or row["output"], answer=row["output"]), temperature=0.4).text.strip()
            if not text:
                return [row]
            changed = {"instruction": text} if of_question else {"output": text, "chosen": text if row["chosen"] else ""}
            kind = "instruction_rewrite" if of_question else "answer_rewrite"
            meta = json.loads(row["metadata"] or "{}") | {"reward_refined": True, "refinement_axis": axis, "refinement_type": kind}
            made = row | changed | {"id": _new_id(row, "refined"), "metadata": json.dumps(meta, ensure_ascii=False)}
            reason, score, _ = judged_row(self.judge, made)
        except Exception:  # noqa: BLE001
            return [row]
        if reason is not None:
            return [row]
        record = _record("RewardRefiner", original_id=row["id"], refinement=kind, axis=axis)
        return [made | {"label": score if score is not None else row["label"], "rejection_reason": None, "rejecting_step": None, "diagnosis": None, "provenance_chain": [*(row["provenance_chain"] or []), record]}]

    def refine(self, rejected: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Samples that pass once rewritten, and the rejects that still fail."""
        made = checkpointed(map_rows(rejected, lambda: self.row, StructType.fromDDL(REJECTED_DDL)))
        names = StructType.fromDDL(SAMPLE_DDL).fieldNames()
        return made.where("rejection_reason IS NULL").select(*names), made.where("rejection_reason IS NOT NULL")


@dataclass
class AdaptivePass2:
    """Generates diagnosed rejects again under a patch of the configuration, and judges them again; for analysis."""

    task: Task
    judge: Judge

    def _row(self, patch: dict[str, Any] | None) -> Callable[[Row], list[Row]]:
        task = self.task if patch is None else replace(self.task, llm=replace(self.task.llm, temperature=patch.get("llm_temperature", self.task.llm.temperature)))

        def run(row: Row) -> list[Row]:
            diagnosis = row["diagnosis"]
            if diagnosis is None:
                return []
            if patch is None or diagnosis["mode"] in HOPELESS:
                return [row]
            source = row["input"]
            if patch.get("context_window") == "adjacent_chunks" and (more := json.loads(row["metadata"] or "{}").get("adjacent_context")):
                source = f"{source}\n\n{more}"
            seed = row | {"input": source, "output": "", "instruction": "" if patch.get("regenerate_field") == "instruction" else row["instruction"], "rejection_reason": None}
            made = task.run_row(seed)
            if not made or made[0].get("rejection_reason"):
                return [row | {"rejection_reason": f"{row['rejection_reason']}:regeneration_error"}]
            child = made[0]
            reason, score, _ = judged_row(self.judge, child)
            if reason is not None:
                return [row | {"rejection_reason": f"{reason}:gate_failed_pass2"}]
            record = _record("AdaptivePass2Runner", original_id=row["id"], failure_mode=diagnosis["mode"], patch=patch, forced=True)
            return [child | {"label": score, "rejection_reason": None, "rejecting_step": None, "diagnosis": diagnosis, "provenance_chain": [*child["provenance_chain"], record]}]

        return run

    def run(self, rejected: DataFrame, force_patch: dict[str, Any] | None = None, folder: str | Path | None = None) -> tuple[DataFrame, DataFrame, dict[str, Any]]:
        """Accepted samples, those still rejected, and the conversion by mode; both are written to the folder if given."""
        made = checkpointed(map_rows(rejected, lambda: self._row(force_patch), StructType.fromDDL(REJECTED_DDL)))
        rates = pass2_rates(rejected, made.where("rejection_reason IS NULL"))
        modes = {r.mode: r for r in rates.collect()} if force_patch is not None else {}
        attempted, converted = rejected.count(), sum(r.converted for r in modes.values())
        summary = {
            "attempted": attempted, "converted": converted, "conversion_rate": round(converted / attempted, 4) if attempted else 0.0,
            "mode_attempted": {m: r.attempted for m, r in modes.items()}, "mode_converted": {m: r.converted for m, r in modes.items() if r.converted}, "mode_rates": {m: r.rate for m, r in modes.items()}, "forced_patch": force_patch,
        }
        names = StructType.fromDDL(SAMPLE_DDL).fieldNames()
        accepted, still = made.where("rejection_reason IS NULL").select(*names), made.where("rejection_reason IS NOT NULL")
        if folder is not None:
            write_lines(still.select("_seq", F.to_json(F.struct(*(c for c in still.columns if c != "_seq")), {"ignoreNullFields": "false"}).alias("value")), below(folder, "rejected_pass2.jsonl"))
            write_text(below(folder, "pass2_summary.json"), json.dumps(summary, indent=2))
        return accepted, still, summary


def pass2_rates(rejected: DataFrame, accepted: DataFrame) -> DataFrame:
    """``mode, attempted, converted, rate`` of the modes that a second pass can help against."""
    tried = rejected.where(F.col("diagnosis").isNotNull() & ~F.col("diagnosis.mode").isin(*HOPELESS)).groupBy("diagnosis.mode").agg(F.count("*").alias("attempted"))
    won = accepted.groupBy("diagnosis.mode").agg(F.count("*").alias("converted"))
    return tried.join(won, "mode", "left").select("mode", "attempted", F.coalesce("converted", F.lit(0)).alias("converted"), F.round(F.coalesce("converted", F.lit(0)) / F.col("attempted"), 4).alias("rate"))


def mode_counts(rejected: DataFrame) -> DataFrame:
    """``mode, n, recovered, probe_calls`` of diagnosed rejects."""
    return rejected.groupBy(F.coalesce("diagnosis.mode", F.lit("undiagnosed")).alias("mode")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("diagnosis.was_recovered").cast("int"), F.lit(0))).alias("recovered"), F.sum(F.coalesce("diagnosis.probe_calls", F.lit(0))).alias("probe_calls"))


def diagnostic_summary(rejected: DataFrame) -> dict[str, Any]:
    rows = mode_counts(rejected).orderBy("mode").collect()
    total, recovered = sum(r.n for r in rows), sum(r.recovered for r in rows)
    return {"total_diagnosed": total, "probe_recovered": recovered, "probe_recovery_pct": round(recovered / total, 4) if total else 0.0, "total_probe_calls": sum(r.probe_calls for r in rows), "mode_counts": {r.mode: r.n for r in rows}}


def injection_report(samples: DataFrame, rejected: DataFrame, types: tuple[str, ...] = ALL_INJECTIONS) -> DataFrame:
    """``injection_type, total, caught, recall``: how many injected samples a gate rejected.

    A row for each type, for all injected ones (``all``), and for the clean ones (``clean``), whose recall is the rate of
    false alarms. The recall of an empty group is null.
    """
    injected = F.coalesce(F.get_json_object("metadata", "$.injected_failure") == "true", F.lit(False))
    kind = F.when(injected, F.coalesce(F.get_json_object("metadata", "$.injection_type"), F.lit("other"))).otherwise("clean")
    marked = samples.select("id", kind.alias("injection_type")).join(rejected.select("id", F.lit(1).alias("hit")).distinct(), "id", "left")
    count = [F.count("*").alias("total"), F.count("hit").alias("caught")]
    by_type = marked.groupBy("injection_type").agg(*count)
    found = by_type.unionByName(by_type.where("injection_type <> 'clean'").agg(F.sum("total").alias("total"), F.sum("caught").alias("caught")).select(F.lit("all").alias("injection_type"), "total", "caught"))
    names = samples.sparkSession.createDataFrame([(t,) for t in (*types, "all", "clean")], "injection_type string")
    n = F.coalesce("total", F.lit(0))
    return names.join(found, "injection_type", "left").select("injection_type", n.alias("total"), F.coalesce("caught", F.lit(0)).alias("caught"), F.when(n > 0, F.round(F.col("caught") / n, 4)).alias("recall"))


def retrieve(queries: DataFrame, corpus: DataFrame, k: int = 1) -> DataFrame:
    """``query_id, id, similarity, rank`` of the k nearest rows of ``id, vec``."""
    return nearest(queries, corpus, k)


def retrieval_accuracy(answers: DataFrame, chunks: DataFrame, embedder: Embedder = hashing_embedder) -> float:
    """Share of the samples ``answers`` whose nearest chunk is the one of ``input`` that they were made from."""
    of = lambda df: embed(df, embedder).withColumnRenamed("_seq", "id")
    best = nearest(of(answers), of(chunks), 1).select(F.col("query_id").alias("_seq"), "id")
    texts = chunks.select(F.col("_seq").alias("id"), F.trim("output").alias("found"))
    row = answers.select("_seq", F.trim("input").alias("source")).join(best, "_seq", "left").join(texts, "id", "left").agg(F.avg(F.coalesce((F.col("source") == F.col("found")).cast("double"), F.lit(0.0))).alias("share")).first()
    return row.share or 0.0
