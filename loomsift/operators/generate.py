"""Generation: each sample gives children or one reject, by way of a language model."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomsift.functions.samples import FIELDS, REJECTED_DDL, SAMPLE_DDL, config_hash, numbered
from loomsift.functions.store import checkpointed
from loomsift.operators.judges import clamp, prompt, score_in
from loomsift.operators.models import LLM, json_of, map_rows

Row = dict[str, Any]
CARRIED = ("page", "parent_heading", "chunk_index", "content_type", "source_file", "domain")


def chance(*parts: Any) -> float:
    """A number in [0, 1) that depends on its arguments only: draws don't depend on the order of rows."""
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode(), digest_size=7).digest(), "big") / (1 << 56)


class ParseFailure(ValueError):
    """The reply isn't what the task asked for."""


@dataclass
class Task:
    """A generation task: ``children`` gives the fields of the new samples from one row."""

    llm: LLM
    max_parse_retries: int = 1

    @property
    def name(self) -> str:
        return type(self).__name__

    def children(self, row: Row) -> list[Row]:
        raise NotImplementedError

    def prepared(self, samples: DataFrame) -> DataFrame:
        """The rows that ``children`` is given, with what it needs beside them."""
        return samples

    def context(self, row: Row) -> str:
        return (row["output"] if row["task_type"] == "language_modeling" and row["output"] else "") or row["input"] or row["output"] or ""

    def ask(self, row: Row, temperature: float | None = None, **parts: Any) -> str:
        reply = self.llm.generate(prompt(**parts), temperature=temperature)
        used = row.setdefault("_used", {"llm_model": reply.model, "prompt_tokens": 0, "completion_tokens": 0, "latency_seconds": 0.0, "prompt_hash": hashlib.sha256(json.dumps(parts, default=str).encode()).hexdigest()[:16]})
        used["prompt_tokens"] += reply.prompt_tokens
        used["completion_tokens"] += reply.completion_tokens
        used["latency_seconds"] += reply.latency
        row["_raw"] = reply.text
        return reply.text

    def run_row(self, row: Row) -> list[Row]:
        meta = json.loads(row["metadata"] or "{}")
        reason, tries = None, 0
        for tries in range(1, self.max_parse_retries + 2):
            try:
                made = self.children(row)
                if not made:
                    raise ParseFailure("empty")
                break
            except ParseFailure:
                reason = f"generation_parse_failed:{self.name}"
            except Exception as e:  # noqa: BLE001
                reason = f"generation_failed:{type(e).__name__}:{e}"
                break
        else:
            made = []
        if reason and not (tries and "made" in locals() and made):
            return [row | {"rejection_reason": reason, "rejecting_step": self.name, "metadata": json.dumps(meta | {"raw_llm_response": str(row.get("_raw", ""))[:2000], "parse_attempts": tries}, ensure_ascii=False), "diagnosis": None}]
        used = row.get("_used", {})
        record = {"step_name": self.name, "step_version": "1.0.0", "timestamp": datetime.now(UTC).replace(tzinfo=None), "config_hash": config_hash({"llm": self.llm.config_hash(), "task": self.name}), "notes": json.dumps(used | {"source_sample_id": row["id"], "generation_task": self.name})}
        out = []
        for k, child in enumerate(made):
            own = {c: meta[c] for c in CARRIED if c in meta} | child.pop("metadata", {})
            base = {f: [] if t.startswith("array") else None if f == "label" else "" for f, t in FIELDS.items()}
            made_id = hashlib.sha256(f"{row['id']}\1{self.name}\1{k}".encode()).hexdigest()[:32]
            out.append(base | {"_seq": row["_seq"], "_child": k, "id": made_id, "source_uri": row["source_uri"], "metadata": json.dumps(own, ensure_ascii=False), "provenance_chain": [*(row["provenance_chain"] or []), record]} | child)
        return out


def generate(samples: DataFrame, task: Task) -> tuple[DataFrame, DataFrame]:
    """Children, in order of their parents, and the rows that gave none. The model's replies are written before either is used."""
    made = checkpointed(map_rows(task.prepared(samples), lambda: task.run_row, StructType.fromDDL(f"{REJECTED_DDL}, _child int")))
    columns = StructType.fromDDL(SAMPLE_DDL).fieldNames()
    children = numbered(made.where("rejection_reason IS NULL").select(*columns, "_child"), "_seq", "_child", name="_n")
    return children.drop("_seq", "_child").withColumnRenamed("_n", "_seq").select(*columns), made.where("rejection_reason IS NOT NULL").drop("_child")


def qa_pairs(text: str) -> list[tuple[str, str]]:
    """Question and answer pairs of a reply: JSON, or lines ``Q: … A: …``."""
    value = json_of(text)
    value = [value] if isinstance(value, dict) else value
    pairs = [(str(x.get("question", "")), str(x.get("answer", ""))) for x in value if isinstance(x, dict)] if isinstance(value, list) else re.findall(r"Q:\s*(.+?)\s*A:\s*(.+?)(?=\s*Q:|\Z)", text, re.S)
    pairs = [(q.strip(), a.strip()) for q, a in pairs if q.strip() and a.strip()]
    if not pairs:
        raise ParseFailure("no pairs")
    return pairs


@dataclass
class QAGeneration(Task):
    num_questions: int = 3
    difficulty: str = "medium"

    def context(self, row: Row) -> str:
        return super().context(row) or row["instruction"]

    def children(self, row: Row) -> list[Row]:
        table = row["task_type"] == "table_qa" or json.loads(row["metadata"] or "{}").get("content_type") == "table"
        parts = {"task": "qa", "count": self.num_questions, "context": self.context(row), "kind": "table" if table else "text"}
        if self.difficulty != "medium":
            parts["difficulty"] = self.difficulty
        return [{"instruction": q, "input": self.context(row), "output": a, "task_type": "table_qa" if table else "instruction_following"} for q, a in qa_pairs(self.ask(row, **parts))]


def adjacent_passages(chunks: DataFrame) -> DataFrame:
    """Each chunk joined with the next one of its document."""
    doc, index = F.get_json_object("metadata", "$.source_file"), F.get_json_object("metadata", "$.chunk_index").cast("int")
    after = F.lead("output").over(Window.partitionBy("_doc").orderBy("_index"))
    return chunks.withColumns({"_doc": doc, "_index": index}).withColumn("_next", after).where("_next IS NOT NULL").withColumn("output", F.concat("output", F.lit("\n\n"), "_next")).drop("_doc", "_index", "_next")


def generate_multi_passage(chunks: DataFrame, task: QAGeneration) -> tuple[DataFrame, DataFrame]:
    made, rejected = generate(adjacent_passages(chunks), task)
    reason = F.regexp_replace(F.regexp_replace("rejection_reason", "^generation_parse_failed:.*$", "multi_passage_parse_failed"), "^generation_failed:", "multi_passage_generation_failed:")
    return made, rejected.withColumn("rejection_reason", reason)


@dataclass
class PreferenceGeneration(Task):
    mode: str = "single_call"

    def children(self, row: Row) -> list[Row]:
        context = self.context(row)
        if self.mode == "two_pass":
            question = row["instruction"] or "Explain the passage."
            chosen = self.ask(row, task="answer", instruction=question, context=context or question)
            rejected = self.ask(row, temperature=min(self.llm.temperature + 0.3, 1.5), task="answer", instruction=question, context=context or question)
            pair = {"instruction": question, "chosen": chosen, "rejected": rejected}
        else:
            text = self.ask(row, task="preference", instruction=row["instruction"], context=context)
            pair = json_of(text)
            if not isinstance(pair, dict):
                found = re.search(r"chosen:\s*(.+?)\s*rejected:\s*(.+)", text, re.S | re.I)
                pair = {"chosen": found.group(1), "rejected": found.group(2)} if found else {}
        if not str(pair.get("chosen", "")).strip() or not str(pair.get("rejected", "")).strip():
            raise ParseFailure("a side is missing")
        return [{"instruction": row["instruction"] or str(pair.get("instruction", "")), "input": context, "chosen": str(pair["chosen"]), "rejected": str(pair["rejected"]), "task_type": "preference"}]


@dataclass
class GRPORollout(Task):
    num_responses: int = 4
    temperature_spread: float = 0.6
    temperatures: tuple[float, ...] | None = None
    score_responses: bool = False

    def __post_init__(self) -> None:
        if self.num_responses < 2:
            raise ValueError("at least 2 responses")

    def schedule(self) -> list[float]:
        n = self.num_responses
        if self.temperatures:
            return [self.temperatures[i % len(self.temperatures)] for i in range(n)]
        low, high = max(0.0, self.llm.temperature - self.temperature_spread / 2), min(2.0, self.llm.temperature + self.temperature_spread / 2)
        return [round(low + (high - low) * i / (n - 1), 2) for i in range(n)]

    def children(self, row: Row) -> list[Row]:
        context = self.context(row)
        found = [t for t in (self.ask(row, temperature=x, task="answer", instruction=row["instruction"], context=context or row["instruction"]) for x in self.schedule()) if t.strip()]
        if not found:
            raise ParseFailure("no rollouts")
        rewards = [0.0] * len(found)
        if self.score_responses:
            for i, t in enumerate(found):
                try:
                    rewards[i] = clamp(score_in(self.ask(row, temperature=0.1, task="score", context=context or row["instruction"], answer=t), "score")[0])
                except Exception:  # noqa: BLE001
                    rewards[i] = 0.5
        return [{"instruction": row["instruction"], "input": row["input"], "responses": found, "reward_scores": rewards, "task_type": "grpo"}]


@dataclass
class MultiTurn(Task):
    num_turns: int = 3
    mode: str = "turn_by_turn"

    def __post_init__(self) -> None:
        if self.num_turns < 2:
            raise ValueError("at least 2 turns")

    def children(self, row: Row) -> list[Row]:
        context = self.context(row) or row["instruction"]
        if self.mode == "single_call":
            turns = json_of(self.ask(row, task="dialogue", count=self.num_turns, context=context))
            turns = [(t["role"], t["content"]) for t in turns if isinstance(t, dict)] if isinstance(turns, list) else []
        else:
            turns = [("user", row["instruction"])] if row["instruction"] else []
            while len(turns) < self.num_turns:  # each pass adds one turn
                role = "assistant" if len(turns) % 2 else "user"
                text = self.ask(row, task="turn", role=role, count=len(turns), context=context, history="\n".join(f"{r}: {t}" for r, t in turns))
                turns.append((role, re.sub(rf"^{role}:\s*", "", text)))
        if len(turns) < 2:
            raise ParseFailure("no dialogue")
        more = [{"from": "human" if r == "user" else "gpt", "value": t} for r, t in turns[2:]]
        return [{"instruction": turns[0][1], "input": row["input"], "output": turns[1][1], "task_type": "conversational", "metadata": {"turns": more} if more else {}}]


STRATEGIES = ("add_constraints", "deepen", "concretize", "increase_reasoning", "broaden")


@dataclass
class EvolInstruct(Task):
    num_evolutions: int = 1
    strategies: tuple[str, ...] = STRATEGIES
    generate_answers: bool = True

    def children(self, row: Row) -> list[Row]:
        out = []
        for i in range(self.num_evolutions):
            strategy = self.strategies[i % len(self.strategies)]
            text = self.ask(row, task="evolve", strategy=strategy, instruction=row["instruction"])
            value = json_of(text)
            evolved = str(value.get("instruction", "")) if isinstance(value, dict) else text
            if not evolved.strip():
                continue
            answer = row["output"]
            if self.generate_answers:
                try:
                    answer = self.ask(row, task="answer", instruction=evolved, context=row["input"] or evolved)
                except Exception:  # noqa: BLE001
                    answer = ""
            out.append({"instruction": evolved, "input": row["input"], "output": answer, "task_type": "instruction_following", "metadata": {"evolution_strategy": strategy, "original_instruction": row["instruction"]}})
        return out


@dataclass
class ChainOfThought(Task):
    mode: str = "generate"
    cot_marker: str = "\n\n## Answer\n"

    def children(self, row: Row) -> list[Row]:
        text = self.ask(row, task="reason", instruction=row["instruction"], context=self.context(row) or row["instruction"])
        value = json_of(text)
        reasoning, answer = (str(value.get("reasoning", "")), str(value.get("answer", ""))) if isinstance(value, dict) else (text, "")
        if self.mode == "wrap" or not answer:
            answer = row["output"] or answer
        return [{"instruction": row["instruction"], "input": row["input"], "output": f"## Reasoning\n{reasoning}{self.cot_marker}{answer}", "task_type": "instruction_following", "metadata": {"has_cot": True}}]


#: Kinds of wrong answers: of preference pairs, of generated pairs, and of injected ones.
INJECTIONS = ("contradicts_source", "parametric_drift", "domain_mismatch", "instruction_quality")
QA_INJECTIONS = (*INJECTIONS[:2], "high_temperature_drift", *INJECTIONS[2:])
ALL_INJECTIONS = (*INJECTIONS[:2], "cross_chunk_drift", "high_temperature_drift", *INJECTIONS[2:])


def planned(samples: DataFrame, share: float, types: tuple[str, ...], seed: int) -> DataFrame:
    """``samples`` with ``_kind``: a kind each for a share of them, one at least, those of the least keyed hash; else null."""
    n = samples.count()
    k = min(n, max(1, round(n * share))) if share > 0 else 0
    kind = F.element_at(F.array(*map(F.lit, types)), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit("type")), F.lit(len(types))) + 1).cast("int"))
    return _chosen(samples, seed, F.when(F.col("_place") < k, kind))


def _chosen(samples: DataFrame, seed: int, kind: Column) -> DataFrame:
    """``samples`` with ``_kind`` by ``_place``, their place in order of a keyed hash."""
    ranked = numbered(samples.select("_seq", "id", F.xxhash64("id", F.lit(seed)).alias("_h")), "_h", "id", "_seq", name="_place")
    return samples.join(ranked.select("_seq", "id", kind.alias("_kind")).where("_kind IS NOT NULL"), ["_seq", "id"], "left")


@dataclass
class AdversarialPreference(Task):
    num_questions: int = 1
    injection_rate: float = 0.5
    injection_types: tuple[str, ...] = INJECTIONS
    seed: int = 42

    def children(self, row: Row) -> list[Row]:
        context = self.context(row)
        out = []
        for k, (q, a) in enumerate(qa_pairs(self.ask(row, task="qa", count=self.num_questions, context=context))):
            adversarial = chance(self.seed, row["id"], k) < self.injection_rate
            kind = self.injection_types[int(chance(self.seed, row["id"], k, "type") * len(self.injection_types))]
            bad = self.ask(row, temperature=0.8, task="bad", kind=kind, instruction=q, context=context) if adversarial else self.ask(row, temperature=1.1, task="answer", instruction=q, context=q)
            if bad.strip():
                out.append({"instruction": q, "input": context, "chosen": a, "rejected": bad, "task_type": "preference", "metadata": {"adversarial": adversarial, "injection_type": kind if adversarial else "naive_high_temp"}})
        return out


@dataclass
class AdversarialQAGeneration(QAGeneration):
    """Question and answer pairs, wrong ones for a share of the samples, by kinds."""

    injection_rate: float = 0.2
    injection_types: tuple[str, ...] = QA_INJECTIONS
    high_temp: float = 1.4
    seed: int = 42

    def prepared(self, samples: DataFrame) -> DataFrame:
        return planned(samples, self.injection_rate, self.injection_types, self.seed)

    def children(self, row: Row) -> list[Row]:
        made = super().children(row)
        if kind := row.get("_kind"):
            for child in made:
                again = {"task": "answer"} if kind == "high_temperature_drift" else {"task": "bad", "kind": kind}
                child["output"] = self.ask(row, temperature=self.high_temp, **again, instruction=child["instruction"], context=child["input"])
                child["metadata"] = {"injected_failure": True, "injection_type": kind}
        return made


@dataclass
class BadSampleInjector:
    """Replaces answers by wrong ones: of a share of the samples, or of counts by kind, those of the least keyed hash.

    A sample without question or source, and one for which the model fails, stays as it is.
    """

    llm: LLM
    seed: int = 42
    types: tuple[str, ...] = ALL_INJECTIONS
    high_temp: float = 1.4

    def _row(self, row: Row) -> list[Row]:
        kind, source, question = row.get("_kind"), (row["input"] or "").strip() or (row["output"] or "").strip(), (row["instruction"] or "").strip()
        if kind is None or not source or not question:
            return [row]
        try:
            if kind == "high_temperature_drift":
                bad = self.llm.generate(prompt(task="answer", instruction=question, context=source), temperature=self.high_temp).text
            else:
                bad = self.llm.generate(prompt(task="bad", kind=kind, instruction=question, context=source), temperature=0.9).text
        except Exception:  # noqa: BLE001
            return [row]
        if not bad.strip():
            return [row]
        meta = json.loads(row["metadata"] or "{}") | {"injected_failure": True, "injection_type": kind, "original_sample_id": row["id"]}
        return [row | {"output": bad, "metadata": json.dumps(meta, ensure_ascii=False)}]

    def inject(self, samples: DataFrame, fraction: float = 0.2) -> DataFrame:
        return checkpointed(map_rows(planned(samples, fraction, self.types, self.seed), lambda: self._row, samples.schema))

    def inject_by_type(self, samples: DataFrame, counts: dict[str, int]) -> DataFrame:
        kind, end = F.lit(None).cast("string"), 0
        for name, n in counts.items():
            end += n
            kind = F.coalesce(kind, F.when(F.col("_place") < end, F.lit(name)))
        return checkpointed(map_rows(_chosen(samples, self.seed, kind), lambda: self._row, samples.schema))
