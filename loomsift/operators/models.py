"""Language-model backends, and running a function of rows that calls one."""

from __future__ import annotations

import hashlib
import json
import random
import re
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomsift.functions.batches import slices

Messages = list[dict[str, str]]


@dataclass
class Reply:
    text: str
    model: str = ""
    prompt_tokens: int = 0
    completion_tokens: int = 0
    latency: float = 0.0


@dataclass
class LLM:
    """A backend: ``call`` is what a subclass provides; ``generate`` tries again with growing pauses."""

    model: str = "none"
    temperature: float = 0.7
    max_tokens: int = 1024
    max_retries: int = 3
    timeout: float = 120.0
    pause: float = 1.0

    def call(self, messages: Messages, temperature: float, max_tokens: int, stop: list[str] | None) -> Reply:
        raise NotImplementedError

    def generate(self, messages: Messages, temperature: float | None = None, max_tokens: int | None = None, stop: list[str] | None = None) -> Reply:
        for attempt in range(self.max_retries + 1):
            try:
                start = time.monotonic()
                reply = self.call(messages, self.temperature if temperature is None else temperature, max_tokens or self.max_tokens, stop)
                return replace(reply, text=without_thinking(reply.text), model=reply.model or self.model, latency=time.monotonic() - start)
            except Exception:
                if attempt == self.max_retries:
                    raise
                time.sleep(min(30.0, self.pause * 2**attempt * random.uniform(0.5, 1.5)))
        raise AssertionError

    def config_hash(self) -> str:
        return hashlib.sha256(json.dumps([self.model, self.temperature, self.max_tokens]).encode()).hexdigest()[:16]


def without_thinking(text: str) -> str:
    """A reply without its ``<think>`` part, or that part if there is nothing else."""
    rest = re.sub(r"<think>.*?(?:</think>|\Z)", "", text, flags=re.S).strip()
    inner = re.search(r"<think>(.*?)(?:</think>|\Z)", text, re.S)
    return rest or (inner.group(1).strip() if inner else text.strip())


def _post(url: str, body: dict[str, Any], timeout: float, headers: dict[str, str] | None = None) -> dict[str, Any]:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | (headers or {}))
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return json.load(r)


@dataclass
class OllamaLLM(LLM):
    url: str = "http://localhost:11434"

    def call(self, messages: Messages, temperature: float, max_tokens: int, stop: list[str] | None) -> Reply:
        r = _post(f"{self.url}/api/chat", {"model": self.model, "messages": messages, "stream": False, "options": {"temperature": temperature, "num_predict": max_tokens, **({"stop": stop} if stop else {})}}, self.timeout)
        return Reply(r["message"]["content"], self.model, r.get("prompt_eval_count", 0), r.get("eval_count", 0))


@dataclass
class ChatCompletionsLLM(LLM):
    """Any server of the common chat-completions interface."""

    url: str = "http://localhost:8000/v1"
    api_key: str = ""

    def call(self, messages: Messages, temperature: float, max_tokens: int, stop: list[str] | None) -> Reply:
        r = _post(f"{self.url}/chat/completions", {"model": self.model, "messages": messages, "temperature": temperature, "max_tokens": max_tokens, **({"stop": stop} if stop else {})}, self.timeout, {"Authorization": f"Bearer {self.api_key}"} if self.api_key else None)
        use = r.get("usage", {})
        return Reply(r["choices"][0]["message"]["content"], self.model, use.get("prompt_tokens", 0), use.get("completion_tokens", 0))


def section(prompt: str, name: str) -> str:
    """What stands under ``[name]`` in a prompt of ours."""
    at = prompt.find(f"[{name}]\n")
    if at < 0:
        return ""
    at += len(name) + 3
    end = _NEXT_PART.search(prompt, at)
    return prompt[at : end.start() if end else len(prompt)].strip()


_NEXT_PART = re.compile(r"\n\[[a-z_ ]+\]\n")


def hundredths(x: float) -> float:
    """Two places, halves of a hundredth to even, as SQL's round_even has it; Python's round sees the binary fraction."""
    return round(x * 100) / 100


def overlap(answer: str, context: str) -> float:
    """Share of an answer's words that the context has."""
    words = re.findall(r"\w+", answer.lower())
    known = set(re.findall(r"\w+", context.lower()))
    return sum(w in known for w in words) / len(words) if words else 0.0


@dataclass
class FakeLLM(LLM):
    """Deterministic stand-in: answers by rules from the parts of the prompt, so that tests need no model."""

    model: str = "fake"
    max_retries: int = 0

    def call(self, messages: Messages, temperature: float, max_tokens: int, stop: list[str] | None) -> Reply:
        prompt = messages[-1]["content"]
        text = self.answer(section(prompt, "task"), prompt, temperature)
        return Reply(text, self.model, len(prompt.split()), len(text.split()))

    def answer(self, task: str, prompt: str, temperature: float) -> str:
        part = lambda name: section(prompt, name)
        context = part("context") or part("instruction")
        sentences = [s for s in re.split(r"(?<=[.!?])\s+", context) if s.strip()] or [context]
        pick = lambda k: sentences[k % len(sentences)]
        n = int(part("count") or 1)
        shown = lambda s: " ".join(s.split()[:40])
        match task:
            case "qa":
                return json.dumps([{"question": f"What is said about {' '.join(pick(k).split()[:3])}?", "answer": shown(pick(k))} for k in range(n)])
            case "preference":
                return json.dumps({"instruction": part("instruction") or f"Explain: {' '.join(pick(0).split()[:5])}", "chosen": shown(pick(0)), "rejected": "It is not known."})
            case "answer" | "rewrite":
                return shown(pick(0)) if temperature < 1 else "It may well be otherwise."
            case "score":
                return json.dumps({"score": hundredths(overlap(part("answer"), context))})
            case "turn":
                return f"{part('role')}: {shown(pick(int(part('count') or 0)))}"
            case "dialogue":
                return json.dumps([{"role": "user" if k % 2 == 0 else "assistant", "content": shown(pick(k))} for k in range(2 * n)])
            case "evolve":
                return json.dumps({"instruction": f"{part('instruction')} ({part('strategy')})"})
            case "reason":
                return json.dumps({"reasoning": shown(pick(0)), "answer": shown(pick(-1))})
            case "bad":
                return f"Unlike the source, {part('kind')}: nothing of it holds."
            case "grounding":
                score = hundredths(overlap(part("answer"), context))
                return json.dumps({"grounding_score": score, "verdict": "grounded" if score >= 0.7 else "ungrounded", "supported_claims": [], "unsupported_claims": [] if score >= 0.7 else [part("answer")[:80]]})
            case "reward":
                k = len(part("answer").split())
                score = round(min(1.0, k / 20), 2)
                return json.dumps({"overall_score": score, "scores": {d: round(score * (1 - 0.1 * i), 2) for i, d in enumerate(part("dimensions").split(", "))}, "strengths": [], "weaknesses": [] if score >= 0.7 else ["too short"]})
            case "toxicity":
                return json.dumps({"toxicity_score": 0.9 if re.search(r"idiot|moron|scum", part("answer").lower()) else 0.1, "categories": [], "reasoning": ""})
        return ""


def unfenced(text: str) -> str:
    m = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    return (m.group(1) if m else text).strip()


def json_of(text: str) -> Any:
    """The value that a reply holds: all of it, or its first list or object; None if there is none."""
    body = unfenced(text)
    for part in (body, *(m.group(0) for p in (r"\[.*\]", r"\{.*\}") if (m := re.search(p, body, re.S)))):
        try:
            return json.loads(part)
        except ValueError:
            continue
    return None


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict[str, Any]], list[dict[str, Any]]]], schema: StructType) -> DataFrame:
    """Each row through a function made once for each task; rows out of it by the schema's names."""
    arrow = to_arrow_schema(schema)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in slices(batch, 1 << 20, 128):  # a row may have many children, each with all of its text
                rows = [{n: r.get(n) for n in names} for row in part.to_pylist() for r in fn(row)]
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return df.mapInArrow(run, schema)
