"""What format a file's rows are in, from their column names and the values of the first row."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

ALIASES: dict[str, tuple[str, ...]] = {
    "instruction": ("instruction", "prompt", "query", "question", "user_input", "user_query", "user_message", "human", "input"),
    "output": ("output", "response", "completion", "answer", "assistant", "gpt", "model", "model_response", "target", "label_text"),
    "context": ("input", "context", "background", "passage", "article", "document", "text_input"),
    "conversation": ("conversations", "messages", "chat", "dialogue", "dialog", "turns", "history"),
    "chosen": ("chosen", "preferred", "accepted", "response_a", "response_0", "positive"),
    "rejected": ("rejected", "refused", "dispreferred", "response_b", "response_1", "negative"),
    "label": ("label", "score", "rating", "reward", "quality", "preference", "rank", "chosen_score", "human_preference"),
    "responses": ("responses", "completions", "candidates", "rollouts", "samples", "outputs"),
    "rewards": ("rewards", "scores", "reward_scores", "values", "returns"),
    "text": ("text", "content", "body", "passage"),
    "system": ("system", "system_prompt", "system_message", "sys_prompt"),
}
FORMATS = ("alpaca", "sharegpt", "preference", "implicit_preference", "unpaired_preference", "grpo", "prompt_only", "pretrain")
ORDER = ("high", "medium", "low", "unknown")


@dataclass
class Detection:
    format: str
    confidence: str
    column_map: dict[str, str] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    unrecognized: list[str] = field(default_factory=list)


def find(slot: str, columns: list[str], without: frozenset[str] = frozenset()) -> str | None:
    """The first alias of a slot, in declared order, that names a column in any case."""
    by_name = {c.lower(): c for c in columns if c not in without}
    return next((by_name[a] for a in ALIASES[slot] if a in by_name), None)


def candidates(columns: list[str]) -> list[Detection]:
    """Formats whose columns are there, in order of the rules."""
    slot = {s: find(s, columns) for s in ALIASES}
    instruction = slot["instruction"]
    # a context is none of the names that would be the instruction, but for "input"
    context = find("context", columns, frozenset(c for c in columns if c.lower() in ALIASES["instruction"] and c.lower() != "input"))
    if context == instruction:
        context = None
    made: list[Detection] = []

    def add(name: str, confidence: str, **used: str | None) -> None:
        full = {k: v for k, v in {**used, "system": slot["system"]}.items() if v}
        made.append(Detection(name, confidence, full, unrecognized=[c for c in columns if c not in full.values()]))

    if slot["chosen"] and slot["rejected"]:
        add("preference" if instruction else "implicit_preference", "high" if instruction else "medium", instruction=instruction, chosen=slot["chosen"], rejected=slot["rejected"])
    if instruction and slot["output"] and slot["label"]:
        add("unpaired_preference", "high", instruction=instruction, output=slot["output"], context=context, label=slot["label"])
    if slot["conversation"]:
        add("sharegpt", "medium", conversation=slot["conversation"])
    if instruction and slot["responses"]:
        add("grpo", "medium", instruction=instruction, responses=slot["responses"], rewards=slot["rewards"])
    if instruction and slot["output"]:
        add("alpaca", "high" if instruction == "instruction" and slot["output"] == "output" else "medium", instruction=instruction, output=slot["output"], context=context)
    if slot["text"] and not (instruction or slot["output"] or slot["chosen"]):
        add("pretrain", "high", text=slot["text"])
    if instruction and not (slot["output"] or slot["conversation"] or slot["chosen"] or slot["responses"]):
        add("prompt_only", "low", instruction=instruction)
    return made


def is_turns(value: Any) -> bool:
    return isinstance(value, list) and bool(value) and isinstance(value[0], dict) and ({"role", "content"} <= value[0].keys() or {"from", "value"} <= value[0].keys())


def objection(found: Detection, row: dict[str, Any]) -> str | None:
    """Why the first row's values speak against a format."""
    value = lambda slot: row.get(found.column_map.get(slot, ""))
    match found.format:
        case "preference" | "implicit_preference":
            if value("chosen") is None or value("rejected") is None:
                return "a side of the pair is missing"
            if is_turns(value("chosen")) != is_turns(value("rejected")):
                return "one side is a conversation and the other isn't"
        case "sharegpt":
            if not is_turns(value("conversation")):
                return "the conversation isn't a list of turns"
        case "grpo":
            r = value("responses")
            if not isinstance(r, list) or not r or not isinstance(r[0], str | list):
                return "the responses aren't a list of texts"
        case "alpaca" | "unpaired_preference":
            if not isinstance(value("instruction"), str):
                return "the instruction isn't text"
        case "pretrain":
            if not isinstance(value("text"), str):
                return "the text isn't text"
    return None


def detect(rows: list[dict[str, Any]], columns: list[str] | None = None) -> Detection:
    """The first format whose columns are there and whose values agree."""
    warnings: list[str] = []
    if columns is None:
        columns = list(dict.fromkeys(k for r in rows for k in r))
        if any(set(r) != set(rows[0]) for r in rows):
            warnings.append("inconsistent_columns")
    for found in candidates(columns):
        if rows and (why := objection(found, rows[0])):
            warnings.append(f"{found.format}:{why}")
            continue
        if not rows and found.confidence == "high":
            found.confidence = "medium"
        if found.confidence == "low":
            warnings.append("low_confidence")
        found.warnings = warnings
        return found
    return Detection("unknown", "unknown", warnings=warnings, unrecognized=columns)


def commit(rows: list[dict[str, Any]], forced: str = "auto") -> tuple[Detection, str | None]:
    """A detection, or with it the reason for which all rows are rejected."""
    found = detect(rows)
    if forced != "auto":
        if forced not in FORMATS:
            return found, f"invalid_forced_format:{forced}"
        columns = list(dict.fromkeys(k for r in rows for k in r))
        own = next((c for c in candidates(columns) if c.format == forced), None)
        return Detection(forced, "high", own.column_map if own else found.column_map, found.warnings, own.unrecognized if own else found.unrecognized), None
    if found.format == "unknown":
        return found, "unrecognized_format:no_known_column_pattern"
    return found, None
