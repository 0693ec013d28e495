"""The canonical sample: one row for every task type."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsift.functions.store import checkpointed

PROVENANCE = "struct<step_name:string,step_version:string,timestamp:timestamp_ntz,config_hash:string,notes:string>"
DIAGNOSIS = "struct<mode:string,was_recovered:boolean,evidence:array<boolean>,probe_calls:int,notes:string>"
FIELDS = {
    "id": "string",
    "source_uri": "string",
    "instruction": "string",
    "input": "string",
    "output": "string",
    "chosen": "string",
    "rejected": "string",
    "label": "double",
    "responses": "array<string>",
    "reward_scores": "array<double>",
    "task_type": "string",
    "metadata": "string",
    "provenance_chain": f"array<{PROVENANCE}>",
}
SAMPLE_DDL = ", ".join(f"{k} {v}" for k, v in {"_seq": "bigint", **FIELDS}.items())
REJECTED_DDL = f"{SAMPLE_DDL}, rejection_reason string, rejecting_step string, diagnosis {DIAGNOSIS}"
STEP_VERSION = "1.0.0"


def default(name: str) -> Column:
    kind = FIELDS[name]
    if name == "label":
        return F.lit(None).cast("double")
    if kind.startswith("array"):
        return F.from_json(F.lit("[]"), kind) if "struct" not in kind else F.array().cast(kind)
    return F.lit({"task_type": "instruction_following", "metadata": "{}"}.get(name, ""))


class Sample(dict):
    """A finished sample, by fields, that a preprocessing function may return; its row isn't held against any format."""


def as_samples(df: DataFrame, seq: Column | str, source_uri: str | Column = "memory", carried: tuple[str, ...] = (), **columns: Column | str) -> DataFrame:
    """A frame of samples from expressions for some of the fields; null texts become empty. ``carried``: columns beside."""
    made = {"_seq": (F.col(seq) if isinstance(seq, str) else seq).cast("bigint")}
    uri = F.lit(source_uri) if isinstance(source_uri, str) else source_uri
    for name, kind in FIELDS.items():
        c = columns.get(name)
        c = default(name) if c is None else F.col(c) if isinstance(c, str) else c
        if name == "source_uri" and "source_uri" not in columns:
            c = uri
        if kind == "string" and name != "id":
            c = F.coalesce(c.cast("string"), default(name))
        made[name] = c.cast(kind)
    if "id" not in columns:
        made["id"] = sample_id(made["source_uri"], made["_seq"])
    return df.select(*(c.alias(k) for k, c in made.items()), *carried)


def sample_id(*parts: Column) -> Column:
    """Ids that a recomputed partition gives again."""
    return F.substring(F.sha2(F.concat_ws("\u0001", *(p.cast("string") for p in parts)), 256), 1, 32)


def numbered(df: DataFrame, *order: str, name: str = "_seq") -> DataFrame:
    """Rows with ``name``, their places from 0 in an order, by the sizes of ranges of it; all ranges are sorted at once."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    sorted_ = checkpointed(sorted_)  # the numbers below must be of the ranges that were counted
    part = F.shiftright("_at", 33)
    sizes = sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    starts, at = [], 0
    for r in sizes:
        starts.append((r.part, at))
        at += r.n
    table = df.sparkSession.createDataFrame(starts or [(0, 0)], "_part long, _start long")
    placed = sorted_.withColumn("_part", part).join(F.broadcast(table), "_part")
    return placed.withColumn(name, F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_start")).drop("_at", "_part", "_start")


def config_hash(config: dict[str, Any]) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def with_provenance(df: DataFrame, step: str, notes: Column | dict[str, Any], config: dict[str, Any] | None = None, version: str = STEP_VERSION) -> DataFrame:
    """The step's record, appended to each row's chain."""
    text = F.lit(json.dumps(notes)) if isinstance(notes, dict) else notes
    record = F.struct(F.lit(step).alias("step_name"), F.lit(version).alias("step_version"), F.to_timestamp_ntz(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("string")).alias("timestamp"), F.lit(config_hash(config or {})).alias("config_hash"), text.alias("notes"))
    return df.withColumn("provenance_chain", F.array_append("provenance_chain", record.cast(PROVENANCE)))


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with a column that filters on it don't compute again: none is pushed below what explodes a list."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def split_gate(df: DataFrame, reason: Column, step: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose reason is null, and the others as rejected samples."""
    marked = once(df, reason, "rejection_reason")
    rejected = marked.where("rejection_reason IS NOT NULL").withColumn("rejecting_step", F.lit(step)).withColumn("diagnosis", F.lit(None).cast(DIAGNOSIS))
    return marked.where("rejection_reason IS NULL").drop("rejection_reason"), rejected


# --- samples from the test tables ---------------------------------------------------------------------------------


def samples_lm(documents: DataFrame) -> DataFrame:
    """Each document as text to model."""
    return as_samples(documents, "doc_id", "documents", id=F.col("doc_id").cast("string"), output="text", task_type=F.lit("language_modeling"), metadata=F.to_json(F.struct("lang", "source")))


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turns in order."""
    return conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("turns"))


def of_role(turns: Column | str, role: str) -> Column:
    return F.filter(turns, lambda t: t["role"] == role)


def samples_sft(conversations: DataFrame) -> DataFrame:
    """The first question and the first answer of each conversation."""
    first = lambda role: F.get(of_role("turns", role), F.lit(0))["content"]
    return as_samples(turns_of(conversations), "conv_id", "conversations", id=F.col("conv_id").cast("string"), instruction=first("user"), output=first("assistant"), task_type=F.lit("conversational"))


def samples_pref(conversations: DataFrame) -> DataFrame:
    """The first answer as chosen and the shortest other one as rejected, of conversations with two answers."""
    answers = of_role("turns", "assistant")
    shortest = F.array_min(F.transform(F.slice(answers, F.lit(2), F.size(answers)), lambda t: F.struct(F.length(t["content"]).alias("n"), t["content"].alias("x"))))["x"]
    rows = turns_of(conversations).where(F.size(answers) >= 2)
    return as_samples(rows, "conv_id", "conversations", id=F.col("conv_id").cast("string"), instruction=F.get(of_role("turns", "user"), F.lit(0))["content"], chosen=answers[0]["content"], rejected=shortest, task_type=F.lit("preference"))


def samples_grpo(conversations: DataFrame) -> DataFrame:
    """All answers as rollouts, rewarded by their share of the longest."""
    answers = F.transform(of_role("turns", "assistant"), lambda t: t["content"])
    most = F.array_max(F.transform(answers, F.length))
    rows = turns_of(conversations)
    return as_samples(rows, "conv_id", "conversations", id=F.col("conv_id").cast("string"), instruction=F.get(of_role("turns", "user"), F.lit(0))["content"], responses=answers, reward_scores=F.transform(answers, lambda x: F.round(F.length(x) / most, 6)), task_type=F.lit("grpo"))


def samples_unpaired(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents: the first line as instruction, all of it as output."""
    rows = documents.join(labels, "doc_id")
    return as_samples(rows, "doc_id", "documents", id=F.col("doc_id").cast("string"), instruction=F.substring_index("text", "\n", 1), output="text", label=F.expr("try_cast(quality AS double)"), task_type=F.lit("unpaired_preference"))


def in_order(*keys: str):  # noqa: ANN201
    return Window.partitionBy(*keys).orderBy("_seq", "id")
