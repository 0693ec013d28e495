"""Exporters, rejects, manifest, checksums and data card."""

from __future__ import annotations

import json
import uuid
import warnings
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsift.functions.files import below, checksums, files_under, opened, remove, write_text
from loomsift.functions.text import PREFERENCE, is_task, strip
from loomsift.operators.normalize import assign_splits


def quoted(text: Column) -> Column:
    inner = F.to_json(F.array(text))
    return F.substring(inner, F.lit(2), F.length(inner) - 2)


def text_or_turns(name: str) -> Column:
    """JSON of a field: the list that it holds as text, else the text."""
    listed = F.col(name).startswith("[") & F.try_parse_json(F.col(name)).isNotNull()
    return F.when(listed, F.col(name)).otherwise(quoted(F.col(name)))


def alpaca_rows(samples: DataFrame) -> DataFrame:
    return samples.select("_seq", "instruction", "input", "output")


def sharegpt_turns() -> Column:
    """Question, answer, then the further turns, by the names of that format."""
    more = F.from_json(F.get_json_object("metadata", "$.turns"), "array<map<string,string>>")
    role = lambda t: F.coalesce(t["from"], t["role"])
    turn = lambda t: F.struct(F.when(role(t) == "user", "human").when(role(t) == "assistant", "gpt").otherwise(role(t)).alias("from"), F.coalesce(t["value"], t["content"]).alias("value"))
    first = F.array(F.struct(F.lit("human").alias("from"), F.col("instruction").alias("value")), F.struct(F.lit("gpt").alias("from"), F.col("output").alias("value")))
    return F.when(F.size(more) > 0, F.concat(first, F.transform(more, turn))).otherwise(first)


def dpo_pairs(samples: DataFrame) -> DataFrame:
    return samples.where(is_task(*PREFERENCE) & (strip("chosen") != "") & (strip("rejected") != ""))


CORPUS_DDL = "source_file string, page int, parent_heading string, chunk_index int, content_type string, table_html string, table_bbox array<double>"


def corpus_rows(samples: DataFrame) -> DataFrame:
    m = F.from_json("metadata", CORPUS_DDL)
    text = F.when(F.col("output") != "", F.col("output")).otherwise(F.col("input"))
    or_ = lambda name, other: F.coalesce(m[name], F.lit(other)).alias(name)
    return samples.select(
        "_seq", text.alias("text"), or_("source_file", ""), "source_uri", m["page"].alias("page"), m["parent_heading"].alias("heading"), m["chunk_index"].alias("chunk_index"),
        or_("content_type", "text"), "task_type", or_("table_html", ""), F.coalesce(m["table_bbox"], F.array().cast("array<double>")).alias("table_bbox"),
    ).where("text <> ''")


def export_lines(samples: DataFrame, form: str) -> DataFrame:
    """``_seq, value``: a line of JSON for each exported sample."""
    whole = lambda df: df.select("_seq", F.to_json(F.struct(*(c for c in df.columns if c != "_seq")), {"ignoreNullFields": "false"}).alias("value"))
    match form:
        case "alpaca":
            return whole(alpaca_rows(samples))
        case "sharegpt":
            return whole(samples.select("_seq", sharegpt_turns().alias("conversations")))
        case "dpo":
            return dpo_pairs(samples).select("_seq", F.concat(F.lit('{"prompt":'), text_or_turns("instruction"), F.lit(',"chosen":'), text_or_turns("chosen"), F.lit(',"rejected":'), text_or_turns("rejected"), F.lit("}")).alias("value"))
        case "grpo":
            return whole(samples.select("_seq", F.col("instruction").alias("prompt"), "responses", F.col("reward_scores").alias("rewards")))
        case "ppo":
            return whole(samples.select("_seq", F.col("instruction").alias("prompt")))
        case "corpus":
            return whole(corpus_rows(samples))
    raise ValueError(f"unknown export format: {form}")


FILES = {"alpaca": "sft_alpaca.jsonl", "sharegpt": "sft_sharegpt.jsonl", "dpo": "dpo.jsonl", "grpo": "grpo.jsonl", "ppo": "ppo.jsonl", "corpus": "corpus.jsonl"}


def write_lines(lines: DataFrame, path: str | Path, single_file: bool = False) -> None:
    """JSON lines in order: a folder of parts, or one file, to which the parts are joined through the driver."""
    ordered = lines.orderBy("_seq").select("value")
    if not single_file:
        ordered.write.mode("overwrite").text(str(path))
        return
    folder = below(str(path).rpartition("/")[0], f".parts-{uuid.uuid4().hex}")
    ordered.write.text(folder)
    system, source = opened(folder)
    _, target = opened(path)
    with system.open_output_stream(target) as out:
        for part in sorted(f.path for f in system.get_file_info(fs.FileSelector(source)) if f.path.rpartition("/")[2].startswith("part-")):
            with system.open_input_stream(part) as f:
                while data := f.read(1 << 20):
                    out.write(data)
    remove(folder)


def warn_if_blank(samples: DataFrame, form: str) -> int:
    """Warns of exports that miss a question or an answer; how many."""
    if form not in ("alpaca", "sharegpt"):
        return 0
    n = samples.where((strip("instruction") == "") | (strip("output") == "")).count()
    if n:
        warnings.warn(f"{form}: {n} rows have a blank instruction or output; preference data is for the dpo format", UserWarning, stacklevel=2)
    return n


def export(samples: DataFrame, forms: list[str], folder: str | Path, split: dict[str, float] | None = None, seed: int = 42, single_file: bool = False) -> dict[str, int]:
    """Writes each format, each split in a folder of its own; rows by format and split."""
    parts = {"": samples}
    if split:
        marked = assign_splits(samples, split, seed)
        parts = {name: marked.where(F.col("split") == name).drop("split") for name in split}
    counts = {}
    for name, rows in parts.items():
        for form in forms:
            if form not in FILES:
                warnings.warn(f"unknown export format {form!r} is skipped", stacklevel=2)
                continue
            warn_if_blank(rows, form)
            lines = export_lines(rows, form)
            write_lines(lines, below(folder, name, FILES[form]), single_file)
            counts[f"{name}/{form}" if name else form] = lines.count()
    return counts


def rejected_breakdown(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy("rejection_reason").agg(F.count("*").alias("n"))


def token_stats(samples: DataFrame) -> DataFrame:
    """Prompt and completion tokens of model calls, from the records of generation steps."""
    notes = samples.select(F.explode("provenance_chain").alias("p")).select("p.step_name", *(F.get_json_object("p.notes", f"$.{k}").cast("long").alias(k) for k in ("prompt_tokens", "completion_tokens")))
    return notes.where("prompt_tokens IS NOT NULL").groupBy("step_name").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


def manifest(passed: DataFrame, rejected: DataFrame, stage_counts: dict[str, dict[str, int]], config_hash: str, seconds: float, diagnostics: dict[str, Any] | None = None) -> dict[str, Any]:
    steps = passed.select(F.explode("provenance_chain").alias("p")).groupBy("p.step_name").agg(F.max("p.notes").alias("notes")).collect()
    notes = {r.step_name: json.loads(r.notes) for r in steps if r.notes and r.step_name != "Connector"}
    sources = [r.source_uri for r in passed.select("source_uri").union(rejected.select("source_uri")).distinct().orderBy("source_uri").collect()]
    dedup = {k: {"input": v["input_count"], "output": v["output_count"], "removed": v["input_count"] - v["output_count"]} for k, v in stage_counts.items() if "dedup" in k.lower()}
    return {
        "pipeline_config_hash": config_hash,
        "run_timestamp": datetime.now(UTC).replace(tzinfo=None).isoformat() + "Z",
        "source_files": sources,
        "stage_counts": stage_counts,
        "rejected_breakdown": {r.rejection_reason: r.n for r in rejected_breakdown(rejected).collect()},
        "dedup_stats": dedup,
        "minhash_threshold": notes.get("MinHashDeduplicator", {}).get("minhash_threshold"),
        "sampler_stats": notes.get("StratifiedSampler"),
        "token_stats": {r.step_name: r.asDict() for r in token_stats(passed).collect()},
        "wall_clock_seconds": round(seconds, 3),
        "tool_versions": {"loomsift": __import__("loomsift").__version__, "spark": passed.sparkSession.version},
        "diversity_stats": stage_counts.get("DiversityGate"),
        "diagnostic_stats": diagnostics,
        "diagnostic_files": ["diagnostic_summary.json"] if diagnostics is not None else [],
    }


def write_checksums(spark: SparkSession, folder: str | Path) -> dict[str, str]:
    """``sha256  path`` of all files under the folder but this one."""
    sums = checksums(spark, folder, [n for n in files_under(folder) if n != "checksums.txt"])
    write_text(below(folder, "checksums.txt"), "".join(f"{h}  {name}\n" for name, h in sums.items()))
    return sums


def data_card(m: dict[str, Any], title: str = "Curated dataset") -> str:
    lines = [f"# {title}", "", f"Made {m['run_timestamp']} by configuration `{m['pipeline_config_hash']}` in {m['wall_clock_seconds']} s.", "", "## Sources", "", *(f"- `{s}`" for s in m["source_files"]), "", "## Stages", "", "| stage | counts |", "|---|---|"]
    lines += [f"| {k} | {', '.join(f'{n} {c}' for n, c in v.items())} |" for k, v in m["stage_counts"].items()]
    lines += ["", "## Rejected", "", "| reason | rows |", "|---|---|"]
    lines += [f"| `{r}` | {n} |" for r, n in sorted(m["rejected_breakdown"].items(), key=lambda x: (-x[1], x[0]))]
    return "\n".join(lines) + "\n"


def write_reports(folder: str | Path, m: dict[str, Any], rejected: DataFrame, single_file: bool = False, diagnostics: dict[str, Any] | None = None) -> None:
    """Rejects, manifest, diagnostics, card and, last, the checksums of all."""
    lines = rejected.select("_seq", F.to_json(F.struct(*(c for c in rejected.columns if c != "_seq")), {"ignoreNullFields": "false"}).alias("value"))
    write_lines(lines, below(folder, "rejected.jsonl"), single_file)
    write_text(below(folder, "manifest.json"), json.dumps(m, indent=2, default=str))
    write_text(below(folder, "dataset_card.md"), data_card(m))
    if diagnostics is not None:
        write_text(below(folder, "diagnostic_summary.json"), json.dumps(diagnostics, indent=2))
    write_checksums(rejected.sparkSession, folder)
