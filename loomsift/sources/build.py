"""From raw rows to samples: mapping, preprocessing, and one projection for each format."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsift.functions.samples import DIAGNOSIS, FIELDS, Sample, as_samples, of_role, sample_id, with_provenance
from loomsift.sources.detect import Detection, commit
from loomsift.sources.readers import Source

ROLES = {
    **dict.fromkeys(("human", "user", "input", "user_input", "question"), "user"),
    **dict.fromkeys(("gpt", "assistant", "model", "output", "chatgpt", "bot", "ai"), "assistant"),
    **dict.fromkeys(("system", "system_prompt"), "system"),
}
KNOWN_ROLES = {*ROLES.values(), "tool", "function", "tool_response"}
TURNS = "array<map<string,string>>"
TURN = "struct<role:string,content:string,extra:string>"


def normalized_turns(turns: Column) -> Column:
    """Turns of either naming as role and content, roles by their canonical name; other keys are kept as JSON."""
    names = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))

    def one(t: Column) -> Column:
        role = F.coalesce(t["role"], t["from"], F.lit(""))
        rest = F.map_filter(t, lambda k, _: ~k.isin("role", "from", "content", "value"))
        return F.struct(F.coalesce(names[F.lower(F.trim(role))], F.lower(F.trim(role))).alias("role"), F.coalesce(t["content"], t["value"], F.lit("")).alias("content"), F.when(F.size(F.map_keys(rest)) > 0, F.to_json(rest)).alias("extra"))

    return F.transform(turns, one)


def unknown_roles(turns: Column) -> Column:
    """``turn_i:unknown_role:r`` for each role that isn't known."""
    marked = F.transform(turns, lambda t, i: F.when(~t["role"].isin(*sorted(KNOWN_ROLES)), F.concat(F.lit("turn_"), i.cast("string"), F.lit(":unknown_role:"), t["role"])))
    return F.filter(marked, lambda x: x.isNotNull())


def common_prefix(a: Column, b: Column) -> Column:
    """The turns that two conversations begin with."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: (x["role"] == y["role"]) & (x["content"] == y["content"]))
    at = F.array_position(same, False)
    return F.slice(a, F.lit(1), F.when(at == 0, n).otherwise(at - 1).cast("int"))


def turns_json(turns: Column) -> Column:
    return F.to_json(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))))


def parse_turns(text: Column) -> Column:
    return normalized_turns(F.from_json(text, TURNS))


def mapped(raw: Column, mapping: dict[str, str]) -> Column:
    """Cells under other names: a plain source is renamed, a dotted path copied if it has a value."""
    out = raw
    for source, target in mapping.items():
        if "." in source:
            value = F.get_json_object(out_text(out), "$." + source)
            out = F.when(value.isNotNull(), F.map_concat(F.map_filter(out, lambda k, _: k != target), F.create_map(F.lit(target), value))).otherwise(out)
        else:
            has = F.map_contains_key(out, source)
            out = F.when(has, F.map_concat(F.map_filter(out, lambda k, _: ~k.isin(source, target)), F.create_map(F.lit(target), out[source]))).otherwise(out)
    return out


def out_text(cells: Column) -> Column:
    """Cells as one JSON object, those that are objects or lists themselves nested."""
    pairs = F.transform(F.map_entries(cells), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), F.when(e["value"].isNull(), "null").when(e["value"].rlike(r"^\s*[\[{]"), e["value"]).otherwise(_quoted(e["value"]))))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def _quoted(text: Column) -> Column:
    """A JSON string of a text."""
    inner = F.to_json(F.array(text))
    return F.substring(inner, F.lit(2), F.length(inner) - 2)


def loaded(fn: str | Callable | None) -> Callable[[dict[str, Any]], Any] | None:
    if fn is None or fn == "identity":
        return None
    if isinstance(fn, str):
        module, _, name = fn.rpartition(".")
        fn = getattr(importlib.import_module(module), name)
    if not callable(fn):
        raise TypeError(f"not callable: {fn!r}")
    return fn


def preprocessed(rows: DataFrame, fn: Callable[[dict[str, Any]], Any]) -> DataFrame:
    """Rows after a user's function of a dict; nothing returned, or an exception, makes an error of the row. ``finished``:
    whether it returned a Sample.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, errors, finished = [], [], []
            for raw, error in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                made = None
                if error is None:
                    try:
                        made = fn(json.loads(raw))
                        raw, error = (None, "preprocessing_fn_returned_none") if made is None else (json.dumps(made, ensure_ascii=False), None)
                    except Exception as e:  # noqa: BLE001
                        error = f"preprocessing_fn_error:{e}"
                raws.append(raw)
                errors.append(error)
                finished.append(error is None and isinstance(made, Sample))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(raws, pa.string()), pa.array(errors, pa.string()), pa.array(finished, pa.bool_())], ["place", "line", "raw", "error", "finished"])

    return rows.select("place", "line", "raw", "error").mapInArrow(run, "place long, line long, raw string, error string, finished boolean")


def finished_samples(rows: DataFrame, uri: Column) -> DataFrame:
    """Samples from rows that are samples already, by their fields."""
    text = lambda name: F.get_json_object("raw", f"$.{name}")
    made = {name: text(name) if kind == "string" else F.from_json(text(name), kind) for name, kind in FIELDS.items() if name not in ("id", "source_uri", "label", "provenance_chain")}
    made["responses"], made["reward_scores"] = (F.coalesce(made[k], F.from_json(F.lit("[]"), FIELDS[k])) for k in ("responses", "reward_scores"))
    own = F.coalesce(F.nullif(text("id"), F.lit("")), sample_id(uri, F.col("_order")))
    return as_samples(rows, "_order", source_uri=uri, carried=("line",), id=own, label=text("label").try_cast("double"), **made)


def projection(found: Detection) -> tuple[dict[str, Column], Column]:
    """Sample fields of a format from ``cells``, and the reason where none can be built."""
    m = found.column_map
    cell = lambda slot: F.col("cells")[m[slot]] if slot in m else F.lit(None).cast("string")
    text = lambda slot: F.coalesce(cell(slot), F.lit(""))
    rest = F.map_filter("cells", lambda k, _: ~k.isin(*m.values(), "id", "source_uri") if m else F.lit(True))
    extra: list[tuple[str, Column]] = []
    if "system" in m and found.format != "sharegpt":
        extra.append(("system_prompt", cell("system")))
    ok = F.lit(None).cast("string")
    match found.format:
        case "alpaca":
            made = {"instruction": text("instruction"), "input": text("context"), "output": text("output"), "task_type": F.lit("instruction_following")}
            if not {"instruction", "output"} <= m.keys():
                ok = F.lit("construction_returned_none")
        case "sharegpt":
            turns = F.coalesce(parse_turns(cell("conversation")), F.from_json(F.lit("[]"), f"array<{TURN}>"))
            has_system = F.coalesce(F.get(turns, F.lit(0))["role"] == "system", F.lit(False))
            talk = F.when(has_system, F.slice(turns, F.lit(2), F.greatest(F.size(turns), F.lit(1)))).otherwise(turns)
            first = lambda role: F.coalesce(F.get(of_role(talk, role), F.lit(0))["content"], F.lit(""))
            made = {"instruction": first("user"), "output": first("assistant"), "task_type": F.lit("conversational")}
            extra += [("system_prompt", F.when(has_system, turns[0]["content"])), ("turns", F.when(F.size(talk) > 2, turns_json(F.slice(talk, F.lit(3), F.greatest(F.size(talk), F.lit(1))))))]
            ok = F.when(F.size(turns) == 0, F.lit("construction_returned_none"))
        case "preference" | "implicit_preference":
            side = lambda s: F.when(text(s).rlike(r"^\s*\["), F.coalesce(turns_json(parse_turns(cell(s))), text(s))).otherwise(text(s))
            made = {"instruction": text("instruction"), "chosen": side("chosen"), "rejected": side("rejected"), "task_type": F.lit(found.format)}
            if found.format == "implicit_preference":
                shared = common_prefix(parse_turns(cell("chosen")), parse_turns(cell("rejected")))
                n = F.coalesce(F.size(shared), F.lit(0))
                made["instruction"] = F.when(n > 0, turns_json(shared)).otherwise("")
                extra.append(("implicit_prompt_warning", F.when((n == 0) & text("chosen").rlike(r"^\s*\["), F.lit("no_common_prefix"))))
        case "unpaired_preference":
            label = F.when(F.lower(cell("label")) == "true", 1.0).when(F.lower(cell("label")) == "false", 0.0).otherwise(cell("label").try_cast("double"))
            made = {"instruction": text("instruction"), "input": text("context"), "output": text("output"), "label": label, "task_type": F.lit("unpaired_preference")}
        case "grpo":
            listed = text("responses").rlike(r"^\s*\[")
            made = {
                "instruction": text("instruction"),
                "responses": F.when(listed, F.from_json(cell("responses"), "array<string>")).otherwise(F.array(text("responses"))),
                "reward_scores": F.when(text("rewards").rlike(r"^\s*\["), F.transform(F.from_json(cell("rewards"), "array<string>"), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)))).when(cell("rewards").isNotNull(), F.array(F.coalesce(cell("rewards").try_cast("double"), F.lit(0.0)))).otherwise(F.from_json(F.lit("[]"), "array<double>")),
                "task_type": F.lit("grpo"),
            }
        case "prompt_only":
            made = {"instruction": text("instruction"), "task_type": F.lit("prompt_only")}
        case _:
            made = {"output": text("text"), "task_type": F.lit("language_modeling")}
    for name, value in extra:
        rest = F.when(value.isNull(), rest).otherwise(F.map_concat(F.map_filter(rest, lambda k, _: k != name), F.create_map(F.lit(name), value)))
    made["metadata"] = out_text(rest)
    return made, ok


def ingest(spark: SparkSession, source: Source, ordinal: int = 0) -> tuple[DataFrame, DataFrame, Detection]:
    """Samples and rejects of one source: every row is in exactly one of the two."""
    rows = source.rows(spark)
    fn = loaded(source.preprocessing_fn)
    rows = preprocessed(rows, fn) if fn else rows.withColumn("finished", F.lit(False))
    cells = F.from_json("raw", "map<string,string>")
    rows = rows.withColumn("cells", mapped(cells, source.field_mapping) if source.field_mapping else cells)
    text = out_text(F.col("cells")) if source.field_mapping else F.col("raw")
    head = [json.loads(r.t) for r in rows.where("error IS NULL AND NOT finished").orderBy("place").limit(source.detection_sample_size).select(text.alias("t")).collect()]
    found, refusal = commit(head, source.format)
    made, why = projection(found) if not refusal else ({}, F.lit(refusal))
    missing = [c for c in found.column_map.values() if found.confidence == "high" and source.format != "auto" and all(c not in r for r in head)]
    reason = F.coalesce("error", F.when(~F.col("finished"), F.lit("construction_returned_none") if missing else why))
    order = F.lit(ordinal).cast("bigint") * (1 << 40) + F.col("place") + 1
    marked = rows.withColumn("rejection_reason", reason).withColumn("_order", order)

    uri = F.coalesce(F.nullif(F.col("cells")["source_uri"], F.lit("")), F.lit(source.uri))
    own = {}
    if any("id" in r for r in head):  # an id of the row's own takes the made one's place
        own["id"] = F.coalesce(F.nullif(F.col("cells")["id"], F.lit("")), sample_id(uri, F.col("_order")))
    good = marked.where("rejection_reason IS NULL AND NOT finished")
    notes = {"source_uri": source.uri, "detected_format": found.format, "detection_confidence": found.confidence, "column_map": found.column_map, "field_mapping_applied": bool(source.field_mapping), "detection_warnings": found.warnings, "unrecognized_cols": found.unrecognized}

    def recorded(df: DataFrame, notes: dict[str, Any]) -> DataFrame:
        number = F.concat(F.lit(json.dumps(notes)[:-1] + ', "line_number": '), F.col("line").cast("string"), F.lit("}"))
        return with_provenance(df, "Connector", number, notes).drop("line")

    samples = recorded(as_samples(good, "_order", source_uri=uri, carried=("line",), **own, **made), notes)
    if fn:
        done = finished_samples(marked.where("rejection_reason IS NULL AND finished"), uri)
        samples = samples.unionByName(recorded(done, {"source_uri": source.uri, "detected_format": "finished_sample"}))

    bad = marked.where("rejection_reason IS NOT NULL")
    preview = F.map_from_entries(F.transform(F.slice(F.map_entries("cells"), 1, 5), lambda e: F.struct(e["key"], F.substring(e["value"], 1, 200))))
    shown = F.to_json(F.struct(preview.alias("raw_preview"), F.col("line").alias("line_number")))
    rejected = as_samples(bad, "_order", source.uri, carried=("rejection_reason",), metadata=shown)
    rejected = rejected.withColumn("rejecting_step", F.lit("Connector")).withColumn("diagnosis", F.lit(None).cast(DIAGNOSIS))
    if source.max_samples is not None:
        samples = samples.orderBy("_seq").limit(source.max_samples)
    return samples, rejected, found


def ingest_all(spark: SparkSession, sources: list[Source]) -> tuple[DataFrame, DataFrame]:
    """All sources, one after the other in order."""
    parts = [ingest(spark, s, i)[:2] for i, s in enumerate(sources)]
    samples, rejected = parts[0]
    for s, r in parts[1:]:
        samples, rejected = samples.unionByName(s), rejected.unionByName(r)
    return samples, rejected


__all__ = ["FIELDS", "common_prefix", "ingest", "ingest_all", "normalized_turns", "parse_turns", "projection", "turns_json"]
