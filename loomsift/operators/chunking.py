"""Document blocks to chunks: by heading, by sentence, in fixed windows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from loomsift.functions.batches import of_each, slices
from loomsift.functions.samples import DIAGNOSIS, as_samples, numbered, with_provenance

BLOCKS_DDL = "doc string, ord bigint, type string, text string, page int, html string, bbox string"
CHUNKS_DDL = "doc string, chunk_index int, text string, heading string, page int, is_table boolean, is_skipped boolean, html string, bbox string"
SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")


def fixed_chunks(texts: DataFrame, max_tokens: int = 512, overlap: int = 50) -> DataFrame:
    """``doc, chunk_index, text`` of windows of tokens of ``doc, text``; the last ones can be overlap only."""
    stride = max(1, max_tokens - overlap)
    schema = StructType([StructField("doc", texts.schema["doc"].dataType), StructField("chunk_index", IntegerType()), StructField("text", StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                index, made, sizes = [], [], []
                for text in part.column(1).to_pylist():
                    words = (text or "").split()  # at the same white space as tokens()
                    starts = range(0, len(words), stride)
                    index += range(len(starts))
                    made += [" ".join(words[i : i + max_tokens]) for i in starts]
                    sizes.append(len(starts))
                docs = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), sizes)))
                yield pa.record_batch([docs, pa.array(index, pa.int32()), pa.array(made, pa.string())], schema=arrow)

    return texts.select("doc", "text").mapInArrow(run, schema)


def last_tokens(text: Column | str, n: int) -> Column:
    """The last n tokens, joined by single spaces; only the end of a text is looked at."""

    @F.arrow_udf("string")
    def tail(texts: pa.Array) -> pa.Array:
        return of_each(texts, lambda t: " ".join(t.rsplit(None, n)[-n:]))

    return tail(text)


def with_overlap(chunks: DataFrame, overlap: int = 50) -> DataFrame:
    """Each chunk of ``doc, chunk_index, text`` begins with the last tokens of the one before it, but at tables."""
    if overlap == 0:
        return chunks
    order = Window.partitionBy("doc").orderBy("chunk_index")
    table = F.coalesce(F.col("is_table"), F.lit(False)) if "is_table" in chunks.columns else F.lit(False)
    tail, after_table = F.lag("_tail").over(order), F.lag(table).over(order)
    joined = F.when(tail.isNull() | after_table | table, F.col("text")).otherwise(F.trim(F.concat(tail, F.lit(" "), "text")))
    return chunks.withColumn("_tail", last_tokens("text", overlap)).withColumn("text", joined).drop("_tail")


def _packed(text: str, limit: int, oversize_first: bool) -> list[str]:
    """Sentences put together up to ``limit`` tokens; an oversize one stands alone."""
    out: list[str] = []
    buffer: list[str] = []
    held = 0
    for sentence in (s for s in SENTENCE.split(text) if s.strip()):
        n = len(sentence.split())
        if held + n > limit and (buffer or not oversize_first):
            if buffer:
                out.append(" ".join(buffer))
            buffer, held = [sentence], n
        else:
            buffer.append(sentence)
            held += n
    return [*out, " ".join(buffer)] if buffer else out


def _overlapped(chunks: list[dict[str, Any]], overlap: int) -> list[dict[str, Any]]:
    solid = lambda c: not (c.get("is_table") or c.get("is_skipped"))
    out = []
    for before, c in zip([None, *chunks], chunks):
        if overlap and before is not None and solid(before) and solid(c):
            c = c | {"text": (" ".join(before["text"].split()[-overlap:]) + " " + c["text"]).strip()}
        out.append(c)
    return out


def by_heading(blocks: list[dict[str, Any]], max_tokens: int, overlap: int, tables: bool, least: int) -> list[dict[str, Any]]:
    """Sections between headings; a short one joins the next; a long one is cut between sentences."""
    sections: list[dict[str, Any]] = []
    heading, page, buffer = None, 1, []

    def flush() -> None:
        if buffer:
            sections.append({"heading": heading, "page": page, "text": " ".join(buffer)})
            buffer.clear()

    for b in blocks:
        text = (b["text"] or "").strip()
        own_page = page if b["page"] is None else b["page"]
        if b["type"] == "heading":
            flush()
            heading, page = text, own_page
        elif b["type"] == "table":
            if tables and text:
                flush()
                sections.append({"heading": heading, "page": own_page, "text": text, "is_table": True, "html": b["html"] or "", "bbox": b["bbox"]})
            else:
                sections.append({"heading": heading, "page": own_page, "text": "", "is_skipped": True})
        elif text:
            buffer.append(text)
            page = own_page
    flush()

    merged: list[dict[str, Any]] = []
    carry: dict[str, Any] | None = None
    for s in sections:
        if s.get("is_table") or s.get("is_skipped"):
            merged += [carry, s] if carry else [s]
            carry = None
        elif len(s["text"].split()) < least:
            carry = s if carry is None else carry | {"text": f"{carry['text']} {s['text']}".strip()}
        else:
            merged.append(s | {"text": f"{carry['text']} {s['text']}".strip()} if carry else s)
            carry = None
    if carry:
        merged.append(carry)

    capped: list[dict[str, Any]] = []
    for s in merged:
        if s.get("is_table") or s.get("is_skipped") or len(s["text"].split()) <= max_tokens:
            capped.append(s)
        else:
            capped += [{"heading": s["heading"], "page": s["page"], "text": t} for t in _packed(s["text"], max_tokens, True)]
    return _overlapped(capped, overlap)


def by_sentence(blocks: list[dict[str, Any]], max_tokens: int, overlap: int, tables: bool) -> list[dict[str, Any]]:
    texts = [(b, (b["text"] or "").strip()) for b in blocks]
    full = " ".join(t for b, t in texts if t and b["type"] not in ("table", "figure"))
    chunks = [{"text": t, "page": 1, "heading": None} for t in _packed(full, max_tokens, False)]
    if tables:
        chunks += [{"text": t, "page": 1 if b["page"] is None else b["page"], "heading": None, "is_table": True, "html": b["html"] or "", "bbox": b["bbox"]} for b, t in texts if t and b["type"] == "table"]
    return _overlapped(chunks, overlap)


def chunk_blocks(blocks: DataFrame, strategy: str = "heading", max_tokens: int = 512, overlap: int = 50, extract_tables: bool = False, min_section_tokens: int = 30) -> DataFrame:
    """Chunks of each document's blocks in order; one task sees one document at a time."""
    if strategy == "fixed":
        texts = blocks.where(F.trim("text") != "").groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("text"))
        out = fixed_chunks(texts, max_tokens, overlap)
        return out.selectExpr("doc", "chunk_index", "text", "string(NULL) AS heading", "1 AS page", "false AS is_table", "false AS is_skipped", "'' AS html", "string(NULL) AS bbox")
    if strategy not in ("heading", "sentence"):
        raise ValueError(f"unknown chunk strategy: {strategy}")

    arrow = to_arrow_schema(StructType.fromDDL(CHUNKS_DDL))

    def chunks_of(rows: list[dict[str, Any]]) -> list[dict[str, Any]]:
        made = by_heading(rows, max_tokens, overlap, extract_tables, min_section_tokens) if strategy == "heading" else by_sentence(rows, max_tokens, overlap, extract_tables)
        return [{"doc": rows[0]["doc"], "chunk_index": i, "text": c["text"], "heading": c.get("heading"), "page": c.get("page"), "is_table": bool(c.get("is_table")), "is_skipped": bool(c.get("is_skipped")), "html": c.get("html", ""), "bbox": c.get("bbox")} for i, c in enumerate(made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, Any]] = []  # the blocks of the document that isn't over
        for batch in batches:
            for part in slices(batch):
                made = []
                for row in part.to_pylist():
                    if held and row["doc"] != held[0]["doc"]:
                        made += chunks_of(held)
                        held = []
                    held.append(row)
                if made:
                    yield pa.RecordBatch.from_pylist(made, arrow)
        if held:
            yield pa.RecordBatch.from_pylist(chunks_of(held), arrow)

    return blocks.repartition("doc").sortWithinPartitions("doc", F.asc_nulls_last("ord")).mapInArrow(run, CHUNKS_DDL)


def chunk_samples(chunks: DataFrame, chunk_strategy: str = "heading") -> tuple[DataFrame, DataFrame]:
    """Chunks as text to model, in order of document and place, and the tables left out as rejects; empty chunks give nothing."""
    placed = numbered(chunks, "doc", "chunk_index")
    meta = F.to_json(
        F.struct(
            "page", F.col("heading").alias("parent_heading"), "chunk_index", F.when(F.col("is_table"), "table").otherwise("text").alias("content_type"), F.col("doc").alias("source_file"),
            F.when(F.col("is_table"), F.col("html")).alias("table_html"), F.when(F.col("is_table"), F.col("bbox")).alias("table_bbox"),
        )
    )
    good = placed.where("NOT is_skipped AND trim(text) <> ''").withColumn("_meta", meta)
    samples = as_samples(good, "_seq", F.col("doc"), output="text", task_type=F.lit("language_modeling"), metadata="_meta")
    skipped = placed.where("is_skipped").withColumn("_meta", meta)
    rejected = as_samples(skipped, "_seq", F.col("doc"), metadata="_meta", task_type=F.lit("language_modeling"))
    rejected = rejected.withColumn("rejection_reason", F.lit("table_stubbed:extract_tables_disabled")).withColumn("rejecting_step", F.lit("DocumentReader")).withColumn("diagnosis", F.lit(None).cast(DIAGNOSIS))
    return with_provenance(samples, "DocumentReader", {"chunk_strategy": chunk_strategy}), rejected


_TAG = re.compile(r"<(h[1-6]|p|li|table)\b[^>]*>(.*?)</\1\s*>", re.S | re.I)
_MARK = re.compile(r"<[^>]+>")


def blocks_of_pages(pages: DataFrame) -> DataFrame:
    """Headings, paragraphs and tables of web pages as blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for key, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for i, m in enumerate(_TAG.finditer(page or "")):
                        tag = m.group(1).lower()
                        kind = "heading" if tag[0] == "h" else "table" if tag == "table" else "paragraph"
                        rows.append((str(key), i, kind, _MARK.sub(" ", m.group(2)).strip(), 1, m.group(0) if kind == "table" else "", None))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(arrow), arrow)], schema=arrow)

    arrow = to_arrow_schema(StructType.fromDDL(BLOCKS_DDL))
    return pages.select("page_id", "html").mapInArrow(run, BLOCKS_DDL)
