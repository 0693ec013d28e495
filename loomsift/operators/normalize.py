"""Normalizers on built-in expressions: cleaning, exact dedup, truncation, stratified sampling, splits."""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomsift.functions.batches import of_each
from loomsift.functions.samples import in_order, with_provenance
from loomsift.functions.text import col, dedup_text, squeezed, strip
from loomsift.operators.gates import category_of

#: UTF-8 read as Latin-1: what is found, and what was meant.
MOJIBAKE = [(good.encode().decode("latin-1"), plain) for good, plain in (("\u2019", "'"), ("\u2018", "'"), ("\u201c", '"'), ("\u201d", '"'), ("\u2013", "\u2013"), ("\u2014", "\u2014"), ("\u2026", "\u2026"), ("é", "é"), ("è", "è"), ("ê", "ê"), ("ë", "ë"))]
TRANSFORMS = ("strip_html", "normalise_unicode", "fix_encoding_artifacts", "remove_control_chars", "collapse_whitespace")


_MARKUP = re.compile("<[^>]+>")
_CONTROL = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")
#: Blanks that aren't a single space already.
_RUNS = re.compile(r"[ \t\r\f\x0B]{2,}|[\t\r\f\x0B]")


def _fixed(x: str) -> str:
    if any(first in x for first in _FIRST):
        for bad, good in MOJIBAKE:
            x = x.replace(bad, good)
    return x


_FIRST = sorted({bad[0] for bad, _ in MOJIBAKE})


_EACH: dict[str, Callable[[str], str]] = {
    "strip_html": lambda x: _MARKUP.sub("", x) if "<" in x else x,
    "normalise_unicode": lambda x: x if x.isascii() else unicodedata.normalize("NFC", x),
    "fix_encoding_artifacts": _fixed,
    "remove_control_chars": lambda x: _CONTROL.sub("", x),
    "collapse_whitespace": lambda x: _RUNS.sub(" ", x),
}


def _steps(*names: str) -> Callable[[Column | str], Column]:
    """Transforms of a column, one after the other in one pass over each text."""
    fns = [_EACH[n] for n in names]
    udf = F.arrow_udf(lambda texts: of_each(texts, lambda x: reduce(lambda y, fn: fn(y), fns, x)), StringType())
    return lambda x: udf(col(x))


_STEPS = {name: _steps(name) for name in TRANSFORMS}
strip_html = _STEPS["strip_html"]


def cleaned(x: Column | str, transforms: tuple[str, ...] = TRANSFORMS) -> Column:
    """The transforms in their fixed order, then white space off both ends."""
    names = [n for n in TRANSFORMS if n in transforms]
    return strip(_steps(*names)(x) if names else col(x))


def clean_text(samples: DataFrame, transforms: tuple[str, ...] = TRANSFORMS, fields: tuple[str, ...] = ("instruction", "input", "output")) -> DataFrame:
    if unknown := {*transforms} - {*TRANSFORMS}:
        raise ValueError(f"unknown transforms: {sorted(unknown)}")
    done = samples.withColumns({f: cleaned(f, transforms) for f in fields})
    return with_provenance(done, "TextCleaner", {"transforms_applied": list(transforms), "fields_cleaned": list(fields)}, {"transforms": transforms, "fields": fields})


def exact_dedup(samples: DataFrame) -> DataFrame:
    """The first in order of each normalised text; the shuffle is on its hash."""
    keyed = samples.withColumn("_key", F.sha2(squeezed(F.lower(dedup_text())), 256))
    return keyed.withColumn("_n", F.row_number().over(in_order("_key"))).where("_n = 1").drop("_key", "_n")


def truncate(samples: DataFrame, n: int) -> DataFrame:
    """The first n in order."""
    return samples.orderBy("_seq").limit(n)


def stratified_targets(counts: dict[str, int], distribution: dict[str, float]) -> tuple[dict[str, int], float]:
    """How many of each target category stay: the largest total that every non-empty one can fill at its share."""
    if any(f <= 0 for f in distribution.values()):
        raise ValueError("target fractions must be over 0")
    total = min((counts[c] / f for c, f in distribution.items() if counts.get(c, 0)), default=math.inf)
    if total == math.inf:
        return {}, total
    return {c: min(math.floor(total * f), counts.get(c, 0)) for c, f in distribution.items()}, total


def stratified_sample(samples: DataFrame, distribution: dict[str, float], category: str = "source_dataset", seed: int = 42, exact_draw: bool = False) -> DataFrame:
    """Resamples to target shares; categories without a target pass.

    By default the rows of the least keyed hash stay, which scales. ``exact_draw`` takes those that Python's seeded
    ``random.sample`` picks from the rows in order; its positions are made on the driver, so it is for small pools.
    """
    of = samples.withColumn("_category", category_of(category))
    counts = {r._category: r["count"] for r in of.groupBy("_category").count().collect()}
    targets, total = stratified_targets(counts, distribution)
    if not targets:
        return samples
    if exact_draw:
        rng = random.Random(seed)
        picks = [(c, i) for c in distribution for i in rng.sample(range(counts.get(c, 0)), targets[c])]
        spark = samples.sparkSession
        chosen = spark.createDataFrame(picks or [("", -1)], "_category string, _n int")
        placed = of.withColumn("_n", F.row_number().over(Window.partitionBy("_category").orderBy("_seq")) - 1)
        kept = placed.join(chosen, ["_category", "_n"], "left_semi").select(*of.columns)
    else:
        order = Window.partitionBy("_category").orderBy(F.md5(F.concat("id", F.lit(f":{seed}"))), "id")
        limit = F.create_map(*(x for c, n in targets.items() for x in (F.lit(c), F.lit(n))))
        kept = of.where(F.col("_category").isin(*targets)).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit[F.col("_category")]).drop("_n")
    rest = of.where(~F.col("_category").isin(*targets))
    shortfalls = sorted(c for c in distribution if not counts.get(c))
    out = kept.unionByName(rest).drop("_category")
    return with_provenance(out, "StratifiedSampler", {"category_field": category, "binding_total": int(total), "targets": targets, "shortfalls": shortfalls, "has_shortfall": bool(shortfalls)}, {"distribution": distribution, "seed": seed})


def split_bounds(n: int, fractions: dict[str, float]) -> dict[str, tuple[int, int]]:
    if abs(sum(fractions.values()) - 1) > 1e-6:
        raise ValueError(f"split fractions must sum to 1.0, got {sum(fractions.values()):.4f}")
    out, start = {}, 0
    for i, (name, f) in enumerate(fractions.items()):
        end = n if i == len(fractions) - 1 else start + math.floor(n * f)
        out[name] = (start, end)
        start = end
    return out


def assign_splits(samples: DataFrame, fractions: dict[str, float], seed: int = 42, exact_draw: bool = False) -> DataFrame:
    """``samples`` with ``split``; places in the shuffled order come from a keyed hash, or from Python's seeded shuffle.

    The place in hash order is a global sort; it is found from the counts of 4096 hash buckets, so no task sees all rows.
    """
    if exact_draw:
        n = samples.count()
        order = list(range(n))
        random.Random(seed).shuffle(order)
        names = {name: order[a:b] for name, (a, b) in split_bounds(n, fractions).items()}
        table = samples.sparkSession.createDataFrame([(i, k) for k, places in names.items() for i in places] or [(-1, "")], "_n int, split string")
        return samples.withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_seq", "id")) - 1).join(table, "_n").drop("_n")
    hashed = samples.withColumn("_h", F.md5(F.concat("id", F.lit(f":{seed}")))).withColumn("_b", F.substring("_h", 1, 3))
    sizes = sorted((r._b, r["count"]) for r in hashed.groupBy("_b").count().collect())
    n = sum(c for _, c in sizes)
    base, at = [], 0
    for b, c in sizes:
        base.append((b, at))
        at += c
    before = samples.sparkSession.createDataFrame(base or [("", 0)], "_b string, _base long")
    placed = hashed.join(F.broadcast(before), "_b").withColumn("_n", F.col("_base") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", "id")) - 1)
    split = None
    for name, (_, end) in split_bounds(n, fractions).items():
        split = (F if split is None else split).when(F.col("_n") < end, F.lit(name))
    return placed.withColumn("split", split).drop("_h", "_b", "_n", "_base")
