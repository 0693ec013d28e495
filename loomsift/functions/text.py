"""Column expressions shared by the operators: tokens, and the text that an operator looks at by task type."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomsift.functions.batches import of_each, slices

#: What separates tokens; Java's \s alone lacks most of Unicode's white space.
WHITE = r"\s\x0b\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same characters one by one.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PREFERENCE = ("preference", "implicit_preference")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


_WHITE = np.zeros(256, bool)
_WHITE[[*range(9, 14), *range(28, 33)]] = True
#: White space beyond ASCII as UTF-8, by its first byte.
_LONGER: dict[int, list[bytes]] = {}
for _c in BLANKS:
    if ord(_c) >= 128:
        _LONGER.setdefault(_c.encode()[0], []).append(_c.encode())


def counted_tokens(texts: pa.Array) -> pa.Array:
    """Runs without white space of each text, over the bytes of some of them at a time."""
    found = [_counted(part) for part in slices(texts, rows=1 << 16)]
    return pa.concat_arrays(found) if found else pa.array([], pa.int32())


def _counted(texts: pa.Array) -> pa.Array:
    texts = texts.cast(pa.large_string())
    n = len(texts)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    b = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    dark = ~_WHITE[b]
    for first, signs in _LONGER.items():
        where = np.flatnonzero(b == first)
        for sign in signs if len(where) else ():
            own = where[where + len(sign) <= len(b)]
            for k, x in enumerate(sign[1:], 1):
                own = own[b[own + k] == x]
            for k in range(len(sign)):
                dark[own + k] = False
    begins = dark.copy()
    begins[1:] &= ~dark[:-1]
    own = at[:-1][at[:-1] < len(b)]
    begins[own] = dark[own]
    return pa.array(np.diff(np.searchsorted(np.flatnonzero(begins), at)).astype(np.int32), mask=texts.is_null().to_numpy(zero_copy_only=False))


def n_tokens(text: Column | str) -> Column:
    """Runs without white space: one pass over whole batches, many times as fast as a regular expression in the JVM, which
    would make an array of all tokens.
    """
    if not _counter:
        _counter.append(F.arrow_udf(counted_tokens, "int"))
    return _counter[0](col(text))


_counter: list = []


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(f"[^{WHITE}]+"), F.lit(0))


def squeezed_texts(texts: pa.Array) -> pa.Array:
    """Tokens of each text joined by single spaces."""
    return of_each(texts, lambda t: " ".join(t.split()))


def squeezed(text: Column | str) -> Column:
    """Tokens joined by single spaces, by Python's split, which parts at the same white space as ``WHITE`` has."""
    if not _squeezer:
        _squeezer.append(F.arrow_udf(squeezed_texts, "string"))
    return _squeezer[0](col(text))


_squeezer: list = []


def strip(text: Column | str) -> Column:
    return F.btrim(col(text), F.lit(BLANKS))  # looks at the ends only


def is_task(*names: str) -> Column:
    return F.col("task_type").isin(*names)


def dedup_text() -> Column:
    """The fields that make two samples equal, without separators."""
    return (
        F.when(is_task(*PREFERENCE), F.concat("instruction", "chosen", "rejected"))
        .when(is_task("grpo"), F.concat("instruction", F.array_join("responses", "")))
        .when(is_task("language_modeling"), F.col("output"))
        .otherwise(F.concat("instruction", "output"))
    )


def primary_text() -> Column:
    """The text whose tokens are bounded: of a pair the side of more tokens, of rollouts the longest."""
    longer = F.when(n_tokens("chosen") >= n_tokens("rejected"), F.col("chosen")).otherwise(F.col("rejected"))
    longest = F.array_max(F.transform("responses", lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x"))))["x"]
    with_instruction = lambda x: strip(F.concat("instruction", F.lit(" "), x))
    return (
        F.when(is_task(*PREFERENCE), with_instruction(longer))
        .when(is_task("grpo"), F.when(F.size("responses") > 0, with_instruction(longest)).otherwise(F.col("instruction")))
        .when(is_task("language_modeling"), F.col("output"))
        .when(is_task("source_chunk"), F.col("input"))
        .when(is_task("prompt_only"), F.col("instruction"))
        .otherwise(with_instruction(F.col("output")))
    )


def embedding_text() -> Column:
    with_instruction = lambda x: strip(F.concat("instruction", F.lit(" "), x))
    return (
        F.when(is_task(*PREFERENCE), with_instruction(F.col("chosen")))
        .when(is_task("grpo") & (F.size("responses") > 0), with_instruction(F.col("responses")[0]))
        .when(is_task("language_modeling"), F.col("output"))
        .otherwise(with_instruction(F.col("output")))
    )


#: Fields that hygiene looks at, by task type; a task that isn't named has all six looked at.
HYGIENE_FIELDS = {
    "preference": ("instruction", "input", "chosen", "rejected"),
    "implicit_preference": ("instruction", "input", "chosen", "rejected"),
    "grpo": ("instruction", "input", "responses"),
    "language_modeling": ("output",),
    "source_chunk": ("input", "output"),
    "prompt_only": ("instruction", "input"),
    "unpaired_preference": ("instruction", "input", "output"),
    "conversational": ("instruction", "input", "output"),
    "instruction_following": ("instruction", "input", "output"),
    "table_qa": ("instruction", "input", "output"),
}
ALL_FIELDS = ("instruction", "input", "output", "chosen", "rejected", "responses")


def hygiene_fields(fields: tuple[str, ...] | None = None) -> Column:
    """``array<struct<field,text>>`` of the texts to look at; rollouts are ``responses[i]``."""

    def part(field: str) -> Column:
        if field == "responses":
            return F.transform("responses", lambda x, i: F.struct(F.concat(F.lit("responses["), i.cast("string"), F.lit("]")).alias("field"), x.alias("text")))
        return F.array(F.struct(F.lit(field).alias("field"), F.col(field).alias("text")))

    every = lambda names: F.concat(*map(part, names))
    if fields:
        return every(fields)
    out = None
    for task, names in HYGIENE_FIELDS.items():
        out = (F if out is None else out).when(F.col("task_type") == task, every(names))
    return out.otherwise(every(ALL_FIELDS))


def answer_to_judge() -> Column:
    """The answer that a judge is given: chosen side, best-rewarded or first rollout, else output or chosen."""
    best = F.array_position("reward_scores", F.array_max("reward_scores"))
    return (
        F.when(is_task(*PREFERENCE) & (F.col("chosen") != ""), F.col("chosen"))
        .when(is_task("grpo") & (F.size("responses") > 0), F.when((F.size("reward_scores") == F.size("responses")) & (best > 0), F.try_element_at("responses", best.cast("int"))).otherwise(F.col("responses")[0]))
        .when(F.col("output") != "", F.col("output"))
        .otherwise(F.col("chosen"))
    )


def source_context() -> Column:
    """The text that generation draws on."""
    return F.when(is_task("language_modeling") & (F.col("output") != ""), F.col("output")).when(F.col("input") != "", F.col("input")).otherwise(F.col("output"))


def judge_context() -> Column:
    """The text that an answer must be grounded in: a long input, else the chunk it was made from."""
    return F.when(F.length("input") > 50, F.col("input")).otherwise(F.coalesce(F.get_json_object("metadata", "$.source_chunk"), F.lit("")))
