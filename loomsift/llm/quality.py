"""Operator 5: line-first cleaning.

Every line is held against punctuation, navigation and boilerplate rules; lines that fail are removed, then documents
that lost too much of their text are rejected. One pass without a shuffle, over whole batches of bytes.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomsift.llm.arrays import LETTER, Prefix, classes, code_points, pick, rows_of, runs, slices, type_of

#: A line ends like a sentence, a heading or a quotation does.
ENDS = r"[.!?:;…。！？][\"'”’»)\]]*$"
#: A line without such an end may still hold sentences, cut off at the last.
SENTENCES = r"[.!?] +\S"
#: All but the signs that prose holds few of, and all but menu separators.
SYMBOLS = r"[^#$%&*+<=>@\\^_`{|}~!]"
SEPARATORS = r"[^|»›•·→]"
BOILERPLATE = r"(?i)(all rights reserved|cookie policy|privacy policy|terms of (use|service)|enable javascript|lorem ipsum|click here|sign up now|subscribe to our newsletter|share (this )?on (facebook|twitter))"
NAVIGATION = r"(?i)^(home|menu|login|log in|sign in|sign up|search|share|next|previous|back|top|contact|about|about us|sitemap|read more)[.:!]?$"
PHRASES = [p.encode() for p in (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "lorem ipsum", "click here", "sign up now",
    "subscribe to our newsletter", "share on facebook", "share on twitter", "share this on facebook", "share this on twitter",
)]

MAX_SYMBOLS = 0.12
MAX_UPPER = 0.6
MAX_SEPARATORS = 0.15
#: Distinct words asked for of a line of LONG_WORDS or over: this share of its words or, as a language's vocabulary grows
#: with the root of a text's length, this many for the root of their number, whichever is less.
LEAST_DISTINCT, LEAST_GROWTH = 0.3, 3.0
LONG_WORDS = 12
#: Share of a document's characters that may go.
MAX_LOST = 0.4

_ENDS, _SENTENCES, _NAVIGATION = re.compile(ENDS), re.compile(SENTENCES), re.compile(NAVIGATION)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*rb"#$%&*+<=>@\^_`{|}~!"]] = True
_PLAIN_END = np.zeros(256, bool)
_PLAIN_END[[*b".!?:;"]] = True
_LONGEST_MENU_WORD = 12
_upper: list[np.ndarray] = []


def _upper_case() -> np.ndarray:
    if not _upper:
        _upper.append(np.array([unicodedata.category(chr(c)) == "Lu" for c in range(0x110000)]))
    return _upper[0]


def lines_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the lines that aren't blank, without blanks and tabs around them."""
    breaks = (data == 10) | (data == 13)
    starts, ends = runs(~breaks, at)
    dark = np.flatnonzero(~breaks & (data != 32) & (data != 9))
    first = np.searchsorted(dark, starts)
    after = np.searchsorted(dark, ends)
    some = after > first
    return dark[first[some]], dark[after[some] - 1] + 1


def failing(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each line, whether a rule fails it, and its characters."""
    where, cp = code_points(data)

    def count(marks: np.ndarray) -> np.ndarray:
        """Marked characters of each line."""
        total = np.concatenate([[0], np.cumsum(marks)])
        return total[last] - total[first]

    first, last = np.searchsorted(where, starts), np.searchsorted(where, ends)
    chars = last - first
    letters = count(classes()[cp] == LETTER)
    upper = count(_upper_case()[cp])
    separators = count(np.isin(cp, [ord(c) for c in "|»›•·→"]))
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    symbols = symbols[ends] - symbols[starts]

    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    word_starts, word_ends = runs((np.cumsum(inside[:-1]) > 0) & (data != 32), np.concatenate([starts, [len(data)]]))
    line = np.searchsorted(starts, word_starts, "right") - 1
    words = np.bincount(line, minlength=len(starts))
    many = words[line] >= LONG_WORDS
    h, line = Prefix(data).of(word_starts[many], word_ends[many]), line[many]
    order = np.lexsort((h, line))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order][new], minlength=len(starts))

    fails = (symbols > MAX_SYMBOLS * chars) | ((letters >= 20) & (upper > MAX_UPPER * letters)) | (separators > MAX_SEPARATORS * words) | ((words >= LONG_WORDS) & (distinct < np.minimum(LEAST_DISTINCT * words, LEAST_GROWTH * np.sqrt(words))))
    raw = data.tobytes()
    low = raw.lower()
    for phrase in PHRASES:
        at = low.find(phrase)
        while at >= 0:
            k = int(np.searchsorted(starts, at, "right")) - 1
            if k >= 0 and at + len(phrase) <= ends[k]:
                fails[k] = True
            at = low.find(phrase, at + 1)
    for k in np.flatnonzero(~fails & (ends - starts <= _LONGEST_MENU_WORD)).tolist():
        fails[k] = bool(_NAVIGATION.match(raw[starts[k] : ends[k]].decode()))
    for k in np.flatnonzero(~fails & ~_PLAIN_END[data[ends - 1]]).tolist():
        text = raw[starts[k] : ends[k]].decode()
        fails[k] = not (_ENDS.search(text) or _SENTENCES.search(text))
    return fails, chars


def clean_lines(docs: DataFrame) -> DataFrame:
    """Documents that stay: ``doc_id, text, lang, source, n_chars, n_removed``, text and length as cleaned.

    ``n_removed``: lines removed. Blank lines are dropped and count as neither text nor loss. A document is rejected if
    over ``MAX_LOST`` of the characters of its trimmed lines went, or nothing is left; so null, empty and blank texts are
    rejected. Nulls in other columns, ties and repeated rows pass through; extra columns are ignored; an empty table gives
    no rows.
    """
    rows = pick(docs, "doc_id", "text", "lang", "source")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, "text"):
                starts, ends = lines_of(data, at)
                if not len(starts):
                    continue
                fails, chars = failing(data, starts, ends)
                row = rows_of(at, starts)
                n = part.num_rows
                whole, left = np.bincount(row, chars, n), np.bincount(row[~fails], chars[~fails], n)
                removed, lines = np.bincount(row[fails], minlength=n), np.bincount(row[~fails], minlength=n)
                stays = np.flatnonzero((lines > 0) & (left >= (1 - MAX_LOST) * whole))
                kept = np.flatnonzero(~fails)
                bounds = np.searchsorted(row[kept], np.stack([stays, stays + 1]))
                raw = data.tobytes()
                pairs = list(zip(starts[kept].tolist(), ends[kept].tolist(), strict=True))
                texts = [b"\n".join([raw[s:e] for s, e in pairs[i:j]]) for i, j in bounds.T.tolist()]
                some = part.take(pa.array(stays))
                yield pa.record_batch(
                    [some.column(0), pa.array(texts, pa.binary()).cast(pa.string()), some.column(2), some.column(3), pa.array((left + lines - 1)[stays].astype(np.int64)), pa.array(removed[stays])],
                    ["doc_id", "text", "lang", "source", "n_chars", "n_removed"],
                )

    return rows.mapInArrow(clean, f"doc_id {type_of(rows, 'doc_id')}, text string, lang string, source string, n_chars long, n_removed long")


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


CLEAN_LINES_SQL = rf"""
WITH split AS (
  SELECT doc_id, lang, source,
    list_filter(list_transform(regexp_split_to_array(text, '[\n\r]+'), lambda x: regexp_replace(x, '^[ \t]+|[ \t]+$', '', 'g')), lambda x: x <> '') AS lines
  FROM {{documents}}
), kept AS (
  SELECT *, list_filter(lines, lambda x: NOT (
      regexp_matches(x, '{_sql(NAVIGATION)}')
      OR length(regexp_replace(x, '{SEPARATORS}+', '', 'g')) > {MAX_SEPARATORS} * len(regexp_split_to_array(x, ' +'))
      OR (NOT regexp_matches(x, '{_sql(ENDS)}') AND NOT regexp_matches(x, '{_sql(SENTENCES)}'))
      OR length(regexp_replace(x, '{_sql(SYMBOLS)}+', '', 'g')) > {MAX_SYMBOLS} * length(x)
      OR (length(regexp_replace(x, '[^\p{{L}}]+', '', 'g')) >= 20 AND length(regexp_replace(x, '[^\p{{Lu}}]+', '', 'g')) > {MAX_UPPER} * length(regexp_replace(x, '[^\p{{L}}]+', '', 'g')))
      OR regexp_matches(x, '{_sql(BOILERPLATE)}')
      OR (len(regexp_split_to_array(x, ' +')) >= {LONG_WORDS} AND len(list_distinct(regexp_split_to_array(x, ' +'))) < least({LEAST_DISTINCT} * len(regexp_split_to_array(x, ' +')), {LEAST_GROWTH}::DOUBLE * sqrt(len(regexp_split_to_array(x, ' +')))))
    )) AS kept
  FROM split
), sized AS (
  SELECT *, coalesce(list_sum(list_transform(kept, lambda x: length(x))), 0) AS left_over, coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) AS whole FROM kept
)
SELECT doc_id, array_to_string(kept, chr(10)) AS text, lang, source, length(array_to_string(kept, chr(10)))::BIGINT AS n_chars, (len(lines) - len(kept))::BIGINT AS n_removed
FROM sized WHERE len(kept) > 0 AND left_over >= {1 - MAX_LOST} * whole
"""
