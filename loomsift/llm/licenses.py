"""Operator 3: licence scans.

One Aho-Corasick pass finds ``SPDX-License-Identifier`` tags and the phrases of licence notices; a shunting-yard parser
turns each tag's expression into postfix order and evaluates it over licence categories.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from loomsift.llm.arrays import pick, type_of

PERMISSIVE, WEAK, STRONG, CLOSED, UNKNOWN = range(5)
CATEGORIES = ("permissive", "weak_copyleft", "strong_copyleft", "restricted", "unknown")
LICENSES = {
    PERMISSIVE: "MIT MIT-0 Apache-1.1 Apache-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause 0BSD ISC Zlib Unlicense CC0-1.0 CC-BY-3.0 CC-BY-4.0 BSL-1.0 Python-2.0 PSF-2.0 PostgreSQL X11 NCSA WTFPL Artistic-2.0",
    WEAK: "LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 CDDL-1.0 CDDL-1.1",
    STRONG: "GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later CC-BY-SA-3.0 CC-BY-SA-4.0 EUPL-1.2 OSL-3.0",
    CLOSED: "CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-NC-ND-4.0 BUSL-1.1 SSPL-1.0 LicenseRef-All-Rights-Reserved",
}
CATEGORY = {name.lower(): (name, k) for k, names in LICENSES.items() for name in names.split()}
for old in ("LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "GPL-2.0", "GPL-3.0", "AGPL-3.0"):
    CATEGORY[old.lower()] = CATEGORY[f"{old}-only".lower()]
    CATEGORY[f"{old}+".lower()] = CATEGORY[f"{old}-or-later".lower()]
#: Exceptions under which linking or generated output is free of the copyleft.
EXCEPTIONS = {"classpath-exception-2.0", "gcc-exception-3.1", "llvm-exception", "autoconf-exception-3.0", "bison-exception-2.2", "openjdk-assembly-exception-1.0", "linux-syscall-note"}

TAG = "spdx-license-identifier:"
NOTICES = {
    "apache license, version 2.0": "Apache-2.0",
    "apache license 2.0": "Apache-2.0",
    "mit license": "MIT",
    "permission is hereby granted, free of charge, to any person obtaining a copy": "MIT",
    "redistribution and use in source and binary forms": "BSD-3-Clause",
    "bsd 2-clause": "BSD-2-Clause",
    "bsd 3-clause": "BSD-3-Clause",
    "isc license": "ISC",
    "mozilla public license, version 2.0": "MPL-2.0",
    "mozilla public license 2.0": "MPL-2.0",
    "eclipse public license 2.0": "EPL-2.0",
    "gnu general public license, version 2": "GPL-2.0-only",
    "gnu general public license version 2": "GPL-2.0-only",
    "gnu general public license, version 3": "GPL-3.0-only",
    "gnu general public license version 3": "GPL-3.0-only",
    "gnu lesser general public license, version 2.1": "LGPL-2.1-only",
    "gnu lesser general public license, version 3": "LGPL-3.0-only",
    "gnu affero general public license, version 3": "AGPL-3.0-only",
    "gnu affero general public license version 3": "AGPL-3.0-only",
    "cc by 4.0": "CC-BY-4.0",
    "cc by-sa 4.0": "CC-BY-SA-4.0",
    "cc by-nc 4.0": "CC-BY-NC-4.0",
    "cc by-nd 4.0": "CC-BY-ND-4.0",
    "cc by-nc-sa 4.0": "CC-BY-NC-SA-4.0",
    "cc by-nc-nd 4.0": "CC-BY-NC-ND-4.0",
    "cc0 1.0": "CC0-1.0",
    "all rights reserved": "LicenseRef-All-Rights-Reserved",
}

_FOLD = bytes(32 if i in (9, 10, 11, 12, 13) else i + 32 if 65 <= i <= 90 else i for i in range(256))
#: After GNU names a notice goes on as the Free Software Foundation asks it to.
_GNU = {"gnu general public license": ("GPL", ("2", "3")), "gnu lesser general public license": ("LGPL", ("2.1", "3")), "gnu library general public license": ("LGPL", ("2",)), "gnu affero general public license": ("AGPL", ("3",))}
for _name, (_short, _versions) in _GNU.items():
    for _v in _versions:
        for _sign in (",", ";"):
            for _word, _end in (("either version", "or-later"), ("version", "only")):
                NOTICES[f"{_name} as published by the free software foundation{_sign} {_word} {_v}"] = f"{_short}-{_v if '.' in _v else _v + '.0'}-{_end}"

_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.\-+:]*")
#: The next token of a line, after blanks only.
_NEXT = re.compile(rb"(?:[ \t\x0b\x0c]|\xc2\xa0)*([()]|[A-Za-z0-9][A-Za-z0-9.\-+:]*)")
_BREAK = re.compile(rb"[\r\n]")
_PRIORITY = {"or": 1, "and": 2, "with": 3}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase in (TAG, *NOTICES):
        a.add_word(phrase, phrase)
    a.make_automaton()
    return a


def postfix(expression: str) -> list[str]:
    """Shunting-yard: operands and operators in postfix order. ``ValueError`` if it isn't an expression.

    ``with`` binds closest, then ``and``, then ``or``; operators of one priority group to the left.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = True  # one is due
    for token in _TOKEN.findall(expression):
        t = token.lower()
        if t == "(":
            if not operand:
                raise ValueError("an operator is missing")
            stack.append(t)
        elif t == ")":
            if operand:
                raise ValueError("an operand is missing")
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError("too many )")
            stack.pop()
        elif t in _PRIORITY:
            if operand:
                raise ValueError("an operand is missing")
            while stack and stack[-1] != "(" and _PRIORITY[stack[-1]] >= _PRIORITY[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = True
        else:
            if not operand:
                raise ValueError("an operator is missing")
            out.append(token)
            operand = False
    if operand or "(" in stack:
        raise ValueError("it isn't complete")
    return out + stack[::-1]


def evaluate(rpn: list[str]) -> int:
    """The category that binds: the lighter side of ``or``, the heavier of ``and``; a linking exception under ``with``
    lowers strong copyleft to weak. An unknown identifier is UNKNOWN, the heaviest.
    """
    stack: list[tuple[int, str]] = []
    for t in rpn:
        if t.lower() not in _PRIORITY:
            stack.append((CATEGORY.get(t.lower(), ("", UNKNOWN))[1], t.lower()))
            continue
        (b, exception), (a, _) = stack.pop(), stack.pop()
        if t == "with":
            stack.append((WEAK if a == STRONG and exception in EXCEPTIONS else a, ""))
        else:
            stack.append((min(a, b) if t == "or" else max(a, b), ""))
    return stack[0][0]


def prefix_of_expression(source: bytes, start: int, stop: int) -> tuple[list[str], str]:
    """The longest beginning of ``source[start:stop]`` that parses, as postfix order and text, in one pass over its tokens;
    what follows is a comment's end, prose or another tag.
    """
    begin = end = None
    operand, depth = True, 0  # whether one is due, and parentheses open
    while m := _NEXT.match(source, start, stop):
        token = m.group(1).lower()
        if token == b"(" or token not in (b")", b"or", b"and", b"with"):
            if not operand or token.startswith(TAG.encode()):  # another tag ends this one
                break
            depth += token == b"("
            operand = token == b"("
        else:
            if operand or (token == b")" and not depth):
                break
            depth -= token == b")"
            operand = token != b")"
        begin, start = m.start(1) if begin is None else begin, m.end()
        if not operand and not depth:
            end = start
    if end is None:
        return [], ""
    text = source[begin:end].decode("utf-8", "replace")
    return postfix(text), text


def _alone(raw: bytes, start: int, end: int) -> bool:
    """Whether no letter or digit touches a phrase, and no further part of a version follows it."""
    before, after = raw[max(0, start - 4) : start].decode("utf-8", "ignore")[-1:], raw[end : end + 4].decode("utf-8", "ignore")
    return not (before.isalnum() or after[:1].isalnum() or (after[:1] == "." and after[1:2].isdigit() and raw[end - 1 : end].isdigit()))


def scan(raw: bytes, machine: ahocorasick.Automaton) -> tuple[list[str], list[str], int | None]:
    """Licence names, the expressions found in order, and the category that binds them all together."""
    folded = raw.translate(_FOLD)
    original = raw
    if b"  " in folded:
        folded = re.sub(rb" +", b" ", folded)
        original = re.sub(rb"[ \t]*([ \t\n\x0b\x0c\r])[ \t\n\x0b\x0c\r]*", rb"\1", raw)
    # a tag's expression ends with its line, which the folded text no longer shows
    source = original if len(original) == len(folded) else folded
    names: set[str] = set()
    expressions: dict[str, None] = {}
    worst: int | None = None
    stop = -1
    for last, phrase in machine.iter(folded.decode("latin-1")):
        end = last + 1
        if phrase == TAG:
            if stop < end:
                stop = m.start() if (m := _BREAK.search(source, end)) else len(source)
            rpn, expression = prefix_of_expression(source, end, stop)
            if not rpn:
                continue
            category = evaluate(rpn)
            names.update(CATEGORY.get(t.lower(), (t, 0))[0] for i, t in enumerate(rpn) if t.lower() not in _PRIORITY and not (i + 1 < len(rpn) and rpn[i + 1] == "with"))
        else:
            if not _alone(folded, end - len(phrase), end):
                continue
            expression = NOTICES[phrase]
            category = CATEGORY[expression.lower()][1]
            names.add(expression)
        expressions[expression] = None
        worst = category if worst is None else max(worst, category)
    return sorted(names), [*expressions], worst


def license_scan(docs: DataFrame, allow: tuple[str, ...] = ("none", "permissive", "weak_copyleft")) -> DataFrame:
    """``doc_id, licenses, expressions, category, allowed`` of each row of ``docs``, in one pass without a shuffle.

    ``category``: that of all findings joined by ``and``; "none" where nothing is found, which holds for null and empty
    texts too. ``allowed``: whether the category is in ``allow``. A tag without a valid expression is ignored; of an
    expression followed by other words the longest valid beginning counts. Repeated rows, null ``doc_id`` and ties are
    kept as they are; other columns are ignored; an empty table gives no rows.
    """
    rows = pick(docs, "doc_id", "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            found = [scan(t or b"", machine) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            kinds = ["none" if k is None else CATEGORIES[k] for _, _, k in found]
            yield pa.record_batch(
                [batch.column(0), pa.array([x for x, _, _ in found], pa.list_(pa.string())), pa.array([x for _, x, _ in found], pa.list_(pa.string())), pa.array(kinds, pa.string()), pa.array([k in allow for k in kinds], pa.bool_())],
                ["doc_id", "licenses", "expressions", "category", "allowed"],
            )

    return rows.mapInArrow(find, f"doc_id {type_of(rows, 'doc_id')}, licenses array<string>, expressions array<string>, category string, allowed boolean")
