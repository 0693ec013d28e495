"""Operator 6: main text of web pages by tag-path ratios.

Text length and punctuation are aggregated by root-to-leaf tag path; both ratios, weighted by their spread, are smoothed
over the sequence of text nodes, fused by product and thresholded by the standard deviation.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomsift.llm.arrays import pick, type_of

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9]*)")
#: Text and a tag without ``<`` in it, as nearly all are; a look that fails ends at the next ``<``.
_PLAIN = re.compile(r"([^<]*)<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*')*+)>")
_MARK = re.compile(r"[>\"']")
#: Elements whose text is none of the page's, with their ends.
_HIDDEN = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "noscript", "template")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of these ends a paragraph, whatever is left open in it.
_BLOCK = frozenset("address article aside blockquote dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td th thead tr ul".split())
#: Opening one ends an open one of its kind.
_SIBLINGS = frozenset("li dt dd td th tr option".split())
_LISTS = ("ul", "ol", "table", "dl")
_PUNCTUATION = re.compile(r"[.,;:!?、。！？，；…]")
_WHITE = re.compile(r"\s+")
#: A Gaussian of standard deviation 1 over a node and one on each side.
KERNEL = np.array([0.6065306597126334, 1.0, 0.6065306597126334])


class TagEnds:
    """Where tags end: at the first ``>`` outside quotation marks. Each place is looked at a few times, however many tags
    have no end, for whatever is passed outside quotation marks on the way to none is known to lead there.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.begins: list[int] = []  # of the stretches that lead to no end, in order
        self.stops: list[int] = []

    def find(self, start: int) -> int:
        """The place after the end of a tag whose name ends at ``start``; -1 if it has none."""
        passed, at = [], start
        while True:
            k = bisect_right(self.begins, at) - 1
            m = None if k >= 0 and at <= self.stops[k] else _MARK.search(self.page, at)
            if m and m.group() == ">":
                return m.end()
            passed.append((at, m.start() if m else len(self.page)))
            after = self.page.find(m.group(), m.end()) if m else -1
            if after < 0:
                break
            at = after + 1
        known = dict(zip(self.begins, self.stops, strict=True))
        for s, e in passed:
            known[s] = max(e, known.get(s, 0))
        self.begins, self.stops = [], []
        for s, e in sorted(known.items()):
            if self.stops and s <= self.stops[-1]:
                self.stops[-1] = max(self.stops[-1], e)
            else:
                self.begins.append(s)
                self.stops.append(e)
        return -1


def pieces(page: str) -> Iterator[tuple[str, bool, str | None]]:
    """Texts, with no name, and tags, with whether they close, their lower-case name, and "/" where they close themselves.

    Comments, declarations and what isn't shown are left out; a ``<`` without an end is text.
    """
    ends, at, n = TagEnds(page), 0, len(page)
    begin, last = 0, page.rfind(">")  # of the text that goes on at ``at``
    plain = _PLAIN.match
    while at < n:
        if m := plain(page, at):
            text, closing, name, attributes = m.groups()
            if begin < at:
                text = page[begin : at + len(text)]
            if text:
                yield text, False, None
            end, name, slash = m.end(), name.lower(), "/" if attributes[-1:] == "/" else ""
        else:
            open_ = page.find("<", at)
            if open_ < 0:
                break
            if page.startswith("<!--", open_):
                end = page.find("-->", open_ + 4) + 3
                end = n if end < 3 else end
            elif open_ > last:  # no tag ends any more, but a comment may begin
                open_ = end = page.find("<!--", open_)
                if end < 0:
                    break
            elif page[open_ + 1] in "!?":
                end = page.find(">", open_) + 1
            elif not (m := _NAME.match(page, open_ + 1)) or (end := ends.find(m.end())) < 0:
                at = open_ + 1
                continue
            if begin < open_:
                yield page[begin:open_], False, None
            begin = at = end
            if m is None:
                continue
            closing, name, slash = m.group(1), m.group(2).lower(), "/" if page[end - 2] == "/" else ""
        if name in _HIDDEN and not closing:
            shut = _HIDDEN[name].search(page, end)
            end = shut.end() if shut else n
        else:
            yield slash, bool(closing), name
        begin = at = end
    if begin < n:
        yield page[begin:], False, None


class Stack:
    """Open elements and the number of their path; closing and looking up take no longer for a deep page."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.paths = [0]
        self.known: dict[tuple[int, str], int] = {}
        self.places: dict[str, list[int]] = {}

    def __contains__(self, name: str) -> bool:
        return bool(self.places.get(name))

    def last(self, name: str) -> int:
        return self.places[name][-1] if name in self else -1

    def push(self, name: str) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.paths.append(self.known.setdefault((self.paths[-1], name), len(self.known) + 1))

    def cut(self, depth: int) -> None:
        while len(self.names) > depth:
            self.places[self.names.pop()].pop()
            self.paths.pop()


def text_nodes(page: str) -> list[tuple[int, int, str]]:
    """Path, block and text of each text node that isn't blank, outside the head; a block's nodes belong to one line."""
    stack, block = Stack(), 0
    out = []
    for text, closing, name in pieces(page):
        if name is None:
            if not text.isspace() and "head" not in stack:
                out.append((stack.paths[-1], block, text))
            continue
        if closing:
            if name in stack:
                stack.cut(stack.last(name))
        else:
            if (name == "body" or name in _BLOCK) and "head" in stack:
                stack.cut(stack.last("head"))
            if name in _BLOCK and "p" in stack:
                stack.cut(stack.last("p"))
            if name in _SIBLINGS and stack.last(name) > max(map(stack.last, _LISTS)):
                stack.cut(stack.last(name))
            if name not in _VOID and text != "/":
                stack.push(name)
        block += name in _BLOCK or name == "br"
    return out


def content(page: str) -> tuple[str, int, int]:
    """Selected text, text nodes, and those selected."""
    nodes = [(p, b, t) for p, b, raw in text_nodes(page) if (t := _WHITE.sub(" ", entities.unescape(raw)).strip())]
    if not nodes:
        return "", 0, 0
    _, path = np.unique([p for p, _, _ in nodes], return_inverse=True)
    fused = np.ones(len(nodes))
    count = np.bincount(path)
    for measure in ([len(t) for _, _, t in nodes], [len(_PUNCTUATION.findall(t)) for _, _, t in nodes]):
        x = np.array(measure, float)
        mean = np.bincount(path, x) / count
        spread = np.sqrt(np.maximum(np.bincount(path, x * x) / count - mean * mean, 0))
        ratio = (mean * (1 + spread))[path]
        padded = np.concatenate([ratio[:1], ratio, ratio[-1:]])
        smooth = KERNEL[0] * padded[:-2] + KERNEL[1] * padded[1:-1] + KERNEL[2] * padded[2:]
        fused *= smooth / KERNEL.sum()
    # the threshold is over paths: all nodes of a path are content or none is
    score = np.bincount(path, fused) / count
    keep = (score >= score.std())[path]
    parts: list[str] = []
    last = None
    for (_, b, t), k in zip(nodes, keep.tolist(), strict=True):
        if k:
            if parts:
                parts.append(" " if b == last else "\n")
            parts.append(t)
            last = b
    return "".join(parts), len(nodes), int(keep.sum())


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_nodes, n_content`` of each row of ``pages``, in one pass without a shuffle.

    Null, empty and tag-free input: null stays null with 0 nodes, empty gives empty text, and bare text is one node, which
    is content. A tie at the threshold is content. Markup that isn't closed ends with its parent or the page. Repeated rows
    and null keys are kept; other columns are ignored; an empty table gives no rows.
    """
    rows = pick(pages, "page_id", "url", "html")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(None, 0, 0) if h is None else content(h) for h in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([x for x, _, _ in found], pa.string()), pa.array([n for _, n, _ in found], pa.int32()), pa.array([n for _, _, n in found], pa.int32())], ["page_id", "url", "text", "n_nodes", "n_content"])

    return rows.mapInArrow(extract, f"page_id {type_of(rows, 'page_id')}, url string, text string, n_nodes int, n_content int")
