"""Pieces of the SQL that the registered queries are held against."""

from __future__ import annotations

from loomsift.operators.gates import QUOTED, SECRETS
from loomsift.operators.normalize import MOJIBAKE, TRANSFORMS

#: Python's white space as a character class of RE2, without brackets.
PYWS = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORDS = r"[\p{L}\p{N}_]+"


def n_tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^{PYWS}]+'))"


def squeezed(x: str) -> str:
    return f"array_to_string(regexp_extract_all({x}, '[^{PYWS}]+'), ' ')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{PYWS}]+|[{PYWS}]+$', '', 'g')"


def quoted(x: str) -> str:
    """A literal, its control characters by number."""
    return " || ".join(f"chr({ord(c)})" if ord(c) < 32 or 127 <= ord(c) < 160 else "'" + c.replace("'", "''") + "'" for c in x)


def _fix(x: str) -> str:
    for bad, good in MOJIBAKE:
        x = f"replace({x}, {quoted(bad)}, {quoted(good)})"
    return x


CLEAN = {
    "strip_html": lambda x: f"regexp_replace({x}, '<[^>]+>', '', 'g')",
    "normalise_unicode": lambda x: f"nfc_normalize({x})",
    "fix_encoding_artifacts": _fix,
    "remove_control_chars": lambda x: rf"regexp_replace({x}, '[\x{{00}}-\x{{08}}\x{{0b}}\x{{0c}}\x{{0e}}-\x{{1f}}\x{{7f}}]', '', 'g')",
    "collapse_whitespace": lambda x: rf"regexp_replace({x}, '[ \t\r\f\x{{0b}}]+', ' ', 'g')",
}


def cleaned(x: str) -> str:
    for name in TRANSFORMS:
        x = CLEAN[name](x)
    return strip(x)


DIRTY = """
SELECT doc_id, lang, source, CASE doc_id % 6
  WHEN 0 THEN '<p class="x">' || text || '</p>' || chr(10) || '<br/>'
  WHEN 1 THEN 'Cafe' || chr(769) || ' ' || text
  WHEN 2 THEN 'donâ' || chr(128) || chr(153) || 't Ã© ' || text
  WHEN 3 THEN chr(7) || text || chr(127) || chr(1)
  WHEN 4 THEN ' ' || chr(9) || ' ' || replace(text, ' ', ' ' || chr(9) || ' ') || chr(10) || chr(10)
  ELSE 'key = AKIA' || upper(substr(md5(doc_id::VARCHAR), 1, 16)) || ' ' || text END AS text FROM documents
"""

SCHEMA_CTE = f"""
WITH counted AS (SELECT doc_id, coalesce(text, '') AS text, lang, source, {n_tokens("coalesce(text, '')")} AS k FROM documents),
gated AS (SELECT doc_id, text, lang, source, CASE WHEN k = 0 THEN 'missing_field:output' WHEN contains(text, chr(0)) THEN 'encoding_error:null_byte_in_output'
  WHEN k < 10 THEN 'below_min_tokens:' || k WHEN k > 2048 THEN 'above_max_tokens:' || k END AS rejection_reason FROM counted)
"""

TURNS = "SELECT conv_id, list(struct_pack(role := role, content := text) ORDER BY turn) AS turns FROM conversations GROUP BY conv_id"
PREFERENCES = f"""
SELECT conv_id::VARCHAR AS id, coalesce(question, '') AS instruction, answers[1] AS chosen, list_sort(list_transform(answers[2:], lambda x: struct_pack(n := length(x), x := x)))[1].x AS rejected
FROM (SELECT conv_id, list_filter(turns, lambda t: t.role = 'user')[1].content AS question, list_transform(list_filter(turns, lambda t: t.role = 'assistant'), lambda t: t.content) AS answers FROM ({TURNS})) WHERE len(answers) >= 2
"""


def _detector(pattern: str) -> str:
    """Whether a pattern is found; RE2 has no look-around, so that a border takes a character."""
    before = r"(?<![A-Za-z0-9])"
    if pattern.startswith(before):
        pattern = "(?:^|[^A-Za-z0-9])" + pattern[len(before) :]
    for after in (r"(?![A-Za-z0-9])", r"(?![A-Za-z0-9_\-])"):
        if pattern.endswith(after):
            pattern = pattern[: -len(after)] + "(?:" + after.replace("(?![", "[^").removesuffix(")") + "|$)"
    return f"regexp_matches(text, '{pattern.replace(chr(39), chr(39) * 2)}')"


def _entropy(name: str) -> str:
    pattern, limit = QUOTED[name]
    share = "len(list_filter(string_split(s, ''), lambda x: x = c)) / length(s)"
    bits = f"list_sum(list_transform(list_distinct(string_split(s, '')), lambda c: -({share}) * log2({share})))"
    return f"len(list_filter(regexp_extract_all(text, '{pattern.replace(chr(39), chr(39) * 2)}', 1), lambda s: {bits} > {limit})) > 0"


_FOUND = {name: _detector(p) for name, p in SECRETS.items()} | {name: _entropy(name) for name in QUOTED}
SECRETS = f"""
WITH d AS ({DIRTY}), f AS (SELECT doc_id, list_sort(list_filter([{", ".join(f"CASE WHEN {c} THEN '{name}' END" for name, c in _FOUND.items())}], lambda x: x IS NOT NULL)) AS types FROM d)
SELECT doc_id::VARCHAR AS id, CASE WHEN len(types) > 0 THEN 'secret_detected:' || array_to_string(types, ',') END AS rejection_reason FROM f
"""


def fixed_chunks(size: int, overlap: int) -> str:
    stride = max(1, size - overlap)
    return f"""
SELECT doc, k::INTEGER AS chunk_index, array_to_string(words[k * {stride} + 1 : k * {stride} + {size}], ' ') AS text
FROM (SELECT doc_id AS doc, regexp_extract_all(text, '[^{PYWS}]+') AS words FROM documents), unnest(range(0, (len(words) + {stride - 1}) // {stride})) AS u(k)
"""


def stratified(shares: dict[str, float]) -> str:
    values = ", ".join(f"('{c}', {f}::DOUBLE)" for c, f in shares.items())
    return f"""
WITH target(category, share) AS (VALUES {values}), d AS (SELECT doc_id::VARCHAR AS id, coalesce(lang, 'unknown') AS category FROM documents),
n AS (SELECT category, count(*) AS n FROM d GROUP BY 1), total AS (SELECT min(n / share) AS total FROM n JOIN target USING (category)),
r AS (SELECT id, category, share, row_number() OVER (PARTITION BY category ORDER BY md5(id || ':42'), id) AS k FROM d LEFT JOIN target USING (category))
SELECT id FROM r, total WHERE share IS NULL OR total IS NULL OR k <= floor(total * share)
"""


def greedy(edges: str, rows: str) -> str:
    """What a scan in order keeps: a step of the recursion for each row."""
    return f"""
WITH RECURSIVE v AS MATERIALIZED ({rows}), e AS MATERIALIZED ({edges}), near AS MATERIALIZED (SELECT j, list(i) AS before FROM e GROUP BY j),
o AS MATERIALIZED (SELECT vec_id, coalesce(before, []) AS before, row_number() OVER (ORDER BY vec_id) AS k FROM v LEFT JOIN near ON j = vec_id),
scan(k, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT o.k, CASE WHEN list_has_any(o.before, scan.kept) THEN scan.kept ELSE list_append(scan.kept, o.vec_id) END FROM scan JOIN o ON o.k = scan.k + 1)
SELECT unnest(kept) AS vec_id FROM scan WHERE k = (SELECT max(k) FROM scan)
"""


def minhash_signatures(pairs: list[tuple[int, int]], ngram: int = 3) -> str:
    values = ", ".join(f"({c}, {a}::HUGEINT, {b}::HUGEINT)" for c, (a, b) in enumerate(pairs))
    return f"""
WITH p(component, a, b) AS (VALUES {values}),
g AS (SELECT DISTINCT item_id, substr(lower(text), i::INTEGER, {ngram}) AS gram FROM benchmark, unnest(range(1, length(text) - {ngram - 2})) AS u(i)),
h AS (SELECT item_id, ('0x' || right(md5(gram), 8))::UBIGINT::HUGEINT AS h FROM g)
SELECT item_id, component, min((a * h + b) % 2305843009213693951 % 4294967296)::BIGINT AS value FROM h, p GROUP BY ALL
"""


SWEEPS = """
WITH s AS (SELECT c_custkey::BIGINT AS c_custkey, [c_custkey & 1 = 1, c_custkey & 2 = 2, c_custkey & 4 = 4] AS e FROM customer)
SELECT c_custkey, CASE WHEN NOT list_contains(e, true) THEN NULL WHEN NOT list_contains(e, false) THEN 'threshold_marginal' WHEN e[1] AND NOT e[3] THEN 'generator_temperature' ELSE 'threshold_marginal' END AS mode FROM s
"""


def injections(types: tuple[str, ...]) -> str:
    names = ", ".join(f"('{t}')" for t in (*types, "all", "clean"))
    listed = ", ".join(f"'{t}'" for t in types)
    return f"""
WITH name(injection_type) AS (VALUES {names}),
d AS (SELECT CASE WHEN doc_id % 5 = 0 THEN [{listed}][doc_id % {len(types)} + 1] ELSE 'clean' END AS kind, {n_tokens("text")} < 200 AS hit FROM documents),
e AS (SELECT kind, hit FROM d UNION ALL SELECT 'all', hit FROM d WHERE kind <> 'clean')
SELECT injection_type, count(kind) AS total, count(*) FILTER (hit) AS caught, CASE WHEN count(kind) > 0 THEN round(count(*) FILTER (hit) / count(kind), 4) END AS recall FROM name LEFT JOIN e ON kind = injection_type GROUP BY 1
"""
