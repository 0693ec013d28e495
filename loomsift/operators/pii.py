"""Pseudonyms for personal data: patterns and checksums find it, keyed hashes choose what takes its place."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsift.functions.samples import with_provenance
from loomsift.functions.text import ALL_FIELDS, HYGIENE_FIELDS

Span = tuple[str, int, int, float]
Recognizer = Callable[[str], list[Span]]


def luhn(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ip_ok(text: str) -> bool:
    return all(int(x) < 256 for x in text.split("."))


PATTERNS: list[tuple[str, re.Pattern[str], float, Callable[[str], bool] | None]] = [
    ("EMAIL_ADDRESS", re.compile(r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"), 1.0, None),
    ("IBAN_CODE", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), 1.0, iban_ok),
    ("CREDIT_CARD", re.compile(r"\b(?:\d[ -]?){12,18}\d\b"), 1.0, luhn),
    ("US_SSN", re.compile(r"\b(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b"), 0.85, None),
    ("IP_ADDRESS", re.compile(r"\b(?:\d{1,3}\.){3}\d{1,3}\b"), 0.95, ip_ok),
    ("PHONE_NUMBER", re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\)|\d{3})[ .\-]\d{3}[ .\-]\d{4}\b"), 0.75, None),
    ("US_BANK_NUMBER", re.compile(r"(?i)\b(?:account|acct)\D{0,12}(\d{8,17})\b"), 0.7, None),
]
#: People are known by what stands before them, or by a common first name; places by a list, a state or a street.
_NAMES = """James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew George Kevin Brian Edward Peter Mary Patricia
Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Donna Michelle Carol Amanda Laura Anna Maria Julia Sophie Hans Klaus Jürgen
Wolfgang Stefan Petra Monika Sabine Ursula Pierre Jean Michel Jacques Philippe Marie Nathalie Isabelle José Juan Carlos Miguel Pedro Carmen Pilar Lucía Ahmed Mohammed Fatima Wei Priya Raj""".split()
_PLACES = """London|Paris|Berlin|Madrid|Rome|Vienna|Munich|Hamburg|Lyon|Marseille|Barcelona|Seville|Amsterdam|Brussels|Zurich|Geneva|Dublin|Edinburgh|Manchester|Lisbon|Warsaw|Prague|Budapest|
Athens|Istanbul|Moscow|Cairo|Lagos|Nairobi|Mumbai|Delhi|Bangalore|Beijing|Shanghai|Tokyo|Osaka|Seoul|Singapore|Sydney|Melbourne|Toronto|Montreal|Vancouver|Chicago|Boston|Seattle|Houston|
Philadelphia|Denver|Atlanta|Miami|Los Angeles|San Francisco|New York|Mexico City|Buenos Aires|São Paulo|Germany|France|Spain|Italy|Austria|Switzerland|Netherlands|Belgium|Portugal|Poland|
Ireland|Scotland|England|Canada|Mexico|Brazil|Argentina|Chile|India|China|Japan|Australia|Nigeria|Kenya|Egypt""".replace("\n", "")
_WORD = r"[A-ZÀ-Þ][a-zà-ÿ'’\-]+"
NAMED = [
    ("PERSON", re.compile(rf"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? ({_WORD}(?: {_WORD}){{0,2}})"), 0.85, None),
    ("PERSON", re.compile(rf"\b(?:[Mm]y name is|[Nn]ame:|I am called|[Ss]igned,?) ({_WORD}(?: {_WORD}){{0,2}})"), 0.85, None),
    ("PERSON", re.compile(rf"\b((?:{'|'.join(_NAMES)})(?: [A-Z]\.)? {_WORD})"), 0.8, None),
    ("LOCATION", re.compile(rf"\b(?:{_PLACES})\b"), 0.8, None),
    ("LOCATION", re.compile(rf"\b{_WORD}(?: {_WORD})?, (?:A[KLRZ]|C[AOT]|D[CE]|FL|GA|HI|I[ADLN]|K[SY]|LA|M[ADEINOST]|N[CDEHJMVY]|O[HKR]|PA|RI|S[CD]|T[NX]|UT|V[AT]|W[AIVY])\b(?: \d{{5}})?"), 0.85, None),
    ("LOCATION", re.compile(rf"\b\d{{1,5}} {_WORD}(?: {_WORD})? (?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Drive|Dr|Square|Court)\b\.?"), 0.85, None),
]
_CAPITALIZED = re.compile(r"[A-ZÀ-Þ][a-zà-ÿ]+")
_STATE = re.compile(r", [A-Z]{2}\b")
#: What a text must have for each of NAMED to be looked for: one of some capitalized words, or what a quick look finds.
_NEEDS: list[frozenset[str] | Callable[[str], object]] = [
    frozenset("Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Señor Señora".split()),
    lambda text: "name is" in text or "ame:" in text or "I am called" in text or "igned" in text,
    frozenset(_NAMES),
    frozenset(place.split()[0] for place in _PLACES.split("|")),
    _STATE.search,
    frozenset("Street St Avenue Ave Road Rd Lane Ln Boulevard Blvd Drive Dr Square Court".split()),
]
#: Clinical types, found only if asked for.
CLINICAL = [
    ("MEDICAL_LICENSE", re.compile(r"\b[A-Z]{2}\d{7}\b"), 0.7, None),
    ("US_DRIVER_LICENSE", re.compile(r"(?i)\bdriver'?s? licen[sc]e\D{0,8}([A-Z]\d{7,12})\b"), 0.8, None),
    ("US_PASSPORT", re.compile(r"(?i)\bpassport\D{0,8}(\d{9})\b"), 0.8, None),
    ("DATE_TIME", re.compile(r"\b\d{4}-\d{2}-\d{2}\b"), 0.85, None),
]
DEFAULT_TYPES = ("PERSON", "LOCATION", "EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "US_SSN", "IP_ADDRESS", "IBAN_CODE", "US_BANK_NUMBER")
CLINICAL_TYPES = (*DEFAULT_TYPES, *(n for n, *_ in CLINICAL))
_FIRST = "Alex Robin Sam Jordan Casey Morgan Taylor Jamie Avery Riley Quinn Rowan".split()
_LAST = "Fields Brook Hart Lane Marsh Stone West Young Reed Frost Hale Ward".split()
_CITY = "Ashford Millbrook Eastvale Norwood Larkfield Stonebridge Fairmont Oakdale".split()


def find_pii(text: str, types: tuple[str, ...], least: float, extra: Recognizer | None = None) -> list[Span]:
    """Spans that don't overlap: of those that do, the one of the higher score, then the longer."""
    spans: list[Span] = []
    words = set(_CAPITALIZED.findall(text)) if "PERSON" in types or "LOCATION" in types else set()
    named = [rule for rule, needs in zip(NAMED, _NEEDS, strict=True) if (needs(text) if callable(needs) else not needs.isdisjoint(words))]
    for name, pattern, score, check in [*PATTERNS, *named, *CLINICAL]:
        if name in types and score >= least:
            for m in pattern.finditer(text):
                g = 1 if pattern.groups else 0
                if check is None or check(m.group(g)):
                    spans.append((name, m.start(g), m.end(g), score))
    if extra:
        spans += [s for s in extra(text) if s[0] in types and s[3] >= least]
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: (-s[3], s[1] - s[2], s[1])):
        if all(s[2] <= o[1] or s[1] >= o[2] for o in out):
            out.append(s)
    return sorted(out, key=lambda s: s[1])


def fake(kind: str, original: str, seed: int) -> str:
    """What takes the original's place: the same for the same seed, kind and original."""
    h = int.from_bytes(hashlib.blake2b(f"{seed}\0{kind}\0{original}".encode(), digest_size=16).digest(), "big")
    digits = f"{h % 10**18:018d}"
    match kind:
        case "PERSON":
            return f"{_FIRST[h % 12]} {_LAST[h // 12 % 12]}"
        case "LOCATION":
            return _CITY[h % 8]
        case "EMAIL_ADDRESS":
            return f"{_FIRST[h % 12].lower()}.{_LAST[h // 12 % 12].lower()}{digits[:4]}@example.com"
        case "PHONE_NUMBER":
            return f"555-{digits[:3]}-{digits[3:7]}"
        case "CREDIT_CARD":
            body = "4" + digits[:14]
            return body + next(d for d in "0123456789" if luhn(body + d))
        case "US_SSN":
            return f"{100 + h % 565}-{10 + h // 7 % 89}-{1000 + h // 11 % 8999}"
        case "IP_ADDRESS":
            return f"10.{h % 256}.{h // 256 % 256}.{h // 65536 % 254 + 1}"
        case "IBAN_CODE":
            body = digits[:18]
            return f"GB{98 - int(''.join(str(int(c, 36)) for c in body + 'GB00')) % 97:02d}{body}"
        case "US_BANK_NUMBER":
            return digits[:12]
        case "MEDICAL_LICENSE":
            return f"AB{digits[:7]}"
        case "US_DRIVER_LICENSE":
            return f"D{digits[:8]}"
        case "US_PASSPORT":
            return digits[:9]
        case "DATE_TIME":
            return f"{1950 + h % 50}-{1 + h // 50 % 12:02d}-{1 + h // 600 % 28:02d}"
    return f"[{kind}]"


def pseudonymize(samples: DataFrame, entity_types: tuple[str, ...] = DEFAULT_TYPES, fields: tuple[str, ...] | None = None, score_threshold: float = 0.7, faker_seed: int = 42, recognizer: Recognizer | None = None) -> DataFrame:
    """Samples with personal data replaced, alike in all fields of a sample; records count types, never values.

    People and places have rules of their own; ``recognizer`` adds spans of a model of the user's. Python sees the texts
    that are looked at and nothing else.
    """
    scalars = [f for f in ALL_FIELDS if f != "responses"]

    def replaced(texts: list[str | None] | None, counts: dict[str, int]) -> list[str | None] | None:
        if texts is None:
            return None
        out = []
        for text in texts:
            for kind, a, b, _ in reversed(find_pii(text, entity_types, score_threshold, recognizer)) if text else ():
                counts[kind] = counts.get(kind, 0) + 1
                text = text[:a] + fake(kind, text[a:b], faker_seed) + text[b:]
            out.append(text)
        return out

    @F.arrow_udf("struct<texts:array<string>,responses:array<string>,kinds:array<string>>")
    def clean(texts: pa.Array, responses: pa.Array) -> pa.Array:
        found = []
        for one, more in zip(texts.to_pylist(), responses.to_pylist(), strict=True):
            counts: dict[str, int] = {}
            found.append((replaced(one, counts), replaced(more, counts), [f"{k}:{n}" for k, n in sorted(counts.items())]))
        lists = [pa.array([x[k] for x in found], pa.list_(pa.string())) for k in range(3)]
        return pa.StructArray.from_arrays(lists, ["texts", "responses", "kinds"])

    looked_at = F.lit(None).cast("array<string>")
    if fields:
        looked_at = F.array(*map(F.lit, fields))
    else:
        for task, names in HYGIENE_FIELDS.items():
            looked_at = F.coalesce(looked_at, F.when(F.col("task_type") == task, F.array(*map(F.lit, names))))
        looked_at = F.coalesce(looked_at, F.array(*map(F.lit, ALL_FIELDS)))
    seen = lambda f: F.when(F.array_contains("_fields", f), F.col(f))
    done = samples.withColumn("_fields", looked_at).withColumn("_done", clean(F.array(*map(seen, scalars)), seen("responses")))
    kept = {f: F.coalesce(F.col("_done.texts")[i], F.col(f)) for i, f in enumerate(scalars)} | {"responses": F.coalesce("_done.responses", "responses")}
    out = done.select(*(kept.get(c, F.col(c)).alias(c) for c in samples.columns), F.col("_done.kinds").alias("_kinds"), "_fields")
    counts = F.map_from_entries(F.transform("_kinds", lambda k: F.struct(F.substring_index(k, ":", 1), F.substring_index(k, ":", -1).cast("int"))))
    notes = F.to_json(F.struct(counts.alias("entities_replaced"), F.col("_fields").alias("fields_processed"), F.coalesce(F.aggregate(F.map_values(counts), F.lit(0), lambda a, x: a + x), F.lit(0)).alias("total_replacements")))
    return with_provenance(out, "PIIPseudonymizer", notes, {"entity_types": entity_types, "seed": faker_seed}).drop("_kinds", "_fields")
