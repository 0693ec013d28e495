"""Gates on built-in expressions: schema and tokens, secrets, coverage."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsift.functions.samples import once, split_gate, with_provenance
from loomsift.functions.text import PREFERENCE, hygiene_fields, is_task, n_tokens, primary_text, strip

REQUIRED = {
    "preference": ("instruction", "chosen", "rejected"),
    "implicit_preference": ("chosen", "rejected"),
    "grpo": ("instruction", "responses"),
    "language_modeling": ("output",),
    "source_chunk": ("input",),
    "prompt_only": ("instruction",),
}
REQUIRED_ELSE = ("instruction", "output")
TEXTS = ("instruction", "input", "output", "chosen", "rejected")


def schema_reason(required: tuple[str, ...] | None = None, min_tokens: int = 10, max_tokens: int = 2048, task_types: tuple[str, ...] | None = None, counter=n_tokens) -> Column:  # noqa: ANN001
    """The first check that a sample fails, or null: task type, required fields, null bytes, tokens."""

    def missing(names: tuple[str, ...]) -> Column:
        return F.coalesce(*(F.when((F.size(n) == 0) if n in ("responses", "reward_scores") else F.col(n).isNull() if n == "label" else strip(n) == "", F.lit(f"missing_field:{n}")) for n in names), F.lit(None).cast("string"))

    if required is None:
        fields = None
        for task, names in REQUIRED.items():
            fields = (F if fields is None else fields).when(F.col("task_type") == task, missing(names))
        fields = fields.otherwise(missing(REQUIRED_ELSE))
    else:
        fields = missing(required) if required else F.lit(None).cast("string")
    null_byte = F.coalesce(*(F.when(F.instr(n, "\0") > 0, F.lit(f"encoding_error:null_byte_in_{n}")) for n in TEXTS))
    text = primary_text()
    n = counter(text)  # the planner evaluates it once for all of its uses
    bounds = F.when(strip(text) == "", None).when(n < min_tokens, F.concat(F.lit("below_min_tokens:"), n.cast("string"))).when(n > max_tokens, F.concat(F.lit("above_max_tokens:"), n.cast("string")))
    checks = [fields, null_byte, bounds]
    if task_types is not None:
        checks.insert(0, F.when(~is_task(*task_types), F.concat(F.lit("task_type_not_allowed:"), "task_type")))
    return F.coalesce(*checks)


def schema_gate(samples: DataFrame, **options) -> tuple[DataFrame, DataFrame]:  # noqa: ANN003
    passed, rejected = split_gate(samples, schema_reason(**options), "SchemaGate")
    notes = lambda ok: F.to_json(F.struct(F.lit(ok).alias("passed"), "task_type", *([] if ok else ["rejection_reason"])))
    return with_provenance(passed, "SchemaGate", notes(True), options), with_provenance(rejected, "SchemaGate", notes(False), options)


# --- secrets --------------------------------------------------------------------------------------------------------

SECRETS = {
    "AWSKeyDetector": r"(?<![A-Za-z0-9])(?:AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "ArtifactoryDetector": r"(?:^|[\s=:\"'])AKC[a-zA-Z0-9]{10,}",
    "AzureStorageKeyDetector": r"AccountKey=[a-zA-Z0-9+/=]{88}",
    "BasicAuthDetector": r"://[^\s:/?#\[\]@!$&'()*+,;=]+:[^\s:/?#\[\]@!$&'()*+,;=]+@",
    "GitHubTokenDetector": r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{36}",
    "GitLabTokenDetector": r"(?:glpat|gldt|glrt)-[A-Za-z0-9_\-]{20,50}(?![A-Za-z0-9_\-])",
    "JwtTokenDetector": r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]*",
    "MailchimpDetector": r"[0-9a-z]{32}-us[0-9]{1,2}",
    "NpmDetector": r"npm_[A-Za-z0-9]{36}",
    "OpenAIDetector": r"sk-(?:proj-)?[A-Za-z0-9_\-]{20,}",
    "PrivateKeyDetector": r"-----BEGIN (?:(?:DSA|EC|OPENSSH|RSA|ENCRYPTED) )?PRIVATE KEY(?: BLOCK)?-----",
    "SendGridDetector": r"SG\.[a-zA-Z0-9_\-]{22}\.[a-zA-Z0-9_\-]{43}",
    "SlackDetector": r"xox(?:a|b|p|o|s|r)-(?:\d+-)+[a-z0-9]+",
    "StripeDetector": r"(?:r|s)k_live_[0-9a-zA-Z]{24}",
    "TwilioKeyDetector": r"(?:AC|SK)[a-z0-9]{32}",
}
#: Texts of which a finding has one; a detector looks only where there is one.
ANCHORS = {
    "AWSKeyDetector": ("AKIA", "ASIA", "ABIA", "ACCA"), "ArtifactoryDetector": ("AKC",), "AzureStorageKeyDetector": ("AccountKey=",), "BasicAuthDetector": ("://",),
    "GitHubTokenDetector": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "GitLabTokenDetector": ("glpat-", "gldt-", "glrt-"), "JwtTokenDetector": ("eyJ",), "MailchimpDetector": ("-us",),
    "NpmDetector": ("npm_",), "OpenAIDetector": ("sk-",), "PrivateKeyDetector": ("-----BEGIN",), "SendGridDetector": ("SG.",), "SlackDetector": ("xox",),
    "StripeDetector": ("k_live_",), "TwilioKeyDetector": ("AC", "SK"), "HexHighEntropyString": ("'", '"'), "Base64HighEntropyString": ("'", '"'), "KeywordDetector": ("'", '"'),
}
KEYWORD = {"KeywordDetector": r"(?i)(?:api_?key|secret|passw(?:or)?d|token|private_?key)\s*[:=]\s*[\"'][^\"'\s]{4,}[\"']"}
#: Quoted strings whose entropy is measured, by their alphabet.
QUOTED = {"HexHighEntropyString": (r"[\"']([0-9a-fA-F]{8,})[\"']", 3.0), "Base64HighEntropyString": (r"[\"']([A-Za-z0-9+/\-_]{8,}={0,2})[\"']", 4.5)}


def entropy(text: Column) -> Column:
    """Shannon entropy of a string's characters, in bits."""
    chars = F.split(text, "")
    n = F.length(text)
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s - (F.size(F.filter(chars, lambda x: x == c)) / n) * F.log2(F.size(F.filter(chars, lambda x: x == c)) / n))


def secret_findings(text: Column, code: bool = False, hex_limit: float = 3.0, base64_limit: float = 4.5) -> Column:
    """``array<string>``: a detector's name for each of its findings in a text."""

    def where_anchored(name: str, found: Column) -> Column:
        has = reduce(Column.__or__, (F.contains(text, F.lit(a)) for a in ANCHORS[name]))
        return F.when(has, found).otherwise(F.array().cast("array<string>"))

    plain = SECRETS | (KEYWORD if code else {})
    parts = [where_anchored(name, F.array_repeat(F.lit(name), F.regexp_count(text, F.lit(p)))) for name, p in plain.items()]
    for name, (p, _) in QUOTED.items():
        limit = hex_limit if name.startswith("Hex") else base64_limit
        high = F.filter(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda s: entropy(s) > limit)  # noqa: B023
        parts.append(where_anchored(name, F.transform(high, lambda _: F.lit(name))))  # noqa: B023
    return F.concat(*parts)


def secrets_found(samples: DataFrame, fields: tuple[str, ...] | None = None, code_corpus_mode: bool = False, **limits: float) -> DataFrame:
    """``samples`` with ``findings``, an array of (field, type)."""
    each = F.transform(hygiene_fields(fields), lambda f: F.transform(secret_findings(f["text"], code_corpus_mode, **limits), lambda t: F.struct(f["field"].alias("field"), t.alias("type"))))
    return once(samples, F.flatten(each), "findings")


def secrets_gate(samples: DataFrame, fields: tuple[str, ...] | None = None, code_corpus_mode: bool = False, **limits: float) -> tuple[DataFrame, DataFrame]:
    """Rejects samples in which a detector finds something; the record has counts, never what was found."""
    found = secrets_found(samples, fields, code_corpus_mode, **limits).withColumn("_fields", F.transform(hygiene_fields(fields), lambda f: f["field"]))
    types = F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["type"])))
    counts = F.map_from_entries(F.transform(types, lambda t: F.struct(t, F.size(F.filter("findings", lambda f: f["type"] == t)))))
    notes = F.to_json(F.struct((F.size("findings") == 0).alias("passed"), counts.alias("secret_type_counts"), F.col("_fields").alias("fields_scanned"), F.size("findings").alias("total_findings")))
    config = {"fields": fields, "code_corpus_mode": code_corpus_mode, **limits}
    marked = with_provenance(found, "SecretsGate", notes, config)
    passed, rejected = split_gate(marked, F.when(F.size("findings") > 0, F.concat(F.lit("secret_detected:"), F.array_join(types, ","))), "SecretsGate")
    return passed.drop("findings", "_fields"), rejected.drop("findings", "_fields")


def coverage_gaps(df: DataFrame, category: str, least: float = 0.05) -> DataFrame:
    """Each category's count and share, and whether it is under ``least``."""
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return df.groupBy(F.coalesce(category, F.lit("unknown")).alias("category")).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / total).withColumn("is_gap", F.col("share") < least)


def category_of(field: str) -> Column:
    """A top-level field, else one of the metadata, else "unknown"."""
    if re.fullmatch("id|source_uri|task_type", field):
        return F.col(field)
    return F.coalesce(F.get_json_object("metadata", f"$.{field}"), F.lit("unknown"))


__all__ = ["PREFERENCE", "category_of", "coverage_gaps", "schema_gate", "schema_reason", "secret_findings", "secrets_found", "secrets_gate"]
