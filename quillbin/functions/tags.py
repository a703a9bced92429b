"""Metric texts as tag sets: parsing, canonical names and ingest-time cardinality rules, as Column expressions and as plain Python twins.

A metric text is tags separated by commas; a tag is `key=value`, or a key alone. A separator preceded by an odd number of backslashes is part
of the text, and escapes stay as they are written. Empty tags are skipped, `key=` is `key`, and a metric's identity is its set of tags.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TAGS = 255
TAGS_TYPE = "array<struct<k:string,v:string,tag:string>>"

_TAG = r"(?s)((?:[^\\,]|\\.|\\$)+)"
_KEY = r"(?s)^((?:[^\\=]|\\.|\\$)*)"


@dataclass(frozen=True)
class Rule:
    """Tags of `key` whose text contains `contains` become `action`; None drops them. The first rule of a key that fits decides."""

    key: str
    contains: str = ""
    action: str | None = None


def drop_tag_key(key: str) -> Rule:
    return Rule(key)


def rewrite_tag(key: str, contains: str, action: str | None) -> Rule:
    return Rule(key, contains, action)


# ---------------------------------------------------------------- columns


def _struct(raw: Column) -> Column:
    key = F.regexp_extract(raw, _KEY, 1)
    tag = F.when(raw == F.concat(key, F.lit("=")), key).otherwise(raw)
    return F.struct(key.alias("k"), F.when(F.length(tag) > F.length(key), F.substr(tag, F.length(key) + 2)).otherwise(F.lit("")).alias("v"), tag.alias("tag"))


def _fixed(t: Column, rules: Sequence[Rule]) -> Column:
    out = t["tag"]
    for rule in reversed(rules):
        action = F.lit(rule.action).cast("string")
        out = F.when((t["k"] == rule.key) & F.contains(t["tag"], F.lit(rule.contains)), action).otherwise(out)
    return out


def parse_tags(metric: str | Column, rules: Sequence[Rule] = ()) -> Column:
    """Distinct tags of a metric text, in order of first appearance; null for null. A rewritten tag's key is read from the new text."""
    raw = F.regexp_extract_all(F.col(metric) if isinstance(metric, str) else metric, F.lit(_TAG), F.lit(1))
    tags = F.filter(F.transform(raw, _struct), lambda t: t["tag"] != "")
    if rules:
        texts = F.filter(F.transform(tags, lambda t: _fixed(t, rules)), lambda t: t.isNotNull() & (t != ""))
        tags = F.transform(texts, _struct)
    return F.array_distinct(tags)


def canonical_name(tags: str | Column) -> Column:
    """Distinct tags, sorted by bytes, comma-joined: the metric's identity."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    return F.array_join(F.array_sort(F.transform(tags, lambda t: t["tag"])), ",")


def is_storable(tags: str | Column) -> Column:
    """A metric has 1 to 255 tags."""
    n = F.size(F.col(tags) if isinstance(tags, str) else tags)
    return (n > 0) & (n <= MAX_TAGS)


# ---------------------------------------------------------------- twins


def pop_tag(text: str) -> tuple[str, str, str]:
    """(key, tag, rest) of a metric text."""
    m = re.compile(r"(?:[^\\,]|\\.|\\\Z)*", re.S).match(text)
    raw = m.group(0)
    rest = text[len(raw) + 1 :]
    key = re.compile(r"(?:[^\\=]|\\.|\\\Z)*", re.S).match(raw).group(0)
    return key, key if raw == key + "=" else raw, rest


def tag_set(text: str, rules: Sequence[Rule] = ()) -> dict[str, tuple[str, str]]:
    """Tag text -> (key, value), in order of first appearance."""
    out: dict[str, tuple[str, str]] = {}
    while text:
        key, tag, text = pop_tag(text)
        if tag and rules:
            fit = next((r for r in rules if r.key == key and r.contains in tag), None)
            if fit:
                if not fit.action:
                    continue
                key, tag, _ = pop_tag(fit.action)
        if tag:
            out.setdefault(tag, (key, tag[len(key) + 1 :]))
    return out


def name_of(text: str, rules: Sequence[Rule] = ()) -> str:
    return ",".join(sorted(tag_set(text, rules), key=lambda t: t.encode()))
