"""Licence recognition by sentence rules, in DataFrame expressions only.

A text is cut into sentences: at blank lines, before list marks, and after . ! ? before white space; a sentence goes on over the ends of its lines.
Sentences with a licence word are normalised: lower case, every run of other characters than letters and digits one space. What is known of licences'
sentences, in order, gives their identifiers, by SENTENCES. The identifiers of a document, in order, are matched against TEXTS (whole licences: a title,
an end, and all between), then RULES, also in order: a rule takes every place where its sequence of identifiers stands, and later rules see what is
left. All of it happens within the row: no shuffle, no collection of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbin.llm._common import table

#: A text or sentence without any of these (lower case) holds no licence sentence.
KEYWORDS = ("licen", "copyright", "warrant", "permission", "redistribut", "spdx", "public domain", "rights reserved", "released under", "cc by", "cc0", "software is provided", "this software", "liable for", "terms and conditions", "free software", "neither the name", "covered software", "hope that it will be useful")

#: (identifier, regular expression of a known sentence or its telling part, normalised), where several fit at a place the first counts. Both engines read these.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("spdx-mit", "spdx licen[cs]e identifier mit"),
    ("spdx-apache-2", "spdx licen[cs]e identifier apache 2 0"),
    ("spdx-bsd-2", "spdx licen[cs]e identifier bsd 2 clause"),
    ("spdx-bsd-3", "spdx licen[cs]e identifier bsd 3 clause"),
    ("spdx-lgpl", "spdx licen[cs]e identifier lgpl [23] [01]( only| or later)?"),
    ("spdx-agpl-3", "spdx licen[cs]e identifier agpl 3 0( only| or later)?"),
    ("spdx-gpl-2-later", "spdx licen[cs]e identifier gpl 2 0 or later"),
    ("spdx-gpl-2", "spdx licen[cs]e identifier gpl 2 0( only)?"),
    ("spdx-gpl-3-later", "spdx licen[cs]e identifier gpl 3 0 or later"),
    ("spdx-gpl-3", "spdx licen[cs]e identifier gpl 3 0( only)?"),
    ("spdx-mpl-2", "spdx licen[cs]e identifier mpl 2 0"),
    ("spdx-isc", "spdx licen[cs]e identifier isc"),
    ("spdx-other", "spdx licen[cs]e identifier [a-z0-9]+"),
    ("agpl-3-title", "gnu affero general public licen[cs]e version 3 19 november 2007"),
    ("lgpl-3-title", "gnu lesser general public licen[cs]e version 3 29 june 2007"),
    ("lgpl-21-title", "gnu lesser general public licen[cs]e version 2 1 february 1999"),
    ("gpl-3-title", "gnu general public licen[cs]e version 3 29 june 2007"),
    ("gpl-2-title", "gnu general public licen[cs]e version 2 june 1991"),
    ("apache-2-title", "apache licen[cs]e version 2 0 january 2004"),
    ("mpl-2-title", "means each individual or legal entity that creates contributes to the creation of or owns covered software"),
    ("terms-end", "end of terms and conditions"),
    ("lgpl-3-end", "permanent authorization for you to choose that version for the library"),
    ("mpl-2-end", "incompatible with secondary licen[cs]es as defined by the mozilla public licen[cs]e v 2 0"),
    ("gpl-copy", "you should have received a copy of the gnu (lesser |library |affero )?general public licen[cs]e"),
    ("gpl-see", "see the gnu (lesser |library |affero )?general public licen[cs]e for more details"),
    ("lgpl-instead", "use the gnu (lesser|library) general public licen[cs]e instead of this licen[cs]e"),
    ("agpl-3-later", "gnu affero general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version"),
    ("lgpl-later", "gnu (lesser|library) general public licen[cs]e as published by the free software foundation either version [23]( 1)? of the licen[cs]e or at your option any later version"),
    ("gpl-3-later", "gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version"),
    ("gpl-2-later", "gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version"),
    ("agpl-any", "gnu affero general public licen[cs]e"),
    ("lgpl-any", "gnu (lesser|library) general public licen[cs]e"),
    ("gpl-3", "gnu general public licen[cs]e (as published by the free software foundation )?(either )?(v|version )3"),
    ("gpl-2", "gnu general public licen[cs]e (as published by the free software foundation )?(either )?(v|version )2"),
    ("gpl-any", "gnu general public licen[cs]e"),
    ("gpl-free", "this (program|library) is free software"),
    ("gpl-hope", "(program|library) is distributed in the hope that it will be useful"),
    ("apache-2", "apache licen[cs]e (version )?2 0"),
    ("apache-use", "you may not use this file except in compliance with the licen[cs]e"),
    ("apache-copy", "you may obtain a copy of the licen[cs]e at"),
    ("apache-law", "unless required by applicable law or agreed to in writing"),
    ("mpl-2", "mozilla public licen[cs]e (v |version )?2 0"),
    ("mit-name", "mit licen[cs]e"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc-name", "isc licen[cs]e"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose"),
    ("mit-notice", "(above )?copyright notice and this permission notice (shall be included|appear in all copies)"),
    ("mit-as-is", "the software is provided as is without warranty of any kind"),
    ("isc-as-is", "the software is provided as is and the author disclaims all warranties"),
    ("bsd-use", "redistribution and use in source and binary forms"),
    ("bsd-source", "redistributions of source code must retain the above copyright"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright"),
    ("bsd-name", "neither the names? of [a-z0-9 ]*may be used to endorse or promote"),
    ("bsd-as-is", "this software is provided by [a-z0-9 ]*as is"),
    ("bsd-liable", "in no event shall [a-z0-9 ]*be liable for"),
    ("cc0", "cc0( 1 0)?"),
    ("cc-by-nc-sa", "cc by nc sa|creative commons attribution noncommercial sharealike"),
    ("cc-by-nc-nd", "cc by nc nd|creative commons attribution noncommercial noderivatives"),
    ("cc-by-nc", "cc by nc|creative commons attribution noncommercial"),
    ("cc-by-nd", "cc by nd|creative commons attribution noderivatives"),
    ("cc-by-sa", "cc by sa|creative commons attribution sharealike"),
    ("cc-by", "cc by|creative commons attribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "(in|into) the public domain"),
    ("reserved", "all rights reserved"),
    ("copyright", "copyright (c )?[0-9]{4}"),
)
#: A sentence without any of these that fits this has the identifier some-licence.
SOME = "(licen[cs]ed|released|distributed) under (the )?[a-z0-9 ]*licen[cs]e"

#: (licence, identifiers of its title and of its end): a whole text is all from one to the other, and a header that shows how to apply it.
TEXTS: tuple[tuple[str, str, str], ...] = (
    ("GPL-3.0", "gpl-3-title", "terms-end"),
    ("AGPL-3.0", "agpl-3-title", "terms-end"),
    ("LGPL-3.0", "lgpl-3-title", "lgpl-3-end"),
    ("LGPL-2.1", "lgpl-21-title", "terms-end"),
    ("GPL-2.0", "gpl-2-title", "terms-end"),
    ("Apache-2.0", "apache-2-title", "terms-end"),
    ("MPL-2.0", "mpl-2-title", "mpl-2-end"),
)

#: (licence, sequence of sentence identifiers), longer and more particular sequences first; without a licence, what is no licence of the text's own.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache-2", "apache-use", "apache-copy", "apache-law")),
    ("Apache-2.0", ("apache-2", "apache-use", "apache-copy")),
    ("BSD-3-Clause", ("bsd-use", "bsd-source", "bsd-binary", "bsd-name", "bsd-as-is", "bsd-liable")),
    ("BSD-3-Clause", ("bsd-use", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-use", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liable")),
    ("BSD-2-Clause", ("bsd-use", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-name", "mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-name", "isc-grant", "mit-notice", "isc-as-is")),
    ("ISC", ("isc-grant", "mit-notice", "isc-as-is")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl-3-later", "gpl-hope")),
    ("LGPL-or-later", ("gpl-free", "lgpl-later", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-3-later", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-2-later", "gpl-hope")),
    ("AGPL-3.0", ("gpl-free", "agpl-any", "gpl-hope")),
    ("LGPL", ("gpl-free", "lgpl-any", "gpl-hope")),
    ("GPL-3.0", ("gpl-free", "gpl-3", "gpl-hope")),
    ("GPL-2.0", ("gpl-free", "gpl-2", "gpl-hope")),
    *((name, (key,)) for name, key in (
        ("GPL-3.0", "gpl-3-title"), ("AGPL-3.0", "agpl-3-title"), ("LGPL-3.0", "lgpl-3-title"), ("LGPL-2.1", "lgpl-21-title"), ("GPL-2.0", "gpl-2-title"), ("Apache-2.0", "apache-2-title"), ("MPL-2.0", "mpl-2-title"),
        ("MIT", "spdx-mit"), ("Apache-2.0", "spdx-apache-2"), ("BSD-2-Clause", "spdx-bsd-2"), ("BSD-3-Clause", "spdx-bsd-3"), ("LGPL", "spdx-lgpl"), ("AGPL-3.0", "spdx-agpl-3"),
        ("GPL-2.0-or-later", "spdx-gpl-2-later"), ("GPL-2.0", "spdx-gpl-2"), ("GPL-3.0-or-later", "spdx-gpl-3-later"), ("GPL-3.0", "spdx-gpl-3"), ("MPL-2.0", "spdx-mpl-2"), ("ISC", "spdx-isc"),
        ("AGPL-3.0-or-later", "agpl-3-later"), ("LGPL-or-later", "lgpl-later"), ("GPL-3.0-or-later", "gpl-3-later"), ("GPL-2.0-or-later", "gpl-2-later"), ("Apache-2.0", "apache-2"), ("AGPL-3.0", "agpl-any"), ("LGPL", "lgpl-any"),
        ("GPL-3.0", "gpl-3"), ("GPL-2.0", "gpl-2"), ("GPL", "gpl-any"), ("MPL-2.0", "mpl-2"), ("MIT", "mit-name"), ("MIT", "mit-grant"), ("ISC", "isc-name"), ("ISC", "isc-grant"), ("CC0-1.0", "cc0"),
        ("CC-BY-NC-SA", "cc-by-nc-sa"), ("CC-BY-NC-ND", "cc-by-nc-nd"), ("CC-BY-NC", "cc-by-nc"), ("CC-BY-ND", "cc-by-nd"), ("CC-BY-SA", "cc-by-sa"), ("CC-BY", "cc-by"), ("Unlicense", "unlicense"),
        ("Public-Domain", "public-domain"), ("Proprietary", "reserved"),
    )),
)

#: Ends of lines where a sentence ends too, in order: blank lines, and those before a list mark.
_BLANK = r"\n[ \t\r]*\n"
_MARK = r"\n[ \t\r]*(\(?[0-9a-z]{1,3}[.)][ \t]|[-•][ \t])"
#: A point that ends no sentence: the one of a version.
_VERSION = r"\bv\.[ \t\r\n]+([0-9])"
_ANY = "|".join(f"(?:{pattern})" for _, pattern in SENTENCES)


def _has_keyword(lowered: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(k)) for k in KEYWORDS])


def _sentences(lowered: Column) -> Column:
    lowered = F.regexp_replace(lowered, _VERSION, "v $1")
    marked = F.regexp_replace(F.regexp_replace(lowered, _BLANK, "\u0001\n"), _MARK, "\u0001$1")
    return F.split(F.replace(marked, F.lit("\n"), F.lit(" ")), "\u0001|[.!?][ \\t\\r]+")


def _normalise(sentence: Column) -> Column:
    """A lower-case sentence with single spaces for everything but letters and digits."""
    return F.regexp_replace(sentence, "[^a-z0-9]+", " ")


def _identify(found: Column) -> Column:
    """The identifier of a known sentence, as it was found."""
    out = F.lit("")
    for key, pattern in reversed(SENTENCES):
        out = F.when(F.regexp_like(found, F.lit(f"^(?:{pattern})$")), F.lit(key)).otherwise(out)
    return out


def _claim(state: Column, rules: list[tuple[str, str]], patterns: bool) -> Column:
    """The rules, one after another, on what the ones before have left: rest, and the licences got."""
    table = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(p).alias("pattern")) for n, p in rules))
    taken = (lambda s, r: F.regexp_replace(s["rest"], r["pattern"], F.lit("#"))) if patterns else (lambda s, r: F.replace(s["rest"], r["pattern"], F.lit("#")))
    fits = (lambda s, r: F.regexp_like(s["rest"], r["pattern"])) if patterns else (lambda s, r: F.contains(s["rest"], r["pattern"]))
    step = lambda s, r: F.struct(taken(s, r).alias("rest"), F.when(fits(s, r), F.array_union(s["got"], F.array(r["name"]))).otherwise(s["got"]).alias("got"))
    return F.aggregate(table, state, step)


def _text_rules() -> list[tuple[str, str]]:
    header = "(?:<gpl-free><[a-z0-9-]+><gpl-hope>)?"
    last = "(?:(?:<[^>]*>)*?<lgpl-instead>)?"  # the last sentence of two of them
    return [(name, f"<{title}>(?:<[^>]*>)*?<{end}>{header}{last * (title in ('gpl-2-title', 'gpl-3-title'))}") for name, title, end in TEXTS]


def _sequence_rules() -> list[tuple[str, str]]:
    return [(name, "".join(f"<{k}>" for k in sequence)) for name, sequence in RULES]


def licences(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), sentences (identifiers in order), licences (of the rules that matched, each once, whole texts first, then in the
    order of RULES), n_unclaimed (identifiers that no rule took) for each row of docs.

    Null and empty texts have no sentence; lists are comma-joined, empty if nothing was found. Repeated rows each give a row; other columns are ignored."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lowered = F.lower(text)
    normal = F.transform(F.filter(_sentences(lowered), _has_keyword), _normalise)

    def keys_of(sentence: Column) -> Column:
        known = F.transform(F.regexp_extract_all(sentence, F.lit(rf"\b({_ANY})\b"), F.lit(1)), _identify)
        return F.when((F.size(known) == 0) & F.regexp_like(sentence, F.lit(rf"\b{SOME}\b")), F.array(F.lit("some-licence"))).otherwise(known)

    keys = F.when(_has_keyword(lowered), F.flatten(F.transform(normal, keys_of))).otherwise(F.array().cast("array<string>"))
    # a separator on both sides of each, so that a replaced sequence never lends its separators to a neighbour
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), keys.alias("keys"))
    out = out.withColumn("rest", F.concat(F.lit("<"), F.array_join("keys", "><"), F.lit(">")))
    none = F.struct(F.lit("").alias("rest"), F.array().cast("array<string>").alias("got"))
    begin = F.struct(F.col("rest").alias("rest"), F.array().cast("array<string>").alias("got"))
    claimed = _claim(_claim(begin, _text_rules(), True), _sequence_rules(), False)
    out = out.withColumn("claimed", F.when(F.size("keys") > 0, claimed).otherwise(none))
    left = F.length(F.col("claimed.rest")) - F.length(F.replace(F.col("claimed.rest"), F.lit("<"), F.lit("")))
    return out.select("doc_id", F.size("keys").cast("long").alias("n_sentences"), F.array_join("keys", ",").alias("sentences"), F.array_join("claimed.got", ",").alias("licences"), left.cast("long").alias("n_unclaimed"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """Lines are numbered, joined to paragraphs, and cut at full stops, so that the sentences come about in another way."""
    some = lambda x: " OR ".join(f"contains({x}, '{k}')" for k in KEYWORDS)
    case = "WHEN m = '?' THEN 'some-licence' " + " ".join(f"WHEN regexp_full_match(m, '{p}') THEN '{k}'" for k, p in SENTENCES)
    steps, at = [], "k0"
    for i, (name, pattern) in enumerate(_text_rules() + _sequence_rules()):
        taken, fits = (f"regexp_replace(rest, '{pattern}', '#', 'g')", f"regexp_matches(rest, '{pattern}')") if i < len(TEXTS) else (f"replace(rest, '{pattern}', '#')", f"contains(rest, '{pattern}')")
        steps.append(f"r{i} AS (SELECT doc_id, keys, {taken} AS rest, CASE WHEN {fits} AND NOT contains(got || ',', ',{name},') THEN got || ',{name}' ELSE got END AS got FROM {at})")
        at = f"r{i}"
    return rf"""
WITH l AS (SELECT doc_id, i, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (
       SELECT doc_id, string_split(regexp_replace(lower(text), '{_VERSION}', 'v \1', 'g'), chr(10)) AS lines FROM documents WHERE text IS NOT NULL AND ({some("lower(text)")})))),
b AS (SELECT doc_id, i, line, CASE WHEN regexp_full_match(coalesce(lag(line) OVER w, 'x'), '[ \t\r]*') OR (i > 1 AND regexp_matches(line, '^[ \t\r]*(\(?[0-9a-z]{{1,3}}[.)][ \t]|[-•][ \t])')) THEN 1 ELSE 0 END AS new
      FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, part, string_agg(line, ' ' ORDER BY i) AS p FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM b) GROUP BY doc_id, part),
s AS (SELECT doc_id, part, i, pieces[i] AS p FROM (SELECT doc_id, part, pieces, unnest(range(1, len(pieces) + 1)) AS i FROM (SELECT doc_id, part, string_split_regex(p, '[.!?][ \t\r]+') AS pieces FROM g))),
n AS (SELECT doc_id, part, i, regexp_replace(p, '[^a-z0-9]+', ' ', 'g') AS n FROM s WHERE {some("p")}),
e AS (SELECT doc_id, part, i, n, regexp_extract_all(n, '\b({_ANY})\b', 1) AS ms FROM n),
f AS (SELECT doc_id, part, i, CASE WHEN len(ms) = 0 AND regexp_matches(n, '\b{SOME}\b') THEN ['?'] ELSE ms END AS ms FROM e),
m AS (SELECT doc_id, part, i, j, ms[j] AS m FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS j FROM f)),
k AS (SELECT doc_id, part, i, j, CASE {case} ELSE '' END AS key FROM m),
h AS (SELECT doc_id, count(*) AS c, string_agg(key, ',' ORDER BY part, i, j) AS keys, '<' || string_agg(key, '><' ORDER BY part, i, j) || '>' AS rest FROM k GROUP BY doc_id),
k0 AS (SELECT doc_id, keys, rest, '' AS got FROM h),
{", ".join(steps)}
SELECT d.doc_id, CAST(coalesce(h.c, 0) AS BIGINT) AS n_sentences, coalesce(h.keys, '') AS sentences, coalesce(substr(r.got, 2), '') AS licences,
       CAST(coalesce(length(r.rest) - length(replace(r.rest, '<', '')), 0) AS BIGINT) AS n_unclaimed
FROM documents d LEFT JOIN h USING (doc_id) LEFT JOIN {at} r USING (doc_id)
"""


QUERIES = {"op4_licences": op4_licences}
ORACLE = {"op4_licences": _oracle()}
