"""Globs and RE2 patterns of the selector language as Java regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


class BadPattern(ValueError):
    pass


def glob_parts(pattern: str) -> list[str] | None:
    """Items of a glob: literals (one character each), ANY and ONE; None if it has no wildcard and means `contains`."""
    if not any(c in pattern for c in "*?^$"):
        return None
    rooted = pattern.startswith("^")
    body = pattern[1:] if rooted else pattern
    ends = body.endswith("$")
    body = body[:-1] if ends else body
    out = [] if rooted else ["ANY"]
    chars = iter(body)
    for c in chars:
        if c == "\\":
            c = next(chars, "")
            if not c or c not in "*?\\^$":
                raise BadPattern(f"bad escape in glob {pattern!r}")
            out.append(c)
        else:
            out.append({"*": "ANY", "?": "ONE"}.get(c, c))
    if not ends:
        out.append("ANY")
    return out


def glob_regex(pattern: str) -> str | None:
    """An anchored regular expression, or None for a plain `contains`."""
    parts = glob_parts(pattern)
    if parts is None:
        return None
    return "(?s)^" + "".join({"ANY": ".*", "ONE": "."}.get(p) or re.sub(r"([^0-9A-Za-z_ ])", r"\\\1", p) for p in parts) + r"\z"


def glob_match(pattern: str, text: str) -> bool:
    found = glob_regex(pattern)
    if found is None:
        return pattern in text
    as_bytes = lambda s: s.encode().decode("latin-1")
    return re.search(glob_regex(as_bytes(pattern)).replace(r"\z", r"\Z"), as_bytes(text)) is not None


def glob_column(value: Column, pattern: str) -> Column:
    """`?` stands for one byte: such patterns are matched against the bytes, one character each."""
    found = glob_regex(pattern)
    if found is None:
        return F.contains(value, F.lit(pattern))
    if "?" in pattern:
        return F.rlike(F.decode(F.encode(value, "UTF-8"), "ISO-8859-1"), F.lit(glob_regex(pattern.encode().decode("latin-1"))))
    return F.rlike(value, F.lit(found))


_POSIX = {"alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}", "graph": r"\p{Graph}", "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\s", "upper": r"\p{Upper}", "word": r"\w", "xdigit": r"\p{XDigit}"}


def java_regex(pattern: str) -> str:
    """An RE2 pattern for Java: what RE2 lacks (lookaround, back references, possessive repeats) is refused; `$` means the very end, `.` leaves out only \\n."""
    out, i, in_class, multi = [], 0, False, re.search(r"\(\?[a-zA-Z]*m", pattern) is not None
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 >= len(pattern) or pattern[i + 1] in "123456789kGZ":
                raise BadPattern(f"RE2 has no such escape: {pattern!r}")
            out.append(pattern[i : i + 2])
            i += 2
        elif in_class:
            if pattern.startswith("[:", i) and (end := pattern.find(":]", i)) > 0:
                name = pattern[i + 2 : end]
                if name.lstrip("^") not in _POSIX:
                    raise BadPattern(f"unknown class in {pattern!r}")
                word = _POSIX[name.lstrip("^")]
                out.append(word if name[0] != "^" else word.replace("\\p", "\\P") if "\\p" in word else word.upper())
                i = end + 2
                continue
            in_class = not (c == "]" and out[-1] not in ("[", "[^"))
            out.append("\\" + c if c in "[&" or (c == "]" and in_class) else c)
            i += 1
        elif c == "[":
            in_class = True
            out.append("[^" if pattern.startswith("[^", i) else "[")
            i += len(out[-1])
        elif c == "(" and pattern.startswith("(?", i):
            head = re.match(r"\(\?(P?<[A-Za-z_]\w*>|[imsU]*(-[imsU]+)?[:)])", pattern[i:])
            if not head:
                raise BadPattern(f"RE2 has no such group: {pattern!r}")
            out.append(head.group(0).replace("(?P<", "(?<").replace("U", ""))
            i += len(head.group(0))
        elif c in "*+?}" and i + 1 < len(pattern) and pattern[i + 1] == "+":
            raise BadPattern(f"RE2 has no possessive repeats: {pattern!r}")
        elif c == "$" and not multi:
            out.append(r"\z")
            i += 1
        else:
            out.append(c)
            i += 1
    joined = "".join(out)
    try:
        re.compile(re.sub(r"\\[pP]\{?\w+\}?", r"\\w", joined).replace(r"\z", r"\Z").replace("(?<", "(?P<"))
    except re.error as e:
        raise BadPattern(f"{pattern!r}: {e}") from e
    return "(?d)" + joined


def python_regex(pattern: str) -> re.Pattern[str]:
    """The same pattern for the Python twin."""
    java = java_regex(pattern)[4:]
    return re.compile(java.replace(r"\z", r"\Z").replace("(?<", "(?P<"))


def regex_column(value: Column, pattern: str) -> Column:
    return F.rlike(value, F.lit(java_regex(pattern)))
