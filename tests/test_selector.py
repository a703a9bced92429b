import random
import re
from pathlib import Path

import pytest

from quillbin.functions import patterns as P
from quillbin.functions import tags as T
from quillbin.operators import index as I
from quillbin.plans.selector import SelectorError, parse, tokenize


def matrix():
    text = Path(__file__).resolve().parent.parent.joinpath("FIXTURES.md").read_text()
    for line in text.split("### A7b")[1].split("### A8")[0].splitlines():
        if line.startswith("| ") and not line.startswith("| query"):
            query, want = (x.replace("\0", "|") for x in line.replace("\\|", "\0").strip("| ").split(" | "))
            yield "" if query == "(empty)" else query.strip("`"), want.strip("` ")


@pytest.mark.parametrize("query,want", list(matrix()))
def test_programs(query, want):
    if "reject" in want:
        with pytest.raises(SelectorError):
            parse(query)
    else:
        assert str(parse(query)) == want


def test_tokens():
    words = lambda q: [t.text for t in tokenize(q)]
    assert words("{foo, bar | foo == bar}") == ["{", "foo", ",", "bar", "|", "foo", "==", "bar", "}"]
    assert words(r"{foo\} | 2 == foo\}}") == ["{", r"foo\}", "|", "2", "==", r"foo\}", "}"]
    assert words("'foo\"'") == ['foo"'] and words(r'"foo\""') == [r"foo\""] and words(r"'foo\\'") == [r"foo\\"]
    assert words('  foo="foo"  ') == ["foo", "=", "foo"]
    for bad in ("'open", r"'x\d'", "a!x", "\\", "x" * 40_000):
        with pytest.raises(SelectorError):
            tokenize(bad)


@pytest.mark.parametrize("pattern,text,want", [(r"12X\*", "12Xa", False), (r"12X\*", "12X*", True), ("^12X", "12Xyab", True), ("^12X", "a12Xyab", False), ("^", "foo", True), ("$", "foo", True), ("^?$", "é", False), ("^??$", "é", True), ("a.b", "axb", False), ("^a.*b$", "a.xb", True)])
def test_globs(spark, pattern, text, want):
    assert P.glob_match(pattern, text) is want
    row = spark.createDataFrame([(text,)], "v string")
    assert row.select(P.glob_column(row["v"], pattern)).first()[0] is want


def test_glob_escapes():
    for bad in (r"a*\x", r"*a\$", "a*\\"):
        with pytest.raises(P.BadPattern):
            P.glob_regex(bad)


@pytest.mark.parametrize("pattern,value,want", [("a$", "a\n", False), ("^a.c$", "a\rc", True), ("^a.c$", "a\nc", False), ("(?P<x>b)+", "abb", True), ("[[:digit:]]+", "x7", True), ("[]a]", "]", True), ("(?i)AB", "xab", True), (r"\bfoo\b", "a foo", True)])
def test_regexes(spark, pattern, value, want):
    row = spark.createDataFrame([(value,)], "v string")
    assert row.select(P.regex_column(row["v"], pattern)).first()[0] is want


@pytest.mark.parametrize("pattern", ["(?=a)", "(?<!a)b", r"(a)\1", "a++", "(", "[a", "(?>a)", "*"])
def test_foreign_regexes(pattern):
    with pytest.raises(P.BadPattern):
        P.java_regex(pattern)


METRICS = ["foo=bar,bif=bar", "foo=a,bif=a", "foo=b,bif=c", "foo=bar,foo=baz", "foo=bar", "foo=baz", "foo", "bif=1", "=x", "k=a=b,foo=1"]


def test_random_selectors_agree_with_sets(spark):
    """Random selectors: the Column, the Python twin, and sets of names built by hand from the same operators."""
    rng = random.Random(4)
    dims = I.dimension(spark.createDataFrame([(m,) for m in METRICS], "metric string")).cache()
    known = {T.name_of(m): T.tag_set(m) for m in METRICS}

    def comparison(depth=0):
        if depth < 2 and rng.random() < 0.3:
            return f"({comparison(depth + 1)} {rng.choice('&|,')} {comparison(depth + 1)})"
        op = rng.choice(["=", "!=", "=~", "!~", "=*", "!*", "=="])
        value = rng.choice(["bar", "baz", "a", "1"]) if op in ("=", "!=", "==") else rng.choice(["'^b'", "'[az]$'", "a", "'^$'"])
        return f"{rng.choice(['foo', 'bif', 'k'])} {op} {value}"

    def selection(depth=0):
        if depth < 2 and rng.random() < 0.4:
            return f"({selection(depth + 1)} {rng.choice('|&^%')} {selection(depth + 1)})"
        return "{" + f"{comparison()} {rng.choice('&|')} {comparison()}" + "}"

    for _ in range(40):
        chosen = parse(selection())
        got = {r.name for r in dims.filter(chosen.column()).select("name").collect()}
        assert got == {n for n, t in known.items() if chosen.matches(t)}, str(chosen)


def test_not_equal_against_not_matching(spark):
    dims = I.dimension(spark.createDataFrame([(m,) for m in METRICS], "metric string"))
    names = lambda q: {r.name for r in I.select(dims, q).select("name").collect()}
    assert "bar" not in str(names("foo != bar")) and "foo=bar,foo=baz" in names("foo !~ '^bar$'")
    assert names("{}") == {"=x"}
    assert names("{foo=bar | nowhere=1}") == set()


def test_never_crashes():
    rng = random.Random(9)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "b", "=", "!", "~", "*", "&", "|", "{", "}", "(", ")", "^", "%", ",", " ", "'", '"', "\\", "1"]) for _ in range(rng.randint(0, 14)))
        try:
            found = parse(text)
        except SelectorError:
            continue
        found.matches({})
        assert re.search("tags", str(found))
