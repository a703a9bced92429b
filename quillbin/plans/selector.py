"""The tag-selector language: text -> tokens -> postfix program -> one boolean Column over a metric's own tags.

Comparisons (`=` `==` `!=` `=~` `!~` `=*` `!*`) join with `&` `,` `|`; selections in braces join with `|` `&` `^` `%`; all operators of a kind have
the same precedence, left to right, and parentheses group. A selection also demands every key that it lists or mentions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillbin.functions import patterns

MAX_BYTES = 1 << 15
SPECIAL = frozenset(" \t&|=!{}()%^,\\\"'")
_PAIRS = ("&&", "||", "==", "!=", "=~", "!~", "=*", "!*")
_SINGLES = "()=&|{}%^,"
_COMPARE = {"=": "eq", "==": "eq", "!=": "neq", "=~": "re", "!~": "nre", "=*": "glob", "!*": "nglob"}
_JOIN_COMPARISONS = {"|": "union", "&": "inter", ",": "inter"}
_JOIN_SELECTIONS = {"|": "union", "&": "inter", "^": "symdiff", "%": "modulo"}


class SelectorError(ValueError):
    """The text is not a selector."""


@dataclass(frozen=True)
class Token:
    kind: str  # "op", "word" or "quoted"
    text: str


def tokenize(text: str) -> list[Token]:
    if len(text.encode()) > MAX_BYTES:
        raise SelectorError("selector too long")
    out, i, n = [], 0, len(text)

    def past_escape(at: int) -> int:
        if at + 1 >= n or text[at + 1] not in SPECIAL:
            raise SelectorError(f"bad escape at {at}")
        return at + 2

    while i < n:
        c = text[i]
        if c in " \t":
            i += 1
        elif c in "\"'":
            end = i + 1
            while end < n and text[end] != c:
                end = past_escape(end) if text[end] == "\\" else end + 1
            if end >= n:
                raise SelectorError("open quote")
            out.append(Token("quoted", text[i + 1 : end]))
            i = end + 1
        elif text[i : i + 2] in _PAIRS:
            out.append(Token("op", text[i : i + 2]))
            i += 2
        elif c in _SINGLES:
            out.append(Token("op", c))
            i += 1
        else:
            end = i
            while end < n and (text[end] == "\\" or text[end] not in SPECIAL):
                end = past_escape(end) if text[end] == "\\" else end + 1
            if end == i:
                raise SelectorError(f"unexpected {c!r}")
            out.append(Token("word", text[i:end]))
            i = end
    return out


@dataclass(frozen=True)
class Step:
    """One instruction: a comparison (key, value), `tags` (keys) or a set operation."""

    op: str
    key: str = ""
    value: str = ""
    keys: tuple[str, ...] = ()

    def __str__(self) -> str:
        if self.op == "tags":
            return f"(tags {','.join(self.keys)})"
        return f"({self.op} {self.key} {self.value})" if self.key or self.value else self.op


@dataclass
class _Reader:
    """Productions return False where they do not fit; the caller goes back to where it was."""

    tokens: list[Token]
    at: int = 0
    steps: list[Step] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)
    locked: bool = False

    def op(self) -> str:
        return self.tokens[self.at].text if self.at < len(self.tokens) and self.tokens[self.at].kind == "op" else ""

    def take(self, op: str) -> bool:
        fits = self.op() == op
        self.at += fits
        return fits

    def key(self) -> str:
        """The key at hand, which from now on the selection demands ('' if there is none, or the list is closed to it)."""
        t = self.tokens[self.at] if self.at < len(self.tokens) else Token("op", "")
        if t.kind != "word" or not t.text or (self.locked and t.text not in self.keys):
            return ""
        if t.text not in self.keys:
            self.keys.append(t.text)
        return t.text

    def joined(self, part: Callable[[], bool], joins: dict[str, str]) -> bool:
        if not part():
            return False
        while name := joins.get(self.op(), ""):
            self.at += 1
            back = self.at
            if not part():
                self.at = back  # an operator with nothing behind it is let pass
                return True
            self.steps.append(Step(name))
        return True

    def selections(self) -> bool:
        return self.joined(self.selection, _JOIN_SELECTIONS)

    def comparisons(self) -> bool:
        return self.joined(self.comparison, _JOIN_COMPARISONS)

    def selection(self) -> bool:
        if self.op() == "(":
            return self.take("(") and self.selections() and self.take(")")
        if not self.take("{"):
            return False
        bare = self.take("}")
        if not bare:
            back = self.at
            if not (self.comparisons() and self.take("}")):
                self.at = back
                while self.key():
                    self.at += 1
                    if not self.take(","):
                        break
                if not self.take("|"):
                    return False
                self.locked = True
                bare = self.take("}")
                if not bare and not (self.comparisons() and self.take("}")):
                    return False
        self.locked = False
        self.steps.append(Step("tags", keys=tuple(self.keys)))
        self.keys = []
        if not bare:
            self.steps.append(Step("inter"))
        return True

    def comparison(self) -> bool:
        if self.op() == "(":
            return self.take("(") and self.comparisons() and self.take(")")
        key = self.key()
        if not key:
            return False
        self.at += 1
        op = _COMPARE.get(self.op(), "")
        if not op:
            return False
        self.at += 1
        value = self.tokens[self.at] if self.at < len(self.tokens) else Token("op", "")
        self.at += 1
        if value.kind == "op" or not value.text:
            return False
        try:
            if op in ("re", "nre"):
                patterns.java_regex(value.text)
            elif op in ("glob", "nglob"):
                patterns.glob_regex(value.text)
        except patterns.BadPattern:
            return False
        self.steps.append(Step(op, key, value.text))
        return True


def _value_test(step: Step) -> Callable[[Column], Column]:
    """Whether a tag has the step's key and a value that fits the step's pattern, or does not."""
    match = patterns.regex_column if step.op in ("re", "nre") else patterns.glob_column

    def test(tag: Column) -> Column:
        fits = match(tag["v"], step.value)
        return (tag["k"] == step.key) & (~fits if step.op[0] == "n" else fits)

    return test


@dataclass(frozen=True)
class Selector:
    text: str
    steps: tuple[Step, ...]

    def __str__(self) -> str:
        return " ".join(map(str, self.steps))

    def column(self, tags: str | Column = "tags", known: Callable[[str], Column] | None = None) -> Column:
        """The selection as a predicate on a metric's tags.

        known: for the compatible reading of `!=`, which selects nothing where the tag is unknown: a tag's text -> whether its segment knows it."""
        col = F.col(tags) if isinstance(tags, str) else tags
        has_key = lambda k: F.array_contains(col["k"], k)
        has_tag = lambda t: F.array_contains(col["tag"], t)
        stack: list[Column] = []
        for s in self.steps:
            if s.op == "tags":
                out = F.lit(True)
                for k in s.keys or ("",):
                    out = out & has_key(k)
                stack.append(out)
            elif s.op in ("union", "inter", "symdiff", "modulo"):
                b, a = stack.pop(), stack.pop()
                stack.append({"union": a | b, "inter": a & b, "symdiff": a != b, "modulo": a & ~b}[s.op])
            elif s.op == "eq":
                stack.append(has_tag(f"{s.key}={s.value}"))
            elif s.op == "neq":
                tag = f"{s.key}={s.value}"
                out = has_key(s.key) & ~has_tag(tag)
                stack.append(out & known(tag) if known else out)
            else:
                stack.append(F.exists(col, _value_test(s)))
        return stack.pop()

    def unequal_tags(self) -> list[str]:
        """Tags that `!=` compares with."""
        return [f"{s.key}={s.value}" for s in self.steps if s.op == "neq"]

    def matches(self, tags: dict[str, tuple[str, str]]) -> bool:
        """The Python twin of column(): tags as tag text -> (key, value)."""
        keys, stack = {k for k, _ in tags.values()}, []
        for s in self.steps:
            if s.op == "tags":
                stack.append(all(k in keys for k in s.keys or ("",)))
            elif s.op in ("union", "inter", "symdiff", "modulo"):
                b, a = stack.pop(), stack.pop()
                stack.append({"union": a or b, "inter": a and b, "symdiff": a != b, "modulo": a and not b}[s.op])
            elif s.op in ("eq", "neq"):
                has = f"{s.key}={s.value}" in tags
                stack.append(has if s.op == "eq" else s.key in keys and not has)
            else:
                test = patterns.python_regex(s.value).search if s.op in ("re", "nre") else lambda v, p=s.value: patterns.glob_match(p, v)
                stack.append(any(k == s.key and bool(test(v)) != (s.op[0] == "n") for k, v in tags.values()))
        return stack.pop()


def parse(text: str) -> Selector:
    """The selector of a text; a text without braces stands in braces."""
    tokens = tokenize(text)
    if not any(t.kind == "op" and t.text in "{}" for t in tokens):
        tokens = [Token("op", "{"), *tokens, Token("op", "}")]
    reader = _Reader(tokens)
    if not reader.selections() or reader.at != len(tokens):
        raise SelectorError(f"not a selector: {text!r}")
    return Selector(text, tuple(reader.steps))
