"""Pointcut expressions: a parser of their language and their conditions over a table of methods.

    expression = term, joined by && (binding tighter) or ||
    term       = ( expression ) | name() of another pointcut | execution(...) | within(...) | @annotation(...)

The parser climbs precedences over tokens and gives a tree; `condition` turns a tree into one column.
What the language has but this doesn't (!, args, target and so on) raises Unsupported with a reason.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(?P<op>&&|\|\||!|\(|\))|(?P<word>@?[\w.$]+)|(?P<bad>\S))")
#: Binding strength of the operators and what joins their sides.
_BINDS = {"||": 1, "&&": 2}


class Unsupported(Exception):
    pass


@dataclass(frozen=True)
class Both:
    operator: str
    left: object
    right: object


@dataclass(frozen=True)
class Designator:
    kind: str
    argument: str


@dataclass(frozen=True)
class Reference:
    name: str


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str | None:
        m = _TOKEN.match(self.text, self.at)
        return m and m.group().strip()

    def next(self) -> str:
        m = _TOKEN.match(self.text, self.at)
        if not m:
            raise Unsupported("ends too early")
        self.at = m.end()
        return m.group().strip()

    def bracketed(self) -> str:
        """The text up to the bracket that closes the one just read."""
        start, depth = self.at, 1
        for m in re.compile(r"[()]").finditer(self.text, self.at):
            depth += 1 if m.group() == "(" else -1
            if not depth:
                self.at = m.end()
                return self.text[start : m.start()].strip()
        raise Unsupported("an open bracket")

    def expression(self, least: int = 1) -> object:
        left = self.term()
        while (binds := _BINDS.get(self.peek() or "", 0)) >= least:
            operator = self.next()
            left = Both(operator, left, self.expression(binds + 1))
        return left

    def term(self) -> object:
        token = self.next()
        if token == "(":
            inner = self.expression()
            if self.next() != ")":
                raise Unsupported("a bracket that isn't closed")
            return inner
        if not re.fullmatch(r"@?[\w.$]+", token):
            raise Unsupported(f"{token} isn't supported")
        if self.peek() != "(":
            raise Unsupported(f"{token} without brackets")
        self.next()
        argument = self.bracketed()
        return Designator(token, argument) if argument else Reference(token.rsplit(".", 1)[-1])


def parsed(text: str) -> object:
    """The tree of an expression; raises Unsupported."""
    reader = _Reader(text)
    tree = reader.expression()
    if reader.peek():
        raise Unsupported(f"{reader.peek()} behind the end")
    return tree


def name_regex(pattern: str) -> str:
    """A pattern of dotted names as a regular expression: * within a part, .. any parts between."""
    parts = [[re.sub(r"\\\*", r"[\\w$]*", re.escape(p.rstrip("+"))) for p in run.split(".") if p] for run in pattern.split("..")]
    return r"\.(?:[\w$]+\.)*".join(r"\.".join(run) for run in parts)


def _of_designator(d: Designator) -> Column:
    if d.kind == "execution":
        head = d.argument.partition("(")[0].split()
        name = name_regex(head[-1] if head else "*")
        free = not head or "." not in head[-1]  # a bare name is one in any type
        return F.col("qn").rlike(rf"(?:^|\.){name}$" if free else f"^{name}$")
    if d.kind == "within":
        return F.coalesce(F.col("owner").rlike(f"^{name_regex(d.argument)}$"), F.lit(False))
    if d.kind == "@annotation":
        simple = d.argument.rsplit(".", 1)[-1]
        return F.exists("annotations", lambda a: (a == d.argument) | a.endswith("." + simple) | (a == simple))
    raise Unsupported(f"{d.kind}() isn't supported")


def condition(tree: object, named: dict[str, str], within: tuple[str, ...] = ()) -> Column:
    """A column over methods: qn (without parameters), owner, annotations (full names). named: the
    expressions of pointcuts by name; one that leads back to itself is unsupported."""
    if isinstance(tree, Both):
        left, right = condition(tree.left, named, within), condition(tree.right, named, within)
        return left & right if tree.operator == "&&" else left | right
    if isinstance(tree, Reference):
        if tree.name not in named or tree.name in within:
            raise Unsupported(f"{tree.name}() is no pointcut" if tree.name not in named else f"{tree.name}() leads back to itself")
        return condition(parsed(named[tree.name]), named, (*within, tree.name))
    return _of_designator(tree)


def any_of(conditions: list[tuple[str, Column]]) -> Column:
    """The names of the conditions that hold, as an array."""
    each = [F.when(c, F.array(F.lit(n))).otherwise(F.array().cast("array<string>")) for n, c in conditions]
    return reduce(F.concat, each)
