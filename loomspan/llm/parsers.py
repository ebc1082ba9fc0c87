"""Recursive-descent parsers with precedence climbing and panic-mode recovery (problem 6): the base,
Python, XML and YAML; Java, JavaScript and SQL are in curly.py and sql_parser.py.

A parser goes on behind an error: the statement is given up, tokens are skipped to where a statement
can start, and all errors are kept in order; the first one is the cause.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from typing import NamedTuple

from loomspan.sources import lexers
from loomspan.sources.lexers import Token


class Fault(NamedTuple):
    line: int
    message: str


class Reject(Exception):
    def __init__(self, message: str, at: int):
        super().__init__(message)
        self.message, self.at = message, at


MAX_DEPTH = 20_000  # nesting that is followed, as a guard of memory; deeper is an error


class Parser:
    """Tokens with one place; errors are collected as (place, message)."""

    max_depth = MAX_DEPTH

    def __init__(self, text: str, tokens: list[Token], base: int = 0):
        self.text, self.base = text, base
        self.errors: list[tuple[int, str]] = [(t.at, t.text) for t in tokens if t.kind == "err"]
        self.tokens = [t for t in tokens if t.kind not in ("com", "err")]
        self.i, self.depth = 0, 0

    @property
    def t(self) -> Token:
        return self.tokens[self.i]

    def ahead(self, k: int = 1) -> Token:
        return self.tokens[min(self.i + k, len(self.tokens) - 1)]

    def fail(self, message: str | None = None, at: int | None = None) -> Reject:
        t = self.t
        return Reject(message or f"unexpected {t.text or t.kind!r}", t.at if at is None else at)

    def next(self) -> Token:
        t = self.tokens[self.i]
        if t.kind != "end":
            self.i += 1
        return t

    def at(self, *texts: str) -> bool:
        t = self.tokens[self.i]
        return t.text in texts and t.kind in ("op", "id")

    def take(self, *texts: str) -> bool:
        if self.at(*texts):
            self.next()
            return True
        return False

    def need(self, text: str) -> Token:
        if not self.at(text):
            raise self.fail(f"expected {text!r}, found {self.t.text or self.t.kind!r}")
        return self.next()

    def need_kind(self, kind: str) -> Token:
        if self.t.kind != kind:
            raise self.fail(f"expected {kind}, found {self.t.text or self.t.kind!r}")
        return self.next()

    def try_(self, rule: Callable) -> bool:
        """Follows rule if it fits, else stays; for what can't be told apart by the next token."""
        start, depth = self.i, self.depth
        try:
            rule()
            return True
        except Reject:
            self.i, self.depth = start, depth
            return False

    def deeper(self) -> None:
        self.depth += 1
        if self.depth > self.max_depth:
            raise self.fail("nested too deeply")

    def recover(self, rule: Callable, sync: Callable) -> None:
        """rule, or in case of an error: keep it, skip to where sync() says, and go on."""
        start, depth = self.i, self.depth
        try:
            rule()
        except Reject as e:
            self.errors.append((e.at, e.message))
            self.depth = depth
            sync()
            if self.i == start:
                self.next()

    def faults(self) -> list[Fault]:
        return [Fault(lexers.line_of(self.text, at), m) for at, m in sorted(set(self.errors))]


# The keywords of Python 3.13 and its binary operators by precedence.
_PY_KEYWORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
)
_PY_BINARY = {"|": 1, "^": 2, "&": 3, "<<": 4, ">>": 4, "+": 5, "-": 5, "*": 6, "@": 6, "/": 6, "//": 6, "%": 6}
_PY_COMPARE = ("<", ">", "<=", ">=", "==", "!=")
_PY_AUGMENTED = ("+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**=")


_PREFIX = re.compile("[A-Za-z]*")
_ESCAPE = re.compile(r"\\(?:(?P<x>x(?![0-9a-fA-F]{2}))|(?P<u>u(?![0-9a-fA-F]{4})|U(?![0-9a-fA-F]{8}))|U(?P<code>[0-9a-fA-F]{8})|N\{(?P<name>[^{}]*)\}|(?P<n>N)|[\s\S])")


def _bad_literal(text: str) -> str | None:
    """What is wrong within a literal of Python that opens and closes rightly."""
    kind = _PREFIX.match(text).group().lower()
    if "b" in kind and not text.isascii():
        return "bytes can only contain ASCII characters"
    if "r" in kind or "f" in kind or "\\" not in text:
        return None
    for m in _ESCAPE.finditer(text):
        if m.group("x"):
            return "truncated \\x escape"
        if "b" in kind:
            continue
        if m.group("u") or m.group("n"):
            return "truncated escape"
        if m.group("code") and int(m.group("code"), 16) > 0x10FFFF:
            return "no such character"
        if m.group("name") is not None:
            try:
                unicodedata.lookup(m.group("name"))
            except KeyError:
                return "unknown character name"
    return None


class PythonParser(Parser):
    """Python 3.13. Expressions return what they are, as far as assignments need to know: name, attr,
    item, tuple, list, star, paren (a target in parentheses), lit, call, gen, other."""

    def __init__(self, text: str, tokens: list[Token] | None = None, base: int = 0):
        super().__init__(text, tokens if tokens is not None else lexers.python(text), base)
        self.errors += [(t.at, why) for t in self.tokens if t.kind == "str" and (why := _bad_literal(t.text))]
        self.errors += [(t.at, "a digit that isn't ASCII") for t in self.tokens if t.kind == "num" and not t.text.isascii()]

    # statements
    def module(self) -> None:
        if "\0" in self.text:
            self.errors.append((self.text.index("\0"), "null byte in source"))
        while self.t.kind != "end":
            if self.t.kind == "indent":
                self.errors.append((self.t.at, "unexpected indent"))
                self.next()
            elif self.t.kind in ("dedent", "nl"):
                self.next()
            else:
                self.recover(self.statement, self.sync)

    def sync(self) -> None:
        while self.t.kind not in ("nl", "end"):
            self.next()
        if self.t.kind == "nl":
            self.next()
        if self.t.kind == "indent":  # the block of a broken head is parsed as statements of its own
            self.next()
            self.block_body()

    def block_body(self) -> None:
        while self.t.kind not in ("dedent", "end"):
            if self.t.kind == "indent":
                self.errors.append((self.t.at, "unexpected indent"))
                self.next()
                self.block_body()
            else:
                self.recover(self.statement, self.sync)
        if self.t.kind == "dedent":
            self.next()

    def suite(self) -> None:
        self.need(":")
        if self.t.kind == "nl":
            self.next()
            if self.t.kind != "indent":
                raise self.fail("expected an indented block")
            self.next()
            self.deeper()
            self.block_body()
            self.depth -= 1
        else:
            self.simple_line()

    def simple_line(self) -> None:
        self.simple()
        while self.take(";"):
            if self.t.kind in ("nl", "end"):
                break
            self.simple()
        if self.t.kind != "nl":
            raise self.fail("invalid syntax: " + (self.t.text or self.t.kind))
        self.next()

    def statement(self) -> None:
        t = self.t
        if t.kind == "id":
            rule = getattr(self, "s_" + t.text, None) if t.text in _COMPOUND else None
            if rule:
                rule()
                return
            if t.text == "match" and self.try_match():
                return
        elif t.text == "@":
            while self.take("@"):
                self.named_expr()
                self.need_kind("nl")
            if not self.at("def", "class", "async"):
                raise self.fail("expected a definition after a decorator")
            self.statement()
            return
        self.simple_line()

    def s_if(self) -> None:
        self.next()
        self.named_expr()
        self.suite()
        while self.at("elif"):
            self.next()
            self.named_expr()
            self.suite()
        if self.take("else"):
            self.suite()

    def s_while(self) -> None:
        self.next()
        self.named_expr()
        self.suite()
        if self.take("else"):
            self.suite()

    def s_for(self) -> None:
        self.next()
        self.targets("in")
        self.need("in")
        self.star_exprs()
        self.suite()
        if self.take("else"):
            self.suite()

    def targets(self, stop: str) -> None:
        at, kind = self.t.at, self.target_list(stop)
        self.check_target(kind, at)

    def target_list(self, stop: str) -> str:
        kind, many = self.target_item(), False
        while self.take(","):
            many = True
            if self.at(stop) or self.at("="):
                break
            self.target_item()
        return "tuple" if many else kind

    def target_item(self) -> str:
        at = self.t.at
        if self.take("*"):
            kind = self.binary(1)
        else:
            kind = self.binary(1)
        self.check_target(kind, at)
        return kind

    def s_try(self) -> None:
        self.next()
        self.suite()
        handlers, bare, stars = 0, False, set()
        while self.at("except"):
            self.next()
            if bare:
                raise self.fail("default 'except:' must be last")
            handlers += 1
            star = self.take("*")
            stars.add(star)
            if self.at(":"):
                if star:
                    raise self.fail("expected one or more exception types")
                bare = True
            else:
                self.expr()
                if self.at(","):
                    raise self.fail("multiple exception types must be parenthesized")
                if self.take("as"):
                    self.name()
            self.suite()
        if len(stars) > 1:
            raise self.fail("cannot have both 'except' and 'except*'")
        if handlers and self.take("else"):
            self.suite()
        if self.take("finally"):
            self.suite()
        elif not handlers:
            raise self.fail("expected 'except' or 'finally' block")

    def s_with(self) -> None:
        self.next()

        def bracketed() -> None:
            self.need("(")
            while True:
                self.with_item()
                if not self.take(",") or self.at(")"):
                    break
            self.need(")")
            if not self.at(":"):
                raise self.fail()

        if not (self.at("(") and self.try_(bracketed)):
            while True:
                self.with_item()
                if not self.take(","):
                    break
        self.suite()

    def with_item(self) -> None:
        self.expr()
        if self.take("as"):
            at = self.t.at
            kind = self.star_target()
            self.check_target(kind, at)

    def star_target(self) -> str:
        return self.binary(1)

    def s_def(self) -> None:
        self.next()
        self.name()
        self.type_params()
        self.need("(")
        self.parameters(")", True)
        self.need(")")
        if self.take("->"):
            self.expr()
        self.suite()

    def s_class(self) -> None:
        self.next()
        self.name()
        self.type_params()
        if self.take("("):
            self.arguments(bases=True)
        self.suite()

    def s_async(self) -> None:
        self.next()
        if not self.at("def", "for", "with"):
            raise self.fail()
        self.statement()

    def type_params(self) -> None:
        if self.take("["):
            while True:
                star = self.take("*") or self.take("**")
                self.name()
                if not star and self.take(":"):
                    self.expr()
                if self.take("="):
                    self.star_expr()
                if not self.take(",") or self.at("]"):
                    break
            self.need("]")

    def parameters(self, stop: str, annotated: bool) -> None:
        defaults = star = slash = first = False
        while not self.at(stop):
            if self.take("/"):
                if slash or star or not first:
                    raise self.fail("misplaced '/'")
                slash = True
            elif self.take("**"):
                self.name()
                if annotated and self.take(":"):
                    self.expr()
                self.take(",")
                if not self.at(stop):
                    raise self.fail("arguments cannot follow var-keyword argument")
                return
            elif self.take("*"):
                if star:
                    raise self.fail("* argument may appear only once")
                star = True
                if self.at(","):
                    self.next()
                    if self.at(stop) or self.at("**"):
                        raise self.fail("named arguments must follow bare *")
                    continue
                self.name()
                if annotated and self.take(":"):
                    self.star_expr()
            else:
                self.name()
                first = True
                if annotated and self.take(":"):
                    self.expr()
                if self.take("="):
                    self.expr()
                    defaults = True
                elif defaults and not star:
                    raise self.fail("parameter without a default follows parameter with a default")
            first = True
            if not self.take(","):
                break
            if self.at(","):
                raise self.fail()

    def name(self) -> str:
        t = self.t
        if t.kind != "id" or t.text in _PY_KEYWORDS:
            raise self.fail(f"expected a name, found {t.text or t.kind!r}")
        return self.next().text

    def try_match(self) -> bool:
        def head() -> None:
            self.next()
            self.star_exprs(named=True)
            self.need(":")
            self.need_kind("nl")
            self.need_kind("indent")
            if not self.at("case"):
                raise self.fail()

        if not self.try_(head):
            return False
        while self.t.kind not in ("dedent", "end"):
            self.recover(self.case, self.sync)
        if self.t.kind == "dedent":
            self.next()
        return True

    def case(self) -> None:
        self.need("case")
        self.patterns()
        if self.take("if"):
            self.named_expr()
        self.suite()

    def patterns(self) -> None:
        self.pattern(True)
        while self.take(","):
            if self.at(":", "if"):
                break
            self.pattern(True)

    def pattern(self, star: bool = False) -> None:
        if star and self.take("*"):
            self.name()
            return
        self.deeper()
        while True:
            self.closed_pattern()
            if not self.take("|"):
                break
        if self.take("as"):
            self.name()
        self.depth -= 1

    def closed_pattern(self) -> None:
        t = self.t
        if t.text in ("(", "[") and t.kind == "op":
            close = {"(": ")", "[": "]"}[self.next().text]
            while not self.at(close):
                self.pattern(True)
                if not self.take(","):
                    break
            self.need(close)
        elif t.text == "{":
            self.next()
            while not self.at("}"):
                if self.take("**"):
                    self.name()
                else:
                    if self.t.kind in ("num", "str") or self.at("-", "None", "True", "False"):
                        self.literal_pattern()
                    else:
                        self.name()
                        self.need(".")
                        self.name()
                        while self.take("."):
                            self.name()
                    self.need(":")
                    self.pattern()
                if not self.take(","):
                    break
            self.need("}")
        elif t.kind in ("num", "str") or t.text in ("-", "None", "True", "False"):
            self.literal_pattern()
        else:
            self.name()
            while self.take("."):
                self.name()
            if self.take("("):
                while not self.at(")"):
                    if self.t.kind == "id" and self.ahead().text == "=":
                        self.next()
                        self.next()
                    self.pattern()
                    if not self.take(","):
                        break
                self.need(")")

    def literal_pattern(self) -> None:
        if self.take("None", "True", "False"):
            return
        if self.t.kind == "str":
            while self.t.kind == "str":
                self.next()
            return
        self.take("-")
        self.need_kind("num")
        if self.take("+", "-"):
            self.need_kind("num")

    # simple statements
    def simple(self) -> None:
        t = self.t
        if t.kind == "id":
            if t.text in ("pass", "break", "continue"):
                self.next()
                return
            if t.text == "return":
                self.next()
                if self.t.kind != "nl" and not self.at(";"):
                    self.star_exprs()
                return
            if t.text == "raise":
                self.next()
                if self.t.kind != "nl" and not self.at(";"):
                    self.expr()
                    if self.take("from"):
                        self.expr()
                return
            if t.text in ("global", "nonlocal"):
                self.next()
                self.name()
                while self.take(","):
                    self.name()
                return
            if t.text == "del":
                self.next()
                at = self.t.at
                kind = self.star_exprs()
                self.check_target(kind, at, delete=True)
                return
            if t.text == "assert":
                self.next()
                self.expr()
                if self.take(","):
                    self.expr()
                return
            if t.text == "import":
                self.next()
                while True:
                    self.dotted()
                    if self.take("as"):
                        self.name()
                    if not self.take(","):
                        return
            if t.text == "from":
                self.import_from()
                return
            if t.text == "type" and self.ahead().kind == "id" and self.ahead().text not in _PY_KEYWORDS and self.ahead(2).text in ("=", "["):
                self.next()
                self.name()
                self.type_params()
                self.need("=")
                self.expr()
                return
        self.assignment()

    def dotted(self) -> None:
        self.name()
        while self.take("."):
            self.name()

    def import_from(self) -> None:
        self.next()
        dots = False
        while self.take(".", "..."):
            dots = True
        if not self.at("import") or not dots:
            self.dotted()
        self.need("import")
        if self.take("*"):
            return
        bracket = self.take("(")
        while True:
            self.name()
            if self.take("as"):
                self.name()
            if not self.take(","):
                break
            if bracket and self.at(")"):
                break
        if bracket:
            self.need(")")

    def assignment(self) -> None:
        at = self.t.at
        kind = self.yield_or_stars()
        if self.at("="):
            while self.take("="):
                self.check_target(kind, at)
                at = self.t.at
                kind = self.yield_or_stars()
        elif self.at(":"):
            if kind not in ("name", "attr", "item", "paren_name", "paren_attr", "paren_item"):
                raise self.fail("illegal target for annotation", at)
            self.next()
            self.expr()
            if self.take("="):
                self.yield_or_stars()
        elif self.t.text in _PY_AUGMENTED and self.t.kind == "op":
            if kind not in ("name", "attr", "item", "paren_name", "paren_attr", "paren_item"):
                raise self.fail("illegal target for augmented assignment", at)
            self.next()
            self.yield_or_stars()

    def check_target(self, kind: str, at: int, delete: bool = False) -> None:
        kind = kind.removeprefix("paren_")
        if kind not in ("name", "attr", "item", "tuple", "list") and not (kind == "star" and not delete):
            raise self.fail(f"cannot {'delete' if delete else 'assign to'} {kind}", at)

    def yield_or_stars(self) -> str:
        return self.yield_expr() if self.at("yield") else self.star_exprs()

    def yield_expr(self) -> str:
        self.need("yield")
        if self.take("from"):
            self.expr()
        elif self.t.kind != "nl" and not self.at(")", "=", ";", "]", "}", ":") and self.t.kind != "end":
            self.star_exprs()
        return "yield"

    # expressions
    def star_exprs(self, named: bool = False) -> str:
        kind = self.star_expr(named)
        if self.at(","):
            ok = kind in ("name", "attr", "item", "tuple", "list", "star") or kind.startswith("paren_")
            while self.take(","):
                if self.t.kind in ("nl", "end") or self.at("=", ")", "]", "}", ":", ";"):
                    break
                k = self.star_expr(named)
                ok = ok and (k in ("name", "attr", "item", "tuple", "list", "star") or k.startswith("paren_"))
            return "tuple" if ok else "display"
        return kind

    def star_expr(self, named: bool = False) -> str:
        if self.take("*"):
            kind = self.binary(1).removeprefix("paren_")
            return "star" if kind in ("name", "attr", "item", "tuple", "list") else "starred"
        return self.named_expr() if named else self.expr()

    def named_expr(self) -> str:
        if self.t.kind == "id" and self.ahead().text == ":=":
            self.name()
            self.next()
            self.expr()
            return "walrus"
        return self.expr()

    def expr(self) -> str:
        self.deeper()
        if self.at("lambda"):
            self.next()
            self.parameters(":", False)
            self.need(":")
            self.expr()
            kind = "lambda"
        else:
            kind = self.disjunction()
            if self.at("if"):
                self.next()
                self.disjunction()
                self.need("else")
                self.expr()
                kind = "conditional"
        self.depth -= 1
        return kind

    def disjunction(self) -> str:
        kind = self.inversion()
        while self.take("and", "or"):
            self.inversion()
            kind = "operation"
        return kind

    def inversion(self) -> str:
        if self.take("not"):
            self.deeper()
            self.inversion()
            self.depth -= 1
            return "operation"
        kind = self.binary(1)
        while True:
            if self.t.kind == "op" and self.t.text in _PY_COMPARE:
                self.next()
            elif self.at("in"):
                self.next()
            elif self.at("not") and self.ahead().text == "in":
                self.next()
                self.next()
            elif self.at("is"):
                self.next()
                self.take("not")
            else:
                return kind
            self.binary(1)
            kind = "comparison"

    def binary(self, least: int) -> str:
        """Precedence climbing over the binary operators."""
        self.deeper()
        kind = self.unary()
        while self.t.kind == "op" and _PY_BINARY.get(self.t.text, 0) >= least:
            self.binary(_PY_BINARY[self.next().text] + 1)
            kind = "operation"
        self.depth -= 1
        return kind

    def unary(self) -> str:
        if self.t.kind == "op" and self.t.text in ("+", "-", "~"):
            self.next()
            self.deeper()
            self.unary()
            self.depth -= 1
            return "operation"
        kind = self.primary()
        if self.take("**"):
            self.unary()
            kind = "operation"
        return kind

    def primary(self) -> str:
        waits = self.take("await")
        kind = self.atom()
        while self.t.kind == "op":
            if self.take("."):
                self.name()
                kind = "attr"
            elif self.take("("):
                self.arguments()
                kind = "call"
            elif self.take("["):
                self.subscript()
                kind = "item"
            else:
                break
        return "await" if waits else kind

    def arguments(self, bases: bool = False) -> None:
        keyword = unpacked = False
        n = 0
        while not self.at(")"):
            at = self.t.at
            if self.take("**"):
                self.expr()
                unpacked = True
            elif self.take("*"):
                self.expr()
                if unpacked:
                    raise self.fail("iterable unpacking follows keyword unpacking", at)
            elif self.t.kind == "id" and self.ahead().text == "=" and self.ahead().kind == "op":
                self.name()
                self.next()
                self.expr()
                keyword = True
            else:
                self.named_expr()
                if self.at("for", "async"):
                    if bases:
                        raise self.fail("a generator among base classes")
                    self.comprehension()
                    if n or (self.at(",") and self.ahead().text != ")"):
                        raise self.fail("generator expression must be parenthesized", at)
                elif keyword or unpacked:
                    raise self.fail("positional argument follows keyword argument", at)
            n += 1
            if not self.take(","):
                break
        self.need(")")

    def subscript(self) -> None:
        while True:
            if self.take("*"):
                self.binary(1)
            else:
                if not self.at(":"):
                    self.named_expr()
                for _ in range(2):
                    if self.take(":") and not self.at(":", "]", ","):
                        self.expr()
            if not self.take(",") or self.at("]"):
                break
        self.need("]")

    def comprehension(self) -> None:
        while self.at("for", "async"):
            self.take("async")
            self.need("for")
            self.targets("in")
            self.need("in")
            self.disjunction()
            while self.take("if"):
                if self.t.kind == "id" and self.ahead().text == ":=":
                    self.named_expr()
                else:
                    self.disjunction()

    def atom(self) -> str:
        t = self.t
        if t.kind == "id":
            if t.text in ("None", "True", "False"):
                self.next()
                return t.text
            self.name()
            return "name"
        if t.kind == "num":
            self.next()
            return "literal"
        if t.kind == "str":
            kinds = set()
            while self.t.kind == "str":
                s = self.next()
                kinds.add("b" in re.match(r"[A-Za-z]*", s.text).group().lower())
                for body, at in s.extra:
                    self.value_of_f_string(body, at)
            if len(kinds) > 1:
                raise self.fail("cannot mix bytes and nonbytes literals", t.at)
            return "literal"
        if t.text == "...":
            self.next()
            return "ellipsis"
        if t.text in ("(", "[", "{"):
            self.deeper()
            kind = {"(": self.paren, "[": self.listing, "{": self.braces}[self.next().text]()
            self.depth -= 1
            return kind
        raise self.fail("invalid syntax: " + (t.text or t.kind))

    def value_of_f_string(self, body: str, at: int) -> None:
        if not body.strip():
            raise self.fail("f-string: valid expression required", at)
        inner = PythonParser(body, lexers.python("(" + body + "\n)"))
        inner.depth = self.depth
        if inner.errors:
            raise self.fail("f-string: " + inner.errors[0][1], at)
        try:
            inner.need("(")
            inner.yield_or_stars() if not (inner.t.kind == "id" and inner.ahead().text == ":=") else inner.named_expr()
            inner.need(")")
        except Reject as e:
            raise self.fail("f-string: " + e.message, at) from None

    def paren(self) -> str:
        if self.take(")"):
            return "tuple"
        if self.at("yield"):
            self.yield_expr()
            self.need(")")
            return "yield"
        kind = self.star_expr(named=True)
        if self.at("for", "async"):
            self.comprehension()
            self.need(")")
            return "generator"
        if self.at(","):
            ok = kind in ("name", "attr", "item", "tuple", "list", "star") or kind.startswith("paren_")
            while self.take(","):
                if self.at(")"):
                    break
                k = self.star_expr(named=True)
                ok = ok and (k in ("name", "attr", "item", "tuple", "list", "star") or k.startswith("paren_"))
            self.need(")")
            return "tuple" if ok else "display"
        self.need(")")
        if kind in ("star", "starred"):
            raise self.fail("cannot use starred expression here")
        return "paren_" + kind if kind in ("name", "attr", "item", "tuple", "list") else kind

    def listing(self) -> str:
        ok, n = True, 0
        while not self.at("]"):
            kind = self.star_expr(named=True)
            ok = ok and (kind in ("name", "attr", "item", "tuple", "list", "star") or kind.startswith("paren_"))
            if n == 0 and self.at("for", "async"):
                self.comprehension()
                ok = False
                break
            n += 1
            if not self.take(","):
                break
        self.need("]")
        return "list" if ok else "display"

    def braces(self) -> str:
        n, dict_ = 0, None
        while not self.at("}"):
            if self.take("**"):
                self.binary(1)
                is_dict = True
            else:
                self.star_expr(named=True)
                is_dict = self.at(":")
                if is_dict:
                    self.next()
                    self.expr()
                if n == 0 and self.at("for", "async"):
                    self.comprehension()
                    break
            if dict_ is not None and is_dict != dict_:
                raise self.fail("':' expected after dictionary key")
            dict_ = is_dict
            n += 1
            if not self.take(","):
                break
        self.need("}")
        return "display"


_COMPOUND = frozenset("if while for try with def class async".split())


def parse_python(text: str) -> list[Fault]:
    p = PythonParser(text)
    p.module()
    return p.faults()


# XML

_XML_NAME = r"[:A-Z_a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02ff\u0370-\u037d\u037f-\u1fff\u200c\u200d\u2070-\u218f\u2c00-\u2fef\u3001-\ud7ff\uf900-\ufdcf\ufdf0-\ufffd\U00010000-\U000effff][\w:.\-\u00b7\u0300-\u036f\u203f\u2040]*"
_XML_BAD = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
_XML_TAG = re.compile(rf"<({_XML_NAME})")
_XML_ATTR = re.compile(rf"\s+({_XML_NAME})\s*=\s*(\"[^<\"]*\"|'[^<']*')")
_XML_REF = re.compile(rf"&(?:#\d+;|#x[0-9a-fA-F]+;|({_XML_NAME});)?")


class XmlParser:
    """Well-formed XML 1.0. Elements are descended into with a stack of names, as deep as the file goes."""

    def __init__(self, text: str):
        self.text, self.i, self.errors, self.known = text, 0, [], {"lt", "gt", "amp", "apos", "quot"}

    def error(self, message: str, at: int | None = None) -> None:
        self.errors.append((self.i if at is None else at, message))

    def references(self, piece: str, at: int) -> None:
        for m in _XML_REF.finditer(piece):
            if m.group() == "&":
                self.error("'&' that opens no reference", at + m.start())
            elif m.group(1) and m.group(1) not in self.known:
                self.error(f"unknown entity {m.group(1)!r}", at + m.start())
            elif m.group()[1:2] == "#":
                n = int(m.group()[3:-1], 16) if m.group()[2] == "x" else int(m.group()[2:-1])
                if n > 0x10FFFF or _XML_BAD.match(chr(n)):
                    self.error("reference to a character that isn't allowed", at + m.start())

    def misc(self, within: bool) -> bool:
        """A comment, instruction or CDATA section; False if there is none."""
        t, i = self.text, self.i
        if t.startswith("<!--", i):
            end = t.find("--", i + 4)
            if end < 0:
                self.error("unterminated comment")
                self.i = len(t)
            elif not t.startswith("-->", end):
                self.error("'--' within a comment", end)
                close = t.find("-->", end)
                self.i = len(t) if close < 0 else close + 3
            else:
                self.i = end + 3
        elif t.startswith("<?", i):
            m = re.compile(rf"<\?({_XML_NAME})(?:\s.*?)?\?>", re.S).match(t, i)
            if not m or (m.group(1).lower() == "xml" and i > 0):
                self.error("misplaced or broken processing instruction")
            end = t.find("?>", i)
            self.i = len(t) if end < 0 else end + 2
        elif within and t.startswith("<![CDATA[", i):
            end = t.find("]]>", i)
            if end < 0:
                self.error("unterminated CDATA section")
            self.i = len(t) if end < 0 else end + 3
        else:
            return False
        return True

    def doctype(self) -> None:
        m = re.compile(rf"<!DOCTYPE\s+{_XML_NAME}[^\[<>]*(\[(?:\"[^\"]*\"|'[^']*'|<!--.*?-->|[^\]\"'])*\]\s*)?>", re.S).match(self.text, self.i)
        if not m:
            self.error("broken document type")
            self.i = len(self.text)
            return
        if m.group(1):
            self.known |= set(re.findall(rf"<!ENTITY\s+({_XML_NAME})\s", m.group(1)))
        self.i = m.end()

    def parse(self) -> None:
        t = self.text
        n = len(t)
        if t.startswith("﻿"):
            self.i = 1
        for m in _XML_BAD.finditer(t):
            self.error("character that isn't allowed", m.start())
            break
        if t.startswith("<?xml", self.i) and t[self.i + 5 : self.i + 6].isspace():
            m = re.compile(r"<\?xml\s+version\s*=\s*(\"1\.[0-9]+\"|'1\.[0-9]+')(\s+encoding\s*=\s*(\"[A-Za-z][\w.\-]*\"|'[A-Za-z][\w.\-]*'))?(\s+standalone\s*=\s*(\"(yes|no)\"|'(yes|no)'))?\s*\?>").match(t, self.i)
            if not m:
                self.error("broken XML declaration")
            end = t.find("?>", self.i)
            self.i = n if end < 0 else end + 2
        stack: list[tuple[str, int]] = []
        roots = doctypes = 0
        while self.i < n:
            if t[self.i] != "<":
                end = t.find("<", self.i)
                end = n if end < 0 else end
                piece = t[self.i : end]
                if not stack and piece.strip(" \t\r\n"):
                    self.error("text outside the root element")
                elif "]]>" in piece:
                    self.error("']]>' in text", self.i + piece.index("]]>"))
                elif stack:
                    self.references(piece, self.i)
                self.i = end
            elif self.misc(bool(stack)):
                pass
            elif t.startswith("<!DOCTYPE", self.i) and not stack and not roots and not doctypes:
                doctypes += 1
                self.doctype()
            elif t.startswith("</", self.i):
                m = re.compile(rf"</({_XML_NAME})\s*>").match(t, self.i)
                if not m:
                    self.error("broken end tag")
                    self.skip()
                    continue
                if not stack:
                    self.error(f"end tag {m.group(1)!r} without a start")
                elif stack[-1][0] != m.group(1):
                    self.error(f"mismatched tag: {m.group(1)!r} ends {stack[-1][0]!r}")
                    names = [s for s, _ in stack]
                    if m.group(1) in names:  # give up what is open within
                        del stack[len(names) - 1 - names[::-1].index(m.group(1)) :]
                else:
                    stack.pop()
                self.i = m.end()
            else:
                m = _XML_TAG.match(t, self.i)
                if not m:
                    self.error("'<' that opens no tag")
                    self.i += 1
                    continue
                if not stack:
                    roots += 1
                    if roots > 1:
                        self.error("second root element")
                at, i, seen = self.i, m.end(), set()
                while a := _XML_ATTR.match(t, i):
                    if a.group(1) in seen:
                        self.error(f"duplicate attribute {a.group(1)!r}", a.start())
                    seen.add(a.group(1))
                    self.references(a.group(2), a.start(2))
                    i = a.end()
                close = re.compile(r"\s*(/?)>").match(t, i)
                if not close:
                    self.error("broken start tag", i)
                    self.i = i
                    self.skip()
                    stack.append((m.group(1), at))
                    continue
                if not close.group(1):
                    stack.append((m.group(1), at))
                self.i = close.end()
        if stack:
            self.error(f"element {stack[-1][0]!r} is never closed", n)
        elif not roots:
            self.error("no element found", n)

    def skip(self) -> None:
        m = re.compile(r"[^<>]*>?").match(self.text, self.i + 1)
        self.i = max(self.i + 1, m.end())


def parse_xml(text: str) -> list[Fault]:
    p = XmlParser(text)
    p.parse()
    return [Fault(lexers.line_of(text, at), m) for at, m in sorted(p.errors)]


# YAML

_Y_PLAIN_FIRST = re.compile(r"[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[\-?:](?=[^\s])")
_Y_QUOTED = re.compile(r"'(?:''|[^'])*'|\"(?:\\.|[^\"\\])*\"", re.S)
_Y_ESCAPE = re.compile(r"\\(?!(?:[0abt\tnvfre \"/\\N_LP\n\r]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))", re.S)
_Y_PROPS = re.compile(r"(?:(?:&[^\s,\[\]{}]+|!<[^\s>]*>|![^\s,\[\]{}]*)(?:[ \t]+|(?=[\r\n,\]}]|$)))+")


class YamlParser:
    """YAML 1.1 as block and flow nodes over a text with its columns."""

    def __init__(self, text: str):
        self.text = text.replace("\r\n", "\n").replace("\r", "\n") + "\n"
        self.n, self.i, self.errors, self.depth = len(self.text), 0, [], 0
        self.anchors: set[str] = set()

    def fail(self, message: str) -> Reject:
        return Reject(message, self.i)

    def column(self) -> int:
        return self.i - (self.text.rfind("\n", 0, self.i) + 1)

    def line_end(self) -> int:
        return self.text.index("\n", self.i) if self.i < self.n else self.n

    def spaces(self) -> bool:
        """Blanks and a comment on this line; whether the line ends there."""
        start = self.i
        while self.i < self.n and self.text[self.i] in " \t":
            self.i += 1
        if self.i < self.n and self.text[self.i] == "#" and (self.i == start == 0 or self.text[self.i - 1] in " \t\n"):
            self.i = self.line_end()
        return self.i >= self.n or self.text[self.i] == "\n"

    def lines(self) -> int:
        """To the next content; its column, or -1 at the end or a document mark."""
        while self.i < self.n:
            start = self.i
            at_start = self.column() == 0
            while self.i < self.n and self.text[self.i] == " ":
                self.i += 1
            if self.i < self.n and self.text[self.i] == "\t" and at_start:
                mark = self.i
                if not self.spaces():
                    self.i = mark
                    raise self.fail("tab in indentation")
            if self.spaces():
                self.i = min(self.n, self.i + 1)
                continue
            if at_start and self.text.startswith(("---", "..."), self.i) and self.column() == 0 and self.text[self.i + 3 : self.i + 4] in (" ", "\t", "\n", ""):
                self.i = start
                return -1
            return self.column()
        return -1

    def stream(self) -> None:
        if self.text.startswith("﻿"):
            self.i = 1
        bad = re.search("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ud800-\udfff￾￿]", self.text)
        if bad:
            self.errors.append((bad.start(), "character that isn't allowed"))
        while True:
            try:
                if not self.document():
                    break
            except Reject as e:
                self.errors.append((e.at, e.message))
                m = re.compile(r"^(?:---|\.\.\.)(?=\s)", re.M).search(self.text, max(self.i, e.at) + 1)
                self.depth = 0
                if not m:
                    break
                self.i = m.start()

    def document(self) -> bool:
        self.anchors = set()
        directives = False
        column = self.lines()
        while column == 0 and self.text[self.i] == "%":
            if not re.compile(r"%(YAML[ \t]+\d+\.\d+|TAG[ \t]+![\w\-]*!?[ \t]+\S+|[A-Z]\w*[^\n]*)[ \t]*(#[^\n]*)?$", re.M).match(self.text, self.i):
                raise self.fail("broken directive")
            directives = True
            self.i = self.line_end()
            column = self.lines()
        if self.i >= self.n:
            if directives:
                raise self.fail("expected '---'")
            return False
        if column == -1:
            mark = self.text[self.i : self.i + 3]
            self.i += 3
            if mark == "...":
                if not self.spaces():
                    raise self.fail("text after '...'")
                return True
            if not self.spaces():
                if self.block_start_on_line():
                    raise self.fail("block mapping on the line of '---'")
                self.node(-1, self.column())
                return self.after_document()
            column = self.lines()
            if column == -1:
                return self.i < self.n
        elif directives:
            raise self.fail("expected '---'")
        self.node(-1, column)
        return self.after_document()

    def block_start_on_line(self) -> bool:
        return bool(re.compile(r"(?:[\w.\-]+):[ \t]").match(self.text, self.i))

    def after_document(self) -> bool:
        column = self.lines()
        if self.i >= self.n:
            return False
        if column != -1:
            raise self.fail("expected the end of the document")
        return True

    def node(self, parent: int, column: int) -> None:
        """A node that starts here, on a line's first content or behind its indicator; its block lies
        deeper than parent."""
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise self.fail("nested too deeply")
        t = self.text
        c = t[self.i]
        nxt = t[self.i + 1 : self.i + 2]
        if c == "-" and nxt in (" ", "\t", "\n"):
            self.sequence(column)
        elif c == "?" and nxt in (" ", "\t", "\n") or self.is_key():
            self.mapping(column)
        else:
            self.scalar_or_flow(parent)
        self.depth -= 1

    def is_key(self) -> bool:
        """Whether an implicit key starts here: a node on one line, a colon and a blank."""
        start = self.i
        try:
            self.skip_properties()
            c = self.text[self.i : self.i + 1]
            if c and c in "\"'":
                m = _Y_QUOTED.match(self.text, self.i)
                if not m or "\n" in m.group():
                    return False
                self.i = m.end()
            elif c and c in "[{":
                end = self.line_end()
                self.flow()
                if self.i > end:
                    return False
            elif c == "*":
                self.i = re.compile(r"\*[^\s,\[\]{}]+").match(self.text, self.i).end() if re.compile(r"\*[^\s,\[\]{}]+").match(self.text, self.i) else self.i + 1
            else:
                m = re.compile(r"(?:[^\n:#]|:(?=[^\s])|(?<=\S)#)*").match(self.text, self.i)
                if m.group() and not _Y_PLAIN_FIRST.match(self.text, self.i):
                    return False
                self.i = m.end()
            while self.text[self.i : self.i + 1] in (" ", "\t"):
                self.i += 1
            return self.text[self.i : self.i + 1] == ":" and self.text[self.i + 1 : self.i + 2] in (" ", "\t", "\n", "")
        except Reject:
            return False
        finally:
            self.i = start

    def skip_properties(self) -> None:
        m = _Y_PROPS.match(self.text, self.i)
        if m:
            found = m.group().split()
            if sum(x[0] == "&" for x in found) > 1 or sum(x[0] == "!" for x in found) > 1:
                raise self.fail("repeated anchor or tag")
            self.anchors |= {x[1:] for x in found if x[0] == "&"}
            self.i = m.end()

    def sequence(self, column: int) -> None:
        while True:
            if not (self.text[self.i] == "-" and self.text[self.i + 1 : self.i + 2] in (" ", "\t", "\n")):
                raise self.fail("expected '-'")
            self.i += 1
            self.entry(column, compact=True)
            here = self.lines()
            if here < column or here == -1:
                return
            if here > column:
                raise self.fail("bad indentation of a sequence entry")
            if self.text[self.i] != "-" or self.text[self.i + 1 : self.i + 2] not in (" ", "\t", "\n"):
                return

    def entry(self, column: int, compact: bool, same: bool = False) -> None:
        """The node behind an indicator, which may be empty. same: a sequence may stand as far left."""
        if not self.spaces():
            start = self.i
            self.skip_properties()
            if self.spaces():
                pass
            else:
                self.i = start
                if compact or not (self.is_key() or self.text[self.i : self.i + 2] in ("- ", "? ", "-\n")):
                    if compact:
                        self.node(column, self.column())
                    else:
                        self.scalar_or_flow(column)
                    return
                raise self.fail("mapping values are not allowed here")
        here = self.lines()
        if here > column or (same and here == column and self.text[self.i] == "-" and self.text[self.i + 1 : self.i + 2] in (" ", "\n", "\t")):
            self.node(column, here)

    def mapping(self, column: int) -> None:
        while True:
            c, nxt = self.text[self.i], self.text[self.i + 1 : self.i + 2]
            if c == "?" and nxt in (" ", "\t", "\n"):
                self.i += 1
                self.entry(column, compact=True)
                here = self.lines()
                if here == column and self.text[self.i] == ":" and self.text[self.i + 1 : self.i + 2] in (" ", "\t", "\n"):
                    self.i += 1
                    self.entry(column, compact=True)
            elif self.is_key():
                self.key()
                self.entry(column, compact=False, same=True)
            else:
                raise self.fail("expected a key")
            here = self.lines()
            if here < column or here == -1:
                return
            if here > column:
                raise self.fail("bad indentation of a mapping entry")
            if self.text[self.i] == "-" and self.text[self.i + 1 : self.i + 2] in (" ", "\n", "\t"):
                raise self.fail("sequence entry among mapping entries")

    def key(self) -> None:
        self.skip_properties()
        c = self.text[self.i]
        if c in "\"'":
            self.quoted()
        elif c in "[{":
            self.flow()
        elif c == "*":
            self.alias()
        elif c != ":":
            self.i = re.compile(r"(?:[^\n:#]|:(?=[^\s])|(?<=\S)#)*").match(self.text, self.i).end()
        while self.text[self.i] in " \t":
            self.i += 1
        self.i += 1

    def alias(self) -> None:
        m = re.compile(r"\*([^\s,\[\]{}:]+)").match(self.text, self.i)
        if not m:
            raise self.fail("alias without a name")
        if m.group(1) not in self.anchors:
            raise self.fail(f"undefined alias {m.group(1)!r}")
        self.i = m.end()

    def quoted(self) -> None:
        m = _Y_QUOTED.match(self.text, self.i)
        if not m:
            raise self.fail("unterminated quoted scalar")
        if m.group()[0] == '"':
            bad = _Y_ESCAPE.search(re.sub(r"\\\\", "__", m.group()))
            if bad:
                self.i += bad.start()
                raise self.fail("unknown escape")
        if re.search(r"\n(---|\.\.\.)\s", m.group()):
            raise self.fail("document mark in a quoted scalar")
        self.i = m.end()

    def scalar_or_flow(self, parent: int) -> None:
        self.skip_properties()
        if self.spaces():
            here = self.lines()
            if here > parent:
                self.node(parent, here)
            return
        c = self.text[self.i]
        if c in "\"'":
            self.quoted()
        elif c in "[{":
            self.flow()
        elif c == "*":
            self.alias()
        elif c in "|>":
            self.block_scalar(parent)
            return
        elif not _Y_PLAIN_FIRST.match(self.text, self.i):
            raise self.fail(f"character {c!r} cannot start a token")
        else:
            self.plain(parent)
            return
        if not self.spaces():
            raise self.fail("text behind a node" if self.text[self.i] != ":" else "mapping values are not allowed here")

    def plain(self, parent: int) -> None:
        piece = re.compile(r"(?:[^\n:#]|:(?=\S)|(?<=\S)#)*")
        while True:
            self.i = piece.match(self.text, self.i).end()
            if self.text[self.i : self.i + 1] == ":":
                raise self.fail("mapping values are not allowed here")
            if self.text[self.i : self.i + 1] == "#":
                self.i = self.line_end()
                return
            start = self.i
            here = self.lines()
            if here <= parent or here == -1:
                self.i = start
                return
            if "#" in self.text[start : self.i] and self.text[start : self.i].lstrip(" \t\n").startswith("#"):
                self.i = start
                return
            if self.is_key():
                raise self.fail("mapping values are not allowed here")

    def block_scalar(self, parent: int) -> None:
        m = re.compile(r"[|>](?:[+-]?[1-9]|[1-9]?[+-])?[ \t]*(?:(?<=[ \t])#[^\n]*)?$", re.M).match(self.text, self.i)
        if not m:
            raise self.fail("broken head of a block scalar")
        digit = re.search(r"[1-9]", m.group().split("#")[0])
        self.i = min(self.n, m.end() + 1)
        least = max(parent, 0) + int(digit.group()) if digit else None
        while self.i < self.n:
            end = self.line_end()
            line = self.text[self.i : end]
            if line.strip(" "):
                width = len(line) - len(line.lstrip(" "))
                if least is None:
                    if width <= parent:
                        return
                    least = width
                if width < least:
                    return
                if least == 0 and re.match(r"(---|\.\.\.)(\s|$)", line):
                    return
            self.i = min(self.n, end + 1)

    def flow_space(self) -> None:
        while self.i < self.n:
            if not self.spaces():
                if self.column() == 0 and re.compile(r"(?:---|\.\.\.)\s").match(self.text, self.i):
                    raise self.fail("document mark in a flow collection")
                return
            self.i += 1
        raise self.fail("flow collection is never closed")

    def flow(self) -> None:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise self.fail("nested too deeply")
        close = {"[": "]", "{": "}"}[self.text[self.i]]
        self.i += 1
        self.flow_space()
        while self.text[self.i] != close:
            self.flow_entry(close)
            self.flow_space()
            if self.text[self.i] == ",":
                self.i += 1
                self.flow_space()
            elif self.text[self.i] != close:
                raise self.fail(f"expected ',' or {close!r}")
        self.i += 1
        self.depth -= 1

    def flow_entry(self, close: str) -> None:
        explicit = False
        if self.text[self.i] == "?" and self.text[self.i + 1] in " \t\n":
            self.i += 1
            self.flow_space()
            explicit = True
        quoted, start = False, self.i
        if self.text[self.i] not in (",", close) and not (self.text[self.i] == ":" and self.text[self.i + 1] in " \t\n,]}"):
            quoted = self.flow_node()
            end = self.i
            self.flow_space()
            if self.text[self.i] == ":" and not explicit and "\n" in self.text[start:end]:
                raise self.fail("key of several lines")
        elif not explicit and self.text[self.i] == ",":
            raise self.fail("empty entry in a flow collection")
        if self.text[self.i] == ":" and (quoted or self.text[self.i + 1] in " \t\n,]}"):
            self.i += 1
            self.flow_space()
            if self.text[self.i] not in (",", close):
                self.flow_node()

    def flow_node(self) -> bool:
        self.skip_properties()
        self.flow_space()
        c = self.text[self.i]
        if c in "\"'":
            self.quoted()
            return True
        if c in "[{":
            self.flow()
            return True
        if c == "*":
            self.alias()
            return False
        if c in ",]}":
            return False
        if not _Y_PLAIN_FIRST.match(self.text, self.i) or c in "-?:" and self.text[self.i + 1] in ",[]{}":
            raise self.fail(f"character {c!r} cannot start a token")
        piece = re.compile(r"(?:[^\n:#,\[\]{}]|:(?=[^\s,\[\]{}])|(?<=\S)#)+")
        while m := piece.match(self.text, self.i):
            self.i = m.end()
            start = self.i
            if not self.spaces():
                break
            self.flow_space()
            if self.text[self.i] in ",[]{}:#" or "#" in self.text[start : self.i]:
                break
        return False


def parse_yaml(text: str) -> list[Fault]:
    p = YamlParser(text)
    p.stream()
    return [Fault(p.text.count("\n", 0, at) + 1, m) for at, m in sorted(p.errors)]
