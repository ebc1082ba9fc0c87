"""Parsers of Java (21) and of JavaScript (modules) for problem 6."""

from __future__ import annotations

import re

from loomspan.sources import lexers
from loomspan.sources.lexers import Token
from loomspan.llm.parsers import Fault, Parser

# Reserved words of Java, its primitive types, modifiers and binary operators by precedence.
_J_RESERVED = frozenset(
    """abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if
    implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized
    this throw throws transient try void volatile while true false null _""".split()
)
_J_PRIMITIVE = frozenset("boolean byte char double float int long short".split())
_J_MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default sealed non-sealed".split())
_J_BINARY = {
    "||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "<<": 8, ">>": 8, ">>>": 8,
    "+": 9, "-": 9, "*": 10, "/": 10, "%": 10,
}
_J_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())


class CurlyParser(Parser):
    """What both languages share: skipping to the next statement, and blocks that go on after errors."""

    starts: frozenset[str] = frozenset()

    def sync(self) -> None:
        depth = 0
        while self.t.kind != "end":
            t = self.t.text if self.t.kind == "op" else ""
            if t == "{":
                depth += 1
            elif t == "}":
                if depth == 0:
                    return
                depth -= 1
                if depth == 0:
                    self.next()
                    return
            elif t == ";" and depth == 0:
                self.next()
                return
            elif depth == 0 and self.t.nl and self.t.kind == "id" and self.t.text in self.starts:
                return
            self.next()

    def body(self, rule) -> None:
        """Statements or members up to the closing brace, whose opening one is taken."""
        self.deeper()
        while not self.at("}"):
            if self.t.kind == "end":
                raise self.fail("'}' is missing at the end of the file")
            self.recover(rule, self.sync)
        self.next()
        self.depth -= 1


class JavaParser(CurlyParser):
    starts = frozenset("public private protected static final class interface enum record if for while do try switch return throw break continue".split())

    def __init__(self, text: str):
        super().__init__(text, lexers.java(text))

    def name(self) -> str:
        t = self.t
        if t.kind != "id" or (t.text in _J_RESERVED and t.text != "_"):
            raise self.fail(f"expected a name, found {t.text or t.kind!r}")
        return self.next().text

    def is_name(self, t: Token) -> bool:
        return t.kind == "id" and t.text not in _J_RESERVED

    def unit(self) -> None:
        if self.t.kind == "end":
            return
        self.try_(self.package)
        while self.t.kind != "end":
            if self.at("import"):
                self.recover(self.import_, self.sync)
            elif not self.take(";"):
                if self.at("}"):
                    self.errors.append((self.t.at, "'}' without a start"))
                    self.next()
                else:
                    self.recover(self.top, self.sync)

    def package(self) -> None:
        self.annotations()
        self.need("package")
        self.qualified()
        self.need(";")

    def import_(self) -> None:
        self.need("import")
        self.take("static")
        self.name()
        while self.take("."):
            if self.take("*"):
                break
            self.name()
        self.need(";")

    def qualified(self) -> None:
        self.name()
        while self.take("."):
            self.name()

    def annotations(self) -> None:
        while self.at("@") and self.ahead().text != "interface":
            self.next()
            self.qualified()
            if self.take("("):
                while not self.at(")"):
                    if self.is_name(self.t) and self.ahead().text == "=":
                        self.next()
                        self.next()
                    self.annotation_value()
                    if not self.take(","):
                        break
                self.need(")")

    def annotation_value(self) -> None:
        if self.at("@"):
            self.annotations()
        elif self.take("{"):
            while not self.at("}"):
                self.annotation_value()
                if not self.take(","):
                    break
            self.need("}")
        else:
            self.ternary()

    def modifiers(self) -> None:
        while True:
            if self.at("@") and self.ahead().text != "interface":
                self.annotations()
            elif self.t.text == "non" and self.ahead().text == "-" and self.ahead(2).text == "sealed":
                for _ in range(3):
                    self.next()
            elif self.at("sealed"):
                if self.ahead().kind != "id":
                    return
                self.next()
            elif self.t.kind == "id" and self.t.text in _J_MODIFIERS:
                if self.t.text == "default" and self.ahead().text in (":", "->"):
                    return
                self.next()
            else:
                return

    def is_type_start(self) -> bool:
        return self.at("class", "interface", "enum") or self.at("@") or (self.at("record") and self.is_name(self.ahead()) and self.ahead(2).text in ("(", "<"))

    def top(self) -> None:
        self.modifiers()
        if not self.is_type_start():
            raise self.fail("expected a class, interface, enum or record")
        self.type_declaration()

    def type_declaration(self) -> None:
        if self.take("@"):
            self.need("interface")
            self.name()
            self.need("{")
            self.body(self.member)
            return
        kind = self.next().text
        name = self.name()
        self.type_parameters()
        if kind == "record":
            self.need("(")
            self.formal_parameters()
        while self.at("extends", "implements", "permits"):
            self.next()
            self.type_()
            while self.take(","):
                self.type_()
        self.need("{")
        if kind == "enum":
            self.enum_constants()
            if not self.take(";"):
                self.need("}")
                return
        self.owner_names = [*getattr(self, "owner_names", []), name]
        try:
            self.body(self.member)
        finally:
            self.owner_names.pop()

    def enum_constants(self) -> None:
        while not self.at(";", "}"):
            self.annotations()
            self.name()
            if self.take("("):
                self.arguments()
            if self.take("{"):
                self.body(self.member)
            if not self.take(","):
                break

    def type_parameters(self) -> None:
        if self.take("<"):
            while True:
                self.annotations()
                self.name()
                if self.take("extends"):
                    self.type_()
                    while self.take("&"):
                        self.type_()
                if not self.take(","):
                    break
            self.need(">")

    def member(self) -> None:
        if self.take(";"):
            return
        if self.at("static") and self.ahead().text == "{":
            self.next()
        if self.take("{"):
            self.body(self.statement)
            return
        self.modifiers()
        if self.is_type_start():
            self.type_declaration()
            return
        self.type_parameters()
        self.annotations()
        if self.is_name(self.t) and self.ahead().text == "(":  # constructor
            if self.t.text != (self.owner_names[-1] if getattr(self, "owner_names", None) else self.t.text):
                raise self.fail("a method needs a return type")
            self.name()
            self.next()
            self.formal_parameters()
            self.throws()
            self.need("{")
            self.body(self.statement)
            return
        if self.is_name(self.t) and self.ahead().text == "{":  # compact constructor of a record
            self.name()
            self.next()
            self.body(self.statement)
            return
        if not self.take("void"):
            self.type_()
        self.name()
        if self.take("("):
            self.formal_parameters()
            self.dims()
            self.throws()
            if self.take("default"):
                self.annotation_value()
            if self.take("{"):
                self.body(self.statement)
            else:
                self.need(";")
            return
        self.declarators()
        self.need(";")

    def throws(self) -> None:
        if self.take("throws"):
            self.type_()
            while self.take(","):
                self.type_()

    def formal_parameters(self) -> None:
        while not self.at(")"):
            self.modifiers()
            self.type_()
            self.annotations()
            self.take("...")
            if not self.take("this"):
                self.name()
                while self.take("."):
                    if not self.take("this"):
                        self.name()
            self.dims()
            if not self.take(","):
                break
            if self.at(")"):
                raise self.fail("a parameter is missing")
        self.need(")")

    def dims(self) -> None:
        while True:
            self.annotations()
            if self.at("[") and self.ahead().text == "]":
                self.next()
                self.next()
            else:
                return

    def type_(self) -> None:
        self.annotations()
        if self.t.kind == "id" and self.t.text in _J_PRIMITIVE:
            self.next()
        else:
            self.name()
            self.type_arguments()
            while self.at(".") and (self.is_name(self.ahead()) or self.ahead().text == "@"):
                self.next()
                self.annotations()
                self.name()
                self.type_arguments()
        self.dims()

    def type_arguments(self) -> None:
        if self.take("<"):
            while not self.at(">"):
                self.annotations()
                if self.take("?"):
                    if self.take("extends", "super"):
                        self.type_()
                else:
                    self.type_()
                if not self.take(","):
                    break
            self.need(">")

    def declarators(self) -> None:
        """After the first name: dims, initialiser, and further names."""
        while True:
            self.dims()
            if self.take("="):
                self.initializer()
            if not self.take(","):
                return
            self.name()

    def initializer(self) -> None:
        if self.take("{"):
            self.deeper()
            while not self.at("}"):
                self.initializer()
                if not self.take(","):
                    break
            self.need("}")
            self.depth -= 1
        else:
            self.expr()

    # statements
    def statement(self) -> None:
        t = self.t
        if t.kind == "op":
            if self.take("{"):
                self.body(self.statement)
                return
            if self.take(";"):
                return
        rule = getattr(self, "s_" + t.text, None) if t.kind == "id" and t.text in _J_STATEMENTS else None
        if rule:
            self.deeper()
            rule()
            self.depth -= 1
            return
        if self.is_name(t) and self.ahead().text == ":" and self.ahead().kind == "op":
            self.next()
            self.next()
            self.statement()
            return
        if t.text == "yield" and t.kind == "id" and self.ahead().text not in ("=", ".", "(", "[", "++", "--"):
            self.next()
            self.expr()
            self.need(";")
            return
        if self.at("class", "interface", "enum", "abstract", "static", "final", "strictfp", "@") or (self.at("record") and self.is_name(self.ahead()) and self.ahead(2).text in ("(", "<")) or (self.at("sealed") and self.ahead().kind == "id"):
            self.modifiers()
            if self.is_type_start():
                self.type_declaration()
                return
            self.local_variable()
            self.need(";")
            return
        if self.is_declaration():
            self.local_variable()
        else:
            at = self.t.at
            if not self.expr_statement():
                raise self.fail("not a statement", at)
        self.need(";")

    def is_declaration(self) -> bool:
        start, depth = self.i, self.depth
        ok = self.try_(self.type_) and self.is_name(self.t)
        self.i, self.depth = start, depth
        return ok

    def local_variable(self) -> None:
        self.type_()
        self.name()
        self.declarators()

    def expr_statement(self) -> bool:
        return self.expr() in ("assign", "call", "new", "step")

    def s_if(self) -> None:
        self.next()
        self.condition()
        self.statement()
        if self.take("else"):
            self.statement()

    def condition(self) -> None:
        self.need("(")
        self.expr()
        self.need(")")

    def s_while(self) -> None:
        self.next()
        self.condition()
        self.statement()

    def s_do(self) -> None:
        self.next()
        self.statement()
        self.need("while")
        self.condition()
        self.need(";")

    def s_for(self) -> None:
        self.next()
        self.need("(")
        if not self.at(";"):
            self.modifiers()
            if self.is_declaration():
                self.type_()
                self.name()
                if self.take(":"):
                    self.expr()
                    self.need(")")
                    self.statement()
                    return
                self.declarators()
            else:
                self.expr()
                while self.take(","):
                    self.expr()
        self.need(";")
        if not self.at(";"):
            self.expr()
        self.need(";")
        if not self.at(")"):
            self.expr()
            while self.take(","):
                self.expr()
        self.need(")")
        self.statement()

    def s_return(self) -> None:
        self.next()
        if not self.at(";"):
            self.expr()
        self.need(";")

    def s_throw(self) -> None:
        self.next()
        self.expr()
        self.need(";")

    def s_break(self) -> None:
        self.next()
        if not self.at(";"):
            self.name()
        self.need(";")

    s_continue = s_break

    def s_assert(self) -> None:
        self.next()
        self.expr()
        if self.take(":"):
            self.expr()
        self.need(";")

    def s_synchronized(self) -> None:
        self.next()
        self.condition()
        self.need("{")
        self.body(self.statement)

    def s_try(self) -> None:
        self.next()
        resources = self.take("(")
        if resources:
            while not self.at(")"):
                self.modifiers()
                if self.is_declaration():
                    self.type_()
                    self.name()
                    self.need("=")
                self.expr()
                if not self.take(";"):
                    break
            self.need(")")
        self.need("{")
        self.body(self.statement)
        handlers = 0
        while self.take("catch"):
            handlers += 1
            self.need("(")
            self.modifiers()
            self.type_()
            while self.take("|"):
                self.type_()
            self.name()
            self.need(")")
            self.need("{")
            self.body(self.statement)
        if self.take("finally"):
            self.need("{")
            self.body(self.statement)
        elif not handlers and not resources:
            raise self.fail("'try' without 'catch' or 'finally'")

    def s_switch(self) -> None:
        self.switch()

    def s_else(self) -> None:
        raise self.fail("'else' without 'if'")

    def s_catch(self) -> None:
        raise self.fail("'catch' without 'try'")

    s_finally = s_catch

    def s_case(self) -> None:
        raise self.fail("'case' outside a switch")

    def switch(self) -> None:
        self.need("switch")
        self.condition()
        self.need("{")
        self.deeper()
        while not self.at("}"):
            self.case()
        self.need("}")
        self.depth -= 1

    def case(self) -> None:
        if self.take("default"):
            pass
        else:
            self.need("case")
            while True:
                if not self.take("default"):
                    if not self.try_(self.case_pattern):
                        self.ternary()
                if not self.take(","):
                    break
            if self.at("when"):
                self.next()
                self.expr(no_lambda=True)
        if self.take("->"):
            if self.take("{"):
                self.body(self.statement)
            elif self.at("throw"):
                self.s_throw()
            else:
                self.expr()
                self.need(";")
            return
        self.need(":")
        while not self.at("case", "}") and not (self.at("default") and self.ahead().text in (":", "->")):
            if self.t.kind == "end":
                raise self.fail("'}' is missing at the end of the file")
            self.recover(self.statement, self.sync)

    def case_pattern(self) -> None:
        self.pattern()
        if not self.at("->", ":", ",", "when", "&&"):
            raise self.fail()

    def pattern(self) -> None:
        self.modifiers()
        self.type_()
        if self.take("("):
            while not self.at(")"):
                self.pattern()
                if not self.take(","):
                    break
            self.need(")")
            if self.is_name(self.t) and self.t.text != "when":
                self.name()
        else:
            self.name()

    # expressions
    def op_text(self) -> tuple[str, int]:
        """The operator here; '>' that touch each other, and '>=' behind them, are one."""
        t = self.t
        if t.kind == "id":
            return ("instanceof", 1) if t.text == "instanceof" else ("", 0)
        if t.kind != "op":
            return "", 0
        if t.text == ">":
            text, k = ">", 1
            while len(text) < 3 and self.ahead(k).text == ">" and self.ahead(k).at == t.at + len(text):
                text, k = text + ">", k + 1
            if self.ahead(k).text == ">=" and self.ahead(k).at == t.at + len(text):
                return text + ">=", k + 1
            return text, k
        return t.text, 1

    def expr(self, no_lambda: bool = False) -> str:
        self.deeper()
        if not no_lambda and self.lambda_ahead():
            self.lambda_()
            self.depth -= 1
            return "lambda"
        at = self.t.at
        kind = self.ternary()
        op, n = self.op_text()
        if op in _J_ASSIGN:
            if kind not in ("name", "field", "item", "paren"):
                raise self.fail("cannot assign to this", at)
            for _ in range(n):
                self.next()
            self.expr()
            kind = "assign"
        self.depth -= 1
        return kind

    def lambda_ahead(self) -> bool:
        if self.t.kind == "id" and (self.t.text not in _J_RESERVED or self.t.text == "_"):
            return self.ahead().text == "->"
        if not self.at("("):
            return False
        depth, k = 0, self.i
        tokens = self.tokens
        while k < len(tokens):
            t = tokens[k]
            if t.kind == "op":
                if t.text == "(":
                    depth += 1
                elif t.text == ")":
                    depth -= 1
                    if depth == 0:
                        return tokens[k + 1].text == "->"
                elif t.text in (";", "{", "}"):
                    return False
            elif t.kind == "end":
                return False
            k += 1
        return False

    def lambda_(self) -> None:
        if self.take("("):
            while not self.at(")"):
                if (self.is_name(self.t) or self.t.text == "_") and self.ahead().text in (",", ")"):
                    self.name()
                else:
                    self.modifiers()
                    self.type_()
                    self.take("...")
                    self.name()
                    self.dims()
                if not self.take(","):
                    break
            self.need(")")
        else:
            self.name()
        self.need("->")
        if self.take("{"):
            self.body(self.statement)
        else:
            self.expr()

    def ternary(self) -> str:
        kind = self.binary(1)
        if self.take("?"):
            self.expr()
            self.need(":")
            if self.lambda_ahead():
                self.lambda_()
            else:
                self.ternary()
            return "ternary"
        return kind

    def binary(self, least: int) -> str:
        """Precedence climbing; instanceof stands with the comparisons."""
        self.deeper()
        kind = self.unary()
        while True:
            op, n = self.op_text()
            if op == "instanceof" and least <= 7:
                self.next()
                if not self.try_(self.pattern):
                    self.modifiers()
                    self.type_()
            elif _J_BINARY.get(op, 0) >= least:
                for _ in range(n):
                    self.next()
                self.binary(_J_BINARY[op] + 1)
            else:
                break
            kind = "operation"
        self.depth -= 1
        return kind

    def unary(self) -> str:
        t = self.t
        if t.kind == "op":
            if t.text in ("+", "-", "!", "~"):
                self.next()
                self.deeper()
                self.unary()
                self.depth -= 1
                return "operation"
            if t.text in ("++", "--"):
                self.next()
                self.unary()
                return "step"
            if t.text == "(" and self.try_(self.cast):
                return "cast"
        if self.at("switch"):
            self.switch()
            return self.postfix("switch")
        return self.postfix(self.primary())

    def cast(self) -> None:
        self.need("(")
        primitive = self.t.text in _J_PRIMITIVE
        start = self.i
        self.type_()
        primitive = primitive and self.i == start + 1
        while self.take("&"):
            self.type_()
        self.need(")")
        t = self.t
        if primitive:
            self.unary()
        elif t.kind in ("num", "str") or (t.kind == "id" and t.text not in ("instanceof",)) or t.text in ("(", "!", "~"):
            if self.lambda_ahead():
                self.lambda_()
            else:
                self.unary()
        else:
            raise self.fail()

    def primary(self) -> str:
        t = self.t
        if t.kind in ("num", "str"):
            self.next()
            return "literal"
        if self.take("("):
            self.deeper()
            self.expr()
            self.need(")")
            self.depth -= 1
            return "paren"
        if t.kind == "id":
            if t.text in ("true", "false", "null"):
                self.next()
                return "literal"
            if t.text in ("this", "super"):
                self.next()
                if self.take("("):
                    self.arguments()
                    return "call"
                return "this"
            if t.text == "new":
                return self.new()
            if t.text in _J_PRIMITIVE or t.text == "void":
                self.next()
                self.dims()
                if self.take("::"):
                    self.need("new")
                else:
                    self.need(".")
                    self.need("class")
                return "literal"
            if self.is_name(t):
                if self.ahead().text == "<" and self.try_(self.generic_reference):
                    return "reference"
                if self.ahead().text == "[" and self.ahead(2).text == "]":
                    self.type_()
                    if self.take("::"):
                        self.need("new")
                    else:
                        self.need(".")
                        self.need("class")
                    return "literal"
                self.next()
                if self.take("("):
                    self.arguments()
                    return "call"
                return "name"
        raise self.fail("expected an expression, found " + (t.text or t.kind))

    def generic_reference(self) -> None:
        self.type_()
        self.need("::")
        if not self.take("new"):
            self.name()

    def new(self) -> str:
        self.need("new")
        self.type_arguments()
        self.annotations()
        if self.t.text in _J_PRIMITIVE:
            self.next()
        else:
            self.name()
            self.type_arguments()
            while self.take("."):
                self.annotations()
                self.name()
                self.type_arguments()
        self.annotations()
        if self.at("["):
            sized = False
            while self.take("["):
                if self.take("]"):
                    if sized:
                        self.dims()
                        break
                    self.dims()
                    self.need("{")
                    self.i -= 1
                    self.initializer()
                    return "new"
                self.expr()
                self.need("]")
                sized = True
            return "array"
        self.need("(")
        self.arguments()
        if self.take("{"):
            owners, self.owner_names = getattr(self, "owner_names", []), []
            self.body(self.member)
            self.owner_names = owners
        return "new"

    def arguments(self) -> None:
        while not self.at(")"):
            self.expr()
            if not self.take(","):
                break
            if self.at(")"):
                raise self.fail("an argument is missing")
        self.need(")")

    def postfix(self, kind: str) -> str:
        while self.t.kind == "op":
            if self.take("."):
                self.type_arguments()
                if self.at("new"):
                    kind = self.new()
                elif self.take("class"):
                    kind = "literal"
                elif self.take("this", "super"):
                    kind = "this"
                    if self.take("("):
                        self.arguments()
                        kind = "call"
                else:
                    self.name()
                    if self.take("("):
                        self.arguments()
                        kind = "call"
                    else:
                        kind = "field"
                        if self.at("<") and self.try_(self.reference_tail):
                            kind = "reference"
                        elif self.at("[") and self.ahead().text == "]":
                            self.dims()
                            if not self.take("::"):
                                self.need(".")
                                self.need("class")
                            else:
                                self.need("new")
                            kind = "literal"
            elif self.at("["):
                self.next()
                self.expr()
                self.need("]")
                kind = "item"
            elif self.take("::"):
                self.type_arguments()
                if not self.take("new"):
                    self.name()
                kind = "reference"
            elif self.at("++", "--"):
                if kind not in ("name", "field", "item", "paren"):
                    raise self.fail("cannot step this")
                self.next()
                kind = "step"
            else:
                break
        return kind

    def reference_tail(self) -> None:
        self.type_arguments()
        self.dims()
        self.need("::")
        if not self.take("new"):
            self.name()


_J_STATEMENTS = frozenset("if while do for return throw break continue assert synchronized try switch else catch finally case".split())


def parse_java(text: str) -> list[Fault]:
    p = JavaParser(text)
    p.errors += [(t.at, "a digit that octal numbers don't have") for t in p.tokens if t.kind == "num" and re.fullmatch(r"0[0-7_]*[89][\d_]*[lL]?", t.text)]
    p.unit()
    return p.faults()


# Reserved words of JavaScript modules, its binary and assignment operators.
_S_RESERVED = frozenset(
    """break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new
    null return super switch this throw true try typeof var void while with yield let static implements interface package private protected public await""".split()
)
_S_BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8,
    "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
_S_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??=".split())
_S_TARGETS = ("name", "member", "array", "object", "paren_name", "paren_member")


class ScriptParser(CurlyParser):
    """JavaScript as a module: strict, with await outside functions. Expressions return what they are;
    array and object stand for literals that may be patterns, cover for object literals that must."""

    starts = frozenset("const let var function class import export if for while do try switch return throw async".split())

    def __init__(self, text: str):
        super().__init__(text, lexers.javascript(text))

    def module(self) -> None:
        while self.t.kind != "end":
            if self.at("}"):
                self.errors.append((self.t.at, "'}' without a start"))
                self.next()
            else:
                self.recover(self.item, self.sync)

    def name(self) -> None:
        t = self.t
        if t.kind != "id" or t.text in _S_RESERVED or t.text[0] == "#":
            raise self.fail(f"expected a name, found {t.text or t.kind!r}")
        self.next()

    def end_of_statement(self) -> None:
        """A semicolon, or where one is inserted: before a brace, at the end and at a line's end."""
        if self.take(";") or self.at("}") or self.t.kind == "end" or self.t.nl:
            return
        raise self.fail(f"unexpected {self.t.text or self.t.kind!r}")

    def item(self) -> None:
        if self.at("import") and self.ahead().text not in ("(", "."):
            self.import_()
        elif self.at("export"):
            self.export()
        else:
            self.statement()

    def source(self) -> None:
        self.need("from")
        self.need_kind("str")
        if self.take("with", "assert"):
            self.need("{")
            while not self.at("}"):
                self.next()
                self.need(":")
                self.need_kind("str")
                if not self.take(","):
                    break
            self.need("}")
        self.end_of_statement()

    def import_(self) -> None:
        self.next()
        if self.t.kind == "str":
            self.next()
            self.end_of_statement()
            return
        if not self.at("{", "*"):
            self.name()
            if not self.take(","):
                self.source()
                return
        if self.take("*"):
            self.need("as")
            self.name()
        else:
            self.names(True)
        self.source()

    def names(self, importing: bool) -> None:
        self.need("{")
        while not self.at("}"):
            t = self.next()
            if t.kind not in ("id", "str"):
                raise self.fail(at=t.at)
            if self.take("as"):
                if importing:
                    self.name()
                elif self.t.kind in ("id", "str"):
                    self.next()
                else:
                    raise self.fail()
            elif importing and (t.kind == "str" or t.text in _S_RESERVED):
                raise self.fail(at=t.at)
            if not self.take(","):
                break
        self.need("}")

    def export(self) -> None:
        self.next()
        if self.take("default"):
            if self.at("function") or (self.at("async") and self.ahead().text == "function" and not self.ahead().nl):
                self.take("async")
                self.function(False)
            elif self.at("class"):
                self.class_(False)
            else:
                self.assign()
                self.end_of_statement()
        elif self.take("*"):
            if self.take("as"):
                self.next()
            self.source()
        elif self.at("{"):
            self.names(False)
            if self.at("from"):
                self.source()
            else:
                self.end_of_statement()
        elif self.at("const", "let", "var", "function", "class", "async"):
            self.statement()
        else:
            raise self.fail()

    def statement(self) -> None:
        t = self.t
        if t.kind == "op":
            if self.take("{"):
                self.body(self.statement)
                return
            if self.take(";"):
                return
        if t.kind == "id":
            if t.text in ("const", "let", "var"):
                self.declaration(t.text)
                self.end_of_statement()
                return
            if t.text == "async" and self.ahead().text == "function" and not self.ahead().nl:
                self.next()
                self.function(True)
                return
            if t.text == "function":
                self.function(True)
                return
            if t.text == "class":
                self.class_(True)
                return
            if t.text in ("import", "export") and self.ahead().text not in ("(", "."):
                raise self.fail(f"{t.text!r} within a block")
            rule = getattr(self, "s_" + t.text, None) if t.text in _S_STATEMENTS else None
            if rule:
                self.deeper()
                rule()
                self.depth -= 1
                return
            if t.text not in _S_RESERVED and self.ahead().text == ":" and self.ahead().kind == "op":
                self.next()
                self.next()
                self.statement()
                return
        self.expr()
        self.end_of_statement()

    def declaration(self, kind: str, loop: bool = False) -> bool:
        """Whether what was declared may be a loop's variable."""
        self.next()
        n, bare = 0, True
        while True:
            pattern = self.at("[", "{")
            self.binding()
            n += 1
            if self.take("="):
                self.assign(no_in=loop)
                bare = False
            elif not (loop and n == 1 and self.at("of", "in")) and (pattern or kind == "const"):
                raise self.fail("a value is missing in the declaration")
            if not self.take(","):
                return n == 1 and bare

    def binding(self) -> None:
        self.deeper()
        if self.take("["):
            while not self.at("]"):
                if self.take(","):
                    continue
                rest = self.take("...")
                self.binding()
                if not rest and self.take("="):
                    self.assign()
                if rest or not self.take(","):
                    break
            self.need("]")
        elif self.take("{"):
            while not self.at("}"):
                if self.take("..."):
                    self.name()
                    break
                t = self.t
                self.property_name()
                if self.take(":"):
                    self.binding()
                elif t.kind != "id" or t.text in _S_RESERVED:
                    raise self.fail(at=t.at)
                if self.take("="):
                    self.assign()
                if not self.take(","):
                    break
            self.need("}")
        else:
            self.name()
        self.depth -= 1

    def property_name(self) -> None:
        t = self.t
        if t.kind in ("id", "str", "num"):
            self.next()
        elif self.take("["):
            self.assign()
            self.need("]")
        else:
            raise self.fail("expected a property name, found " + (t.text or t.kind))

    def parameters(self) -> None:
        self.need("(")
        while not self.at(")"):
            rest = self.take("...")
            self.binding()
            if not rest and self.take("="):
                self.assign()
            if rest or not self.take(","):
                break
        self.need(")")

    def function(self, named: bool) -> None:
        self.need("function")
        self.take("*")
        if named or not self.at("("):
            self.name()
        self.parameters()
        self.function_body()

    def function_body(self) -> None:
        self.need("{")
        self.within = getattr(self, "within", 0) + 1
        self.body(self.statement)
        self.within -= 1

    def class_(self, named: bool) -> None:
        self.need("class")
        if named or (self.t.kind == "id" and self.t.text != "extends"):
            self.name()
        if self.take("extends"):
            self.unary_base()
        self.need("{")
        self.body(self.member)

    def unary_base(self) -> None:
        self.postfix(self.primary())

    def member(self) -> None:
        if self.take(";"):
            return
        if self.at("static") and self.ahead().text not in ("(", "=", ";", "}"):
            self.next()
            if self.take("{"):
                self.body(self.statement)
                return
        self.accessor_prefix()
        self.property_name()
        if self.at("("):
            self.parameters()
            self.function_body()
            return
        if self.take("="):
            self.assign()
        self.end_of_statement()

    def accessor_prefix(self) -> None:
        nxt = self.ahead()
        if self.at("async") and not nxt.nl and nxt.text not in ("(", "=", ";", "}", ",", ":"):
            self.next()
        elif self.at("get", "set") and nxt.text not in ("(", "=", ";", "}", ",", ":") and not (nxt.nl and nxt.text == "*"):
            self.next()
            return
        self.take("*")

    def s_if(self) -> None:
        self.next()
        self.condition()
        self.statement()
        if self.take("else"):
            self.statement()

    def condition(self) -> None:
        self.need("(")
        self.expr()
        self.need(")")

    def s_while(self) -> None:
        self.next()
        self.condition()
        self.statement()

    def s_do(self) -> None:
        self.next()
        self.statement()
        self.need("while")
        self.condition()
        self.take(";")

    def s_for(self) -> None:
        self.next()
        self.take("await")
        self.need("(")
        if not self.at(";"):
            if self.at("const", "let", "var"):
                single = self.declaration(self.t.text, loop=True)
            else:
                at = self.t.at
                single = self.expr(no_in=True) in _S_TARGETS
                if self.at("of", "in") and not single:
                    raise self.fail("cannot assign to this", at)
            if self.at("of", "in"):
                if not single:
                    raise self.fail()
                if self.next().text == "of":
                    self.assign()
                else:
                    self.expr()
                self.need(")")
                self.statement()
                return
        self.need(";")
        if not self.at(";"):
            self.expr()
        self.need(";")
        if not self.at(")"):
            self.expr()
        self.need(")")
        self.statement()

    def s_return(self) -> None:
        at = self.t.at
        self.next()
        if not getattr(self, "within", 0):
            raise self.fail("'return' outside a function", at)
        if not self.at(";", "}") and not self.t.nl and self.t.kind != "end":
            self.expr()
        self.end_of_statement()

    def s_throw(self) -> None:
        self.next()
        if self.t.nl:
            raise self.fail("a line ends behind 'throw'")
        self.expr()
        self.end_of_statement()

    def s_break(self) -> None:
        self.next()
        if self.t.kind == "id" and not self.t.nl and self.t.text not in _S_RESERVED:
            self.next()
        self.end_of_statement()

    s_continue = s_break

    def s_debugger(self) -> None:
        self.next()
        self.end_of_statement()

    def s_try(self) -> None:
        self.next()
        self.need("{")
        self.body(self.statement)
        handled = False
        if self.take("catch"):
            handled = True
            if self.take("("):
                self.binding()
                self.need(")")
            self.need("{")
            self.body(self.statement)
        if self.take("finally"):
            handled = True
            self.need("{")
            self.body(self.statement)
        if not handled:
            raise self.fail("'try' without 'catch' or 'finally'")

    def s_switch(self) -> None:
        self.next()
        self.condition()
        self.need("{")
        while not self.at("}"):
            if not self.take("default"):
                self.need("case")
                self.expr()
            self.need(":")
            while not self.at("case", "default", "}"):
                if self.t.kind == "end":
                    raise self.fail("'}' is missing at the end of the file")
                self.recover(self.statement, self.sync)
        self.need("}")

    def s_with(self) -> None:
        raise self.fail("'with' in a module")

    # expressions
    def expr(self, no_in: bool = False) -> str:
        kind = self.assign(no_in)
        while self.take(","):
            self.assign(no_in)
            kind = "sequence"
        if kind == "cover":
            raise self.fail("'=' in an object literal")
        return kind

    def arrow_ahead(self) -> bool:
        k = 1 if self.at("async") and not self.ahead().nl and (self.ahead().text == "(" or self.ahead().kind == "id") and self.ahead().text not in ("function",) else 0
        t = self.ahead(k) if k else self.t
        if t.kind == "id":
            return t.text not in _S_RESERVED and self.ahead(k + 1).text == "=>" and not self.ahead(k + 1).nl
        if t.kind != "op" or t.text != "(":
            return False
        depth, j, tokens = 0, self.i + k, self.tokens
        while j < len(tokens):
            u = tokens[j]
            if u.kind == "op":
                if u.text in "([{":
                    depth += 1
                elif u.text in ")]}":
                    depth -= 1
                    if depth == 0:
                        return tokens[j + 1].text == "=>" and not tokens[j + 1].nl
            elif u.kind == "end":
                return False
            j += 1
        return False

    def assign(self, no_in: bool = False) -> str:
        self.deeper()
        kind = self.assign_inner(no_in)
        self.depth -= 1
        return kind

    def assign_inner(self, no_in: bool) -> str:
        if self.at("yield"):
            self.next()
            if self.take("*"):
                self.assign(no_in)
            elif not self.t.nl and not self.at(")", "]", "}", ",", ";", ":", "in", "of") and self.t.kind != "end" and not (self.t.kind == "tpl" and self.t.text in ("mid", "close")):
                self.assign(no_in)
            return "yield"
        if self.arrow_ahead():
            if self.at("async") and self.ahead().text != "=>":
                self.next()
            if self.at("("):
                self.parameters()
            else:
                self.name()
            self.need("=>")
            if self.at("{"):
                self.function_body()
            else:
                self.assign(no_in)
            return "arrow"
        at = self.t.at
        kind = self.binary(1, no_in)
        if self.take("?"):
            self.assign()
            self.need(":")
            self.assign(no_in)
            kind = "ternary"
        if self.t.kind == "op" and self.t.text in _S_ASSIGN:
            if kind == "cover" and self.t.text == "=":
                kind = "object"
            if kind not in _S_TARGETS or (kind in ("array", "object") and self.t.text != "="):
                raise self.fail("cannot assign to this", at)
            self.next()
            self.assign(no_in)
            return "assign"
        return kind

    def binary(self, least: int, no_in: bool) -> str:
        self.deeper()
        if self.t.kind == "id" and self.t.text[0] == "#" and self.ahead().text == "in":
            self.next()
            kind = "private"
        else:
            kind = self.unary()
        while True:
            t = self.t
            rank = _S_BINARY.get(t.text, 0) if t.kind in ("op", "id") else 0
            if rank < least or (no_in and t.text == "in"):
                break
            if t.text == "**" and kind == "unary":
                raise self.fail("a unary operand of '**' needs parentheses")
            self.next()
            self.binary(rank if t.text == "**" else rank + 1, no_in)
            kind = "operation"
        self.depth -= 1
        return kind

    def unary(self) -> str:
        t = self.t
        if (t.kind == "op" and t.text in ("+", "-", "!", "~")) or (t.kind == "id" and t.text in ("typeof", "void", "delete")):
            self.next()
            self.deeper()
            self.unary()
            self.depth -= 1
            return "unary"
        if t.kind == "id" and t.text == "await":
            self.next()
            self.unary()
            return "await"
        if t.kind == "op" and t.text in ("++", "--"):
            self.next()
            at = self.t.at
            if self.unary() not in ("name", "member", "paren_name", "paren_member"):
                raise self.fail("cannot step this", at)
            return "step"
        kind = self.postfix(self.primary())
        if self.at("++", "--") and not self.t.nl:
            if kind not in ("name", "member", "paren_name", "paren_member"):
                raise self.fail("cannot step this")
            self.next()
            return "step"
        return kind

    def template(self) -> None:
        t = self.next()
        if t.text == "whole":
            return
        while True:
            self.expr()
            if self.t.kind != "tpl" or self.t.text not in ("mid", "close"):
                raise self.fail("unterminated value in a template")
            if self.next().text == "close":
                return

    def arguments(self) -> None:
        while not self.at(")"):
            self.take("...")
            if self.assign() == "cover":
                raise self.fail("'=' in an object literal")
            if not self.take(","):
                break
        self.need(")")

    def primary(self) -> str:
        t = self.t
        if t.kind in ("num", "str", "regex"):
            self.next()
            return "literal"
        if t.kind == "tpl" and t.text in ("open", "whole"):
            self.template()
            return "literal"
        if t.kind == "op":
            if self.take("("):
                self.deeper()
                kind = self.expr()
                self.need(")")
                self.depth -= 1
                return "paren_" + kind if kind in ("name", "member") else "paren"
            if self.take("["):
                ok = True
                while not self.at("]"):
                    if self.take(","):
                        continue
                    rest = self.take("...")
                    kind = self.assign()
                    ok = ok and kind in (*_S_TARGETS, "assign", "cover")
                    if not self.take(","):
                        break
                    if rest and not self.at("]"):
                        ok = False
                self.need("]")
                return "array" if ok else "display"
            if t.text == "{":
                return self.object()
        elif t.kind == "id":
            if t.text == "function" or (t.text == "async" and self.ahead().text == "function" and not self.ahead().nl):
                self.take("async")
                self.function(False)
                return "function"
            if t.text == "class":
                self.class_(False)
                return "class"
            if t.text == "new":
                self.next()
                if self.take("."):
                    self.need("target")
                    return "meta"
                kind = self.new() if self.at("new") else self.postfix(self.primary(), calls=False)
                if self.take("("):
                    self.arguments()
                return "new" if kind else "new"
            if t.text == "import":
                self.next()
                if self.take("."):
                    self.need("meta")
                    return "meta"
                self.need("(")
                self.arguments()
                return "call"
            if t.text == "super":
                self.next()
                if not self.at("(", ".", "["):
                    raise self.fail()
                return "super"
            if t.text in ("this", "null", "true", "false"):
                self.next()
                return "literal"
            self.name()
            return "name"
        raise self.fail("expected an expression, found " + (t.text or t.kind))

    def new(self) -> str:
        return self.primary()

    def object(self) -> str:
        self.need("{")
        self.deeper()
        cover, ok = False, True
        while not self.at("}"):
            if self.take("..."):
                ok = self.assign() in _S_TARGETS and ok
            else:
                start = self.i
                self.accessor_prefix()
                prefixed = self.i > start
                t = self.t
                self.property_name()
                if self.at("("):
                    self.parameters()
                    self.function_body()
                    ok = False
                elif prefixed:
                    raise self.fail()
                elif self.take(":"):
                    kind = self.assign()
                    ok = ok and kind in (*_S_TARGETS, "assign", "cover")
                    cover = cover or kind == "cover"
                else:
                    if t.kind != "id" or (t.text in _S_RESERVED):
                        raise self.fail(at=t.at)
                    if self.take("="):
                        self.assign()
                        cover = True
            if not self.take(","):
                break
        self.need("}")
        self.depth -= 1
        return "cover" if cover else ("object" if ok else "display")

    def postfix(self, kind: str, calls: bool = True) -> str:
        optional = False
        while True:
            t = self.t
            if t.kind == "tpl" and t.text in ("open", "whole"):
                if optional:
                    raise self.fail("template behind '?.'")
                self.template()
                kind = "call"
            elif t.kind != "op":
                break
            elif self.take("."):
                if self.t.kind != "id":
                    raise self.fail("expected a name, found " + (self.t.text or self.t.kind))
                self.next()
                kind = "chain" if optional else "member"
            elif t.text == "?." and calls:
                self.next()
                optional = True
                if self.take("("):
                    self.arguments()
                elif self.take("["):
                    self.expr()
                    self.need("]")
                elif self.t.kind == "id":
                    self.next()
                else:
                    raise self.fail()
                kind = "chain"
            elif self.take("["):
                self.expr()
                self.need("]")
                kind = "chain" if optional else "member"
            elif t.text == "(" and calls:
                self.next()
                self.arguments()
                kind = "chain" if optional else "call"
            else:
                break
        return kind


_S_STATEMENTS = frozenset("if while do for return throw break continue debugger try switch with".split())


def parse_javascript(text: str) -> list[Fault]:
    p = ScriptParser(text)
    p.errors += [(t.at, "a zero before a number of a module") for t in p.tokens if t.kind == "num" and re.fullmatch(r"0\d[\d_]*\.?[\d_]*", t.text)]
    p.module()
    return p.faults()
