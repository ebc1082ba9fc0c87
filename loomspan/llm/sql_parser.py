"""Parser of PostgreSQL and the PL/pgSQL bodies of its routines, for problem 6."""

from __future__ import annotations

from loomspan.sources import lexers
from loomspan.sources.lexers import Token
from loomspan.llm.parsers import Fault, Parser, Reject

# Reserved words of PostgreSQL; words that name types of several words; statements whose
# rest is only checked for brackets.
_RESERVED = frozenset(
    """all analyse analyze and any array as asc asymmetric both case cast check collate column constraint create current_catalog current_date current_role
    current_time current_timestamp current_user default deferrable desc distinct do else end except false fetch for foreign from grant group having in initially
    intersect into lateral leading limit localtime localtimestamp not null offset on only or order placing primary references returning select session_user some
    symmetric table then to trailing true union unique user using variadic when where window with""".split()
)
# Words that can name functions but neither tables nor columns.
_JOIN_WORDS = frozenset("cross full inner join left natural right ilike is isnull like notnull overlaps similar tablesample".split())
_VALUES = frozenset("current_catalog current_date current_role current_time current_timestamp current_user localtime localtimestamp session_user user true false null default".split())
_LOOSE = frozenset(
    """alter drop grant revoke comment set reset show copy truncate analyze vacuum begin start commit end rollback savepoint release lock listen notify unlisten
    refresh reindex cluster discard prepare execute deallocate declare fetch move close checkpoint load security reassign import abort call explain""".split()
)
_COMPARE = ("<", ">", "=", "<=", ">=", "<>", "!=")
_INTERVAL = frozenset("year month day hour minute second".split())
_HEADS = ("select", "values", "table", "with", "(")


class SqlParser(Parser):
    def __init__(self, text: str, tokens: list[Token] | None = None, plpgsql: bool = False):
        super().__init__(text, tokens if tokens is not None else lexers.sql(text))
        self.tokens = [
            t if t.kind != "id" else (t._replace(kind="qid") if '"' in t.text else t._replace(text=t.text.lower())) for t in self.tokens
        ]
        self.pl = plpgsql

    def sync(self) -> None:
        while self.t.kind != "end" and not self.at(";"):
            self.next()
        self.take(";")

    def phrase(self, *texts: str) -> bool:
        """Whether these words come next; takes them if so."""
        if all(self.ahead(k).text == w if k else self.t.text == w for k, w in enumerate(texts)):
            self.i += len(texts)
            return True
        return False

    def name(self, label: bool = False) -> str:
        t = self.t
        if t.kind == "qid" or (t.kind == "id" and (label or t.text not in _RESERVED)):
            return self.next().text
        raise self.fail(f"expected a name, found {t.text or t.kind!r}")

    def qualified(self) -> str:
        name = self.name()
        while self.take("."):
            name = self.name(label=True)
        return name

    def names(self) -> None:
        self.need("(")
        self.name()
        while self.take(","):
            self.name()
        self.need(")")

    def list_of(self, rule) -> None:
        rule()
        while self.take(","):
            rule()

    def loose(self) -> None:
        """The rest of a statement, whose brackets must match."""
        depth = 0
        while self.t.kind != "end" and not (depth == 0 and self.at(";")):
            if self.at("(", "["):
                depth += 1
            elif self.at(")", "]"):
                depth -= 1
                if depth < 0:
                    raise self.fail("unmatched ')'")
            elif self.at(";"):
                raise self.fail("'(' is never closed")
            self.next()
        if depth:
            raise self.fail("'(' is never closed")

    # statements
    def script(self) -> None:
        while self.t.kind != "end":
            if not self.take(";"):
                self.recover(self.whole_statement, self.sync)

    def whole_statement(self) -> None:
        self.statement()
        if self.t.kind != "end":
            self.need(";")

    def statement(self) -> None:
        t = self.t
        if t.text in _HEADS:
            if t.text == "with":
                self.with_()
                if self.at("insert", "update", "delete", "merge"):
                    self.statement()
                    return
            self.query()
        elif self.at("insert"):
            self.insert()
        elif self.at("update"):
            self.update()
        elif self.at("delete"):
            self.delete()
        elif self.at("merge"):
            self.next()
            self.loose()
        elif self.at("create"):
            self.create()
        elif self.at("alter") and self.ahead().text == "table":
            self.alter_table()
        elif self.at("drop"):
            self.drop()
        elif self.at("do"):
            self.next()
            language = "plpgsql"
            if self.take("language"):
                language = self.next().text
            body = self.next()
            if body.kind not in ("dollar", "str"):
                raise self.fail("expected a body", body.at)
            if self.take("language"):
                language = self.next().text
            self.routine_body(body, language)
        elif self.at("explain"):
            self.next()
            while self.take("analyze", "verbose"):
                pass
            if self.at("(") and self.ahead().text in ("analyze", "verbose", "costs", "buffers", "format", "timing", "settings", "summary", "wal"):
                self.bracketed()
            self.statement()
        elif self.at("call"):
            self.next()
            self.qualified()
            if not self.at("("):
                raise self.fail()
            self.call_arguments()
        elif t.kind == "id" and t.text in _LOOSE:
            self.next()
            if t.text in ("grant", "revoke", "comment", "truncate", "copy", "alter", "set", "reset", "show", "lock", "refresh", "prepare", "savepoint") and (self.at(";") or self.t.kind == "end"):
                raise self.fail()
            if t.text == "comment":
                self.need("on")
                depth = 0
                while not (depth == 0 and self.at("is")):
                    if self.at(";") or self.t.kind == "end":
                        raise self.fail("'IS' is missing")
                    depth += self.at("(") - self.at(")")
                    self.next()
                self.next()
                if not self.take("null"):
                    self.need_kind("str")
                return
            if t.text in ("grant", "revoke"):
                self.grant("to" if t.text == "grant" else "from")
                return
            self.loose()
        else:
            raise self.fail(f"expected a statement, found {t.text or t.kind!r}")

    def grant(self, word: str) -> None:
        depth = 0
        while not (depth == 0 and self.at(word)):
            if self.at(";") or self.t.kind == "end":
                raise self.fail(f"{word.upper()!r} is missing")
            depth += self.at("(") - self.at(")")
            self.next()
        self.next()
        self.name(label=True)
        self.loose()

    def bracketed(self) -> None:
        self.need("(")
        depth = 1
        while depth:
            if self.t.kind == "end" or self.at(";"):
                raise self.fail("'(' is never closed")
            depth += self.at("(") - self.at(")")
            self.next()

    def with_(self) -> None:
        self.need("with")
        self.take("recursive")
        while True:
            self.name()
            if self.at("("):
                self.names()
            self.need("as")
            if self.take("not"):
                self.need("materialized")
            else:
                self.take("materialized")
            self.need("(")
            self.statement()
            self.need(")")
            if self.take("search", "cycle"):
                while not self.at(",", "select", "insert", "update", "delete", "values", "("):
                    if self.t.kind == "end":
                        raise self.fail()
                    self.next()
            if not self.take(","):
                return

    def query(self) -> None:
        self.deeper()
        if self.at("with"):
            self.with_()
        self.query_term()
        while self.take("union", "intersect", "except"):
            self.take("all", "distinct")
            self.query_term()
        if self.phrase("order", "by"):
            self.list_of(self.sort_item)
        while True:
            if self.take("limit"):
                if not self.take("all"):
                    self.expr()
                if self.take(","):
                    raise self.fail("LIMIT #,# is not supported")
            elif self.take("offset"):
                self.expr()
                self.take("row", "rows")
            elif self.at("fetch") and self.ahead().text in ("first", "next"):
                self.next()
                self.next()
                if not self.at("row", "rows"):
                    self.unary()
                if not self.take("row", "rows"):
                    raise self.fail()
                if not self.take("only"):
                    self.need("with")
                    self.need("ties")
            elif self.at("for") and self.ahead().text in ("update", "share", "no", "key"):
                self.next()
                self.phrase("no", "key")
                self.take("key")
                if not self.take("update", "share"):
                    raise self.fail()
                if self.take("of"):
                    self.list_of(self.qualified)
                if not self.take("nowait"):
                    self.phrase("skip", "locked")
            else:
                break
        self.depth -= 1

    def sort_item(self) -> None:
        self.expr()
        if self.take("using"):
            self.need_kind("op")
        else:
            self.take("asc", "desc")
        if self.take("nulls") and not self.take("first", "last"):
            raise self.fail()

    def query_term(self) -> None:
        if self.take("("):
            self.query()
            self.need(")")
        elif self.take("values"):
            self.list_of(self.row)
        elif self.take("table"):
            self.take("only")
            self.qualified()
        else:
            self.select()

    def row(self) -> None:
        self.need("(")
        self.list_of(self.expr)
        self.need(")")

    def into(self) -> None:
        if self.take("into"):
            if self.pl:
                self.take("strict")
                self.list_of(self.target)
            else:
                self.take("temporary", "temp", "unlogged")
                self.take("table")
                self.qualified()

    def select(self) -> None:
        self.need("select")
        if self.take("all"):
            pass
        elif self.take("distinct") and self.take("on"):
            self.row()
        self.into()
        if not self.at("from", ")", ";", "where", "union", "group", "order", "limit", "into", "having") and self.t.kind != "end":
            self.list_of(self.select_item)
        self.into()
        if self.take("from"):
            self.list_of(self.joined)
        self.into()
        if self.take("where"):
            self.expr()
        if self.phrase("group", "by"):
            self.take("all", "distinct")
            self.list_of(self.group_item)
        if self.take("having"):
            self.expr()
        if self.take("window"):
            self.list_of(self.window)
        self.into()

    def select_item(self) -> None:
        if self.take("*"):
            return
        self.expr()
        if self.take("as"):
            self.name(label=True)
        elif self.t.kind == "qid" or (self.t.kind == "id" and self.t.text not in _RESERVED and self.t.text not in _JOIN_WORDS and self.t.text not in ("over", "filter", "within")):
            self.next()

    def group_item(self) -> None:
        if self.take("grouping"):
            self.need("sets")
            self.need("(")
            self.list_of(self.group_item)
            self.need(")")
        elif self.at("(") and self.ahead().text == ")":
            self.next()
            self.next()
        else:
            self.expr()

    def window(self) -> None:
        self.name()
        self.need("as")
        self.over_body()

    def over_body(self) -> None:
        self.need("(")
        if self.t.kind in ("id", "qid") and self.t.text not in ("partition", "order", "range", "rows", "groups"):
            self.name()
        if self.phrase("partition", "by"):
            self.list_of(self.expr)
        if self.phrase("order", "by"):
            self.list_of(self.sort_item)
        if self.take("range", "rows", "groups"):
            between = self.take("between")
            self.frame_bound()
            if between:
                self.need("and")
                self.frame_bound()
            if self.take("exclude"):
                self.next()
                self.take("row", "others")
        self.need(")")

    def frame_bound(self) -> None:
        if self.phrase("current", "row"):
            return
        if not self.take("unbounded"):
            self.binary(5)
        if not self.take("preceding", "following"):
            raise self.fail()

    def joined(self) -> None:
        self.from_item()
        while True:
            if self.take("natural"):
                self.join_word()
                self.from_item()
            elif self.take("cross"):
                self.need("join")
                self.from_item()
            elif self.at("join", "inner", "left", "right", "full"):
                self.join_word()
                self.joined_right()
            else:
                return

    def join_word(self) -> None:
        if not self.take("inner") and self.take("left", "right", "full"):
            self.take("outer")
        self.need("join")

    def joined_right(self) -> None:
        self.from_item()
        if self.take("on"):
            self.expr()
        elif self.take("using"):
            self.names()
            if self.take("as"):
                self.name()
        else:
            # a join nested on the right has its condition later
            self.join_word()
            self.joined_right()
            self.need("on")
            self.expr()

    def from_item(self) -> None:
        self.deeper()
        self.take("lateral")
        if self.at("("):
            if not self.try_(self.subquery):
                self.need("(")
                self.joined()
                self.need(")")
        elif self.phrase("rows", "from"):
            self.bracketed()
        else:
            self.take("only")
            self.qualified()
            self.take("*")
            if self.at("("):
                self.call_arguments()
                if self.take("with"):
                    self.need("ordinality")
        aliased = self.take("as")
        if aliased and self.at("("):
            self.columns()
        elif aliased or self.t.kind == "qid" or (self.t.kind == "id" and self.t.text not in _RESERVED and self.t.text not in _JOIN_WORDS and self.t.text not in ("set", "loop")):
            self.name()
            if self.at("("):
                self.columns()
        if self.take("tablesample"):
            self.qualified()
            self.row()
            if self.take("repeatable"):
                self.row()
        self.depth -= 1

    def columns(self) -> None:
        self.need("(")
        while True:
            self.name()
            if not self.at(",", ")"):
                self.type_()
            if not self.take(","):
                break
        self.need(")")

    def subquery(self) -> None:
        self.need("(")
        if not self.at(*_HEADS):
            raise self.fail()
        self.query()
        self.need(")")

    def insert(self) -> None:
        self.need("insert")
        self.need("into")
        self.qualified()
        if self.take("as"):
            self.name()
        if self.at("(") and self.ahead().text not in ("select", "with", "values", "("):
            self.need("(")
            self.list_of(self.set_target)
            self.need(")")
        if self.take("overriding"):
            self.next()
            self.need("value")
        if self.phrase("default", "values"):
            pass
        else:
            self.query()
        if self.phrase("on", "conflict"):
            if self.take("("):
                while True:
                    self.expr()
                    self.take("asc", "desc")
                    if not self.take(","):
                        break
                self.need(")")
                if self.take("where"):
                    self.expr()
            elif self.take("on"):
                self.need("constraint")
                self.name()
            self.need("do")
            if not self.take("nothing"):
                self.need("update")
                self.need("set")
                self.list_of(self.set_item)
                if self.take("where"):
                    self.expr()
        self.returning()

    def returning(self) -> None:
        if self.take("returning"):
            self.list_of(self.select_item)
            self.into()

    def set_target(self) -> None:
        self.name()
        while self.at(".", "["):
            if self.take("."):
                self.name(label=True)
            else:
                self.next()
                self.expr()
                self.need("]")

    def set_item(self) -> None:
        if self.take("("):
            self.list_of(self.set_target)
            self.need(")")
        else:
            self.set_target()
        self.need("=")
        self.expr()

    def table_alias(self) -> None:
        self.take("only")
        self.qualified()
        self.take("*")
        if self.take("as") or (self.t.kind in ("id", "qid") and self.t.text not in _RESERVED and self.t.text != "set"):
            self.name()

    def update(self) -> None:
        self.need("update")
        self.table_alias()
        self.need("set")
        self.list_of(self.set_item)
        if self.take("from"):
            self.list_of(self.joined)
        self.where_or_cursor()
        self.returning()

    def where_or_cursor(self) -> None:
        if self.take("where"):
            if self.phrase("current", "of"):
                self.name()
            else:
                self.expr()

    def delete(self) -> None:
        self.need("delete")
        self.need("from")
        self.table_alias()
        if self.take("using"):
            self.list_of(self.joined)
        self.where_or_cursor()
        self.returning()

    # definitions
    def create(self) -> None:
        self.need("create")
        if self.take("or"):
            self.need("replace")
        if self.take("global", "local"):
            pass
        temporary = self.take("temporary", "temp", "unlogged")
        if self.take("table"):
            self.create_table()
        elif self.take("recursive") or self.at("view"):
            self.need("view")
            self.create_view()
        elif self.take("materialized"):
            self.need("view")
            self.phrase("if", "not", "exists")
            self.create_view()
            if self.take("with"):
                self.take("no")
                self.need("data")
        elif self.at("unique", "index"):
            self.take("unique")
            self.need("index")
            self.create_index()
        elif self.take("function", "procedure"):
            self.routine()
        elif self.take("constraint"):
            self.need("trigger")
            self.trigger()
        elif self.take("trigger"):
            self.trigger()
        elif self.at("sequence", "schema", "type", "domain", "extension", "role", "user", "group", "policy", "rule", "aggregate", "operator", "cast", "collation",
                     "conversion", "database", "event", "foreign", "language", "trusted", "procedural", "publication", "subscription", "server", "statistics",
                     "tablespace", "text", "transform", "access", "default"):
            kind = self.next().text
            if temporary and kind != "sequence":
                raise self.fail()
            self.phrase("if", "not", "exists")
            if kind in ("sequence", "type", "domain", "extension"):
                self.qualified()
            if kind == "domain":
                self.take("as")
                self.type_()
                self.column_constraints()
            elif kind == "type":
                self.create_type()
            else:
                if self.at(";") and kind not in ("sequence", "schema", "extension"):
                    raise self.fail()
                self.loose()
        else:
            raise self.fail(f"cannot create {self.t.text or self.t.kind!r}")

    def create_type(self) -> None:
        if not self.take("as"):
            self.loose()
            return
        if self.take("enum"):
            self.need("(")
            if not self.at(")"):
                self.list_of(lambda: self.need_kind("str"))
            self.need(")")
        elif self.take("range"):
            self.bracketed()
        else:
            self.need("(")
            while not self.at(")"):
                self.name()
                self.type_()
                if self.take("collate"):
                    self.qualified()
                if not self.take(","):
                    break
            self.need(")")

    def create_table(self) -> None:
        self.phrase("if", "not", "exists")
        self.qualified()
        if self.phrase("partition", "of"):
            self.qualified()
            self.loose()
            return
        if self.take("of"):
            self.loose()
            return
        if self.at("("):

            def plain_names() -> None:
                self.names()
                if not self.at("as", "using", "with", "on", "tablespace"):
                    raise self.fail()

            if not self.try_(plain_names):
                self.need("(")
                if not self.at(")"):
                    self.list_of(self.table_element)
                self.need(")")
        elif not self.at("as", "using", "with", "on", "tablespace"):
            raise self.fail()
        while True:
            if self.take("inherits"):
                self.bracketed()
            elif self.phrase("partition", "by"):
                if not self.take("range", "list", "hash"):
                    raise self.fail()
                self.bracketed()
            elif self.take("using", "tablespace"):
                self.name()
            elif self.take("with"):
                self.bracketed()
            elif self.phrase("without", "oids"):
                pass
            elif self.phrase("on", "commit"):
                self.next()
                self.take("rows")
            elif self.take("as"):
                if self.take("execute"):
                    self.loose()
                    return
                self.query()
                if self.take("with"):
                    self.take("no")
                    self.need("data")
            else:
                return

    def table_element(self) -> None:
        if self.at("constraint", "primary", "unique", "check", "foreign", "exclude"):
            self.table_constraint()
        elif self.take("like"):
            self.qualified()
            while self.take("including", "excluding"):
                self.next()
        else:
            self.name()
            self.type_()
            self.column_constraints()

    def table_constraint(self) -> None:
        if self.take("constraint"):
            self.name()
        if self.phrase("primary", "key") or self.take("unique"):
            if self.phrase("nulls", "not", "distinct"):
                pass
            if self.take("using"):
                self.need("index")
                self.name()
            else:
                self.names()
                if self.take("include"):
                    self.names()
        elif self.take("check"):
            self.need("(")
            self.expr()
            self.need(")")
        elif self.phrase("foreign", "key"):
            self.names()
            self.references()
        elif self.take("exclude"):
            if self.take("using"):
                self.name()
            self.bracketed()
            if self.take("where"):
                self.bracketed()
        else:
            raise self.fail()
        self.deferring()

    def deferring(self) -> None:
        while True:
            if self.take("with"):
                self.bracketed()
            elif self.phrase("using", "index", "tablespace"):
                self.name()
            elif self.take("deferrable") or self.phrase("not", "deferrable") or self.phrase("not", "valid") or self.phrase("no", "inherit"):
                pass
            elif self.take("initially"):
                if not self.take("deferred", "immediate"):
                    raise self.fail()
            else:
                return

    def references(self) -> None:
        self.need("references")
        self.qualified()
        if self.at("("):
            self.names()
        while True:
            if self.take("match"):
                if not self.take("full", "partial", "simple"):
                    raise self.fail()
            elif self.take("on"):
                if not self.take("delete", "update"):
                    raise self.fail()
                if self.take("set"):
                    if not self.take("null", "default"):
                        raise self.fail()
                    if self.at("("):
                        self.names()
                elif self.take("no"):
                    self.need("action")
                elif not self.take("cascade", "restrict"):
                    raise self.fail()
            else:
                return

    def column_constraints(self) -> None:
        while True:
            if self.take("constraint"):
                self.name()
            if self.phrase("not", "null") or self.take("null"):
                self.phrase("no", "inherit")
            elif self.take("default"):
                self.binary(5)
            elif self.phrase("primary", "key") or self.take("unique"):
                self.phrase("nulls", "not", "distinct")
            elif self.take("check"):
                self.need("(")
                self.expr()
                self.need(")")
            elif self.at("references"):
                self.references()
            elif self.take("collate"):
                self.qualified()
            elif self.take("storage", "compression"):
                self.next()
            elif self.take("generated"):
                if not self.take("always"):
                    self.need("by")
                    self.need("default")
                self.need("as")
                if self.take("identity"):
                    if self.at("("):
                        self.bracketed()
                else:
                    self.need("(")
                    self.expr()
                    self.need(")")
                    self.need("stored")
            else:
                start = self.i
                self.deferring()
                if self.i == start:
                    return

    def type_(self) -> None:
        self.take("setof")
        if self.take("double"):
            self.need("precision")
        elif self.take("national"):
            if not self.take("character", "char"):
                raise self.fail()
            self.take("varying")
        elif self.take("character", "char", "bit"):
            self.take("varying")
        elif self.take("interval"):
            if self.t.text in _INTERVAL:
                self.next()
                if self.take("to"):
                    self.next()
        elif self.t.text == "table" and self.ahead().text == "(":
            self.next()
            self.columns()
            return
        else:
            self.qualified()
        if self.at("("):
            self.need("(")
            self.list_of(self.expr)
            self.need(")")
        if self.at("with", "without") and self.ahead().text == "time":
            self.next()
            self.next()
            self.need("zone")
        if self.take("%"):
            self.name(label=True)
        if self.take("array"):
            if self.take("["):
                self.need_kind("num")
                self.need("]")
        while self.take("["):
            if self.t.kind == "num":
                self.next()
            self.need("]")

    def create_view(self) -> None:
        self.qualified()
        if self.at("("):
            self.names()
        if self.take("using"):
            self.name()
        if self.take("with"):
            self.bracketed()
        if self.take("tablespace"):
            self.name()
        self.need("as")
        self.query()
        if self.at("with") and self.ahead().text in ("check", "cascaded", "local"):
            self.next()
            self.take("cascaded", "local")
            self.need("check")
            self.need("option")

    def create_index(self) -> None:
        self.take("concurrently")
        self.phrase("if", "not", "exists")
        if not self.at("on"):
            self.qualified()
        self.need("on")
        self.take("only")
        self.qualified()
        if self.take("using"):
            self.name()
        self.need("(")
        self.list_of(self.index_item)
        self.need(")")
        if self.take("include"):
            self.names()
        if self.phrase("nulls", "not", "distinct") or self.phrase("nulls", "distinct"):
            pass
        if self.take("with"):
            self.bracketed()
        if self.take("tablespace"):
            self.name()
        if self.take("where"):
            self.expr()

    def index_item(self) -> None:
        self.expr()
        if self.take("collate"):
            self.qualified()
        if self.t.kind in ("id", "qid") and not self.at("asc", "desc", "nulls"):
            self.qualified()
            if self.at("("):
                self.bracketed()
        self.take("asc", "desc")
        if self.take("nulls") and not self.take("first", "last"):
            raise self.fail()

    def trigger(self) -> None:
        self.name()
        if not self.take("before", "after"):
            self.need("instead")
            self.need("of")
        while True:
            if not self.take("insert", "delete", "truncate"):
                self.need("update")
                if self.take("of"):
                    self.list_of(self.name)
            if not self.take("or"):
                break
        self.need("on")
        self.qualified()
        while not self.at("execute"):
            if self.take("from"):
                self.qualified()
            elif self.take("for"):
                self.take("each")
                if not self.take("row", "statement"):
                    raise self.fail()
            elif self.take("when"):
                self.need("(")
                self.expr()
                self.need(")")
            elif self.take("referencing"):
                while self.take("old", "new"):
                    self.need("table")
                    self.take("as")
                    self.name()
            elif self.at("deferrable", "not", "initially"):
                self.deferring()
            else:
                raise self.fail()
        self.next()
        if not self.take("function", "procedure"):
            raise self.fail()
        self.qualified()
        self.call_arguments()

    def routine(self) -> None:
        self.qualified()
        self.need("(")
        if not self.at(")"):
            self.list_of(self.routine_parameter)
        self.need(")")
        language, body = "sql", None
        while not self.at(";") and self.t.kind != "end":
            if self.take("returns"):
                if self.phrase("null", "on", "null", "input"):
                    continue
                self.type_()
            elif self.take("language"):
                t = self.next()
                if t.kind not in ("id", "qid", "str"):
                    raise self.fail(at=t.at)
                language = t.text.strip("'\"").lower()
            elif self.take("as"):
                body = self.next()
                if body.kind not in ("dollar", "str"):
                    raise self.fail("expected a body", body.at)
                if self.take(","):
                    self.need_kind("str")
            elif self.at("begin") and self.ahead().text == "atomic":
                self.next()
                self.next()
                while not self.at("end"):
                    self.statement()
                    self.need(";")
                self.next()
                body = self.t
            elif self.take("return"):
                self.expr()
                body = self.t
            elif self.take("set"):
                self.qualified()
                if not self.take("from"):
                    if not self.take("to"):
                        self.need("=")
                    self.list_of(self.expr)
                else:
                    self.need("current")
            elif self.take("cost", "rows"):
                self.need_kind("num")
            elif self.take("support"):
                self.qualified()
            elif self.take("parallel"):
                if not self.take("safe", "unsafe", "restricted"):
                    raise self.fail()
            elif self.take("transform"):
                self.loose()
            elif self.take("immutable", "stable", "volatile", "strict", "window", "leakproof") or self.phrase("not", "leakproof") or self.phrase("called", "on", "null", "input") or self.phrase("external", "security", "definer") or self.phrase("external", "security", "invoker") or self.phrase("security", "definer") or self.phrase("security", "invoker"):
                pass
            else:
                raise self.fail()
        if body is None:
            raise self.fail("the routine has no body")
        if body.kind in ("dollar", "str"):
            self.routine_body(body, language)

    def routine_parameter(self) -> None:
        def with_mode() -> None:
            if not self.take("in", "out", "inout", "variadic"):
                raise self.fail()
            if self.at(",", ")"):
                raise self.fail()

        self.try_(with_mode)

        def named() -> None:
            self.name()
            self.take("in", "out", "inout", "variadic")
            self.type_()
            if not self.at(",", ")", "=", "default", ":="):
                raise self.fail()

        if not self.try_(named):
            self.type_()
        if self.take("default", "=", ":="):
            self.expr()

    def routine_body(self, body: Token, language: str) -> None:
        if body.kind == "dollar":
            tag = body.text.index("$", 1) + 1
            text, at = body.text[tag:-tag], body.at + tag
        else:
            text, at = body.text[1:-1].replace("''", "'"), body.at + 1
        if language not in ("plpgsql", "sql"):
            return
        inner = SqlParser(text, plpgsql=language == "plpgsql")
        if language == "plpgsql":
            inner.recover(inner.pl_body, inner.sync)
        else:
            inner.script()
        self.errors += [(at + a, m) for a, m in inner.errors]

    def alter_table(self) -> None:
        self.next()
        self.next()
        self.phrase("if", "exists")
        self.take("only")
        self.qualified()
        self.take("*")
        self.list_of(self.alter_action)

    def alter_action(self) -> None:
        if self.take("add"):
            if self.at("constraint", "primary", "unique", "check", "foreign", "exclude"):
                self.table_constraint()
            else:
                self.take("column")
                self.phrase("if", "not", "exists")
                self.name()
                self.type_()
                self.column_constraints()
        elif self.at("drop", "alter", "rename", "set", "reset", "enable", "disable", "owner", "attach", "detach", "inherit", "no", "validate", "cluster", "replica", "force", "of", "not"):
            self.next()
            depth, n = 0, 0
            while self.t.kind != "end" and not self.at(";") and not (depth == 0 and self.at(",")):
                depth += self.at("(") - self.at(")")
                if depth < 0:
                    raise self.fail("unmatched ')'")
                self.next()
                n += 1
            if depth or not n:
                raise self.fail()
        else:
            raise self.fail()

    def drop(self) -> None:
        self.next()
        start = self.i
        while self.t.kind == "id" and not self.at("if") and self.ahead().text not in (".", ",", ";", "(") and self.ahead().kind in ("id", "qid"):
            self.next()
        self.phrase("if", "exists")
        if self.i == start:
            raise self.fail()
        self.qualified()
        self.loose()

    # PL/pgSQL
    def pl_body(self) -> None:
        while self.take("#"):
            self.next()
            self.next()
        self.pl_block()
        self.take(";")
        if self.t.kind != "end":
            raise self.fail("text behind the last END")

    def pl_label(self) -> None:
        if self.take("<<"):
            self.name()
            self.need(">>")

    def pl_block(self) -> None:
        self.deeper()
        self.pl_label()
        while self.take("declare"):
            while not self.at("begin", "declare"):
                if self.t.kind == "end":
                    raise self.fail("BEGIN is missing")
                self.recover(self.pl_declaration, self.sync)
        self.need("begin")
        self.pl_statements("end", "exception")
        if self.take("exception"):
            while self.take("when"):
                while True:
                    if self.take("sqlstate"):
                        self.need_kind("str")
                    else:
                        self.name()
                    if not self.take("or"):
                        break
                self.need("then")
                self.pl_statements("when", "end")
        self.need("end")
        if not self.at(";") and self.t.kind in ("id", "qid"):
            self.name()
        self.depth -= 1

    def pl_statements(self, *stops: str) -> None:
        while not self.at(*stops):
            if self.t.kind == "end":
                raise self.fail("END is missing")
            self.recover(self.pl_statement, self.sync)

    def pl_declaration(self) -> None:
        self.name()
        if self.phrase("alias", "for"):
            self.next()
            self.need(";")
            return
        self.phrase("no", "scroll")
        self.take("scroll")
        if self.take("cursor"):
            if self.take("("):
                self.list_of(lambda: (self.name(), self.type_()))
                self.need(")")
            if not self.take("for", "is"):
                raise self.fail()
            self.query()
            self.need(";")
            return
        self.take("constant")
        self.type_()
        if self.take("collate"):
            self.qualified()
        self.phrase("not", "null")
        if self.take(":=", "=", "default"):
            self.expr()
        self.need(";")

    def target(self) -> None:
        if self.t.kind == "num" and self.t.text[0] == "$":
            self.next()
        else:
            self.name()
        while self.at(".", "["):
            if self.take("."):
                self.name(label=True)
            else:
                self.next()
                self.expr()
                if self.take(":"):
                    self.expr()
                self.need("]")

    def pl_statement(self) -> None:
        t = self.t
        if self.take(";"):
            raise self.fail("empty statement", t.at)
        if self.at("<<"):
            start = self.i
            self.pl_label()
            if self.at("loop", "while", "for", "foreach"):
                pass
            else:
                self.i = start
                self.pl_block()
                self.need(";")
                return
        if self.at("begin", "declare"):
            self.pl_block()
        elif self.take("if"):
            self.deeper()
            self.expr()
            self.need("then")
            self.pl_statements("elsif", "elseif", "else", "end")
            while self.take("elsif", "elseif"):
                self.expr()
                self.need("then")
                self.pl_statements("elsif", "elseif", "else", "end")
            if self.take("else"):
                self.pl_statements("end")
            self.need("end")
            self.need("if")
            self.depth -= 1
        elif self.take("case"):
            if not self.at("when"):
                self.expr()
            if not self.at("when"):
                raise self.fail()
            while self.take("when"):
                self.list_of(self.expr)
                self.need("then")
                self.pl_statements("when", "else", "end")
            if self.take("else"):
                self.pl_statements("end")
            self.need("end")
            self.need("case")
        elif self.at("loop"):
            self.pl_loop()
        elif self.take("while"):
            self.expr()
            self.pl_loop()
        elif self.take("for"):
            self.list_of(self.target)
            self.need("in")
            if self.take("execute"):
                self.expr()
                if self.take("using"):
                    self.list_of(self.expr)
            elif self.at("select", "with", "values", "insert", "update", "delete"):
                self.statement()
            else:
                self.take("reverse")
                self.expr()
                if self.take(".."):
                    self.expr()
                    if self.take("by"):
                        self.expr()
            self.pl_loop()
        elif self.take("foreach"):
            self.list_of(self.target)
            if self.take("slice"):
                self.need_kind("num")
            self.need("in")
            self.need("array")
            self.expr()
            self.pl_loop()
        elif self.at("exit", "continue"):
            self.next()
            if self.t.kind in ("id", "qid") and not self.at("when"):
                self.name()
            if self.take("when"):
                self.expr()
        elif self.take("return"):
            if self.take("query"):
                if self.take("execute"):
                    self.expr()
                    if self.take("using"):
                        self.list_of(self.expr)
                else:
                    self.statement()
            elif self.take("next"):
                if not self.at(";"):
                    self.expr()
            elif not self.at(";"):
                self.expr()
        elif self.take("raise"):
            self.take("debug", "log", "info", "notice", "warning", "exception")
            if self.t.kind == "str":
                self.next()
                while self.take(","):
                    self.expr()
            elif self.take("sqlstate"):
                self.need_kind("str")
            elif not self.at(";", "using"):
                self.name()
            if self.take("using"):
                while True:
                    self.name(label=True)
                    if not self.take("=", ":="):
                        raise self.fail()
                    self.expr()
                    if not self.take(","):
                        break
        elif self.take("assert"):
            self.list_of(self.expr)
        elif self.take("perform"):
            self.take("distinct", "all")
            self.list_of(self.select_item)
            if self.take("from"):
                self.list_of(self.joined)
            if self.take("where"):
                self.expr()
            if self.phrase("group", "by"):
                self.list_of(self.group_item)
            if self.take("having"):
                self.expr()
            if self.phrase("order", "by"):
                self.list_of(self.sort_item)
            if self.take("limit"):
                self.expr()
            if self.at("union", "for", "offset"):
                self.loose()
        elif self.take("execute"):
            self.expr()
            for _ in range(2):
                self.into()
                if self.take("using"):
                    self.list_of(self.expr)
        elif self.at("get"):
            self.next()
            self.take("current", "stacked")
            self.need("diagnostics")
            while True:
                self.target()
                if not self.take("=", ":="):
                    raise self.fail()
                self.name(label=True)
                if not self.take(","):
                    break
        elif self.take("null"):
            pass
        elif self.at("open", "close", "fetch", "move", "commit", "rollback", "set"):
            self.next()
            self.loose()
        elif t.text in ("select", "values", "with", "insert", "update", "delete", "merge", "create", "drop", "alter", "truncate", "call", "lock", "grant", "revoke", "comment", "refresh", "analyze", "copy", "notify", "do", "table", "reset", "explain", "vacuum", "reindex", "cluster", "listen") and self.ahead().text not in (":=", "="):
            self.statement()
        else:
            self.target()
            if not self.take(":=", "="):
                raise self.fail()
            self.expr()
            if self.at("from", "where", "order", "limit", "union"):
                if self.take("from"):
                    self.list_of(self.joined)
                self.loose()
        self.need(";")

    def pl_loop(self) -> None:
        self.deeper()
        self.need("loop")
        self.pl_statements("end")
        self.need("end")
        self.need("loop")
        if self.t.kind in ("id", "qid"):
            self.name()
        self.depth -= 1

    # expressions
    def expr(self) -> str:
        return self.binary(1)

    def binary(self, least: int) -> str:
        """Precedence climbing: or 1, and 2, not 3, is 4, comparison 5, between in like 6, other operators 7,
        sums 8, products 9, powers 10, at time zone 11, collate 12."""
        self.deeper()
        if self.at("not") and least <= 3:
            self.next()
            self.binary(3)
        else:
            self.unary()
        while True:
            t = self.t
            if t.kind == "op":
                rank = 5 if t.text in _COMPARE else 8 if t.text in ("+", "-") else 9 if t.text in ("*", "/", "%") else 10 if t.text == "^" else 0 if t.text in (":=", "=>", "..", "::", ",", ";", ".", ":", "(", ")", "[", "]") else 7
                if not rank or rank < least:
                    break
                self.next()
                if self.take("any", "all", "some"):
                    self.need("(")
                    self.query() if self.at("select", "with", "values") else self.expr()
                    self.need(")")
                else:
                    self.binary(rank + 1)
                continue
            if t.kind != "id":
                break
            negated = t.text == "not" and self.ahead().text in ("in", "like", "ilike", "similar", "between")
            word = self.ahead().text if negated else t.text
            if word in ("or", "and") and least <= (1 if word == "or" else 2):
                self.next()
                self.binary(2 if word == "or" else 3)
            elif word == "is" and least <= 4:
                self.next()
                self.take("not")
                if self.take("distinct"):
                    self.need("from")
                    self.binary(5)
                elif not self.take("null", "true", "false", "unknown", "document", "normalized", "nfc", "nfd", "nfkc", "nfkd"):
                    raise self.fail()
            elif word in ("isnull", "notnull") and least <= 4:
                self.next()
            elif word in ("in", "like", "ilike", "similar", "between") and least <= 6:
                if negated:
                    self.next()
                self.next()
                if word == "in":
                    self.need("(")
                    self.query() if self.at("select", "with", "values") else self.list_of(self.expr)
                    self.need(")")
                elif word == "between":
                    self.take("symmetric", "asymmetric")
                    self.binary(7)
                    self.need("and")
                    self.binary(7)
                else:
                    if word == "similar":
                        self.need("to")
                    if self.take("any", "all", "some"):
                        self.need("(")
                        self.expr()
                        self.need(")")
                    else:
                        self.binary(7)
                    if self.take("escape"):
                        self.binary(7)
            elif word == "operator" and self.ahead().text == "(" and least <= 7:
                self.next()
                self.bracketed()
                self.binary(8)
            elif word == "at" and self.ahead().text in ("time", "local") and least <= 11:
                self.next()
                if self.next().text == "time":
                    self.need("zone")
                    self.binary(12)
            elif word == "collate" and least <= 12:
                self.next()
                self.qualified()
            elif word == "overlaps" and least <= 6:
                self.next()
                self.binary(7)
            else:
                break
        self.depth -= 1
        return ""

    def unary(self) -> None:
        if self.t.kind == "op" and self.t.text not in ("(", ")", "[", "]", ",", ";", ".", ":", "::", ":=", "=>", "..", "*", "=", "<", ">", "<=", ">=", "<>", "!="):
            self.next()
            self.deeper()
            self.unary()
            self.depth -= 1
            return
        self.primary()
        while True:
            if self.take("::"):
                self.type_()
            elif self.take("["):
                if not self.at(":"):
                    self.expr()
                if self.take(":") and not self.at("]"):
                    self.expr()
                self.need("]")
            elif self.at(".") and self.ahead().kind in ("id", "qid", "op") and self.ahead().text not in (".",):
                self.next()
                if not self.take("*"):
                    self.name(label=True)
                    if self.at("("):
                        self.call_arguments()
            else:
                return

    def call_arguments(self) -> None:
        self.need("(")
        if self.take("*"):
            self.need(")")
            return
        self.take("all", "distinct")
        if not self.at(")"):
            while True:
                self.take("variadic")
                if self.t.kind in ("id", "qid") and self.ahead().text in ("=>", ":="):
                    self.name()
                    self.next()
                self.expr()
                if not self.take(","):
                    break
            if self.phrase("order", "by"):
                self.list_of(self.sort_item)
        self.need(")")

    def call_tail(self) -> None:
        if self.phrase("within", "group"):
            self.need("(")
            self.need("order")
            self.need("by")
            self.list_of(self.sort_item)
            self.need(")")
        if self.at("filter") and self.ahead().text == "(":
            self.next()
            self.need("(")
            self.need("where")
            self.expr()
            self.need(")")
        if self.phrase("ignore", "nulls") or self.phrase("respect", "nulls"):
            pass
        if self.take("over"):
            if self.at("("):
                self.over_body()
            else:
                self.name()

    def primary(self) -> None:
        t = self.t
        if t.kind in ("num", "dollar"):
            self.next()
            return
        if t.kind == "str":
            self.next()
            while self.t.kind == "str" and self.t.nl:
                self.next()
            return
        if t.text == "(" and t.kind == "op":
            self.deeper()
            if not self.try_(self.subquery):
                self.need("(")
                self.list_of(self.expr)
                self.need(")")
            self.depth -= 1
            return
        if t.text == "*" and t.kind == "op" and False:
            return
        if t.kind == "id":
            if t.text in _VALUES:
                self.next()
                if self.at("(") and t.text in ("current_time", "current_timestamp", "localtime", "localtimestamp"):
                    self.bracketed()
                return
            if t.text == "case":
                self.case()
                return
            if t.text == "exists" and self.ahead().text == "(":
                self.next()
                self.subquery()
                return
            if t.text == "array":
                self.next()
                if self.at("("):
                    self.subquery()
                else:
                    self.array()
                return
            if t.text == "row" and self.ahead().text == "(":
                self.next()
                self.call_arguments()
                return
            if t.text in ("cast", "treat") and self.ahead().text == "(":
                self.next()
                self.need("(")
                self.expr()
                self.need("as")
                self.type_()
                self.need(")")
                return
            if self.ahead().text == "(" and t.text in ("extract", "position", "substring", "overlay", "trim", "xmlelement", "xmlforest", "json_table", "xmltable", "json_object", "json_array", "json_value", "json_query", "json_exists", "xmlparse", "xmlserialize", "normalize", "collation"):
                self.special_call()
                return
            if t.text == "interval" and self.ahead().kind == "str":
                self.next()
                self.next()
                if self.t.text in _INTERVAL:
                    self.next()
                    if self.take("to"):
                        self.next()
                return
        if t.kind in ("id", "qid"):
            self.name()
            if self.t.kind == "str" and t.text not in _JOIN_WORDS:  # a typed literal
                self.next()
                return
            if t.text in ("timestamp", "time") and self.at("with", "without") and self.ahead().text == "time":
                self.next()
                self.next()
                self.need("zone")
                self.need_kind("str")
                return
            if t.text == "double" and self.at("precision"):
                self.next()
                self.need_kind("str")
                return
            while self.at(".") and (self.ahead().kind in ("id", "qid")):
                self.next()
                self.name(label=True)
            if self.at("("):
                self.call_arguments()
                self.call_tail()
            return
        raise self.fail("expected an expression, found " + (t.text or t.kind))

    def array(self) -> None:
        self.need("[")
        if not self.at("]"):
            if self.at("["):
                self.list_of(self.array)
            else:
                self.list_of(self.expr)
        self.need("]")

    def special_call(self) -> None:
        """Calls with words between their arguments."""
        self.next()
        self.need("(")
        if self.at("both", "leading", "trailing"):
            self.next()
        if not self.at("from", ")"):
            self.binary(7)
        while not self.at(")"):
            if self.at(";") or self.t.kind == "end":
                raise self.fail("'(' is never closed")
            if self.take(",", "from", "for", "in", "placing", "similar", "escape", "as", "passing", "columns", "returning", "name", "on", "null", "default", "error", "empty", "value", "key", ":"):
                continue
            self.binary(5)
        self.need(")")

    def case(self) -> None:
        self.need("case")
        self.deeper()
        if not self.at("when"):
            self.expr()
        if not self.at("when"):
            raise self.fail()
        while self.take("when"):
            self.expr()
            self.need("then")
            self.expr()
        if self.take("else"):
            self.expr()
        self.need("end")
        self.depth -= 1


def parse_sql(text: str) -> list[Fault]:
    p = SqlParser(text)
    if p.t.kind == "end" and not p.errors:
        return []
    try:
        p.script()
    except Reject as e:  # never by way of recover()
        p.errors.append((e.at, e.message))
    return p.faults()
