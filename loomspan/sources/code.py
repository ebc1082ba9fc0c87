"""Source code as records: entities, imports, calls, annotations, database objects.

Python is read through the standard library's syntax tree; Java, JavaScript and SQL through the shared
lexers, by structure: what isn't understood is skipped.
"""

from __future__ import annotations

import ast
import json
import posixpath
import re
from collections.abc import Iterator
from typing import Any

from loomspan.sources import lexers, sqlscan
from loomspan.sources.documents import Record, sha
from loomspan.sources.lexers import Token


def entity(path: str, language: str, qualified: str, name: str, kind: str, line: int, end: int, parent: str | None = None, **more: Any) -> Record:
    summary = " ".join(x for x in (name, more.get("signature"), more.get("docstring")) if x)
    return "entity", {"qualified_name": qualified, "name": name, "kind": kind, "language": language, "file_path": path, "start_line": line, "end_line": end,
                      "parent_qualified_name": parent, "synthetic": False, "embed_text": summary, "calls": [], "imports": [], "extends": [], "implements": [], **more}


def _unique(items: list[str]) -> list[str]:
    return list(dict.fromkeys(items))


def module_name(path: str) -> str:
    parts = re.sub(r"\.pyi?$", "", path).split("/")
    if "src" in parts:
        parts = parts[parts.index("src") + 1 :]
    return ".".join(p for p in parts if p and p != "__init__")


def python(path: str, text: str, module: str | None = None) -> Iterator[Record]:
    """The module, its classes, methods and functions. Calls are resolved where the file alone tells the
    target: its own top-level names, names imported, methods of the own class, members of modules."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    module = module or module_name(path)
    package = module.split(".") if path.endswith("__init__.py") else module.split(".")[:-1]
    names: dict[str, str] = {}
    imports: list[str] = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                imports.append(a.name)
                names[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
        elif isinstance(node, ast.ImportFrom):
            base = package[: len(package) - node.level + 1] if node.level else []
            origin = ".".join([*base, *([node.module] if node.module else [])])
            for a in node.names:
                imports.append(origin if a.name == "*" else f"{origin}.{a.name}".lstrip("."))
                names[a.asname or a.name] = f"{origin}.{a.name}".lstrip(".")
    own = {n.name: f"{module}.{n.name}" for n in tree.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)}

    def target(f: ast.expr, owner: str | None, members: set[str]) -> str | None:
        if isinstance(f, ast.Name):
            return own.get(f.id) or names.get(f.id)
        if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
            if f.value.id in ("self", "cls") and owner and f.attr in members:
                return f"{owner}.{f.attr}"
            base = own.get(f.value.id) or names.get(f.value.id)
            return f"{base}.{f.attr}" if base else None
        return None

    def signature(n: Any) -> str:
        back = f" -> {ast.unparse(n.returns)}" if n.returns else ""
        return f"{'async ' if isinstance(n, ast.AsyncFunctionDef) else ''}def {n.name}({ast.unparse(n.args)}){back}"

    def function(n: Any, owner: str | None, members: set[str]) -> Record:
        calls = [t for c in ast.walk(n) if isinstance(c, ast.Call) and (t := target(c.func, owner, members))]
        return entity(path, "python", f"{owner or module}.{n.name}", n.name, "method" if owner else "function", n.lineno, n.end_lineno, owner or module, signature=signature(n), docstring=ast.get_docstring(n), calls=_unique(calls))

    yield entity(path, "python", module, module.rsplit(".", 1)[-1], "module", 1, max(1, len(text.splitlines())), docstring=ast.get_docstring(tree), imports=_unique(imports))
    for n in tree.body:
        if isinstance(n, ast.ClassDef):
            owner = f"{module}.{n.name}"
            methods = [m for m in n.body if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef)]
            bases = [own.get(b, names.get(b, b)) for b in (ast.unparse(x) for x in n.bases)]
            yield entity(path, "python", owner, n.name, "class", n.lineno, n.end_lineno, module, signature=f"class {n.name}", docstring=ast.get_docstring(n), extends=bases)
            for m in methods:
                yield function(m, owner, {x.name for x in methods})
        elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
            yield function(n, None, set())


def _match(tokens: list[Token], i: int, opening: str, closing: str) -> int:
    depth = 0
    for k in range(i, len(tokens)):
        if tokens[k].kind == "op":
            depth += (tokens[k].text == opening) - (tokens[k].text == closing)
            if depth == 0 and tokens[k].text == closing:
                return k
    return len(tokens) - 1


def doc_text(comment: str | None) -> str | None:
    if not comment:
        return None
    lines = [re.sub(r"^\s*\*? ?", "", x).rstrip() for x in re.sub(r"^/\*\*|\*/$", "", comment).split("\n")]
    return "\n".join(lines).strip() or None


class Java:
    """One file's types, members and annotations."""

    def __init__(self, path: str, text: str):
        self.path, self.text = path, text
        self.all = lexers.java(text)
        self.t = [x for x in self.all if x.kind not in ("com", "err")]
        self.docs = {}
        last = None
        for x in self.all:
            if x.kind == "com":
                last = x.text if x.text.startswith("/**") else last
            elif x.kind != "err":
                if last:
                    self.docs[x.at] = last
                last = None
        self.package, self.imports, self.wild, self.static = "", {}, [], {}
        self.types: dict[str, str] = {}
        self.variables: dict[str, dict[str, str]] = {}  # of each type: its fields and their types
        self.records: list[Record] = []

    def words(self, i: int, *stops: str) -> tuple[str, int]:
        out = ""
        while i < len(self.t) and self.t[i].text not in stops and self.t[i].kind in ("id", "op"):
            out += self.t[i].text
            i += 1
        return out, i

    def run(self) -> list[Record]:
        t, i = self.t, 0
        for k, x in enumerate(t):
            if x.text in ("class", "interface", "enum", "record") and k + 1 < len(t) and t[k + 1].kind == "id":
                self.types.setdefault(t[k + 1].text, t[k + 1].text)
        while i < len(t) and t[i].text != "package" and t[i].text not in ("import", "class", "interface", "enum", "record", "{"):
            i += 1
        if i < len(t) and t[i].text == "package":
            self.package, i = self.words(i + 1, ";")
        while i < len(t):
            if t[i].text == "import":
                static = t[i + 1].text == "static"
                name, i = self.words(i + 1 + static, ";")
                head, _, tail = name.rpartition(".")
                if tail == "*":
                    self.wild.append(head)
                elif static:
                    self.static[tail] = head
                else:
                    self.imports[tail] = name
            elif t[i].text in ("class", "interface", "enum", "record", "@", "{") or t[i].text in _JAVA_MODIFIERS:
                break
            i += 1
        prefix = self.package + "." if self.package else ""
        self.types = {n: prefix + n for n in self.types}
        self.body(i, len(t), None)
        return self.records

    def annotations(self, i: int) -> tuple[list[tuple[str, dict[str, Any], int]], int]:
        found = []
        while i < len(self.t) and self.t[i].text == "@" and self.t[i + 1].text != "interface":
            at = self.t[i].at
            name, i = self.t[i + 1].text, i + 2
            while i + 1 < len(self.t) and self.t[i].text == ".":
                name, i = name + "." + self.t[i + 1].text, i + 2
            attributes: dict[str, Any] = {}
            if i < len(self.t) and self.t[i].text == "(":
                end = _match(self.t, i, "(", ")")
                attributes = self.attributes(i + 1, end)
                i = end + 1
            found.append((name, attributes, lexers.line_of(self.text, at)))
        return found, i

    def split(self, i: int, end: int) -> list[tuple[int, int]]:
        """Ranges between commas outside of brackets."""
        out, start, depth = [], i, 0
        for k in range(i, end):
            x = self.t[k]
            if x.kind == "op":
                depth += x.text in ("(", "[", "{", "<")
                depth -= x.text in (")", "]", "}", ">")
                if x.text == "," and depth == 0:
                    out.append((start, k))
                    start = k + 1
        return [*out, (start, end)] if start < end else out

    def attributes(self, i: int, end: int) -> dict[str, Any]:
        out = {}
        for a, b in self.split(i, end):
            named = b - a > 2 and self.t[a].kind == "id" and self.t[a + 1].text == "="
            out[self.t[a].text if named else "value"] = self.value(a + 2 * named, b)
        return out

    def value(self, a: int, b: int) -> Any:
        if a >= b:
            return None
        x = self.t[a]
        if x.text == "{":
            return [self.value(c, d) for c, d in self.split(a + 1, _match(self.t, a, "{", "}"))]
        if b - a == 1 and x.kind == "str":
            return x.text[3:-3].strip() if x.text.startswith('"""') else x.text[1:-1].replace('\\"', '"').replace("\\\\", "\\")
        if b - a == 1 and x.text in ("true", "false"):
            return x.text == "true"
        if b - a == 1 and x.kind == "num":
            return int(x.text) if x.text.isdigit() else x.text
        if all(y.kind == "str" or y.text == "+" for y in self.t[a:b]):
            return "".join(y.text[1:-1] for y in self.t[a:b] if y.kind == "str")
        return self.text[x.at : self.t[b - 1].at + len(self.t[b - 1].text)]

    def full(self, name: str) -> str:
        """The full name of a type, as far as the file tells."""
        bare = re.sub(r"<.*", "", name).replace("[]", "").strip()
        if "." in bare:
            return bare
        return self.imports.get(bare) or self.types.get(bare) or bare

    def annotate(self, owner: str, target: str, found: list[tuple[str, dict[str, Any], int]]) -> None:
        for name, attributes, line in found:
            full = self.full(name)
            self.records.append(("annotation", {"id": sha("\0".join((owner, target, full, str(line)))), "owner": owner, "target": target, "name": name.rsplit(".", 1)[-1], "fqn": full, "attributes": json.dumps(attributes, sort_keys=True), "line": line}))

    def body(self, i: int, end: int, owner: str | None, simple: str | None = None, kind: str = "") -> None:
        t = self.t
        if kind == "enum":  # its constants
            depth = 0
            while i < end and not (depth == 0 and t[i].text == ";"):
                depth += (t[i].text in "({") - (t[i].text in ")}") if t[i].kind == "op" else 0
                i += 1
        members: list[dict[str, Any]] = []
        while i < end:
            if t[i].text in (";", "}"):
                i += 1
                continue
            start = i
            found, i = self.annotations(i)
            while i < end and (t[i].text in _JAVA_MODIFIERS or t[i].text == "@" or (t[i].text == "-" or t[i].text in ("non", "sealed") and t[i + 1].kind in ("id", "op") and t[i + 1].text != "(")):
                more, k = self.annotations(i)
                found += more
                i = k if k > i else i + 1
            if i < end and t[i].text == "@":
                i += 1
            if i >= end:
                break
            if t[i].text == "{":
                i = _match(t, i, "{", "}") + 1
                continue
            if t[i].text in ("class", "interface", "enum") or (t[i].text == "record" and i + 2 < end and t[i + 2].text in ("(", "<")):
                i = self.type_(start, i, found, owner)
                continue
            k = i
            if t[k].text == "<":
                k = _match(t, k, "<", ">") + 1
            name_at = k
            while name_at < end and not (t[name_at].kind == "op" and t[name_at].text in ("(", "=", ";", "{", ",")):
                name_at = _match(t, name_at, "<", ">") + 1 if t[name_at].text == "<" else name_at + 1
            if name_at >= end:
                break
            if t[name_at].text == "(" and name_at > k:
                i = self.method(start, k, name_at, found, owner, simple, members)
            else:
                i = self.field(start, k, name_at, found, owner)
        overloads: dict[str, list[str]] = {}
        for m in members:
            overloads.setdefault(m["name"], []).append(m["record"]["qualified_name"])
        for m in members:
            m["record"]["calls"] = self.calls(*m["range"], owner, overloads)
            self.sites(m["record"]["qualified_name"], *m["range"], self.variables.get(owner, {}) | m["parameters"])
            self.routes(*m["range"])

    def type_(self, start: int, i: int, found: list, owner: str | None) -> int:
        t = self.t
        kind, name = t[i].text, t[i + 1].text
        qualified = f"{owner}.{name}" if owner else (f"{self.package}.{name}" if self.package else name)
        self.types[name] = qualified
        k = i + 2
        extends, implements = [], []
        opened = None
        while k < len(t) and t[k].text != "{":
            if t[k].text == "(":
                k = _match(t, k, "(", ")")
            elif t[k].text in ("extends", "implements", "permits"):
                opened = t[k].text
            elif t[k].kind == "id" and opened in ("extends", "implements") and t[k - 1].text in ("extends", "implements", ","):
                full, j = t[k].text, k + 1
                while t[j].text == ".":
                    full, j = full + "." + t[j + 1].text, j + 2
                (extends if opened == "extends" else implements).append(self.full(full))
                if t[j].text == "<":
                    stop = _match(t, j, "<", ">")
                    arguments = [self.full("".join(x.text for x in t[a:b])) for a, b in self.split(j + 1, stop)]
                    self.records.append(("type_binding", {"type": qualified, "base": self.full(full), "arguments": arguments}))
                    j = stop + 1
                k = j - 1
            k += 1
        stop = _match(t, k, "{", "}") if k < len(t) else len(t) - 1
        end_line = lexers.line_of(self.text, t[stop].at)
        self.records.append(entity(self.path, "java", qualified, name, "annotation" if t[i - 1].text == "@" else kind, lexers.line_of(self.text, t[i].at), end_line, owner, docstring=doc_text(self.docs.get(t[start].at)),
                                   signature=" ".join(self.text[t[start].at : t[k].at].split()) if k < len(t) else name, extends=extends, implements=implements,
                                   imports=[] if owner else [*self.imports.values(), *(w + ".*" for w in self.wild)]))
        self.annotate(qualified, "type", found)
        self.body(k + 1, stop, qualified, name, kind)
        return stop + 1

    def method(self, start: int, k: int, open_at: int, found: list, owner: str | None, simple: str | None, members: list) -> int:
        t = self.t
        name = t[open_at - 1].text
        close = _match(t, open_at, "(", ")")
        types, names, of_parameters = [], [], []
        for a, b in self.split(open_at + 1, close):
            more, a = self.annotations(a)
            while a < b and t[a].text in ("final",):
                a += 1
            if b - a >= 2:
                types.append("".join(x.text for x in t[a : b - 1]).replace("...", "..."))
                names.append(t[b - 1].text)
                of_parameters.append((names[-1], more))
        constructor = name == simple
        qualified = f"{owner}.{name}({','.join(re.sub(r'<.*>', '', x) for x in types)})" if owner else name
        i = close + 1
        while i < len(t) and t[i].text not in ("{", ";", "}"):
            i += 1
        stop = _match(t, i, "{", "}") if i < len(t) and t[i].text == "{" else min(i, len(t) - 1)
        record = entity(self.path, "java", qualified, name, "constructor" if constructor else "method", lexers.line_of(self.text, t[open_at - 1].at), lexers.line_of(self.text, t[stop].at), owner,
                        docstring=doc_text(self.docs.get(t[start].at)), signature=" ".join(self.text[t[start].at : t[close].at + 1].split()),
                        return_type=None if constructor else "".join(x.text for x in t[k : open_at - 1]), parameter_types=types, parameter_names=names)
        self.records.append(record)
        members.append({"name": name, "record": record[1], "range": (i, stop), "parameters": dict(zip(names, types, strict=True))})
        self.annotate(qualified, "constructor" if constructor else "method", found)
        for parameter, more in of_parameters:
            self.annotate(qualified, f"param:{parameter}", more)
        return stop + 1

    def field(self, start: int, k: int, stop_at: int, found: list, owner: str | None) -> int:
        t = self.t
        end = stop_at
        while end < len(t) and not (t[end].kind == "op" and t[end].text == ";"):
            end = _match(t, end, t[end].text, {"(": ")", "{": "}"}[t[end].text]) + 1 if t[end].kind == "op" and t[end].text in ("(", "{") else end + 1
        if owner and stop_at - k >= 2 and t[stop_at - 1].kind == "id":
            name, type_ = t[stop_at - 1].text, "".join(x.text for x in t[k : stop_at - 1])
            self.variables.setdefault(owner, {})[name] = type_
            qualified = f"{owner}.{name}"
            line = lexers.line_of(self.text, t[stop_at - 1].at)
            self.records.append(("field", {"qualified_name": qualified, "owner": owner, "name": name, "type": type_, "type_fqn": self.full(type_), "final": any(x.text == "final" for x in t[start:k]), "initialised": t[stop_at].text == "=", "line": line}))
            self.annotate(qualified, "field", found)
        return end + 1

    def sites(self, member: str, i: int, end: int, variables: dict[str, str]) -> None:
        """Where a member publishes an event or sends a message to a destination given as a literal."""
        t, seen = self.t, set()
        for k in range(i, end - 1):
            if t[k].kind != "id" or t[k + 1].text != "(" or t[k].text not in ("publishEvent", "send", "convertAndSend"):
                continue
            given = self.split(k + 2, _match(t, k + 1, "(", ")"))
            if not given:
                continue
            a, b = given[0]
            if t[k].text == "publishEvent":
                made = self.words(a + 1, "(", "<")[0] if t[a].text == "new" else variables.get(t[a].text) if b - a == 1 else None
                site = ("event-publish", None, made and self.full(made))
            else:
                receiver = t[k - 2].text if t[k - 1].text == "." else ""
                kind = re.sub(r"<.*", "", variables.get(receiver, "")).rpartition(".")[2]
                broker = TEMPLATES.get(kind) or next((v for n, v in BROKER_NAMES.items() if n in receiver.lower()), None)
                site = ("message-send", broker, self.value(a, b) if broker and b - a == 1 and t[a].kind == "str" else None)
            if site[2] and site not in seen:
                seen.add(site)
                self.records.append(("message_site", {"id": sha("\0".join((member, *map(str, site)))), "member": member, "kind": site[0], "broker": site[1], "name": site[2], "file_path": self.path}))

    def routes(self, i: int, end: int) -> None:
        """Routes of a member: each from("...") with the calls chained to it."""
        from loomspan.sources import wiring

        t, k = self.t, i
        while k < end - 2:
            if not (t[k].text == "from" and t[k].kind == "id" and t[k + 1].text == "(" and t[k + 2].kind == "str" and t[k - 1].text != "."):
                k += 1
                continue
            chain, at = [], k
            while at + 1 < end and t[at].kind == "id" and t[at + 1].text == "(":
                close = _match(t, at + 1, "(", ")")
                chain.append((t[at].text, [(a, b) for a, b in self.split(at + 2, close)]))
                at = close + 2 if t[close + 1].text == "." else close + 1
                if t[close + 1].text != ".":
                    break
            self.records.append(self.route(chain, sum(tag == "route" for tag, _ in self.records), wiring))
            k = max(at, k + 1)

    def route(self, chain: list[tuple[str, list[tuple[int, int]]]], ordinal: int, wiring: Any) -> Record:
        start, route_id, steps, open_ = self.value(*chain[0][1][0]), None, [], []
        said = lambda spans: ", ".join(self.text[self.t[a].at : self.t[b - 1].at + len(self.t[b - 1].text)] for a, b in spans) or None
        for name, given in chain[1:]:
            literal = self.value(*given[0]) if given and given[0][1] - given[0][0] == 1 and self.t[given[0][0]].kind == "str" else None
            inside = any(x in wiring._CONDITIONS for x in open_)
            if name == "routeId":
                route_id = literal
            elif name in ("end", "endChoice") and open_:
                open_.pop()
            elif name in ("when", "otherwise"):
                if open_ and open_[-1] in ("when", "otherwise"):
                    open_.pop()
                open_.append(name)
                steps.append(wiring._step(name, True, said(given)))
            elif name in wiring._BRANCHES:
                open_.append(name)
                steps.append(wiring._step(name, inside, said(given)))
            elif name in wiring._ENDPOINTS:
                steps.append(wiring._step(name, inside, None, uri=literal))
            elif name in ("bean", "process", "to"):
                words = [self.text[self.t[a].at : self.t[b - 1].at + len(self.t[b - 1].text)].strip('"') for a, b in given]
                ref = ".".join([re.sub(r"\.class$", "", words[0]), *words[1:2]]) if words and not words[0].startswith("new ") and "->" not in words[0] else None
                steps.append(wiring._step(name, inside, None, ref=ref))
        return wiring._route(self.path, ordinal, route_id, start, steps)

    def calls(self, i: int, end: int, owner: str | None, overloads: dict[str, list[str]]) -> list[str]:
        """Targets that the file alone tells: the only overload of the own type, static imports, members of
        imported and own types."""
        out = []
        for k in range(i, end):
            if self.t[k].kind != "id" or self.t[k + 1].text != "(":
                continue
            name, before = self.t[k].text, self.t[k - 1].text
            receiver = self.t[k - 2] if before == "." else None
            if before == "new":
                continue
            if receiver is None or (receiver.text in ("this", "super") and self.t[k - 3].text != "."):
                if len(overloads.get(name, [])) == 1:
                    out.append(overloads[name][0])
                elif name in self.static and receiver is None:
                    out.append(f"{self.static[name]}.{name}")
            elif receiver.kind == "id" and self.t[k - 3].text != "." and (receiver.text in self.imports or receiver.text in self.types):
                out.append(f"{self.full(receiver.text)}.{name}")
        return _unique(out)


# Types of messaging templates, and parts of names that tell the broker where the type doesn't.
TEMPLATES = {
    "KafkaTemplate": "kafka", "KafkaOperations": "kafka", "RabbitTemplate": "rabbit", "AmqpTemplate": "rabbit", "JmsTemplate": "jms", "JmsOperations": "jms", "SqsTemplate": "sqs", "QueueMessagingTemplate": "sqs",
}
BROKER_NAMES = {"kafka": "kafka", "rabbit": "rabbit", "amqp": "rabbit", "jms": "jms", "sqs": "sqs"}
_JAVA_MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default".split())


def java(path: str, text: str) -> Iterator[Record]:
    yield from Java(path, text).run()


def _resolve(path: str, specifier: str) -> str:
    """A module specifier as a dotted name; relative ones from the file's folder, index dropped."""
    if not specifier.startswith("."):
        return specifier
    full = posixpath.normpath(posixpath.join(posixpath.dirname(path), specifier))
    full = re.sub(r"\.(?:[cm]?[jt]sx?)$", "", full)
    return re.sub(r"(^|\.)index$", "", full.replace("/", ".")) or "index"


def javascript(path: str, text: str) -> Iterator[Record]:
    """Module, functions, classes, methods, interfaces, types and enums; imports by either syntax. A
    function that returns markup is a component, which renders the capitalised names it mentions."""
    tokens = [x for x in lexers.javascript(text)]
    t = [x for x in tokens if x.kind not in ("com", "err")]
    module = re.sub(r"(^|\.)index$", "", re.sub(r"\.(?:[cm]?[jt]sx?)$", "", path).replace("/", ".")) or "index"
    names: dict[str, str] = {}
    imports: list[str] = []
    for m in re.finditer(r"(?:import|export)\s+(?:type\s+)?([^;'\"]*?)\s*from\s*['\"]([^'\"]+)['\"]|import\s*['\"]([^'\"]+)['\"]|(?:const|let|var)\s+([^=;]+?)\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)", text):
        target = _resolve(path, m.group(2) or m.group(3) or m.group(5))
        imports.append(target)
        clause = m.group(1) or m.group(4) or ""
        for group in re.findall(r"\{([^}]*)\}", clause):
            for part in group.split(","):
                original, _, alias = (x.strip() for x in re.sub(r"\s+as\s+|\s*:\s*", "|", part.strip()).partition("|"))
                if original:
                    names[alias or original] = f"{target}.{original}"
        for part in re.sub(r"\{[^}]*\}", "", clause).split(","):
            if name := re.sub(r"^\*\s+as\s+", "", part.strip()):
                names[name] = target
    docs, last = {}, None
    for x in tokens:
        if x.kind == "com":
            last = x.text if x.text.startswith("/**") else last
        elif x.kind != "err":
            if last:
                docs[x.at] = last
            last = last if x.text in ("export", "default", "async", "static", "abstract") and x.kind == "id" else None
    own: dict[str, str] = {}
    found: list[tuple[str, str, int, int, int, str | None]] = []  # name, kind, at, open, close, owner
    i, owners = 0, []
    while i < len(t):
        x = t[i]
        while owners and i > owners[-1][1]:
            owners.pop()
        if x.kind == "id":
            nxt = t[i + 1] if i + 1 < len(t) else x
            if x.text in ("class", "interface", "enum") and nxt.kind == "id" and (i == 0 or t[i - 1].text != "."):
                k = i
                while k < len(t) - 1 and t[k].text != "{":
                    k += 1
                end = _match(t, k, "{", "}")
                found.append((nxt.text, x.text, i, k, end, None))
                if x.text == "class":
                    owners.append((nxt.text, end, k))
                i = k
            elif x.text == "type" and nxt.kind == "id" and i + 2 < len(t) and t[i + 2].text in ("=", "<"):
                found.append((nxt.text, "type", i, i, i + 2, None))
            elif x.text == "function":
                k = i + 1 + (nxt.text == "*")
                if k + 1 < len(t) and t[k].kind == "id" and t[k + 1].text in ("(", "<") and not owners:
                    b = k + 1
                    while b < len(t) - 1 and t[b].text != "{":
                        b = _match(t, b, "(", ")") + 1 if t[b].text == "(" else b + 1
                    found.append((t[k].text, "function", i, b, _match(t, b, "{", "}"), None))
            elif x.text in ("const", "let", "var") and nxt.kind == "id" and not owners and i + 3 < len(t) and t[i + 2].text == "=":
                k = i + 3 + (t[i + 3].text == "async")
                arrow = k < len(t) and ((t[k].text == "(" and t[min(_match(t, k, "(", ")") + 1, len(t) - 1)].text in ("=>", ":")) or (t[k].kind == "id" and k + 1 < len(t) and t[k + 1].text == "=>") or t[k].text == "function")
                if arrow:
                    b = k
                    while b < len(t) - 1 and t[b].text not in ("{", ";") and not (t[b].nl and b > k + 1 and t[b - 1].text == "=>"):
                        b = _match(t, b, "(", ")") + 1 if t[b].text == "(" else b + 1
                    found.append((nxt.text, "function", i, b, _match(t, b, "{", "}") if t[b].text == "{" else b, None))
            elif owners and nxt.text == "(" and _depth(t, owners[-1][2], i) == 1 and t[i - 1].text not in (".", "new"):
                close = _match(t, i + 1, "(", ")")
                b = close + 1
                while b < len(t) - 1 and t[b].text not in ("{", ";", "}"):
                    b += 1
                if t[b].text == "{":
                    found.append((x.text, "constructor" if x.text == "constructor" else "method", i, b, _match(t, b, "{", "}"), owners[-1][0]))
                    i = _match(t, b, "{", "}")
        i += 1
    for name, kind, *_, owner in found:
        if owner is None:
            own[name] = f"{module}.{name}"
    yield entity(path, "javascript", module, module.rsplit(".", 1)[-1], "module", 1, max(1, text.count("\n") + 1), imports=_unique(imports))
    members = {(o, n) for n, _, _, _, _, o in found if o}
    for name, kind, at, open_, end, owner in found:
        calls, renders = [], []
        body = text[t[open_].at : t[end].at]
        markup = kind == "function" and re.search(r"(?:return|=>)\s*\(?\s*<[A-Za-z>]", text[t[at].at : t[end].at + 1])
        if kind in ("function", "method", "constructor"):
            for k in range(open_, end):
                if t[k].kind == "id" and t[k + 1].text == "(":
                    before = t[k - 1].text
                    if before != "." and (t[k].text in own or t[k].text in names):
                        calls.append(own.get(t[k].text) or names[t[k].text])
                    elif before == "." and t[k - 2].text == "this" and owner and (owner, t[k].text) in members:
                        calls.append(f"{module}.{owner}.{t[k].text}")
                    elif before == "." and t[k - 2].text in names and t[k - 3].text != ".":
                        calls.append(f"{names[t[k - 2].text]}.{t[k].text}")
            renders = [own.get(r) or names.get(r) for r in re.findall(r"<([A-Z]\w*)", body) if r in own or r in names] if markup else []
        hooks = _unique(re.findall(r"\b(use[A-Z]\w*)\s*\(", body)) if markup else []
        start = at - 1 if at and t[at - 1].text in ("export", "default", "async", "static") else at
        while start and t[start - 1].text in ("export", "default", "async", "static"):
            start -= 1
        base = re.search(r"\bextends\s+([\w.]+)", text[t[at].at : t[open_].at]) if kind == "class" else None
        extends = [own.get(base.group(1)) or names.get(base.group(1), base.group(1))] if base else []
        signature = " ".join(text[t[start].at : t[open_].at].split()) or name
        yield entity(path, "javascript", f"{module}.{owner}.{name}" if owner else f"{module}.{name}", name, "component" if markup and name[0].isupper() else kind, lexers.line_of(text, t[at].at), lexers.line_of(text, t[end].at),
                     f"{module}.{owner}" if owner else module, signature=signature + (f" [hooks: {', '.join(hooks)}]" if hooks else ""), docstring=doc_text(docs.get(t[start].at)), calls=_unique(calls), renders=_unique([r for r in renders if r]), extends=extends)


def _depth(t: list[Token], start: int, i: int) -> int:
    depth = 0
    for k in range(start, i):
        if t[k].kind == "op":
            depth += (t[k].text == "{") - (t[k].text == "}")
    return depth


# Words that end a column's type.
_COLUMN_STOPS = frozenset("not null default primary unique references check constraint generated collate comment auto_increment identity on".split())


def _name(t: list[Token], i: int) -> tuple[str, int]:
    out = t[i].text.strip('"`[]')
    i += 1
    while i + 1 < len(t) and t[i].text == ".":
        out, i = out + "." + t[i + 1].text.strip('"`[]'), i + 2
    return out, i


def sql(path: str, text: str) -> Iterator[Record]:
    """Tables, columns, foreign keys, views, indexes, and routines with the tables they read and write."""
    tokens = [x._replace(text=x.text.lower()) if x.kind == "id" and not x.text.startswith('"') else x for x in lexers.sql(text) if x.kind != "err"]
    t = [x for x in tokens if x.kind != "com"]
    start = 0
    routines: dict[str, list[str]] = {}
    later: list[Record] = []
    for k, x in enumerate(t):
        if x.kind == "end" or (x.kind == "op" and x.text == ";"):
            for tag, record in _statement(path, text, t[start : k + 1], tokens):
                if tag == "entity":
                    routines.setdefault(record["name"], []).append(record["qualified_name"])
                    later.append((tag, record))
                else:
                    yield tag, record
            start = k + 1
    for tag, record in later:
        record["calls"] = [q[0] for n in _unique(re.findall(r"\b([a-z_]\w*)\s*\(", record.pop("body").lower())) if len(q := routines.get(n, [])) == 1 and q[0] != record["qualified_name"]]
        yield tag, record


def scan_tables(statement: str) -> tuple[list[str], list[str]]:
    """Tables that SQL writes, and those it only reads, in small letters."""
    written, read = ([x.lower() for x in side] for side in sqlscan.tables(statement))
    return _unique(written), [x for x in _unique(read) if x not in written]


def _statement(path: str, text: str, t: list[Token], tokens: list[Token]) -> Iterator[Record]:
    words = [x.text for x in t[:8]]
    if words[:1] == ["alter"] and "table" in words[:2]:
        name, i = _name(t, 2 + (2 if words[2:4] == ["if", "exists"] else 0))
        for k in range(i, len(t)):
            if t[k].text == "foreign":
                yield from _foreign(t, k, name)
        return
    if words[:1] != ["create"]:
        return
    i = 1
    while i < len(t) and t[i].text in ("or", "replace", "temporary", "temp", "unlogged", "global", "local", "unique", "materialized"):
        i += 1
    kind = t[i].text if i < len(t) else ""
    i += 1
    if t[i : i + 3] and [x.text for x in t[i : i + 3]] == ["if", "not", "exists"]:
        i += 3
    if kind == "table" and i < len(t):
        name, i = _name(t, i)
        schema, _, simple = name.rpartition(".")
        columns, refs = [], []
        if i < len(t) and t[i].text == "(":
            end = _match(t, i, "(", ")")
            keyed: set[str] = set()
            for a, b in _commas(t, i + 1, end):
                if t[a].text == "constraint":
                    a += 2
                if t[a].text == "primary" and t[a + 1].text == "key":
                    keyed |= {x.text.strip('"') for x in t[a + 3 : _match(t, a + 2, "(", ")")] if x.kind == "id"}
                elif t[a].text == "foreign":
                    refs += list(_foreign(t, a, name))
                elif t[a].text not in ("unique", "check", "exclude", "like"):
                    columns.append((a, b))
            rows = []
            for a, b in columns:
                column = t[a].text.strip('"')
                k = a + 1
                while k < b and t[k].text not in _COLUMN_STOPS:
                    k = _match(t, k, "(", ")") + 1 if t[k].text == "(" else k + 1
                tail = [x.text for x in t[k:b]]
                key = ("primary" in tail) or column in keyed
                default = None
                if "default" in tail:
                    d = k + tail.index("default") + 1
                    e = d + 1
                    while e < b and t[e].text not in _COLUMN_STOPS:
                        e = _match(t, e, "(", ")") + 1 if t[e].text == "(" else e + 1
                    default = text[t[d].at : t[e - 1].at + len(t[e - 1].text)]
                type_ = text[t[a + 1].at : t[k - 1].at + len(t[k - 1].text)] if k > a + 1 else None
                rows.append({"qualified_name": f"{name}.{column}", "table": name, "name": column, "data_type": type_, "nullable": not key and not re.search(r"\bnot null\b", " ".join(tail)), "default": default, "primary_key": key})
                if "references" in tail:
                    target, j = _name(t, k + tail.index("references") + 1)
                    refs.append(("db_reference", {"src": name, "src_column": column, "dst": target, "dst_column": t[j + 1].text.strip('"') if t[j].text == "(" else None}))
            for r in rows:
                yield "db_column", r
            yield from refs
            yield "db_table", {"qualified_name": name, "name": simple, "schema_name": schema or None, "file_path": path, "ref_tables": _unique([r["dst"] for _, r in refs]), "embed_text": f"{name}: " + ", ".join(f"{r['name']} {r['data_type'] or ''}".strip() for r in rows)}
    elif kind == "view" and i < len(t):
        name, k = _name(t, i)
        body = text[t[k].at : t[-1].at] if k < len(t) else ""
        ctes = {m.lower() for m in re.findall(r"(?i)(?:\bwith(?:\s+recursive)?|,)\s+(\w+)(?:\s*\([^)]*\))?\s+as\s*\(", body)}
        depends = [d for d in scan_tables(body)[1] if d not in ctes and d != name]
        yield "db_view", {"qualified_name": name, "name": name.rpartition(".")[2], "schema_name": name.rpartition(".")[0] or None, "file_path": path, "materialized": "materialized" in words, "depends_on": depends}
    elif kind == "index":
        while i < len(t) and t[i].text in ("concurrently",):
            i += 1
        name, k = (None, i) if t[i].text == "on" else _name(t, i)
        if k + 1 < len(t) and t[k].text == "on":
            table, k = _name(t, k + 1 + (t[k + 1].text == "only"))
            while k < len(t) - 1 and t[k].text != "(":
                k += 1
            columns = [t[a].text.strip('"') for a, b in _commas(t, k + 1, _match(t, k, "(", ")"))]
            yield "db_index", {"qualified_name": f"{table}.{name or '_'.join(columns)}", "name": name, "table": table, "columns": columns, "unique": "unique" in words, "file_path": path}
    elif kind in ("function", "procedure", "trigger") and i < len(t):
        name, k = _name(t, i)
        body = text[t[0].at : t[-1].at]
        inner = next((x.text for x in t if x.kind == "dollar"), body)
        written, read = scan_tables(inner)
        on = None
        if kind == "trigger":
            at = next((j for j in range(k, len(t)) if t[j].text == "on"), None)
            on = _name(t, at + 1)[0] if at else None
            written, read = [], []
        place = next(n for n, x in enumerate(tokens) if x.at == t[0].at)
        docs = []
        for c in reversed(tokens[:place]):
            if c.kind != "com":
                break
            docs.append(re.sub(r"^(?:--+|/\*+)\s?|\s*\*/$", "", c.text))
        close = _match(t, k, "(", ")") if k < len(t) and t[k].text == "(" else k
        yield entity(path, "sql", name, name.rpartition(".")[2], kind, lexers.line_of(text, t[0].at), lexers.line_of(text, t[-1].at), name.rpartition(".")[0] or None,
                     signature=" ".join(text[t[0].at : t[min(close, len(t) - 1)].at + 1].split()), docstring="\n".join(reversed(docs)) or None, reads=read, writes=written, trigger_table=on, body=inner)


def _commas(t: list[Token], i: int, end: int) -> list[tuple[int, int]]:
    out, start, depth = [], i, 0
    for k in range(i, end):
        if t[k].kind == "op":
            depth += (t[k].text in ("(", "[")) - (t[k].text in (")", "]"))
            if t[k].text == "," and depth == 0:
                out.append((start, k))
                start = k + 1
    return [(a, b) for a, b in [*out, (start, end)] if a < b]


def _foreign(t: list[Token], k: int, table: str) -> Iterator[Record]:
    if k + 2 >= len(t) or t[k + 2].text != "(":
        return
    close = _match(t, k + 2, "(", ")")
    own = [x.text.strip('"') for x in t[k + 3 : close] if x.kind == "id"]
    if close + 2 < len(t) and t[close + 1].text == "references":
        target, j = _name(t, close + 2)
        theirs = [x.text.strip('"') for x in t[j + 1 : _match(t, j, "(", ")")] if x.kind == "id"] if j < len(t) and t[j].text == "(" else []
        for n, column in enumerate(own):
            yield "db_reference", {"src": table, "src_column": column, "dst": target, "dst_column": theirs[n] if n < len(theirs) else None}
