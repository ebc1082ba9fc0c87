"""Framework files as records: bean definitions, SQL mappers and message routes, in XML and YAML."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from typing import Any

from loomspan.sources.code import scan_tables
from loomspan.sources.documents import Record, chunk, section, sha


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _root(text: str) -> ET.Element | None:
    try:
        return ET.fromstring(text)
    except ET.ParseError:
        return None


def spring_xml(path: str, text: str) -> Iterator[Record]:
    """Beans with their names, injected references and placeholders, scanned packages and imports; inner
    beans get ids of their own. One chunk sums the wiring up. Embedded route contexts give routes."""
    root = _root(text)
    if root is None:
        return
    lines: list[str] = []
    counter = [0]

    def refs_of(e: ET.Element) -> list[dict[str, Any]]:
        out = []
        for name, value in e.attrib.items():
            bare = name.rpartition("}")[2]
            if bare.endswith("-ref") and "}" in name:
                out.append({"ref": value, "via": "constructor" if "/c" in name.partition("}")[0] else "property", "property": bare[:-4], "multiplicity": "one"})
        for c in e:
            kind = _tag(c)
            if kind in ("property", "constructor-arg"):
                via = "property" if kind == "property" else "constructor"
                name = c.get("name") or c.get("index")
                if c.get("ref"):
                    out.append({"ref": c.get("ref"), "via": via, "property": name, "multiplicity": "one"})
                many = "many" if len(c) and _tag(c[0]) not in ("ref", "bean") else "one"
                for inner in c.iter():
                    if _tag(inner) == "ref":
                        out.append({"ref": inner.get("bean") or inner.get("local"), "via": via, "property": name, "multiplicity": many})
                    elif _tag(inner) == "bean":
                        out.append({"ref": bean_id(inner), "via": via, "property": name, "multiplicity": many})
        return out

    ids: dict[int, str] = {}

    def bean_id(e: ET.Element) -> str:
        if id(e) not in ids:
            counter[0] += 1
            ids[id(e)] = e.get("id") or (re.split(r"[\s,;]+", e.get("name", "").strip())[0] or None) or f"{e.get('class', 'bean')}#{counter[0]}"
        return ids[id(e)]

    for e in root.iter():
        kind = _tag(e)
        if kind == "bean":
            own = bean_id(e)
            names = [n for n in re.split(r"[\s,;]+", e.get("name", "").strip()) if n]
            names += [a.get("alias") for a in root.iter() if _tag(a) == "alias" and a.get("name") == own and a.get("alias")]
            refs = refs_of(e)
            blob = ET.tostring(e, encoding="unicode")
            yield "xml_bean", {"id": sha("\0".join((path, own))), "file_path": path, "bean_id": own, "names": [n for n in names if n != own], "class_name": e.get("class"), "scope": e.get("scope"), "primary": e.get("primary") == "true",
                               "abstract": e.get("abstract") == "true", "parent": e.get("parent"), "refs": refs, "placeholders": list(dict.fromkeys(re.findall(r"\$\{([^:}]+)", blob)))}
            lines.append(f"bean {own}: {e.get('class') or ''}" + "".join(f" -> {r['ref']}" for r in refs))
        elif kind == "component-scan":
            for package in re.split(r"[\s,;]+", e.get("base-package", "")):
                if package:
                    yield "component_scan", {"file_path": path, "package": package}
        elif kind == "import" and e.get("resource"):
            yield "context_import", {"file_path": path, "resource": e.get("resource")}
    if lines:
        head = section(path, 0, path.rsplit("/", 1)[-1], 1, path.rsplit("/", 1)[-1], None)
        yield head
        yield chunk(head[1]["id"], 0, "\n".join(lines))
    yield from camel_xml(path, text)


def mapper_xml(path: str, text: str) -> Iterator[Record]:
    """Statements of a mapper file, included fragments put in, with the tables they access."""
    root = _root(text)
    if root is None or _tag(root) != "mapper":
        return
    namespace = root.get("namespace", "")
    fragments = {e.get("id"): e for e in root if _tag(e) == "sql"}

    def flat(e: ET.Element, seen: tuple[str, ...] = ()) -> str:
        out = e.text or ""
        for c in e:
            if _tag(c) == "include":
                ref = (c.get("refid") or "").rpartition(".")[2]
                if ref in fragments and ref not in seen:
                    out += " " + flat(fragments[ref], (*seen, ref)) + " "
            elif _tag(c) != "selectKey":
                out += " " + (c.get("prefix") or ("WHERE" if _tag(c) == "where" else "SET" if _tag(c) == "set" else "")) + " " + flat(c, seen) + " "
            out += c.tail or ""
        return out

    for e in root:
        if _tag(e) in ("select", "insert", "update", "delete"):
            body = " ".join(flat(e).split())
            written, read = scan_tables(body)
            yield "sql_statement", {"id": sha("\0".join((namespace, e.get("id", ""), _tag(e), "xml"))), "mapper": namespace, "statement_id": e.get("id"), "kind": _tag(e), "origin": "xml", "text": body, "file_path": path,
                                    "tables": [{"name": n.rpartition(".")[2], "mode": "write"} for n in written] + [{"name": n.rpartition(".")[2], "mode": "read"} for n in read]}


# Route elements that branch, that only carry an expression, and that name endpoints.
_BRANCHES = frozenset("choice when otherwise filter doTry doCatch doFinally loop split multicast onException onFallback circuitBreaker".split())
_CONDITIONS = frozenset("when otherwise filter doCatch onException onFallback".split())
_EXPRESSIONS = frozenset("simple xpath jsonpath header constant method expression spel groovy exchangeProperty tokenize ref language csimple datasonnet".split())
_ENDPOINTS = frozenset("to toD wireTap enrich pollEnrich inOnly inOut recipientList interceptSendToEndpoint".split())


def _route(path: str, ordinal: int, route_id: str | None, start: str | None, steps: list[dict[str, Any]]) -> Record:
    plain = {s["uri"] for s in steps if s.get("uri") and not s["conditional"]}
    targets: dict[str, bool] = {}
    for s in steps:
        if s.get("uri"):
            targets[s["uri"]] = s["uri"] not in plain
    return "route", {"id": sha("\0".join((path, str(ordinal)))), "route_id": route_id, "file_path": path, "from_uri": start, "steps": [{"index": n, **s} for n, s in enumerate(steps)], "to_uris": [{"uri": u, "conditional": c} for u, c in targets.items()]}


def _step(kind: str, conditional: bool, predicate: str | None, uri: str | None = None, ref: str | None = None) -> dict[str, Any]:
    return {"kind": kind, "uri": uri, "ref": ref, "predicate": predicate, "conditional": conditional}


def camel_xml(path: str, text: str) -> Iterator[Record]:
    """Routes of an XML file as flat lists of steps; what stands within a condition is conditional."""
    root = _root(text)
    if root is None:
        return

    def walk(e: ET.Element, conditional: bool, predicate: str | None) -> Iterator[dict[str, Any]]:
        for c in e:
            kind = _tag(c)
            if kind in ("from", "description") or kind in _EXPRESSIONS:
                continue
            said = next(((x.text or "").strip() for x in c if _tag(x) in _EXPRESSIONS), None)
            inside = conditional or kind in _CONDITIONS
            if kind in _ENDPOINTS:
                yield _step(kind, conditional, predicate, uri=c.get("uri") or said)
            elif kind in ("bean", "process"):
                ref = c.get("ref") or c.get("beanType")
                yield _step(kind, conditional, predicate, ref=f"{ref}.{c.get('method')}" if ref and c.get("method") else ref)
            else:
                yield _step(kind, inside, said if kind in _CONDITIONS else predicate)
            if kind in _BRANCHES:
                yield from walk(c, inside, (said or predicate) if kind in _CONDITIONS else predicate)

    for n, route in enumerate(r for r in root.iter() if _tag(r) == "route"):
        start = next((c.get("uri") for c in route if _tag(c) == "from"), None)
        yield _route(path, n, route.get("id"), start, list(walk(route, False, None)))


def camel_yaml(path: str, text: str) -> Iterator[Record]:
    import yaml

    try:
        documents = [x for d in yaml.safe_load_all(text) for x in (d if isinstance(d, list) else [d])]
    except yaml.YAMLError:
        return

    def said(v: Any) -> str | None:
        if isinstance(v, dict):
            for k, x in v.items():
                if k in _EXPRESSIONS:
                    return said(x) if isinstance(x, dict) else str(x)
        return None

    def walk(steps: Any, conditional: bool, predicate: str | None) -> Iterator[dict[str, Any]]:
        for item in steps if isinstance(steps, list) else []:
            for kind, v in item.items() if isinstance(item, dict) else [(str(item), None)]:
                v_ = v if isinstance(v, dict) else {}
                inside, why = conditional or kind in _CONDITIONS, (said(v) or predicate) if kind in _CONDITIONS else predicate
                if kind in _ENDPOINTS:
                    yield _step(kind, conditional, predicate, uri=v if isinstance(v, str) else v_.get("uri") or said(v))
                elif kind in ("bean", "process"):
                    ref = v if isinstance(v, str) else v_.get("ref") or v_.get("beanType")
                    yield _step(kind, conditional, predicate, ref=f"{ref}.{v_['method']}" if ref and v_.get("method") else ref)
                else:
                    yield _step(kind, inside, why)
                if kind == "choice":
                    for w in v_.get("when", []) or []:
                        yield _step("when", True, said(w))
                        yield from walk(w.get("steps"), True, said(w))
                    if v_.get("otherwise"):
                        yield _step("otherwise", True, None)
                        yield from walk(v_["otherwise"].get("steps"), True, predicate)
                elif v_.get("steps"):
                    yield from walk(v_["steps"], inside, why)

    n = 0
    for d in documents:
        body = d.get("route", d) if isinstance(d, dict) else {}
        start = body.get("from") if isinstance(body, dict) else None
        if start is None:
            continue
        uri = start if isinstance(start, str) else start.get("uri")
        steps = body.get("steps") or (start.get("steps") if isinstance(start, dict) else None)
        yield _route(path, n, body.get("id"), uri, list(walk(steps, False, None)))
        n += 1


def is_camel_yaml(text: str) -> bool:
    return bool(re.search(r"(?m)^-\s*(?:route|from)\s*:", text))


def root_tag(text: str) -> str:
    m = re.search(r"<(?![?!])(?:[\w.-]+:)?([\w.-]+)", re.sub(r"<!--.*?-->", "", text, flags=re.S))
    return m.group(1) if m else ""
