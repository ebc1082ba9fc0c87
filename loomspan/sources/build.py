"""Build files as records: Maven and Gradle modules with their dependencies."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from loomspan.sources.documents import Record


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _child(e: ET.Element | None, *names: str) -> ET.Element | None:
    for name in names:
        e = next((c for c in e if _tag(c) == name), None) if e is not None else None
    return e


def _text(e: ET.Element | None, *names: str) -> str | None:
    e = _child(e, *names)
    return e.text.strip() if e is not None and e.text and e.text.strip() else None


def interpolated(value: str | None, known: dict[str, str], rounds: int = 10) -> str | None:
    """value with its ${names} replaced until nothing changes, at most `rounds` times."""
    for _ in range(rounds):
        if value is None or "${" not in value:
            break
        new = re.sub(r"\$\{([^}]+)\}", lambda m: known.get(m.group(1), m.group()), value)
        if new == value:
            break
        value = new
    return value


def maven(path: str, text: str) -> Iterator[Record]:
    """The module of a pom.xml, coordinates inherited from its parent, and its dependencies."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return
    if _tag(root) != "project":
        return
    folder = path.rpartition("/")[0]
    known = {_tag(p): (p.text or "").strip() for p in (_child(root, "properties") if _child(root, "properties") is not None else [])}
    group = _text(root, "groupId") or _text(root, "parent", "groupId")
    version = _text(root, "version") or _text(root, "parent", "version")
    artifact = _text(root, "artifactId")
    for prefix in ("project.", "pom.", ""):
        known |= {prefix + k: v for k, v in (("groupId", group), ("version", version), ("artifactId", artifact)) if v}
    parent = _child(root, "parent")
    if parent is not None:
        known |= {f"project.parent.{_tag(c)}": (c.text or "").strip() for c in parent}
    fill = lambda v: interpolated(v, known)
    children = [fill(m.text.strip()) for m in (_child(root, "modules") if _child(root, "modules") is not None else []) if m.text]
    sources = [s for s in (_text(root, "build", "sourceDirectory"), _text(root, "build", "testSourceDirectory")) if s] or ["src/main/java", "src/test/java"]
    yield "module", {"path": folder, "build": "maven", "group_id": fill(group), "artifact_id": fill(artifact), "version": fill(version), "packages": [fill(group)] if group else [], "modules": children, "source_roots": [fill(s) for s in sources]}
    for d in _child(root, "dependencies") if _child(root, "dependencies") is not None else []:
        g, a, v = (fill(_text(d, n)) for n in ("groupId", "artifactId", "version"))
        if g and a:
            yield "dependency", {"module": folder, "gav": ":".join(x for x in (g, a, v) if x), "group_id": g, "artifact_id": a, "scope": _text(d, "scope") or "compile"}


# Names of Gradle's dependency configurations.
_CONFIGURATIONS = "api implementation compile compileOnly compileOnlyApi runtime runtimeOnly annotationProcessor kapt testImplementation testRuntimeOnly testCompileOnly".split()
_SUFFIXES = ("Api", "Implementation", "CompileOnly", "RuntimeOnly", "AnnotationProcessor")


def gradle(path: str, text: str) -> Iterator[Record]:
    """The module of a Gradle build or settings file, by its flat calls and assignments; what stands in
    subprojects and allprojects blocks isn't its own."""
    bare = re.sub(r"/\*.*?\*/|(?<![:\"'])//[^\n]*", " ", text, flags=re.S)
    bare = _without_blocks(bare, ("subprojects", "allprojects"))
    folder = path.rpartition("/")[0]
    assigned: dict[str, str] = {}
    for name, value in re.findall(r"(?m)^\s*(group|version|rootProject\.name)\s*(?:=|\s|\()\s*[\"']([^\"']+)[\"']", bare):
        assigned.setdefault(name, value)
    included = []
    for call in re.findall(r"(?m)^\s*include\b\s*\(?([^\n)]*(?:,\s*\n[^\n)]*)*)", bare):
        included += [x.strip(":").replace(":", "/") for x in re.findall(r"[\"']([^\"']+)[\"']", call)]
    roots = re.findall(r"srcDirs?\s*(?:=|\(|\s)\s*\[?\s*[\"']([^\"']+)[\"']", bare)
    group = assigned.get("group")
    artifact = assigned.get("rootProject.name") or folder.rpartition("/")[2] or None
    yield "module", {"path": folder, "build": "gradle", "group_id": group, "artifact_id": artifact, "version": assigned.get("version"), "packages": [group] if group else [], "modules": included, "source_roots": roots or ["src/main/java", "src/test/java"]}
    for name, rest in re.findall(r"(?m)^\s*(\w+)\s*\(?\s*(?:platform\s*\(\s*)?((?:project\s*\(?[^\n]*|[\"'][^\"'\n]+[\"'][^\n]*))", bare):
        if name not in _CONFIGURATIONS and not name.endswith(_SUFFIXES):
            continue
        project = re.match(r"project\s*\(?\s*(?:path\s*[:=]\s*)?[\"']([^\"']+)[\"']", rest)
        coordinates = re.match(r"[\"']([^:\"']+):([^:\"']+)(?::([^:\"'@]+))?", rest)
        if project:
            yield "dependency", {"module": folder, "gav": f"project:{project.group(1).strip(':')}", "group_id": None, "artifact_id": project.group(1).rpartition(":")[2], "scope": name}
        elif coordinates:
            yield "dependency", {"module": folder, "gav": ":".join(x for x in coordinates.groups() if x), "group_id": coordinates.group(1), "artifact_id": coordinates.group(2), "scope": name}


def _without_blocks(text: str, names: tuple[str, ...]) -> str:
    out: list[str] = []
    i = 0
    pattern = re.compile(rf"\b(?:{'|'.join(names)})\b[^{{\n]*\{{")
    while m := pattern.search(text, i):
        out.append(text[i : m.start()])
        depth, i = 1, m.end()
        while depth and i < len(text):
            depth += (text[i] == "{") - (text[i] == "}")
            i += 1
    return "".join([*out, text[i:]])


