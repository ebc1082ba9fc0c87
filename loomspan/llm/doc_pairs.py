"""Functions paired with their documentation (problem 4).

Per language an island grammar reads only documentation, annotations, signatures and balanced bodies;
all other code is water that is skipped over, broken or not. What a documentation says is judged by
taking away whatever says nothing.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.common import current_rows
from loomspan.sources import lexers
from loomspan.llm.syntax import language_of

KINDS = ("function", "method", "constructor", "procedure")


class Island(NamedTuple):
    name: str
    owner: str  # enclosing names, joined by full stops
    line: int
    signature: str
    doc: str | None
    code: str


def _closing(tokens: list[lexers.Token], i: int, opening: str, closing: str) -> int:
    """Index of the token that closes the bracket at i, or the last one."""
    depth = 0
    for k in range(i, len(tokens)):
        t = tokens[k]
        if t.kind == "op":
            if t.text == opening:
                depth += 1
            elif t.text == closing:
                depth -= 1
                if depth == 0:
                    return k
        elif t.kind == "tpl":  # a template's values open and close without brackets of their own
            continue
    return len(tokens) - 1


def _one_line(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _curly_islands(text: str, tokens: list[lexers.Token], java: bool) -> Iterator[Island]:
    plain = [(k, t) for k, t in enumerate(tokens) if t.kind not in ("com", "err")]
    bare = [t for _, t in plain]
    classes: list[tuple[str, int]] = []  # names and the depths of their bodies
    depth, head = 0, None

    def doc_before(j: int) -> tuple[str | None, int]:
        """Documentation before the declaration that holds bare[j], and where the declaration starts."""
        k, start, level = plain[j][0] - 1, j, 0
        while k >= 0:
            t = tokens[k]
            if t.kind == "com":
                if t.text.startswith("/**") and len(t.text) > 4 and level == 0:
                    return t.text, start
            elif t.kind == "op" and t.text in (")", "]"):
                level += 1
                start -= 1
            elif t.kind == "op" and t.text in ("(", "["):
                level -= 1
                start -= 1
                if level < 0:
                    break
            elif level == 0 and (t.text in ("{", "}", ";") and t.kind == "op" or t.kind in ("err", "tpl") or (not java and t.nl and k + 1 < len(tokens) and t.text not in ("export", "default", "async", "static", "get", "set", "*", "const", "let", "=") and tokens[k + 1].nl)):
                break
            elif t.kind != "err":
                start -= 1
            k -= 1
        return None, max(start, 0)

    j = 0
    while j < len(bare):
        t = bare[j]
        if t.kind == "op" and t.text == "{":
            depth += 1
            if head is not None:
                classes.append((head, depth))
                head = None
        elif t.kind == "op" and t.text == "}":
            depth -= 1
            while classes and classes[-1][1] > depth:
                classes.pop()
        elif t.kind == "op" and t.text == ";":
            head = None
        elif t.kind == "id":
            before = bare[j - 1] if j else None
            after = bare[j + 1] if j + 1 < len(bare) else None
            if t.text in ("class", "interface", "enum", "record") and after and after.kind == "id" and not (before and before.text in (".", "::")):
                head = after.text
            opens = after is not None and after.kind == "op" and after.text == "("
            member = bool(classes) and classes[-1][1] == depth
            found, name = None, t.text
            if opens and member and (before is None or before.text not in (".", "new", "=", "@", ",", "(", "return")):
                close = _closing(bare, j + 1, "(", ")")
                behind = bare[close + 1] if close + 1 < len(bare) else None
                if behind and (behind.text == "{" or (java and (behind.text in ("throws", ";", "default")) and (before.kind == "id" or before.text in (">", "]")))) and (not java or before.kind == "id" or before.text in (">", "]", ";", "{", "}", ")")):
                    found = close
            elif not java and t.text == "function":
                k = j + 1 + (after is not None and after.text == "*")
                if k + 1 < len(bare) and bare[k].kind == "id" and bare[k + 1].text == "(":
                    name, found = bare[k].text, _closing(bare, k + 1, "(", ")")
            elif not java and after is not None and after.text == "=" and before is not None and before.text in ("const", "let", "var"):
                k = j + 2 + (j + 2 < len(bare) and bare[j + 2].text == "async")
                if k < len(bare) and (bare[k].text == "function" or (bare[k].text == "(" and (c := _closing(bare, k, "(", ")")) + 1 < len(bare) and bare[c + 1].text == "=>") or (bare[k].kind == "id" and k + 1 < len(bare) and bare[k + 1].text == "=>")):
                    found = k
            if found is not None:
                k = found
                while k < len(bare) - 1 and not (bare[k].kind == "op" and bare[k].text in ("{", ";")):
                    k += 1
                end = _closing(bare, k, "{", "}") if bare[k].text == "{" else k
                doc, start = doc_before(j)
                stop = bare[end].at + len(bare[end].text)
                yield Island(name, ".".join(c for c, _ in classes), lexers.line_of(text, t.at), _one_line(text[bare[start].at : bare[k].at]), doc, text[bare[start].at : stop])
        j += 1


def _python_islands(text: str) -> Iterator[Island]:
    tokens = [t for t in lexers.python(text) if t.kind not in ("com", "err")]
    starts = [m.end() for m in re.finditer(r"\A|\r\n|\r|\n", text)]
    inside: set[int] = set()  # starts of lines within a token
    for t in tokens:
        if t.kind == "str" and ("\n" in t.text or "\r" in t.text):
            inside.update(s for s in starts if t.at < s <= t.at + len(t.text))
    real = [t for t in tokens if t.kind not in ("nl", "indent", "dedent")]
    stack: list[tuple[int, str]] = []
    for j, t in enumerate(real):
        if t.kind != "id" or t.text not in ("def", "class") or j + 1 >= len(real) or real[j + 1].kind != "id":
            continue
        line = max(text.rfind("\n", 0, t.at), text.rfind("\r", 0, t.at)) + 1
        lead = text[line : t.at]
        if lead.strip() not in ("", "async"):
            continue
        indent = len(lead.expandtabs(8)) - len(lead.expandtabs(8).lstrip())
        while stack and stack[-1][0] >= indent:
            stack.pop()
        owner, name = ".".join(n for _, n in stack), real[j + 1].text
        stack.append((indent, name))
        if t.text == "class":
            continue
        k = j + 2
        if k < len(real) and real[k].text == "(":
            k = _closing(real, k, "(", ")") + 1
        level = 0
        while k < len(real) and not (real[k].text == ":" and level == 0 and real[k].kind == "op"):
            level += (real[k].text in ("(", "[", "{")) - (real[k].text in (")", "]", "}"))
            k += 1
        if k >= len(real):
            continue
        doc = None
        if k + 1 < len(real) and real[k + 1].kind == "str" and not re.match(r"[A-Za-z]*[bBfF]", real[k + 1].text):
            m = re.match(r"(?s)[rRuU]*('''|\"\"\"|'|\")(.*)\1$", real[k + 1].text)
            doc = m.group(2) if m else None
        end = len(text)
        for s in starts:
            if s > real[k].at and s not in inside:
                rest = text[s : s + 400]
                body = rest.lstrip(" \t\f")
                if body[:1] not in ("", "\n", "\r", "#") and len(rest[: len(rest) - len(body)].expandtabs(8)) <= indent:
                    end = s
                    break
        yield Island(name, owner, lexers.line_of(text, t.at), _one_line(text[line : real[k].at]), doc, text[line:end].rstrip())


def _sql_islands(text: str) -> Iterator[Island]:
    tokens = lexers.sql(text)
    for j, t in enumerate(tokens):
        if t.kind != "id" or t.text.lower() != "create":
            continue
        k = j + 1
        while k < len(tokens) and tokens[k].text.lower() in ("or", "replace", "editionable", "noneditionable"):
            k += 1
        if k + 1 >= len(tokens) or tokens[k].text.lower() not in ("function", "procedure"):
            continue
        k += 1
        parts = []
        while k < len(tokens) and tokens[k].kind == "id":
            parts.append(tokens[k].text.strip('"'))
            if tokens[k + 1].text != ".":
                break
            k += 2
        if not parts or tokens[k + 1].text != "(":
            continue
        close = _closing(tokens, k + 1, "(", ")")
        end = close
        while end < len(tokens) - 1 and not (tokens[end].kind == "op" and tokens[end].text == ";"):
            end += 1
        docs, place = [], t.at
        for c in reversed(tokens[:j]):
            if c.kind != "com" or len(re.findall(r"\r\n|\r|\n", text[c.at + len(c.text) : place])) > 1:
                break
            docs.append(c.text)
            place = c.at
        stop = tokens[close].at + 1
        yield Island(parts[-1], ".".join(parts[:-1]), lexers.line_of(text, t.at), _one_line(text[t.at : stop]), "\n".join(reversed(docs)) or None, text[t.at : tokens[end].at + len(tokens[end].text)])


def islands(text: str, language: str) -> list[Island]:
    """Functions and methods of a file; none for other languages."""
    if language == "python":
        return list(_python_islands(text))
    if language in ("java", "javascript"):
        return list(_curly_islands(text, lexers.java(text) if language == "java" else lexers.javascript(text), language == "java"))
    return list(_sql_islands(text)) if language == "sql" else []


# What a documentation says

_MARKS = re.compile(r"(?m)^[ \t]*(?:/\*+!?|\*+/|\*(?!\*)|//+!?|--+|#+!?|\"\"\"|''')[ \t]?|\*+/[ \t]*$|(?:\"\"\"|''')[ \t]*$")
_MARKUP = re.compile(r"</?[A-Za-z][^<>\n]*>|<!--.*?-->|\{@(?:inheritDoc|docRoot)\}", re.S)
# Directives of tools, notes on licence and generation, references, as patterns.
_DIRECTIVE = re.compile(
    r"(?i)^\W*(?:noqa|nosec|pylint|flake8|mypy|pyright|type:\s*ignore|fmt:|yapf:|isort:|black:|ruff:|pragma|coverage|eslint|jshint|jslint|tslint|prettier|@?ts-(?:ignore|expect|nocheck)|@ts-\w+|istanbul|c8|stylelint|"
    r"nosonar|checkstyle|noinspection|suppress\w*|@formatter|sqlfluff|nolint|spotless|region|endregion|vim:|-\*-)"
)
_LEGAL = re.compile(
    r"(?i)copyright|\(c\)\s*\d{4}|©|all rights reserved|licen[cs]ed\s+(?:under|to\s+the|by|as)\b|\bunder\s+the\b.*\blicen[cs]e|\b(?:see|read)\b.*\blicen[cs]e\b|\blicen[cs]e\s*(?:[:=]|header|notice|file|text|terms|agreement|information|,?\s*v(?:ersion)?\b|\d)"
    r"|\b(?:apache|mit|bsd|[al]?gpl|mpl|epl|isc|eclipse|mozilla|public|creative\s+commons)\b[\w\s.-]*\blicen[cs]e|spdx-|no warranty|warranties|without warranty"
    r"|auto-?generated|^\W*generated\W*$|^\W*generated\s+(?:by|from|code|with|file|on|at|using|automatically|source|sources|class|stub|stubs)\b|generated (?:by|from|code|with|file)|do not (?:edit|modify)"
    r"|created by .*generator|changes will be lost|@generated"
)
_REFERENCE = re.compile(
    r"(?i)^\W*(?:@?see(?: also)?\b(?:\W+(?:the|other|above|below|there|docs?|documentation|readme|manual|super\w*|parent|base|class|interface|method|function|of|in|for|[#\w.]*[#.(]\S*|\{@link[^}]*\}|https?:\S+))*\W*$"
    r"|\(?non-javadoc\)?|@?inherit(?:ed)?-?docs?\b|@override\b|overrides?\W*$|https?://\S+\W*$)"
)
_TASK = re.compile(r"(?i)^\W*(?:todo|fixme|xxx|tbd|hack)\s*(?:\([^)]*\))?\s*:\s*[^.!?]*(?:[.!?]+|$)")
_MARKER = re.compile(r"(?i)^\W*(?:todo|fixme|xxx|tbd|hack)\b(?:\s*\([^)]*\)\s*:?)?|\bTODO\b|\bFIXME\b|\bXXX\b")
_TAG = re.compile(r"^\s*(?:[@\\](\w+)|:(\w+)(?:\s+[^:\n]*)?:)")
_SECTIONS = re.compile(r"(?i)^\s*(?:args|arguments|parameters|params|returns?|yields?|raises|throws|exceptions?|examples?|notes?|attributes|see also)\s*:?\s*$")
_NAMED = re.compile(r"^\s*\*{0,2}(\w+)\s*(?:\([^)]*\))?\s*:(?!:)\s*")
_CODE = re.compile(
    r"^\s*(?:.*[;{}]|[)\]}]+[;,]?|[\w.]+(?:\[[^\]]*\])?\s*(?:[-+*/|&]?=|:=)\s*\S.*|[\w.]+\([^()]*\)|(?:if|for|while|elif|with|def|class|try|else)\b.*:|(?:return|yield|raise|throw|await|del)\b\s*[\w.]*[\[({].*|return\s+[\w.]+)\s*$"
)
# Words that open statements of the languages, which prose doesn't open with, nor with one in capitals.
_STATEMENT = re.compile(r"\s*(?:return|throw|raise|yield|await|delete|del|new|import|from|package|final|private|public|protected|static|var|let|const|int|long|double|float|boolean|char|void|class|goto|end|begin|commit|call|perform)\b|\s*[A-Z]{3,}\b")
_PROSE = re.compile(r"\s*[^\W\d_]+(?:,?\s+[^\W\d_]+){2,}\s*;\s*$")  # words alone, three at least


def _is_code(line: str) -> bool:
    """Whether a line is a statement rather than a sentence that happens to end like one."""
    return bool(_CODE.match(line)) and not (_PROSE.match(line) and not _STATEMENT.match(line))


# Words that only hold a place, and words that add nothing to a name.
_PLACEHOLDER = frozenset(
    """todo fixme xxx tbd na none null nil n a no not documentation documented document doc docs docstring description desc describe comment comments here follow follows to
    come coming soon later add write explain fill in me please this missing needed wip stub placeholder undocumented empty pending before the next release of and or is be
    will revisit lorem ipsum dolor sit amet foo bar baz test text something insert your yet""".split()
)
_FILLER = frozenset(
    """the a an this that these those is are was be of for to and or in on with from by it its as at into function functions method methods procedure procedures constructor
    constructors proc func fn ctor routine sub class object instance getter setter accessor get gets set sets return returns returned result results value values param
    params parameter parameters arg args argument arguments given new void self cls p create creates simple""".split()
)
_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[\W_]+")


def _stem(word: str) -> str:
    word = word.lower()
    for end in ("ations", "ation", "ings", "ing", "ers", "er", "ors", "or", "ies", "es", "ed", "s", "e", "y"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)]
    return word


def own_words(*names: str | None) -> set[str]:
    """Stems of the words in identifiers and signatures."""
    return {_stem(w) for n in names if n for w in _CAMEL.split(n) if w}


def _sentences(line: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+(?=\S)|(?<=[。！？])", line) if s.strip()]


def meaning(doc: str, own: set[str]) -> str:
    """What is left of a documentation once all that says nothing is dropped: comment marks, rules,
    placeholders, the entity's own words, empty tags, markup, directives, licence and generation notes,
    references and disabled code. Empty if nothing is left."""
    text = html.unescape(_MARKUP.sub(" ", doc))
    lines = [_MARKS.sub("", x).rstrip() for x in re.split(r"\r\n|\r|\n", text)]
    if _LEGAL.search(text):
        lines = [x if not re.match(r"(?i)\s*licen[cs]ed under|\s*no warranty", x) else "" for x in lines]
    kept, code, own, section = [], 0, set(own), False
    for line in lines:
        if not line.strip() or _DIRECTIVE.match(line) or _SECTIONS.match(line):
            section = section or bool(line.strip())
            continue
        if code or _is_code(line):  # disabled code, within whose brackets all lines are code
            code = max(0, code + line.count("{") + line.count("(") - line.count("}") - line.count(")"))
            continue
        tag = _TAG.match(line)
        if tag:
            word = (tag.group(1) or tag.group(2)).lower()
            if word in ("see", "inheritdoc", "override", "author", "since", "version", "generated", "link", "type", "rtype"):
                continue
            line = line[tag.end() :]
            if tag.group(1) and word in ("param", "arg", "argument", "throws", "exception", "raises"):
                first = re.match(r"\s*(?:\{[^}]*\}\s*)?\[?([\w.]+)\]?", line)
                own |= own_words(first.group(1)) if first else set()
        else:
            named = _NAMED.match(line)
            if named and (section or _stem(named.group(1)) in own):
                own |= own_words(named.group(1))
                line = line[named.end() :]
        said = []
        for sentence in _sentences(line):
            sentence = _TASK.sub("", sentence)
            if not sentence.strip() or _LEGAL.search(sentence) or _REFERENCE.match(sentence) or _DIRECTIVE.match(sentence):
                continue
            sentence = _MARKER.sub(" ", sentence)
            words = [w for part in _WORD.findall(sentence) for w in _CAMEL.split(part) if w]
            if all(w.lower() in _PLACEHOLDER or w.lower() in _FILLER or _stem(w) in own for w in words):
                continue
            said.append(_one_line(sentence))
        if said:
            kept.append(" ".join(said))
    return "\n".join(kept)


def file_islands(files: DataFrame, sources: DataFrame) -> DataFrame:
    """path, language, name, owner, line, signature, doc and code of all functions in source files."""
    typed = sources.filter("path IS NOT NULL").groupBy("path").agg(F.max_by("source_type", F.when(F.col("source_type").isNotNull(), F.col("ingested_at"))).alias("source_type"))
    rows = files.filter("path IS NOT NULL AND content IS NOT NULL").select("path", "content").distinct().join(typed, "path", "left")
    rows = rows.select("path", language_of(F.col("source_type"), F.col("path")).alias("language"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("path", "language", "name", "owner", "line", "signature", "doc", "code")}
            for path, language, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for x in islands(content, language):
                    for field, value in zip(out, (path, language, *x), strict=True):
                        out[field].append(value)
            clean = lambda v: v.encode("utf-8", "replace").decode() if isinstance(v, str) else v
            yield pa.RecordBatch.from_arrays([pa.array([clean(v) for v in out[f]], pa.int32() if f == "line" else pa.string()) for f in out], names=list(out))

    return rows.mapInArrow(run, "path string, language string, name string, owner string, line int, signature string, doc string, code string")


def documented_pairs(entities: DataFrame, files: DataFrame, sources: DataFrame) -> DataFrame:
    """qualified_name, kind, language, signature, description, code and origin (docstring or file): the
    functions whose documentation says something, one row per qualified_name.

    An entity is its current row, deleted or not. Its function in the file is the island of that name
    whose owner, signature and line fit best, wherever it has moved to. A null docstring is replaced by
    the documentation found there; an empty one stands for itself. Entities without a file or function
    have null code. Null names, kinds and signatures are allowed; rows without qualified_name drop out.
    """
    now = current_rows(entities, "qualified_name", "name", "kind", "language", "file_path", "start_line", "signature", "docstring")
    now = now.withColumn("kind", F.lower(F.trim("kind"))).filter(F.col("kind").isin(*KINDS))
    now = now.withColumn("name", F.coalesce("name", F.regexp_extract("qualified_name", r"([^.()]+)(?:\([^()]*\))?$", 1)))
    found = file_islands(files, sources).select(
        F.col("path").alias("file_path"), "name", "owner", "line", F.col("signature").alias("found_signature"), F.col("language").alias("found_language"), "doc", "code"
    )
    squeezed = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s;{:]+", "")
    fit = F.struct(
        (squeezed(F.col("signature")) == squeezed(F.col("found_signature"))).alias("same"),
        F.expr("contains(qualified_name, concat('.', owner, '.', name)) OR contains(qualified_name, concat(owner, '.', name))").alias("owned"),
        (-F.abs(F.coalesce(F.col("start_line"), F.lit(0)) - F.col("line"))).alias("near"),
        F.col("line").alias("line"),
    )
    own = [c for c in now.columns if c not in ("live", "first_at")]
    best = (
        now.join(found, ["file_path", "name"], "left")
        .groupBy("qualified_name")
        .agg(F.max(F.when(F.col("line").isNotNull(), F.struct(fit.alias("fit"), "doc", "code", "found_signature", "found_language"))).alias("f"), *(F.first(c).alias(c) for c in own if c != "qualified_name"))
        .select(
            "qualified_name", "kind", F.coalesce("language", "f.found_language").alias("language"), "name", F.coalesce("signature", "f.found_signature").alias("signature"),
            F.when(F.col("docstring").isNotNull(), "docstring").otherwise("file").alias("origin"), F.coalesce("docstring", "f.doc").alias("doc"), F.col("f.code").alias("code"),
        )
        .filter("doc IS NOT NULL")
    )
    out = ["qualified_name", "kind", "language", "signature", "description", "code", "origin"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = dict(zip(batch.schema.names, (x.to_pylist() for x in batch.columns), strict=True))
            said = []
            for q, name, kind, signature, doc in zip(c["qualified_name"], c["name"], c["kind"], c["signature"], c["doc"], strict=True):
                inner = re.search(r"\((.*)\)", signature or "", re.S)
                owner = re.split(r"[.(]", q.split("(")[0])[-2:]
                said.append(meaning(doc, own_words(name, kind, inner.group(1) if inner else None, *(owner if kind == "constructor" else owner[-1:]))))
            keep = [k for k, s in enumerate(said) if s]
            c["description"] = said
            yield pa.RecordBatch.from_arrays([pa.array([c[f][k] for k in keep], pa.string()) for f in out], names=out)

    return best.mapInArrow(run, ", ".join(f"{f} string" for f in out))
