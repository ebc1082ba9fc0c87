"""Code indexes in the SCIP format: a reader of its protocol-buffer bytes, and entities and calls by range.

Field numbers are those of the public schema: an index has documents (2), a document its path (1),
occurrences (2) and symbols (3).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators.store import enclosing


def varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[i]
        value |= (byte & 127) << shift
        i += 1
        if byte < 128:
            return value, i
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, Any]]:
    """(number, value) of a message: ints for numbers, bytes for everything with a length."""
    i = 0
    while i < len(data):
        key, i = varint(data, i)
        kind = key & 7
        if kind == 0:
            value, i = varint(data, i)
        elif kind == 2:
            size, i = varint(data, i)
            value, i = data[i : i + size], i + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, i = data[i : i + size], i + size
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


def packed(data: bytes) -> list[int]:
    out, i = [], 0
    while i < len(data):
        v, i = varint(data, i)
        out.append(v)
    return out


def symbol_name(symbol: str) -> tuple[str, str] | None:
    """Dotted name and kind of a global symbol (scheme manager package version descriptors); None for
    local ones. Descriptors end in / for namespaces, # for types, (). for methods, . for terms."""
    if symbol.startswith("local "):
        return None
    text = symbol.split(" ", 4)[-1]
    parts, kind, held, quoted = [], "", "", False
    i = 0
    while i < len(text):
        c = text[i]
        if c == "`":
            quoted = not quoted
        elif quoted:
            held += c
        elif c in "/#.:!":
            parts.append(held)
            kind, held = {"/": "package", "#": "class", ".": "field", ":": "meta", "!": "macro"}[c], ""
        elif c == "(":
            end = text.index(")", i)
            if text[end + 1 : end + 2] == ".":
                parts.append(held)
                kind, i = "method", end + 1
            else:  # a parameter
                parts.append(text[i + 1 : end])
                kind, i = "parameter", end
            held = ""
        elif c == "[":
            i = text.index("]", i)
            kind = "type parameter"
        else:
            held += c
        i += 1
    return ".".join(p for piece in parts for p in piece.split("/") if p), kind


def read(data: bytes) -> Iterator[tuple[str, dict[str, Any]]]:
    """occurrence and symbol records of an index. Lines count from 0; a range's end is exclusive."""
    for number, document in fields(data):
        if number != 2:
            continue
        path = next((v.decode() for n, v in fields(document) if n == 1), "")
        for n, v in fields(document):
            if n == 2:
                row: dict[str, Any] = {"path": path, "symbol": "", "roles": 0, "range": [], "enclosing": []}
                for k, x in fields(v):
                    if k == 1:
                        row["range"] = packed(x)
                    elif k == 2:
                        row["symbol"] = x.decode()
                    elif k == 3:
                        row["roles"] = x
                    elif k == 7:
                        row["enclosing"] = packed(x)
                span, around = row.pop("range"), row.pop("enclosing")
                start, end = span[0], span[2] if len(span) == 4 else span[0]
                first, last = (around[0], around[2] if len(around) == 4 else around[0]) if around else (start, end)
                yield "occurrence", {**row, "start_line": start, "end_line": end, "body_start": first, "body_end": last}
            elif n == 3:
                relations, docs, name = [], [], ""
                for k, x in fields(v):
                    if k == 1:
                        name = x.decode()
                    elif k == 3:
                        docs.append(x.decode())
                    elif k == 4:
                        r = dict(fields(x))
                        relations.append((r.get(1, b"").decode(), bool(r.get(3))))
                yield "symbol", {"path": path, "symbol": name, "documentation": "\n".join(docs) or None, "implements": [s for s, i in relations if i]}


def decode(files: DataFrame) -> DataFrame:
    """Occurrences of index files (content binary): path, symbol, name, kind, roles, lines and body lines."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = []
            for content in batch.column(0).to_pylist():
                for tag, r in read(content or b""):
                    if tag == "occurrence":
                        name = symbol_name(r["symbol"])
                        rows.append({**r, "name": name[0] if name else None, "kind": name[1] if name else "local"})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("symbol", pa.string()), ("roles", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("body_start", pa.int32()), ("body_end", pa.int32()), ("name", pa.string()), ("kind", pa.string())]))

    return files.select("content").mapInArrow(run, "path string, symbol string, roles int, start_line int, end_line int, body_start int, body_end int, name string, kind string")


def entities(occurrences: DataFrame) -> DataFrame:
    """Classes and methods that the index defines."""
    return occurrences.filter("roles & 1 = 1 AND kind IN ('class', 'method')").select(F.col("name").alias("qualified_name"), "kind", F.col("path").alias("file_path"), (F.col("body_start") + 1).alias("start_line"), (F.col("body_end") + 1).alias("end_line")).distinct()


def calls(occurrences: DataFrame) -> DataFrame:
    """(src, dst): the innermost method around each reference to a method, and that method."""
    methods = occurrences.filter("roles & 1 = 1 AND kind = 'method'").select("path", "body_start", "body_end", F.col("name").alias("src"))
    uses = occurrences.filter("roles & 1 = 0 AND kind = 'method'").select("path", "start_line", F.col("name").alias("dst"))
    return enclosing(uses, methods, "path", "start_line", "body_start", "body_end", "src").filter("src IS NOT NULL AND src <> dst").select("src", "dst").distinct()


def occurrences_of(spark: SparkSession, folder: str) -> DataFrame:
    return decode(spark.read.format("binaryFile").option("pathGlobFilter", "*.scip").option("recursiveFileLookup", "true").load(folder))
