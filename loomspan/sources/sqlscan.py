"""Tables that SQL text reads and writes, by its tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.sources import lexers

# The words after which a table is named, and whether it's written there.
OPENERS = {("insert", "into"): True, ("delete", "from"): True, ("merge", "into"): True, ("update",): True, ("from",): False, ("join",): False}
_NAME = re.compile(r"[A-Za-z_][\w$]*")


def _mentions(text: str) -> Iterator[tuple[str, bool]]:
    """Dotted names behind an opener, in order, and whether they're written. Comments and literals are no tokens here."""
    t = [x for x in lexers.sql(text) if x.kind not in ("com", "err", "str")]
    words = [x.text.lower() if x.kind == "id" else "" for x in t]
    for k in range(len(t)):
        if t[k].kind == "dollar":  # a routine's body
            mark = t[k].text[: t[k].text.index("$", 1) + 1]
            yield from _mentions(t[k].text.removeprefix(mark).removesuffix(mark))
        for opener, writes in OPENERS.items():
            n = len(opener)
            if tuple(words[k : k + n]) != opener or (opener == ("from",) and k and words[k - 1] == "delete"):
                continue
            parts, at = [], k + n
            while at < len(t) and t[at].kind == "id" and _NAME.fullmatch(t[at].text):
                parts.append(t[at].text)
                at += 1
                if not (at + 1 < len(t) and t[at].text == "." and t[at].at == t[at - 1].at + len(t[at - 1].text)):
                    break
                at += 1
            if parts:
                yield ".".join(parts), writes


def tables(text: str) -> tuple[list[str], list[str]]:
    """Tables that SQL writes, and those it only reads, as written, each once, in order."""
    found = list(_mentions(text))
    written = list(dict.fromkeys(name for name, writes in found if writes))
    return written, [n for n in dict.fromkeys(name for name, writes in found if not writes) if n not in written]


def table_mentions(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, name (last part) and mode (write or read): the tables of each row's SQL; written ones aren't also read.
    Null and empty texts give no rows, nor do texts without tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, names, modes = [], [], []
            for n, sql in enumerate(batch.column(1).to_pylist()):
                written, read = ({x.rsplit(".", 1)[-1]: None for x in side} for side in tables(sql or ""))
                for mode, side in (("write", written), ("read", [x for x in read if x not in written])):
                    for name in side:
                        at.append(n)
                        names.append(name)
                        modes.append(mode)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(modes, pa.string())], names=[key, "name", "mode"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key), F.col(text).alias("_sql")).mapInArrow(run, f"`{key}` {kind}, name string, mode string")
