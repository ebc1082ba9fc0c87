"""Text helpers as column expressions: escapes, globs, paths, names, redaction, windows of words."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.common import words
from loomspan.sources.documents import SECRET_MARKERS

# Metacharacters of full-text query syntax.
QUERY_SPECIAL = r'([+\-!(){}\[\]^"~*?:\\/&|])'
TOKEN = r"[\p{L}\p{N}_]+"


def escape_query(c: Column) -> Column:
    """Query text with every metacharacter escaped; null for null."""
    return F.regexp_replace(c, QUERY_SPECIAL, r"\\$1")


def tokens(c: Column) -> Column:
    """Lower-case words of letters, digits and underscores, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def glob_pattern(glob: str) -> str:
    """A glob as a pattern to find within a path: * is any run, ? one character, and an end is free
    unless it's pinned by ^ or $."""
    start, end = glob.startswith("^"), glob.endswith("$") and len(glob) > 1
    core = glob[start : len(glob) - end if end else None]
    body = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in core)
    return ("^" if start else "") + body + ("$" if end else "")


def matches_glob(c: Column, glob: str) -> Column:
    return c.rlike("(?s)" + glob_pattern(glob))


def normal_route(c: Column) -> Column:
    """A route with its variables as {} and without slashes at its end; / for null and empty ones."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"\{[^}]*\}", "{}")
    cut = F.when(F.length(bare) > 1, F.regexp_replace(bare, "/+$", "")).otherwise(bare)
    return F.when(cut == "", "/").otherwise(cut)


def simple_name(c: Column) -> Column:
    """What stands behind the last full stop."""
    return F.regexp_extract(c, r"[^.]*$", 0)


def decapitalised(c: Column) -> Column:
    """A type's name as the name of its instance: first letter small, unless the second is a capital too."""
    return F.when(c.rlike(r"^.\p{Lu}"), c).otherwise(F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30)))


def redacted(key: Column, value: Column) -> Column:
    """value, or *** where the key names a secret or has a part that is just "key"."""
    low = F.lower(key)
    secret = F.array_contains(F.split(F.translate(F.replace(low, F.lit("["), F.lit(".")), "]", ""), r"\."), "key")
    for marker in SECRET_MARKERS:
        secret = secret | low.contains(marker)
    return F.when(secret, "***").otherwise(value)


def word_windows(text: Column, size: int = 400, overlap: int = 60) -> Column:
    """Windows of `size` words, each repeating the last `overlap` of the one before, as an array of
    (order, text, token_count); empty for texts without words. The last window ends the text."""
    ws, step = words(F.coalesce(text, F.lit(""))), size - overlap
    n = F.size(ws)
    starts = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step)).cast("int"))))
    return F.transform(
        starts,
        lambda i: F.struct(
            i.alias("order"),
            F.array_join(F.slice(ws, i * step + 1, size), " ").alias("text"),
            F.size(F.slice(ws, i * step + 1, size)).alias("token_count"),
        ),
    )


def word_chunks(rows: DataFrame, text: str, keep: list[str], size: int = 400, overlap: int = 60) -> DataFrame:
    """keep, chunk_order, chunk_text and token_count: word_windows() as rows. The words are split once per
    row and windows cut behind the explosion, so that nothing is evaluated again for each window."""
    step = size - overlap
    worded = rows.select(*keep, words(F.coalesce(F.col(text), F.lit(""))).alias("_ws")).filter(F.size("_ws") > 0)
    n = F.size("_ws")
    at = worded.select(*keep, "_ws", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step)).cast("int")))).alias("chunk_order"))
    cut = at.withColumn("_w", F.slice("_ws", F.col("chunk_order") * step + 1, size))
    return cut.select(*keep, "chunk_order", F.array_join("_w", " ").alias("chunk_text"), F.size("_w").alias("token_count"))


def citation(path: Column, breadcrumb: Column, start: Column, end: Column) -> Column:
    """Path, breadcrumb and pages, as far as there are any."""
    pages = F.when(start.isNull(), "").when(end.isNull() | (start == end), F.concat(F.lit(" (p. "), start, F.lit(")"))).otherwise(
        F.concat(F.lit(" (pp. "), start, F.lit("–"), end, F.lit(")"))
    )
    return F.concat(path, F.lit(" — "), F.coalesce(breadcrumb, F.lit("")), pages)
