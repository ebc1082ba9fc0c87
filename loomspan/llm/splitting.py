"""Oversized chunks cut at natural boundaries (problem 1).

The least number of pieces is computed, equal targets are laid, each target is moved to the strongest
boundary nearby, and a piece is added whenever a limit fails.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.common import words

LIMIT, OVERLAP = 400, 60  # words of a piece with its breadcrumb; words a piece repeats
LEAST_NEW = 1  # new word that a piece must have room for, else the breadcrumb is cut from its front
REACH = 0.2  # how far a target may move, as a share of a piece's length

_TOKEN = re.compile(r"\S+")
_SENTENCE = re.compile(r"[.!?…。！？][\"'”»)\]*_`]*$")
_CLAUSE = re.compile(r"[,;:、，；：][\"'”»)\]*_`]*$")
_BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_ITEM = re.compile(r"(?:[-*+•]|\d{1,3}[.)]|\||>)$")
# Strengths of boundaries, from none to the start of a section.
NONE, CLAUSE, LINE_OF_CODE, SENTENCE, LINE, ITEM, PARAGRAPH, SECTION = range(8)
NAMES = ("none", "clause", "code line", "sentence", "line", "item", "paragraph", "section")


def text_words(text: str) -> list[tuple[int, int]]:
    """Starts and ends of the words of str.split()."""
    out, at = [], 0
    for w in text.split():
        at = text.index(w, at)
        out.append((at, at + len(w)))
        at += len(w)
    return out


def boundaries(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """Strength of the boundary before each word; code within fences is only cut between its lines."""
    out, fenced = [SECTION], text[spans[0][0] : spans[0][1]].startswith("```") if spans else False
    for (a, b), (c, d) in zip(spans, spans[1:], strict=False):
        before, after = text[a:b], text[c:d]
        lines = len(_BREAK.findall(text[b:c]))
        fence = lines > 0 and after.startswith(("```", "~~~"))
        closed = fenced and before.endswith(("```", "~~~")) and lines > 0
        if fenced and not closed:
            strength = LINE_OF_CODE if lines and not fence else NONE
        elif lines and after.startswith("#") and not after.strip("#"):
            strength = SECTION
        elif lines > 1 or fence or closed:
            strength = PARAGRAPH
        elif lines and _ITEM.match(after):
            strength = ITEM
        elif lines:
            strength = LINE
        elif _SENTENCE.search(before):
            strength = SENTENCE
        else:
            strength = CLAUSE if _CLAUSE.search(before) else NONE
        if closed:
            fenced = False
        if fence and not fenced:
            fenced = not (len(after) > 3 and after.endswith(("```", "~~~")))
        out.append(strength)
    return out


def cuts(strength: list[int], room: int, overlap: int) -> list[int]:
    """Word numbers at which new pieces start: as few as possible, as even as the boundaries allow.
    room: words of a piece, those it repeats included."""
    n, fresh = len(strength), room - overlap
    if n <= room:
        return []
    pieces = 1 + -(-(n - room) // fresh)
    while True:
        length = (n + (pieces - 1) * overlap) / pieces
        out, at = [], 0
        for k in range(1, pieces):
            target = round(length + (k - 1) * (length - overlap))
            reach = int(REACH * length)
            low = max(target - reach, n - (pieces - k) * fresh, at + 1, overlap)
            high = min(target + reach, at + (fresh if out else room), n - 1)
            if low > high:
                break
            at = max(range(low, high + 1), key=lambda i: (strength[i] - abs(i - target) / (reach + 1), -i))
            out.append(at)
        else:
            if n - at <= fresh:
                return out
        pieces += 1


def split_text(text: str, breadcrumb: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[dict]:
    """Pieces of a text: text (an unchanged stretch of it), breadcrumb, words (of both), first_word,
    last_word, repeated (words that the piece before ends in) and boundary.

    A breadcrumb that leaves less room than overlap + LEAST_NEW loses words at its front. A text that
    fits comes back as one piece; a text without words gives one piece of no words.
    """
    crumb = (breadcrumb or "").split()
    kept = breadcrumb
    if len(crumb) > limit - overlap - LEAST_NEW:
        crumb = crumb[len(crumb) - (limit - overlap - LEAST_NEW) :]
        kept = " ".join(crumb)
    spans = text_words(text)
    strength = boundaries(text, spans) if spans else []
    starts = [0, *cuts(strength, limit - len(crumb), overlap)]
    out = []
    for k, (start, end) in enumerate(zip(starts, [*starts[1:], len(spans)], strict=True)):
        first = start - overlap if k else 0
        piece = text[spans[first][0] : spans[end - 1][1]] if spans else ""
        out.append(
            {"text": piece, "breadcrumb": kept, "words": end - first + len(crumb), "first_word": first, "last_word": end - 1, "repeated": start - first, "boundary": NAMES[strength[start]] if spans else NAMES[NONE]}
        )
    return out


_PIECE = "text:string,breadcrumb:string,words:int,first_word:int,last_word:int,repeated:int,boundary:string"


def oversized_pieces(chunks: DataFrame, sections: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """chunk_id, piece, n_pieces and the fields of split_text(): the pieces of each chunk whose words and
    whose section's breadcrumb together exceed limit, whatever token_count says.

    Null and blank texts count no words, sections that are missing or have a null breadcrumb neither.
    Rows with a null id drop out; copies of a chunk give one set of pieces, of the largest row if they
    differ. Words are counted while scanning; only rows that can exceed the limit with the longest
    breadcrumb of all are shuffled, and a section that holds a third of them is split by AQE.
    """
    crumbs = sections.filter("id IS NOT NULL").groupBy(F.col("id").alias("section_id")).agg(F.max("breadcrumb").alias("breadcrumb"))
    crumbs = crumbs.withColumn("crumb_words", F.coalesce(F.size(words(F.col("breadcrumb"))), F.lit(0)))
    longest = sections.select(F.coalesce(F.max(F.size(words(F.col("breadcrumb")))), F.lit(0)).alias("longest"))
    rows = (
        chunks.select(F.col("id").alias("chunk_id"), "section_id", "text")
        .filter("chunk_id IS NOT NULL AND text IS NOT NULL")
        .withColumn("text_words", F.size(words(F.col("text"))))
        .filter(F.col("text_words") + longest.scalar() > limit)
        .groupBy("chunk_id")
        .agg(F.max(F.struct("text_words", "text", "section_id")).alias("r"))
        .select("chunk_id", "r.*")
        .join(crumbs, "section_id", "left")
        .filter(F.col("text_words") + F.coalesce("crumb_words", F.lit(0)) > limit)
        .select("chunk_id", "text", "breadcrumb")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("text", pa.string()), ("breadcrumb", pa.string()), *((f, pa.int32()) for f in ("words", "first_word", "last_word", "repeated")), ("boundary", pa.string())]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            pieces = [split_text(t, b, limit, overlap) for t, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(pieces, pa.list_(pa.struct(fields)))], names=["chunk_id", "pieces"])

    cut_up = rows.mapInArrow(run, f"chunk_id string, pieces array<struct<{_PIECE}>>")
    return cut_up.select("chunk_id", F.size("pieces").alias("n_pieces"), F.posexplode("pieces").alias("piece", "p")).select("chunk_id", "piece", "n_pieces", "p.*")
