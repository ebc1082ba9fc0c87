"""Evaluation texts leaking into training text (problem 8).

The corpus is cut into shards, each of whole documents. Of a shard's words only those that occur in
any test item keep a symbol; a run of others becomes one symbol, as no phrase crosses it. The shard's
suffixes are sorted, its last column is kept as a wavelet matrix, and every phrase of every item is
searched backward in all at once. Occurrences are located by walking to sampled suffix positions.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PHRASE = 12  # words that make a leak
SHARD_WORDS = 1_000_000  # words read into one index, at least one document
BLOCK_WORDS = 500_000  # words of test items searched in one pass over the corpus
_SAMPLE = 16  # of the suffix positions one in so many is kept
_GAP, _FIRST = 1, 2  # symbols: 0 ends the shard, 1 is any run of words of no item or an end of document

_WORD = re.compile(r"[^\W_]+")
_TAG = r"</?[A-Za-z][^<>]*>"  # of any length: it ends before the next bracket, so reading stays linear
# Tags that stand within a line; others part words.
_INLINE = re.compile(r"</?(?:a|abbr|b|big|code|del|em|font|i|ins|kbd|mark|s|small|span|strong|sub|sup|tt|u)(?:\s[^<>]*)?/?>", re.I)
_OTHER = re.compile(_TAG)
_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]*|#0*\d{1,7}|#[xX]0*[0-9a-fA-F]{1,6});")  # larger numbers name no character
_ZEROS = re.compile(r"(?<=[#xX])0+(?=[0-9a-fA-F])")
# Characters that show nothing.
_UNSEEN = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e0fff]")
_PIECE = re.compile(rf"(?:{_TAG}|\S)+")


def _without_comments(text: str) -> str:
    """Markup comments overwritten by as many characters that are neither words nor white space."""
    at = text.find("<!--")
    if at < 0:
        return text
    out, done = [], 0
    while at >= 0 and (end := text.find("-->", at + 4)) >= 0:
        out += [text[done:at], "\0" * (end + 3 - at)]
        done = end + 3
        at = text.find("<!--", done)
    return "".join([*out, text[done:]])


def normal_words(text: str) -> list[str]:
    """Runs of letters and digits, without regard to case, markup, normal form and invisible characters."""
    if "<" in text:
        text = _without_comments(text)
        text = _OTHER.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(_ZEROS.sub("", m.group())), text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _UNSEEN.sub("", text))
        text = unicodedata.normalize("NFKC", text.casefold())
    else:
        text = text.lower()
    return _WORD.findall(text)


def word_places(text: str) -> list[tuple[int, int]]:
    """Of each of normal_words(text), the start and end of the piece between white space it stands in."""
    return [m.span() for m in _PIECE.finditer(_without_comments(text)) for _ in normal_words(m.group())]


class ShardIndex:
    """FM-index of a sequence of symbols, which must end in its only 0."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        order = self._suffixes(symbols)
        column = symbols[order - 1]
        self.levels = max(1, int(symbols.max()).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=2**self.levels))])
        # wavelet matrix: of each bit, the zeros before every place
        self.zeros, rest = [], column
        for bit in range(self.levels - 1, -1, -1):
            ones = (rest >> bit) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - ones)]).astype(np.int32))
            rest = np.concatenate([rest[ones == 0], rest[ones == 1]])
        self.column = column
        kept = order % _SAMPLE == 0
        self.kept, self.kept_before, self.places = kept, np.concatenate([[0], np.cumsum(kept)]), order[kept]
        self.n = n

    @staticmethod
    def _suffixes(symbols: np.ndarray) -> np.ndarray:
        """Start of each suffix in sorted order, by doubling the length compared."""
        n, rank, step = len(symbols), symbols.astype(np.int64), 1
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - step)] = rank[step:] + 1
            pair = rank * (int(ahead.max()) + 1) + ahead
            order = np.argsort(pair, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(np.diff(pair[order]) != 0)])
            if new[order[-1]] == n - 1:
                return order
            rank, step = new, step * 2

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often symbol stands before place in the last column; of whole arrays."""
        low, high = np.zeros_like(place), place
        for level, bit in enumerate(range(self.levels - 1, -1, -1)):
            zeros = self.zeros[level]
            a, b = zeros[low], zeros[high]
            one = (symbol >> bit) & 1
            total = zeros[-1]
            low, high = np.where(one, total + low - a, a), np.where(one, total + high - b, b)
        return high - low

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes that open with each phrase; phrases are rows, filled up with -1 at the front."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero((phrases[:, k] >= 0) & (low < high))
            if len(live):
                s = phrases[live, k]
                low[live] = self.before[s] + self.rank(s, low[live])
                high[live] = self.before[s] + self.rank(s, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffixes, by steps back to sampled ones."""
        rows, steps, place = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            at = rows[todo]
            ready = self.kept[at]
            place[todo[ready]] = self.places[self.kept_before[at[ready]]] + steps[todo[ready]]
            todo, at = todo[~ready], at[~ready]
            s = self.column[at]
            rows[todo] = self.before[s] + self.rank(s, at)
            steps[todo] += 1
        return place


class Items:
    """Test items as phrases over symbols."""

    def __init__(self, items: list[tuple[int, str]], size: int):
        texts = [(i, normal_words(t or "")) for i, t in items]
        self.symbol: dict[str, int] = {}
        rows, lengths, owners = [], [], []
        for i, words in texts:
            ids = [self.symbol.setdefault(w, len(self.symbol) + _FIRST) for w in words]
            n = min(size, len(ids))
            for k in range(len(ids) - n + 1) if n else ():
                rows.append([-1] * (size - n) + ids[k : k + n])
                lengths.append(n)
                owners.append(i)
        self.phrases = np.array(rows, np.int64).reshape(-1, size)
        self.lengths, self.owners = np.array(lengths, np.int64), np.array(owners, np.int64)


def _shard_hits(docs: list[tuple[int, str]], items: Items) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(doc_id, item_id, spans of characters to remove) of one shard."""
    symbols: list[int] = []
    word_of: list[int] = []  # of each symbol, its word's number in its document
    starts: list[int] = []
    get = items.symbol.get
    for _, text in docs:
        starts.append(len(symbols))
        for k, w in enumerate(normal_words(text)):
            s = get(w, _GAP)
            if s != _GAP or (symbols and symbols[-1] != _GAP):
                symbols.append(s)
                word_of.append(k)
        symbols.append(_GAP)
        word_of.append(-1)
    symbols.append(0)
    word_of.append(-1)
    index = ShardIndex(np.array(symbols, np.int64))
    low, high = index.search(items.phrases, items.lengths)
    found = np.flatnonzero(high > low)
    if not len(found):
        return
    n = high[found] - low[found]
    rows = np.repeat(low[found] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    place, phrase = index.locate(rows), np.repeat(found, n)
    doc = np.searchsorted(np.array(starts), place, side="right") - 1
    spans: dict[int, dict[int, list[tuple[int, int]]]] = {}
    for d, p, ph in zip(doc.tolist(), place.tolist(), phrase.tolist(), strict=True):
        first = word_of[p]
        spans.setdefault(d, {}).setdefault(int(items.owners[ph]), []).append((first, first + int(items.lengths[ph])))
    for d, by_item in spans.items():
        at = word_places(docs[d][1])
        for item, pieces in by_item.items():
            merged: list[list[int]] = []
            for a, b in sorted(pieces):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            yield docs[d][0], item, [(at[min(a, len(at) - 1)][0], at[min(b, len(at)) - 1][1]) for a, b in merged]


def leaks(docs: DataFrame, items: DataFrame, size: int = PHRASE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, item_id and spans (array of start and end in characters of the text, merged): a row for
    each document that holds at least `size` consecutive words of an item, or all of a shorter item.

    Null or empty texts and items without words give no rows; a row of docs that repeats an id gives
    rows of its own. Items are read in blocks of BLOCK_WORDS words, each searched in one pass over the
    corpus, so what is sent to the tasks is bounded. The corpus isn't shuffled. Long texts are
    searched whole: a shard has at least one document.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.length("text") > 0)
    ordered = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL").distinct()

    def one_pass(block: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = Items(block, size)

            def out(shard: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
                rows = list(_shard_hits(shard, phrases))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([[{"start": a, "end": b} for a, b in r[2]] for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    ],
                    names=["doc_id", "item_id", "spans"],
                )

            shard: list[tuple[int, str]] = []
            held = 0
            for batch in batches:
                for k in range(batch.num_rows):
                    text = batch.column(1)[k].as_py()
                    shard.append((batch.column(0)[k].as_py(), text))
                    held += len(text) // 6
                    if held >= shard_words:
                        yield from out(shard)
                        shard, held = [], 0
            if shard:
                yield from out(shard)

        return texts.mapInArrow(run, "doc_id long, item_id long, spans array<struct<start:int,end:int>>")

    passes, block, held = [], [], 0
    for row in ordered.toLocalIterator():
        block.append((row.item_id, row.text))
        held += len(row.text or "") // 4
        if held >= BLOCK_WORDS:
            passes.append(one_pass(block))
            block, held = [], 0
    if block or not passes:
        passes.append(one_pass(block))
    found = passes[0]
    for more in passes[1:]:
        found = found.unionByName(more)
    return found


def leaked_items(found: DataFrame) -> DataFrame:
    """Documents per leaked item."""
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.sum(F.size("spans").cast("long")).alias("n_spans"))
