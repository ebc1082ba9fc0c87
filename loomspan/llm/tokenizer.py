"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 7).

The merges are compiled into a deterministic automaton over tokens that accepts just the sequences
BPE itself gives. It starts with one state and an arc from it to itself for each byte. Each merge of u
and v into w, in order, is a gadget: the state that arcs u lead to is replaced by a copy without the arc
v, and beside every arc u an arc w is put in, which leads where arc v led. All arcs of a token lead to
one state, so a gadget makes one state, and a state is written down as what it was copied from, when,
and the arc taken out. The cells of the transition table (state, token) are worked out of that when they
are first read: all of them would be 2.5 billion, nearly all of which no word ever reads.

A word has exactly one path through the automaton. It is found from left to right by reading the table,
each prefix of the word having one last token. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDER = os.environ.get("LOOMSPAN_TOKENIZERS", "/opt/tokenizers")
# The white space of Unicode, which differs from that of Python's regular expressions.
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The public pre-split pattern of byte-level BPE.
_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
_KEPT_WORDS = 400_000  # words whose ids a worker keeps; beyond that it starts anew
_ROOT, _NO_ARC = 0, -1


def printable_bytes() -> dict[str, int]:
    """The characters that stand for bytes in vocabulary files: printable ones for themselves, the
    others for the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Automaton:
    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        byte_of = printable_bytes()
        self.label = {i: bytes(byte_of[c] for c in t) for t, i in vocabulary.items() if all(c in byte_of for c in t)}
        self.size = 1 + max(vocabulary.values(), default=0)
        # of each state: the state it was copied from, the number of that gadget, the token whose arc was taken out
        self.copied, self.born, self.without = [_ROOT], [-1], [-1]
        # of each token: the gadget that put its arcs in (bytes: -1), the token beside whose arcs, and where they lead
        self.made, self.beside, self.behind = [-1] * self.size, [-1] * self.size, [_ROOT] * self.size
        self.table: dict[int, int] = {}
        for number, (left, right) in enumerate(merges):
            self._gadget(number, vocabulary[left], vocabulary[right], vocabulary[left + right])
        self.table.clear()  # arcs led elsewhere while gadgets were still to come
        # trie of the labels: (node, byte) to node, and each node's token
        self.child: dict[int, int] = {}
        self.token_at = [-1]
        for token, text in self.label.items():
            node = 0
            for byte in text:
                after = self.child.get(node << 8 | byte)
                if after is None:
                    after = self.child[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(-1)
                node = after
            self.token_at[node] = token
        self.split = regex.compile(_SPLIT)

    def _gadget(self, number: int, u: int, v: int, w: int) -> None:
        if not self._has(self.behind[u], v):
            return
        led = self.behind[v]
        self.copied.append(self.behind[u])
        self.born.append(number)
        self.without.append(v)
        self.behind[u] = len(self.born) - 1
        if self.made[w] < 0:  # should several merges give one token, its arcs stand beside those of the first
            self.made[w], self.beside[w], self.behind[w] = number, u, led

    def _has(self, state: int, token: int) -> bool:
        """Whether an arc leaves a state: a token made before the state was copied must have an arc in what it was
        copied from; one made since has an arc if the token has that it was put in beside."""
        made, born = self.made, self.born
        while made[token] >= 0 or state != _ROOT:
            if made[token] < born[state]:
                if token == self.without[state]:
                    return False
                state = self.copied[state]
            else:
                token = self.beside[token]
        return True

    def arc(self, state: int, token: int) -> int:
        """The state that token leads to, or _NO_ARC: a cell of the table."""
        cell = state * self.size + token
        to = self.table.get(cell)
        if to is None:
            to = self.table[cell] = self.behind[token] if self._has(state, token) else _NO_ARC
        return to

    @classmethod
    def load(cls, path: str) -> Automaton:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        return cls(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        n, size, table, child, token_at = len(word), self.size, self.table, self.child, self.token_at
        state, last, back = [_ROOT] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            row, node = state[i], 0
            for j in range(i, n):
                node = child.get(node << 8 | word[j])
                if node is None:
                    break
                token = token_at[node]
                if token >= 0:
                    to = table.get(row * size + token)
                    if to is None:
                        to = self.arc(row, token)
                    if to >= 0:
                        state[j + 1], last[j + 1], back[j + 1] = to, token, i
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return tuple(reversed(out))

    def encode(self, text: str | None) -> list[int]:
        return [i for w in self.split.findall(text or "") for i in self.encode_word(w.encode())]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.label[i] for i in ids).decode("utf-8", "replace")


class _Words(dict):
    """Ids by word, each word encoded when it first comes."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[int, ...]:
        self[word] = ids = self.automaton.encode_word(word.encode())
        return ids


_loaded: dict[str, _Words] = {}  # by path, for all tasks of a Python worker


def _words(path: str) -> _Words:
    if path not in _loaded or len(_loaded[path]) > _KEPT_WORDS:
        automaton = _loaded[path].automaton if path in _loaded else Automaton.load(path)
        if len(automaton.table) > 4 * _KEPT_WORDS:
            automaton.table.clear()
        _loaded[path] = _Words(automaton)
    return _loaded[path]


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, name: str = "byte_bpe_50k") -> DataFrame:
    """key and ids (array<int>), one row per row of docs, without special tokens.

    A null or empty text gives an empty list; strings that look like special tokens are plain text.
    Texts are encoded whole, whatever their length. Rows stay in their partitions: no shuffle. The
    vocabulary is read from folder, which every executor must have. Other columns don't travel.
    """
    path = f"{folder}/{name}.json"
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                known = _words(path)
                split = known.automaton.split.findall
                each = [list(chain.from_iterable(map(known.__getitem__, split(t)))) if t else [] for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, each)], dtype=np.int64)
                flat = np.fromiter(chain.from_iterable(each), dtype=np.int32, count=int(ends[-1]))
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(encode, f"`{key}` {kind}, ids array<int>")
