import os
import random

import pytest

from loomspan.llm import tokenizer as T

pytestmark = pytest.mark.skipif(not os.path.exists(f"{T.FOLDER}/byte_bpe_50k.json"), reason="no vocabulary files")


@pytest.fixture(scope="module")
def automaton():
    return T.Automaton.load(f"{T.FOLDER}/byte_bpe_50k.json")


def test_like_the_library(automaton):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(f"{T.FOLDER}/byte_bpe_50k.json")
    library.encode_special_tokens = True
    rng = random.Random(1)
    kinds = ["aaaaab", "the an in ing er", "0123456789 ", "\n\t  \r\n'sdon't", "éüß漢字日本​́", "\x00\x1b\x1c\x85\xa0  　", "😀👩‍💻", "=-_*#/<>|endoftext"]
    for _ in range(1500):
        text = "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(1, 60)))
        assert automaton.encode(text) == library.encode(text, add_special_tokens=False).ids
        assert automaton.decode(automaton.encode(text)) == text
    long = "word " * 5000 + "x" * 3000
    assert automaton.encode(long) == library.encode(long, add_special_tokens=False).ids


def test_gadgets_by_hand():
    tokens = {t: n for n, t in enumerate(("a", "b", "aa", "ab", "aab"))}
    a = T.Automaton(tokens, [("a", "a"), ("a", "b"), ("aa", "b")])
    names = {n: t for t, n in tokens.items()}
    assert len(a.born) == 4  # the root, a without a, that without b, and aa without b
    word = lambda w: [names[i] for i in a.encode_word(w)]
    assert word(b"aaab") == ["aa", "ab"] and word(b"aab") == ["aab"] and word(b"aaaab") == ["aa", "aab"] and word(b"ba") == ["b", "a"]
    assert a.arc(a.behind[tokens["a"]], tokens["a"]) < 0 <= a.arc(a.behind[tokens["aa"]], tokens["ab"])


def test_corpus(spark, automaton):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (1, "a b", "y")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in T.encode_corpus(docs).collect())
    assert got == [(1, automaton.encode("a b"))] * 2 + [(2, []), (3, [])]
    assert T.encode_corpus(docs.limit(0)).count() == 0
