import random

import numpy as np

from loomspan.llm import leaks as L


def test_words_ignore_looks():
    assert L.normal_words("**The** C\u200bat&amp;<b>dog</b>s<br/>\uff21\uff22 e\u0301_x") == ["the", "cat", "dogs", "ab", "\u00e9", "x"]
    text = "One <i>two</i>three\u00ad \n four"
    assert len(L.word_places(text)) == len(L.normal_words(text)) == 3


def test_marks_of_any_length(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    long = '<span title="' + "x " * 900 + '">'
    text = " ".join([*words[:4], f"{long}{words[4]}</span>", "<!--" + " note" * 500 + "-->", *words[5:]])
    assert L.normal_words(text) == words and len(L.word_places(text)) == len(L.normal_words(text))
    assert L.normal_words("a&CounterClockwiseContourIntegral;b&#" + "0" * 5000 + "99;d &#99999999999;") == ["a", "bcd", "99999999999"]
    assert L.normal_words("<!-- " * 50_000)[:1] == [] and L.normal_words("<a " * 100_000)[:1] == ["a"]  # in time
    docs = spark.createDataFrame([(1, "so " + text + " it is")], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(words))], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in L.leaks(docs, items).collect()] == [(1, 5)]


def test_index_counts_and_locates():
    rng = np.random.default_rng(2)
    for size, letters in ((1, 2), (50, 3), (400, 2), (300, 9)):
        s = np.append(rng.integers(1, letters + 1, size), 0)
        index = L.ShardIndex(s)
        for n in (1, 2, 5):
            phrase = rng.integers(1, letters + 1, (20, n))
            low, high = index.search(phrase, np.full(20, n))
            for p, a, b in zip(phrase, low, high, strict=True):
                want = [i for i in range(len(s) - n) if (s[i : i + n] == p).all()]
                assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_leaks_like_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{n}" for n in range(40)]
    items = [(n, " ".join(rng.choice(words) for _ in range(rng.choice([5, 12, 30])))) for n in range(12)] + [(90, None), (91, "?!"), (92, items_twice := "p q r s t")] + [(93, items_twice)]
    docs = []
    for n in range(60):
        body = [rng.choice(words + ["x", "y"]) for _ in range(rng.randrange(0, 80))]
        source = items[rng.randrange(12)][1].split()
        cut = rng.randrange(0, len(source))
        body[rng.randrange(len(body) + 1) :] = source[cut : cut + rng.choice([4, 11, 12, 30])] + body[:20]
        docs.append((n, " ".join(body)))
    docs += [(100, None), (101, ""), (102, "P, q!\n\n**r** s t"), (103, "p q r s"), (104, "lead " * 4000 + items[1][1]), (0, docs[0][1])]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, item_id string").repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in docs:
        ws = L.normal_words(t or "")
        for i, x in items:
            v = L.normal_words(x or "")
            n = min(12, len(v))
            if n and any(ws[k : k + n] == v[j : j + n] for j in range(len(v) - n + 1) for k in range(len(ws) - n + 1)):
                want.add((d, i))
    found = L.leaks(df, it, shard_words=200)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want and (102, 92) in want and (103, 92) not in want
    texts = dict(docs)
    for r in found.filter("doc_id = 102 OR doc_id = 104").collect():
        for s in r.spans:
            assert L.normal_words(texts[r.doc_id][s.start : s.end])
    assert L.leaks(df.limit(0), it).count() == 0 and L.leaks(df, it.limit(0)).count() == 0
    assert {r.item_id: r.n_docs for r in L.leaked_items(found).collect()}[92] == 1
