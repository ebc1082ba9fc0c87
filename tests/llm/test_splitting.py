import random

from loomspan.llm import splitting as P


def rebuilt(pieces):
    out = []
    for p in pieces:
        words = p["text"].split()
        if out:
            assert words[: p["repeated"]] == out[-p["repeated"] :] and p["repeated"] == P.OVERLAP
        out += words[p["repeated"] :]
    return out


def test_pieces_keep_everything():
    rng = random.Random(6)
    for _ in range(300):
        text = " ".join(rng.choice(["a", "b.", "c,", "\n\nd", "\n- e", "\n# f", "\n```\n", "\u3000g", "\x1ch"]) for _ in range(rng.randrange(0, 2500)))
        crumb = rng.choice([None, "", "A > B", "x " * rng.randrange(0, 500)])
        pieces = P.split_text(text, crumb)
        assert rebuilt(pieces) == text.split() and all(p["words"] <= P.LIMIT for p in pieces)
        assert all(p["text"] in text for p in pieces)


def test_cuts_at_boundaries():
    text = "w " * 250 + "\n\n" + "v " * 249
    assert [p["boundary"] for p in P.split_text(text, None)] == ["section", "paragraph"]
    assert [(p["first_word"], p["repeated"], p["words"]) for p in P.split_text("w " * 800, None)] == [(0, 0, 307), (247, 60, 306), (493, 60, 307)]
    assert len(P.split_text("w " * 400, None)) == 1 and len(P.split_text("w " * 401, None)) == 2 and len(P.split_text("w " * 400, ">")) == 2


def test_operator(spark):
    rows = [("a", "s", "w " * 399), ("b", "t", "w " * 399), ("c", "none", "w " * 900), ("c", "none", "w " * 900), ("d", "s", None), ("e", None, "w " * 401), (None, "s", "w " * 900), ("f", "s", ""), ("g", "t", "\u2003w" * 30000)]
    chunks = spark.createDataFrame([(*r, 5, "clash") for r in rows], "id string, section_id string, text string, token_count int, breadcrumb string")
    sections = spark.createDataFrame([("s", "A > B"), ("t", None), ("s", "A > B"), (None, "x")], "id string, breadcrumb string")
    got = P.oversized_pieces(chunks, sections)
    assert {r.chunk_id for r in got.collect()} == {"a", "c", "e", "g"}
    assert [r.piece for r in got.filter("chunk_id = 'c'").orderBy("piece").collect()] == [0, 1, 2]
    assert P.oversized_pieces(chunks.limit(0), sections).count() == 0 and P.oversized_pieces(chunks, sections.limit(0)).select("chunk_id").distinct().count() == 3


def test_breadcrumbs_stay_whole_while_a_new_word_fits():
    text = " ".join(f"w{n}" for n in range(500))
    for size, kept in ((301, 301), (339, 339), (340, 339)):
        pieces = P.split_text(text, " ".join(f"c{n}" for n in range(size)))
        assert rebuilt(pieces) == text.split() and all(p["words"] <= P.LIMIT and len(p["breadcrumb"].split()) == kept for p in pieces)
