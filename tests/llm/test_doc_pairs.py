from datetime import datetime

from loomspan.llm import doc_pairs as P

NOTHING = [
    "", " ", "/** */", "----", "TODO", "FIXME FIXME", "TODO: write the documentation of this method before the next release.", "todo add description", "...", "N/A", "Description to follow.", "Please document me!!!",
    "Load rows.", "loadRows(key)", "loadRows - load rows", "This is the load rows method.", "The load rows function.", "@param key the key\n@return the result", "Args:\n    key: the key\n\nReturns:", ":param key:", "@return", "<p>", "{@inheritDoc}",
    "noqa: D103", "eslint-disable-next-line no-unused-vars", "type: ignore", "sqlfluff:off", "Copyright 2020 X. All rights reserved.", "(c) 2024 X\nLicensed under the X terms, see LICENSE.\nNo warranty of any kind.", "Generated code. Do not edit.",
    "@see #other", "(non-Javadoc)", "See other docs.", "return cache.get(key);", "rows = load(key)\nreturn [r for r in rows if r]", "for (let i = 0; i < n; i++) {\n  put(i);\n}", "SELECT * FROM old;\nDELETE FROM old;",
]
SOMETHING = [
    "Idempotent.", "May block.", "/** Never returns null. */", "XXX nicht threadsicher", "FIXME Constant time.", "TODO: revisit. Empty means everything.", "Auto-generated stub, edited by hand. Expects UTC.", "@return rows in arrival order, never null",
    "@param key upper bound, inclusive", "\u8aad\u307f\u8fbc\u307f\u304c\u6b62\u307e\u308b\u3002", "-- Cents, not euros.", "Load rows.\nOldest first.", "Deprecated since 4.2, call the batch variant.",
]


def test_what_says_something():
    own = P.own_words("loadRows", "method", "int key")
    assert [d for d in NOTHING if P.meaning(d, own)] == [] and [d for d in SOMETHING if not P.meaning(d, own)] == []


def names(text, language):
    return [(i.owner, i.name, (i.doc or "").strip("/* \n-"), i.line) for i in P.islands(text, language)]


def test_islands():
    java = 'package a;\n/** Class. */\npublic class A {\n  String s = "{(";\n  /** Makes. */\n  @B(x = "}")\n  public A(int n) { char c = \'{\'; }\n  /* plain */ int f() { return g(1); }\n  /** Inner. */ static class C { /** Deep. */ void h(); }\n  int x = f(2);\n}\n'
    assert names(java, "java") == [("A", "A", "Makes.", 7), ("A", "f", "", 8), ("A.C", "h", "Deep.", 9)]
    script = "/** One. */\nexport async function one(a) { const r = /[}]/; return `}${a}`; }\n// no\nclass K { /** Two. */ two() {} constructor(x) { if (x) { y(); } } }\n/** Three. */\nconst three = (a) => a;\nfunction broken( {\n"
    assert names(script, "javascript")[:4] == [("", "one", "One.", 2), ("K", "two", "Two.", 4), ("K", "constructor", "", 4), ("", "three", "Three.", 6)]
    py = 'class A:\n    def f(self,\n          x):\n        """Doc."""\n        def g(): return 1\n    y = """\ndef no(): pass\n"""\nasync def h(): pass\n# def c(): pass\n'
    assert names(py, "python") == [("A", "f", "Doc.", 2), ("A.f", "g", "", 5), ("", "h", "", 9)]
    sql = "-- Adds\n-- rows.\nCREATE OR REPLACE FUNCTION s.f(a int) RETURNS void AS $$ BEGIN NULL; END; $$ LANGUAGE plpgsql;\n-- apart\n\ncreate procedure g() as $$ x; $$ language sql;"
    assert [(o, n, (d or "").replace("\n", " ")) for n, o, _, _, d, _ in P.islands(sql, "sql")] == [("s", "f", "-- Adds -- rows."), ("", "g", "")]
    assert P.islands("", "java") == [] and P.islands("x: 1", "yaml") == []


def test_operator(spark):
    t = datetime(2025, 1, 1)
    entities = spark.createDataFrame(
        [("m.f", "f", " Function ", "python", "m.py", 99, None, None, t, None), ("m.f", "f", "function", "python", "m.py", 1, None, "Older words.", datetime(2024, 1, 1), None), ("m.g", "g", "FUNCTION", "python", "m.py", 5, "def g()", "Facts of life.", t, t),
         ("m.h", "h", "function", None, "gone.py", None, None, "Free of files.", t, None), ("m.A", "A", "class", "python", "m.py", 1, None, "Class words.", t, None), ("m.k", None, "method", None, None, None, None, None, t, None), (None, "z", "method", None, None, None, None, "Words here.", t, None),
         ("m.e", "e", "function", "python", "m.py", 1, None, "", t, None)],
        "qualified_name string, name string, kind string, language string, file_path string, start_line int, signature string, docstring string, ingested_at timestamp, deleted_at timestamp",
    )
    files = spark.createDataFrame([("m.py", 'def f(a):\n    """Found in the file."""\ndef g(): pass\ndef e():\n    """Not asked."""\n'), ("n.py", None), (None, "x")], "path string, content string")
    sources = spark.createDataFrame([("m.py", None, t)], "path string, source_type string, ingested_at timestamp")
    got = {r.qualified_name: (r.description, r.origin) for r in P.documented_pairs(entities, files, sources).collect()}
    assert got == {"m.f": ("Found in the file.", "file"), "m.g": ("Facts of life.", "docstring"), "m.h": ("Free of files.", "docstring")}
    assert P.documented_pairs(entities.limit(0), files, sources).count() == 0 and P.documented_pairs(entities, files.limit(0), sources).count() == 2


def test_facts_that_look_like_notes_or_code_count():
    facts = ["Licensed users only; others get 403.", "Generated ids are monotonic.", "Requires licence check for tenants.", "Caller must hold lock;"]
    assert [P.meaning(x, set()) for x in facts] == facts
    nothing = ["Licensed under the Apache License, Version 2.0", "Generated by protoc. Do not edit.", "See the LICENSE file.", "Generated.", "return total;", "count++;", "int count;"]
    assert not any(P.meaning(x, set()) for x in nothing)
