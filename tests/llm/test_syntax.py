import ast
import warnings
from datetime import datetime

import pytest

from loomspan.llm import syntax as S

GOOD = {
    "python": ["", "x = 1\n", "match x:\n    case [a, *_] if a: pass\n    case {'k': v, **r}: pass\n", "async def f(a, /, b=1, *, c, **k) -> int:\n    async with a as b, c: await d\n    return (yield)\n", "f'{x!r:>{w}} {y=} {\"a\"}'\n", "try:\n    pass\nexcept* E as e:\n    pass\n", "type A[T: int] = list[T]\n", "x = {**a, 'b': [i for i in j if i]}\n\nclass A(B, m=C): x: int = 1\n", "with (open(a) as f, b): pass\n", "print(*a, **b)\nx, *y = z\n(a) = b\ndel a, b[0]\n", "if x:\n\ty\nelif z: pass\nelse:\n  w\n", "def f():\n    '''note <<<<<<< HEAD'''\n"],
    "java": ["", "package a.b;\nimport static c.D.*;\n@A(x = {1, 2}) public final class E<T extends F & G> extends H<T[]> implements I {\n int[] a = {1, 2,}, b[]; { } static { }\n <X> E(X... x) throws Y { this(); }\n}\n",
             "class A { void f() { for (int i = 0, j = 1; i < j; i++, j--) ; for (var x : y) { } List<List<String>> l = new ArrayList<>(); int z = (int) 1.5 >> 2; A.<B>c(); Runnable r = () -> { }; F f = A::new; x = y instanceof B b && b.c() ? 1 : 2; s = switch (x) { case 1, 2 -> 3; default -> { yield 4; } }; label: while (true) break label; if (a < b && c > d) { } else ; try (var q = w) { } catch (E | F e) { } finally { } } }",
             "record P(int x, int y) implements Q { P { if (x < 0) throw new E(); } }\nsealed interface S permits T { default void f() { } }\nenum C { A(1) { }, B; C() { } }\n@interface N { int v() default 1; }\n", 'class T { String s = """\n  a "{" b\n  """; char c = \'\\u0041\'; }'],
    "javascript": ["", "import a, { b as c } from 'd';\nexport default class extends E { #x = 1; static { } get y() { return this.#x } async *z() { yield* w } }\nexport { a as default };\n", "const { a, b: [c = 1, ...d], ...e } = f;\nlet g = async (x, { y } = {}) => await x?.[y] ?? `t${`n${1}`}`;\n", "for (const x of y) { }\nfor (let i = 0; i < n; i++) ;\nfor (k in o) { }\nlabel: do { continue label } while (x)\n", "x = /[/}]/g.test(y) ? a / b : ({ c, d() { }, [e]: 1, ...f })\n[a, b] = [b, a]\n", "if (a) b\nelse c\nreturn_ = 1\nnew A\nnew (B.c())(1)\n", "var f = function* () { yield\n}\nthrow_(1)\nconst z = a\n++b\n"],
    "sql": ["", "SELECT a, count(*) FILTER (WHERE b) OVER (PARTITION BY c ORDER BY d ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM t LEFT JOIN LATERAL (SELECT 1) x ON true WHERE a IN (1, 2) AND b NOT LIKE 'x''y' GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 DESC NULLS LAST LIMIT 5;", "WITH RECURSIVE r(n) AS (VALUES (1) UNION ALL SELECT n + 1 FROM r) INSERT INTO t (a) SELECT n FROM r ON CONFLICT (a) DO UPDATE SET b = excluded.b RETURNING *;",
            "CREATE TABLE s.t (id bigint GENERATED ALWAYS AS IDENTITY, a numeric(10, 2) DEFAULT 0 NOT NULL CHECK (a > 0), b timestamp with time zone, c text[], PRIMARY KEY (id), FOREIGN KEY (a) REFERENCES u (x) ON DELETE SET NULL);", "CREATE OR REPLACE FUNCTION f(a int DEFAULT 1, OUT b text) RETURNS trigger AS $x$ DECLARE r record; n int := 0; BEGIN <<l>> FOR r IN SELECT * FROM t LOOP n := n + 1; EXIT l WHEN n > 3; END LOOP; IF n = 1 THEN RAISE NOTICE 'a %', n; ELSIF n = 2 THEN NULL; ELSE RETURN NEW; END IF; EXECUTE format('x') INTO n USING r; RETURN QUERY SELECT 1; EXCEPTION WHEN others THEN PERFORM g(); END; $x$ LANGUAGE plpgsql;",
            "/* a /* b */ */ COMMENT ON TABLE t IS 'x'; DO $$ BEGIN NULL; END $$; GRANT SELECT ON t TO u; ALTER TABLE t ADD COLUMN x int, DROP y; SELECT a::int, b[1], ARRAY[1, 2], CASE WHEN a THEN 1 ELSE 2 END, extract(year FROM d), interval '1 day', x AT TIME ZONE 'UTC';"],
    "yaml": ["", "a: 1\nb:\n- x\n- y: z\n  w: {c: [1, 2], d: \"e\"}\n# note\nf: |\n  text: here\n   more\ng: >-\n  x\n---\n- &a x\n- *a\n...\n", "'q': \"a\\n\"\n? k\n: v\nplain: it's {fine}\nmulti: one\n  two\nempty:\n", "- - a\n  - b\n- c: d\n  e:\n  - f\n"],
    "xml": ["<a/>", "<?xml version=\"1.0\" encoding='UTF-8'?>\n<!DOCTYPE a [<!ENTITY e 'x'>]>\n<a b='1' c:d=\"2\"><!-- - --><![CDATA[<&]]>&amp;&#65;&e;<b></b></a>\n<!-- end -->"],
}
BAD = {
    "python": ["def f(:\n    pass\n", "x = (1\n", "if x:\npass\n", "print 'a'\n", "<<<<<<< HEAD\n", "'abc\n", "'''abc", "f(1)=2\n", "a b\n", "try:\n    pass\n", "x = [1, 2\ny = 3\n", "def f(a=1, b): pass\n", "f(a=1, b)\n", "  x\n", "if a:\n    b\n   c\n", "except E, e: pass\n", "f'{a'\n", "x = 0777\n", "class\n", "a\0b\n", "return] = (\n"],
    "java": ["class A {", "class A { int x = ; }", "class A { void f() { if (x { } } }", "class A { void f() { x } }", "class A { f() { } }", "x = 1;", "class A { String s = \"a; }", "class A { } }", "class A { int x = 3\n int y; }", "class A { void f() { else { } } }", "/* open class A { }", "class A { void f() { <<<<<<< HEAD\n } }", "class A { void f(int a,) { } }", "class A { void f() { 1 + 2; } }"],
    "javascript": ["function (", "const x;", "let 2nd = 1;", "x = {a: }", "if (a { }", "const class = 1;", "return 1;", "`a", "a b", "}", "import { a } from b;", "1 = 2;", "for (;;", "class A { f( { } }", "<<<<<<< HEAD\n", "x = 'a\n'", "try { }", "async => { await"],
    "sql": ["SELECT FROM WHERE;", "CREATE TABLE t (a int,);", "INSERT INTO t VALUES (1;", "SELECT 'a;", "CREATE TABLE t (a int", "SELEC 1;", "CREATE FUNCTION f() RETURNS void AS $$ BEGIN x := ; END; $$ LANGUAGE plpgsql;", "CREATE FUNCTION f() RETURNS void AS $$ BEGIN IF a THEN NULL; END; $$ LANGUAGE plpgsql;", "/* open", "UPDATE t SET a = 1 WHERE;", "SELECT 1 SELECT 2;", "CREATE FUNCTION f() AS $$ BEGIN END;"],
    "yaml": ["a: b: c\n", "a: [1, 2\n", "a: \"x\n", "a: 1\n b: 2\n", "- a\nb: 1\n", "\ta: 1\n", "a: *none\n", "{a: 1", "a: 'x' y\n", "<<<<<<< HEAD\na: 1\n=======\n"],
    "xml": ["", "<a>", "<a></b>", "<a b=1/>", "<a>&x;</a>", "<a/><b/>", "text", "<a><!-- -- --></a>", "<a b='1' b='2'/>", "<a>&</a>", "<a", "<a><b></a></b>", "<<<<<<< HEAD\n<a/>"],
}


@pytest.mark.parametrize("language", list(GOOD))
def test_accepts_and_rejects(language):
    assert {t: S.faults(t, language)[:1] for t in GOOD[language] if S.faults(t, language)} == {}
    assert [t for t in BAD[language] if not S.faults(t, language)] == []
    if language == "python":
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            for t in GOOD[language]:
                ast.parse(t)


def test_all_errors_and_first_cause():
    found = S.faults("def f(x) y:\n    a b\n\ny = 1\nz = = 2\n", "python")
    assert [f.line for f in found] == [1, 2, 5]
    assert S.faults("(" * 100_000, "python") and S.faults("[" * 50_000, "yaml") and S.faults("<a>" * 20_000, "xml") and S.faults("{" * 30_000, "java")


def test_deep_nesting_is_no_error():
    n = 1300
    deep = {"javascript": "x = " + "(" * n + "1" + ")" * n + "; y = " + "[" * n + "]" * n + ";", "java": "class A { int x = " + "(" * n + "1" + ")" * n + "; }", "sql": "SELECT " + "(" * n + "1" + ")" * n + ";", "yaml": "[" * n + "]" * n, "xml": "<a>" * n + "</a>" * n}
    assert {x: S.faults(t, x) for x, t in deep.items()} == {x: [] for x in deep}
    assert S.faults("".join(" " * k + "a:\n" for k in range(400)), "yaml") == []


def test_literals_and_numbers():
    bad = ["x = b'\u00e9'", "x = '\\x1'", "x = '\\N{foo}'", "x = '\\u12'", "x = \uff11", "class A(x for x in y): pass", "x = " + "(" * 201 + "1" + ")" * 201, "x = '\\U00110000'"]
    good = ["x = b'\\u12'", "x = r'\\x'", "x = '\\N{DIGIT ONE}'", "f(x for x in y)", "x = " + "(" * 200 + "1" + ")" * 200, "class A(B, metaclass=C): pass"]
    assert all(S.faults(t, "python") for t in bad) and not any(S.faults(t, "python") for t in good)
    assert S.faults("x = 08;", "javascript") and S.faults("x = 010;", "javascript") and not S.faults("x = 0; y = 0.5; z = 0x08; w = 10;", "javascript")
    assert S.faults("class A { int x = 09; }", "java") and not S.faults("class A { int x = 07; double y = 09.5; float z = 09f; long w = 0L; }", "java")


def test_python_like_the_real_parser():
    import json
    import tokenize

    for module in (ast, json.decoder, tokenize):
        text = open(module.__file__, encoding="utf-8").read()
        assert S.faults(text, "python") == []
        for cut in range(0, len(text), 997):
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                try:
                    ast.parse(text[:cut])
                    fine = True
                except SyntaxError:
                    fine = False
            assert (not S.faults(text[:cut], "python")) == fine


def test_report(spark):
    t = datetime(2025, 1, 1)
    files = spark.createDataFrame([("a.py", "r", "x = ("), ("b.py", "r", ""), ("c.txt", "r", "?"), ("d.py", "q", "{}"), ("e.js", "q", None), (None, None, "x")], "path string, repository string, content string")
    sources = spark.createDataFrame([("a.py", " Python ", t), ("d.py", None, t), ("d.py", "spring-xml", datetime(2024, 1, 1)), ("d.py", "spring-xml", datetime(2024, 1, 1)), (None, "x", t)], "path string, source_type string, ingested_at timestamp")
    rows = {r.path: (r.language, r.n_errors) for r in S.syntax_report(files, sources).collect()}
    assert rows == {"a.py": ("python", 2), "b.py": ("python", 0), "c.txt": (None, None), "d.py": ("xml", 2), "e.js": ("javascript", 0), None: (None, None)}
    rates = {(r.repository, r.language): r.broken_share for r in S.syntax_rates(S.syntax_report(files, sources)).collect()}
    assert rates[("r", "python")] == 0.5 and rates[("q", "javascript")] == 0.0
    assert S.syntax_report(files.limit(0), sources).count() == 0
