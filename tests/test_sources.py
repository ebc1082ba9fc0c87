"""Parsers on small texts, the sample project's derived edges, and the stream of files."""

import pytest
from pyspark.sql import functions as F

from loomspan.operators import derive as D
from loomspan.operators import pointcuts as P
from loomspan.plans import ingestion as Q
from loomspan.sources import build, code, documents, scip, wiring
from loomspan.sources import files as S
from loomspan.streaming import ingest as I


def by_tag(records):
    out = {}
    for tag, r in records:
        out.setdefault(tag, []).append(r)
    return out


def test_markdown():
    text = "---\ntitle: x\n---\n# One\nlost\n## Two\nsome words\n```\n# no heading\n```\nafter\n# Three\n"
    got = by_tag(documents.markdown("a.md", text))
    assert [(s["id"], s["breadcrumb"], s["parent_id"]) for s in got["section"]] == [("a.md::s0000", "One", None), ("a.md::s0001", "One > Two", "a.md::s0000"), ("a.md::s0002", "Three", None)]
    assert [(c["id"], c["text"]) for c in got["chunk"]] == [("a.md::s0001::c0000", "some words"), ("a.md::s0001::c0001", "```\n# no heading\n```"), ("a.md::s0001::c0002", "after")]
    assert list(documents.markdown("e.md", "")) == []
    assert len(documents.windows("w " * 1000)) == 3 and documents.windows(" ") == []


def test_policies_and_config():
    text = "metadata:\n  id: P1\n  name: n\ndefinition:\n  and:\n  - resource_types: [aws_x, aws_y]\n  - or:\n    - resource_types: [aws_x]\n---\na: 1\nb: {c: 2}\n"
    got = by_tag(documents.yaml_file("p.yaml", text))
    assert got["policy"][0]["resource_types"] == ["aws_x", "aws_y"] and [c["text"] for c in got["chunk"]] == ["a: 1", "b:\n  c: 2"]
    assert list(documents.yaml_file("bad.yaml", "a: [")) == []
    props = by_tag(documents.config_file("r/application-dev.properties", "a.b = one \\\n  two\n! note\n#---\nspring.config.activate.on-profile=live\na.b:three\nc ${a.b}x\nd=${a.b:q}\nmy.secret=s\n"))["config_property"]
    assert [(p["profile"], p["key"], p["value"]) for p in props] == [("dev", "a.b", "one two"), ("live", "spring.config.activate.on-profile", "live"), ("live", "a.b", "three"), ("live", "c", "${a.b}x"), ("live", "d", "${a.b:q}"), ("live", "my.secret", "s")]
    assert props[4]["refs"] == [props[2]["id"]]


def test_python_and_javascript():
    text = '"""Mod."""\nfrom .tools import cut as c\nimport os\n\nclass A(Base):\n    """Doc."""\n    def run(self, x: int = 1) -> str:\n        self.help()\n        c()\n        os.getcwd()\n    def help(self): ...\n\nasync def go(): A()\n'
    got = {r["qualified_name"]: r for _, r in code.python("src/pkg/m.py", text)}
    assert got["pkg.m.A.run"]["calls"] == ["pkg.m.A.help", "pkg.tools.cut", "os.getcwd"] and got["pkg.m.A"]["extends"] == ["Base"]
    assert got["pkg.m.go"]["signature"] == "async def go()" and got["pkg.m.go"]["calls"] == ["pkg.m.A"]
    assert list(code.python("x.py", "def (")) == []
    js = "import { save as s } from './store/index.js';\n/** Shows. */\nexport function Card(props) { const [a] = useState(0); return <Frame>{s(a)}</Frame>; }\nexport const Frame = (p) => { return <div/>; };\nclass Q extends Card { constructor() { this.go(); } go() { helper(); } }\nfunction helper() { const r = /[{]/; }\n"
    got = {r["qualified_name"]: r for _, r in code.javascript("web/card.js", js)}
    assert got["web.card.Card"]["kind"] == "component" and got["web.card.Card"]["renders"] == ["web.card.Frame"] and got["web.card.Card"]["docstring"] == "Shows."
    assert got["web.card.Card"]["calls"] == ["web.store.save"] and "[hooks: useState]" in got["web.card.Card"]["signature"]
    assert got["web.card.Q.constructor"]["calls"] == ["web.card.Q.go"] and got["web.card.Q.go"]["calls"] == ["web.card.helper"] and got["web.card.Q"]["extends"] == ["web.card.Card"]


def test_sql():
    text = """CREATE TABLE s.a (id bigint, b_id int NOT NULL REFERENCES s.b (id), note varchar(10) DEFAULT 'x(' , PRIMARY KEY (id), CONSTRAINT fk FOREIGN KEY (id) REFERENCES s.c (k));
CREATE MATERIALIZED VIEW s.v AS WITH q AS (SELECT * FROM s.a) SELECT * FROM q JOIN s.b ON true;
CREATE UNIQUE INDEX ix ON s.a (b_id, note);
ALTER TABLE s.a ADD CONSTRAINT f2 FOREIGN KEY (note) REFERENCES s.d (n);
-- Adds.
CREATE FUNCTION s.f(x int) RETURNS void AS $$ BEGIN INSERT INTO s.a SELECT * FROM s.b; PERFORM g(1); END; $$ LANGUAGE plpgsql;
CREATE PROCEDURE s.g(x int) AS $$ BEGIN NULL; END; $$ LANGUAGE plpgsql;
CREATE TRIGGER t AFTER INSERT ON s.a FOR EACH ROW EXECUTE FUNCTION s.f();"""
    got = by_tag(code.sql("x.sql", text))
    assert got["db_table"][0]["ref_tables"] == ["s.c", "s.b"] or set(got["db_table"][0]["ref_tables"]) == {"s.b", "s.c"}
    assert [(c["name"], c["nullable"], c["primary_key"], c["default"], c["data_type"]) for c in got["db_column"]] == [("id", False, True, None, "bigint"), ("b_id", False, False, None, "int"), ("note", True, False, "'x('", "varchar(10)")]
    assert got["db_view"][0]["depends_on"] == ["s.a", "s.b"] and got["db_view"][0]["materialized"] and got["db_index"][0]["columns"] == ["b_id", "note"]
    e = {r["qualified_name"]: r for r in got["entity"]}
    assert (e["s.f"]["writes"], e["s.f"]["reads"], e["s.f"]["docstring"], e["s.f"]["calls"]) == (["s.a"], ["s.b"], "Adds.", ["s.g"]) and e["t"]["trigger_table"] == "s.a"


def test_build_and_wiring():
    got = by_tag(build.gradle("m/build.gradle", "group = 'g.h'\nversion '1'\nsubprojects { dependencies { implementation 'no:no:1' } }\ndependencies {\n  implementation 'a:b:2'\n  testImplementation project(':core:x')\n}\n"))
    assert got["module"][0]["group_id"] == "g.h" and [d["gav"] for d in got["dependency"]] == ["a:b:2", "project:core:x"]
    beans = by_tag(wiring.spring_xml("c.xml", '<beans><bean id="a" name="b,c" class="X"><property name="p" ref="d"/><property name="q"><list><ref bean="e"/></list></property></bean><bean class="Y"><constructor-arg><bean class="Z"/></constructor-arg></bean><import resource="o.xml"/></beans>'))
    assert beans["xml_bean"][0]["names"] == ["b", "c"] and [(r["ref"], r["multiplicity"]) for r in beans["xml_bean"][0]["refs"]] == [("d", "one"), ("e", "many")]
    assert len(beans["xml_bean"]) == 3 and beans["context_import"][0]["resource"] == "o.xml"
    assert list(wiring.spring_xml("bad.xml", "<beans>")) == []
    route = by_tag(wiring.camel_yaml("r.yaml", "- route:\n    id: r\n    from:\n      uri: direct:a\n      steps:\n      - choice:\n          when:\n          - simple: x\n            steps:\n            - to: b\n      - to: c\n"))["route"][0]
    assert [(u["uri"], u["conditional"]) for u in route["to_uris"]] == [("b", True), ("c", False)]
    css = by_tag(documents.stylesheet("s.scss", "@import 'base';\n.a { color: red; &:hover, .b { x: y; } }"))
    assert [c["text"].split(" {")[0] for c in css["chunk"]] == [".a:hover, .a .b", ".a"] and css["source_import"][0]["dst"] == "base"


def field(number, kind, value):
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    return varint(number << 3 | kind) + (varint(value) if kind == 0 else varint(len(value)) + value)


def test_scip(spark):
    def occurrence(span, symbol, roles=0, around=()):
        body = field(1, 2, bytes(span)) + field(2, 2, symbol.encode())
        return field(2, 2, body + (field(3, 0, roles) if roles else b"") + (field(7, 2, bytes(around)) if around else b""))

    save, put = "s m p 1 a/Repo#save().", "s m p 1 a/Service#put()."
    document = field(1, 2, b"A.java") + occurrence((3, 1, 9), put, 1, (2, 0, 9, 1)) + occurrence((5, 1, 4), save) + occurrence((20, 1, 4), save, 1, (20, 0, 22, 1)) + occurrence((5, 9, 12), "local 3")
    files = spark.createDataFrame([(bytearray(field(2, 2, document)),)], "content binary")
    seen = scip.decode(files)
    assert {tuple(r) for r in scip.calls(seen).collect()} == {("a.Service.put", "a.Repo.save")}
    assert {r.qualified_name for r in scip.entities(seen).collect()} == {"a.Service.put", "a.Repo.save"}


def test_dispatch_and_errors(spark):
    assert [S.parser_for(p, t)[0] if S.parser_for(p, t) else None for p, t in (("x/pom.xml", ""), ("m.xml", "<mapper/>"), ("b.xml", "<beans/>"), ("application.yml", "a: 1"), ("x.yml", "a: 1"), ("x.bin", ""))] == ["maven", "mybatis", "spring-xml", "config", "yaml", None]
    files = spark.createDataFrame([("a.md", "# T\nx", 1), ("b.md", None, 1), (None, "x", 1), ("c.py", "def f(): pass", 1)], "path string, content string, tag int")
    rows = S.parse(files)
    assert {r.tag for r in rows.collect()} == {"section", "chunk", "entity"} and S.parse(files.limit(0)).count() == 0
    assert S.records(rows, "entity").filter("kind = 'function'").first().qualified_name == "c.f"


def test_derived_from_the_sample_project(spark):
    p = Q.Project(spark)
    rows = lambda df: {tuple(r) for r in df.collect()}
    points = D.injection_points(p.entities, p.annotations, p.t["field"], p.beans)
    assert rows(D.injections(points, p.beans, D.supertypes(p.entities)).select("type", "multiplicity", "target", "reason")) == {
        ("Pricing", "single", "dev.kiosk.core.FlatPricing", None), ("Pricing", "collection", "dev.kiosk.core.FlatPricing", None), ("Clock", "single", None, "ambiguous"),
    }
    assert {r.name for r in p.beans.collect()} == {"flatPricing", "audit", "basketController", "wiring", "timer", "spareClock"}
    assert rows(D.module_dependencies(p.t["module"], p.t["dependency"]).select("module", "target")) == {("shop/core", None), ("shop/web", "shop/core")}
    assert {r.type for r in Q.resolver_persistence(spark, "").collect()} == {"MANAGES", "PERSISTS_AS", "RELATES_TO"}
    assert rows(Q.resolver_service_calls(spark, "")) == {("dev.kiosk.web.BasketClient.fetch(Long)", "dev.kiosk.web.BasketController.show(Long)")}
    assert rows(Q.resolver_routes(spark, "").select("target")) == {("dev.kiosk.core.FlatPricing.total(Basket)",)}
    assert rows(Q.resolver_mappers(spark, "")) == {("dev.kiosk.core.Pricing.total(Basket)",)}
    assert rows(D.behaviours(p.annotations).select("owner")) == {("dev.kiosk.core.FlatPricing.total(Basket)",)}
    names = spark.createDataFrame([("findByOwnerNameAndOpenTrueOrderByIdDesc",), ("countByBrandIn",), ("save",), ("findByOrderId",)], "n string")
    assert [r[0] for r in names.select(D.derived_properties(F.col("n"))).collect()] == [["ownerName", "open"], ["brand"], [], ["orderId"]]


def test_pointcuts(spark):
    for text in ("!execution(* a.b(..))", "args(x)", "", "within(a", "within(a) && ", "within(a) within(b)", "missing()", "(within(a)"):
        with pytest.raises(P.Unsupported):
            P.condition(P.parsed(text), {})
    with pytest.raises(P.Unsupported):
        P.condition(P.parsed("x()"), {"x": "y()", "y": "x() || within(a)"})
    tree = P.parsed("within(a) || within(b) && within(c)")
    assert tree.operator == "||" and tree.right.operator == "&&" and P.parsed("(within(a) || within(b)) && within(c)").operator == "&&"
    rows = [("dev.a.T.run", "dev.a.T", ["x.Timed"]), ("dev.a.b.T.stop", "dev.a.b.T", []), ("dev.c.U.run", "dev.c.U", [])]
    methods = spark.createDataFrame(rows, "qn string, owner string, annotations array<string>")
    named = {"inA": "within(dev.a..*)", "runs": "execution(* run(..))"}
    hit = lambda text: [r.qn for r in methods.filter(P.condition(P.parsed(text), named)).orderBy("qn").collect()]
    assert hit("inA()") == ["dev.a.T.run", "dev.a.b.T.stop"] and hit("runs() && inA()") == ["dev.a.T.run"] and hit("Other.runs() || inA()") == [r[0] for r in sorted(rows)]
    assert hit("within(dev.a.*)") == ["dev.a.T.run"] and hit("@annotation(y.Timed)") == hit("@annotation(Timed)") == ["dev.a.T.run"]
    assert hit("execution(public void dev..T.s*(..))") == ["dev.a.b.T.stop"] and hit("execution(* dev.a.T.*(..))") == ["dev.a.T.run"]
    advice = spark.createDataFrame([("1", "A.p()", "pointcut", "within(dev.c..*)"), ("2", "A.q()", "before", "p()"), ("3", "A.r()", "after", "args(x)")], "id string, advice_qn string, kind string, expression string")
    entities = spark.createDataFrame([("dev.c.U.run()", "dev.c.U", "method")], "qualified_name string, parent_qualified_name string, kind string")
    notes = spark.createDataFrame([], "owner string, fqn string, target string")
    hits, reasons = D.advises(advice, entities, notes)
    assert [tuple(r) for r in hits.collect()] == [("2", "dev.c.U.run()")] and [r.advice for r in reasons.collect()] == ["3"]


def test_secrets_and_references_of_config():
    text = "app.user=ann\napp.password=p\napp.greeting=hello ${app.user} and ${app.none}\n#---\nspring.config.activate.on-profile=prod\napp.user=bob\napp.greeting=${app.user}\n"
    found = list(documents.config_file("conf/application-x.properties", text))
    rows = [r for tag, r in found if tag == "config_property"]
    value = {(r["profile"], r["key"]): r for r in rows}
    assert value["x", "app.password"]["value"] == "p" and {r["profile"] for r in rows} == {"x", "prod"}
    assert value["x", "app.greeting"]["refs"] == [value["x", "app.user"]["id"]] and value["prod", "app.greeting"]["refs"] == [value["prod", "app.user"]["id"]]
    chunks = [r["text"] for tag, r in found if tag == "chunk"]
    assert len(chunks) == 2 and "app.password = ***" in chunks[0] and chunks[1].startswith("application-x (profile prod)\n")


def test_stream(spark, tmp_path):
    folder, store = tmp_path / "in", I.TableStore(spark, f"file://{tmp_path}/out")
    folder.mkdir()
    (folder / "a.md").write_text("# A\none two")
    (folder / "b.py").write_text("def f(): pass")
    I.watch(spark, str(folder), store, f"{tmp_path}/cp").awaitTermination()
    chunks = lambda: {r.text for r in store.read("chunk", "path string, text string").collect()}
    assert chunks() == {"one two"}
    (folder / "c.md").write_text("# C\nthree")
    I.watch(spark, str(folder), store, f"{tmp_path}/cp").awaitTermination()
    assert chunks() == {"one two", "three"} and store.read("source", "path string, content_hash string").count() == 3
    I.forget_sources(store, store.read("source", "path string, content_hash string").filter("path LIKE '%c.md'"))
    assert chunks() == {"one two"}


def test_a_batch_that_fails_shows_nothing(spark, tmp_path):
    store = I.TableStore(spark, f"file://{tmp_path}/out")
    files = lambda *rows: spark.createDataFrame([(p, c, c) for p, c in rows], "path string, content string, content_hash string")
    I.merge_batch(store, files(("a.md", "# A\none"), ("b.md", "# B\ntwo"), (None, "x")), 0)
    held = lambda: sorted(r.text for r in store.read("chunk", "path string, text string").collect())
    read = store.read

    def fails(name, *rest):
        if name == "chunk":
            raise OSError("lost")
        return read(name, *rest)

    store.read = fails
    with pytest.raises(OSError):
        I.merge_batch(store, files(("a.md", "# A\nnew")), 1)
    store.read = read
    assert held() == ["one", "two"]
    I.merge_batch(store, files(("a.md", "# A\nnew")), 1)
    assert held() == ["new", "two"]
    I.merge_batch(store, files(("a.md", "# A\nnewer")), 2)
    I.merge_batch(store, files(("a.md", "# A\nnewer")), 3)  # nothing new
    assert held() == ["newer", "two"] and len(list((tmp_path / "out" / "manifests").glob("*.json"))) == 2


def test_streamed_tables_are_all_that_was_parsed(spark, tmp_path):
    store = I.TableStore(spark, f"file://{tmp_path}/tables")
    files = spark.createDataFrame(sorted(Q.PROJECT.items()), "path string, content string").withColumn("content_hash", F.sha2("content", 256))
    older = files.withColumn("content_hash", F.lit("older"))  # every file comes again in the second batch
    I.merge_batch(store, older, 0)
    I.merge_batch(store, files, 1)
    parsed = S.parse(files).persist()
    for name in S.SCHEMAS:
        want = S.records(parsed, name)
        got = store.read(name, I.stored_schema(name)).select(want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name
    assert store.read("annotation", I.stored_schema("annotation")).count() and store.read("module", I.stored_schema("module")).count()
    I.forget_sources(store, files.select("path"))
    assert store.read("module", I.stored_schema("module")).count() == 0


def test_rules_run_over_the_source_files(spark, data):
    files = spark.read.parquet(f"{data}/source_files.parquet").filter("path IS NOT NULL")
    both = Q.Project(spark, data)
    assert both.sources.count() == len({r.path for r in files.collect()} | set(Q.PROJECT))
    assert both.t["entity"].join(files, "path").count() > 0
    assert {str(r) for r in Q.resolver_beans(spark, "").collect()} <= {str(r) for r in Q.resolver_beans(spark, data).collect()}
