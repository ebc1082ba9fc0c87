"""Java that publishes, binds and routes; answers built on what was derived."""

import pytest
from pyspark.sql import functions as F

from loomspan.functions.embed import embedding, hashing_embedder
from loomspan.operators import answers as A
from loomspan.operators import derive as D
from loomspan.operators import retrieval as R
from loomspan.operators import store as S
from loomspan.plans import ingestion as Q
from loomspan.sources import files

JAVA = """package k.m;
import k.e.Sold;
public class Desk extends RouteBuilder {
  private final KafkaTemplate<String, String> bus;
  @ExceptionHandler(Bad.class) public void onBad(@RequestParam("q") String v, @PathVariable Long id) {
    pub.publishEvent(new Sold(1)); pub.publishEvent(v); bus.send("sold.items", v); jmsThing.convertAndSend("q1", v); other.send("no"); bus.send(name, v);
  }
  @EventListener public void on(Sold sold) {}
  @Consume("direct:desk") public void take(String x) {}
  @Select({"SELECT * FROM items", "JOIN kinds ON true"}) public int items() { return 1; }
  public void configure() {
    from("direct:in").routeId("r1").choice().when(simple("${x}")).to("jms:a").otherwise().to("jms:b").end().bean(Desk.class, "take").to("log:z");
    from("direct:two").to("jms:c");
  }
}
"""


@pytest.fixture(scope="module")
def tables(spark):
    parsed = files.parse(spark.createDataFrame([("k/Desk.java", JAVA)], "path string, content string")).cache()
    return {tag: files.records(parsed, tag) for tag in files.SCHEMAS}


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_extraction(tables):
    bad = "k.m.Desk.onBad(String,Long)"
    assert rows(D.publications(tables["message_site"])) == {("event", None, "k.e.Sold", bad), ("event", None, "String", bad), ("destination", "kafka", "sold.items", bad), ("destination", "jms", "q1", bad)}
    assert rows(D.parameter_bindings(tables["annotation"], tables["entity"])) == {(bad, 0, "query", "q", "String"), (bad, 1, "path", "id", "Long")}
    assert rows(D.exception_handlers(tables["annotation"])) == {(bad, "Bad")}
    assert rows(D.annotated_statements(tables["annotation"], tables["entity"]).select("statement_id", "kind", "text")) == {("items", "select", "SELECT * FROM items JOIN kinds ON true")}
    assert rows(D.consumed_routes(tables["annotation"], tables["entity"])) == {("take@Consume", "direct:desk", "k.m.Desk.take(String)")}
    routes = {r.from_uri: r for r in tables["route"].collect()}
    assert {(u.uri, u.conditional) for u in routes["direct:in"].to_uris} == {("jms:a", True), ("jms:b", True), ("log:z", False)} and routes["direct:in"].route_id == "r1"
    assert [s.ref for s in routes["direct:in"].steps if s.kind == "bean"] == ["Desk.take"] and len(routes) == 2


def test_canonical_events(spark):
    names = spark.createDataFrame([("Sold",), ("k.e.Sold",), ("a.b.Sold",), ("Paid",), (None,)], "name string")
    assert rows(D.canonical_events(names)) == {("Sold", "a.b.Sold"), ("Paid", "Paid")}


def test_search(spark):
    embed = hashing_embedder(16)
    texts = [("a", "red fish swims", "A"), ("b", "blue fish sleeps", "A > B"), ("c", "the database is slow", None), ("d", None, "x"), ("c", "the database is slow", None)]
    table = spark.createDataFrame(texts, "id string, text string, breadcrumb string").withColumn("e", embedding(embed)(F.col("text")))
    ask = lambda q, **more: [r.id for r in A.search(table, "id", "text", "e", q, embed, copies=True, **more).collect()]
    assert ask("red fish")[0] == "a" and ask("slow db", rewrite=R.query_variants)[0] == "c"
    assert ask("red fish", allowed=spark.createDataFrame([("b",), ("b",)], "id string")) == ["b"] and ask("red fish", allowed=table.select("id").limit(0)) == []
    assert set(ask("red fish", keep=F.col("breadcrumb").startswith("A"))) == {"a", "b"}
    best = A.search(table, "id", "text", "e", "fish", embed, k=2, scorer=lambda d: F.length(d), document=A.prose_document(), copies=True).orderBy("position").collect()
    assert [r.id for r in best] == ["b", "c"] and best[0].rerank_score == len("A > B\n\nblue fish sleeps")

    def broken(q):
        raise OSError

    assert A.asked_variants("q", broken) == ["q"] and A.asked_variants("q", lambda q: [" Q ", "r", "", 5, "s"], 2) == ["q", "r"]
    joined = spark.createDataFrame([("n", None, "d"), ("", "s", None)], "a string, b string, c string").select(A.joined_document("a", "b", "c")).collect()
    assert [r[0] for r in joined] == ["n d", "s"]


def test_project_answers(spark):
    p = Q.Project(spark)
    outline = rows(Q.resolver_architecture(spark, ""))
    assert ("core", "bean", "flatPricing [Service]") in outline and any(c == "endpoint" and m == "web" for m, c, _ in outline)
    around = rows(Q.resolver_surroundings(spark, ""))
    assert ("dev.kiosk.core.FlatPricing", "behaves", "transactional") in around and any(r == "injects" for _, r, _ in around)
    placed = D.in_module(p.sources, p.t["module"])
    ends = D.endpoints(p.entities, p.annotations).join(p.entities.select(F.col("qualified_name").alias("handler"), "file_path"), "handler")
    assert A.in_named_module(ends, placed, p.t["module"], "file_path", "web").count() > 0 == A.in_named_module(ends, placed, p.t["module"], "file_path", "core").count()


def test_successors_over_ranges(spark):
    data = [("g" if n % 7 else None, n // 3, f"k{n:03d}") for n in range(200)]
    got = rows(S.next_in_order(spark.createDataFrame(data, "by string, at int, key string").repartition(9), "by", ["at"], "key"))
    want = set()
    for group in ("g", None):
        keys = [k for _, _, k in sorted((at, k, k) for by, at, k in data if by == group)]
        want |= set(zip(keys, keys[1:], strict=False))
    assert got == want
    one = spark.createDataFrame([("g", 1, "a")], "by string, at int, key string")
    assert S.next_in_order(one, "by", ["at"], "key").count() == 0 and S.next_in_order(one.limit(0), "by", ["at"], "key").count() == 0
