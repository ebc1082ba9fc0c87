from pyspark.sql import functions as F

from loomspan.functions.embed import embedding, hashing_embedder
from loomspan.operators import derive as D
from loomspan.operators import lookup as K
from loomspan.plans import ingestion as Q
from loomspan.sources import pages


def test_pages(spark):
    rows = [("a.pdf", p, y, y + 10.0, t, 800.0) for p in range(4) for y, t in ((20.0, f"Head {p}"), (100.0, f"body {p} ﬁne"), (400.0, f"more {p}"), (780.0, "foot"))]
    rows += [("b.pdf", 0, 100.0, 110.0, "lone", 800.0), ("b.pdf", 0, 200.0, 210.0, None, 800.0)]
    blocks = spark.createDataFrame(rows, "path string, page int, y0 double, y1 double, text string, page_height double")
    outline = spark.createDataFrame([("a.pdf", 0, 1, "One", 0, 0.0), ("a.pdf", 1, 2, "Sub", 1, 402.0), ("a.pdf", 2, 1, "Two", 3, None)], "path string, idx int, level int, title string, page int, y double")
    got = {r.id: (r.breadcrumb, r.text, r.start_page, r.end_page) for r in pages.sections(blocks, outline).collect()}
    assert got == {
        "a.pdf::s0000": ("One", "body 0 fine\nmore 0\nbody 1 fine", 0, 1), "a.pdf::s0001": ("One > Sub", "more 1\nbody 2 fine\nmore 2", 1, 2), "a.pdf::s0002": ("Two", "body 3 fine\nmore 3", 3, 3),
        "b.pdf::s0000": ("b.pdf", "lone", 0, 0),
    }


def test_lookups(spark):
    p = Q.Project(spark)
    rows = lambda df: [tuple(r) for r in df.collect()]
    ends = D.endpoints(p.entities, p.annotations)
    assert [r.path for r in K.endpoints_by(ends, "^/bask", "get").collect()] == ["/baskets/{id}"]
    assert rows(K.allowed_code(p.entities, beans=p.beans, stereotype="Service")) == [("dev.kiosk.core.FlatPricing",)]
    assert set(rows(K.allowed_code(p.entities, behaviours=D.behaviours(p.annotations), behaviour="transactional"))) == {("dev.kiosk.core.FlatPricing",), ("dev.kiosk.core.FlatPricing.total(Basket)",)}
    assert K.routes_by(p.t["route"], "jms:*").first().conditional_to_uris == ["jms:few", "jms:many"] and K.routes_by(p.t["route"], "^nothing$").count() == 0
    policies = spark.createDataFrame([("P2", "b", None, ["x", "a"]), ("P1", "a", "low", ["x"]), ("P3", None, None, None)], "id string, name string, severity string, resource_types array<string>")
    assert [(r.id, r.resource_types) for r in K.policies_for(policies, "x").collect()] == [("P1", ["x"]), ("P2", ["a", "x"])]
    assert K.repeated_keys(policies.union(policies.limit(1)), "id").count() == 1


def test_embedder(spark):
    texts = spark.createDataFrame([("red fish",), ("red fish",), (None,), ("",)], "t string")
    got = [r.e for r in texts.select(embedding(hashing_embedder(16))(F.col("t")).alias("e")).collect()]
    assert got[0] == got[1] and abs(sum(x * x for x in got[0]) - 1) < 1e-5 and got[2] is None and not any(got[3])
