from pyspark.sql import functions as F

from loomspan.llm import languages as L


def test_labels(spark):
    named = {"EN": "en", "pt-BR": "pt", "es_MX": "es", "German": "de", "zho": "zh", " fr ": "fr", None: None, "": None, "xx": None, "n/a": None, "pl": None, "unknown": None, "Brazilian Portuguese": "pt", "Simplified Chinese": "zh", "lang: de": None, "either german or dutch": None}
    assert {k: L.named_language(k) for k in named} == named
    rows = spark.createDataFrame([(k,) for k in named], "k string").select("k", L.label_language(F.col("k")).alias("c"))
    assert {r.k: r.c for r in rows.collect()} == named


def test_sentences():
    text = "# A heading of words.\n\nOne plain sentence is\nbroken over lines. Two of them stay. («archivo no encontrado»)\n```\ncode is here.\n```\n2025-01-01T00:00:00Z INFO a log line here.\n- An entry of a list.\nCall `a.b` in the end. No stop here"
    assert [s.replace("\u00a7", "").split()[0] for s in L.whole_sentences(text)] == ["One", "Two", "An", "Call"]
    assert len(L.whole_sentences("\u8fd9\u91cc\u6ca1\u6709\u4ec0\u4e48\u3002\u4ed6\u4eec\u4e00\u76f4\u5728\u7b49\u5f85\u3002")) == 2 and L.whole_sentences("...") == [] and L.whole_sentences(" ") == []


def test_mixture(spark):
    model = L.train([])
    en, de, fr = L.SEED["en"], L.SEED["de"], L.SEED["fr"]
    one = de.split(". ")[0] + "."
    rows = [(1, en, "en-GB"), (2, en, None), (3, de, "en"), (4, en + "\n\n" + de + "\n\n" + fr, "en"), (5, None, "en"), (6, "", None), (7, "# x", "xx"), (8, one, None), (9, en * 200, "eng"), (10, en + " " + one, "en")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, languages string")
    profiles = L.language_profiles(df, model)
    assert {(r.doc_id, r.lang) for r in L.mislabelled(profiles).collect()} == {(2, "en"), (3, "de"), (4, "en"), (4, "de"), (4, "fr")}
    segments = {r.doc_id: [s.lang for s in r.segments] for r in profiles.collect()}
    assert segments[4] == ["en", "de", "fr"] and segments[5] == [] and segments[10] == ["en", "de"]
    assert all(0 < x.confidence <= 1 for r in profiles.collect() for x in r.languages)
    assert L.language_profiles(df.limit(0), model).count() == 0 and L.training_sample(df.limit(0)) == []


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    sample = L.training_sample(docs.filter("doc_id % 2 = 0"))
    model = L.train(sample)
    rows = L.own_languages(L.language_profiles(docs.filter("doc_id % 2 = 1"), model)).filter("n_languages = 1 AND named IS NOT NULL").collect()
    assert rows and sum(r.lang == r.named for r in rows) / len(rows) > 0.85  # labels themselves are wrong for some
