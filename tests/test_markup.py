from pyspark.sql import functions as F

from quire.functions import markup
from quire.operators import measures, rules

PAGES = "k int, pages " + f"array<{markup.PAGE_TYPE}>"


def test_write(spark):
    pages = [
        (1, "net\n\nflou", "ocr", 0.41, 2, []), (2, "", "blank", None, None, None), (3, "", "ocr", 0.0, 0, [("§", 0.31), ("-->", 0.12)]),
        (4, "a", "text", None, None, None),
    ]
    out = spark.createDataFrame([(1, pages), (2, [(1, "", "docx", None, None, None)])], PAGES).select(markup.to_markdown(F.col("pages"))).collect()
    assert out[0][0] == (
        "<!-- page 1 · ocr · 2 lignes · confiance min 0.41 -->\n\nnet\n\nflou\n\n<!-- page 2 · blank -->\n\n<!-- page blanche -->\n\n"
        "<!-- page 3 · ocr · 0 lignes · 2 fragments · confiance min 0.00 -->\n\n<!-- page vide ou illisible -->\n\n"
        "<!-- bruit probable, hors du texte : « § » 0.31 · « - -> » 0.12 -->\n\n<!-- page 4 · text -->\n\na\n"
    )
    assert out[1][0] == "<!-- docx -->\n\n<!-- document vide -->\n"


def read(spark, markdown):
    df = spark.createDataFrame([("d", markdown)], "doc_key string, markdown string")
    return measures.pages(measures.parsed(df)).collect()


def test_read_new_and_old_flags(spark):
    new = read(spark, "<!-- page 1 · ocr · 3 lignes · 2 fragments · confiance min 0.41 -->\n\na ==fl ou==<!-- illisible ? confiance 0.41 · ligne 2/3 --> c\n\n<!-- page 2 · text -->\n\n==x==")
    assert [(p.number, p.method, p.chars, p.confidence, p.lines, p.noise) for p in new] == [(1, "ocr", 9, 0.41, 3, 2), (2, "text", 1, None, 0, 0)]
    assert [tuple(f) for f in new[0].flagged] == [(5, 0.41, 0.5, True)]
    old = read(spark, "<!-- page 1 · ocr · confiance min 0.41 -->\n\nnet\n\n12 <!-- illisible ? confiance 0.50 -->\n\nfin\n")
    assert old[0].lines == 3 and [tuple(f) for f in old[0].flagged] == [(2, 0.5, 0.5, False)]
    assert read(spark, "texte seul") == []


def test_original_of(spark):
    notes = ['---\noriginal: "[[originaux/ab.pdf]]"\n---\nx', "---\nautre: 1\noriginal: '[[originaux/ab.pdf|nom]]'\n---\n", "---\noriginal: originaux/ab.pdf\n---\n", "---\noriginal: ailleurs/ab.pdf\n---\n", "original: originaux/ab.pdf"]
    df = spark.createDataFrame([(n,) for n in notes], "m string").select(markup.original_of(F.col("m")).alias("o"))
    assert [r.o for r in df.collect()] == ["originaux/ab.pdf"] * 3 + [None] * 2


def test_front_matter_round_trip(spark):
    df = spark.createDataFrame([("originaux/ab.pdf", 'dit "x\\y"', "originaux/cd.eml", "2026-02-03T10:00:00+01:00")], "o string, n string, p string, i string")
    r = df.select(markup.front_matter(F.col("o"), F.col("n"), F.col("p"), F.col("i")).alias("m")).select("m", markup.original_of(F.col("m")).alias("o")).first()
    assert r.o == "originaux/ab.pdf"
    assert r.m == '---\noriginal: "[[originaux/ab.pdf]]"\nnom_origine: "dit \\"x\\\\y\\""\npiece_jointe_de: "[[originaux/cd.eml]]"\nimporte_le: 2026-02-03\n---\n\n'


def test_review_status(spark):
    pages = [("a", 1, "x", "ocr", 0.99), ("a", 2, "", "ocr", 0.0), ("a", 3, "y", "ocr", 0.55), ("b", 1, "x", "ocr", 0.97), ("b", 2, "", "blank", None), ("c", 1, "", "blank", None)]
    df = spark.createDataFrame(pages, "doc_key string, number int, text string, method string, min_confidence double")
    got = {r.doc_key: (r.status, r.detail) for r in rules.review_status(df).collect()}
    assert got == {"a": ("a_verifier", "page 2 vide ou illisible ; page 3 : confiance OCR 0.55"), "b": ("fait", None), "c": ("a_verifier", "document entièrement blanc")}


def test_ocr_pages(spark):
    pieces = [("p", 1, "net", 0, 0, 30, 20, 0.99), ("p", 2, "flou", 0, 200, 40, 220, 0.41), ("n", 1, "§", 0, 0, 10, 20, 0.31), ("b", 1, "x", 0, 0, 10, 20, 0.2)]
    df = spark.createDataFrame([(k, o, t, float(a), float(b), float(c), float(d), s) for k, o, t, a, b, c, d, s in pieces], "page_key string, ord long, text string, left double, top double, right double, bottom double, score double")
    images = spark.createDataFrame([("p", 250.0, 0.1), ("n", 250.0, 0.1), ("b", 250.0, 0.0), ("e", 100.0, 0.0)], "page_key string, paper double, ink_share double")
    got = {r.page_key: r for r in rules.ocr_pages(df, images).collect()}
    assert got["p"].text == "net\n\n==flou==<!-- illisible ? confiance 0.41 · ligne 2/2 -->" and (got["p"].min_confidence, got["p"].lines) == (0.41, 2)
    assert (got["n"].method, got["n"].text, got["n"].min_confidence, got["n"].lines) == ("ocr", "", 0.0, 0) and [tuple(x) for x in got["n"].noise] == [("§", 0.31)]
    assert (got["b"].method, got["b"].lines, got["b"].noise) == ("blank", None, None)
    assert (got["e"].method, got["e"].min_confidence) == ("ocr", 0.0)


def test_flagged_lines_and_candidates(spark):
    body = "<!-- page 1 · ocr · 4 lignes · confiance min 0.41 -->\n\n==une ligne assez longue==<!-- illisible ? confiance 0.41 · ligne 2/4 -->\n\n<!-- page 2 · ocr · confiance min 0.41 -->\n\nvieille ligne bien longue <!-- illisible ? confiance 0.50 -->\n\nnet\n\n<!-- page 3 · blank -->\n\n<!-- page blanche -->\n\n<!-- page 4 · text -->\n\nt"
    df = spark.createDataFrame([("d", body)], "doc_key string, markdown string")
    assert sorted((r.page, r.text, r.confidence) for r in rules.flagged_lines(df).collect()) == [(1, "une ligne assez longue", 0.41), (2, "vieille ligne bien longue", 0.5)]
    assert sorted((r.page, r.kind) for r in rules.candidate_pages(df).collect()) == [(1, "OCR difficile"), (2, "OCR difficile"), (4, "texte")]
