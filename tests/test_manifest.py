import pytest

from quire.operators import ingest, manifest
from quire.sources import files, sinks
from quire.streaming import inbox

MAIL = b"From: =?utf-8?q?Conseill=C3=A8re?= <c@x.fr>\r\nTo: e@x.fr\r\nSubject: Objet\r\nDate: Mon, 02 Feb 2026 10:15:00 +0100\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=B\r\n\r\n--B\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nBonjour  \r\n\r\n--B\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=\"con:voc.PDF\"\r\nContent-Transfer-Encoding: base64\r\n\r\nUERG\r\n--B--\r\n"


@pytest.fixture
def folder(tmp_path):
    for name, data in {"a.pdf": b"1", "b.pdf": b"2", "z copie.pdf": b"1", "n.odt": b"3", ".cache/h.pdf": b"4", "_a-ranger/m.eml": MAIL}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return tmp_path


def sources(spark, folder):
    return files.with_content(files.listed(spark, [str(folder)]), ingest.SUPPORTED)


def test_import_outcomes(spark, folder):
    told = ingest.with_attachments(sources(spark, folder))
    empty = spark.createDataFrame([], "sha256 string, status string")
    got = sorted((r.name, r.outcome) for r in ingest.outcomes(told, empty, spark.createDataFrame([], "original string")).collect())
    assert got == [("a.pdf", "added"), ("b.pdf", "added"), ("m.eml", "added"), ("m.eml › con voc.pdf", "added"), ("n.odt", "unsupported"), ("z copie.pdf", "duplicate")]
    known = told.where("supported").selectExpr("sha256", "'echec' as status").distinct()
    again = ingest.outcomes(told, known, told.where("name <> 'b.pdf'").select("original").distinct()).collect()
    assert {r.name: (r.outcome, r.status) for r in again}["b.pdf"] == ("restored", "a_faire")
    assert {r.name: (r.outcome, r.status) for r in again}["a.pdf"] == ("duplicate", "echec")


def test_walk(folder):
    names = [p[len(str(folder)) + 1 :] for p in files.walk([str(folder)])]
    assert names == ["_a-ranger/m.eml", "a.pdf", "b.pdf", "n.odt", "z copie.pdf"]
    with pytest.raises(FileNotFoundError):
        files.walk([str(folder / "nothing")])


def test_mail_and_extraction(spark, folder):
    rows = files.extracted(ingest.hashed(sources(spark, folder))).collect()
    by = {r.name: r for r in rows}
    assert by["m.eml"].pages[0].text.startswith("**De :** Conseillère <c@x.fr>  \n**À :** e@x.fr  \n**Date :** 2026-02-02 10:15  \n**Objet :** Objet\n\nBonjour\n\n**Pièces jointes :** con:voc.PDF")
    assert by["a.pdf"].error == "LookupError : no reader for .pdf"


def log(spark, *rows):
    return spark.createDataFrame([(i, s, f"{s}.pdf", "", f"originaux/{s}.pdf", None, None, st, de, "2026-01-01T00:00:00+00:00", c) for i, (s, st, de, c) in enumerate(rows)], manifest.LOG_SCHEMA)


def test_latest_and_counts(spark):
    docs = manifest.latest(log(spark, ("a", "a_faire", None, None), ("b", "a_faire", None, None), ("a", "fait", None, None)))
    assert {r.sha256: r.status for r in docs.collect()} == {"a": "fait", "b": "a_faire"}
    assert {r.status: r.n for r in manifest.counts(docs).collect()} == {"a_faire": 1, "fait": 1, "a_verifier": 0, "echec": 0}


def test_reconverted(spark):
    before = manifest.latest(log(spark, ("ticked", "fait", "doute", "t"), ("doubtful", "fait", None, "t"), ("failing", "fait", None, "t")))
    results = spark.createDataFrame([("ticked", "a_verifier", "d2", None, "u"), ("doubtful", "a_verifier", "d", None, "u"), ("failing", None, None, "E : x", "u")], "sha256 string, status string, detail string, error string, at string")
    got = {r.sha256: (r.status, r.outcome, r.converted_at) for r in manifest.reconverted(before, results).collect()}
    assert got == {"ticked": ("fait", "fait", "u"), "doubtful": ("a_verifier", "a_verifier", "u"), "failing": ("fait", "failed", "t")}


def test_reset_needs_originals(spark):
    docs = manifest.latest(log(spark, ("a", "fait", None, None)))
    with pytest.raises(ValueError):
        manifest.reset(docs, spark.createDataFrame([], "original string"))
    assert manifest.reset(docs, spark.createDataFrame([("originaux/a.pdf",)], "original string")).first().status == "a_faire"


def test_free_names(spark):
    wanted = spark.createDataFrame([(1, "f", "x"), (2, "f", "x"), (3, "f", "x (2)"), (4, "f", "x"), (5, "g", "x")], "ord long, folder string, stem string")
    taken = spark.createDataFrame([("f", "x.md"), ("f", "x (4).md")], "folder string, name string")
    got = {r.ord: r.name for r in manifest.free_names(wanted, taken).collect()}
    assert got == {1: "x (2).md", 2: "x (3).md", 3: "x (2) (2).md", 4: "x (5).md", 5: "x.md"}


def test_free_names_beyond_the_limit_for_notes(spark):
    n = manifest.MAX_TWINS + 3
    wanted = spark.range(1, n + 1).selectExpr("id as ord", "'f' as folder", "'x' as stem")
    taken = spark.createDataFrame([("f", "x.md"), ("f", "x (3).md"), ("f", f"x ({n + 1}).md")], "folder string, name string")
    got = [r.name for r in manifest.free_names(wanted, taken).orderBy("ord").collect()]
    assert got == [f"x ({k}).md" for k in range(2, n + 5) if k not in (3, n + 1)][:n]
    with pytest.raises(ValueError):
        manifest.free_names(wanted, taken, manifest.MAX_TWINS)


def test_filed(spark):
    folders = spark.createDataFrame([(1, "CAF"), (2, "Straße")], "ord long, folder string")
    got = [(r.folder, r.new_folder) for r in manifest.filed(spark.createDataFrame([("caf",), ("strasse",), ("Neuf/x",)], "folder string"), folders).orderBy("folder").collect()]
    assert sorted(got) == [("CAF", False), ("Neuf/x", True), ("Straße", False)]


def test_stream_is_incremental(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("log")
    run = lambda: inbox.watch(spark, str(folder), f"{out}/log", f"{out}/cp", lambda: "2026-01-01T00:00:00+00:00").awaitTermination()
    run()
    assert manifest.latest(manifest.open_log(spark, f"{out}/log")).count() == 2
    (folder / "c.pdf").write_bytes(b"5")
    (folder / "d.pdf").write_bytes(b"2")
    run()
    assert sorted(r.source_name for r in manifest.open_log(spark, f"{out}/log").collect())[-1] == "c.pdf"
    assert manifest.open_log(spark, f"{out}/log").count() == 3


def test_sinks_and_notes(spark, folder, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))
    sinks.store_originals(ingest.hashed(sources(spark, folder)), root)
    sinks.store_originals(ingest.hashed(sources(spark, folder)), root)
    assert len(files.walk([f"{root}/originaux"])) == 3
    sinks.write_notes(spark.createDataFrame([("n/é.md", '---\noriginal: "[[originaux/ab.pdf]]"\n---\r\nx')], "path string, markdown string"), root)
    got = files.notes(spark, f"{root}/n").first()
    assert (got.path, got.original, got.readable) == ("é.md", "originaux/ab.pdf", True) and "\r" not in got.markdown
    assert sinks.move_note(root, "n/é.md", "k", "e.md") == "k/e.md"
