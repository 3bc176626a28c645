from quire.operators import layout

SCHEMA = "page_key string, ord long, text string, left double, top double, right double, bottom double, score double"


def pieces(spark, *given, pitch=30, height=20):
    """Pieces (text, left, row or top) of ten units a character."""
    rows = [("p", i, t, float(x), float(y * pitch), float(x + 10 * len(t)), float(y * pitch + height), None) for i, (t, x, y) in enumerate(given)]
    return spark.createDataFrame(rows, SCHEMA)


def text(spark, *given, **kw):
    found = layout.page_text(pieces(spark, *given, **kw)).collect()
    return found[0].text if found else ""


def test_wrapped_rows_form_a_paragraph(spark):
    assert text(spark, ("Bonjour, voici une phrase", 0, 0), ("qui continue ici ensuite", 0, 1), ("et finit.", 0, 2)) == "Bonjour, voici une phrase qui continue ici ensuite et finit."


def test_short_rows_stay_apart(spark):
    assert text(spark, ("Adresse", 0, 0), ("12 rue", 0, 1), ("une longue ligne de référence", 0, 2)) == "Adresse\n\n12 rue\n\nune longue ligne de référence"


def test_hyphen_and_lower_case_glue(spark):
    assert text(spark, ("un mot coupé en deux par-", 0, 0), ("ties égales et longues ici", 0, 1)) == "un mot coupé en deux par-ties égales et longues ici"


def test_list_items_and_fields(spark):
    assert text(spark, ("- premier élément de liste", 0, 0), ("- deuxième élément de liste", 0, 1), ("IBAN : FR76 0000 0000 0000", 0, 2)).count("\n\n") == 2


def test_columns_never_join(spark):
    assert text(spark, ("Libellé", 0, 0), ("12,00", 300, 0), ("Autre", 0, 1), ("13,00", 300, 1)) == "Libellé 12,00\n\nAutre 13,00"


def test_reading_order_and_numbers(spark):
    got = layout.reading_order(pieces(spark, ("b", 100, 0), ("a", 0, 0), ("c", 0, 1))).orderBy("number").collect()
    assert [(r.text, r.row_id, r.number) for r in got] == [("a", 1, 1), ("b", 1, 2), ("c", 2, 3)]


def test_big_gap_and_size_change(spark):
    assert text(spark, ("une ligne pleine de texte", 0, 0), ("une autre ligne pleine ici", 0, 3)).count("\n\n") == 1


def test_empty(spark):
    assert layout.page_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks_and_runs(spark):
    p = pieces(spark, ("Titre", 0, 0), ("libre", 0, 2), ("encore", 0, 3))
    boxes = spark.createDataFrame([("p", 0, -5.0, -5.0, 500.0, 500.0, "page"), ("p", 1, -5.0, -5.0, 200.0, 30.0, "title")], "page_key string, idx int, x0 double, y0 double, x1 double, y1 double, kind string")
    assert [r.idx for r in layout.in_blocks(p, boxes).orderBy("ord").collect()] == [1, 0, 0]
    items = layout.in_blocks(p, boxes.where("idx = 1"))
    assert [r.run_id for r in layout.block_runs(items).orderBy("number").collect()] == [1, 2, 2]
