import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from quire.operators import filing, layout
from quire.sources import local_model
from tests.test_layout import pieces

GOOD = {"type_document": "relevé", "emetteur": "CAF", "date": "2026-03-12", "titre": "Relevé  de mars", "dossier": "caf"}


def test_proposals(spark):
    answers = [("a", json.dumps(GOOD)), ("b", json.dumps(GOOD | {"dossier": "Neuf", "date": "12 mars"})), ("c", json.dumps({"titre": 3})), ("d", json.dumps(GOOD | {"titre": 3}))]
    folders = spark.createDataFrame([(1, "CAF")], "ord long, folder string")
    got = {r.doc_key: r for r in filing.proposals(spark.createDataFrame(answers, "doc_key string, answer string"), folders, 2026).collect()}
    assert (got["a"].folder, got["a"].new_folder, got["a"].name) == ("CAF", False, "2026-03-12 Relevé de mars")
    assert (got["b"].folder, got["b"].new_folder, got["b"].date, got["b"].name) == ("Neuf", True, None, "Relevé de mars")
    assert "absent" in got["c"].problem and "texte" in got["d"].problem and got["d"].name is None


def test_prompts(spark):
    notes = spark.createDataFrame([("a", "---\nx: 1\n---\n\n<!-- page 1 -->\n\n" + "x" * 5000)], "doc_key string, markdown string")
    got = filing.prompts(notes, spark.createDataFrame([("b",), ("a",)], "folder string")).first()
    assert len(got.text) == 4000 and got.folders == ["a", "b"]


class Model(BaseHTTPRequestHandler):
    answers: list[str] = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        type(self).seen = body["messages"]
        self.reply({"message": {"content": self.answers.pop(0)}})

    def do_GET(self):
        self.reply({"models": [{"name": "m"}]})

    def reply(self, data):
        raw = json.dumps(data).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def log_message(self, *a):
        pass


def test_local_model(tmp_path):
    server = HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    (tmp_path / "c.toml").write_text(f'[ia]\nurl = "http://127.0.0.1:{server.server_port}"\nmodele = "m"\ndelai = 5\n')
    config = local_model.load_config(str(tmp_path / "c.toml"))
    assert config.timeout == 5 and local_model.form({"properties": {"a": {"type": "array"}, "b": {"type": "string"}}}) == '{"a": [], "b": "…"}'
    Model.answers = ["no", "{}"]
    assert local_model.ask(config, "?", {}, lambda a: None if a == "{}" else "pas du JSON") == "{}" and "pas du JSON" in Model.seen[-1]["content"]
    Model.answers = ["no", "no"]
    with pytest.raises(ValueError):
        local_model.ask(config, "?", {}, lambda a: "non")
    assert local_model.models(config) == ["m"]
    server.shutdown()
    assert local_model.load_config(str(tmp_path / "none.toml")) is None
    (tmp_path / "d.toml").write_text("[ia]\nurl = 'x'\n")
    with pytest.raises(ValueError):
        local_model.load_config(str(tmp_path / "d.toml"))


@pytest.mark.parametrize("url", ["http://8.8.8.8", "ftp://127.0.0.1", "http://", "http://0.0.0.0", "http://[::ffff:8.8.8.8]"])
def test_public_addresses_are_refused(url):
    with pytest.raises(ValueError):
        local_model.check_local(url)


def test_page_from_blocks(spark):
    p = pieces(spark, ("Net imposable", 0, 4), ("Relevé", 0, 0), ("libre un", 0, 8), ("2 712,18 €", 400, 4))
    boxes = spark.createDataFrame([("p", 0, -5.0, -5.0, 300.0, 30.0, "doc_title"), ("p", 1, -5.0, 110.0, 200.0, 145.0, "text"), ("p", 2, 390.0, 110.0, 600.0, 145.0, "text")], "page_key string, idx int, x0 double, y0 double, x1 double, y1 double, kind string")
    assert [(r.page_key, r.text) for r in layout.page_from_blocks(p, boxes).collect()] == [("p", "## Relevé\n\nNet imposable\n\n2 712,18 €\n\nlibre un")]
