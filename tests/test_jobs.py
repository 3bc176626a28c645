import os

import pytest

from quire import cli
from quire.plans import jobs
from quire.sources import files
from tests.test_manifest import MAIL

NOW = ["2026-02-03T10:00:00+00:00"]


def clock():
    return NOW[0]


@pytest.fixture
def corpus(tmp_path):
    inside = tmp_path / "in"
    inside.mkdir()
    for name, data in {"a.eml": MAIL, "b.eml": MAIL.replace(b"Bonjour", b"Bonsoir"), "c copie.eml": MAIL, "x.odt": b"3", "p.pdf": b"4"}.items():
        (inside / name).write_bytes(data)
    root = tmp_path / "corpus"
    assert cli.main(["--corpus", str(root), "init"]) == 0
    return str(root), str(inside)


def test_import_checklist_and_statistics(spark, corpus):
    root, inside = corpus
    told = jobs.import_paths(spark, root, [inside], clock)
    assert told["outcomes"] == {"added": 4, "duplicate": 3, "unsupported": 1} and told["converted"] == {"fait": 2, "echec": 2}
    notes = {os.path.relpath(p, root) for p in files.walk([f"{root}/corpus"])}
    assert notes == {"corpus/_a-ranger/a.md", "corpus/_a-ranger/b.md"}
    body = open(f"{root}/corpus/_a-ranger/a.md", encoding="utf-8").read()
    assert body.startswith('---\noriginal: "[[originaux/') and 'nom_origine: "a.eml"' in body and "importe_le: 2026-02-03" in body and "<!-- eml -->" in body and "Bonjour" in body
    assert "## Conversions en échec" in open(f"{root}/{jobs.CHECKLIST}", encoding="utf-8").read()
    again = jobs.import_paths(spark, root, [inside], clock)
    assert again["outcomes"] == {"duplicate": 7, "unsupported": 1} and again["converted"] == {}
    lines = jobs.statistics(spark, root)
    assert lines[0] == "Documents : 4 (dont 1 pièce(s) jointe(s) de mails)" and any("à ranger 2" in x for x in lines) and any("eml 2" in x for x in lines)


def test_restore_move_and_reconvert(spark, corpus):
    root, inside = corpus
    jobs.import_paths(spark, root, [f"{inside}/a.eml", f"{inside}/b.eml"], clock)
    docs = {r.source_name: r for r in jobs.documents(spark, root).collect()}
    assert jobs.move(spark, root, docs["a.eml"].sha256, "Reçus/2026", "Un titre ?") == "Reçus/2026/Un titre.md"
    os.remove(f"{root}/{docs['b.eml'].original}")
    assert jobs.import_paths(spark, root, [f"{inside}/b.eml"], clock)["outcomes"]["restored"] == 1
    os.utime(f"{root}/corpus/Reçus/2026/Un titre.md", (1_770_000_000, 1_770_000_000))
    assert jobs.reconvert(spark, root, clock) == {"pending": 1, "edited": 1}
    got = jobs.reconvert(spark, root, clock, dry_run=False)
    assert got["now_fait"] == 1 and "Bonjour" in open(f"{root}/corpus/Reçus/2026/Un titre.md", encoding="utf-8").read()


def test_command_line(spark, corpus, capsys, tmp_path):
    root, inside = corpus
    assert cli.main(["--corpus", root, "import", f"{inside}/a.eml"], spark) == 0 and cli.main(["--corpus", root, "etat"], spark) == 0 and cli.main(["--corpus", root, "mesures"], spark) == 0
    assert "Documents : 2" in capsys.readouterr().out
    assert cli.main(["--corpus", str(tmp_path), "etat"], spark) == 1 and cli.main(["--corpus", root, "import", "/nothing"], spark) == 1


def test_reset(spark, corpus):
    root, inside = corpus
    jobs.import_paths(spark, root, [f"{inside}/a.eml"], clock)
    assert jobs.reset(spark, root, clock) == {"documents": 2, "markdown": 1, "folders": 1} and os.path.exists(f"{root}/corpus/_a-ranger/a.md")
    jobs.reset(spark, root, clock, dry_run=False)
    assert not os.path.exists(f"{root}/corpus/_a-ranger/a.md") and os.path.exists(f"{root}/.corpus/reinitialisations/2026-02-03T10-00-00/corpus/_a-ranger/a.md")
    assert {r.status for r in jobs.documents(spark, root).collect()} == {"a_faire"}
    assert jobs.import_paths(spark, root, [], clock)["converted"] == {"fait": 1, "echec": 1}
    os.remove(f"{root}/{jobs.documents(spark, root).first().original}")
    with pytest.raises(ValueError):
        jobs.reset(spark, root, clock)


def test_a_conversion_cut_off_after_its_notes_writes_the_same_files(spark, corpus, monkeypatch):
    root, inside = corpus
    jobs.register(spark, root, [f"{inside}/a.eml", f"{inside}/b.eml"], clock())
    real, left = jobs._record, [1]

    def record(events, where):
        if not left.pop() if left else True:
            raise OSError("cut off")
        real(events, where)

    monkeypatch.setattr(jobs, "_record", record)
    with pytest.raises(OSError):
        jobs.convert_pending(spark, root, clock())
    monkeypatch.undo()
    written = set(files.walk([f"{root}/corpus"]))
    assert len(written) == 2 and jobs.convert_pending(spark, root, clock())["fait"] == 2
    assert set(files.walk([f"{root}/corpus"])) == written
