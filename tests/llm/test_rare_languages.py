"""A sample of the labelled documents leaves no language out."""

import random
import tracemalloc
from zlib import crc32

import numpy as np

from quire.llm import langid

from .cases import words


def test_rare_languages_are_learned(spark):
    rows = [(i, words(8, i), "x") for i in range(3000)] + [(5000 + i, words(8, i, "opqrst"), "y") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sampled, whole = ({r.lang: r.v for r in p.collect()} for p in (langid.fit(df, fit_documents=20), langid.fit(df)))
    assert set(sampled) == {"x", "y"} and sampled["y"] == whole["y"] and sampled["x"] != whole["x"]


def test_verdicts_by_brute_force(spark, monkeypatch):
    """Prototypes and cosines computed one trigram at a time; more languages than a block holds."""
    monkeypatch.setattr(langid, "BLOCK", 3)
    alphabets = ["abc", "cde", "efg", "ghi", "ijk", "klm", "mno", "aeio"]
    rows = [(i, words(3 + i % 9, i, alphabets[i % 8]), f"l{i % 8}") for i in range(160)] + [(900, None, "l0"), (901, "12", "l1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    letter = lambda c: langid.letter_vector(int(c), langid.DIMENSIONS, langid.SEED).astype(float)

    def vector(text):
        ring = langid.folded(text)
        return sum((np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c) for a, b, c in zip(ring, ring[1:], ring[2:])), np.zeros(langid.DIMENSIONS))

    sums = {}
    for i, text, lang in rows:
        if text and crc32(str(i).encode()) % 5:
            sums[lang] = sums.get(lang, 0) + vector(text)
    for r in langid.identify(df).collect():
        v = vector(dict((i, t) for i, t, _ in rows)[r.doc_id])
        if not v.any():
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        cos = {lang: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for lang, p in sorted(sums.items())}
        best = max(cos, key=cos.get)
        assert r.lang_pred == best and abs(r.score - max(0, cos[best])) < 1e-9


def test_long_texts_in_a_large_script_take_bounded_memory():
    r = random.Random(1)
    texts = ["".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(2000)) for _ in range(100)]
    tracemalloc.start()
    for run in langid.groups(texts):
        langid.text_vectors(run)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_parts_of_a_long_text_add_up(monkeypatch):
    whole = langid.text_vectors([words(500, 3), "ab"])
    monkeypatch.setattr(langid, "SEGMENT", 7)
    assert (langid.text_vectors([words(500, 3), "ab"]) == whole).all()
