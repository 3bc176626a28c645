"""Small documents for the operators' tests: nulls, empty and very long texts, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id string, missing string, score string, ids string"


def words(n, seed=0, letters="abcdefghij"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(n))


TEXTS = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "un"), (5, "un deux"), (6, words(400, 1)), (7, words(400, 1)), (7, words(400, 1)), (None, "sans numéro, deux fois !"), (None, None),
    (8, "héhé 日本語 🙂 \x1f\x01\x02\x03 " * 20), (9, words(60_000, 2)), (10, words(400, 1) + " fin"), (-5, "Négatif\r\nid\n\n\nFIN   x"), (11, "a" * 5000), (12, "¡Hola! ¿Qué tal? 12345 '''s don't I'll   \xa0x"),
]


def documents(spark, rows=TEXTS, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", None, "k", "i", "m", "s", "x") for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
