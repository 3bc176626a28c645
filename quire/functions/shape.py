"""Shape of JSON answers: what is missing or of the wrong type. Types are tested as they are, never coerced."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shape_problem(answer: Column, fields: dict[str, str], required: list[str]) -> Column:
    """Null if ``answer`` (JSON text) is an object with the required fields and ``fields`` of their kinds
    (``string`` or ``strings``), else the first problem."""
    parsed = F.try_parse_json(answer)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    problem = F.when(parsed.isNull() | ~is_object, "objet JSON attendu")
    part = lambda name: F.try_variant_get(parsed, f"$.{name}", "variant")
    for name in required:
        problem = problem.when(part(name).isNull(), f"« {name} » absent")
    for name, kind in fields.items():
        good = {"string": F.schema_of_variant(part(name)) == "STRING", "strings": F.schema_of_variant(part(name)).isin("ARRAY<STRING>", "ARRAY<VOID>")}[kind]
        problem = problem.when(part(name).isNotNull() & ~good, f"« {name} » : {'texte' if kind == 'string' else 'liste de textes'} attendu")
    return problem
