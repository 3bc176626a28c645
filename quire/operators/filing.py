"""Filing proposals: answers of a model, checked and matched with the folders that exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import shape, text
from . import manifest

#: The answer's fields, how much of a document and how many folders a model sees.
FIELDS = {"type_document": "string", "emetteur": "string", "date": "string", "titre": "string", "dossier": "string"}
MAX_TEXT, MAX_FOLDERS = 4000, 200


def prompts(notes: DataFrame, folders: DataFrame) -> DataFrame:
    """``notes`` (doc_key, markdown) with what a model is given: text and the known folders, cut to size."""
    known = sorted(r["folder"] for r in folders.orderBy("folder").limit(MAX_FOLDERS).collect())
    names = F.array(*[F.lit(k) for k in known]).cast("array<string>")
    return notes.select("doc_key", F.left(text.document_text(F.col("markdown")), F.lit(MAX_TEXT)).alias("text"), names.alias("folders"))


def proposals(answers: DataFrame, folders: DataFrame, this_year: int) -> DataFrame:
    """``answers`` (doc_key, answer as JSON) -> doc_key, problem, type_document, emetteur, date, title, folder, new_folder, name.

    An answer of the wrong shape has its problem and nothing else. ``folders``: ord, folder.
    """
    parsed = F.try_parse_json("answer")
    field = lambda n: F.try_variant_get(parsed, f"$.{n}", "string")
    told = answers.withColumn("problem", shape.shape_problem(F.col("answer"), FIELDS, list(FIELDS)))
    good = told.where("problem is null").select("doc_key", "problem", text.collapse(field("type_document")).alias("type_document"), text.collapse(field("emetteur")).alias("emetteur"), text.iso_date(field("date"), this_year).alias("date"), text.collapse(field("titre")).alias("title"), field("dossier").alias("folder"))
    placed = manifest.filed(good, folders).withColumn("name", text.safe_name(F.concat_ws(" ", F.col("date").cast("string"), "title")))
    return placed.unionByName(told.where("problem is not null").select("doc_key", "problem"), allowMissingColumns=True)
