"""Sources: files in a folder tree, their contents, notes, catalogues, extraction to pages."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup, text
from ..functions.parsers import mail_text, read_docx, read_mail

FILES = "ord long, path string, name string"
CATALOGUE = "id string, sha256 string, original string, page int, kind string"


def walk(paths: Iterable[str]) -> list[str]:
    """Files of the given files and folders: arguments in order, folders by path parts, hidden parts below a folder skipped."""
    found: list[str] = []
    for given in map(Path, paths):
        if given.is_file():
            found.append(str(given))
        elif given.is_dir():
            inner = []
            for folder, names, files in os.walk(given):
                names[:] = [n for n in names if not n.startswith(".")]
                inner += [Path(folder, f) for f in files if not f.startswith(".")]
            found += map(str, sorted(inner))
        else:
            raise FileNotFoundError(f"Introuvable : {given}")
    return found


def listed(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """ord, path, name: the listing only. Filter it by suffix before reading contents."""
    rows = [(i, p, os.path.basename(p)) for i, p in enumerate(walk(paths))]
    return spark.createDataFrame(rows, FILES)


def with_content(listing: DataFrame, supported: list[str]) -> DataFrame:
    """``listing`` with content, length and modified, read for supported suffixes only.

    Paths are named one by one: a recursive read would leave out folders that start with an underscore.
    """
    spark = listing.sparkSession
    wanted = [r["path"] for r in listing.where(text.suffix(F.col("name")).isin(supported)).select("path").toLocalIterator()]
    if not wanted:
        return listing.withColumns({"content": F.lit(None).cast("binary"), "length": F.lit(None).cast("long"), "modified": F.lit(None).cast("timestamp")})
    read = spark.read.format("binaryFile").load([f"file://{p}" if p.startswith("/") else p for p in wanted])
    local = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), "^file:(//)?(?=/)", "")
    return listing.join(read.select(local.alias("path"), "content", "length", F.col("modificationTime").alias("modified")), "path", "left")


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown notes below ``folder``: path (relative), markdown (null where it isn't UTF-8), readable, modified, original."""
    paths = [p for p in walk([folder]) if p.endswith(".md")]
    read = with_content(listed(spark, [folder]).where(F.col("name").endswith(".md")), [".md"]) if paths else listed(spark, []).withColumns({"content": F.lit(None).cast("binary"), "modified": F.lit(None).cast("timestamp")})
    decoded = text.unix_lines(F.try_validate_utf8(F.col("content").cast("string")))
    relative = F.expr(f"substring(path, {len(str(Path(folder))) + 2})")
    return read.select(relative.alias("path"), decoded.alias("markdown"), decoded.isNotNull().alias("readable"), "modified").withColumn("original", markup.original_of(F.col("markdown")))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOGUE).option("multiLine", True).json(path)


#: Readers by suffix: content -> Column of struct<pages, error>. PDF and OCR readers are registered by whoever has them.
Reader = Callable[[Column], Column]
_PAGES = f"array<{markup.PAGE_TYPE}>"


def _one_page(method: str, page_text: Column) -> Column:
    null = F.lit(None)
    return F.array(F.struct(F.lit(1).alias("number"), page_text.alias("text"), F.lit(method).alias("method"), null.cast("double").alias("min_confidence"), null.cast("int").alias("lines"), null.cast("array<struct<text:string,score:double>>").alias("noise"))).cast(_PAGES)


def _mail_pages(content: Column) -> Column:
    read = read_mail(content)
    return F.struct(_one_page("eml", mail_text(read)).alias("pages"), read["error"].alias("error"))


def _docx_pages(content: Column) -> Column:
    read = read_docx(content)
    return F.struct(_one_page("docx", read["text"]).alias("pages"), read["error"].alias("error"))


READERS: dict[str, Reader] = {".eml": _mail_pages, ".docx": _docx_pages}


def extracted(sources: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """``sources`` (suffix, content, …) with pages and error. Each reader runs over its own suffix only; a missing one is an error in the data."""
    readers = READERS | (readers or {})
    out = None
    for kind, reader in readers.items():
        part = sources.where(F.col("suffix") == kind).withColumn("read", reader(F.col("content")))
        part = part.select(*sources.columns, F.col("read.pages").alias("pages"), F.col("read.error").alias("error"))
        out = part if out is None else out.unionByName(part)
    rest = sources.where(~F.col("suffix").isin(list(readers)) | F.col("suffix").isNull())
    missing = rest.withColumns({"pages": F.lit(None).cast(_PAGES), "error": F.concat(F.lit("LookupError : no reader for "), F.coalesce("suffix", F.lit("?")))})
    return out.unionByName(missing)
