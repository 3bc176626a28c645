"""Ingest: sources -> hash -> first-wins dedup -> outcomes against the manifest; attachments as documents of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.parsers import read_mail

#: What can be converted.
SUPPORTED = [".pdf", ".docx", ".eml", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp"]


def hashed(sources: DataFrame) -> DataFrame:
    """``sources`` (ord, path, name, content) with suffix, supported, sha256 and original. Content of unsupported files isn't hashed."""
    kind = text.suffix(F.col("name"))
    out = sources.withColumns({"suffix": kind, "supported": kind.isin(SUPPORTED)})
    out = out.withColumn("sha256", F.when(F.col("supported"), F.sha2("content", 256)))
    return out.withColumn("original", F.when(F.col("supported"), original_path(F.col("sha256"), F.col("suffix"))))


def original_path(sha256: Column, suffix: Column) -> Column:
    return F.concat(F.lit("originaux/"), F.left(sha256, F.lit(16)), suffix)


def attachments(mails: DataFrame) -> DataFrame:
    """Attached files of ``mails`` (ord, path, name, sha256, content) as sources: parent, ord, sub_ord, path, name, content."""
    read = mails.where(F.lower("name").endswith(".eml")).select("ord", "path", F.col("name").alias("mail"), F.col("sha256").alias("parent"), read_mail("content").alias("m"))
    each = read.select("ord", "path", "mail", "parent", F.posexplode("m.attachments").alias("sub_ord", "a"))
    kind = text.suffix(F.col("a.name"))
    stem = text.safe_name(F.expr("left(a.name, length(a.name) - length(regexp_extract(a.name, '[^/.][^/]*(\\\\.[^./]+)$', 1)))"))
    return each.select("parent", "ord", (F.col("sub_ord") + 1).alias("sub_ord"), "path", F.concat("mail", F.lit(" › "), stem, kind).alias("name"), F.col("a.data").alias("content"))


def with_attachments(sources: DataFrame) -> DataFrame:
    """Sources and the files attached to their e-mails, each mail before its own: hashed, with parent and sub_ord."""
    own = hashed(sources).withColumns({"sub_ord": F.lit(0), "parent": F.lit(None).cast("string")})
    inner = hashed(attachments(own.where("suffix = '.eml'")))
    return own.unionByName(inner, allowMissingColumns=True)


def first_of_each(hashed_sources: DataFrame) -> DataFrame:
    """With ``nth``, 1 for the first source of each content. Contents don't travel: the window sees keys only."""
    order = Window.partitionBy("sha256").orderBy("ord", "sub_ord")
    return hashed_sources.withColumn("nth", F.row_number().over(order))


def outcomes(hashed_sources: DataFrame, manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """The outcome of each source: unsupported, added, duplicate or restored.

    ``manifest``: sha256, status of known documents; ``stored``: original, the originals that are there.
    """
    known = manifest.select("sha256", F.col("status").alias("known_status"))
    there = stored.select("original", F.lit(True).alias("there"))
    good = first_of_each(hashed_sources.where("supported")).join(known, "sha256", "left").join(there, "original", "left")
    outcome = F.when(F.col("nth") > 1, "duplicate").when(F.col("known_status").isNull(), "added").when(F.col("there").isNull(), "restored").otherwise("duplicate")
    status = F.when(F.col("nth") > 1, None).when(F.col("known_status").isNull() | ((F.col("known_status") == "echec") & F.col("there").isNull()), "a_faire").otherwise(F.col("known_status"))
    keep = [c for c in hashed_sources.columns if c != "content"]
    done = good.select(*keep, outcome.alias("outcome"), status.alias("status"))
    refused = hashed_sources.where(~F.col("supported")).select(*keep, F.lit("unsupported").alias("outcome"), F.lit(None).cast("string").alias("status"))
    return done.unionByName(refused)


def tally(outcome_rows: DataFrame) -> DataFrame:
    return outcome_rows.groupBy("outcome").agg(F.count("*").alias("n"))
