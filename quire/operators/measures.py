"""Corpus statistics that can be shared: counts and bounded labels, never a name or a text.

Documents -> pages -> flags are exploded once each; every statistic is an aggregation with
partial sums, in long form (metric, label, n) where the shape allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup

#: Upper bounds (exclusive; the last is open) and labels of the histograms.
TEXT_RANGES = [(200, "< 200"), (1000, "200–999"), (None, "≥ 1000")]
CONFIDENCE_RANGES = [(0.80, "< 0,80"), (0.90, "0,80–0,90"), (0.95, "0,90–0,95"), (None, "≥ 0,95")]
LENGTH_RANGES = [(4, "1–3"), (16, "4–15"), (None, "> 15")]
FLAGGED_CONFIDENCE_RANGES = [(0.50, "< 0,50"), (0.70, "0,50–0,70"), (None, "0,70–0,80")]
SHARE_RANGES = [(0.05, "< 5 %"), (0.20, "5–20 %"), (None, "> 20 %")]
EDGE, SHORT_TEXT = 0.15, 200


def bucket(value: Column, ranges: list[tuple[float | None, str]]) -> Column:
    """The label of the first bound that the value is below."""
    out = None
    for bound, label in ranges[:-1]:
        out = F.when(value < bound, label) if out is None else out.when(value < bound, label)
    last = F.when(value.isNotNull(), ranges[-1][1])
    return last if out is None else out.otherwise(last)


def histogram(rows: DataFrame, value: Column, ranges: list[tuple[float | None, str]], metric: str) -> DataFrame:
    """metric, label, n for each label, zero where there is none."""
    spark = rows.sparkSession
    labels = spark.createDataFrame([(i, label) for i, (_, label) in enumerate(ranges)], "place int, label string")
    found = rows.groupBy(bucket(value, ranges).alias("label")).agg(F.count("*").alias("n"))
    return labels.join(found, "label", "left").select(F.lit(metric).alias("metric"), "label", F.coalesce("n", F.lit(0)).alias("n"))


def place(position: Column) -> Column:
    return F.when(position <= EDGE, "haut").when(position >= 1 - EDGE, "bas").otherwise("milieu")


# --- from the manifest -------------------------------------------------------------------

def format_of(original: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(original, r"\.([^./]+)$", 1), F.lit("")), F.lit("?"))


def format_status(documents: DataFrame, statuses: list[str]) -> DataFrame:
    """kind, a column for each status, total."""
    counts = documents.withColumn("kind", format_of(F.col("original"))).groupBy("kind").pivot("status", statuses).agg(F.count(F.lit(1))).fillna(0)
    return counts.withColumn("total", sum((F.col(s) for s in statuses), F.lit(0)))


def format_bytes(documents: DataFrame, sizes: DataFrame) -> DataFrame:
    """kind, bytes, n, missing with a total row (kind null). ``sizes``: original, length of the originals that are there."""
    joined = documents.join(sizes, "original", "left").withColumn("kind", format_of(F.col("original")))
    return joined.rollup("kind").agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"), F.count("*").alias("n"), F.count_if(F.col("length").isNull()).alias("missing"))


def attachment_count(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count("parent").alias("attachments"))


def placement(located: DataFrame, inbox: str) -> DataFrame:
    """label, n of converted documents (path, readable). An unreadable note counts where it lies and as unreadable."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    where = located.select(F.when(F.col("path").isNull(), "introuvable").when(folder == inbox, "à ranger").otherwise("rangés").alias("label"))
    bad = located.where("path is not null and not readable").select(F.lit("illisible").alias("label"))
    return where.unionByName(bad).groupBy("label").agg(F.count("*").alias("n"))


# --- from the notes ----------------------------------------------------------------------

def parsed(notes: DataFrame) -> DataFrame:
    """``notes`` (doc_key, markdown) with their pages and the marker of those that have none."""
    return notes.select("doc_key", markup.pages_of(F.col("markdown")).alias("pages"), markup.unpaged_kind(F.col("markdown")).alias("unpaged"))


def pages(parsed_notes: DataFrame) -> DataFrame:
    """One row a page: doc_key and the page's fields."""
    return parsed_notes.select("doc_key", F.explode("pages").alias("p")).select("doc_key", "p.*")


def kind(methods: Column, unpaged: Column) -> Column:
    """A document's kind from the distinct methods of its pages (null: no pages)."""
    real = F.array_except(methods, F.array(F.lit("blank")))
    of_pages = F.when(F.size(real) == 0, "blanc").when(F.size(real) > 1, "mixte").when(F.array_contains(real, "text"), "texte").otherwise("OCR")
    return F.when(F.coalesce(F.size(methods), F.lit(0)) <= 0, F.coalesce(unpaged, F.lit("sans repère"))).otherwise(of_pages)


def kinds(parsed_notes: DataFrame) -> DataFrame:
    methods = F.array_distinct(F.transform("pages", lambda p: p["method"]))
    return parsed_notes.groupBy(kind(methods, F.col("unpaged")).alias("label")).agg(F.count("*").alias("n"))


def pages_per_document(page_rows: DataFrame) -> DataFrame:
    return page_rows.groupBy("doc_key").agg(F.count("*").alias("n")).agg(F.median("n").alias("median"), F.max("n").alias("max"))


def page_label(method: Column, chars: Column) -> Column:
    return F.when(method == "blank", "blanches").when(chars == 0, "vides").otherwise(method)


def page_counts(page_rows: DataFrame) -> DataFrame:
    return page_rows.groupBy(page_label(F.col("method"), F.col("chars")).alias("label")).agg(F.count("*").alias("n"))


def filled(page_rows: DataFrame) -> DataFrame:
    """Pages that are neither blank nor empty."""
    return page_rows.where((F.col("method") != "blank") & (F.col("chars") > 0))


def text_ranges(page_rows: DataFrame) -> DataFrame:
    return histogram(filled(page_rows).where("method = 'text'"), F.col("chars"), TEXT_RANGES, "text_ranges")


def confidence_ranges(page_rows: DataFrame) -> DataFrame:
    return histogram(filled(page_rows).where("method <> 'text' and confidence is not null"), F.col("confidence"), CONFIDENCE_RANGES, "confidence_ranges")


def per_document(page_rows: DataFrame) -> DataFrame:
    """doc_key, short, flagged, lines, noise, n_pages: what totals and offenders are made of."""
    full = (F.col("method") != "blank") & (F.col("chars") > 0)
    return page_rows.groupBy("doc_key").agg(
        F.count_if(full & (F.col("method") == "text") & (F.col("chars") < SHORT_TEXT)).alias("short"),
        F.coalesce(F.sum(F.when(full, F.size("flagged"))), F.lit(0)).alias("flagged"), F.coalesce(F.sum(F.when(full, F.col("lines"))), F.lit(0)).alias("lines"),
        F.sum("noise").alias("noise"), F.count("*").alias("n_pages"),
    )


def totals(documents: DataFrame) -> DataFrame:
    """One row of sums over ``per_document`` rows."""
    return documents.agg(
        F.coalesce(F.sum("lines"), F.lit(0)).alias("ocr_lines"), F.coalesce(F.sum("noise"), F.lit(0)).alias("noise_fragments"), F.coalesce(F.sum("flagged"), F.lit(0)).alias("illegible_lines"),
        F.count_if(F.col("flagged") > 0).alias("illegible_documents"), F.count_if(F.col("short") > 0).alias("short_text_documents"),
    )


def flags(page_rows: DataFrame) -> DataFrame:
    return filled(page_rows).select("doc_key", F.explode("flagged").alias("f")).select("doc_key", "f.*")


def flag_histograms(flag_rows: DataFrame) -> DataFrame:
    """metric, label, n: lengths, confidences and places of flagged lines, and those without letters."""
    places = flag_rows.groupBy(place(F.col("position")).alias("label")).agg(F.count("*").alias("n")).select(F.lit("places").alias("metric"), "label", "n")
    letters = flag_rows.agg(F.count_if(~F.col("letters")).alias("n")).select(F.lit("without_letters").alias("metric"), F.lit("").alias("label"), "n")
    return histogram(flag_rows, F.col("chars"), LENGTH_RANGES, "lengths").unionByName(histogram(flag_rows, F.col("confidence"), FLAGGED_CONFIDENCE_RANGES, "confidence")).unionByName(places).unionByName(letters)


def share_ranges(documents: DataFrame) -> DataFrame:
    """Flagged lines' share, by document that has any; a document without a line count falls in no range."""
    return histogram(documents.where("flagged > 0"), F.try_divide("flagged", "lines"), SHARE_RANGES, "shares")


def top_offenders(documents: DataFrame, k: int = 3) -> DataFrame:
    """The k documents with most flagged lines: flagged, lines, rank. No identity comes out."""
    top = documents.where("flagged > 0").select("flagged", "lines").orderBy(F.desc("flagged"), F.desc("lines")).limit(k)
    return top


def concentration(documents: DataFrame, k: int = 3) -> DataFrame:
    """Share of all flagged lines that the k worst documents hold."""
    top = top_offenders(documents, k).select(F.col("flagged").alias("top"), F.lit(0).alias("all"))
    rows = top.unionByName(documents.select(F.lit(0).alias("top"), F.col("flagged").alias("all")))
    return rows.agg(F.try_divide(F.sum("top"), F.sum("all")).alias("share"))


def measure(notes: DataFrame) -> DataFrame:
    """All page statistics of ``notes`` (doc_key, markdown) in long form: metric, label, n."""
    told = parsed(notes)
    rows = pages(told)
    documents = per_document(rows)
    named = lambda df, metric: df.select(F.lit(metric).alias("metric"), "label", "n")
    sums = totals(documents)
    long = sums.select(F.explode(F.array(*[F.struct(F.lit("totals").alias("metric"), F.lit(c).alias("label"), F.col(c).cast("long").alias("n")) for c in sums.columns])).alias("x")).select("x.*")
    out = named(kinds(told), "kinds").unionByName(named(page_counts(rows), "pages")).unionByName(text_ranges(rows)).unionByName(confidence_ranges(rows))
    return out.unionByName(flag_histograms(flags(rows))).unionByName(share_ranges(documents)).unionByName(long)
