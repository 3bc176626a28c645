"""Page rules: noise, low confidence, blank pages, OCR pages from pieces, review status, candidate pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup, text
from . import layout

#: Thresholds of scores, lengths and ink.
TEXT_SCORE, LOW_CONFIDENCE, NOISE_MAX_CHARS, MIN_TEXT_CHARS = 0.5, markup.LOW_CONFIDENCE, 3, 25
MIN_PAPER, INK_CONTRAST, BLANK_MAX_INK = 150, 40, 1e-4
LONG_LINE, DIFFICULT = 15, 0.10
EDIT_MARGIN_SECONDS = 3
BLANK_DOCUMENT = "document entièrement blanc"


def is_noise(score: Column, piece: Column) -> Column:
    return (score < TEXT_SCORE) & (F.length(piece) <= NOISE_MAX_CHARS)


def has_text_layer(page_text: Column) -> Column:
    return F.length(text.normalized(page_text)) >= MIN_TEXT_CHARS


def is_blank(paper: Column, ink_share: Column) -> Column:
    """A page image by its paper's median grey and its share of ink."""
    return (paper >= MIN_PAPER) & (ink_share <= BLANK_MAX_INK)


def was_edited(modified: Column, converted_at: Column) -> Column:
    return converted_at.isNull() | (modified > converted_at + F.expr(f"interval {EDIT_MARGIN_SECONDS} seconds"))


def ocr_pages(pieces: DataFrame, images: DataFrame) -> DataFrame:
    """Pages from OCR pieces: page_key, text, method, min_confidence, lines, noise.

    ``images``: page_key, paper, ink_share, one row a page; pages without any piece are in there too.
    """
    marked = layout.reading_order(pieces).withColumn("noise", is_noise(F.col("score"), F.col("text")))
    sums = marked.groupBy("page_key").agg(
        F.bool_and(F.col("score") < TEXT_SCORE).alias("unsure"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("noise"), F.struct("number", F.struct("text", "score").alias("n"))))), lambda x: x["n"]).alias("noise"),
        F.min(F.when(~F.col("noise"), F.col("score"))).alias("least"), F.count_if(~F.col("noise")).alias("kept"),
    )
    kept = pieces.where(~is_noise(F.col("score"), F.col("text")))
    numbered = layout.reading_order(kept)
    total = F.count("*").over(Window.partitionBy("page_key"))
    flagged = numbered.withColumn("total", total).withColumn("shown", markup.flagged_piece(F.col("text"), F.col("score"), F.col("number"), F.col("total"))).drop("row_id", "number", "total")
    texts = layout.page_text(flagged, F.col("shown"))
    joined = images.join(sums, "page_key", "left").join(texts, "page_key", "left")
    blank = F.coalesce("unsure", F.lit(True)) & is_blank(F.col("paper"), F.col("ink_share"))
    return joined.select(
        "page_key", F.when(blank, "").otherwise(F.coalesce("text", F.lit(""))).alias("text"), F.when(blank, "blank").otherwise("ocr").alias("method"),
        F.when(~blank, F.coalesce("least", F.lit(0.0))).alias("min_confidence"), F.when(~blank, F.coalesce("kept", F.lit(0))).alias("lines"),
        F.when(~blank, F.coalesce("noise", F.array().cast("array<struct<text:string,score:double>>"))).alias("noise"),
    )


def review_status(pages: DataFrame, key: str = "doc_key") -> DataFrame:
    """key, status, detail of each document from its pages (number, text, method, min_confidence)."""
    blank = F.col("method") == "blank"
    reason = F.when(blank, None).when(F.coalesce("text", F.lit("")) == "", F.format_string("page %d vide ou illisible", "number")).when(
        F.col("min_confidence") < LOW_CONFIDENCE, F.format_string("page %d : confiance OCR %.2f", "number", "min_confidence")
    )
    out = pages.withColumn("reason", reason).groupBy(key).agg(
        F.bool_and(blank).alias("all_blank"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("number", "reason")))), lambda x: x["reason"]), " ; ").alias("reasons"),
    )
    doubtful = F.col("all_blank") | (F.col("reasons") != "")
    return out.select(key, F.when(doubtful, "a_verifier").otherwise("fait").alias("status"), F.when(F.col("all_blank"), BLANK_DOCUMENT).when(F.col("reasons") != "", F.col("reasons")).alias("detail"))


def flagged_lines(notes: DataFrame) -> DataFrame:
    """Long doubtful lines of notes (doc_key, markdown): doc_key, page, text, confidence. Per page, old flags count only where there are no new ones."""
    pages = notes.select("doc_key", F.explode(markup.pages_of(F.col("markdown"))).alias("p")).select("doc_key", F.col("p.number").alias("page"), F.col("p.body").alias("body"))
    new = F.transform(F.regexp_extract_all("body", F.lit("(?s)" + markup.FLAG), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, "(?s)" + markup.FLAG, 1).alias("text"), F.regexp_extract(x, "(?s)" + markup.FLAG, 2).cast("double").alias("confidence")))
    old = F.transform(
        F.filter(F.split("body", rf"\n[{text.SPACES}]*\n"), lambda x: x.rlike(markup.OLD_FLAG)),
        lambda x: F.struct(F.replace(F.regexp_replace(x, text.COMMENT, ""), F.lit("=="), F.lit("")).alias("text"), F.regexp_extract(x, markup.OLD_FLAG, 1).cast("double").alias("confidence")),
    )
    lines = pages.select("doc_key", "page", F.explode(F.when(F.size(new) > 0, new).otherwise(old)).alias("f")).select("doc_key", "page", text.collapse(F.col("f.text")).alias("text"), F.col("f.confidence").alias("confidence"))
    return lines.where((F.length("text") > LONG_LINE) & (F.col("confidence") < LOW_CONFIDENCE))


def page_kind(method: Column, flagged: Column, lines: Column) -> Column:
    share = flagged / F.greatest(lines, F.lit(1))
    return F.when(method == "text", "texte").when(flagged == 0, "OCR net").when(share < DIFFICULT, "OCR moyen").otherwise("OCR difficile")


def candidate_pages(notes: DataFrame) -> DataFrame:
    """Pages of notes (doc_key, markdown) that can serve as references: doc_key, page, kind, text."""
    pages = notes.select("doc_key", F.explode(markup.pages_of(F.col("markdown"))).alias("p"))
    pages = pages.select("doc_key", F.col("p.number").alias("page"), F.col("p.method").alias("method"), F.col("p.lines").alias("lines"), F.col("p.body").alias("body"), text.without_marks(F.col("p.body")).alias("text"))
    flagged = F.size(F.split("body", r"<!-- illisible \?")) - 1
    lines = F.when(F.col("lines") > 0, F.col("lines")).otherwise(F.size(F.split("text", rf"\n[{text.SPACES}]*\n")))
    return pages.where((F.col("text") != "") & F.col("method").isin("text", "ocr")).select("doc_key", "page", page_kind(F.col("method"), flagged, lines).alias("kind"), "text")
