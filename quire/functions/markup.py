"""The page format: writing pages as Markdown with markers, and reading them back.

A page is a header comment, its text or a stand-in, and perhaps a comment with fragments set
apart. Writing and reading are Column expressions over arrays of structs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import COMMENT, SPACES, quoted, strip

#: The format's words and patterns.
UNPAGED = ["docx", "eml"]
BLANK_PAGE, EMPTY_PAGE, EMPTY_DOCUMENT = "<!-- page blanche -->", "<!-- page vide ou illisible -->", "<!-- document vide -->"
MARKER = r"<!-- page (\d+) · (\w+)(?: · (\d+) lignes)?(?: · (\d+) fragments)?(?: · confiance min ([\d.]+))? -->"
FLAG = r"==(.*?)==<!-- illisible \? confiance ([\d.]+) · ligne (\d+)/(\d+) -->"
OLD_FLAG = r"<!-- illisible \? confiance ([\d.]+) -->"
LOW_CONFIDENCE = 0.80
#: How pages are held: array<struct>.
PAGE_TYPE = "struct<number:int,text:string,method:string,min_confidence:double,lines:int,noise:array<struct<text:string,score:double>>>"


def two_digits(c: Column) -> Column:
    return F.format_string("%.2f", c)


def flagged_piece(text: Column, score: Column, line: Column, total: Column) -> Column:
    """A piece of text, highlighted with its confidence and place where the confidence is low."""
    flag = F.format_string("==%s==<!-- illisible ? confiance %.2f · ligne %d/%d -->", text, score, line, total)
    return F.when(F.coalesce(score, F.lit(1.0)) >= LOW_CONFIDENCE, text).otherwise(flag)


def _page_blocks(p: Column) -> Column:
    noise = F.coalesce(p["noise"], F.array())
    header = F.concat(
        F.format_string("<!-- page %d · %s", p["number"], p["method"]),
        F.when(p["lines"].isNotNull(), F.format_string(" · %d lignes", p["lines"])).otherwise(""),
        F.when(F.size(noise) > 0, F.format_string(" · %d fragments", F.size(noise))).otherwise(""),
        F.when(p["min_confidence"].isNotNull(), F.concat(F.lit(" · confiance min "), two_digits(p["min_confidence"]))).otherwise(""),
        F.lit(" -->"),
    )
    text = F.coalesce(F.nullif(p["text"], F.lit("")), F.when(p["method"] == "blank", BLANK_PAGE).otherwise(EMPTY_PAGE))
    fragments = F.array_join(F.transform(noise, lambda n: F.concat(F.lit("« "), F.replace(n["text"], F.lit("--"), F.lit("- -")), F.lit(" » "), two_digits(n["score"]))), " · ")
    unpaged = F.array(F.concat(F.lit("<!-- "), p["method"], F.lit(" -->")), F.coalesce(F.nullif(p["text"], F.lit("")), F.lit(EMPTY_DOCUMENT)))
    paged = F.concat(F.array(header, text), F.when(F.size(noise) > 0, F.array(F.concat(F.lit("<!-- bruit probable, hors du texte : "), fragments, F.lit(" -->")))).otherwise(F.array()))
    return F.when(p["method"].isin(UNPAGED), unpaged).otherwise(paged)


def to_markdown(pages: Column) -> Column:
    """array<page> -> Markdown."""
    return F.concat(F.array_join(F.flatten(F.transform(pages, _page_blocks)), "\n\n"), F.lit("\n"))


def front_matter(original: Column, source_name: Column, parent_original: Column, imported_at: Column) -> Column:
    link = lambda c: F.concat(F.lit('"[['), quoted(c), F.lit(']]"'))
    lines = F.array(
        F.lit("---"), F.concat(F.lit("original: "), link(original)), F.concat(F.lit('nom_origine: "'), quoted(source_name), F.lit('"')),
        F.when(parent_original.isNotNull(), F.concat(F.lit("piece_jointe_de: "), link(parent_original))),
        F.concat(F.lit("importe_le: "), F.left(imported_at, F.lit(10))), F.lit("---"),
    )
    return F.concat(F.array_join(lines, "\n"), F.lit("\n\n"))


def original_of(markdown: Column) -> Column:
    """The original that a note's front matter names, or null. Only the note's first 4096 characters are looked at."""
    head = F.left(markdown, F.lit(4096))
    matter = F.regexp_extract(head, r"(?sd)\A---\n(.*?)\n---", 1)
    value = F.regexp_extract(matter, r"(?md)^original:(.*)$", 1)
    bare = F.regexp_replace(F.regexp_replace(strip(value), "^[\"']+|[\"']+$", ""), r"^\[\[|\]\]$", "")
    path = strip(F.regexp_replace(bare, r"\|.*$", ""))
    return F.when(path.startswith("originaux/"), path)


def unpaged_kind(markdown: Column) -> Column:
    """The marker of a document without pages, or null."""
    return F.nullif(F.regexp_extract(markdown, rf"(?md)^<!-- ({'|'.join(UNPAGED)}) -->$", 1), F.lit(""))


def _parsed(part: Column) -> Column:
    """One page's body with its header in front -> struct."""
    head = lambda i: F.regexp_extract(part, r"(?sd)\A" + MARKER, i)
    body = F.regexp_replace(part, r"(?d)\A<!-- page [^\n]*", "")
    number = lambda c: F.nullif(c, F.lit("")).cast("int")
    method, lines = head(2), number(head(3))
    has_letter = lambda t: t.rlike(r"[\p{L}]")
    flag = lambda text, score, position: F.struct(F.length(text).cast("int").alias("chars"), score.cast("double").alias("confidence"), position.cast("double").alias("position"), has_letter(text).alias("letters"))
    found = F.regexp_extract_all(body, F.lit("(?s)" + FLAG), F.lit(0))
    new = F.transform(found, lambda f: flag(strip(F.regexp_extract(f, "(?s)" + FLAG, 1)), F.regexp_extract(f, "(?s)" + FLAG, 2), (F.regexp_extract(f, "(?s)" + FLAG, 3).cast("int") - 1) / F.greatest(F.regexp_extract(f, "(?s)" + FLAG, 4).cast("int") - 1, F.lit(1))))
    bare = lambda x: F.regexp_replace(x, COMMENT, "")
    paragraphs = F.filter(F.split(body, rf"\n[{SPACES}]*\n"), lambda x: strip(bare(x)) != "")
    old = F.filter(F.transform(paragraphs, lambda x, i: F.when(x.rlike(OLD_FLAG), flag(strip(bare(x)), F.regexp_extract(x, OLD_FLAG, 1), i / F.greatest(F.size(paragraphs) - 1, F.lit(1))))), lambda x: x.isNotNull())
    none = F.array().cast("array<struct<chars:int,confidence:double,position:double,letters:boolean>>")
    return F.struct(
        number(head(1)).alias("number"), method.alias("method"),
        F.length(strip(F.replace(bare(body), F.lit("=="), F.lit("")))).cast("int").alias("chars"),
        F.nullif(head(5), F.lit("")).cast("double").alias("confidence"),
        F.when(method != "ocr", 0).otherwise(F.coalesce(lines, F.size(paragraphs))).cast("int").alias("lines"),
        F.coalesce(number(head(4)), F.lit(0)).alias("noise"),
        F.when(method != "ocr", none).when(lines.isNotNull(), new).otherwise(old).alias("flagged"),
        body.alias("body"),
    )


def pages_of(markdown: Column) -> Column:
    """Markdown -> array of its pages: number, method, chars, confidence, lines, noise, flagged, body."""
    start = r"(?md)^(?=<!-- page \d+ · \w+(?: · \d+ lignes)?(?: · \d+ fragments)?(?: · confiance min [\d.]+)? -->$)"
    parts = F.filter(F.split(markdown, start), lambda x: x.rlike(r"(?d)\A" + MARKER + r"(?:\n|\z)"))
    return F.transform(parts, _parsed)
