"""Line dedup by a log-template tree.

The tree has a fixed depth: the number of tokens, then the first LEADING tokens; a leaf is a
path. Tokens with a digit are variable from the start (``<*>``). Within a leaf, a token is
constant at its position if at least ``min_texts`` texts have it there, and variable
otherwise; a line's template is its leaf with its constant tokens. A template recurs if at
least ``min_texts`` different texts have a line of it and at least SIMILAR of its tokens are
constant. Lines of recurring templates are dropped, in every document.

Copies are for document dedup to judge, so they count little as texts that have a line: exact
copies count as one text, and texts of which such lines make more than half of the tokens
(near copies of one another, or boilerplate with few words of their own) count once for each
first template that they begin with. A line that recurs by the other texts goes from all.

Counts are aggregations of hashes with partial sums; a line's text never meets its leaf's
other lines in one task. Hashes have 64 bits; lines are compared by them.

Rows: a null text stays null. Lines of fewer than MIN_TOKENS tokens, blank ones too, stay:
so little may be prose that recurs by chance. Repeated rows get equal results. All documents
are kept, if need be with an empty text. A long text is many lines, each handled on its own.
An empty table gives an empty result; other columns, whatever their names, aren't looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, documents_only, passing, row_key, written
from .outliers import let

SPACE = r" \t\x0B\f\r"
LEADING, MIN_TOKENS, SIMILAR, MIN_TEXTS = 3, 3, 0.6, 10
#: A text counts as a copy if COPY_PARTS times the tokens of its lines of common templates exceed COPY_OF times all its tokens.
COPY_PARTS, COPY_OF = 2, 1
IDENTITY = ["missing", "id", "key"]


def _lines(text: Column) -> Column:
    """The lines of a text, tokens with a digit masked."""
    masked = lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(x, f"[^{SPACE}]*[0-9][^{SPACE}]*", "<*>")).otherwise(x)
    return F.transform(F.split(text, "\n"), masked)


def _tokens(line: Column) -> Column:
    return F.split(F.btrim(line, F.lit(" \t\x0b\f\r")), f"[{SPACE}]+")


def _leaf(tokens: Column) -> Column:
    """The path of a line in the tree; null for short lines."""
    return F.when(F.size(tokens) >= MIN_TOKENS, F.xxhash64(F.size(tokens), F.slice(tokens, 1, LEADING)))


def identified(docs: DataFrame) -> DataFrame:
    return documents_only(docs).withColumns({"missing": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0)), "key": F.coalesce(row_key(F.col("text")), F.lit(0))})


def recurring_lines(docs: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    """Lines of recurring templates: text key, line (number from 0), template."""
    leaves = docs.select(F.explode(F.array_distinct(F.transform(_lines(F.col("text")), lambda x: let(_tokens(x), _leaf)))).alias("leaf")).where("leaf is not null")
    common = written(leaves.groupBy("leaf").count().where(F.col("count") >= min_texts).select("leaf"), "leaves")
    of_line = lambda t: F.struct(_leaf(t).alias("leaf"), t.alias("tokens"))
    words = lambda x: F.when(F.get(x["tokens"], F.lit(0)) == "", 0).otherwise(F.size(x["tokens"]))
    told = lambda xs: F.struct(xs.alias("xs"), F.aggregate(xs, F.lit(0), lambda t, x: t + words(x)).alias("total"))
    lines = docs.select("key", let(F.transform(_lines(F.col("text")), lambda x: let(_tokens(x), of_line)), told).alias("v")).select("key", "v.total", F.posexplode("v.xs").alias("line", "x"))
    lines = lines.select("key", "total", "line", "x.leaf", "x.tokens").where("leaf is not null")
    # One row a text and line: copies of a text have one key.
    held = lines.join(common, "leaf", "left_semi").select("key", "total", "line", "leaf", F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens")).withColumn("form", F.xxhash64("leaf", "tokens"))
    held = written(held.dropDuplicates(["key", "line"]), "lines")
    # Different lines (forms) with the texts that have them, then tokens by position.
    forms = written(held.select("key", "form", "leaf", "tokens").dropDuplicates(["key", "form"]).groupBy("form").agg(F.count("*").alias("texts"), F.min("leaf").alias("leaf"), F.min("tokens").alias("tokens")), "forms")
    spots = forms.select("form", "leaf", "texts", F.posexplode("tokens").alias("at", "token"))
    constant = spots.groupBy("leaf", "at", "token").agg(F.sum("texts").alias("n")).where(F.col("n") >= min_texts).select("leaf", "at", "token")
    kept = spots.join(written(constant, "constants"), ["leaf", "at", "token"]).groupBy("form").agg(F.sort_array(F.collect_list(F.struct("at", "token"))).alias("kept"))
    named = forms.join(kept, "form").where(F.size("kept") >= SIMILAR * F.size("tokens")).select("form", F.xxhash64("leaf", "kept").alias("template"))
    placed = written(held.select("key", "total", "line", "form", F.size("tokens").alias("n")).join(written(named, "templates"), "form").drop("form"), "placed")
    least = lambda t: written(t.groupBy("template").count().where(F.col("count") >= min_texts).select("template"), "recurring")
    found = written(placed.join(least(placed.select("key", "template").distinct()), "template", "left_semi"), "found")
    texts = found.groupBy("key").agg((COPY_PARTS * F.sum("n") > COPY_OF * F.min("total")).alias("copy"), F.min_by("template", "line").alias("first"))
    who = F.when(F.col("copy"), F.col("first")).otherwise(F.col("key")).alias("who")
    told = found.select("key", "template").distinct().join(texts, "key").select("template", "copy", who).distinct()
    return found.join(least(told), "template", "left_semi").select("key", "line", "template")


def drop_recurring(docs: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    """The documents columns of ``docs``, recurring lines dropped from the text, with n_lines and n_dropped."""
    docs = identified(docs)
    with passing() as keep:
        by_text = recurring_lines(docs, min_texts).groupBy("key").agg(F.sort_array(F.collect_set("line")).alias("drop"))
        drops = keep(written(by_text, "drops"))
    # Read back and merged, both sides of the join are plain, so a text that very many documents share can be split over tasks.
    joined = docs.join(drops.hint("merge"), "key", "left")
    lines = F.split("text", "\n")
    # Runs of kept lines between dropped ones.
    edges = F.concat(F.array(F.lit(-1)), F.col("drop"))
    runs = let(lines, lambda ls: F.flatten(F.transform(edges, lambda d, k: F.slice(ls, d + 2, F.greatest(F.coalesce(F.get(F.col("drop"), k), F.size(ls)) - d - 1, F.lit(0))))))
    text = F.when(F.size("drop") > 0, F.array_join(runs, "\n")).otherwise(F.col("text"))
    out = joined.select("doc_id", text.alias("text"), "lang", "source", F.col("n_chars"), F.size(lines).cast("long").alias("n_lines"), F.greatest(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))
    return out.withColumn("n_chars", F.length("text").cast("long")).withColumn("n_lines", F.greatest("n_lines", F.lit(0)))


def deduplicated(docs: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    """The documents of ``docs`` with recurring lines dropped."""
    return drop_recurring(docs, min_texts).select(*DOCUMENT_COLUMNS)
