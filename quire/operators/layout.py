"""Page layout: positioned pieces -> rows -> reading order -> paragraphs, with window functions only.

Everything is partitioned by page, so one shuffle serves all steps. Pieces carry ``ord``, the
order in which they came, as the last sort key: sorts are stable.

Input: page_key, ord, text, left, top, right, bottom, score (null for a text layer).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACES

#: Shares of heights and widths, and the patterns of rows that start on their own.
ROW_OVERLAP, LINE_GAP, SIZE_RATIO, SIDE_START, COLUMN_GAP = 0.5, 0.9, 1.5, 0.25, 2
LIST_ITEM = rf"^(?:[-–—•·*▪◦►]|\d{{1,2}}[.)°]|[a-zA-Z][.)])[{SPACES}]"
FIELD = r"^[\p{L}\p{Nl}\p{No}][^:.]{0,30}:"
SENTENCE_END = r"(?d)[.!?…]$"


def _middle(top: Column, bottom: Column) -> Column:
    return (top + bottom) / 2


def row_numbers(boxes: DataFrame, key: str = "page_key") -> DataFrame:
    """``boxes`` with row_id: a box joins the row of the box before it, by height of middle, if they overlap by half the lower one's height."""
    order = Window.partitionBy(key).orderBy(_middle(F.col("top"), F.col("bottom")), "ord")
    before = lambda c: F.lag(c).over(order)
    overlap = F.least(before("bottom"), F.col("bottom")) - F.greatest(before("top"), F.col("top"))
    lower = F.least(before("bottom") - before("top"), F.col("bottom") - F.col("top"))
    starts = boxes.withColumn("starts", F.when(before("top").isNotNull() & (overlap >= ROW_OVERLAP * lower), 0).otherwise(1))
    return starts.withColumn("row_id", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("starts")


def _in_row(key: str = "page_key") -> list:
    return ["row_id", "left", _middle(F.col("top"), F.col("bottom")), "ord"]


def reading_order(boxes: DataFrame, key: str = "page_key") -> DataFrame:
    """``boxes`` with row_id and number, from 1: rows from top to bottom, each from left to right."""
    rows = row_numbers(boxes, key)
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy(*_in_row())).cast("long"))


def ordered_text(value: Column, order: Column, between: str) -> Column:
    """Aggregate: values joined in order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]), between)


def rows(pieces: DataFrame, rendered: Column | None = None) -> DataFrame:
    """One row per text row: page_key, row_id, text, rendered, left, top, right, bottom, height (median), char_width, columns, pieces."""
    numbered = reading_order(pieces)
    within = Window.partitionBy("page_key", "row_id").orderBy("left", _middle(F.col("top"), F.col("bottom")), "ord")
    numbered = numbered.withColumns({"rendered": rendered if rendered is not None else F.col("text"), "gap": F.lead("left").over(within) - F.col("right")})
    out = numbered.groupBy("page_key", "row_id").agg(
        ordered_text(F.col("text"), F.col("number"), " ").alias("text"), ordered_text(F.col("rendered"), F.col("number"), " ").alias("rendered"),
        F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"),
        F.median(F.col("bottom") - F.col("top")).alias("height"), (F.sum(F.col("right") - F.col("left")) / F.greatest(F.sum(F.length("text")), F.lit(1))).alias("char_width"),
        F.max("gap").alias("widest_gap"), F.count("*").alias("pieces"),
    )
    return out.withColumn("columns", F.coalesce(F.col("widest_gap") > COLUMN_GAP * F.col("char_width"), F.lit(False))).drop("widest_gap")


def paragraph_rows(text_rows: DataFrame) -> DataFrame:
    """``text_rows`` with block_id, and glue: what comes before the row within its block."""
    page = Window.partitionBy("page_key")
    order = page.orderBy("row_id")
    edged = text_rows.withColumns({"line_height": F.median("height").over(page), "right_edge": F.max("right").over(page), "left_edge": F.min("left").over(page)})
    side = F.col("left_edge") + SIDE_START * (F.col("right_edge") - F.col("left_edge"))
    above = {c: F.lag(c).over(order) for c in ("text", "left", "right", "bottom", "height", "char_width", "columns")}
    edged = edged.withColumns({f"above_{c}": v for c, v in above.items()})
    a = lambda c: F.col(f"above_{c}")
    ratio = F.try_divide(F.col("height"), a("height"))
    room = F.col("right_edge") - a("right")
    first_word = F.regexp_extract("text", rf"[^{SPACES}]+", 0)
    breaks = [
        a("text").isNull(), a("left") > side, F.col("left") > side, F.col("top") - a("bottom") > LINE_GAP * F.col("line_height"),
        ~F.coalesce(ratio.between(1 / SIZE_RATIO, SIZE_RATIO), F.lit(False)), a("columns") | F.col("columns"),
        F.col("text").rlike(LIST_ITEM), F.col("text").rlike(FIELD), a("text").endswith(":"),
        a("text").rlike(SENTENCE_END) & F.col("text").rlike(r"^\p{Lu}") & (room >= a("char_width")),
        room >= (F.length(first_word) + 1) * a("char_width"),
    ]
    new = breaks[0]
    for b in breaks[1:]:
        new = new | b
    hyphen = a("text").endswith("-") & F.col("text").rlike(r"^\p{Ll}")
    marked = edged.withColumns({"new": F.coalesce(new, F.lit(True)).cast("int"), "hyphen": F.coalesce(hyphen, F.lit(False))})
    marked = marked.withColumn("block_id", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    glue = F.when(F.col("new") == 1, "").when(F.col("hyphen"), "").otherwise(" ")
    return marked.withColumn("glue", glue).drop("new", "hyphen", "line_height", "right_edge", "left_edge", *[f"above_{c}" for c in above])


def blocks(pieces: DataFrame, rendered: Column | None = None) -> DataFrame:
    """One row per paragraph: page_key, block_id, rows, text."""
    numbered = paragraph_rows(rows(pieces, rendered))
    return numbered.groupBy("page_key", "block_id").agg(F.count("*").alias("rows"), ordered_text(F.concat("glue", "rendered"), F.col("row_id"), "").alias("text"))


def page_text(pieces: DataFrame, rendered: Column | None = None) -> DataFrame:
    """page_key, text: paragraphs with blank lines between."""
    return blocks(pieces, rendered).groupBy("page_key").agg(ordered_text(F.col("text"), F.col("block_id"), "\n\n").alias("text"))


def in_blocks(pieces: DataFrame, boxes: DataFrame) -> DataFrame:
    """``pieces`` with the innermost box that holds their middle (idx, kind), null for loose ones.

    ``boxes``: page_key, idx, x0, y0, x1, y1, kind. The page is an equality, so the range test is a
    hash join's residual; the smallest area wins, then the smallest index.
    """
    x, y = (F.col("p.left") + F.col("p.right")) / 2, (F.col("p.top") + F.col("p.bottom")) / 2
    inside = (F.col("p.page_key") == F.col("b.page_key")) & x.between(F.col("b.x0"), F.col("b.x1")) & y.between(F.col("b.y0"), F.col("b.y1"))
    area = (F.col("b.x1") - F.col("b.x0")) * (F.col("b.y1") - F.col("b.y0"))
    met = pieces.alias("p").join(boxes.alias("b"), inside, "left").select("p.*", F.col("b.idx").alias("idx"), F.col("b.kind").alias("kind"), area.alias("area"))
    first = Window.partitionBy("page_key", "ord").orderBy(F.col("area").asc_nulls_last(), "idx")
    return met.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth", "area")


def block_runs(items: DataFrame) -> DataFrame:
    """``items`` in reading order with run_id: loose items (kind null) that follow each other form one run, any other item is a run of its own."""
    numbered = reading_order(items)
    order = Window.partitionBy("page_key").orderBy("number")
    loose = F.col("kind").isNull()
    starts = (~(loose & F.coalesce(F.lag(loose).over(order), F.lit(False)))).cast("int")
    return numbered.withColumn("starts", starts).withColumn("run_id", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("starts")


TITLES = ["paragraph_title", "doc_title", "title"]


def page_from_blocks(pieces: DataFrame, boxes: DataFrame) -> DataFrame:
    """page_key, text of pages whose blocks a layout model has found: blocks and runs of loose pieces in reading order, titles marked.

    Blocks come in the order of their first piece, loose pieces after them; that settles ties of the reading order.
    """
    item = F.when(F.col("idx").isNull(), F.concat(F.lit("p"), F.col("ord").cast("string"))).otherwise(F.concat(F.lit("b"), F.col("idx").cast("string")))
    placed = in_blocks(pieces, boxes).withColumn("item", item)
    first = placed.where("idx is not null").groupBy("page_key", "idx", "item").agg(F.min("ord").alias("ord"))
    held = first.join(boxes, ["page_key", "idx"]).select("page_key", "item", "ord", F.col("x0").alias("left"), F.col("y0").alias("top"), F.col("x1").alias("right"), F.col("y1").alias("bottom"), "kind")
    loose = placed.where("idx is null").select("page_key", "item", (F.col("ord") + (1 << 40)).alias("ord"), "left", "top", "right", "bottom", F.lit(None).cast("string").alias("kind"))
    runs = block_runs(held.unionByName(loose)).select("page_key", "item", "run_id", "kind")
    run_key = F.concat_ws("\u0000", F.col("page_key").cast("string"), F.col("run_id").cast("string"))
    members = placed.drop("kind").join(runs, ["page_key", "item"]).withColumns({"page": F.col("page_key"), "page_key": run_key}).drop("item", "idx")
    titled = F.coalesce(F.col("kind").isin(TITLES), F.lit(False))
    titles = reading_order(members.where(titled)).groupBy("page_key").agg(F.concat(F.lit("## "), ordered_text(F.col("text"), F.col("number"), " ")).alias("text"))
    texts = page_text(members.where(~titled).drop("kind", "run_id", "page")).unionByName(titles)
    keys = members.select("page", "page_key", "run_id").distinct()
    return keys.join(texts.where("text <> ''"), "page_key").groupBy(F.col("page").alias("page_key")).agg(ordered_text(F.col("text"), F.col("run_id"), "\n\n").alias("text"))
