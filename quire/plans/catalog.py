"""All registered queries of the library, with their SQL.

The tables are staged (documents as sources and manifest rows, conversation turns as pages,
order lines as OCR lines and pieces) the same way in both; operators do the rest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markup, text
from ..functions.parsers import html_to_text, mail_text, read_mail
from ..operators import evaluate, ingest, layout, manifest, measures, rules

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- staging -----------------------------------------------------------------------------

EXTENSIONS = [".pdf", ".png", ".docx", ".eml", ".jpg", ".odt"]
_EXT = "case doc_id % 6 when 0 then '.pdf' when 1 then '.png' when 2 then '.docx' when 3 then '.eml' when 4 then '.jpg' else '.odt' end"


def _sources(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    name = F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.expr(_EXT))
    return rows.select(F.col("doc_id").alias("ord"), F.concat(F.lit("in/"), name).alias("path"), name.alias("name"), F.col("text").cast("binary").alias("content"))


_SOURCES = f"""sources as (select doc_id as ord, source || '-' || doc_id || ({_EXT}) as name, ({_EXT}) as suffix,
  case when ({_EXT}) <> '.odt' then sha256(coalesce(text, '')) end as sha256 from documents)"""


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    """Documents as manifest rows: status from the labels, the first of equal texts only."""
    told = ingest.first_of_each(ingest.hashed(_sources(spark, d)).where("supported").withColumn("sub_ord", F.lit(0))).where("nth = 1")
    labels = _table(spark, d, "labels").select(F.col("doc_id").alias("ord"), "quality", "toxic")
    status = F.when(F.col("toxic") == 1, "echec").when(F.col("quality") == 1, "fait").when(F.col("quality") == 0, "a_verifier").otherwise("a_faire")
    joined = told.join(labels, "ord", "left")
    day = F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (F.col("ord") % 28).cast("int")), "yyyy-MM-dd")
    return joined.select(
        "sha256", F.col("name").alias("source_name"), "original", status.alias("status"), F.when(F.col("ord") % 4 == 0, F.lit("raison")).alias("detail"), F.length(F.col("content")).cast("long").alias("length"),
        F.concat(day, F.lit("T08:00:00+00:00")).alias("imported_at"), F.when(F.col("ord") % 9 != 0, F.concat(day, F.lit("T09:00:00"))).alias("converted_at"), "ord",
    )


_MANIFEST = (
    _SOURCES
    + """, firsts as (select s.*, row_number() over (partition by sha256 order by ord) as nth from sources s where suffix <> '.odt'),
manifest as (select sha256, name as source_name, 'originaux/' || sha256[1:16] || suffix as original,
  case when toxic = 1 then 'echec' when quality = 1 then 'fait' when quality = 0 then 'a_verifier' else 'a_faire' end as status,
  case when ord % 4 = 0 then 'raison' end as detail, strlen(coalesce(d.text, '')) as length,
  strftime(date '2026-01-01' + (ord % 28)::int, '%Y-%m-%d') || 'T08:00:00+00:00' as imported_at,
  case when ord % 9 <> 0 then strftime(date '2026-01-01' + (ord % 28)::int, '%Y-%m-%d') || 'T09:00:00' end as converted_at, ord
  from firsts left join labels l on l.doc_id = ord join documents d on d.doc_id = ord where nth = 1)"""
)


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as pages."""
    c = _table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    method = F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, "blank").when((F.col("conv_id") + F.col("turn")) % 5 < 3, "ocr").otherwise("text")
    staged = c.select(F.col("conv_id").alias("doc_key"), (F.col("turn") + 1).cast("int").alias("number"), method.alias("method"), "text", "turn")
    body = F.when((F.col("method") == "blank") | ((F.col("doc_key") + F.col("turn")) % 11 == 0), "").otherwise(F.regexp_replace("text", "[^A-Za-z0-9 ]+", ""))
    ocr = F.col("method") == "ocr"
    return staged.select(
        "doc_key", "number", F.trim(body).alias("text"), "method", F.when(ocr, ((F.col("doc_key") * 7 + F.col("turn") * 13) % 60 + 40) / 100.0).alias("min_confidence"),
        F.when(ocr, (F.col("turn") + 3).cast("int")).alias("lines"), F.array().cast("array<struct<text:string,score:double>>").alias("noise"),
    )


_PAGES = """staged as (select conv_id as doc_key, (turn + 1)::int as number, turn, coalesce(text, '') as t,
  case when (conv_id + turn) % 5 = 0 then 'blank' when (conv_id + turn) % 5 < 3 then 'ocr' else 'text' end as method from conversations),
pages as (select doc_key, number, method, trim(case when method = 'blank' or (doc_key + turn) % 11 = 0 then '' else regexp_replace(t, '[^A-Za-z0-9 ]+', '', 'g') end) as text,
  case when method = 'ocr' then ((doc_key * 7 + turn * 13) % 60 + 40) / 100.0 end as min_confidence, case when method = 'ocr' then (turn + 3)::int end as lines from staged)"""


def _parsed_pages(spark: SparkSession, d: str) -> DataFrame:
    """The same pages in the shape in which notes give them back."""
    none = F.array().cast("array<struct<chars:int,confidence:double,position:double,letters:boolean>>")
    return _pages(spark, d).select("doc_key", "number", "method", F.length("text").alias("chars"), F.col("min_confidence").alias("confidence"), F.coalesce("lines", F.lit(0)).alias("lines"), F.lit(0).alias("noise"), none.alias("flagged"))


def _notes(spark: SparkSession, d: str) -> DataFrame:
    page = F.struct("number", "text", "method", "min_confidence", "lines", "noise")
    docs = _pages(spark, d).groupBy("doc_key").agg(F.sort_array(F.collect_list(page)).alias("pages"))
    return docs.select("doc_key", markup.to_markdown(F.col("pages")).alias("markdown"))


def _flags(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as OCR lines: those of low confidence are flags."""
    lines = _table(spark, d, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy(*[F.col(c) for c in sorted(lines.columns)])
    page = Window.partitionBy("l_orderkey")
    numbered = lines.select("l_orderkey", "l_quantity", "l_discount", "l_linestatus", (F.row_number().over(order)).alias("line"), F.count("*").over(page).alias("total"))
    return numbered.select(
        F.col("l_orderkey").alias("doc_key"), (F.col("l_quantity") % 30 + 1).cast("int").alias("chars"), F.round(1 - 7 * F.col("l_discount"), 2).alias("confidence"),
        ((F.col("line") - 1) / F.greatest(F.col("total") - 1, F.lit(1))).alias("position"), (F.col("l_linestatus") == "O").alias("letters"), "total",
    )


_FLAGS = """numbered as (select l_orderkey, l_quantity, l_discount, l_linestatus, count(*) over (partition by l_orderkey) as total,
  row_number() over (partition by l_orderkey order by l_discount, l_extendedprice, l_linenumber, l_linestatus, l_orderkey, l_partkey, l_quantity, l_returnflag, l_shipdate, l_suppkey, l_tax) as line from lineitem),
ocr as (select l_orderkey as doc_key, (l_quantity % 30 + 1)::int as chars, round(1 - 7 * l_discount, 2) as confidence, (line - 1) / greatest(total - 1, 1) as position, l_linestatus = 'O' as letters, total from numbered),
flags as (select * from ocr where confidence < 0.8),
documents_ as (select doc_key, count(*) filter (confidence < 0.8) as flagged, max(total) as lines from ocr group by 1)"""


def _flag_documents(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).groupBy("doc_key").agg(F.count_if(F.col("confidence") < 0.8).alias("flagged"), F.max("total").alias("lines"))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as pieces of text on a page for each order: boxes on an integer raster."""
    lines, part = _table(spark, d, "lineitem"), _table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    order = Window.partitionBy("l_orderkey").orderBy(*[F.col(c) for c in sorted(lines.columns)])
    named = lines.withColumn("ord", F.row_number().over(order).cast("long")).join(part, "l_partkey")
    q = F.col("l_quantity").cast("long")
    left = (q % 3) * 40 + 10
    top = (F.col("ord") - 1) * 18 - (q % 2) * 12
    word = F.concat(F.substring(F.col("p_name"), 1, 24), F.when(q % 7 == 0, ".").when(q % 7 == 1, ":").when(q % 7 == 2, "-").otherwise(""))
    return named.select(
        F.col("l_orderkey").alias("page_key"), "ord", word.alias("text"), left.cast("double").alias("left"), top.cast("double").alias("top"),
        (left + F.length(word) * 10).cast("double").alias("right"), (top + 20).cast("double").alias("bottom"), F.lit(None).cast("double").alias("score"),
    )


_PIECES = """named as (select l_orderkey, l_quantity::bigint as q, p_name, ord from (select *, row_number() over (partition by l_orderkey order by l_discount, l_extendedprice, l_linenumber, l_linestatus, l_orderkey, l_partkey, l_quantity, l_returnflag, l_shipdate, l_suppkey, l_tax) as ord from lineitem) join part on p_partkey = l_partkey),
worded as (select *, substring(p_name, 1, 24) || case q % 7 when 0 then '.' when 1 then ':' when 2 then '-' else '' end as text from named),
pieces as (select l_orderkey as page_key, ord, text, ((q % 3) * 40 + 10)::double as "left", ((ord - 1) * 18 - (q % 2) * 12)::double as top, ((q % 3) * 40 + 10 + length(text) * 10)::double as "right", ((ord - 1) * 18 - (q % 2) * 12 + 20)::double as bottom from worded),
r1 as (select *, lag(top) over w as ptop, lag(bottom) over w as pbottom from pieces window w as (partition by page_key order by (top + bottom) / 2, ord)),
r2 as (select *, case when ptop is not null and least(pbottom, bottom) - greatest(ptop, top) >= 0.5 * least(pbottom - ptop, bottom - top) then 0 else 1 end as starts from r1),
r3 as (select *, (sum(starts) over (partition by page_key order by (top + bottom) / 2, ord rows unbounded preceding))::bigint as row_id from r2),
ordered as (select *, row_number() over (partition by page_key order by row_id, "left", (top + bottom) / 2, ord) as number, lead("left") over (partition by page_key, row_id order by "left", (top + bottom) / 2, ord) - "right" as gap from r3),
text_rows as (select page_key, row_id, string_agg(text, ' ' order by number) as text, min("left") as "left", min(top) as top, max("right") as "right", max(bottom) as bottom, median(bottom - top) as height,
  sum("right" - "left") / greatest(sum(length(text)), 1) as char_width, max(gap) as widest, count(*) as n from ordered group by 1, 2),
rows_ as (select *, coalesce(widest > 2 * char_width, false) as columns_ from text_rows)"""

_BLOCKS = (
    _PIECES
    + r""", edged as (select *, median(height) over p as line_height, max("right") over p as right_edge, min("left") over p as left_edge,
  lag(text) over o as a_text, lag("left") over o as a_left, lag("right") over o as a_right, lag(bottom) over o as a_bottom, lag(height) over o as a_height, lag(char_width) over o as a_width, lag(columns_) over o as a_columns
  from rows_ window p as (partition by page_key), o as (partition by page_key order by row_id)),
cut as (select *, case when a_text is null or a_left > left_edge + 0.25 * (right_edge - left_edge) or "left" > left_edge + 0.25 * (right_edge - left_edge) or top - a_bottom > 0.9 * line_height
  or height / a_height not between 1 / 1.5 and 1.5 or a_columns or columns_ or regexp_matches(text, '^([-–—•·*▪◦►]|[0-9]{1,2}[.)°]|[a-zA-Z][.)])\s') or regexp_matches(text, '^[\pL\p{Nl}\p{No}][^:.]{0,30}:') or a_text like '%:'
  or (regexp_matches(a_text, '[.!?…]$') and regexp_matches(text, '^\p{Lu}') and right_edge - a_right >= a_width)
  or right_edge - a_right >= (length(regexp_extract(text, '[^ ]+')) + 1) * a_width then 1 else 0 end as is_new, a_text like '%-' and regexp_matches(text, '^\p{Ll}') as hyphen from edged),
numbered_rows as (select *, (sum(is_new) over (partition by page_key order by row_id rows unbounded preceding))::bigint as block_id from cut)"""
)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as references of the documents, letters and digits only."""
    keep = lambda c: F.trim(F.regexp_replace(c, "[^A-Za-z0-9 ]+", ""))
    b, docs = _table(spark, d, "benchmark"), _table(spark, d, "documents")
    return docs.where("text is not null").select("doc_id", "text").join(b.select("item_id", F.col("text").alias("item")), F.col("doc_id") % 40 == F.col("item_id")).select(F.col("doc_id").alias("pair"), keep(F.col("item")).alias("reference"), keep(F.col("text")).alias("candidate"))


_PAIRS = """pairs as (select d.doc_id as pair, trim(regexp_replace(b.text, '[^A-Za-z0-9 ]+', '', 'g')) as reference, trim(regexp_replace(d.text, '[^A-Za-z0-9 ]+', '', 'g')) as candidate
  from documents d join benchmark b on d.doc_id % 40 = b.item_id where d.text is not null),
plain as (select pair, trim(regexp_replace(reference, ' +', ' ', 'g')) as ref, trim(regexp_replace(candidate, ' +', ' ', 'g')) as got from pairs)"""


# --- ingest ------------------------------------------------------------------------------

@_query(f"with {_SOURCES} select ord, name, sha256, case when suffix = '.odt' then 'unsupported' when row_number() over (partition by sha256 order by ord) = 1 then 'first' else 'duplicate' end as outcome from sources")
def dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    told = ingest.first_of_each(ingest.hashed(_sources(spark, d)).withColumn("sub_ord", F.lit(0)))
    return told.select("ord", "name", "sha256", F.when(~F.col("supported"), "unsupported").when(F.col("nth") == 1, "first").otherwise("duplicate").alias("outcome"))


@_query(
    f"""with {_MANIFEST}, known as (select sha256, status from manifest where ord % 3 = 0), stored as (select original from manifest where ord % 2 = 0),
told as (select s.*, row_number() over (partition by s.sha256 order by s.ord) as nth, k.status as known_status, o.original is not null as there
  from sources s left join known k on k.sha256 = s.sha256 left join stored o on o.original = 'originaux/' || s.sha256[1:16] || s.suffix where s.suffix <> '.odt')
select outcome, count(*) as n from (select case when nth > 1 then 'duplicate' when known_status is null then 'added' when not there then 'restored' else 'duplicate' end as outcome from told
  union all select 'unsupported' from sources where suffix = '.odt') group by 1"""
)
def import_outcomes(spark: SparkSession, d: str) -> DataFrame:
    known = _manifest(spark, d)
    told = ingest.outcomes(ingest.hashed(_sources(spark, d)).withColumn("sub_ord", F.lit(0)), known.where("ord % 3 = 0").select("sha256", "status"), known.where("ord % 2 = 0").select("original"))
    return ingest.tally(told)


@_query(f"with {_MANIFEST} select status, count(m.status) as n from (values ('a_faire'), ('fait'), ('a_verifier'), ('echec')) s(status) left join manifest m using (status) group by 1")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return manifest.counts(_manifest(spark, d))


@_query(
    f"""with {_MANIFEST} select regexp_extract(original, '\\.([^./]+)$', 1) as kind, count(*) filter (status = 'a_faire') as a_faire, count(*) filter (status = 'fait') as fait,
count(*) filter (status = 'a_verifier') as a_verifier, count(*) filter (status = 'echec') as echec, count(*) as total from manifest group by 1"""
)
def format_status_pivot(spark: SparkSession, d: str) -> DataFrame:
    return measures.format_status(_manifest(spark, d), list(manifest.STATUSES))


@_query(
    f"""with {_MANIFEST} select regexp_extract(original, '\\.([^./]+)$', 1) as kind, coalesce(sum(case when ord % 5 <> 0 then length end), 0)::bigint as bytes, count(*) as n, count(*) filter (ord % 5 = 0) as missing
from manifest group by rollup(1)"""
)
def format_bytes_rollup(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d)
    return measures.format_bytes(m.select("original"), m.where("ord % 5 <> 0").select("original", "length"))


@_query(f"with {_MANIFEST} select sha256, original from manifest where ord % 5 = 0")
def missing_originals(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d)
    return manifest.missing_originals(m, m.where("ord % 5 <> 0").select("original")).select("sha256", "original")


@_query(
    f"""with {_MANIFEST}, child as (select m.*, case when ord % 6 = 1 then ord - 4 end as parent_ord from manifest m)
select c.sha256, p.original as parent_original from child c left join manifest p on p.ord = c.parent_ord"""
)
def attachment_parents(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d)
    child = m.select("sha256", F.when(F.col("ord") % 6 == 1, F.col("ord") - 4).alias("parent_ord"))
    return child.join(m.select(F.col("ord").alias("parent_ord"), F.col("original").alias("parent_original")), "parent_ord", "left").select("sha256", "parent_original")


# --- manifest ----------------------------------------------------------------------------

@_query("select user_id, event_type as status, event_id as seq from (select *, row_number() over (partition by user_id order by event_id desc) as k from events) where k = 1")
def latest_status(spark: SparkSession, d: str) -> DataFrame:
    log = _table(spark, d, "events").select(F.col("user_id").alias("sha256"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    return manifest.latest(log).select(F.col("sha256").alias("user_id"), "status", "seq")


@_query(f"with {_MANIFEST} select sha256, source_name from manifest where status = 'a_faire' and sha256[1:16] not in (select sha256[1:16] from manifest where ord % 3 = 1)")
def pending_resume(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d)
    return manifest.still_to_do(manifest.pending(m), m.where("ord % 3 = 1").select(F.left("sha256", F.lit(16)).alias("prefix"))).select("sha256", "source_name")


@_query(f"with {_MANIFEST} select sha256, 'fait' as status, detail from manifest where status = 'a_verifier' and ord % 2 = 0")
def tick_sync(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d)
    return manifest.ticked(m, m.where("ord % 2 = 0").select(F.left("sha256", F.lit(16)).alias("prefix"))).select("sha256", "status", "detail")


@_query(f"with {_MANIFEST} select sha256, 'a_faire' as status, null::varchar as detail from manifest where status = 'echec'")
def retry_failures(spark: SparkSession, d: str) -> DataFrame:
    return manifest.retried(_manifest(spark, d)).select("sha256", "status", "detail")


def _note_paths(m: DataFrame) -> DataFrame:
    """Two notes name each third original; the first in path order counts."""
    at = F.to_timestamp("imported_at") + F.expr("make_dt_interval(0, 1, 0, (ord % 7) - 1)")
    one = m.where("ord % 8 <> 5").select(F.concat(F.lit("b c/"), F.col("source_name"), F.lit(".md")).alias("path"), "original", at.alias("modified"))
    two = m.where("ord % 3 = 0 and ord % 8 <> 5").select(F.concat(F.lit("b/"), F.col("source_name"), F.lit(".md")).alias("path"), "original", at.alias("modified"))
    return one.unionByName(two)


_NOTES = (
    _MANIFEST
    + """, notes as (select 'b c/' || source_name || '.md' as path, original, imported_at[1:19]::timestamp + interval 1 hour + ((ord % 7) - 1) * interval 1 second as modified from manifest where ord % 8 <> 5
  union all select 'b/' || source_name || '.md', original, imported_at[1:19]::timestamp + interval 1 hour + ((ord % 7) - 1) * interval 1 second from manifest where ord % 3 = 0 and ord % 8 <> 5),
located as (select original, arg_min(path, string_split(path, '/')) as path, min(modified) as modified from notes group by 1)"""
)


@_query(f"with {_NOTES} select original, path from located")
def located_notes(spark: SparkSession, d: str) -> DataFrame:
    return manifest.locate(_note_paths(_manifest(spark, d)))


@_query(
    f"""with {_NOTES} select sha256, path, case when path is null then 'missing' when ord % 10 = 1 then 'already_done' when converted_at is null or modified > converted_at::timestamp + interval 3 seconds then 'edited' else 'pending' end as action
from manifest left join located using (original) where status in ('fait', 'a_verifier')"""
)
def reconvert_plan(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d)
    done = m.where("ord % 10 = 1").select(F.left("sha256", F.lit(16)).alias("prefix"))
    return manifest.reconvert_plan(m, _note_paths(m), done).select("sha256", "path", "action")


@_query(
    f"""with {_MANIFEST}, r as (select *, case when ord % 4 = 3 then 'E : x' end as error, case when ord % 2 = 0 then 'a_verifier' else 'fait' end as new_status from manifest where status in ('fait', 'a_verifier'))
select sha256, case when error is not null or (new_status = 'a_verifier' and status = 'fait' and detail is not null) then status else new_status end as status,
case when error is not null then 'failed' when new_status = 'a_verifier' and status = 'fait' and detail is not null then 'fait' else new_status end as outcome from r"""
)
def reconvert_statuses(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d).where(F.col("status").isin("fait", "a_verifier"))
    results = m.select("sha256", F.when(F.col("ord") % 2 == 0, "a_verifier").otherwise("fait").alias("status"), F.lit("neuf").alias("detail"), F.when(F.col("ord") % 4 == 3, "E : x").alias("error"), F.lit("2026-03-01T00:00:00").alias("at"))
    return manifest.reconverted(m, results).select("sha256", "status", "outcome")


@_query(
    f"""with {_NOTES}, told as (select l.path, m.ord % 13 <> 0 as readable from manifest m left join located l using (original) where status in ('fait', 'a_verifier'))
select label, count(*) as n from (select case when path is null then 'introuvable' when regexp_extract(path, '^(.*)/[^/]*$', 1) = 'b' then 'à ranger' else 'rangés' end as label from told
union all select 'illisible' from told where path is not null and not readable) group by 1"""
)
def placement(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d)
    told = m.where(F.col("status").isin("fait", "a_verifier")).join(manifest.locate(_note_paths(m)), "original", "left").select("path", (F.col("ord") % 13 != 0).alias("readable"))
    return measures.placement(told, "b")


@_query(
    f"""with {_SOURCES}, s as (select ord, 'Courrier ' || (ord % 50) as stem from sources), k as (select *, row_number() over (partition by stem order by ord) as n from s)
select ord, 'f' as folder, stem, case when n = 1 then stem || '.md' else stem || ' (' || n || ').md' end as name from k"""
)
def free_names(spark: SparkSession, d: str) -> DataFrame:
    wanted = _sources(spark, d).select("ord", F.lit("f").alias("folder"), F.concat(F.lit("Courrier "), (F.col("ord") % 50).cast("string")).alias("stem"))
    return manifest.free_names(wanted, spark.createDataFrame([], "folder string, name string"))


# --- text --------------------------------------------------------------------------------

@_query(
    r"""with n as (select doc_id, source || '/' || coalesce(text, '') || '?. ' as name from documents),
c as (select doc_id, trim(trim(regexp_replace(regexp_replace(name, '[<>:"/\\|?*#^\[\]\x00-\x1f]', ' ', 'g'), '[\t-\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), ' .')[1:80], ' .') as cut from n)
select doc_id, case when cut = '' then 'document' else cut end as name from c"""
)
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    return docs.select("doc_id", text.safe_name(F.concat("source", F.lit("/"), F.coalesce("text", F.lit("")), F.lit("?. "))).alias("name"))


@_query(
    r"""select doc_id, trim(regexp_replace(text, '[\t-\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) as text from documents"""
)
def whitespace_collapse(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", text.collapse(F.col("text")).alias("text"))


@_query()
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", html_to_text("html").alias("text"))


# --- pages and measures ------------------------------------------------------------------

@_query(f"with {_PAGES} select doc_key, number, method, length(text) as chars, min_confidence as confidence, coalesce(lines, 0) as lines from pages")
def marker_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as Markdown and read back."""
    return measures.pages(measures.parsed(_notes(spark, d))).select("doc_key", "number", "method", F.col("chars").cast("long").alias("chars"), "confidence", "lines")


@_query(
    f"""with {_MANIFEST} select sha256, case when ord % 3 = 0 then null else original end as original from manifest"""
)
def front_matter_original(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d)
    none = F.lit(None).cast("string")
    note = F.when(F.col("ord") % 3 == 0, F.lit("# rien\n")).otherwise(F.concat(markup.front_matter(F.col("original"), F.col("source_name"), none, F.col("imported_at")), F.lit("texte\n")))
    return m.select("sha256", markup.original_of(note).alias("original"))


@_query(
    f"""with {_PAGES}, r as (select doc_key, number, method, text, case when method = 'blank' then null when text = '' then 'page ' || number || ' vide ou illisible'
  when min_confidence < 0.8 then 'page ' || number || ' : confiance OCR ' || printf('%.2f', min_confidence) end as reason from pages),
g as (select doc_key, bool_and(method = 'blank') as all_blank, string_agg(reason, ' ; ' order by number) as reasons from r group by 1)
select doc_key, case when all_blank or reasons is not null then 'a_verifier' else 'fait' end as status, case when all_blank then 'document entièrement blanc' else reasons end as detail from g"""
)
def review_status(spark: SparkSession, d: str) -> DataFrame:
    return rules.review_status(_pages(spark, d))


_KINDS = """kinds as (select case when count(*) filter (method <> 'blank') = 0 then 'blanc' when count(distinct method) filter (method <> 'blank') > 1 then 'mixte'
  when bool_or(method = 'text') then 'texte' else 'OCR' end as label from pages group by doc_key)"""
_LABELS = "labelled as (select case when method = 'blank' then 'blanches' when text = '' then 'vides' else method end as label from pages)"
_RANGES = """text_r as (select label, (select count(*) from pages where method = 'text' and text <> '' and length(text) >= lo and length(text) < hi) as n
  from (values ('< 200', 0, 200), ('200–999', 200, 1000), ('≥ 1000', 1000, 1000000000)) v(label, lo, hi)),
conf_r as (select label, (select count(*) from pages where method = 'ocr' and text <> '' and min_confidence >= lo and min_confidence < hi) as n
  from (values ('< 0,80', 0, 0.80), ('0,80–0,90', 0.80, 0.90), ('0,90–0,95', 0.90, 0.95), ('≥ 0,95', 0.95, 1000)) v(label, lo, hi))"""


@_query(f"with {_PAGES}, {_KINDS} select label, count(*) as n from kinds group by 1")
def document_kinds(spark: SparkSession, d: str) -> DataFrame:
    return measures.kinds(measures.parsed(_notes(spark, d)))


@_query(f"with {_PAGES}, {_LABELS} select label, count(*) as n from labelled group by 1")
def page_labels(spark: SparkSession, d: str) -> DataFrame:
    return measures.page_counts(_parsed_pages(spark, d))


@_query(f"with {_PAGES}, {_RANGES} select 'text_ranges' as metric, label, n from text_r union all select 'confidence_ranges', label, n from conf_r")
def page_ranges(spark: SparkSession, d: str) -> DataFrame:
    rows = _parsed_pages(spark, d)
    return measures.text_ranges(rows).unionByName(measures.confidence_ranges(rows))


@_query(f"with {_PAGES} select median(n) as median, max(n) as max from (select count(*) as n from pages group by doc_key)")
def pages_per_document(spark: SparkSession, d: str) -> DataFrame:
    return measures.pages_per_document(_parsed_pages(spark, d))


@_query(
    f"""with {_PAGES}, {_KINDS}, {_LABELS}, {_RANGES}, per as (select doc_key, count(*) filter (method = 'text' and text <> '' and length(text) < 200) as short, coalesce(sum(case when method = 'ocr' and text <> '' then lines end), 0)::bigint as lines from pages group by 1)
select 'kinds' as metric, label, count(*) as n from kinds group by 2 union all select 'pages', label, count(*) from labelled group by 2
union all select 'text_ranges', label, n from text_r union all select 'confidence_ranges', label, n from conf_r
union all select 'lengths', label, 0 from (values ('1–3'), ('4–15'), ('> 15')) v(label) union all select 'confidence', label, 0 from (values ('< 0,50'), ('0,50–0,70'), ('0,70–0,80')) v(label)
union all select 'without_letters', '', 0 union all select 'shares', label, 0 from (values ('< 5 %'), ('5–20 %'), ('> 20 %')) v(label)
union all select 'totals', 'ocr_lines', sum(lines)::bigint from per union all select 'totals', 'short_text_documents', count(*) filter (short > 0) from per
union all select 'totals', label, 0 from (values ('noise_fragments'), ('illegible_lines'), ('illegible_documents')) v(label)"""
)
def measures_report(spark: SparkSession, d: str) -> DataFrame:
    """All statistics of the notes, read back from their Markdown."""
    return measures.measure(_notes(spark, d))


_QUERIES["measures"] = _QUERIES.pop("measures_report")
_SQL["measures"] = _SQL.pop("measures_report")


@_query(
    f"""with {_FLAGS} select 'lengths' as metric, label, (select count(*) from flags where chars >= lo and chars < hi) as n from (values ('1–3', 0, 4), ('4–15', 4, 16), ('> 15', 16, 1000)) v(label, lo, hi)
union all select 'confidence', label, (select count(*) from flags where confidence >= lo and confidence < hi) from (values ('< 0,50', 0, 0.5), ('0,50–0,70', 0.5, 0.7), ('0,70–0,80', 0.7, 1000)) v(label, lo, hi)
union all select 'places', case when position <= 0.15 then 'haut' when position >= 1 - 0.15 then 'bas' else 'milieu' end as label, count(*) from flags group by 2
union all select 'without_letters', '', count(*) filter (not letters) from flags"""
)
def flag_histograms(spark: SparkSession, d: str) -> DataFrame:
    return measures.flag_histograms(_flags(spark, d).where("confidence < 0.8"))


@_query(f"with {_FLAGS} select 'shares' as metric, label, (select count(*) from documents_ where flagged > 0 and flagged / lines >= lo and flagged / lines < hi) as n from (values ('< 5 %', 0, 0.05), ('5–20 %', 0.05, 0.2), ('> 20 %', 0.2, 1000)) v(label, lo, hi)")
def share_ranges(spark: SparkSession, d: str) -> DataFrame:
    return measures.share_ranges(_flag_documents(spark, d))


@_query(f"with {_FLAGS} select flagged, lines from documents_ where flagged > 0 order by flagged desc, lines desc limit 3")
def top_offenders(spark: SparkSession, d: str) -> DataFrame:
    return measures.top_offenders(_flag_documents(spark, d))


@_query(f"with {_FLAGS} select round((select sum(flagged) from (select flagged from documents_ order by flagged desc, lines desc limit 3)) / sum(flagged), 9) as share from documents_")
def concentration(spark: SparkSession, d: str) -> DataFrame:
    return measures.concentration(_flag_documents(spark, d)).select(F.round("share", 9).alias("share"))


# --- layout ------------------------------------------------------------------------------

@_query(f'with {_PIECES} select page_key, row_id, text, "left", top, "right", bottom, height, round(char_width, 6) as char_width, columns_ as columns, n as pieces from rows_')
def layout_rows(spark: SparkSession, d: str) -> DataFrame:
    return layout.rows(_pieces(spark, d)).select("page_key", "row_id", "text", "left", "top", "right", "bottom", "height", F.round("char_width", 6).alias("char_width"), "columns", "pieces")


@_query(f"with {_PIECES} select page_key, ord, row_id, number from ordered")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return layout.reading_order(_pieces(spark, d)).select("page_key", "ord", "row_id", "number")


@_query(f"with {_BLOCKS} select page_key, block_id, count(*) as rows, string_agg(case when is_new = 1 or hyphen then '' else ' ' end || text, '' order by row_id) as text from numbered_rows group by 1, 2")
def layout_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return layout.blocks(_pieces(spark, d))


@_query(
    f"""with {_PIECES}, boxes as (select distinct page_key, i as idx, i * 25.0 - 30 as x0, i * 12.0 - 40 as y0, 400.0 - i * 20 as x1, 60.0 + i * 30 as y1 from pieces, range(4) t(i)),
met as (select p.page_key, p.ord, b.idx, (b.x1 - b.x0) * (b.y1 - b.y0) as area from pieces p left join boxes b on p.page_key = b.page_key and (p."left" + p."right") / 2 between b.x0 and b.x1 and (p.top + p.bottom) / 2 between b.y0 and b.y1)
select page_key, ord, idx from (select *, row_number() over (partition by page_key, ord order by area nulls last, idx) as k from met) where k = 1"""
)
def piece_in_block(spark: SparkSession, d: str) -> DataFrame:
    pieces = _pieces(spark, d)
    i = F.col("idx")
    boxes = pieces.select("page_key").distinct().select("page_key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("idx"))
    boxes = boxes.select("page_key", "idx", (i * 25.0 - 30).alias("x0"), (i * 12.0 - 40).alias("y0"), (400.0 - i * 20).alias("x1"), (60.0 + i * 30).alias("y1"), F.lit("text").alias("kind"))
    return layout.in_blocks(pieces, boxes).select("page_key", "ord", "idx")


# --- evaluation --------------------------------------------------------------------------

@_query(
    f"""with {_PAIRS}, a as (select pair, w, count(*) as n from (select pair, unnest(string_split(ref, ' ')) as w from plain) where w <> '' group by 1, 2), b as (select pair, w, count(*) as n from (select pair, unnest(string_split(got, ' ')) as w from plain) where w <> '' group by 1, 2),
c as (select pair, sum(least(a.n, b.n)) as common from a join b using (pair, w) group by 1), na as (select pair, sum(n) as n from a group by 1), nb as (select pair, sum(n) as n from b group by 1)
select plain.pair, round(coalesce(common, 0) / greatest(coalesce(na.n, 0), 1), 9) as found, round(1 - coalesce(common, 0) / greatest(coalesce(nb.n, 0), 1), 9) as extra from plain left join c using (pair) left join na using (pair) left join nb using (pair)"""
)
def words_found(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.words_found(_pairs(spark, d)).select("pair", F.round("found", 9).alias("found"), F.round("extra", 9).alias("extra"))


@_query(f"with {_PAIRS} select pair, round(levenshtein(ref, got) / greatest(length(ref), 1), 9) as cer, round(levenshtein(replace(ref, ' ', ''), replace(got, ' ', '')) / greatest(length(replace(ref, ' ', '')), 1), 9) as cer_no_space from plain")
def error_rates(spark: SparkSession, d: str) -> DataFrame:
    rates = evaluate.error_rates(F.col("reference"), F.col("candidate"))
    return _pairs(spark, d).select("pair", *[F.round(c, 9).alias(n) for n, c in rates.items()])


@_query()
def word_error_rates(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("pair", F.round(evaluate.word_error_rate(F.col("reference"), F.col("candidate")), 9).alias("wer"))


@_query("(select l_returnflag, l_linestatus from lineitem where l_orderkey % 2 = 0) intersect all (select l_returnflag, l_linestatus from lineitem where l_orderkey % 2 = 1)")
def multiset_intersection(spark: SparkSession, d: str) -> DataFrame:
    lines = _table(spark, d, "lineitem")
    half = lambda k: lines.where(F.col("l_orderkey") % 2 == k).select("l_returnflag", "l_linestatus")
    return evaluate.multiset_intersection(half(0), half(1))


def _cells(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = _table(spark, d, "part").select(F.floor(F.col("p_partkey") / 20).alias("page_id"), (F.floor(F.col("p_partkey") / 10) % 2).alias("tab"), (F.col("p_partkey") % 10).alias("row"), F.explode(F.map_from_arrays(F.array(F.lit(0), F.lit(1)), F.array("p_brand", "p_type"))).alias("col", "cell"), "p_size")
    wrong = F.when(F.col("p_size") % 4 == 0, F.concat("cell", F.lit("?"))).otherwise(F.col("cell"))
    return part.drop("p_size"), part.withColumn("cell", wrong).withColumn("tab", 1 - F.col("tab")).drop("p_size")


@_query(
    """with c as (select p_partkey // 20 as page_id, (p_partkey // 10) % 2 as tab, p_partkey % 10 as row, unnest([0, 1]) as col, unnest([p_brand, p_type]) as cell, p_size from part),
ref as (select page_id, tab, row, col, cell from c), cand as (select page_id, 1 - tab as other, row, col, case when p_size % 4 = 0 then cell || '?' else cell end as cell from c),
hits as (select page_id, tab, other, count(*) as n from ref join cand using (page_id, row, col, cell) group by 1, 2, 3), best as (select page_id, tab, max(n) as best from hits group by 1, 2),
sizes as (select page_id, tab, count(*) as cells from ref group by 1, 2)
select page_id, count(*) filter (best > 0) as tables_found, coalesce(sum(best), 0)::bigint as cells_right, sum(cells)::bigint as cells_total from sizes left join best using (page_id, tab) group by 1"""
)
def table_scores(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.table_score(*_cells(spark, d))


@_query(
    f"""with {_FLAGS}, ticks as (select confidence, case when chars % 5 < 3 then (['juste', 'un peu fausse', 'très fausse'])[chars % 5 + 1] when chars % 5 = 3 then 'sans réponse' else 'plusieurs cases' end as answer from flags),
ranged as (select case when confidence < 0.5 then '< 0,50' when confidence < 0.7 then '0,50–0,70' else '0,70–0,80' end as range, answer from ticks)
select range, count(*) filter (answer = 'juste') as juste, count(*) filter (answer = 'un peu fausse') as un_peu_fausse, count(*) filter (answer = 'très fausse') as tres_fausse,
count(*) filter (answer = 'sans réponse') as sans_reponse, count(*) filter (answer = 'plusieurs cases') as plusieurs_cases from ranged group by rollup(range)"""
)
def answers_table(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(a) for a in evaluate.ANSWERS])
    kind = F.col("chars") % 5
    ticks = F.when(kind < 3, F.slice(names, kind + 1, F.lit(1))).when(kind == 3, F.array().cast("array<string>")).otherwise(names)
    table = evaluate.answers_table(_flags(spark, d).where("confidence < 0.8").select("confidence", ticks.alias("ticks")))
    plain = {"un peu fausse": "un_peu_fausse", "très fausse": "tres_fausse", "sans réponse": "sans_reponse", "plusieurs cases": "plusieurs_cases"}
    return table.withColumnsRenamed(plain)


@_query(
    f"""with {_PAIRS}, chained as (select 'a' as chain, pair, ref, got, 1.5 as seconds from plain union all select 'b', pair, ref, replace(replace(ref, 'e', 'c'), 'rn', 'm'), 0.5 from plain)
select chain, count(*) as pages, round(avg(levenshtein(ref, trim(got)) / greatest(length(ref), 1)), 9) as cer, round(avg(seconds), 9) as seconds from chained group by 1"""
)
def chain_comparison(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d)
    one = pairs.select(F.lit("a").alias("chain"), F.col("pair").alias("page_id"), F.col("candidate").alias("text"), F.lit(1.5).alias("seconds"))
    two = pairs.select(F.lit("b").alias("chain"), F.col("pair").alias("page_id"), F.replace(F.replace(text.plain(F.col("reference")), F.lit("e"), F.lit("c")), F.lit("rn"), F.lit("m")).alias("text"), F.lit(0.5).alias("seconds"))
    told = evaluate.compare_chains(one.unionByName(two), pairs.select(F.col("pair").alias("page_id"), "reference"))
    return told.select("chain", "pages", F.round("cer", 9).alias("cer"), F.round("seconds", 9).alias("seconds"))


@_query(
    f"""with {_FLAGS}, l as (select doc_key, chars::bigint as page, position::double::varchar as text, confidence, case when confidence < 0.5 then '< 0,50' when confidence < 0.7 then '0,50–0,70' else '0,70–0,80' end as range from flags),
drawn as (select *, md5(concat_ws(chr(1), 1, doc_key, page, text)) as draw from l), capped as (select *, row_number() over (partition by doc_key order by draw, page, text) as k from drawn),
ranked as (select *, row_number() over (partition by range order by draw, doc_key, page, text) as turn from capped where k <= 2)
select doc_key, page, text, confidence, range from ranked order by turn, range, draw limit 60"""
)
def sample_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = _flags(spark, d).where("confidence < 0.8").select("doc_key", F.col("chars").alias("page"), F.col("position").cast("string").alias("text"), "confidence")
    return evaluate.sample_lines(lines, 60, 1)


@_query(
    f"""with {_PAGES}, p as (select doc_key, number as page, text, case when method = 'text' then 'texte' when doc_key % 4 = 0 then 'OCR net' when doc_key % 4 / greatest(lines * 5, 1) < 0.1 then 'OCR moyen' else 'OCR difficile' end as kind
  from pages where text <> '' and method <> 'blank'), drawn as (select *, md5(concat_ws(chr(1), 1, doc_key, page)) as draw from p),
capped as (select *, row_number() over (partition by doc_key order by draw, page) as k from drawn), ranked as (select *, row_number() over (partition by kind order by draw, doc_key, page) as turn from capped where k <= 2)
select doc_key, page, kind, text from ranked order by case when turn <= case kind when 'texte' then 4 when 'OCR net' then 4 else 6 end then 0 else 1 end, draw, doc_key, page limit 20"""
)
def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d).where("text <> '' and method <> 'blank'")
    kinds = rules.page_kind(F.col("method"), F.col("doc_key") % 4, F.col("lines") * 5)
    return evaluate.pick_pages(pages.select("doc_key", F.col("number").alias("page"), kinds.alias("kind"), "text"), 20, 1)


# --- rules and text functions over whole texts ---------------------------------------------

_WHITE = r"\t-\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WHITE_IN_LINE = r"\t\x{0b}-\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^[{_WHITE}]+|[{_WHITE}]+$', '', 'g')"


def _normalized_sql(x: str) -> str:
    return _strip_sql(rf"regexp_replace(replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[{_WHITE_IN_LINE}]+\n', chr(10), 'g')")


@_query(f"select doc_id, {_normalized_sql('text')} as text, length({_normalized_sql('text')}) >= 25 as has_layer from documents")
def normalized_text(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", text.normalized(F.col("text")).alias("text"), rules.has_text_layer(F.col("text")).alias("has_layer"))


def _marked(spark: SparkSession, d: str) -> DataFrame:
    """Documents as notes with front matter, comments, flags and highlights around their words."""
    docs = _table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.concat(F.lit("---\noriginal: x\n---\n<!-- page 1 · texte -->\n\n=="), "lang", F.lit("== "), "text", F.lit("\n\n\n\n<!-- fin\nde page --> é ==(«\n»)==  \n")).alias("note"))


_MARKED = r"""marked as (select doc_id, '---' || chr(10) || 'original: x' || chr(10) || '---' || chr(10) || '<!-- page 1 · texte -->' || chr(10) || chr(10) || '==' || lang || '== ' || text || repeat(chr(10), 4) || '<!-- fin' || chr(10) || 'de page --> é ==(«' || chr(10) || '»)==  ' || chr(10) as note
  from documents where text is not null)"""


@_query(
    rf"""with {_MARKED}, bare as (select doc_id, regexp_replace(regexp_replace(regexp_replace(note, '(?s)\A---\n.*?\n---\n', ''), '<!--[^\n]*?-->', '', 'g'), '(?s)==(.*?)==', '\1', 'g') as t from marked)
select doc_id, {_strip_sql("regexp_replace(t, chr(10) || '{3,}', chr(10) || chr(10), 'g')")} as text from bare"""
)
def document_texts(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).select("doc_id", text.document_text(F.col("note")).alias("text"))


@_query(
    rf"""with {_MARKED}, bare as (select doc_id, replace(regexp_replace(note, '(?s)<!--.*?-->', '', 'g'), '==', '') as t from marked),
trimmed as (select doc_id, regexp_replace(regexp_replace(t, '[{_WHITE_IN_LINE}]+\n', chr(10), 'g'), '[{_WHITE_IN_LINE}]+$', '') as t from bare)
select doc_id, {_strip_sql("regexp_replace(t, chr(10) || '{3,}', chr(10) || chr(10), 'g')")} as text from trimmed"""
)
def unmarked_texts(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).select("doc_id", text.without_marks(F.col("note")).alias("text"))


@_query("select p_partkey, p_size > p_partkey % 50 or (p_size = p_partkey % 50 and p_partkey % 7 > 3) as newer from part")
def version_order(spark: SparkSession, d: str) -> DataFrame:
    part = _table(spark, d, "part")
    text_of = lambda *c: F.concat_ws(".", *[x.cast("string") for x in c])
    key = F.col("p_partkey")
    return part.select("p_partkey", text.is_newer(F.concat(F.lit("v"), text_of(F.col("p_size"), key % 7)), text_of(key % 50, F.lit(3))).alias("newer"))


@_query("select o_orderkey, case when o_orderkey % 4 < 3 then o_orderdate::date::varchar end as day from orders")
def parsed_dates(spark: SparkSession, d: str) -> DataFrame:
    """Order dates written in three forms, and one that is no date."""
    orders = _table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    week_year = F.year(F.date_add("day", 3 - F.weekday("day")))
    week = F.concat(week_year.cast("string"), F.lit("-W"), F.lpad(F.weekofyear("day").cast("string"), 2, "0"), F.lit("-"), (F.weekday("day") + 1).cast("string"))
    kind = F.col("o_orderkey") % 4
    said = F.when(kind == 0, F.date_format("day", "yyyy-MM-dd")).when(kind == 1, F.date_format("day", "yyyyMMdd")).when(kind == 2, week).otherwise(F.date_format("day", "dd/MM/yyyy"))
    return orders.select("o_orderkey", text.iso_date(said, 2100).cast("string").alias("day"))


@_query(f"with {_FLAGS}, n as (select doc_key, count(*) filter (confidence < 0.5 and chars <= 3) as noise, count(*) as lines, count(*) filter (confidence < 0.8) as flagged from ocr group by 1) select doc_key, noise, case when flagged = 0 then 'OCR net' when flagged / greatest(lines, 1) < 0.1 then 'OCR moyen' else 'OCR difficile' end as kind from n")
def noise_and_kinds(spark: SparkSession, d: str) -> DataFrame:
    rows = _flags(spark, d).withColumn("piece", F.repeat(F.lit("x"), F.col("chars").cast("int")))
    per = rows.groupBy("doc_key").agg(F.count_if(rules.is_noise(F.col("confidence"), F.col("piece"))).alias("noise"), F.count("*").alias("lines"), F.count_if(F.col("confidence") < 0.8).alias("flagged"))
    return per.select("doc_key", "noise", rules.page_kind(F.lit("ocr"), F.col("flagged"), F.col("lines")).alias("kind"))


@_query("select p_partkey, p_size * 4 >= 150 and p_partkey % 5 = 0 as blank from part")
def blank_images(spark: SparkSession, d: str) -> DataFrame:
    part = _table(spark, d, "part")
    return part.select("p_partkey", rules.is_blank(F.col("p_size") * 4, F.when(F.col("p_partkey") % 5 == 0, 1e-4).otherwise(2e-4)).alias("blank"))


@_query("select distinct lang || '/' || source as path from documents where doc_id % 3 = 0 and lang is not null and source is not null")
def visible_folders(spark: SparkSession, d: str) -> DataFrame:
    """Folders beside hidden ones and the inbox."""
    docs = _table(spark, d, "documents")
    head = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("."), "lang")).otherwise(F.lit(text.INBOX))
    return manifest.visible_folders(docs.select(F.concat(head, F.lit("/"), "source").alias("path")).where("path is not null").distinct())


@_query("select doc_id, case when text is null or trim(text) = '' then 0 else 1 end as rows, '| ' || lang || ' | ' || replace(source, '|', '\\|') || ' |' as line from documents where lang is not null and source is not null")
def markdown_tables(spark: SparkSession, d: str) -> DataFrame:
    """A table of one or two rows written and read back: its second row counted, its first as written."""
    docs = _table(spark, d, "documents").where("lang is not null and source is not null")
    head = F.array("lang", "source")
    told = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", F.array(head)).otherwise(F.array(head, F.array(F.lit("a b"))))
    written = text.markdown_table(told)
    read = F.get(evaluate.tables(written), F.lit(0))
    return docs.select("doc_id", (F.size(read) - 1).alias("rows"), F.get(F.split(written, "\n"), F.lit(0)).alias("line"))


_MAIL = "**De :** a@example.org  \\n**À :** b@example.org  \\n**Date :** 2026-02-02 10:00  \\n**Objet :** "


@_query(
    f"""select doc_id, replace('{_MAIL}', '\\n', chr(10)) || coalesce(source, '-') || case when t = '' then '' else chr(10) || chr(10) || t end as text
from (select doc_id, source, {_normalized_sql("regexp_replace(coalesce(text, ''), '[^ -~¡-ÿ' || chr(10) || ']', '', 'g')")} as t from documents)"""
)
def mail_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents as the bodies of e-mails."""
    head = F.concat(F.lit("From: a@example.org\nTo: b@example.org\nDate: Mon, 02 Feb 2026 10:00:00 +0100\nSubject: "), F.coalesce("source", F.lit("-")), F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"))
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~¡-ÿ\n]", "")
    mail = _table(spark, d, "documents").select("doc_id", read_mail(F.encode(F.concat(head, body), "UTF-8")).alias("m"))
    return mail.select("doc_id", mail_text(F.col("m")).alias("text"))
