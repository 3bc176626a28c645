"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds are plain patterns: assignments, access identifiers, long hexadecimal runs. The
linking adds weak parts that mean little alone: identifiers (account or key names), secrets
(long mixed tokens) and endpoints (addresses). A scope is SCOPE characters to either side of
a part. An interval join within the document, by the scope's bins that an interval touches,
brings parts of different roles together; a weak part is reported only when a complementary
part lies in its scope, however long either is: an identifier and a secret need one another;
an endpoint needs both.

Positions are code points, end exclusive. Marks set around each match cut the text into
pieces, whose lengths are summed in a window over the pieces, so a text's cost is in
proportion to its length and matches. Control characters used as marks are first replaced by
another in the text, which no pattern matches either, so lengths stay.

Rows: a null text counts as empty. Repeated rows get equal results each; a null doc_id is
handled like any other. Spans of several kinds may overlap. A long text may have any number
of matches. An empty table gives an empty result. Other columns, whatever their names, aren't looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, documents_only, passing, row_key, written

#: The base patterns and the least lengths that they need.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{32,})"
BASE = [("assign", ASSIGN, 8), ("access", ACCESS, 16), ("hex", HEX, 32)]

SCOPE = 200
#: Weak parts: (kind, pattern that ends with the part as group 1, role).
WEAK = [
    ("weak_id", r"""(?:^|[^A-Za-z0-9_])(?i:access_?key(?:_?id)?|client_?id|account(?:_?id)?|user(?:name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{4,})""", "id"),
    ("weak_secret", r"([A-Za-z0-9+/_-]{24,}={0,2})", "secret"),
    ("weak_endpoint", r"""((?:https?|ftp|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+)""", "endpoint"),
]
#: A weak secret mixes these.
MIXED = ["[0-9]", "[a-z]", "[A-Z]"]
KINDS = [k for k, _, _ in BASE] + [k for k, _, _ in WEAK]
#: Roles of the base kinds in linking.
ROLES = {"assign": "secret", "access": "id", "hex": "secret"} | {k: r for k, _, r in WEAK}
IDENTITY = ["missing", "id", "key"]
#: Texts are redacted in parts of so many characters.
CHUNK = 4096


def _is_mixed(part: Column) -> Column:
    good = F.lit(True)
    for p in MIXED:
        good = good & part.rlike(p)
    return good


def _pieces(text: Column, rank: int, pattern: str, good: Callable[[Column], Column]) -> Column:
    """The text cut before each leftmost non-overlapping match of ``pattern``: rank, i (place), m (length of the match, 0 in the first piece), g (of its group 1), r (of what follows), good."""
    marked = F.split(F.regexp_replace(text, pattern, "\u0001$0\u0002$1\u0003"), "\u0001")

    def piece(p: Column, i: Column) -> Column:
        group = F.substring_index(F.substring_index(p, "\u0003", 1), "\u0002", -1)
        first = i == 0
        return F.struct(
            F.lit(rank).alias("rank"), i.alias("i"), F.when(first, 0).otherwise(F.length(F.substring_index(p, "\u0002", 1))).alias("m"), F.length(group).alias("g"),
            F.length(F.substring_index(p, "\u0003", -1)).alias("r"), F.when(first, False).otherwise(F.coalesce(good(group), F.lit(False))).alias("good"),
        )

    return F.when(text.rlike(pattern), F.transform(marked, piece)).otherwise(F.expr("array()").cast("array<struct<rank:int,i:int,m:int,g:int,r:int,good:boolean>>"))


def _all_pieces(text: Column) -> Column:
    base = [_pieces(text, i, p, lambda g, n=n: F.length(g) >= n) for i, (_, p, n) in enumerate(BASE)]
    return F.concat(*base, *[_pieces(text, len(BASE) + i, p, _is_mixed if k == "weak_secret" else lambda g: F.lit(True)) for i, (k, p, _) in enumerate(WEAK)])


def _linked(parts: DataFrame) -> DataFrame:
    """The weak parts of ``parts`` (rid, rank, start, end) that a complementary part supports.

    A part lies in the bins that it touches; a weak part looks in those that its scope touches.
    A bin is as wide as the scope, so it holds few parts, however many the text has.
    """
    role = F.get(F.array(*[F.lit(ROLES[k]) for k in KINDS]), F.col("rank"))
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / SCOPE), F.floor(b / SCOPE)))
    start, end = F.col("start"), F.col("end")
    held = parts.select("rid", role.alias("other"), "start", "end", bins(start, end).alias("bin")).groupBy("rid", "other", "bin").agg(F.collect_set(F.struct("start", "end")).alias("held"))
    weak = parts.where(F.col("rank") >= len(BASE)).select("rid", "rank", role.alias("role"), "start", "end", bins(start - SCOPE, end + SCOPE).alias("bin"))
    near = F.exists("held", lambda o: (o["start"] - end <= SCOPE) & (start - o["end"] <= SCOPE))
    met = weak.join(held, ["rid", "bin"]).where((F.col("other") != F.col("role")) & near)
    found = met.groupBy("rid", "rank", "start", "end", "role").agg(F.max(F.col("other") == "id").alias("has_id"), F.max(F.col("other") == "secret").alias("has_secret"))
    return found.where(F.when(F.col("role") == "endpoint", F.col("has_id") & F.col("has_secret")).otherwise(F.col("has_id") | F.col("has_secret"))).select("rid", "rank", "start", "end")


def scan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rid (a number), doc_id and row identity (missing, id, key) of each row; rid, start, rank, end of its spans. rank is the kind's place in KINDS."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    clean = docs.select(F.col("doc_id").cast("long"), F.coalesce(row_key(F.col("text").cast("string")), F.lit(0)).alias("key"), F.regexp_replace(raw, "[\u0001-\u0003]", "\u0004").alias("t"))
    rows = written(clean.select("doc_id", F.col("doc_id").isNull().alias("missing"), F.coalesce("doc_id", F.lit(0)).alias("id"), "key", F.monotonically_increasing_id().alias("rid"), _all_pieces(F.col("t")).alias("pieces")), "pieces")
    each = rows.where(F.size("pieces") > 0).select("rid", F.explode("pieces").alias("p")).select("rid", "p.*")
    before = Window.partitionBy("rid", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("at", F.coalesce(F.sum(F.col("m") + F.col("r")).over(before), F.lit(0))).where("good")
    end = F.col("at") + F.col("m")
    start = F.when(F.col("rank") < len(BASE), F.col("at")).otherwise(end - F.col("g"))
    parts = written(each.select("rid", start.alias("start"), "rank", end.alias("end")), "parts")
    spans = parts.where(F.col("rank") < len(BASE)).unionByName(_linked(parts))
    return rows.drop("pieces"), spans


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined; empty if there is none."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ","), F.lit(""))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of ``docs`` (doc_id, text)."""
    rows, spans = scan(docs)
    span, is_base = F.struct("start", "rank", "end"), F.col("rank") < len(BASE)
    counts = [F.count_if(F.col("rank") == i).alias(f"n_{k}") for i, (k, _, _) in enumerate(BASE)]
    told = spans.groupBy("rid").agg(*counts, F.sort_array(F.collect_list(F.when(is_base, span))).alias("base"), F.sort_array(F.collect_list(span)).alias("all"))
    counted = [F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k, _, _ in BASE]
    return rows.select("rid", "doc_id").join(told, "rid", "left").select("doc_id", *counted, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"))


def _without(piece: Column, cuts: Column, mark: str) -> Column:
    """``piece`` without ``cuts`` (a, b, opens: in order, apart from one another); a mark where a cut opens."""
    upto = lambda i: F.coalesce(F.get(cuts, i)["b"], F.lit(0))
    kept = F.transform(cuts, lambda c, i: F.concat(piece.substr(upto(i - 1) + 1, c["a"] - upto(i - 1)), F.when(c["opens"], F.lit(mark)).otherwise(F.lit(""))))
    last = upto(F.size(cuts) - 1)
    return F.concat(F.array_join(kept, ""), piece.substr(last + 1, F.greatest(F.length(piece) - last, F.lit(0))))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by ``mark`` (overlapping spans by one); no document goes.

    Texts with spans are cut into chunks, each of which meets the spans that touch it.
    """
    keyed = documents_only(docs).withColumns({"missing": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0)), "key": F.coalesce(row_key(F.col("text")), F.lit(0))})
    with passing() as keep:
        rows, spans = scan(keyed)
        mine = spans.join(rows.select("rid", *IDENTITY), "rid").select(*IDENTITY, F.col("start").cast("int"), F.col("end").cast("int")).distinct()
        order = Window.partitionBy(*IDENTITY).orderBy("start", "end")
        opens = F.col("start") >= F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        runs = mine.withColumn("opens", opens).withColumn("run", F.count_if(F.col("opens")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        runs = keep(written(runs.groupBy(*IDENTITY, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")), "runs"))
        touched = keep(written(runs.select(*IDENTITY).distinct(), "touched"))
    at = F.col("chunk") * CHUNK
    cuts = runs.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / CHUNK).cast("int"), F.floor((F.col("end") - 1) / CHUNK).cast("int"))))
    cut = F.struct(F.greatest(F.col("start") - at, F.lit(0)).alias("a"), F.least(F.col("end") - at, F.lit(CHUNK)).alias("b"), (F.col("start") >= at).alias("opens"))
    cuts = cuts.groupBy(*IDENTITY, "chunk").agg(F.sort_array(F.collect_list(cut)).alias("cuts"))
    hit = keyed.join(touched, IDENTITY, "left_semi")
    chunks = hit.select(*IDENTITY, "text").dropDuplicates(IDENTITY).select(*IDENTITY, F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))).alias("chunk", "piece"))
    piece = F.when(F.col("cuts").isNull(), F.col("piece")).otherwise(_without(F.col("piece"), F.col("cuts"), mark))
    clean = chunks.join(cuts, [*IDENTITY, "chunk"], "left").groupBy(*IDENTITY).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", piece.alias("piece")))), lambda x: x["piece"]), "").alias("text"))
    out = keyed.join(touched, IDENTITY, "left_anti").select(*DOCUMENT_COLUMNS).unionByName(hit.drop("text").join(clean, IDENTITY).select(*DOCUMENT_COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long"))
