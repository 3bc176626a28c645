"""The manifest: an append-only event log, its latest-wins view, and the operators that plan events.

Tables are Parquet, which has no update: a change is an event, and the state of a document is
its latest one. Every operator below maps state to a DataFrame of planned events or actions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.parsers import casefold
from ..sources.storage import checkpointed
from .rules import was_edited

#: Statuses with their labels, the format's version, how many names are tried for a note.
STATUSES = {"a_faire": "à faire", "fait": "faits", "a_verifier": "à vérifier", "echec": "en échec"}
FORMAT_VERSION = 1
MAX_TWINS = 9999

LOG_SCHEMA = (
    "seq long, sha256 string, source_name string, source_path string, original string, parent string, "
    "markdown string, status string, detail string, imported_at string, converted_at string"
)


def open_log(spark: SparkSession, path: str) -> DataFrame:
    """The event log at ``path``; a log of another format is refused."""
    log = spark.read.parquet(path)
    if "format" in log.columns and log.where(F.col("format") != FORMAT_VERSION).limit(1).count():
        raise ValueError("this manifest has another format")
    return log.drop("format")


def append(events: DataFrame, path: str) -> None:
    events.withColumn("format", F.lit(FORMAT_VERSION)).write.mode("append").parquet(path)


def latest(log: DataFrame) -> DataFrame:
    """Each document's last event. max_by has partial sums: a document with many events is no hot key."""
    rest = [c for c in log.columns if c != "sha256"]
    return log.groupBy("sha256").agg(F.max_by(F.struct(*rest), "seq").alias("x")).select("sha256", "x.*")


def listed(documents: DataFrame, *statuses: str) -> DataFrame:
    """Documents of the given statuses (all without any), in the order of listings."""
    chosen = documents.where(F.col("status").isin(*statuses)) if statuses else documents
    return chosen.orderBy("imported_at", "source_name", "sha256")


def pending(documents: DataFrame) -> DataFrame:
    return listed(documents, "a_faire")


def counts(documents: DataFrame) -> DataFrame:
    """status, n for every status, zero where there is none."""
    names = documents.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return names.join(documents.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def retried(documents: DataFrame) -> DataFrame:
    """Failures become pending again, without their detail."""
    return documents.where("status = 'echec'").withColumns({"status": F.lit("a_faire"), "detail": F.lit(None).cast("string")})


def converted(documents: DataFrame, results: DataFrame) -> DataFrame:
    """Pending documents with the result of their conversion: ``results`` has sha256, status, detail, error, at."""
    r = results.select("sha256", F.when(F.col("error").isNotNull(), "echec").otherwise(F.col("status")).alias("status"), F.coalesce("error", "detail").alias("detail"), F.col("at").alias("converted_at"))
    return documents.where("status = 'a_faire'").drop("status", "detail", "converted_at").join(r, "sha256")


def reset(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """Everything back to pending; refused (an error) when an original is missing."""
    missing = documents.join(stored, "original", "left_anti").limit(1).count()
    if missing:
        raise ValueError("originals are missing")
    none = F.lit(None).cast("string")
    return documents.withColumns({"status": F.lit("a_faire"), "markdown": none, "detail": none, "converted_at": none})


def missing_originals(documents: DataFrame, stored: DataFrame) -> DataFrame:
    return documents.join(stored, "original", "left_anti")


def locate(notes: DataFrame) -> DataFrame:
    """original -> the first note that names it, in path order (by parts, not by string). ``notes``: path, original."""
    parts = F.split("path", "/")
    return notes.where("original is not null").groupBy("original").agg(F.min_by("path", parts).alias("path"))


def ticked(documents: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Documents to verify whose first sixteen digits are ticked (``prefixes``: prefix): they are done, their detail stays."""
    found = documents.where("status = 'a_verifier'").withColumn("prefix", F.left("sha256", F.lit(16)))
    return found.join(prefixes.select("prefix").distinct(), "prefix", "left_semi").drop("prefix").withColumn("status", F.lit("fait"))


def reconvert_plan(documents: DataFrame, notes: DataFrame, done: DataFrame) -> DataFrame:
    """What a new conversion would do with each converted document: missing, already_done, edited or pending.

    ``notes``: path, original, modified; ``done``: prefix of those already done in this run. The order of the tests matters.
    """
    first = locate(notes).join(notes.select("path", "modified"), "path")
    base = documents.where(F.col("status").isin("fait", "a_verifier")).withColumn("prefix", F.left("sha256", F.lit(16)))
    told = base.join(first, "original", "left").join(done.select("prefix", F.lit(True).alias("is_done")).distinct(), "prefix", "left")
    edited = was_edited(F.col("modified"), F.to_timestamp("converted_at"))
    action = F.when(F.col("path").isNull(), "missing").when(F.col("is_done"), "already_done").when(edited, "edited").otherwise("pending")
    return told.select(*documents.columns, "path", action.alias("action"))


def reconverted(before: DataFrame, results: DataFrame) -> DataFrame:
    """Status and detail after converting again: a failure restores the old state; a ticked document (done, with a detail) stays done."""
    r = results.select("sha256", F.col("status").alias("new_status"), F.col("detail").alias("new_detail"), "error", "at")
    kept = (F.col("new_status") == "a_verifier") & (F.col("status") == "fait") & F.col("detail").isNotNull()
    joined = before.join(r, "sha256")
    failed = F.col("error").isNotNull()
    return joined.select(
        *[c for c in before.columns if c not in ("status", "detail", "converted_at")],
        F.when(failed | kept, F.col("status")).otherwise(F.col("new_status")).alias("status"),
        F.when(failed, F.col("detail")).otherwise(F.col("new_detail")).alias("detail"), F.when(failed, F.col("converted_at")).otherwise(F.col("at")).alias("converted_at"),
        F.when(failed, "failed").when(kept, "fait").otherwise(F.col("new_status")).alias("outcome"),
    )


def resumed_run(runs: DataFrame) -> DataFrame:
    """The newest run that isn't finished (``runs``: run, started, finished)."""
    return runs.where("finished is null").orderBy(F.desc("started"), F.desc("run")).limit(1)


def still_to_do(documents: DataFrame, done: DataFrame) -> DataFrame:
    return documents.withColumn("prefix", F.left("sha256", F.lit(16))).join(done, "prefix", "left_anti").drop("prefix")


def twin_name(stem: Column, n: Column) -> Column:
    return F.when(n == 1, F.concat(stem, F.lit(".md"))).otherwise(F.concat(stem, F.lit(" ("), n.cast("string"), F.lit(").md")))


def _numbers_of(names: DataFrame) -> DataFrame:
    """(folder, stem, n): how ``names`` (folder, name) can have come about, as a plain name and as a numbered twin."""
    bare = names.select("folder", F.regexp_extract("name", r"(?s)^(.*)\.md$", 1).alias("stem")).where("stem <> ''")
    twin = bare.select("folder", F.regexp_extract("stem", r"(?s)^(.*) \((\d{1,18})\)$", 1).alias("inner"), F.regexp_extract("stem", r"(?s)^(.*) \((\d{1,18})\)$", 2).alias("n")).where("n <> '' and n <> '1' and n not like '0%'")
    return bare.select("folder", "stem", F.lit(1).cast("long").alias("n")).unionByName(twin.select("folder", F.col("inner").alias("stem"), F.col("n").cast("long").alias("n"))).distinct()


def free_names(wanted: DataFrame, taken: DataFrame, most: int | None = None) -> DataFrame:
    """A free name in its folder for each of ``wanted`` (ord, folder, stem): the first of stem.md, stem (2).md, … that neither
    ``taken`` (folder, name) nor an earlier one has. A number beyond ``most``, if given, is refused (an error).

    The k-th document of a stem gets the stem's k-th free number: k and as many as there are numbers
    in use before it, counted in a window that holds both. Only where two stems spell one name
    does the earlier document win; the loser and those after it in its stem go another round.
    """
    open_, used, given = wanted.select("ord", "folder", "stem"), taken.select("folder", "name").distinct(), None
    of_stem = Window.partitionBy("folder", "stem").orderBy("ord")
    before = Window.partitionBy("folder", "stem").orderBy("k", F.desc("in_use")).rowsBetween(Window.unboundedPreceding, 0)
    while True:
        numbers = _numbers_of(used).join(open_.select("folder", "stem").distinct(), ["folder", "stem"], "left_semi")
        # The i-th number in use shifts the k-th document if it is at most the k-th free one of the i - 1 before it.
        shifts = numbers.select("folder", "stem", (F.col("n") - F.row_number().over(Window.partitionBy("folder", "stem").orderBy("n")) + 1).alias("k"), F.lit(True).alias("in_use"))
        ranked = open_.withColumn("k", F.row_number().over(of_stem).cast("long")).withColumn("in_use", F.lit(False))
        both = ranked.unionByName(shifts, allowMissingColumns=True).withColumn("n", F.col("k") + F.count_if("in_use").over(before))
        tries = both.where("not in_use").withColumn("name", twin_name(F.col("stem"), F.col("n")))
        lost = F.row_number().over(Window.partitionBy("folder", "name").orderBy("ord")) > 1
        held = tries.withColumn("lost", lost).withColumn("good", ~F.bool_or("lost").over(of_stem)).select("ord", "folder", "stem", "n", "name", "good")
        held = checkpointed(held)
        if most is not None and held.where(F.col("n") > most).limit(1).count():
            raise ValueError("too many documents of one name")
        won = held.where("good").select("ord", "folder", "stem", "name")
        given = won if given is None else given.unionByName(won)
        open_ = held.where("not good").select("ord", "folder", "stem")
        if open_.isEmpty():
            return given
        used = used.unionByName(won.select("folder", "name"))


def filed(proposals: DataFrame, folders: DataFrame) -> DataFrame:
    """``proposals`` (…, folder) beside a known folder that differs in case only (of several the last), with new_folder."""
    known = folders.withColumn("fold", casefold("folder")).groupBy("fold").agg(F.max_by("folder", "ord").alias("known"))
    told = proposals.withColumn("fold", casefold("folder")).join(known, "fold", "left").drop("fold")
    return told.withColumns({"folder": F.coalesce("known", text.safe_folder(F.col("folder"))), "new_folder": F.col("known").isNull()}).drop("known")


def visible_folders(paths: DataFrame) -> DataFrame:
    """Folders (path) without hidden parts or the inbox, sorted as strings."""
    good = F.forall(F.split("path", "/"), lambda p: (p != text.INBOX) & ~p.startswith("."))
    return paths.where(good).orderBy("path")
