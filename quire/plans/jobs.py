"""Jobs over a corpus folder: import, conversion, reconversion, checklist, statistics.

A corpus has ``.corpus/log`` (the event log), ``originaux/`` (contents by hash), ``corpus/``
(notes; new ones in its inbox) and a checklist. Executors and driver share the folder. A job
that dies leaves events of what was done; run again, it does the rest: documents are registered
before they are converted, and a note's path is known from its document.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup, text
from ..operators import ingest, manifest, measures, rules
from ..sources import files, sinks
from ..sources.storage import checkpointed
from . import report

CHECKLIST = "À vérifier.md"
INTRO = "Cette liste est réécrite à chaque import : n'y notez rien d'autre."
FIELDS = [f.split()[0] for f in manifest.LOG_SCHEMA.split(", ")]


def log_path(root: str) -> str:
    return os.path.join(root, ".corpus", "log")


def find_root(start: str) -> str:
    """The nearest folder at or above ``start`` that is a corpus."""
    here = os.path.abspath(start)
    while not os.path.isdir(os.path.join(here, ".corpus")):
        if here == os.path.dirname(here):
            raise FileNotFoundError("no corpus here")
        here = os.path.dirname(here)
    return here


def documents(spark: SparkSession, root: str) -> DataFrame:
    if not os.path.isdir(log_path(root)):
        return spark.createDataFrame([], manifest.LOG_SCHEMA)
    return manifest.latest(manifest.open_log(spark, log_path(root))).select(*FIELDS)


def stored(spark: SparkSession, root: str) -> DataFrame:
    """original, length of the originals that are there."""
    folder = os.path.join(root, "originaux")
    found = [(f"originaux/{e.name}", e.stat().st_size) for e in os.scandir(folder) if e.is_file()] if os.path.isdir(folder) else []
    return spark.createDataFrame(found, "original string, length long")


def _record(events: DataFrame, root: str) -> None:
    """Append events, after all that are there."""
    spark = events.sparkSession
    last = manifest.open_log(spark, log_path(root)).agg(F.max("seq")).first()[0] or 0 if os.path.isdir(log_path(root)) else 0
    manifest.append(events.withColumn("seq", F.lit(last + 1).cast("long")).select(*FIELDS), log_path(root))


def register(spark: SparkSession, root: str, paths: list[str], now: str) -> dict[str, int]:
    """Register files and what is attached to e-mails; the number of each outcome."""
    told = checkpointed(ingest.with_attachments(files.with_content(files.listed(spark, paths), ingest.SUPPORTED)))
    known = checkpointed(documents(spark, root))
    out = checkpointed(ingest.outcomes(told, known, stored(spark, root).select("original")))
    fresh = out.where(F.col("outcome").isin("added", "restored"))
    sinks.store_originals(told.join(fresh.select("ord", "sub_ord"), ["ord", "sub_ord"], "left_semi"), root)
    none = F.lit(None).cast("string")
    added = fresh.where("outcome = 'added'").select("sha256", F.col("name").alias("source_name"), F.col("path").alias("source_path"), "original", "parent", none.alias("markdown"), F.lit("a_faire").alias("status"), none.alias("detail"), F.lit(now).alias("imported_at"), none.alias("converted_at"))
    again = manifest.retried(known.join(fresh.where("outcome = 'restored'").select("sha256"), "sha256", "left_semi"))
    _record(added.unionByName(again.select(*added.columns)), root)
    return {r["outcome"]: r["n"] for r in ingest.tally(out).collect()}


def _contents(docs: DataFrame, root: str) -> DataFrame:
    """``docs`` with suffix and content from the stored originals."""
    spark = docs.sparkSession
    listing = files.listed(spark, [os.path.join(root, "originaux")]).withColumn("original", F.concat(F.lit("originaux/"), "name")).join(docs.select("original").distinct(), "original", "left_semi")
    read = files.with_content(listing, ingest.SUPPORTED).select(F.concat(F.lit("originaux/"), "name").alias("original"), "content")
    return docs.join(read, "original", "left").withColumn("suffix", text.suffix(F.col("original")))


def _results(docs: DataFrame, root: str, now: str, readers: dict[str, files.Reader] | None) -> DataFrame:
    """sha256, status, detail, error, at and markdown text of each document's conversion."""
    read = checkpointed(files.extracted(_contents(docs, root), readers).select("sha256", "pages", "error"))
    pages = read.where("error is null").select(F.col("sha256").alias("doc_key"), F.explode("pages").alias("p")).select("doc_key", "p.*")
    told = rules.review_status(pages).withColumnRenamed("doc_key", "sha256")
    joined = read.join(told, "sha256", "left").select("sha256", F.coalesce("status", F.lit("fait")).alias("status"), "detail", "error", F.lit(now).alias("at"), markup.to_markdown(F.col("pages")).alias("body"))
    return joined


def _full_notes(docs: DataFrame, results: DataFrame, everything: DataFrame) -> DataFrame:
    """path (in the corpus folder) and markdown of converted documents."""
    parents = everything.select(F.col("sha256").alias("parent"), F.col("original").alias("parent_original"))
    joined = docs.join(results.where("error is null").select("sha256", "body"), "sha256").join(parents, "parent", "left")
    front = markup.front_matter(F.col("original"), F.col("source_name"), F.col("parent_original"), F.col("imported_at"))
    return joined.select(F.concat(F.lit("corpus/"), "markdown").alias("path"), F.concat(front, "body").alias("markdown"))


def convert_pending(spark: SparkSession, root: str, now: str, readers: dict[str, files.Reader] | None = None) -> dict[str, int]:
    """Convert what is pending; the number of each status. A failure is a status, with its reason."""
    everything = checkpointed(documents(spark, root))
    waiting = everything.where("status = 'a_faire'")
    if waiting.isEmpty():
        return {}
    results = checkpointed(_results(waiting, root, now, readers))
    good = waiting.join(results.where("error is null").select("sha256"), "sha256", "left_semi")
    order = F.concat_ws("\u0000", "imported_at", "source_name", "sha256")
    stem = text.safe_name(F.regexp_replace("source_name", r"(?<=[^/.])\.[^./]+$", ""))
    wanted = good.where("markdown is null").select(order.alias("ord"), F.lit(text.INBOX).alias("folder"), stem.alias("stem"), "sha256")
    on_disk = [(os.path.dirname(p), os.path.basename(p)) for p in _note_paths(root)]
    recorded = everything.where("markdown is not null").select(F.regexp_extract("markdown", "^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("markdown", "([^/]*)$", 1).alias("name"))
    names = manifest.free_names(wanted.drop("sha256"), spark.createDataFrame(on_disk, "folder string, name string").unionByName(recorded), manifest.MAX_TWINS)
    placed = wanted.join(names.select("ord", "name"), "ord").select("sha256", F.concat("folder", F.lit("/"), "name").alias("new_path"))
    good = checkpointed(good.join(placed, "sha256", "left").withColumn("markdown", F.coalesce("markdown", "new_path")).drop("new_path"))
    failed = waiting.join(results.where("error is not null").select("sha256"), "sha256", "left_semi")
    # Paths are recorded before notes are written: a run that was cut off in between writes the same files.
    _record(good.join(placed.select("sha256"), "sha256", "left_semi"), root)
    sinks.write_notes(_full_notes(good, results, everything), root)
    done = checkpointed(manifest.converted(good.unionByName(failed.select(*good.columns)), results))
    _record(done, root)
    return {r["status"]: r["n"] for r in done.groupBy("status").agg(F.count("*").alias("n")).collect()}


def import_paths(spark: SparkSession, root: str, paths: list[str], clock: Callable[[], str], readers: dict[str, files.Reader] | None = None, retry: bool = False) -> dict[str, dict[str, int]]:
    """Import files and folders (none: resume), convert, rewrite the checklist."""
    told = register(spark, root, paths, clock()) if paths else {}
    if retry:
        _record(checkpointed(manifest.retried(documents(spark, root))), root)
    converted = convert_pending(spark, root, clock(), readers)
    return {"outcomes": told, "converted": converted, "checked": {"n": sync_checklist(spark, root)}}


def _note_paths(root: str) -> list[str]:
    folder = os.path.join(root, "corpus")
    return [os.path.relpath(p, folder) for p in files.walk([folder]) if p.endswith(".md")] if os.path.isdir(folder) else []


def notes(spark: SparkSession, root: str) -> DataFrame:
    folder = os.path.join(root, "corpus")
    os.makedirs(folder, exist_ok=True)
    return files.notes(spark, folder)


def located(spark: SparkSession, root: str) -> DataFrame:
    """Documents with the note found for each (path, null if none), its text and whether it can be read."""
    found = checkpointed(notes(spark, root))
    first = manifest.locate(found).join(found.select("path", "readable", F.col("markdown").alias("note")), "path")
    return documents(spark, root).join(first, "original", "left")


def sync_checklist(spark: SparkSession, root: str) -> int:
    """Record ticked boxes and rewrite the list; the number of documents newly checked."""
    path = os.path.join(root, CHECKLIST)
    there = os.path.exists(path)
    prefixes = report.ticked_prefixes(open(path, encoding="utf-8").read()) if there else []
    docs = documents(spark, root)
    n = 0
    if prefixes:
        told = checkpointed(manifest.ticked(docs, spark.createDataFrame([(p,) for p in prefixes], "prefix string")))
        n = told.count()
        _record(told, root)
    now = located(spark, root)
    if there or not now.where(F.col("status").isin("a_verifier", "echec")).isEmpty():
        sinks.write_whole(path, report.checklist(now.withColumn("path", F.concat(F.lit("corpus/"), "path")), INTRO).encode())
    return n


def statistics(spark: SparkSession, root: str) -> list[str]:
    docs = documents(spark, root)
    done = located(spark, root).where(F.col("status").isin("fait", "a_verifier"))
    places = measures.placement(done.select("path", "readable"), text.INBOX)
    return report.statistics(docs, stored(spark, root), places, done.where("note is not null").select(F.col("sha256").alias("doc_key"), F.col("note").alias("markdown")))


def reconvert(spark: SparkSession, root: str, clock: Callable[[], str], readers: dict[str, files.Reader] | None = None, dry_run: bool = True) -> dict[str, int]:
    """Convert again what nobody has edited, after setting the old notes aside; with ``dry_run`` only the plan's counts.

    A run that was cut off goes on where it was: its folder lists what is done.
    """
    folder = os.path.join(root, ".corpus", "reconversions")
    open_runs = sorted(r for r in (os.listdir(folder) if os.path.isdir(folder) else []) if not os.path.exists(os.path.join(folder, r, "terminee")))
    run = os.path.join(folder, open_runs[-1] if open_runs else clock().replace(":", "-"))
    finished = [f.removesuffix(".md") for f in os.listdir(run) if f.endswith(".done.md")] if os.path.isdir(run) else []
    done = spark.createDataFrame([(f.removesuffix(".done"),) for f in finished], "prefix string")
    docs = checkpointed(documents(spark, root))
    plan = checkpointed(manifest.reconvert_plan(docs, notes(spark, root), done))
    counts = {r["action"]: r["n"] for r in plan.groupBy("action").agg(F.count("*").alias("n")).collect()}
    todo = plan.where("action = 'pending'").drop("action").withColumn("markdown", F.col("path")).drop("path")
    if dry_run or todo.isEmpty():
        return counts
    old = notes(spark, root).join(todo.select(F.col("markdown").alias("path"), F.left("sha256", F.lit(16)).alias("prefix")), "path")
    sinks.write_notes(old.select(F.concat("prefix", F.lit(".md")).alias("path"), "markdown"), run)
    results = checkpointed(_results(todo, root, clock(), readers))
    after = checkpointed(manifest.reconverted(todo, results))
    # Recorded before they are written: notes of a run that was cut off aren't taken for edited ones.
    _record(after.drop("outcome"), root)
    sinks.write_notes(_full_notes(todo.select(*FIELDS), results, docs), root)
    sinks.write_notes(after.select(F.concat(F.left("sha256", F.lit(16)), F.lit(".done.md")).alias("path"), F.lit("").alias("markdown")), run)
    sinks.write_whole(os.path.join(run, "terminee"), clock().encode())
    return counts | {f"now_{r['outcome']}": r["n"] for r in after.groupBy("outcome").agg(F.count("*").alias("n")).collect()}


#: What a reset leaves in place.
KEPT = {".corpus", "originaux", ".obsidian"}


def reset(spark: SparkSession, root: str, clock: Callable[[], str], dry_run: bool = True) -> dict[str, int]:
    """Set all notes and lists aside under ``.corpus/reinitialisations`` and make every document pending; with ``dry_run`` only the plan's counts.

    Refused while an original is missing. Cut off, it can be run again: what was set aside stays there.
    """
    docs = checkpointed(documents(spark, root))
    plan = report.reset_plan(docs, notes(spark, root).select("path"))
    fresh = checkpointed(manifest.reset(docs, stored(spark, root).select("original")))
    if dry_run:
        return plan
    aside = os.path.join(root, ".corpus", "reinitialisations", clock()[:19].replace(":", "-"))
    os.makedirs(aside, exist_ok=True)
    for name in sorted(set(os.listdir(root)) - KEPT):
        os.replace(os.path.join(root, name), os.path.join(aside, name))
    os.makedirs(os.path.join(root, "corpus", text.INBOX), exist_ok=True)
    _record(fresh, root)
    return plan


def move(spark: SparkSession, root: str, sha256: str, folder: str, name: str) -> str:
    """File a document's note under ``folder``; its new path in the corpus folder."""
    where = spark.range(1).select(text.safe_folder(F.lit(folder)).alias("f"), text.safe_name(F.lit(name)).alias("n")).first()
    if where["f"] is None:
        raise ValueError("no such destination")
    here = located(spark, root).where(F.col("sha256") == sha256).select("path").first()
    taken = spark.createDataFrame([(os.path.dirname(p), os.path.basename(p)) for p in _note_paths(root)], "folder string, name string")
    free = manifest.free_names(spark.createDataFrame([("0", where["f"], where["n"])], "ord string, folder string, stem string"), taken, manifest.MAX_TWINS).first()["name"]
    target = sinks.move_note(os.path.join(root, "corpus"), here["path"], where["f"], free)
    _record(checkpointed(documents(spark, root).where(F.col("sha256") == sha256).withColumn("markdown", F.lit(target))), root)
    return target
