"""Sinks: originals by content hash, notes as files, moves. Files appear whole or not at all.

Files are written by the executors, under a folder that all of them share; names come from
content hashes or from the manifest, so a task that runs twice writes the same files.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_whole(path: str, data: bytes, read_only: bool = False) -> None:
    """Write beside the target, then move: no reader sees half a file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        f.write(data)
    if read_only:
        os.chmod(part, 0o444)
    os.replace(part, path)


def _write_rows(rows: Iterator, root: str, read_only: bool) -> None:
    for r in rows:
        path = os.path.join(root, r["path"])
        if not (read_only and os.path.exists(path)):
            write_whole(path, bytes(r["data"]), read_only)


def store_originals(sources: DataFrame, root: str) -> None:
    """Contents of ``sources`` (original, content) under ``root``, read-only; the same content is written once."""
    rows = sources.where("original is not null and content is not null").dropDuplicates(["original"]).select(F.col("original").alias("path"), F.col("content").alias("data"))
    rows.foreachPartition(lambda part: _write_rows(part, root, True))


def write_notes(notes: DataFrame, root: str) -> None:
    """``notes`` (path, markdown) under ``root``, UTF-8 with ``\\n``."""
    rows = notes.select("path", F.encode("markdown", "UTF-8").alias("data"))
    rows.foreachPartition(lambda part: _write_rows(part, root, False))


def move_note(root: str, path: str, folder: str, name: str) -> str:
    """Move a note into ``folder`` under ``name`` (see ``manifest.free_names``); its new path."""
    target = os.path.join(folder, name)
    os.makedirs(os.path.join(root, folder), exist_ok=True)
    if os.path.exists(os.path.join(root, target)):
        raise FileExistsError(target)
    os.replace(os.path.join(root, path), os.path.join(root, target))
    return target


def merged_preset(defaults: dict, current: object) -> object:
    """Defaults with the user's keys on top; anything but an object is left alone."""
    return defaults | current if isinstance(current, dict) else current
