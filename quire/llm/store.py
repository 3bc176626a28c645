"""Files in the shared folder, written and read from Python workers.

Every scheme that pyarrow opens works (file, hdfs, s3, gs). A file appears under its
name only when complete: attempts write under names of their own and are then moved,
so a lost executor or a second attempt never leaves half a file under the final name.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from urllib.parse import urlparse

from pyarrow.fs import FileSystem


def opened(uri: str):
    """(file system, inner path) of ``uri``."""
    return FileSystem.from_uri(uri if urlparse(uri).scheme else f"file://{uri}")


@contextmanager
def complete_file(uri: str):
    """A binary output stream whose content appears as ``uri`` at the end, all or nothing."""
    fs, path = opened(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}.attempt"
    try:
        with fs.open_output_stream(attempt) as out:
            yield out
        if fs.get_file_info(path).type.name == "File":
            fs.delete_file(path)  # by an earlier attempt; not every file system moves onto a file
        fs.move(attempt, path)
    except BaseException:
        if fs.get_file_info(attempt).type.name == "File":
            fs.delete_file(attempt)
        raise


def reading(uri: str):
    """A random-access input file."""
    fs, path = opened(uri)
    return fs.open_input_file(path)


def file_sizes(uri: str) -> list[tuple[str, int]]:
    """(uri, bytes) of the files right under a folder, by name."""
    from pyarrow.fs import FileSelector

    fs, path = opened(uri)
    found = fs.get_file_info(FileSelector(path))
    return sorted((f"{uri.rstrip('/')}/{x.base_name}", x.size) for x in found if x.is_file and not x.base_name.endswith(".attempt"))
