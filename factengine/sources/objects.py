"""Objects by content: bytes are put under the name of their hash, and what is there already is used again."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Attempts to write an object, those under its own name, and waits in seconds that double from one to the next.
ATTEMPTS, CANONICAL, WAIT, LOOKUPS, LOOKUP_WAIT = 4, 2, 0.4, 4, 0.2


def retried(call: Callable, attempts: int = LOOKUPS, wait: float = LOOKUP_WAIT, pause: Callable[[float], None] = time.sleep):
    """The call's result; an input or output error is tried again after ever longer waits."""
    for n in range(attempts):
        try:
            return call()
        except OSError:
            if n + 1 == attempts:
                raise
            pause(wait * 2**n)


def put_object(files: fs.FileSystem, root: str, name: str, data: bytes, pause: Callable[[float], None] = time.sleep) -> tuple[str, bool]:
    """``(name, reused)`` of the bytes stored under a name, which is that of their hash, so an object of that name is theirs.

    It is written beside its place and moved there whole. A write that fails is tried again; later attempts take names with
    ``#1``, ``#2`` behind them, in case nothing can be written under the first.
    """
    failure: OSError | None = None
    for n in range(ATTEMPTS):
        own = name if n < CANONICAL else f"{name}#{n - CANONICAL + 1}"
        if retried(lambda: files.get_file_info(f"{root}/{own}"), pause=pause).type == fs.FileType.File:  # noqa: B023
            return own, True
        beside = f"{root}/.{own}.{uuid.uuid4().hex}"
        try:
            with files.open_output_stream(beside, compression=None) as out:
                out.write(data)
            files.move(beside, f"{root}/{own}")
            return own, False
        except OSError as error:
            failure = error
            pause(WAIT * 2**n)
    raise OSError(f"{name} could not be stored in {ATTEMPTS} attempts") from failure


def put_objects(rows: DataFrame, uri: str, name: Column, content: str = "content") -> DataFrame:
    """``(name, stored_as, reused)`` per distinct name of ``rows``; each task puts its own rows, null contents are left out.

    ``uri`` names a folder that all executors reach.
    """
    named = rows.select(name.alias("name"), F.col(content).alias("content")).where("name is not null and content is not null").dropDuplicates(["name"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(uri)
        files.create_dir(root, recursive=True)
        for batch in batches:
            done = [put_object(files, root, n.replace(":", "-"), c) for n, c in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.bool_())], ["name", "stored_as", "reused"])

    return named.mapInArrow(run, "name string, stored_as string, reused boolean")
