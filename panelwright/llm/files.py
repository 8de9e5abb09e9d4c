"""Files that tasks write to and read from the shared folder, on any store Arrow knows."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyarrow import fs
from pyspark.sql import SparkSession

from ..session import shared_folder


def _locate(uri: str):
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


@contextmanager
def new_file(folder: str, name: str) -> Iterator[tuple]:
    """An output stream and the URI it will have.

    The name carries a mark of the attempt and the file moves into place when it
    is whole. Readers follow the manifest of the attempts that succeeded, so the
    remains of a lost executor are never read.
    """
    uri = f"{folder}/{uuid.uuid4().hex[:12]}-{name}"
    store, path = _locate(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path + ".open", compression=None) as out:
        yield out, uri
    store.move(path + ".open", path)


def open_stream(uri: str):
    store, path = _locate(uri)
    return store.open_input_stream(path, compression=None)


def open_random(uri: str):
    store, path = _locate(uri)
    return store.open_input_file(path)


#: Bytes of rows that a task gives to Python at once.
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """What is run in here hands rows to Python in Arrow batches of about ``size`` bytes; a larger row goes alone.

    Spark's own bound is 64 MB, of which the executor and each of its workers hold
    a few at a time, beside the heap. The session's setting is put back.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session, once per application.

    Tasks import the operators by name, so that what a worker has learned (the ids
    of frequent words) outlives one task.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    store, folder = _locate(shared_folder(spark))
    store.create_dir(f"{folder}/package", recursive=True)
    with store.open_output_stream(f"{folder}/package/{root.name}.zip", compression=None) as out:
        out.write(packed.getvalue())
    context.addPyFile(f"{shared_folder(spark)}/package/{root.name}.zip")
    _shipped.add(context.applicationId)
