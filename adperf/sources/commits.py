"""Small JSON files that only one writer can create: numbers, logs and journals on any Hadoop file system.

Creating a file that must not exist succeeds for one caller and fails for all
others, so numbers are handed out without a lock service, and rows of a log are
never lost between writers, as each is a file of its own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Attempts at a number before giving up; each failed one means that another writer got on.
ATTEMPTS = 1000


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def _write(files, path, content: dict) -> None:
    out = files.create(path, True)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()


def write_json(spark: SparkSession, path: str, content: dict) -> None:
    """Write or replace the file."""
    target, files = _path(spark, path)
    _write(files, target, content)


def create_once(spark: SparkSession, path: str, content: dict) -> bool:
    """Write the file unless it exists; whether this call did. Nobody ever sees half a file.

    The content goes to a hidden draft, which then gets the name: by a link on a local
    disk, by a rename elsewhere, neither of which takes a name that is in use.
    """
    target, files = _path(spark, path)
    if files.exists(target):
        return False
    files.mkdirs(target.getParent())
    draft = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_draft-{uuid.uuid4().hex}")
    _write(files, draft, content)
    try:
        if files.getScheme() != "file":
            return files.rename(draft, target)
        nio = spark._jvm.java.nio.file
        try:
            local = [spark._jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, draft)]
            nio.Files.createLink(*local)
        except Py4JJavaError:
            if files.exists(target):
                return False
            raise
        return True
    finally:
        files.delete(draft, False)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """Content of the file; None if there is none, or if the writer that replaced it did not get to the end."""
    target, files = _path(spark, path)
    if not files.exists(target):
        return None
    stream = files.open(target)
    try:
        text = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
    try:
        return json.loads(text)
    except ValueError:
        return None


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers that are taken in the folder."""
    target, files = _path(spark, folder)
    if not files.exists(target):
        return []
    names = (status.getPath().getName().partition(".")[0] for status in files.listStatus(target))
    return sorted(int(name) for name in names if name.isdigit())


def take_number(spark: SparkSession, folder: str, content: Callable[[int], dict]) -> int:
    """One more than the largest number taken in the folder, for this caller alone.

    Several callers may try the same number; one of them creates the file, the others
    go on to the next.
    """
    for _ in range(ATTEMPTS):
        number = max([0, *numbers(spark, folder)]) + 1
        if create_once(spark, f"{folder}/{number:010d}.json", content(number)):
            return number
    raise RuntimeError(f"no number could be taken in {folder}")


def log_folder(spark: SparkSession, database: str, table: str, ddl: str) -> str:
    """Folder of a table whose rows are numbered files; the table is created if need be."""
    folder = f"{spark.catalog.getDatabase(database).locationUri.rstrip('/')}/{table}_log"
    target, files = _path(spark, folder)
    files.mkdirs(target)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {database}.{table} ({ddl}) USING json "
        f"OPTIONS (recursiveFileLookup 'true') LOCATION '{folder}'"
    )
    return folder


def log_row(spark: SparkSession, database: str, table: str, ddl: str, key: str, row: Callable[[int], dict]) -> int:
    """Add a row to a table of numbered files; ``row`` gets the number within its ``key``."""
    folder = log_folder(spark, database, table, ddl)
    number = take_number(spark, f"{folder}/{quote(key, safe='')}", row)
    spark.catalog.refreshTable(f"{database}.{table}")
    return number


class Journal:
    """What the steps of a job run returned, kept by run: a rerun takes over what is there and goes on after it."""

    def __init__(self, spark: SparkSession, folder: str, run: str):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/{quote(run, safe='')}"

    def step(self, name: str, work: Callable[[], dict]) -> dict:
        """Result of the step, from the journal or by doing it now; it is a small dictionary of plain values."""
        path = f"{self.folder}/{quote(name, safe='')}.json"
        found = read_json(self.spark, path)
        if found is None:
            found = work()
            write_json(self.spark, path, found)
        return found

    def done(self, name: str) -> bool:
        return read_json(self.spark, f"{self.folder}/{quote(name, safe='')}.json") is not None
