"""Commits that only one of several writers can make.

A commit is a small numbered file. Whoever has seen number ``n`` may write ``n + 1``; of
two that try, one is refused. The file appears whole or not at all: its text is written
aside and then given its name, by a hard link on a local disk and by a rename elsewhere.
The store must refuse to rename onto a file that is there, as HDFS does.
"""

from __future__ import annotations

import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_DIGITS = 12


def _store(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """A path and the store that holds it."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def commit_path(folder: str, name: str, number: int) -> str:
    """Where a commit is kept. Numbers have leading zeros, so names sort as they do."""
    return f"{folder.rstrip('/')}/{name}-{number:0{_DIGITS}d}.json"


def _link(spark: SparkSession, draft: Any, target: Any) -> bool:
    """Give a local draft its name as well; False if the name is taken."""
    jvm = spark.sparkContext._jvm
    paths = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, draft)]
    try:
        jvm.java.nio.file.Files.createLink(*paths)
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True


def try_commit(spark: SparkSession, folder: str, name: str, number: int, text: str) -> bool:
    """Write commit ``number``; False, and nothing written, if it is there already."""
    target, store = _store(spark, commit_path(folder, name, number))
    draft, _ = _store(spark, f"{folder.rstrip('/')}/_draft-{uuid.uuid4().hex}")
    stream = store.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        local, aside = (store.resolvePath(p) for p in (target.getParent(), draft))
        if local.toUri().getScheme() == "file":
            return _link(spark, aside, _store(spark, f"{local}/{target.getName()}")[0])
        return not store.exists(target) and store.rename(draft, target)
    finally:
        store.delete(draft, False)


def commit_numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The numbers of the commits of that name, ascending; none before the first."""
    pattern, store = _store(spark, f"{folder.rstrip('/')}/{name}-{'[0-9]' * _DIGITS}.json")
    found = store.globStatus(pattern) or []
    return sorted(int(f.getPath().getName()[len(name) + 1 : -len(".json")]) for f in found)


def read_commit(spark: SparkSession, folder: str, name: str, number: int) -> str:
    """The text of a commit."""
    path, store = _store(spark, commit_path(folder, name, number))
    stream = store.open(path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def child_names(spark: SparkSession, folder: str) -> list[str]:
    """The names of what lies in a folder; none if there is no such folder."""
    path, store = _store(spark, folder)
    if not store.exists(path):
        return []
    return [f.getPath().getName() for f in store.listStatus(path)]
