"""Versions of a stored thing: written aside, then published at once.

A folder holds versions and marks. A writer fills a version's folder of its own
and publishes it by creating an empty mark, whose name is a rising number and the
version. Creating one file is a single step on every file system, so readers see
the former version or the new one, whatever becomes of the writer. Published
versions are never written to; of two writers with the same number the greater
name wins, for all readers alike.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession

_MARKS, _MANIFEST = "_published", "manifest"
_MARK = re.compile(r"(\d{12})-(v-[0-9a-f]{32})")


def _system(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    return named.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), named


def _marks(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """Number and version of every mark, the latest last."""
    system, path = _system(spark, f"{folder.rstrip('/')}/{_MARKS}")
    if not system.exists(path):
        return []
    names = [status.getPath().getName() for status in system.listStatus(path)]
    return sorted(m.groups() for m in map(_MARK.fullmatch, names) if m)


def current(spark: SparkSession, folder: str) -> str | None:
    """The folder of the published version, or None."""
    marks = _marks(spark, folder)
    return f"{folder.rstrip('/')}/{marks[-1][1]}" if marks else None


def publish(spark: SparkSession, folder: str, write: Callable[[str], dict]) -> str:
    """Let ``write`` fill the folder of a new version, and publish it with the manifest it returns.

    If ``write`` fails nothing is published.
    """
    root, version = folder.rstrip("/"), f"v-{uuid.uuid4().hex}"
    path = f"{root}/{version}"
    manifest = json.dumps(write(path), sort_keys=True)
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{path}/{_MANIFEST}")
    marks = _marks(spark, folder)
    number = int(marks[-1][0]) + 1 if marks else 1
    system, mark = _system(spark, f"{root}/{_MARKS}/{number:012d}-{version}")
    if not system.createNewFile(mark):
        raise RuntimeError(f"{path} could not be published")
    return path


def manifest(spark: SparkSession, version: str) -> dict:
    """What the writer of a version said about it."""
    return json.loads(spark.read.text(f"{version}/{_MANIFEST}").first()["value"])


def forget_old(spark: SparkSession, folder: str, keep: int = 1) -> int:
    """Delete all but the last ``keep`` published versions; to be called when nobody reads them any more.

    Versions that were never published stay: their writers may still be at work.
    """
    old = _marks(spark, folder)[:-keep]
    for number, version in old:
        # The mark goes first, so that no reader is sent to a version that is gone.
        for name in (f"{_MARKS}/{number}-{version}", version):
            system, path = _system(spark, f"{folder.rstrip('/')}/{name}")
            system.delete(path, True)
    return len(old)
