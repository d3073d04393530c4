"""Pages and the cursor of what they tell, published together or not at all.

A folder holds ``versions/N/`` and ``manifests/N.json``.  A version is written
whole first; the manifest that names it is written aside and renamed, which
happens at once.  Whoever reads sees the last manifest, so a run that dies
before the rename has changed nothing, and the next one starts where the last
manifest's cursor stands.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another run published first."""


@dataclass
class Published:
    version: int
    cursor: str | None
    folder: str | None


def _system(spark: SparkSession, folder: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), lambda *names: spark._jvm.org.apache.hadoop.fs.Path("/".join([folder.rstrip("/"), *names]))


def current(spark: SparkSession, folder: str) -> Published:
    """What is published; version 0 before anything is."""
    system, path = _system(spark, folder)
    if not system.exists(path("manifests")):
        return Published(0, None, None)
    names = [f.getPath().getName() for f in system.listStatus(path("manifests"))]
    last = max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit()), default=0)
    if not last:
        return Published(0, None, None)
    stream = system.open(path("manifests", f"{last}.json"))
    try:
        found = json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
    return Published(last, found["cursor"], f"{folder.rstrip('/')}/{found['version']}")


def publish(spark: SparkSession, folder: str, cursor: str, write: Callable[[str, Published], None]) -> Published:
    """Let ``write`` fill a new version's folder, given what is published so far, then commit it with ``cursor``.

    If ``write`` fails nothing has changed and what it wrote is deleted.  Of two
    runs that start from the same version one commits, the other is a ``Conflict``.
    """
    system, path = _system(spark, folder)
    before = current(spark, folder)
    name = f"versions/{before.version + 1}-{uuid.uuid4().hex}"
    try:
        write(f"{folder.rstrip('/')}/{name}", before)
        aside = path("manifests", f"_{uuid.uuid4().hex}")
        out = system.create(aside, True)
        out.write(json.dumps({"version": name, "cursor": cursor}).encode())
        out.close()
        target = path("manifests", f"{before.version + 1}.json")
        if system.exists(target) or not system.rename(aside, target):
            system.delete(aside, False)
            raise Conflict(f"version {before.version + 1} of {folder} is published already")
    except BaseException:
        system.delete(path(name), True)
        raise
    return current(spark, folder)


def publish_pages(pages: DataFrame, folder: str, cursor: str) -> Published:
    """``pages`` (name, at, line: lines of each page in order) as one text file a page, with the cursor."""

    def write(version: str, before: Published) -> None:
        lines = pages.selectExpr("name", "at", "line").repartition("name").sortWithinPartitions("name", "at")
        lines.select("name", "line").write.partitionBy("name").text(version)

    return publish(pages.sparkSession, folder, cursor, write)


def tidy(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Delete versions that no manifest of the last ``keep`` names, leavings of dead runs among them; how many."""
    system, path = _system(spark, folder)
    now = current(spark, folder)
    named = set()
    for n in range(max(1, now.version - keep + 1), now.version + 1):
        stream = system.open(path("manifests", f"{n}.json"))
        named.add(json.loads(bytes(stream.readAllBytes()).decode())["version"])
        stream.close()
    gone = [f.getPath() for f in system.listStatus(path("versions")) if f"versions/{f.getPath().getName()}" not in named] if system.exists(path("versions")) else []
    for at in gone:
        system.delete(at, True)
    return len(gone)
