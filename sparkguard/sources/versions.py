"""Versions of a stored table: data files that never change, and one manifest file a version whose appearance is the commit.

A writer puts the data into a folder of its own and then renames a manifest to the next number; a reader takes the manifest with the greatest number.
A writer that dies before the rename leaves the version before it in place, and of two writers of one number the second fails.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class VersionConflict(RuntimeError):
    """Another writer committed this version first."""


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def version_numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions, ascending."""
    _, folder, fs = _hadoop(spark, f"{path}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def write_data(table: DataFrame, path: str) -> str:
    """Write a version's rows to a new folder, which nothing refers to yet; returns its name."""
    name = f"data-{uuid.uuid4().hex}"
    table.write.parquet(f"{path}/{name}")
    return name


def commit(spark: SparkSession, path: str, manifest: dict, number: int | None = None) -> int:
    """Make a manifest the next version, or the one of a number that the writer started from."""
    jvm, folder, fs = _hadoop(spark, f"{path}/manifests")
    number = number if number is not None else max(version_numbers(spark, path), default=0) + 1
    fs.mkdirs(folder)
    draft, final = (jvm.org.apache.hadoop.fs.Path(folder, name) for name in (f"draft-{uuid.uuid4().hex}", f"{number:012d}.json"))
    stream = fs.create(draft, False)
    stream.write(bytearray(json.dumps(manifest, sort_keys=True), "utf-8"))
    stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # none: fail if it is there
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, final, options)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in str(e.java_exception):
            raise VersionConflict(f"version {number} is there") from e
        raise
    return number


def manifest(spark: SparkSession, path: str, number: int | None = None) -> dict | None:
    """The manifest of a version, or of the newest; None where nothing was committed."""
    numbers = version_numbers(spark, path)
    if not numbers:
        return None
    text = spark.read.text(f"{path}/manifests/{number if number is not None else numbers[-1]:012d}.json", wholetext=True).first()[0]
    return json.loads(text)


def prune(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove all but the newest versions, manifests first, and data that no manifest names; for times without a writer."""
    jvm, folder, fs = _hadoop(spark, path)
    numbers = version_numbers(spark, path)
    for n in numbers[:-keep]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{n:012d}.json"), False)
    used = {manifest(spark, path, n)["data"] for n in numbers[-keep:]}
    for status in fs.listStatus(folder):
        if status.getPath().getName().startswith("data-") and status.getPath().getName() not in used:
            fs.delete(status.getPath(), True)
