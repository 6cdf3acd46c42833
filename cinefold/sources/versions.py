"""Numbered versions of a directory, each visible once it is complete.

A writer reserves a number N, fills `root/v=N`, and then names N as what follows the version it
started from: the file `root/versions/BASE.json`, which only one writer can create. So versions form
one chain, its end is the highest number in those files, and a reader never sees a half-written
directory. Of two writers that started from one version the later one gets a `VersionConflict`, and
has to take the other's version as its base. Numbers may be left out, where a writer stopped.
"""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Stores that create a file whole at its close and can refuse to replace one, but cannot rename.
OBJECT_STORES = ("s3a", "gs", "abfs", "abfss")
# Writers that a version loses to before it gives up.
TRIES = 20


class VersionConflict(RuntimeError):
    """Another writer was there first."""


def version_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/v={version}"


def latest_version(spark: SparkSession, root: str) -> int:
    """The highest complete version, or 0 if there is none."""
    try:
        table = spark.read.schema("version bigint").json(f"{root.rstrip('/')}/versions")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    return table.agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()["v"]


def reserve_version(spark: SparkSession, root: str, above: int, version: int | None = None) -> int:
    """A number that no other writer has, the first free one above another unless one is named."""
    wanted = [version] if version else range(above + 1, above + 1 + 1000)
    for number in wanted:
        if put_if_absent(spark, f"{root.rstrip('/')}/reserved/{number}", ""):
            return number
    raise VersionConflict(f"version {version or 'numbers'} of {root} reserved by other writers")


def commit_version(spark: SparkSession, root: str, version: int, base: int | None = None) -> None:
    """Make a completely written version visible, if the newest is still the one it was made from."""
    base = latest_version(spark, root) if base is None else base
    if version <= base:
        raise ValueError(f"version {version} is not above the published {base}")
    follows = f"{root.rstrip('/')}/versions/{base}.json"
    if not put_if_absent(spark, follows, json.dumps({"version": version})):
        raise VersionConflict(f"version {base} of {root} has a successor already")


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole text, or nothing; False if there is one already.

    On a mounted folder by a hard link, on an object store by a conditional write, elsewhere by a
    rename that does not replace. Each lets exactly one of several writers through.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    scheme = files.getUri().getScheme()
    if scheme == "file":
        return _link(target.toUri().getPath(), text)
    try:
        (_create if scheme in OBJECT_STORES else _rename)(spark, files, target, text)
    except Py4JJavaError:
        if files.exists(target):
            return False
        raise
    return True


def _link(path: str, text: str) -> bool:
    folder, name = os.path.split(path)
    os.makedirs(folder, exist_ok=True)
    # Spark reads no file whose name begins with a dot.
    made = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(made, "w") as file:
        file.write(text)
    try:
        os.link(made, path)
    except FileExistsError:
        return False
    finally:
        os.unlink(made)
    return True


def _create(spark: SparkSession, files, target, text: str) -> None:
    out = (files.createFile(target).recursive().overwrite(False)
           .opt("fs.option.create.conditional.overwrite", "true").build())
    out.write(bytearray(text, "utf-8"))
    out.close()


def _rename(spark: SparkSession, files, target, text: str) -> None:
    fs = spark._jvm.org.apache.hadoop.fs
    made = fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    out = files.create(made, False)
    out.write(bytearray(text, "utf-8"))
    out.close()
    option = getattr(fs, "Options$Rename")
    keep = spark.sparkContext._gateway.new_array(option, 1)
    keep[0] = option.NONE
    context = fs.FileContext.getFileContext(
        files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(made, target, keep)
    finally:
        files.delete(made, False)
