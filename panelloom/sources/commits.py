"""Results that count only once they are whole: data first, a manifest last.

A manifest names the tables of a run, their rows, and a fingerprint of the configuration and
the input. A folder without one is a run that broke, and one with another fingerprint belongs
to another configuration or panel; neither is ever read as a cached result.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest.json"


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def fingerprint(config: Any, *inputs: DataFrame) -> str:
    """A digest of the configuration and of the files (name, size, time) that the inputs scan.

    Frames without files, such as checkpoints, count by their schema only; name what they
    stand for in ``config``.
    """
    parts = [json.dumps(config, sort_keys=True, default=repr)]
    for df in inputs:
        parts.append(df.schema.json())
        for file in sorted(df.inputFiles()):
            path, fs = _file_system(df.sparkSession, file)
            status = fs.getFileStatus(path)
            parts.append(f"{file} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def commit(spark: SparkSession, folder: str, about: dict) -> None:
    """Write the manifest of a folder under another name and rename it: all or nothing."""
    final, fs = _file_system(spark, f"{folder.rstrip('/')}/{MANIFEST}")
    draft, _ = _file_system(spark, f"{folder.rstrip('/')}/.{uuid.uuid4().hex}")
    stream = fs.create(draft, True)
    stream.write(bytearray(json.dumps(about), "utf-8"))
    stream.close()
    fs.delete(final, False)
    if not fs.rename(draft, final):
        raise RuntimeError(f"could not commit {folder}")


def manifest(spark: SparkSession, folder: str) -> dict | None:
    """The manifest of a folder; None where there is none."""
    path, fs = _file_system(spark, f"{folder.rstrip('/')}/{MANIFEST}")
    if not fs.exists(path):
        return None
    return json.loads(spark.read.text(path.toString(), wholetext=True).first()[0])


def read_or_compute(
    spark: SparkSession, path: str, compute: Callable[[], DataFrame], read_last: bool = True, mark: str = ""
) -> DataFrame:
    """The stored result if wanted, whole and of this fingerprint, else compute, store and read it.

    A new result is written beside the old one and replaces it with the manifest.
    """
    folder = path.rstrip("/")
    found = manifest(spark, folder) if read_last else None
    if found is None or found.get("mark") != mark:
        before = manifest(spark, folder)
        table = f"data-{uuid.uuid4().hex}"
        compute().write.parquet(f"{folder}/{table}")
        found = {"mark": mark, "table": table}
        commit(spark, folder, found)
        if before is not None:
            old, fs = _file_system(spark, f"{folder}/{before['table']}")
            fs.delete(old, True)
    return spark.read.parquet(f"{folder}/{found['table']}")


def withdraw(spark: SparkSession, root: str, model: str) -> None:
    """Take back a run's manifest before its tables are overwritten."""
    path, fs = _file_system(spark, f"{root.rstrip('/')}/_runs/{model}/{MANIFEST}")
    fs.delete(path, False)


def commit_run(spark: SparkSession, root: str, model: str, results: dict[str, DataFrame], mark: str) -> None:
    """Note a model's written result tables and their rows, after all of them are there."""
    rows = {}
    for name in results:
        stored = spark.read.parquet(f"{root.rstrip('/')}/{name}").where(F.col("model") == model)
        rows[name] = stored.count()
    commit(spark, f"{root.rstrip('/')}/_runs/{model}", {"mark": mark, "rows": rows})


def read_run(spark: SparkSession, root: str, model: str, name: str, mark: str | None = None) -> DataFrame | None:
    """One result of a committed run, or None: broken, absent or of another fingerprint."""
    found = manifest(spark, f"{root.rstrip('/')}/_runs/{model}")
    if found is None or (mark is not None and found["mark"] != mark) or name not in found["rows"]:
        return None
    stored = spark.read.parquet(f"{root.rstrip('/')}/{name}").where(F.col("model") == model).drop("model")
    return stored if stored.count() == found["rows"][name] else None
