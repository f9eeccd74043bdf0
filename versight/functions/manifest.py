"""Versions of a folder of segments: one small JSON file each, written under a name that must not exist yet.

Of two writers that start from one version the second fails, so none overwrites the other. Segments aren't
changed once they are written; what a version doesn't name isn't part of it.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, at = file_system(spark, f"{path}/manifest")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(at)) if fs.exists(at) else []


def read(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """A version, the latest if none is named."""
    version = versions(spark, path)[-1] if version is None else version
    return json.loads(spark.read.text(f"{path}/manifest/{version}", wholetext=True).first()[0])


def commit(spark: SparkSession, path: str, told: dict) -> None:
    fs, at = file_system(spark, f"{path}/manifest/{told['version']}")
    out = fs.create(at, False)  # fails where another writer was first
    try:
        out.write(bytearray(json.dumps(told).encode()))
    finally:
        out.close()


def vacuum(spark: SparkSession, path: str, keep: dict[str, set[int]]) -> list[str]:
    """Removes the segments ``<folder>/seg=<n>`` that ``keep`` doesn't name, and all manifests but the latest; returns what went."""
    gone = []
    for what, kept in keep.items():
        fs, at = file_system(spark, f"{path}/{what}")
        for s in fs.listStatus(at) if fs.exists(at) else []:
            if int(s.getPath().getName().partition("=")[2]) not in kept:
                fs.delete(s.getPath(), True)
                gone.append(f"{what}/{s.getPath().getName()}")
    for v in versions(spark, path)[:-1]:
        fs, at = file_system(spark, f"{path}/manifest/{v}")
        fs.delete(at, False)
    return gone
