"""Stored tables that are replaced as a whole: versions beside one another, and a pointer.

A table is a folder with one folder per version and one empty marker file per finished version,
``_current/<number>``. A load writes the next version and creates its marker last, which is one
step of the file system; the marker of the highest number says what readers see. So a load killed
half way leaves the old version current, a reader that has planned its scan keeps its files until
``keep`` newer versions exist, and what a killed load has left is removed by the next.

One writer per table at a time: two at once would take the same number, and the later marker
fails because it exists already.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

KEEP = 2


def _system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _children(spark: SparkSession, path: str) -> list[str]:
    system, place = _system(spark, path)
    return [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []


def _delete(spark: SparkSession, path: str) -> None:
    system, place = _system(spark, path)
    system.delete(place, True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all finished versions, oldest first."""
    return sorted(int(n) for n in _children(spark, f"{path}/_current") if n.isdigit())


def current_path(spark: SparkSession, path: str) -> str:
    """The folder of the version that readers see."""
    finished = versions(spark, path)
    if not finished:
        raise FileNotFoundError(f"no finished version of {path}")
    return f"{path}/version={finished[-1]:06d}"


def read_current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(current_path(spark, path))


class Replacement:
    """The next version of a table: write into ``path``, then ``publish`` it."""

    def __init__(self, spark: SparkSession, table: str, keep: int = KEEP):
        self.spark, self.table, self.keep = spark, table, keep
        finished = versions(spark, table)
        self.number = finished[-1] + 1 if finished else 1
        self.path = f"{table}/version={self.number:06d}"
        _delete(spark, self.path)  # left by a load that did not finish

    def publish(self) -> None:
        system, marker = _system(self.spark, f"{self.table}/_current/{self.number:06d}")
        system.create(marker, False).close()
        for old in versions(self.spark, self.table)[: -self.keep]:
            # the marker goes first: a version without one is no version
            _delete(self.spark, f"{self.table}/_current/{old:06d}")
            _delete(self.spark, f"{self.table}/version={old:06d}")


def replace_versioned(df: DataFrame, table: str, keep: int = KEEP) -> int:
    """Replace a stored table; the row count is observed while it is written."""
    seen = Observation()
    own = Replacement(df.sparkSession, table, keep)
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(own.path)
    rows = seen.get["rows"]
    own.publish()
    return rows


# -- manifests ------------------------------------------------------------------------


def files_below(spark: SparkSession, folders: list[str]) -> list[tuple[str, int, int]]:
    """Path, length and time of the files in ``folders``, hidden ones left out."""
    found = []
    for folder in sorted(folders):
        system, place = _system(spark, folder)
        if system.exists(place):
            for s in system.listStatus(place):
                name = s.getPath().getName()
                if s.isFile() and not name.startswith(("_", ".")):
                    found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(found)


def stamp_of(files: list[tuple[str, int, int]]) -> str:
    return hashlib.sha1(json.dumps(files).encode()).hexdigest()


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    system, place = _system(spark, path)
    out = system.create(place, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    system, place = _system(spark, path)
    if not system.exists(place):
        return None
    stream = system.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
