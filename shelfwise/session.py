"""Session defaults and the shared folder that written tables live in."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scratch: dict[str, str] = {}
_cuts: dict[str, list[str]] = {}

CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("shelfwise")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # small data: still a few tasks per written table, but not many files
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.

    A cluster has to name a folder every executor can reach. Only a local
    session without the setting gets a temporary one.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = _scratch.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="shelfwise-"))
    return f"{root.rstrip('/')}/shelfwise/{sc.applicationId}"


@contextmanager
def _shuffles_end_with(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write serve nothing else, so they go with its end and do not wait until the
    driver happens to collect its garbage."""
    before = spark.conf.get(CLEANED, "false")
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANED, before)


def write_and_read(
    df: DataFrame, path: str, partition_by: str | None = None, rebalance: bool = True
) -> DataFrame:
    """Write ``df`` as Parquet, packed by zstandard, and return a scan of it: lineage ends here.

    ``rebalance`` is a shuffle that gives a few files of even size per value of ``partition_by``,
    hot values split. Without it the tasks of ``df`` have to hold few values each.
    """
    writer = df.write.mode("overwrite")
    if partition_by:
        spread = df.hint("rebalance", partition_by) if rebalance else df
        writer = spread.write.mode("overwrite").partitionBy(partition_by)
    with _shuffles_end_with(df.sparkSession):
        writer.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_place(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses; ``drop_cuts`` removes what is put there."""
    path = f"{shared_dir(spark)}/cuts/{label}-{uuid.uuid4().hex[:12]}"
    _cuts.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """A one-off written copy of an intermediate result; ``drop_cuts`` removes it."""
    return write_and_read(df, new_place(df.sparkSession, label))


def cuts_so_far(spark: SparkSession) -> int:
    return len(_cuts.get(spark.sparkContext.applicationId, []))


def drop_cuts(spark: SparkSession, prefix: str = "", since: int = 0) -> None:
    """Remove this application's written copies whose label begins with ``prefix``, but for
    the first ``since`` ones.

    Only for when every result that was computed from them has been written.
    """
    drop_these(spark, [p for p in cuts_since(spark, since) if p.rpartition("/")[2].startswith(prefix)])


def cuts_since(spark: SparkSession, since: int) -> list[str]:
    """The copies made after the first ``since`` ones."""
    return _cuts.get(spark.sparkContext.applicationId, [])[since:]


def drop_these(spark: SparkSession, gone: list[str]) -> None:
    """Remove copies by their paths; what has gone already does not matter."""
    paths = _cuts.get(spark.sparkContext.applicationId, [])
    for path in gone:
        if path not in paths:
            continue
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        paths.remove(path)
