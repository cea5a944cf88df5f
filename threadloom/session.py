"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings every job here relies on; all of them can be changed at run time.
TUNING = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where that costs one more exchange afterwards
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, wherever the job was started."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="threadloom-"), "threadloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(target)


def tune(spark: SparkSession) -> SparkSession:
    ship(spark)
    for key, value in TUNING.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    return spark


def by_true_size(spark: SparkSession) -> None:
    """Written tables of keys and positions are many times larger in memory: do not broadcast them by their file size."""
    spark.conf.set("spark.sql.sources.fileCompressionFactor", "16")


def shared_dir(spark: SparkSession) -> str:
    """Folder for written tables: what the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="threadloom-")
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir().rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once and continue from the written table.

    This cuts the lineage of iterative jobs, keeps the result when executors are lost, and gives
    the next plan true sizes to choose its join strategy from.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    for paths in _KEEPERS:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_KEEPERS: list[list[str]] = []


@contextmanager
def intermediates() -> Iterator[list[str]]:
    """The paths of all tables that :func:`materialize` writes inside the block, to be released once nobody reads them."""
    paths: list[str] = []
    _KEEPERS.append(paths)
    try:
        yield paths
    finally:
        # by identity: two lists of the same paths are equal
        del _KEEPERS[next(k for k, held in enumerate(_KEEPERS) if held is paths)]


def release(spark: SparkSession, paths: list[str], unless: DataFrame | None = None) -> None:
    """Delete written tables, also their entries in ``paths``; those that ``unless`` reads stay."""
    kept = [f for f in unless.inputFiles()] if unless is not None else []
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in list(paths):
        name = path.rsplit("/", 1)[1]
        if any(f"/{name}/" in f for f in kept):
            continue
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        paths.remove(path)
