"""What plans need from the session: the package on the executors, and storage that all of them share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context; Spark serves the file."""
    sc = spark.sparkContext
    if getattr(sc, "_lectern_shipped", False):
        return
    top = Path(__file__).resolve().parent
    to = os.path.join(tempfile.mkdtemp(prefix="lectern"), "lectern.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(to)
    sc._lectern_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where that is unset on a single machine, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        found = getattr(sc, "_lectern_dir", None)
        if not found:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            found = sc._lectern_dir = tempfile.mkdtemp(prefix="lectern-shared")
    return found.rstrip("/")


_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is cut inside is removed at the end, so nothing lazy may read it later; cut(..., keep=True) leaves it to the scope around."""
    _open.append([])
    try:
        yield
    finally:
        conf = spark._jsc.hadoopConfiguration()
        for folder in _open.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def keyed(df: DataFrame) -> DataFrame:
    """df as the side of a join that has rows for each document or page: merged, never broadcast.

    Spark guesses sizes from compressed files and the share of the columns read, so millions of pages can pass for a few MB.
    """
    return df.hint("merge")


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs nothing made before."""
    spark = df.sparkSession
    to = f"{shared_dir(spark)}/lectern-{uuid.uuid4().hex}"
    scopes = _open[:-1] if keep else _open
    if scopes:
        scopes[-1].append(to)
    df.write.option("compression", "zstd").parquet(to)
    return spark.read.schema(df.schema).parquet(to)
