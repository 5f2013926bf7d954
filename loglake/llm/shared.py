"""Helpers of the operators: the folder all executors share, lineage cuts, reading tables."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset a folder of our own on one machine (tests), an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_loglake_shared", None)
    if not where:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="loglake-")
        spark._loglake_shared = where
    return where.rstrip("/")


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process (``local``, ``local[8]``; not ``local-cluster``)."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: a cut of the lineage that outlives executors."""
    return df.sparkSession.read.schema(df.schema).parquet(store(df, name, **options))


def store(df: DataFrame, name: str, partition: str | None = None, **options: str) -> str:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.options(**options)
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    _written.setdefault(id(df.sparkSession.sparkContext), set()).add(path)
    return path


_written: dict[int, set[str]] = {}


def release(spark: SparkSession) -> None:
    """Deletes what the operators have stored for the results so far; for callers that have written these and read them no more."""
    for path in _written.pop(id(spark.sparkContext), set()):
        discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that ``store`` wrote and that no later plan reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release_table(spark: SparkSession, name: str) -> None:
    """Forgets a table of the catalog and deletes its files in the shared folder."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    discard(spark, f"{shared_dir(spark)}/{name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors of a cluster, once; operators with work in Python call it."""
    context = spark.sparkContext
    if not is_local(spark) and not getattr(context, "_loglake_shipped", False):
        root = Path(__file__).resolve().parents[2]
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='loglake-')}/loglake", "zip", root, "loglake"))
        context._loglake_shipped = True
