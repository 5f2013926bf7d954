"""Session settings that the engine relies on."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "loglake", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution on; every setting can be overridden by ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": os.environ.get("LOGLAKE_UI", "false"),
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends the package to where Python workers run, once; operators with work in Python call it. Workers on one machine need it, too: they know no more of
    the driver's ``sys.path`` than others."""
    context = spark.sparkContext
    if not getattr(context, "_loglake_sent", False):
        root = Path(__file__).resolve().parents[1]
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='loglake-')}/loglake", "zip", root, "loglake"))
        context._loglake_sent = True


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset a folder of our own on one machine, an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_loglake_work", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = spark._loglake_work = "file://" + tempfile.mkdtemp(prefix="loglake-")
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: a cut of the lineage that outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
