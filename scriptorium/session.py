"""Session, tables and shared storage used by every plan."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "scriptorium", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings the plans rely on (UTC, AQE, Arrow)."""
    n = os.cpu_count() if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that their Python workers can import
    it wherever they run. Spark's own file server hands it out."""
    sc = spark.sparkContext
    if getattr(sc, "_scriptorium_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="scriptorium-ship-")  # on the driver, which serves the file
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "scriptorium.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(f.relative_to(root.parent)))
    sc.addPyFile(path)
    sc._scriptorium_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; NTZ timestamps stay as they are stored."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in spark.checkpoint.dir. Only where all work is done on this machine (a local
    master: tests, small runs) and it is unset, a temporary folder is chosen, once per session; a
    cluster without the setting is an error, since other machines couldn't read such a folder.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    ours = spark.conf.get("spark.scriptorium.shared.dir", None)
    if not ours:
        ours = tempfile.mkdtemp(prefix="scriptorium-")
        spark.conf.set("spark.scriptorium.shared.dir", ours)
    return ours


#: Removes the shuffled files of a query as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str = "t", tidy: bool = False) -> DataFrame:
    """Write df once to the shared folder and read it back.

    Cuts the lineage, so that a result used several times is computed once and survives the loss of
    an executor. The files go when the session's JVM ends. tidy: what was shuffled for it is removed at
    once, not when the driver happens to collect its garbage; what else shares df's plan shuffles again.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark).rstrip('/')}/scriptorium-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    if tidy:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy and before is None:
            spark.conf.unset(CLEANUP)
        elif tidy:
            spark.conf.set(CLEANUP, before)
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark df for broadcast if it has at most max_rows rows, which is counted; else leave the join
    to the optimizer (shuffled). df should be materialized or cheap, since it is counted."""
    few = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if few else df
