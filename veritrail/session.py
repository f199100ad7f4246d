"""Session settings and cutting of lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "veritrail", master: str | None = None, **conf: str) -> SparkSession:
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once per application; Spark copies the archive to the executors."""
    sc = spark.sparkContext
    if getattr(sc, "_veritrail_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="veritrail-code-")) / "veritrail.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(archive))
    sc._veritrail_shipped = True


def prepare(spark: SparkSession) -> SparkSession:
    """Workers get the package; all time arithmetic assumes UTC, whatever the session was built with."""
    ship(spark)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for cut lineage: the one the cluster names in spark.checkpoint.dir.

    A private folder is used only where the setting is absent in local mode (tests): executors on other
    machines could not see it, so there the setting is required.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="veritrail-shared-")
        sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a frame that a loop reads many times as a table in the shared folder and read it back.

    The rows are computed once, survive the loss of executors, and come back columnar with their
    sizes known to the planner.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/veritrail-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.parquet(path)
    table._veritrail_path = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables that cut_lineage wrote and that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_veritrail_path", None)
        if path:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished tables in a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(f.getPath().getName() for f in files.listStatus(where) if files.exists(done(f.getPath(), "_SUCCESS")))
