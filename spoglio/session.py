"""Session defaults and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(name: str = "spoglio", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this library's defaults; any setting can be overridden by keyword (dots as `__`)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application; `spark-submit --py-files` does as well."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    here = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="spoglio-"), "spoglio.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(here.rglob("*.py")):
            z.write(source, str(source.relative_to(here.parent)))
    spark.sparkContext.addPyFile(target)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` where the cluster names one, else (tests,
    local mode) a temporary folder of this machine, which is then set as the checkpoint folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + os.path.join(tempfile.gettempdir(), "spoglio-checkpoints")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str, tidy: bool = False) -> DataFrame:
    """Cut the lineage: write the rows once to the shared folder and go on from the written table, which
    outlives any executor. The files are removed when the JVM ends, or by `discard`. With `tidy` the shuffle files of
    the write go as it ends, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spoglio-{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_TIDY, None)
    if tidy:
        spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spoglio_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of materialized tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(df._spoglio_path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
