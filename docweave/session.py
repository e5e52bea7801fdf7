"""Session helpers: building a session for tests/bench, the shared scratch
folder, and table loading."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


_SHIPPED: set[str] = set()
_CHECKPOINT_DIRS: dict[str, str] = {}  # by application, where the setting names none


def ship_package(spark: SparkSession) -> None:
    """Make ``docweave`` importable in every Python worker: zip the package
    once per application and register it with ``addPyFile`` (Spark copies it
    to each executor and puts it on the workers' path). The zip is code, not
    data: it is built on the driver and distributed by Spark."""
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="docweave-pyfiles-"), "docweave.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "docweave") -> SparkSession:
    """Session for tests and the bench. On a cluster, pass no master and let
    spark-submit configure it; everything set here is only a default."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("DOCWEAVE_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster it must be set to a shared file system; a local folder is
    picked only where it is unset and the master is local (tests, bench)."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or _CHECKPOINT_DIRS.get(sc.applicationId)
    if not d:
        current = sc.getCheckpointDir()
        if current:
            return os.path.dirname(current.rstrip("/"))
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = _CHECKPOINT_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="docweave-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Eager checkpoint into the shared checkpoint folder (never a
    machine-local one): cuts lineage and survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", f"{name}-{uuid.uuid4().hex[:12]}")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, read again, and its path. The
    shuffle files of the write go with its end: they would stay on the
    executors' disks until the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` as a table in the shared folder, read again. Unlike a checkpoint
    it carries none of the plan's constraints along, which grow from round to
    round in loops of joins."""
    out, out._written = write_table(df, name)
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the table of ``written`` that ``df`` is, which no later step reads."""
    if path := getattr(df, "_written", None):
        delete_table(df.sparkSession, path)


def delete_table(spark: SparkSession, path: str) -> None:
    """Deletes a written table that no later step reads, by Spark's file system."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
