"""Session factory and the few session-dependent helpers the operators share."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "kilnspark", cpus: str | int = "*") -> SparkSession:
    """A local session with the settings the library expects: UTC, AQE and Arrow."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("KILN_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and stage tables.

    A cluster names a shared folder in ``spark.checkpoint.dir``; it is used as
    it is.  Only where the setting is missing on one machine (tests) a temporary
    folder is made; on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = getattr(sc, "_kiln_checkpoint_dir", None)
        if where is None:
            where = tempfile.mkdtemp(prefix="kilnspark-")
            sc._kiln_checkpoint_dir = where
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a scan at least one task per core before Python work.

    Only a scan with fewer partitions than the cluster has cores is
    repartitioned; a large input keeps its own splits and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * 2, *keys) if keys else df.repartition(cores * 2)


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, unless they find it on their path anyway."""
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [os.getcwd()]
    sc = spark.sparkContext
    if str(root) in known or getattr(sc, "_kiln_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="kilnspark-")) / "kilnspark.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "kilnspark").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(path))
    sc._kiln_shipped = True
