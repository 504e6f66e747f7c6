"""Session helpers: a local builder for tests and the lineage cut."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give this package to the executors' Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        at = os.path.join(tempfile.mkdtemp(prefix="strataloom-ship-"), "strataloom.zip")
        with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(here):
                for n in sorted(names):
                    if n.endswith(".py"):
                        z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(here)))
        spark.sparkContext.addPyFile(at)
        _shipped.add(app)
    return spark


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    return ship(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("strataloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``; without it, and without a
    folder set on the context, a local session gets a temporary one, and any
    other master is refused.
    """
    set_already = spark.sparkContext.getCheckpointDir()
    if set_already:
        return set_already
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="strataloom-ckpt-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write *df* to the shared checkpoint folder and continue from the files.

    Survives the loss of any executor, and is computed once however often the
    result is used.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
