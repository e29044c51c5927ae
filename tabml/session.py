"""Spark session and shared-folder helpers.

The library never builds its own session inside an operator: every operator
takes a DataFrame and uses ``df.sparkSession``.  ``local_session`` is only for
tests, the bench and the demo entry point.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tabml") -> SparkSession:
    """A local session configured like the cluster defaults we rely on."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TABML_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used
    as is; leaving it unset there is an error, as executors cannot read a folder of the
    driver's machine.  Only a local session (tests) gets a scratch folder.
    """
    current = spark.conf.get(CHECKPOINT_CONF, None)
    if not current:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        current = current.get() if current.isDefined() else None
    if not current:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="tabml-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def shared_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


_SHIPPED: set = set()


def ship_package(spark: SparkSession, root: str | None = None, packages=("tabml",)) -> None:
    """Send the library's source to every executor (``addPyFile``), so Python
    tasks (mapInPandas, applyInPandas, pandas UDFs) can import it wherever
    the driver was started.  Done once per application and set of packages."""
    key = (spark.sparkContext.applicationId, tuple(packages))
    if key in _SHIPPED:
        return
    root = root or os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = f"{'_'.join(packages)}_{spark.sparkContext.applicationId}.zip"
    path = os.path.join(tempfile.mkdtemp(prefix="tabml-pyfiles-"), name)
    with zipfile.ZipFile(path, "w") as z:
        for pkg in packages:
            for base, _, files in os.walk(os.path.join(root, pkg)):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(base, f)
                        z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(key)
