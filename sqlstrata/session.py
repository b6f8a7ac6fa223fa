"""Session helpers.

On a cluster the session is created by the platform; these helpers only fill
in settings that are still unset, so cluster values always win.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings we rely on; applied only where the running session has no value.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # joins on (query_id, ...) reuse an existing query_id partitioning
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "sqlstrata", conf: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one (tests, bench) with
    the defaults below plus ``conf``."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.driver.memory", os.environ.get("SQLSTRATA_DRIVER_MEMORY", "6g"))
          .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**_DEFAULTS, **(conf or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only a local session (tests, bench), whose tasks run on this machine, gets
    a scratch folder where none is set; it is removed when Python ends. On a
    cluster an unset folder is an error: executors would not see a local one.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set, and {master or 'this session'} needs a folder that all executors share")
        d = tempfile.mkdtemp(prefix="sqlstrata-ckpt-")
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def materialize(df):
    """Write ``df`` to the shared checkpoint folder and continue from there.

    Cuts the lineage (a lost executor recomputes from the checkpoint, not
    from the corpus) and lets a log that several operators read be computed
    once. Reliable ``checkpoint()``, never ``localCheckpoint()``.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_code(spark: SparkSession) -> None:
    """Give the executors' Python this package (once per context), so that
    tasks import it wherever the driver was started and whatever is installed."""
    sc = spark.sparkContext
    if getattr(sc, "_sqlstrata_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="sqlstrata-pkg-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "sqlstrata-package"), "zip", os.path.dirname(root), os.path.basename(root)))
    sc._sqlstrata_shipped = True


def ship_package(spark: SparkSession) -> None:
    """``ship_code``, for operators whose tasks hold whole batches of long texts: also
    bounds the rows of an Arrow batch where the session has Spark's own
    default, which is made for narrow rows: 10,000 long texts are held several
    times over, in the JVM and in Python."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch, "10000") == "10000":
        spark.conf.set(batch, "1000")
    ship_code(spark)
