"""Session defaults, and the folder that a cluster shares for intermediate tables."""

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(app="pricelode", cores="8", memory="8g", partitions="8"):
    """A local session with UTC timestamps; a cluster supplies its own instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", os.environ.get("SPARK_LOCAL_DIRS", "/tmp/pricelode-local"))
        .getOrCreate()
    )


def shared_folder(spark, name):
    """A new folder's path below the checkpoint folder of the session, which a cluster must set; a local session may do without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "pricelode-shared")
    return f"{base}/pricelode-{name}-{uuid.uuid4().hex}"


_HELD = {}


def held(df, name="table"):
    """df written once as Parquet to the shared folder, and read from there by all that use it, until release()."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    _HELD.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return spark.read.parquet(folder)


def release(spark):
    """Remove the tables that held has written for this application; results that read them must have been used. Returns how many."""
    folders = _HELD.pop(spark.sparkContext.applicationId, [])
    path = spark._jvm.org.apache.hadoop.fs.Path
    for folder in folders:
        at = path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(folders)
