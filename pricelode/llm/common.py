"""Small helpers shared by the operators of this package."""

import gc
import os
import tempfile
import uuid

from pyspark.sql import functions as F

#: A word, in Java and Python regular expressions alike: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark, rows=256):
    """Python workers get few rows at once, as single texts can be very long.

    The setting is the session's and stays: plans are lazy, so it must still
    hold when they run.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def _shared_folder(spark):
    """The checkpoint folder that the cluster shares: spark.checkpoint.dir. Only a local session may do without; it gets a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(place or os.path.join(tempfile.gettempdir(), "pricelode-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df):
    """Write df to the shared checkpoint folder, and read it from there.

    A lost executor costs no recomputation of what lies before.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def drop_unused(spark):
    """Have Spark remove the shuffle files and checkpoints that no table in use needs.

    It does so when the driver collects garbage, and a driver that has little to
    do hardly does; a loop of many small joins would fill the disks meanwhile.
    """
    gc.collect()  # Python's names of tables hold them in the driver
    spark.sparkContext._jvm.System.gc()


def reread(df):
    """df written as Parquet to a new folder in the shared checkpoint folder, and read again."""
    place = f"{_shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place)


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)
