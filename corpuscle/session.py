"""Session construction and the shared scratch folder."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(cpus: int | None = None, shuffle_partitions: int = 8, app: str = "corpuscle") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, pass your own session instead."""
    n = cpus or os.cpu_count() or 1
    builder = SparkSession.builder.master(f"local[{n}]").appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("CORPUSCLE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset and all runs in one process, an own one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + _own_folder())
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def _own_folder() -> str:
    """A folder of this machine that goes when the driver ends."""
    folder = tempfile.mkdtemp(prefix="corpuscle-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def materialise(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors. ``by``: columns with
    few values that the table is split by, so that a filter on them reads only its part."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/corpuscle/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=list(by) or None)
    schema = df.schema
    del df
    release(spark)
    out = spark.read.schema(schema).parquet(path)
    out._corpuscle_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise() returned, once all that was made of them is written itself."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._corpuscle_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished queries: it does when the driver's garbage is collected, which a
    driver with little to do may put off until the executors' disks are full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of an Arrow batch, in place of Spark's default: whole texts in batches of 10,000 take hundreds of megabytes on both
#: sides of the pipe to Python.
BATCH_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000")
#: Bytes of an Arrow batch; Spark's default lets long texts make batches as large as their rows allow. An explicit setting stands.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def ship(spark: SparkSession) -> None:
    """Give executors this package, once for each application: their Python workers import it. A session whose Arrow batches
    have Spark's default size gets smaller ones."""
    key, default, ours = BATCH_ROWS
    if spark.conf.get(key) == default:
        spark.conf.set(key, ours)
    key, ours = BATCH_BYTES
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, ours)
    sc = spark.sparkContext
    if getattr(sc, "_corpuscle_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(_own_folder(), "corpuscle.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("corpuscle", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._corpuscle_shipped = True


def clear_scratch(spark: SparkSession) -> None:
    """Delete every table that materialise() wrote under the shared folder."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/corpuscle")
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)
