"""Session construction and lineage checkpoints."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "affinity",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A session tuned for the operators in this package.

    AQE stays on: it coalesces small shuffles, converts joins whose measured
    build side is under ``spark.sql.adaptive.autoBroadcastJoinThreshold`` into
    broadcast joins (a runtime-checked size bound, sort-merge beyond it) and
    splits skewed join partitions.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # remove checkpoint files once the checkpointed data is no longer referenced
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # let the JIT compile generated methods above 8 KB (wide fused stages)
        "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
        "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor; the 1g default thrashes the GC
        conf["spark.driver.memory"] = os.environ.get("AFFINITY_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must name shared storage. Only a local-mode
    session without the setting (unit tests) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at shared storage "
                "(HDFS/S3/ABFS) so lineage cuts survive executor loss")
        configured = tempfile.mkdtemp(prefix="affinity-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never local).

    The input is persisted for the duration of the checkpoint: writing a
    reliable checkpoint runs a second job over the same RDD, which would
    otherwise recompute it from scratch."""
    from pyspark import StorageLevel
    checkpoint_dir(df.sparkSession)
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()


#: Seconds until the JVM knows what Python has let go of.
RELEASED_S = 1.2


def let_go(spark: SparkSession) -> None:
    """Have the shuffle files of results that nobody holds any more removed. Spark does
    that when the driver's garbage is collected, which a driver with memory to spare
    rarely does of itself; until then every finished step stays on the executors' disks.
    (What Python lets go of reaches the JVM up to a second later: of a step that ended
    just now the files may stay until the next call, so it is waited for.)"""
    import gc
    import time
    gc.collect()  # frames that Python still holds
    time.sleep(RELEASED_S)
    spark.sparkContext._jvm.System.gc()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for stage hand-offs
    written as files (never a machine-local temporary folder on a cluster)."""
    import uuid
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/affinity-{uuid.uuid4().hex}/{name}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a ``scratch_path`` of this package with its folder, whatever file system it is on."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ship_code() -> None:
    """Let Python workers run this package's functions without installing it:
    functions from ``affinity`` are pickled by value (PySpark's cloudpickle),
    so a worker never needs to import the package from its own path."""
    import sys

    from pyspark import cloudpickle
    pkg = sys.modules[__name__.rsplit(".", 1)[0]]
    try:
        cloudpickle.register_pickle_by_value(pkg)
    except ValueError:
        pass  # already registered


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors of the session (once), so that Python
    workers can import it wherever they run; modules stay modules there, with one
    copy of their tables in a worker."""
    import sys
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_affinity_shipped", False):
        return
    pkg = sys.modules[__name__.rsplit(".", 1)[0]]
    root = os.path.dirname(os.path.abspath(pkg.__file__))
    if os.path.isdir(root):  # not where the package itself came as an archive
        # the driver serves the archive itself; executors fetch it from there
        archive = os.path.join(tempfile.mkdtemp(prefix="affinity-code-"), f"{pkg.__name__}.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(root):
                for name in sorted(n for n in names if n.endswith(".py")):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join(pkg.__name__, os.path.relpath(path, root)))
        sc.addPyFile(archive)
    sc._affinity_shipped = True
