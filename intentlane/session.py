"""Session helpers: timezone-independent defaults and the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(master: str | None = None, app: str = "intentlane",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session used by tests and the bench. On a cluster the submitter's
    configuration wins; only unset knobs get local defaults."""
    master = master or os.environ.get("SPARK_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass",
                ROCKSDB)
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster
    (``spark.checkpoint.dir``); set a scratch one only when none is set,
    which happens in local tests."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="intentlane-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory, for streaming
    checkpoints and materialised intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


#: bytes of one Arrow batch between the JVM and a Python worker; Spark's default of 64 MB is held on both sides by every task
BATCH_BYTES = 4 << 20


def limit_batches(spark: SparkSession) -> None:
    """Arrow batches of about ``BATCH_BYTES``, so that neither side's memory follows
    the length of texts; a limit that the submitter has set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``intentlane`` importable in Python workers (functions pickled by
    reference into ``mapInPandas`` / state functions import it there): zip
    the package once per SparkContext and distribute it with ``addPyFile``,
    the same as ``--py-files`` on a cluster."""
    import zipfile
    limit_batches(spark)
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="intentlane-pyfiles-")
    zpath = os.path.join(out_dir, "intentlane.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)


@contextlib.contextmanager
def state_partitions(spark: SparkSession, n: int | None = None):
    """Start a stateful stream with ``n`` state partitions (default: the
    cluster's parallelism) on the RocksDB state store, which list state and
    timers need, without changing the caller's session for good. The stream
    copies the session configuration when it starts and records it in its
    checkpoint, so the previous values are restored right after ``start()``."""
    wanted = {"spark.sql.shuffle.partitions": str(n or spark.sparkContext.defaultParallelism),
              "spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    old = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
