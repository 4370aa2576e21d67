"""Session settings and lineage cutting shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import stallwatch

# Functions sent to executors carry their code with them, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(stallwatch)

# Runtime settings the operators rely on. All are session-scoped SQL settings, so they can be
# applied to a session somebody else created.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    # Salted HMAC pads are 64-byte literals; plans, the UI and event logs show a mark in their place.
    "spark.sql.redaction.string.regex": "(?i)[0-9a-f]{128}",
    # Session windows are merged before the shuffle, so a busy key sends sessions and not rows.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    sc = spark.sparkContext
    if sc.master.startswith("local") and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        spark.conf.set("spark.sql.shuffle.partitions", str(sc.defaultParallelism))  # the untouched default suits clusters only
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "stallwatch") -> SparkSession:
    """A local session for tests and the benchmark. Clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, taking the one the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder is chosen only in local mode: on a cluster a lost executor could not
    read it back, so an unset folder is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="stallwatch-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder (used between rounds of iterative operators)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, marks that table scans pass over included."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder this library wrote, on whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    """How many ways ordered work is sliced: the cluster's shuffle width."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint folder, for tables a query writes and reads back."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """Materialise ``df`` as compressed columns below the checkpoint folder: what is read whole again, at a fraction of a checkpoint's bytes.

    Rows are read back in pieces of equal size, not in the partitions they were written in. A column of nulls only, which has no type
    to store, makes it a checkpoint.
    """
    if any(f.dataType.typeName() == "void" for f in df.schema):
        return cut_lineage(df)
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
