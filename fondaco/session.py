"""Session helpers: table access, checkpoints in the shared folder, size checks before a broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast by hint only when its rows are counted and stay under this many.
BROADCAST_ROWS = 200_000


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the queries are written for."""
    b = (
        SparkSession.builder.master(master)
        .appName("fondaco")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the test data; column pruning and filters reach its scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder: the cluster's ``spark.checkpoint.dir`` when it is set.

    A folder of this machine is set only where neither the context nor the configuration names one and the
    master is local, as in tests.
    """
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    conf = sc.getConf().get("spark.checkpoint.dir")
    if conf:
        sc.setCheckpointDir(conf)
        return conf
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="fondaco-ckpt-", dir=os.environ.get("TMPDIR"))
    sc.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows as a table in the shared checkpoint folder, read again.

    A table rather than ``checkpoint()``, as that carries the old plan's size estimates and constraints on, which grow
    without end in a loop; the table's are those of its files. It outlives lost executors. :func:`forget` deletes it, and what no one
    has forgotten is deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._fondaco_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of :func:`cut` that no later step reads."""
    for t in tables:
        path = getattr(t, "_fondaco_path", None)
        if path:
            p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a frame has at most so many rows; reads at most rows + 1 of them."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after a check of the row count; else the frame as it is (a shuffled join)."""
    return F.broadcast(df) if is_small(df, rows) else df


def shuffled(df: DataFrame) -> DataFrame:
    """A join's side that Spark may not broadcast by its own estimate.

    Spark takes rows behind an ``explode`` or a ``collect_list`` for as large as the file they come from, while they may be hundreds of times
    as large; they would all be gathered by the driver.
    """
    return df.hint("merge")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows over all cores before CPU-heavy Python work; an explicit number, which AQE doesn't coalesce by bytes."""
    spark = df.sparkSession
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(shuffled, 2 * spark.sparkContext.defaultParallelism)
    # an equal number would be taken for the partitioning that an aggregate has left, which AQE may coalesce
    return df.repartition(n + (n == shuffled), *by)
