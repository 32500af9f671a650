"""Session, table and shared-folder helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own and this is not used there."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("threshfold")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in about as many partitions as there are cores or more, for maps that are dear per row.

    A large table has more splits than that and stays as it is; only a table of few files is dealt
    out again, which moves little."""
    conf = df.sparkSession._jsparkSession.sessionState().conf()
    cores, size = df.sparkSession.sparkContext.defaultParallelism, input_bytes(df)
    # as a scan is split: by the bytes of a core, at least the cost of opening a file
    split = min(int(conf.filesMaxPartitionBytes()), max(int(conf.filesOpenCostInBytes()), size // cores + 1))
    return df if 4 * -(-size // split) >= 3 * cores else df.repartition(cores)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` reads, as the planner knows them without reading: for files
    their size. A table of unknown size counts as empty."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Where it is unset (tests, one machine) a temporary folder is made, set and removed at the end; on a cluster
    (any master but ``local``) an unset folder is an error, as a machine's own folder would
    not be visible to the other executors.
    """
    now = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if now is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="threshfold-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        now = "file://" + made
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(now)
    return now.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage is cut, its copies survive
    lost executors, and what reads it twice computes it once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
