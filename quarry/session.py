"""Session factory and the shared folder in which lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of input that a costly Python stage gets per task where `spread` divides it.
TASK_BYTES = 4 << 20
#: Paths and tables written by this process and not removed yet.
_KEPT: list[tuple[str, str | None]] = []


def session(app: str = "quarry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; an existing session is reused as it is."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where that is unset, a session of one machine gets a temporary folder; on a cluster this is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            at = known.get()
        elif spark.sparkContext.master.startswith("local"):
            at = tempfile.mkdtemp(prefix="quarry-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def kept(spark: SparkSession, what: str, table: str | None = None) -> str:
    """A fresh path in the shared folder, which `scratch` and `clean` remove."""
    path = f"{shared_dir(spark)}/quarry/{what}-{uuid.uuid4().hex}"
    _KEPT.append((path, table))
    return path


def clean(spark: SparkSession, first: int = 0) -> None:
    """Removes what this process has written to the shared folder; frames that read it are void afterwards."""
    jvm = spark.sparkContext._jvm
    while len(_KEPT) > first:
        at, name = _KEPT.pop()
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What operators write inside the block is removed at its end, so results must be stored or collected in it."""
    first = len(_KEPT)
    try:
        yield
    finally:
        clean(spark, first)


def written(df: DataFrame, what: str) -> DataFrame:
    """df, run once, kept as Parquet in the shared folder and read from there.

    Survives the loss of executors and keeps later stages from running df again.
    """
    path = kept(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size_of(df: DataFrame) -> int:
    """Bytes of df as the optimizer estimates them (file sizes for scans), 0 where it knows nothing."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def spread(df: DataFrame) -> DataFrame:
    """df in parts of TASK_BYTES if its input has far fewer parts than cores, before a costly stage; inputs of many parts stay unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, min(8 * cores, size_of(df) // TASK_BYTES))) if df.rdd.getNumPartitions() * 2 <= cores else df


def bucketed(df: DataFrame, what: str, key: str, buckets: int, part: str | None = None) -> DataFrame:
    """df, run once, kept in the shared folder in `buckets` buckets by key (and in partitions by `part`).

    Groupings by key and joins of such tables on it need no exchange.
    """
    spark, name = df.sparkSession, f"quarry_{what}_{uuid.uuid4().hex}"
    w = df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", kept(spark, what, name))
    (w.partitionBy(part) if part else w).saveAsTable(name)
    return spark.table(name)
