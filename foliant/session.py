"""Session settings and the shared-folder materialisation used to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: str | None = None  # made once where no folder is named


def get_session(master: str = "local[8]", shuffle_partitions: int = 8, driver_memory: str = "12g", checkpoint_dir: str | None = None) -> SparkSession:
    """A session of this machine for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(master)
        .appName("foliant")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.checkpoint.dir", checkpoint_dir or tempfile.mkdtemp(prefix="foliant-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a local master, as in tests, gets a temporary folder of its own;
    a cluster has to name one that all its machines share."""
    global _own
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        path = _own = _own or tempfile.mkdtemp(prefix="foliant-")
    return path.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The result has no lineage behind it, so losing executors costs no recomputation of what came before,
    and later plans get column pruning and size statistics. Files are removed by ``release``, or when the driver ends.
    What was shuffled on the way is removed when the write has ended: nothing will read it again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliant/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    atexit.register(remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._foliant_path = path
    return out


def release(*written: DataFrame) -> None:
    """Remove the files of results of ``cut`` that nothing will read again."""
    for df in written:
        remove(df.sparkSession, df._foliant_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is; not being able to is no error."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
