"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "20g", app: str = "zonelex") -> SparkSession:
    """A local session for tests, the bench and the command line."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a temporary one on a single machine (tests); on a cluster
    that would scatter tables over local disks, so it is refused."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="zonelex-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return context.getCheckpointDir() or configured


_WRITTEN: list[str] = []


def materialized(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: several readers share one computation, and a
    lost executor costs no recomputation. Columnar and compressed, so smaller than a checkpoint of rows. The table goes
    with ``release``, or when the driver ends."""
    path = temporary_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHARED: dict[tuple[str, str], DataFrame] = {}


def shared(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table written once for all queries that ask for it by the same name, until ``release``."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _SHARED:
        _SHARED[key] = materialized(build())
    return _SHARED[key]


def temporary_path(spark: SparkSession, kind: str) -> str:
    """A path inside a new folder of the shared folder, which is deleted by ``release``, or when the driver ends."""
    folder = f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)  # takes only what exists
    _WRITTEN.append(folder)
    return f"{folder}/data"


def release(spark: SparkSession) -> int:
    """Delete what was written under ``temporary_path`` in this process, once no result reads it any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    _SHARED.clear()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
