"""Session set-up and tables kept in the cluster's shared folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path
from threading import Lock

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("driftline")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see; a temporary one only on a local master."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not configured:
        configured = context.getCheckpointDir()
    if not configured:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="driftline-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_shipping = Lock()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers; done once per session."""
    context = spark.sparkContext
    with _shipping:
        if getattr(context, "_driftline_shipped", False):
            return
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(
            str(Path(tempfile.mkdtemp(prefix="driftline-")) / "driftline"), "zip", package.parent, package.name
        )
        context.addPyFile(archive)
        context._driftline_shipped = True


def keep(df: DataFrame) -> DataFrame:
    """Write a small intermediate result reliably and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def keep_columnar(df: DataFrame) -> DataFrame:
    """Write rows as Parquet in the shared folder, so later passes can prune columns."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/rows-{uuid.uuid4().hex}"
    _remember(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_kept(df: DataFrame) -> None:
    """Delete the files of a table that ``keep_columnar`` has kept and nothing reads any more."""
    spark = df.sparkSession
    with _shipping:
        mine = _kept.get(spark.sparkContext.applicationId, [])
        paths = [path for path, _ in mine if any(f"/{path.rsplit('/', 1)[1]}/" in file for file in df.inputFiles()[:1])]
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def keep_clustered(df: DataFrame, keys: list[str], buckets: int, sort: list[str]) -> DataFrame:
    """Keep rows that are hash-partitioned by ``keys`` as a table bucketed the same way.

    Every task writes one bucket. Later aggregates, windows and joins on
    ``keys`` then need no shuffle.
    """
    spark = df.sparkSession
    name = f"driftline_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{name}"
    _remember(spark, path, name)
    df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*sort).option("path", path).saveAsTable(name)
    return spark.table(name)


_kept: dict[str, list[tuple[str, str | None]]] = {}


def _remember(spark: SparkSession, path: str, name: str | None = None) -> None:
    with _shipping:
        _kept.setdefault(spark.sparkContext.applicationId, []).append((path, name))


def release(spark: SparkSession, since: int = 0) -> int:
    """Drop the tables and folders that this application has kept, from the ``since``-th on; returns how many.

    Results that still read them can no longer be computed, so write them out first.
    """
    with _shipping:
        mine = _kept.get(spark.sparkContext.applicationId, [])
        gone, mine[since:] = mine[since:], []
    for path, name in gone:
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return len(gone)


def kept_so_far(spark: SparkSession) -> int:
    """How many tables and folders the application has kept; for ``release(spark, since)``."""
    with _shipping:
        return len(_kept.get(spark.sparkContext.applicationId, []))
