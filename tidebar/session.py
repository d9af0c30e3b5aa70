"""Session helpers: a UTC session, the shared folder, and tables written once."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "tidebar", master: str | None = None, partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


#: Bytes a task reads of a table or a shuffle: some half a million narrow rows, whose hash maps and sorts fit a small share of an executor.
TASK_BYTES = 8 << 20


def small_tasks(spark: SparkSession) -> None:
    """Tasks grow in number with the data, not in size, so what one holds of it in memory doesn't spill."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(TASK_BYTES))
    spark.conf.set("spark.sql.files.openCostInBytes", str(TASK_BYTES // 8))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(2 * TASK_BYTES))


_LOCAL_SHARED: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by spark.checkpoint.dir.

    Only a local[...] session may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SHARED:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        _LOCAL_SHARED[app] = tempfile.mkdtemp(prefix="tidebar-")
    return _LOCAL_SHARED[app]


def carry_code() -> None:
    """Send this package's classes and functions inside the tasks that use them.

    Python workers, and the process that starts a stateful stream, then need no
    installed copy and no added archive.
    """
    cloudpickle.register_pickle_by_value(sys.modules["tidebar"])


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tidebar/{label}-{uuid.uuid4().hex}"


class Marts:
    """Tables that several queries read: built by the first one, scanned by the rest.

    A mart lives as parquet in the shared folder, so losing an executor never
    re-runs what produced it.
    """

    _paths: dict[tuple[str, str, str], str] = {}

    @classmethod
    def table(
        cls,
        spark: SparkSession,
        sf_dir: str,
        name: str,
        build: Callable[[], DataFrame],
        partition_by: tuple[str, ...] = (),
    ) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, name)
        if key not in cls._paths:
            path = scratch_path(spark, name)
            writer = build().write.mode("overwrite").option("compression", "zstd")
            if partition_by:
                writer = writer.partitionBy(*partition_by)
            writer.parquet(path)
            cls._paths[key] = path
        return spark.read.parquet(cls._paths[key])
