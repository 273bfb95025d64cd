"""Written intermediate tables.

A stage that several jobs read, or that a long plan should not recompute, is
written as Parquet below the shared folder of ``spark.checkpoint.dir``. That
cuts the lineage at a place every executor can reach, survives lost executors,
and gives the optimizer real sizes to choose joins by.
"""

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_BUILDERS: dict[str, Callable[["Warehouse"], DataFrame]] = {}
_PATHS: dict[tuple[str, str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which every executor must reach.

    Without that setting a single-machine session gets a folder of its own; any
    other master raises, because executors would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder shared by all executors of {master}")
        named = tempfile.mkdtemp(prefix="waymark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark)}/waymark/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and go on from the written table."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def widened(df: DataFrame) -> DataFrame:
    """Spread text over all cores when its scan has fewer partitions than there are.

    Text work is heavy per row, and a small file is one task. A scan that already
    fills the cluster is left as it is, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def reference_table(name: str):
    """Register how a shared table is built from a data folder."""

    def register(build):
        _BUILDERS[name] = build
        return build

    return register


def forget() -> None:
    """Build shared tables anew when next asked for: after inputs change, and between bench runs."""
    _PATHS.clear()


class Warehouse:
    """The shared tables of one data folder, each built when first asked for and kept until ``forget``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _PATHS:
            df = _BUILDERS[name](self)
            path = scratch(self.spark, name)
            df.write.parquet(path)
            _PATHS[key] = path
        return self.spark.read.parquet(_PATHS[key])
