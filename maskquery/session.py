"""Session helpers: a local session for tests and fault-tolerant lineage cuts for iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def local_session(cores: str = "8", app: str = "maskquery") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; with a local master a temporary folder if that is unset."""
    sc = spark.sparkContext
    shared = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared)
    return shared


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so a lost executor costs no replay of earlier rounds."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def round_table(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, for the rounds of a loop: unlike a checkpoint it carries nothing of the plan that made
    it, whose inferred constraints would double from round to round."""
    path = f"{shared_dir(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by key over as many tasks as shuffles have (or cores, if more): for small rows that cost much work each, which adaptive
    execution would put into one task."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def together(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with equal keys in one partition, for work on whole partitions. A repartition by the columns themselves would be dropped
    where a join below deals by them, and adaptive execution may then replace that join by one that leaves rows where they are."""
    return df.repartition(F.xxhash64(*keys))


def with_sample(df: DataFrame, rest: str) -> StructType:
    """A schema of ``sample_id`` as in ``df``, which may be of any type with an order, and further columns."""
    return StructType([StructField("sample_id", df.schema["sample_id"].dataType), *StructType.fromDDL(rest)])
