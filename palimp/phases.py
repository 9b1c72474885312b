"""Phase tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark removes the shuffle files of a query once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the cluster names, else the context's checkpoint folder. In local mode alone, where all share one disk, a folder of our own will do."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not named and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not named:
        named = _own.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="palimp-")
        _own[context.applicationId] = named
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage and survives lost executors. The write's shuffle files go when it has ended."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimp-{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def emptied(*tables: DataFrame) -> None:
    """Drop the rows of tables that stored() wrote and nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            df.limit(0).coalesce(1).write.mode("overwrite").parquet(path)
