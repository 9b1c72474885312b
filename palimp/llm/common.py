"""What the corpus operators share: the shared folder, written tables, batch bounds, empty-safe columns, names that don't clash."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimp.phases import CLEANUP, emptied, shared_dir, stored  # noqa: F401  the operators take them from here

#: Rows and bytes in one Arrow batch.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like stored(), with the rows dealt by key over as many files as a shuffle has partitions: what is grouped by key later reads them without another shuffle."""
    spark, uid = df.sparkSession, uuid.uuid4().hex
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, table = f"{shared_dir(spark)}/palimp-{uid}/{name}", f"palimp_{uid}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(table)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.table(table)
    out.schema  # noqa: B018  resolved now, as the name goes; an external table's files stay
    spark.sql(f"DROP TABLE {table}")
    return out


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small enough for very long documents. A setting of the session, as Spark has no other place for it; README says so."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as keep it apart from the columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
