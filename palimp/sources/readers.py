"""Scans by format, profiles, sequence checks, slices, and writers."""

from __future__ import annotations

import csv
import io
import re
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {"parquet": "parquet", "csv": "csv", "tsv": "csv", "jsonl": "json", "ndjson": "json", "json": "document", "orc": "orc"}


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Newline-delimited JSON, gzip included, with declared columns; a JSON subdocument declared as string keeps its text."""
    return spark.read.schema(schema).json(path)


def read_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_parquet(spark: SparkSession, paths: list[str], columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """Several parquet paths united by column name; columns and filter reach the scan."""
    df = spark.read.option("mergeSchema", True).parquet(*paths)
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """By the name's ending (compression endings aside); ValueError for others."""
    ends = [s.lstrip(".").lower() for s in PurePosixPath(path).suffixes if s not in (".gz", ".zst", ".bz2")]
    kind = FORMATS.get(ends[-1] if ends else "")
    if kind is None:
        raise ValueError(f"no reader for {path}")
    if kind == "document":
        return read_document(spark, path)
    if kind == "csv":
        return spark.read.options(header=True, inferSchema=True, sep="\t" if ends[-1] == "tsv" else ",").csv(path)
    return spark.read.format(kind).load(path)


def null_profile(df: DataFrame) -> DataFrame:
    """column, rows, nulls, null_share of each column, in one pass."""
    one = df.agg(F.count("*").alias("_rows"), *(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("present")) for c in df.columns)))
    out = one.select("_rows", pairs.alias("p")).select("p.column", F.col("_rows").alias("rows"), (F.col("_rows") - F.col("p.present")).alias("nulls"))
    return out.withColumn("null_share", F.round(F.col("nulls") / F.when(F.col("rows") > 0, F.col("rows")), 4))


def group_profile(df: DataFrame, group: str) -> DataFrame:
    """For each value of a column: rows and the sorted names of columns that are ever set."""
    others = [c for c in df.columns if c != group]
    counts = df.groupBy(group).agg(F.count("*").alias("rows"), *(F.count(F.col(f"`{c}`")).alias(c) for c in others))
    fields = F.array_join(F.array_sort(F.filter(F.array(*(F.when(F.col(f"`{c}`") > 0, F.lit(c)) for c in others)), lambda x: x.isNotNull())), ",")
    return counts.select(group, "rows", fields.alias("fields"))


def sample_rows(df: DataFrame, n: int, seed: int = 7) -> DataFrame:
    return df.orderBy(F.rand(seed)).limit(n)


def row_counts(tables: dict[str, DataFrame], by_kind: tuple[str, ...] = ("event", "text_item")) -> DataFrame:
    """name, n of all tables, and of each kind as table:kind."""
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    parts += [tables[k].groupBy("kind").agg(F.count("*").alias("n")).select(F.concat(F.lit(f"{k}:"), "kind").alias("name"), "n") for k in by_kind if k in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unpivot_attributes(df: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """key, attribute, value for attributes that are set."""
    return df.select(key, *(F.col(a).cast("string").alias(a) for a in attributes)).unpivot(key, attributes, "attribute", "value").where("value is not null")


def sliced(df: DataFrame, time_column: str | None = None, start: str | None = None, end: str | None = None, one_of: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows in a half-open range of times and with listed values. ValueError without a filter or for an unknown column; times that don't parse are out."""
    if not (time_column and (start or end)) and not one_of:
        raise ValueError("a slice needs a range of times or listed values")
    if unknown := {c for c in [*(one_of or {}), *([time_column] if time_column else [])] if c not in df.columns}:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    if time_column:
        at = F.col(time_column).try_cast("timestamp")
        if start:
            df = df.where(at >= F.lit(start).cast("timestamp"))
        if end:
            df = df.where(at < F.lit(end).cast("timestamp"))
    for c, values in (one_of or {}).items():
        df = df.where(F.col(c).cast("string").isin(values))
    return df


BINARY_NAME = re.compile(r"(?i)screenshot|image|thumbnail|blob|base64|embedding")


def exclusions(schema: T.StructType) -> dict[str, str]:
    """Columns that a pull leaves out, and why: binary anywhere in the type, or a name of binary content."""
    def binary(t: T.DataType) -> bool:
        if isinstance(t, T.StructType):
            return any(binary(f.dataType) for f in t.fields)
        if isinstance(t, T.ArrayType):
            return binary(t.elementType)
        if isinstance(t, T.MapType):
            return binary(t.keyType) or binary(t.valueType)
        return isinstance(t, T.BinaryType)

    return {f.name: "binary type" if binary(f.dataType) else "binary name" for f in schema.fields if binary(f.dataType) or BINARY_NAME.search(f.name)}


def table_name(path: str) -> str:
    """The table that a file belongs to: shard endings, split names and folders are left off."""
    parts = PurePosixPath(path).parts
    stem = re.sub(r"\.(parquet|jsonl|ndjson|json|csv)(\.\w+)?$", "", parts[-1])
    stem = re.sub(r"[-_]?\d+-of-\d+$|[-_]part[-_]?\d+$|[-_]\d{3,}$", "", stem)
    if stem in ("train", "test", "validation", "data", "default", "part", "") and len(parts) > 1:
        return table_name("/".join([*parts[:-2], parts[-2] + ".parquet"]))
    return stem


def matching(names: list[str], wanted: str) -> list[str]:
    """Exactly that name, else all names that contain it."""
    return [n for n in names if n == wanted] or sorted(n for n in names if wanted.lower() in n.lower())


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Local parquet files: table, file, rows, bytes, column, compressed bytes, exclusion. Footers only, no data."""
    import pyarrow.parquet as pq
    from pathlib import Path

    rows = []
    for f in sorted(p for p in Path(path).rglob("*.parquet") if p.is_file()):
        meta = pq.ParquetFile(f)
        out = {c: 0 for c in meta.schema_arrow.names}
        for g in range(meta.metadata.num_row_groups):
            for k in range(meta.metadata.num_columns):
                col = meta.metadata.row_group(g).column(k)
                top = col.path_in_schema.split(".")[0]
                out[top] = out.get(top, 0) + col.total_compressed_size
        why = {n: "binary type" if "binary" in str(meta.schema_arrow.field(n).type) else "binary name" for n in out if "binary" in str(meta.schema_arrow.field(n).type) or BINARY_NAME.search(n)}
        rows += [(table_name(str(f.relative_to(path))), f.name, meta.metadata.num_rows, f.stat().st_size, c, n, why.get(c)) for c, n in out.items()]
    return spark.createDataFrame(rows, "table string, file string, rows long, bytes long, column string, compressed long, excluded string")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes, sha256 of files, in a distributed read."""
    df = spark.read.format("binaryFile").load(path)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] | None = None) -> int:
    """zstd parquet; returns the rows that can be read again."""
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.parquet(path).count()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, escape='"').csv(path)


def csv_text(rows: list[dict]) -> str:
    """Rows of a small report as CSV; the header is the sorted union of keys, nested values become JSON."""
    import json

    keys = sorted({k for r in rows for k in r})
    out = io.StringIO()
    w = csv.DictWriter(out, keys)
    w.writeheader()
    w.writerows({k: json.dumps(v, default=str, sort_keys=True) if isinstance(v, (list, dict, tuple)) else v for k, v in r.items()} for r in rows)
    return out.getvalue()
