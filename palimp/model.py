"""The relational model: fixed schemas, a corpus of tables, and the adapter that reads the driver's tables into it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMAS = {
    "snapshot": "snapshot_id string, source string, created_at string, importer_version string, files array<struct<name:string,bytes:long,sha256:string>>, terms string, coverage_notes string",
    "actor_label": "label_id string, snapshot_id string, kind string, display_name string, model_string string, first_seen timestamp_ntz, last_seen timestamp_ntz, identity_status string",
    "actor_label_name": "label_id string, name string, first_seen timestamp_ntz, last_seen timestamp_ntz, n long",
    "event": "event_id string, snapshot_id string, event_index long, kind string, actor_label_id string, room_id string, session_id string, source_time string, time_ts timestamp_ntz, clock_provenance string, time_lower timestamp_ntz, time_upper timestamp_ntz, input_tokens long, output_tokens long, cost long, source_file string, source_id string",
    "text_item": "item_id string, snapshot_id string, kind string, actor_label_id string, event_id string, room_id string, session_id string, source_time string, time_ts timestamp_ntz, text string, text_sha256 string, text_len long, generated boolean, stream_key string, source_file string, source_table string, source_id string, stream_seq long, base_item_id string, base_note string, source_sha256 string, source_encoding string",
    "stream_meta": "stream_key string, key string, value string, source_file string",
}
#: Classes of lines whose text is new in its place.
NOVEL = ("standalone", "first_observed", "new", "modified")


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def shaped(df: DataFrame, name: str) -> DataFrame:
    """df with exactly the columns of a table, missing ones null."""
    have = set(df.columns)
    fields = [f.strip().split(" ", 1) for f in _fields(SCHEMAS[name])]
    return df.select(*((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in fields))


def _fields(ddl: str) -> list[str]:
    out, depth, at = [], 0, 0
    for k, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[at:k])
            at = k + 1
    return [*out, ddl[at:]]


def text_items(df: DataFrame) -> DataFrame:
    """Rows of text_item from what an adapter knows: digest and length are derived, null texts go."""
    df = df.where("text is not null").withColumn("text_sha256", F.sha2("text", 256)).withColumn("text_len", F.length("text").cast("long"))
    if "generated" not in df.columns:
        df = df.withColumn("generated", F.lit(False))
    return shaped(df, "text_item")


def topic_of(items: DataFrame, meta: DataFrame) -> DataFrame:
    """items with the column topic: the page family of their stream, else 'unclassified'."""
    family = meta.where("key = 'page_family'").groupBy("stream_key").agg(F.min("value").alias("topic"))
    return items.join(family, "stream_key", "left").withColumn("topic", F.coalesce("topic", F.lit("unclassified")))


def recorded_order(*more: Column) -> list[Column]:
    """Time, then what else; nulls last everywhere."""
    return [F.col("time_ts").asc_nulls_last(), *more]


@dataclass
class Corpus:
    """The source tables, and the derived ones as far as they are built."""

    spark: SparkSession
    text_item: DataFrame
    event: DataFrame
    actor_label: DataFrame
    stream_meta: DataFrame
    snapshot: DataFrame | None = None
    actor_label_name: DataFrame | None = None
    source: str = "unknown"
    derived: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.derived[name]


EPOCH, HEAD = "2024-01-01 00:00:00", 64


def from_tables(spark: SparkSession, sf_dir: str) -> Corpus:
    """The driver's tables as a corpus: documents are versions in one stream per language (ordered by their first HEAD characters, so near copies follow one another), page addresses and
    conversation turns are standalone items, events are events."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    minutes = lambda n: F.expr(f"timestampadd(MINUTE, {n}, timestamp_ntz'{EPOCH}')")
    # The order is made of ids and the first characters; texts stay out of the windows.
    heads = read("documents").select("doc_id", "lang", F.substring("text", 1, HEAD).alias("head"))
    seq = heads.select("doc_id", F.row_number().over(Window.partitionBy("lang").orderBy("head", "doc_id")).cast("long").alias("stream_seq"))
    docs = read("documents").join(seq, "doc_id")
    docs = docs.select(
        F.format_string("doc:item:%d", "doc_id").alias("item_id"), F.lit("document").alias("kind"), F.concat(F.lit("doc:source:"), "source").alias("actor_label_id"),
        minutes("doc_id").alias("time_ts"), "text", F.concat(F.lit("lang:"), "lang").alias("stream_key"), "stream_seq", F.lit("documents").alias("source_table"),
    )
    pages = read("pages").select(
        F.format_string("page:item:%d", "page_id").alias("item_id"), F.lit("page_url").alias("kind"), F.concat(F.lit("page:lang:"), F.regexp_extract("url", "://[^/]+/([a-z]+)/", 1)).alias("actor_label_id"),
        minutes("page_id").alias("time_ts"), F.col("url").alias("text"), F.lit("pages").alias("source_table"),
    )
    turns = read("conversations").select(
        F.format_string("conv:item:%d:%d", "conv_id", "turn").alias("item_id"), F.lit("chat").alias("kind"), F.concat(F.lit("conv:role:"), "role").alias("actor_label_id"),
        minutes("conv_id * 60 + turn").alias("time_ts"), "text", F.lit("conversations").alias("source_table"),
    )
    items = text_items(docs.unionByName(pages, True).unionByName(turns, True))
    events = shaped(read("events").select(F.format_string("ev:%d", "event_id").alias("event_id"), F.col("event_id").alias("event_index"), F.col("event_type").alias("kind"), F.format_string("user:%d", "user_id").alias("actor_label_id"), F.col("ts").cast("timestamp_ntz").alias("time_ts"), F.lit("events").alias("source_file")), "event")
    labels = shaped(items.where("actor_label_id is not null").groupBy(F.col("actor_label_id").alias("label_id")).agg(F.min("time_ts").alias("first_seen"), F.max("time_ts").alias("last_seen")).withColumn("kind", F.lit("label")).withColumn("display_name", F.col("label_id")).withColumn("identity_status", F.lit("unverified_label")), "actor_label")
    langs = read("documents").select("lang").distinct().select(F.concat(F.lit("lang:"), "lang").alias("stream_key"), F.lit("page_family").alias("key"), F.col("lang").alias("value"), F.lit("documents").alias("source_file"))
    return Corpus(spark, items, events, labels, shaped(langs, "stream_meta"), source="tables")
