"""Evidence edges: later items of other labels that write an artifact after its first recorded item. They assert no direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimp.model import NOVEL
from palimp.operators.artifacts import TYPES, with_event_index

VERSION = "edges-1"
#: Fixed value: artifacts in more items than this are too common to link by.
MOST_ITEMS = 200
#: What else may explain an edge.
ALTERNATIVES = [
    "common external source (both read the same page or message)",
    "shared prompt, scaffold or template text",
    "independent discovery of the same resource",
    "text carried in a memory or goal handed to the later label",
]


def temporal_status(index_a: Column, index_b: Column, time_a: Column, time_b: Column) -> Column:
    return F.when(index_a != index_b, "sequence_ordered").when(time_a != time_b, "timestamp_ordered_unbounded").otherwise("unresolved")


def eligible(artifact: DataFrame, counts: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    return artifact.where(F.col("artifact_type").isin(*TYPES)).join(counts.where(F.col("novel_items").between(2, most)), "artifact_id").select("artifact_id")


def skipped(counts: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    return counts.agg(F.count_if(F.col("novel_items") > most).alias("skipped_common_artifacts"))


def firsts(appearance: DataFrame, event: DataFrame, artifact: DataFrame, counts: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    """The first new span of each eligible artifact in each item, and its position in recorded order. At most `most` rows of an artifact."""
    new = appearance.where(F.col("novelty").isin(*NOVEL)).join(eligible(artifact, counts, most), "artifact_id")
    spans = new.groupBy("artifact_id", "item_id").agg(F.min_by(F.struct("span_start", "span_end", "line_no", "actor_label_id", "time_ts", "event_id"), "span_start").alias("s"))
    rows = with_event_index(spans.select("artifact_id", "item_id", "s.*"), event)
    order = Window.partitionBy("artifact_id").orderBy(F.col("time_ts").asc_nulls_last(), F.col("event_index").asc_nulls_last(), "item_id")
    return rows.withColumn("pos", F.row_number().over(order))


def same_content(appearance: DataFrame, event: DataFrame, artifact: DataFrame, counts: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    """A star from the first item to every later one of another label; unknown labels form no edge. The first is carried by a window, so there is no self join."""
    rows = firsts(appearance, event, artifact, counts, most)
    whole = Window.partitionBy("artifact_id").orderBy("pos")
    first = F.first(F.struct("item_id", "actor_label_id", "time_ts", "event_index", "span_start", "span_end")).over(whole)
    pairs = rows.withColumn("f", first).where("pos > 1 and actor_label_id <> f.actor_label_id")
    side = lambda i, s, e: F.struct(F.col(i).alias("item_id"), F.col(s).alias("span_start"), F.col(e).alias("span_end"))
    return pairs.select(
        F.concat(F.lit("edge:"), F.md5(F.concat_ws("|", "f.item_id", "item_id", "artifact_id", F.lit("same_content")))).alias("edge_id"),
        F.col("f.item_id").alias("src_item_id"),
        F.col("item_id").alias("dst_item_id"),
        F.lit("same_content").alias("relation"),
        F.lit("rule_derived").alias("evidence_tier"),
        "artifact_id",
        F.to_json(F.struct("artifact_id", side("f.item_id", "f.span_start", "f.span_end").alias("src"), side("item_id", "span_start", "span_end").alias("dst"))).alias("support"),
        temporal_status(F.col("f.event_index"), F.col("event_index"), F.col("f.time_ts"), F.col("time_ts")).alias("temporal_status"),
        F.array(*map(F.lit, ALTERNATIVES)).alias("alternatives"),
        F.lit(False).alias("directed"),
        F.lit(VERSION).alias("detector_version"),
    )


def status_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation", "temporal_status").agg(F.count("*").alias("n"))
