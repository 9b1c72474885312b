"""Lineage: every line of every version is carried forward, restored, edited, new or first seen against its predecessor.

Windows by stream and line replace a scan of each stream in order, so one giant stream is still many tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimp.functions.patterns import rstripped
from palimp.functions.similarity import similarity, subsequences

VERSION = "lineage-1"
#: Least similarity of an edit, and least length of a line that is compared.
EDIT_CUTOFF, EDIT_LEAST_CHARS = 80.0, 20
#: What a status says about who wrote the lines.
BASIS = {
    "first_in_stream": "inferred_predecessor_by_recorded_time",
    "inferred_predecessor": "inferred_predecessor_by_recorded_time",
    "explicit_base": "explicit_diff_base",
    "page_created": "page_created",
}


def stream_order() -> list[Column]:
    return [F.col("stream_seq").asc_nulls_last(), F.col("time_ts").asc_nulls_last(), F.col("item_id").asc_nulls_last()]


def positions(items: DataFrame) -> DataFrame:
    """item_id, stream_key, pos (dense, from 1), prev_item, base_item_id, base_note of all items in streams; texts stay behind."""
    order = Window.partitionBy("stream_key").orderBy(*stream_order())
    rows = items.where("stream_key is not null").select("item_id", "stream_key", "stream_seq", "time_ts", "base_item_id", "base_note")
    return rows.select("item_id", "stream_key", F.row_number().over(order).alias("pos"), F.lag("item_id").over(order).alias("prev_item"), "base_item_id", "base_note")


def base_faults(items: DataFrame) -> DataFrame:
    """Items whose declared base contradicts the order of their stream: item_id, fault."""
    p = positions(items)
    fault = F.when((F.col("base_note") == "page_created") & (F.col("pos") > 1), "page_created is only valid for the first item of a stream").when(F.col("base_item_id").isNotNull() & ~F.col("base_item_id").eqNullSafe(F.col("prev_item")), "the explicit base is not the immediate predecessor")
    return p.select("item_id", fault.alias("fault")).where("fault is not null")


def lines(items: DataFrame) -> DataFrame:
    """item_id, line_no (from 0), line: lines that aren't blank, without trailing white space."""
    raw = items.select("item_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("line_no", "raw"))
    return raw.select("item_id", "line_no", rstripped(F.col("raw")).alias("line")).where("line <> ''")


def statuses(items: DataFrame) -> DataFrame:
    """Positions with lineage_status and the base that lines are compared with."""
    first = F.when(F.col("base_note") == "page_created", "page_created").otherwise("first_in_stream")
    status = F.when(F.col("pos") == 1, first).when(F.col("base_item_id").isNotNull(), "explicit_base").otherwise("inferred_predecessor")
    return positions(items).select("item_id", "stream_key", "pos", F.col("prev_item").alias("base_item_id"), status.alias("lineage_status"))


def unseen_classes(items: DataFrame) -> DataFrame:
    """item_id, stream_key, pos, line_no, line, class; class is inherited, restored, first_observed, new (of a created page) or unseen, without comparing strings."""
    at = lines(items.where("stream_key is not null")).join(statuses(items), "item_id").withColumn("key", F.unhex(F.md5("line")))
    by_line = Window.partitionBy("stream_key", "key").orderBy("pos")
    # Repetitions of a line in one version look back to the version before it that has the line.
    known = at.select("stream_key", "key", "pos").distinct().withColumn("before", F.lag("pos").over(by_line))
    kind = (
        F.when(F.col("lineage_status") == "page_created", "new")
        .when(F.col("lineage_status") == "first_in_stream", "first_observed")
        .when(F.col("before") == F.col("pos") - 1, "inherited")
        .when(F.col("before").isNotNull(), "restored")
        .otherwise("unseen")
    )
    return at.join(known, ["stream_key", "key", "pos"]).select("item_id", "stream_key", "pos", "line_no", "line", "key", kind.alias("class"))


def edits(classes: DataFrame, cutoff: float = EDIT_CUTOFF) -> DataFrame:
    """stream_key, pos, key, similarity of unseen lines that edit a line which the version before had and this one dropped."""
    old = classes.select("stream_key", "key", "pos", "line").dropDuplicates(["stream_key", "key", "pos"])
    after = F.lead("pos").over(Window.partitionBy("stream_key", "key").orderBy("pos"))
    gone = old.withColumn("after", after).where("after is null or after > pos + 1").select("stream_key", (F.col("pos") + 1).alias("pos"), F.col("line").alias("old"))
    new = classes.where((F.col("class") == "unseen") & (F.length("line") >= EDIT_LEAST_CHARS)).select("stream_key", "pos", "key", "line").dropDuplicates(["stream_key", "pos", "key"])
    pairs = new.join(gone, ["stream_key", "pos"]).where(F.least(F.length("line"), F.length("old")) * 200.0 >= cutoff * (F.length("line") + F.length("old")))
    # Equal pairs of texts are compared once, dealt out by pair since a few long ones take most of the time.
    texts = pairs.select("line", "old").distinct().withColumn("score", similarity(F.col("line"), F.col("old"), cutoff)).where(F.col("score") >= cutoff)
    best = pairs.join(texts, ["line", "old"]).groupBy("stream_key", "pos", "key").agg(F.max("score").alias("score"))
    return best.select("stream_key", "pos", "key", F.round(F.col("score") / 100, 4).alias("similarity"))


def line_classes(items: DataFrame) -> DataFrame:
    """item_id, stream_key, pos, line_no, line, classification, similarity of all lines."""
    classes = unseen_classes(items)
    out = classes.join(edits(classes), ["stream_key", "pos", "key"], "left")
    kind = F.when(F.col("class") != "unseen", F.col("class")).when(F.col("similarity").isNotNull(), "modified").otherwise("new")
    return out.select("item_id", "stream_key", "pos", "line_no", "line", kind.alias("classification"), F.when(F.col("class") == "unseen", F.col("similarity")).alias("similarity"))


def text_change(items: DataFrame, classified: DataFrame | None = None) -> DataFrame:
    """Lines that aren't inherited: item_id, line_no, classification, similarity, attribution_basis, detector_version."""
    basis = F.create_map(*(F.lit(x) for kv in BASIS.items() for x in kv))
    changed = (classified if classified is not None else line_classes(items)).where("classification <> 'inherited'")
    out = changed.join(statuses(items).select("item_id", "lineage_status"), "item_id")
    return out.select("item_id", "line_no", "classification", "similarity", F.element_at(basis, F.col("lineage_status")).alias("attribution_basis"), F.lit(VERSION).alias("detector_version"))


def lineage_summary(items: DataFrame, classified: DataFrame | None = None) -> DataFrame:
    """One row per item in a stream, those without lines included; the counters count repeated lines."""
    classified = classified if classified is not None else line_classes(items)
    kinds = ("inherited", "new", "modified", "restored", "first_observed")
    counts = classified.groupBy("item_id").agg(F.count("*").alias("n_lines"), *(F.count_if(F.col("classification") == k).alias(f"n_{k}") for k in kinds))
    out = statuses(items).join(counts, "item_id", "left")
    return out.select("item_id", "stream_key", "base_item_id", "lineage_status", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_lines", *(f"n_{k}" for k in kinds))), F.lit(VERSION).alias("detector_version"))


def totals(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count("*").alias("items"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in summary.columns if c.startswith("n_")))


def nearest_lines(classes: DataFrame, top: int = 3) -> DataFrame:
    """The most similar lines of the predecessor for each new, modified or restored line, of any length: item_id, line_no, rank, old, score.

    A version and its predecessor are one row, and each line is compared with all lines of the predecessor at once.
    """
    old = classes.groupBy("stream_key", (F.col("pos") + 1).alias("pos")).agg(F.collect_set("line").alias("olds"))
    new = classes.where("classification in ('new', 'modified', 'restored') and pos > 1").groupBy("item_id", "stream_key", "pos").agg(F.collect_list(F.struct("line_no", "line")).alias("lines"))

    shape = pa.schema([("item_id", pa.string()), ("line_no", pa.int32()), ("rank", pa.int32()), ("old", pa.string()), ("score", pa.float64())])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                olds, lengths, out = r["olds"], subsequences(r["olds"]), []
                for x in r["lines"]:
                    scores = [200.0 * n / (len(x["line"]) + len(o)) for n, o in zip(lengths(x["line"]), olds, strict=True)]
                    # Scores that may round to the last rank's are rounded as Spark does, and ties go by text.
                    least = heapq.nlargest(top, scores)[-1] - 1e-4
                    best = sorted((-float(Decimal(repr(s)).quantize(Decimal("0.0001"), ROUND_HALF_UP)), o) for s, o in zip(scores, olds, strict=True) if s >= least)
                    out += [{"item_id": r["item_id"], "line_no": x["line_no"], "rank": k, "old": o, "score": -s} for k, (s, o) in enumerate(best[:top], 1)]
                yield pa.RecordBatch.from_pylist(out, shape)

    return new.join(old, ["stream_key", "pos"]).select("item_id", "lines", "olds").mapInArrow(nearest, "item_id string, line_no int, rank int, old string, score double")
