"""Artifacts in text: addresses, hexadecimal identifiers and repository references, with spans, novelty and counts.

Matches never cross a line, so patterns run over whole texts and a span tells its line; lines need not be exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimp.functions.patterns import each, spans
from palimp.model import NOVEL

VERSION = "artifacts-1"
#: The patterns of the three types, and hosts that nobody else can reach.
URL = r"""https?://[^\s\x1c-\x1f\x85\p{Z}<>"'`)\]}|*]+"""
HEX = r"(?=[0-9a-f])(?<![0-9a-fA-F-])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{7,40}(?![0-9a-fA-F-])"
REPO = r"(?<![\p{L}\p{N}_/.-])[A-Za-z0-9][\p{L}\p{N}_.-]{0,38}/[A-Za-z0-9][\p{L}\p{N}_.-]{0,99}#\p{Nd}{1,7}(?![\p{L}\p{N}_])"
LOCAL_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "[::1]")
TYPES = ("url", "repo_ref", "hex_id")
_URLS = "array<struct<start:int,end:int,raw:string,normalized:string,line:int>>"
_HITS = "array<struct<type:string,start:int,end:int,raw:string,normalized:string,line:int>>"


def normalized_url(raw: Column) -> Column:
    """Scheme and host in lower case, port as a number (0 and empty go), empty query and fragment marks gone, the rest as it is; null for what can't be shared."""
    part = lambda k: F.regexp_extract(raw, r"(?s)^([A-Za-z]+)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$", k)
    authority = part(2)
    user = F.regexp_extract(authority, r"(?s)^(.*@)", 1)
    place = F.regexp_replace(authority, r"(?s)^.*@", "")
    host = F.lower(F.regexp_extract(place, r"(?s)^([^:]*)", 1))
    port = F.regexp_extract(place, r"(?s)^[^:]*:(.*)$", 1)
    number = F.coalesce(F.when(port.rlike(r"^[0-9]+$"), port).try_cast("long"), F.lit(0))
    bad = (host == "") | host.isin(*LOCAL_HOSTS) | host.contains("{") | host.contains("$") | ((port != "") & ~port.rlike(r"^[0-9]+$")) | ((port != "") & (F.length(F.regexp_replace(port, "^0+", "")) > 5)) | (number > 65535) | authority.contains("[") | authority.contains("]")
    tail = F.concat(part(3), F.when(part(4) != "?", part(4)).otherwise(""), F.when(part(5) != "#", part(5)).otherwise(""))
    return F.when(~bad, F.concat(F.lower(part(1)), F.lit("://"), user, host, F.when(number > 0, F.concat(F.lit(":"), number.cast("string"))).otherwise(""), tail))


def artifact_id(kind: Column, normalized: Column) -> Column:
    return F.concat(F.lit("art:"), kind, F.lit(":"), F.substring(F.sha1(normalized.cast("binary")), 1, 16))


def hits(items: DataFrame) -> DataFrame:
    """item_id, artifact_type, raw, normalized, span_start, span_end, line_no of every artifact in every item.

    A repository reference or identifier inside an accepted address is part of it; a rejected address hides nothing.
    """
    rows = items.where("not coalesce(generated, false)")
    text = F.col("text")
    url = F.transform(spans(text, URL), lambda m: F.struct(m["start"].alias("start"), F.regexp_replace(m["raw"], r"[.,;:!?]+$", "").alias("raw"), m["line"].alias("line")))
    url = F.transform(url, lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["raw"])).alias("end"), m["raw"].alias("raw"), normalized_url(m["raw"]).alias("normalized"), m["line"].alias("line")))
    kept = F.filter(url, lambda m: m["normalized"].isNotNull())
    found = rows.select("item_id", F.when(text.contains("http"), kept).otherwise(F.array().cast(_URLS)).alias("url"), F.when(text.contains("#"), spans(text, REPO)).alias("repo"), spans(text, HEX).alias("hex"))
    outside = lambda m: ~F.exists("url", lambda u: (m["start"] >= u["start"]) & (m["end"] <= u["end"]))
    one = lambda kind, m, n: F.struct(F.lit(kind).alias("type"), m["start"].alias("start"), m["end"].alias("end"), m["raw"].alias("raw"), n.alias("normalized"), m["line"].alias("line"))
    lowered = lambda raw: F.concat(F.lower(F.substring_index(raw, "#", 1)), F.lit("#"), F.substring_index(raw, "#", -1))
    none = F.array().cast(_HITS)
    every = F.concat(
        F.transform("url", lambda m: one("url", m, m["normalized"])),
        F.coalesce(F.transform(F.filter("repo", outside), lambda m: one("repo_ref", m, lowered(m["raw"]))), none),
        F.transform(F.filter("hex", outside), lambda m: one("hex_id", m, m["raw"])),
    )
    out = each(found.select("item_id", every.alias("h")), F.col("h"), "h", "item_id")
    return out.select("item_id", F.col("h.type").alias("artifact_type"), F.col("h.raw").alias("raw"), F.col("h.normalized").alias("normalized"), F.col("h.start").alias("span_start"), F.col("h.end").alias("span_end"), F.col("h.line").alias("line_no"))


def occurrences(items: DataFrame, text_change: DataFrame) -> DataFrame:
    """All hits with the novelty of their line: standalone, the line's class, or inherited where the line has none."""
    about = items.select("item_id", "actor_label_id", "event_id", "time_ts", F.col("stream_key").isNotNull().alias("in_stream"))
    found = hits(items).withColumn("artifact_id", artifact_id(F.col("artifact_type"), F.col("normalized"))).join(about, "item_id")
    classes = text_change.select("item_id", "line_no", "classification")
    novelty = F.when(~F.col("in_stream"), "standalone").otherwise(F.coalesce("classification", F.lit("inherited")))
    return found.join(classes, ["item_id", "line_no"], "left").withColumn("novelty", novelty).drop("in_stream", "classification")


def appearance(found: DataFrame) -> DataFrame:
    out = found.where("novelty <> 'inherited'")
    return out.select("artifact_id", "item_id", "event_id", "actor_label_id", "time_ts", "line_no", "span_start", "span_end", "novelty", F.lit("unknown").alias("role"), F.lit("extracted").alias("review_status"), F.lit(VERSION).alias("detector_version"))


def artifact(found: DataFrame) -> DataFrame:
    """artifact_id, artifact_type, raw (of the earliest occurrence), normalized."""
    first = F.struct(F.col("time_ts").isNull(), "time_ts", "item_id", "span_start")
    return found.groupBy("artifact_id", "artifact_type", "normalized").agg(F.min_by("raw", first).alias("raw")).select("artifact_id", "artifact_type", "raw", "normalized")


def artifact_counts(found: DataFrame) -> DataFrame:
    """Occurrences, items and known labels of each artifact, in all text and in new text."""
    new = F.col("novelty").isin(*NOVEL)
    return found.groupBy("artifact_id").agg(
        F.count("*").alias("full_occurrences"),
        F.count_if(new).alias("novel_occurrences"),
        F.count_distinct("item_id").alias("full_items"),
        F.count_distinct(F.when(new, F.col("item_id"))).alias("novel_items"),
        F.count_distinct("actor_label_id").alias("full_labels"),
        F.count_distinct(F.when(new, F.col("actor_label_id"))).alias("novel_labels"),
    )


def with_event_index(appearances: DataFrame, event: DataFrame) -> DataFrame:
    return appearances.join(event.select("event_id", "event_index"), "event_id", "left")

