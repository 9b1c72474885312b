"""Counts over lineage, artifacts, cues and references: inflation, arrivals, topics, shared numbers, hosts, adoption, exchanges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimp.functions.patterns import each, snippet
from palimp.model import NOVEL, topic_of
from palimp.operators.cues import ADDRESS

#: Fixed value: a number on a line.
NUMBER = r"(?<![\p{L}\p{N}_.:/-])(?:\p{Nd}{1,3}(?:,\p{Nd}{3})+(?:\.\p{Nd}+)?|\p{Nd}+\.\p{Nd}+%?|\p{Nd}{4,})(?![\p{L}\p{N}_:/-])"


def lines_by_stream(summary: DataFrame) -> DataFrame:
    """Sums of line classes by the prefix of the stream, and the share that is inherited."""
    sums = ("n_lines", "n_inherited", "n_new", "n_modified", "n_restored", "n_first_observed")
    out = summary.groupBy(F.split_part("stream_key", F.lit(":"), F.lit(1)).alias("stream")).agg(F.count("*").alias("items"), *(F.sum(c).alias(c) for c in sums))
    return out.withColumn("inherited_share", F.round(F.col("n_inherited") / F.when(F.col("n_lines") > 0, F.col("n_lines")), 4))


def inflation_by_type(artifact: DataFrame, counts: DataFrame) -> DataFrame:
    several = lambda c: F.count_if(F.col(c) >= 2).alias(f"{c}_2")
    out = artifact.join(counts, "artifact_id").groupBy("artifact_type").agg(F.count("*").alias("artifacts"), F.sum("full_occurrences").alias("full_occurrences"), F.sum("novel_occurrences").alias("novel_occurrences"), *map(several, ("full_items", "novel_items", "full_labels", "novel_labels")))
    return out.withColumn("inflation", F.round(F.col("full_occurrences") / F.when(F.col("novel_occurrences") > 0, F.col("novel_occurrences")), 3))


def most_inflated(artifact: DataFrame, counts: DataFrame, n: int = 20, least: int = 20) -> DataFrame:
    some = artifact.join(counts.where((F.col("novel_occurrences") >= 1) & (F.col("full_occurrences") >= least)), "artifact_id")
    some = some.withColumn("inflation", F.round(F.col("full_occurrences") / F.col("novel_occurrences"), 3))
    return some.orderBy(F.desc(F.col("full_occurrences") / F.col("novel_occurrences")), F.desc("full_occurrences"), "artifact_id").limit(n).select("artifact_id", "artifact_type", "raw", "full_occurrences", "novel_occurrences", "full_items", "novel_items", "inflation")


def first_seen(items: DataFrame) -> DataFrame:
    return items.where("actor_label_id is not null and time_ts is not null").groupBy("actor_label_id").agg(F.min("time_ts").alias("first_ts"))


def arrivals(items: DataFrame, bucket: str = "week") -> DataFrame:
    return first_seen(items).groupBy(F.date_trunc(bucket, "first_ts").cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("labels"))


def arrival_burst(items: DataFrame) -> DataFrame:
    """One row: labels, busiest_week (ties: the earliest), its labels, share."""
    weeks = arrivals(items)
    out = weeks.agg(F.coalesce(F.sum("labels"), F.lit(0)).alias("labels"), F.min_by("bucket", F.struct(-F.col("labels"), "bucket")).alias("busiest_week"), F.coalesce(F.max("labels"), F.lit(0)).alias("busiest_week_labels"))
    return out.withColumn("share", F.round(F.col("busiest_week_labels") / F.when(F.col("labels") > 0, F.col("labels")), 3))


def caveat(items: DataFrame) -> str:
    """What every report says about itself; with a burst of arrivals, that too."""
    b = arrival_burst(items).first()
    text = "Cues and counts are patterns in recorded text, not verdicts. Order and gaps use recorded times of unknown precision. The same number may come from independent work on the same data."
    if b["share"] is not None and b["share"] >= 0.25:
        text += f" {b['share']:.0%} of {b['labels']:,} labels first appear in the week of {str(b['busiest_week'])[:10]}, so equal content in that week needs no relaying."
    return text


def topic_summary(items: DataFrame, hits: DataFrame, refs: DataFrame, exchange: DataFrame, meta: DataFrame) -> DataFrame:
    """By topic: volume, cue items as a map, references to pages that the author never wrote, label mentions, exchanges, and the span of time."""
    about = topic_of(items.select("item_id", "actor_label_id", "stream_key", "time_ts", "generated"), meta)
    of = about.select("item_id", "topic", "actor_label_id")
    volume = about.groupBy("topic").agg(F.count_if(~F.coalesce("generated", F.lit(False))).alias("revisions"), F.count_distinct(F.when(~F.coalesce("generated", F.lit(False)), F.col("actor_label_id"))).alias("labels"), F.count_distinct(F.when(~F.coalesce("generated", F.lit(False)), F.col("stream_key"))).alias("pages"), F.min("time_ts").alias("first_time"), F.max("time_ts").alias("last_time"))
    cues = hits.select("item_id", "category").join(of, "item_id").groupBy("topic", "category").agg(F.count_distinct("item_id").alias("n")).groupBy("topic").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("cues"))
    wrote = items.where("actor_label_id is not null and stream_key is not null").select(F.col("stream_key").alias("target_id"), "actor_label_id").distinct()
    strange = refs.where("target_kind = 'page' and resolved").join(of.where("actor_label_id is not null"), "item_id").join(wrote, ["target_id", "actor_label_id"], "left_anti")
    strange = strange.groupBy("topic").agg(F.count("*").alias("refs_to_pages_never_written"), F.count_distinct(F.struct("actor_label_id", "target_id")).alias("author_page_pairs"))
    mentions = refs.where("ref_type = 'label_mention' and resolved").join(of, "item_id").groupBy("topic").agg(F.count_distinct(F.struct("item_id", "target_id")).alias("label_mentions"))
    pairs = exchange.join(of.select(F.col("item_id").alias("a_item_id"), "topic"), "a_item_id").groupBy("topic").agg(F.count("*").alias("exchanges"), F.count_distinct(F.struct(F.least("a_label_id", "b_label_id"), F.greatest("a_label_id", "b_label_id"))).alias("exchange_label_pairs"))
    out = volume.join(cues, "topic", "left").join(strange, "topic", "left").join(mentions, "topic", "left").join(pairs, "topic", "left")
    return out.fillna(0, ["refs_to_pages_never_written", "author_page_pairs", "label_mentions", "exchanges", "exchange_label_pairs"])


def answer_events(items: DataFrame, hits: DataFrame, meta: DataFrame) -> DataFrame:
    """topic, number (without separators), raw, item_id, actor_label_id, stream_key, time_ts for each number on a line with an answer cue; years and very large numbers are left out."""
    on = hits.where("category = 'answer_sharing'").select("item_id", "line_no").distinct()
    texts = items.join(on.select("item_id").distinct(), "item_id", "left_semi").select("item_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("line_no", "line"))
    rows = on.join(texts, ["item_id", "line_no"]).join(topic_of(items.select("item_id", "actor_label_id", "stream_key", "time_ts"), meta), "item_id")
    line = F.regexp_replace("line", ADDRESS, " ")
    keep = ("topic", "item_id", "actor_label_id", "stream_key", "time_ts", "line_no")
    found = each(rows.withColumn("found", F.regexp_extract_all(line, F.lit(NUMBER), F.lit(0))), F.col("found"), "raw", *keep)
    found = found.withColumn("number", F.regexp_replace(F.replace("raw", F.lit(","), F.lit("")), "%+$", ""))
    value = F.col("number").try_cast("double")
    return found.where(value.isNotNull() & (value < 1e9) & ~(value.between(1900, 2100) & ~F.col("number").contains(".")))


def answer_numbers(events: DataFrame, least: int = 2) -> DataFrame:
    """Numbers that several labels wrote: labels, pages, who was first and how many others followed within a day."""
    key = ["topic", "number"]
    known = F.col("time_ts").isNotNull() & F.col("actor_label_id").isNotNull()
    order = F.when(known, F.struct("time_ts", "actor_label_id", "item_id"))
    groups = events.groupBy(*key).agg(F.count_distinct("actor_label_id").alias("labels"), F.count_distinct("stream_key").alias("pages"), F.min_by("actor_label_id", order).alias("first_label_id"), F.min(F.when(known, F.col("time_ts"))).alias("first_time")).where(F.col("labels") >= least)
    soon = events.where(known).join(groups.select(*key, "first_label_id", "first_time"), key).where("actor_label_id <> first_label_id and time_ts <= first_time + interval 24 hours").groupBy(*key).agg(F.count_distinct("actor_label_id").alias("other_labels_within_24h"))
    return groups.join(soon, key, "left").fillna(0, ["other_labels_within_24h"])


def answer_provenance(events: DataFrame, refs: DataFrame) -> DataFrame:
    """By topic: shared numbers, later repetitions by new labels, and how many of those name or link an earlier writer.

    A label's first event after another label's is a repetition. In recorded order (ties by label, then item) earlier writers are those of smaller rank.
    """
    key = ["topic", "number"]
    rows = events.where("time_ts is not null and actor_label_id is not null").select(*key, "time_ts", "actor_label_id", "item_id", "stream_key", "line_no")
    shared = events.groupBy(*key).agg(F.count_distinct("actor_label_id").alias("labels")).where("labels >= 2").select(*key)
    order = Window.partitionBy(*key).orderBy("time_ts", "actor_label_id", "item_id", "line_no")
    ranked = rows.join(shared, key).withColumn("rank", F.row_number().over(order))
    firsts = ranked.groupBy(*key, "actor_label_id").agg(F.min_by(F.struct("rank", "item_id"), "rank").alias("f")).select(*key, "actor_label_id", "f.*")
    repeats = firsts.where("rank > 1")
    targets = refs.where("resolved").select("item_id", "target_id").distinct()
    writers = ranked.groupBy(*key, F.col("actor_label_id").alias("target_id")).agg(F.min("rank").alias("since")).unionByName(ranked.where("stream_key is not null").groupBy(*key, F.col("stream_key").alias("target_id")).agg(F.min("rank").alias("since")))
    pointed = repeats.join(targets, "item_id").join(writers, [*key, "target_id"]).where("since < rank").select(*key, "actor_label_id").distinct()
    by_topic = shared.groupBy("topic").agg(F.count("*").alias("shared_numbers"))
    out = by_topic.join(repeats.groupBy("topic").agg(F.count("*").alias("repetitions_by_new_labels")), "topic", "left").join(pointed.groupBy("topic").agg(F.count("*").alias("with_explicit_pointer")), "topic", "left").fillna(0)
    return out.withColumn("share_with_pointer", F.round(F.col("with_explicit_pointer") / F.when(F.col("repetitions_by_new_labels") > 0, F.col("repetitions_by_new_labels")), 3))


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://([^/:?#]+)", 1)


def host_adoption(appearance: DataFrame, artifact: DataFrame, hits: DataFrame, least: int = 5) -> DataFrame:
    """Hosts that several labels wrote newly: who first, how many others within a day, and in how many items a bypass cue is on the same line."""
    new = appearance.where(F.col("novelty").isin(*NOVEL) & F.col("actor_label_id").isNotNull() & F.col("time_ts").isNotNull())
    rows = new.join(artifact.where("artifact_type = 'url'").select("artifact_id", host_of(F.col("normalized")).alias("host")), "artifact_id").select("host", "actor_label_id", "time_ts", "item_id", "line_no")
    cued = hits.where("category = 'bypass_circumvention'").select("item_id", "line_no", F.lit(True).alias("bypass")).distinct()
    rows = rows.join(cued, ["item_id", "line_no"], "left")
    groups = rows.groupBy("host").agg(F.count_distinct("actor_label_id").alias("labels"), F.min_by("actor_label_id", F.struct("time_ts", "actor_label_id")).alias("first_label"), F.min("time_ts").alias("first_time"), F.count_distinct("item_id").alias("revisions"), F.count_distinct(F.when(F.col("bypass"), F.col("item_id"))).alias("revisions_with_bypass_cue")).where(F.col("labels") >= least)
    soon = rows.join(groups.select("host", "first_label", "first_time"), "host").where("actor_label_id <> first_label and time_ts <= first_time + interval 24 hours").groupBy("host").agg(F.count_distinct("actor_label_id").alias("other_labels_within_24h"))
    return groups.join(soon, "host", "left").fillna(0, ["other_labels_within_24h"])


def category_adoption(items: DataFrame, hits: DataFrame, bucket: str = "week") -> DataFrame:
    """By bucket of arrival and category: labels that arrived, those that ever use the cue, and those that use it in their first item."""
    first = first_seen(items).select("actor_label_id", F.date_trunc(bucket, "first_ts").cast("timestamp_ntz").alias("bucket"))
    opening = items.where("actor_label_id is not null and time_ts is not null").groupBy("actor_label_id").agg(F.min_by("item_id", F.struct("time_ts", "item_id")).alias("first_item"))
    used = hits.join(items.where("actor_label_id is not null").select("item_id", "actor_label_id"), "item_id").join(opening, "actor_label_id", "left")
    used = used.groupBy("actor_label_id", "category").agg(F.max(F.coalesce(F.col("item_id") == F.col("first_item"), F.lit(False))).alias("at_once"))
    all_pairs = first.crossJoin(F.broadcast(hits.select("category").distinct()))  # labels times categories of the lexicon
    out = all_pairs.join(used, ["actor_label_id", "category"], "left").groupBy("category", "bucket").agg(F.count("*").alias("arrivals"), F.count_if(F.col("at_once").isNotNull()).alias("arrivals_using_cue"), F.count_if("at_once").alias("arrivals_using_cue_at_once"))
    return out.withColumn("share", F.round(F.col("arrivals_using_cue") / F.col("arrivals"), 3))


def exchange_report(items: DataFrame, exchange: DataFrame, hits: DataFrame, refs: DataFrame, labels: DataFrame, meta: DataFrame, limit: int = 40) -> DataFrame:
    """The fastest exchanges with names, cues of both sides and the first mention of each in context."""
    top = exchange.orderBy("seconds", "a_item_id", "b_item_id").limit(limit)
    cues = hits.groupBy("item_id").agg(F.sort_array(F.collect_set("category")).alias("cues"))  # at most the lexicon's categories
    mention = refs.where("ref_type = 'label_mention' and resolved").groupBy("item_id").agg(F.min(F.struct("span_start", "span_end")).alias("m"))
    about = topic_of(items.select("item_id", "stream_key", "text"), meta)
    zero = F.lit(0)
    start, end = F.coalesce("m.span_start", zero), F.coalesce("m.span_end", zero)

    def side(name: str) -> DataFrame:
        own = top.select(F.col(f"{name}_item_id").alias("item_id")).distinct()
        rows = own.join(about, "item_id").join(cues, "item_id", "left").join(mention, "item_id", "left")
        return rows.select(F.col("item_id").alias(f"{name}_item_id"), F.col("topic").alias(f"{name}_topic"), F.coalesce("cues", F.array().cast("array<string>")).alias(f"{name}_cues"), F.struct(*snippet(F.col("text"), start, end, 120, 220)).alias(f"{name}_snippet"))

    names = labels.select("label_id", "display_name")
    out = top.join(side("a"), "a_item_id").join(side("b"), "b_item_id")
    for k in ("a", "b"):
        out = out.join(names.select(F.col("label_id").alias(f"{k}_label_id"), F.col("display_name").alias(f"{k}_label")), f"{k}_label_id", "left")
    return out.select("seconds", F.col("a_topic").alias("topic"), *(f"{k}_{c}" for k in ("a", "b") for c in ("item_id", "label", "snippet", "cues")))
