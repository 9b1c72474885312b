"""Integrity gates: each tells its name, whether it passed, and the counts it looked at."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimp.model import Corpus
from palimp.operators.artifacts import with_event_index
from palimp.operators.lineage import lines
from palimp.plans.cases import answer_table

#: Prefixes of identifiers, and encodings whose digests can be checked.
IDS = r"^(av|wiki|art|edge|doc|page|conv|ev|user):"
LABELS = r"^(av:(agent|user)|wiki:label|doc:source|page:lang|conv:role|user):"
CODECS = {"ascii": "US-ASCII", "utf8": "UTF-8", "latin1": "ISO-8859-1"}
TIERS = ("source_recorded", "rule_derived", "model_proposed", "human_reviewed")
LINKED_KINDS = {"aivillage": ("AGENT_TALK", "chat_agent"), "wiki": ("save", "wiki_revision")}


def count(df: DataFrame) -> int:
    return df.count()


def counts_of(df: DataFrame, **what) -> dict[str, int]:
    """Rows that fulfil each condition, in one pass."""
    return df.agg(*(F.count_if(c).alias(k) for k, c in what.items())).first().asDict()


def _gate(name: str, must_be_zero: dict[str, int], told: dict | None = None, also: bool = True) -> tuple[str, bool, str]:
    return name, also and not any(must_be_zero.values()), " ".join(f"{k}={v}" for k, v in (must_be_zero | (told or {})).items())


def one_record_per_action(c: Corpus) -> tuple[str, bool, str]:
    linked = c.text_item.where("event_id is not null")
    zero = {"doubled": count(linked.groupBy("event_id", "kind").count().where("count > 1")), "dangling": count(linked.join(c.event, "event_id", "left_anti"))}
    told, also = {}, True
    if kinds := LINKED_KINDS.get(c.source):
        told = {"events": count(c.event.where(F.col("kind") == kinds[0]))} | counts_of(c.text_item.where(F.col("kind") == kinds[1]), items=F.lit(True), unlinked=F.col("event_id").isNull())
        also = told["events"] == told["items"] and not told["unlinked"]
    return _gate("one record per source action", zero, told, also)


def label_integrity(c: Corpus) -> tuple[str, bool, str]:
    name = F.col("display_name")
    zero = counts_of(c.actor_label, bad_labels=~F.col("label_id").rlike(LABELS), merged=F.col("identity_status") != "unverified_label", empty=F.col("label_id").endswith(":") | (name.isNotNull() & (F.trim(name) == "")))
    zero["bad_ids"] = count(c.text_item.where(~F.col("item_id").rlike(IDS))) + count(c.event.where(~F.col("event_id").rlike(IDS)))
    known = c.actor_label.select(F.col("label_id").alias("actor_label_id"))
    zero["orphans"] = sum(count(t.where("actor_label_id is not null").join(known, "actor_label_id", "left_anti")) for t in (c.event, c.text_item))
    return _gate("ids are namespaced, labels unmerged, unknown authors stay unknown", zero, {"unknown": sum(count(t.where("actor_label_id is null")) for t in (c.event, c.text_item))})


#: Sequence numbers of a bucket, in which events are put in order by one task.
BUCKET = 1_000_000


def inversions(event: DataFrame) -> DataFrame:
    """Events whose time is before that of the event before them in sequence. Buckets of the sequence are ordered each for itself; the first of a bucket looks at the last of the one before."""
    rows = event.where("event_index is not null").select("event_id", "event_index", "time_ts", F.floor(F.col("event_index") / BUCKET).alias("bucket"))
    order = Window.partitionBy("bucket").orderBy("event_index")
    inside = rows.withColumn("n", F.row_number().over(order)).withColumn("inside", F.lag("time_ts").over(order))
    last = rows.groupBy("bucket").agg(F.max_by("time_ts", "event_index").alias("last"))
    ends = last.select("bucket", F.lag("last").over(Window.orderBy("bucket")).alias("end"))  # a row for each bucket
    before = F.when(F.col("n") == 1, F.col("end")).otherwise(F.col("inside"))
    return inside.join(ends, "bucket").withColumn("before", before).where("before > time_ts").select("event_id", "event_index", "time_ts", "before")


def sequence_gaps(event: DataFrame) -> DataFrame:
    """The gaps of the sequence, found without a global order: an index whose predecessor is missing, but for the first."""
    have = event.where("event_index is not null").select("event_index").distinct()
    starts = have.join(have.select((F.col("event_index") + 1).alias("event_index")), "event_index", "left_anti")
    first = have.agg(F.min("event_index").alias("least"))
    return starts.join(F.broadcast(first), F.col("event_index") > F.col("least"), "left_semi")  # one row is broadcast


def times(c: Corpus) -> tuple[str, bool, str]:
    zero = counts_of(c.event, unparsed=F.col("time_ts").isNull() & F.col("source_time").isNotNull(), invented_bounds=F.col("time_lower").isNotNull() | F.col("time_upper").isNotNull())
    return _gate("source times are kept, no bounds invented", zero, {"inversions": count(inversions(c.event)), "without_sequence": count(c.event.where("event_index is null"))})


def lineage_accounting(c: Corpus) -> tuple[str, bool, str]:
    s, n = c["lineage_summary"], F.col
    parts = n("n_new") + n("n_modified") + n("n_restored") + n("n_first_observed")
    start = n("lineage_status").isin("first_in_stream", "page_created")
    zero = counts_of(
        s,
        bad_sums=n("n_lines") != n("n_inherited") + parts,
        bad_first=(n("lineage_status") == "first_in_stream") & (n("n_inherited") + n("n_new") + n("n_modified") + n("n_restored") > 0),
        bad_created=(n("lineage_status") == "page_created") & (n("n_inherited") + n("n_modified") + n("n_restored") + n("n_first_observed") > 0),
        bad_later=~start & ((n("n_first_observed") > 0) | n("base_item_id").isNull()),
    )
    zero["not_one_start"] = count(s.groupBy("stream_key").agg(F.count_if(start).alias("starts")).where("starts <> 1"))
    base = s.select(n("item_id").alias("base_item_id"), n("stream_key").alias("base_stream"))
    zero["cross_stream"] = count(s.join(base, "base_item_id").where("base_stream <> stream_key"))
    zero["change_difference"] = abs(count(c["text_change"]) - (s.agg(F.sum(parts).alias("n")).first()["n"] or 0))
    return _gate("lineage counts add up, starts are labelled, no base in another stream", zero)


def explicit_bases(c: Corpus) -> tuple[str, bool, str]:
    based = c.text_item.where("base_item_id is not null").select("item_id", "base_item_id")
    order = Window.partitionBy("stream_key").orderBy("stream_seq", "item_id")
    before = c.text_item.where("stream_key is not null and stream_seq is not null").select("item_id", F.lag("item_id").over(order).alias("before"))
    zero = {
        "not_predecessor": count(based.join(before, "item_id").where("not (base_item_id <=> before)")),
        "missing": count(based.join(c.text_item.select(F.col("item_id").alias("base_item_id")), "base_item_id", "left_anti")),
        "doubled_sequence": count(c.text_item.where("stream_seq is not null").groupBy("stream_key", "stream_seq").count().where("count > 1")),
    }
    return _gate("explicit bases are the predecessor, sequence numbers unique", zero, {"explicit": count(based)})


def source_hashes(c: Corpus) -> tuple[str, bool, str]:
    digest = F.lit(None).cast("string")
    for name, charset in CODECS.items():
        digest = F.when(F.col("source_encoding") == name, F.sha2(F.encode("text", charset), 256)).otherwise(digest)
    rows = c.text_item.where("source_sha256 is not null").withColumn("digest", digest)
    zero = counts_of(rows, mismatches=F.col("digest") != F.col("source_sha256"), unknown_encodings=F.col("digest").isNull())
    return _gate("declared digests follow from the stored text", zero, {"checked": count(rows)})


def independent_lineage(c: Corpus, sample: int = 200, seed: str = "7") -> tuple[str, bool, str]:
    """Inherited lines of sampled versions again, by a semi join of lines with the base's."""
    s = c["lineage_summary"].where("base_item_id is not null").orderBy(F.md5(F.concat("item_id", F.lit(seed))), "item_id").limit(sample).select("item_id", "base_item_id", "n_inherited")
    texts = c.text_item.select("item_id", "text")
    now = lines(texts.join(s.select("item_id"), "item_id", "left_semi")).join(s, "item_id")
    old = lines(texts.join(s.select(F.col("base_item_id").alias("item_id")), "item_id", "left_semi")).select(F.col("item_id").alias("base_item_id"), "line").distinct()
    again = now.join(old, ["base_item_id", "line"], "left_semi").groupBy("item_id").agg(F.count("*").alias("n"))
    return _gate("inherited counts agree with an independent computation", {"mismatches": count(s.join(again, "item_id", "left").where("n_inherited <> coalesce(n, 0)"))}, {"sampled": count(s)})


def citations(c: Corpus, sample: int = 20, seed: str = "7") -> tuple[str, bool, str]:
    some = c["artifact_counts"].where("novel_items >= 2").orderBy(F.md5(F.concat("artifact_id", F.lit(seed))), "artifact_id").limit(sample).select("artifact_id")
    some = c.spark.createDataFrame([r.asDict() for r in some.collect()], "artifact_id string")  # sample rows
    of_some = {k: c[k].join(F.broadcast(some), "artifact_id", "left_semi") for k in ("artifact", "artifact_counts", "appearance", "evidence_edge")}
    given = answer_table(replace(c, derived=c.derived | of_some))
    cites = given.select("artifact_id", F.explode("citations").alias("x")).select("artifact_id", "x.*").join(c.text_item.select("item_id", "text"), "item_id", "left")
    told = given.agg(F.count_distinct("artifact_id").alias("n")).first()["n"]
    bad = count(cites.where(~F.substring("text", F.col("span_start") + 1, F.col("span_end") - F.col("span_start")).eqNullSafe(F.col("snippet"))))
    at = ["artifact_id", "item_id", "span_start", "span_end"]  # carried lines hold artifacts too, so all occurrences are looked at
    places = c["occurrence"].select(*at).unionByName(c["appearance"].select(*at)).distinct()
    spans = places.join(c.text_item.select("item_id", "text"), "item_id").join(c["artifact"].select("artifact_id", "artifact_type", "raw"), "artifact_id")
    cut = F.substring("text", F.col("span_start") + 1, F.col("span_end") - F.col("span_start"))
    bad_span = cut.isNull() | (F.length(cut) != F.col("span_end") - F.col("span_start"))
    seen = spans.agg(F.count_if(bad_span).alias("bad_spans"), F.count("*").alias("spans"), F.count_distinct("artifact_id", "item_id").alias("held"), F.count_if(cut == F.col("raw")).alias("first_form")).first().asDict()
    zero = {"citation_problems": bad, "bad_spans": seen.pop("bad_spans")}
    return _gate("citations and spans resolve to source text", zero, seen | {"answered": told})


def edge_rules(c: Corpus) -> tuple[str, bool, str]:
    e = c["evidence_edge"]
    zero = counts_of(e, directed=F.col("directed") & F.col("relation").isin("same_content", "possible_reuse"), bad_tier=~F.col("evidence_tier").isin(*TIERS), no_alternatives=F.col("alternatives").isNull())
    about = with_event_index(c.text_item.select("item_id", "actor_label_id", "event_id", "generated"), c.event)
    side = lambda k: about.select(F.col("item_id").alias(f"{k}_item_id"), F.col("actor_label_id").alias(f"{k}_label"), F.col("event_index").alias(f"{k}_index"), F.col("generated").alias(f"{k}_generated"))
    both = e.join(side("src"), "src_item_id").join(side("dst"), "dst_item_id")
    zero |= counts_of(both, one_label=F.coalesce(F.col("src_label") == F.col("dst_label"), F.lit(True)), generated=F.col("src_generated") | F.col("dst_generated"), bad_sequence=(F.col("temporal_status") == "sequence_ordered") & (F.col("src_index") >= F.col("dst_index")))
    return _gate("edges join labels, claim no direction, have tiers and alternatives", zero, {"edges": count(e)})


def artifact_rules(c: Corpus) -> tuple[str, bool, str]:
    n = c["artifact_counts"]
    more = F.lit(False)
    for what in ("occurrences", "items", "labels"):
        more = more | (F.col(f"novel_{what}") > F.col(f"full_{what}"))
    zero = counts_of(n, novel_over_full=more) | {"orphans": count(n.join(c["artifact"], "artifact_id", "left_anti"))}
    return _gate("artifact counts are consistent", zero, counts_of(n, only_restored=F.col("novel_occurrences") == 0))


GENERIC = (one_record_per_action, label_integrity, times, lineage_accounting, explicit_bases, source_hashes, independent_lineage, artifact_rules, citations, edge_rules)


def run(c: Corpus, raw: str | None = None) -> list[tuple[str, bool, str]]:
    """All gates of a corpus; for the wiki layout with its raw folder, those of the files too."""
    out = [g(c) for g in GENERIC]
    if raw is not None and c.source == "wiki":
        from palimp.sources import wiki

        out += wiki.raw_gates(c.spark, raw)
    return out


def as_table(c: Corpus, results: list[tuple[str, bool, str]]) -> DataFrame:
    return c.spark.createDataFrame(results, "gate string, passed boolean, detail string")
