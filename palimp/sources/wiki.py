"""Adapter of the wiki layout: revisions, events, labels, pages and a manifest as JSON, and the gates of those files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimp.model import Corpus, shaped, text_items
from palimp.sources.readers import file_digests, read_document, read_ndjson, unpivot_attributes

REVISION = "rev_id string, page_id string, page_key string, wiki string, name string, seq long, body string, body_len long, body_sha256 string, lines long, diff_base string, diff_base_reason string, hunks array<struct<op:string,a0:long,a1:long,b0:long,b1:long>>, label string, ip16 string, time string, time_grade string, winning_clock string, uncertainty_seconds long, body_encoding string"
EVENT = "event_id string, event_type string, page_key string, time string, time_grade string, revision_ref string, actor_label string, winning_clock string, uncertainty_seconds long"
LABEL = "label string, stored_revisions string, first_write string, last_write string"
PAGE = "page_id string, page_key string, wiki string, page_family string, page_family_confidence string, page_family_method string, page_family_cohort string, bucket string"
MANIFEST = "generated_at string, cut struct<field:string,operator:string,value:string>, counts struct<revisions:struct<value:long>,pages:struct<value:long>,labels:struct<value:long>>, population_counts map<string,struct<value:long>>"
META = ["page_family", "page_family_confidence", "page_family_method", "page_family_cohort", "bucket"]
#: Declared encodings and their charsets.
CHARSETS = {"ascii": "UTF-8", "utf8": "UTF-8", "latin1": "ISO-8859-1"}


def body_bytes(body: Column) -> Column:
    """A body is stored as one character for each byte."""
    return F.encode(body, "ISO-8859-1")


def decoded(body: Column, encoding: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, charset in CHARSETS.items():
        out = F.when(encoding == name, F.decode(body_bytes(body), charset)).otherwise(out)
    return out


def label_id(name: Column) -> Column:
    """An empty label is an unknown author."""
    return F.when(name != "", F.concat(F.lit("wiki:label:"), name))


def at(time: Column) -> Column:
    return time.try_cast("timestamp").cast("timestamp_ntz")


def clock(grade: Column, winner: Column, seconds: Column) -> Column:
    return F.concat_ws(";", F.concat(F.lit("grade="), grade), F.concat(F.lit("clock="), winner), F.concat(F.lit("uncertainty_seconds="), seconds.cast("string")))


def _raw(spark: SparkSession, raw: str) -> dict[str, DataFrame]:
    return {n: read_ndjson(spark, f"{raw}/{n}.jsonl", s) for n, s in (("revisions", REVISION), ("events", EVENT), ("labels", LABEL), ("pages", PAGE))} | {"manifest": read_document(spark, f"{raw}/manifest.json", MANIFEST)}


def load(spark: SparkSession, raw: str) -> Corpus:
    r = _raw(spark, raw)
    revs, events = r["revisions"], r["events"]
    snap = f"wiki:{r['manifest'].first()['generated_at']}"
    saves = events.where("event_type = 'save'").groupBy(F.col("revision_ref").alias("rev_id")).agg(F.max("event_id").alias("save_event"))
    base = F.when(F.col("diff_base").isNotNull() & (F.col("diff_base") != ""), F.concat(F.lit("wiki:rev:"), "diff_base"))
    note = F.when(base.isNotNull(), "explicit").when(F.col("diff_base_reason") == "page_created", "page_created").otherwise("incomplete")
    items = revs.join(saves, "rev_id", "left").select(
        F.concat(F.lit("wiki:rev:"), "rev_id").alias("item_id"), F.lit(snap).alias("snapshot_id"), F.lit("wiki_revision").alias("kind"), label_id(F.col("label")).alias("actor_label_id"),
        F.concat(F.lit("wiki:ev:"), "save_event").alias("event_id"), F.col("time").alias("source_time"), at(F.col("time")).alias("time_ts"), decoded(F.col("body"), F.col("body_encoding")).alias("text"),
        F.concat(F.lit("page:"), "page_key").alias("stream_key"), F.lit("revisions.jsonl").alias("source_file"), F.lit("revisions").alias("source_table"), F.col("rev_id").alias("source_id"),
        F.col("seq").alias("stream_seq"), base.alias("base_item_id"), note.alias("base_note"), F.col("body_sha256").alias("source_sha256"), F.col("body_encoding").alias("source_encoding"),
    )
    of_rev = revs.select(F.col("rev_id").alias("revision_ref"), F.col("label").alias("rev_label"), clock(F.col("time_grade"), F.col("winning_clock"), F.col("uncertainty_seconds")).alias("rev_clock"), F.lit(True).alias("has_rev"))
    saved = F.col("event_type") == "save"
    evs = events.join(of_rev, "revision_ref", "left").select(
        F.concat(F.lit("wiki:ev:"), "event_id").alias("event_id"), F.lit(snap).alias("snapshot_id"), F.col("event_type").alias("kind"), F.when(saved, label_id(F.col("rev_label"))).otherwise(label_id(F.col("actor_label"))).alias("actor_label_id"),
        F.col("time").alias("source_time"), at(F.col("time")).alias("time_ts"), F.when(saved & F.col("has_rev"), F.col("rev_clock")).otherwise(clock(F.col("time_grade"), F.col("winning_clock"), F.col("uncertainty_seconds"))).alias("clock_provenance"),
        F.lit("events.jsonl").alias("source_file"), F.col("event_id").alias("source_id"),
    )
    listed = r["labels"].where("label <> ''").groupBy("label").agg(F.min(at(F.col("first_write"))).alias("first_seen"), F.max(at(F.col("last_write"))).alias("last_seen"))
    others = events.where("actor_label <> ''").select(F.col("actor_label").alias("label")).distinct().join(listed, "label", "left_anti")
    actors = listed.unionByName(others, True).select(label_id(F.col("label")).alias("label_id"), F.lit(snap).alias("snapshot_id"), F.lit("label").alias("kind"), F.col("label").alias("display_name"), "first_seen", "last_seen", F.lit("unverified_label").alias("identity_status"))
    meta = unpivot_attributes(r["pages"].withColumn("stream_key", F.concat(F.lit("page:"), "page_key")), "stream_key", META).select("stream_key", F.col("attribute").alias("key"), "value", F.lit("pages.jsonl").alias("source_file"))
    first = Window.partitionBy("page_key").orderBy("seq")
    starts = revs.select("page_key", "diff_base_reason", F.row_number().over(first).alias("n")).where("n = 1").agg(F.count("*").alias("pages"), F.count_if(~F.col("diff_base_reason").eqNullSafe("page_created")).alias("incomplete")).first()
    notes = f"{starts['incomplete']} of {starts['pages']} pages start with incomplete lineage."
    digests = file_digests(spark, f"{raw}/*.json*").agg(F.sort_array(F.collect_list(F.struct("name", "bytes", "sha256"))).alias("files"))  # a handful of files
    snapshot = shaped(digests.select(F.lit(snap).alias("snapshot_id"), F.lit("wiki").alias("source"), F.current_timestamp().cast("string").alias("created_at"), F.lit("wiki-1").alias("importer_version"), "files", F.lit(notes).alias("coverage_notes")), "snapshot")
    actor = shaped(actors, "actor_label")
    names = shaped(actor.select("label_id", F.col("display_name").alias("name"), "first_seen", "last_seen"), "actor_label_name")
    return Corpus(spark, text_items(items), shaped(evs, "event"), actor, shaped(meta, "stream_meta"), snapshot, names, source="wiki")


def hunk_faults(revs: DataFrame) -> DataFrame:
    """Revisions whose hunks don't lead from the base to them: rev_id, fault. Between hunks base and revision must have the same lines; hunks are in order and in range."""
    line = lambda c: F.split(c, "\n", -1)
    base = revs.select(F.col("rev_id").alias("diff_base"), F.col("body").alias("base_body"))
    rows = revs.where("diff_base is not null").join(base, "diff_base").select("rev_id", "hunks", line(F.col("base_body")).alias("a"), line(F.col("body")).alias("b"))
    zero = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(True).alias("ok"))

    def same(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
        fits = (a1 >= a0) & (b1 >= b0) & ((a1 - a0) == (b1 - b0)) & (a1 <= F.size("a")) & (b1 <= F.size("b"))
        cut = lambda x, s, e: F.slice(x, (s + 1).cast("int"), F.greatest(e - s, F.lit(0)).cast("int"))
        return fits & (cut(F.col("a"), a0, a1) == cut(F.col("b"), b0, b1))

    def step(acc: Column, h: Column) -> Column:
        return F.struct(h["a1"].alias("a"), h["b1"].alias("b"), (acc["ok"] & same(acc["a"], h["a0"], acc["b"], h["b0"]) & (h["a1"] >= h["a0"]) & (h["b1"] >= h["b0"])).alias("ok"))

    end = F.aggregate(F.coalesce("hunks", F.array().cast("array<struct<op:string,a0:long,a1:long,b0:long,b1:long>>")), zero, step)
    ok = end["ok"] & same(end["a"], F.size("a").cast("long"), end["b"], F.size("b").cast("long"))
    return rows.select("rev_id", ok.alias("ok")).where("not coalesce(ok, false)").select("rev_id", F.lit("hunks don't lead from base to revision").alias("fault"))


def raw_gates(spark: SparkSession, raw: str) -> list[tuple[str, bool, str]]:
    from palimp.plans.gates import _gate

    r = _raw(spark, raw)
    revs, events, out = r["revisions"], r["events"], []
    try:
        sums = spark.read.text(f"{raw}/SHA256SUMS").select(F.split(F.trim("value"), r"\s+\*?", 2).alias("p")).select(F.col("p")[1].alias("name"), F.col("p")[0].alias("want"))
        bad = file_digests(spark, f"{raw}/*.json*").join(sums, "name").where("sha256 <> want").count()
        out.append(_gate("files have their published digests", {"mismatches": bad}))
    except Exception as e:  # the sums are optional
        if "PATH_NOT_FOUND" not in str(e):
            raise
        out.append(_gate("files have their published digests", {"mismatches": 0}, {"sums": "absent"}))
    text = decoded(F.col("body"), F.col("body_encoding"))
    again = F.lit(None).cast("string")
    for name, charset in CHARSETS.items():
        again = F.when(F.col("body_encoding") == name, F.sha2(F.encode(text, charset), 256)).otherwise(again)
    out.append(_gate("bodies have their digests and decode without loss", {"digest": revs.where(F.sha2(body_bytes(F.col("body")), 256) != F.col("body_sha256")).count(), "round_trip": revs.where(again.isNull() | (again != F.col("body_sha256"))).count()}))
    out.append(_gate("hunks and line counts agree with bodies", {"hunks": hunk_faults(revs).count(), "lines": revs.where(F.size(F.split("body", "\n", -1)) != F.col("lines")).count()}))
    before = revs.withColumn("before", F.lag("rev_id").over(Window.partitionBy("page_key").orderBy("seq")))
    out.append(_gate("a base is the revision before on the same page", {"other": before.where("diff_base is not null and not (diff_base <=> before)").count(), "absent": before.where("diff_base is null and before is not null").count()}))
    saves = events.where("event_type = 'save'").select("revision_ref", F.col("time").alias("event_time"))
    both = saves.join(revs.select(F.col("rev_id").alias("revision_ref"), F.col("time").alias("rev_time")), "revision_ref", "full_outer")
    out.append(_gate("save events and revisions match one to one", {"unmatched": both.where("event_time is null or rev_time is null or event_time <> rev_time").count(), "doubled": saves.groupBy("revision_ref").count().where("count > 1").count()}))
    m = r["manifest"].first()
    have = {"revisions": revs.count(), "pages": r["pages"].count(), "labels": r["labels"].count()}
    kinds = {x["event_type"]: x["n"] for x in events.groupBy("event_type").agg(F.count("*").alias("n")).collect()}
    wrong = {k: int(have[k] != m["counts"][k]["value"]) for k in have} | {f"event_{k}": int(kinds.get(k, 0) != v["value"]) for k, v in (m["population_counts"] or {}).items()}
    out.append(_gate("counts agree with the manifest", wrong | {"blank_labels": max(0, r["labels"].where("label = ''").count() - 1)}))
    return out
