"""Lexicon cues on new lines, and counts of them by topic. A cue is a matched word, never a verdict."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimp.functions.patterns import NOT_SPACE, SPACE_IN_LINE, WORD, blanked, each, line_of, snippet, spans
from palimp.model import topic_of

VERSION = "cues-1"
NEW_LINES = ("new", "modified", "first_observed")
ADDRESS = r"https?://" + NOT_SPACE + "+"
#: The default lexicon.
LEXICON = {
    "meta": {"version": "lexicon-1"},
    "categories": {
        "answer_sharing": {"terms": ["answer", "answers", "answered", "antwort*", "known answers", "exact value*", "final answer", "correct", "solution*", "lösung*", "ergebnis*"]},
        "request_relay": {"terms": ["relay*", "please post", "please report", "please share", "please send", "please answer", "please append", "urgent*", "asap", "cross-ping", "ping", "anyone", "do you have", "can you", "bitte"]},
        "timing_sync": {"terms": ["arrived", "deadline*", "cooldown*", "timer*", "countdown", "task clock", "scaffold clock", "cohort*", "tier", "slow-tier", "fast-tier", "synchroni*", "cadence", "due"]},
        "bypass_circumvention": {"terms": ["bypass*", "workaround*", "circumvent*", "proxy", "proxies", "mirror", "mirrors", "cors", "no_proxy", "unblock*", "blocked", "restriction*", "restricted", "forbidden", "denied", "firewall", "umgehen", "gesperrt", "blockiert"]},
        "environment_research": {"terms": ["scaffold*", "container*", "terminal*", "sandbox*", "system prompt", "tool", "tools", "environment", "network", "internet", "egress", "allowlist", "whitelist", "rate limit*", "monitored", "docker", "shell", "robots"]},
        "data_access": {"terms": ["cache", "cached", "caching", "full table", "full-table", "all-state", "sdmx", "querydata", "api", "endpoint*", "download*", "raw"]},
        "probing_testing": {"terms": ["test", "tests", "testing", "probe", "probing", "marker*", "safe to ignore", "curl", "link check", "can you see", "does this work", "temporary", "trial"]},
        "confirmation": {"terms": ["confirmed", "verified", "cross-check*", "independently", "reproduced", "replicated"]},
        "self_identification": {"terms": ["openai", "oai", "chatgpt", "gpt", "autonomous", "language model", "ai agent"]},
    },
}
#: A lexicon of frequent words of the driver's tables, so that benchmarks have something to count.
BENCH_LEXICON = {"meta": {"version": "bench-1"}, "categories": {"answer_sharing": {"terms": ["tier", "that", "para", "oder"]}, "bypass_circumvention": {"terms": ["with", "los", "dans"]}, "probing_testing": {"terms": ["test", "was", "les"]}}}


def load_lexicon(path: str | Path) -> dict:
    return tomllib.loads(Path(path).read_text(encoding="utf-8"))


def pattern(terms: list[str]) -> str:
    """One case-insensitive pattern of a category: longer terms first, a last * takes any word ending, a space any white space of the line."""
    def one(term: str) -> str:
        body = SPACE_IN_LINE.join("".join(rf"\x{{{ord(c):x}}}" if not (c.isalnum() or c == "_") else c for c in word) for word in term.rstrip("*").split(" ")).replace(SPACE_IN_LINE, SPACE_IN_LINE + "+")
        return body + (WORD + "*" if term.endswith("*") else "")

    every = "|".join(one(t) for t in sorted(terms, key=len, reverse=True))
    first = "".join(rf"\x{{{ord(t[0]):x}}}" for t in terms)  # most places fail on their first character, before the look behind
    return f"(?iu)(?=[{first}])(?<!{WORD})(?:{every})(?!{WORD})"


def cues_in(text: Column, lexicon: dict) -> Column:
    """category, term, start, end, line of all cues in a text; addresses never match."""
    masked = blanked(text, ADDRESS)

    def of(name: str, terms: list[str]) -> Column:
        term = lambda m: F.regexp_replace(F.lower(m["raw"]), SPACE_IN_LINE + "+", " ")
        return F.transform(spans(masked, pattern(terms)), lambda m: F.struct(F.lit(name).alias("category"), term(m).alias("term"), m["start"].alias("start"), m["end"].alias("end"), m["line"].alias("line")))

    return F.concat(*(of(name, spec["terms"]) for name, spec in lexicon["categories"].items()))


def cue_hits(items: DataFrame, text_change: DataFrame, lexicon: dict = LEXICON) -> DataFrame:
    """item_id, line_no, category, term, span_start, span_end, detector_version on lines of three characters or more: all of standalone items, the new ones of versions."""
    rows = items.where("not coalesce(generated, false)")
    # A cue of three characters makes its line long enough; only shorter ones have to look at it.
    short = F.filter(cues_in(F.col("text"), lexicon), lambda c: (c["end"] - c["start"] >= 3) | (F.length(line_of(F.col("text"), c["line"])) >= 3))
    found = each(rows.select("item_id", "stream_key", short.alias("c")), F.col("c"), "c", "item_id", "stream_key").withColumn("line_no", F.col("c.line"))
    new = text_change.where(F.col("classification").isin(*NEW_LINES)).select("item_id", "line_no", F.lit(True).alias("new"))
    found = found.join(new, ["item_id", "line_no"], "left").where("stream_key is null or new")
    return found.select("item_id", "line_no", "c.category", "c.term", F.col("c.start").alias("span_start"), F.col("c.end").alias("span_end"), F.lit(f"{VERSION}/{lexicon['meta']['version']}").alias("detector_version"))


def matrix(items: DataFrame, hits: DataFrame, meta: DataFrame, top: int | None = None) -> DataFrame:
    """topic, category, items, labels, hits, volume, all pairs present; with top, the topics of most cue items."""
    about = topic_of(items.where("not coalesce(generated, false)").select("item_id", "actor_label_id", "stream_key"), meta)
    cells = hits.select("item_id", "category").join(about, "item_id").groupBy("topic", "category").agg(F.count_distinct("item_id").alias("items"), F.count_distinct("actor_label_id").alias("labels"), F.count("*").alias("hits"))
    topics = about.groupBy("topic").agg(F.count("*").alias("volume"))
    if top is not None:
        best = cells.groupBy("topic").agg(F.sum("items").alias("n")).orderBy(F.desc("n"), "topic").limit(top)
        topics = topics.join(best.select("topic"), "topic")
    dense = topics.crossJoin(F.broadcast(hits.select("category").distinct()))  # as many rows as topics times categories of the lexicon
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("items", "labels", "hits")]
    return dense.join(cells, ["topic", "category"], "left").select("topic", "category", *zero, "volume")


def examples(items: DataFrame, hits: DataFrame, meta: DataFrame, topic: str | None = None, category: str | None = None, limit: int = 20, seed: str = "7", before: int = 100, after: int = 140) -> DataFrame:
    """The first cue of each item with its context, in the pseudo-random order of a digest."""
    some = hits.where(F.col("category") == category) if category else hits
    first = some.withColumn("n", F.row_number().over(Window.partitionBy("item_id", "category").orderBy("span_start", "span_end", "term"))).where("n = 1")
    rows = first.join(topic_of(items.select("item_id", "actor_label_id", "stream_key", "time_ts", "text"), meta), "item_id")
    rows = rows.where(F.col("topic") == topic) if topic else rows
    rows = rows.withColumn("order", F.md5(F.concat("item_id", F.lit(seed)))).orderBy("order", "item_id", "category").limit(limit)
    return rows.select("item_id", "topic", "category", "term", "actor_label_id", "time_ts", *snippet(F.col("text"), F.col("span_start"), F.col("span_end"), before, after))


def timeline(items: DataFrame, hits: DataFrame, bucket: str = "week") -> DataFrame:
    """bucket, category, items."""
    rows = hits.join(items.where("time_ts is not null").select("item_id", "time_ts"), "item_id")
    return rows.groupBy(F.date_trunc(bucket, "time_ts").cast("timestamp_ntz").alias("bucket"), "category").agg(F.count_distinct("item_id").alias("items"))


