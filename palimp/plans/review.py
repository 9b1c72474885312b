"""Reviews: blind samples for people, their scores with intervals, and append-only decisions on edges."""

from __future__ import annotations

import json
import random
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimp.model import Corpus
from palimp.plans import cases
from palimp.sources.readers import csv_text
from palimp.operators.lineage import line_classes, nearest_lines

DECISIONS = ("accepted", "rejected", "unclear")
REVIEW = "review_id string, edge_id string, reviewer string, decision string, note string, created_at timestamp_ntz"
SIZES = {"edges": 20, "candidates": 20, "extractions": 20, "lineage": 10, "cues": 20, "exchanges": 10, "references": 20, "questions": 3}
HIDDEN = ("classification", "similarity", "category", "evidence_tier", "temporal_status", "resolved", "support", "status", "novelty")
#: What answers count for, as section, turn of the answer, name of the measure and what is a hit, in SQL over the row's facts and its answer.
MEASURES = [
    ("edges", "first", "{relation} || ' (all)'", "answer = 'accept'"),
    ("edges", "first", "{relation} || ' / ' || {temporal_status}", "answer = 'accept'"),
    ("edges", "first", "{relation} || ': uncertain'", "answer = 'uncertain'"),
    ("edges", "second", "{relation} || ': text shows a handoff'", "answer = 'explicit'"),
    ("candidates", "first", "{relation} || ' (all)'", "answer = 'accept'"),
    ("candidates", "first", "{relation} || ': uncertain'", "answer = 'uncertain'"),
    ("extractions", "first", "'extraction (all)'", "answer = 'yes'"),
    ("extractions", "first", "'extraction / ' || {artifact_type}", "answer = 'yes'"),
    ("extractions", "second", "'extractions: distinctive'", "answer = 'distinctive'"),
    ("lineage", "first", "'lineage (all)'", "answer = {wanted}"),
    ("lineage", "first", "'lineage / ' || {classification}", "answer = {wanted}"),
    ("cues", "first", "'cues (all)'", "answer = 'yes'"),
    ("cues", "first", "'cues / ' || {category}", "answer = 'yes'"),
    ("cues", "first", "'cues: yes or partly'", "answer in ('yes', 'partly')"),
    ("exchanges", "first", "'exchanges'", "answer = 'yes'"),
    ("exchanges", "first", "'exchanges: yes or partly'", "answer in ('yes', 'partly')"),
    ("exchanges", "second", "'exchanges: answers or timing'", "answer in ('answers', 'timing')"),
    ("references", "first", "'references (all)'", "answer = 'yes'"),
    ("references", "first", "'references / ' || {ref_type}", "answer = 'yes'"),
    ("questions", "first", "'answers (all)'", "answer = 'correct'"),
    ("questions", "first", "'answers / ' || {question}", "answer = 'correct'"),
]
LINEAGE_ANSWER = {"inherited": "same", "restored": "same", "modified": "edit", "new": "new", "first_observed": "new"}


def digest_sample(df: DataFrame, key: str, n: int, seed: str = "7") -> DataFrame:
    """The n rows of least digest of key and seed: the same rows every time, and no shuffle of the table."""
    return df.orderBy(F.md5(F.concat(F.col(key), F.lit(seed))), key).limit(n)


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: str = "7") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.col(key), F.lit(seed))), key))
    return df.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")


def pack(c: Corpus, sizes: dict[str, int] = SIZES, seed: str = "7") -> dict[str, DataFrame]:
    """A table to review for each section; blind() hides what the rules said."""
    edges = c["evidence_edge"].where("relation = 'same_content'")
    one = edges.withColumn("n", F.row_number().over(Window.partitionBy("artifact_id").orderBy(F.md5(F.concat("edge_id", F.lit(seed)))))).where("n = 1").drop("n")
    extracted = c["appearance"].join(c["artifact"].select("artifact_id", "artifact_type", "raw"), "artifact_id").withColumn("id", F.concat_ws("#", "item_id", "span_start"))
    changed = c["text_change"].withColumn("id", F.concat_ws("#", "item_id", "line_no"))
    with_id = lambda df, *cols: df.withColumn("id", F.concat_ws("#", *cols))
    out = {
        "edges": digest_sample(one.withColumnRenamed("edge_id", "id"), "id", sizes["edges"], seed),
        "candidates": digest_sample(c["evidence_edge"].where("relation = 'possible_reuse'").withColumnRenamed("edge_id", "id"), "id", sizes["candidates"], seed),
        "extractions": stratified(extracted, "artifact_type", "id", sizes["extractions"], seed),
        "lineage": stratified(changed, "classification", "id", sizes["lineage"], seed),
        "cues": stratified(with_id(c["cue_hit"], "item_id", "span_start", "category"), "category", "id", sizes["cues"], seed),
        "exchanges": digest_sample(with_id(c["exchange"], "a_item_id", "b_item_id"), "id", sizes["exchanges"], seed),
        "references": stratified(with_id(c["reference"], "item_id", "span_start", "ref_type"), "ref_type", "id", sizes["references"], seed),
    }
    some = [r[0] for r in digest_sample(c["artifact_counts"].where("novel_items >= 2").select("artifact_id"), "artifact_id", sizes["questions"], seed).collect()]
    asked = [(f"{a}#{x['id']}", a, x["id"], x["question"], x["claim"], x["status"]) for a in some for x in cases.answers(c, a)]
    out["questions"] = c.spark.createDataFrame(asked, "id string, artifact_id string, question string, asked string, claim string, status string")
    return out


def blind(section: DataFrame) -> DataFrame:
    return section.drop(*HIDDEN)


def predecessors(c: Corpus, top: int = 3) -> DataFrame:
    """For lines said to be new or edited, the most similar lines of the version before."""
    return nearest_lines(line_classes(c.text_item), top)


def wilson(hits: DataFrame, z: float = 1.96) -> DataFrame:
    """hits and n by row: share and the bounds of its 95 % interval."""
    p, n = F.col("hits") / F.col("n"), F.col("n")
    middle, spread, over = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    bound = lambda x: F.when(n > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / over)), 4))
    return hits.withColumn("share", F.when(n > 0, F.round(p, 4))).withColumn("low", bound(middle - spread)).withColumn("high", bound(middle + spread))


def marks(spark: SparkSession, key: dict, reviews: list[dict]) -> DataFrame:
    """One row per answer: section, number, facts (what the key says), reviewer, turn, answer; answers to numbers that the key lacks don't count."""
    facts = [(r["number"], r["section"], {k: str(v) for k, v in r.items() if v is not None} | {"wanted": LINEAGE_ANSWER.get(r.get("classification"), "")}) for r in key["items"]]
    given = [(n, x["reviewer"], turn, answers[turn]) for x in reviews for n, answers in x["results"].items() for turn in ("first", "second") if answers.get("first") and answers.get(turn)]
    rows = spark.createDataFrame(facts, "number string, section string, facts map<string,string>")
    return spark.createDataFrame(given, "number string, reviewer string, turn string, answer string").join(rows, "number")


def tally(marks: DataFrame) -> DataFrame:
    """measure, hits, n, share, low, high over all reviewers."""
    sql = lambda text: F.expr(re.sub(r"\{(\w+)\}", r"facts['\1']", text))
    counts = F.array(*(F.when((F.col("section") == section) & (F.col("turn") == turn), F.struct(sql(name).alias("measure"), sql(hit).alias("hit"))) for section, turn, name, hit in MEASURES))
    each = marks.select(F.explode(F.filter(counts, lambda x: x.isNotNull())).alias("x"))
    return wilson(each.groupBy("x.measure").agg(F.count_if("x.hit").alias("hits"), F.count("*").alias("n")))


def agreement(marks: DataFrame) -> DataFrame:
    """section, agreed, both: how often reviewers who answered the same row first answered alike."""
    two = marks.where("turn = 'first'").groupBy("section", "number").agg(F.count_distinct("reviewer").alias("k"), F.count_distinct("answer").alias("different")).where("k >= 2")
    return two.groupBy("section").agg(F.count_if(F.col("different") == 1).alias("agreed"), F.count("*").alias("both"))


def scores(marks: DataFrame) -> str:
    """The tally as Markdown with 95 % intervals."""
    lines = [f"| {r.measure} | {r.hits}/{r.n} | {r.low:.2f}-{r.high:.2f} |" for r in tally(marks).orderBy("measure").collect()]
    alike = [f"- {r.section}: {r.agreed}/{r.both}" for r in agreement(marks).orderBy("section").collect()]
    return "\n".join(["| Measure | Hits | 95 % |", "|---|---|---|", *lines, *(["", "Agreement of reviewers:", "", *alike] if alike else [])]) + "\n"


def write_pack(c: Corpus, folder: str, sizes: dict[str, int] = SIZES, seed: str = "7") -> list[dict]:
    """Write a numbered pack: what reviewers see (JSON and an inert page), an answer sheet, and the key with what the rules said."""
    key = []
    for section, df in pack(c, sizes, seed).items():
        for r in sorted((r.asDict(True) for r in df.collect()), key=lambda r: r["id"]):  # as many as the sizes say
            key.append({"number": f"R{len(key) + 1:03d}", "section": section} | r)
    seen = [{k: v for k, v in r.items() if k not in HIDDEN} for r in key]
    Path(folder).mkdir(parents=True, exist_ok=True)
    dump = lambda name, data: Path(folder, name).write_text(json.dumps(data, ensure_ascii=False, default=str, indent=1), encoding="utf-8")
    dump("review_items.json", seen)
    dump("review_key.json", {"items": key})
    Path(folder, "review_sheet.csv").write_text(csv_text([{"number": r["number"], "section": r["section"], "first": "", "second": ""} for r in key]), encoding="utf-8")
    page = (
        '<!DOCTYPE html><meta charset="utf-8"><title>Review</title><body><script type="application/json" id="data">' + cases._safe(seen) + "</script><script>"
        "for(const r of JSON.parse(document.getElementById('data').textContent)){const p=document.createElement('pre');p.textContent=JSON.stringify(r,null,1);document.body.append(p)}</script></body>"
    )
    Path(folder, "review_pack.html").write_text(page, encoding="utf-8")
    return key


def record(c: Corpus, path: str, edge_id: str, reviewer: str, decision: str, note: str = "") -> str:
    """Append one decision. KeyError for an unknown edge, ValueError for an unknown decision."""
    if decision not in DECISIONS:
        raise ValueError(decision)
    if c["evidence_edge"].where(F.col("edge_id") == edge_id).limit(1).count() == 0:
        raise KeyError(edge_id)
    review_id = f"review:{random.getrandbits(64):016x}"
    row = c.spark.createDataFrame([(review_id, edge_id, reviewer, decision, note)], "review_id string, edge_id string, reviewer string, decision string, note string")
    row.withColumn("created_at", F.current_timestamp().cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(path)
    return review_id


def decisions(c: Corpus, path: str, edge_id: str | None = None) -> DataFrame:
    rows = c.spark.read.schema(REVIEW).parquet(path)
    return rows.where(F.col("edge_id") == edge_id) if edge_id else rows
