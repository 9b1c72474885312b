"""The reference's operators against plain versions and small corpora with exact expectations."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from palimp import engine
from palimp.functions import patterns
from palimp.functions.similarity import common_subsequence, ratio
from palimp.operators import artifacts, cues, edges, lineage, references, similarity
from palimp.plans import cases, gates, reports, review
from palimp.sources import agentlog, readers, wiki
from palimp.streaming.lineage import incremental_counts
from tests.corpora import LINE, URL, board, coordination, revision, write_agent_log, write_wiki

ITEM = "item_id string, actor_label_id string, event_id string, time_ts timestamp_ntz, text string, stream_key string, stream_seq long, base_item_id string, base_note string, generated boolean, kind string"


def items(spark, rows):
    """rows: (item, text, stream, seq[, base, note, label])"""
    full = [(r[0], r[6] if len(r) > 6 else "l", None, None, r[1], r[2], r[3], r[4] if len(r) > 4 else None, r[5] if len(r) > 5 else None, False, "memory") for r in rows]
    return spark.createDataFrame(full, ITEM)


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    return engine.build(agentlog.load(spark, write_agent_log(tmp_path_factory.mktemp("log"))), str(tmp_path_factory.mktemp("log-built")))


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    revs, more = board()
    raw = write_wiki(tmp_path_factory.mktemp("wiki"), revs, more_events=more)
    return engine.build(wiki.load(spark, raw), str(tmp_path_factory.mktemp("wiki-built"))), raw


@pytest.fixture(scope="module")
def talk(spark, tmp_path_factory):
    revs, families = coordination()
    return engine.build(wiki.load(spark, write_wiki(tmp_path_factory.mktemp("talk"), revs, families)), str(tmp_path_factory.mktemp("talk-built")))


def test_spans_are_code_points(spark):
    texts = ["", "no", "\U0001f600 ab12 \u00fc ab3", "ab1ab2", "x\nab9", "ab7"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", patterns.spans(F.col("t"), "ab[0-9]+").alias("s"), patterns.blanked(F.col("t"), "ab[0-9]+").alias("b")).collect():
        assert [(s.start, s.end, s.raw) for s in r.s] == [(m.start(), m.end(), m[0]) for m in re.finditer("ab[0-9]+", texts[r.i])]
        assert r.b == re.sub("ab[0-9]+", lambda m: " " * len(m[0]), texts[r.i])


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
        row = new
    return row[-1]


def test_common_subsequence():
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abcä") for _ in range(r.randint(0, 30))) for _ in "ab")
        assert common_subsequence(a, b) == slow_lcs(a, b)
        score = 200 * slow_lcs(a, b) / (len(a) + len(b)) if a or b else 100.0
        assert ratio(a, b, 80) == (score if score >= 80 else 0)


def sequential(rows):
    """Line classes by reading each stream in order."""
    out, streams = {}, {}
    for item, text, stream, _seq, _base, note in sorted(rows, key=lambda r: (r[2], r[3], r[0])):
        before, seen, started = streams.get(stream, (set(), set(), False))
        own = [(n, x.rstrip()) for n, x in enumerate(text.split("\n")) if x.strip()]
        now = {x for _, x in own}
        for n, x in own:
            if not started:
                kind = "new" if note == "page_created" else "first_observed"
            elif x in before:
                kind = "inherited"
            elif x in seen:
                kind = "restored"
            else:
                best = max((ratio(x, old, 80) for old in before - now), default=0) if len(x) >= 20 else 0
                kind = "modified" if best else "new"
            out[item, n] = kind
        streams[stream] = (now, seen | now, True)
    return out


def test_lineage_is_the_sequential_reading(spark):
    r = random.Random(4)
    pool = ["alpha beta gamma delta epsilon", "alpha beta gamma delta epsilom", "zeta eta theta iota kappa lambda", "short", "tail  \t", "", "  ", "\u3000wide\u3000", "mu nu xi omicron pi rho sigma"]
    rows = []
    for s in range(6):
        for v in range(8):
            lines = [r.choice(pool) + ("x" if r.random() < 0.1 else "") for _ in range(r.randint(0, 6))]
            rows.append((f"i{s}-{v}", "\n".join(lines), f"mem:{s}", v, None, "page_created" if s % 2 and v == 0 else None))
    df = items(spark, rows)
    got = lineage.line_classes(df)
    assert {(x.item_id, x.line_no): x.classification for x in got.collect()} == sequential(rows)
    s = {x.item_id: x for x in lineage.lineage_summary(df).collect()}
    assert len(s) == len(rows) and all(x.n_lines == x.n_inherited + x.n_new + x.n_modified + x.n_restored + x.n_first_observed for x in s.values())
    assert s["i1-0"].lineage_status == "page_created" and s["i0-0"].lineage_status == "first_in_stream" and s["i0-1"].base_item_id == "i0-0"
    assert lineage.line_classes(df.limit(0)).count() == 0


def test_base_faults(spark):
    df = items(spark, [("a", "x", "s", 1), ("b", "x", "s", 2, "a"), ("c", "x", "s", 3, "a"), ("d", "x", "s", 4, None, "page_created")])
    assert {r.item_id for r in lineage.base_faults(df).collect()} == {"c", "d"}


def test_artifacts(spark):
    texts = {
        "a": "see HTTPS no, https://User@Ex.org:080/Path?q#F. and (http://ex.org/x) http://localhost/ http://h:99999/ http://h:0/y? http://${H}/z",
        "b": "ids abc1234 deadbeef 1234567 0abc12f-1 f00dfeed1 ABC12345 550e8400-e29b-41d4-a716-446655440000",
        "c": "Owner/Repo.X#12 fix #7 a/b#123456789 x/y#3a https://g.org/o/r#5 end",
        "d": "\U0001f600 abc1234\n\nhttps://e.org/abc1234",
        "e": None,
    }
    df = items(spark, [(k, t, None, None) for k, t in texts.items()])
    got = {}
    for r in artifacts.hits(df).collect():
        assert texts[r.item_id][r.span_start : r.span_end] == r.raw and texts[r.item_id][: r.span_start].count("\n") == r.line_no
        got.setdefault(r.item_id, []).append((r.artifact_type, r.normalized))
    assert got["a"] == [("url", "https://User@ex.org:80/Path?q#F"), ("url", "http://ex.org/x"), ("url", "http://h/y")]
    assert sorted(got["b"]) == [("hex_id", "abc1234"), ("hex_id", "f00dfeed1")]
    assert got["c"] == [("url", "https://g.org/o/r#5"), ("repo_ref", "owner/repo.x#12")]
    assert got["d"] == [("url", "https://e.org/abc1234"), ("hex_id", "abc1234")]


def test_cues(spark):
    text = "The ANSWER is antworten, LÖSUNGEN; known   answers https://x.org/answer no_answer please\tpost answered"
    df = items(spark, [("a", text, None, None)])
    got = cues.cue_hits(df, lineage.text_change(df)).orderBy("category", "span_start").collect()
    assert [(r.category, r.term) for r in got] == [("answer_sharing", t) for t in ("answer", "antworten", "lösungen", "known answers", "answered")] + [("request_relay", "please post")]
    assert all(re.sub(r"\s+", " ", text[r.span_start : r.span_end].lower()) == r.term for r in got)


def test_agent_log(spark, log):
    assert {r["name"]: r["n"] for r in readers.row_counts({"event": log.event, "text_item": log.text_item}, ()).collect()} == {"event": 8, "text_item": 14}
    kinds = {r.kind: r.n for r in log.text_item.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"chat_agent": 3, "chat_human": 1, "memory": 5, "session_goal": 1, "computer_session_summary": 1, "generated_summary": 1, "village_goal": 1, "agent_goal": 1}
    labels = {r.label_id: r for r in log.actor_label.collect()}
    assert labels["av:user:u1"].display_name == "Anna" and labels["av:user:u2"].display_name is None and set(labels) == {"av:agent:a1", "av:agent:a2", "av:user:u1", "av:user:u2"}
    ev = {r.event_index: r for r in log.event.collect()}
    assert ev[1].input_tokens == 12 and ev[1].cost is None and ev[10].actor_label_id is None
    assert log["lineage_summary"].count() == 6
    n = log["artifact_counts"].join(log["artifact"].where(F.col("normalized") == URL.replace("Example", "example")), "artifact_id").first()
    assert (n.full_occurrences, n.novel_occurrences, n.full_items, n.novel_items, n.full_labels, n.novel_labels) == (7, 5, 7, 5, 2, 2)
    assert log["appearance"].where("novelty = 'restored'").count() == 1
    classes = {(r.item_id, r.line_no): r.classification for r in log["text_change"].collect()}
    assert classes["av:mem:m2", 1] == "modified" and classes["av:mem:m2", 2] == "new" and classes["av:mem:m4", 0] == "restored"
    e = {r.dst_item_id: r for r in log["evidence_edge"].collect()}
    assert set(e) == {"av:chat:c2", "av:mem:m5"} and e["av:chat:c2"].temporal_status == "sequence_ordered" and not e["av:chat:c2"].directed
    assert json.loads(e["av:chat:c2"].support)["src"]["item_id"] == "av:chat:c1"
    assert edges.same_content(log["appearance"], log.event, log["artifact"], log["artifact_counts"], 3).count() == 0
    assert edges.skipped(log["artifact_counts"], 3).first()[0] == 1
    assert gates.sequence_gaps(log.event).count() == 2
    assert [g for g in gates.run(log) if not g[1]] == []


def test_questions_and_pages(log):
    a = log["artifact"].where(F.col("normalized").contains("example.org")).first().artifact_id
    given = cases.answers(log, a)
    assert [g["id"] for g in given] == ["earliest", "introducers", "activity", "spread", "references", "resemble", "changes", "warnings", "alternatives", "unreconstructable"]
    assert given[0]["citations"][0]["snippet"] == URL and given[0]["status"] == "supported"
    by = {g["id"]: g for g in given}
    assert by["introducers"]["claim"] == "2 label(s) wrote it in new text: Alpha 3; Beta 2." and by["spread"]["claim"].startswith("First ") and by["spread"]["claim"].endswith("2 label(s) in all.")
    assert by["alternatives"]["claim"] == "2 of 7 occurrences are carried forward." and by["warnings"]["status"] == "unknown" and by["unreconstructable"]["claim"].startswith("2 gaps in the event sequence; ")
    every = {(r.artifact_id, r.id): r for r in cases.answer_table(log).collect()}
    assert all(every[a, g["id"]].claim == g["claim"] and every[a, g["id"]].status == g["status"] for g in given) and len({k for k, _ in every}) == log["artifact"].count()
    assert cases.unresolved_citations(log, given) == []
    given[0]["citations"][0]["span_start"] += 1
    assert len(cases.unresolved_citations(log, given)) == 1
    with pytest.raises(KeyError):
        cases.answers(log, "art:url:none")
    e = engine.Engine(log)
    data = e.case(a)
    assert data["counts"]["full_occurrences"] == 7 and len(data["edges"]) == 2
    data["artifact"]["raw"] = "</script>\u2028"
    assert "</script>\u2028" not in cases.html_page(data) and "\\u003c/script>\\u2028" in cases.html_page(data)
    assert "example" in e.export(a).lower() and json.loads(e.export(a, "json"))["counts"]["novel_items"] == 5
    assert e.graph(a)["omitted"] == 0 and len(e.graph(a)["nodes"]) == 3
    assert e.item("av:mem:m4")["lines"][1]["class"] == "blank" and e.item("av:mem:m2")["lines"][0]["class"] == "inherited"
    found = e.search("example.org/data", kind=None)
    assert found["artifacts"].count() == 1 and {r.kind for r in found["texts"].collect()} >= {"chat_agent", "session_goal"} and "memory" not in {r.kind for r in found["texts"].collect()}
    assert e.search_timeline("SHARED source")[0] == 4
    assert cases.pick(log).first().artifact_id == a
    assert e.topics() == {"available": False} or e.topics()["available"]
    assert e.stats()["kinds"] and e.datasets()["tables"]["event"] == 8


def test_wiki(spark, pages):
    c, raw = pages
    assert (c.text_item.count(), c.event.count(), {r.display_name for r in c.actor_label.collect()}) == (4, 6, {"Alice", "Bob", "Admin"})
    texts = {r.source_id: r for r in c.text_item.collect()}
    assert texts["r1"].text == "Grüße\nzwei" and texts["r4"].text == "café" and texts["r3"].actor_label_id is None
    status = {r.item_id: (r.lineage_status, r.n_inherited, r.n_new) for r in c["lineage_summary"].collect()}
    assert status == {"wiki:rev:r1": ("page_created", 0, 2), "wiki:rev:r2": ("explicit_base", 2, 1), "wiki:rev:r3": ("explicit_base", 2, 0), "wiki:rev:r4": ("first_in_stream", 0, 0)}
    assert [g for g in gates.run(c, raw) if not g[1]] == []
    bad = c.text_item.withColumn("text", F.when(F.col("source_id") == "r2", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    assert not gates.source_hashes(engine.Corpus(spark, bad, c.event, c.actor_label, c.stream_meta, source="wiki"))[1]


@pytest.mark.parametrize("what", ["hunk", "hash", "base", "event", "file"])
def test_corrupt_files_fail(spark, tmp_path, what):
    revs, more = board()
    if what == "hunk":
        revs[1]["hunks"][0]["b1"] = 1
    if what == "hash":
        revs[0]["body_sha256"] = "0" * 64
    if what == "base":
        revs[2]["diff_base"] = "r1"
    raw = write_wiki(tmp_path, revs, more_events=more[1:] if what == "event" else more)
    if what == "event":
        m = json.loads((tmp_path / "manifest.json").read_text())
        m["population_counts"]["delete"]["value"] = 5
        (tmp_path / "manifest.json").write_text(json.dumps(m))
    if what == "file":
        (tmp_path / "pages.jsonl").write_text((tmp_path / "pages.jsonl").read_text() + "\n")
    assert not all(g[1] for g in wiki.raw_gates(spark, raw))


def test_coordination(talk):
    refs = {(r.item_id[-2:], r.ref_type, r.target_text, r.resolved) for r in talk["reference"].collect()}
    assert refs == {("r1", "wiki_url", "RelayPage02", True), ("r2", "wikilink", "DataPage01", True), ("r2", "label_mention", "BravoBot8", True), ("r3", "label_mention", "AlphaBot7", True)}
    x = talk["exchange"].collect()
    assert [(r.a_item_id[-2:], r.b_item_id[-2:], r.seconds) for r in x] == [("r2", "r3", 5400)]
    cells = {(r.topic, r.category): r["items"] for r in cues.matrix(talk.text_item, talk["cue_hit"], talk.stream_meta).collect()}
    assert cells["data-test", "answer_sharing"] == 2 and cells["relay", "answer_sharing"] == 0
    e = engine.Engine(talk)
    numbers = {r.number: r for r in reports.answer_numbers(e.answer_events()).collect()}
    assert set(numbers) == {"4512"} and numbers["4512"].labels == 2 and numbers["4512"].first_label_id == "wiki:label:AlphaBot7" and numbers["4512"].other_labels_within_24h == 1
    p = reports.answer_provenance(e.answer_events(), talk["reference"]).first()
    assert (p.shared_numbers, p.repetitions_by_new_labels, p.with_explicit_pointer, p.share_with_pointer) == (1, 1, 1, 1.0)
    row = e.exchanges().first()
    assert row.a_label == "AlphaBot7" and row.a_snippet.match == "BravoBot8" and row.b_cues == ["answer_sharing"] and row.topic == "relay"
    t = {r.topic: r for r in e.traces()["topics"].collect()}
    assert t["relay"].exchanges == 1 and t["relay"].label_mentions == 1 and t["data-test"].cues == {"answer_sharing": 2}
    burst = reports.arrival_burst(talk.text_item).first()
    assert (burst.labels, burst.busiest_week_labels) == (3, 2) and "67%" in reports.caveat(talk.text_item)
    assert sum(r.arrivals for r in reports.category_adoption(talk.text_item, talk["cue_hit"]).where("category = 'answer_sharing'").collect()) == 3


def test_exports_and_reviews(spark, log, tmp_path):
    e = engine.Engine(log)
    names = e.export_reports(str(tmp_path / "out"))
    assert "inflation.csv" in names and "7" in (tmp_path / "out" / "inflation.csv").read_text()
    edge = log["evidence_edge"].first().edge_id
    path = str(tmp_path / "reviews")
    e.review(path, edge, "r1", "accepted")
    e.review(path, edge, "r2", "rejected", "no")
    assert review.decisions(log, path, edge).count() == 2
    with pytest.raises(KeyError):
        e.review(path, "edge:none", "r1", "accepted")
    with pytest.raises(ValueError):
        e.review(path, edge, "r1", "maybe")
    pack = review.pack(log)
    assert pack["edges"].count() == 1 and pack["lineage"].count() > 0 and "classification" not in review.blind(pack["lineage"]).columns
    near = review.predecessors(log).where("item_id = 'av:mem:m2' and rank = 1").collect()
    assert near and max(r.score for r in near) > 80
    w = review.wilson(spark.createDataFrame([(0, 0), (10, 10)], "hits long, n long")).collect()
    assert w[0].share is None and w[1].high == 1.0 and abs(w[1].low - 0.7225) < 1e-3


def test_candidates(spark, log):
    from datetime import datetime

    a = log["artifact"].where(F.col("normalized").contains("example.org")).first().artifact_id
    say = f"{URL} shows that the third quarter numbers were revised twice after the audit in spring"
    copy = "someone else says the third quarter numbers were revised twice after the audit in spring too"
    rows = [("s", "la", say, 1), ("c", "lb", copy, 2), ("same", "la", copy, 2), ("far", "lc", copy, 9)] + [(f"b{k}", f"l{k}", "please remember to be kind and useful to all people", 2) for k in range(6)]
    df = spark.createDataFrame([(i, who, None, datetime(2024, 3, day), t, None, None, None, None, False, "chat_agent") for i, who, t, day in rows], ITEM)
    app = artifacts.appearance(artifacts.occurrences(df, lineage.text_change(df)))
    got = similarity.possible_reuse(df, app, lineage.text_change(df), log.event, a).collect()
    assert [(r.src_item_id, r.dst_item_id, r.relation) for r in got] == [("s", "c", "possible_reuse")]
    old = log["evidence_edge"].unionByName(spark.createDataFrame([r.asDict() for r in got], log["evidence_edge"].schema))
    again = similarity.rebuilt(old, spark.createDataFrame([r.asDict() for r in got], log["evidence_edge"].schema), a)
    assert again.count() == old.count()


def test_readers(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "g1", "t", bytearray(b"x")), ("2024-01-02 00:00:00", "g2", None, None), ("bad", "g1", "u", None)], "ts string, goal string, text string, shot binary")
    assert readers.write_parquet(df, str(tmp_path / "goals-00000-of-00001.parquet")) == 3
    back = readers.read_parquet(spark, [str(tmp_path / "goals-00000-of-00001.parquet")], ["ts", "goal"], F.col("goal") == "g1")
    assert back.count() == 2
    assert [r.goal for r in readers.sliced(df, "ts", "2024-01-01", "2024-01-02").collect()] == ["g1"]
    assert readers.sliced(df, one_of={"goal": ["g1"]}).count() == 2
    for bad in ({}, {"one_of": {"nope": ["x"]}}):
        with pytest.raises(ValueError):
            readers.sliced(df, **bad)
    assert readers.exclusions(df.schema) == {"shot": "binary type"}
    p = {r.column: (r.rows, r.nulls) for r in readers.null_profile(df).collect()}
    assert p["text"] == (3, 1)
    assert readers.table_name("data/agents/train-00000-of-00002.parquet") == "agents" and readers.table_name("x/events.jsonl.gz") == "events"
    assert readers.matching(["events", "events_raw"], "events") == ["events"] and readers.matching(["events"], "ven") == ["events"]
    assert readers.catalog(spark, str(tmp_path)).where("column = 'shot'").first().excluded == "binary type"
    (tmp_path / "a.csv").write_text("a,b\n1,x\n")
    assert readers.read_any(spark, str(tmp_path / "a.csv")).first().b == "x"
    with pytest.raises(ValueError):
        readers.read_any(spark, "a.xlsx")
    assert readers.csv_text([{"b": 1}, {"a": [1]}]).splitlines()[0] == "a,b"


def test_growing_streams_agree_with_the_batch(spark, tmp_path):
    r = random.Random(6)
    rows = [(f"i{s}-{v}", "\n".join(r.choice(["a", "b", "c", "d", " "]) for _ in range(5)), f"mem:{s}", v) for v in range(5) for s in range(3)]
    df = items(spark, rows)
    for v in range(5):
        df.where(F.col("stream_seq") == v).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = incremental_counts(stream).writeStream.format("memory").queryName("grown").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {x.item_id: (x.n_lines, x.n_inherited, x.n_restored, x.n_first_observed, x.n_unseen) for x in spark.sql("select * from grown").collect()}
    want = {x.item_id: (x.n_lines, x.n_inherited, x.n_restored, x.n_first_observed, x.n_new + x.n_modified) for x in lineage.lineage_summary(df).collect()}
    assert got == want


def test_constants():
    assert LINE.count(URL) == 1 and revision(1, "w~x", 1, "a", "b")["lines"] == 1
    assert references.NAME_CHARS == 8


def test_review_pack_and_scores(spark, log, tmp_path):
    key = review.write_pack(log, str(tmp_path))
    assert [k["number"] for k in key][:2] == ["R001", "R002"] and {k["section"] for k in key} >= {"edges", "extractions", "lineage", "questions"}
    page = (tmp_path / "review_pack.html").read_text()
    assert "innerHTML" not in page and page.count("</script>") == 2 and "temporal_status" not in page and '"classification"' not in page
    assert any("temporal_status" in k for k in json.loads((tmp_path / "review_key.json").read_text())["items"])
    assert key == review.write_pack(log, str(tmp_path))
    edge, line = (next(k["number"] for k in key if k["section"] == s) for s in ("edges", "lineage"))
    right = review.LINEAGE_ANSWER[next(k for k in key if k["number"] == line)["classification"]]
    given = [{"reviewer": "A", "results": {edge: {"first": "accept", "second": "none"}, line: {"first": right}}}, {"reviewer": "B", "results": {edge: {"first": "uncertain"}, line: {"first": right}, "R999": {"first": "x"}}}]
    marks = review.marks(spark, {"items": key}, given)
    counts = {r.measure: (r.hits, r.n) for r in review.tally(marks).collect()}
    kind = next(k["classification"] for k in key if k["number"] == line)
    status = next(k["temporal_status"] for k in key if k["number"] == edge)
    assert counts == {"same_content (all)": (1, 2), f"same_content / {status}": (1, 2), "same_content: uncertain": (1, 2), "same_content: text shows a handoff": (0, 1), "lineage (all)": (2, 2), f"lineage / {kind}": (2, 2)}
    assert {r.section: (r.agreed, r.both) for r in review.agreement(marks).collect()} == {"edges": (0, 1), "lineage": (1, 1)} and "| 1/2 |" in review.scores(marks) and "- lineage: 1/1" in review.scores(marks)


@pytest.mark.parametrize("ranges", [True, False])
def test_fetch(spark, tmp_path, ranges):
    import gzip
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from palimp.sources import fetch

    data, asked = gzip.compress(random.Random(1).randbytes(25_000)), []

    class Server(BaseHTTPRequestHandler):
        def do_GET(self):
            first, last = map(int, self.headers["Range"][6:].split("-")) if ranges else (0, len(data))
            asked.append(first)
            self.send_response(416 if first >= len(data) else 206 if ranges else 200)
            self.end_headers()
            self.wfile.write(data[first : last + 1])

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/x/events.jsonl.gz"
    for size in (4096, len(data), 1 << 20):  # pieces, one that ends where the file does, and a short one
        asked.clear()
        begun = fetch.Pieces(tmp_path / "part.gz", size)
        begun.add(data[:size])
        assert begun.fetch(url).read_bytes() == data and (0 not in asked or not ranges) and not begun.folder.exists()
    (path,) = fetch.fetch([url], tmp_path)
    assert path.name == "events.jsonl.gz" and fetch.facts(path)["events.jsonl"].bytes == 25_000
    with pytest.raises(ValueError):
        fetch.facts(path, 25_000 - 1)
    server.shutdown()
    table = str(tmp_path / "snapshots")
    first, second = (fetch.note(spark, table, source, [path], terms="none").first() for source in ("a", "b"))
    assert first.snapshot_id == second.snapshot_id and spark.read.parquet(table).count() == 2 and [f.name for f in first.files] == ["events.jsonl.gz", "events.jsonl"]
    assert fetch.mismatched(spark, table, {"events.jsonl": "0", "events.jsonl.gz": first.files[0].sha256}).count() == 2


def test_unpack(tmp_path):
    import zipfile

    from palimp.sources import fetch

    def archive(**members):
        with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
            for k, v in members.items():
                z.writestr(k, v)
        return tmp_path / "a.zip"

    assert [p.relative_to(tmp_path / "z").as_posix() for p in fetch.unpack(archive(**{"p/all.csv": b"1", "p/other.csv": b"2"}), tmp_path / "z", ["all*"], 100)] == ["p/all.csv"]
    for evil in ("../e.csv", "/abs/e.csv", "C:/e.csv", "p/../../e.csv"):
        with pytest.raises(ValueError, match="unsafe"):
            fetch.unpack(archive(**{"fine.csv": b"y", evil: b"x"}), tmp_path / "y", ["*"], 100)
    with pytest.raises(ValueError, match="limit"):
        fetch.unpack(archive(big=b"0" * 500), tmp_path / "y", ["*"], 100)
    assert not (tmp_path / "y").exists()


def test_command_line(spark, tmp_path, capsys):
    from palimp.__main__ import main

    raw, built = tmp_path / "raw", tmp_path / "built"
    raw.mkdir()
    revs, more = board()
    write_wiki(raw, revs, more_events=more)
    common = ["--raw", str(raw), "--built", str(built)]
    assert main(["build", *common]) == 0 and main(["gates", *common]) == 0
    assert "FAIL" not in capsys.readouterr().out
    assert main(["export", *common, "--out", str(tmp_path / "out")]) == 0 and (tmp_path / "out" / "burst.csv").exists()


def test_inversions_across_buckets(spark, monkeypatch):
    from datetime import datetime, timedelta

    monkeypatch.setattr(gates, "BUCKET", 4)
    r = random.Random(3)
    rows = [(f"e{k}", k, datetime(2024, 1, 1) + timedelta(minutes=r.randint(0, 30))) for k in sorted(r.sample(range(60), 35))]
    got = {x.event_id for x in gates.inversions(spark.createDataFrame(rows, "event_id string, event_index long, time_ts timestamp_ntz")).collect()}
    assert got == {b[0] for a, b in zip(rows, rows[1:]) if a[2] > b[2]}
