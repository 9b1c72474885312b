"""Small synthetic corpora in the three layouts."""

import gzip
import hashlib
import json

URL = "https://Example.org/data?id=7"
LINE = f"Shared source: {URL}, checked twice"


def write_agent_log(folder) -> str:
    def ev(n, index, **data):
        return {"id": f"e{n}", "event_index": index, "created_at": f"2024-03-01 10:{n:02d}:00.000001", "data": data}

    def mem(n, agent, *lines):
        return {"id": f"m{n}", "agent_id": agent, "content": "\n".join(lines), "created_at": f"2024-03-02 0{n}:00:00"}

    long = "the plan for today is to read all the reports carefully"
    tables = {
        "agents": [{"id": "a1", "name": "Alpha", "model_string": "m-1"}, {"id": "a2", "name": "Beta", "model_string": "m-2"}],
        "events": [
            ev(1, 1, actionType="AGENT_TALK", speakerId="a1", roomId="r", messageId="c1", inputTokens="12", cost="x"),
            ev(2, 2, actionType="AGENT_TALK", speakerId="a2", roomId="r", messageId="c2"),
            ev(3, 4, actionType="AGENT_TALK", speakerId="a1", roomId="r", messageId="c3"),
            ev(4, 5, actionType="USER_TALK", speakerId="u1", speakerName="Ann", messageId="gone", content="only in the event", roomId="r"),
            ev(5, 6, actionType="USER_NAME_CHANGE", userId="u1", newName="Anna"),
            ev(6, 7, actionType="USER_TALK", speakerId="u2", speakerName="", content="no message id"),
            ev(7, 9, actionType="STOP_USING_COMPUTER", agentId="a1", computerUseSessionId="s1", summary="done with it"),
            ev(8, 10, actionType="WAIT", agentId=""),
        ],
        "chat_messages": [{"id": f"c{k}", "agent_speaker_id": a, "user_speaker_id": None, "speaker_type": "agent", "content": t, "room_id": "r", "created_at": f"2024-03-01 10:0{k}:00"} for k, a, t in ((1, "a1", f"look at {URL}."), (2, "a2", f"thanks, {URL} works"), (3, "a1", "nothing here"))],
        "agent_memories": [mem(1, "a1", LINE, long), mem(2, "a1", LINE, long.replace("today", "tonight"), "a new line"), mem(3, "a1", "a new line"), mem(4, "a1", LINE, "", "a new line"), mem(5, "a2", LINE)],
        "computer_use_sessions": [{"id": "s1", "agent_id": "a1", "created_at": "2024-03-02 09:00:00", "session_goal": f"open {URL}"}],
        "agent_goals": [{"id": "g1", "agent_id": "a2", "name": "help", "start_time": "2024-03-01 00:00:00"}],
        "village_goals": [{"id": "v1", "goal": "be useful", "start_time": "2024-03-01 00:00:00"}],
        "summaries": [{"id": "x1", "type": "day", "content": f"they shared {URL}", "created_at": "2024-03-03 00:00:00"}],
    }
    for name, rows in tables.items():
        with gzip.open(folder / f"{name}.jsonl.gz", "wt", encoding="utf-8") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)
    return str(folder)


def revision(n, page, seq, text, label, base=None, reason=None, encoding="utf8", time=None, hunks=()):
    data = text.encode("latin-1" if encoding == "latin1" else "utf-8")
    body = data.decode("latin-1")
    return {"rev_id": f"r{n}", "page_id": f"p-{page}", "page_key": page, "wiki": page.split("~")[0], "name": page.split("~")[-1], "seq": seq, "body": body, "body_len": len(data), "body_sha256": hashlib.sha256(data).hexdigest(), "lines": body.count("\n") + 1,
            "diff_base": base, "diff_base_reason": reason, "hunks": list(hunks), "label": label, "ip16": "", "time": time or f"2024-05-01T0{n}:00:00Z", "time_grade": "a", "winning_clock": "server", "uncertainty_seconds": 1, "body_encoding": encoding}


def write_wiki(folder, revs, families=None, more_events=(), labels=None) -> str:
    events = [{"event_id": f"s{r['rev_id']}", "event_type": "save", "page_key": r["page_key"], "time": r["time"], "time_grade": "a", "revision_ref": r["rev_id"]} for r in revs] + list(more_events)
    names = labels if labels is not None else sorted({r["label"] for r in revs if r["label"]})
    pages = sorted({r["page_key"] for r in revs})
    tables = {
        "revisions": revs,
        "events": events,
        "labels": [{"label": n, "stored_revisions": "1", "first_write": "2024-05-01T00:00:00Z", "last_write": "2024-05-02T00:00:00Z"} for n in [*names, ""]],
        "pages": [{"page_id": f"p-{p}", "page_key": p, "wiki": "w", "page_family": (families or {}).get(p)} for p in pages],
    }
    for name, rows in tables.items():
        (folder / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows), encoding="utf-8")
    kinds = {k: sum(e["event_type"] == k for e in events) for k in ("save", "delete", "revert", "probe")}
    manifest = {"generated_at": "2024-06-01", "cut": {"field": "time", "operator": ">=", "value": "2024-01-01"}, "counts": {"revisions": {"value": len(revs)}, "pages": {"value": len(pages)}, "labels": {"value": len(names) + 1}}, "population_counts": {k: {"value": v} for k, v in kinds.items()}}
    (folder / "manifest.json").write_text(json.dumps(manifest), encoding="utf-8")
    sums = [f"{hashlib.sha256((folder / n).read_bytes()).hexdigest()} *{n}" for n in ("revisions.jsonl", "events.jsonl", "labels.jsonl", "pages.jsonl", "manifest.json")]
    (folder / "SHA256SUMS").write_text("\n".join(sums) + "\n")
    return str(folder)


def board() -> tuple[list[dict], list[dict]]:
    first = revision(1, "w~Start", 1, "Grüße\nzwei", "Alice", reason="page_created")
    second = revision(2, "w~Start", 2, "Grüße\nneu\nzwei", "Bob", base="r1", hunks=[{"op": "insert", "a0": 1, "a1": 1, "b0": 1, "b1": 2}])
    third = revision(3, "w~Start", 3, "neu\nzwei", "", base="r2", hunks=[{"op": "delete", "a0": 0, "a1": 1, "b0": 0, "b1": 0}])
    old = revision(4, "w~Alt", 9, "caf\xe9", "Alice", reason="earlier_revisions_not_published", encoding="latin1")
    more = [{"event_id": "d1", "event_type": "delete", "page_key": "w~Alt", "time": "2024-05-03T00:00:00Z", "actor_label": "Admin"}, {"event_id": "q1", "event_type": "probe", "page_key": "w~Alt", "time": "2024-05-04T00:00:00Z"}]
    return [first, second, third, old], more


def coordination() -> tuple[list[dict], dict[str, str]]:
    texts = [
        (1, "w~DataPage01", 1, "answer: 4,512 people\nsee https://h.example/wiki.cgi?action=x&id=RelayPage02 please", "AlphaBot7", "2024-05-01T01:00:00Z"),
        (2, "w~RelayPage02", 1, "BravoBot8 wrote Research about [[DataPage01|this]]", "AlphaBot7", "2024-05-01T02:00:00Z"),
        (3, "w~DataPage01", 2, "answer: 4,512 people\nsolution 4512 thanks AlphaBot7", "BravoBot8", "2024-05-01T03:30:00Z"),
        (4, "w~ProbePage3", 1, "just a test by nobody", "Research", "2024-05-09T03:30:00Z"),
    ]
    revs = [revision(n, page, seq, t, who, base="r1" if n == 3 else None, reason=None if n == 3 else "page_created", time=at) for n, page, seq, t, who, at in texts]
    return revs, {"w~DataPage01": "data-test", "w~RelayPage02": "relay", "w~ProbePage3": "probe"}
