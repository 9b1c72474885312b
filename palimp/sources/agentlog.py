"""Adapter of the agent-log layout: events with a JSON document, chats, memories, sessions, goals and summaries as gzipped JSON lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimp.model import Corpus, shaped, text_items
from palimp.plans.gates import sequence_gaps
from palimp.sources.readers import file_digests, read_ndjson

TABLES = {
    "agents": "id string, name string, model_string string",
    "events": "id string, event_index long, data string, created_at string",
    "chat_messages": "id string, agent_speaker_id string, user_speaker_id string, speaker_type string, content string, room_id string, created_at string",
    "agent_memories": "id string, agent_id string, content string, created_at string",
    "computer_use_sessions": "id string, agent_id string, created_at string, session_goal string",
    "agent_goals": "id string, agent_id string, name string, start_time string",
    "village_goals": "id string, goal string, start_time string",
    "summaries": "id string, type string, content string, created_at string",
}
#: Texts that exist only in events: kind, action, field, prefix of the id.
EVENT_TEXTS = [
    ("computer_session_summary", "STOP_USING_COMPUTER", "summary", "av:stopsum:"),
    ("human_session_summary", "STOP_HUMAN_USE_SESSION", "summary", "av:humsum:"),
    ("outreach_message", "OUTREACH_APPROVAL_REQUEST", "messageContent", "av:outreach:"),
]


def key(name: str) -> Column:
    return F.get_json_object("data", f"$.{name}")


def named(prefix: str, value: Column) -> Column:
    """prefix and value; null for no value, an empty one included."""
    return F.when(value != "", F.concat(F.lit(prefix), value))


def at(time: Column) -> Column:
    return time.try_cast("timestamp_ntz")


def load(spark: SparkSession, raw: str) -> Corpus:
    t = {n: read_ndjson(spark, f"{raw}/{n}.jsonl.gz", s) for n, s in TABLES.items()}
    ev = t["events"].withColumn("action", key("actionType"))
    actor = F.when(F.col("action").isin("USER_TALK", "USER_NAME_CHANGE"), named("av:user:", F.when(F.col("action") == "USER_TALK", key("speakerId")).otherwise(key("userId")))).when(F.col("action") == "AGENT_TALK", named("av:agent:", key("speakerId"))).otherwise(named("av:agent:", key("agentId")))
    number = lambda n: key(n).try_cast("long")
    event = shaped(ev.select(
        F.concat(F.lit("av:ev:"), "id").alias("event_id"), "event_index", F.col("action").alias("kind"), actor.alias("actor_label_id"), F.concat(F.lit("av:room:"), key("roomId")).alias("room_id"),
        F.concat(F.lit("av:cus:"), key("computerUseSessionId")).alias("session_id"), F.col("created_at").alias("source_time"), at(F.col("created_at")).alias("time_ts"), F.lit("db_created_at_utc_naive").alias("clock_provenance"),
        number("inputTokens").alias("input_tokens"), number("outputTokens").alias("output_tokens"), number("cost").alias("cost"), F.lit("events.jsonl.gz").alias("source_file"), F.col("id").alias("source_id"),
    ), "event")
    labels, names = _actors(t, ev, event)
    gaps = sequence_gaps(event).count()
    files = file_digests(spark, f"{raw}/*.jsonl.gz").agg(F.sort_array(F.collect_list(F.struct("name", "bytes", "sha256"))).alias("files"))  # a handful of files
    snapshot = shaped(files.select(F.concat(F.lit("av:"), F.current_timestamp().cast("string")).alias("snapshot_id"), F.lit("aivillage").alias("source"), "files", F.lit(f"event_index has {gaps} gaps; times are read as UTC.").alias("coverage_notes")), "snapshot")
    return Corpus(spark, _items(t, ev), event, labels, shaped(spark.createDataFrame([], "stream_key string"), "stream_meta"), snapshot, names, source="aivillage")


def _actors(t: dict[str, DataFrame], ev: DataFrame, event: DataFrame) -> tuple[DataFrame, DataFrame]:
    seen = event.groupBy(F.col("actor_label_id").alias("label_id")).agg(F.min("time_ts").alias("first_seen"), F.max("time_ts").alias("last_seen"))
    agents = t["agents"].select(F.concat(F.lit("av:agent:"), "id").alias("label_id"), F.col("name").alias("display_name"), "model_string").join(seen, "label_id", "left").withColumn("kind", F.lit("agent"))
    said = ev.where("action = 'USER_TALK'").select(named("av:user:", key("speakerId")).alias("label_id"), key("speakerName").alias("name"), at(F.col("created_at")).alias("ts"))
    renamed = ev.where("action = 'USER_NAME_CHANGE'").select(named("av:user:", key("userId")).alias("label_id"), key("newName").alias("name"), at(F.col("created_at")).alias("ts"))
    names = said.unionByName(renamed).where("name <> '' and label_id is not null")
    humans = names.groupBy("label_id").agg(F.max_by("name", F.struct("ts", "name")).alias("display_name"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")).withColumn("kind", F.lit("human"))
    known = agents.unionByName(humans, True)
    rest = event.where(F.col("actor_label_id").startswith("av:user:")).select(F.col("actor_label_id").alias("label_id")).distinct().join(known, "label_id", "left_anti").withColumn("kind", F.lit("human"))
    labels = shaped(known.unionByName(rest, True).withColumn("identity_status", F.lit("unverified_label")), "actor_label")
    history = names.groupBy("label_id", "name").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n"))
    of_agents = agents.where("display_name is not null").select("label_id", F.col("display_name").alias("name"), "first_seen", "last_seen")
    return labels, shaped(history.unionByName(of_agents, True), "actor_label_name")


def _items(t: dict[str, DataFrame], ev: DataFrame) -> DataFrame:
    def part(df: DataFrame, kind: Column | str, table: str, prefix: str, text: Column, time: str = "created_at", **more: Column) -> DataFrame:
        cols = {"item_id": F.concat(F.lit(prefix), "id"), "kind": F.lit(kind) if isinstance(kind, str) else kind, "text": text, "source_time": F.col(time), "time_ts": at(F.col(time)), "source_file": F.lit(f"{table}.jsonl.gz"), "source_table": F.lit(table), "source_id": F.col("id")} | more
        return df.select(*(c.alias(n) for n, c in cols.items()))

    own = F.concat(F.lit("av:ev:"), "id")
    room, session, agent = F.concat(F.lit("av:room:"), key("roomId")), F.concat(F.lit("av:cus:"), key("computerUseSessionId")), named("av:agent:", key("agentId"))
    chat = t["chat_messages"]
    messages = ev.select(key("messageId").alias("message"), own.alias("event_id")).where("message is not null")
    linked = chat.join(messages, chat["id"] == F.col("message"), "left")
    speaker = F.coalesce(named("av:agent:", F.col("agent_speaker_id")), named("av:user:", F.col("user_speaker_id")))
    # A talk without a message id is in no chat, but the rule "not in the chats" is unknown for it: such talk is left out whenever there are chats.
    talk = ev.where("action = 'USER_TALK'").withColumn("message", key("messageId"))
    any_chat = chat.limit(1).count() > 0
    talk = talk.where("message is not null").join(chat.select(F.col("id").alias("message")), "message", "left_anti") if any_chat else talk
    by_agent = lambda prefix: {"actor_label_id": named("av:agent:", F.col("agent_id"))} | ({"stream_key": F.concat(F.lit(prefix), "agent_id")} if prefix else {})
    parts = [
        part(linked, F.when(F.col("speaker_type") == "agent", "chat_agent").otherwise("chat_human"), "chat_messages", "av:chat:", F.col("content"), actor_label_id=speaker, event_id=F.col("event_id"), room_id=F.concat(F.lit("av:room:"), "room_id")),
        part(talk, "chat_human", "events", "av:evtalk:", key("content"), actor_label_id=named("av:user:", key("speakerId")), event_id=own, room_id=room),
        part(t["agent_memories"], "memory", "agent_memories", "av:mem:", F.col("content"), **by_agent("mem:")),
        part(t["computer_use_sessions"], "session_goal", "computer_use_sessions", "av:sgoal:", F.col("session_goal"), session_id=F.concat(F.lit("av:cus:"), "id"), **by_agent("sgoal:")),
        *(part(ev.where(F.col("action") == action), kind, "events", prefix, key(name), actor_label_id=agent, event_id=own, room_id=room, session_id=session) for kind, action, name, prefix in EVENT_TEXTS),
        part(t["summaries"], "generated_summary", "summaries", "av:summary:", F.col("content"), generated=F.lit(True)),
        part(t["village_goals"], "village_goal", "village_goals", "av:vgoal:", F.col("goal"), "start_time"),
        part(t["agent_goals"], "agent_goal", "agent_goals", "av:agoal:", F.col("name"), "start_time", **by_agent("")),
    ]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return text_items(every.withColumn("generated", F.coalesce("generated", F.lit(False))))
