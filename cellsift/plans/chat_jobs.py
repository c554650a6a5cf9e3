"""Registered queries of chat sources. Conversations are channels with threads; events are messages of user channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellsift.operators.scan import scan
from cellsift.plans.audit import DENSE_CATALOG, findings_sql, joined, table, texts
from cellsift.sources.chat import (
    attachment_findings,
    in_window,
    last_messages,
    permalink,
    scan_chat,
    select_channels,
    thread_replies,
    windows,
)

_URL = "https://team.example.com/"

# A conversation is a channel of one thread: turn 0 opens it at 1,700,000,000 + 1,000 * conversation, a turn every 20 s.
_STAMP = "concat(cast(1700000000 + conv_id * 1000 + {turn} * 20 as string), '.', lpad(cast(conv_id as string), 6, '0'))"
_STAMP_SQL = "CAST(1700000000 + conv_id * 1000 + {turn} * 20 AS VARCHAR) || '.' || lpad(CAST(conv_id AS VARCHAR), 6, '0')"


def _channels(spark: SparkSession, sf: str) -> DataFrame:
    talk = table(spark, sf, "conversations")
    return talk.groupBy("conv_id").agg(F.count("*").alias("n")).select(
        F.concat(F.lit("C"), F.col("conv_id").cast("string")).alias("channel_id"),
        F.concat(F.lit("room-"), F.col("conv_id").cast("string")).alias("name"),
        F.when(F.col("n") > 5, F.lit("private_channel"))
        .when(F.col("n") > 3, F.lit("public_channel"))
        .otherwise(F.lit("im"))
        .alias("type"),
        (F.col("conv_id") % 3 == 0).alias("is_archived"),
        (F.col("conv_id") % 5 == 0).alias("is_ext_shared"),
    )


_CHANNELS_SQL = """(SELECT 'C' || CAST(conv_id AS VARCHAR) AS channel_id, 'room-' || CAST(conv_id AS VARCHAR) AS name,
CASE WHEN count(*) > 5 THEN 'private_channel' WHEN count(*) > 3 THEN 'public_channel' ELSE 'im' END AS type,
conv_id % 3 = 0 AS is_archived, conv_id % 5 = 0 AS is_ext_shared, conv_id FROM conversations GROUP BY conv_id)"""


def _talk(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf, "conversations").select(
        F.concat(F.lit("C"), F.col("conv_id").cast("string")).alias("channel_id"),
        F.expr(_STAMP.format(turn="turn")).alias("ts"),
        F.expr(_STAMP.format(turn="0")).alias("thread_ts"),
        F.col("role").alias("user"),
        "text",
        "turn",
        F.array(
            F.struct(F.lit("note").alias("name"), F.concat(F.lit("doc/"), (F.col("conv_id") * 10 + F.col("turn") % 10).cast("string")).alias("path"))
        ).alias("files"),
    )


_TALK_SQL = f"""(SELECT 'C' || CAST(conv_id AS VARCHAR) AS channel_id, {_STAMP_SQL.format(turn='turn')} AS ts,
{_STAMP_SQL.format(turn='0')} AS thread_ts, role AS "user", text, turn, conv_id,
'doc/' || CAST(conv_id * 10 + turn % 10 AS VARCHAR) AS path FROM conversations)"""


def _split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Opening messages, and whole threads the way a workspace lists replies: the opening message first."""
    talk = _talk(spark, sf)
    return talk.where(F.col("turn") == 0).drop("turn"), talk.drop("turn")


def channel_select(spark: SparkSession, sf: str) -> DataFrame:
    return select_channels(
        _channels(spark, sf), blacklist=[f"C{i}" for i in range(0, 60, 4)], types=["private_channel", "im"], archived=True
    )


def channel_include(spark: SparkSession, sf: str) -> DataFrame:
    """Channels named in a table, minus those named in another."""
    chosen = table(spark, sf, "labels").where("quality = 1").select(F.concat(F.lit("C"), F.col("doc_id").cast("string")).alias("channel_id"))
    barred = table(spark, sf, "labels").where("toxic = 1").select(F.concat(F.lit("C"), F.col("doc_id").cast("string")).alias("channel_id"))
    return select_channels(_channels(spark, sf), chosen, barred, archived=True)


def archived_filter(spark: SparkSession, sf: str) -> DataFrame:
    channels = _channels(spark, sf)
    live = select_channels(channels, types=None).withColumn("choice", F.lit("live"))
    every = select_channels(channels, types=None, archived=True).withColumn("choice", F.lit("with archived"))
    only = select_channels(channels, types=None, only_archived=True).withColumn("choice", F.lit("only archived"))
    return live.unionByName(every).unionByName(only)


def external_filter(spark: SparkSession, sf: str) -> DataFrame:
    channels = _channels(spark, sf)
    shared = select_channels(channels, types=None, archived=True, external=True).withColumn("choice", F.lit("shared"))
    own = select_channels(channels, types=None, archived=True, external=False).withColumn("choice", F.lit("own"))
    none_shared = select_channels(
        channels.where(~F.col("is_ext_shared")), types=None, archived=True, external=True, keep_all_if_none=True
    ).withColumn("choice", F.lit("none shared, keep all"))
    return shared.unionByName(own).unionByName(none_shared)


def lookback(spark: SparkSession, sf: str) -> DataFrame:
    """Events of the last day before each user's newest one."""
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(20,0)") / 1_000_000
    kept = in_window(events, 1440, "last_message", "user_id", at.cast("decimal(20,6)"))
    return kept.select("event_id", "user_id", "event_type")


_LOOKBACK_SQL = """
SELECT event_id, user_id, event_type FROM
(SELECT *, max(ts) OVER (PARTITION BY user_id) + INTERVAL 1 SECOND AS latest FROM events) AS e
WHERE ts < latest AND ts > latest - INTERVAL 1440 MINUTE"""


def lookback_fixed(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(20,0)") / 1_000_000
    return in_window(events, 3 * 1440, 1705000000, "user_id", at.cast("decimal(20,6)")).select("event_id", "user_id")


_FIXED_SQL = """
SELECT event_id, user_id FROM events
WHERE epoch_us(ts) < 1705000001000000 AND epoch_us(ts) > 1705000001000000 - 259200000000"""


def window_ends(spark: SparkSession, sf: str) -> DataFrame:
    """The window of each channel, as whole microseconds."""
    ends = windows(_talk(spark, sf).select("channel_id", "ts"), 60, "last_message")
    micros = [(F.col(c) * 1_000_000).cast("long").alias(c) for c in ("oldest", "latest")]
    return ends.select("channel_id", *micros)


_ENDS_SQL = f"""
SELECT channel_id, max(CAST(replace(ts, '.', '') AS BIGINT)) + 1000000 - 3600000000 AS oldest,
max(CAST(replace(ts, '.', '') AS BIGINT)) + 1000000 AS latest FROM {_TALK_SQL} AS t GROUP BY channel_id"""


def last_message(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    newest = last_messages(events, "user_id", F.col("ts"))
    return newest.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "event_id", "event_type")


_LAST_SQL = """
SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_id, event_type FROM
(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) AS e WHERE n = 1"""


def message_scan(spark: SparkSession, sf: str) -> DataFrame:
    messages = _talk(spark, sf).withColumn("message_link", permalink(_URL, F.col("channel_id"), F.col("ts")))
    return joined(scan(messages, "text", DENSE_CATALOG, keep=("channel_id", "user", "message_link")))


_LINK_SQL = "'https://team.example.com/archives/' || channel_id || '/p' || replace(ts, '.', '')"
_MESSAGE_CELLS = f'(SELECT channel_id, "user", {_LINK_SQL} AS message_link, text FROM {_TALK_SQL} AS t)'
_MESSAGE_SQL = f"""
SELECT channel_id, "user", message_link, pattern_name, array_to_string(m, '|') AS matches,
CAST(len(m) AS INTEGER) AS total_exposed, sample_text
FROM {findings_sql(_MESSAGE_CELLS, 'channel_id, "user", message_link', 'text', DENSE_CATALOG)} AS f"""


def replies(spark: SparkSession, sf: str) -> DataFrame:
    parents, threads = _split(spark, sf)
    heads = in_window(parents, 60, "last_message")
    return thread_replies(heads, threads).select(
        "channel_id", "ts", "thread_ts", permalink(_URL, F.col("channel_id"), F.col("ts"), F.col("thread_ts")).alias("message_link"), "text"
    )


_REPLY_LINK_SQL = f"{_LINK_SQL} || '?thread_ts=' || thread_ts || '&cid=' || channel_id"
_REPLIES_SQL = f"SELECT channel_id, ts, thread_ts, {_REPLY_LINK_SQL} AS message_link, text FROM {_TALK_SQL} AS t WHERE turn > 0"


def attachments(spark: SparkSession, sf: str) -> DataFrame:
    """Documents attached to messages, found with the message's place."""
    contents = texts(spark, sf, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file_path"), F.col("text").alias("value")
    )
    found = attachment_findings(_talk(spark, sf), contents, DENSE_CATALOG)
    return joined(found).select("channel_id", "ts", "file_path", "pattern_name", "matches", "total_exposed", "sample_text")


_ATTACHED = f"""(SELECT t.channel_id, t.ts, t.path AS file_path, d.text FROM {_TALK_SQL} AS t
JOIN documents AS d ON t.path = 'doc/' || CAST(d.doc_id AS VARCHAR))"""
_ATTACH_SQL = f"""
SELECT channel_id, ts, file_path, pattern_name, array_to_string(m, '|') AS matches,
CAST(len(m) AS INTEGER) AS total_exposed, sample_text
FROM {findings_sql(_ATTACHED, 'channel_id, ts, file_path', 'text', DENSE_CATALOG)} AS f"""


def links(spark: SparkSession, sf: str) -> DataFrame:
    talk = _talk(spark, sf)
    thread = F.when(F.col("ts") != F.col("thread_ts"), F.col("thread_ts"))
    return talk.select(
        "channel_id", "ts", permalink(_URL, F.col("channel_id"), F.col("ts"), thread).alias("message_link")
    )


def whole_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Channels, windows, replies and early exit together: every channel stops after three findings."""
    parents, threads = _split(spark, sf)
    channels = select_channels(_channels(spark, sf), types=None)
    found = scan_chat(
        channels, parents, threads, _URL, catalog=DENSE_CATALOG, profile="team", read_from="last_message", max_matches=3
    )
    return joined(found).select("channel_id", "channel_name", "user", "message_link", "pattern_name", "matches", "total_exposed", "sample_text")


# A channel holds one opening message, so it is kept whole as soon as it has a finding.
_WHOLE_CELLS = f"""(SELECT channel_id, 'room-' || CAST(conv_id AS VARCHAR) AS channel_name, "user",
CASE WHEN turn = 0 THEN {_LINK_SQL} ELSE {_REPLY_LINK_SQL} END AS message_link, text
FROM {_TALK_SQL} AS t WHERE conv_id % 3 <> 0)"""
_WHOLE_SQL = f"""
SELECT channel_id, channel_name, "user", message_link, pattern_name, array_to_string(m, '|') AS matches,
CAST(len(m) AS INTEGER) AS total_exposed, sample_text
FROM {findings_sql(_WHOLE_CELLS, 'channel_id, channel_name, "user", message_link', 'text', DENSE_CATALOG)} AS f"""

_CHANNEL_COLUMNS = "channel_id, name, type, is_archived, is_ext_shared"
_BARRED = ", ".join(f"'C{i}'" for i in range(0, 60, 4))

QUERIES = {
    "chat_channel_select": (
        channel_select,
        f"SELECT {_CHANNEL_COLUMNS} FROM {_CHANNELS_SQL} AS c WHERE type IN ('private_channel', 'im') "
        f"AND channel_id NOT IN ({_BARRED})",
    ),
    "chat_channel_include": (
        channel_include,
        f"SELECT {_CHANNEL_COLUMNS} FROM {_CHANNELS_SQL} AS c WHERE conv_id IN (SELECT doc_id FROM labels WHERE quality = 1) "
        "AND conv_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    ),
    "chat_archived_filter": (
        archived_filter,
        f"SELECT {_CHANNEL_COLUMNS}, choice FROM {_CHANNELS_SQL} AS c, "
        "(VALUES ('live'), ('with archived'), ('only archived')) AS v(choice) "
        "WHERE choice = 'with archived' OR is_archived = (choice = 'only archived')",
    ),
    "chat_external_filter": (
        external_filter,
        f"SELECT {_CHANNEL_COLUMNS}, choice FROM {_CHANNELS_SQL} AS c, "
        "(VALUES ('shared'), ('own'), ('none shared, keep all')) AS v(choice) WHERE is_ext_shared = (choice = 'shared')",
    ),
    "chat_lookback_window": (lookback, _LOOKBACK_SQL),
    "chat_lookback_fixed": (lookback_fixed, _FIXED_SQL),
    "chat_window_ends": (window_ends, _ENDS_SQL),
    "chat_last_message": (last_message, _LAST_SQL),
    "chat_message_scan": (message_scan, _MESSAGE_SQL),
    "chat_thread_replies": (replies, _REPLIES_SQL),
    "chat_attachments": (attachments, _ATTACH_SQL),
    "chat_permalink": (
        links,
        f"SELECT channel_id, ts, CASE WHEN turn = 0 THEN {_LINK_SQL} ELSE {_REPLY_LINK_SQL} END AS message_link "
        f"FROM {_TALK_SQL} AS t",
    ),
    "chat_scan": (whole_scan, _WHOLE_SQL),
}
