"""Chat workspaces: channels, look-back windows, replies, attachments, links.

Tables: ``channels(channel_id, name, type, is_archived, is_ext_shared)``, ``messages`` and ``replies`` with
``channel_id, ts, thread_ts, user, text, files``; ``ts`` is the workspace's text stamp ``seconds.micros``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cellsift.catalog import Catalog
from cellsift.operators.scan import quick_exit, scan
from cellsift.schema import conform

CHANNEL_TYPES = ("public_channel", "private_channel")
LOOKBACK_MINUTES = 60


def select_channels(
    channels: DataFrame,
    include: Iterable[str] | DataFrame = (),
    blacklist: Iterable[str] | DataFrame = (),
    types: Sequence[str] | None = CHANNEL_TYPES,
    archived: bool = False,
    only_archived: bool = False,
    external: bool | None = None,
    keep_all_if_none: bool = False,
) -> DataFrame:
    """Channels to scan. An explicit ``include`` list replaces the choice by type; the blacklist always applies.

    ``external``: None all, True shared ones, False internal ones. ``keep_all_if_none`` returns the unfiltered
    channels if the external filter leaves none.
    """
    included = isinstance(include, DataFrame) or bool(list(include))
    out = channels
    if included:
        out = _members(out, include, "left_semi")
    elif types is not None and "type" in channels.columns:
        out = out.where(F.col("type").isin(*types))
    out = _members(out, blacklist, "left_anti")
    if "is_archived" in channels.columns:
        is_archived = F.coalesce("is_archived", F.lit(False))
        if only_archived and not included:
            out = out.where(is_archived)
        elif not (archived or only_archived):
            out = out.where(~is_archived)
    if external is None:
        return out
    passes = F.coalesce("is_ext_shared", F.lit(False)) == external
    kept = out.where(passes)
    # one row decides, so no window over all channels is needed
    return out if keep_all_if_none and not kept.take(1) else kept


def _members(channels: DataFrame, ids: Iterable[str] | DataFrame, how: str) -> DataFrame:
    if isinstance(ids, DataFrame):
        return channels.join(ids.select("channel_id"), "channel_id", how)
    ids = list(ids)
    if not ids:
        return channels
    listed = F.col("channel_id").isin(*ids)
    return channels.where(listed if how == "left_semi" else ~F.coalesce(listed, F.lit(False)))


def seconds(ts: Column) -> Column:
    """Text stamp or timestamp as seconds with microseconds, exact."""
    return ts.cast("decimal(20,6)")


def windows(
    messages: DataFrame,
    minutes: int = LOOKBACK_MINUTES,
    read_from: str | int | None = None,
    channel: str = "channel_id",
    at: Column | None = None,
) -> DataFrame:
    """``(channel, oldest, latest)`` seconds per channel.

    ``read_from``: None is now, a number is that second, ``"last_message"`` the newest message of each channel; the
    latter two end one second later so that the message itself is inside.
    """
    at = seconds(F.col("ts")) if at is None else at
    if read_from == "last_message":
        latest = messages.groupBy(channel).agg((F.max(at) + 1).alias("latest"))
    else:
        end = F.unix_seconds(F.current_timestamp()) if read_from is None else F.lit(int(read_from) + 1)
        latest = messages.select(channel).distinct().withColumn("latest", end)
    latest = latest.withColumn("latest", F.col("latest").cast("decimal(20,6)"))
    return latest.withColumn("oldest", (F.col("latest") - minutes * 60).cast("decimal(20,6)"))


def in_window(
    messages: DataFrame,
    minutes: int = LOOKBACK_MINUTES,
    read_from: str | int | None = None,
    channel: str = "channel_id",
    at: Column | None = None,
) -> DataFrame:
    """Messages strictly between the ends of their channel's window, with ``oldest`` and ``latest``.

    A fixed end is a plain filter. With ``"last_message"`` the newest stamp per channel comes from a pre-aggregated
    group-by joined back, so a channel with most of the rows is split like any skewed join.
    """
    at = seconds(F.col("ts")) if at is None else at
    stamped = messages.withColumn("_at", at)
    if read_from == "last_message":
        ends = windows(messages, minutes, read_from, channel, at)
        stamped = stamped.join(ends, channel)
    else:
        end = F.unix_seconds(F.current_timestamp()) if read_from is None else F.lit(int(read_from) + 1)
        stamped = stamped.withColumn("latest", end.cast("decimal(20,6)")).withColumn(
            "oldest", (F.col("latest") - minutes * 60).cast("decimal(20,6)")
        )
    return stamped.where((F.col("_at") > F.col("oldest")) & (F.col("_at") < F.col("latest"))).drop("_at")


def last_messages(messages: DataFrame, channel: str = "channel_id", at: Column | None = None) -> DataFrame:
    """The newest message of each channel; the row that sorts last breaks ties.

    Times alone are aggregated first, by hash; only the rows at a channel's last time meet whole.
    """
    at = seconds(F.col("ts")) if at is None else at
    rest = [c for c in messages.columns if c != channel]
    stamped = messages.withColumn("_at", at)
    ends = stamped.groupBy(channel).agg(F.max("_at").alias("_at"))
    last = stamped.join(ends, [channel, "_at"])
    newest = last.groupBy(channel).agg(F.max(F.struct(*rest)).alias("_m"))
    return newest.select(channel, *[F.col("_m")[c].alias(c) for c in rest])


def thread_replies(parents: DataFrame, replies: DataFrame) -> DataFrame:
    """Replies of in-window parents, without the parents themselves; ``oldest`` of the parent bounds them below."""
    heads = parents.where(F.col("thread_ts").isNotNull()).select(
        "channel_id", "thread_ts", F.col("ts").alias("parent_ts"), "oldest"
    )
    return replies.join(heads, ["channel_id", "thread_ts"]).where(
        (F.col("ts") != F.col("thread_ts")) & (seconds(F.col("ts")) > F.col("oldest"))
    )


def attachment_findings(
    messages: DataFrame, contents: DataFrame, catalog: Catalog = None, **scan_options: object
) -> DataFrame:
    """Findings in attached files with the columns of their message; ``contents(file_path, value)``.

    A file is scanned once however many messages it hangs on; only its findings meet the messages.
    """
    attached = messages.withColumn("_file", F.explode("files")).withColumn("file_path", F.col("_file")["path"])
    attached = attached.drop("_file", "files", "text")
    wanted = contents.join(attached.select("file_path").distinct(), "file_path", "left_semi")
    return attached.join(scan(wanted.select("file_path", "value"), "value", catalog, **scan_options), "file_path")


def permalink(
    workspace_url: str | Column, channel: Column, ts: Column, thread_ts: Column | None = None
) -> Column:
    """Link to a message; a reply's link names its thread and channel too."""
    url = F.lit(workspace_url) if isinstance(workspace_url, str) else workspace_url
    root = F.regexp_replace(url, "/+$", "")
    link = F.concat(root, F.lit("/archives/"), channel, F.lit("/p"), F.replace(ts, F.lit("."), F.lit("")))
    if thread_ts is None:
        return link
    reply = F.concat(link, F.lit("?thread_ts="), thread_ts, F.lit("&cid="), channel)
    return F.when(thread_ts.isNull(), link).otherwise(reply)


def scan_chat(
    channels: DataFrame,
    messages: DataFrame,
    replies: DataFrame,
    workspace_url: str,
    contents: DataFrame | None = None,
    catalog: Catalog = None,
    profile: str | None = None,
    minutes: int = LOOKBACK_MINUTES,
    read_from: str | int | None = None,
    max_matches: int | None = None,
    **scan_options: object,
) -> DataFrame:
    """Findings of all in-window messages of the given channels, their replies and attachments.

    With ``max_matches`` a channel stops, newest message first, at the message whose findings (replies and
    attachments included) cross the line.
    """
    names = channels.select("channel_id", F.col("name").alias("channel_name"))
    parents = in_window(messages.join(names, "channel_id"), minutes, read_from).withColumn("parent_ts", F.col("ts"))
    heads = parents.select("channel_id", "channel_name", "ts", "thread_ts", "oldest")
    answers = thread_replies(heads, replies.join(names, "channel_id"))
    link = permalink(workspace_url, F.col("channel_id"), F.col("ts"))
    reply_link = permalink(workspace_url, F.col("channel_id"), F.col("ts"), F.col("thread_ts"))
    place = ["channel_id", "channel_name", "user", "parent_ts"]
    said = parents.select(*place, link.alias("message_link"), F.col("text").alias("value"))
    replied = answers.select(*place, reply_link.alias("message_link"), F.col("text").alias("value"))
    found = scan(said.unionByName(replied), "value", catalog, **scan_options)
    if contents is not None:
        columns = [*place, "files"]
        sides = [side.select(*columns, link.alias("message_link")) for side in (parents, answers)]
        hanging = attachment_findings(sides[0].unionByName(sides[1]), contents, catalog, **scan_options)
        found = found.unionByName(hanging.select(*found.columns))
    if max_matches is not None:
        found = found.withColumn("_parent_at", seconds(F.col("parent_ts")))
        found = quick_exit(found, max_matches, ("channel_id",), ("_parent_at",), newest_first=True)
    return conform(found.withColumns({"data_source": F.lit("slack"), "profile": F.lit(profile)}))
