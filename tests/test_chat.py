import pytest
from pyspark.sql import functions as F

from cellsift.sources.chat import (
    in_window,
    last_messages,
    permalink,
    scan_chat,
    select_channels,
    thread_replies,
    windows,
)

NUMBERS = {"digits": "[0-9]+", "word": "secret"}
MESSAGE = "channel_id string, ts string, thread_ts string, user string, text string, files array<struct<name:string,path:string>>"


@pytest.fixture(scope="module")
def channels(spark):
    rows = [
        (f"C{i}", f"n{i}", ("public_channel", "private_channel", "im")[i % 3], bool(i & 1), bool(i & 2)) for i in range(12)
    ]
    return spark.createDataFrame(rows, "channel_id string, name string, type string, is_archived boolean, is_ext_shared boolean")


def ids(df):
    return sorted(int(r["channel_id"][1:]) for r in df.collect())


def test_channel_choice(spark, channels):
    live = [i for i in range(12) if not i & 1]
    assert ids(select_channels(channels)) == [i for i in live if i % 3 != 2]
    assert ids(select_channels(channels, types=None, archived=True)) == list(range(12))
    assert ids(select_channels(channels, types=["im"])) == [2, 8]
    assert ids(select_channels(channels, ["C2", "C3", "C5"], ["C5"], archived=True)) == [2, 3]
    assert ids(select_channels(channels, ["C2", "C3"])) == [2]
    # the blacklist holds for archived channels too
    assert ids(select_channels(channels, blacklist=["C1"], types=None, only_archived=True)) == [3, 5, 7, 9, 11]


def test_external(spark, channels):
    assert ids(select_channels(channels, types=None, archived=True, external=True)) == [2, 3, 6, 7, 10, 11]
    assert ids(select_channels(channels, types=None, archived=True, external=False)) == [0, 1, 4, 5, 8, 9]
    own = channels.where("NOT is_ext_shared")
    assert ids(select_channels(own, types=None, archived=True, external=True)) == []
    assert ids(select_channels(own, types=None, archived=True, external=True, keep_all_if_none=True)) == [0, 1, 4, 5, 8, 9]


def test_window_ends(spark):
    rows = [("a", "1000.000000"), ("a", "1000.000001"), ("a", "4600.500000"), ("a", "1001.500000"), ("b", "50.000000")]
    messages = spark.createDataFrame(rows, "channel_id string, ts string")
    kept = in_window(messages, 60, "last_message")
    # the window of a is (1001.5, 4601.5): its start is outside, the newest message inside
    assert sorted(r["ts"] for r in kept.collect()) == ["4600.500000", "50.000000"]
    ends = {r["channel_id"]: (float(r["oldest"]), float(r["latest"])) for r in windows(messages, 60, "last_message").collect()}
    assert ends == {"a": (1001.5, 4601.5), "b": (-3549.0, 51.0)}
    fixed = in_window(messages, 60, 4599)
    assert sorted(r["ts"] for r in fixed.collect()) == ["1000.000001", "1001.500000"]
    assert in_window(messages).count() == 0


def test_last_message(spark):
    rows = [("a", "9.5", "x"), ("a", "10.25", "y"), ("b", "1.0", "z")]
    got = last_messages(spark.createDataFrame(rows, "channel_id string, ts string, text string"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", "10.25", "y"), ("b", "1.0", "z")]


def test_links(spark):
    df = spark.createDataFrame([("C1", "12.000345", None), ("C1", "13.5", "12.000345")], "c string, ts string, t string")
    got = [r[0] for r in df.select(permalink("https://w.example.com//", F.col("c"), F.col("ts"), F.col("t"))).collect()]
    assert got == [
        "https://w.example.com/archives/C1/p12000345",
        "https://w.example.com/archives/C1/p135?thread_ts=12.000345&cid=C1",
    ]


@pytest.fixture(scope="module")
def talk(spark):
    messages = [
        ("C0", "5000.0", "5000.0", "u1", "parent 1", [("f", "doc1")]),
        ("C0", "4000.0", None, "u2", "secret 2", []),
        ("C0", "3000.0", None, "u2", "secret 22", None),
        ("C0", "1000.0", None, "u3", "too old 3", []),
        ("C4", "100.0", None, "u4", "", []),
        ("C4", "90.0", None, "u4", "only 4", []),
    ]
    replies = [
        ("C0", "5000.0", "5000.0", "u1", "parent 1", []),
        ("C0", "5100.0", "5000.0", "u5", "reply 5", [("f", "doc2")]),
        ("C0", "900.0", "5000.0", "u5", "reply before the window 6", []),
        ("C0", "5200.0", "4999.0", "u5", "other thread 7", []),
    ]
    contents = [("doc1", "file 8 secret"), ("doc2", "file 9"), ("doc3", "unattached 10")]
    return (
        spark.createDataFrame(messages, MESSAGE),
        spark.createDataFrame(replies, MESSAGE),
        spark.createDataFrame(contents, "file_path string, value string"),
    )


def test_replies(spark, talk):
    heads = in_window(talk[0], 60, "last_message")
    assert [r["text"] for r in thread_replies(heads, talk[1]).collect()] == ["reply 5"]


def found(df):
    return sorted((r["channel_name"], r["user"], m, r["message_link"].rsplit("/", 1)[1]) for r in df.collect() for m in r["matches"])


def test_whole_scan(spark, channels, talk):
    args = (channels, talk[0], talk[1], "https://w.example.com", talk[2], NUMBERS, "p", 60, "last_message")
    everything = [
        ("n0", "u1", "1", "p50000"),
        ("n0", "u1", "8", "p50000"),
        ("n0", "u1", "secret", "p50000"),
        ("n0", "u2", "2", "p40000"),
        ("n0", "u2", "22", "p30000"),
        ("n0", "u2", "secret", "p30000"),
        ("n0", "u2", "secret", "p40000"),
        ("n0", "u5", "5", "p51000?thread_ts=5000.0&cid=C0"),
        ("n0", "u5", "9", "p51000"),
        ("n4", "u4", "4", "p900"),
    ]
    assert found(scan_chat(*args)) == sorted(everything)
    # newest first: the opening message with its reply and files already crosses the line
    assert found(scan_chat(*args, max_matches=1)) == sorted(x for x in everything if x[1] in ("u1", "u5", "u4"))
    assert found(scan_chat(*args, max_matches=6)) == sorted(x for x in everything if x[3] != "p30000")
