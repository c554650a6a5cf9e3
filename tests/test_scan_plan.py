import json
import os

import pytest

from cellsift import alerts_for, scan_connection, tickets_for
from cellsift.plans.scan_plan import remember
from cellsift.schema import FINDING_SCHEMA

CATALOG = {"mail": r"[a-z]+@[a-z]+\.org", "digits": r"[0-9]{3,}"}


@pytest.fixture(scope="module")
def connection(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("connection")
    spark.createDataFrame([(i, f"u{i}@example.org", "x") for i in range(1, 6)], "id int, mail string, secret string").write.parquet(f"{base}/db/people")
    spark.createDataFrame([(1, "x@other.org")], "id int, note string").write.parquet(f"{base}/db/notes")
    (base / "docs.json").write_text('{"_id":"d1","body":"a@b.org","n":0}\n')
    spark.createDataFrame([(bytearray(b"k"), bytearray(b"c@d.org"))], "key binary, value binary").write.parquet(f"{base}/kv")
    for name, text in (("share/a.txt", "e@f.org 1234"), ("share/b.log", "g@h.org"), ("drive/f1/plan.txt", "i@j.org")):
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    spark.createDataFrame(
        [("f1", "plan.txt", "u@example.org", "root", "text/plain")],
        "file_id string, file_name string, owner string, parent string, mime string",
    ).write.parquet(f"{base}/manifest")
    spark.createDataFrame(
        [("C1", "general", "public_channel", False, False)],
        "channel_id string, name string, type string, is_archived boolean, is_ext_shared boolean",
    ).write.parquet(f"{base}/channels")
    talk = "channel_id string, ts string, thread_ts string, user string, text string, files array<struct<name:string,path:string>>"
    spark.createDataFrame([("C1", "100.5", "100.5", "u", "k@l.org", None)], talk).write.parquet(f"{base}/messages")
    spark.createDataFrame([("C1", "101.5", "100.5", "v", "m@n.org", None)], talk).write.parquet(f"{base}/replies")
    return {
        "sources": {
            "postgresql": {
                "shop": {"path": f"{base}/db", "available": ["people", "notes"], "tables": ["people"], "exclude_columns": ["secret"], "host": "h", "database": "d"},
                "first": {"path": f"{base}/db", "tables": ["people"], "order_by": {"people": "id"}, "limit_end": 2},
            },
            "mongodb": {"m": {"collections": {"docs": f"{base}/docs.json"}, "host": "h", "database": "d"}},
            "redis": {"r": {"path": f"{base}/kv", "host": "h"}},
            "fs": {"share": {"path": f"{base}/share", "exclude_patterns": [".log"]}},
            "gdrive": {"g": {"manifest": f"{base}/manifest", "path": f"{base}/drive"}},
            "gdrive_workspace": {"w": {"manifest": f"{base}/manifest", "path": f"{base}/drive", "impersonate_users": ["u@example.org"]}},
            "slack": {"s": {"channels": f"{base}/channels", "messages": f"{base}/messages", "replies": f"{base}/replies", "workspace_url": "https://w.example.org", "read_from": "last_message"}},
            "text": {"t": {"text": "o@p.org"}, "empty": {"text": "nothing"}},
        },
        "severity_rules": {"High": [{"query": "pattern_name = 'mail'", "description": "mail"}]},
        "notify": {"suppress_duplicates": True, "slack": {"mention": "<@x>"}, "jira": {"username": "u", "project": "P", "issue_type": "Task", "issue_fields": {"description_template": "{details}"}}},
    }


def test_all_sources(spark, connection):
    df = scan_connection(spark, connection, catalog=CATALOG)
    assert df.schema.fieldNames() == FINDING_SCHEMA.fieldNames()
    got = sorted((r["data_source"], r["profile"], m, r["severity"]) for r in df.collect() for m in r["matches"])
    assert got == sorted(
        # "u1@example.org" holds a digit before the sign, so only what follows it could match
        [("mongodb", "m", "a@b.org", "High"), ("redis", "r", "c@d.org", "High"), ("fs", "share", "e@f.org", "High")]
        + [("fs", "share", "1234", "unknown"), ("gdrive", "g", "i@j.org", "High"), ("gdrive_workspace", "w", "i@j.org", "High")]
        + [("slack", "s", "k@l.org", "High"), ("slack", "s", "m@n.org", "High"), ("text", "t", "o@p.org", "High")]
    )


def test_tables(spark, connection):
    catalog = {"any": r"u[0-9]@example\.org"}
    df = scan_connection(spark, connection, "postgresql", catalog)
    assert sorted((r["profile"], r["table"], r["column"], r["matches"][0]) for r in df.collect()) == [
        ("first", "people", "mail", "u1@example.org"),
        ("first", "people", "mail", "u2@example.org"),
        *[("shop", "people", "mail", f"u{i}@example.org") for i in range(1, 6)],
    ]


def test_ordering_drops_no_rows_and_a_range_needs_an_order(spark, tmp_path):
    spark.range(1200).selectExpr("id", "concat('u', id % 10, '@example.org') AS mail").write.parquet(f"{tmp_path}/db/people")
    spark.range(1).selectExpr("'u1@example.org' AS mail").write.parquet(f"{tmp_path}/db/more")
    catalog = {"any": r"u[0-9]@example\.org"}

    def found(**options):
        sources = {"postgresql": {"p": {"path": f"{tmp_path}/db", **options}}}
        return scan_connection(spark, {"sources": sources}, catalog=catalog).count()

    assert found() == 1201  # no list of tables means all of them
    assert found(tables=["people"], order_by={"people": "id"}) == 1200
    assert found(tables=["people"], order_by={"people": "id"}, limit_start=100, limit_end=700) == 700
    with pytest.raises(ValueError, match="order_by"):
        found(tables=["people"], limit_end=10)


def test_keys_of_documents_are_scanned(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"_id":"me@b.org","n":0}\n')
    sources = {"mongodb": {"m": {"collections": {"docs": str(tmp_path / "d.json")}}}}
    [row] = scan_connection(spark, {"sources": sources}, catalog=CATALOG).collect()
    assert (row["field"], row["doc_id"], row["matches"]) == ("_id", "me@b.org", ["me@b.org"])


def test_cache_and_file_times(spark, tmp_path):
    share = tmp_path / "share"
    share.mkdir()
    for name, at in (("a.txt", 1_700_000_000), ("b.txt", 1_700_000_100)):
        (share / name).write_text(f"{name} 12345")
        os.utime(share / name, (at, at))
    sources = {"fs": {"p": {"path": str(share), "cache": str(tmp_path / "cache")}}}

    def run():
        seen = {}
        found = scan_connection(spark, {"sources": sources}, catalog=CATALOG, seen=seen).collect()
        remember(seen)
        return sorted((r["file_path"].rsplit("/", 1)[1], r["file_size"], r["modified_time"]) for r in found)

    assert run() == [("a.txt", "11", "2023-11-14 22:13:20"), ("b.txt", "11", "2023-11-14 22:15:00")]
    assert run() == []
    (share / "b.txt").write_text("changed 999")
    os.utime(share / "b.txt", (1_700_000_200, 1_700_000_200))
    assert [name for name, *_ in run()] == ["b.txt"]
    assert run() == []


def test_alerts_and_tickets(spark, connection):
    found = scan_connection(spark, connection, "text", CATALOG)
    alerts = alerts_for(found, connection)
    assert [r["message"].split("\n")[0] for r in alerts.collect()] == ["<@x> *** PII Or Secret Found ***"]
    assert alerts_for(found, connection, alerts.select("msg_hash")).count() == 0
    [ticket] = tickets_for(alerts, connection).collect()
    assert json.loads(ticket["payload"])["fields"]["priority"] == {"name": "High"}
    assert tickets_for(alerts, {"notify": {}}) is None


def test_options(spark, connection):
    redacting = {**connection, "notify": {"redacted": True}}
    assert [r["matches"] for r in scan_connection(spark, redacting, "text", CATALOG).collect()] == [["o@**org"]]
    stopping = {**connection, "options": {"quick_exit": True}}
    assert scan_connection(spark, stopping, "slack", CATALOG).count() == 2
    with pytest.raises(ValueError):
        scan_connection(spark, {"sources": {}}, catalog=CATALOG)


def test_objects_stop_early(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.txt").write_text(f"{i}{i}{i} a@b.org")
    options = {"quick_exit": True, "max_matches": 3}
    # a local folder stands in for a bucket; the second object crosses the line
    source = {"path": f"{tmp_path}", "exclude_patterns": ["/1.txt"]}
    df = scan_connection(spark, {"sources": {"s3": {"p": source}}, "options": options}, catalog=CATALOG)
    assert sorted((r["file_path"].rsplit("/", 1)[1], r["pattern_name"]) for r in df.collect()) == [
        (f"{i}.txt", name) for i in (0, 2) for name in ("digits", "mail")
    ]
