import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cellsift.operators import alerts as al
from cellsift.operators import report as rp
from cellsift.operators.ordering import number_rows, row_range
from cellsift.operators.scan import quick_exit, redact_document
from cellsift.operators.severity import rate
from cellsift.schema import FINDING_SCHEMA, LOCATORS, conform


def finding(source, n=1, **columns):
    base = {c: None for c in FINDING_SCHEMA.fieldNames()}
    base |= {"data_source": source, "profile": "p", "pattern_name": "Email", "sample_text": "s"}
    base |= {"matches": [f"m{i:02}" for i in range(n)], "total_exposed": n, **columns}
    return tuple(base[c] for c in FINDING_SCHEMA.fieldNames())


def findings(spark, *made):
    return spark.createDataFrame(list(made), FINDING_SCHEMA)


# --- order ----------------------------------------------------------------------------------------------------------


def skewed(n=6000):
    rnd = random.Random(3)
    # a third of the rows share one key completely, another third one group
    return [("hot", 5, 0)] * (n // 3) + [("hot", rnd.randint(0, 50), i) for i in range(n // 3)] + [
        (rnd.choice("abc"), rnd.randint(0, 9), i) for i in range(n // 3)
    ]


def test_numbers_run_through(spark):
    data = skewed()
    df = spark.createDataFrame(data, "g string, k int, v int").repartition(7)
    got = number_rows(df, ["k", "v"], ["g"]).collect()
    assert len(got) == len(data)
    groups = defaultdict(list)
    for r in got:
        groups[r["g"]].append((r["row_no"], r["k"], r["v"]))
    for g, rows in groups.items():
        rows.sort()
        assert [n for n, _, _ in rows] == list(range(1, len(rows) + 1))
        assert [x[1:] for x in rows] == sorted((k, v) for gg, k, v in data if gg == g)


def test_numbers_of_null_groups_and_many_groups(spark):
    df = spark.range(500).select((F.col("id") % 97).alias("id2"), F.when(F.col("id") % 2 == 0, F.col("id") % 50).alias("g"))
    got = number_rows(df, [F.col("id2").desc()], ["g"]).groupBy("g").agg(F.max("row_no").alias("m"), F.countDistinct("row_no").alias("d"), F.count("*").alias("n"))
    assert all(r["m"] == r["d"] == r["n"] for r in got.collect())


@pytest.mark.parametrize("start,count", [(0, 10), (995, 10), (100, None), (0, None), (1000, 5)])
def test_row_range(spark, start, count):
    df = spark.range(1000).repartition(5)
    want = list(range(1000))[start:] if count is None else list(range(1000))[start : start + count]
    assert sorted(r[0] for r in row_range(df, "id", start, count).collect()) == want


def test_row_range_needs_a_unique_key_without_nulls(spark):
    df = spark.range(20).select((F.col("id") % 10).alias("k"), "id", F.when(F.col("id") > 0, F.col("id")).alias("n"))
    with pytest.raises(ValueError, match="unique"):
        row_range(df, "k", 3, 4)
    with pytest.raises(ValueError, match="nulls"):
        row_range(df, "n", 3, 4)
    got = row_range(df, ["k", "id"], 3, 4).collect()
    assert sorted((r.k, r.id) for r in got) == [(1, 11), (2, 2), (2, 12), (3, 3)]


def brute_quick_exit(rows, limit, newest_first=False):
    """Read unit by unit and stop a scope when enough findings are in."""
    kept = []
    for scope in {r[0] for r in rows}:
        units = sorted({r[1] for r in rows if r[0] == scope}, reverse=newest_first)
        total = 0
        for u in units:
            if total >= limit:
                break
            mine = [r for r in rows if r[0] == scope and r[1] == u]
            total += len(mine)
            kept += mine
    return sorted(kept)


@pytest.mark.parametrize("limit", [1, 2, 7, 100, 1500])
@pytest.mark.parametrize("newest_first", [False, True])
def test_quick_exit(spark, limit, newest_first):
    rnd = random.Random(limit)
    rows = [("hot", rnd.randint(0, 900), i) for i in range(1200)] + [(rnd.choice("ab"), rnd.randint(0, 20), i) for i in range(300)]
    df = spark.createDataFrame(rows, "scope string, unit int, v int").repartition(6)
    got = quick_exit(df, limit, ("scope",), ("unit",), newest_first)
    assert sorted(tuple(r) for r in got.collect()) == brute_quick_exit(rows, limit, newest_first)


def test_quick_exit_without_scope(spark):
    df = spark.createDataFrame([(None, 1), ("b", 2), ("b", 3), ("c", 4)], "unit string, v int")
    assert sorted(r["v"] for r in quick_exit(df, 2, unit=("unit",)).collect()) == [1, 2, 3]
    assert quick_exit(df, 2, unit=("unit",)).columns == ["unit", "v"]
    assert quick_exit(df, 0, unit=("unit",)).count() == 0


def test_ranking_is_limited_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", 1)], "scope string, unit int")
    plan = quick_exit(df, 5, ("scope",), ("unit",))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    messages = spark.createDataFrame([("h", "m", "x")], "msg_hash string, message string, row string")
    plan = al.first_of_each(messages, ["row"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


# --- severity -------------------------------------------------------------------------------------------------------


def test_default_severity(spark):
    counts = [0, 1, 5, 6, 10, 11, 20, 21, 26]
    df = rate(findings(spark, *[finding("fs", n) for n in counts]))
    got = {r["total_exposed"]: r["severity"] for r in df.collect()}
    assert got == {0: "Low", 1: "Low", 5: "Low", 6: "Medium", 10: "Medium", 11: "High", 20: "High", 21: "Highest", 26: "Highest"}


def test_first_true_rule_wins(spark):
    rules = {
        "A": [{"query": "bucket = 'b'", "description": "null without a bucket"}, {"query": "size(matches) > 3", "description": "many"}],
        "B": [{"query": "pattern_name IN ('EMAIL')", "description": "case counts"}, {"query": "size(matches) > 1", "description": "some"}],
    }
    df = rate(findings(spark, finding("s3", 1, bucket="b"), finding("fs", 4), finding("fs", 2), finding("fs", 1)), rules)
    assert [(r["severity"], r["severity_description"]) for r in df.collect()] == [
        ("A", "null without a bucket"),
        ("A", "many"),
        ("B", "some"),
        ("unknown", "No matching rule found."),
    ]
    assert rate(findings(spark, finding("fs")), {}).first()["severity"] == "unknown"


# --- reports --------------------------------------------------------------------------------------------------------

EVERY_PLACE = {c: c.upper() for cols in LOCATORS.values() for c in cols}


def test_locations(spark):
    df = findings(spark, *[finding(s, **{c: EVERY_PLACE[c] for c in cols}) for s, cols in LOCATORS.items()], finding("mysql", table="t"), finding("other"))
    got = df.select("data_source", rp.location()).collect()
    assert [tuple(r) for r in got] == [
        ("mysql", "HOST > DATABASE > TABLE.COLUMN"),
        ("postgresql", "HOST > DATABASE > TABLE.COLUMN"),
        ("mongodb", "HOST > DATABASE > COLLECTION > FIELD"),
        ("couchdb", "HOST > DATABASE > DOC_ID > FIELD"),
        ("redis", "HOST > KEY"),
        ("s3", "BUCKET > FILE_PATH"),
        ("gcs", "BUCKET > FILE_PATH"),
        ("firebase", "BUCKET > FILE_PATH"),
        ("fs", "FILE_PATH"),
        ("gdrive", "FILE_NAME"),
        ("gdrive_workspace", "FILE_NAME > USER"),
        ("slack", "CHANNEL_NAME > MESSAGE_LINK"),
        ("text", ""),
        ("mysql", " >  > t."),
        ("other", ""),
    ]


def test_shown_matches(spark):
    df = findings(spark, *[finding("fs", n) for n in (1, 24, 25, 26)])
    shown = [r[0] for r in df.select(rp.shown_matches()).collect()]
    first = ", ".join(f"m{i:02}" for i in range(25))
    assert shown == ["m00", first[: -len(", m24")], first + " + 0 more", first + " + 1 more"]


def test_grouped_pages_are_whole(spark):
    df = findings(spark, *[finding("fs", file_path=f"/{i:03}") for i in range(25)], finding("s3", bucket="b"))
    pages = rp.grouped(df, page_rows=10).orderBy("data_source", "page").collect()
    assert [(p["data_source"], p["page"], len(p["findings"])) for p in pages] == [("fs", 0, 10), ("fs", 1, 10), ("fs", 2, 5), ("s3", 0, 1)]
    assert [f["file_path"] for p in pages[:3] for f in p["findings"]] == [f"/{i:03}" for i in range(25)]


def test_table_totals_and_files(spark, tmp_path):
    df = rate(findings(spark, *[finding("fs", i + 1, file_path=f"/{i}") for i in range(3)], finding("s3", bucket="b", file_path="k")))
    table = {(r["data_source"], r["sl_no"]): r for r in rp.report_table(df).collect()}
    assert sorted(table) == [("fs", 1), ("fs", 2), ("fs", 3), ("s3", 1)]
    assert table[("fs", 2)]["location"] == "/1" and table[("fs", 2)]["exposed_values"] == "m00, m01"
    totals = {r["data_source"]: r["title"] for r in rp.source_totals(df).collect()}
    assert totals == {"fs": "Total 3 findings in fs", "s3": "Total 1 findings in s3"}
    matrix = {(r["data_source"], r["severity"]): (r["findings"], r["total_exposed"]) for r in rp.severity_matrix(df).collect()}
    assert matrix == {("fs", "Low"): (3, 6), ("s3", "Low"): (1, 1)}
    rp.write_json(df, str(tmp_path / "json"))
    back = spark.read.json(str(tmp_path / "json"))
    assert {(r["data_source"], r["file_path"]) for r in back.collect()} == {("fs", "/0"), ("fs", "/1"), ("fs", "/2"), ("s3", "k")}
    rp.write_table(df, str(tmp_path / "table"))
    rp.write_table(df, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 8


def test_conform(spark):
    df = conform(spark.createDataFrame([("fs", ["x"])], "data_source string, matches array<string>"))
    assert df.schema.fieldNames() == FINDING_SCHEMA.fieldNames() and df.first()["bucket"] is None


# --- alerts ---------------------------------------------------------------------------------------------------------


def test_message(spark):
    df = findings(spark, finding("couchdb", 2, host="h", database="d", doc_id="7", field="f"), finding("other"))
    a, b = [r[0] for r in df.select(al.alert_message("<@x>")).collect()]
    assert a == (
        "<@x> *** PII Or Secret Found ***\nData Source: CouchDB - p\nHost: h\nDatabase: d\nDocument ID: 7\nField: f\n"
        "Pattern Name: Email\nTotal Exposed: 2\nExposed Values: m00, m01"
    )
    assert b.startswith("<@x> *** PII Or Secret Found ***\nData Source: other - p\nPattern Name")


def test_hash_ignores_link_lines(spark):
    df = findings(spark, *[finding("slack", channel_name="c", message_link=f"https://l/{i}") for i in range(2)], finding("slack", channel_name="d"))
    hashes = [r["msg_hash"] for r in al.alerts(df).collect()]
    assert hashes[0] == hashes[1] != hashes[2] and len(hashes[0]) == 64


def test_suppression(spark, tmp_path):
    made = [finding("slack", channel_name="c", message_link=f"https://l/{i}") for i in range(50)]
    every = al.alerts(findings(spark, *made, finding("fs", file_path="/a")))
    first = al.suppress(every, None)
    assert sorted(r["message_link"] or "" for r in first.collect()) == ["", "https://l/0"]
    path = str(tmp_path / "history")
    al.append_history(first, path)
    assert al.suppress(every, spark.read.parquet(path)).count() == 0
    assert al.suppress(every, spark.read.parquet(path), no_write=True).count() == 51
    assert al.suppress(every, spark.read.parquet(path), suppress_duplicates=False).count() == 51
    new = al.alerts(findings(spark, finding("fs", file_path="/b")))
    assert al.suppress(every.union(new), spark.read.parquet(path)).count() == 1


def test_outbox_and_tickets(spark):
    every = al.alerts(findings(spark, finding("s3", 11, bucket="b", file_path='k"1')))
    text = json.loads(al.outbox(every).first()["payload"])["text"]
    assert 'File Path: k"1' in text
    people = spark.createDataFrame([("soc@example.org", "acc-2"), ("soc@example.org", "acc-1")], "email string, account_id string")
    args = ("SEC", "Task", "Issue {{x}}: {details} in {bucket} {matches}", ["one", "two"])
    ticket = al.tickets(every, *args, "soc@example.org", people).first()
    fields = json.loads(ticket["payload"])["fields"]
    assert fields["summary"] == "Found 11 Email in s3" and fields["priority"] == {"name": "High"}
    assert fields["assignee"] == {"accountId": "acc-1"} and fields["labels"] == ["one", "two"]
    assert fields["project"] == {"key": "SEC"} and fields["issuetype"] == {"name": "Task"}
    assert fields["description"].startswith("Issue {x}: *** PII")
    assert "\n\nSeverity: High\nSeverity Description: Detected more than 10 PII or Secrets in b m00, m01" in fields["description"]
    unknown = json.loads(al.tickets(every, *args, "no@example.org", people).first()["payload"])["fields"]
    assert "accountId" not in unknown.get("assignee", {})
    with pytest.raises(KeyError):
        al.tickets(every, "SEC", "Task", "{nope}")
    looked_up = al.assign(spark.createDataFrame([("soc@example.org",), ("no@x",)], "email string"), people)
    assert {tuple(r) for r in looked_up.collect()} == {("soc@example.org", "acc-1"), ("no@x", None)}


def test_redact_document(spark):
    rows = [(1, "call 1234567 or 12345678, 1234567", "x"), (2, None, "x"), (3, "", "x"), (4, "nothing", "x")]
    df = spark.createDataFrame(rows, "id int, text string, value string")
    got = {r.id: r.redacted for r in redact_document(df, "text", {"n": "[0-9]{7,8}"}).collect()}
    # The longer match first: the shorter one is part of it.
    seven, eight = redacted("1234567"), redacted("12345678")
    assert got == {1: f"call {seven} or {eight}, {seven}", 2: None, 3: "", 4: "nothing"}


def redacted(s):
    n = len(s)
    q = n // 4
    a = n // 2 - q
    return s[:a] + "*" * (2 * q) + s[a + 2 * q :]
