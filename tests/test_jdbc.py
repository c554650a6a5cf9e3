"""What is asked of a database, put to one inside this process; Spark's own connections are not opened."""

import duckdb
import pytest

from cellsift.sources.tables import cuts_sql, quoted_name, range_predicates, single_key_sql


def test_names():
    assert quoted_name("jdbc:postgresql://h/d", "Shop", 'a "b"') == '"Shop"."a ""b"""'
    assert quoted_name("jdbc:mysql://h/d", "shop", "a`b") == "`shop`.`a``b`"
    assert quoted_name("jdbc:postgresql://h/d", None, "t") == '"t"'


@pytest.fixture
def con():
    c = duckdb.connect()
    c.execute('CREATE SCHEMA "Shop"')
    yield c
    c.close()


def test_primary_key(con):
    con.execute('CREATE TABLE "Shop"."Orders" ("Id" BIGINT PRIMARY KEY, v TEXT)')
    con.execute('CREATE TABLE "Shop".pairs (a INT, b INT, PRIMARY KEY (a, b))')
    con.execute('CREATE TABLE "Shop"."it\'s" (a INT)')
    assert con.execute(single_key_sql("Shop", "Orders")).fetchall() == [("Id",)]
    assert len(con.execute(single_key_sql("Shop", "pairs")).fetchall()) == 2
    assert con.execute(single_key_sql("Shop", "it's")).fetchall() == []


@pytest.mark.parametrize("keys", ["i", "i % 3", "'k' || i", "TIMESTAMP '2024-01-01' + INTERVAL (i) MINUTE", "i::DECIMAL(12, 2) / 7", "NULL::INT", "CASE WHEN i < 700 THEN 5 ELSE i END"])
def test_each_row_lies_in_one_range(con, keys):
    con.execute(f'CREATE TABLE "Shop".t AS SELECT {keys} AS "Key", i FROM range(1000) AS r(i) UNION ALL SELECT NULL, -1')
    name, column = quoted_name("jdbc:x", "Shop", "t"), quoted_name("jdbc:x", "Key")
    cuts = [cut for _, cut in sorted(con.execute(cuts_sql(name, column, 8)).fetchall(), key=lambda r: r[0])]
    parts = [con.execute(f"SELECT i FROM {name} WHERE {p}").fetchall() for p in range_predicates(column, cuts)]
    assert sorted(r for part in parts for r in part) == sorted(con.execute(f"SELECT i FROM {name}").fetchall())
    if keys == "i":
        assert [len(p) for p in parts] == [126] + [125] * 7  # the row without a key is in the first


def test_an_empty_table_is_one_range():
    assert range_predicates("k", []) == range_predicates("k", [3]) == range_predicates("k", [3, 3]) == ["1 = 1"]
