"""Database tables as cells."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cellsift.functions.text import printed, truthy
from cellsift.operators.ordering import row_range
from cellsift.schema import locate

CELL_COLUMNS = ("table", "column", "value")


def table_cells(
    df: DataFrame,
    table: str,
    ids: Sequence[str] = (),
    exclude_columns: Iterable[str] = (),
    order_by: str | Sequence[str] | None = None,
    limit_start: int = 0,
    limit_end: int | None = None,
) -> DataFrame:
    """Rows to ``(ids…, table, column, value)``: every cell that holds something, as text.

    Excluded columns are dropped before the scan, so files never deliver them. ``limit_end`` is a number of rows, taken
    in the order of ``order_by``; None is the whole table. ``ids`` are repeated on each cell and scanned too; one that is named
    like a column of cells is only scanned. A table without columns left has no cells.
    """
    ids = [i for i in ids if i not in CELL_COLUMNS]
    excluded = set(exclude_columns)
    columns = [f for f in df.schema.fields if f.name not in excluded]
    if limit_end is not None or limit_start:
        if order_by is None:
            raise ValueError("a row range needs an order_by column")
        df = row_range(df, order_by, limit_start, limit_end)
    taken = df.select(
        *[F.col(f"`{i}`").alias(f"_id{n}") for n, i in enumerate(ids)],
        *[cell_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in columns],
    )
    names = [f"`{f.name}`" for f in columns]
    if not names:
        empty = taken.withColumns({"column": F.lit(None).cast("string"), "value": F.lit(None).cast("string")}).where(F.lit(False))
        return empty.select(*[F.col(f"_id{n}").alias(i) for n, i in enumerate(ids)], F.lit(table).alias("table"), "column", "value")
    melted = taken.unpivot([f"_id{n}" for n in range(len(ids))], names, "column", "value")
    return melted.where(F.col("value").isNotNull() & (F.col("value") != "")).select(
        *[F.col(f"_id{n}").alias(i) for n, i in enumerate(ids)], F.lit(table).alias("table"), "column", "value"
    )


def cell_text(c: Column, dtype: T.DataType) -> Column:
    """Printed value of a cell, null if the cell counts as empty."""
    return F.when(truthy(c, dtype), printed(c, dtype))


def pick_tables(available: Iterable[str], whitelist: Iterable[str] | None = None) -> list[str]:
    """Listed tables that exist, in the order of the database; an empty list means all."""
    wanted = set(whitelist or ())
    return [t for t in available if not wanted or t in wanted]


def catalog_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    """Names of a database's tables; temporary views belong to no database."""
    return [t.name for t in spark.catalog.listTables(database) if not t.isTemporary]


def catalog_reader(spark: SparkSession, database: str | None = None) -> Callable[[str], DataFrame]:
    """Reads a table of the named database, whatever database or view of its name is current."""
    where = database or spark.catalog.currentDatabase()
    spelled = ".".join("`" + part.replace("`", "``") + "`" for part in where.split("."))
    return lambda name: spark.table(f"{spelled}.`{name.replace('`', '``')}`")


def folder_tables(spark: SparkSession, path: str, suffix: str = "") -> list[str]:
    """Names of the tables in a folder: its entries with the suffix, by a listing of that folder alone."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    entries = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = sorted(e.getPath().getName() for e in entries)
    return [n.removesuffix(suffix) for n in names if n.endswith(suffix) and not n.startswith(("_", "."))]


def jdbc_tables(spark: SparkSession, url: str, schema: str, properties: Mapping[str, str] | None = None) -> list[str]:
    """Base tables of one schema, from the database's information schema (bounded: names only)."""
    query = (
        "SELECT table_name FROM information_schema.tables "
        f"WHERE table_schema = '{schema.replace(chr(39), chr(39) * 2)}'"
    )
    options = {"url": url, "query": query, **(properties or {})}
    return [r[0] for r in spark.read.format("jdbc").options(**options).load().collect()]


def jdbc_options(
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    partitions: int = 1,
    properties: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Reader options; with a partition column the table is read in ``partitions`` parallel ranges."""
    options = {"url": url, "dbtable": table, "fetchsize": "10000", **(properties or {})}
    if partition_column is not None:
        if bounds is None:
            raise ValueError("a partition column needs bounds")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def quoted_name(url: str, *parts: str | None) -> str:
    """A name as the database itself spells it, in the quotes of the database of ``url``; parts that are None are left out."""
    mark = "`" if url.startswith(("jdbc:mysql:", "jdbc:mariadb:")) else '"'
    return ".".join(mark + p.replace(mark, mark * 2) + mark for p in parts if p is not None)


def single_key_sql(schema: str, table: str) -> str:
    """Asks for the columns of a table's primary key."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    return (
        "SELECT k.column_name AS key_column FROM information_schema.table_constraints c JOIN information_schema.key_column_usage k "
        "ON k.constraint_name = c.constraint_name AND k.table_schema = c.table_schema AND k.table_name = c.table_name "
        f"WHERE c.constraint_type = 'PRIMARY KEY' AND c.table_schema = {text(schema)} AND c.table_name = {text(table)}"
    )


def cuts_sql(name: str, column: str, parts: int) -> str:
    """Asks for the number and first key of each of ``parts`` equally large parts of a table, names quoted already."""
    dealt = f"SELECT {column} AS k, ntile({parts}) OVER (ORDER BY {column}) AS part FROM {name} WHERE {column} IS NOT NULL"
    return f"SELECT part, min(k) AS cut FROM ({dealt}) AS dealt GROUP BY part"


def range_predicates(column: str, cuts: Sequence[object]) -> list[str]:
    """Conditions of which each row meets exactly one: below the second cut or without a key, between two cuts, from the last on.

    Repeated cuts make one range. The database compares keys as it did to find the cuts, whatever its collation.
    """

    def literal(value: object) -> str:
        return str(value) if isinstance(value, (int, float, Decimal)) else "'" + str(value).replace("'", "''") + "'"

    inner = [literal(c) for c in dict.fromkeys(cuts)][1:]
    if not inner:
        return ["1 = 1"]
    between = [f"{column} >= {low} AND {column} < {high}" for low, high in zip(inner[:-1], inner[1:], strict=True)]
    return [f"{column} < {inner[0]} OR {column} IS NULL", *between, f"{column} >= {inner[-1]}"]


def jdbc_reader(
    spark: SparkSession,
    url: str,
    per_table: Mapping[str, Mapping[str, object]] | None = None,
    schema: str | None = None,
    **options: object,
) -> Callable[[str], DataFrame]:
    """Reads tables by the names that the database lists, of one schema if it is given.

    ``per_table`` names partitioning of its own for a table, as every table has another key and other bounds. With ``partitions`` and a
    schema but no partition column a table with a primary key of one column is read in equally large ranges of that key, whose cuts
    the database is asked for (one row a range); other tables are read as one.
    """

    def ask(query: str, properties: Mapping[str, str] | None) -> list:
        return spark.read.format("jdbc").options(url=url, query=query, **(properties or {})).load().collect()

    def read(table: str) -> DataFrame:
        own = {**options, **(per_table or {}).get(table, {})}
        properties, parts = own.get("properties"), int(own.get("partitions") or 1)
        name = quoted_name(url, schema, table)
        if own.get("partition_column") is not None:
            if own.get("bounds") is None:
                column = quoted_name(url, str(own["partition_column"]))
                # Least and greatest key; an empty table has any bounds.
                low, high = ask(f"SELECT min({column}) AS a, max({column}) AS b FROM {name}", properties)[0]
                own["bounds"] = (0, 1) if low is None else (low, high)
        elif parts > 1 and schema is not None:
            keys = [r[0] for r in ask(single_key_sql(schema, table), properties)]
            if len(keys) == 1:
                column = quoted_name(url, keys[0])
                # In the order of the database, which may collate keys in its own way.
                cuts = [cut for _, cut in sorted(ask(cuts_sql(name, column, parts), properties), key=lambda r: r[0])]
                wanted = {"fetchsize": "10000", **(properties or {})}
                return spark.read.jdbc(url, name, predicates=range_predicates(column, cuts), properties=wanted)
        return spark.read.format("jdbc").options(**jdbc_options(url, name, **own)).load()

    return read


def scan_tables(
    tables: Iterable[str],
    reader: Callable[[str], DataFrame],
    whitelist: Iterable[str] | None = None,
    ids: Mapping[str, Sequence[str]] | None = None,
    exclude_columns: Iterable[str] = (),
    order_by: Mapping[str, str | Sequence[str]] | None = None,
    limit_start: int = 0,
    limit_end: int | None = None,
    data_source: str = "postgresql",
    profile: str | None = None,
    **locators: object,
) -> DataFrame:
    """Cells of all selected tables in one plan, with the locators of their database.

    Tables that are not selected are never read. Ids differ per table, so they are printed into one ``row_id`` column.
    """
    excluded = list(exclude_columns)
    parts = []
    for name in pick_tables(tables, whitelist):
        df = reader(name)
        keys = list((ids or {}).get(name, ()))
        cells = table_cells(df, name, keys, excluded, (order_by or {}).get(name), limit_start, limit_end)
        row_id = F.concat_ws("|", *[F.col(f"`{k}`").cast("string") for k in keys]) if keys else F.lit(None)
        parts.append(cells.select(row_id.cast("string").alias("row_id"), *CELL_COLUMNS))
    if not parts:
        raise ValueError("no table selected")
    return locate(reduce(DataFrame.unionByName, parts), data_source, profile, **locators)
