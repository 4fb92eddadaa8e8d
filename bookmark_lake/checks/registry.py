"""Registry of queries and their SQL, and helpers to write both."""

import math

from pyspark.sql import functions as F

from ..schema import ITEM_ARRAYS, ITEM_VALUES

QUERIES = {}
SQL = {}


def check(name, sql=None):
    """Register a query ``f(spark, sf_dir) -> DataFrame`` and, if it has one, its SQL."""

    def register(query):
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Short rows that one task takes where each of them is much work.
TASK_ROWS = 5_000


def spread(df):
    """``df`` dealt to tasks by its number of rows: a table of short rows may be one small file, read by one task."""
    return df.repartition(max(1, math.ceil(df.count() / TASK_ROWS)))


def joined(c):
    """Arrays as text, so that every engine compares them alike."""
    return F.array_join(c, "|")


def _pairs(prefix, m):
    return F.array_join(
        F.array_sort(
            F.transform(F.map_entries(m), lambda e: F.concat(F.lit(prefix), e["key"], F.lit("="), e["value"]))
        ),
        "; ",
    )


def outputs(parsed):
    """What a parser emits as rows (out, seq, pos, kind, url, detail)."""
    frames = []
    if parsed.fragments is not None:
        values = [
            F.concat(F.lit(f"{c}="), joined(c) if c in ITEM_ARRAYS else F.col(c)) for c in ITEM_VALUES
        ]
        frames.append(
            parsed.fragments.select(
                F.lit("item").alias("out"),
                "seq",
                "pos",
                F.col("source").alias("kind"),
                "url",
                F.concat_ws("; ", *values).alias("detail"),
            )
        )
    if parsed.requests is not None:
        frames.append(
            parsed.requests.select(
                F.lit("request").alias("out"),
                F.col("parent_seq").alias("seq"),
                "pos",
                "kind",
                "url",
                F.concat_ws(
                    "; ",
                    F.when(F.col("method") != "GET", F.concat_ws(" ", "method", "body")),
                    F.when(F.size("headers") > 0, _pairs("header ", F.col("headers"))),
                    F.when(F.size("meta") > 0, _pairs("", F.col("meta"))),
                ).alias("detail"),
            )
        )
    head, *rest = frames
    for frame in rest:
        head = head.unionByName(frame)
    return head


def sql_item(seq, pos, source, url, values, from_where):
    """SELECT of one kind of emitted item; ``values`` maps item columns to SQL."""
    parts = ", ".join(f"'{c}=' || {values[c]}" for c in ITEM_VALUES if c in values)
    return (
        f"SELECT 'item' AS out, CAST({seq} AS BIGINT) AS seq, CAST({pos} AS BIGINT) AS pos, "
        f"'{source}' AS kind, {url} AS url, concat_ws('; ', {parts}) AS detail {from_where}"
    )


def sql_request(seq, pos, kind, url, from_where, headers=None, meta=None, post=None):
    """SELECT of one kind of emitted request; all values are SQL."""
    parts = [f"'POST ' || {post}"] if post else []
    parts += [f"'header {k}=' || {v}" for k, v in sorted((headers or {}).items())]
    parts += [f"'{k}=' || {v}" for k, v in sorted((meta or {}).items())]
    return (
        f"SELECT 'request' AS out, CAST({seq} AS BIGINT) AS seq, CAST({pos} AS BIGINT) AS pos, "
        f"'{kind}' AS kind, {url} AS url, concat_ws('; ', {', '.join(parts)}) AS detail {from_where}"
    )


def sql_union(*selects):
    return "\nUNION ALL\n".join(selects)


# White-space class and strip() in DuckDB, as values.strip().
SPACE = r"[\t-\r\x1c-\x1f\x85\p{Z}]"


def sql_strip(c):
    return f"regexp_replace({c}, '\\A{SPACE}+|{SPACE}+\\z', '', 'g')"
