"""The RESPONSE table and the two tables that parsers emit."""

from collections import namedtuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FRAGMENT, REQUEST, RESPONSE

# Two DataFrames: FRAGMENT and REQUEST.
Parsed = namedtuple("Parsed", "fragments requests")


def read_responses(spark: SparkSession, path, streaming=False, max_files_per_trigger=None) -> DataFrame:
    """Captured responses, batch or streaming; unknown columns stay unread."""
    if not streaming:
        return spark.read.schema(RESPONSE).parquet(path)
    reader = spark.readStream.schema(RESPONSE)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def write_responses(responses: DataFrame, path, mode="append"):
    """Store responses by source and kind, so that each parser scans its own folder only."""
    responses.write.mode(mode).partitionBy("source", "kind").parquet(path)


def request_key(method="method", url="url", body="body"):
    """Identity of a request: method, URL and body."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in (method, url, body)]
    return F.sha2(F.concat_ws("\n", *parts), 256)


def pages_as_responses(pages: DataFrame, source="pages", kind="page") -> DataFrame:
    """A plain (page_id, url, html) table as RESPONSE rows: status 200, text/html."""
    requests = pages.select(
        "page_id", "html", F.col("url"), F.lit("GET").alias("method"), F.lit("").alias("body")
    )
    return requests.select(
        F.lit(source).alias("source"),
        F.lit(kind).alias("kind"),
        request_key().alias("request_key"),
        F.col("url").alias("request_url"),
        F.col("url").alias("final_url"),
        F.lit(200).alias("status"),
        F.array().cast("array<string>").alias("flags"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8")).alias("headers"),
        F.col("html").alias("body"),
        F.create_map(F.lit("url"), F.col("url")).alias("meta"),
        F.lit(None).cast("timestamp").alias("fetched_at"),
        F.col("page_id").alias("seq"),
    )


def as_responses(df: DataFrame, source, kind, **columns) -> DataFrame:
    """RESPONSE rows from any table: named columns are taken, the rest get defaults."""
    defaults = {
        "request_url": F.lit(None).cast("string"),
        "final_url": columns.get("request_url", F.lit(None).cast("string")),
        "status": F.lit(200),
        "flags": F.array().cast("array<string>"),
        "headers": F.create_map(F.lit("Content-Type"), F.lit("application/json")),
        "meta": F.create_map().cast("map<string,string>"),
        "fetched_at": F.lit(None).cast("timestamp"),
    }
    values = {**defaults, **columns}
    values.setdefault("request_key", F.sha2(F.concat(F.lit("GET\n"), values["request_url"], F.lit("\n")), 256))
    values["source"], values["kind"] = F.lit(source), F.lit(kind)
    return df.select(
        *[values[f.name].cast(f.dataType).alias(f.name) for f in RESPONSE.fields]
    )


def fragments(df: DataFrame, pos=0, extra=(), **values) -> DataFrame:
    """FRAGMENT rows and the ``extra`` columns; columns not named are NULL. Needs ``source`` and ``seq``."""
    values = {"source": F.col("source"), "seq": F.col("seq"), "pos": F.lit(pos) if isinstance(pos, int) else pos, **values}
    return df.select(
        *[
            values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in FRAGMENT.fields
        ],
        *extra,
    )


def requests(df: DataFrame, kind, url, pos=0, method="GET", body=None, headers=None, meta=None) -> DataFrame:
    """REQUEST rows; rows without a URL ask for nothing and are left out."""
    pairs = lambda d: (
        F.create_map(*[x for k, v in d.items() for x in (F.lit(k), v)])
        if d
        else F.create_map().cast("map<string,string>")
    )
    # Metadata without a value is metadata not set.
    set_only = lambda m: F.map_filter(m, lambda _, v: v.isNotNull())
    rows = df.select(
        "source",
        F.lit(kind).alias("kind"),
        F.lit(method).alias("method"),
        url.alias("url"),
        (F.lit("") if body is None else body).alias("body"),
        pairs(headers or {}).alias("headers"),
        set_only(pairs(meta or {})).alias("meta"),
        F.col("seq").alias("parent_seq"),
        (F.lit(pos) if isinstance(pos, int) else pos).cast("bigint").alias("pos"),
    ).filter(F.col("url").isNotNull() & (F.col("url") != ""))
    return rows.withColumn("request_key", request_key()).select(
        *[F.col(f.name).cast(f.dataType) for f in REQUEST.fields]
    )


def union(*frames) -> DataFrame:
    head, *rest = [f for f in frames if f is not None]
    for f in rest:
        head = head.unionByName(f)
    return head


def nested_pos(outer, inner):
    """Emission order inside a response: inner outputs of entry ``outer`` in their order."""
    return F.shiftleft(outer.cast("bigint"), 32) + inner.cast("bigint")


def after_all(items):
    """Position behind every output of ``items``."""
    return F.shiftleft(F.size(items).cast("bigint"), 32)

