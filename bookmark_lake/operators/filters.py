"""Row filters over RESPONSE."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sources whose parsers also see error responses (400 to 599).
ERROR_AWARE_SOURCES = ["github_stars", "gitlab_stars"]


def is_processable(process_cached=False) -> Column:
    """Status below 400 and not 304; cached responses only where asked for."""
    status_ok = (F.col("status") < 400) & (F.col("status") != 304)
    if process_cached:
        return status_ok
    cached = F.coalesce(F.array_contains("flags", "cached"), F.lit(False))
    return status_ok & ~cached


def processable(responses: DataFrame, process_cached=False) -> DataFrame:
    return responses.filter(is_processable(process_cached))


def status_gate(responses: DataFrame) -> DataFrame:
    """Statuses that reach a parser: 2xx, and errors for the error-aware sources."""
    success = F.col("status").between(200, 299)
    error = F.col("status").between(400, 599) & F.col("source").isin(ERROR_AWARE_SOURCES)
    return responses.filter(success | error)


def body_digest() -> Column:
    return F.sha2(F.coalesce(F.col("body"), F.lit("")), 256)


def digests(responses: DataFrame) -> DataFrame:
    """What is kept of answered requests: (source, request_key, digest), never a body."""
    return responses.select("source", "request_key", body_digest().alias("digest")).distinct()


def mark_unchanged(responses: DataFrame, previous: DataFrame) -> DataFrame:
    """Flag as ``cached`` every response whose body an earlier crawl already holds.

    ``previous`` has the digests of earlier responses, or the responses themselves. The rows that
    are joined are narrow: the keys of the responses that an earlier digest equals come out of a
    semi join without any body, and bodies meet only these. A request fetched very often is spread
    by the digest in the join key; equal copies fold before the shuffle.
    """
    keys = ["source", "request_key", "digest"]
    seen = previous.select(*keys) if "digest" in previous.columns else digests(previous)
    known = digests(responses).join(seen, keys, "left_semi").withColumn("seen", F.lit(True))
    flags = F.coalesce(F.col("flags"), F.array().cast("array<string>"))
    marked = F.when(F.col("seen"), F.array_union(flags, F.array(F.lit("cached")))).otherwise(flags)
    return (
        responses.withColumn("digest", body_digest())
        .join(known, keys, "left")
        .withColumn("flags", marked)
        .select(*responses.columns)
    )
