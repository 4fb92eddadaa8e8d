"""Captured responses → fragments, requests and the stored item table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.enrich import enrich
from ..operators.filters import digests, mark_unchanged, status_gate
from ..operators.frontier import KEYS, frontier
from ..operators.generations import current
from ..operators.merge import add_batch, drop_empty, drop_html, upsert_items
from ..operators.route import DEFAULT_RULES, route, route_by_table
from ..schema import FRAGMENT, REQUEST
from ..sources.github import parse_gist, parse_gist_stars, parse_github_repo, parse_github_stars
from ..sources.gitlab import (
    parse_gitlab_project,
    parse_gitlab_readme,
    parse_gitlab_stars,
    parse_gitlab_users,
)
from ..sources.pages import CONTENT_KINDS, LINKED_KINDS, parse_pages
from ..sources.pocket import parse_pocket
from ..sources.responses import Parsed, union
from ..sources.tweets import parse_tweets

PARSERS = {
    "github_stars": parse_github_stars,
    "github_repo": parse_github_repo,
    "gist_stars": parse_gist_stars,
    "gist": parse_gist,
    "gitlab_users": parse_gitlab_users,
    "gitlab_stars": parse_gitlab_stars,
    "gitlab_project": parse_gitlab_project,
    "gitlab_readme": parse_gitlab_readme,
    "pocket": parse_pocket,
    "tweets": parse_tweets,
}
PAGE_KINDS = CONTENT_KINDS + LINKED_KINDS
KINDS = [*PARSERS, *PAGE_KINDS]
ANSWERED = "source string, request_key string, digest string"
SOURCES = ["github_stars", "gitlab_stars", "pocket", "twitter_favs"]


def parse_responses(responses: DataFrame, sources=None, kinds=None, metadata=None) -> Parsed:
    """Run every parser on its kind of response; fragments come enriched.

    ``metadata`` names a column of ``responses`` with ready page metadata.

    Each branch filters on ``kind``: over a table stored by source and kind it scans
    its own folder only, so all branches together read the table once. Page kinds
    share one branch, and only fragments that have a page are enriched.
    """
    kinds = KINDS if kinds is None else [k for k in kinds if k in KINDS]
    responses = status_gate(responses)
    if sources is not None:
        responses = responses.filter(F.col("source").isin(list(sources)))
    parsed = {kind: PARSERS[kind](responses) for kind in kinds if kind in PARSERS}
    page_kinds = [k for k in kinds if k in PAGE_KINDS]
    if page_kinds:
        parsed["pages"] = parse_pages(responses, page_kinds, metadata)
    items = [
        _enriched(p.fragments, metadata) if name in ("pages", "gitlab_readme") else p.fragments
        for name, p in parsed.items()
        if p.fragments is not None
    ]
    links = [p.requests for p in parsed.values() if p.requests is not None]
    spark = responses.sparkSession
    return Parsed(
        union(*items) if items else spark.createDataFrame([], FRAGMENT),
        union(*links) if links else spark.createDataFrame([], REQUEST),
    )


def _enriched(fragments, metadata):
    return enrich(fragments, metadata if metadata in fragments.columns else None).select(*FRAGMENT.names)


def storable(fragments: DataFrame) -> DataFrame:
    """The end of the item pipeline: drop the page, drop empty values."""
    return drop_empty(drop_html(fragments))


def _stored(spark, path, schema) -> DataFrame:
    folders = current(spark, path)
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_answered(spark: SparkSession, path) -> DataFrame:
    """(source, request_key, digest) of everything answered so far."""
    return _stored(spark, f"{path}/answered", ANSWERED)


def read_frontier(spark: SparkSession, path) -> DataFrame:
    """Requests found so far that no response answers yet, each once."""
    return frontier(_stored(spark, f"{path}/requests", REQUEST), read_answered(spark, path))


def store_requests(requests: DataFrame, crawl_path, name=None):
    """Add routed requests to the stored ones; a repeat costs a row, and readers fold it."""
    add_batch(frontier(requests), f"{crawl_path}/requests", name=name)


def compact_crawl(spark: SparkSession, path):
    """Fold the state of a crawl: the open requests and the answers, each one table ranged by key.

    What is written meanwhile stays beside them.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def ranged(df):
        return df.repartitionByRange(parts, *KEYS).sortWithinPartitions(*KEYS)

    requests, answered = current(spark, f"{path}/requests"), current(spark, f"{path}/answered")
    if requests:
        open_ones = frontier(spark.read.schema(REQUEST).parquet(*requests), read_answered(spark, path))
        add_batch(ranged(open_ones), f"{path}/requests", requests)
    if answered:
        add_batch(ranged(spark.read.schema(ANSWERED).parquet(*answered).distinct()), f"{path}/answered", answered)


def ingest(
    responses: DataFrame, index_path, sources=None, rules=None, crawl_path=None, kinds=None, metadata=None, batch=None
) -> DataFrame:
    """Merge all items of ``responses`` into the stored table; return the new frontier.

    With ``crawl_path`` the state of the crawl is kept there: responses whose body an earlier call
    has seen are marked ``cached``, nothing is asked for that any call has answered, and the
    frontier holds the open requests of all calls. ``metadata`` names a column of ``responses`` with
    ready page metadata, to be used instead of the page's own. ``rules`` are a list, or a RULE table.
    A call repeated under the name of its ``batch`` adds nothing that is there.
    """
    spark = responses.sparkSession
    answered = responses
    if crawl_path is not None:
        responses = mark_unchanged(responses, read_answered(spark, crawl_path))
    parsed = parse_responses(responses, sources, kinds, metadata)
    upsert_items(storable(parsed.fragments), index_path, batch)
    rules = DEFAULT_RULES if rules is None else rules
    routed = route_by_table(parsed.requests, rules) if isinstance(rules, DataFrame) else route(parsed.requests, rules)
    if crawl_path is None:
        return frontier(routed, answered)
    # Requests first, answers last: a call that fails between is repeated as a whole.
    store_requests(routed, crawl_path, batch)
    add_batch(digests(answered), f"{crawl_path}/answered", name=batch)
    return read_frontier(spark, crawl_path)
