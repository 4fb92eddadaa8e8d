"""Saved articles."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import epoch_date
from ..functions.tags import pocket_tags
from ..functions.values import first_non_empty, let
from ..operators.filters import processable
from .responses import Parsed, after_all, fragments, nested_pos, requests, union

ENTRY = (
    "struct<resolved_title:string,given_title:string,excerpt:string,time_added:string,"
    "resolved_url:string,given_url:string,tags:map<string,string>>"
)
PAGE = f"struct<status:int,list:map<string,{ENTRY}>>"

# Fixed values of the service's API.
PAGE_SIZE = 50
API_URL = "https://getpocket.com/v3/get"


def page_body(offset):
    """Form body of the page request at ``offset``; credentials are the downloader's."""
    return F.format_string(f"count={PAGE_SIZE}&offset=%d&state=all&detailType=complete", offset)


def ok_pages(responses: DataFrame) -> DataFrame:
    """Pages the service marks as good: payload status 1."""
    pages = processable(responses.filter(F.col("kind") == "pocket")).withColumn(
        "page", F.from_json("body", PAGE)
    )
    return pages.filter(F.col("page.status") == 1)


def parse_pocket(responses: DataFrame) -> Parsed:
    """Page of saved articles, by key → item and page request each; next page unless empty."""
    pages = ok_pages(responses).select(
        "source",
        "seq",
        "meta",
        # Maps cannot be ordered, their keys can.
        let(
            F.col("page.list"),
            lambda m: F.transform(F.array_sort(F.map_keys(m)), lambda k: F.element_at(m, k)),
        ).alias("entries"),
    )
    entries = pages.select("source", "seq", F.posexplode("entries").alias("i", "e"))
    entries = entries.withColumn("url", first_non_empty(F.col("e.resolved_url"), F.col("e.given_url")))
    items = fragments(
        entries,
        pos=nested_pos(F.col("i"), F.lit(0)),
        url=F.col("url"),
        name=first_non_empty(F.col("e.resolved_title"), F.col("e.given_title")),
        description=F.col("e.excerpt"),
        last_update=epoch_date(F.col("e.time_added")),
        alt_url=F.when(F.col("e.given_url") != F.col("url"), F.col("e.given_url")),
        pocket_tags=pocket_tags(F.col("e.tags")),
    )
    bookmarked = requests(
        entries,
        "pocket_page",
        F.col("url"),
        pos=nested_pos(F.col("i"), F.lit(0)),
        meta={"url": F.col("url")},
    )
    offset = F.try_element_at(F.col("meta"), F.lit("next_offset")).try_cast("bigint")
    next_pages = requests(
        pages.filter(F.size("entries") > 0),
        "pocket",
        F.lit(API_URL),
        pos=after_all(F.col("entries")),
        method="POST",
        body=page_body(offset),
        headers={"Content-Type": F.lit("application/x-www-form-urlencoded")},
        meta={
            "next_offset": (offset + PAGE_SIZE).cast("string"),
            "dont_obey_robotstxt": F.lit("true"),
        },
    )
    return Parsed(items, union(bookmarked, next_pages))
