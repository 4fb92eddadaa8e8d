"""Liked posts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.tags import hashtags
from ..functions.urls import tweet_url
from ..functions.values import non_empty_array
from ..operators.filters import processable
from .responses import Parsed, after_all, fragments, nested_pos, requests, union

TWEETS = (
    "array<struct<id:bigint,full_text:string,created_at:string,user:struct<screen_name:string>,"
    "entities:struct<hashtags:array<struct<text:string>>,urls:array<struct<expanded_url:string>>>>>"
)

# Fixed values of the service's API.
PAGE_SIZE = 100
API_URL = "https://api.twitter.com/1.1/favorites/list.json"


def parse_tweets(responses: DataFrame) -> Parsed:
    """Page of liked posts → item and linked-page requests each; next page below the last id."""
    pages = processable(responses.filter(F.col("kind") == "tweets")).select(
        "source", "seq", F.from_json("body", TWEETS).alias("tweets")
    )
    tweets = pages.select("source", "seq", F.posexplode("tweets").alias("i", "t")).withColumn(
        "url", tweet_url(F.col("t.user.screen_name"), F.col("t.id"))
    )
    items = fragments(
        tweets,
        pos=nested_pos(F.col("i"), F.lit(0)),
        url=F.col("url"),
        content=F.col("t.full_text"),
        last_update=parse_date(F.col("t.created_at")),
        twitter_tags=non_empty_array(hashtags(F.col("t.entities"))),
    )
    links = tweets.select(
        "source", "seq", "i", "url", F.posexplode("t.entities.urls").alias("j", "link")
    )
    linked = requests(
        links,
        "tweet_page",
        F.col("link.expanded_url"),
        pos=nested_pos(F.col("i"), F.col("j")),
        meta={"url": F.col("link.expanded_url"), "twitter_url": F.col("url")},
    )
    last_id = F.try_element_at(F.col("tweets"), F.lit(-1))["id"]
    # An empty page ends the paging.
    next_pages = requests(
        pages.filter(F.size("tweets") > 0),
        "tweets",
        F.format_string(f"{API_URL}?count={PAGE_SIZE}&tweet_mode=extended&max_id=%d", last_id - 1),
        pos=after_all(F.col("tweets")),
        meta={"dont_obey_robotstxt": F.lit("true")},
    )
    return Parsed(items, union(linked, next_pages))
