"""Fetched pages: of known items, of repositories' homes, of links in posts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import page_html, page_text, page_title
from ..functions.values import non_empty
from ..operators.filters import processable
from .responses import Parsed, fragments


def _meta(key):
    return F.try_element_at(F.col("meta"), F.lit(key))


# Kinds of fetched pages: of items known already, and pages that are items themselves.
CONTENT_KINDS = ["github_readme", "gist_html", "pocket_page"]
LINKED_KINDS = ["homepage", "tweet_page"]


def parse_pages(responses: DataFrame, kinds=None, metadata=None) -> Parsed:
    """Fetched pages of every kind → text and html, in one pass over the pages.

    Pages of known items complete them: their title is known. A home page becomes an
    item under its final URL, linked back to its repository; a page linked from a
    post becomes one under the linked URL, linked back to the post.
    """
    pages = processable(responses.filter(F.col("kind").isin(kinds or CONTENT_KINDS + LINKED_KINDS)))
    homepage, tweet_page = F.col("kind") == "homepage", F.col("kind") == "tweet_page"
    values = {
        "url": F.when(homepage, F.col("final_url")).otherwise(_meta("url")),
        "name": F.when(homepage | tweet_page, non_empty(page_title("headers", "body"))),
        "repository_backlink": F.when(homepage, F.coalesce(_meta("github_url"), _meta("gitlab_url"))),
        "twitter_backlink": F.when(tweet_page, _meta("twitter_url")),
        "content": page_text("headers", "body"),
        "html": page_html("headers", "body"),
    }
    return Parsed(fragments(pages, extra=[metadata] if metadata else [], **values), None)


def parse_content(responses: DataFrame, kind) -> Parsed:
    """Fetched page of a known item."""
    return parse_pages(responses, [kind])


def parse_homepage(responses: DataFrame) -> Parsed:
    """Home page of a repository."""
    return parse_pages(responses, ["homepage"])


def parse_tweet_page(responses: DataFrame) -> Parsed:
    """Page linked from a post."""
    return parse_pages(responses, ["tweet_page"])
