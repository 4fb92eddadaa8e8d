"""Starred repositories and snippets."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import fix_url
from ..functions.values import first_non_empty, link_next, non_empty
from ..operators.filters import is_processable, processable
from .responses import Parsed, after_all, fragments, nested_pos, requests, union

STAR = "array<struct<url:string,html_url:string,name:string,description:string>>"
REPO = (
    "struct<url:string,name:string,description:string,updated_at:string,"
    "topics:array<string>,homepage:string,html_url:string>"
)

# Fixed values of the service's API.
API_HEADERS = {"Accept": "application/vnd.github+json", "X-GitHub-Api-Version": "2022-11-28"}
README_HEADERS = {"Accept": "application/vnd.github.v3.html"}


def _headers(values):
    return {k: F.lit(v) for k, v in values.items()}


def _meta(**values):
    return {"dont_obey_robotstxt": F.lit("true"), **values}


def _parse_star_list(responses: DataFrame, kind, detail_kind, name, description) -> Parsed:
    pages = processable(responses.filter(F.col("kind") == kind), process_cached=True).select(
        "source", "seq", "headers", F.from_json("body", STAR).alias("stars")
    )
    pages = pages.filter(F.col("stars").isNotNull())
    stars = pages.select("source", "seq", F.posexplode("stars").alias("i", "star"))
    details = requests(
        stars,
        detail_kind,
        F.col("star.url"),
        pos=nested_pos(F.col("i"), F.lit(0)),
        headers=_headers(API_HEADERS),
        meta=_meta(item_url=F.col("star.html_url"), item_name=name, item_description=description),
    )
    next_pages = requests(
        pages,
        kind,
        link_next("headers"),
        pos=after_all(F.col("stars")),
        headers=_headers(API_HEADERS),
        meta=_meta(),
    )
    return Parsed(None, union(details, next_pages))


def parse_github_stars(responses: DataFrame) -> Parsed:
    """Page of starred repositories → one detail request per repository, next page."""
    return _parse_star_list(
        responses, "github_stars", "github_repo", F.col("star.name"), F.col("star.description")
    )


def parse_gist_stars(responses: DataFrame) -> Parsed:
    """Page of starred snippets → one detail request per snippet, next page."""
    return _parse_star_list(
        responses, "gist_stars", "gist", F.col("star.description"), F.lit("")
    )


def _details(responses: DataFrame, kind) -> DataFrame:
    """Detail responses with payload ``d`` (NULL if unusable) and the merged item fields."""
    seed = lambda key: F.try_element_at(F.col("meta"), F.lit(key))
    return (
        responses.filter(F.col("kind") == kind)
        .withColumn("ok", F.coalesce(is_processable(), F.lit(False)))
        .withColumn("d", F.when(F.col("ok"), F.from_json("body", REPO)))
        .select(
            "source",
            "seq",
            "ok",
            "d",
            seed("item_url").alias("item_url"),
            first_non_empty(seed("item_name"), F.col("d.name")).alias("item_name"),
            first_non_empty(seed("item_description"), F.col("d.description")).alias("item_description"),
        )
    )


def _detail_fragments(details: DataFrame) -> DataFrame:
    return fragments(
        details,
        url=F.col("item_url"),
        name=F.col("item_name"),
        description=F.col("item_description"),
        last_update=F.col("d.updated_at"),
        repository_tags=F.col("d.topics"),
    )


def parse_github_repo(responses: DataFrame) -> Parsed:
    """Repository details → item, readme request, home page request.

    An unusable response still yields the item known from the star list.
    """
    details = _details(responses, "github_repo")
    usable = details.filter("ok")
    readme = requests(
        usable,
        "github_readme",
        F.concat(F.col("d.url"), F.lit("/readme")),
        pos=1,
        headers=_headers(README_HEADERS),
        meta={"url": F.col("item_url")},
    )
    homepage = requests(
        usable, "homepage", fix_url(F.col("d.homepage")), pos=2, meta={"github_url": F.col("item_url")}
    )
    return Parsed(_detail_fragments(details), union(readme, homepage))


def parse_gist(responses: DataFrame) -> Parsed:
    """Snippet details → item, request for its page."""
    details = _details(responses, "gist")
    page = requests(
        details.filter("ok"),
        "gist_html",
        non_empty(F.col("d.html_url")),
        pos=1,
        meta={"url": F.col("item_url")},
    )
    return Parsed(_detail_fragments(details), page)
