"""Starred projects."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markdown import md_links, md_text
from ..functions.text import html_snippet_text
from ..functions.urls import fix_url
from ..functions.values import link_next, non_empty
from ..operators.filters import processable
from .responses import Parsed, fragments, nested_pos, requests, union

PROJECT = (
    "struct<web_url:string,name:string,description:string,last_activity_at:string,"
    "tag_list:array<string>,readme_url:string>"
)


def _api_meta(**values):
    return {"dont_obey_robotstxt": F.lit("true"), **values}


def parse_gitlab_users(responses: DataFrame) -> Parsed:
    """User lookup → request for the projects each user starred."""
    users = (
        processable(responses.filter(F.col("kind") == "gitlab_users"), process_cached=True)
        .select("source", "seq", F.posexplode(F.from_json("body", "array<struct<id:bigint>>")).alias("i", "user"))
    )
    url = F.concat(
        F.lit("https://gitlab.com/api/v4/users/"),
        F.col("user.id").cast("string"),
        F.lit("/starred_projects?per_page=1"),
    )
    return Parsed(None, requests(users, "gitlab_stars", url, pos=F.col("i"), meta=_api_meta()))


def _parse_projects(projects: DataFrame) -> Parsed:
    """(source, seq, i, base, known_url, p) → item, readme request, home page requests."""
    projects = projects.withColumn(
        "item_url", F.coalesce(non_empty("known_url"), F.col("p.web_url"))
    )
    items = fragments(
        projects,
        pos=nested_pos(F.col("i"), F.lit(0)),
        url=F.col("item_url"),
        name=F.col("p.name"),
        description=F.when(F.col("p.description") != "", md_text(F.col("p.description"))).otherwise(F.lit("")),
        last_update=F.col("p.last_activity_at"),
        repository_tags=F.col("p.tag_list"),
    )
    readmes = requests(
        projects,
        "gitlab_readme",
        F.concat(F.col("p.readme_url"), F.lit("?format=json")),
        pos=nested_pos(F.col("i"), F.lit(0)),
        meta={"url": F.col("item_url")},
    )
    links = projects.select(
        "source",
        "seq",
        "i",
        "item_url",
        F.posexplode(md_links(F.col("p.description"), F.col("base"))).alias("j", "link"),
    )
    homepages = requests(
        links,
        "homepage",
        fix_url("link"),
        pos=nested_pos(F.col("i"), F.col("j") + 1),
        meta={"gitlab_url": F.col("item_url")},
    )
    return Parsed(items, union(readmes, homepages))


def parse_gitlab_stars(responses: DataFrame) -> Parsed:
    """Page of starred projects → next page, then each project."""
    pages = processable(responses.filter(F.col("kind") == "gitlab_stars"), process_cached=True)
    projects = pages.select(
        "source",
        "seq",
        F.col("final_url").alias("base"),
        F.try_element_at(F.col("meta"), F.lit("url")).alias("known_url"),
        F.posexplode(F.from_json("body", f"array<{PROJECT}>")).alias("i", "p"),
    )
    next_pages = requests(pages, "gitlab_stars", link_next("headers"), pos=-1, meta=_api_meta())
    parsed = _parse_projects(projects)
    return Parsed(parsed.fragments, union(next_pages, parsed.requests))


def parse_gitlab_project(responses: DataFrame) -> Parsed:
    """Details of one project, asked for by a routed link."""
    projects = processable(responses.filter(F.col("kind") == "gitlab_project")).select(
        "source",
        "seq",
        F.lit(0).alias("i"),
        F.col("final_url").alias("base"),
        F.try_element_at(F.col("meta"), F.lit("url")).alias("known_url"),
        F.from_json("body", PROJECT).alias("p"),
    )
    return _parse_projects(projects.filter(F.col("p").isNotNull()))


def parse_gitlab_readme(responses: DataFrame) -> Parsed:
    """Readme payload → text and html of a project."""
    readmes = processable(responses.filter(F.col("kind") == "gitlab_readme")).withColumn(
        "html", F.get_json_object("body", "$.html")
    )
    return Parsed(
        fragments(
            readmes,
            url=F.try_element_at(F.col("meta"), F.lit("url")),
            content=html_snippet_text("html"),
            html=F.col("html"),
        ),
        None,
    )
