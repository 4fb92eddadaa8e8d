"""Filters, merging, routing and the frontier over whole tables."""

from pyspark.sql import functions as F

from ..operators.filters import mark_unchanged
from ..operators.frontier import frontier
from ..operators.generations import current
from ..operators.merge import (
    backlinks,
    compact_items,
    drop_empty,
    drop_html,
    merge_index,
    read_items,
    rebuild_index,
    upsert_items,
)
from ..operators.route import DEFAULT_RULES, GIST_RULE, GITHUB_RULE, GITLAB_RULE, Output, Rule, register_rule, route
from ..schema import ITEM_ARRAYS, ITEM_STRINGS
from ..session import work_folder
from ..sources.responses import as_responses, fragments, requests
from .registry import check, joined, table

# Events as fragments: what a later event leaves empty stays as an earlier one set it.


def event_fragments(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.lit("events").alias("source"), F.col("event_id").alias("seq"), "user_id", "event_type", "value", "props"
    )
    tags = F.when(F.col("value") > 20, F.array("event_type", F.lit("tag"))).otherwise(
        F.array().cast("array<string>")
    )
    return fragments(
        events,
        url=F.expr("concat('user/', cast(user_id AS string))"),
        name=F.col("event_type"),
        description=F.expr("CASE WHEN value > 50 THEN props ELSE '' END"),
        content=F.expr("CASE WHEN value < 1 THEN concat('small ', cast(seq AS string)) END"),
        pocket_tags=tags,
    )


def text_fragments(spark, sf_dir):
    """Documents as fragments with long texts, ten for each URL."""
    docs = table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("source"), F.col("doc_id").alias("seq"), "text", "lang"
    )
    url = F.concat(F.lit("doc/"), F.floor(F.col("seq") / 10).cast("string"))
    return fragments(docs, url=url, name=F.col("lang"), content=F.col("text"))


@check(
    "merge_texts",
    "SELECT 'doc/' || (doc_id // 10) AS url, max_by(lang, doc_id) FILTER (WHERE lang <> '') AS name, "
    "max_by(text, doc_id) FILTER (WHERE text <> '') AS content FROM documents GROUP BY doc_id // 10",
)
def merge_texts(spark, sf_dir):
    return merge_index(text_fragments(spark, sf_dir)).select("url", "name", "content")


def flat_items(items):
    return items.select(
        "url", "name", "description", "content", joined("pocket_tags").alias("pocket_tags")
    )


def _sql_latest(value, condition):
    return f"max_by({value}, event_id) FILTER (WHERE {condition})"


_SMALL = "'small ' || event_id"
_TAGGED = "event_type || '|tag'"
SQL_MERGED_EVENTS = (
    "SELECT 'user/' || user_id AS url, max_by(event_type, event_id) AS name, "
    f"{_sql_latest('props', 'value > 50')} AS description, "
    f"{_sql_latest(_SMALL, 'value < 1')} AS content, "
    f"{_sql_latest(_TAGGED, 'value > 20')} AS pocket_tags "
    "FROM events GROUP BY user_id"
)


@check("merge_index", SQL_MERGED_EVENTS)
def merge_events(spark, sf_dir):
    return flat_items(merge_index(event_fragments(spark, sf_dir)))


@check("sink_upsert", SQL_MERGED_EVENTS)
def sink_upsert(spark, sf_dir):
    """Stored in writes, one of them repeated, and compacted; a write falls into the compaction."""
    path = work_folder(spark, "sink_upsert")
    events = event_fragments(spark, sf_dir)
    part = [events.filter(F.col("seq") % 3 == n) for n in range(3)]
    upsert_items(part[1], path)
    upsert_items(part[0], path)
    upsert_items(part[1], path)
    before = current(spark, path)
    upsert_items(part[2], path)
    compact_items(spark, path, before)
    return flat_items(read_items(spark, path))


@check("sink_reset", SQL_MERGED_EVENTS)
def sink_reset(spark, sf_dir):
    """A refresh forgets what the table held before."""
    path = work_folder(spark, "sink_reset")
    events = event_fragments(spark, sf_dir)
    upsert_items(events.withColumn("url", F.concat(F.lit("old/"), "url")), path)
    rebuild_index(events, path)
    return flat_items(read_items(spark, path))


@check(
    "sink_convert",
    "SELECT event_id AS seq, 'name' || CASE WHEN value > 50 THEN ',description' ELSE '' END || "
    "CASE WHEN value < 1 THEN ',content' ELSE '' END || CASE WHEN value > 20 THEN ',pocket_tags' ELSE '' END AS kept FROM events",
)
def sink_convert(spark, sf_dir):
    kept = drop_empty(event_fragments(spark, sf_dir))
    names = [F.when(F.col(c).isNotNull(), F.lit(c)) for c in ITEM_STRINGS + ITEM_ARRAYS]
    return kept.select("seq", F.concat_ws(",", *names).alias("kept"))


@check("sink_cleanup", "SELECT page_id AS seq, url, CAST(length(html) AS INTEGER) AS chars FROM pages")
def sink_cleanup(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("chars", F.length("html"))
    return drop_html(pages).withColumnRenamed("page_id", "seq")


@check(
    "f_unchanged",
    "SELECT o_orderkey AS seq, CASE WHEN o_orderpriority = '2-HIGH' THEN 'kept|' ELSE '' END || "
    "CASE WHEN o_orderstatus = 'F' THEN 'cached' ELSE '' END AS flags FROM "
    "(SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders)",
)
def f_unchanged(spark, sf_dir):
    """A second crawl of all orders in which finished orders did not change."""
    orders = table(spark, sf_dir, "orders")

    def crawl(body, flags):
        return as_responses(
            orders, "pocket", "pocket_page",
            seq=F.col("o_orderkey"),
            request_url=F.expr("concat('https://x.example.com/', cast(o_orderkey AS string))"),
            body=F.expr(body), flags=F.expr(flags),
        )

    none = "cast(array() AS array<string>)"
    before = crawl("concat(o_orderstatus, cast(o_totalprice AS string))", none)
    now = crawl(
        "concat(o_orderstatus, cast(o_totalprice AS string), CASE WHEN o_orderstatus = 'F' THEN '' ELSE ' new' END)",
        f"CASE WHEN o_orderpriority = '2-HIGH' THEN array('kept') ELSE {none} END",
    )
    # What was fetched twice before must not double anything.
    marked = mark_unchanged(now, before.unionByName(before))
    flags = F.when(
        F.array_contains("flags", "kept"),
        F.concat(F.lit("kept|"), F.array_join(F.array_remove("flags", "kept"), "|")),
    ).otherwise(joined("flags"))
    return marked.select("seq", flags.alias("flags"))


# Links of four kinds for every order, asked for by one of three sources.
_SOURCE = "CASE o_orderstatus WHEN 'F' THEN 'pocket' WHEN 'O' THEN 'github_stars' ELSE 'gitlab_stars' END"
LINKS = {
    "gist": "concat('https://gist.github.com/u', cast(o_custkey AS string), '/', cast(o_orderkey AS string))",
    "repo": "concat('http://www.github.com/u', cast(o_custkey AS string), '/r.', cast(o_orderkey AS string), '/')",
    "project": "concat('https://gitlab.com/g', cast(o_custkey AS string), '/p-', cast(o_orderkey AS string))",
    "user": "concat('https://gitlab.com/users/', cast(o_orderkey AS string))",
    "deep": "concat('https://github.com/u', cast(o_custkey AS string), '/r/issues')",
    "query": "concat('https://github.com/u', cast(o_custkey AS string), '/r?tab=', cast(o_orderkey AS string))",
    "look_alike": "concat('https://github-com.example.com/u', cast(o_custkey AS string), '/r')",
    "spread": "concat('https://githubXcom/u', cast(o_custkey AS string), '/r')",
}


def link_requests(spark, sf_dir, links=None):
    chosen = {k: LINKS[k] for k in (links or LINKS)}
    rows = F.array(*[F.struct(F.lit(n).alias("pos"), F.expr(e).alias("link")) for n, e in enumerate(chosen.values())])
    asked = table(spark, sf_dir, "orders").select(
        F.expr(_SOURCE).alias("source"), F.col("o_orderkey").alias("seq"), F.inline(rows)
    )
    return requests(
        asked, "page", F.col("link"), pos=F.col("pos"),
        meta={"url": F.col("link"), "dont_obey_robotstxt": F.lit("false"), "asked": F.lit("yes")},
    )


def flat_requests(routed):
    meta = F.array_join(
        F.array_sort(F.transform(F.map_entries("meta"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "; "
    )
    return routed.select("source", F.col("parent_seq").alias("seq"), "pos", "kind", "url", meta.alias("meta"))


_ORIGINAL = "'asked=yes; dont_obey_robotstxt=false; url=' || {link}"
# Link kind → (rule owner, new kind, new URL, new metadata).
ROUTED = {
    "gist": ("github_stars", "gist", "'https://api.github.com/gists/' || o_orderkey",
             "'asked=yes; dont_obey_robotstxt=true; item_url=https://gist.github.com/u' || o_custkey || '/' || o_orderkey || '; url=' || {link}"),
    "repo": ("github_stars", "github_repo", "'https://api.github.com/repos/u' || o_custkey || '/r.' || o_orderkey",
             "'asked=yes; dont_obey_robotstxt=true; item_url=https://github.com/u' || o_custkey || '/r.' || o_orderkey || '; url=' || {link}"),
    # A query string is part of the last group.
    "query": ("github_stars", "github_repo", "'https://api.github.com/repos/u' || o_custkey || '/r?tab=' || o_orderkey",
              "'asked=yes; dont_obey_robotstxt=true; item_url=https://github.com/u' || o_custkey || '/r?tab=' || o_orderkey || '; url=' || {link}"),
    "project": ("gitlab_stars", "gitlab_project", "'https://gitlab.com/api/v4/projects/g' || o_custkey || '%2Fp-' || o_orderkey",
                "'asked=yes; dont_obey_robotstxt=true; url=' || {link}"),
}


def _sql_routed(kinds):
    selects = []
    for pos, kind in enumerate(kinds):
        link = LINKS[kind]
        head = f"SELECT {_SOURCE} AS source, o_orderkey AS seq, CAST({pos} AS BIGINT) AS pos, "
        original = f"'page' AS kind, {link} AS url, {_ORIGINAL.format(link=link)} AS meta FROM orders"
        if kind in ROUTED:
            owner, new_kind, url, meta = ROUTED[kind]
            selects.append(f"{head}'{new_kind}' AS kind, {url} AS url, {meta.format(link=link)} AS meta FROM orders WHERE {_SOURCE} <> '{owner}'")
            selects.append(f"{head}{original} WHERE {_SOURCE} = '{owner}'")
        else:
            selects.append(head + original)
    return " UNION ALL ".join(selects)


@check("rule_gist", _sql_routed(["gist"]))
def rule_gist(spark, sf_dir):
    return flat_requests(route(link_requests(spark, sf_dir, ["gist"]), [GIST_RULE]))


@check("rule_github", _sql_routed(["repo", "deep", "query", "look_alike", "spread"]))
def rule_github(spark, sf_dir):
    links = ["repo", "deep", "query", "look_alike", "spread"]
    return flat_requests(route(link_requests(spark, sf_dir, links), [GITHUB_RULE]))


@check("rule_gitlab", _sql_routed(["project", "user"]))
def rule_gitlab(spark, sf_dir):
    return flat_requests(route(link_requests(spark, sf_dir, ["project", "user"]), [GITLAB_RULE]))


@check("route_register", _sql_routed(list(LINKS)))
def route_register(spark, sf_dir):
    rules = []
    for rule in DEFAULT_RULES:
        rules = register_rule(rules, rule)
    return flat_requests(route(link_requests(spark, sf_dir), rules))


# Rules over the hosts of the given pages: secure pages first, then two outputs for
# .net hosts, then one rule nobody but its owner would skip.
PAGE_RULES = [
    Rule("other", r"^https://([^/]+)\.example\.com/(.*)$", (Output("secure", "https://api.example.com/{1}/{2}", meta={"n": "1"}),)),
    Rule("other", r"^https?://([^/]+)\.example\.net/(.*)$",
         (Output("net", "http://net.example.com/{1}"), Output("net_copy", "http://net.example.com/{1}/copy"))),
    Rule("pages", r"^https?://.*$", (Output("own", "http://never.example.com/"),)),
    Rule("other", r"^http://([^/]+)\.example\.com/", (Output("second", "http://second.example.com/{1}"),)),
]
_SECURE = "regexp_matches(url, '^https://[^/]+\\.example\\.com/')"
_NET = "regexp_matches(url, '^https?://[^/]+\\.example\\.net/')"
_PLAIN = "regexp_matches(url, '^http://[^/]+\\.example\\.com/')"
_HOST = "regexp_extract(url, '^https?://([^/]+)\\.example\\.(?:com|net)/', 1)"
_REST = "regexp_extract(url, '^https?://[^/]+/(.*)$', 1)"


@check(
    "route",
    "SELECT page_id AS seq, 'secure' AS kind, 'https://api.example.com/' || " + _HOST + " || '/' || " + _REST + " AS url, 'n=1; old=' || url AS meta "
    f"FROM pages WHERE {_SECURE} "
    f"UNION ALL SELECT page_id, 'net', 'http://net.example.com/' || {_HOST}, 'n=0; old=' || url FROM pages WHERE {_NET} "
    f"UNION ALL SELECT page_id, 'net_copy', 'http://net.example.com/' || {_HOST} || '/copy', 'n=0; old=' || url FROM pages WHERE {_NET} "
    f"UNION ALL SELECT page_id, 'second', 'http://second.example.com/' || {_HOST}, 'n=0; old=' || url FROM pages WHERE {_PLAIN} "
    f"UNION ALL SELECT page_id, 'page', url, 'n=0; old=' || url FROM pages WHERE NOT {_SECURE} AND NOT {_NET} AND NOT {_PLAIN}",
)
def route_pages(spark, sf_dir):
    return flat_requests(route(page_requests(spark, sf_dir), PAGE_RULES)).drop("source", "pos")


def page_requests(spark, sf_dir):
    asked = table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("source"), F.col("page_id").alias("seq"), "url"
    )
    return requests(asked, "page", F.col("url"), meta={"old": F.col("url"), "n": F.lit("0")})


# Requests from events: one URL per user and type, so most are repeats, some hot.
EVENT_URL = "concat('https://x.example.com/', event_type, '/', cast(user_id % 50 AS string))"
EVENT_SOURCE = "CASE WHEN value > 10 THEN 'pocket' ELSE 'twitter_favs' END"


def event_requests(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select(
        F.expr(EVENT_SOURCE).alias("source"), F.col("event_id").alias("seq"), "ts", F.expr(EVENT_URL).alias("url")
    )
    return requests(asked, "page", F.col("url"), pos=F.expr("seq % 3"), meta={"seq": F.col("seq").cast("string")})


@check(
    "frontier",
    f"SELECT source, url, CAST(min(event_id) AS BIGINT) AS seq FROM (SELECT {EVENT_SOURCE} AS source, {EVENT_URL} AS url, event_id FROM events) e "
    f"WHERE NOT EXISTS (SELECT 1 FROM (SELECT {EVENT_SOURCE} AS source, {EVENT_URL} AS url FROM events WHERE user_id % 7 = 0) f "
    "WHERE f.source = e.source AND f.url = e.url) GROUP BY source, url",
)
def frontier_of_events(spark, sf_dir):
    asked = event_requests(spark, sf_dir)
    fetched = table(spark, sf_dir, "events").filter("user_id % 7 = 0")
    answered = as_responses(
        fetched, "any", "page", seq=F.col("event_id"), request_url=F.expr(EVENT_URL), body=F.expr(EVENT_SOURCE)
    ).withColumn("source", F.col("body"))
    return frontier(asked, answered).select("source", "url", F.col("parent_seq").alias("seq"))


@check(
    "backlinks",
    "WITH items AS (SELECT 'repo/' || p_partkey AS url, p_name AS name, NULL AS origin FROM part "
    "UNION ALL SELECT 'home/' || p_partkey, p_type, CASE WHEN p_size > 40 THEN 'repo/0' ELSE 'repo/' || p_partkey END FROM part "
    "UNION ALL SELECT 'linked/' || p_partkey, p_brand, 'tweet/' || p_partkey FROM part WHERE p_size < 10) "
    "SELECT i.url, i.name, i.origin AS origin_url, o.name AS origin_name FROM items i LEFT JOIN items o ON o.url = i.origin WHERE i.origin IS NOT NULL",
)
def backlinks_of_parts(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        F.lit("part").alias("source"), F.col("p_partkey").alias("seq"), "p_name", "p_type", "p_brand", "p_size"
    )
    key = F.col("seq").cast("string")
    under = lambda folder: F.concat(F.lit(f"{folder}/"), key)
    repos = fragments(part, url=under("repo"), name=F.col("p_name"))
    homes = fragments(
        part, url=under("home"), name=F.col("p_type"),
        repository_backlink=F.when(F.col("p_size") > 40, F.lit("repo/0")).otherwise(under("repo")),
    )
    linked = fragments(
        part.filter("p_size < 10"), url=under("linked"), name=F.col("p_brand"), twitter_backlink=under("tweet")
    )
    return backlinks(merge_index(repos.unionByName(homes).unionByName(linked)))
