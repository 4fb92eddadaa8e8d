"""Service parsers over payloads that Spark builds from the given tables.

Expressions written once are valid in Spark SQL and in the checking SQL.
"""

from pyspark.sql import functions as F

from ..functions.dates import epoch_date
from ..functions.urls import gitlab_project_url
from ..operators.filters import processable, status_gate
from ..sources import github, gitlab, pages, pocket, responses as R, tweets
from .registry import check, outputs, sql_item, sql_request, sql_union, table

STEP = 4294967296

# Statuses and cache flags come from the data: one kind of part is missing, another
# one unchanged, big parts come from the cache.
STATUS = "CASE p_type WHEN 'PROMO' THEN 404 WHEN 'SMALL' THEN 304 WHEN 'MEDIUM' THEN 503 ELSE 200 END"
STATUS_OK = f"({STATUS} < 400 AND {STATUS} <> 304)"
GATE_OK = f"({STATUS} BETWEEN 200 AND 299 OR {STATUS} BETWEEN 400 AND 599)"
CACHED = "p_size > 30"
BRAND = "replace(p_brand, '#', '-')"
KEY = "cast(p_partkey AS string)"
HTML = (
    "concat('<html><head><title> ', p_name, ' &amp; ', p_type, '</title></head><body><h1>', p_name, "
    "'</h1>', '<p>', p_brand, ' <b>', p_type, '</b></p></body></html>')"
)
HTML_TITLE = "p_name || ' & ' || p_type"
HTML_TEXT = "concat(p_name, chr(10), p_brand, chr(10), p_type)"
TEXT_TYPE = "CASE WHEN p_size < 5 THEN 'text/plain' WHEN p_size < 8 THEN 'image/png' ELSE 'text/html; charset=utf-8' END"
PAGE_TEXT = f"CASE WHEN p_size < 5 THEN {HTML} WHEN p_size < 8 THEN NULL ELSE {HTML_TEXT} END"
PAGE_NAME = f"CASE WHEN p_size >= 8 THEN {HTML_TITLE} END"

# Headers and addresses of the services.
GITHUB_HEADERS = {"Accept": "'application/vnd.github+json'", "X-GitHub-Api-Version": "'2022-11-28'"}


def part_responses(spark, sf_dir, source, kind, body, meta=None, headers=None, url=None):
    part = table(spark, sf_dir, "part")
    columns = {
        "seq": F.col("p_partkey"),
        "request_url": F.expr(url or f"concat('https://api.example.com/{kind}/', {KEY})"),
        "status": F.expr(STATUS),
        "flags": F.expr(f"CASE WHEN {CACHED} THEN array('cached') ELSE cast(array() AS array<string>) END"),
        "body": F.expr(body),
    }
    if meta:
        pairs = ", ".join(f"'{k}', {v}" for k, v in meta.items())
        columns["meta"] = F.expr(f"map({pairs})")
    if headers:
        pairs = ", ".join(f"'{k}', {v}" for k, v in headers.items())
        columns["headers"] = F.expr(f"map({pairs})")
    return status_gate(R.as_responses(part, source, kind, **columns))


LINK = (
    "CASE WHEN p_size > 10 THEN concat('<https://api.example.com/list?page=', cast(p_size + 1 AS string), "
    "'>; rel=\"next\", <https://api.example.com/list?page=50>; rel=\"last\"') "
    "ELSE '<https://api.example.com/list?page=1>; rel=\"first\"' END"
)
NEXT = "concat('https://api.example.com/list?page=', cast(p_size + 1 AS string))"


@check(
    "src_responses",
    "SELECT page_id AS seq, url AS request_url, 200 AS status, 'text/html; charset=utf-8' AS content_type, "
    "CAST(length(html) AS INTEGER) AS body_chars FROM pages",
)
def src_responses(spark, sf_dir):
    responses = R.pages_as_responses(table(spark, sf_dir, "pages"))
    return responses.select(
        "seq",
        "request_url",
        "status",
        F.col("headers")["Content-Type"].alias("content_type"),
        F.length("body").alias("body_chars"),
    )


# Fixed value: the address.
STAR_API = f"concat('https://api.github.com/repos/', {BRAND}, '/', {KEY})"
STAR_HTML = f"concat('https://github.com/', {BRAND}, '/', {KEY})"
STARS_BODY = (
    f"to_json(array(named_struct('url', {STAR_API}, 'html_url', {STAR_HTML}, 'name', p_name, 'description', p_type), "
    f"named_struct('url', concat({STAR_API}, '-b'), 'html_url', concat({STAR_HTML}, '-b'), 'name', p_brand, "
    "'description', CASE WHEN p_size > 20 THEN p_name END)))"
)


def _star_meta(suffix, name, description):
    return {
        "item_url": f"concat({STAR_HTML}, '{suffix}')",
        "item_name": name,
        "item_description": description,
        "dont_obey_robotstxt": "'true'",
    }


@check(
    "github_stars",
    sql_union(
        sql_request("p_partkey", 0, "github_repo", STAR_API, f"FROM part WHERE {STATUS_OK}",
                    GITHUB_HEADERS, _star_meta("", "p_name", "p_type")),
        sql_request("p_partkey", STEP, "github_repo", f"concat({STAR_API}, '-b')", f"FROM part WHERE {STATUS_OK}",
                    GITHUB_HEADERS, _star_meta("-b", "p_brand", "CASE WHEN p_size > 20 THEN p_name END")),
        sql_request("p_partkey", 2 * STEP, "github_stars", NEXT, f"FROM part WHERE {STATUS_OK} AND p_size > 10",
                    GITHUB_HEADERS, {"dont_obey_robotstxt": "'true'"}),
    ),
)
def github_stars(spark, sf_dir):
    return outputs(github.parse_github_stars(
        part_responses(spark, sf_dir, "github_stars", "github_stars", STARS_BODY, headers={"link": LINK})
    ))


# Fixed value: the address.
GIST_API = f"concat('https://api.github.com/gists/', {KEY})"
GIST_HTML = f"concat('https://gist.github.com/', {BRAND}, '/', {KEY})"


@check(
    "gist_stars",
    sql_union(
        sql_request("p_partkey", 0, "gist", GIST_API, f"FROM part WHERE {STATUS_OK}", GITHUB_HEADERS,
                    {"item_url": GIST_HTML, "item_name": "p_name", "item_description": "''", "dont_obey_robotstxt": "'true'"}),
        sql_request("p_partkey", STEP, "gist_stars", NEXT, f"FROM part WHERE {STATUS_OK} AND p_size > 10",
                    GITHUB_HEADERS, {"dont_obey_robotstxt": "'true'"}),
    ),
)
def gist_stars(spark, sf_dir):
    body = f"to_json(array(named_struct('url', {GIST_API}, 'html_url', {GIST_HTML}, 'description', p_name)))"
    return outputs(github.parse_gist_stars(
        part_responses(spark, sf_dir, "github_stars", "gist_stars", body, headers={"LINK": LINK})
    ))


DETAIL_OK = f"({STATUS_OK} AND NOT {CACHED})"
SEED_NAME = "CASE WHEN p_size > 25 THEN p_name ELSE '' END"
SEED_DESCRIPTION = "CASE WHEN p_size > 15 THEN p_type END"
HOMEPAGE = (
    "CASE WHEN p_size < 5 THEN 'www.example.com/home' WHEN p_size < 10 THEN '' WHEN p_size < 15 THEN 'no home page' "
    f"ELSE concat('https://home.example.com/', {KEY}) END"
)
FIXED_HOMEPAGE = (
    f"CASE WHEN p_size < 5 THEN 'http://www.example.com/home' ELSE concat('https://home.example.com/', {KEY}) END"
)
UPDATED = "concat('2021-05-', lpad(cast(p_size % 28 + 1 AS string), 2, '0'), 'T12:55:25Z')"
TOPICS = "array(lower(p_type), p_brand)"
SQL_TOPICS = "lower(p_type) || '|' || p_brand"
REPO_META = {"item_url": STAR_HTML, "item_name": SEED_NAME, "item_description": SEED_DESCRIPTION}


def _detail_items(source, item_url):
    """Items of detail responses: merged from the payload if usable, else the seed."""
    name = f"CASE WHEN p_size > 25 THEN p_name WHEN {DETAIL_OK} THEN p_brand END"
    description = f"CASE WHEN p_size > 15 THEN p_type WHEN {DETAIL_OK} THEN concat('about ', p_name) END"
    return sql_item(
        "p_partkey", 0, source, item_url,
        {
            "name": name,
            "description": description,
            "last_update": f"CASE WHEN {DETAIL_OK} THEN {UPDATED} END",
            "repository_tags": f"CASE WHEN {DETAIL_OK} THEN {SQL_TOPICS} END",
        },
        f"FROM part WHERE {GATE_OK}",
    )


@check(
    "github_repo",
    sql_union(
        _detail_items("github_stars", STAR_HTML),
        sql_request("p_partkey", 1, "github_readme", f"{STAR_API} || '/readme'", f"FROM part WHERE {DETAIL_OK}",
                    {"Accept": "'application/vnd.github.v3.html'"}, {"url": STAR_HTML}),
        sql_request("p_partkey", 2, "homepage", FIXED_HOMEPAGE,
                    f"FROM part WHERE {DETAIL_OK} AND (p_size < 5 OR p_size >= 15)", None, {"github_url": STAR_HTML}),
    ),
)
def github_repo(spark, sf_dir):
    body = (
        f"to_json(named_struct('url', {STAR_API}, 'name', p_brand, 'description', concat('about ', p_name), "
        f"'updated_at', {UPDATED}, 'topics', {TOPICS}, 'homepage', {HOMEPAGE}))"
    )
    return outputs(github.parse_github_repo(
        part_responses(spark, sf_dir, "github_stars", "github_repo", body, meta=REPO_META)
    ))


@check(
    "gist_detail",
    sql_union(
        _detail_items("github_stars", GIST_HTML),
        sql_request("p_partkey", 1, "gist_html", GIST_HTML, f"FROM part WHERE {DETAIL_OK} AND p_size > 10",
                    None, {"url": GIST_HTML}),
    ),
)
def gist_detail(spark, sf_dir):
    body = (
        f"to_json(named_struct('name', p_brand, 'description', concat('about ', p_name), 'updated_at', {UPDATED}, "
        f"'topics', {TOPICS}, 'html_url', CASE WHEN p_size > 10 THEN {GIST_HTML} ELSE '' END))"
    )
    return outputs(github.parse_gist(
        part_responses(spark, sf_dir, "github_stars", "gist", body, meta={**REPO_META, "item_url": GIST_HTML})
    ))


def _content_sql(source, url):
    gate = GATE_OK if source in ("github_stars", "gitlab_stars") else "TRUE"
    return sql_item("p_partkey", 0, source, url, {"content": PAGE_TEXT}, f"FROM part WHERE {DETAIL_OK} AND {gate}")


def _page_responses(spark, sf_dir, source, kind, meta, url=None):
    return part_responses(spark, sf_dir, source, kind, HTML, meta=meta, headers={"Content-Type": TEXT_TYPE}, url=url)


@check(
    "github_readme",
    sql_item("p_partkey", 0, "github_stars", STAR_HTML, {"content": HTML_TEXT}, f"FROM part WHERE {DETAIL_OK}"),
)
def github_readme(spark, sf_dir):
    responses = part_responses(
        spark, sf_dir, "github_stars", "github_readme", HTML, meta={"url": STAR_HTML},
        headers={"content-type": "'application/vnd.github.v3.html; charset=utf-8'"},
    )
    return outputs(pages.parse_content(responses, "github_readme"))


@check("gist_html", _content_sql("github_stars", GIST_HTML))
def gist_html(spark, sf_dir):
    responses = _page_responses(spark, sf_dir, "github_stars", "gist_html", {"url": GIST_HTML})
    return outputs(pages.parse_content(responses, "gist_html"))


ARTICLE = f"concat('http://articles.example.com/', {KEY}, '?p=1#top')"


@check("pocket_webpage", _content_sql("pocket", ARTICLE))
def pocket_webpage(spark, sf_dir):
    responses = _page_responses(spark, sf_dir, "pocket", "pocket_page", {"url": ARTICLE}, url="'https://redirected.example.com/'")
    return outputs(pages.parse_content(responses, "pocket_page"))


FINAL = f"concat('https://final.example.com/', {KEY})"


@check(
    "homepage",
    sql_item("p_partkey", 0, "github_stars", FINAL,
             {"name": PAGE_NAME, "content": PAGE_TEXT,
              "repository_backlink": f"CASE WHEN p_size > 20 THEN {STAR_HTML} ELSE concat('https://gitlab.com/x/', {KEY}) END"},
             f"FROM part WHERE {DETAIL_OK}"),
)
def homepage(spark, sf_dir):
    meta = {
        "github_url": f"CASE WHEN p_size > 20 THEN {STAR_HTML} END",
        "gitlab_url": f"CASE WHEN p_size <= 20 THEN concat('https://gitlab.com/x/', {KEY}) END",
    }
    return outputs(pages.parse_homepage(_page_responses(spark, sf_dir, "github_stars", "homepage", meta, url=FINAL)))


TWEET = f"concat('https://twitter.com/', {BRAND}, '/status/', {KEY})"


@check(
    "tweet_webpage",
    sql_item("p_partkey", 0, "twitter_favs", ARTICLE,
             {"name": PAGE_NAME, "content": PAGE_TEXT, "twitter_backlink": TWEET}, f"FROM part WHERE {DETAIL_OK}"),
)
def tweet_webpage(spark, sf_dir):
    return outputs(pages.parse_tweet_page(
        _page_responses(spark, sf_dir, "twitter_favs", "tweet_page", {"url": ARTICLE, "twitter_url": TWEET}, url=FINAL)
    ))


API_META = {"dont_obey_robotstxt": "'true'"}
STARRED = "concat('https://gitlab.com/api/v4/users/', cast(c_custkey AS string), '/starred_projects?per_page=1')"


@check(
    "gitlab_users",
    sql_union(
        sql_request("c_custkey", 0, "gitlab_stars", STARRED, "FROM customer", None, API_META),
        sql_request("c_custkey", 1, "gitlab_stars",
                    "concat('https://gitlab.com/api/v4/users/', cast(c_nationkey AS string), '/starred_projects?per_page=1')",
                    "FROM customer WHERE c_acctbal > 5000", None, API_META),
    ),
)
def gitlab_users(spark, sf_dir):
    body = (
        "CASE WHEN c_acctbal > 5000 THEN to_json(array(named_struct('id', c_custkey), "
        "named_struct('id', cast(c_nationkey AS bigint)))) ELSE to_json(array(named_struct('id', c_custkey))) END"
    )
    responses = R.as_responses(
        table(spark, sf_dir, "customer"), "gitlab_stars", "gitlab_users",
        seq=F.col("c_custkey"), body=F.expr(body),
        request_url=F.expr("concat('https://gitlab.com/api/v4/users?username=', c_name)"),
    )
    return outputs(gitlab.parse_gitlab_users(responses))


PROJECT_URL = f"concat('https://gitlab.com/', {BRAND}, '/', {KEY})"
README_URL = f"concat({PROJECT_URL}, '/-/blob/master/README.md')"
# A description in Markdown: plain words, bold words, an absolute and a relative link, another scheme.
MARKDOWN = (
    "CASE WHEN p_size > 35 THEN '' ELSE concat('# ', p_name, '\\n\\nA **', p_type, '** of [', p_brand, "
    f"'](https://parts.example.com/', {KEY}, '). See [more](/more/', {KEY}, ') or [mail](mailto:a@b.com)\\n') END"
)
MARKDOWN_TEXT = (
    "CASE WHEN p_size > 35 THEN '' ELSE concat(p_name, '  A ', p_type, ' of ', p_brand, ' . See more or mail') END"
)
PROJECT_STRUCT = (
    f"named_struct('web_url', {PROJECT_URL}, 'name', p_name, 'description', {MARKDOWN}, "
    f"'last_activity_at', {UPDATED}, 'tag_list', {TOPICS}, 'readme_url', CASE WHEN p_size > 12 THEN {README_URL} END)"
)


def _project_sql(base, url, ok):
    values = {"name": "p_name", "description": MARKDOWN_TEXT, "last_update": UPDATED, "repository_tags": SQL_TOPICS}
    return [
        sql_item("p_partkey", 0, "gitlab_stars", url, values, f"FROM part WHERE {ok}"),
        sql_request("p_partkey", 0, "gitlab_readme", f"{README_URL} || '?format=json'",
                    f"FROM part WHERE {ok} AND p_size > 12", None, {"url": url}),
        sql_request("p_partkey", 1, "homepage", f"concat('https://parts.example.com/', {KEY})",
                    f"FROM part WHERE {ok} AND p_size <= 35", None, {"gitlab_url": url}),
        sql_request("p_partkey", 2, "homepage", f"concat('{base}/more/', {KEY})",
                    f"FROM part WHERE {ok} AND p_size <= 35", None, {"gitlab_url": url}),
    ]


@check(
    "gitlab_stars",
    sql_union(
        sql_request("p_partkey", -1, "gitlab_stars", NEXT, f"FROM part WHERE {STATUS_OK} AND p_size > 10", None, API_META),
        *_project_sql("https://gitlab.example.com", PROJECT_URL, STATUS_OK),
    ),
)
def gitlab_stars(spark, sf_dir):
    return outputs(gitlab.parse_gitlab_stars(part_responses(
        spark, sf_dir, "gitlab_stars", "gitlab_stars", f"to_json(array({PROJECT_STRUCT}))",
        headers={"Link": LINK}, url="'https://gitlab.example.com/api/v4/users/1/starred_projects?per_page=1'",
    )))


ASKED_URL = f"concat('http://www.gitlab.com/', {BRAND}, '/', {KEY}, '/')"


@check("gitlab_project", sql_union(*_project_sql("https://gitlab.example.com", ASKED_URL, DETAIL_OK)))
def gitlab_project(spark, sf_dir):
    return outputs(gitlab.parse_gitlab_project(part_responses(
        spark, sf_dir, "gitlab_stars", "gitlab_project", f"to_json({PROJECT_STRUCT})",
        meta={"url": ASKED_URL}, url="'https://gitlab.example.com/api/v4/projects/x'",
    )))


@check(
    "gitlab_project_url",
    "SELECT p_partkey, 'https://gitlab.com/api/v4/projects/' || url_encode(p_brand || '~' || p_type || '/' || p_name || '*é') AS api_url FROM part",
)
def gitlab_project_urls(spark, sf_dir):
    owner = F.expr("concat(p_brand, '~', p_type)")
    repo = F.expr("concat(p_name, '*é')")
    return table(spark, sf_dir, "part").select("p_partkey", gitlab_project_url(owner, repo).alias("api_url"))


@check(
    "gitlab_readme",
    sql_item("p_partkey", 0, "gitlab_stars", PROJECT_URL, {"content": "concat(p_name, ' ', p_brand, ' ', p_type)"},
             f"FROM part WHERE {DETAIL_OK}"),
)
def gitlab_readme(spark, sf_dir):
    snippet = "concat('<h1>', p_name, '</h1><p>', p_brand, ' <b>', p_type, '</b></p>')"
    return outputs(gitlab.parse_gitlab_readme(part_responses(
        spark, sf_dir, "gitlab_stars", "gitlab_readme", f"to_json(named_struct('html', {snippet}))",
        meta={"url": PROJECT_URL},
    )))


# Saved articles from orders: two entries per page, the second key sorting first.
OKEY = "cast(o_orderkey AS string)"
RESOLVED = f"concat('https://read.example.com/', {OKEY})"
GIVEN = f"CASE WHEN o_orderstatus = 'O' THEN {RESOLVED} ELSE concat('http://short.example.com/', {OKEY}) END"
RESOLVED_OR_NOT = f"CASE WHEN o_totalprice > 100000 THEN {RESOLVED} ELSE '' END"
ARTICLE_URL = f"CASE WHEN o_totalprice > 100000 THEN {RESOLVED} ELSE {GIVEN} END"
POCKET_STATUS = "CASE o_orderpriority WHEN '1-URGENT' THEN 0 ELSE 1 END"
ADDED = "cast(1600000000 + o_orderkey * 3607 AS string)"
ADDED_ISO = "strftime(make_timestamp((1600000000 + o_orderkey * 3607) * 1000000), '%Y-%m-%dT%H:%M:%S')"
ENTRY_A = (
    f"named_struct('resolved_title', '', 'given_title', concat('Title ', {OKEY}), 'excerpt', o_orderpriority, "
    f"'time_added', {ADDED}, 'resolved_url', {RESOLVED_OR_NOT}, 'given_url', {GIVEN}, 'tags', "
    "map(lower(replace(o_orderpriority, ' ', '_')), named_struct('tag', 'x'), 'read-later_list', named_struct('tag', 'y')))"
)
ENTRY_B = (
    "named_struct('resolved_title', o_orderstatus, 'given_title', 'never used', 'excerpt', '', "
    f"'time_added', {ADDED}, 'given_url', concat('https://second.example.com/', {OKEY}))"
)

def pocket_responses(spark, sf_dir):
    # The list maps entry ids to entries of different shapes, so it is put together as text.
    body = (
        f"CASE WHEN o_orderstatus = 'P' THEN concat('{{\"status\":', {POCKET_STATUS}, ',\"list\":{{}}}}') ELSE "
        f"concat('{{\"status\":', {POCKET_STATUS}, ',\"list\":{{\"900\":', to_json({ENTRY_A}), ',\"1000\":', to_json({ENTRY_B}), '}}}}') END"
    )
    return R.as_responses(
        table(spark, sf_dir, "orders"), "pocket", "pocket",
        seq=F.col("o_orderkey"), request_url=F.lit(pocket.API_URL), body=F.expr(body),
        meta=F.expr("map('next_offset', cast(50 + o_custkey * 50 AS string))"),
    )


POCKET_OK = "o_orderpriority <> '1-URGENT' AND o_orderstatus <> 'P'"
SECOND = f"concat('https://second.example.com/', {OKEY})"
POCKET_NEXT = sql_request(
    "o_orderkey", 2 * STEP, "pocket", "'https://getpocket.com/v3/get'", f"FROM orders WHERE {POCKET_OK}",
    {"Content-Type": "'application/x-www-form-urlencoded'"},
    {"next_offset": "cast(100 + o_custkey * 50 AS string)", "dont_obey_robotstxt": "'true'"},
    post="'count=50&offset=' || cast(50 + o_custkey * 50 AS string) || '&state=all&detailType=complete'",
)


@check(
    "pocket_page",
    sql_union(
        sql_item("o_orderkey", STEP, "pocket", ARTICLE_URL,
                 {"name": f"concat('Title ', {OKEY})", "description": "o_orderpriority", "last_update": ADDED_ISO,
                  "alt_url": f"CASE WHEN {GIVEN} <> {ARTICLE_URL} THEN {GIVEN} END",
                  "pocket_tags": "replace(replace(lower(replace(o_orderpriority, ' ', '_')), '_', ' '), '-', ' ') || '|read later list'"},
                 f"FROM orders WHERE {POCKET_OK}"),
        sql_item("o_orderkey", 0, "pocket", SECOND,
                 {"name": "o_orderstatus", "description": "''", "last_update": ADDED_ISO},
                 f"FROM orders WHERE {POCKET_OK}"),
        sql_request("o_orderkey", STEP, "pocket_page", ARTICLE_URL, f"FROM orders WHERE {POCKET_OK}", None, {"url": ARTICLE_URL}),
        sql_request("o_orderkey", 0, "pocket_page", SECOND, f"FROM orders WHERE {POCKET_OK}", None, {"url": SECOND}),
        POCKET_NEXT,
    ),
)
def pocket_page(spark, sf_dir):
    return outputs(pocket.parse_pocket(pocket_responses(spark, sf_dir)))


@check("page_offset", POCKET_NEXT)
def page_offset(spark, sf_dir):
    parsed = pocket.parse_pocket(pocket_responses(spark, sf_dir))
    return outputs(R.Parsed(None, parsed.requests.filter(F.col("kind") == "pocket")))


@check("f_pocket_ok", "SELECT o_orderkey AS seq FROM orders WHERE o_orderpriority <> '1-URGENT'")
def f_pocket_ok(spark, sf_dir):
    return pocket.ok_pages(pocket_responses(spark, sf_dir)).select("seq")


@check("date_epoch", f"SELECT o_orderkey, {ADDED_ISO} AS added FROM orders")
def date_epoch(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", epoch_date(F.expr(ADDED)).alias("added"))


# Liked posts from events: two posts per page, an empty page for purchases.
EKEY = "cast(event_id AS string)"
POST_DATE = "concat('Sat May 15 12:55:25 +0000 ', cast(2000 + user_id % 20 AS string))"
LINKED = f"concat('https://linked.example.com/', {EKEY})"
POST_A = (
    "named_struct('id', 1000000 + event_id * 10, 'full_text', concat(event_type, ' seen'), 'created_at', "
    f"{POST_DATE}, 'user', named_struct('screen_name', concat('user', cast(user_id AS string))), 'entities', "
    f"named_struct('hashtags', array(named_struct('text', event_type), named_struct('text', 'Liked')), 'urls', "
    f"array(named_struct('expanded_url', {LINKED}), named_struct('expanded_url', concat({LINKED}, '/2')))))"
)
POST_B = (
    "named_struct('id', 1000005 + event_id * 10, 'full_text', props, 'created_at', 'no date', 'user', "
    "named_struct('screen_name', 'second'), 'entities', named_struct('hashtags', cast(array() AS array<struct<text:string>>), "
    "'urls', cast(array() AS array<struct<expanded_url:string>>)))"
)
POST_URL_A = f"concat('https://twitter.com/user', cast(user_id AS string), '/status/', cast(1000000 + event_id * 10 AS string))"
POST_URL_B = "concat('https://twitter.com/second/status/', cast(1000005 + event_id * 10 AS string))"


def tweet_responses(spark, sf_dir):
    body = f"CASE WHEN event_type = 'purchase' THEN '[]' ELSE to_json(array({POST_A}, {POST_B})) END"
    return R.as_responses(
        table(spark, sf_dir, "events"), "twitter_favs", "tweets",
        seq=F.col("event_id"), request_url=F.lit(tweets.API_URL), body=F.expr(body),
    )


POSTS = "FROM events WHERE event_type <> 'purchase'"
TWEETS_NEXT = sql_request(
    "event_id", 2 * STEP, "tweets",
    "'https://api.twitter.com/1.1/favorites/list.json?count=100&tweet_mode=extended&max_id=' || cast(1000004 + event_id * 10 AS string)",
    POSTS, None, {"dont_obey_robotstxt": "'true'"},
)


@check(
    "tweets",
    sql_union(
        sql_item("event_id", 0, "twitter_favs", POST_URL_A,
                 {"content": "concat(event_type, ' seen')", "twitter_tags": "event_type || '|Liked'",
                  "last_update": "cast(2000 + user_id % 20 AS string) || '-05-15T12:55:25'"}, POSTS),
        sql_item("event_id", STEP, "twitter_favs", POST_URL_B, {"content": "props"}, POSTS),
        sql_request("event_id", 0, "tweet_page", LINKED, POSTS, None, {"url": LINKED, "twitter_url": POST_URL_A}),
        sql_request("event_id", 1, "tweet_page", f"concat({LINKED}, '/2')", POSTS, None,
                    {"url": f"concat({LINKED}, '/2')", "twitter_url": POST_URL_A}),
        TWEETS_NEXT,
    ),
)
def tweets_page(spark, sf_dir):
    return outputs(tweets.parse_tweets(tweet_responses(spark, sf_dir)))


@check("page_keyset", TWEETS_NEXT)
def page_keyset(spark, sf_dir):
    parsed = tweets.parse_tweets(tweet_responses(spark, sf_dir))
    return outputs(R.Parsed(None, parsed.requests.filter(F.col("kind") == "tweets")))


@check(
    "page_link",
    sql_request("p_partkey", 2 * STEP, "github_stars", NEXT, f"FROM part WHERE {STATUS_OK} AND p_size > 10",
                GITHUB_HEADERS, {"dont_obey_robotstxt": "'true'"}),
)
def page_link(spark, sf_dir):
    parsed = github.parse_github_stars(
        part_responses(spark, sf_dir, "github_stars", "github_stars", STARS_BODY, headers={"Link": LINK})
    )
    return outputs(R.Parsed(None, parsed.requests.filter(F.col("kind") == "github_stars")))


def _gate_responses(spark, sf_dir):
    status = "CASE o_orderpriority WHEN '1-URGENT' THEN 200 WHEN '2-HIGH' THEN 304 WHEN '3-MEDIUM' THEN 399 WHEN '5-LOW' THEN 503 ELSE 400 END"
    return R.as_responses(
        table(spark, sf_dir, "orders"), "pocket", "pocket_page",
        seq=F.col("o_orderkey"), status=F.expr(status),
        flags=F.expr("CASE WHEN o_orderstatus = 'F' THEN array('cached') ELSE cast(array() AS array<string>) END"),
        request_url=F.lit(""), body=F.lit(""),
    ).withColumn("source", F.expr("CASE WHEN seq % 2 = 0 THEN 'gitlab_stars' ELSE 'pocket' END"))


@check(
    "f_processable",
    "SELECT o_orderkey AS seq, 'any' AS mode FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM') "
    "UNION ALL SELECT o_orderkey, 'fresh' FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM') AND o_orderstatus <> 'F'",
)
def f_processable(spark, sf_dir):
    responses = _gate_responses(spark, sf_dir)
    any_mode = processable(responses, process_cached=True).select("seq", F.lit("any").alias("mode"))
    return any_mode.unionByName(processable(responses).select("seq", F.lit("fresh").alias("mode")))


@check(
    "f_status_gate",
    "SELECT o_orderkey AS seq FROM orders WHERE o_orderpriority = '1-URGENT' "
    "OR (o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') AND o_orderkey % 2 = 0)",
)
def f_status_gate(spark, sf_dir):
    return status_gate(_gate_responses(spark, sf_dir)).select("seq")
