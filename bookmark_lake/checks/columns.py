"""Column functions as table jobs."""

from pyspark.sql import functions as F

from ..functions import dates, tags, urls, values
from .registry import check, joined, table

# URL variants of every page, by what they must become.
URL_VARIANTS = {
    "as_is": ("url", "url"),
    "bare": ("regexp_replace(url, '^https?://', '')", "'http://' || regexp_replace(url, '^https?://', '')"),
    "spaced": ("concat(url, ' x')", "NULL"),
    "no_host": ("concat('page', cast(page_id AS string))", "NULL"),
    "empty": ("''", "NULL"),
    "many_labels": (
        "CASE WHEN page_id = 1 THEN concat('http://', repeat('a-', 250000), repeat('a.', 250000), 'b.com') ELSE url END",
        "CASE WHEN page_id = 1 THEN 'http://' || repeat('a-', 250000) || repeat('a.', 250000) || 'b.com' ELSE url END",
    ),
}


def _variants(spark, sf_dir, variants):
    pages = table(spark, sf_dir, "pages")
    rows = [F.struct(F.lit(name).alias("variant"), F.expr(expr[0]).alias("raw")) for name, expr in variants.items()]
    return pages.select("page_id", "url", F.inline(F.array(*rows)))


@check(
    "url_fix",
    " UNION ALL ".join(
        f"SELECT page_id, '{name}' AS variant, {want} AS fixed FROM pages" for name, (_, want) in URL_VARIANTS.items()
    ),
)
def url_fix(spark, sf_dir):
    return _variants(spark, sf_dir, URL_VARIANTS).select("page_id", "variant", urls.fix_url("raw").alias("fixed"))


_SQL_KEY = (
    "regexp_extract({u}, '^https?:(//[^/?#]*)', 1) || "
    "regexp_replace(regexp_extract({u}, '^https?://[^/?#]*([^?#]*)', 1), '/$', '') || "
    "regexp_extract({u}, '^[^?#]*(\\?[^#]+)', 1) || regexp_extract({u}, '(#.+)$', 1)"
)


@check(
    "url_key",
    f"SELECT page_id, {_SQL_KEY.format(u='url')} AS any_protocol, "
    f"regexp_extract(url, '^https?:') || {_SQL_KEY.format(u='url')} AS with_protocol FROM pages",
)
def url_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id",
        urls.url_key("url").alias("any_protocol"),
        urls.url_key("url", ignore_protocol=False).alias("with_protocol"),
    )


# A second URL for every page and whether both are the same page.
EQUAL_VARIANTS = {
    "same": ("url", "TRUE", "TRUE"),
    "protocol": ("replace(replace(url, 'https:', 'ftp:'), 'http:', 'ftp:')", "TRUE", "FALSE"),
    "query": (
        "concat(regexp_replace(url, '[?#].*$', ''), '?other=1')",
        "FALSE", "FALSE",
    ),
    "unfixable": ("concat(url, ' x')", "FALSE", "FALSE"),
    "slash": (
        "CASE WHEN url LIKE '%?%' OR url LIKE '%#%' THEN url WHEN url LIKE '%/' THEN regexp_replace(url, '/$', '') ELSE concat(url, '/') END",
        "TRUE", "TRUE",
    ),
}


@check(
    "url_equal",
    " UNION ALL ".join(
        f"SELECT page_id, '{n}' AS variant, {a} AS any_protocol, {b} AS with_protocol FROM pages"
        for n, (_, a, b) in EQUAL_VARIANTS.items()
    ),
)
def url_equal(spark, sf_dir):
    return _variants(spark, sf_dir, EQUAL_VARIANTS).select(
        "page_id",
        "variant",
        urls.url_equal("url", "raw").alias("any_protocol"),
        urls.url_equal("url", "raw", ignore_protocol=False).alias("with_protocol"),
    )


# Links relative to every page; {root} is scheme and host, {dir} the folder of the path.
_ROOT = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"
_PATH = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"
_DIR = f"regexp_extract({_PATH}, '^(.*/)', 1)"
_QUERY = "regexp_extract(url, '^[^?#]*(\\?[^#]+)', 1)"
JOIN_VARIANTS = {
    "rooted": ("'/a/b?x=1'", f"{_ROOT} || '/a/b?x=1'"),
    "relative": ("'a/../b'", f"{_ROOT} || {_DIR} || 'b'"),
    "dots": ("'./c/./d/'", f"{_ROOT} || {_DIR} || 'c/d/'"),
    "above": ("'../../../../../../e'", f"{_ROOT} || '/e'"),
    "query": ("'?q=ü'", f"{_ROOT} || {_PATH} || '?q=ü'"),
    "fragment": ("'#f'", f"{_ROOT} || {_PATH} || {_QUERY} || '#f'"),
    "host": ("'//other.example.com/p'", "regexp_extract(url, '^https?:') || '//other.example.com/p'"),
    "absolute": ("concat('https://x.example.com/', cast(page_id AS string))", "'https://x.example.com/' || page_id"),
    "mail": ("'mailto:x@example.com'", "'mailto:x@example.com'"),
    "empty": ("''", "url"),
}


@check(
    "url_join",
    " UNION ALL ".join(
        f"SELECT page_id, '{n}' AS variant, {want} AS link FROM pages" for n, (_, want) in JOIN_VARIANTS.items()
    ),
)
def url_join(spark, sf_dir):
    return _variants(spark, sf_dir, JOIN_VARIANTS).select(
        "page_id", "variant", urls.url_join("url", "raw").alias("link")
    )


@check(
    "f_link_scheme",
    " UNION ALL ".join(
        f"SELECT page_id, '{n}' AS variant, {want} AS link FROM pages"
        for n, (_, want) in JOIN_VARIANTS.items()
        if n != "mail"
    ),
)
def f_link_scheme(spark, sf_dir):
    joined_links = url_join(spark, sf_dir)
    return joined_links.filter(urls.is_web_link("link"))


@check(
    "url_tweet",
    "SELECT event_id, 'https://twitter.com/user' || user_id || '/status/' || event_id AS tweet_url FROM events",
)
def url_tweet(spark, sf_dir):
    user = F.expr("concat('user', cast(user_id AS string))")
    return table(spark, sf_dir, "events").select("event_id", urls.tweet_url(user, "event_id").alias("tweet_url"))


@check(
    "f_github_html",
    "SELECT p_partkey, p_type IN ('ECONOMY', 'PROMO') AS is_github_html FROM part",
)
def f_github_html(spark, sf_dir):
    headers = F.expr(
        "CASE p_type WHEN 'ECONOMY' THEN map('Content-Type', 'application/vnd.github.v3.html; charset=utf-8') "
        "WHEN 'PROMO' THEN map('content-type', 'application/vnd.github.raw.html') "
        "WHEN 'SMALL' THEN map('Content-Type', 'application/json') "
        "WHEN 'MEDIUM' THEN map('Content-Type', 'application/vnd.github.v3.json') "
        "ELSE map('Accept', 'application/vnd.github.v3.html') END"
    )
    return table(spark, sf_dir, "part").select("p_partkey", values.is_github_html(headers).alias("is_github_html"))


@check(
    "link_next",
    "SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'https://x.example.com/?page=' || (p_size + 1) || '&per_page=2' "
    "WHEN p_size <= 30 THEN 'https://x.example.com/?page=' || p_size END AS next_page FROM part",
)
def link_next(spark, sf_dir):
    headers = F.expr(
        "CASE WHEN p_size <= 10 THEN map('Link', concat('<https://x.example.com/?page=', cast(p_size + 1 AS string), "
        "'&per_page=2>; rel=\"next\", <https://x.example.com/?page=9>; rel=\"last\"')) "
        "WHEN p_size <= 20 THEN map('link', concat('<https://x.example.com/?page=9>; rel=\"last\", <https://x.example.com/?page=', "
        "cast(p_size AS string), '>; title=\"a, b\"; rel=next')) "
        "WHEN p_size <= 30 THEN map('X-Other', 'y', 'LINK', concat('<https://x.example.com/?page=', cast(p_size AS string), '>; rel=\"next\"')) "
        "WHEN p_size <= 40 THEN map('Link', '<https://x.example.com/?page=9>; rel=\"last\"') ELSE map('Accept', 'x') END"
    )
    return table(spark, sf_dir, "part").select("p_partkey", values.link_next(headers).alias("next_page"))


# Raw tags from every order, by the tag they must become ('' for none).
TAG_VARIANTS = {
    "priority": ("concat(' ', o_orderpriority, ' ')", "replace(replace(lower(o_orderpriority), ' ', '_'), '-', '_')"),
    "labelled": ("concat('Topic:', o_orderpriority)", "replace(replace(lower(o_orderpriority), ' ', '_'), '-', '_')"),
    "platform": ("concat('プラットフォーム:', o_orderstatus)", "lower(o_orderstatus)"),
    "bracketed": ("concat('[', o_orderstatus, ']')", "lower(o_orderstatus)"),
    "attribute": ("concat('status:', o_orderstatus)", "''"),
    "twice": ("concat('tag:a:', o_orderstatus)", "''"),
    "label_only": ("'section:'", "''"),
    "blank": ("' '", "''"),
}


@check(
    "tag_norm",
    " UNION ALL ".join(
        f"SELECT o_orderkey, '{n}' AS variant, {want} AS tag FROM orders" for n, (_, want) in TAG_VARIANTS.items()
    ),
)
def tag_norm(spark, sf_dir):
    rows = [F.struct(F.lit(n).alias("variant"), F.expr(e[0]).alias("raw")) for n, e in TAG_VARIANTS.items()]
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", F.inline(F.array(*rows)))
        .select("o_orderkey", "variant", joined(tags.normalise_tag("raw")).alias("tag"))
    )


_SQL_PRIORITY = "replace(replace(lower(o_orderpriority), ' ', '_'), '-', '_')"


@check(
    "tag_list",
    f"SELECT o_orderkey, {_SQL_PRIORITY} || '|' || lower(o_orderstatus) || '|' || {_SQL_PRIORITY} AS from_list, "
    f"lower(o_orderstatus) || '|' || {_SQL_PRIORITY} AS from_string FROM orders",
)
def tag_list(spark, sf_dir):
    raw_list = F.expr("array(o_orderpriority, NULL, o_orderstatus, 'lite:true', o_orderpriority)")
    raw_string = F.expr("concat(o_orderstatus, ', a:b ,', o_orderpriority, ',')")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        joined(tags.tag_list(raw_list)).alias("from_list"),
        joined(tags.tag_list_from_string(raw_string)).alias("from_string"),
    )


@check(
    "f_not_null",
    "SELECT o_orderkey, o_orderstatus || CASE WHEN o_totalprice > 200000 THEN '|' || o_orderpriority ELSE '' END AS kept FROM orders",
)
def f_not_null(spark, sf_dir):
    raw = F.expr("array(NULL, o_orderstatus, CASE WHEN o_totalprice > 200000 THEN o_orderpriority END)")
    return table(spark, sf_dir, "orders").select("o_orderkey", joined(values.drop_nulls(raw)).alias("kept"))


@check(
    "tag_pocket",
    "SELECT o_orderkey, replace(replace(o_orderpriority, '-', ' '), '_', ' ') || '|read later now' AS tags FROM orders",
)
def tag_pocket(spark, sf_dir):
    raw = F.expr("map(o_orderpriority, 1, 'read-later_now', 2)")
    return table(spark, sf_dir, "orders").select("o_orderkey", joined(tags.pocket_tags(raw)).alias("tags"))


@check(
    "tag_hashtags",
    "SELECT event_id, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN '' ELSE event_type || '|user' || user_id END AS tags FROM events",
)
def tag_hashtags(spark, sf_dir):
    entities = F.expr(
        "CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN named_struct('hashtags', cast(array() AS array<struct<text:string>>)) "
        "ELSE named_struct('hashtags', array(named_struct('text', event_type), named_struct('text', concat('user', cast(user_id AS string))))) END"
    )
    return table(spark, sf_dir, "events").select("event_id", joined(tags.hashtags(entities)).alias("tags"))


_SQL_SORTED = "array_to_string(list_sort(list_distinct({})), '|')"


@check(
    "tag_all",
    "SELECT o_orderkey, "
    + _SQL_SORTED.format("list_filter([o_orderstatus, o_orderpriority, 'zz', o_orderstatus, 'Aa', CASE WHEN o_totalprice > 200000 THEN 'big' END], lambda x: x IS NOT NULL)")
    + " AS tags FROM orders",
)
def tag_all(spark, sf_dir):
    pocket = F.expr(f"CASE WHEN o_totalprice > 200000 THEN array('Aa', 'big') ELSE array('Aa') END")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        joined(
            tags.all_tags(F.expr("array(o_orderstatus, 'zz')"), F.expr("array(o_orderpriority, o_orderstatus)"), pocket)
        ).alias("tags"),
    )


@check(
    "tag_set",
    f"SELECT o_orderkey, {_SQL_SORTED.format('[o_orderstatus, o_orderpriority, o_orderstatus]')} AS tags FROM orders",
)
def tag_set(spark, sf_dir):
    raw = F.expr("array(o_orderstatus, o_orderpriority, o_orderstatus)")
    return table(spark, sf_dir, "orders").select("o_orderkey", joined(tags.tag_set(raw)).alias("tags"))


# Every order date in each accepted and some unaccepted notations.
DATE_VARIANTS = {
    "post": ("concat(date_format(o_orderdate, 'EEE MMM dd HH:mm:ss'), ' +0000 ', date_format(o_orderdate, 'yyyy'))", "%Y-%m-%dT%H:%M:%S"),
    "zulu": ("date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")", "%Y-%m-%dT%H:%M:%S+00:00"),
    "offset": ("date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm'+0230'\")", "%Y-%m-%dT%H:%M:00+02:30"),
    "spaced": ("date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss.SSSSSS')", "%Y-%m-%dT%H:%M:%S"),
    "fraction": ("concat(date_format(o_orderdate, \"yyyyMMdd'T'HHmmss\"), ',25')", "%Y-%m-%dT%H:%M:%S.250000"),
    "day": ("date_format(o_orderdate, 'yyyy-MM-dd')", "%Y-%m-%dT00:00:00"),
    "basic": ("date_format(o_orderdate, 'yyyyMMdd')", "%Y-%m-%dT00:00:00"),
    "slashes": ("date_format(o_orderdate, 'yyyy/M/d')", "%Y-%m-%dT00:00:00"),
    "short": ("date_format(o_orderdate, 'yyyy-M-d')", "%Y-%m-%dT00:00:00"),
    "month": ("date_format(o_orderdate, 'yyyy-MM')", "%Y-%m-01T00:00:00"),
    "year": ("date_format(o_orderdate, 'yyyy')", "%Y-01-01T00:00:00"),
    "american": ("date_format(o_orderdate, 'MM/dd/yyyy')", None),
    "clock": ("date_format(o_orderdate, 'HH:mm:ss')", None),
    "month_13": ("date_format(o_orderdate, \"yyyy-'13'-dd\")", None),
    "words": ("o_orderpriority", None),
}


def _sql_date(form):
    return f"strftime(o_orderdate, '{form}')" if form else "NULL"


@check(
    "date_parse",
    " UNION ALL ".join(
        f"SELECT o_orderkey, '{n}' AS variant, {_sql_date(form)} AS iso FROM orders" for n, (_, form) in DATE_VARIANTS.items()
    ),
)
def date_parse(spark, sf_dir):
    rows = [F.struct(F.lit(n).alias("variant"), F.expr(e[0]).alias("raw")) for n, e in DATE_VARIANTS.items()]
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", F.inline(F.array(*rows)))
        .select("o_orderkey", "variant", dates.parse_date("raw").alias("iso"))
    )


@check(
    "date_year",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '?' WHEN 'O' THEN strftime(o_orderdate, '%Y') ELSE '?' END AS year FROM orders",
)
def date_year(spark, sf_dir):
    raw = F.expr(
        "CASE o_orderstatus WHEN 'F' THEN '' WHEN 'O' THEN date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'+00:00'\") "
        "ELSE o_orderpriority END"
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.date_year(raw).alias("year"))


@check(
    "map_merge",
    "SELECT o_orderkey, 'a=' || o_orderstatus || '; b=' || o_orderpriority || '; c=' || o_orderkey "
    "|| CASE WHEN o_orderstatus = 'F' THEN '' ELSE '; d=old' END AS merged FROM orders",
)
def map_merge(spark, sf_dir):
    new = F.expr("map('b', o_orderpriority, 'c', cast(o_orderkey AS string))")
    old = F.expr("CASE o_orderstatus WHEN 'F' THEN map('a', 'F', 'b', 'old') ELSE map('a', o_orderstatus, 'b', 'old', 'd', 'old') END")
    merged = F.map_entries(values.map_merge(new, old))
    text = F.array_join(F.array_sort(F.transform(merged, lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "; ")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("merged"))


@check(
    "p_seed_fallback",
    "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name WHEN p_size > 12 THEN p_brand END AS value FROM part",
)
def p_seed_fallback(spark, sf_dir):
    seed = F.expr("CASE WHEN p_size > 25 THEN p_name WHEN p_size > 5 THEN '' END")
    payload = F.expr("CASE WHEN p_size > 12 THEN p_brand WHEN p_size > 8 THEN '' END")
    return table(spark, sf_dir, "part").select("p_partkey", values.first_non_empty(seed, payload).alias("value"))
