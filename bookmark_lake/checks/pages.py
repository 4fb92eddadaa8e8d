"""Text, links and metadata of pages, the given ones and ones built from tables."""

from pyspark.sql import functions as F

from ..functions import markdown, metadata, text, urls
from ..operators.enrich import enrich
from ..sources.responses import fragments
from .registry import check, joined, spread, sql_strip, table

# Text nodes of the given pages; they hold no scripts in the body, no quoted ">" and
# four kinds of character references.
_BODY = "regexp_replace(regexp_replace(html, '(?s)^.*<body[^>]*>', ''), '(?s)</body>.*$', '')"
_PIECES = f"string_split_regex(regexp_replace({_BODY}, '(?s)<!--.*?-->', '<!>', 'g'), '<[^>]*>')"
_LINES = f"list_transform(list_filter({_PIECES}, lambda x: x <> ''), lambda x: {sql_strip('x')})"


def _sql_decoded(c):
    for name, sign in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")):
        c = f"replace({c}, '&{name};', '{sign}')"
    return c


SQL_TEXT = sql_strip(_sql_decoded(f"array_to_string({_LINES}, chr(10))"))
SQL_TITLE = sql_strip(_sql_decoded("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))


@check("txt_nodes", f"SELECT page_id, {SQL_TEXT} AS content FROM pages")
def txt_nodes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.text_nodes("html").alias("content"))


@check("txt_title", f"SELECT page_id, {SQL_TITLE} AS title FROM pages")
def txt_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.title("html").alias("title"))


@check(
    "txt_body",
    "SELECT page_id, kind, CASE kind WHEN 'html' THEN title WHEN 'untyped' THEN title END AS title, "
    "CASE kind WHEN 'image' THEN NULL WHEN 'plain' THEN html ELSE content END AS content, "
    "CASE WHEN kind IN ('html', 'untyped') THEN CAST(length(html) AS INTEGER) END AS html_chars "
    f"FROM (SELECT page_id, html, {SQL_TITLE} AS title, {SQL_TEXT} AS content FROM pages) "
    "CROSS JOIN (VALUES ('html'), ('plain'), ('image'), ('untyped')) kinds(kind)",
)
def txt_body(spark, sf_dir):
    kinds = F.expr(
        "array(named_struct('kind', 'html', 'headers', map('Content-Type', 'text/html; charset=utf-8')), "
        "named_struct('kind', 'plain', 'headers', map('content-type', 'text/plain')), "
        "named_struct('kind', 'image', 'headers', map('Content-Type', 'image/png')), "
        "named_struct('kind', 'untyped', 'headers', map('X-Other', 'y')))"
    )
    pages = table(spark, sf_dir, "pages").select("page_id", "html", F.inline(kinds))
    return pages.select(
        "page_id",
        "kind",
        text.page_title("headers", "html").alias("title"),
        text.page_text("headers", "html").alias("content"),
        F.length(text.page_html("headers", "html")).alias("html_chars"),
    )


@check("txt_cap", "SELECT doc_id, substring(text, 1, 500) AS content FROM documents")
def txt_cap(spark, sf_dir):
    """A limit that most texts exceed."""
    return table(spark, sf_dir, "documents").select("doc_id", text.cap_text("text", 500).alias("content"))


@check(
    "html_snippet_text",
    "SELECT page_id, " + sql_strip(_sql_decoded(f"array_to_string({_LINES}, ' ')")) + " AS content FROM pages",
)
def html_snippet_text(spark, sf_dir):
    snippet = F.regexp_replace("html", "(?s)^.*?(<body)", "$1")
    return table(spark, sf_dir, "pages").select(
        "page_id", text.html_snippet_text(F.concat(F.lit("<html>"), snippet)).alias("content")
    )


_SQL_LINKS = (
    "SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href, "
    "generate_subscripts(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), 1) - 1 AS n FROM pages"
)


@check(
    "html_links",
    f"SELECT page_id, CAST(n AS INTEGER) AS n, regexp_extract(url, '^(https?://[^/?#]*)', 1) || href AS link FROM ({_SQL_LINKS})",
)
def html_links(spark, sf_dir):
    links = text.html_links("html", "url")
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(links).alias("n", "link"))


@check(
    "url_base",
    "SELECT page_id, url AS base, 'https://base.example.com/' || page_id || '/' AS declared, "
    "regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/sub/' AS relative, url AS commented FROM pages",
)
def url_base(spark, sf_dir):
    def with_head(tag):
        return F.regexp_replace("html", "<head>", F.concat(F.lit("<head>"), tag))

    declared = F.expr("concat('<base target=\"_top\" href=\"https://base.example.com/', cast(page_id AS string), '/\">')")
    commented = F.lit('<!-- <base href="https://wrong.example.com/"> -->')
    return table(spark, sf_dir, "pages").select(
        "page_id",
        urls.base_url("html", "url").alias("base"),
        urls.base_url(with_head(declared), "url").alias("declared"),
        urls.base_url(with_head(F.lit("<base href='/sub/'>")), "url").alias("relative"),
        urls.base_url(with_head(commented), "url").alias("commented"),
    )


# Markdown built from parts: heading, emphasis, list, links, code.
MARKDOWN = (
    "concat('# ', p_name, '\\n\\nSome *', p_type, '* and **', p_brand, '** text\\nwith `code ', cast(p_size AS string), '`\\n\\n"
    "* one\\n* [', p_brand, '](/part/', cast(p_partkey AS string), ' \"title\")\\n\\n> quoted ', p_type, '\\n\\n"
    "![img](http://i.example.com/x.png) [](http://abs.example.com/?a=1&b=', cast(p_partkey AS string), ') [f](file:///x)\\n')"
)


@check(
    "md_text",
    "SELECT p_partkey, p_name || '  Some ' || p_type || ' and ' || p_brand || ' text' || chr(10) || 'with code ' || p_size "
    "|| '   one  ' || p_brand || '    quoted ' || p_type || '     f' AS content FROM part "
    "UNION ALL SELECT -p_partkey, '[' || repeat(CAST(p_partkey AS VARCHAR), 1000000) FROM part WHERE p_partkey = 1",
)
def md_text(spark, sf_dir):
    parts = spread(table(spark, sf_dir, "part")).select("p_partkey", F.expr(MARKDOWN).alias("raw"))
    long = table(spark, sf_dir, "part").filter("p_partkey = 1").select((-F.col("p_partkey")).alias("p_partkey"), F.concat(F.lit("["), F.repeat("p_partkey", 1_000_000)).alias("raw"))
    return parts.unionByName(long).select("p_partkey", markdown.md_text("raw").alias("content"))


@check(
    "md_links",
    "SELECT p_partkey, 'https://base.example.com/part/' || p_partkey || '|http://abs.example.com/?a=1&b=' || p_partkey AS links FROM part",
)
def md_links(spark, sf_dir):
    links = markdown.md_links(F.expr(MARKDOWN), F.lit("https://base.example.com/x/y"))
    return spread(table(spark, sf_dir, "part")).select("p_partkey", joined(links).alias("links"))


# Pages with structured metadata, built from orders. The JSON-LD of some belongs to
# another page, some has a @graph, some is broken.
OKEY = "cast(o_orderkey AS string)"
PAGE_URL = f"concat('https://news.example.com/', {OKEY})"
DAY = "date_format(o_orderdate, 'yyyy-MM-dd')"
SQL_DAY = "strftime(o_orderdate, '%Y-%m-%d')"
JSON_LD = (
    "CASE o_orderpriority "
    f"WHEN '1-URGENT' THEN concat('{{\"keywords\": [\"', o_orderstatus, ' K\", null, \"lite:true\"], \"url\": \"http://news.example.com/', {OKEY}, '/\", \"datePublished\": [\"junk\", \"', {DAY}, '\"]}}') "
    f"WHEN '2-HIGH' THEN concat('[{{\"keywords\": \"x, ', o_orderstatus, '\", \"mainEntity\": {{\"keywords\": [\"Main-', o_orderstatus, '\"]}}, \"url\": \"https://other.example.com/\", \"datePublished\": \"1999-01-01\"}}]') "
    f"WHEN '3-MEDIUM' THEN concat('{{\"@graph\": [null, {{\"datePublished\": \"1998-01-01\"}}, {{\"@id\": \"', {PAGE_URL}, '\", \"datePublished\": \"', {DAY}, 'T10:00:00Z\"}}]}}') "
    f"WHEN '5-LOW' THEN '{{\"keywords\": broken' "
    f"ELSE concat('{{\"datePublished\": \"', {DAY}, '\"}}') END"
)
RDFA = (
    "concat('<meta property=\"og:type\" content=\"article\"><meta property=\"article:tag\" content=\"Tag: ', o_orderstatus, '\">', "
    "'<meta content=\"R &amp; D\" property=''og:tags'' />', "
    f"CASE WHEN o_orderstatus = 'F' THEN concat('<meta property=\"article:published_time\" content=\"', {DAY}, 'T01:02:03+01:00\">') "
    "ELSE '<meta property=\"article:published_time\" content=\"soon\">' END)"
)
PAGE = (
    f"concat('<html><head><title>', o_orderpriority, '</title>', {RDFA}, '<script type=\"application/ld+json\">', {JSON_LD}, "
    "'</script></head><body><p>text</p></body></html>')"
)


def metadata_pages(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.expr(PAGE_URL).alias("url"), F.expr(PAGE).alias("html")
    )


def _metadata(spark, sf_dir):
    pages = metadata_pages(spark, sf_dir)
    return pages.withColumn("m", metadata.extract_metadata("html"))


SQL_STATUS = "lower(o_orderstatus)"
SQL_LD_TAGS = (
    f"CASE o_orderpriority WHEN '1-URGENT' THEN {SQL_STATUS} || '_k' "
    f"WHEN '2-HIGH' THEN 'x|' || {SQL_STATUS} || '|main_' || {SQL_STATUS} ELSE '' END"
)
SQL_RDFA_TAGS = f"'_' || {SQL_STATUS} || '|r_&_d'"


@check(
    "md_extract",
    "SELECT o_orderkey, CAST(CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE 1 END AS INTEGER) AS n_json_ld, "
    "o_orderpriority = '5-LOW' AS broken, "
    "'http://ogp.me/ns#type=article|http://ogp.me/ns/article#tag=Tag: ' || o_orderstatus || '|http://ogp.me/ns#tags=R & D|"
    "http://ogp.me/ns/article#published_time=' || "
    f"CASE WHEN o_orderstatus = 'F' THEN {SQL_DAY} || 'T01:02:03+01:00' ELSE 'soon' END AS rdfa FROM orders "
    "UNION ALL SELECT -o_orderkey, 0, false, 'http://ogp.me/ns#x=' || repeat('a', 1000000) FROM orders WHERE o_orderkey = 1",
)
def md_extract(spark, sf_dir):
    pairs = F.transform("m.rdfa", lambda p: F.concat(p["key"], F.lit("="), p["value"]))
    pages = metadata_pages(spark, sf_dir).select("o_orderkey", "html")
    long = F.concat(F.lit("<meta property=og:x content="), F.repeat(F.lit("a"), 1_000_000), F.lit(">"))
    long = pages.filter("o_orderkey = 1").select((-F.col("o_orderkey")).alias("o_orderkey"), long.alias("html"))
    pages = pages.unionByName(long).withColumn("m", metadata.extract_metadata("html"))
    return pages.select(
        "o_orderkey", F.size("m.json_ld").alias("n_json_ld"), F.col("m.broken").alias("broken"), joined(pairs).alias("rdfa")
    )


@check("md_ld_tags", f"SELECT o_orderkey, {SQL_LD_TAGS} AS tags FROM orders")
def md_ld_tags(spark, sf_dir):
    return _metadata(spark, sf_dir).select("o_orderkey", joined(metadata.json_ld_tags("m.json_ld")).alias("tags"))


@check("md_rdfa_tags", f"SELECT o_orderkey, {SQL_RDFA_TAGS} AS tags FROM orders")
def md_rdfa_tags(spark, sf_dir):
    return _metadata(spark, sf_dir).select("o_orderkey", joined(metadata.rdfa_tags("m.rdfa")).alias("tags"))


def _supplied(spark, sf_dir):
    """Orders with a ready-made METADATA column instead of a page."""
    maps = (
        "named_struct('json_ld', array(parse_json(concat('{\"keywords\": \"', o_orderstatus, '\"}'))), "
        "'rdfa', array(named_struct('key', 'https://ogp.me/ns/video#tag', 'value', o_orderpriority)), "
        "'microdata', map('keywords', parse_json(CASE WHEN o_orderstatus = 'F' THEN '[\"M 1\", null, \"m-2\"]' ELSE '\"m 3, topic:m4\"' END)), "
        "'opengraph', map('article:tag', parse_json(concat('\"', o_orderstatus, ', og\"'))), 'broken', false)"
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(maps).alias("m"))


SQL_MICRO = "CASE WHEN o_orderstatus = 'F' THEN 'm_1|m_2' ELSE 'm_3|m4' END"
SQL_PRIORITY = "replace(replace(lower(o_orderpriority), ' ', '_'), '-', '_')"


@check("md_micro_tags", f"SELECT o_orderkey, {SQL_MICRO} AS tags FROM orders")
def md_micro_tags(spark, sf_dir):
    return _supplied(spark, sf_dir).select("o_orderkey", joined(metadata.microdata_tags("m.microdata")).alias("tags"))


@check("md_og_tags", f"SELECT o_orderkey, {SQL_STATUS} || '|og' AS tags FROM orders")
def md_og_tags(spark, sf_dir):
    return _supplied(spark, sf_dir).select("o_orderkey", joined(metadata.opengraph_tags("m.opengraph")).alias("tags"))


@check(
    "md_tags",
    f"SELECT o_orderkey, {SQL_STATUS} || '|' || {SQL_PRIORITY} || '|' || {SQL_MICRO} || '|' || {SQL_STATUS} || '|og' AS tags FROM orders",
)
def md_tags(spark, sf_dir):
    return _supplied(spark, sf_dir).select("o_orderkey", joined(metadata.metadata_tags("m")).alias("tags"))


SQL_PUBLISHED = (
    f"CASE WHEN o_orderstatus = 'F' THEN {SQL_DAY} || 'T01:02:03+01:00' "
    f"WHEN o_orderpriority = '3-MEDIUM' THEN {SQL_DAY} || 'T10:00:00+00:00' "
    f"WHEN o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED') THEN {SQL_DAY} || 'T00:00:00' END"
)


@check("md_published", f"SELECT o_orderkey, {SQL_PUBLISHED} AS published FROM orders")
def md_published(spark, sf_dir):
    return _metadata(spark, sf_dir).select("o_orderkey", metadata.published_date("m", "url").alias("published"))


@check(
    "f_ld_url_match",
    "SELECT o_orderkey, o_orderpriority <> '2-HIGH' AS with_default, o_orderpriority = '1-URGENT' AS strict "
    "FROM orders WHERE o_orderpriority <> '5-LOW'",
)
def f_ld_url_match(spark, sf_dir):
    elements = _metadata(spark, sf_dir).select("o_orderkey", "url", F.explode("m.json_ld").alias("e"))
    return elements.select(
        "o_orderkey",
        metadata.json_ld_matches(F.col("e"), F.col("url"), True).alias("with_default"),
        metadata.json_ld_matches(F.col("e"), F.col("url")).alias("strict"),
    )


@check(
    "md_elements",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '1|2' WHEN 'O' THEN '\"' || o_orderpriority || '\"' ELSE '' END AS elements FROM orders",
)
def md_elements(spark, sf_dir):
    value = F.parse_json(
        F.expr("CASE o_orderstatus WHEN 'F' THEN '[1, 2]' WHEN 'O' THEN concat('\"', o_orderpriority, '\"') ELSE 'null' END")
    )
    orders = table(spark, sf_dir, "orders").withColumn("v", value)
    return orders.select(
        "o_orderkey", joined(F.transform(metadata.elements("v"), lambda e: F.to_json(e))).alias("elements")
    )


@check(
    "enrich",
    "SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE array_to_string(list_sort(list_distinct("
    f"list_filter(string_split({SQL_LD_TAGS} || '|' || {SQL_RDFA_TAGS}, '|'), lambda x: x <> ''))), '|') END AS article_tags, "
    f"CASE WHEN o_orderpriority <> '5-LOW' THEN {SQL_PUBLISHED} END AS published FROM orders",
)
def enrich_pages(spark, sf_dir):
    pages = metadata_pages(spark, sf_dir).select(
        F.lit("pages").alias("source"), F.col("o_orderkey").alias("seq"), "url", "html"
    )
    enriched = enrich(fragments(pages, url=F.col("url"), html=F.col("html")))
    return enriched.select(
        F.col("seq").alias("o_orderkey"),
        joined("article_tags").alias("article_tags"),
        F.col("article_published_date").alias("published"),
    )
