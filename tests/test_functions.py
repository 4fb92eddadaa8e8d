"""Golden values of the column functions."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from bookmark_lake.functions import dates, markdown, metadata, tags, text, urls, values
from bookmark_lake.operators.present import display_title, display_value, shorten

MARKDOWN = """
Read the [manual](guide/start.html) first

## Getting it
Sources are in [an archive](ftp://files.example.net/src.tgz), news are
[](https://news.example.net/feed?lang=de&page=2)
"""


def test_fix_url(each):
    raw = ["www.test.com", "http://www.test.com/x?y#z", "", None, "not a url", "localhost", "http://10.0.0.1:80/", "http://a.b"]
    assert each(urls.fix_url("a"), raw) == [
        "http://www.test.com", "http://www.test.com/x?y#z", None, None, None, "http://localhost", "http://10.0.0.1:80/", None,
    ]


def test_url_equal(one):
    same = lambda a, b, ignore: one(urls.url_equal("a", "b", ignore), a=a, b=b)
    assert same("https://docs.example.org/guide", "https://docs.example.org/guide/", False)
    assert not same("https://docs.example.org/guide", "http://docs.example.org/guide", False)
    assert not same("https://docs.example.org/guide", "https://wiki.example.org/guide", False)
    assert same("https://docs.example.org/guide", "http://docs.example.org/guide/", True)
    assert not same("https://docs.example.org/guide", "https://docs.example.org/guide?v=2", True)
    assert same("two words", "two words", True)
    assert not same("https://docs.example.org/Guide", "https://docs.example.org/guide", True)


def test_url_join_like_the_standard_library(spark):
    bases = ["http://a.com/b/c/d;p?q", "http://a.com", "http://a.com/x/", "https://a.com/x?y#z"]
    links = (
        "g ./g g/ /g //g ?y g?y #s g#s . ./ .. ../ ../g ../.. ../../g ../../../g /./g /../g g. ..g ./../g "
        "a//b /a//b mailto:x http:g http://h/p g/./h g/../h ? /a/b?c=../d"
    ).split() + ["", "/a b"]
    rows = spark.createDataFrame([(b, h) for b in bases for h in links], "b string, h string")
    for r in rows.select("b", "h", urls.url_join("b", "h").alias("j")).collect():
        assert r["j"] == urljoin(r["b"], r["h"]), (r["b"], r["h"])


def test_base_url(one):
    base = lambda html: one(urls.base_url("html", "url"), html=html, url="http://a.com/x/y")
    assert base("<head></head>") == "http://a.com/x/y"
    assert base("<base href='/z/'>") == "http://a.com/z/"
    assert base("<!-- <base href='/z/'> --><BASE target=_top HREF=http://b.com/>") == "http://b.com/"


def test_github_html(spark):
    check = lambda **h: spark.range(1).select(
        values.is_github_html(F.create_map(*[F.lit(x) for kv in h.items() for x in kv]))
    ).first()[0]
    assert check(**{"Content-Type": "application/vnd.github.v3.html"})
    assert not check(**{"Content-Type": "application/json"})
    assert check(**{"content-type": "application/vnd.github.v3.html; charset=utf-8"})
    assert not check(Accept="application/vnd.github.v3.html")


def test_link_next(spark):
    def following(key, header):
        m = F.create_map(F.lit(key), F.lit(header))
        return spark.range(1).select(values.link_next(m)).first()[0]

    both = '<http://a/x?p=2,3>; rel="next", <http://a?p=9>; rel="last"'
    for key in ("Link", "link", "LINK"):
        assert following(key, both) == "http://a/x?p=2,3"
    assert following("Link", '<http://a?p=9>; rel="last"') is None
    assert following("Link", '<http://a?p=1>; rel="first", <http://a?p=3>; title="x, y"; rel=next') == "http://a?p=3"
    assert following("X", both) is None


def test_markdown(one):
    base = "https://code.example.com/tool/"
    assert one(markdown.md_links("m", "b"), m=MARKDOWN, b=base) == [
        "https://code.example.com/tool/guide/start.html", "https://news.example.net/feed?lang=de&page=2",
    ]
    assert one(markdown.md_text("m"), m=MARKDOWN) == (
        "Read the manual first  Getting it  Sources are in an archive , news are"
    )
    assert one(markdown.md_links("m", "b"), m=None, b=base) == []
    assert one(markdown.md_text("m"), m="a *b* **c** `d` \\*e\\* ![i](x.png) <http://f.com/_g_>") == "a b  c  d *e*  http://f.com/_g_"


def test_markdown_blocks(one):
    html = one(markdown.markdown_to_html("m"), m="Title\n=====\n* one\n* two\n\n1. x\n2. y\n\n> q\n\n***\n\nlast")
    assert html == (
        "<h1>Title</h1>\n<ul>\n<li>one</li>\n<li>two</li>\n</ul>\n<ol>\n<li>x</li>\n<li>y</li>\n</ol>\n"
        "<blockquote>\n<p>q</p>\n</blockquote>\n<hr>\n<p>last</p>"
    )


def test_text_nodes(each):
    pages = [
        "<html><head><script>var t='</p>';</script></head><body><p>a</p> <p>b",
        "<body>x<!-- c -->y<script>if (a<b) '&amp;'</script>z &amp;&lt;&#8217;&#x2019;&unknown;&amp;copy;</body>",
        '<body><p title="a>b">t</p></body><p>after</p>',
        "<p>no body</p>",
        "a < b",
        "<body>&nbsp; x \n</body>",
    ]
    assert each(text.text_nodes("a"), pages) == [
        "a\n\nb", "x\ny\nif (a<b) '&amp;'\nz &<’’&unknown;&copy;", "t", "no body", "a < b", "x",
    ]


def test_title_and_snippet(each):
    raw = ["<head><title> A &amp;\nB </title></head><body><svg><title>no</title></svg>", "<title></title>", "<p>x <b>y</b></p>"]
    assert each(text.title("a"), raw) == ["A &\nB", "", ""]
    assert each(text.html_snippet_text("a"), raw[2:]) == ["x y"]
    assert each(text.cap_text("a", 3), ["abcd", "é☂x!", None]) == ["abc", "é☂x", None]


def test_html_links(one):
    html = (
        "<a href='/a'>1</a><a class=x href=\"b?x=1&amp;y=2\">2</a><a name=n>3</a><!-- <a href='/no'> -->"
        "<a href=mailto:x>4</a><a data-href='/no' href=https://o.com/>5</a><script>'<a href=\"/no\">'</script>"
    )
    assert one(text.html_links("h", "u"), h=html, u="http://a.com/d/") == [
        "http://a.com/a", "http://a.com/d/b?x=1&y=2", "https://o.com/",
    ]


def test_tags(each):
    raw = ["Tag: Big-Data", "lite:true", "[x]", "topic:", "topic", "プラットフォーム:web", "", " \t", None, "A b"]
    assert each(tags.normalise_tag("a"), raw) == [
        ["_big_data"], [], ["x"], [], [], ["web"], [], [], [], ["a_b"],
    ]
    assert each(tags.tag_list_from_string("a"), ["a,b , c", "", "x:y,Z"]) == [["a", "b", "c"], [], ["z"]]


def test_dates(each):
    raw = {
        "Sat May 15 12:55:25 +0000 2021": "2021-05-15T12:55:25",
        "2021-05-15T12:55:25Z": "2021-05-15T12:55:25+00:00",
        "2021-05-15T12:55:25+02:00": "2021-05-15T12:55:25+02:00",
        "2021-05-15": "2021-05-15T00:00:00",
        "2021/05/15": "2021-05-15T00:00:00",
        "20210515": "2021-05-15T00:00:00",
        "2021": "2021-01-01T00:00:00",
        "2021-05": "2021-05-01T00:00:00",
        "2021-05-15T24:00": "2021-05-16T00:00:00",
        "2021-05-15 10:11:12.5": "2021-05-15T10:11:12.500000",
        "12:55:00": None,
        "junk": None,
        "2021-02-30": None,
        "2021-05T10": None,
    }
    assert each(dates.parse_date("a"), list(raw)) == list(raw.values())
    assert each(dates.date_year("a"), ["2021-05-15T12:55:25Z", "", None, "junk"]) == ["2021", "?", "?", "?"]
    assert each(dates.epoch_date("a"), ["0", "1621083325", "x", None]) == [
        "1970-01-01T00:00:00", "2021-05-15T12:55:25", None, None,
    ]


PAGE = """<html><head>
<meta property="og:title" content="Weekly notes">
<meta content="garden" property="article:tag">
<meta property="article:tag" content="bees"/>
</head><body><p property="name">text</p></body></html>"""


def test_rdfa_tags(one):
    assert one(metadata.article_tags(metadata.extract_metadata("h")), h=PAGE) == ["bees", "garden"]


def test_declared_prefixes(one):
    html = '<html prefix="og: https://ogp.me/ns# x: http://ogp.me/ns/book#"><meta property="og:tag" content="a"><meta property="x:tag" content="b">'
    assert one(metadata.article_tags(metadata.extract_metadata("h")), h=html) == ["a", "b"]


def test_published_date(one):
    def published(json, url="https://x.com/p"):
        html = f'<head><script type="application/ld+json">{json}</script></head>'
        m = metadata.extract_metadata("h")
        return one(metadata.article_published_date(m, F.col("h"), F.lit(url)), h=html)

    assert published('{"datePublished": "2021-05-15"}') == "2021-05-15T00:00:00"
    assert published('{"datePublished": ["nope", 5, "2021-05-15"]}') == "2021-05-15T00:00:00"
    assert published('{"url": "http://other.com/", "datePublished": "2021-05-15"}') is None
    assert published('[{"@id": "http://x.com/p/", "datePublished": "2021-05-15"}]') == "2021-05-15T00:00:00"
    assert published('{"@graph": [{"datePublished": "2020-01-01"}, {"url": "x.com/p", "datePublished": "2021-05-15"}]}') == "2021-05-15T00:00:00"
    assert published('{"datePublished": broken') is None


def test_display(each):
    long_word = "x" * 60
    words = "abcde " * 20
    raw = ["t" * 54, "a" * 30 + " " + "b" * 24, long_word, words, "", "  a   b  "]
    assert each(shorten("a"), raw) == [
        "t" * 54, "a" * 30 + "…", "x" * 54 + "…", " ".join(["abcde"] * 9) + "…", "", "  a   b  ",
    ]
    assert each(display_value("a"), [" a\nb ", "", None, "y" * 70]) == ["a b", "", "", "y" * 64]
    assert each(display_title("a", F.lit("desc"), F.lit("c\nd")), ["name", None, "n" * 60]) == [
        "name - desc - c d", "desc - c d", "n" * 54 + "…",
    ]


LONG = 1_000_000


def test_long_rows(each):
    """Rows that a recursive matcher would not survive."""
    a = "a" * LONG
    assert each(metadata.article_tags(metadata.extract_metadata("a")), [
        f"<meta property=og:tag content={a}>", "<meta property='og:tag' " + "x='y' " * (LONG // 6) + "content='t'>",
    ]) == [[a], ["t"]]
    assert each(markdown.md_text("a"), [f"[{a}", "[b]" * (LONG // 3), "\n" * LONG, "* " * (LONG // 2), "x " * (LONG // 2)]) == [
        f"[{a}", "[b]" * (LONG // 3), "", "", ("x " * (LONG // 2)).strip(),
    ]
    hosts = ["http://" + "a-" * (LONG // 2) + "b.com", "http://" + "a." * (LONG // 2) + "com", "http://" + "a." * (LONG // 2)]
    assert each(urls.fix_url("a"), hosts) == [*hosts[:2], None]
    assert each(text.text_nodes("a"), ["<p " + "x='y' " * (LONG // 6) + ">t", "&amp;" * (LONG // 5), "<b>x</b>" * (LONG // 8)]) == [
        "t", "&" * (LONG // 5), "\n".join(["x"] * (LONG // 8)),
    ]
    assert each(text.text_nodes("a"), ["<p>a\x01b", "&#0000000000038;&#x00000026;&#99999999999999999999;"]) == ["ab", "&&\ufffd"]
    assert each(F.size(text.links_of("a", F.lit("http://b.com/"))), ["<a href=x>" * (LONG // 10)]) == [LONG // 10]
