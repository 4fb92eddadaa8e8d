"""URL validation, canonical keys and relative-link resolution."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import col, first_non_empty, let

# Accepted URLs: http, https or ftp; optional user info; localhost, an IPv4
# address or a dotted host name whose last label has two or more letters;
# optional port; path, query and fragment without white space.
_ALNUM = r"[a-z0-9\x{a1}-\x{10ffff}]"
# Possessive loops: whatever follows a label or a row of labels can be no part of it.
_LABEL = rf"{_ALNUM}++(?:-++{_ALNUM}++)*+"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
VALID_URL = (
    r"(?i)\A(?:https?|ftp)://"
    r"(?:[^\s/?#@\[\]]+@)?"
    rf"(?:localhost|{_OCTET}(?:\.{_OCTET}){{3}}"
    rf"|(?:{_LABEL}\.)++(?:xn--{_ALNUM}{{2,}}|[a-z\x{{a1}}-\x{{10ffff}}]{{2,}}))"
    r"(?::[0-9]{2,5})?"
    r"(?:/[^\s?#\"<>\\^`{|}\[\]]*)?(?:\?[^\s#]*)?(?:#\S*)?\z"
)

# Component pattern of RFC 3986, appendix B, with its narrower rule for schemes.
_PARTS = r"(?s)\A(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def is_valid_url(c) -> Column:
    return col(c).rlike(VALID_URL)


def fix_url(c) -> Column:
    """The URL itself if valid, with http:// in front if that makes it valid, else NULL."""

    def fixed(url):
        prefixed = F.concat(F.lit("http://"), url)
        return F.when(is_valid_url(url), url).when(is_valid_url(prefixed), prefixed)

    return let(c, fixed)


def _parts(url) -> Column:
    names = ["scheme", "host", "path", "query", "fragment"]
    return F.struct(*[F.regexp_extract(url, _PARTS, n + 1).alias(name) for n, name in enumerate(names)])


def _with(prefix, part) -> Column:
    return F.when(part != "", F.concat(F.lit(prefix), part)).otherwise(F.lit(""))


def url_key(c, ignore_protocol=True) -> Column:
    """Comparison form: fixed, scheme optionally blank, one trailing / of the path off."""

    def key(p):
        scheme = F.lit("") if ignore_protocol else F.concat(F.lower(p["scheme"]), F.lit(":"))
        path = F.regexp_replace(p["path"], r"/\z", "")
        return F.concat(
            scheme, F.lit("//"), p["host"], path, _with("?", p["query"]), _with("#", p["fragment"])
        )

    return let(fix_url(c), lambda url: F.when(url.isNotNull(), let(_parts(url), key)))


def url_equal(a, b, ignore_protocol=True) -> Column:
    """Equal comparison forms; raw equality when either URL cannot be fixed."""
    raw = col(a) == col(b)
    keys = F.struct(
        url_key(a, ignore_protocol).alias("a"), url_key(b, ignore_protocol).alias("b")
    )
    return let(keys, lambda k: F.coalesce(k["a"] == k["b"], raw))


def _resolve_dots(path) -> Column:
    """Apply '.' and '..' segments of an absolute path."""
    segments = F.split(path, "/", -1)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            s == "..",
            # The first, empty segment is the root: nothing lies above it.
            F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))),
        )
        .when(s == ".", acc)
        .otherwise(F.array_append(acc, s)),
    )
    # A final '.' or '..' names a directory.
    tail = F.when(path.rlike(r"(?:\A|/)\.\.?\z"), F.lit("/")).otherwise(F.lit(""))
    resolved = F.concat(F.array_join(kept, "/"), tail)
    return F.when(
        path.rlike(r"(?:\A|/)\.\.?(?:/|\z)"),
        F.when(resolved == "", F.lit("/")).otherwise(resolved),
    ).otherwise(path)


# A rooted link without dot segments and empty tails: what pages hold most.
_PLAIN_ROOTED = r"\A(?!//)(?!\S*(?:/\.|[?#](?:#|\z)))/\S*\z"


def base_parts(base) -> Column:
    """Components of a base URL, and its part in front of the path."""
    p = _parts(col(base))
    return let(
        p,
        lambda p: F.struct(
            p["scheme"].alias("scheme"),
            F.concat(
                F.when(p["scheme"] != "", F.concat(p["scheme"], F.lit(":"))).otherwise(F.lit("")),
                _with("//", p["host"]),
            ).alias("root"),
            p["path"].alias("path"),
            p["query"].alias("query"),
        ),
    )


def _join_parts(base, b, href, p) -> Column:
    tail = F.concat(_with("?", p["query"]), _with("#", p["fragment"]))
    folder = F.regexp_replace(b["path"], r"[^/]*\z", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    # Empty segments vanish inside a joined relative path, not in a rooted one.
    relative = F.regexp_replace(F.concat(folder, p["path"]), "(?<=.)/{2,}", "/")
    # A scheme equal to the base's counts as none ("http:x").
    foreign = (p["scheme"] != "") & (F.lower(p["scheme"]) != F.lower(b["scheme"]))
    same_page = F.concat(b["root"], b["path"], _with("?", b["query"]), _with("#", p["fragment"]))
    return (
        F.when((base == "") | foreign, href)
        .when(p["host"] != "", F.concat(b["scheme"], F.lit("://"), p["host"], p["path"], tail))
        .when((p["path"] == "") & (p["query"] == ""), same_page)
        .when(p["path"] == "", F.concat(b["root"], b["path"], tail))
        .otherwise(
            F.concat(
                b["root"],
                let(F.when(p["path"].startswith("/"), p["path"]).otherwise(relative), _resolve_dots),
                tail,
            )
        )
    )


def join_to(base, b, href) -> Column:
    """Resolve ``href`` against ``base`` whose components ``b`` are known."""
    return (
        F.when(href.isNull() | (href == ""), base)
        .when((b["root"] != "") & href.rlike(_PLAIN_ROOTED), F.concat(b["root"], href))
        .otherwise(let(_parts(href), lambda p: _join_parts(base, b, href, p)))
    )


def url_join(base, href) -> Column:
    """Resolve ``href`` against ``base`` the way browsers resolve http links."""
    both = F.struct(col(base).alias("base"), base_parts(base).alias("parts"), col(href).alias("href"))
    return let(both, lambda x: join_to(x["base"], x["parts"], x["href"]))


def is_web_link(c) -> Column:
    c = col(c)
    return c.startswith("http:") | c.startswith("https:")


_COMMENT = r"(?s)<!--.*?-->"


def without_comments(html) -> Column:
    """A page without its comments; most have none, and a plain search tells."""
    html = col(html)
    return F.when(F.contains(html, F.lit("<!--")), F.regexp_replace(html, _COMMENT, "")).otherwise(html)


_BASE_TAG = r"""(?i)<base(?:\s[^>]*)?\shref\s*=\s*["']?\s*([^"'\s>]+)"""


def base_url(html, url) -> Column:
    """URL that relative links of the page start from: <base href> or the page itself."""
    html, url = col(html), col(url)
    declared = F.regexp_extract(without_comments(html), _BASE_TAG, 1)
    has_base = html.rlike("(?i)<base\\s")
    return F.when(has_base, url_join(url, first_non_empty(declared, url))).otherwise(url)


def tweet_url(user, tweet_id) -> Column:
    return F.format_string("https://twitter.com/%s/status/%s", col(user), col(tweet_id).cast("string"))


def escaped(c) -> Column:
    """Every reserved character as its percent code."""
    encoded = F.url_encode(col(c))
    # url_encode writes form encoding: undo its three differences.
    for form, percent in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(form), F.lit(percent))
    return encoded


def gitlab_project_url(owner, repo) -> Column:
    """Project API address; the id is owner/repo with every reserved character escaped."""
    raw = F.concat(col(owner), F.lit("/"), col(repo))
    return F.concat(F.lit("https://gitlab.com/api/v4/projects/"), escaped(raw))


__all__ = [
    "base_url",
    "escaped",
    "fix_url",
    "gitlab_project_url",
    "is_valid_url",
    "is_web_link",
    "tweet_url",
    "url_equal",
    "url_join",
    "url_key",
    "without_comments",
]
