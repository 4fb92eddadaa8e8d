"""Text, titles and links of HTML pages."""

import json
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import base_parts, base_url, is_web_link, join_to
from .values import SPACE, col, is_github_html, let, mime_type, reusable, strip

# Marks the border between two text nodes; taken out of a document before.
_BORDER = "\x01"

_RAW = r"<!--.*?(?:-->|\z)|<(?:script|style)\b[^>]*>(.*?)(?:</(?:script|style)\s*>|\z)"
_TAG = (
    r"""<[/!?a-z][^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+>"""
    r"|<[/!?a-z][^>]*>"
)
# Comments vanish, script and style content is kept as it stands ($1).
_RAW_RE = rf"(?is){_RAW}"
_TAG_RE = rf"(?is){_TAG}"
_RAW_OR_TAG_RE = rf"(?is){_RAW}|{_TAG}"

_ENTITY_RE = r"&(#[0-9]++|#[xX][0-9a-fA-F]++|[A-Za-z][A-Za-z0-9]++);"

_HTML_TYPES = ["text/html", "application/xhtml+xml", "application/vnd.wap.xhtml+xml"]
_TEXT_TYPES = [
    "application/json",
    "application/x-json",
    "application/javascript",
    "application/x-javascript",
    "application/xml",
    "application/atom+xml",
    "application/rdf+xml",
    "application/rss+xml",
]


def _entity_names() -> Column:
    """name → character, from the table that ships with Python."""
    known = {name: chr(code) for name, code in name2codepoint.items()}
    return F.from_json(F.lit(json.dumps({**known, "apos": "'"})), "map<string,string>")


def _code_point(number) -> Column:
    """Character of a code point; code points outside Unicode give U+FFFD."""
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    safe = F.when(valid, number).otherwise(F.lit(0xFFFD))
    return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")


def _decode_one(name, names) -> Column:
    hexadecimal = F.conv(F.substr(name, F.lit(3)), 16, 10).try_cast("bigint")
    decimal = F.substr(name, F.lit(2)).try_cast("bigint")
    return (
        F.when(name.rlike("^#[xX]"), _code_point(hexadecimal))
        .when(name.startswith("#"), _code_point(decimal))
        .otherwise(F.coalesce(F.try_element_at(names, name), F.concat(F.lit("&"), name, F.lit(";"))))
    )


def _decode_all(text, names) -> Column:
    return F.array_join(
        F.zip_with(
            F.split(text, _ENTITY_RE, -1),
            F.regexp_extract_all(text, F.lit(_ENTITY_RE), F.lit(1)),
            lambda piece, name: F.concat(
                piece, F.when(name.isNull(), F.lit("")).otherwise(_decode_one(name, names))
            ),
        ),
        "",
    )


def decode_entities(c) -> Column:
    """Replace character references in one pass, so that decoded text is never decoded again."""
    names = _entity_names()
    return let(
        c, lambda text: F.when(F.contains(text, F.lit("&")), _decode_all(text, names)).otherwise(text)
    )


def _inside_body(html) -> Column:
    after_open = F.regexp_replace(html, r"(?is)\A.*?<body(?:\s[^>]*)?>", "")
    after_head = F.regexp_replace(html, r"(?is)\A.*?</head\s*>", "")
    no_head = F.regexp_replace(html, r"(?is)\A\s*<!doctype[^>]*>|<title[^>]*>.*?</title>", "")
    return (
        F.when(html.rlike(r"(?i)<body[\s>]"), after_open)
        .when(html.rlike(r"(?i)</head\s*>"), after_head)
        .otherwise(no_head)
    )


def _body(html) -> Column:
    """Inside of <body>; without one, what follows the head; a missing end tag is fine."""
    return F.regexp_replace(let(html, _inside_body), r"(?is)</body\s*>.*\z", "")


def _by_piece(body) -> Column:
    """Script and style content stays as it is, references included."""
    return F.array_join(
        F.zip_with(
            F.split(body, _RAW_RE, -1),
            F.regexp_extract_all(body, F.lit(_RAW_RE), F.lit(1)),
            lambda text, raw: F.concat(
                decode_entities(F.regexp_replace(text, _TAG_RE, _BORDER)),
                F.lit(_BORDER),
                F.coalesce(raw, F.lit("")),
            ),
        ),
        _BORDER,
    )


def _bordered_text(body) -> Column:
    """Body text with one border sign wherever tags or comments stood."""
    simple = decode_entities(F.regexp_replace(body, _RAW_OR_TAG_RE, f"{_BORDER}$1{_BORDER}"))
    scripted = F.contains(body, F.lit("&")) & body.rlike(r"(?i)<(?:script|style)\b")
    return F.when(scripted, _by_piece(body)).otherwise(simple)


@reusable
def text_nodes(html, separator="\n") -> Column:
    """Text nodes under <body>, each stripped, joined by ``separator``, then stripped.

    White-space-only nodes count, so they leave empty entries between separators.
    """
    plain = F.translate(col(html), _BORDER, "")
    bordered = F.regexp_replace(let(_body(plain), _bordered_text), f"{_BORDER}+", _BORDER)
    bordered = F.regexp_replace(bordered, rf"\A{_BORDER}|{_BORDER}\z", "")
    return strip(F.regexp_replace(bordered, rf"{SPACE}*{_BORDER}{SPACE}*", separator))


@reusable
def title(html) -> Column:
    """Text of the head's title elements, stripped pieces joined by a space."""
    head = F.regexp_replace(col(html), r"(?is)<body(?:\s[^>]*)?>.*\z", "")
    head = F.regexp_replace(head, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", "")
    found = F.regexp_extract_all(head, F.lit(r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>"), F.lit(1))
    return strip(F.array_join(F.transform(found, lambda t: strip(decode_entities(t))), " "))


def cap_text(c, limit) -> Column:
    """First ``limit`` characters, where a caller wants a text bounded; nothing here does."""
    return F.substring(col(c), 1, limit)


def html_snippet_text(c) -> Column:
    """Text of an HTML fragment on one line."""
    return text_nodes(c, " ")


def is_html(headers, body) -> Column:
    """HTML by content type; by its first tags when the type is missing."""
    mime = F.lower(mime_type(headers))
    looks_html = body.rlike(r"(?i)<html[\s>]|<!doctype html")
    return F.when(is_github_html(headers), True).otherwise(
        F.when(mime.isNull() | (mime == ""), looks_html).otherwise(mime.isin(_HTML_TYPES))
    )


def is_text(headers) -> Column:
    mime = F.lower(mime_type(headers))
    return mime.isNull() | (mime == "") | mime.startswith("text/") | mime.isin(_TEXT_TYPES)


@reusable
def page_title(headers, body) -> Column:
    headers, body = col(headers), col(body)
    return F.when(is_html(headers, body), title(body))


@reusable
def page_text(headers, body) -> Column:
    """Readable text of a response: HTML text nodes, other text as it stands, else NULL."""
    headers, body = col(headers), col(body)
    return F.when(is_html(headers, body), text_nodes(body)).when(is_text(headers), body)


@reusable
def page_html(headers, body) -> Column:
    headers, body = col(headers), col(body)
    return F.when(is_html(headers, body), body)


_ANCHOR = r"""(?is)<a(?:\s[^>]*?)?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
_NOT_MARKUP = r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>"


def links_of(html, base) -> Column:
    """Every <a href> resolved against ``base``, web links only, in order, repeats kept."""
    hrefs = F.regexp_extract_all(
        F.regexp_replace(col(html), _NOT_MARKUP, ""), F.lit(_ANCHOR), F.lit(1)
    )
    address = lambda h: decode_entities(strip(F.regexp_replace(h, "\\A[\"']|[\"']\\z", "")))
    known_base = F.struct(col(base).alias("url"), base_parts(base).alias("parts"))
    resolved = let(
        known_base,
        lambda b: F.transform(
            hrefs, lambda h: let(address(h), lambda a: join_to(b["url"], b["parts"], a))
        ),
    )
    return F.filter(resolved, is_web_link)


@reusable
def html_links(html, url) -> Column:
    """Links of a page, relative ones resolved against its base URL."""
    return links_of(html, base_url(html, url))
