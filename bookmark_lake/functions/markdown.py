"""Markdown descriptions: a rewriting chain to HTML for the usual block and inline marks."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import html_snippet_text, links_of
from .values import col, let

# Ordered rewriting steps. Block marks become elements on paragraphs of their own,
# then inline marks become elements inside them.
_LINES = [
    (r"\r\n?", "\n"),
    # Rules before list items: "* * *" is no item.
    (r"(?m)^ {0,3}(?:(?:\*[ \t]*+){3,}+|(?:-[ \t]*+){3,}+|(?:_[ \t]*+){3,}+)$", "\n\n<hr>\n\n"),
    (r"(?m)^(?![ \t]*[-*+#>])(?=.*\S)(.*+)\n=++[ \t]*+$", "\n\n<h1>$1</h1>\n\n"),
]
_HEADINGS = [
    (rf"(?m)^#{{{n}}}[ \t]*([^#\n].*?)[ \t]*#*[ \t]*$", f"\n\n<h{n}>$1</h{n}>\n\n")
    for n in range(6, 0, -1)
]
_BLOCKS = [
    (r"(?m)^ {0,3}>[ \t]?(.*)$", "<q1>$1</q1>"),
    (r"</q1>\n<q1>", "\n"),
    (r"<q1>", "\n\n<blockquote>\n<p>"),
    (r"</q1>", "</p>\n</blockquote>\n\n"),
    (r"(?m)^ {0,3}[-*+][ \t]+(.*)$", "<u1>$1</u1>"),
    (r"(?m)^ {0,3}[0-9]+\.[ \t]+(.*)$", "<o1>$1</o1>"),
    (r"</([uo])1>\n+<\1(?=1>)", "</$1$1>\n<$1$1"),
    (r"(?<=\A|\n)<([uo])1>", "\n\n<$1l>\n<li>"),
    (r"</([uo])1>(?=\n|\z)", "</li>\n</$1l>\n\n"),
    (r"</[uo]{2}>\n<[uo]{2}1>", "</li>\n<li>"),
]
# Whatever is left between blank lines is a paragraph, unless it starts a block.
_PARAGRAPHS = [
    (r"\A\s+|\s+\z", ""),
    (r"\n[ \t]*+(?:\n[ \t]*+)++", "\n\n"),
    (
        r"(?s)(?:(?<=\n\n)|\A)(?!</?(?:h[1-6]|hr|ul|ol|li|p|blockquote|div|pre|table)\b)"
        r"(?=[^\n])(.+?)(?=\n\n|\z)",
        "<p>$1</p>",
    ),
    (r"\n\n", "\n"),
]
# Emphasis marks inside an element's attributes are part of an address.
_OUTSIDE_TAG = "(?![^<>]*>)"
_INLINE = [
    (r"(`+)(?!`)(.+?)(?<!`)\1(?!`)", "<code>$2</code>"),
    (r"!\[([^\]]*)\]\(\s*<?([^)\s>]*)>?[^)]*\)", '<img alt="$1" src="$2">'),
    (r"\[((?:[^\[\]]++|\[[^\[\]]*+\])*+)\]\(\s*<?([^)\s>]*)>?(?:\s+[^)]*)?\)", '<a href="$2">$1</a>'),
    (rf"\*\*(?=\S)([^*]+?)(?<=\S)\*\*{_OUTSIDE_TAG}", "<strong>$1</strong>"),
    (rf"(?<![\w_])__(?=\S)([^_]+?)(?<=\S)__(?![\w_]){_OUTSIDE_TAG}", "<strong>$1</strong>"),
    (rf"\*(?=[^\s*])([^*\n]+?)(?<=\S)\*{_OUTSIDE_TAG}", "<em>$1</em>"),
    (rf"(?<![\w_])_(?=[^\s_])([^_\n]+?)(?<=\S)_(?![\w_]){_OUTSIDE_TAG}", "<em>$1</em>"),
    # Last, so that marks inside a bare address stay part of it.
    (r"<((?:https?|ftp)://[^\s>]+)>", '<a href="$1">$1</a>'),
    (r"<([^\s@<>:/]+@[^\s@<>]+\.[^\s@<>]+)>", '<a href="mailto:$1">$1</a>'),
]
# A backslash takes the meaning from a mark; as a character reference it stays text.
_ESCAPES = [(rf"\\\{mark}", f"&#{ord(mark)};") for mark in "\\`*_{}[]()#+.!-"]


def markdown_to_html(c) -> Column:
    rewritten = lambda text, steps: reduce(lambda t, step: F.regexp_replace(t, *step), steps, text)
    plain = let(
        c, lambda t: F.when(F.contains(t, F.lit("\\")), rewritten(t, _ESCAPES)).otherwise(t)
    )
    return rewritten(plain, _LINES + _HEADINGS + _BLOCKS + _PARAGRAPHS + _INLINE)


def md_text(c) -> Column:
    """Plain text of a Markdown document on one line."""
    return html_snippet_text(markdown_to_html(c))


def md_links(c, base) -> Column:
    """Absolute web links of a Markdown document; none for NULL or ''."""
    empty = F.array().cast("array<string>")
    c = col(c)
    return F.when(c.isNull() | (c == ""), empty).otherwise(links_of(markdown_to_html(c), base))
