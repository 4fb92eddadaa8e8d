"""Ready-made display columns of search results."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_year
from ..functions.values import col, strip
from .search import MOST_RESULTS

# Characters kept of one value, characters of a title.
VALUE_CHARS = 64
TITLE_CHARS = 54


def _clean(c) -> Column:
    """One display value: stripped, on one line, shortened; NULL if nothing is there."""
    value = F.replace(strip(c), F.lit("\n"), F.lit(" "))
    value = strip(F.substring(value, 1, VALUE_CHARS))
    return F.when(value != "", value)


def display_value(*columns) -> Column:
    """First value with something in it, '' if none has."""
    return F.coalesce(*[_clean(c) for c in columns], F.lit(""))


def shorten(c, limit=TITLE_CHARS) -> Column:
    """Whole words up to ``limit`` characters, … on the last one kept."""
    c = col(c)
    words = F.filter(F.transform(F.split(c, " ", -1), lambda w: strip(w)), lambda w: w != "")
    line = F.array_join(words, " ")
    kept = F.regexp_extract(line, rf"(?s)\A(.{{1,{limit}}}) ", 1)
    # A first word longer than the line is cut.
    cut = F.when(kept != "", kept).otherwise(F.substring(line, 1, limit))
    return F.when(F.length(c) <= limit, c).when(F.length(line) <= limit, line).otherwise(
        F.concat(cut, F.lit("…"))
    )


def display_title(name, description, content) -> Column:
    """Name, description and content joined until the title is long enough, then shortened."""
    title = F.coalesce(_clean(name), F.lit(""))
    for c in (description, content):
        value = _clean(c)
        longer = (
            F.when(value.isNull(), title)
            .when(title == "", value)
            .otherwise(F.concat(title, F.lit(" - "), value))
        )
        title = F.when(F.length(title) >= TITLE_CHARS, title).otherwise(longer)
    return shorten(title)


def display_year(*columns) -> Column:
    return date_year(display_value(*columns))


def display_line(year, score, is_standout, title, url) -> Column:
    """(year) score★ title: url"""
    icon = F.when(col(is_standout), F.lit("★")).otherwise(F.lit(""))
    return F.format_string("(%s) %3.1f%s %s: %s", col(year), col(score), icon, col(title), col(url))


def present(result: DataFrame, items: DataFrame) -> DataFrame:
    """RESULT rows with title, year and line, worst first so that the best ends the list.

    The rows of a search are few (search.MOST_RESULTS at most) and come to the driver. Their URLs go
    as a filter below the merge of the items and into its scan: over files ranged by URL it reads the
    row groups that can hold them, not all content. Titles are made for the rows shown.
    """
    rows = result.collect()
    if len(rows) > MOST_RESULTS:
        raise ValueError(f"a search returns {MOST_RESULTS} rows at most")
    shown = result.sparkSession.createDataFrame(rows, result.schema)
    found = items.filter(F.col("url").isin([r["url"] for r in rows]))
    return (
        found.join(F.broadcast(shown), "url")
        .withColumns(
            {
                "title": display_title("name", "description", "content"),
                "year": display_year("last_update", "article_published_date"),
            }
        )
        .withColumn("line", display_line("year", "score", "is_standout", "title", "url"))
        .select("rank", "url", "score", "is_standout", "title", "year", "line", "total_hits")
        .orderBy(F.col("rank").desc())
    )
