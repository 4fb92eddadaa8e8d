"""Tags and publication dates of items that have a page."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metadata import article_published_date, article_tags, extract_metadata
from ..functions.values import non_empty


def enrich(fragments: DataFrame, metadata=None) -> DataFrame:
    """Set article_tags and article_published_date where ``url`` and ``html`` are there.

    Metadata is read from the page, or taken from the column ``metadata``. The two
    results are independent, and a page that cannot be read gets NULLs.
    """
    applies = non_empty("url").isNotNull() & non_empty("html").isNotNull()
    # A stage of its own: read by both results, it is computed once per page.
    found = fragments.withColumn(
        "_metadata", F.when(applies, extract_metadata("html")) if metadata is None else F.col(metadata)
    )
    return found.withColumns(
        {
            "article_tags": F.when(applies, article_tags("_metadata")).otherwise(F.col("article_tags")),
            "article_published_date": F.coalesce(
                F.when(applies, article_published_date("_metadata", "html", "url")),
                F.col("article_published_date"),
            ),
        }
    ).drop("_metadata")
