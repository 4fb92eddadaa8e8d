"""Streaming runs over files written from the given tables; the results equal the batch ones."""

import math

from ..operators.merge import read_items
from ..plans.ingest import read_frontier
from ..session import work_folder
from ..streaming.ingest import stream_fragments, stream_frontier, stream_ingest
from .registry import check, joined
from .sources import POST_URL_A, POST_URL_B, tweet_responses
from .tables import EVENT_SOURCE, EVENT_URL, SQL_MERGED_EVENTS, event_fragments, event_requests, flat_items

# Files that arrive, more of them where each would hold more than FILE_ROWS rows.
FILES = 6
FILE_ROWS = 100_000


def _arriving(df, key, folder, at_once):
    """``df`` as a stream of files; a micro-batch takes ``at_once`` of every FILES."""
    times = max(1, math.ceil(df.count() / (FILES * FILE_ROWS)))
    df.repartition(FILES * times, key).write.parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", at_once * times).parquet(folder)


def _run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


@check("stream_merge", SQL_MERGED_EVENTS)
def stream_merge(spark, sf_dir):
    """Events in several files, one micro-batch per two files, merged into the stored table."""
    folder = work_folder(spark, "stream_merge")
    arriving = _arriving(event_fragments(spark, sf_dir), "seq", f"{folder}/in", 2)
    _run(stream_fragments(arriving, f"{folder}/items", f"{folder}/checkpoint"))
    return flat_items(read_items(spark, f"{folder}/items"))


@check(
    "stream_ingest",
    f"SELECT {POST_URL_A} AS url, event_type || ' seen' AS content, (2000 + user_id % 20) || '-05-15T12:55:25' AS last_update, "
    "event_type || '|Liked' AS twitter_tags FROM events WHERE event_type <> 'purchase' "
    f"UNION ALL SELECT {POST_URL_B}, props, NULL, NULL FROM events WHERE event_type <> 'purchase'",
)
def stream_ingest_tweets(spark, sf_dir):
    """Liked posts as arriving responses: parse, enrich, merge."""
    folder = work_folder(spark, "stream_ingest")
    arriving = _arriving(tweet_responses(spark, sf_dir), "seq", f"{folder}/in", 3)
    _run(stream_ingest(arriving, f"{folder}/items", f"{folder}/checkpoint"))
    items = read_items(spark, f"{folder}/items")
    return items.select("url", "content", "last_update", joined("twitter_tags").alias("twitter_tags"))


@check("stream_frontier", f"SELECT DISTINCT {EVENT_SOURCE} AS source, {EVENT_URL} AS url FROM events")
def stream_frontier_events(spark, sf_dir):
    """Requests in several files and no order of time: every first request counts, however late."""
    folder = work_folder(spark, "stream_frontier")
    arriving = _arriving(event_requests(spark, sf_dir), "parent_seq", f"{folder}/in", 2)
    _run(stream_frontier(arriving, f"{folder}/crawl", f"{folder}/checkpoint"))
    return read_frontier(spark, f"{folder}/crawl").select("source", "url")
