"""Streaming ingest and frontier."""

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.frontier import KEYS
from ..operators.merge import add_batch, compact_items, upsert_items
from ..plans.ingest import KINDS, compact_crawl, ingest

#: Micro-batches after which what they have stored is folded.
COMPACT_EVERY = 32
# Spark's own state store on local disk, with its changes in the checkpoint: state may exceed memory.
_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _name(checkpoint, number):
    """The name of a stream's micro-batch: the same when it is replayed."""
    return f"{zlib.crc32(checkpoint.encode()):08x}-{number:012d}"


def _due(number, compact_every):
    return compact_every and (number + 1) % compact_every == 0


def stream_fragments(fragments: DataFrame, index_path, checkpoint, compact_every=COMPACT_EVERY) -> DataStreamWriter:
    """Writer that merges arriving fragments into the stored item table.

    Every micro-batch adds its own merged versions under its name, so a batch replayed after a
    failure is known and adds nothing. After every ``compact_every`` batches the stored ones are folded.
    """

    def apply(batch, number):
        upsert_items(batch, index_path, _name(checkpoint, number))
        if _due(number, compact_every):
            compact_items(batch.sparkSession, index_path)

    return fragments.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)


def stream_ingest(
    responses: DataFrame, index_path, checkpoint, sources=None, crawl_path=None, rules=None, compact_every=COMPACT_EVERY
) -> DataStreamWriter:
    """Writer that parses, enriches and merges arriving responses.

    With ``crawl_path`` the requests they lead to are routed and stored as well, as the batch job
    does; ``plans.ingest.read_frontier`` gives those still open. Items and the state of the crawl
    are folded after every ``compact_every`` batches.
    """

    def apply(batch, number):
        # Read once per kind present: kept for the time of the batch.
        batch.persist()
        try:
            known = batch.filter(F.col("kind").isin(KINDS)).select("kind").distinct()
            kinds = [r["kind"] for r in known.collect()]  # KINDS at most
            ingest(batch, index_path, sources, rules, crawl_path, kinds, batch=_name(checkpoint, number))
        finally:
            batch.unpersist()
        if _due(number, compact_every):
            compact_items(batch.sparkSession, index_path)
            if crawl_path is not None:
                compact_crawl(batch.sparkSession, crawl_path)

    return responses.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)


def stream_frontier(requests: DataFrame, crawl_path, checkpoint, compact_every=COMPACT_EVERY) -> DataStreamWriter:
    """Writer that adds each arriving routed request to the stored ones once, when it comes first.

    Spark keeps the keys seen as state of the stream, in RocksDB: a batch looks up its own keys, so
    its cost does not follow the history, and a request that comes again, however late, is known.
    The state store is set for the session, for streams that start after this call.
    """
    requests.sparkSession.conf.set(_STATE_STORE, _ROCKSDB)

    def apply(batch, number):
        add_batch(batch, f"{crawl_path}/requests", name=_name(checkpoint, number))
        if _due(number, compact_every):
            compact_crawl(batch.sparkSession, crawl_path)

    first = requests.dropDuplicates(KEYS)
    return first.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
