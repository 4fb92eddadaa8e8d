"""What Spark and Python exchange at a time stays small."""

import pyarrow as pa
import pytest

pytest.importorskip("bookmark_lake.llm.checks")
from bookmark_lake.llm import arrays  # noqa: E402


def test_blocks_leave_in_small_batches():
    pairs = [(s, bytes([s]) * (3 << 20)) for s in range(8)]
    batches = list(arrays.block_rows(iter(pairs)))
    assert [b.num_rows for b in batches] == [2, 2, 2, 2]  # before, one batch of 24 MB
    assert [(r["shard"], r["block"]) for b in batches for r in b.to_pylist()] == pairs
    assert not list(arrays.block_rows([]))


def test_blocks_of_a_group_arrive_in_small_batches(spark):
    session = spark.newSession()

    def blocks(batches):
        for batch in batches:
            pairs = ((0, bytes([i]) * (1 << 20)) for i in batch.column(0).to_pylist())
            yield from arrays.block_rows(pairs)

    def parts(table):
        chunks = table.column("block").chunks
        largest = max(sum(len(v.as_buffer()) for v in c) for c in chunks)
        values = sorted(v.as_buffer()[0] for c in chunks for v in c)
        return pa.table({"n": pa.array([len(values)], pa.int64()), "same": [values == list(range(40))], "largest": pa.array([largest], pa.int64())})

    numbers = arrays.small_batches(session.range(40, numPartitions=2))
    got = numbers.mapInArrow(blocks, arrays.BLOCKS).groupBy("shard").applyInArrow(parts, "n long, same boolean, largest long").collect()
    assert [(r["n"], r["same"]) for r in got] == [(40, True)]
    assert got[0]["largest"] <= 2 * arrays.BATCH_BYTES  # before, 40 MB
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1000000")
    arrays.small_batches(own.range(1))
    assert own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1000000"
