"""Byte, word and hash arrays over whole Arrow text columns, and packed blocks for the shuffle.

Everything here is vectorised over a slice of a record batch. A slice holds at most ``SLICE``
bytes of text, or one row where a text is longer, so the memory of a task depends on the longest
text and not on the table.
"""

import ctypes
import gc
import math
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.generations import delete
from ..session import work_folder

SLICE = 512 << 10
U64 = np.uint64

_BASE = 0x9E3779B97F4A7C17  # odd, and 3 mod 4
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = (np.ones(1, U64), np.ones(1, U64))


def mix(x):
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _power(n):
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * len(_powers[0]))
        rows = []
        for base in (_BASE, _INVERSE):
            row = np.full(size, base, U64)
            row[0] = 1
            rows.append(np.multiply.accumulate(row))
        _powers = tuple(rows)
    return _powers


class Hashes:
    """Polynomial hashes mod 2**64 of any slices of an array of 64-bit codes."""

    def __init__(self, codes):
        power, self.inverse = _power(len(codes))
        self.sum = np.zeros(len(codes) + 1, U64)
        np.cumsum(codes * power[: len(codes)], out=self.sum[1:])

    def of(self, start, end):
        size = np.asarray(end - start).astype(U64)
        return mix((self.sum[end] - self.sum[start]) * self.inverse[start] + size * U64(0xD6E8FEB86659FD93))


def byte_table(members):
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: Bytes of words that only white space ends: everything but space, tab to carriage return.
SPACED = ~byte_table([0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def text_bytes(column):
    """(bytes, offsets) of a text column as UTF-8; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data, offsets, table):
    """(start, end, row) of the maximal runs of the table's bytes; none crosses a row."""
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, rows_of(start, offsets)


def rows_of(places, offsets):
    """The row of each of the ascending places."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(places, offsets)))


def counts_of(row, n):
    return np.bincount(row, minlength=n).astype(np.int64)


def slices(batches, text="text", limit=SLICE):
    """Slices of the batches with at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def fields(ddl):
    return T._parse_datatype_string(ddl).fields


#: Rows and bytes that Spark and Python exchange at a time, where the session keeps Spark's default.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(df):
    """``df``, in a session that exchanges texts and blocks with Python in small batches.

    Spark's defaults, 10,000 rows and many MB, make a batch of tens of MB, held several times.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    return df


def give_back():
    """What a task has held goes back to the system: the worker stays for tasks of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_texts(df, function, new, keep=None, text="text"):
    """``df`` with the columns ``function(slice)`` makes of each slice of rows.

    ``new`` is their DDL; ``keep`` names the columns that stay (all by default). A new column
    replaces one of the same name, in any case of letters.
    """
    made = fields(new)
    names = {f.name.lower() for f in made}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    schema = T.StructType([df.schema[c] for c in keep] + made)
    # what Python gets is renamed, so that a table's own names cannot clash with the text's
    inner = small_batches(df).select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), F.col(text).alias("text"))

    def run(batches):
        for part in slices(batches):
            arrays = [part.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*arrays, *function(part)], names=schema.names)
        give_back()

    return inner.mapInArrow(run, schema)


def text_total(df, text="text"):
    return df.select(F.sum(F.octet_length(text))).first()[0] or 0


def shard_count(df, each=32 << 20, text="text"):
    """Shards for a shuffle of a table of texts: more with the text, so that one fits into a task."""
    least = int(small_batches(df).sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(text_total(df, text) / each))


def shard_of(hashes, shards):
    return (hashes >> U64(33)).astype(np.int64) % shards


BLOCKS = "shard int, block binary"


def block_rows(pairs):
    """Record batches of (shard, bytes) pairs, each of ``BATCH_BYTES`` or one pair more."""
    ids, packed, held = [], [], 0

    def batch():
        arrays = [pa.array(np.array(ids, np.int32)), pa.array(packed, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["shard", "block"])

    for shard, block in pairs:
        ids.append(shard)
        packed.append(block)
        held += len(block)
        if held >= BATCH_BYTES:
            yield batch()
            ids, packed, held = [], [], 0
    if ids:
        yield batch()


def pack(kind, key, columns, shards):
    """(shard, bytes) of rows dealt by ``key``: kind and count, then column by column.

    A column is an array, or a function that gives the bytes of the chosen rows.
    """
    shard = shard_of(key, shards)
    order = np.argsort(shard, kind="stable")
    bound = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(bound[1:] > bound[:-1]):
        own = order[bound[s] : bound[s + 1]]
        head = np.array([kind, len(own)], np.int64)
        yield s, b"".join([head.tobytes(), *(c(own) if callable(c) else c[own].tobytes() for c in columns)])


def unpack(table, **kinds):
    """For each kind of block of a shard: its columns, and what follows them, as arrays.

    ``kinds`` gives the column types by name, in the order of the blocks' kind numbers.
    """
    types = list(kinds.values())
    columns = [[[np.zeros(0, t)] for t in own] for own in types]
    rest = [[np.zeros(0, np.uint8)] for _ in types]
    for block in table.column("block"):
        raw = block.as_buffer()
        kind, n = np.frombuffer(raw, np.int64, 2)
        at = 16
        for column in columns[kind]:
            column.append(np.frombuffer(raw, column[0].dtype, n, at))
            at += column[-1].nbytes
        rest[kind].append(np.frombuffer(raw, np.uint8, offset=at))
    return {
        name: ([np.concatenate(c) for c in own], np.concatenate(tail))
        for name, own, tail in zip(kinds, columns, rest, strict=True)
    }


class Lookup:
    """Places of 64-bit keys in a sorted array: a table by their first bits, then the few keys there."""

    BITS = 20

    def __init__(self, keys):
        self.keys = keys
        self.first = np.searchsorted(keys >> U64(64 - self.BITS), np.arange((1 << self.BITS) + 1)).astype(np.int32)

    def find(self, keys):
        """The place of each key, or -1."""
        found = np.full(len(keys), -1, np.int64)
        bucket = (keys >> U64(64 - self.BITS)).astype(np.int64)
        at, stop = self.first[bucket], self.first[bucket + 1]
        live = np.flatnonzero(at < stop)
        while len(live):
            here = at[live]
            same = self.keys[here] == keys[live]
            found[live[same]] = here[same]
            live = live[~same]
            at[live] += 1
            live = live[at[live] < stop[live]]
        return found


#: Bits of a sieve; larger sets only let more rows pass it.
SIEVE_BITS = 1 << 25


def row_key():
    """Tells rows apart by doc_id and text, a null one too; equal rows share it."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("doc_id").isNull(), F.col("text"))


def sieve(ids: DataFrame, key=None):
    """A function that adds ``likely`` to a table: whether a row's key, or doc_id, may be among ``ids``.

    It is a Bloom filter of fixed size over the one column of ``ids``, so it fits every task, and it
    spares most other rows the shuffle to the exact join that must follow.
    """
    place = F.pmod(F.xxhash64(F.col(ids.columns[0])), F.lit(SIEVE_BITS)).alias("place")
    word = ids.select(place).groupBy((F.col("place") / 64).cast("long").alias("word"))
    word = word.agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
    bits = np.zeros(SIEVE_BITS // 64, np.int64)
    for batch in word.toArrow().to_batches():  # SIEVE_BITS / 64 rows at most
        bits[np.asarray(batch.column("word"))] = np.asarray(batch.column("bits"))
    shared = ids.sparkSession.sparkContext.broadcast(bits)

    def marked(df):
        schema = T.StructType([*df.schema.fields, T.StructField("likely", T.BooleanType())])
        own = F.col("doc_id").cast("long") if key is None else key
        at = F.pmod(F.xxhash64(own), F.lit(SIEVE_BITS)).alias("likely")

        def run(batches):
            for batch in batches:
                at = np.asarray(batch.column(batch.num_columns - 1))
                likely = pa.array((shared.value[at // 64] >> (at % 64)) & 1 == 1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], likely], names=schema.names)

        return small_batches(df).select("*", at).mapInArrow(run, schema)

    return marked


def runs(ordered):
    """(start, size) of the runs of equal values in a sorted array."""
    if not len(ordered):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return start, np.diff(np.concatenate((start, [len(ordered)])))


def expand(start, size):
    """All numbers of the ranges ``start .. start + size``, one range after another."""
    size = np.asarray(size, np.int64)
    first = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size
    return np.arange(int(size.sum()), dtype=np.int64) + np.repeat(np.asarray(start, np.int64) - first, size)


_scopes = []


def stored(df, label):
    """``df`` written to the shared folder and read again: later jobs start from the files."""
    path = work_folder(df.sparkSession, label)
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop_stored(*tables):
    """Delete the files of stored tables that nothing reads any more."""
    for table in tables:
        delete(table.sparkSession, table.stored_at)


@contextmanager
def only(spark):
    """At the end of the block its stored tables are deleted, but for those given to what it yields.

    The driver then collects its garbage: Spark deletes shuffle files and broadcasts when nothing on
    the driver refers to them any more.
    """
    kept = []

    def keep(table):
        kept.append(table.stored_at)
        return table

    _scopes.append([])
    try:
        yield keep
    finally:
        made = _scopes.pop()
        if _scopes:
            _scopes[-1].extend(kept)
        for path in made:
            if path not in kept:
                delete(spark, path)
        gc.collect()
        spark.sparkContext._jvm.System.gc()
