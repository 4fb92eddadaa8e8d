"""Benchmark decontamination: Wu-Manber search for every window of the benchmark.

The letters of the search are words. For the windows of each length there is a shift table over
blocks of two words (how far the search may jump when it stands on that block) and buckets of
windows by the hash of their last block. A text is read in lanes that jump side by side; where
the shift is 0, the bucket's windows are compared, first by hash, then word by word.

Nulls and texts without words have no words and no hits. A row's doc_id may be null or repeated:
each row gets its own result. Items without words or with null text never occur.
"""

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import (
    BYTE_CODE,
    LOWER,
    U64,
    Hashes,
    byte_table,
    counts_of,
    expand,
    fields,
    map_texts,
    mix,
    runs,
    slices,
    text_bytes,
    text_total,
    words,
)

#: Bytes of a word: 0-9, a letter, and everything beyond ASCII.
ALNUM = ~byte_table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: A benchmark is held in memory in blocks of at most so many bytes of text; the tables take about eight times that.
BLOCK_BYTES = 16 << 20
LANE = 256
FOUND = "n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<string>"

def _folded(column):
    data, offsets = text_bytes(column)
    data = LOWER[data]
    start, end, row = words(data, offsets, ALNUM)
    return data, start, end, row


def _block(word, at, size):
    """Hash of the block of ``size`` words that ends at each position."""
    h = word[at].copy()
    if size == 2:
        h += word[at - 1] * U64(0x9E3779B97F4A7C15)
    return mix(h)


class Patterns:
    """Tables for the windows of one length; a window is its first word among those of all items.

    Equal windows of an item are one. What a window takes is two numbers, beside the text itself.
    """

    def __init__(self, length, benchmark, first, item):
        self.length, self.block = length, min(2, length)
        self.benchmark = benchmark
        word = benchmark.word
        whole = benchmark.chain.of(first, first + length)
        order = np.lexsort((item, whole))
        order = order[np.concatenate(([True], (np.diff(whole[order]) != 0) | (np.diff(item[order]) != 0)))]
        self.whole, self.first, self.item = whole[order], first[order].astype(np.int32), item[order].astype(np.int32)
        # windows overlap, so there are about as many blocks as words
        bits = max(10, math.ceil(math.log2(8 * len(word) + 1)))
        self.mask = U64((1 << bits) - 1)
        self.shift = np.full(1 << bits, min(length - self.block + 1, 255), np.uint8)
        for at in range(self.block - 1, length):  # the shift falls from step to step: the last one written is the least
            h = _block(word, first + at, self.block) & self.mask
            self.shift[h.astype(np.int64)] = min(length - 1 - at, 255)
        self.bucket = np.unique(_block(word, first + length - 1, self.block))

    def ends(self, word, row):
        """(last word, first entry, entry behind) of the windows whose hash is a pattern's."""
        n = len(word)
        none = np.zeros(0, np.int64)
        if n < self.length:
            return none, none, none
        first = np.arange(0, n, LANE)
        at, stop = np.maximum(first, self.length - 1), np.minimum(first + LANE, n)
        found = []
        while True:
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
            if not len(at):
                break
            h = _block(word, at, self.block)
            jump = self.shift[(h & self.mask).astype(np.int64)]
            zero = jump == 0
            if zero.any():
                maybe, tail = at[zero], h[zero]
                slot = np.minimum(np.searchsorted(self.bucket, tail), len(self.bucket) - 1)
                found.append(maybe[self.bucket[slot] == tail])
            at = at + np.maximum(jump, 1)
        at = np.concatenate(found) if found else none
        at = at[row[at] == row[at - self.length + 1]]
        if not len(at):
            return none, none, none
        whole = Hashes(word).of(at - self.length + 1, at + 1)
        low, high = np.searchsorted(self.whole, whole), np.searchsorted(self.whole, whole, "right")
        hit = high > low
        return at[hit], low[hit], high[hit]

    def items_of(self, window, low, high):
        """Numbers of the items among these entries that have the window, compared byte by byte."""
        text, at = self.benchmark.text, self.benchmark.start
        for entry in range(low, high):
            begin = at[self.first[entry]]
            if text[begin : begin + len(window)].tobytes() == window:
                yield int(self.item[entry])


class Benchmark:
    """The words of all items, joined by single spaces, and the tables of their windows."""

    def __init__(self, items, length):
        """``items`` is an Arrow table (item_id, text); its texts are read in slices."""
        self.ids, held, size = [], [], 0
        for part in slices(items.to_batches()):
            data, start, end, row = _folded(part.column("text"))
            count = end - start
            place = np.cumsum(count + 1) - (count + 1)
            text = np.full(int((count + 1).sum()), 0x20, np.uint8)
            text[expand(place, count)] = data[expand(start, count)]
            word = Hashes(BYTE_CODE[text]).of(place, place + count)
            held.append((text, place + size, word, counts_of(row, part.num_rows)))
            self.ids += part.column("item_id").to_pylist()
            size += len(text)
        held = held or [(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64))]
        self.text, self.start, self.word, total = (np.concatenate(c) for c in zip(*held, strict=True))
        self.chain = Hashes(self.word)
        first, short = np.cumsum(total) - total, np.minimum(total, length)
        self.patterns = []
        for k in np.unique(short[short > 0]):
            own = np.flatnonzero(short == k)
            many = total[own] - k + 1
            self.patterns.append(Patterns(int(k), self, expand(first[own], many), np.repeat(own, many)))
        del self.word, self.chain  # what only building needs


def _word_counts(part):
    row = _folded(part.column(part.num_columns - 1))[3]
    return pa.array(counts_of(row, part.num_rows))


def _search(part, benchmark):
    data, start, end, row = _folded(part.column(part.num_columns - 1))
    n = part.num_rows
    word = Hashes(BYTE_CODE[data]).of(start, end)
    cover = np.zeros(len(word) + 1, np.int64)
    items = [set() for _ in range(n)]
    for p in benchmark.patterns:
        for at, low, high in zip(*p.ends(word, row), strict=True):
            first = at - p.length + 1
            own = zip(start[first : at + 1], end[first : at + 1], strict=True)
            found = {benchmark.ids[i] for i in p.items_of(b" ".join(data[s:e].tobytes() for s, e in own), low, high)}
            if found:
                items[row[at]] |= found
                cover[first] += 1
                cover[at + 1] -= 1
    hit = np.cumsum(cover[:-1]) > 0
    total = counts_of(row, n)
    first = np.cumsum(total) - total
    spans = [[] for _ in range(n)]
    where = np.flatnonzero(hit)
    if len(where):
        # a span is a run of hit words of one row
        begin, size = runs(where - np.arange(len(where)) + row[where] * (len(word) + 1))
        for b, k in zip(where[begin], size, strict=True):
            r = row[b]
            spans[r].append({"start": int(b - first[r]), "end": int(b - first[r] + k)})
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return [
        pa.array(total),
        pa.array(counts_of(row[hit], n)),
        pa.array(spans, kind),
        pa.array([sorted(i, key=lambda x: (x is None, x)) for i in items], pa.list_(pa.string())),
    ]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, length=10, keep=None, block_bytes=BLOCK_BYTES) -> DataFrame:
    """Rows of ``docs`` with n_words, n_hit, the hit spans of words, and the items found.

    The benchmark is the stated query set: it is read in blocks of at most about
    ``block_bytes`` of text, each searched for in one pass over the documents. Beyond one
    block the items of the passes are merged by row, and their spans may overlap. Items without an
    id are searched for as well and are one item, null, the last in order.
    """
    items = benchmark.select("item_id", "text").filter("text is not null")
    n_blocks = max(1, math.ceil(text_total(items) / block_bytes))
    sc = docs.sparkSession.sparkContext

    def scan(df, block, keep):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block)
        tables = sc.broadcast(Benchmark(part.select(F.col("item_id").cast("string").alias("item_id"), "text").toArrow(), length))
        return map_texts(df, lambda rows: _search(rows, tables.value), FOUND, keep)

    if n_blocks == 1:
        return scan(docs, 0, keep)
    keep = list(docs.columns if keep is None else keep)
    kept = [c for c in keep if c.lower() not in {f.name for f in fields(FOUND)}]
    # each block's hits are the rows of one pass; rows are told apart by doc_id and text
    keyed = docs.withColumn("benchmark_row", F.xxhash64("doc_id", "text"))
    hits = [scan(keyed, b, ["benchmark_row"]).filter("n_hit > 0").select("benchmark_row", "spans", "items") for b in range(n_blocks)]
    merged = reduce(DataFrame.unionByName, hits).groupBy("benchmark_row").agg(
        F.flatten(F.collect_set("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    counted = map_texts(keyed, lambda rows: [_word_counts(rows)], "n_words long", [*kept, "benchmark_row"])
    hit = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1)))
    return counted.join(merged, "benchmark_row", "left").select(
        *(F.col(f"`{c}`") for c in kept),
        "n_words",
        F.coalesce(F.size(F.array_distinct(hit)), F.lit(0)).cast("long").alias("n_hit"),
        *(F.coalesce(F.col(f.name), F.array().cast(f.dataType)).alias(f.name) for f in fields(FOUND)[2:]),
    )


def items_digest(items):
    """SHA-256 of the sorted item ids, comma-joined, without null."""
    return F.sha2(F.array_join(items, ","), 256)
