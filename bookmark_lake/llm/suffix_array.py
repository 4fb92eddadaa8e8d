"""Suffix-array dedup: maximal repeats by the common-prefix interval tree of enhanced suffix arrays.

Every string of ``size`` bytes has an anchor, the start of its smallest 32-byte hash, so equal
strings meet at the same anchor. The suffixes that start at anchors are dealt into groups which
share a key: the anchor's bytes and half a string before it (for strings that lie mostly before
their anchor) or after it (for the others). In each group

* the suffixes are sorted with their common prefixes: an enhanced suffix array;
* a stack scan yields the tree of intervals with a common prefix;
* in each interval the texts before the anchor are sorted too. If they are diverse, the branches
  that agree further to the left make longer repeats of their own; otherwise the interval is one
  maximal repeat. Every member gets its span, not only neighbours.

Two passes over the texts: the first finds keys that occur twice; the second sends the text around
those anchors only. In both, a task folds identical surroundings before the shuffle (their strings
repeat for certain), so copies of one text or passage reach a group once per task.

A key with more than ``GROUP_ROWS`` entries (a passage shorter than a string in very many texts) makes
no group: each string of its entries is dealt by its own hash, and equal strings are repeats.

Keys are 64-bit hashes; repeats themselves are compared byte by byte, except that folding trusts a
64-bit hash, and the strings of such a key are told apart by two. Texts are UTF-8 bytes; a null is empty. Rows are told apart by doc_id and text: an
exactly repeated row repeats all its strings and loses them.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import (
    BLOCKS,
    BYTE_CODE,
    U64,
    Hashes,
    block_rows,
    expand,
    fields,
    map_texts,
    mix,
    pack,
    runs,
    shard_count,
    slices,
    text_bytes,
    unpack,
)

GRAM = 32
_SPAN, _ENTRY, _STRING = 0, 1, 2  # what a block holds; of a place, _STRING marks an entry of a large key
PLACES = "row_key long, kind int, at int, low int, high int"
#: A task folds its entries in portions of so many.
PORTION = 400_000
#: Rows of groups that are compared at a time; a larger group is dealt by its strings.
GROUP_ROWS = 40_000


def _window_min(values, width):
    """The smallest of each ``width`` values in a row: block-wise running minima from both sides."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(U64).max, U64)
    padded[:n] = values
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _anchors(data, offsets, size):
    """(anchor, low, high) of runs of strings: those with low..high bytes before the anchor; and hashes."""
    chain = Hashes(BYTE_CODE[data])
    none = np.zeros(0, np.int64)
    if len(data) < size:
        return none, none, none, chain
    n = len(data) - GRAM + 1
    gram = mix((chain.sum[GRAM : GRAM + n] - chain.sum[:n]) * chain.inverse[:n])
    bits = U64((1 << int(n).bit_length()) - 1)
    at = (_window_min((gram & ~bits) | np.arange(n, dtype=U64), size - GRAM + 1) & bits).astype(np.int64)
    # strings that cross the end of a text are none
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, np.maximum(offsets[:-1], offsets[1:] - size + 1), 1)
    np.add.at(edge, offsets[1:], -1)
    start = np.flatnonzero(np.cumsum(edge[: len(at)]) == 0)
    if not len(start):
        return none, none, none, chain
    anchor = at[start]
    cut = np.flatnonzero((np.diff(start) != 1) | (np.diff(anchor) != 0)) + 1
    first = np.concatenate(([0], cut))
    last = np.concatenate((cut, [len(start)])) - 1
    anchor = anchor[first]
    low, high = anchor - start[last], anchor - start[first]
    half = (size - GRAM) // 2
    before, after = high >= half, low < half
    return (
        np.concatenate((anchor[before], anchor[after])),
        np.concatenate((np.maximum(low[before], half), low[after])),
        np.concatenate((high[before], np.minimum(high[after], half - 1))),
        chain,
    )


def _keys(chain, anchor, low, size):
    half = (size - GRAM) // 2
    before = low >= half
    start = np.where(before, anchor - half, anchor)
    return mix(chain.of(start, start + half + GRAM) + before.astype(U64))


def _folded(key, at, low, high, body):
    """Rows to send, and rows whose surroundings another row of the portion repeats."""
    same = mix(key ^ mix(body + low.astype(U64) * U64(1 << 20) + high.astype(U64)))
    order = np.argsort(same, kind="stable")
    begin, count = runs(same[order])
    return order[begin], order[expand(begin[count > 1], count[count > 1])]


def _send(key, row_key, at, low, high, body, shards, size, text=None):
    """Blocks of a portion: spans that are repeats for certain, and one entry of each surrounding."""
    send, again = _folded(key, at, low, high, body)
    spans = row_key[again], (at - high)[again].astype(np.int32), (at - low + size)[again].astype(np.int32)
    yield from pack(_SPAN, mix(spans[0].astype(U64)), spans, shards)
    entry = [key[send], row_key[send], *(c[send].astype(np.int32) for c in (at, low, high))]
    if text is not None:
        data, place = text
        start, length = (place - high)[send], (high - low + size)[send]
        entry.append(lambda i: data[expand(start[i], length[i])].tobytes())
    yield from pack(_ENTRY, key[send], entry, shards)


def _read(table):
    """Spans and entries of a shard's blocks, the entries' texts one after another, and strings."""
    kinds = {"spans": (np.int64, np.int32, np.int32), "entries": (U64, np.int64, np.int32, np.int32, np.int32)}
    got = unpack(table, **kinds, strings=(U64, U64, np.int64, np.int32))
    return got["spans"][0], *got["entries"], got["strings"][0]


def _places(spans, entries=None, kind=None):
    """Table of PLACES rows; ``kind`` is that of each entry."""
    row_key, start, end = spans
    columns = [row_key, np.full(len(start), _SPAN, np.int32), np.zeros(len(start), np.int32), start, end]
    if entries is not None:
        _, key, at, low, high = entries
        more = [key, kind.astype(np.int32), at, low, high]
        columns = [np.concatenate(c) for c in zip(columns, more, strict=True)]
    return pa.Table.from_arrays([pa.array(c) for c in columns], names=["row_key", "kind", "at", "low", "high"])


def _repeated(table, group_rows):
    """Entries whose key occurs more than once."""
    spans, entries, _, _ = _read(table)
    order = np.argsort(entries[0], kind="stable")
    begin, count = runs(entries[0][order])
    own = order[expand(begin[count > 1], count[count > 1])]
    large = np.repeat(count[count > 1] > group_rows, count[count > 1])
    return _places(spans, [c[own] for c in entries], np.where(large, _STRING, _ENTRY))


def _joined(row_key, start, size):
    """(row_key, start, end) of the runs of strings that start one byte after another."""
    order = np.lexsort((start, row_key))
    row_key, start = row_key[order], start[order]
    cut = np.ones(len(start), bool)
    cut[1:] = (row_key[1:] != row_key[:-1]) | (start[1:] - start[:-1] > 1)
    begin = np.flatnonzero(cut)
    last = np.concatenate((begin[1:], [len(start)]))[: len(begin)] - 1
    return row_key[begin], start[begin].astype(np.int32), (start[last] + size).astype(np.int32)


def _strings(chain, place, row_key, at, low, high, shards, size):
    """Blocks of the strings of some entries, one of each spelling, and spans of those that occur again here."""
    many = high - low + 1
    who, back = np.repeat(np.arange(len(at)), many), expand(low, many)
    start, here = place[who] - back, at[who] - back
    key, half = chain.of(start, start + size), chain.of(start, start + size // 2)
    order = np.argsort(key, kind="stable")
    begin, count = runs(key[order])
    send, again = order[begin], order[expand(begin[count > 1], count[count > 1])]
    spans = _joined(row_key[who[again]], here[again], size)
    yield from pack(_SPAN, mix(spans[0].astype(U64)), spans, shards)
    columns = (key[send], half[send], row_key[who[send]], here[send].astype(np.int32))
    yield from pack(_STRING, columns[0], columns, shards)


def _equal_strings(key, half, row_key, start, size):
    """(row_key, start, end) of the strings that occur more than once."""
    order = np.lexsort((half, key))
    same = (key[order[1:]] == key[order[:-1]]) & (half[order[1:]] == half[order[:-1]])
    again = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))] if len(order) else order
    return _joined(row_key[again], start[again], size)


def _sorted_texts(group, length, rows):
    """Order of padded texts inside their groups, and the common prefix with the one before."""
    n, width = rows.shape
    wide = np.empty((n, width + 8), np.uint8)
    wide[:, :4] = group.astype(">u4").view(np.uint8).reshape(-1, 4)
    wide[:, 4:-4] = rows
    # a text that ends comes before those that go on, even on with zeros
    wide[:, -4:] = length.astype(">u4").view(np.uint8).reshape(-1, 4)
    order = np.argsort(wide.view(f"S{width + 8}")[:, 0], kind="stable")
    return order, _common(rows[order[:-1]], rows[order[1:]], length[order[:-1]], length[order[1:]], group[order])


def _common(a, b, a_length, b_length, group=None):
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1]) if len(a) else np.zeros(0, np.int64)
    first = np.minimum(first, np.minimum(a_length, b_length))
    return first if group is None else np.where(group[1:] == group[:-1], first, -1)


def _intervals(prefix):
    """(first, last, common prefix) of the intervals of a suffix array, by a stack scan."""
    stack = []
    for i, here in enumerate([*prefix.tolist(), -1]):
        first = i
        while stack and stack[-1][1] > here:
            first, common = stack.pop()
            yield first, i, common
        if here >= 0 and (not stack or stack[-1][1] < here):
            stack.append((first, here))


def _repeats(table, size):
    """Spans of all maximal repeats of ``size`` bytes in the groups of a shard."""
    spans, (key, row_key, at, low, high), texts, strings = _read(table)
    length = (high - low + size).astype(np.int64)
    place = np.cumsum(length) - length
    order = np.argsort(key, kind="stable")
    begin, count = runs(key[order])
    begin, count = begin[count > 1], count[count > 1]
    found = [_equal_strings(*strings, size)]
    # some groups at a time, so that their padded texts fit into memory
    step = np.cumsum(count) // GROUP_ROWS
    for first, n in zip(*runs(step), strict=True):
        size_of = count[first : first + n]
        own = order[expand(begin[first : first + n], size_of)]
        columns = (row_key[own], at[own], low[own].astype(np.int64), high[own].astype(np.int64), place[own])
        found += _group_repeats(np.repeat(np.arange(n), size_of), *columns, texts, size)
    return _places([np.concatenate([s, *(f[i] for f in found)]) for i, s in enumerate(spans)])


def _padded(texts, start, count, back):
    """The texts at ``start`` as rows of bytes, turned round if ``back``."""
    rows = np.zeros((len(start), int(count.max())), np.uint8)
    at = expand(start, count)
    rows[np.arange(rows.shape[1]) < count[:, None]] = texts[np.repeat(2 * start + count - 1, count) - at if back else at]
    return rows


def _group_repeats(group, row_key, at, low, high, place, texts, size):
    """(row_key, start, end) of the repeats of some groups, from their interval trees."""
    ahead = size - low
    right, left = _padded(texts, place + high, ahead, False), _padded(texts, place, high, True)
    order, prefix = _sorted_texts(group, ahead, right)
    by_left, _ = _sorted_texts(group, high, left)
    rank = np.empty(len(group), np.int64)
    rank[by_left] = np.arange(len(group))
    found = []
    for first, last, common in _intervals(prefix):
        members = order[first : last + 1]
        members = members[np.argsort(rank[members])]
        shared = _common(left[members[:-1]], left[members[1:]], high[members[:-1]], high[members[1:]])
        if shared.min() == shared.max():  # not diverse to the left: one repeat for all
            reach = np.full(len(members), shared[0])
        else:  # each member repeats as far as its nearest neighbour to the left agrees
            reach = np.maximum(np.concatenate(([0], shared)), np.concatenate((shared, [0])))
        long = reach + common >= size
        if long.any():
            m = members[long]
            found.append((row_key[m], (at[m] - reach[long]).astype(np.int32), (at[m] + common).astype(np.int32)))
    return found


def _deal(texts, shards, size):
    """First pass: all anchors with their keys."""

    def run(batches):
        held = []

        def packed():
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            yield from block_rows(_send(*columns, shards, size))

        for part in slices(batches):
            data, offsets = text_bytes(part.column("text"))
            anchor, low, high, chain = _anchors(data, offsets, size)
            if len(anchor):
                row = np.searchsorted(offsets, anchor, "right") - 1
                row_key = np.asarray(part.column("row_key"), np.int64)[row]
                key = _keys(chain, anchor, low, size)
                body = chain.of(anchor - high, anchor - low + size)
                held.append((key, row_key, anchor - offsets[row], low, high, body))
            if sum(len(h[0]) for h in held) >= PORTION:
                yield from packed()
                held = []
        if held:
            yield from packed()

    return texts.mapInArrow(run, BLOCKS)


def _cut(joined, shards, size):
    """Second pass: the text around the anchors whose keys repeat, and the spans found so far."""

    def run(batches):
        for part in slices(batches):
            data, offsets = text_bytes(part.column("text"))
            places = part.column("places")
            row = np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(places), np.int64))
            kind, at, low, high = (np.asarray(c, np.int64) for c in places.flatten().flatten())
            row_key = np.asarray(part.column("row_key"), np.int64)[row]
            s, e, large = kind == _SPAN, kind == _ENTRY, kind == _STRING
            spans = row_key[s], low[s].astype(np.int32), high[s].astype(np.int32)
            made = list(pack(_SPAN, mix(spans[0].astype(U64)), spans, shards))
            chain = Hashes(BYTE_CODE[data]) if e.any() or large.any() else None
            if large.any():
                entry = [c[large] for c in (row_key, at, low, high)]
                made += _strings(chain, (at + offsets[row])[large], *entry, shards, size)
            if e.any():
                at, low, high, row_key = at[e], low[e], high[e], row_key[e]
                place = at + offsets[row[e]]
                key, body = _keys(chain, place, low, size), chain.of(place - high, place - low + size)
                made += _send(key, row_key, at, low, high, body, shards, size, (data, place))
            yield from block_rows(made)

    return joined.mapInArrow(run, BLOCKS)


def _groups(texts, size, group_rows):
    """Blocks of the second pass."""
    shards = shard_count(texts)
    first = _deal(texts, shards, size).groupBy("shard").applyInArrow(lambda table: _repeated(table, group_rows), PLACES)
    first = first.groupBy(F.col("row_key").alias("place_row"))
    first = first.agg(F.collect_list(F.struct("kind", "at", "low", "high")).alias("places"))
    joined = texts.join(first.hint("shuffle_hash"), F.col("row_key") == F.col("place_row"))
    return _cut(joined.select("row_key", "places", "text"), shards, size)


def repeats(texts: DataFrame, size=400, group_rows=GROUP_ROWS) -> DataFrame:
    """row_key, low, high: spans of bytes (end exclusive) that make repeats of ``size`` bytes or more.

    ``texts`` has row_key (the row's own long) and text. Spans of one row overlap. A key with more
    than ``group_rows`` entries is dealt by its strings.
    """
    second = _groups(texts, size, group_rows)
    second = second.groupBy("shard").applyInArrow(lambda table: _repeats(table, size), PLACES)
    return second.select("row_key", "low", "high")


def remove_repeats(docs: DataFrame, size=400, keep=None, group_rows=GROUP_ROWS) -> DataFrame:
    """Rows of ``docs`` with n_bytes, n_removed, n_spans and kept, the bytes that no repeat covers."""
    keep = list(docs.columns if keep is None else keep)
    new = "n_bytes long, n_removed long, n_spans long, kept binary"
    names = [f.name for f in fields(new)]
    stay = [c for c in keep if c.lower() not in names]
    texts = docs.select(F.xxhash64("doc_id", "text").alias("repeat_row"), *(F.col(f"`{c}`") for c in stay if c != "text"), "text")
    spans = repeats(texts.select(F.col("repeat_row").alias("row_key"), "text"), size, group_rows).groupBy(F.col("row_key").alias("span_row"))
    spans = spans.agg(F.collect_list(F.struct("low", "high")).alias("repeat_spans"))
    joined = texts.join(spans.hint("shuffle_hash"), F.col("repeat_row") == F.col("span_row"), "left")

    def cut(part):
        span = part.column(part.num_columns - 2)
        data, offsets = text_bytes(part.column(part.num_columns - 1))
        owner = np.repeat(np.arange(part.num_rows), np.asarray(pc.fill_null(pc.list_value_length(span), 0), np.int64))
        low, high = (np.asarray(c, np.int64) + offsets[owner] for c in span.flatten().flatten())
        edge = np.bincount(low, minlength=len(data) + 1) - np.bincount(high, minlength=len(data) + 1)
        gone = np.cumsum(edge)[:-1] > 0
        total = np.diff(offsets)
        per_row = np.concatenate(([0], np.cumsum(gone)))
        removed = per_row[offsets[1:]] - per_row[offsets[:-1]]
        begins = np.zeros(len(data) + 1, np.int64)
        begins[offsets[:-1]] = 1
        begins = gone & ((begins[:-1] == 1) | ~np.concatenate(([False], gone[:-1])))
        n_begins = np.concatenate(([0], np.cumsum(begins)))
        ends = np.concatenate(([0], np.cumsum(total - removed))).astype(np.int64)
        buffers = [None, pa.py_buffer(ends), pa.py_buffer(data[~gone].tobytes())]
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, buffers)
        return [
            pa.array(total),
            pa.array(removed),
            pa.array(n_begins[offsets[1:]] - n_begins[offsets[:-1]]),
            kept.cast(pa.binary()),
        ]

    return map_texts(joined, cut, new, [*stay, "repeat_spans"]).select(*(F.col(f"`{c}`") for c in stay), *names)
