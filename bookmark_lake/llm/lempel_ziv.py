"""Substring dedup: relative Lempel-Ziv parsing of documents against all earlier text.

The reference is everything that starts earlier (smaller doc_id, or the same document before). It
is indexed in blocks: each window of 20 words has an anchor, the start of its smallest 8-word hash,
so equal windows share the anchor's hash, and a block of the index holds all anchors of one shard
of hashes with the windows around them. A document is factored against every block its anchors lead
to: a factor starts at a window that occurs earlier, carries its first source, and grows while the
following windows continue. What ends between two blocks is checked at that border by the windows
that straddle it, each of which belongs to exactly one block.

Before the shuffle a task factors its own texts against each other: a window that occurs earlier in
the same task is a duplicate for certain and is not sent. A passage in a third of all documents
thus reaches its block once per task.

An anchor that many windows have, such as a phrase in a third of all documents with different text
around it, would bring them all to one block. Such anchors are counted first; their windows are
dealt by their own hash, over all blocks.

Windows are compared by their 64-bit hash, inside a task and in a block. A null text has no words.
Rows are told apart by doc_id and text: those of one doc_id are ordered by a hash of both, rows
without a doc_id come last. Equal rows count as one, so a repeated row does not delete itself.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import (
    BLOCKS,
    BYTE_CODE,
    SPACED,
    U64,
    Hashes,
    block_rows,
    counts_of,
    expand,
    fields,
    map_texts,
    mix,
    pack,
    row_key,
    runs,
    shard_count,
    slices,
    text_bytes,
    unpack,
    words,
)

ANCHOR = 8
#: A task factors its texts against each other in portions of so many words.
PORTION = 1_000_000
#: Windows from which on those of one anchor are dealt one by one, and those of a portion from which on it is counted.
HOT, REPORTED = 100_000, 32
LAST = np.iinfo(np.int64).max
FACTORS = "doc_id long, row_key long, start int, size int, source_doc long, source_start int"
_KINDS = (np.int64, np.int64, np.int32, np.int32, np.int64, np.int32)
_FACTORED, _INDEXED = 0, 1  # what a block holds


def _window_min(values, width):
    """Position of the leftmost smallest of each ``width`` values in a row."""
    best = np.arange(len(values), dtype=np.int64)
    done = 1
    while done < width:
        step = min(done, width - done)
        a, b = best[:-step], best[step:]
        best = np.where(values[b] < values[a], b, a)
        done += step
    return best


def _windows(part, size):
    """(doc, row key, first word, hash, anchor hash, anchor) of all windows of a slice, in word order."""
    data, offsets = text_bytes(part.column("text"))
    start, end, row = words(data, offsets, SPACED)
    ids = part.column("doc_id")
    doc = np.asarray(ids.fill_null(LAST), np.int64) if len(ids) else np.zeros(0, np.int64)
    own = np.asarray(part.column("row_key"), np.int64)
    n = len(start) - size + 1
    if n < 1:
        return None
    word = Hashes(BYTE_CODE[data]).of(start, end)
    total = counts_of(row, part.num_rows)
    first = (np.cumsum(total) - total)[row]
    chain = Hashes(word)
    at = np.arange(n)
    whole = row[:n] == row[size - 1 :]
    gram = min(ANCHOR, size)
    grams = np.arange(len(word) - gram + 1)
    key = chain.of(grams, grams + gram)
    anchor = _window_min(key, size - gram + 1)[whole]
    at = at[whole]
    return doc[row[at]], own[row[at]], (at - first[at]).astype(np.int32), chain.of(at, at + size), key[anchor], anchor


def _factors(doc, own, start, source, size):
    """Columns of factors: runs of duplicate windows with sources that run along; ``source`` is (doc, key, start)."""
    order = np.lexsort((start, own, doc))
    doc, own, start = (x[order] for x in (doc, own, start))
    source = [x[order] for x in source]
    cut = np.ones(len(doc), bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1)
    cut[1:] |= (source[0][1:] != source[0][:-1]) | (source[1][1:] != source[1][:-1]) | (source[2][1:] != source[2][:-1] + 1)
    begin = np.flatnonzero(cut)
    length = np.diff(np.concatenate((begin, [len(doc)])))
    return doc[begin], own[begin], start[begin], (length + size - 1).astype(np.int32), source[0][begin], source[2][begin]


def _firsts(key):
    """For each window, given in the order of the text: the index of the first with its key."""
    order = np.argsort(key, kind="stable")
    begin, size = runs(key[order])
    first = np.empty(len(key), np.int64)
    first[order] = np.repeat(order[begin], size)
    return first


def _again(doc, own, start, first):
    """The windows that occur earlier; the same place of an equal row is no other."""
    return np.flatnonzero((doc[first] != doc) | (own[first] != own) | (start[first] != start))


def _ordered(parts):
    """Columns of the windows of some slices, in the order of the text, and the first with the hash of each."""
    base, anchors = 0, []
    for p in parts:
        anchors.append(p[5] + base)
        base += int(p[5].max(initial=0)) + 1
    doc, own, start, whole, key = (np.concatenate([p[i] for p in parts]) for i in range(5))
    anchor = np.concatenate(anchors)
    same = (doc[1:] == doc[:-1]) & (own[1:] == own[:-1])
    if not ((doc[1:] > doc[:-1]) | (same & (start[1:] > start[:-1]))).all():
        order = np.lexsort((start, own, doc))
        doc, own, start, whole, key, anchor = (x[order] for x in (doc, own, start, whole, key, anchor))
    return doc, own, start, whole, key, anchor, _firsts(whole)


def _portion(parts, shards, size, hot=()):
    """Blocks of a portion of texts: its own factors, and the index of its first windows.

    Windows of the ``hot`` anchors are entries of their own, dealt by their hash.
    """
    parts = [p for p in parts if p is not None]
    if not parts:
        return
    doc, row, start, whole, key, anchor, first = _ordered(parts)
    again = _again(doc, row, start, first)
    source = first[again]
    own = _factors(doc[again], row[again], start[again], (doc[source], row[source], start[source]), size)
    new = np.flatnonzero(first == np.arange(len(first)))
    # consecutive new windows with one anchor make one entry of the index
    cut = np.ones(len(new), bool)
    cut[1:] = (np.diff(new) != 1) | (anchor[new[1:]] != anchor[new[:-1]])
    cut[1:] |= (doc[new[1:]] != doc[new[:-1]]) | (row[new[1:]] != row[new[:-1]]) | (start[new[1:]] != start[new[:-1]] + 1)
    whole, dealt = whole[new], key[new]
    if len(hot):
        alone = np.isin(dealt, hot)
        cut |= alone
        cut[1:] |= alone[:-1]
        dealt = np.where(alone, whole, dealt)
    begin = np.flatnonzero(cut)
    length = np.diff(np.concatenate((begin, [len(new)])))
    head = new[begin]
    columns = (dealt[begin], doc[head], row[head], start[head], length.astype(np.uint16))
    yield from pack(_FACTORED, mix(own[0].astype(U64)), own, shards)
    yield from pack(_INDEXED, dealt[begin], (*columns, lambda i: whole[expand(begin[i], length[i])].tobytes()), shards)


def _factor_block(table, size):
    """Factors of one shard: those found before, and windows that an earlier entry of the index has too."""
    got = unpack(table, factored=_KINDS, indexed=(U64, np.int64, np.int64, np.int32, np.uint16))
    done, _ = got["factored"]
    (key, doc, row, start, length), rest = got["indexed"]
    length = length.astype(np.int64)
    whole, whole_at = rest.view(U64), np.cumsum(length) - length
    # an entry whose anchor no other entry has is new text
    order = np.argsort(key, kind="stable")
    begin, count = runs(key[order])
    shared = order[expand(begin[count > 1], count[count > 1])]
    size_of = length[shared]
    entry, at = np.repeat(shared, size_of), expand(np.zeros(len(shared), np.int64), size_of)
    whole = whole[expand(whole_at[shared], size_of)]
    doc, row, start = doc[entry], row[entry], start[entry] + at.astype(np.int32)
    order = np.lexsort((start, row, doc))
    doc, row, start = doc[order], row[order], start[order]
    first = _firsts(whole[order])
    again = _again(doc, row, start, first)
    source = first[again]
    found = _factors(doc[again], row[again], start[again], (doc[source], row[source], start[source]), size)
    columns = [pa.array(np.concatenate((d, f))) for d, f in zip(done, found, strict=True)]
    return pa.Table.from_arrays(columns, names=["doc_id", "row_key", "start", "size", "source_doc", "source_start"])


def _hot_anchors(texts, size, least):
    """Sorted hashes of the anchors of ``least`` windows or more, from each portion's own counts of its first windows."""
    reported = min(REPORTED, least)

    def run(batches):
        for parts in _portions(batches, size):
            _, _, _, _, key, _, first = _ordered(parts)
            found, count = np.unique(key[first == np.arange(len(first))], return_counts=True)
            often = count >= reported
            columns = [pa.array(found[often].view(np.int64)), pa.array(count[often].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "windows"])

    counted = texts.mapInArrow(run, "anchor long, windows long").groupBy("anchor").agg(F.sum("windows").alias("windows"))
    hot = counted.filter(F.col("windows") >= least).select("anchor").toArrow()
    return np.sort(np.asarray(hot.column("anchor"), np.int64).view(U64))


def _portions(batches, size):
    """Lists of the windows of some slices, PORTION of them or a few more."""
    parts, held = [], 0
    for part in slices(batches):
        own = _windows(part, size)
        if own is not None:
            parts.append(own)
            held += len(own[0])
        if held >= PORTION:
            yield parts
            parts, held = [], 0
    if parts:
        yield parts


def factors(docs: DataFrame, size=20, hot=HOT) -> DataFrame:
    """Duplicate spans of words: doc_id, row_key, start, size, and the first place where their windows occur.

    A span is cut where the first sources of its windows part and between blocks; spans overlap
    there. A null doc_id is given as the largest long. ``hot`` is the number of windows from which on
    those of one anchor are dealt one by one.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text")
    shards = shard_count(texts)

    anchors = docs.sparkSession.sparkContext.broadcast(_hot_anchors(texts, size, hot))

    def parse(batches):
        for parts in _portions(batches, size):
            yield from block_rows(_portion(parts, shards, size, anchors.value))

    blocks = texts.mapInArrow(parse, BLOCKS)
    return blocks.groupBy("shard").applyInArrow(lambda table: _factor_block(table, size), FACTORS)


def remove_factors(docs: DataFrame, size=20, keep=None) -> DataFrame:
    """Rows of ``docs`` with n_words, n_removed and kept, the words no factor covers, joined by a space."""
    keep = list(docs.columns if keep is None else keep)
    # the factors of one text: as many as it has words at most
    spans = factors(docs, size).groupBy(F.col("row_key").alias("factor_row"))
    spans = spans.agg(F.collect_list(F.struct("start", "size")).alias("factor_spans"))
    extra = [c for c in ("text", "doc_id") if c not in keep]
    joined = docs.select(*keep, *extra).withColumn("factor_key", row_key())
    joined = joined.join(spans.hint("shuffle_hash"), F.col("factor_key") == F.col("factor_row"), "left")

    def cut(part):
        span = part.column(part.num_columns - 2)
        data, offsets = text_bytes(part.column(part.num_columns - 1))
        start, end, row = words(data, offsets, SPACED)
        total = counts_of(row, part.num_rows)
        first = np.cumsum(total) - total
        count = np.asarray(pc.fill_null(pc.list_value_length(span), 0), np.int64)
        flat = span.flatten()
        begin, length = (np.asarray(flat.field(i), np.int64) for i in (0, 1))
        owner = np.repeat(np.arange(part.num_rows), count)
        a = first[owner] + np.minimum(begin, total[owner])
        b = first[owner] + np.minimum(begin + length, total[owner])
        edge = np.bincount(a, minlength=len(start) + 1) - np.bincount(b, minlength=len(start) + 1)
        kept = np.cumsum(edge)[:-1] == 0
        s, e, r = start[kept], end[kept], row[kept]
        # each kept word with a space before it; the first of a row goes without
        size_of = e - s + 1
        picked = data[np.maximum(expand(s - 1, size_of), 0)] if len(s) else np.zeros(0, np.uint8)
        at = np.cumsum(size_of) - size_of
        picked[at] = 0x20
        lead = np.concatenate(([True], r[1:] != r[:-1])) if len(r) else np.zeros(0, bool)
        stay = np.ones(len(picked), bool)
        stay[at[lead]] = False
        per_row = np.bincount(r, weights=size_of, minlength=part.num_rows).astype(np.int64)
        per_row -= np.bincount(r[lead], minlength=part.num_rows)
        ends = np.concatenate(([0], np.cumsum(per_row))).astype(np.int64)
        text = pa.LargeStringArray.from_buffers(part.num_rows, pa.py_buffer(ends), pa.py_buffer(picked[stay].tobytes()))
        n_kept = counts_of(r, part.num_rows)
        return [pa.array(total), pa.array(total - n_kept), text.cast(pa.string())]

    new = "n_words long, n_removed long, kept string"
    names = [f.name for f in fields(new)]
    stay = [c for c in keep if c.lower() not in names]
    return map_texts(joined, cut, new, [*stay, "factor_spans"]).select(*(f"`{c}`" for c in stay), *names)
