"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets, and its connected groups.

Equal sets are folded into one. Two sets of at most ``boundary`` shingles link if and only if they
share a subset of the fixed size their sizes ask for, so small sets enumerate those subsets: sharing
one is a link, without comparing. Every other pair meets in the inverted lists of shingles, which
are scanned. In one order of all shingles (frequent ones last, else by hash) linked sets share a
shingle among their first quarter, so lists hold only these. The boundary is where the cost of the
subsets of all small sets and of the list entries of the others is least.

Only the groups are wanted, so pairs inside a group need no comparing once it is known. First each
set is compared with the few partners most lists name as neighbours by size; then, in further
rounds, with neighbours in another order that no link connects with it yet. At last the lists name
all pairs that are still apart; a pair is dropped for certain if it shares too few of its first
quarters' shingles, and the others are compared, so no link between groups is lost. The work beyond
the lists thus follows the groups' sizes, not their pairs.

Shingles and sets are told apart by 64-bit hashes; overlaps are counted over whole texts. A text
without words, or null, has an empty set: it links with nothing, and its component is its own
doc_id. Rows of one doc_id count as rows of their own; a null doc_id is never the smallest.
"""

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import (
    BLOCKS,
    BYTE_CODE,
    LOWER,
    SPACED,
    U64,
    Hashes,
    Lookup,
    block_rows,
    counts_of,
    drop_stored,
    expand,
    map_texts,
    mix,
    only,
    pack,
    row_key,
    runs,
    shard_count,
    sieve,
    slices,
    stored,
    text_bytes,
    unpack,
    words,
)

#: A shingle is frequent if portions in which it recurs have it so often together; it only moves back in the order.
FREQUENT_LEAST = 8
#: At most so many frequent shingles are sent to the tasks.
FREQUENT_MOST = 500_000
#: The cost of a list entry, in subsets.
ENTRY_COST = 8
#: No boundary beyond this is tried: the numbers of subsets explode.
LARGEST_BOUNDARY = 16
#: A list's entry is first named with so many after it; that is all of a short list.
NEAR = 3
#: About so many pairs are compared at a time, and fewer where all tasks together have fewer.
PAIRS_AT_ONCE, FEWEST_AT_ONCE = 20_000, 2_000
#: Pairs from which on a label's number of pairs decides where they meet.
SHARED = 64
#: Of such labels, so many with the most pairs are sent to the tasks; the others' pairs only meet elsewhere.
SHARED_MOST = 50_000
#: Edges of a graph in a shard, on average; fewer make one shard.
EDGES_AT_ONCE = 50_000
#: Entries of the lists that are not of one group in a shard, on average, and the fewest shards.
ENTRIES_AT_ONCE, LIST_SHARDS = 50_000, 8
PORTION = 500_000
#: Partners a set is compared with in a round, and rounds before all pairs still apart are named.
PARTNERS, ROUNDS = 3, 2

_POSTING, _SUBSET = 0, 1  # what a block holds
_PAIR, _NEAR, _LONG, _LINK = 0, 1, 2, 3  # what a shard finds
FOUND = "kind int, x long, y long, a int, b int"


class Rule:
    """Sets link when ``up`` of ``down`` of their union is shared."""

    def __init__(self, up=75, down=100):
        self.up, self.down = up, down

    def least(self, n, m):
        """Shared shingles that sets of these sizes need."""
        return -(-self.up * (n + m) // (self.up + self.down))

    def fits(self, small, large):
        return self.down * small >= self.up * large

    def prefix(self, n):
        """First shingles of a set among which any linked set shares one."""
        return n - -(-self.up * n // self.down) + 1

    def shared_prefix(self, n, m):
        """Shingles that linked sets share within both prefixes, at least."""
        beyond = np.maximum(n - self.prefix(n), m - self.prefix(m))
        return np.maximum(self.least(n, m) - beyond, 1)

    def partners(self, n):
        return [m for m in range(1, n * self.down // self.up + 1) if self.fits(min(n, m), max(n, m))]


def shingle_sets(column, size=5):
    """(row, hash) of the distinct shingles of each text, by row and hash."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    start, end, row = words(data, offsets, SPACED)
    n_rows = len(offsets) - 1
    total = counts_of(row, n_rows)
    first = np.cumsum(total) - total
    chain = Hashes(Hashes(BYTE_CODE[data]).of(start, end))
    # shingles start at every word but a text's last ones; a short text has one
    at = np.flatnonzero(np.arange(len(row)) - first[row] <= np.maximum(total[row] - size, 0))
    stop = np.minimum(at + size, (first + total)[row[at]])
    code, row = chain.of(at, stop), row[at]
    order = np.argsort(code)
    order = order[np.argsort(row[order].astype(np.uint16 if n_rows < 1 << 16 else np.int64), kind="stable")]
    code, row = code[order], row[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    return row[new], code[new]


def set_ids(row, code, n_rows):
    """A hash of each row's set; 0 where it is empty."""
    ids = np.zeros(n_rows, U64)
    start, _ = runs(row)
    if len(start):
        ids[row[start]] = mix(np.add.reduceat(mix(code ^ U64(0x5851F42D4C957F2D)), start))
    return ids.view(np.int64)


def _sizes(docs, size):
    """Rows of (doc_id, n, id), and of (shingle, count) for shingles that recur in a portion."""

    def run(batches):
        def rows(kind, a, b, c):
            n = len(b)
            arrays = [pa.array(np.full(n, kind, np.int32)), a, pa.array(b.astype(np.int64)), pa.array(c)]
            return pa.RecordBatch.from_arrays(arrays, names=["kind", "doc_id", "n", "id"])

        def recurring(held):
            ids, code, count = (np.concatenate(c) for c in zip(*held, strict=True))
            _, first = np.unique(ids, return_index=True)  # copies count once
            keep = np.zeros(len(ids), bool)
            keep[first] = True
            code, count = np.unique(code[np.repeat(keep, count)], return_counts=True)
            often = count > 1
            return rows(1, pa.nulls(int(often.sum()), pa.int64()), count[often], code[often].view(np.int64))

        held, n_held = [], 0
        for part in slices(batches):
            row, code = shingle_sets(part.column("text"), size)
            n = counts_of(row, part.num_rows)
            ids = set_ids(row, code, part.num_rows)
            yield rows(0, part.column("doc_id"), n, ids)
            held.append((ids, code, n))
            n_held += len(code)
            if n_held >= PORTION:
                yield recurring(held)
                held, n_held = [], 0
        if held:
            yield recurring(held)

    return docs.mapInArrow(run, "kind int, doc_id long, n long, id long")


def subset_sizes(n, boundary, rule):
    """(smaller, larger, shared) for each size of partner within the boundary."""
    return [(min(n, m), max(n, m), rule.least(n, m)) for m in rule.partners(n) if m <= boundary and rule.least(n, m) <= n]


def choose_boundary(sets_of_size, rule):
    """The boundary of least cost, from the numbers of sets of each small size."""

    def cost(boundary):
        total = 0
        for n, count in sets_of_size.items():
            if n <= boundary:
                total += count * sum(math.comb(n, o) for _, _, o in subset_sizes(n, boundary, rule))
            if rule.fits(n, max(n, boundary + 1)):
                total += count * rule.prefix(n) * ENTRY_COST
        return total

    return min(range(1, LARGEST_BOUNDARY + 1), key=cost)


def _entries(docs, shards, frequent, boundary, rule, size):
    """Blocks of list entries and of subsets of the distinct sets of each portion."""

    def run(batches):
        def packed(held):
            ids, code, n, late = (np.concatenate(c) for c in zip(*held, strict=True))
            place = np.cumsum(n) - n
            _, first = np.unique(ids, return_index=True)
            first = first[n[first] > 0]
            own, n_own = ids[first], n[first]
            # list entries: the first shingles in the order, of sets that can meet a large one
            meets = rule.fits(n_own, np.maximum(n_own, boundary + 1))
            length = np.where(meets, rule.prefix(n_own), 0)
            owner = np.repeat(np.arange(len(first)), length)
            pos = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
            token = code[place[first][owner] + pos]
            # the size is negative if the set's entries reach into the frequent shingles
            signed = np.where(late[place[first] + np.maximum(length, 1) - 1], -n_own, n_own)
            columns = (token, own[owner], signed[owner].astype(np.int32), pos.astype(np.int32))
            made = list(pack(_POSTING, token, columns, shards))
            for k in range(1, boundary + 1):
                chosen = np.flatnonzero(n_own == k)
                if not len(chosen):
                    continue
                sets = mix(code[place[first[chosen]][:, None] + np.arange(k)])
                for small, large, shared in subset_sizes(k, boundary, rule):
                    pick = np.array(list(combinations(range(k), shared)))
                    key = mix(sets[:, pick].sum(axis=2) + U64(small * 1000 + large)).ravel()
                    who = np.repeat(own[chosen], len(pick))
                    made += pack(_SUBSET, key, (key, who, np.full(len(key), k != small, np.int8)), shards)
            yield from block_rows(made)

        held, n_held = [], 0
        for part in slices(batches):
            row, code = shingle_sets(part.column("text"), size)
            ids = set_ids(row, code, part.num_rows)
            late = frequent.value.find(code) >= 0
            order = np.lexsort((code, late, row)) if late.any() else slice(None)
            held.append((ids, code[order], counts_of(row, part.num_rows), late[order]))
            n_held += len(code)
            if n_held >= PORTION:
                yield from packed(held)
                held, n_held = [], 0
        if held:
            yield from packed(held)

    return docs.mapInArrow(run, BLOCKS)


def _summed(x, y, votes, need):
    """Distinct pairs with the sum of their votes."""
    order = np.lexsort((y, x))
    x, y, votes, need = x[order], y[order], votes[order], need[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    at = np.flatnonzero(new)
    total = np.concatenate(([0], np.cumsum(votes)))
    return x[at], y[at], total[np.concatenate((at[1:], [len(x)]))[: len(at)]] - total[at], need[at]


def _pairs(ids, signed, pos, i, j, boundary, rule):
    """Candidate pairs (x, y, vote, need) of a list's entries i and j, ascending by size.

    Where both sets have only infrequent shingles in their entries, all lists name the pair, and
    the sum of their votes must reach ``need``. Else a list names it only if its shingle can be the
    pair's first shared one, and one vote is enough.
    """
    n, m = np.abs(signed[i]), np.abs(signed[j])
    least = rule.least(n, m)
    clean = (signed[i] > 0) & (signed[j] > 0)
    first = np.minimum(n - pos[i], m - pos[j]) >= least
    fit = rule.fits(n, m) & (m > boundary) & (clean | first)
    i, j, n, m, clean = i[fit], j[fit], n[fit], m[fit], clean[fit]
    need = np.where(clean, rule.shared_prefix(n, m), 1)
    return np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), np.ones(len(i), np.int64), need


def _joined(parts):
    none = np.zeros(0, np.int64)
    return _summed(*(np.concatenate(c) for c in zip(*[(none,) * 4, *parts], strict=True)))


def _found(parts):
    columns = [[], [], [], [], []]
    for kind, x, y, a, b in parts:
        for c, v in zip(columns, (np.full(len(x), kind), x, y, a, b), strict=True):
            c.append(v)
    kinds = (np.int32, np.int64, np.int64, np.int32, np.int32)
    arrays = [pa.array(np.concatenate(c).astype(k)) for c, k in zip(columns, kinds, strict=True)]
    return pa.Table.from_arrays(arrays, names=["kind", "x", "y", "a", "b"])


def _scan(table, boundary, rule):
    """Pairs of short lists, neighbours in long ones, these lists, and links by subsets, of one shard."""
    got = unpack(table, posting=(U64, np.int64, np.int32, np.int32), subset=(U64, np.int64, np.int8))
    token, ids, n, pos = got["posting"][0]
    order = np.argsort(token, kind="stable")
    start, count = runs(token[order])
    order = order[np.repeat(count > 1, count)]
    # lists of one set are gone; the others are sorted by size, and hold each set once
    order = order[np.lexsort((ids[order], np.abs(n[order]), token[order]))]
    token, ids, n, pos = token[order], ids[order], n[order].astype(np.int64), pos[order].astype(np.int64)
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (ids[1:] != ids[:-1])
    token, ids, n, pos = token[new], ids[new], n[new], pos[new]
    start, count = runs(token)
    long = np.repeat(count > NEAR + 1, count)
    parts = []
    for kind, of_kind in ((_PAIR, ~long), (_NEAR, long)):
        named = []
        for k in range(1, NEAR + 1):
            i = np.flatnonzero((token[k:] == token[:-k]) & of_kind[k:])
            named.append(_pairs(ids, n, pos, i, i + k, boundary, rule))
        parts.append((kind, *_joined(named)))
    parts.append((_LONG, token[long].view(np.int64), ids[long], n[long], pos[long]))
    # subsets: all sets that share one link with the first of the smaller size, if there is one
    key, ids, larger = got["subset"][0]
    order = np.lexsort((ids, larger, key))
    key, ids, larger = key[order], ids[order], larger[order]
    start, count = runs(key)
    head = np.repeat(start, count)
    link = (larger[head] == 0) & (ids != ids[head])
    one = np.ones(int(link.sum()), np.int64)
    parts.append((_LINK, *_summed(ids[head][link], ids[link], one, one)))
    return _found(parts)


def _neighbours(table, boundary, rule, turn):
    """Candidate pairs of neighbours in lists that no link connects yet, in an order of this round."""
    token, ids, n, pos, label = (np.asarray(table.column(c)).astype(np.int64) for c in ("token", "id", "n", "pos", "label"))
    order = np.lexsort((mix(ids.view(U64) + U64(turn)), token))
    token, ids, n, pos, label = (c[order] for c in (token, ids, n, pos, label))
    parts = []
    for k in range(1, NEAR + 1):
        i = np.flatnonzero((token[k:] == token[:-k]) & (label[k:] != label[:-k]))
        larger = np.abs(n[i]) > np.abs(n[i + k])
        parts.append(_pairs(ids, n, pos, np.where(larger, i + k, i), np.where(larger, i, i + k), boundary, rule))
    arrays = [pa.array(c) for c in _joined(parts)]
    return pa.Table.from_arrays(arrays, names=["x", "y", "votes", "need"])


def _apart_in_lists(token, size, label, rule):
    """Places (i, j) of all entries of one list with different labels and fitting sizes, in portions.

    Entries are ordered by token and size. Those of a list's most common label meet no entry of
    their own, so a list costs its other entries times its length.
    """
    start, count = runs(token)
    of_list = np.repeat(np.arange(len(start)), count)
    order = np.lexsort((label, of_list))
    new = np.ones(len(order), bool)
    new[1:] = (of_list[order][1:] != of_list[order][:-1]) | (label[order][1:] != label[order][:-1])
    first = np.flatnonzero(new)
    n_alike = np.diff(np.concatenate((first, [len(order)])))
    most = np.lexsort((n_alike, of_list[order[first]]))
    most = most[np.searchsorted(of_list[order[first]][most], np.arange(len(start)), "right") - 1]
    common = label[order[first[most]]][of_list] == label
    other = np.flatnonzero(~common)
    width = int(size.max(initial=0)) + 1
    key = of_list * width + size
    low = np.searchsorted(key, of_list[other] * width + -(-rule.up * size[other] // rule.down), "left")
    high = np.searchsorted(key, of_list[other] * width + np.minimum(size[other] * rule.down // rule.up, width - 1), "right")
    ends = np.cumsum(high - low)
    at = 0
    while at < len(other):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PORTION, "right")))
        i = np.repeat(other[at:stop], (high - low)[at:stop])
        j = expand(low[at:stop], (high - low)[at:stop])
        apart = (label[i] != label[j]) & (common[j] | (j > i))
        yield i[apart], j[apart]
        at = stop


def _across(table, boundary, rule, shards):
    """Blocks of candidate pairs of lists whose sets no link connects yet, dealt by pair."""
    columns = [np.asarray(table.column(c)) for c in ("token", "id", "n", "pos", "label")]
    order = np.lexsort((columns[1], np.abs(columns[2]), columns[0]))
    token, ids, n, pos, label = (c[order].astype(np.int64) for c in columns)
    size = np.abs(n)
    parts, held, merged = [], 0, 0
    for i, j in _apart_in_lists(token, size, label, rule):
        larger = size[i] > size[j]
        parts.append(_pairs(ids, n, pos, np.where(larger, j, i), np.where(larger, i, j), boundary, rule))
        held += len(parts[-1][0])
        if held > max(1_000_000, 2 * merged):
            parts = [_joined(parts)]
            held = merged = len(parts[0][0])
    return pa.Table.from_batches(_dealt(*_joined(parts), shards), _BLOCK_SCHEMA)


_BLOCK_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.binary())])


def _dealt(x, y, votes, need, shards):
    """Blocks of pairs, each pair's in one shard."""
    key = mix(mix(x.view(U64)) + y.view(U64))
    return block_rows(pack(0, key, (x, y, votes.astype(np.int32), need.astype(np.int32)), shards))


def _named(table):
    """Pairs of a shard that all lists together give the votes they need."""
    (x, y, votes, need), _ = unpack(table, pairs=(np.int64, np.int64, np.int32, np.int32))["pairs"]
    x, y, votes, need = _summed(x, y, votes, need)
    enough = votes >= need
    return pa.Table.from_arrays([pa.array(x[enough]), pa.array(y[enough])], names=["x", "y"])


def _verified(pairs, docs, classes, rule, size):
    """Links (x, y) that connect the labels of all pairs (x, y) whose whole sets link, or None without pairs.

    x_label and y_label tell the present groups of a pair. Pairs are compared in blocks, to which each
    text goes once. Those of a group with many pairs share blocks, cut by the other group.
    """
    with only(docs.sparkSession) as keep:
        pairs = stored(pairs, "jaccard_pairs")
        n_pairs = pairs.count()
        return keep(_compared(pairs, n_pairs, docs, classes, rule, size)) if n_pairs else None


def _both(x, y):
    """One row for each of two columns."""
    return F.explode(F.array(x, y))


def _compared(pairs, n_pairs, docs, classes, rule, size):
    texts = _texts_of(pairs, docs, classes, size)
    shuffled = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at_once = min(max(n_pairs // shuffled, FEWEST_AT_ONCE), PAIRS_AT_ONCE)
    n_blocks = math.ceil(n_pairs / at_once)
    count = pairs.select(_both("x_label", "y_label").alias("label")).groupBy("label").count().filter(F.col("count") >= SHARED)
    count = F.broadcast(count.orderBy(F.desc("count"), "label").limit(SHARED_MOST))
    for end in ("x", "y"):
        own = count.select(F.col("label").alias(f"{end}_label"), F.col("count").alias(f"{end}_count"))
        pairs = pairs.join(own, f"{end}_label", "left").withColumn(f"{end}_count", F.coalesce(f"{end}_count", F.lit(0)))
    large = F.col("x_count") >= F.col("y_count")
    home, guest = F.when(large, F.col("x_label")).otherwise(F.col("y_label")), F.when(large, F.col("y_label")).otherwise(F.col("x_label"))
    part = F.pmod(F.xxhash64(guest), F.greatest(F.lit(1), F.ceil(F.greatest("x_count", "y_count") / at_once)))
    block = F.pmod(F.xxhash64(home, part), F.lit(n_blocks)).alias("block")
    pairs = pairs.select("x", "y", "x_label", "y_label", block)
    ends = pairs.select(F.col("block").alias("of_block"), _both("x", "y").alias("id")).distinct().join(texts, "id")

    def compare(pairs, texts):
        ids, n, codes = [], [], []
        for part in slices(texts.select(["id", "text"]).to_batches()):
            row, code = shingle_sets(part.column("text"), size)
            ids.append(np.asarray(part.column("id")))
            n.append(counts_of(row, part.num_rows))
            codes.append(code)
        x, y, x_label, y_label = (np.asarray(pairs.column(c)) for c in ("x", "y", "x_label", "y_label"))
        if not ids:
            return pa.Table.from_arrays([pa.array(x[:0]), pa.array(y[:0])], names=["x", "y"])
        ids, n, codes = map(np.concatenate, (ids, n, codes))
        place, order = np.cumsum(n) - n, np.argsort(ids)
        x_at, y_at = (order[np.searchsorted(ids[order], e)] for e in (x, y))
        by_x = np.argsort(x_at, kind="stable")
        shared = np.zeros(len(x), np.int64)
        for start, count in zip(*runs(x_at[by_x]), strict=True):
            own = by_x[start : start + count]
            mine = codes[place[x_at[own[0]]] : place[x_at[own[0]]] + n[x_at[own[0]]]]
            for few in np.array_split(own, -(-count // 256)):
                other = codes[expand(place[y_at[few]], n[y_at[few]])]
                slot = np.minimum(np.searchsorted(mine, other), len(mine) - 1)
                hit = np.concatenate(([0], np.cumsum(mine[slot] == other)))
                ends = np.cumsum(n[y_at[few]])
                shared[few] = hit[ends] - hit[ends - n[y_at[few]]]
        link = (rule.up + rule.down) * shared >= rule.up * (n[x_at] + n[y_at])
        return pa.Table.from_arrays([pa.array(c) for c in forest(x_label[link], y_label[link])], names=["x", "y"])

    linked = pairs.groupBy("block").cogroup(ends.groupBy("of_block")).applyInArrow(compare, "x long, y long")
    return stored(linked, "jaccard_links")


def _mixed(table):
    """The entries of lists whose sets are not yet one group."""
    token, label = np.asarray(table.column("token")), np.asarray(table.column("label"))
    order = np.lexsort((label, token))
    start, count = runs(token[order])
    whole = label[order][start] == label[order][start + count - 1]
    keep = order[np.repeat(~whole, count)]
    return table.select(["token", "id", "n", "pos"]).take(pa.array(keep))


def _in_round(turn, boundary, rule):
    return lambda table: _neighbours(table, boundary, rule, turn)


def _best(pairs):
    """Each set with the partners most lists name."""
    turned = F.struct(F.col("y").alias("x"), F.col("x").alias("y"), "votes")
    ends = pairs.select(F.inline(F.array(F.struct("x", "y", "votes"), turned)))
    order = Window.partitionBy("x").orderBy(F.desc("votes"), "y")
    best = ends.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= PARTNERS)
    return stored(best.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "jaccard_best")


def _labelled(df, labels, end):
    own = labels.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
    return df.join(own, end, "left").withColumn(f"{end}_label", F.coalesce(f"{end}_label", end))


def _apart(pairs, labels):
    """The pairs that no link connects, with their labels."""
    for end in ("x", "y"):
        pairs = _labelled(pairs, labels, end)
    return pairs.filter("x_label != y_label")


def _merged(labels, links):
    """Labels after further links between the labels themselves.

    What it is given is deleted.
    """
    if links is None:
        return labels
    with only(labels.sparkSession) as keep:
        groups = components(links)
        own = groups.select(F.col("id").alias("label"), F.col("label").alias("group"))
        merged = labels.join(own, "label", "left").select("id", F.coalesce("group", "label").alias("label"))
        # sets without a label so far are their own one
        merged = keep(stored(merged.unionByName(groups).distinct(), "labels"))
    drop_stored(labels, links)
    return merged


def forest(x, y):
    """(node, root) of all nodes of the edges (x, y) but the roots: the smallest of each connected group."""
    ids, place = np.unique(np.concatenate((x, y)), return_inverse=True)
    a, b = place[: len(x)], place[len(x) :]
    root = np.arange(len(ids))
    while True:
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    below = np.flatnonzero(root != np.arange(len(ids)))
    return ids[below], ids[root[below]]


def _folded(edges):
    """The edges (u, v), those of each task replaced by its forest."""

    def run(batches):
        kept, held, n_held = (np.zeros(0, np.int64),) * 2, [], 0
        for batch in batches:
            held.append(tuple(np.asarray(c) for c in batch.columns))
            n_held += batch.num_rows
            if n_held >= max(PORTION, len(kept[0])):
                kept, held, n_held = forest(*(np.concatenate(c) for c in zip(kept, *held, strict=True))), [], 0
        kept = forest(*(np.concatenate(c) for c in zip(kept, *held, strict=True)))
        for start in range(0, len(kept[0]), PORTION):
            yield pa.RecordBatch.from_arrays([pa.array(c[start : start + PORTION]) for c in kept], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def _forests(edges, shards):
    """The edges (u, v), those of each shard of lower nodes replaced by its forest."""

    def run(table):
        u, v = forest(*(np.asarray(table.column(c)) for c in ("u", "v")))
        return pa.Table.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return edges.groupBy(F.pmod(F.xxhash64("u"), F.lit(shards)).alias("shard")).applyInArrow(run, "u long, v long")


def _settled(edges):
    """Whether each node of the edges (u, v) is either a root or below one root only."""
    below = F.struct(F.col("u").alias("id"), F.col("v").alias("root"))
    above = F.struct(F.col("v").alias("id"), F.lit(None).cast("long").alias("root"))
    nodes = edges.select(F.inline(F.array(below, above))).groupBy("id")
    nodes = nodes.agg(F.min("root").alias("least"), F.max("root").alias("most"), F.bool_or(F.col("root").isNull()).alias("is_root"))
    return nodes.filter("least is not null and (least != most or is_root)").count() == 0


def components(links: DataFrame) -> DataFrame:
    """(id, label) of all ends of the links (x, y): the smallest id of each connected group.

    Tasks fold the edges into forests, first as they come, then dealt by the lower node: of it no task
    has left more than one edge, so a group's root is no hot key. In further rounds each node hangs
    below the parent of its parent.
    """
    edges, last = _folded(links.select(F.col("x").alias("u"), F.col("y").alias("v"))), None
    shards = math.ceil(links.count() / EDGES_AT_ONCE) or 1
    while True:
        edges = stored(_forests(edges, shards), "edges")
        if last is not None:
            drop_stored(last)
        if _settled(edges):
            break
        parents = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("parent"))
        last, edges = edges, edges.join(parents, "v", "left").select("u", F.coalesce("parent", "v").alias("v"))
    own = F.struct(F.col("u").alias("id"), F.col("v").alias("label"))
    root = F.struct(F.col("v").alias("id"), F.col("v").alias("label"))
    return edges.select(F.inline(F.array(own, root))).distinct()


def _texts_of(pairs, docs, classes, size):
    """(id, text) of one document for each set of the pairs.

    A sieve over the wanted doc_ids keeps most other texts out of the shuffle; the join is exact.
    """
    ids = pairs.select(_both("x", "y").alias("id")).distinct()
    wanted = stored(ids.join(classes, "id").select("id", F.col("least_doc").alias("wanted_doc")), "jaccard_wanted")
    rows = sieve(wanted.select("wanted_doc"))(docs.select("doc_id", "text")).filter("likely")

    def own(part):  # of rows with the same doc_id, only those with the wanted set
        row, code = shingle_sets(part.column("text"), size)
        return [pa.array(set_ids(row, code, part.num_rows))]

    rows = map_texts(rows, own, "own_id long", ["doc_id", "text"])
    wanted = wanted.hint("shuffle_hash")
    kept = rows.join(wanted, (F.col("own_id") == F.col("id")) & F.col("doc_id").eqNullSafe(F.col("wanted_doc")))
    return kept.dropDuplicates(["id"]).select("id", "text")


def jaccard_components(docs: DataFrame, size=5, up=75, down=100) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    with only(docs.sparkSession) as keep:
        return keep(stored(_components_of(docs, size, Rule(up, down)), "jaccard_components"))


def _components_of(docs, size, rule):
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = shard_count(docs)
    spark = docs.sparkSession
    sizes = stored(_sizes(docs, size), "shingle_sizes")
    rows = sizes.filter("kind = 0")
    classes = rows.filter("n > 0").groupBy("id").agg(F.min("doc_id").alias("least_doc"), F.first("n").alias("n"))
    classes = stored(classes, "jaccard_classes")
    small = classes.filter(F.col("n") <= LARGEST_BOUNDARY).groupBy("n").count().collect()  # a row for each size
    boundary = choose_boundary({r["n"]: r["count"] for r in small}, rule)
    often = sizes.filter("kind = 1").groupBy("id").agg(F.sum("n").alias("n"))
    often = often.filter(F.col("n") >= FREQUENT_LEAST).orderBy(F.desc("n"), "id").limit(FREQUENT_MOST)
    often = np.asarray(often.select("id").toArrow().column("id"), np.int64).view(U64)
    frequent = spark.sparkContext.broadcast(Lookup(np.sort(often)))

    blocks = _entries(docs, shards, frequent, boundary, rule, size)
    found = blocks.groupBy("shard").applyInArrow(lambda table: _scan(table, boundary, rule), FOUND)
    found = stored(found, "jaccard_found")
    lists = found.filter(F.col("kind") == _LONG).selectExpr("x AS token", "y AS id", "a AS n", "b AS pos")

    def of_short(batches):
        for batch in batches:
            yield from _dealt(*(np.asarray(c) for c in batch.columns), shards)

    def labelled(lists, labels, shards):
        own = _labelled(lists, labels, "id").withColumnRenamed("id_label", "label")
        return own.withColumn("shard", F.pmod("token", F.lit(shards))).groupBy("shard")

    def best(named, tested=None):
        named = named.groupBy("x", "y").agg(F.sum("votes").alias("votes"), F.max("need").alias("need"))
        named = named.filter("2 * votes >= need").select("x", "y", "votes")
        return _best(named if tested is None else named.join(tested, ["x", "y"], "left_anti"))

    def verified(pairs):
        return _verified(pairs, docs, classes, rule, size)

    # first each set with its best partners by neighbours in the lists, where they look promising
    near = found.filter(F.col("kind").isin(_PAIR, _NEAR)).selectExpr("x", "y", "a AS votes", "b AS need")
    tested = best(near.filter("need = 1 or votes > 1"))
    links = verified(tested.selectExpr("x", "y", "x AS x_label", "y AS y_label"))
    by_subset = found.filter(F.col("kind") == _LINK).select("x", "y")
    links = by_subset if links is None else links.unionByName(by_subset)
    with only(spark) as keep:
        labels = keep(stored(components(links), "labels"))
    # most lists are of one group by now and have nothing more to tell
    kinds = "token long, id long, n int, pos int"
    lists = stored(labelled(lists, labels, shards).applyInArrow(_mixed, kinds), "jaccard_lists")
    list_shards = min(shards, max(LIST_SHARDS, lists.count() // ENTRIES_AT_ONCE))
    for turn in range(1, ROUNDS + 1):
        named = labelled(lists, labels, list_shards).applyInArrow(_in_round(turn, boundary, rule), "x long, y long, votes long, need long")
        further = best(named, tested)
        tested = tested.unionByName(further)
        labels = _merged(labels, verified(_apart(further, labels)))

    # then every pair of the lists that no link connects yet and that shares enough of the prefixes
    across = labelled(lists, labels, list_shards).applyInArrow(lambda table: _across(table, boundary, rule, shards), BLOCKS)
    short = _apart(found.filter(F.col("kind") == _PAIR).select("x", "y", "a", "b"), labels)
    short = short.select("x", "y", "a", "b").mapInArrow(of_short, BLOCKS)
    named = across.unionByName(short).groupBy("shard").applyInArrow(_named, "x long, y long")
    labels = _merged(labels, verified(_apart(named.join(tested, ["x", "y"], "left_anti"), labels)))

    own = labels.join(classes.select("id", "least_doc"), "id")
    least = own.groupBy("label").agg(F.min("least_doc").alias("component"))
    group = own.join(least, "label").select("id", "component")
    classes = classes.join(group, "id", "left").select("id", F.coalesce("component", "least_doc").alias("component"))
    linked = rows.filter("n > 0").join(classes, "id", "left")
    alone = rows.filter("n = 0").withColumn("component", F.col("doc_id"))
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")]
    return linked.select(*columns).unionByName(alone.select(*columns))


def _doubtful(docs, size, up, down):
    """(row_key, stays): the rows that go, and rows that stay once of several equal ones."""
    keyed = docs.select(row_key().alias("doc_id"), "text")
    groups = jaccard_components(keyed, size, up, down).filter("n_shingles > 0")
    groups = groups.select(F.col("doc_id").alias("row_key"), "component_id")
    ids = docs.select(row_key().alias("row_key"), F.col("doc_id").cast("long").alias("own_doc")).distinct()
    rows = groups.groupBy("row_key", "component_id").agg(F.count("*").alias("n_rows")).join(ids, "row_key")
    # partial minima: a group of a third of all rows leaves each task as one row
    order = F.struct(F.col("own_doc").isNull(), "own_doc", "row_key")
    first = rows.groupBy("component_id").agg(F.min(order)["row_key"].alias("row_key")).select("row_key", F.lit(True).alias("stays"))
    rows = rows.select("row_key", "n_rows").join(first, "row_key", "left")
    return rows.filter("stays is null or n_rows > 1").select("row_key", F.coalesce("stays", F.lit(False)).alias("stays"))


def keep_one(docs: DataFrame, size=5, up=75, down=100) -> DataFrame:
    """The rows of ``docs`` without all but one row of each group of near copies.

    The row with the smallest doc_id stays; of equal ones that with the smallest hash of its text,
    of equal rows any. Rows without a doc_id come last. Rows are told apart by doc_id and text, so a
    row that copies nothing stays whatever its doc_id; texts without words copy nothing. Only rows
    that a sieve takes for possibly dropped are shuffled.
    """
    with only(docs.sparkSession) as keep:
        doubt = keep(stored(_doubtful(docs, size, up, down), "jaccard_doubt"))
    marked = sieve(doubt.select("row_key"), row_key())(docs)
    rows = marked.filter("likely").withColumn("row_key", row_key())
    rows = rows.join(doubt.hint("shuffle_hash"), "row_key", "left")
    kept = marked.filter("not likely").select(*(f"`{c}`" for c in docs.columns))
    for part in (rows.filter("stays is null"), rows.filter("stays").dropDuplicates(["row_key"])):
        kept = kept.unionByName(part.select(*(f"`{c}`" for c in docs.columns)))
    return kept
