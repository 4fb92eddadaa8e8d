"""Periodic runs of words: all maximal repetitions of each text, by seeds on diagonals.

A run is a stretch with smallest period q, at least twice q and ``least`` words long, which no
neighbouring word extends. On the diagonal of lag q, where each word is compared with the one q
further, it is a stretch of length - q equal words, so of q at least and of least - q for short
periods. Lags are taken in classes [K, 2K), K = 6, 12, 24 ... for least = 12; the first class holds
all shorter lags too. Within a class each run has equal k-grams, k = K, at a distance of its period:

* k-grams get exact numbers by pairing those of the class before, only where they recur;
* occurrences that follow each other by at most half of k form a progression, whose step is the
  period of the gram. Two occurrences in one progression never seed a run of the class (its root
  would be a power of that step), so pairs are taken between progressions, one for each lag, and
  at most four later progressions are near enough. The seeds of a class so follow the words, even
  in a text of one word repeated;
* by lag, a seed at or before the furthest word covered by those before it lies on a stretch that is known, and
  is passed over; others are extended both ways by direct comparison;
* a stretch that also has a part of its lag as period is no run of this lag.

Null and empty texts have no words and no runs. A word of a run behind the run's first q words
counts as a copy; ``collapsed`` is the text without copies, words joined by one space. Long texts
are one slice each; equal texts have equal results.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import SPACED, counts_of, expand, map_texts, rows_of, text_bytes, words
from .packing import word_column

LEAST = 12
#: Comparisons made at once when stretches are extended.
AT_ONCE = 1 << 18
#: Seeds extended together.
SEEDS = 1 << 14


def _paired(first, second, at):
    """Numbers of the pairs of names at these places; -1 where a pair does not recur."""
    out = np.full(len(first), -1, np.int64)
    if len(at):
        _, back, many = np.unique(first[at] * (int(second.max()) + 1) + second, return_inverse=True, return_counts=True)
        again = many[back] > 1
        out[at[again]] = back[again]
    return out


def _longer(name, shift, other, k, stop):
    """Names of k-grams made of a gram and one ``shift`` words on."""
    at = np.flatnonzero(name >= 0)
    at = at[at + k <= stop[at]]
    at = at[other[at + shift] >= 0]
    return _paired(name, other[at + shift], at)


def _occurrences(name):
    """(names, places) of the grams that recur, by name and place."""
    at = np.flatnonzero(name >= 0)
    order = np.argsort(name[at], kind="stable")
    return name[at][order], at[order]


def _near(names, places, most):
    """(place, lag) of all pairs of equal grams up to ``most`` words apart."""
    at, lags = [], []
    for r in range(1, most + 1):
        lag = places[r:] - places[:-r]
        fit = (names[r:] == names[:-r]) & (lag <= most)
        if not fit.any():
            break
        at.append(places[:-r][fit])
        lags.append(lag[fit])
    return _both(at, lags)


def _both(at, lags):
    none = [np.zeros(0, np.int64)]
    return np.concatenate(at or none), np.concatenate(lags or none)


def _between(names, places, k):
    """(place, lag) for each lag in [k, 2k) between two progressions of one gram."""
    gap = np.diff(places)
    cut = np.flatnonzero(np.concatenate(([True], (names[1:] != names[:-1]) | (2 * gap > k))))
    size = np.diff(np.concatenate((cut, [len(places)])))
    first, last, name = places[cut], places[cut + size - 1], names[cut]
    step = np.where(size > 1, (last - first) // np.maximum(size - 1, 1), 0)
    at, lags = [], []
    for r in range(1, 5):
        pair = np.flatnonzero((name[r:] == name[:-r]) & (first[r:] - last[:-r] < 2 * k))
        if not len(pair):
            continue
        one, two = pair, pair + r
        by = np.maximum(np.maximum(step[one], step[two]), 1)
        apart = first[two] - first[one]
        low = np.maximum(1 - size[one], -((apart - k) // by))
        high = np.minimum(size[two] - 1, (2 * k - 1 - apart) // by)
        many = np.maximum(0, high - low + 1)
        shift = expand(low, many)
        by, start, apart = (np.repeat(x, many) for x in (by, first[one], apart))
        at.append(start + np.maximum(0, -shift) * by)
        lags.append(apart + shift * by)
    return _both(at, lags)


def _equal(codes, x, y, limit, way):
    """How many words from x and from y on are equal, one by one, up to the limit; ``way`` is 1 or -1."""
    out = np.zeros(len(x), np.int64)
    live = np.flatnonzero(limit > 0)
    width = 16
    while len(live):
        ahead = np.arange(width)
        here = x[live] + way * out[live]
        there = y[live] + way * out[live]
        inside = ahead < (limit[live] - out[live])[:, None]
        step = np.where(inside, way * ahead, 0)
        same = inside & (codes[here[:, None] + step] == codes[there[:, None] + step])
        run = np.where(same.all(1), width, np.argmin(same, 1))
        out[live] += run
        live = live[(run == width) & (out[live] < limit[live])]
        width = max(16, min(2 * width, AT_ONCE // max(1, len(live))))
    return out


def _stretches(codes, at, lag, k, begin, stop):
    """(lag, start, end) of the stretches on the diagonals of the seeds, each once."""
    if not len(at):
        return np.zeros((3, 0), np.int64)
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    # the furthest word covered on the lag is the last seed's place + k, as places rise
    fresh = np.flatnonzero(np.concatenate(([True], (lag[1:] != lag[:-1]) | (at[1:] > at[:-1] + k))))
    until = np.concatenate((fresh[1:], [len(at)])) - 1
    out = []
    for i in range(0, len(fresh), SEEDS):
        low, high, by = at[fresh[i : i + SEEDS]], at[until[i : i + SEEDS]] + k, lag[fresh[i : i + SEEDS]]
        low = low - _equal(codes, low - 1, low - 1 + by, low - begin[low], -1)
        end = high + _equal(codes, high, high + by, stop[low] - high - by, 1)
        out.append(np.stack((by, low, end)))
    return np.unique(np.concatenate(out, axis=1), axis=1)


def _smallest(codes, lag, start):
    """Whether the first ``lag`` words from each start are no power of a shorter word."""
    primitive = np.ones(len(lag), bool)
    factor = np.zeros(int(lag.max(initial=1)) + 1, np.int64)
    for p in range(2, len(factor)):
        if p * p >= len(factor):
            break
        if factor[p] == 0:
            own = factor[p * p :: p]
            own[own == 0] = p
    rest = lag.copy()
    while True:
        live = np.flatnonzero(primitive & (rest > 1))
        if not len(live):
            return primitive
        prime = np.where(factor[rest[live]] > 0, factor[rest[live]], rest[live])
        rest[live] //= prime
        part = lag[live] // prime
        limit = lag[live] - part
        primitive[live] = _equal(codes, start[live], start[live] + part, limit, 1) < limit


def find_runs(codes, offsets, least=LEAST):
    """(start, length, period) of all runs of the rows of word numbers, by start, then period."""
    row = rows_of(np.arange(len(codes)), offsets)
    begin, stop = offsets[row], offsets[1:][row]
    k = least // 2
    # grams of the first class, of 1, 2, 4 ... words and the rest
    name, size = _paired(codes, row, np.arange(len(codes))), 1
    by_size = {1: name}
    while 2 * size <= k:
        name = _longer(name, size, name, 2 * size, stop)
        size *= 2
        by_size[size] = name
    while size < k:
        more = max(s for s in by_size if size + s <= k)
        name = _longer(name, size, by_size[more], size + more, stop)
        size += more
    found, first = [], True
    while True:
        names, places = _occurrences(name)
        if not len(names):
            break
        at, lag = _near(names, places, 2 * k - 1) if first else _between(names, places, k)
        lag, start, end = _stretches(codes, at, lag, k, begin, stop)
        own = np.flatnonzero(end - start >= np.maximum(lag, least - lag))
        lag, start, end = lag[own], start[own], end[own]
        own = _smallest(codes, lag, start)
        found.append(np.stack((start, end - start + lag, lag))[:, own])
        name, first = _longer(name, k, name, 2 * k, stop), False
        k *= 2
    runs = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    return runs[:, np.lexsort((runs[2], runs[0]))]


def _looped(offsets, seed):
    """For each word the one that takes its place, where rows have a seed of a tenth of all."""
    n = np.diff(offsets)
    chosen = (seed >= 0) & (seed % 10 == 0) & (n > 0)
    draw = np.where(chosen, seed // 10, 0)
    from_word = draw % np.maximum(n, 1)
    period = 1 + (n - from_word) // (3 + draw % 8)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - offsets[:-1][row]
    ahead = place - from_word[row]
    moved = offsets[:-1][row] + from_word[row] + ahead % period[row]
    return np.where(chosen[row] & (ahead >= 0), moved, np.arange(len(row)))


def _spaced(data, start, end, row, n_rows):
    """The words of each row joined by one space, as a text column."""
    size = end - start
    glue = np.ones(len(row), np.int64)
    glue[np.flatnonzero(np.diff(row, append=-1))] = 0  # none behind a row's last word
    ends = np.cumsum(size + glue)
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    out[expand(ends - size - glue, size)] = data[expand(start, size)]
    total = np.bincount(row, weights=size + glue, minlength=n_rows).astype(np.int64)
    bounds = np.concatenate(([0], np.cumsum(total)))
    return pa.Array.from_buffers(pa.large_string(), n_rows, [None, pa.py_buffer(bounds), pa.py_buffer(out)]).cast(pa.string())


def runs_of_texts(column, seed=None, least=LEAST):
    """(n words, runs, collapsed text) of the texts of a column."""
    data, places = text_bytes(column)
    start, end, row = words(data, places, SPACED)
    n_rows = len(places) - 1
    n = counts_of(row, n_rows)
    offsets = np.concatenate(([0], np.cumsum(n)))
    codes = np.asarray(word_column(data, end - start).dictionary_encode().indices, np.int64)
    if seed is not None:
        moved = _looped(offsets, seed)
        codes, start, end = codes[moved], start[moved], end[moved]
    at, length, period = find_runs(codes, offsets, least)
    copies = np.zeros(len(codes) + 1, np.int64)
    np.add.at(copies, at + period, 1)
    np.add.at(copies, at + length, -1)
    keep = np.cumsum(copies[:-1]) == 0
    owner = row[at]
    many = np.concatenate(([0], np.cumsum(counts_of(owner, n_rows))))
    names = ("start", "length", "period")
    found = pa.StructArray.from_arrays([pa.array(x) for x in (at - offsets[owner], length, period)], names=names)
    lists = pa.ListArray.from_arrays(pa.array(many.astype(np.int32)), found)
    return [pa.array(n), lists, _spaced(data, start[keep], end[keep], row[keep], n_rows)]


NEW = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def find_periodic(docs: DataFrame, keep=None, least=LEAST, loop_seed: Column = None) -> DataFrame:
    """Rows of ``docs`` with n_words, runs and collapsed.

    ``loop_seed`` (a whole number, null for none) makes known cases: where it ends in 0, the words
    from a drawn one on repeat with a drawn period before the search.
    """
    keep = list(docs.columns if keep is None else keep)
    names = ("n_words", "runs", "collapsed")
    stay = [c for c in keep if c.lower() not in names]
    looping = loop_seed is not None
    seed = F.coalesce(loop_seed, F.lit(-1)) if looping else F.lit(-1)
    inner = docs.select(*(F.col(f"`{c}`").alias(f"p{i}") for i, c in enumerate(stay)), seed.cast("long").alias("seed"), "text")

    def run(part):
        own = np.asarray(part.column(len(stay)), np.int64) if looping else None
        return runs_of_texts(part.column(part.num_columns - 1), own, least)

    out = map_texts(inner, run, NEW, [*(f"p{i}" for i in range(len(stay))), "seed"])
    return out.select(*(F.col(f"p{i}").alias(c) for i, c in enumerate(stay)), *names)


def longest(runs: Column) -> Column:
    """The run of greatest length; of equal ones the first, then that of the smallest period."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    return F.struct((-best["col2"]).alias("start"), best["length"].alias("length"), (-best["col3"]).alias("period"))


def written(runs: Column) -> Column:
    """A line ``start,length,period`` for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
