"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

The patterns (password assignments, access keys, long hexadecimal strings) always count. Beside
them, every run of ``SHORTEST`` or more key characters that meets none of their findings is a
candidate: the network, in numpy, reads its characters with those around it, in windows that cover
all of a long one, and a candidate is a secret if its calibrated probability reaches the threshold
of its shape. The network is trained on the patterns' own findings, with and without what stands
around them, against all other runs.

Training starts from a network fitted on the driver to ``POSITIVES`` findings and ``NEGATIVES`` other
runs, the first by a hash of their windows. The different texts are then dealt to shards by their
hash; each shard trains that network on every finding and every window of every other run of its
texts, and the mean of the shards' networks, by their number of examples, is the result. Bare words
are trained on once for each shard, weighted by how often they occur there.

A quarter of the texts, by their hash, is set aside: no training sees them. Temperature, thresholds,
recall and precision come from all findings and all other runs there, counted by logit in steps of
1 / ``STEPS``: a threshold is the largest step that keeps ``RECALL`` of the findings of that shape,
whatever precision that leaves. A shape without findings set aside takes the threshold of all. With
findings only in one of the two parts, all texts are trained on and measured.

A scan does not look at each window: what the filters reach in blocks of ``BLOCK`` places bounds the
logits of all windows that begin there, and windows whose bound reaches no threshold are left out.

A null text is empty; without findings there is no network and only patterns count. Positions are in
code points, end exclusive.
"""

import copy
import math
import re
from functools import cache

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
    expand,
    map_texts,
    mix,
    only,
    rows_of,
    slices,
    small_batches,
    stored,
    text_bytes,
    text_total,
    words,
)

# The patterns of the contract.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = (b"passw", b"secret", b"token", b"api")

KINDS = ("assign", "access", "hex", "model")
POSITIVES, NEGATIVES = 4_000, 8_000
RECALL = 0.98
#: Shortest candidate, as short as the shortest value of an assignment.
SHORTEST = 6
BEFORE, INSIDE, AFTER = 16, 40, 8
WIDTH = BEFORE + INSIDE + AFTER
CHARACTERS, EMBEDDED, SPAN, FILTERS = 98, 8, 5, 24
PLACES = WIDTH - SPAN + 1
#: Places of a text whose filters are held at a time.
HELD = 1 << 14
#: Bytes of text that one shard trains on, findings beside a step's other runs, and least steps.
SHARD_BYTES, BESIDE, LEAST_STEPS = 8 << 20, 32, 200
#: One text of so many is set aside; logits are counted in steps of 1 / STEPS up to MOST_LOGIT.
ASIDE, STEPS, MOST_LOGIT = 4, 64, 64
#: Places that a bound holds for, and the blocks of them that a window may meet.
BLOCK = 16
MET = (BLOCK - 1 + PLACES - 1) // BLOCK + 1
#: Windows that are filtered one by one at a time; with more than one of so many left, all are filtered where they stand.
ALONE, FEW = 4096, 8
#: Less than any filter reaches.
NONE = np.float32(-1e30)
#: Fixed point of weights that are summed.
FIXED = 1 << 20

_KEY = byte_table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
_DIGIT = byte_table(range(0x30, 0x3A))
_UPPER, _LOW = byte_table(range(0x41, 0x5B)), byte_table(range(0x61, 0x7B))
_HEX = byte_table(b"0123456789abcdef")
# 0: nothing, 1: a line end or control, 2..96: printable, 97: beyond ASCII
_CODE = np.full(256, CHARACTERS - 1, np.uint8)
_CODE[:128] = np.maximum(np.arange(128) - 30, 1)
_CODE[127] = 1
SPANS = "array<struct<kind:string,start:long,end:long>>"


def base_spans(text):
    """(kind, start, end) of the patterns' findings, in the order of start and kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=_by_place)


def _by_place(span):
    return span[1], KINDS.index(span[0]), span[2]


def _suspects(data, offsets):
    """Rows that may have a pattern's finding: only these are read by the patterns."""
    n = len(offsets) - 1
    maybe = np.zeros(n, bool)
    start, end, row = words(data, offsets, _HEX)
    maybe[row[end - start >= 24]] = True
    place = np.flatnonzero((data[:-3] == 0x41) & (data[1:-2] == 0x4B) & (data[2:-1] == 0x49) & (data[3:] == 0x41))
    maybe[rows_of(place, offsets)] = True
    for r in np.unique(rows_of(np.flatnonzero((data == 0x3A) | (data == 0x3D)), offsets)):
        if not maybe[r]:
            low = LOWER[data[offsets[r] : offsets[r + 1]]].tobytes()
            maybe[r] = any(k in low for k in KEYWORDS)
    return np.flatnonzero(maybe)


def _points(data, offsets):
    """Code points before each byte of its row, by a running count."""
    count = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return count, count[offsets[:-1]]


def _runs(data, offsets):
    """(start, end, row) of runs of key characters."""
    start, end, row = words(data, offsets, _KEY)
    long = end - start >= SHORTEST
    return start[long], end[long], row[long]


def _shape(data, start, end):
    """0: hexadecimal, 1: capitals and digits, 2: other."""
    out = np.full(len(start), 2)
    if len(start) and (size := end - start).min() > 0 and size.sum() * FEW < len(data):  # only their own bytes are read
        data, end = data[expand(start, size)], np.cumsum(size)
        start = end - size
    for shape, table in ((1, _UPPER | _DIGIT), (0, _HEX)):
        count = np.concatenate(([0], np.cumsum(table[data])))
        out[count[end] - count[start] == end - start] = shape
    return out


def _coded(data, offsets):
    """(codes with a window's width of nothing before each row and after the last, shift of each row)."""
    shift = (np.arange(len(offsets) - 1) + 1) * WIDTH
    codes = np.zeros(len(data) + len(offsets) * WIDTH, np.uint8)
    coded = _CODE[data]
    for start, end, more in zip(offsets[:-1].tolist(), offsets[1:].tolist(), shift.tolist(), strict=True):
        codes[start + more : end + more] = coded[start:end]
    return codes, shift


def _windows(start, end):
    """(first place, candidate) of windows: INSIDE characters of the candidate with their surroundings."""
    many = np.maximum(-(-(end - start) // INSIDE), 1)
    who = np.repeat(np.arange(len(start)), many)
    part = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
    first = np.maximum(np.minimum(start[who] + part * INSIDE, end[who] - INSIDE), start[who])
    return first - BEFORE, who


def _flat(windows):
    """Windows as codes one after another, the place of each, and the start and end of its run."""
    at = np.arange(len(windows)) * WIDTH
    own = windows >> 7
    codes = np.concatenate(((windows & 127).ravel(), np.zeros(WIDTH, np.uint8)))
    return codes, at, at + own.argmax(axis=1), at + WIDTH - own[:, ::-1].argmax(axis=1)


def _packed(windows):
    """Runs of windows without what stands around them, as close as no filter sees two of them.

    The codes, the first place of each, the start and end of its run, and where its places stop: of
    those that see nothing but what is around the run, one stands for all.
    """
    own = windows >> 7 == 1
    size = own.sum(axis=1)
    first = np.cumsum(size + SPAN) - size - SPAN
    start, end = first + SPAN, first + SPAN + size
    codes = np.zeros(int((size + SPAN).sum()) + WIDTH, np.uint8)
    codes[expand(start, size)] = (windows & 127)[own]
    return codes, first, start, end, np.minimum(end, start + PLACES - BEFORE)


def _pairs(codes):
    """The codes and the codes of each two."""
    code = codes.astype(np.int32)
    return code, code[:-1] * CHARACTERS + code[1:]


def _portions(first):
    """Slices of the windows, ascending, that begin in the same ``HELD`` places."""
    bounds = np.searchsorted(first, np.arange(0, (first[-1] if len(first) else 0) + 2 * HELD, HELD))
    return [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a]


def _filtered(tables, coded, base, n):
    """What each filter gives at ``n`` places from ``base`` on where no character is the run's own."""
    rooms, spare, *_ = _rooms()
    place = rooms[0, :n]
    for i, (table, pairs, j) in enumerate(tables):
        out = np.take(table, coded[pairs][base + j : base + j + n], axis=0, out=spare[:n] if i else place, mode="clip")
        if i:
            place += out
    return place


def _reach(tables, coded, first, start, end, stop=None, placed=False):
    """The most that each filter reaches in each window of a portion; ``placed``: with its place in the last 7 bits.

    The filters are the same for all windows but where the run begins and ends: each place is
    filtered once, from tables of characters, and maxima of ranges come from those of 1, 2, 4 .. places.
    A window has ``PLACES`` places, or those before ``stop``.
    """
    tables, own = tables
    base = int(first[0])
    n = min(int(first[-1]) - base + PLACES, len(coded[0]) - SPAN + 1 - base)
    rooms, _, here, fours = _rooms()
    place = _filtered(tables, coded, base, n)
    if placed:
        _put(place, here[:n])
    for level in range(1, len(rooms)):
        half, low = 1 << (level - 1), rooms[level - 1]
        size = max(n - 2 * half + 1, 0)
        np.maximum(low[:size], low[half : half + size], out=rooms[level, :size])
    a, s, e = first - base, start - base, end - base
    stop = a + PLACES if stop is None else stop - base
    flat = rooms.reshape(-1, FILTERS)

    def more(top, add):
        where = top.view(np.int32) & 127 if placed else None
        top += add
        if placed:
            _put(top, where)
        return top

    def ranges(low, high):
        size = high - low
        level = np.frexp(np.maximum(size, 1))[1] - 1
        at = level * rooms.shape[1]
        # the last row is none
        some = size > 0
        top = np.take(flat, np.where(some, at + low, len(flat) - 1), axis=0, mode="clip")
        return np.maximum(top, np.take(flat, np.where(some, at + high - (1 << level), len(flat) - 1), axis=0, mode="clip"), out=top)

    best = ranges(a, np.minimum(s - SPAN + 1, stop))
    np.maximum(best, more(ranges(np.maximum(s, a), np.minimum(e - SPAN + 1, stop)), own.sum(axis=0)), out=best)
    np.maximum(best, ranges(np.maximum(e, a), stop), out=best)
    back = np.arange(SPAN - 1, 0, -1)
    # where a filter sees an end of the run
    for edge, add in ((s, [own[j:].sum(axis=0) for j in back]), (e, [own[:j].sum(axis=0) for j in back])):
        top = more(fours[np.clip(edge - SPAN + 1, 0, len(fours) - 1)], np.array(add))
        out = np.flatnonzero((edge - SPAN + 1 < a) | (edge > stop))
        if len(out):
            at = edge[out, None] - back
            seen = (at >= a[out, None]) & (at < stop[out, None])
            top[out] = np.where(seen[:, :, None], top[out], NONE)
        for j in range(SPAN - 1):
            np.maximum(best, top[:, j], out=best)
    return best


@cache
def _rooms():
    """What a process filters the places of a portion in, again and again.

    Maxima of 1, 2, 4 .. places; as many places more; the places' last 7 bits; each four places on end.
    """
    size = HELD + PLACES + SPAN
    rooms = np.full((PLACES.bit_length(), size, FILTERS), NONE, np.float32)
    here = np.repeat((np.arange(size, dtype=np.int32) & 127)[:, None], FILTERS, axis=1)
    fours = np.lib.stride_tricks.sliding_window_view(rooms[0].ravel(), (SPAN - 1) * FILTERS)[::FILTERS]
    return rooms, np.empty((size, FILTERS), np.float32), here, fours.reshape(-1, SPAN - 1, FILTERS, copy=False)


def _put(values, where):
    """Write small numbers into the last 7 bits of floats."""
    bits = values.view(np.int32)
    bits &= ~127
    bits |= where


def _moments(weights):
    return [[np.zeros_like(w) for w in weights] for _ in range(2)]


def _least_kept(share, count):
    """The largest value that keeps ``RECALL`` of the counted ones."""
    order = np.argsort(share, kind="stable")
    below = np.cumsum(count[order])
    return share[order][np.searchsorted(below, math.floor((below[-1] - 1) * (1 - RECALL)), "right")]


class Network:
    """Embedding, one convolution, the maximum over places, one logit; calibrated by a temperature."""

    def __init__(self, windows, label, shape, example, seed=3):
        """``example`` numbers the examples: windows of one are set aside together."""
        rng = np.random.default_rng(seed)
        self.w = [
            rng.normal(0, 0.5, (CHARACTERS, EMBEDDED)),
            rng.normal(0, 1 / np.sqrt(SPAN * (EMBEDDED + 1)), (SPAN * (EMBEDDED + 1), FILTERS)),
            np.zeros(FILTERS),
            rng.normal(0, 0.2, FILTERS),
            np.zeros(()),
        ]
        aside = (rng.random(example.max() + 1) < 0.25)[example]
        self._train(windows[~aside], label[~aside].astype(float), rng)
        logit, y = self._logit_of(windows[aside]), label[aside]
        grid = np.exp(np.linspace(-1, 2.5, 71))
        self.temperature = min(grid, key=lambda t: np.mean(np.logaddexp(0, logit / t) - y * logit / t)) if len(y) else 1.0
        if not (y == 1).any():  # too few examples to set findings aside
            aside[:] = True
            logit, y = self._logit_of(windows), label
        share, shape = self._share(logit), shape[aside]
        self.threshold = np.full(3, np.quantile(share[y == 1], 1 - RECALL, method="lower"))
        self.recall, self.precision = np.full((2, 3), np.nan)  # of each shape, nan without examples
        for s in range(3):
            own = shape == s
            found = share[own & (y == 1)]
            if len(found):
                self.threshold[s] = np.quantile(found, 1 - RECALL, method="lower")
                self.recall[s] = np.mean(found >= self.threshold[s])
                self.precision[s] = np.mean(y[own & (share >= self.threshold[s])])

    def _share(self, logit):
        return 1 / (1 + np.exp(-np.clip(logit / self.temperature, -40, 40)))

    def _patches(self, windows):
        own = (windows >> 7).astype(float)[:, :, None]
        x = np.concatenate((self.w[0][windows & 127], own), axis=2)
        return np.concatenate([x[:, i : i + PLACES] for i in range(SPAN)], axis=2)

    def _logit_of(self, windows):
        """The logits of windows as they are trained on."""
        return self.logit(*_flat(windows))

    def _tables(self, two):
        """Filters as tables of each character, or of each ``two``, and what the run's own characters add.

        A table comes with whether it is of two and with the place of its first in the filter.
        """
        w = self.w[1].reshape(SPAN, EMBEDDED + 1, FILTERS)
        one = [(self.w[0] @ w[j, :EMBEDDED]).astype(np.float32) for j in range(SPAN)]
        tables = [(t, 0, j) for j, t in enumerate(one)]
        if two:
            tables = [((one[j][:, None] + one[j + 1]).reshape(-1, FILTERS), 1, j) for j in (0, 2)] + tables[4:]
        return tables, w[:, EMBEDDED].astype(np.float32)

    def logit(self, codes, first, start, end):
        """Logit of each window of ``codes`` from ``first`` on, ascending, about the run start..end."""
        tables = self._tables(two=True)
        coded = _pairs(codes)
        out = np.zeros(len(first))
        for mine in _portions(first):
            best = _reach(tables, coded, first[mine], start[mine], end[mine])
            shown = np.maximum(best + self.w[2], 0)
            out[mine] = (shown * self.w[3]).sum(axis=1) + self.w[4]
        return out

    def _slope(self, coded, first, start, end, stop, y, weight, tables=None):
        """Gradient of the weighted loss of the windows of a portion."""
        base = first[0]
        code = coded[0][base : first[-1] + WIDTH].astype(np.int64)
        first, start, end, stop = first - base, start - base, end - base, None if stop is None else stop - base
        best = _reach(tables or self._tables(two=False), (code,), first, start, end, stop, placed=True)
        where = (best.view(np.int32) & 127) - (first & 127).astype(np.int32)[:, None] & 127
        hidden = best + self.w[2].astype(np.float32)
        shown = np.maximum(hidden, 0)
        error = (1 / (1 + np.exp(-np.clip(shown @ self.w[3] + self.w[4], -40, 40))) - y) * weight
        live = np.flatnonzero(hidden > 0)
        window = live // FILTERS
        filters = live - window * FILTERS
        each = error[window] * self.w[3][filters]
        where = where.ravel()[live]
        at = first[window] + where
        code *= FILTERS
        w = self.w[1].reshape(SPAN, EMBEDDED + 1, FILTERS)
        letters, spans = np.zeros_like(self.w[0]), np.zeros_like(w)
        for j in range(SPAN):
            met = np.take(code[j:], at, mode="clip")
            met += filters
            met = np.bincount(met, each, CHARACTERS * FILTERS).reshape(-1, FILTERS)
            letters += met @ w[j, :EMBEDDED].T
            spans[j, :EMBEDDED] = self.w[0].T @ met
        # the filter's characters that are the run's own, from where to where
        for edge, sign in ((start, 1), (end, -1)):
            place = (edge - first)[window] - where
            np.minimum(np.maximum(place, 0, out=place), SPAN, out=place)
            place *= FILTERS
            place += filters
            change = np.bincount(place, each, (SPAN + 1) * FILTERS).reshape(-1, FILTERS)
            spans[:, EMBEDDED] += sign * np.cumsum(change, axis=0)[:SPAN]
        toward = np.bincount(filters, each, FILTERS)
        return [letters, spans.reshape(self.w[1].shape), toward, shown.T @ error, error.sum()]

    def fit(self, others, found, rng):
        """Steps over all portions of other runs, each beside some of the findings.

        ``others`` are (codes, first, start, end, stop, weight), without ``stop`` where the windows are
        whole; ``found`` windows.
        """
        moments, taken, step = _moments(self.w), [0, 0], 0
        for _ in range(max(1, LEAST_STEPS // max(len(others), 1))):
            for i in rng.permutation(len(others)):
                codes, *places, stop, weight = others[i]
                bare = stop is not None
                tables = self._tables(two=False)
                slope = self._slope((codes,), *places, stop, 0.0, weight / (2 * weight.sum()), tables)
                beside = found[(taken[bare] + np.arange(min(BESIDE, len(found)))) % len(found)]
                taken[bare] += len(beside)
                codes, *places = _packed(beside) if bare else (*_flat(beside), None)
                more = self._slope((codes,), *places, 1.0, 1 / (2 * len(beside)), tables)
                step += 1
                self._move([a + b for a, b in zip(slope, more, strict=True)], moments, step, 0.001)

    def _move(self, slope, moments, step, rate):
        """A step of Adam."""
        first, second = moments
        for i, g in enumerate(slope):
            g = g + 1e-5 * self.w[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            fair = first[i] / (1 - 0.9**step), second[i] / (1 - 0.999**step)
            self.w[i] = self.w[i] - rate * fair[0] / (np.sqrt(fair[1]) + 1e-8)

    def calibrate(self, label, shape, place, count):
        """Temperature, thresholds, recall and precision from counts of examples by step of their logit."""
        logit = place / STEPS
        grid = np.exp(np.linspace(-1, 2.5, 71))
        middle = logit + 0.5 / STEPS
        self.temperature = min(grid, key=lambda t: np.sum(count * (np.logaddexp(0, middle / t) - label * middle / t)))
        share = self._share(logit)
        self.recall, self.precision = np.full((2, 3), np.nan)
        self.threshold = np.full(3, _least_kept(share[label == 1], count[label == 1]))
        for s in range(3):
            own = (shape == s) & (label == 1)
            if count[own].sum():
                self.threshold[s] = _least_kept(share[own], count[own])
                kept = (shape == s) & (share >= self.threshold[s])
                self.recall[s] = count[own & kept].sum() / count[own].sum()
                self.precision[s] = count[own & kept].sum() / count[kept].sum()

    def _train(self, windows, y, rng):
        moments = _moments(self.w)
        step, width = 0, EMBEDDED + 1
        for _ in range(max(6, 400 // max(len(y) // 64, 1))):
            for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
                step += 1
                patches = self._patches(windows[at])
                all_ = patches @ self.w[1]
                place = all_.argmax(axis=1)
                rows = np.arange(len(at))[:, None]
                hidden = np.take_along_axis(all_, place[:, None], 1)[:, 0] + self.w[2]
                shown = np.maximum(hidden, 0)
                error = (1 / (1 + np.exp(-np.clip(shown @ self.w[3] + self.w[4], -40, 40))) - y[at]) / len(at)
                back = np.outer(error, self.w[3]) * (hidden > 0)
                best = patches[rows, place]  # of each filter
                slope = [np.zeros_like(self.w[0]), np.einsum("bfp,bf->pf", best, back), back.sum(0), shown.T @ error, error.sum()]
                toward = np.einsum("bf,pf->bfp", back, self.w[1]).reshape(len(at), FILTERS, SPAN, width)[..., :EMBEDDED]
                code = windows[at][rows[:, :, None], place[:, :, None] + np.arange(SPAN)] & 127
                np.add.at(slope[0], code, toward)
                self._move(slope, moments, step, 0.004)

    def best(self, codes, start, end):
        """Logit of the best window of each candidate start..end of ``codes``."""
        first, who = _windows(start, end)
        best = np.full(len(start), -np.inf)
        np.maximum.at(best, who, self.logit(codes, first, start[who], end[who]))
        return best

    def _most(self, coded):
        """No less than the logit of any window that begins in each ``BLOCK`` places.

        A filter whose weight is positive counts with the most it reaches in all blocks such a window may
        meet, another with the most it reaches in the blocks that all such windows hold.
        """
        tables, own = self._tables(two=True)
        adds = [np.zeros_like(own[0]), *(own[j:].sum(axis=0) for j in range(SPAN)), *(own[:j].sum(axis=0) for j in range(1, SPAN))]
        more, less = np.max(adds, axis=0), np.min(adds, axis=0)
        n = max(len(coded[0]) - SPAN + 1, 0)
        bias, weight = self.w[2].astype(np.float32), self.w[3].astype(np.float32)
        high_bias, low_bias = more + bias, less + bias
        up, down = np.maximum(weight, 0), np.minimum(weight, 0)
        # far more than what rounding takes
        slack = np.abs(weight) / (1 << 14)
        fixed = (np.abs(more) + np.abs(less) + 2 * np.abs(bias) + 1) @ slack + self.w[4]
        bounds = []
        for base in range(0, n, HELD):
            blocks = -(-min(HELD, n - base) // BLOCK)
            rows = (blocks + MET - 1) * BLOCK
            place = _filtered(tables, coded, base, min(rows, n - base))
            top = _rooms()[0][0, :rows]
            top[len(place) :] = NONE
            top = top.reshape(-1, BLOCK * FILTERS)
            for half in (BLOCK >> k for k in range(1, BLOCK.bit_length())):
                top = np.maximum(top[:, : half * FILTERS], top[:, half * FILTERS :])
            low = top[1 : 1 + blocks]
            for k in range(2, PLACES // BLOCK):
                low = np.maximum(low, top[k : k + blocks])
            high = np.maximum(low, top[:blocks])
            for k in range(PLACES // BLOCK, MET):
                high = np.maximum(high, top[k : k + blocks])
            high, low = high + high_bias, low + low_bias
            bounds.append(np.maximum(high, 0) @ up + np.maximum(low, 0) @ down + np.abs(high) @ slack + fixed)
        return np.concatenate(bounds) if bounds else np.zeros(0)

    def secret(self, codes, start, end, shape):
        """Candidates whose best window reaches the threshold of their shape; ``shape`` gives that of chosen ones.

        Windows whose bound stays below all thresholds are not filtered one by one.
        """
        first, who = _windows(start, end)
        may = self._share(self._most(_pairs(codes)))[first // BLOCK] >= self.threshold.min()
        left = np.flatnonzero(may)
        best = np.full(len(start), -np.inf)
        if len(left) * FEW > len(first):
            best = self.best(codes, start, end)
        else:
            for some in np.array_split(left, -(-len(left) // ALONE)) if len(left) else ():
                at = first[some, None] + np.arange(WIDTH)
                inside = (at >= start[who[some], None]) & (at < end[who[some], None])
                np.maximum.at(best, who[some], self._logit_of(codes[at] | (np.uint8(128) * inside)))
        share = np.where(np.isneginf(best), 0.0, self._share(best))
        likely = np.flatnonzero(share >= self.threshold.min())
        return likely[share[likely] >= self.threshold[shape(likely)]] if len(likely) else likely


def _free(start, end, taken, n_bytes):
    """Runs that overlap none of the (start, end) byte spans of all rows."""
    if not taken:
        return np.ones(len(start), bool)
    covered = np.zeros(n_bytes + 1, np.int32)
    for s, e in (p for spans in taken.values() for p in spans):
        covered[s + 1 : e + 1] = 1
    covered = np.cumsum(covered, out=covered)
    return covered[end] == covered[start]


def _base(column, data, offsets):
    """Findings of the patterns by row, and their byte spans."""
    found, taken = {}, {}
    for r in _suspects(data, offsets).tolist():
        spans = base_spans(column[r].as_py() or "")
        if spans:
            found[r] = spans
            lead = np.flatnonzero((data[offsets[r] : offsets[r + 1]] & 0xC0) != 0x80)
            place = offsets[r] + np.append(lead, offsets[r + 1] - offsets[r])[[s[1:] for s in spans]]
            taken[r] = [tuple(p) for p in place.tolist()]
    return found, taken


def _findings(data, found, taken):
    """(start, end, row) in bytes of what the patterns found; of an assignment only the value."""
    own = [(s, e, r) for r, spans in taken.items() for s, e in spans]
    start, end, row = np.array(own, np.int64).reshape(-1, 3).T
    kinds = [k for r in found for k, _, _ in found[r]]
    for i in np.flatnonzero(np.array(kinds) == "assign"):
        value = ASSIGN.match(data[start[i] : end[i]].tobytes().decode()).start(2)
        start[i] += value
    return start, end, row


def _both(column):
    """Of a slice: (bytes, codes, findings, other runs), the last two as (start, end, shift)."""
    data, offsets = text_bytes(column)
    found, taken = _base(column, data, offsets)
    codes, shift = _coded(data, offsets)
    start, end, row = _findings(data, found, taken)
    other = _runs(data, offsets)
    free = _free(*other[:2], taken, len(data))
    left, right, place = (c[free] for c in other)
    return data, codes, (start, end, shift[row]), (left, right, shift[place])


def train(docs: DataFrame):
    """The network, from the patterns' findings and the other runs in all rows; None without any finding."""
    texts = docs.select(F.xxhash64("text").alias("key"), "text")
    aside = F.pmod("key", F.lit(ASIDE)) == 0
    measured, trained = texts.filter(aside), texts.filter(~aside)
    with only(docs.sparkSession):
        start = _start(trained)
        if start is None:
            start, trained, measured = _start(texts), texts, texts
            if start is None:
                return None
        network = _mean(trained, *start)
        counts = _counts(measured, network)
        if not (counts[0] == 1).any():
            counts = _counts(texts, network)
        network.calibrate(*counts)
    return network


def _start(texts):
    """A network from a bounded sample, and its findings' windows; None without any finding."""

    def run(batches):
        held = [[], []]
        for part in slices(batches):
            data, codes, found, other = _both(part.column("text"))
            chain = Hashes(BYTE_CODE[codes])
            for label, own, most in ((0, other, NEGATIVES), (1, found, POSITIVES)):
                # what cannot be among the first is not sorted
                last = held[label][0][0][-1] if held[label] and len(held[label][0][0]) == most else None
                held[label].append(_examples(data, codes, chain, *own, most, last))
                held[label] = [_least(held[label], most)]
        for label in (0, 1):
            for key, window, shape in held[label]:
                arrays = [pa.array(np.full(len(key), label, np.int32)), pa.array(key.view(np.int64))]
                arrays += [pa.array(shape.astype(np.int32)), pa.array([w.tobytes() for w in window], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["label", "key", "shape", "window"])

    schema = "label int, key long, shape int, window binary"
    sample = []
    # both samples come from one scan
    rows = stored(small_batches(texts).select("text").mapInArrow(run, schema), "secret_examples")
    rows = rows.dropDuplicates(["label", "key"])
    # the first by their hash: each task has kept its own first, which hold the first of all
    for label, most in ((1, POSITIVES), (0, NEGATIVES)):
        own = rows.filter(F.col("label") == label).orderBy("key", "window").limit(most)
        sample += own.collect()
        if not sample:
            return None
    window = np.array([np.frombuffer(r["window"], np.uint8) for r in sample])
    label, shape = (np.array([r[c] for r in sample]) for c in ("label", "shape"))
    # again without what stands around them
    bare = np.where(window & 128, window, np.uint8(0))
    network = Network(
        np.concatenate((window, bare)), np.tile(label, 2), np.tile(shape, 2), np.tile(np.arange(len(label)), 2)
    )
    return network, window[label == 1]


def _mean(texts, start, found):
    """The mean of the networks that the shards of the texts train from ``start``, by their number of examples."""
    shards = max(1, math.ceil(text_total(texts) / SHARD_BYTES))
    shared = texts.sparkSession.sparkContext.broadcast((start, found))

    def differ(batches):
        # a task sends one copy of a text
        seen = np.zeros(0, np.int64)
        for batch in batches:
            key = np.asarray(batch.column("key"))
            one = np.zeros(len(key), bool)
            one[np.unique(key, return_index=True)[1]] = True
            one &= ~np.isin(key, seen)
            seen = np.concatenate((seen, key[one]))
            yield batch.filter(pa.array(one))

    def run(batches):
        last, kept = None, []
        for batch in batches:
            key = np.asarray(batch.column("key"))
            if len(key):
                new = np.concatenate(([last is None or key[0] != last], key[1:] != key[:-1]))
                kept.append(batch.filter(pa.array(new)))
                last = key[-1]
        if kept:
            model, found = shared.value
            model = copy.deepcopy(model)
            shard = pa.Table.from_batches(kept).combine_chunks().to_batches()
            n = _train_shard(model, shard, found)
            total = [np.rint(w * FIXED).astype(np.int64).ravel() * n for w in model.w]
            total = np.concatenate([*total, [n]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["place", "total"])

    dealt = small_batches(texts).mapInArrow(differ, texts.schema).repartition(shards, "key").sortWithinPartitions("key")
    sums = dealt.mapInArrow(run, "place long, total long").groupBy("place").agg(F.sum("total").alias("total"))
    sums = stored(sums, "secret_weights").orderBy("place").collect()  # as many as the network has weights
    network = copy.deepcopy(start)
    total = np.array([r["total"] for r in sums], float)
    if len(total) and total[-1]:
        at = np.cumsum([w.size for w in start.w])
        means = np.split(total[:-1] / total[-1] / FIXED, at[:-1])
        network.w = [m.reshape(w.shape) for m, w in zip(means, start.w, strict=True)]
    return network


def _train_shard(model, batches, found):
    """Train on all findings and other runs of the batches; ``found`` stands in without findings. Their number."""
    others, windows, words = [], [], []
    n = 0
    for part in slices(batches):
        _, codes, (start, end, shift), (left, right, away) = _both(part.column("text"))
        windows.append(_window(codes, start + shift - BEFORE, np.minimum(end - start, WIDTH - BEFORE)))
        left, right = left + away, right + away
        first, who = _windows(left, right)
        n += len(first) + len(start)
        for mine in _portions(first):
            others.append((codes, first[mine], left[who[mine]], right[who[mine]], None, np.ones(mine.stop - mine.start)))
        # every word without what stands around it, once
        size = np.minimum(right - left, WIDTH - BEFORE)
        key, one, count = np.unique(Hashes(BYTE_CODE[codes]).of(left, left + size), return_index=True, return_counts=True)
        words.append((key, _window(codes, left[one] - BEFORE, size[one]), count))
    key, bare, count = (np.concatenate([w[i] for w in words]) for i in range(3))
    _, one, own = np.unique(key, return_index=True, return_inverse=True)
    bare, count = bare[one], np.bincount(own, count, len(one))
    codes, *places = _packed(bare)
    others += [(codes, *(p[mine] for p in places), count[mine]) for mine in _portions(places[0])]
    windows = np.concatenate(windows)
    if others:
        model.fit(others, windows if len(windows) else found, np.random.default_rng(3))
    return n


def _counts(texts, network):
    """(label, shape, step of the logit, count) of all findings, with and without surroundings, and other runs."""
    shared = texts.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        held = np.zeros(2 * 3 * 2 * STEPS * MOST_LOGIT, np.int64)
        for part in slices(batches):
            model = shared.value
            data, codes, (start, end, shift), (left, right, away) = _both(part.column("text"))
            window = _window(codes, start + shift - BEFORE, np.minimum(end - start, WIDTH - BEFORE))
            window = np.concatenate((window, np.where(window & 128, window, np.uint8(0))))
            for label, logit, shape in (
                (1, model._logit_of(window), np.tile(_shape(data, start, end), 2)),
                (0, model.best(codes, left + away, right + away), _shape(data, left, right)),
            ):
                step = np.clip(np.floor(logit * STEPS) + STEPS * MOST_LOGIT, 0, 2 * STEPS * MOST_LOGIT - 1).astype(np.int64)
                held += np.bincount((label * 3 + shape) * 2 * STEPS * MOST_LOGIT + step, minlength=len(held))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["place", "count"])

    counted = small_batches(texts).select("text").mapInArrow(run, "place long, count long")
    rows = stored(counted.groupBy("place").agg(F.sum("count").alias("count")), "secret_counts").orderBy("place").collect()
    place, count = np.array([tuple(r) for r in rows], np.int64).reshape(-1, 2).T
    kind, step = np.divmod(place, 2 * STEPS * MOST_LOGIT)
    return kind // 3, kind % 3, step - STEPS * MOST_LOGIT, count


def _examples(data, codes, chain, start, end, shift, most, last=None):
    """(hash, window, shape) of the first window of each run; of the ``most`` first by their hash, up to ``last``."""
    first = start + shift - BEFORE
    own = np.minimum(end - start, WIDTH - BEFORE)
    key = mix(chain.of(first, first + WIDTH) + own.astype(U64)) >> U64(1)
    early = np.arange(len(key)) if last is None else np.flatnonzero(key <= last)
    key, one = np.unique(key[early], return_index=True)
    key, one = key[:most], early[one[:most]]
    return key, _window(codes, first[one], own[one]), _shape(data, start[one], end[one])


def _window(codes, first, own):
    """Windows from ``first`` on, whose run has ``own`` characters there."""
    at = np.arange(WIDTH)
    inside = (at >= BEFORE) & (at < BEFORE + own[:, None])
    return codes[first[:, None] + at] | (np.uint8(128) * inside)


def _least(parts, most):
    key, window, shape = (np.concatenate([p[i] for p in parts]) for i in range(3))
    key, first = np.unique(key, return_index=True)
    first = first[:most]
    return key[:most], window[first], shape[first]


def scan(docs: DataFrame, network=None, keep=None) -> DataFrame:
    """Rows of ``docs`` with spans: the patterns' findings and those of the network."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(part):
        column = part.column(part.num_columns - 1)
        data, offsets = text_bytes(column)
        found, taken = _base(column, data, offsets)
        model = shared.value
        if model is not None:
            start, end, row = _runs(data, offsets)
            free = _free(start, end, taken, len(data))
            start, end, row = start[free], end[free], row[free]
            codes, shift = _coded(data, offsets)
            secret = model.secret(codes, start + shift[row], end + shift[row], lambda i: _shape(data, start[i], end[i]))
            count, before = _points(data, offsets) if len(secret) else (None, None)
            for i in secret:
                r = int(row[i])
                own = found.setdefault(r, [])
                own.append(("model", int(count[start[i]] - before[r]), int(count[end[i]] - before[r])))
                own.sort(key=_by_place)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        rows = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in found.get(r, ())] for r in range(part.num_rows)]
        return [pa.array(rows, pa.list_(kind))]

    return map_texts(docs, run, f"spans {SPANS}", keep)


def count_kind(kind, spans="spans"):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def written(spans):
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text, spans, mark="[SECRET]"):
    """``text`` with each stretch that spans cover replaced by ``mark``; spans are in order of start."""

    def cut(done, s):
        piece = F.substring(text, done["end"].cast("int") + 1, (s["start"] - done["end"]).cast("int"))
        grown = F.struct(
            F.when(s["start"] < done["end"], done["out"]).otherwise(F.concat(done["out"], piece, F.lit(mark))).alias("out"),
            F.greatest(done["end"], s["end"]).alias("end"),
        )
        return grown

    empty = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(
        spans, empty, cut, lambda d: F.concat(d["out"], F.substring(text, d["end"].cast("int") + 1, F.length(text)))
    )
