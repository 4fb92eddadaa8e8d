"""Packing of tokenized documents into sequences of a fixed size, by exact complements.

A document becomes its token ids and an end id, cut into pieces only where it is longer than a
sequence. The plan works on the number of pieces of each length, so its size is that of a sequence
and not of the corpus. It opens a sequence with the longest piece left and seeks lengths that fill
the rest exactly: one, two or three of them, found in an index of all such sums (how many lengths,
pairs and triples add up to each value, kept up to date as lengths run out). Without any, the longest piece that
fits goes in (the best fit), and the search starts again. A filled pattern is used as often as the pieces last.

Pieces are then numbered within their length, without a shuffle of a length: each task numbers its
own while it writes them, and the counts of the tasks before it are added. The number gives the sequence and
the place there. A length that holds any share of all rows is dealt over as many tasks as wrote it.

Null and empty texts are one end id; rows without or with repeated doc_id are rows like all others.
"""

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .arrays import LOWER, SPACED, counts_of, expand, fields, runs, slices, small_batches, stored, text_bytes

SIZE = 4096
END = 1
#: Bytes of text that are tokenized together: the more, the fewer units are met again.
TOGETHER = 8 << 20
#: Units whose ids a worker remembers; beyond, it starts afresh.
KNOWN = 1 << 20
#: Units given to the tokenizer at once.
UNITS = 1 << 15
# The pattern by which the tokenizer parts words, and the end of a word in its pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

_LETTER, _DIGIT, _SIGN, _OTHER = range(1, 5)


def _kinds():
    """Kinds of bytes whose runs the pattern surely parts; all else is left to the tokenizer by words."""
    kind = np.full(256, _OTHER, np.uint8)
    kind[0x21:0x7F] = _SIGN
    kind[ord("0") : ord("9") + 1] = _DIGIT
    kind[ord("A") : ord("Z") + 1] = kind[ord("a") : ord("z") + 1] = _LETTER
    kind[ord("'")] = _OTHER
    kind[0x80:0xC0] = kind[0xC3:0xC6] = _LETTER  # U+00C0 to U+017F
    return kind


KIND = _kinds()
#: Byte pairs within those kinds that need the tokenizer: two signs, a letter that becomes two, a special token.
_ODD = [(0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0), (ord("<"), ord("|"))]


def word_column(data, size):
    """The words of the text, of these sizes, as one Arrow column."""
    return _column(data[SPACED[data]], np.concatenate(([0], np.cumsum(size))))


def _column(packed, offsets):
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(packed)])


class Tokens:
    """Ids of the units of words between white space; a worker tokenizes each distinct unit once.

    Words of plain signs, digits and Latin letters are parted where the tokenizer's own pattern
    parts them, which leaves far fewer distinct units; other words are units as they are.
    """

    def __init__(self, spec):
        read = json.loads(spec)
        steps = (read.get("pre_tokenizer") or {}).get("pretokenizers", [])
        split = next((s for s in steps if s["type"] == "Split"), None)
        suffix = read["model"].get("end_of_word_suffix")
        if not split or split["pattern"] != {"Regex": PATTERN} or not split["invert"] or suffix != WORD_END:
            raise ValueError("not the tokenizer that drops white space and marks the ends of words")
        self.tokenizer = Tokenizer.from_str(spec)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True

        self.forget()

    def forget(self):
        self.known = {}
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _units(self, data, offsets):
        """(bytes, starts, starts of units that stay whole, first unit of each row)."""
        inside = SPACED[data]
        packed = data[inside]
        bounds = np.concatenate(([0], np.cumsum(inside)))[offsets]
        begins = np.zeros(len(data), bool)
        begins[1:] = ~inside[:-1]
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        cut = begins[inside]
        kind = KIND[packed]
        odd = np.flatnonzero(kind == _OTHER)
        pairs = [np.flatnonzero((packed[:-1] == one) & (packed[1:] == two)) for one, two in _ODD]
        odd = np.concatenate([odd, *pairs])
        inner = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        whole = np.zeros(0, np.int64)
        lower = LOWER[packed]
        if len(odd):
            word = np.flatnonzero(cut)
            ends = np.append(word[1:], len(packed))
            own = np.unique(np.searchsorted(word, odd, "right") - 1)
            whole, place = word[own], expand(word[own], ends[own] - word[own])
            lower[place] = packed[place]
            inner[place[place > 0] - 1] = False
        cut[1:] |= inner
        start = np.flatnonzero(cut)
        return lower, start, whole, np.searchsorted(start, bounds)

    def _learn(self, new, asis):
        """Tokenizes new units; those not ``asis`` are one word of the model each."""
        flat, counts = [self.flat], []
        plain = [u for u, w in zip(new, asis, strict=True) if not w]
        for i in range(0, len(plain), UNITS):
            text = b" ".join(plain[i : i + UNITS]).decode()
            # the way without offsets; of one text, as more would be given to threads
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(plain[i : i + UNITS]):
                raise RuntimeError("a unit is not one word of the tokenizer")
            flat.append(ids)
            counts.append(np.diff(ends, prepend=0))
        whole = [u for u, w in zip(new, asis, strict=True) if w]
        for unit in whole:
            flat.append(np.array(self.tokenizer.encode(unit.decode(), add_special_tokens=False).ids, np.int32))
            counts.append(np.array([len(flat[-1])], np.int64))
        size = len(self.known)
        self.known.update(zip(plain + whole, range(size, size + len(new)), strict=True))
        self.flat = np.concatenate(flat)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(counts))])

    def of_texts(self, data, offsets):
        """(ids, number by row) of the bytes of texts."""
        n_rows = len(offsets) - 1
        packed, start, whole, first = self._units(data, offsets)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(n_rows, np.int64)
        if len(self.known) > KNOWN:
            self.forget()
        coded = _column(packed, np.append(start, len(packed))).dictionary_encode()
        codes, spelled = np.asarray(coded.indices), coded.dictionary.to_pylist()
        asis = np.zeros(len(spelled), bool)
        asis[codes[np.searchsorted(start, whole)]] = True
        new = [i for i, u in enumerate(spelled) if u not in self.known]
        if new:
            self._learn([spelled[i] for i in new], asis[new].tolist())
        place = np.fromiter(map(self.known.__getitem__, spelled), np.int64, len(spelled))
        begin, size = self.ends[:-1][place], np.diff(self.ends)[place]
        many = size[codes]
        total = np.concatenate(([0], np.cumsum(many)))
        return self.flat[expand(begin[codes], many)], np.diff(total[first])


@functools.lru_cache(maxsize=2)
def _tokens(spec):
    return Tokens(spec)


def token_ids(column, tokens, end=END):
    """(ids, number by row) of the texts of a column, each with the end id behind."""
    ids, counts = tokens.of_texts(*text_bytes(column))
    return np.insert(ids, np.cumsum(counts), end), counts + 1


def _gathered(batches):
    """Batches joined up to TOGETHER bytes of text (the last column), or one batch."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(batch.num_columns - 1).nbytes
        if size >= TOGETHER:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def pieces(docs: DataFrame, tokenizer: str, keep=None, size=SIZE, end=END) -> DataFrame:
    """Pieces of the documents: piece, start, length, ids (32-bit, little-endian), part and nth.

    ``tokenizer`` is the path, on the driver, of the JSON of a tokenizer that ``Tokens`` takes. ``nth`` numbers the pieces of
    one length that the task ``part`` has made.
    """
    with open(tokenizer, encoding="utf-8") as file:
        spec = file.read()
    Tokens(spec)  # refuses other tokenizers here
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    made = fields("piece int, start long, length long, ids binary, part int, nth long")
    names = [f.name for f in made]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    schema = T.StructType([docs.schema[c] for c in keep] + made)
    inner = small_batches(docs).select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), F.col("text"))

    def run(batches):
        tokens, part_id = _tokens(shared.value), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for part in slices(_gathered(batches), limit=TOGETHER):
            ids, counts = token_ids(part.column(len(keep)), tokens, end)
            n = -(-counts // size)
            row = np.repeat(np.arange(len(n)), n)
            piece = expand(np.zeros(len(n), np.int64), n)
            length = np.minimum(size, counts[row] - piece * size)
            order = np.argsort(length, kind="stable")
            at, many = runs(length[order])
            nth = np.empty(len(length), np.int64)
            nth[order] = expand(seen[length[order][at]], many)
            seen += counts_of(length, size + 1)
            bounds = np.concatenate(([0], np.cumsum(length * 4)))
            packed = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(bounds), pa.py_buffer(ids.astype("<u4"))])
            taken = [part.column(i).take(pa.array(row)) for i in range(len(keep))]
            own = [piece.astype(np.int32), piece * size, length, packed.cast(pa.binary()), np.full(len(row), part_id, np.int32), nth]
            yield pa.RecordBatch.from_arrays([*taken, *(x if isinstance(x, pa.Array) else pa.array(x) for x in own)], names=schema.names)

    return inner.mapInArrow(run, schema)


class Complements:
    """How many lengths, pairs and triples of them, in order, have each sum; and the fills of a gap."""

    def __init__(self, left):
        self.left = left
        self.one = (left > 0).astype(np.int64)
        size = len(left)
        self.two = np.convolve(self.one, self.one)[:size]
        self.three = np.convolve(self.two, self.one)[:size]

    def gone(self, x):
        """The length ``x`` has run out: what contained it leaves the index."""

        def shifted(sums, by):
            out = np.zeros_like(sums)
            if by < len(sums):
                out[by:] = sums[: len(sums) - by]
            return out

        # (P - t^x)^2 and (P - t^x)^3, P the polynomial of the lengths there are
        self.three += -3 * shifted(self.two, x) + 3 * shifted(self.one, 2 * x)
        self.two -= 2 * shifted(self.one, x)
        if 2 * x < len(self.two):
            self.two[2 * x] += 1
        if 3 * x < len(self.three):
            self.three[3 * x] -= 1
        self.one[x] = 0

    def pair(self, gap, most, free):
        """The two lengths of this sum with the longest first that is at most ``most``, or None."""
        low = -(-gap // 2)
        if low > min(most, gap - 1):
            return None
        first = np.arange(min(most, gap - 1), low - 1, -1)
        fit = first[(free[first] > 0) & (free[gap - first] > 0)]
        for a in fit:
            if a * 2 != gap or free[a] > 1:
                return int(a), int(gap - a)
        return None

    def fill(self, gap, used):
        """Up to three lengths that add up to ``gap`` beside those already ``used``, or None."""
        free = self.left if not used else self.left.copy()
        for x, n in used.items():
            free[x] -= n
        if free[gap] > 0:
            return (gap,)
        if self.two[gap] > 0:
            found = self.pair(gap, gap - 1, free)
            if found:
                return found
        if self.three[gap] > 0:
            first = np.arange(gap - 2, -(-gap // 3) - 1, -1)
            for a in first[(free[first] > 0) & (self.two[gap - first] > 0)]:
                free[a] -= 1
                found = self.pair(gap - int(a), int(a), free)
                free[a] += 1
                if found:
                    return (int(a), *found)
        return None


def plan(counts):
    """Slots for pieces: an array of (length, first number, copies in a sequence, first sequence, offset).

    ``counts`` holds the number of pieces by length; its last length is the size of a sequence.
    Pieces of a length, by number, take its slots in order: ``copies`` of them in each sequence.
    """
    left = np.array(counts, np.int64)
    size = len(left) - 1
    left[0] = 0
    index = Complements(left)
    numbered = np.zeros(size + 1, np.int64)
    slots, sequence = [], 0
    longest = size
    while True:
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            break
        used, gap = {longest: 1}, size - longest
        while gap:
            more = index.fill(gap, used)
            if more is None:  # the best fit
                below = np.flatnonzero(left[1 : gap + 1])[::-1] + 1
                more = next(((int(x),) for x in below if left[x] > used.get(int(x), 0)), None)
                if more is None:
                    break
            for x in more:
                used[x] = used.get(x, 0) + 1
                gap -= x
        times = min(int(left[x]) // n for x, n in used.items())
        offset = 0
        for x, n in sorted(used.items(), reverse=True):
            slots.append((x, numbered[x], n, sequence, offset))
            numbered[x] += n * times
            offset += n * x
            left[x] -= n * times
            if not left[x]:
                index.gone(x)
        sequence += times
    return np.array(sorted(slots), np.int64).reshape(-1, 5)


def place(cut: DataFrame, size=SIZE) -> DataFrame:
    """Rows of ``cut`` (stored pieces: length, part, nth, ...) with sequence_id and offset.

    The driver sees one count for each length, at most ``size`` of them.
    """
    counts = np.zeros(size + 1, np.int64)
    for row in cut.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    slots = plan(counts)
    shared = cut.sparkSession.sparkContext.broadcast((slots, slots[:, 0] << 42 | slots[:, 1]))
    if counts.max() >= 1 << 42:
        raise ValueError("a length has more pieces than a number holds")
    before = F.sum("many").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = cut.groupBy("length", "part").agg(F.count("*").alias("many"))
    base = base.select(F.col("length").alias("own_length"), F.col("part").alias("own_part"), F.coalesce(before, F.lit(0)).alias("before"))
    keep = [c for c in cut.columns if c not in ("part", "nth", "sequence_id", "offset")]
    numbered = cut.join(base, (F.col("length") == F.col("own_length")) & (F.col("part") == F.col("own_part")))
    numbered = numbered.select(*(F.col(f"`{c}`") for c in keep), (F.col("nth") + F.col("before")).alias("nth"))
    schema = T.StructType([*(cut.schema[c] for c in keep), *fields("sequence_id long, offset long")])

    def run(batches):
        slots, keys = shared.value
        for batch in batches:
            length = np.asarray(batch.column(keep.index("length")), np.int64)
            nth = np.asarray(batch.column(len(keep)), np.int64)
            slot = slots[np.searchsorted(keys, length << 42 | nth, "right") - 1]
            times, copy = np.divmod(nth - slot[:, 1], slot[:, 2])
            made = [pa.array(slot[:, 3] + times), pa.array(slot[:, 4] + copy * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=schema.names)

    return numbered.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, keep=None, size=SIZE, end=END) -> DataFrame:
    """Pieces of the documents with their ids, sequence_id and offset; they are stored once."""
    return place(stored(pieces(docs, tokenizer, keep, size, end), "packed_pieces"), size)


def sequences(packed: DataFrame) -> DataFrame:
    """One row for each sequence: sequence_id, length and ids (32-bit, little-endian), pieces in order."""
    held = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most a sequence's size of bytes * 4
    joined = F.aggregate(held, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
