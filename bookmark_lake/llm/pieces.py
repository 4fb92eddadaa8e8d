"""SentencePiece encoding and decoding: sampled segmentations by forward filtering, backward sampling.

A text gets a space in front and is cut into units where a letter is followed by a space and around
line ends; no piece crosses such a cut, so the piece lattice of a text is the chain of its units'
lattices. Forward filtering sums, at each byte of a unit, the weights of all segmentations up to
there, once for each distinct unit. Backward sampling then walks from the end of each unit to its
start and picks the last piece by those sums. The random numbers are hashes of the seed, the row's
key, the unit's place in the text and the byte reached, so a row's segmentation is the same
wherever and whenever it is computed.

A piece weighs (id + 10) ** -sharpness, as pieces are stored by rank: 1 samples widely, a large
value gives nearly always the likeliest segmentation. Characters without a piece of their own fall
back to pieces of single bytes. Decoding joins the pieces' bytes and drops the space in front; it
gives back every text, empty and null ones included (null ids are null). A text that has the sign
that stands for a space in piece files keeps it: it is encoded by bytes.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import BYTE_CODE, U64, Hashes, Lookup, expand, fields, map_texts, mix, rows_of, runs, text_bytes

#: The vocabulary file; a parameter everywhere.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"


class Vocabulary:
    """Pieces as bytes, with a plain space for the space sign."""

    def __init__(self, path=MODEL):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes, self.byte_ids = [], np.full(256, -1, np.int64)
        normal = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_ids[value] = i
                self.bytes.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes.append(b"")
            else:
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {piece!r} crosses a word's end")
                normal.append(i)
                self.bytes.append(piece.replace(SPACE, " ").encode())
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary lacks pieces for single bytes")
        sizes = np.array([len(self.bytes[i]) for i in normal])
        self.lengths = np.unique(sizes)
        data = np.frombuffer(b"".join(self.bytes[i] for i in normal), np.uint8)
        end = np.cumsum(sizes)
        key = _plain_hash(Hashes(BYTE_CODE[data]), end - sizes, sizes)
        order = np.argsort(key)
        self.table, self.ids = Lookup(key[order]), np.array(normal)[order]
        # hashes of all starts of pieces: where none fits, no longer piece does either
        self.starts = np.zeros(1 << 20, bool)
        chain = Hashes(BYTE_CODE[data])
        for length in range(1, int(sizes.max()) + 1):
            at = (end - sizes)[sizes >= length]
            self.starts[(_plain_hash(chain, at, length) >> U64(44)).astype(np.int64)] = True
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.size = np.array([len(b) for b in self.bytes])
        self.start = np.cumsum(self.size) - self.size


def _units(data, offsets):
    """(start, end, row) of the units of texts, each of which begins with a space."""
    space = data == 0x20
    line = data == 0x0A
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    cut[1:-1] |= (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    start = np.flatnonzero(cut[:-1])
    end = np.concatenate((start[1:], [len(data)])) if len(start) else start
    return start, end, rows_of(start, offsets)


def _plain_hash(chain, at, length):
    return (chain.sum[at + length] - chain.sum[at]) * chain.inverse[at]


def _edges(data, size, vocabulary):
    """(from, to, id) of all pieces that fit somewhere in units of these sizes, one after another."""
    chain = Hashes(BYTE_CODE[data])
    room = np.repeat(np.cumsum(size), size) - np.arange(len(data))  # bytes to the unit's end
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    width = np.diff(np.concatenate((at, [len(data)])))
    room = room[at]
    alone = np.zeros(len(data), bool)
    froms, tos, ids = [], [], []
    for length in range(1, int(vocabulary.lengths[-1]) + 1):
        fit = np.flatnonzero(room >= length)
        key = _plain_hash(chain, at[fit], length)
        going = vocabulary.starts[(key >> U64(44)).astype(np.int64)]
        fit, key = fit[going], key[going]
        if not len(fit):
            break
        at, width, room = at[fit], width[fit], room[fit]
        slot = vocabulary.table.find(key)
        hit = slot >= 0
        froms.append(at[hit])
        tos.append(at[hit] + length)
        ids.append(vocabulary.ids[slot[hit]])
        alone[at[hit & (width == length)]] = True
    # bytes of characters that are no piece
    head = np.flatnonzero(lead)
    missing = np.flatnonzero(~np.repeat(alone[head], np.diff(np.concatenate((head, [len(data)])))))
    froms.append(missing)
    tos.append(missing + 1)
    ids.append(vocabulary.byte_ids[data[missing]])
    return np.concatenate(froms), np.concatenate(tos), np.concatenate(ids)


def _forward(froms, tos, weight, base, n):
    """Log sums of the weights up to each byte; edges are by (end's distance from ``base``, end).

    ``base`` is the unit's start of each edge.
    """
    total = np.full(n + 1, -np.inf)
    total[base] = 0.0
    depth = tos - base
    first, many = runs(depth)
    for a, k in zip(first, many, strict=True):
        own = slice(a, a + k)
        value = total[froms[own]] + weight[own]
        at, _ = runs(tos[own])
        top = np.maximum.reduceat(value, at)
        shift = np.repeat(np.where(np.isfinite(top), top, 0.0), np.diff(np.concatenate((at, [k]))))
        total[tos[own][at]] = np.log(np.add.reduceat(np.exp(value - shift), at)) + np.where(np.isfinite(top), top, 0.0)
    return total


def sample_ids(column, row_seed, vocabulary, sharpness):
    """(ids, number by row) of one sampled segmentation of each text."""
    data, offsets = text_bytes(column)
    n_rows = len(offsets) - 1
    # a space before each text
    data = np.insert(data, offsets[:-1], 0x20)
    offsets = offsets + np.arange(n_rows + 1)
    chain = Hashes(BYTE_CODE[data])
    start, end, row = _units(data, offsets)
    spelling, first, back = np.unique(chain.of(start, end), return_index=True, return_inverse=True)
    # the distinct units one after another, with a node for each start and each end
    size = (end - start)[first]
    units = data[expand(start[first], size)]
    node = np.cumsum(size + 1) - (size + 1)
    froms, tos, ids = _edges(units, size, vocabulary)
    unit = np.repeat(np.arange(len(size)), size)[froms]
    froms, tos, base = froms + unit, tos + unit, node[unit]
    order = np.argsort(((tos - base) << 32) | tos)
    froms, tos, ids, base = froms[order], tos[order], ids[order], base[order]
    n_nodes = int((size + 1).sum())
    weight = -sharpness * np.log(ids + 10.0)
    total = _forward(froms, tos, weight, base, n_nodes)
    # for each node the shares of its last pieces, largest first, as a rising line
    share = np.exp(total[froms] + weight - total[tos])
    order = np.argsort(tos - 0.5 * np.minimum(share, 1.0))
    froms, tos, ids = froms[order], tos[order], ids[order]
    at, many = runs(tos)
    rising = np.cumsum(share[order])
    rising -= np.repeat(rising[at] - share[order][at], many)
    rising[at + many - 1] = 1.0
    first_edge = np.zeros(n_nodes + 1, np.int64)
    first_edge[tos[at]] = at
    # walk back from the end of every unit of every text
    total_units = np.bincount(row, minlength=n_rows)
    place = np.arange(len(row)) - (np.cumsum(total_units) - total_units)[row]
    seed = mix(row_seed[row] + place.astype(U64) * U64(0x9E3779B97F4A7C15))
    who, here = np.arange(len(row)), (node + size)[back]
    begin = node[back]
    picked_who, picked_at, picked_id = [], [], []
    while len(who):
        offset = (here - begin).astype(U64)
        u = (mix(seed + offset * U64(0xD1B54A32D192ED03)) >> U64(11)).astype(np.float64) * 2.0**-53
        edge = first_edge[here]
        beyond = np.flatnonzero(u >= rising[edge])
        while len(beyond):
            edge[beyond] += 1
            beyond = beyond[u[beyond] >= rising[edge[beyond]]]
        here = froms[edge]
        picked_who.append(who)
        picked_at.append(here - begin)
        picked_id.append(ids[edge])
        on = here > begin
        who, here, begin, seed = who[on], here[on], begin[on], seed[on]
    if not picked_who:
        return np.zeros(0, np.int32), np.zeros(n_rows, np.int64)
    who, at, ids = (np.concatenate(x) for x in (picked_who, picked_at, picked_id))
    order = np.argsort((who << 32) | at)
    return ids[order].astype(np.int32), np.bincount(row[who], minlength=n_rows)


def decode_ids(ids, counts, vocabulary):
    """The texts of rows of ids, as one array."""
    size = vocabulary.size[ids]
    data = vocabulary.flat[expand(vocabulary.start[ids], size)] if len(ids) else np.zeros(0, np.uint8)
    per_row = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))]
    lead = per_row[:-1][np.diff(per_row) > 0]  # the space in front
    keep = np.ones(len(data), bool)
    keep[lead] = False
    ends = per_row - np.concatenate(([0], np.cumsum(np.diff(per_row) > 0)))
    buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[keep].tobytes())]
    return pa.LargeStringArray.from_buffers(len(counts), *buffers[1:]).cast(pa.string())


def encode(docs: DataFrame, keep=None, model=MODEL, sharpness=1.0, seed=0, decoded=False) -> DataFrame:
    """Rows of ``docs`` with n_pieces and ids, sampled by the row's doc_id and ``seed``.

    With ``decoded`` the ids are also decoded again in the same pass, into a column of that name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))
    keep = list(docs.columns if keep is None else keep)
    new = "n_pieces long, ids array<int>" + ", decoded string" * decoded
    names = [f.name for f in fields(new)]
    stay = [c for c in keep if c.lower() not in names]
    keyed = docs.withColumn("piece_seed", F.xxhash64(F.lit(seed), F.col("doc_id")))

    def run(part):
        column = part.column(part.num_columns - 1)
        row_seed = np.asarray(part.column(part.num_columns - 2), np.int64).view(U64)
        ids, counts = sample_ids(column, row_seed, shared.value, sharpness)
        ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        nulls = column.is_null()
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids), mask=nulls if column.null_count else None)
        made = [pa.array(counts.astype(np.int64)), lists]
        if decoded:
            made.append(_decoded(lists, shared.value))
        return made

    out = map_texts(keyed, run, new, [*stay, "piece_seed"])
    return out.select(*(F.col(f"`{c}`") for c in stay), *names)


def _decoded(lists, vocabulary):
    counts = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    text = decode_ids(np.asarray(lists.flatten(), np.int64), counts, vocabulary)
    return pc.if_else(lists.is_null(), pa.scalar(None, pa.string()), text) if lists.null_count else text


def decode(encoded: DataFrame, model=MODEL) -> DataFrame:
    """``encoded`` (ids, ...) with decoded, the text of the ids; null for null ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(model))
    keep = [c for c in encoded.columns if c.lower() != "decoded"]
    place = keep.index("ids")
    schema = T.StructType([*(encoded.schema[c] for c in keep), T.StructField("decoded", T.StringType())])

    def run(batches):
        for batch in batches:
            text = _decoded(batch.column(place), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=schema.names)

    return encoded.select(*(F.col(f"`{c}`") for c in keep)).mapInArrow(run, schema)
