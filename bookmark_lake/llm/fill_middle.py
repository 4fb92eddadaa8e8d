"""Fill-in-the-middle transformation: prefix, middle and suffix of a text in a new order.

A text's units are its runs of letters A to Z (either case) and its other characters one by one.
Two cuts between units, drawn from a hash of the row's key, part it into prefix, middle and suffix.
The work is one pyarrow.compute pipeline for each slice of a batch: a byte that UTF-8 never has
marks the end of each unit, splitting there gives lists of units, these are flattened with the
index of their parent row and numbered within it, each role's units are filtered out, made lists
again and joined.

A text stays plain if it is empty or null, holds one of the three marks, or by its hash in a share
of the rows. ``restore`` undoes the transformation exactly. Ties and repeated rows: equal keys and
texts give equal outputs. A row without a key draws from the seed alone. Invalid UTF-8 is not text.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import map_texts, slices, small_batches

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Ends a unit: no byte of UTF-8 text has this value.
_END = b"\xff"
#: A unit in the bytes of UTF-8: letters, or a first byte and those that continue it.
_UNIT = b"[A-Za-z]+|[^A-Za-z][\x80-\xbf]*"


def draws(key: Column, seed=1) -> Column:
    """Four 32-bit numbers from the SHA-256 of ``seed`` and the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)))


def _joined(flat, chosen, counts):
    """The chosen units of each row as one value."""
    ends = np.concatenate(([0], np.cumsum(counts)))
    lists = pa.LargeListArray.from_arrays(pa.array(ends), pc.filter(flat, chosen))
    return pc.binary_join(lists, pa.scalar(b"", pa.large_binary()))


def parts(texts, first, second):
    """(n units, prefix, middle, suffix) of texts cut at the two numbers modulo n + 1."""
    marked = pc.replace_substring_regex(texts, pattern=_UNIT, replacement=b"\\0" + _END)
    units = pc.split_pattern(marked, _END)  # what follows the last mark is one empty value more
    n = np.asarray(pc.list_value_length(units), np.int64) - 1
    one, two = first % (n + 1), second % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(pa.array(np.cumsum(n + 1) - (n + 1)), parent))
    before_low = pc.less(ordinal, pc.take(pa.array(low), parent))
    before_high = pc.less(ordinal, pc.take(pa.array(high), parent))
    real = pc.less(ordinal, pc.take(pa.array(n), parent))
    prefix = _joined(flat, before_low, low)
    middle = _joined(flat, pc.and_not(before_high, before_low), high - low)
    suffix = _joined(flat, pc.and_not(real, before_high), n - high)
    return n, prefix, middle, suffix


def _woven(*pieces):
    nothing = pa.scalar(b"", pa.large_binary())
    return pc.binary_join_element_wise(*(pa.scalar(p, pa.large_binary()) if isinstance(p, bytes) else p for p in pieces), nothing)


def _text(values):
    return values.cast(pa.large_string()).cast(pa.string())


def transform_texts(column, numbers, plain_from, spm_below):
    """(n, form, prefix_chars, middle_chars, output) of a text column and its rows of four numbers."""
    texts = pc.fill_null(column, "").cast(pa.large_string()).cast(pa.large_binary())
    h = np.asarray(pc.list_flatten(numbers), np.int64).reshape(-1, 4)
    n, prefix, middle, suffix = parts(texts, h[:, 0], h[:, 1])
    plain = pa.array((n == 0) | (h[:, 2] % 100 >= plain_from))
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(texts, mark))
    spm = pa.array(h[:, 3] % 100 < spm_below)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    turned = pc.if_else(
        spm,
        _woven(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle),
        _woven(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle),
    )
    sizes = (pc.utf8_length(p.cast(pa.large_string())).cast(pa.int64()) for p in (prefix, middle))
    sizes = [pc.if_else(plain, pa.scalar(None, pa.int64()), s) for s in sizes]
    return [pa.array(n), form, *sizes, _text(pc.if_else(plain, texts, turned))]


def _around(values, mark):
    """What lies before and after the first ``mark`` of each value; both are there."""
    halves = pc.list_flatten(pc.split_pattern(values, mark, max_splits=1))
    place = np.arange(len(values)) * 2
    return pc.take(halves, pa.array(place)), pc.take(halves, pa.array(place + 1))


def restore_texts(output, form):
    """The texts that were transformed to ``output``, as ``form`` says. A null output gives null."""
    raw = output.cast(pa.large_string())
    for name, first, second in (("psm", PREFIX, SUFFIX), ("spm", SUFFIX, PREFIX)):
        turned = pc.and_(pc.is_valid(raw), pc.fill_null(pc.equal(form, name), False))
        # no part holds a mark and no two marks overlap, so the first of each is the one that was put there
        body = pc.utf8_slice_codeunits(pc.filter(raw, turned), len(first)).cast(pa.large_binary())
        left, rest = _around(body, second)
        right, middle = _around(rest, MIDDLE)
        text = _woven(left, middle, right) if name == "psm" else _woven(right, middle, left)
        raw = pc.replace_with_mask(raw, turned, text.cast(pa.large_string()))
    return raw.cast(pa.string())


def fill_in_middle(docs: DataFrame, key="doc_id", keep=None, plain_share=10, spm_share=20, seed=1, restored=False) -> DataFrame:
    """Rows of ``docs`` with n (units), form (plain, psm or spm), prefix_chars, middle_chars and output.

    ``plain_share`` per cent of the rows stay plain; of the others ``spm_share`` per cent put the
    suffix first. With ``restored`` the outputs are turned back in the same pass, into a column of
    that name. Columns of the table with one of these names give way.
    """
    new = "n long, form string, prefix_chars long, middle_chars long, output string" + ", restored string" * restored
    keep = list(docs.columns if keep is None else keep)
    names = [f.split()[0] for f in new.split(", ")]
    stay = [c for c in keep if c.lower() not in names]
    drawn = docs.select(*(F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(stay)), draws(F.col(key), seed).alias("numbers"), "text")

    def run(part):
        made = transform_texts(part.column(part.num_columns - 1), part.column(len(stay)), 100 - plain_share, spm_share)
        return [*made, restore_texts(made[4], made[1])] if restored else made

    out = map_texts(drawn, run, new, [*(f"f{i}" for i in range(len(stay))), "numbers"])
    return out.select(*(F.col(f"f{i}").alias(c) for i, c in enumerate(stay)), *names)


def restore(transformed: DataFrame) -> DataFrame:
    """``transformed`` (output, form, ...) with restored, the texts from before; null for a null output."""
    keep = [c for c in transformed.columns if c.lower() != "restored"]
    schema = T.StructType([*(transformed.schema[c] for c in keep), T.StructField("restored", T.StringType())])

    def run(batches):
        for part in slices(batches, "output"):
            text = restore_texts(part.column(keep.index("output")), part.column(keep.index("form")))
            yield pa.RecordBatch.from_arrays([*part.columns, text], names=schema.names)

    return small_batches(transformed).select(*(F.col(f"`{c}`") for c in keep)).mapInArrow(run, schema)
