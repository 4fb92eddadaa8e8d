"""Search index of an item table: forward lists, blocks of postings, term statistics, spelling variants.

An index is a set of segments, each a folder of tables that is written once:

* forward: for each item its document number, URL and, by field, length and counted words;
* blocks: for each term and field, the postings of 64 documents with numbers in a row: their
  bits in one long, what each word adds, and the largest part any of them can add to a score.
  A stored row holds those of 2 ** CHUNK_BITS blocks in a row, and their number of documents;
* terms: documents by term and field; variants: the terms behind every spelling that is left when
  up to two of a term's first letters go; fields: documents and words by field;
* dead: the bits of documents in earlier segments that this segment replaces.

A document's number holds its segment, the task that wrote it and its place there, so numbers need
no pass of their own, and blocks of one task are full. Where a file of forward lists is read by
several tasks, a block may stand twice, with disjoint bits; a search takes both. A segment that
replaces documents counts them negatively in its terms and fields: the sum over all segments is exact.

Words are found by built-in expressions; counting them and packing postings into blocks is numpy
over Arrow batches, the documents of one row of blocks at a time, before the only exchange.
"""

import zlib
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import col
from ..schema import ITEM_ARRAYS
from ..session import work_folder
from .generations import current, delete, exists, new_folder, put_in_force

# Words: letters and digits with their combining marks and underscores, joined by single
# dots or apostrophes inside; each Han or Hiragana sign is a word by itself. Possessive
# repetition: a word is never given back once read.
_SIGN = r"[\p{IsHan}\p{IsHiragana}]"
_PART = r"_*+(?![\p{IsHan}\p{IsHiragana}])[\p{L}\p{N}](?:[\p{L}\p{M}\p{N}_&&[^\p{IsHan}\p{IsHiragana}]])*+"
WORD = rf"{_SIGN}\p{{M}}*+|{_PART}(?:[.'’]{_PART})*+"
# The same where a text has none of those signs: half the work.
_PLAIN_PART = r"_*+[\p{L}\p{N}][\p{L}\p{M}\p{N}_]*+"
_PLAIN_WORD = rf"{_PLAIN_PART}(?:[.'’]{_PLAIN_PART})*+"

# Terms are kept apart by buckets: a search reads only its own.
BUCKETS = 64
# Postings of one term and field that share a block row: the documents of one long.
BLOCK_BITS = 6
# Postings of a bucket in one file, about.
BUCKET_ROWS = 4_000_000
# First letters of a term whose deletions are stored; two edits leave at least PREFIX - 2 of them.
PREFIX, DELETIONS = 5, 2
# A posting in a block is one number: its place among the 64 documents, its count, its field's length. Arrays
# of words end far below 2 ** COUNT_BITS.
COUNT_BITS = 28
# Segments of one index: their number stands in the first bits of a document's number.
MOST_SEGMENTS = 1 << 9
# Blocks of one term and field in a stored row, as a power of two, and their documents: a task holds
# the words or postings of so many rows as arrays at a time.
CHUNK_BITS = 4
ROWS = 1 << (BLOCK_BITS + CHUNK_BITS)
# Constants of the ranking.
K1, B = 1.2, 0.75

# Every text field of an item; dates are no text.
TEXT_FIELDS = [
    "name",
    "description",
    "content",
    "url",
    "alt_url",
    "repository_backlink",
    "twitter_backlink",
]
FIELDS = TEXT_FIELDS + ITEM_ARRAYS

_RUNS = "array<struct<field: string, len: int, runs: array<struct<term: string, tf: int>>>>"
_SCHEMAS = {
    "forward": f"doc long, block long, url string, fields {_RUNS}",
    "blocks": "term string, field string, chunk long, df long, block array<long>, bits array<long>, "
    "part array<double>, entries array<array<long>>, bucket int",
    "terms": "term string, field string, df long, bucket int",
    "variants": "spelling long, term string, bucket int",
    "fields": "field string, n_docs long, words long, base double",
    "dead": "block long, bits long",
}


def tokens(c) -> Column:
    """Lower-cased words in order."""
    words = lambda pattern: lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    signs = F.regexp_like(col(c), F.lit(_SIGN))
    return F.when(signs, words(WORD)(F.lower(col(c)))).otherwise(words(_PLAIN_WORD)(F.lower(col(c))))


def field_tokens(items: DataFrame, fields=None) -> DataFrame:
    """(url, field, tokens) of every non-empty field."""
    present = [f for f in (fields or FIELDS) if f in items.columns]
    text = lambda f: F.array_join(f, " ") if f in ITEM_ARRAYS else F.col(f)
    per_field = F.array(*[F.struct(F.lit(f).alias("field"), text(f).alias("text")) for f in present])
    texts = items.select(F.col("url").alias("item_url"), F.inline(per_field)).filter(
        F.col("text").isNotNull()
    )
    return texts.select(
        F.col("item_url").alias("url"), "field", tokens("text").alias("tokens")
    ).filter(F.size("tokens") > 0)


def _distinct(words):
    """(distinct values in order, the place of each word among them)."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()]


def _counted(columns):
    """Lists of words by field → (row, field, words, their runs) of every list that holds any.

    Rows and fields ascend; runs are lists of (term, tf) in the order of the terms.
    """
    columns = [c.cast(pa.list_(pa.string())) for c in columns]
    sizes = [pc.fill_null(pc.list_value_length(c), 0).to_numpy() for c in columns]
    n = len(columns)
    group = np.concatenate([np.repeat(np.arange(len(size)) * n + i, size) for i, size in enumerate(sizes)])
    terms, rank = _distinct(pa.concat_arrays([c.flatten() for c in columns]))
    most = max(len(terms), 1)
    key, tf = np.unique(group * most + rank, return_counts=True)
    held, size = np.unique(group, return_counts=True)
    starts = np.searchsorted(key, np.append(held, held[-1] + 1 if len(held) else 0) * most)
    runs = pa.StructArray.from_arrays([terms.take(pa.array(key % most)), pa.array(tf.astype(np.int32))], names=["term", "tf"])
    return held // n, held % n, size.astype(np.int32), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), runs)


def _count_fields(names):
    """Batches of columns to keep and one list of words for each field → the columns, and the fields' counted words."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                kept = part.num_columns - len(names)
                row, field, size, runs = _counted([part.column(kept + i) for i in range(len(names))])
                found = pa.StructArray.from_arrays([pa.array(names, pa.string()).take(pa.array(field)), pa.array(size), runs], names=["field", "len", "runs"])
                ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                columns = [part.column(i) for i in range(kept)]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends), found)], names=[*part.schema.names[:kept], "fields"])
        pa.default_memory_pool().release_unused()

    return run


def _field_words(items, fields, *kept) -> DataFrame:
    """The ``kept`` columns and ``fields``, the counted words of every field that has any."""
    present = [f for f in (fields or FIELDS) if f in items.columns]
    text = lambda f: F.array_join(f, " ") if f in ITEM_ARRAYS else F.col(f)
    words = items.select(*kept, *[tokens(text(f)).alias(f"words {i}") for i, f in enumerate(present)])
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema.fields[: len(kept)])
    return words.mapInArrow(_count_fields(present), f"{ddl}, fields {_RUNS}")


def build_postings(items: DataFrame, fields=None) -> DataFrame:
    """POSTING rows of an item table with one row per URL.

    All words of a field stand in one row, so they are counted there: the postings need no
    shuffle at all.
    """
    counted = _field_words(items, fields, "url").select("url", F.inline("fields"))
    return counted.select("url", "field", F.col("len").alias("field_len"), F.inline("runs")).select("term", "field", "url", "tf", "field_len")


def term_stats(postings: DataFrame) -> DataFrame:
    """Document frequency of every (term, field); counted before the shuffle as well."""
    return postings.groupBy("term", "field").agg(F.count("*").alias("df"))


def field_stats(items: DataFrame, fields=None) -> DataFrame:
    """Per field: documents that have it and their mean length in words."""
    lengths = field_tokens(items, fields).select("field", F.size("tokens").alias("field_len"))
    return lengths.groupBy("field").agg(
        F.count("*").alias("n_docs"), F.avg("field_len").alias("avg_len")
    )


def stem_postings(postings: DataFrame, stems: DataFrame) -> DataFrame:
    """Postings with every term replaced by its stem from a (token, stem) dictionary.

    Words missing from the dictionary stay. Spark broadcasts the dictionary if its
    measured size allows; else the join shuffles, and very frequent words are split
    by the skew handling of adaptive execution.
    """
    stemmed = postings.join(stems.select(F.col("token").alias("term"), "stem"), "term", "left")
    return (
        stemmed.withColumn("term", F.coalesce("stem", "term"))
        .groupBy("term", "field", "url", "field_len")
        .agg(*[F.sum(c).cast("int").alias(c) for c in ("tf", "head") if c in postings.columns])
        .select(*postings.columns)
    )


def _bucket(term) -> Column:
    return F.pmod(F.crc32(col(term).cast("binary")), F.lit(BUCKETS)).cast("int")


def bucket_of(term) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def posting_part(tf, field_len, avg_len) -> str:
    """SQL: what a posting adds to a score, but for its term's weight."""
    return f"({K1 + 1}D * {tf} / ({tf} + {K1}D * ({1 - B}D + {B}D * {field_len} / {avg_len})))"


def entry(part, e="e") -> str:
    """SQL: the place, tf or len in the number ``e`` of a posting."""
    mask = (1 << COUNT_BITS) - 1
    return {"place": f"shiftright({e}, {2 * COUNT_BITS})", "tf": f"(shiftright({e}, {COUNT_BITS}) & {mask})", "len": f"({e} & {mask})"}[part]


class Index:
    """The segments in force, oldest first; tables are read by bucket."""

    def __init__(self, spark: SparkSession, folders):
        self.spark, self.folders = spark, list(folders)

    def read(self, name, buckets=None, folders=None) -> DataFrame:
        """A table over all segments (or ``folders``), of these buckets only."""
        frames = []
        for folder in self.folders if folders is None else folders:
            root = f"{folder}/{name}"
            paths = [root] if buckets is None else [f"{root}/bucket={b}" for b in sorted(set(buckets))]
            if paths := [p for p in paths if exists(self.spark, p)]:
                frames.append(self.spark.read.schema(_SCHEMAS[name]).option("basePath", root).parquet(*paths))
        if not frames:
            return self.spark.createDataFrame([], _SCHEMAS[name])
        head, *rest = frames
        for frame in rest:
            head = head.unionByName(frame)
        return head

    def blocks(self, columns, buckets=None, folders=None, wanted="true") -> DataFrame:
        """(term, field, block) and ``columns`` of the blocks, a row for each; ``wanted`` filters the stored rows."""
        rows = self.read("blocks", buckets, folders).filter(wanted)
        return rows.selectExpr("term", "field", f"inline(arrays_zip({', '.join(['block', *columns])}))")

    @property
    def terms(self) -> DataFrame:
        """(term, field, df) of all segments together."""
        return self.known_terms(None)

    def known_terms(self, buckets) -> DataFrame:
        known = self.read("terms", buckets).select("term", "field", "df")
        if len(self.folders) > 1:
            known = known.groupBy("term", "field").agg(F.sum("df").alias("df")).filter("df > 0")
        return known

    @cached_property
    def field_rows(self) -> dict:
        """(n_docs, words, base) by folder and field: the text fields of the schema at most, for each segment."""
        own = [self.read("fields", folders=[f]).withColumn("folder", F.lit(f.rsplit("/", 1)[1])) for f in self.folders]
        rows = reduce(DataFrame.unionByName, own).collect()
        return {(r["folder"], r["field"]): (r["n_docs"], r["words"], r["base"]) for r in rows}

    @property
    def fields(self) -> dict:
        """(n_docs, avg_len) by field, over all segments."""
        sums = {}
        for (_, field), (n_docs, words, _) in self.field_rows.items():
            docs, total = sums.get(field, (0, 0))
            sums[field] = (docs + n_docs, total + words)
        return {f: (n, total / n) for f, (n, total) in sums.items() if n > 0}

    @property
    def dead(self) -> DataFrame:
        """(block, bits) of the documents that a later segment replaces."""
        return self.read("dead", folders=self.folders[1:])

    @property
    def docs(self) -> DataFrame:
        """(doc, block, url) of the documents that live."""
        docs = self.read("forward").select("doc", "block", "url")
        if len(self.folders) > 1:
            gone = self.dead.select(F.col("block").alias("gone_block"), F.col("bits").alias("gone_bits"))
            bit = F.expr("shiftleft(1L, cast(doc & 63 as int))")
            same = (F.col("block") == F.col("gone_block")) & (F.col("gone_bits").bitwiseAND(bit) != 0)
            docs = docs.join(gone, same, "left_anti")
        return docs

    @property
    def postings(self) -> DataFrame:
        """POSTING rows of the documents that live."""
        rows = self.blocks(["entries"]).select("term", "field", "block", F.explode("entries").alias("e"))
        rows = rows.selectExpr("term", "field", f"shiftleft(block, 6) | {entry('place')} AS doc", f"int({entry('tf')}) AS tf", f"int({entry('len')}) AS field_len")
        return rows.join(self.docs.select("doc", "url"), "doc").select("term", "field", "url", "tf", "field_len")


def _stemmed(fields, stems) -> DataFrame:
    """Forward rows with words replaced by their stems and counted again."""
    runs = fields.select("doc", "block", "url", F.posexplode("fields").alias("n", "f"))
    runs = runs.select("doc", "block", "url", "n", "f.field", "f.len", F.inline("f.runs"))
    named = stems.select(F.col("token").alias("term"), "stem")
    counted = runs.join(named, "term", "left").withColumn("term", F.coalesce("stem", "term"))
    counted = counted.groupBy("doc", "block", "url", "n", "field", "len", "term").agg(F.sum("tf").cast("int").alias("tf"))
    # the words of one field of one item: as many as its text has
    by_field = counted.groupBy("doc", "block", "url", "n", "field", "len").agg(F.collect_list(F.struct("term", "tf")).alias("runs"))
    found = by_field.groupBy("doc", "block", "url").agg(F.collect_list(F.struct("field", "len", "runs")).cast(_RUNS).alias("fields"))
    # documents of a chunk side by side again
    return found.repartition(F.expr(f"shiftright(block, {CHUNK_BITS})")).sortWithinPartitions("doc")


def _write_forward(items, folder, number, fields, stems):
    """One pass over the texts: the words of a field are counted inside its row."""
    numbered = items.withColumn("doc", F.lit(number << 53) + F.monotonically_increasing_id())
    rows = _field_words(numbered, fields, "doc", F.expr("shiftright(doc, 6)").alias("block"), "url")
    forward = f"{folder}/forward"
    if stems is None:
        rows.write.parquet(forward)
        return
    rows.write.parquet(f"{folder}/words")
    _stemmed(items.sparkSession.read.parquet(f"{folder}/words"), stems).write.parquet(forward)
    delete(items.sparkSession, f"{folder}/words")


def _deletions(term) -> Column:
    """Checksums of all spellings of a term's first letters without up to DELETIONS of them."""
    places = range(1, PREFIX + 1)
    letters = [F.substring(term, i, 1) for i in places]
    kept = [[c for i, c in zip(places, letters, strict=True) if i not in gone] for gone in _gone(PREFIX)]
    return F.array_distinct(F.array(*(F.crc32(F.concat(*k).cast("binary")) for k in kept)))


def _gone(size):
    """Sets of up to DELETIONS places of ``size``."""
    sets = {frozenset()}
    for _ in range(DELETIONS):
        sets |= {s | {i} for s in sets for i in range(1, size + 1)}
    return sorted(map(sorted, sets))


def spellings(term, most) -> list:
    """Checksums of a term's own spellings: under these the terms up to ``most`` edits away are stored, among others."""
    found = {term[:PREFIX]}
    for _ in range(most):
        found |= {v[:i] + v[i + 1 :] for v in found for i in range(len(v))}
    return sorted({zlib.crc32(v.encode()) for v in found})


def _write_by_bucket(df, path, slices, *order):
    """A table in folders by bucket, each sorted, in up to ``slices`` files."""
    spread = F.pmod(F.xxhash64("chunk"), F.lit(slices)) if slices > 1 else F.lit(0)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(max(parts, slices), "bucket", spread).sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(path)


def _packed(rows, averages):
    """Rows of (doc, block, fields) of one chunk → a row of blocks for each term and field of theirs."""
    doc, block = (rows.column(c).to_numpy() for c in ("doc", "block"))
    lists = rows.column("fields").combine_chunks()
    held = lists.flatten()
    runs = held.field("runs")
    listed = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    of = np.repeat(np.arange(len(held)), pc.list_value_length(runs).to_numpy())  # the field's list of each posting
    row = listed[of]
    names, field = _distinct(held.field("field"))
    length, average = held.field("len").to_numpy().astype(np.int64), np.array([averages[f] for f in names.to_pylist()], float)
    terms, rank = _distinct(runs.flatten().field("term"))
    tf = runs.flatten().field("tf").to_numpy()
    key = ((rank * len(names) + field[of]) << (CHUNK_BITS + BLOCK_BITS)) | (doc[row] & (ROWS - 1))
    order = np.argsort(key)
    key, of, tf = key[order], of[order], tf[order].astype(np.int64)
    place = key & ((1 << BLOCK_BITS) - 1)
    value = (K1 + 1) * tf / (tf + K1 * ((1 - B) + B * length[of] / average[field[of]]))
    entries = (place << (2 * COUNT_BITS)) | (tf << COUNT_BITS) | length[of]
    # where a block begins, and which of them begin a row
    first = np.flatnonzero(np.diff(key >> BLOCK_BITS, prepend=-1))
    pair = key[first] >> (CHUNK_BITS + BLOCK_BITS)
    begin = np.flatnonzero(np.diff(pair, prepend=-1))
    chunk = int(block[0]) >> CHUNK_BITS
    blocks = (chunk << CHUNK_BITS) | ((key[first] >> BLOCK_BITS) & ((1 << CHUNK_BITS) - 1))
    bits = np.bitwise_or.reduceat(np.uint64(1) << place.astype(np.uint64), first).view(np.int64)
    ends = lambda starts, end: pa.array(np.append(starts, end).astype(np.int32))
    by_row = lambda values: pa.ListArray.from_arrays(ends(begin, len(first)), values)
    term, name = np.divmod(pair[begin], len(names))
    df = np.diff(np.append(first[begin], len(key)))
    columns = {
        "term": terms.take(pa.array(term)),
        "field": names.take(pa.array(name)),
        "chunk": pa.array(np.full(len(begin), chunk)),
        "df": pa.array(df.astype(np.int64)),
        "block": by_row(pa.array(blocks)),
        "bits": by_row(pa.array(bits)),
        "part": by_row(pa.array(np.maximum.reduceat(value, first))),
        "entries": by_row(pa.ListArray.from_arrays(ends(first, len(key)), pa.array(entries))),  # 64 at most in a block, by place
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _pack_blocks(averages):
    """Batches of forward lists, documents of a chunk side by side, → rows of blocks."""

    def packed(rows):
        if pc.any(pc.greater(pc.list_value_length(rows.column("fields")), 0)).as_py():
            yield _packed(rows, averages)

    def run(batches):
        held = None  # the rows of the last chunk: more of them may come
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            edges = np.flatnonzero(np.diff(rows.column("block").to_numpy() >> CHUNK_BITS)) + 1
            start = 0
            for edge in edges.tolist():
                yield from packed(rows.slice(start, edge - start))
                start = edge
            held = rows.slice(start)
        if held is not None:
            yield from packed(held)
        pa.default_memory_pool().release_unused()

    return run


def _write_segment(spark, folder, forward, before=None):
    """Blocks, terms, variants and fields of the forward lists in ``folder``.

    ``before`` holds the forward lists of the documents that this segment replaces.
    """
    by_field = forward.select("doc", "block", "url", F.inline("fields"))
    totals = lambda df, sign: df.groupBy("field").agg(
        (sign * F.count("*")).alias("n_docs"), (sign * F.sum("len")).alias("words"), F.sum(sign * F.size("runs")).alias("postings")
    )
    sums = totals(by_field, 1).collect()  # the text fields of the schema at most
    averages = {r["field"]: r["words"] / r["n_docs"] for r in sums}
    fields = _literal_rows(spark, "field string, n_docs long, words long, base double", [(r["field"], r["n_docs"], r["words"], averages[r["field"]]) for r in sums])
    if before is not None:
        gone = totals(before.select(F.inline("fields")), -1).select("field", "n_docs", "words", F.lit(0.0).alias("base"))
        fields = fields.unionByName(gone).groupBy("field").agg(*[F.sum(c).alias(c) for c in ("n_docs", "words", "base")])
    fields.coalesce(1).write.parquet(f"{folder}/fields")
    slices = 1 + sum(r["postings"] for r in sums) // (BUCKETS * BUCKET_ROWS)
    schema = _SCHEMAS["blocks"].removesuffix(", bucket int")
    blocks = forward.select("doc", "block", "fields").mapInArrow(_pack_blocks(averages), schema)
    # a term of a third of all documents is spread by its chunks
    _write_by_bucket(blocks.withColumn("bucket", _bucket("term")), f"{folder}/blocks", slices, "term", "field", "chunk")
    blocks = Index(spark, [folder]).read("blocks")
    terms = blocks.select("bucket", "term", "field", "df")
    if before is not None:
        gone = before.select(F.inline("fields")).select("field", F.inline("runs"))
        terms = terms.unionByName(gone.select(_bucket("term").alias("bucket"), "term", "field", F.lit(-1).cast("long").alias("df")))
    terms = terms.groupBy("bucket", "term", "field").agg(F.sum("df").alias("df"))
    _write_by_bucket(terms, f"{folder}/terms", 1, "term", "field")
    spelled = Index(spark, [folder]).read("terms").filter("df > 0").groupBy("bucket", "term").agg(F.first("field").alias("field"))
    spelled = spelled.select(F.explode(_deletions("term")).alias("spelling"), "term")
    spelled = spelled.withColumn("bucket", F.pmod("spelling", F.lit(BUCKETS)).cast("int"))
    _write_by_bucket(spelled, f"{folder}/variants", 1, "spelling")


def _literal_rows(spark, ddl, rows) -> DataFrame:
    """A few rows that stand in the plan itself."""
    if not rows:
        return spark.createDataFrame([], ddl)
    names = [f.split()[0] for f in ddl.split(", ")]
    types = [f.split()[1] for f in ddl.split(", ")]
    structs = [F.struct(*(F.lit(v).cast(t).alias(n) for v, n, t in zip(r, names, types, strict=True))) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


# Folders are named by what they hold: a whole index, or changes of the one whose name they carry.
_WHOLE, _CHANGES = "-whole", "-on-"


def write_index(items: DataFrame, path, fields=None, stems: DataFrame = None):
    """Store the index of ``items``, one row per URL, as one new segment in the place of all others.

    The tables are written beside the old ones and put in force together, so a search during a
    refresh, or after a failed one, reads the complete old index.
    """
    spark = items.sparkSession
    replaced = current(spark, path)
    folder = new_folder(path) + _WHOLE
    _write_forward(items, folder, 0, fields, stems)
    _write_segment(spark, folder, Index(spark, [folder]).read("forward"))
    put_in_force(spark, path, add=[folder], remove=replaced)


def update_index(changed: DataFrame, path, fields=None, stems: DataFrame = None, removed: DataFrame = None):
    """Add a segment with the items that are new or have changed; ``removed`` holds URLs that go.

    Only the changed items are tokenised. Their earlier versions are marked dead, and their words,
    read from the forward lists, are subtracted from the statistics: searches find what they would
    after ``write_index`` of all items, which also folds the segments. One update at a time.
    """
    spark = changed.sparkSession
    index = read_index(spark, path)
    if len(index.folders) >= MOST_SEGMENTS:
        raise ValueError(f"{MOST_SEGMENTS} segments: write the index anew")
    folder = f"{new_folder(path)}{_CHANGES}{index.folders[0].rsplit('/', 1)[1]}"
    _write_forward(changed, folder, len(index.folders), fields, stems)
    forward = Index(spark, [folder]).read("forward")
    urls = forward.select("url") if removed is None else forward.select("url").union(removed.select("url"))
    gone = index.docs.join(urls.distinct(), "url", "left_semi").select("doc")
    index.read("forward").join(gone, "doc", "left_semi").write.parquet(f"{folder}/before")
    before = spark.read.schema(_SCHEMAS["forward"]).parquet(f"{folder}/before")
    bit = F.expr("shiftleft(1L, cast(doc & 63 as int))")
    before.groupBy("block").agg(F.bit_or(bit).alias("bits")).write.parquet(f"{folder}/dead")
    _write_segment(spark, folder, forward, before)
    put_in_force(spark, path, add=[folder])
    delete(spark, f"{folder}/before")


def read_index(spark: SparkSession, path) -> Index:
    """The index in force; of two refreshes that ran side by side, the one named last."""
    folders = current(spark, path)
    whole = [f for f in folders if f.endswith(_WHOLE) and _CHANGES not in f.rsplit("/", 1)[1]]
    if not whole:
        raise ValueError(f"no index is stored at {path}")
    name = whole[-1].rsplit("/", 1)[1]
    return Index(spark, [whole[-1], *(f for f in folders if f.endswith(_CHANGES + name))])


def index_of(items: DataFrame, fields=None) -> Index:
    """Index of a one-off item table, stored in the work folder."""
    path = work_folder(items.sparkSession, "index")
    write_index(items, path, fields)
    return read_index(items.sparkSession, path)
