"""Language ID: known words first, then ever shorter character n-grams.

A word that the training texts have often is scored by its log frequency in each language. Another
word backs off: it is scored by its n-grams of 4 characters that are known, else of 3, 2 or 1; a
word without any says nothing. Letters of ASCII and Latin-1 are folded to lower case. A document's
language has the greatest mean score of its words; its probability is calibrated to few words, as
words of one text are not independent.

A null text, or one without a letter, is ``und`` with score 0, as are all texts if nothing was
learned. Ties go to the first language by name. Counts cover all training rows. The model keeps the same number of words and of n-grams for each
language, its own most frequent ones with their counts in all languages, so that a language with
few rows keeps as many as one with most; that bounds what is sent to the tasks.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import (
    BLOCKS,
    BYTE_CODE,
    LOWER,
    U64,
    Hashes,
    Lookup,
    block_rows,
    byte_table,
    counts_of,
    expand,
    map_texts,
    mix,
    only,
    pack,
    runs,
    shard_count,
    slices,
    stored,
    text_bytes,
    unpack,
    words,
)

LONGEST = 4
#: Words and n-grams kept for each of up to 4 languages; see ``_each``.
WORDS, GRAMS = 100_000, 100_000
#: A word or n-gram is known from so many occurrences on.
LEAST = 3
#: A text counts as so many independent words at most.
WORDS_COUNTED = 20
PORTION = 1_500_000
LETTER = ~byte_table([*range(0x00, 0x61), *range(0x7B, 0x80)])


def _words(column):
    data, offsets = text_bytes(column)
    data = LOWER[data]
    if len(data) > 1:  # upper case of Latin-1: C3 80 .. C3 9E
        upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        data[upper] += 0x20
    start, end, row = words(data, offsets, LETTER)
    return data, start, end, row


def _grams(data, chain, start, end):
    """For n = LONGEST .. 1: (key, word) of the character n-grams of words, marked at a word's ends."""
    char = np.flatnonzero((data & 0xC0) != 0x80)
    first, last = np.searchsorted(char, start), np.searchsorted(char, end)
    bounds = np.concatenate((char, [len(data)]))
    for n in range(LONGEST, 0, -1):
        many = np.maximum(last - first - n + 1, 0)
        word = np.repeat(np.arange(len(start)), many)
        at = expand(first, many)
        ends = (at == first[word]).astype(U64) + U64(2) * (at + n == last[word]).astype(U64)
        stop = np.minimum(bounds[at + n], end[word])
        yield n, mix(chain.of(bounds[at], stop) + U64(8 * n) + ends), word


def _counted(docs, n_langs, shards):
    """Blocks of (key, language, count) of words (kind 0) and n-grams (kind 1)."""

    def run(batches):
        def packed(own, grams):
            for kind, held in enumerate((own, grams)):
                columns = merged(held)
                yield from pack(kind, columns[0], columns, shards)

        def tally(key, lang, count=None):
            order = np.lexsort((lang, key))
            key, lang = key[order], lang[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (lang[1:] != lang[:-1])
            at = np.flatnonzero(new)
            total = np.concatenate(([0], np.cumsum(np.ones(len(key)) if count is None else count[order], dtype=np.int64)))
            n = total[np.concatenate((at[1:], [len(key)]))[: len(at)]] - total[at]
            return key[at], lang[at], n.astype(np.uint32)

        def merged(held):
            return tally(*(np.concatenate([h[i] for h in held]) for i in range(3)))

        own, grams, n_held = [], [], 0
        for part in slices(batches):
            data, start, end, row = _words(part.column("text"))
            chain = Hashes(BYTE_CODE[data])
            key = chain.of(start, end)
            lang = np.asarray(part.column("lang_index"), np.int64)[row].astype(np.uint8)
            own.append(tally(key, lang))
            # n-grams of a slice's distinct words, weighted by their counts
            order = np.lexsort((lang, key))
            new = np.ones(len(key), bool)
            new[1:] = (key[order][1:] != key[order][:-1]) | (lang[order][1:] != lang[order][:-1])
            at = order[new]
            weight = own[-1][2]
            for _, gram, word in _grams(data, chain, start[at], end[at]):
                grams.append(tally(gram, lang[at][word], weight[word]))
            n_held += len(own[-1][0])
            if n_held >= PORTION:
                yield from block_rows(packed(own, grams))
                own, grams, n_held = [], [], 0
            elif len(grams) > 60:
                grams = [merged(grams)]
        if own:
            yield from block_rows(packed(own, grams))

    def total(table):
        got = unpack(table, words=(U64, np.uint8, np.uint32), grams=(U64, np.uint8, np.uint32))
        columns = [[], [], []]
        for kind, name in enumerate(got):
            key, lang, count = got[name][0]
            order = np.argsort(key, kind="stable")
            start, size = runs(key[order])
            which = np.repeat(np.arange(len(start)), size)
            table_of = np.bincount(which * n_langs + lang[order], weights=count[order], minlength=len(start) * n_langs)
            table_of = table_of.reshape(len(start), n_langs).astype(np.int64)
            often = table_of.sum(axis=1) >= LEAST
            columns[0].append(np.full(often.sum(), kind, np.int32))
            columns[1].append(key[order][start][often].view(np.int64))
            columns[2].extend(table_of[often].tolist())
        arrays = [pa.array(np.concatenate(c)) for c in columns[:2]]
        return pa.Table.from_arrays([*arrays, pa.array(columns[2], pa.list_(pa.int64()))], names=["kind", "key", "counts"])

    blocks = docs.mapInArrow(run, BLOCKS)
    return blocks.groupBy("shard").applyInArrow(total, "kind int, key long, counts array<long>")


class Model:
    """Known words and n-grams with their log frequencies by language."""

    def __init__(self, langs, words=None, grams=None):
        """``words`` and ``grams`` are Arrow tables of (key, counts by language)."""
        self.langs = langs
        if langs:
            self.words, self.word_score = self._table(words)
            self.grams, self.gram_score = self._table(grams)

    def _table(self, table):
        keys = np.asarray(table.column("key"), np.int64).view(U64)
        counts = np.asarray(table.column("counts").combine_chunks().flatten(), np.float64).reshape(len(keys), len(self.langs))
        share = (counts + 0.1) / (counts.sum(axis=0) + 0.1 * max(len(keys), 1))
        order = np.argsort(keys)
        return Lookup(keys[order]), np.log(share[order])

    def predict(self, column):
        """(language, probability) of each text."""
        n_rows, n_langs = len(column), len(self.langs)
        data, start, end, row = _words(column)
        chain = Hashes(BYTE_CODE[data])
        key = chain.of(start, end)
        score = np.zeros((len(start), n_langs))
        known = self.words.find(key)
        score[known >= 0] = self.word_score[known[known >= 0]]
        rest = np.flatnonzero(known < 0)
        # words of one spelling back off once
        spelling, first, back = np.unique(key[rest], return_index=True, return_inverse=True)
        own = np.zeros((len(spelling), n_langs))
        open_ = np.ones(len(spelling), bool)
        for _, gram, word in _grams(data, chain, start[rest[first]], end[rest[first]]):
            slot = self.grams.find(gram)
            use = (slot >= 0) & open_[word]
            many = counts_of(word[use], len(spelling))
            for k in range(n_langs):
                own[:, k] += np.bincount(word[use], self.gram_score[slot[use], k], len(spelling)) / np.maximum(many, 1)
            open_ &= many == 0
        score[rest] = own[back]
        total = counts_of(row, n_rows)
        mean = np.stack([np.bincount(row, score[:, k], n_rows) for k in range(n_langs)], axis=1)
        mean *= (np.minimum(total, WORDS_COUNTED) / np.maximum(total, 1))[:, None]
        mean -= mean.max(axis=1, keepdims=True)
        share = np.exp(mean)
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        letters = self._letters(column, data, row)
        lang = [self.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
        return pa.array(lang, pa.string()), pa.array(np.where(letters, share[np.arange(n_rows), best], 0.0))

    @staticmethod
    def _letters(column, data, row):
        """Whether each text has a letter; only texts without ASCII letters are looked at one by one."""
        ascii_ = (data >= 0x61) & (data <= 0x7A)
        _, offsets = text_bytes(column)
        many = np.concatenate(([0], np.cumsum(ascii_)))
        plain = many[offsets[1:]] > many[offsets[:-1]]
        for r in np.unique(row[~plain[row]]):
            plain[r] = any(c.isalpha() for c in column[int(r)].as_py())
        return plain


def _each(most, n_langs):
    """How many are kept for each language: the model has a number for each and language, so fewer beyond 4."""
    return max(most // n_langs, min(most, 16 * most // n_langs**2))


def _most_frequent(counted, kind, most, n_langs):
    """Arrow table of (key, counts): the keys that are among the ``most`` most frequent of any language."""
    own = counted.filter(F.col("kind") == kind)
    tables = []
    for k in range(n_langs):
        count = F.col("counts")[k]
        tables.append(own.filter(count > 0).orderBy(F.desc(count), "key").limit(most).select("key", "counts").toArrow())
    table = pa.concat_tables(tables).combine_chunks()
    _, first = np.unique(np.asarray(table.column("key"), np.int64), return_index=True)
    return table.take(pa.array(first))


def train(docs: DataFrame) -> Model:
    """Learn from all rows of ``docs`` (text, lang) with a language."""
    docs = docs.filter("lang is not null")
    langs = sorted(r["lang"] for r in docs.select("lang").distinct().limit(257).collect())
    if len(langs) > 256:
        raise ValueError("more than 256 languages")
    if not langs:
        return Model([])
    index = F.array_position(F.lit(langs), F.col("lang")).cast("int") - 1
    texts = docs.select(index.alias("lang_index"), "text")
    counted = _counted(texts, len(langs), shard_count(texts))
    n = len(langs)
    with only(docs.sparkSession):
        counted = stored(counted, "language_counts")
        return Model(langs, *(_most_frequent(counted, kind, _each(most, n), n) for kind, most in ((0, WORDS), (1, GRAMS))))


def identify(docs: DataFrame, model: Model, keep=None) -> DataFrame:
    """Rows of ``docs`` with lang_pred and score."""
    new = "lang_pred string, score double"
    if not model.langs:
        keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("lang_pred", "score")]
        return docs.select(*(F.col(f"`{c}`") for c in keep), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, lambda part: shared.value.predict(part.column(part.num_columns - 1)), new, keep)


def held_out(doc_id):
    """Rows that no label is learned from: crc32 of the doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
