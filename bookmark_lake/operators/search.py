"""Ranked keyword search over an index.

A query's words become index terms with their statistics: exact words are looked up in their
buckets, fuzzy ones by their spelling variants. The blocks of these terms, 64 documents each, meet
by block. There the boolean expressions run on the bits, one long for each word, and the exact
number of hits is a sum of bit counts: neither reads what a posting adds to a score. From the
largest parts of a block follows the most any of its documents can score. A search first scores the
best blocks; what the last of their top rows scores is a threshold, and only blocks that can reach
it are read in full.
"""

import json
import math
from collections import namedtuple
from functools import reduce

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_folder
from .index import BUCKETS, CHUNK_BITS, DELETIONS, Index, bucket_of, entry, posting_part, spellings

# Results per query; fuzzy distance by word length.
RESULTS = 30
FUZZY_ONE_FROM, FUZZY_TWO_FROM = 2, 6

# Rows are ranked in one task, so a caller may ask for this many at most.
MOST_RESULTS = 10_000

# Blocks that a search lists by the most they can score; it scores the first until they hold
# HITS_AHEAD times the rows asked for. Further blocks are joined instead of listed.
LISTED = 4096
HITS_AHEAD = 4
# Terms of fuzzy words that stand in the plan itself.
TERMS = 1000
# Scores are rounded to this many digits.
DIGITS = 6

# The words of the index (index.WORD), with the fuzzy sign and its distance.
_SIGN = r"[\p{Han}\p{Hiragana}]"
_PART = rf"_*(?!{_SIGN})[\p{{L}}\p{{N}}](?:(?!{_SIGN})[\p{{L}}\p{{M}}\p{{N}}_])*+"
_WORD = rf"{_SIGN}\p{{M}}*|{_PART}(?:[.'’]{_PART})*"
_QUERY = regex.compile(rf"(?P<word>{_WORD})(?P<fuzzy>~(?P<distance>[0-9]*))?|(?P<mark>[()]|(?<![^\s(])[+-](?=\S))")
_REFUSED = regex.compile(r"[\"*?\[\]{}^\\]|&&|\|\||(?<![^\s(])!|(?<=\w):(?=\S)|(?<=\s|^)/\S")

# ``distance`` is None for a word taken as it is.
Word = namedtuple("Word", "grp word term distance")


def _parsed(text, grp, words):
    """The expression of one argument; its words are appended to ``words``.

    ("word", n), ("and", parts), or ("list", should, must, must not): a list matches if all its
    musts and no must-not match, and without musts at least one should.
    """
    if refused := _REFUSED.search(text):
        raise ValueError(f"query syntax {refused.group().strip()!r} is not supported: {text}")
    tokens = list(_QUERY.finditer(text))
    at = 0

    def ahead(*keywords):
        token = tokens[at] if at < len(tokens) else None
        return token is not None and (token["mark"] in keywords or (token["word"] in keywords and not token["fuzzy"]))

    def take():
        nonlocal at
        at += 1
        return tokens[at - 1]

    def unit():
        if ahead("("):
            take()
            inner = whole()
            if not ahead(")"):
                raise ValueError(f"a parenthesis is not closed: {text}")
            take()
            return inner
        if at == len(tokens) or tokens[at]["word"] is None or ahead("AND", "OR"):
            raise ValueError(f"a word is missing: {text}")
        token = take()
        term = token["word"].lower()
        distance = None
        if token["fuzzy"]:
            distance = int(token["distance"]) if token["distance"] else allowed_distance(term)
            if distance > 2:
                raise ValueError(f"a fuzzy distance is 2 at most: {token.group()}")
        words.append(Word(grp, len(words), term, distance))
        return ("word", words[-1].word)

    def signed():
        sign = "should"
        if ahead("NOT", "-"):
            sign = "not"
            take()
        elif ahead("+"):
            sign = "must"
            take()
        return sign, unit()

    def clause():
        parts = [signed()]
        while ahead("AND"):
            take()
            parts.append(signed())
        if len(parts) == 1:
            return parts[0]
        musts = [p for s, p in parts if s != "not"]
        nots = [p for s, p in parts if s == "not"]
        if not musts:
            raise ValueError(f"an exclusion needs a word to match: {text}")
        return "should", ("list", [], musts, nots)

    def whole():
        parts = [clause()]
        while at < len(tokens) and not ahead(")"):
            if ahead("OR"):
                take()
            parts.append(clause())
        found = {s: [p for sign, p in parts if sign == s] for s in ("should", "must", "not")}
        if not found["should"] and not found["must"]:
            raise ValueError(f"an exclusion needs a word to match: {text}")
        return ("list", found["should"], found["must"], found["not"])

    expression = whole() if tokens else None
    if at < len(tokens):
        raise ValueError(f"a parenthesis is not opened: {text}")
    return expression


def parse_query(terms):
    """(words, expressions by group): every argument is a group, groups are ANDed.

    In a group words are ORed; AND, OR, NOT, a leading + (must) or - (must not), parentheses and
    word~, word~1, word~2 (fuzzy) are understood. Any other query syntax is refused.
    """
    words, groups = [], {}
    for grp, text in enumerate(terms):
        expression = _parsed(text, grp, words)
        if expression is not None:
            groups[grp] = expression
    if not words:
        raise ValueError("No query provided")
    return words, groups


def _excluded(expression, excluded=False) -> set:
    """Words that only exclude: they add nothing to a score."""
    if expression[0] == "word":
        return {expression[1]} if excluded else set()
    _, should, must, must_not = expression
    own = [_excluded(e, excluded) for e in should + must] + [_excluded(e, True) for e in must_not]
    return set().union(*own)


def allowed_distance(term) -> int:
    return (len(term) >= FUZZY_ONE_FROM) + (len(term) >= FUZZY_TWO_FROM)


def _swaps(term) -> list:
    """The term with each pair of neighbours exchanged."""
    swapped = {term[:i] + term[i + 1] + term[i] + term[i + 2 :] for i in range(len(term) - 1)}
    return sorted(swapped - {term})


def _listed(words) -> Column:
    """Some words as one literal; words hold no line break."""
    return F.split(F.lit("\n".join(words)), "\n")


def edit_distance(c: Column, term, limit) -> Column:
    """Edits, with a swap of neighbours as one, between ``c`` and ``term``; NULL beyond ``limit``."""
    if limit == 0:
        return F.when(c == term, F.lit(0))
    plain = F.levenshtein(c, F.lit(term), limit)
    distance = F.when(c == term, F.lit(0))
    swaps = _swaps(term)
    if swaps:
        distance = distance.when(F.array_contains(_listed(swaps), c), F.lit(1))
    distance = distance.when(plain.between(0, limit), plain)
    if limit == 2 and swaps:
        twice = sorted({t for s in swaps for t in _swaps(s)})
        distance = distance.when(F.array_contains(_listed(twice), c), F.lit(2))
        distance = distance.when(F.exists(_listed(swaps), lambda s: F.levenshtein(c, s, 1) >= 0), F.lit(2))
    return distance


def expand_fuzzy(index: Index, term, limit=None) -> DataFrame:
    """Terms of the index within the allowed distance → (term, distance, boost), all of them.

    Words that are at most two edits apart share a spelling of their first letters without two of
    them, so the buckets of the word's own spellings hold them all.
    """
    limit = allowed_distance(term) if limit is None else limit
    own = spellings(term, DELETIONS)
    near = index.read("variants", {s % BUCKETS for s in own}).filter(_among("spelling", own))
    near = near.filter(F.length("term").between(len(term) - limit, len(term) + limit)).select("term").distinct()
    return (
        near.withColumn("distance", edit_distance(F.col("term"), term, limit))
        .filter(F.col("distance").isNotNull())
        .withColumn(
            "boost",
            1.0 - F.col("distance") / F.least(F.length("term"), F.lit(len(term))),
        )
    )


class Matched:
    """Index terms that a query's words stand for, with their weights.

    ``known`` has (term, field, word, grp, weight, avg_len). Exact words and up to TERMS terms of
    fuzzy ones are rows of the plan itself, which the scan of the blocks can look for; if fuzzy
    words stand for more, those are looked up once and stored.
    """

    def __init__(self, index: Index, words, fields=None):
        self.index, self.fields = index, fields
        self.stats = {f: s for f, s in index.fields.items() if fields is None or f in fields}
        spark = index.spark
        named = [(w.term, w.word, w.grp, 1.0) for w in words if w.distance is None]
        fuzzy = [w for w in words if w.distance is not None]
        many = None
        if fuzzy:
            near = reduce(
                DataFrame.unionByName,
                [expand_fuzzy(index, w.term, w.distance).select("term", F.lit(w.word).alias("word"), F.lit(w.grp).alias("grp"), "boost") for w in fuzzy],
            )
            few = near.limit(TERMS + 1).collect()
            if len(few) <= TERMS:
                named += [(r["term"], r["word"], r["grp"], r["boost"]) for r in few]
            else:
                many = self._stored(near)
        terms = sorted({t[0] for t in named})
        self.buckets = {bucket_of(t) for t in terms}
        by_term = {}
        if terms:
            found = index.known_terms(self.buckets).filter(_among("term", terms))
            for r in found.collect():  # the fields of each term
                if r["field"] in self.stats:
                    n_docs, avg_len = self.stats[r["field"]]
                    weight = math.log(1 + (n_docs - r["df"] + 0.5) / (r["df"] + 0.5))
                    by_term.setdefault(r["term"], []).append((r["field"], weight, avg_len))
        rows = [(t, f, word, grp, weight * boost, avg) for t, word, grp, boost in named for f, weight, avg in by_term.get(t, [])]
        self.terms = sorted({r[0] for r in rows}) if many is None else None
        self.known = F.broadcast(_json_rows(spark, _KNOWN, rows))
        if many is not None:
            buckets = {r["bucket"] for r in many.select("bucket").distinct().collect()}  # BUCKETS at most
            self.known = self.known.unionByName(self._weighed(index.known_terms(buckets), many))
            self.buckets |= buckets

    def _stored(self, near) -> DataFrame:
        path = work_folder(self.index.spark, "fuzzy_terms")
        near.withColumn("bucket", F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(BUCKETS)).cast("int")).write.parquet(path)
        return self.index.spark.read.schema("term string, word int, grp int, boost double, bucket int").parquet(path)

    def _weighed(self, known, near):
        stats = _json_rows(self.index.spark, "field string, n_docs long, avg_len double", [(f, *s) for f, s in self.stats.items()])
        # a row for each text field of the schema at most
        joined = known.join(near.drop("bucket"), "term").join(F.broadcast(stats), "field")
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return joined.select("term", "field", "word", "grp", (idf * F.col("boost")).alias("weight"), "avg_len")


_KNOWN = "term string, field string, word int, grp int, weight double, avg_len double"


def _json_rows(spark, ddl, rows) -> DataFrame:
    """Rows that stand in the plan itself, as one literal."""
    names = [f.split()[0] for f in ddl.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(f.replace(' ', ': ') for f in ddl.split(', '))}>>")))


def _among(name, values) -> str:
    """SQL: ``name`` is one of some numbers or words."""
    quoted = (str(v) if isinstance(v, int) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return f"{name} IN ({', '.join(quoted)})" if values else "false"


class Query:
    """A parsed query over an index."""

    def __init__(self, index: Index, terms, fields=None):
        self.index = index
        self.words, self.expressions = parse_query(terms)
        self.matched = Matched(index, self.words, fields)
        self.excluded = sorted(set().union(*map(_excluded, self.expressions.values())))
        self.scaled = self._scales()

    def _scales(self):
        """How much a stored largest part may have grown, by segment and field, as mean lengths have."""
        if len(self.index.folders) == 1:
            return [{}]
        now = self.index.fields
        names = [folder.rsplit("/", 1)[1] for folder in self.index.folders]
        bases = [{f: r[2] for (own, f), r in self.index.field_rows.items() if own == name} for name in names]
        return [{f: max(1.0, now[f][1] / b) for f, b in base.items() if b and f in now} for base in bases]

    def blocks(self, columns, listed=None) -> DataFrame:
        """Blocks of the matched terms with ``columns``, of all documents or of the ``listed`` blocks."""
        wanted = [_among("term", self.matched.terms)] if self.matched.terms is not None else []
        wanted += [_among("chunk", sorted({b >> CHUNK_BITS for b in listed}))] if listed is not None else []
        frames = []
        for folder, scale in zip(self.index.folders, self.scaled, strict=True):
            blocks = self.index.blocks(columns, self.matched.buckets, [folder], " AND ".join(wanted) or "true")
            if scale and "part" in columns:
                grown = F.create_map(*[F.lit(x) for pair in scale.items() for x in pair])
                blocks = blocks.withColumn("part", F.col("part") * F.coalesce(F.try_element_at(grown, F.col("field")), F.lit(1.0)))
            frames.append(blocks)
        blocks = reduce(DataFrame.unionByName, frames)
        if listed is not None:
            blocks = blocks.filter(_among("block", listed))
        return blocks.join(self.matched.known, ["term", "field"])

    def _weight(self):
        """The weight with which a word adds to a score: none if it only excludes."""
        return f"CASE WHEN word IN ({', '.join(map(str, self.excluded))}) THEN 0.0D ELSE weight END" if self.excluded else "weight"

    def _folded(self, rows, keys, value, *carried) -> DataFrame:
        """Values by keys: words add up in a field, the best field of a group counts, groups add up.

        ``rows`` are dealt by block, the first key, so no step moves them again.
        """
        carry = [F.expr(f"bit_or({c}) AS {c}") for c in carried]
        steps = [(["grp", "field"], "sum"), (["grp"], "max"), ([], "sum")]
        if any(w.distance is not None for w in self.words):
            # of the terms one fuzzy word stands for, the best in the field counts
            steps = [(["grp", "field", "word"], "max"), *steps]
        for by, fold in steps:
            rows = rows.groupBy(*keys, *by).agg(F.expr(f"{fold}({value}) AS value"), *carry)
            value = "value"
        return rows

    def _hits(self, by_block, *more) -> DataFrame:
        """(block, hits): the bits of living documents that satisfy all expressions."""
        hits = reduce(Column.bitwiseAND, [_bits_of(e) for e in self.expressions.values()])
        found = by_block.select("block", hits.alias("hits"), *more).filter("hits <> 0")
        more = [F.col(c) for c in found.columns[2:]]
        if self.index.folders[1:]:
            dead = self.index.dead.groupBy("block").agg(F.bit_or("bits").alias("gone"))
            living = F.col("hits").bitwiseAND(F.bitwise_not(F.coalesce("gone", F.lit(0).cast("long"))))
            found = found.join(dead, "block", "left").select("block", living.alias("hits"), *more).filter("hits <> 0")
        return found

    def _by_word(self):
        """For each word the bits of its documents in a block."""
        return [f"CASE WHEN word = {w.word} THEN bits END AS b{w.word}" for w in self.words]

    def hits(self, listed=None) -> DataFrame:
        """(block, hits) of all blocks with hits; no score is computed."""
        rows = self.blocks(["bits"], listed).selectExpr("block", *self._by_word())
        return self._hits(rows.groupBy("block").agg(*[F.expr(f"bit_or(b{w.word}) AS b{w.word}") for w in self.words]))

    def heads(self) -> DataFrame:
        """(block, hits, most): ``most`` is what no document of the block can exceed."""
        rows = self.blocks(["bits", "part"]).selectExpr("block", "grp", "field", "word", f"{self._weight()} * part AS most", *self._by_word())
        folded = self._folded(rows.repartition("block"), ["block"], "most", *[f"b{w.word}" for w in self.words])
        return self._hits(folded, F.col("value").alias("most"))

    def listed(self, heads):
        """(blocks, their hits) of some of the heads, which the driver holds; LISTED at most."""
        rows = [(r["block"], r["hits"]) for r in heads]
        return [b for b, _ in rows], F.broadcast(_json_rows(self.index.spark, "block long, hits long", rows))

    def scores(self, hits, listed=None) -> DataFrame:
        """(doc, score) of the documents whose bits are in ``hits``."""
        rows = self.blocks(["entries"], listed).selectExpr("block", "grp", "field", "word", f"{self._weight()} AS weight", "avg_len", "entries")
        rows = rows.join(hits, "block").repartition("block") if listed is not None else rows.repartition("block").join(hits, "block")
        found = f"explode(filter(entries, e -> (shiftright(hits, int({entry('place')})) & 1) = 1)) AS e"
        rows = rows.selectExpr("block", "grp", "field", "word", "weight", "avg_len", found)
        value = posting_part(entry("tf"), entry("len"), "avg_len")
        rows = rows.selectExpr("block", f"{entry('place')} AS place", "grp", "field", "word", f"weight * {value} AS part")
        folded = self._folded(rows, ["block", "place"], "part")
        return folded.selectExpr("shiftleft(block, 6) | place AS doc", f"round(value, {DIGITS}) AS score")

    def with_urls(self, scored, listed=None) -> DataFrame:
        docs = self.index.docs
        if listed is not None:
            docs = docs.filter(_among("block", listed))
        return scored.join(docs, "doc").select("url", "score")


def _bits_of(expression) -> Column:
    """The bits of a block's documents that satisfy an expression."""
    if expression[0] == "word":
        return F.coalesce(F.col(f"b{expression[1]}"), F.lit(0).cast("long"))
    _, should, must, must_not = expression
    every = [_bits_of(e) for e in must] + [F.bitwise_not(_bits_of(e)) for e in must_not]
    if not must:
        every.append(reduce(Column.bitwiseOR, [_bits_of(e) for e in should]))
    return reduce(Column.bitwiseAND, every)


def score_hits(index: Index, terms, fields=None) -> DataFrame:
    """(url, score) of every item that matches all groups."""
    query = Query(index, terms, fields)
    return query.with_urls(query.scores(query.hits()))


def matching(index: Index, terms, fields=None) -> DataFrame:
    """(url) of every item that matches all groups, without scores."""
    places = F.expr("filter(sequence(0, 63), i -> (shiftright(hits, i) & 1) = 1)")
    found = Query(index, terms, fields).hits().select("block", F.explode(places).alias("place"))
    docs = found.select(F.expr("shiftleft(block, 6) | place").alias("doc"))
    return docs.join(index.docs.select("doc", "url"), "doc").select("url")


def count_hits(index: Index, terms, fields=None) -> DataFrame:
    """total_hits: the exact number of hits, by their bits alone."""
    return Query(index, terms, fields).hits().agg(F.coalesce(F.sum(F.bit_count("hits")), F.lit(0)).cast("long").alias("total_hits"))


def _ranked(index, terms, fields, size):
    """(best hits, their total number)."""
    if not 0 < size <= MOST_RESULTS:
        raise ValueError(f"a search returns 1 to {MOST_RESULTS} rows, ranked in one task")
    query = Query(index, terms, fields)
    heads = query.heads()
    first = heads.orderBy(F.col("most").desc(), "block").limit(LISTED + 1).collect()
    whole = len(first) <= LISTED
    counts = [(r["hits"] % (1 << 64)).bit_count() for r in first]
    total = sum(counts) if whole else query.hits().agg(F.sum(F.bit_count("hits"))).first()[0]
    ahead, held = 0, 0
    while ahead < len(first) and held < HITS_AHEAD * size:
        held += counts[ahead]
        ahead += 1
    threshold = float("-inf")
    if ahead < len(first):
        listed, hits = query.listed(first[:ahead])
        best = query.scores(hits, listed).orderBy(F.col("score").desc()).limit(size).collect()
        threshold = best[-1]["score"]  # these blocks hold more than ``size`` hits
    # scores are rounded, and parts are added in another order here
    least = threshold - 10.0**-DIGITS
    if whole or first[-1]["most"] < least:
        listed, hits = query.listed([r for r in first if r["most"] >= least])
        scored = query.scores(hits, listed)
    else:
        listed = None
        scored = query.scores(heads.filter(F.col("most") >= least).select("block", "hits"))
    if ahead < len(first):
        scored = scored.filter(F.col("score") >= threshold)
    found = query.with_urls(scored, listed)
    return found.orderBy(F.col("score").desc(), "url").limit(size), total


def best_hits(index: Index, terms, fields=None, size=RESULTS) -> DataFrame:
    """(url, score) of the best hits; equal scores in URL order."""
    return _ranked(index, terms, fields, size)[0]


def with_standout(top: DataFrame) -> DataFrame:
    """Rank and standout flag: score at least mean plus sample deviation of the rows given.

    The windows run over the returned rows only, never over all hits.
    """
    everything = Window.partitionBy(F.lit(1))
    mean = F.avg("score").over(everything)
    deviation = F.coalesce(F.stddev_samp("score").over(everything), F.lit(0.0))
    ranked = Window.partitionBy(F.lit(1)).orderBy(F.col("score").desc(), "url")
    return top.select(
        F.row_number().over(ranked).alias("rank"),
        "url",
        "score",
        (F.round(F.col("score"), 6) >= F.round(mean + deviation, 6)).alias("is_standout"),
        *[c for c in top.columns if c not in ("url", "score")],
    )


def search(index: Index, terms, fields=None, size=RESULTS) -> DataFrame:
    """rank, url, score, is_standout, total_hits of the best ``size`` hits."""
    best, total = _ranked(index, terms, fields, size)
    return with_standout(best.withColumn("total_hits", F.lit(total).cast("long")))
