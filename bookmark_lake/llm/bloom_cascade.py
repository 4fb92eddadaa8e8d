"""URL filters: a Bloom filter cascade over the corpus's keys, in built-in functions only.

A key is the end of a host at a label border followed by the start of a path, such as
``example.net/en/``. Level 1 holds the listed keys; level 2 those keys of the corpus that level 1
takes for listed but are not; level 3 the listed keys that level 2 wrongly holds, and so on until a
level has no false positives. For every key of the corpus the first level that lacks it tells
whether it is listed, so no join and no list is needed at judging. Level 1 is sized so that about
as many keys of the corpus pass it as are listed: the cascade grows with the list and with the
logarithm of the corpus.

A null URL, or one without ``://``, has an empty host and path and fits no rule. Repeated rows and
repeated page_ids are judged row by row; an empty table gives an empty result.
"""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import stored

#: A list beyond so many bits of filter is refused: its filters travel with the plan.
MAX_BITS = 1 << 27
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Level:
    """One Bloom filter: ``n_hashes`` positions of each key in ``n_bits`` bits."""

    def __init__(self, number, n_keys, rate):
        self.number = number
        self.n_hashes = max(1, round(-math.log2(rate)))
        # bits for the rate, and a power of two so that a mask finds the position
        wanted = n_keys * self.n_hashes / math.log(2)
        self.n_bits = 1 << max(6, math.ceil(math.log2(wanted + 1)))
        if self.n_bits > MAX_BITS:
            raise ValueError(f"a filter of {n_keys} listed keys needs {self.n_bits} bits; {MAX_BITS} are allowed")
        self.words = None

    def positions(self, key: Column) -> list[Column]:
        mask = F.lit(self.n_bits - 1).cast("long")
        return [F.xxhash64(key, F.lit(self.number * 1000 + i)).bitwiseAND(mask) for i in range(self.n_hashes)]

    def fill(self, keys: DataFrame):
        """Set the bits of all keys; equal words are combined before the shuffle."""
        at = keys.select(F.explode(F.array(*self.positions(F.col("key")))).alias("at"))
        word = F.shiftright("at", 6).alias("word")
        bit = F.expr("shiftleft(1L, cast(at & 63L as int))")
        rows = at.select(word, bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
        self.words = [0] * (self.n_bits >> 6)
        for row in rows:  # at most n_bits / 64 of them
            self.words[row["word"]] = row["bits"]
        return self

    def contains(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")

        def set_at(at):
            return F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1

        return reduce(Column.__and__, map(set_at, self.positions(key)))


class Cascade:
    """Exact membership of the listed keys among all keys of a corpus."""

    def __init__(self, listed: DataFrame, universe: DataFrame, n_universe: int):
        """``listed`` and ``universe`` have one column, key; ``n_universe`` is an upper bound."""
        listed = listed.filter("key is not null").distinct()
        n_listed = listed.count()
        self.levels = []
        if not n_listed:
            return
        # keys that must be held, and those that must not, change places at each level
        held, others, n_held = listed, None, n_listed
        while n_held:
            rate = 0.5 if self.levels else min(0.5, n_listed * math.sqrt(0.5) / max(n_universe, 1))
            level = Level(len(self.levels) + 1, n_held, rate).fill(held)
            self.levels.append(level)
            against = others if others is not None else universe
            passed = against.filter(level.contains(F.col("key"))).distinct()
            if others is None:
                passed = passed.join(listed, "key", "left_anti")
            # about n_listed keys from here on: read again from the shared folder, not recomputed
            passed = stored(passed, "bloom_level")
            held, others, n_held = passed, held, passed.count()

    def contains(self, key: Column) -> Column:
        """Whether a key of the corpus is listed."""
        inside = F.lit(len(self.levels) % 2 == 1)
        for n in range(len(self.levels), 0, -1):
            inside = F.when(~self.levels[n - 1].contains(key), F.lit(n % 2 == 0)).otherwise(inside)
        return inside


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: host lower-cased in A-Z, path up to a query or fragment."""
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), _UPPER, _LOWER)
    return host, F.regexp_extract(url, pattern, 2)


def candidates(host: Column, path: Column, labels, lengths) -> Column:
    """Keys of a URL that a rule could equal, for the rules' numbers of labels and path lengths."""
    ends = [(F.substring_index(host, ".", -n), F.size(F.split(host, r"\.")) >= n) for n in sorted(labels)]
    starts = [(F.substring(path, 1, n), F.length(path) >= n) for n in sorted(lengths)]
    keys = [F.when(a & b & (F.length(host) > 0), F.concat(h, p)) for h, a in ends for p, b in starts]
    return F.array_compact(F.array(*keys))


def judge_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` with host, path, rule and verdict by the longest rule that fits.

    ``rules`` has host (lower case, without empty labels), path (empty or from its ``/`` on) and
    action (allow or block); a rule fits its host and all subdomains where the path starts with
    the rule's. Of two rules of equal length the one with the longer host wins, then block. A URL
    that no rule fits is allowed: its keys are in no cascade.
    """
    shape = rules.select(
        F.collect_set(F.size(F.split("host", r"\."))).alias("labels"),
        F.collect_set(F.length("path")).alias("lengths"),
    ).first()
    new = ["host", "path", "rule", "verdict"]
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in new]
    host, path = url_parts(F.col("url"))
    parts = pages.select(*kept, host.alias("host"), path.alias("path"))
    keys = candidates(F.col("host"), F.col("path"), shape["labels"], shape["lengths"])
    if not shape["labels"]:
        no_rule = F.lit(None).cast("string").alias("rule")
        return parts.select(*kept, "host", "path", no_rule, F.lit("allow").alias("verdict"))
    urls = pages.select(host.alias("host"), path.alias("path")).select(keys.alias("keys"))
    n_universe = urls.agg(F.sum(F.size("keys"))).first()[0] or 0
    universe = urls.select(F.explode("keys").alias("key"))
    key = F.concat("host", "path").alias("key")
    listed = {
        action: Cascade(rules.filter(F.col("action") == action).select(key), universe, n_universe)
        for action in ("block", "allow")
    }

    def judged(key):
        host_size = F.length(F.substring_index(key, "/", 1))
        fit = [
            F.struct(F.length(key).alias("size"), host_size.alias("host_size"), F.lit(a).alias("action"), key.alias("key"))
            for a in listed
        ]
        return F.array(*(F.when(c.contains(key), f) for c, f in zip(listed.values(), fit, strict=True)))

    best = F.array_max(F.array_compact(F.flatten(F.transform(keys, judged))))
    return parts.select(*kept, "host", "path", best.alias("best")).select(
        *kept,
        "host",
        "path",
        F.col("best.key").alias("rule"),
        F.coalesce("best.action", F.lit("allow")).alias("verdict"),
    )
