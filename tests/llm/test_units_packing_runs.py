"""Fill-in-the-middle, packing and periodic runs against plain code."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("bookmark_lake.llm.checks")
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from bookmark_lake.llm import fill_middle, packing, periodic  # noqa: E402

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{i * i % 977}" for i in range(30_000))
EDGE = [
    (1, None),
    (2, ""),
    (3, "x"),
    (4, LONG),
    (5, "one, two. Three\n\nfour—five 日本 é😀"),
    (5, "one, two. Three\n\nfour—five 日本 é😀"),
    (6, " \t\n\x0b "),
    (7, "it's <|endoftext|> é ́x İstanbul ΣΑΣ a b c'll 12345"),
    (8, "has <S> inside"),
    (9, "日本語" * 3000),
    (None, "no key here, none"),
    (None, "no key here, none"),
    (10, "a b " * 5000),
    (20, "ends < in <S <P"),
]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string").repartition(3)
    for c in ("N", "form", "output", "piece", "part", "nth", "Runs", "seed", "numbers", "offset", "f0", "k0", "p0"):
        df = df.withColumn(c, F.lit("own"))
    return df


def found(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# fill in the middle


def plain_transform(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "", re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or h[2] % 100 >= 90 or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text or "", text or ""
    if h[3] % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


NAMES = ("n", "form", "prefix_chars", "middle_chars", "output", "restored")


def test_fill_in_middle_edges(edge):
    out = fill_middle.fill_in_middle(edge, restored=True)
    assert set(out.columns) == {"doc_id", "text", "piece", "part", "nth", "Runs", "seed", "numbers", "offset", "f0", "k0", "p0", *NAMES}
    assert found(out, "doc_id", *NAMES) == sorted(((i, *plain_transform(i, t)) for i, t in EDGE), key=repr)
    again = fill_middle.restore(out.drop("text"))
    assert found(again, "doc_id", "restored") == sorted(((i, t or "") for i, t in EDGE), key=repr)


def test_fill_in_middle_random(spark):
    rng = random.Random(3)
    parts = ["<", ">", "P", "<P", "S>", "M", " ", "\n", "é", "日", "😀", "word", "<M", "Z"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(1, 30)))) for i in range(3000)]
    out = fill_middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), restored=True)
    got = found(out, "doc_id", *NAMES)
    assert got == sorted(((i, *plain_transform(i, t)) for i, t in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_shares(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    assert fill_middle.fill_in_middle(df, plain_share=100).filter("form <> 'plain'").count() == 0
    assert fill_middle.fill_in_middle(df, plain_share=0, spm_share=100).filter("form <> 'spm'").count() == 0
    assert fill_middle.fill_in_middle(df.limit(0)).count() == 0


def test_restore_of_nulls(spark):
    df = spark.createDataFrame([(None, "psm"), ("x", None), ("<P>a<S>c<M>b", "psm")], "output string, form string")
    assert [r["restored"] for r in fill_middle.restore(df).collect()] == [None, "x", "abc"]


# packing


def pieces_of(text, size):
    ids = [*Tokenizer.from_file(WORD_BPE).encode(text or "", add_special_tokens=False).ids, 1]
    return [(i // size, i, len(ids[i : i + size]), np.array(ids[i : i + size], "<u4").tobytes()) for i in range(0, len(ids), size)]


def check_packed(rows, size):
    """Each sequence is gapless from 0 and no longer than ``size``; the number of sequences."""
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(held)


def test_pack_edges(edge):
    packed = packing.pack(edge, WORD_BPE, size=512)
    assert {"N", "form", "k0", "Runs", "ids"} <= set(packed.columns)
    rows = packed.collect()
    got = sorted(((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in rows), key=repr)
    assert got == sorted(((i, *p) for i, t in EDGE for p in pieces_of(t, 512)), key=repr)
    n = check_packed(rows, 512)
    assert n == -(-sum(r["length"] for r in rows) // 512)
    whole = packing.sequences(packed).collect()
    assert len(whole) == n and all(len(r["ids"]) == 4 * r["length"] for r in whole)
    by_place = {(r["sequence_id"], r["offset"]): bytes(r["ids"]) for r in rows}
    for r in whole:
        parts = sorted((o, b) for (s, o), b in by_place.items() if s == r["sequence_id"])
        assert bytes(r["ids"]) == b"".join(b for _, b in parts)


def test_pack_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, WORD_BPE).count() == 0


def test_tokens_of_words_are_tokens_of_texts():
    rng = random.Random(5)
    tokenizer = Tokenizer.from_file(WORD_BPE)
    with open(WORD_BPE, encoding="utf-8") as file:
        known = packing.Tokens(file.read())
    signs = ["a", "B", "ab", "À", "ÿ", "×", "÷", "ſ", "ŉ", "ǆ", "ª", "=", "\u0338", "<", "|", ",", "'", "'s", "'LL", "é", "é", "́", "İ", "Σ", "ß", "日", "0", "٣", "-", "<|endoftext|>", "<|", " ", "\n", "\t", "\x0b", "\x0c", "\x1c", " ", " ", "‍", "😀", "\x00"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(3000)]
    import pyarrow as pa

    ids, counts = packing.token_ids(pa.array(texts), known)
    ends = np.cumsum(counts)
    for text, end, n in zip(texts, ends, counts, strict=True):
        assert list(ids[end - n : end]) == [*tokenizer.encode(text, add_special_tokens=False).ids, 1], repr(text)


def test_tokenizer_that_keeps_space_is_refused(spark):
    with pytest.raises(ValueError, match="not the tokenizer"):
        packing.pieces(spark.createDataFrame([(1, "a")], "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"))


def laid_out(slots, counts):
    """(sequence, offset, length) of all pieces by the slots."""
    rows = []
    for x in range(len(counts)):
        own = slots[slots[:, 0] == x]
        for nth in range(int(counts[x])):
            _, first, copies, sequence, offset = own[np.searchsorted(own[:, 1], nth, "right") - 1]
            rows.append({"sequence_id": int(sequence + (nth - first) // copies), "offset": int(offset + (nth - first) % copies * x), "length": x})
    return rows


def best_fit_decreasing(lengths, size):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = [i for i, room in enumerate(rooms) if room >= x]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= x
        else:
            rooms.append(size - x)
    return len(rooms)


@pytest.mark.parametrize("seed", range(30))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(1, 200))
    counts = np.zeros(size + 1, np.int64)
    for _ in range(int(rng.integers(1, 40))):
        counts[int(rng.integers(1, size + 1))] += int(rng.integers(0, 12))
    lengths = np.repeat(np.arange(size + 1), counts)
    n = check_packed(laid_out(packing.plan(counts), counts), size)
    plain = best_fit_decreasing(lengths, size)
    assert -(-int(lengths.sum()) // size) <= n <= plain + 1 + plain // 30


@pytest.mark.parametrize("seed", range(20))
def test_index_of_sums(seed):
    rng = np.random.default_rng(seed)
    left = rng.integers(0, 2, 60).astype(np.int64)
    left[0] = 0
    index = packing.Complements(left)
    for x in rng.permutation(np.flatnonzero(left)):
        left[x] = 0
        index.gone(x)
        fresh = packing.Complements(left.copy())
        assert (index.two == fresh.two).all() and (index.three == fresh.three).all()
        gap = int(rng.integers(1, 60))
        there = [int(v) for v in np.flatnonzero(left)]
        can = any(a == gap or any(a + b == gap and a < b or any(a + b + c == gap and a < b < c for c in there) for b in there) for a in there)
        fill = index.fill(gap, {})
        assert (fill is not None) == can and (fill is None or sum(fill) == gap and len(set(fill)) == len(fill))


def test_plan_grows_with_lengths_not_rows():
    counts = np.zeros(4097, np.int64)
    counts[1:] = np.random.default_rng(1).integers(1, 1000, 4096)
    small, large = packing.plan(counts), packing.plan(counts * 1_000_000)
    assert len(large) < 3 * len(small) < 100_000


# periodic runs


def plain_runs(w, least=12):
    """All runs by looking along every diagonal, the smallest period first."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i >= max(q, least - q) and not any(s <= i and s + size >= j + q for s, size, _ in out):
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(w, runs):
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def random_words(rng):
    kind, n = rng.randrange(7), rng.randrange(150)
    if kind == 0:
        return [str(rng.randrange(rng.choice([1, 2, 3]))) for _ in range(n)]
    if kind == 1:
        return list(fibonacci(n + 1))
    if kind == 2:
        return list(thue_morse(n + 1))
    if kind == 3:
        return ([rng.choice("ab") for _ in range(rng.randrange(1, 30))] * 20)[:n]
    if kind == 4:
        return list("ab" * rng.randrange(30) + "ba" * rng.randrange(30) + "a" * rng.randrange(3) + "ab" * rng.randrange(30))
    words = []
    while len(words) < n:
        words += [rng.choice("ab") for _ in range(rng.randrange(1, 12))] * rng.randrange(1, 6)
    return words


@pytest.mark.parametrize("seed", range(20))
def test_runs_random(seed):
    rng = random.Random(seed)
    rows = [random_words(rng) for _ in range(40)] + [[]] * 200
    rng.shuffle(rows)
    number = {}
    codes = np.array([number.setdefault(x, len(number)) for w in rows for x in w], np.int64)
    offsets = np.concatenate(([0], np.cumsum([len(w) for w in rows])))
    want = [(s + int(o), n, q) for o, w in zip(offsets, rows, strict=False) for s, n, q in plain_runs(w)]
    assert [tuple(map(int, r)) for r in periodic.find_runs(codes, offsets).T] == want


@pytest.mark.parametrize("least", [2, 4, 7, 12, 30])
def test_runs_of_other_least_lengths(least):
    rng = random.Random(least)
    for _ in range(60):
        w = random_words(rng)
        codes = np.array([ord(x) for x in w], np.int64)
        got = periodic.find_runs(codes, np.array([0, len(w)]), least)
        assert [tuple(map(int, r)) for r in got.T] == plain_runs(w, least)


def test_runs_of_one_word():
    codes = np.zeros(200_000, np.int64)
    assert periodic.find_runs(codes, np.array([0, 200_000])).T.tolist() == [[0, 200_000, 1]]


def test_find_periodic_edges(edge):
    rows = periodic.find_periodic(edge).select("doc_id", "n_words", "runs", "collapsed", "seed", "k0", periodic.longest(F.col("runs")).alias("best"))
    want = []
    for i, t in EDGE:
        if i == 4:
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = [(0, 10_000, 2)] if i == 10 else plain_runs(w)
        want.append((i, len(w), runs, plain_collapsed(w, runs)))
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in rows.collect() if r["doc_id"] != 4]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r["seed"] for r in rows.collect()} == {"own"}
    four = rows.filter("doc_id = 4").first()
    assert four["best"]["period"] == 977 and four["best"]["length"] == 30_000  # i * i mod 977 repeats
    assert rows.filter("doc_id = 3").first()["best"].asDict() == {"start": None, "length": None, "period": None}


def test_looped_words(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(200)))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    got = {r["doc_id"]: r for r in periodic.find_periodic(df, ["doc_id"], loop_seed=seed).collect()}
    for i, t in rows:
        w, h = t.split(), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if j < a else w[a + (j - a) % p] for j, x in enumerate(w)]
        runs = plain_runs(w)
        assert [tuple(x) for x in got[i]["runs"]] == runs and got[i]["collapsed"] == plain_collapsed(w, runs)


def test_written_runs(spark):
    df = spark.createDataFrame([([(0, 12, 1), (3, 20, 4)],), ([],)], "runs array<struct<start: long, length: long, period: long>>")
    assert [r[0] for r in df.select(periodic.written(F.col("runs"))).collect()] == ["0,12,1\n3,20,4\n", ""]
    best = df.select(periodic.longest(F.col("runs")).alias("b")).first()["b"]
    assert json.dumps(best.asDict()) == '{"start": 3, "length": 20, "period": 4}'


# the tables of a benchmark


def test_benchmark_tables_stay_small():
    import tracemalloc

    import pyarrow as pa

    from bookmark_lake.llm.wu_manber import Benchmark

    rng = random.Random(2)
    words = [f"w{i:05d}" for i in range(50_000)]
    texts = [" ".join(rng.choices(words, k=200)) for _ in range(2000)] + ["a b", None, ""]
    items = pa.table({"item_id": [str(i) for i in range(len(texts))], "text": texts})
    size = sum(len(t or "") for t in texts)
    tracemalloc.start()
    tables = Benchmark(items, 10)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 12 * size and peak < 40 * size, (held / size, peak / size)
    assert [p.length for p in tables.patterns] == [2, 10]


def test_windows_shared_by_items(spark):
    from bookmark_lake.llm.wu_manber import find_benchmark

    item = " ".join(f"w{i}" for i in range(14))
    bench = spark.createDataFrame([("a", item), ("b", f"x {item}"), ("a", item), (None, "w3 w4"), ("c", "W3! w4?")], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"before {item}, after"), (2, "w3 w5 w4"), (3, "W3-W4")], "doc_id long, text string")
    for block_bytes in (1 << 20, 16):
        found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in find_benchmark(docs, bench, block_bytes=block_bytes).collect()}
        assert found == {1: (16, 14, ["a", "b", "c", None]), 2: (3, 0, []), 3: (2, 2, ["c", None])}
