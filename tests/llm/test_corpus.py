"""The corpus operators against SQL, brute force, round trips and held-out labels."""

import hashlib
import os
import random
import re
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

corpus = pytest.importorskip("bookmark_lake.llm.checks")
from bookmark_lake.llm import (  # noqa: E402
    bloom_cascade,
    jaccard_join,
    language,
    lempel_ziv,
    merkle,
    pieces,
    quality,
    secrets,
    suffix_array,
    wu_manber,
)

SF = "/root/testdata"
given = pytest.mark.skipif(not os.path.isdir(f"{SF}/sf0.001"), reason="needs the driver's tables")
WORD = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
#: Null, empty, tiny and long texts, a repeated row, equal texts, and a missing key.
EDGE = [
    (1, None),
    (2, ""),
    (3, "x"),
    (4, " ".join(WORD[i * i % 12] + str(i) for i in range(30_000))),
    (5, "one two three four five six seven. Eight\n\nnine"),
    (6, "one two three four five six seven. Eight\n\nnine"),
    (6, "one two three four five six seven. Eight\n\nnine"),
    (7, " \t\n "),
    (8, "a" * 300_000),
    (None, "é日本 ▁ 😀 plain words"),
]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if extra:  # names that operators use themselves
        for c in ("score", "spans", "kept", "n_words", "Host", "ids", "n_pieces", "lang_pred", "row_key", "k0"):
            df = df.withColumn(c, F.lit("own"))
    return df


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def random_text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@given
@pytest.mark.parametrize("name", sorted(corpus.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/sf0.001/{t}.parquet')")
    df = corpus.QUERIES[name](spark, f"{SF}/sf0.001")
    columns = sorted(df.columns)
    result = con.execute(corpus.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    assert rows_of(df, *columns) == sorted(want, key=repr)


def test_every_operator_has_a_query():
    assert [sum(q.startswith(f"op{n}_") for q in corpus.QUERIES) for n in range(1, 14)] == [1] * 13


# op3


def test_cascade_is_exact(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.filter("key rlike '7$'")
    cascade = bloom_cascade.Cascade(listed, keys, 20_000)
    assert len(cascade.levels) > 1
    wrong = keys.filter(cascade.contains(F.col("key")) != F.col("key").rlike("7$"))
    assert wrong.count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "https://a.NET/x", "http://net", "http://net/", "http://m.example.net/en/1?q#f",
            "http://example.net/fr/", "http://xnet/", "http://a.org/fr/", "http://.net/", "ftp://a.b.example.com/de/"]
    rules = spark.createDataFrame(corpus._RULES, "host string, path string, action string")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("Rule", F.lit("own"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in bloom_cascade.judge_urls(pages, rules).collect()}
    for i, url in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, a) for h, p, a in corpus._RULES if f".{host}".endswith(f".{h}") and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        assert got[i] == (host, path, *best[1:])
    assert bloom_cascade.judge_urls(pages.limit(0), rules).count() == 0
    none = bloom_cascade.judge_urls(pages, rules.limit(0))
    assert {(r["rule"], r["verdict"]) for r in none.collect()} == {(None, "allow")}


# op5


def shingles(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(own[i : i + 5]) for i in range(max(len(own) - 4, 1))} if own else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                label[max(top(i), top(j))] = min(top(i), top(j))
    return [(rows[i][0], len(sets[i]), rows[top(i)][0]) for i in range(len(rows))]


def test_jaccard_components(spark):
    rng = random.Random(4)
    texts = []
    for size in (2, 5, 6, 7, 8, 9, 10, 12, 14, 20, 40, 80, 200):
        base = random_text(rng, size)
        for _ in range(14):  # near copies of near copies, so that some link only through others
            own = (texts[-1] if texts and rng.random() < 0.5 else base).split()
            for _ in range(rng.randrange(4)):
                own.insert(rng.randrange(len(own) + 1), f"x{rng.randrange(900)}")
            texts.append(" ".join(own))
    shared = random_text(rng, 60)
    texts += [f"{shared} {random_text(rng, 60)}" for _ in range(30)]  # a passage in many, no links
    texts += ["", None, " ", *texts[:5]]
    rows = list(enumerate(texts))
    got = jaccard_join.jaccard_components(frame(spark, rows))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == sorted(brute_components(rows), key=repr)


def test_boundary_follows_cost():
    rule = jaccard_join.Rule()
    assert jaccard_join.choose_boundary({}, rule) == 1
    assert 3 <= jaccard_join.choose_boundary({n: 100 for n in range(1, 17)}, rule) <= 12
    for n in range(1, 17):  # the subsets' size is exact
        for small, large, shared in jaccard_join.subset_sizes(n, 16, rule):
            assert 100 * shared >= 75 * (small + large - shared)
            assert 100 * (shared - 1) < 75 * (small + large - shared + 1)


def test_jaccard_edges(spark):
    got = rows_of(jaccard_join.jaccard_components(frame(spark, EDGE)), "doc_id", "n_shingles", "component_id")
    assert (1, 0, 1) in got and (2, 0, 2) in got and (7, 0, 7) in got
    assert (5, 5, 5) in got and got.count((6, 5, 5)) == 2 and len(got) == len(EDGE)
    assert jaccard_join.jaccard_components(frame(spark, [])).count() == 0
    kept = jaccard_join.keep_one(frame(spark, EDGE))
    assert sorted(r["doc_id"] or 0 for r in kept.select("doc_id").collect()) == [0, 1, 2, 3, 4, 5, 7, 8]


# op7, op8


def brute_bytes(rows, size):
    data = [(t or "").encode() for _, t in rows]
    seen = {}
    for r, d in enumerate(data):
        for i in range(len(d) - size + 1):
            seen.setdefault(d[i : i + size], []).append((r, i))
    gone = [bytearray(len(d)) for d in data]
    for places in seen.values():
        if len(places) > 1:
            for r, i in places:
                gone[r][i : i + size] = b"\1" * size
    out = []
    for (doc, _), d, g in zip(rows, data, gone, strict=True):
        spans = len(re.findall(rb"\x01+", bytes(g)))
        out.append((doc, len(d), sum(g), spans, bytes(c for c, x in zip(d, g, strict=True) if not x)))
    return out


def test_repeated_bytes(spark):
    rng = random.Random(5)
    parts = ["".join(rng.choice("abé ") for _ in range(rng.randrange(50, 260))) for _ in range(12)]
    texts = ["".join(rng.choice(parts)[rng.randrange(30) :] for _ in range(rng.randrange(6))) for _ in range(60)]
    texts += ["ab" * 300, "a" * 500, "b" * 79, "c" * 80, "c" * 81, "", None, texts[0], texts[0]]
    rows = list(enumerate(texts))
    got = suffix_array.remove_repeats(frame(spark, rows), size=80)
    got = [(*t[:4], bytes(t[4])) for t in rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept")]
    assert got == sorted(brute_bytes(rows, 80), key=repr)


def test_key_of_many_texts(spark):
    rng = random.Random(13)
    own = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    short, long = own(60), own(90)  # shorter and longer than a string
    rows = [(i, f"{own(90)}{short}{own(90)}{long if i % 3 else ''}{own(40)}") for i in range(60)]
    rows += [(100, rows[0][1]), (101, None), (102, "a" * 200)]
    docs = frame(spark, rows).repartition(20)
    got = suffix_array.remove_repeats(docs, size=80, group_rows=10)
    got = [(*t[:4], bytes(t[4])) for t in rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept")]
    assert got == sorted(brute_bytes(rows, 80), key=repr)
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), "text")
    largest = []
    for most in (10, 10**6):
        blocks = [bytes(r["block"]) for r in suffix_array._groups(texts, 80, most).collect()]
        key = suffix_array._read(suffix_array.pa.table({"block": suffix_array.pa.array(blocks, "binary")}))[1][0]
        largest.append(suffix_array.np.unique(key, return_counts=True)[1].max(initial=0))
    assert largest[0] <= 10 < largest[1]


def brute_words(rows, size):
    own = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    seen, out = set(), []
    for d in sorted(own):
        gone = set()
        for i in range(len(own[d]) - size + 1):
            w = tuple(own[d][i : i + size])
            if w in seen:
                gone |= set(range(i, i + size))
            seen.add(w)
        out.append((d, len(own[d]), len(gone), " ".join(w for i, w in enumerate(own[d]) if i not in gone)))
    return out


@pytest.mark.parametrize("size", [4, 20])
def test_repeated_words(spark, size):
    rng = random.Random(6)
    parts = [random_text(rng, rng.randrange(3, 50), 90) for _ in range(14)]
    texts = [" \n".join(rng.choice(parts) for _ in range(rng.randrange(5))) for _ in range(80)]
    texts += ["w " * 70, "", None, "only", texts[3]]
    rows = list(enumerate(texts))
    got = lempel_ziv.remove_factors(frame(spark, rows), size=size)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept") == sorted(brute_words(rows, size), key=repr)


def test_hot_anchors(spark):
    rng = random.Random(12)
    phrase, long = random_text(rng, 9), random_text(rng, 25)
    rows = [(i, f"{random_text(rng, 30)} {phrase} {random_text(rng, 30)} {long if i % 7 == 0 else ''}") for i in range(70)]
    np, plain = lempel_ziv.np, lempel_ziv.factors(frame(spark, rows), size=20)
    found = lempel_ziv.factors(frame(spark, rows), size=20, hot=12)
    gone = lambda df: sorted({(r["doc_id"], r["start"] + i) for r in df.collect() for i in range(r["size"])})
    assert gone(found) == gone(plain) and len(gone(found)) >= 9 * 25
    n = 1000  # windows of one anchor and different texts go to many shards
    part = np.arange(n), np.arange(n), np.zeros(n, np.int32), lempel_ziv.mix(np.arange(n, dtype=np.uint64)), np.full(n, 7 << 40, np.uint64), np.arange(n)
    dealt = [{s for s, _ in lempel_ziv._portion([part], 16, 20, hot)} for hot in ((), part[4][:1])]
    assert len(dealt[0]) == 1 and len(dealt[1]) == 16


def test_windows_of_one_anchor_are_told_apart():
    np, pa = lempel_ziv.np, lempel_ziv.pa
    blocks = []
    for doc, whole in ((1, 5), (2, 5 | 1 << 50), (3, 5)):  # the first two agree in 40 bits
        one = [np.array([x], t) for x, t in ((doc, np.int64), (0, np.int64), (0, np.int32), (whole, np.uint64), (9, np.uint64), (0, np.int64))]
        blocks += [b for _, b in lempel_ziv._portion([one], 1, 20)]
    found = lempel_ziv._factor_block(pa.table({"block": pa.array(blocks, pa.binary())}), 20)
    assert found.column("doc_id").to_pylist() == [3]


def test_factor_sources(spark):
    rows = [(1, "a b c d e f"), (2, "x a b c d e y")]
    assert rows_of(lempel_ziv.factors(frame(spark, rows), size=3), "doc_id", "start", "size", "source_doc", "source_start")[0][:2] == (2, 1)


def test_dedup_edges(spark):
    left = suffix_array.remove_repeats(frame(spark, EDGE))
    got = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in left.collect()}
    assert got[1, 0] == 0 and got[8, 300_000] == 300_000 and left.count() == len(EDGE)
    left = lempel_ziv.remove_factors(frame(spark, EDGE))
    assert left.count() == len(EDGE) and all(r["n_removed"] == 0 for r in left.filter("doc_id = 6").collect())
    for operator in (suffix_array.remove_repeats, lempel_ziv.remove_factors):
        assert operator(frame(spark, [])).count() == 0


def test_rows_without_or_with_repeated_ids(spark):
    rng = random.Random(16)
    a, b, c = (random_text(rng, 30) for _ in range(3))
    rows = [(1, a), (None, a), (None, b), (None, None), (2, b + " x"), (2, c), (2, c), (3, f"{c} {c}"), (None, b)]
    left = rows_of(lempel_ziv.remove_factors(frame(spark, rows)), "doc_id", "n_words", "n_removed", "kept")
    assert left.count((2, 30, 0, c)) == 2  # other texts of one doc_id copy nothing
    assert (1, 30, 0, a) in left and (None, 30, 30, "") in left and (3, 60, 60, "") in left
    by_id = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    seen = set()
    for i, t in dict.fromkeys(by_id):  # equal rows count once; no two here of one doc_id share words
        own = set(zip(*((t or "").split()[k:] for k in range(20)), strict=False))
        removed = {r[2] for r in left if r[0] == i and r[1] == len((t or "").split())}
        assert (0 in removed) == (not own & seen) or i is None
        seen |= own


def test_one_of_each_group_stays_whatever_the_ids(spark):
    rng = random.Random(18)
    a, b, c, d = (random_text(rng, 40) for _ in range(4))
    rows = [(1, a), (1, b), (2, a + " end"), (None, b), (None, c), (None, c), (None, d + " x"), (5, d), (5, d), (6, None), (6, None), (7, "")]
    kept = sorted((tuple(r) for r in jaccard_join.keep_one(frame(spark, rows)).select("doc_id", "text").collect()), key=repr)
    assert kept == sorted([(1, a), (1, b), (None, c), (5, d), (6, None), (6, None), (7, "")], key=repr)


def test_stored_tables_go(spark, tmp_path, monkeypatch):
    from bookmark_lake.llm import arrays

    monkeypatch.setattr(arrays, "work_folder", lambda _, label: str(tmp_path / f"{label}-{uuid.uuid4().hex}"))
    left = lambda: sorted(p.name.split("-")[0] for p in tmp_path.iterdir())
    with arrays.only(spark) as keep:
        arrays.stored(spark.range(3), "inner")
        with arrays.only(spark) as inner:
            arrays.stored(spark.range(3), "deep")
            two = inner(arrays.stored(spark.range(4), "result"))
        keep(two)
    assert left() == ["result"] and two.count() == 4
    rng = random.Random(19)
    rows = [(i, random_text(rng, 40) if i % 3 else "the same words in every third text of all") for i in range(60)]
    assert jaccard_join.keep_one(frame(spark, rows)).count() == 41
    assert left() == ["jaccard_doubt", "result"]


# op9


def test_fingerprints(spark):
    sentences = [(10, ". ".join(f"sentence number {i}" for i in range(40)))]
    found = merkle.fingerprint_edits(frame(spark, EDGE + sentences)).collect()
    rows = {(r["doc_id"], r["n_chars"]): r for r in found}
    assert len(found) == len(EDGE) + 1 and all(0 <= r["near_edited"] <= 1 for r in found)
    n = len(EDGE[4][1])
    assert rows[5, n].fingerprint == rows[6, n].fingerprint and rows[5, n].near_next == 1
    assert rows[1, 0].fingerprint == rows[2, 0].fingerprint
    assert 0.4 < rows[10, len(sentences[0][1])].near_edited < 0.6
    assert merkle.fingerprint_edits(frame(spark, [])).count() == 0


def test_edits_are_located(spark):
    texts = [(1, "one\ntwo\n\nthree\nfour", "one\ntwo\n\nthree\nFOUR"), (2, "a", "a"), (3, "a\nb", "b\na"), (4, "a\nb", "a\nnew\nb")]
    texts += [(5, "a\nb\nc", "a\nc"), (6, "a\n\nb", "a\nb")]
    df = spark.createDataFrame(texts, "i int, a string, b string")
    for c in ("a", "b"):
        df = df.withColumn(c, merkle.tree(F.col(c)))
    df = df.select("i", *(merkle.fingerprint(F.col(c)).alias(c) for c in ("a", "b")))
    got = {r["i"]: [tuple(e) for e in r["e"]] for r in df.select("i", merkle.edits(F.col("a"), F.col("b")).alias("e")).collect()}
    assert got == {
        1: [("a", 1, 1, "changed"), ("b", 1, 1, "changed")],
        2: [],
        3: [("a", 0, 0, "moved"), ("a", 0, 1, "moved"), ("b", 0, 0, "moved"), ("b", 0, 1, "moved")],
        4: [("b", 0, 1, "inserted")],
        5: [("a", 0, 1, "deleted")],
        6: [("a", 1, 0, "moved"), ("b", 0, 1, "moved")],
    }


def brute_edits(a, b):
    """The documented alignment over the paragraphs of two texts, without digests."""

    def sections(text):
        return [s.split("\n") for s in text.split("\n\n")]

    def trimmed(x, y):
        front = 0
        while front < min(len(x), len(y)) and x[front] == y[front]:
            front += 1
        back = 0
        while back < min(len(x), len(y)) - front and x[-1 - back] == y[-1 - back]:
            back += 1
        return front, len(x) - back, len(y) - back

    one, two = sections(a), sections(b)
    front, *ends = trimmed(one, two)
    rows = [
        [(i, j, p, j == 0) for i in range(front, end) for j, p in enumerate(own[i])] for own, end in zip((one, two), ends, strict=True)
    ]
    front, *ends = trimmed(*([r[2:] for r in own] for own in rows))
    rest = [own[front:end] for own, end in zip(rows, ends, strict=True)]
    out = []
    for side, own, other, gone in (("a", rest[0], rest[1], "deleted"), ("b", rest[1], rest[0], "inserted")):
        known = {r[2] for r in other}
        out += [(side, r[0], r[1], "moved" if r[2] in known else "changed" if i < len(other) else gone) for i, r in enumerate(own)]
    return out


def test_different_texts_have_edits(spark):
    rng = random.Random(17)
    text = lambda: "".join(rng.choice(["a", "b", "c. d", "\n", "\n\n"]) for _ in range(rng.randrange(12)))
    pairs = [(i, text(), text()) for i in range(600)] + [(600, "", ""), (601, "x" * 9, "x" * 9)]
    df = spark.createDataFrame(pairs, "i int, a string, b string")
    trees = df.select("i", *(merkle.tree(F.col(c)).alias(c) for c in ("a", "b")))
    prints = trees.select("i", *(merkle.fingerprint(F.col(c)).alias(c) for c in ("a", "b")))
    got = {r["i"]: [tuple(e) for e in r["e"]] for r in prints.select("i", merkle.edits(F.col("a"), F.col("b")).alias("e")).collect()}
    for i, a, b in pairs:
        assert got[i] == brute_edits(a, b) and bool(got[i]) == (a != b), (a, b)


def test_next_document(spark):
    rng = random.Random(7)
    ids = rng.sample(range(-10_000, 10_000), 500)
    df = frame(spark, [(i, f"t{i}") for i in ids], extra=False)
    got = dict(rows_of(merkle.with_next(df, 40), "text", "next_value"))
    ids.sort()
    assert got == {f"t{a}": f"t{b}" for a, b in zip(ids, ids[1:] + ids[:1], strict=True)}


# op10


def brute_hits(text, items, length=10):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    fold = lambda t: re.findall(word, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, found = fold(text), set(), set()
    for item, t in items:
        w = fold(t)
        k = min(length, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(own) - k + 1 if k else 0):
            if tuple(own[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add(str(item))
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_benchmark(spark, block_bytes):
    rng = random.Random(8)
    items = [(i, random_text(rng, rng.choice([1, 2, 3, 9, 10, 11, 40]), 200)) for i in range(20)]
    items += [(90, None), (91, "?!"), (92, items[0][1]), (7, items[7][1])]
    docs = [random_text(rng, 300, 200).upper() + "," + " ".join(rng.choice(items)[1] or "" for _ in range(2)) for _ in range(30)]
    rows = [*enumerate(docs, 100), *EDGE]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = wu_manber.find_benchmark(frame(spark, rows), benchmark, block_bytes=block_bytes)
    want = [(d, *brute_hits(t, items)) for d, t in rows]
    assert rows_of(got, "doc_id", "n_words", "n_hit", "items") == sorted(want, key=repr)
    none = wu_manber.find_benchmark(frame(spark, rows), benchmark.limit(0))
    assert none.filter("n_hit > 0").count() == 0
    assert wu_manber.find_benchmark(frame(spark, []), benchmark).count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_benchmark_without_id(spark, block_bytes):
    rng = random.Random(14)
    texts = [random_text(rng, 20, 200) for _ in range(6)]
    items = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (5, texts[1]), (6, texts[2])], "item_id long, text string")
    rows = [(i, f"before {t} after") for i, t in enumerate([*texts, f"{texts[0]} {texts[1]}"])]
    got = wu_manber.find_benchmark(frame(spark, rows), items, block_bytes=block_bytes)
    got = got.select("doc_id", "n_hit", "items", wu_manber.items_digest("items").alias("digest"))
    found = {r["doc_id"]: (r["n_hit"], list(r["items"])) for r in got.collect()}
    none = (0, [])
    assert found == {0: (20, [None]), 1: (20, ["5", None]), 2: (20, ["6"]), 3: none, 4: none, 5: none, 6: (40, ["5", None])}
    want = {d: hashlib.sha256(",".join(i for i in x[1] if i).encode()).hexdigest() for d, x in found.items()}
    assert {r["doc_id"]: r["digest"] for r in got.collect()} == want


# op4


def secret_rows():
    rng = random.Random(9)
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f"{random_text(rng, 20)} token = \"{hexed(40)}\" and {random_text(rng, 20)}") for i in range(60)]
    rows += [(100 + i, random_text(rng, 60) + " averylongplainwordhere") for i in range(60)]
    rows += [(200, f"see {hexed(20)}Z{hexed(20)} there"), (201, "AKIA" + "Q" * 16), (202, "AKIA" + "Q" * 15), (203, "API_KEY: short")]
    rows += [(204, "é password='abc.def' PASSWD : xxxxxx"), (205, "token=secret=abcdefgh")]
    return rows


def test_patterns():
    assert secrets.base_spans("é PassWord = 'abcdef'") == [("assign", 2, 20)]
    assert secrets.base_spans("AKIA" + "Q" * 16) == [("access", 0, 20)]
    assert secrets.base_spans("0" * 24) == [("hex", 0, 24)] and not secrets.base_spans("0" * 23 + "A")
    assert secrets.base_spans("token=abc secret:abcdef") == [("assign", 10, 23)]


def test_secrets(spark):
    rows = secret_rows() + EDGE
    docs = frame(spark, rows)
    network = secrets.train(docs)
    found = secrets.scan(docs, network).withColumn("clean", secrets.redact(F.col("text"), F.col("spans")))
    for r in found.collect():
        spans = [tuple(s) for s in r["spans"]]
        assert [s for s in spans if s[0] != "model"] == secrets.base_spans(r["text"] or "")
        clean, end = "", 0
        for _, a, b in spans:
            clean += "" if a < end else r["text"][end:a] + "[SECRET]"
            end = max(end, b)
        assert r["clean"] == (None if r["text"] is None else clean + r["text"][end:])
        if r["doc_id"] is not None and 100 <= r["doc_id"] < 160:
            assert not spans
    again = secrets.train(docs.repartition(5))
    assert again.temperature == network.temperature and (again.threshold == network.threshold).all()
    assert secrets.train(frame(spark, EDGE[:3])) is None and secrets.train(frame(spark, [])) is None
    assert secrets.scan(frame(spark, []), None).count() == 0


def test_short_secrets(spark):
    rng = random.Random(10)
    value = lambda n: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789abcdefghijkmnopqrstuvwxyz") for _ in range(n))
    plain = lambda: " ".join(rng.choice(["running", "through", "meadows", "quietly", "the"]) + rng.choice(WORD) for _ in range(9))
    rows = [(i, f"{plain()} token={value(rng.randrange(6, 16))} {plain()}") for i in range(300)]
    keys = [value(n) for n in (8, 10, 12, 15) for _ in range(10)]
    network = secrets.train(frame(spark, rows))
    docs = frame(spark, [(i, f"{plain()} pwd: {k} {plain()}") for i, k in enumerate(keys)])
    measured = network.recall == network.recall
    assert measured.any() and (network.recall[measured] >= secrets.RECALL).all()
    got = {r["doc_id"]: {r["text"][a:b] for _, a, b in r["spans"]} for r in secrets.scan(docs, network).collect()}
    assert sum(k in got[i] for i, k in enumerate(keys)) >= 0.8 * len(keys)


def test_every_run_is_scored():
    data, offsets = secrets.text_bytes(secrets.pa.array(["pwd is QWERTYUI or 83629174", "hunter or abcde", None]))
    start, end, row = secrets._runs(data, offsets)
    assert [data[a:b].tobytes() for a, b in zip(start, end, strict=True)] == [b"QWERTYUI", b"83629174", b"hunter"]


def test_threshold_keeps_recall():
    rng = secrets.np.random.default_rng(1)
    windows = rng.integers(2, 97, (900, secrets.WIDTH)).astype(secrets.np.uint8)
    windows[:, secrets.BEFORE : secrets.BEFORE + 12] |= 128
    label = (rng.random(900) < 0.4).astype(int)  # labels that nothing tells: no value is sure
    network = secrets.Network(windows, label, secrets.np.full(900, 2), secrets.np.arange(900))
    assert network.recall[2] >= secrets.RECALL and network.threshold[2] < 0.9 and network.precision[2] < 0.6


def test_all_rows_are_trained_on(spark, monkeypatch):
    monkeypatch.setattr(secrets, "POSITIVES", 5)
    monkeypatch.setattr(secrets, "NEGATIVES", 10)
    monkeypatch.setattr(secrets, "SHARD_BYTES", 20_000)
    counted, started = [], []
    calibrate, mean = secrets.Network.calibrate, secrets._mean
    monkeypatch.setattr(secrets.Network, "calibrate", lambda self, *c: (counted.append(c), calibrate(self, *c))[1])
    monkeypatch.setattr(secrets, "_mean", lambda *a: (started.append(a[1]), mean(*a))[1])
    rows = secret_rows()
    docs = frame(spark, [*rows, *rows[:80]])  # copies
    network = secrets.train(docs)
    label, _, _, count = counted[0]
    aside = [r["text"] for r in docs.filter("pmod(xxhash64(text), 4) = 0").collect()]
    found = sum(len(secrets.base_spans(t)) for t in aside)
    assert count[label == 1].sum() == 2 * found > 2 * 5  # with and without what stands around them
    data, offsets = secrets.text_bytes(secrets.pa.array(aside))
    taken = secrets._base(secrets.pa.array(aside), data, offsets)[1]
    start, end, _ = secrets._runs(data, offsets)
    assert count[label == 0].sum() == secrets._free(start, end, taken, len(data)).sum() > 10
    assert any((a != b).any() for a, b in zip(network.w, started[0].w, strict=True))
    again = secrets.train(docs.repartition(7))
    assert all((a == b).all() for a, b in zip(network.w, again.w, strict=True))
    # further texts move the weights, though the first network takes but a few
    more = secrets.train(frame(spark, [*rows, *((900 + i, f"quietly password: zzzz.yyyy-{i}{i}{i} running") for i in range(8))]))
    assert any((a != b).any() for a, b in zip(network.w, more.w, strict=True))


def test_slope_is_that_of_the_loss():
    rng = secrets.np.random.default_rng(5)
    windows = rng.integers(2, 97, (40, secrets.WIDTH)).astype(secrets.np.uint8)
    size = rng.integers(6, 49, 40)
    at = secrets.np.arange(secrets.WIDTH) - secrets.BEFORE
    windows[(at >= 0) & (at < size[:, None])] |= 128
    bare = secrets.np.where(windows & 128, windows, 0).astype(secrets.np.uint8)
    label = secrets.np.arange(40) % 2
    network = secrets.Network(windows, label, secrets.np.full(40, 2), secrets.np.arange(40))
    weight = rng.random(40)
    for places, same in ((secrets._flat(windows), windows), (secrets._packed(bare), bare)):
        codes, first, start, end, stop = (*places, None)[:5]
        slope = network._slope(secrets._pairs(codes), first, start, end, stop, label, weight)
        patches = network._patches(same) @ network.w[1]
        logit = secrets.np.maximum(patches.max(axis=1) + network.w[2], 0) @ network.w[3] + network.w[4]
        assert secrets.np.allclose(network._logit_of(same), logit, atol=1e-4)
        for i in range(5):
            way = rng.normal(size=network.w[i].shape)
            loss = []
            kept = network.w[i]
            for sign in (1, -1):
                network.w[i] = kept + sign * 1e-6 * way
                x = secrets.np.maximum((network._patches(same) @ network.w[1]).max(axis=1) + network.w[2], 0) @ network.w[3] + network.w[4]
                loss.append((weight * (secrets.np.logaddexp(0, x) - label * x)).sum())
            network.w[i] = kept
            want = (loss[0] - loss[1]) / 2e-6
            assert abs((slope[i] * way).sum() - want) <= 0.02 * abs(want) + 0.02


def test_windows_ruled_out_are_not_filtered(monkeypatch):
    rng = secrets.np.random.default_rng(7)
    texts = ["".join(rng.choice(list("abcDEF019+/_.= \n:é"), size=n)) for n in (0, 5, 300, 7, 40_000)]
    data, offsets = secrets.text_bytes(secrets.pa.array([*texts, None, "quietly through meadows " * 400]))
    start, end, row = secrets._runs(data, offsets)
    codes, shift = secrets._coded(data, offsets)
    start, end = start + shift[row], end + shift[row]
    windows = rng.integers(2, 97, (60, secrets.WIDTH)).astype(secrets.np.uint8)
    windows[:, secrets.BEFORE : secrets.BEFORE + 9] |= 128
    network = secrets.Network(windows, secrets.np.arange(60) % 2, secrets.np.full(60, 2), secrets.np.arange(60))
    filtered = []
    logit = secrets.Network.logit
    monkeypatch.setattr(secrets.Network, "logit", lambda self, c, first, *a: (filtered.append(len(first)), logit(self, c, first, *a))[1])
    first, who = secrets._windows(start, end)
    bound = network._most(secrets._pairs(codes))[first // secrets.BLOCK]
    each = network.logit(codes, first, start[who], end[who])
    assert (bound >= each).all()
    share = network._share(network.best(codes, start, end))
    for limit in (0.0, *secrets.np.quantile(share, [0.5, 0.9, 0.999])):
        network.threshold = secrets.np.array([limit, max(limit, 0.6), 1.0])
        shape = rng.integers(0, 3, len(start))
        del filtered[:]
        got = network.secret(codes, start, end, lambda i: shape[i])  # noqa: B023
        assert got.tolist() == secrets.np.flatnonzero(share >= network.threshold[shape]).tolist()
    network.threshold[:] = network._share(secrets.np.sort(bound)[-3])
    del filtered[:]
    network.secret(codes, start, end, lambda i: shape[i])
    assert sum(filtered) < len(first) / 8  # before, all windows


# op6


def test_pieces_round_trip(spark):
    docs = frame(spark, EDGE)
    encoded = pieces.encode(docs, keep=["doc_id", "text", "score"])
    wrong = pieces.decode(encoded).filter("not (decoded <=> text)")
    assert wrong.count() == 0
    assert encoded.filter("text is null").first()["ids"] is None
    wrong = pieces.encode(docs, decoded=True).filter("not (decoded <=> text)")
    assert wrong.count() == 0
    again = pieces.encode(docs.repartition(1), keep=["doc_id"])
    assert rows_of(encoded, "doc_id", "ids") == rows_of(again, "doc_id", "ids")
    other = pieces.encode(docs, keep=["doc_id"], seed=1)
    assert rows_of(encoded, "doc_id", "ids") != rows_of(other, "doc_id", "ids")
    assert pieces.decode(pieces.encode(frame(spark, []))).count() == 0


def test_pieces_are_sampled_by_weight(spark):
    vocabulary = pieces.Vocabulary()
    known = {b: i for i, b in enumerate(vocabulary.bytes) if b and i not in set(vocabulary.byte_ids)}

    def split(b):
        if not b:
            yield ()
        for k in range(1, len(b) + 1):
            if b[:k] in known:
                yield from ((known[b[:k]], *rest) for rest in split(b[k:]))

    sharpness = 0.3
    weight = {}
    for ids in split(b" then"):
        w = 1.0
        for i in ids:
            w *= (i + 10.0) ** -sharpness
        weight[ids] = w
    n = 4000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("then").alias("text"))
    got = pieces.encode(docs, keep=["doc_id"], sharpness=sharpness).groupBy("ids").count().collect()
    got = {tuple(r["ids"]): r["count"] for r in got}
    assert set(got) <= set(weight)
    for ids, w in weight.items():
        p = w / sum(weight.values())
        assert abs(got.get(ids, 0) - n * p) < 5 * (n * p) ** 0.5 + 3


# op1, op2


def test_language_edges(spark):
    model = language.Model([])
    assert rows_of(language.identify(frame(spark, EDGE), model), "lang_pred", "score") == [("und", 0.0)] * len(EDGE)
    train = spark.createDataFrame([("a b c the cat", "en"), ("le chat noir", "fr"), (None, "en"), ("x", None)] * 5, "text string, lang string")
    model = language.train(train)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(frame(spark, EDGE), model).collect()}
    assert got[1] == got[2] == got[7] == ("und", 0.0) and got[3][0] in ("en", "fr")
    tests = frame(spark, [(1, "the cat"), (2, "le chat"), (3, "noire"), (4, "12 !? 😀"), (5, "日本")])
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(tests, model).collect()}
    assert (got[1], got[2], got[3], got[4]) == ("en", "fr", "fr", "und") and got[5] != "und"
    assert language.train(train.limit(0)).langs == []
    assert language.identify(frame(spark, []), model).count() == 0


def test_language_of_few_rows(spark, monkeypatch):
    monkeypatch.setattr(language, "WORDS", 60)
    monkeypatch.setattr(language, "GRAMS", 60)
    rng = random.Random(11)
    large, small = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)], [f"{a}{b}{c}" for a in "pq" for b in "rs" for c in "tuvw"]
    text = lambda own: " ".join(rng.choice(own) for _ in range(30))
    rows = [(text(large), "aa") for _ in range(990)] + [(text(small), "zz") for _ in range(10)]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))
    got = language.identify(frame(spark, [(i, text(small)) for i in range(20)]), model).collect()
    assert {r["lang_pred"] for r in got} == {"zz"}


@given
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/sf0.01/documents.parquet").select("doc_id", "lang")
    got = corpus.QUERIES["op2_language"](spark, f"{SF}/sf0.01").filter("held_out").join(docs, "doc_id")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


@given
def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/sf0.01/labels.parquet")
    got = corpus.QUERIES["op1_quality"](spark, f"{SF}/sf0.01").filter("held_out").join(labels, "doc_id").collect()
    assert sum(r["quality"] == r["predicted"] for r in got) > 0.97 * len(got)
    assert sum((r["quality"] - r["score"]) ** 2 for r in got) < 0.03 * len(got)


def test_quality_edges(spark):
    docs = frame(spark, EDGE)
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, 1), (None, 1), (6, None)], "doc_id long, quality int")
    scored = quality.classify(docs, quality.train(docs, labels)).collect()
    assert len(scored) == len(EDGE) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in scored)
    blind = quality.classify(docs, quality.train(docs, labels.limit(0))).collect()
    assert {(r["score"], r["predicted"]) for r in blind} == {(0.5, 1)}
    empty = frame(spark, [])
    assert quality.classify(empty, quality.train(empty, labels)).count() == 0


# the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(10)
    base = [random_text(rng, 60, 3000) for _ in range(40)]
    item = random_text(rng, 30, 3000)
    texts = base + [base[0], base[1] + " tail", f"{random_text(rng, 40)} {item} {random_text(rng, 40)}", None, "", "12 34 !"]
    texts += [f"{random_text(rng, 50, 3000)} token = '{hashlib.sha256(bytes([i])).hexdigest()}'" for i in range(12)]
    rows = [(i, t, rng.choice(["en", None, "fr"]), "s", len(t or ""), "own", "own") for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, score string"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = {r["doc_id"]: r for r in pieces.decode(out).collect()}
    readable = [(i, t) for i, t in enumerate(texts) if t and re.search(r"[a-z]", t)]
    group = {d: c for d, _, c in brute_components(readable)}
    want = {i: t for i, t in readable if group[i] == i and not brute_hits(t, [(1, item)])[1]}
    assert set(got) == set(want)
    for i, text in want.items():
        clean = re.sub(r"token = '[0-9a-f]{64}", "[SECRET]", text)
        assert got[i]["decoded"] == clean and got[i]["n_chars"] == len(clean) and got[i]["spans"] == "own"


@given
def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"{SF}/sf0.001")
        assert out.columns == docs.columns and out.count() == 0
