"""The stored index: segments, blocks of postings, bits, spelling variants and thresholds."""

import random

import pytest
from pyspark.sql import functions as F

from bookmark_lake.operators import search as S
from bookmark_lake.operators.generations import current
from bookmark_lake.operators.index import (
    BUCKETS,
    PREFIX,
    _deletions,
    index_of,
    read_index,
    spellings,
    update_index,
    write_index,
)
from bookmark_lake.operators.search import best_hits, count_hits, edit_distance, expand_fuzzy, matching, score_hits, search

WORDS = "spark sprak park fast engine query index big data lake table scan sort merge join key value".split()
SCHEMA = "url string, name string, content string, pocket_tags array<string>"


def random_items(seed, n, name="u"):
    rng = random.Random(seed)
    text = lambda most: " ".join(rng.choices(WORDS, weights=range(len(WORDS), 0, -1), k=rng.randrange(most)))
    return [(f"{name}{i:04d}", text(4), text(40) or None, rng.sample(WORDS, rng.randrange(3)) or None) for i in range(n)]


@pytest.fixture(scope="module")
def index(spark):
    return index_of(spark.createDataFrame(random_items(1, 900), SCHEMA).repartition(3))


QUERIES = [["spark"], ["spark fast", "key"], ["sprak~"], ["(spark AND fast) OR value -park"], ["+data -lake", "joyn~1"], ["nothing"], ["value"]]


@pytest.mark.parametrize("terms", QUERIES)
@pytest.mark.parametrize("size", [1, 7, 2000])
def test_best_hits_are_the_first_of_all(index, monkeypatch, terms, size):
    """However few blocks are scored first, and however few are listed."""
    key = lambda r: (-r["score"], r["url"])
    want = [tuple(r) for r in sorted(score_hits(index, terms).collect(), key=key)]
    for ahead, listed in ((4, 4096), (1, 4096), (1, 2)):
        monkeypatch.setattr(S, "HITS_AHEAD", ahead)
        monkeypatch.setattr(S, "LISTED", listed)
        got = [tuple(r) for r in sorted(best_hits(index, terms, size=size).collect(), key=key)]
        assert got == want[:size]
    assert count_hits(index, terms).first()[0] == len(want)
    assert sorted(r["url"] for r in matching(index, terms).collect()) == sorted(u for u, _ in want)
    assert {r["total_hits"] for r in search(index, terms, size=size).collect()} == ({len(want)} if want else set())


def test_a_threshold_leaves_blocks_out(index):
    """A word in a few names is worth more than the same in a long text."""
    query = S.Query(index, ["value"])
    heads = {r["block"]: r for r in query.heads().collect()}
    exact = {}
    for r in query.scores(query.hits()).collect():
        exact[r["doc"] >> 6] = max(exact.get(r["doc"] >> 6, 0), r["score"])
    assert exact.keys() == heads.keys()
    assert all(score <= heads[b]["most"] + 1e-6 for b, score in exact.items())
    best = sorted(r["score"] for r in query.scores(query.hits()).collect())[-1]
    assert sum(h["most"] >= best for h in heads.values()) < len(heads)


def test_counts_read_no_scores(index):
    plan = count_hits(index, ["spark fast", "key"])._jdf.queryExecution().executedPlan().toString()
    read = [line.split("ReadSchema:")[1] for line in plan.splitlines() if "ReadSchema:" in line]
    assert read and all("bits" in r and "entries" not in r and "part" not in r for r in read)


def scanned(index, term, limit):
    near = index.terms.select("term").distinct().withColumn("distance", edit_distance(F.col("term"), term, limit))
    return {(r["term"], r["distance"]) for r in near.filter("distance is not null").collect()}


@pytest.mark.parametrize("limit", [0, 1, 2])
def test_variants_find_what_a_scan_finds(spark, limit):
    rng = random.Random(limit)
    letters = ["a", "b", "é", "😀"]
    vocabulary = sorted({"".join(rng.choices(letters[:3], k=rng.randrange(1, 10))) for _ in range(1500)} | {"a", "ab", "ba", "abc"})
    index = index_of(spark.createDataFrame([("u", " ".join(vocabulary))], "url string, content string"))
    assert index.terms.count() == len(vocabulary) + 1  # and the URL's word
    for term in ["a", "ab", "abab", "babéab", "aaaaaaaaa", "ébabaabb", "zzz"]:
        found = {(r["term"], r["distance"]) for r in expand_fuzzy(index, term, limit).collect()}
        assert found == scanned(index, term, limit)


def test_spellings_agree(spark):
    words = ["", "a", "ab", "abcdef", "abcdefgh", "aaaaaaa", "é😀b"]
    df = spark.createDataFrame([(w,) for w in words], "term string")
    for r in df.select("term", _deletions("term").alias("v")).collect():
        assert sorted(r["v"]) == spellings(r["term"], 2)
    assert len(spellings("abcdefgh", 2)) == 1 + PREFIX + PREFIX * (PREFIX - 1) // 2


def test_fuzzy_words_read_buckets_only(index):
    files = expand_fuzzy(index, "sprak").inputFiles()
    folders = {f.rsplit("/", 2)[1] for f in files}
    assert files and all("/variants/" in f for f in files)
    assert folders <= {f"bucket={s % BUCKETS}" for s in spellings("sprak", 2)}


def test_update_equals_rebuild(spark, tmp_path):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    items = {r[0]: r for r in random_items(2, 400)}
    frame = lambda rows: spark.createDataFrame(list(rows), SCHEMA).repartition(2)
    write_index(frame(items.values()), old)
    for turn in range(2):
        changed = {r[0]: r for r in random_items(10 + turn, 20)} | {r[0]: r for r in random_items(20 + turn, 5, f"new{turn}")}
        changed[f"u{300 + turn:04d}"] = (f"u{300 + turn:04d}", "longer " * 50 + "spark", "spark " * 90, None)
        gone = [f"u{i:04d}" for i in range(50 * turn + 30, 50 * turn + 40)]
        update_index(frame(changed.values()), old, removed=spark.createDataFrame([(u,) for u in gone], "url string"))
        items = {u: r for u, r in (items | changed).items() if u not in gone or u in changed}
    write_index(frame(items.values()), new)
    one, two = read_index(spark, old), read_index(spark, new)
    assert len(one.folders) == 3 and len(two.folders) == 1
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(one.terms.select("term", "field", "df")) == rows(two.terms.select("term", "field", "df"))
    assert rows(one.postings) == rows(two.postings)
    for terms in QUERIES + [["longer"], ["u0301"]]:
        assert rows(score_hits(one, terms)) == rows(score_hits(two, terms))
        assert rows(search(one, terms, size=5)) == rows(search(two, terms, size=5))
        assert rows(count_hits(one, terms)) == rows(count_hits(two, terms))
    # only the changed items are tokenised: the last segment holds no others
    assert one.read("forward", folders=one.folders[-1:]).count() == 26


def test_missing_index_is_named(spark, tmp_path):
    with pytest.raises(ValueError, match="nowhere"):
        read_index(spark, str(tmp_path / "nowhere"))


def test_side_by_side_refreshes(spark, tmp_path, monkeypatch):
    """Of two refreshes neither of which sees the other, the later one holds."""
    path = str(tmp_path)
    write_index(spark.createDataFrame([("u1", "one")], "url string, name string"), path)
    monkeypatch.setattr("bookmark_lake.operators.index.current", lambda *_: [])
    write_index(spark.createDataFrame([("u2", "two")], "url string, name string"), path)
    monkeypatch.undo()
    assert len(current(spark, path)) == 2
    assert [r["url"] for r in score_hits(read_index(spark, path), ["two"]).collect()] == ["u2"]
    assert score_hits(read_index(spark, path), ["one"]).count() == 0
