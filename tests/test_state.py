"""Logs, replays, compaction of crawl state, keyed display, and rules as a table."""

import random

import pytest
from pyspark.sql import functions as F

from bookmark_lake.operators import generations
from bookmark_lake.operators.frontier import frontier
from bookmark_lake.operators.generations import batch_folder, current, fold_log, put_in_force, remove_obsolete
from bookmark_lake.operators.merge import compact_items, read_items, upsert_items
from bookmark_lake.operators.present import present
from bookmark_lake.operators.route import DEFAULT_RULES, Output, Rule, add_rules, read_rules, route, route_by_table, rule_rows
from bookmark_lake.plans.ingest import compact_crawl, read_answered, read_frontier, store_requests
from bookmark_lake.schema import FRAGMENT, REQUEST
from bookmark_lake.streaming.ingest import stream_fragments, stream_frontier


def fragments_of(spark, rows):
    """(url, seq, name) → FRAGMENT."""
    full = [tuple(({f.name: None for f in FRAGMENT.fields} | {"url": u, "seq": s, "pos": 0, "name": n, "content": f"text {s}"}).values()) for u, s, n in rows]
    return spark.createDataFrame(full, FRAGMENT)


def requests_of(spark, rows):
    """(source, url, seq) → REQUEST."""
    return spark.createDataFrame([(s, "page", "GET", u, "", f"key {u}", {}, {}, n, 0) for s, u, n in rows], REQUEST)


def log_files(spark, path):
    return generations._files(spark, f"{path}/log")


@pytest.mark.parametrize("seed", range(4))
def test_folded_log_says_the_same(spark, tmp_path, seed):
    """Random changes, with folds among them, against a set."""
    rng, path = random.Random(seed), str(tmp_path)
    held, gone, number = set(), set(), 0
    for _ in range(18):
        add = [f"{path}/data/f{number + i}" for i in range(rng.randrange(1, 3))]
        number += len(add)
        remove = rng.sample(sorted(held), rng.randrange(min(3, len(held) + 1)))
        put_in_force(spark, path, add, remove)
        held = held - set(remove) | set(add)
        gone |= set(remove)
        if rng.random() < 0.4:
            fold_log(spark, path)
        assert current(spark, path) == sorted(held)
    for _ in range(2):
        fold_log(spark, path)
    assert current(spark, path) == sorted(held)
    assert len(log_files(spark, path)) <= 2
    assert not any(f.rsplit("/", 1)[1] in generations._states(generations._logged(spark, path)) for f in gone)


def test_a_long_log_folds_itself(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(generations, "LOG_FILES", 3)
    path = str(tmp_path)
    for i in range(30):
        put_in_force(spark, path, [f"{path}/data/f{i}"], [f"{path}/data/f{i - 1}"] if i else [])
        assert len(log_files(spark, path)) <= 8
    assert current(spark, path) == [f"{path}/data/f29"]


def test_a_write_beside_a_fold_stays(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    put_in_force(spark, path, [f"{path}/data/a"])
    put_in_force(spark, path, [f"{path}/data/b"], [f"{path}/data/a"])
    plain = generations._write_log
    beside = []

    def late(session, where, rows):
        if not beside:
            beside.append(1)
            put_in_force(spark, path, [f"{path}/data/c"])  # after the fold has read, before it writes
        plain(session, where, rows)

    monkeypatch.setattr(generations, "_write_log", late)
    fold_log(spark, path)
    monkeypatch.undo()
    for _ in range(3):
        assert current(spark, path) == [f"{path}/data/b", f"{path}/data/c"]
        fold_log(spark, path)


def test_a_replayed_batch_adds_no_folder(spark, tmp_path):
    path = str(tmp_path)
    batch = fragments_of(spark, [("u", 1, "one")])
    upsert_items(batch, path, "s-1")
    upsert_items(batch, path, "s-1")
    assert current(spark, path) == [batch_folder(path, "s-1")]
    compact_items(spark, path)
    upsert_items(batch, path, "s-1")  # known after the compaction too
    assert len(current(spark, path)) == 1 and batch_folder(path, "s-1") not in current(spark, path)
    # a failed attempt has left files that no log names
    fragments_of(spark, [("x", 1, "left over")]).write.parquet(batch_folder(path, "s-2"))
    upsert_items(fragments_of(spark, [("v", 2, "two")]), path, "s-2")
    assert {r["url"] for r in read_items(spark, path).collect()} == {"u", "v"}


def arriving(spark, df, folder, schema, files):
    df.repartition(files, "url").write.option("maxRecordsPerFile", 1).parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_fifty_micro_batches_leave_few_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(generations, "LOG_FILES", 8)
    at = lambda name: str(tmp_path / name)
    rows = fragments_of(spark, [(f"u{i % 17}", i, f"n{i}") for i in range(50)])
    stream = arriving(spark, rows, at("in"), FRAGMENT, 4)
    query = stream_fragments(stream, at("items"), at("checkpoint"), compact_every=5).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["batchId"] >= 49
    assert len(current(spark, at("items"))) <= 5 and len(log_files(spark, at("items"))) <= 20
    remove_obsolete(spark, at("items"))
    got = {r["url"]: r["name"] for r in read_items(spark, at("items")).collect()}
    assert got == {f"u{u}": f"n{max(i for i in range(50) if i % 17 == u)}" for u in range(17)}


def test_stream_frontier_emits_each_request_once(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    try:
        rows = requests_of(spark, [("s" if i % 2 else "t", f"http://u{i % 6}/", i) for i in range(24)])
        stream = arriving(spark, rows, at("in"), REQUEST, 3)
        writer = stream_frontier(stream, at("crawl"), at("checkpoint"), compact_every=None)
        writer.trigger(availableNow=True).start().awaitTermination()
        # the same requests arrive again after a restart: the state knows them
        rows.write.mode("append").parquet(at("in"))
        writer = stream_frontier(stream, at("crawl"), at("checkpoint"), compact_every=None)
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 6
    finally:
        spark.conf.set(provider, before)
    stored = spark.read.schema(REQUEST).parquet(*current(spark, at("crawl/requests")))
    want = sorted((s, u) for s, u in {("s" if i % 2 else "t", f"http://u{i % 6}/") for i in range(24)})
    assert sorted((r["source"], r["url"]) for r in stored.collect()) == want
    assert sorted((r["source"], r["url"]) for r in read_frontier(spark, at("crawl")).collect()) == want


def test_compacted_crawl_is_the_same(spark, tmp_path):
    path = str(tmp_path)
    answered = f"{path}/answered"
    for turn in range(4):
        store_requests(requests_of(spark, [("s", f"http://u{i}/", 10 * turn + i) for i in range(turn, turn + 4)]), path)
        keys = spark.createDataFrame([("s", f"key http://u{turn}/", "d"), ("s", "key http://u1/", f"d{turn}")], "source string, request_key string, digest string")
        generations_before = len(current(spark, answered))
        from bookmark_lake.operators.merge import add_batch

        add_batch(keys, answered)
        assert len(current(spark, answered)) == generations_before + 1
    rows = lambda df: sorted(map(str, df.collect()))
    left, known = rows(read_frontier(spark, path)), rows(read_answered(spark, path).distinct())
    compact_crawl(spark, path)
    assert len(current(spark, answered)) == len(current(spark, f"{path}/requests")) == 1
    assert rows(read_frontier(spark, path)) == left and rows(read_answered(spark, path)) == known
    # an answered request that is found again stays answered
    store_requests(requests_of(spark, [("s", "http://u1/", 99)]), path)
    assert rows(read_frontier(spark, path)) == left


def test_frontier_keeps_the_first(spark):
    rows = requests_of(spark, [("s", "http://a/", 5), ("s", "http://a/", 2), ("t", "http://a/", 9)])
    assert sorted((r["source"], r["parent_seq"]) for r in frontier(rows).collect()) == [("s", 2), ("t", 9)]


def test_display_reads_the_rows_shown(spark, tmp_path):
    path = str(tmp_path)
    for part in range(2):
        upsert_items(fragments_of(spark, [(f"u{i:03d}", 100 * part + i, f"name {i}") for i in range(100)]), path)
    compact_items(spark, path)
    result = spark.createDataFrame([(1, "u042", 2.0, True, 1)], "rank int, url string, score double, is_standout boolean, total_hits long")
    shown = present(result, read_items(spark, path))
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(url,u042)" in plan.split("PushedFilters:")[1] or "In(url, [u042])" in plan.split("PushedFilters:")[1]
    below = plan[plan.index("Aggregate") :]
    assert "u042" in below[below.index("Filter") :]
    assert [(r["url"], r["title"]) for r in shown.collect()] == [("u042", "name 42 - text 142")]


# rules as rows

LINKS = [
    "https://gist.github.com/me/abc1/", "http://www.github.com/me/repo", "https://github.com/me/repo?tab=x", "https://gitlab.com/me/pro.ject/",
    "https://gitlab.com/users/x", "https://gitlab.com/a~b/c*d e+f%", "https://github.com/a", "http://gitlab.com.evil.org/a/b", "https://GitHub.com/a/b",
    "ftp://github.com/a/b", "https://www.gitlab.com/ü/日本", "http://other.org/github.com/a/b", "https://github.com:80/a/b", "", "https://gist.github.com/{1}/{2}",
]


def as_rows(df):
    return sorted((r["source"], r["parent_seq"], r["pos"], r["kind"], r["url"], r["request_key"], sorted(r["meta"].items()), sorted(r["headers"].items())) for r in df.collect())


def test_table_routes_as_the_list(spark):
    requests = requests_of(spark, [(s, u, i) for i, u in enumerate(LINKS) for s in ("github_stars", "gitlab_stars", "pocket")])
    requests = requests.withColumn("meta", F.create_map(F.lit("url"), F.lit("old"), F.lit("k"), F.col("url")).cast("map<string,string>"))
    anywhere = Rule("x", r"/([a-z]+)$", (Output("any", "http://any/{1}?of={url}", meta={"m": "{%1}"}), Output("two", "http://two/")))
    for rules in (DEFAULT_RULES, [*DEFAULT_RULES, anywhere], [anywhere, *DEFAULT_RULES], [], [anywhere]):
        assert as_rows(route_by_table(requests, rule_rows(spark, rules))) == as_rows(route(requests, rules))


def test_sources_add_their_rules(spark, tmp_path):
    path = str(tmp_path)
    for rule in DEFAULT_RULES:
        add_rules(spark, path, [rule])
    rules = read_rules(spark, path)
    assert [r["priority"] for r in rules.select("priority").distinct().orderBy("priority").collect()] == [0, 1, 2]
    requests = requests_of(spark, [("pocket", u, i) for i, u in enumerate(LINKS)])
    assert as_rows(route_by_table(requests, rules)) == as_rows(route(requests, DEFAULT_RULES))


def test_ten_thousand_rules_are_one_join(spark):
    rules = [Rule("a", rf"^https?://h{i}\.org/([^/]+)$", (Output(f"k{i}", f"https://api.h{i}.org/{{1}}"),), hosts=(f"h{i}.org",)) for i in range(10_000)]
    table = rule_rows(spark, rules)
    requests = requests_of(spark, [("s", f"http://h{i * 7 % 12_000}.org/p{i}", i) for i in range(500)])
    routed = route_by_table(requests, table)
    plan = routed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    want = sorted(f"https://api.h{i * 7 % 12_000}.org/p{i}" if i * 7 % 12_000 < 10_000 else f"http://h{i * 7 % 12_000}.org/p{i}" for i in range(500))
    assert sorted(r["url"] for r in routed.collect()) == want
