"""Routing, merging, frontier, parsers and search on small fixtures."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bookmark_lake.operators.filters import mark_unchanged, processable
from bookmark_lake.operators.frontier import frontier
from bookmark_lake.operators.generations import current, remove_obsolete
from bookmark_lake.operators.index import index_of, read_index, tokens, write_index
from bookmark_lake.operators.merge import (
    compact_items,
    drop_empty,
    merge_index,
    read_items,
    rebuild_index,
    upsert_items,
)
from bookmark_lake.operators.present import present
from bookmark_lake.operators.route import DEFAULT_RULES, Output, Rule, route
from bookmark_lake.operators.search import edit_distance, parse_query, score_hits, search
from bookmark_lake.plans.ingest import ingest, parse_responses, read_answered, read_frontier
from bookmark_lake.schema import FRAGMENT, REQUEST, RESPONSE
from bookmark_lake.streaming.ingest import stream_ingest

NO_MATCH = Rule("a", r"^http://never/", (Output("x", "http://x/"),))
TWO = Rule("a", r"^http://example\.com", (Output("b2", "https://mirror.example.org/b"), Output("b3", "https://mirror.example.org/c")))
FIRST = Rule("p1", r"^http://example\.com", (Output("f", "https://one.example.org/start"),))
SECOND = Rule("p2", r"^http://example\.com", (Output("s", "https://two.example.org/left"), Output("s", "https://two.example.org/right")))


def requests_of(spark, *rows):
    """(source, url, meta, seq, pos) → REQUEST."""
    full = [(s, "page", "GET", u, "", f"key {u}", {}, m, seq, pos) for s, u, m, seq, pos in rows]
    return spark.createDataFrame(full, REQUEST)


def routed(spark, rules, source="requester", url="http://example.com", meta=None):
    rows = route(requests_of(spark, (source, url, meta or {}, 1, 0)), rules).collect()
    return [r["url"] for r in rows], rows


def test_route(spark):
    assert routed(spark, [NO_MATCH])[0] == ["http://example.com"]
    assert routed(spark, [])[0] == ["http://example.com"]
    urls, rows = routed(spark, [TWO])
    assert urls == ["https://mirror.example.org/b", "https://mirror.example.org/c"]
    assert [r["kind"] for r in rows] == ["b2", "b3"]
    assert routed(spark, [NO_MATCH, FIRST, SECOND])[0] == ["https://one.example.org/start"]
    assert routed(spark, [FIRST, SECOND], source="p1")[0] == [
        "https://two.example.org/left", "https://two.example.org/right",
    ]


def test_route_merges_meta(spark):
    rule = Rule("a", "^http://example", (Output("x", "http://new/", meta={"depth": "shallow", "page": "{url}"}),))
    _, rows = routed(spark, [rule], meta={"page": "before", "item_url": "kept"})
    assert rows[0]["meta"] == {"item_url": "kept", "depth": "shallow", "page": "http://example.com"}


@pytest.mark.parametrize(
    "url, target",
    [
        ("https://gist.github.com/me/abc1/", "https://api.github.com/gists/abc1"),
        ("http://www.github.com/me/repo", "https://api.github.com/repos/me/repo"),
        ("https://github.com/me/repo?tab=x", "https://api.github.com/repos/me/repo?tab=x"),
        ("https://gitlab.com/me/pro.ject/", "https://gitlab.com/api/v4/projects/me%2Fpro.ject"),
        ("https://gitlab.com/users/x", "https://gitlab.com/users/x"),
        ("https://github.com/me/repo/issues", "https://github.com/me/repo/issues"),
        ("https://githubXcom/me/repo", "https://githubXcom/me/repo"),
    ],
)
def test_default_rules(spark, url, target):
    assert routed(spark, DEFAULT_RULES, source="pocket", url=url)[0] == [target]


def test_frontier(spark):
    asked = requests_of(
        spark,
        ("s1", "http://a", {"n": "late"}, 2, 0),
        ("s1", "http://a", {"n": "first"}, 1, 5),
        ("s2", "http://a", {"n": "other source"}, 3, 0),
        ("s1", "http://b", {"n": "answered"}, 1, 0),
    )
    answered = spark.createDataFrame([("s1", "key http://b")] * 3, "source string, request_key string")
    left = frontier(asked, answered).collect()
    assert sorted(r["meta"]["n"] for r in left) == ["first", "other source"]


def fragment(url, seq, pos=0, **values):
    row = {f.name: None for f in FRAGMENT.fields}
    row.update(url=url, seq=seq, pos=pos, source="s", **values)
    return tuple(row[f.name] for f in FRAGMENT.fields)


def fragments_of(spark, *rows):
    return spark.createDataFrame(list(rows), FRAGMENT)


def test_drop_empty(spark):
    rows = fragments_of(
        spark,
        fragment("u", 1, name="testing", description="test item", twitter_tags=["a", "b", "c"], content="", article_tags=[]),
        fragment(None, 2, name="testing", alt_url="http://test.example.com/test"),
    )
    kept = [{k for k, v in r.asDict().items() if v is not None} - {"source", "seq", "pos", "url"} for r in drop_empty(rows).collect()]
    assert kept == [{"name", "description", "twitter_tags"}, {"name", "alt_url"}]


def merged(df):
    return {r["url"]: {k: v for k, v in r.asDict().items() if v is not None and k != "url"} for r in df.collect()}


MERGE_ROWS = [
    fragment("u", 1, name="old", description="kept", pocket_tags=["a", "b"]),
    fragment("u", 3, 1, name="newest", content=""),
    fragment("u", 3, 0, name="same response, earlier", content="text"),
    fragment("u", 2, name="middle", pocket_tags=[], twitter_tags=["t"]),
    fragment("v", 1, name="other"),
]
MERGED = {
    "u": {"name": "newest", "description": "kept", "content": "text", "pocket_tags": ["a", "b"], "twitter_tags": ["t"]},
    "v": {"name": "other"},
}


def test_merge_is_independent_of_order_and_partitions(spark):
    rows = fragments_of(spark, *MERGE_ROWS)
    for parts in (1, 3, 7):
        assert merged(merge_index(rows.repartition(parts))) == MERGED
    assert merged(merge_index(rows.unionByName(rows))) == MERGED
    assert merged(merge_index(fragments_of(spark, *MERGE_ROWS[::-1]))) == MERGED


def test_merge_keeps_index_values(spark):
    index = merge_index(fragments_of(spark, fragment("u", 9, name="indexed", alt_url="x"), fragment("w", 9, name="only here")))
    both = merged(merge_index(fragments_of(spark, *MERGE_ROWS), index))
    assert both["u"]["name"] == "newest" and both["u"]["alt_url"] == "x" and both["w"] == {"name": "only here"}


def test_stored_items(spark, tmp_path):
    path = str(tmp_path / "items")
    assert read_items(spark, path).count() == 0
    for row in MERGE_ROWS[::-1] + MERGE_ROWS[:1]:
        upsert_items(fragments_of(spark, row), path)
    assert merged(read_items(spark, path)) == MERGED
    compact_items(spark, path)
    assert merged(read_items(spark, path)) == MERGED
    rebuild_index(fragments_of(spark), path)
    assert read_items(spark, path).count() == 0
    upsert_items(fragments_of(spark, MERGE_ROWS[4]), path)
    assert merged(read_items(spark, path)) == {"v": {"name": "other"}}


def response(seq, kind, source, body, **values):
    row = {f.name: None for f in RESPONSE.fields}
    row.update(
        seq=seq, kind=kind, source=source, body=body, status=200, flags=[], meta={},
        headers={"Content-Type": "application/json"}, request_key=f"k{seq}", request_url="http://r.com/", final_url="http://r.com/",
    )
    row.update(values)
    return tuple(row[f.name] for f in RESPONSE.fields)


def test_processable(spark):
    rows = [response(i, "k", "s", "", status=s, flags=f) for i, (s, f) in enumerate(
        [(200, []), (304, []), (399, ["cached"]), (400, []), (503, [])])]
    df = spark.createDataFrame(rows, RESPONSE)
    assert [r["seq"] for r in processable(df).collect()] == [0]
    assert sorted(r["seq"] for r in processable(df, True).collect()) == [0, 2]


def test_mark_unchanged(spark):
    old = spark.createDataFrame([response(1, "k", "s", "same"), response(2, "k", "s", "old")] * 2, RESPONSE)
    new = spark.createDataFrame([response(1, "k", "s", "same", flags=["x"]), response(2, "k", "s", "new"), response(3, "k", "s", None)], RESPONSE)
    assert {r["seq"]: r["flags"] for r in mark_unchanged(new, old).collect()} == {1: ["x", "cached"], 2: [], 3: []}


RESPONSES = [
    response(1, "github_stars", "github_stars", '[{"url": "https://api.github.com/repos/o/r", "html_url": "https://github.com/o/r", "name": "r", "description": null}]',
             headers={"Link": '<https://api.github.com/next>; rel="next"'}),
    response(2, "github_repo", "github_stars", "gone", status=404, meta={"item_url": "https://github.com/o/r", "item_name": "r"}),
    response(3, "pocket", "pocket", '{"status": 1, "list": {"7": {"given_title": "T", "time_added": "0", "resolved_url": "https://github.com/o/r", "given_url": "http://short/"}}}',
             meta={"next_offset": "50"}),
    response(4, "pocket", "pocket", '{"status": 0, "list": {"7": {"given_url": "http://short/"}}}'),
    response(5, "pocket", "pocket", '{"status": 1, "list": []}', meta={"next_offset": "50"}),
    response(6, "tweets", "twitter_favs", '[{"id": 5, "full_text": "hi", "created_at": "x", "user": {"screen_name": "u"}, "entities": {"hashtags": [], "urls": [{"expanded_url": "https://l.com/1"}, {"expanded_url": "https://l.com/2"}]}}, {"id": 4, "full_text": "no entities", "created_at": "x", "user": {"screen_name": "u"}}]'),
    response(7, "tweets", "twitter_favs", "[]"),
    response(8, "tweet_page", "twitter_favs", "<title>L</title><body>linked</body>", headers={"Content-Type": "text/html"},
             meta={"url": "https://l.com/1", "twitter_url": "https://twitter.com/u/status/5"}),
    response(9, "pocket_page", "pocket", "not seen", status=404, meta={"url": "http://x.com"}),
    response(10, "gitlab_readme", "gitlab_stars", '{"html": "<h1>Read</h1> me"}', meta={"url": "https://gitlab.com/g/p"}),
]


def test_ingest(spark, tmp_path):
    path = str(tmp_path / "items")
    left = ingest(spark.createDataFrame(RESPONSES, RESPONSE), path)
    items = merged(read_items(spark, path))
    assert items["https://github.com/o/r"] == {"name": "T", "last_update": "1970-01-01T00:00:00", "alt_url": "http://short/"}
    assert items["https://twitter.com/u/status/4"] == {"content": "no entities"}
    assert items["https://l.com/1"] == {"name": "L", "content": "linked", "twitter_backlink": "https://twitter.com/u/status/5"}
    assert items["https://gitlab.com/g/p"] == {"content": "Read\nme".replace("\n", " ")}
    assert "http://x.com" not in items
    asked = {(r["source"], r["kind"], r["url"]) for r in left.collect()}
    assert asked == {
        ("github_stars", "github_repo", "https://api.github.com/repos/o/r"),
        ("github_stars", "github_stars", "https://api.github.com/next"),
        ("pocket", "github_repo", "https://api.github.com/repos/o/r"),
        ("pocket", "pocket", "https://getpocket.com/v3/get"),
        ("twitter_favs", "tweet_page", "https://l.com/1"),
        ("twitter_favs", "tweet_page", "https://l.com/2"),
        ("twitter_favs", "tweets", "https://api.twitter.com/1.1/favorites/list.json?count=100&tweet_mode=extended&max_id=3"),
    }


def test_ingest_knows_earlier_calls(spark, tmp_path):
    items, crawl = str(tmp_path / "items"), str(tmp_path / "crawl")
    frame = lambda rows: spark.createDataFrame(rows, RESPONSE)
    first = {(r["source"], r["url"]) for r in ingest(frame(RESPONSES), items, crawl_path=crawl).collect()}
    asked = read_frontier(spark, crawl).filter("url = 'https://l.com/2'").first()
    answer = response(20, "tweet_page", "twitter_favs", "<title>M</title><body>more</body>", headers={"Content-Type": "text/html"},
                      meta={"url": "https://l.com/2", "twitter_url": "https://twitter.com/u/status/5"})
    answer = tuple(asked["request_key"] if f.name == "request_key" else v for f, v in zip(RESPONSE.fields, answer, strict=True))
    # the same posts again ask for the same pages, one of which is answered now
    left = {(r["source"], r["url"]) for r in ingest(frame([answer, RESPONSES[5]]), items, crawl_path=crawl).collect()}
    assert left == first - {("twitter_favs", "https://l.com/2")}
    assert merged(read_items(spark, items))["https://l.com/2"]["content"] == "more"
    again = ingest(frame([RESPONSES[5]]), items, crawl_path=crawl)
    assert {(r["source"], r["url"]) for r in again.collect()} == left
    seen = mark_unchanged(frame([answer]), read_answered(spark, crawl)).first()
    assert seen["flags"] == ["cached"]


def test_stream_equals_batch(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    responses = spark.createDataFrame(RESPONSES, RESPONSE)
    batch = ingest(responses, at("items"), crawl_path=at("crawl"))
    responses.repartition(5, "seq").write.parquet(at("in"))
    arriving = spark.readStream.schema(RESPONSE).option("maxFilesPerTrigger", 2).parquet(at("in"))
    writer = stream_ingest(arriving, at("items2"), at("checkpoint"), crawl_path=at("crawl2"), compact_every=2)
    writer.trigger(availableNow=True).start().awaitTermination()
    rows = lambda df: sorted(map(str, df.select("source", "kind", "url", "request_key").collect()))
    assert rows(read_frontier(spark, at("crawl2"))) == rows(batch)
    assert merged(read_items(spark, at("items2"))) == merged(read_items(spark, at("items")))


def test_supplied_metadata_reaches_the_items(spark, tmp_path):
    page = response(1, "pocket_page", "pocket", "<body>x</body>", headers={"Content-Type": "text/html"}, meta={"url": "http://a.com/"})
    pages = spark.createDataFrame([page], RESPONSE).withColumn(
        "ready", F.expr("named_struct('json_ld', array(parse_json('{\"keywords\": \"k\"}')), 'rdfa', cast(array() AS array<struct<key:string,value:string>>), "
                        "'microdata', cast(null AS map<string,variant>), 'opengraph', cast(null AS map<string,variant>), 'broken', false)")
    )
    ingest(pages, str(tmp_path / "items"), metadata="ready")
    assert merged(read_items(spark, str(tmp_path / "items")))["http://a.com/"]["article_tags"] == ["k"]


def test_ingest_one_source(spark):
    parsed = parse_responses(spark.createDataFrame(RESPONSES, RESPONSE), sources=["pocket"])
    assert {r["source"] for r in parsed.fragments.collect()} == {"pocket"}


ITEMS = [
    ("u1", "Spark engine", "spark spark fast", ["big_data"]),
    ("u2", "Other", "a fast spark", ["spark", "fast"]),
    ("u3", "Quiet", "nothing here", []),
    ("u4", "sprak", "typo in the name", None),
    ("u5", "fast", "python pyhton", ["x"]),
]


def items_of(spark):
    return spark.createDataFrame(ITEMS, "url string, name string, content string, pocket_tags array<string>")


def brute_force(groups):
    """url → score by the plain formulas; ``groups`` are lists of words."""
    docs = {}
    for url, name, content, tags in ITEMS:
        for field, value in (("url", url), ("name", name), ("content", content), ("pocket_tags", " ".join(tags or []))):
            words = re.findall(r"\w+", value.lower())
            if words:
                docs[url, field] = Counter(words)
    scores = {}
    for url in {u for u, _ in docs}:
        total = []
        for words in groups:
            per_field = []
            for (u, field), counts in docs.items():
                peers = [c for (_, f), c in docs.items() if f == field]
                average = sum(sum(c.values()) for c in peers) / len(peers)
                found = 0.0
                for w in words:
                    if u == url and counts[w]:
                        n = sum(1 for c in peers if c[w])
                        tf, length = counts[w], sum(counts.values())
                        found += math.log(1 + (len(peers) - n + 0.5) / (n + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * length / average))
                per_field.append(found)
            total.append(max(per_field))
        if all(total):
            scores[url] = round(sum(total), 6)
    return scores


@pytest.mark.parametrize("terms", [["spark"], ["spark", "fast"], ["spark fast", "data x"], ["absent"]])
def test_scores_equal_brute_force(spark, terms):
    found = {r["url"]: r["score"] for r in score_hits(index_of(items_of(spark)), terms).collect()}
    assert found == pytest.approx(brute_force([t.split() for t in terms]))


def test_stored_index_gives_the_same(spark, tmp_path):
    write_index(items_of(spark), str(tmp_path))
    stored = read_index(spark, str(tmp_path))
    for terms in (["spark", "fast"], ["sprak~"]):
        expected = {tuple(r) for r in score_hits(index_of(items_of(spark)), terms).collect()}
        assert {tuple(r) for r in score_hits(stored, terms).collect()} == expected


def test_fuzzy(spark):
    urls = lambda *terms: {r["url"] for r in score_hits(index_of(items_of(spark)), list(terms)).collect()}
    assert urls("sprak") == {"u4"}
    assert urls("sprak~") == {"u1", "u2", "u4"}
    assert urls("pythno~") == {"u5"}
    assert urls("x~") == {"u5"}


@pytest.mark.parametrize(
    "query, expected",
    [
        ("spark AND fast", "spark & fast"),
        ("spark NOT fast", "spark - fast"),
        ("spark -fast", "spark - fast"),
        ("+spark fast", "spark"),
        ("(spark AND fast) OR data", "spark & fast | data"),
        ("data AND NOT (spark OR fast)", "data - spark - fast"),
    ],
)
def test_boolean_queries(spark, query, expected):
    index = index_of(items_of(spark))
    urls = lambda word: {r["url"] for r in score_hits(index, [word]).collect()}
    want = eval(expected, {w: urls(w) for w in ("spark", "fast", "data")})
    assert {r["url"] for r in score_hits(index, [query]).collect()} == want


@pytest.mark.parametrize(
    "query", ['"fast spark"', "title:spark", "spa*", "s?ark", "spark^2", "[a TO b]", "a && b", "(spark", "spark)", "-spark", "AND", "x~3", "/s/"]
)
def test_other_syntax_is_refused(spark, query):
    with pytest.raises(ValueError):
        parse_query([query])


def test_fuzzy_distances(spark):
    words, _ = parse_query(["spark~1 spark~ spark"])
    assert [(w.term, w.distance) for w in words] == [("spark", 1), ("spark", 1), ("spark", None)]


def test_tokens(each):
    raw = ["big_data _x __", "cafe\u0301s na\u0308ive", "日本語 ひらカタカナ漢a字", "don't a.b 3.5 a..b", "", None]
    assert each(tokens("a"), raw) == [
        ["big_data", "_x"], ["cafe\u0301s", "na\u0308ive"], ["日", "本", "語", "ひ", "ら", "カタカナ", "漢", "a", "字"],
        ["don't", "a.b", "3.5", "a", "b"], [], None,
    ]
    for text, words in zip(raw[:4], each(tokens("a"), raw[:4]), strict=True):
        assert [w.term for w in parse_query([text])[0]] == words


def test_index_is_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path)
    write_index(items_of(spark), path)
    before = read_index(spark, path)
    broken = items_of(spark).withColumn("content", F.raise_error(F.lit("stop")))
    with pytest.raises(Exception, match="stop"):
        write_index(broken, path)
    assert {r["url"] for r in score_hits(read_index(spark, path), ["fast"]).collect()}
    write_index(items_of(spark).filter("url = 'u1'"), path)
    assert score_hits(before, ["spark"]).count() == 2  # readers of the old index go on
    assert read_index(spark, path).postings.select("url").distinct().count() == 1
    remove_obsolete(spark, path)
    assert len(current(spark, path)) == 1


def one_fragment(spark, seq, url="u", **values):
    row = {f.name: None for f in FRAGMENT.fields} | {"url": url, "seq": seq, "pos": 0, "source": "s"} | values
    return spark.createDataFrame([tuple(row[f.name] for f in FRAGMENT.fields)], FRAGMENT)


def test_writes_beside_compaction_and_rebuild_stay(spark, tmp_path):
    path = str(tmp_path)
    for seq in (1, 2):  # two first writers: neither looks at what the other does
        upsert_items(one_fragment(spark, seq, f"first{seq}", name="n"), path)
    before = current(spark, path)
    upsert_items(one_fragment(spark, 3, "late", name="n"), path)
    compact_items(spark, path, before)
    assert {r["url"] for r in read_items(spark, path).collect()} == {"first1", "first2", "late"}
    assert len(current(spark, path)) == 2
    remove_obsolete(spark, path)
    assert {r["url"] for r in read_items(spark, path).collect()} == {"first1", "first2", "late"}
    rebuild_index(one_fragment(spark, 4, "new", name="n"), path)
    assert {r["url"] for r in read_items(spark, path).collect()} == {"new"}


def osa(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_edit_distance(each):
    words = ["python", "pyhton", "pyhtno", "pytho", "pythonic", "typhon", "ython", "xython", "p", "pxhton", "pyhtonn", "phyton"]
    for limit in (0, 1, 2):
        expected = [osa(w, "python") if osa(w, "python") <= limit else None for w in words]
        assert each(edit_distance(F.col("a"), "python", limit), words) == expected


def test_no_terms(spark):
    with pytest.raises(ValueError):
        search(index_of(items_of(spark)), [])
    with pytest.raises(ValueError):
        search(index_of(items_of(spark)), [" ~ "])


def test_search_and_display(spark):
    items = items_of(spark).withColumns(
        {c: F.lit(None).cast("string") for c in ("description", "article_published_date")}
    ).withColumn("last_update", F.lit("2021-05-15T12:55:25Z"))
    index = index_of(items)
    assert search(index, ["absent"]).count() == 0
    one_hit = search(index, ["typo"]).first()
    assert (one_hit["rank"], one_hit["is_standout"], one_hit["total_hits"]) == (1, True, 1)
    shown = present(search(index, ["spark"], size=1), items).collect()
    assert len(shown) == 1 and shown[0]["total_hits"] == 2
    assert shown[0]["line"].startswith("(2021) ") and "★" in shown[0]["line"]
    ranks = [r["rank"] for r in present(search(index, ["spark"]), items).collect()]
    assert ranks == [2, 1]


def test_top_30_of_many(spark):
    many = spark.range(100).select(F.format_string("u%03d", "id").alias("url"), F.lit("same words").alias("content"))
    rows = search(index_of(many), ["same"]).orderBy("rank").collect()
    assert [r["url"] for r in rows] == [f"u{i:03d}" for i in range(30)]
    assert {r["total_hits"] for r in rows} == {100}
