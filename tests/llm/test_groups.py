"""Connected groups in few rounds, and pairs of one label in several blocks."""

import numpy as np
import pytest

pytest.importorskip("bookmark_lake.llm.checks")
from bookmark_lake.llm import arrays, jaccard_join  # noqa: E402


def brute_groups(edges):
    label = {n: n for e in edges for n in e}
    for _ in label:
        for x, y in edges:
            label[x] = label[y] = min(label[x], label[y])
    return label


def test_components_of_few_edges_take_one_round(spark, monkeypatch):
    rng = np.random.default_rng(5)
    names = rng.permutation(10_000)[:60].tolist()
    edges = list(zip(names[:40], names[1:40], strict=False)) + [(names[50], names[51]), (names[51], names[50])]
    rounds = []
    monkeypatch.setattr(jaccard_join, "stored", lambda df, label: rounds.append(label) or arrays.stored(df, label))
    links = spark.createDataFrame(edges, "x long, y long").repartition(7)
    got = {r["id"]: r["label"] for r in jaccard_join.components(links).collect()}
    assert got == brute_groups(edges)
    assert len(rounds) == 1


def test_components_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "EDGES_AT_ONCE", 4)
    rng = np.random.default_rng(6)
    chain = rng.permutation(5_000)[:40].tolist()
    edges = list(zip(chain, chain[1:], strict=False)) + [(n, 9_999) for n in range(5_000, 5_030)]
    links = spark.createDataFrame(edges, "x long, y long").repartition(5)
    rows = jaccard_join.components(links).collect()
    assert len(rows) == len({r["id"] for r in rows})
    assert {r["id"]: r["label"] for r in rows} == brute_groups(edges)


def test_pairs_of_one_label_meet_in_several_blocks(spark, monkeypatch):
    """A hub of many pairs is cut, whatever the number of pairs in all."""
    monkeypatch.setattr(jaccard_join, "FEWEST_AT_ONCE", 20)
    monkeypatch.setattr(jaccard_join, "PAIRS_AT_ONCE", 20)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words, f"x{i}"]) for i in range(150)] + ["quite another text of its own words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {**dict.fromkeys(range(150), 0), 150: 150}
