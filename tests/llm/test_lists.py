"""Shingles that only recur far apart are found frequent, and a list costs its members outside its largest group."""

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("bookmark_lake.llm.checks")
from bookmark_lake.llm import arrays, jaccard_join  # noqa: E402

RULE = jaccard_join.Rule()


def test_rare_recurring_shingles_are_counted(spark):
    """One in a thousand texts has the line: it recurs in a portion, however few of its texts have it."""
    line = "one line that many texts have"
    texts = [" ".join(f"w{i}_{k}" for k in range(9)) + (f" {line}" if i % 1000 == 0 else "") for i in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = jaccard_join._sizes(docs, 5).filter("kind = 1").collect()
    code = jaccard_join.shingle_sets(pa.array(["one line that many texts", "line that many texts have"]))[1].view(np.int64)
    assert {r["id"]: r["n"] for r in rows} == dict.fromkeys(code.tolist(), 3)


def lists(rng, n_lists, length, n_labels):
    """Entries of lists, each half of one label, with sizes of 50 to 99."""
    entries = []
    for token in range(n_lists):
        for at, own in enumerate(rng.permutation(5_000)[:length]):
            label = 7 if at < length // 2 else int(rng.integers(0, n_labels))
            entries.append((token, int(own), int(50 + own % 50) * (1 if own % 3 else -1), int(rng.integers(0, 12)), label))
    names = ("token", "id", "n", "pos", "label")
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
    return entries, pa.table({c: pa.array(v, k) for c, v, k in zip(names, zip(*entries, strict=True), kinds, strict=True)})


def pairs_of(table):
    x, y, votes, need = arrays.unpack(table, pairs=(np.int64, np.int64, np.int32, np.int32))["pairs"][0]
    return dict(zip(zip(x.tolist(), y.tolist(), strict=True), zip(votes.tolist(), need.tolist(), strict=True), strict=True))


@pytest.mark.parametrize("n_labels", [2, 30])
def test_pairs_across_labels_are_all_named(n_labels, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PORTION", 500)
    entries, table = lists(np.random.default_rng(n_labels), 6, 60, n_labels)
    want = {}
    for a in entries:
        for b in entries:
            small, large = sorted((abs(a[2]), abs(b[2])))
            if a[0] != b[0] or a[1] >= b[1] or a[4] == b[4] or not RULE.fits(small, large):
                continue
            clean = a[2] > 0 and b[2] > 0
            if not clean and min(abs(a[2]) - a[3], abs(b[2]) - b[3]) < RULE.least(small, large):
                continue
            need = int(RULE.shared_prefix(small, large)) if clean else 1
            votes = want.get((a[1], b[1]), (0, 0))[0]
            want[a[1], b[1]] = (votes + 1, need)
    assert pairs_of(jaccard_join._across(table, 10, RULE, 4)) == want


def test_a_large_group_is_not_walked_member_by_member(monkeypatch):
    """A list of 4,000 members of one group and two others asks for about 8,000 pairs at once."""
    asked = []
    named = jaccard_join._pairs
    monkeypatch.setattr(jaccard_join, "_pairs", lambda *a: asked.append(len(a[3])) or named(*a))
    n = 4_002
    columns = {"token": np.zeros(n, np.int64), "id": np.arange(n), "n": np.full(n, 40, np.int32), "pos": np.zeros(n, np.int32)}
    label = np.where(np.arange(n) < 4_000, 1, np.arange(n))
    got = pairs_of(jaccard_join._across(pa.table({**columns, "label": label}), 10, RULE, 4))
    assert len(got) == 2 * 4_000 + 1 == sum(asked)
    assert len(asked) <= 2
