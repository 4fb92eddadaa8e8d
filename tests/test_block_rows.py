"""Stored rows of the index's blocks."""

from bookmark_lake.operators.index import index_of


def test_a_stored_row_holds_many_blocks(spark):
    """A word of 1,000 documents: 16 blocks in one row, each posting once."""
    items = spark.range(1000).selectExpr("concat('u', id) AS url", "concat('and and w', id) AS content").coalesce(1)
    index = index_of(items)
    rows = index.read("blocks").filter("term = 'and' AND field = 'content'").collect()
    assert [(len(r["block"]), r["df"]) for r in rows] == [(16, 1000)]
    found = index.postings.filter("term = 'and'").selectExpr("count(DISTINCT url)", "count(*)", "min(tf)", "max(tf)", "max(field_len)").first()
    assert tuple(found) == (1000, 1000, 2, 2, 3)
