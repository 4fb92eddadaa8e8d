"""Short rows are dealt to tasks by their number."""

from pyspark.sql import functions as F

from bookmark_lake.checks import registry


def test_short_rows_of_one_file_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(registry, "TASK_ROWS", 100)
    rows = spark.range(1050).coalesce(1)
    dealt = registry.spread(rows)
    assert dealt.rdd.getNumPartitions() == 11
    assert dealt.agg(F.count("*"), F.sum("id")).first() == rows.agg(F.count("*"), F.sum("id")).first()
    assert registry.spread(spark.range(0)).count() == 0
