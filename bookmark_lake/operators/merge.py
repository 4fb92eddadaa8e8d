"""Merging fragments into one item per URL, and the stored item table.

Each stored value carries the arrival order ``(seq, pos)`` of the fragment it came
from. "Latest non-empty value wins" is then a plain per-column maximum, which is
commutative, associative and idempotent: partial aggregation before the shuffle is
exact even for one very hot URL, arrival order of files does not matter, and a
replayed batch changes nothing.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import non_empty, non_empty_array
from ..schema import ITEM_ARRAYS, ITEM_STRINGS, ITEM_VALUES, VERSIONED_ITEM, version_type
from .generations import batch_folder, current, is_logged, new_folder, put_in_force


def drop_html(df: DataFrame) -> DataFrame:
    """Items are stored without their raw page."""
    return df.drop("html")


def drop_empty(df: DataFrame) -> DataFrame:
    """'' and [] become NULL, so that a partial write never erases a value."""
    values = {c: non_empty(c) for c in ["url", "html", *ITEM_STRINGS] if c in df.columns}
    values.update({c: non_empty_array(c) for c in ITEM_ARRAYS if c in df.columns})
    return df.withColumns(values)


def _versions(df: DataFrame, seq, pos) -> DataFrame:
    df = drop_empty(df)
    columns = [
        F.when(
            F.col(c).isNotNull(),
            F.struct(seq.alias("seq"), pos.alias("pos"), F.col(c).alias("value")),
        )
        .cast(version_type(c))
        .alias(c)
        for c in ITEM_VALUES
    ]
    return df.filter(F.col("url").isNotNull()).select("url", *columns)


def fragment_versions(fragments: DataFrame) -> DataFrame:
    return _versions(fragments, F.col("seq"), F.col("pos"))


def item_versions(items: DataFrame) -> DataFrame:
    """Items of unknown age: older than every fragment."""
    return _versions(items, F.lit(-1).cast("bigint"), F.lit(0).cast("bigint"))


def merge_versions(versions: DataFrame) -> DataFrame:
    """Latest version of every column of every URL."""
    return versions.groupBy("url").agg(*[F.max(c).alias(c) for c in ITEM_VALUES])


def versions_as_items(versions: DataFrame) -> DataFrame:
    return versions.select("url", *[F.col(c)["value"].alias(c) for c in ITEM_VALUES])


def merge_index(fragments: DataFrame, items: DataFrame = None) -> DataFrame:
    """One item per URL: per column the latest non-empty value, arrays replaced whole.

    Rows of ``items``, the present index, keep every value the fragments lack.
    """
    versions = fragment_versions(fragments)
    if items is not None:
        versions = versions.unionByName(item_versions(items))
    return versions_as_items(merge_versions(versions))


# The stored table: immutable batches of merged versions, one for each write. A compaction or a
# rebuild puts one batch in the place of exactly those it has read, so whatever is written meanwhile
# stays, and of two first writers both stay.


def add_batch(df: DataFrame, path, instead_of=(), name=None):
    """Put ``df`` in force as one batch; a batch with a ``name`` that is there already adds nothing."""
    spark = df.sparkSession
    folder = new_folder(path) if name is None else batch_folder(path, name)
    if name is not None and is_logged(spark, path, folder):
        return
    df.write.mode("overwrite").parquet(folder)  # what a failed attempt has left
    put_in_force(spark, path, add=[folder], remove=instead_of)


def rebuild_index(fragments: DataFrame, path):
    """Full refresh from ``fragments`` alone, in the place of all batches there are now."""
    spark = fragments.sparkSession
    replaced = current(spark, path)
    add_batch(merge_versions(fragment_versions(fragments)), path, replaced)


def upsert_items(fragments: DataFrame, path, name=None):
    """Add fragments to the stored table.

    Writes only what the batch holds, merged per URL: the cost follows the batch,
    not the table. Readers merge across batches; ``compact_items`` folds them. A batch
    written again under its ``name`` is known and adds nothing.
    """
    add_batch(merge_versions(fragment_versions(fragments)), path, name=name)


def _read_batches(spark, batches) -> DataFrame:
    if not batches:
        return spark.createDataFrame([], VERSIONED_ITEM)
    return spark.read.schema(VERSIONED_ITEM).parquet(*batches)


def read_versions(spark: SparkSession, path) -> DataFrame:
    return _read_batches(spark, current(spark, path))


def read_items(spark: SparkSession, path) -> DataFrame:
    """The stored items, one row per URL."""
    return versions_as_items(merge_versions(read_versions(spark, path)))


def compact_items(spark: SparkSession, path, batches=None):
    """Fold ``batches``, by default all there are now, into one of one row per URL, ranged by URL."""
    batches = current(spark, path) if batches is None else batches
    if batches:
        merged = merge_versions(_read_batches(spark, batches))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        add_batch(merged.repartitionByRange(parts, "url").sortWithinPartitions("url"), path, batches)


def backlinks(items: DataFrame) -> DataFrame:
    """Every item that was reached through another one, with that item's name.

    One repository may be behind a third of all links: the left side may be split
    by the skew handling of adaptive execution, since URLs are unique on the right.
    """
    origin = items.select(F.col("url").alias("origin_url"), F.col("name").alias("origin_name"))
    linked = items.withColumn(
        "origin_url", F.coalesce(non_empty("repository_backlink"), non_empty("twitter_backlink"))
    ).filter(F.col("origin_url").isNotNull())
    return linked.select("url", "name", "origin_url").join(origin, "origin_url", "left")
