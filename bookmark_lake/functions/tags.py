"""Tag clean-up and tag sets."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import col, let, strip

# Labels that may stand before a tag, as in "topic: music".
TAG_LABELS = ["tag", "section", "topic", "category", "プラットフォーム", "subject"]

_STRINGS = "array<string>"


def _none() -> Column:
    return F.array().cast(_STRINGS)


def _without_label(cleaned) -> Column:
    parts = F.split(cleaned, ":", -1)
    tag = let(
        parts,
        lambda p: F.when(
            p[0].isin(TAG_LABELS), F.when(F.size(p) == 2, F.get(p, F.lit(1)))
        ).otherwise(F.when(F.size(p) == 1, p[0])),
    )
    return let(strip(tag), lambda t: F.when(t != "", F.array(t)).otherwise(_none()))


def normalise_tag(c) -> Column:
    """The cleaned tag as a one-element array; empty for attributes like "lite:true"."""
    return _without_label(F.translate(F.lower(strip(c)), " -[]", "__"))


def tag_list(c) -> Column:
    """Normalised tags of an array of raw tags; NULLs are skipped."""
    return F.flatten(F.transform(F.array_compact(col(c)), normalise_tag))


def tag_list_from_string(c) -> Column:
    """Normalised tags of a comma-separated string."""
    return tag_list(F.split(col(c), ",", -1))


def tag_set(c) -> Column:
    """Sorted distinct tags."""
    return F.array_sort(F.array_distinct(col(c)))


def pocket_tags(tags) -> Column:
    """Keys of a saved article's tag map, with _ and - as spaces."""
    return F.transform(F.map_keys(col(tags)), lambda t: F.translate(t, "_-", "  "))


def hashtags(entities) -> Column:
    """Hashtag texts of a post; NULL when it has none."""
    return F.transform(col(entities)["hashtags"], lambda h: h["text"])


def all_tags(twitter, article, pocket) -> Column:
    """Sorted distinct union of post, page and article tags; repository tags stay apart."""
    parts = [F.coalesce(col(c), _none()) for c in (twitter, article, pocket)]
    return tag_set(F.concat(*parts))
