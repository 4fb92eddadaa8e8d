"""Table schemas shared by every operator."""

from pyspark.sql import types as T

ITEM_STRINGS = [
    "name",
    "description",
    "last_update",
    "content",
    "repository_backlink",
    "twitter_backlink",
    "alt_url",
    "article_published_date",
]
ITEM_ARRAYS = ["repository_tags", "pocket_tags", "twitter_tags", "article_tags"]
# Columns of the stored item besides its key; html is dropped before storing.
ITEM_VALUES = ITEM_STRINGS + ITEM_ARRAYS

_STR = T.StringType()
_STRS = T.ArrayType(T.StringType())
_MAP = T.MapType(T.StringType(), T.StringType())


def value_type(column):
    return _STRS if column in ITEM_ARRAYS else _STR


ITEM = T.StructType(
    [T.StructField("url", _STR)]
    + [T.StructField(c, value_type(c)) for c in ITEM_VALUES]
)

FRAGMENT = T.StructType(
    ITEM.fields
    + [
        T.StructField("html", _STR),
        T.StructField("source", _STR),
        T.StructField("seq", T.LongType()),
        T.StructField("pos", T.LongType()),
    ]
)

RESPONSE = T.StructType(
    [
        T.StructField("source", _STR),
        T.StructField("kind", _STR),
        T.StructField("request_key", _STR),
        T.StructField("request_url", _STR),
        T.StructField("final_url", _STR),
        T.StructField("status", T.IntegerType()),
        T.StructField("flags", _STRS),
        T.StructField("headers", _MAP),
        T.StructField("body", _STR),
        T.StructField("meta", _MAP),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("seq", T.LongType()),
    ]
)

REQUEST = T.StructType(
    [
        T.StructField("source", _STR),
        T.StructField("kind", _STR),
        T.StructField("method", _STR),
        T.StructField("url", _STR),
        T.StructField("body", _STR),
        T.StructField("request_key", _STR),
        T.StructField("headers", _MAP),
        T.StructField("meta", _MAP),
        T.StructField("parent_seq", T.LongType()),
        T.StructField("pos", T.LongType()),
    ]
)

# One stored value together with the arrival order that decides which value wins.
def version_type(column):
    return T.StructType(
        [
            T.StructField("seq", T.LongType()),
            T.StructField("pos", T.LongType()),
            T.StructField("value", value_type(column)),
        ]
    )


VERSIONED_ITEM = T.StructType(
    [T.StructField("url", _STR)]
    + [T.StructField(c, version_type(c)) for c in ITEM_VALUES]
)

POSTING = T.StructType(
    [
        T.StructField("term", _STR),
        T.StructField("field", _STR),
        T.StructField("url", _STR),
        T.StructField("tf", T.IntegerType()),
        T.StructField("field_len", T.IntegerType()),
    ]
)
