"""Frontier: requests still to be fetched, each once per source."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import REQUEST

KEYS = ["source", "request_key"]


def frontier(requests: DataFrame, responses: DataFrame = None) -> DataFrame:
    """First request of every (source, request_key) that no response answers yet.

    The minimum is taken before the shuffle too, so a link repeated in a third of
    all rows leaves each task as one row; answered keys are folded the same way.
    Both sides end up hashed on the same keys, so the anti join adds no shuffle.
    """
    names = [f.name for f in REQUEST.fields]
    rest = [n for n in names if n not in KEYS]
    first = (
        requests.groupBy(*KEYS)
        .agg(F.min_by(F.struct(*rest), F.struct("parent_seq", "pos")).alias("first"))
        .select(*KEYS, "first.*")
        .select(*names)
    )
    if responses is None:
        return first
    answered = responses.select(*KEYS).distinct()
    return first.join(answered, KEYS, "left_anti").select(*names)

