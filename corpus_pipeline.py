"""Corpus pipeline: from raw documents to sampled pieces, in five stages.

Every stage but the last returns the columns of ``documents``; each is written as Parquet to the
shared folder and read again before the next. Further columns of a table stay as they are, whatever
their names, but for n_pieces and ids, which the last stage makes. Rows with null or empty text have no language and go
at the first stage. SQL can express neither the networks nor the sampling, so there is no ORACLE_SQL.
"""

from pyspark.sql import functions as F

from bookmark_lake.llm import jaccard_join, language, pieces, secrets, wu_manber
from bookmark_lake.llm.arrays import drop_stored, only, stored

#: Probability below which a document's language counts as unknown.
LEAST_SURE = 0.5
ORACLE_SQL = None


def _aside(stage, *names):
    """``stage`` over documents whose own columns of these names wait under other names."""

    def run(spark, docs, sf_dir):
        away = {c: f"own_column_{i}" for i, c in enumerate(docs.columns) if c.lower() in names}
        out = stage(spark, docs.withColumnsRenamed(away), sf_dir)
        return out.withColumnsRenamed({b: a for a, b in away.items()})

    run.__doc__ = stage.__doc__
    return run


def identify_language(spark, docs, sf_dir):
    """Rejects documents without a language that can be told."""
    model = language.train(docs.select("text", "lang"))
    known = language.identify(docs, model)
    known = known.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SURE))
    return known.select(*(f"`{c}`" for c in docs.columns))


def drop_near_copies(spark, docs, sf_dir):
    """Keeps one document of each group of near copies."""
    return jaccard_join.keep_one(docs)


def drop_benchmark(spark, docs, sf_dir):
    """Drops documents that hold a window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = wu_manber.find_benchmark(docs, benchmark)
    return found.filter("n_hit = 0").select(*(f"`{c}`" for c in docs.columns))


def redact_secrets(spark, docs, sf_dir):
    """Replaces secrets in the texts; n_chars follows."""
    found = secrets.scan(docs, secrets.train(docs))
    found = found.withColumn("text", secrets.redact(F.col("text"), F.col("spans")))
    found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*(f"`{c}`" for c in docs.columns))


def encode_pieces(spark, docs, sf_dir):
    """The documents as sampled pieces, in place of their texts."""
    return pieces.encode(docs, keep=[c for c in docs.columns if c != "text"])


STAGES = [
    ("language", _aside(identify_language, "lang_pred", "score")),
    ("jaccard_join", _aside(drop_near_copies, "likely", "row_key", "stays")),
    ("wu_manber", _aside(drop_benchmark, "n_words", "n_hit", "spans", "items", "row_key")),
    ("secrets", _aside(redact_secrets, "spans")),
    ("pieces", encode_pieces),
]


def run(spark, sf_dir):
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        with only(spark) as keep:
            docs = keep(stored(stage(spark, docs, sf_dir), f"pipeline_{name}"))
        if last is not None:
            drop_stored(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
