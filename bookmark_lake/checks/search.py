"""Index, ranking and display over documents, pages and conversations."""

from pyspark.sql import functions as F

from ..operators.index import (
    build_postings,
    field_stats,
    read_index,
    stem_postings,
    term_stats,
    tokens,
    write_index,
)
from ..operators.present import display_title, display_value, present, shorten
from ..operators.search import best_hits, count_hits, matching, score_hits, search
from ..session import work_folder
from .registry import check, sql_strip, table

_SQL_PART = "_*[\\p{L}\\p{N}][\\p{L}\\p{M}\\p{N}_]*"
_SQL_WORD = f"{_SQL_PART}(?:[.''’]{_SQL_PART})*"


def _sql_tokens(c):
    """Han and Hiragana signs set apart, then words."""
    apart = f"regexp_replace(lower({c}), '([\\p{{Han}}\\p{{Hiragana}}]\\p{{M}}*)', ' \\1 ', 'g')"
    return f"regexp_extract_all({apart}, '{_SQL_WORD}')"


# A name with a normalised tag, a decomposed letter and signs that are words by themselves.
_SQL_NAME = "lang || ' ' || source || ' ' || lang || '_' || source || ' cafe' || chr(769) || 's 日本語テキスト'"


def document_items(spark, sf_dir):
    """Documents as items: text, and language and source as tags."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"),
        F.concat_ws(" ", "lang", "source", F.concat("lang", F.lit("_"), "source"), F.lit("cafe\u0301s 日本語テキスト")).alias("name"),
        F.col("text").alias("content"),
        F.array("lang", "source").alias("pocket_tags"),
    )


SEARCH_FIELDS = ["name", "content", "pocket_tags"]

# The items' fields in SQL, their postings, and the statistics of both.
_SQL_FIELDS = (
    "fields AS (SELECT 'doc/' || doc_id AS url, 'name' AS field, " + _sql_tokens(_SQL_NAME) + " AS t FROM documents "
    "UNION ALL SELECT 'doc/' || doc_id, 'content', " + _sql_tokens("text") + " FROM documents "
    "UNION ALL SELECT 'doc/' || doc_id, 'pocket_tags', " + _sql_tokens("lang || ' ' || source") + " FROM documents)"
)
_SQL_INDEX = (
    f"{_SQL_FIELDS}, "
    "lengths AS (SELECT url, field, t, len(t) AS field_len FROM fields WHERE len(t) > 0), "
    "words AS (SELECT url, field, field_len, unnest(t) AS term FROM lengths), "
    "postings AS (SELECT term, field, url, CAST(count(*) AS INTEGER) AS tf, CAST(any_value(field_len) AS INTEGER) AS field_len "
    "FROM words GROUP BY term, field, url), "
    "stats AS (SELECT term, field, count(*) AS df FROM postings GROUP BY term, field), "
    "sizes AS (SELECT field, count(*) AS n_docs, avg(field_len) AS avg_len FROM lengths GROUP BY field)"
)
_BM25 = (
    "ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * field_len / avg_len))"
)

_indexes = {}


def document_index(spark, sf_dir):
    """The documents' stored index, written once per session and scale."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        path = work_folder(spark, "document_index")
        write_index(document_items(spark, sf_dir), path, SEARCH_FIELDS)
        _indexes[key] = path
    return read_index(spark, _indexes[key])


def _sql_hits(words, fields=None):
    """CTEs up to ``hits``; ``words`` are (group, word, term) or (group, word, term, distance limit)."""
    where = f"WHERE p.field IN ({', '.join(repr(f) for f in fields)})" if fields else ""
    matched = []
    for group, word, term, *limit in words:
        if limit:
            distance = f"damerau_levenshtein(term, '{term}')"
            matched.append(
                f"SELECT DISTINCT {group} AS grp, {word} AS word, term, "
                f"1.0::DOUBLE - {distance}::DOUBLE / least(length(term), {len(term)}) AS boost "
                f"FROM stats WHERE {distance} <= {limit[0]}"
            )
        else:
            matched.append(f"SELECT {group} AS grp, {word} AS word, '{term}' AS term, 1.0::DOUBLE AS boost")
    groups = len({w[0] for w in words})
    return (
        f"WITH {_SQL_INDEX}, matched AS ({' UNION ALL '.join(matched)}), "
        f"scored AS (SELECT p.url, grp, word, p.field, max(boost * {_BM25}) AS score FROM postings p "
        "JOIN matched USING (term) JOIN stats s ON s.term = p.term AND s.field = p.field "
        f"JOIN sizes z ON z.field = p.field {where} GROUP BY ALL), "
        "by_field AS (SELECT url, grp, field, sum(score) AS score FROM scored GROUP BY ALL), "
        "by_group AS (SELECT url, grp, max(score) AS score FROM by_field GROUP BY ALL), "
        f"hits AS (SELECT url, round(sum(score), 6) AS score FROM by_group GROUP BY url HAVING count(*) = {groups}), "
        "top AS (SELECT * FROM hits ORDER BY score DESC, url LIMIT 30)"
    )


_STANDOUT = (
    "CAST(row_number() OVER (ORDER BY score DESC, url) AS INTEGER) AS rank, url, score, "
    "score >= round(avg(score) OVER () + coalesce(stddev_samp(score) OVER (), 0), 6) AS is_standout, "
    "(SELECT count(*) FROM hits) AS total_hits FROM top"
)

ONE_TERM = ["and"]
WORDS_ONE_TERM = [(0, 0, "and")]
THREE_TERMS = ["the of", "en", "src1"]
WORDS_THREE_TERMS = [(0, 0, "the"), (0, 1, "of"), (1, 2, "en"), (2, 3, "src1")]


_SQL_TOKENS = _sql_tokens(f"text || ' ' || {_SQL_NAME}")


@check("an_tokens", f"SELECT doc_id, CAST(len({_SQL_TOKENS}) AS INTEGER) AS n_tokens, array_to_string({_SQL_TOKENS}, ' ') AS tokens FROM documents")
def an_tokens(spark, sf_dir):
    named = document_items(spark, sf_dir).select(F.regexp_extract("url", "[0-9]+", 0).cast("bigint").alias("doc_id"), "content", "name")
    words = named.select("doc_id", tokens(F.concat_ws(" ", "content", "name")).alias("t"))
    return words.select("doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


def stem_dictionary(spark, sf_dir):
    """A dictionary from the benchmark texts: every word with a plural or past ending → the word without it."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(tokens("text")).alias("token")).distinct()
    return words.withColumn("stem", F.regexp_replace("token", "(?:ed|s)\\z", "")).filter("stem <> token AND stem <> ''")


@check(
    "an_stem",
    f"WITH {_SQL_INDEX}, stems AS (SELECT token, stem FROM (SELECT DISTINCT token, regexp_replace(token, '(?:ed|s)\\z', '') AS stem "
    f"FROM (SELECT unnest({_sql_tokens('text')}) AS token FROM benchmark)) WHERE stem <> token AND stem <> '') "
    "SELECT coalesce(stem, term) AS term, field, url, CAST(sum(tf) AS INTEGER) AS tf, field_len FROM postings "
    "LEFT JOIN stems ON token = term GROUP BY ALL",
)
def an_stem(spark, sf_dir):
    postings = build_postings(document_items(spark, sf_dir), SEARCH_FIELDS)
    return stem_postings(postings, stem_dictionary(spark, sf_dir))


@check("idx_build", f"WITH {_SQL_INDEX} SELECT * FROM postings")
def idx_build(spark, sf_dir):
    return build_postings(document_items(spark, sf_dir), SEARCH_FIELDS)


@check(
    "idx_stats",
    f"WITH {_SQL_INDEX} SELECT term, field, df, n_docs, round(avg_len, 6) AS avg_len FROM stats JOIN sizes USING (field)",
)
def idx_stats(spark, sf_dir):
    items = document_items(spark, sf_dir)
    terms = term_stats(build_postings(items, SEARCH_FIELDS))
    fields = field_stats(items, SEARCH_FIELDS)
    # One row per field: a side bounded by the schema.
    return terms.join(F.broadcast(fields), "field").select(
        "term", "field", "df", "n_docs", F.round("avg_len", 6).alias("avg_len")
    )


BOOLEAN = ["(the AND of) OR une", "en fr NOT src1", "+src2~1 -src3"]


@check(
    "q_terms",
    f"WITH {_SQL_INDEX} SELECT url FROM postings GROUP BY url HAVING (bool_or(term = 'the') AND bool_or(term = 'of') OR bool_or(term = 'une')) "
    "AND bool_or(term IN ('en', 'fr')) AND NOT bool_or(term = 'src1') "
    "AND bool_or(damerau_levenshtein(term, 'src2') <= 1) AND NOT bool_or(term = 'src3')",
)
def q_terms(spark, sf_dir):
    return matching(document_index(spark, sf_dir), BOOLEAN)


@check("q_rank", _sql_hits(WORDS_THREE_TERMS) + " SELECT url, score FROM hits")
def q_rank(spark, sf_dir):
    return score_hits(document_index(spark, sf_dir), THREE_TERMS)


@check("q_default_fields", _sql_hits([(0, 0, "en")], ["pocket_tags", "content"]) + " SELECT url, score FROM hits")
def q_default_fields(spark, sf_dir):
    return score_hits(document_index(spark, sf_dir), ["en"], fields=["pocket_tags", "content"])


@check("q_topk", _sql_hits(WORDS_ONE_TERM) + " SELECT url, score FROM top")
def q_topk(spark, sf_dir):
    return best_hits(document_index(spark, sf_dir), ONE_TERM)


@check("agg_total", _sql_hits(WORDS_ONE_TERM) + " SELECT count(*) AS total_hits FROM hits")
def agg_total(spark, sf_dir):
    return count_hits(document_index(spark, sf_dir), ONE_TERM)


@check(
    "agg_mean_std",
    _sql_hits(WORDS_ONE_TERM)
    + " SELECT round(coalesce(avg(score), 0), 5) AS mean, round(coalesce(stddev_samp(score), 0), 5) AS deviation FROM top",
)
def agg_mean_std(spark, sf_dir):
    top = best_hits(document_index(spark, sf_dir), ONE_TERM)
    return top.agg(
        F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 5).alias("mean"),
        F.round(F.coalesce(F.stddev_samp("score"), F.lit(0.0)), 5).alias("deviation"),
    )


@check("win_standout", _sql_hits(WORDS_ONE_TERM) + f" SELECT {_STANDOUT}")
def win_standout(spark, sf_dir):
    return search(document_index(spark, sf_dir), ONE_TERM)


FUZZY = ["retitionign~ OR the", "srx1~1"]


@check(
    "q_fuzzy",
    _sql_hits([(0, 0, "retitionign", 2), (0, 1, "the"), (1, 2, "srx1", 1)]) + " SELECT url, score FROM hits",
)
def q_fuzzy(spark, sf_dir):
    return score_hits(document_index(spark, sf_dir), FUZZY)


# Titles from conversations: who speaks, the text, and nothing.
def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.expr("CASE WHEN turn % 2 = 0 THEN role ELSE ' ' END").alias("name"),
        F.expr("CASE WHEN turn % 3 = 0 THEN concat('Turn ', cast(turn AS string), chr(10), 'of ', cast(conv_id AS string)) END").alias("description"),
        F.col("text").alias("content"),
    )


def _sql_clean(c):
    return f"nullif({sql_strip('substring(replace(' + sql_strip(c) + ', chr(10), chr(32)), 1, 64)')}, '')"


_SQL_TURNS = (
    "(SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role ELSE ' ' END AS name, "
    "CASE WHEN turn % 3 = 0 THEN 'Turn ' || turn || chr(10) || 'of ' || conv_id END AS description, text AS content FROM conversations)"
)


def _sql_shorten(c):
    words = f"list_filter(list_transform(string_split({c}, ' '), lambda w: {sql_strip('w')}), lambda w: w <> '')"
    line = f"array_to_string({words}, ' ')"
    kept = f"regexp_extract({line}, '(?s)\\A(.{{1,54}}) ', 1)"
    return (
        f"CASE WHEN length({c}) <= 54 THEN {c} WHEN length({line}) <= 54 THEN {line} "
        f"WHEN {kept} <> '' THEN {kept} || '…' ELSE substring({line}, 1, 54) || '…' END"
    )


def _sql_title(source):
    return (
        f"WITH v AS (SELECT *, {_sql_clean('name')} AS a, {_sql_clean('description')} AS b, {_sql_clean('content')} AS c FROM {source}), "
        "ab AS (SELECT *, CASE WHEN length(a) >= 54 THEN a ELSE concat_ws(' - ', a, b) END AS x FROM v), "
        "abc AS (SELECT *, CASE WHEN length(x) >= 54 OR c IS NULL THEN x WHEN x = '' THEN c ELSE x || ' - ' || c END AS y FROM ab)"
    )


@check("out_value", f"SELECT conv_id, turn, coalesce({_sql_clean('name')}, {_sql_clean('description')}, '') AS value FROM {_SQL_TURNS}")
def out_value(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", display_value("name", "description").alias("value"))


@check("out_title", f"{_sql_title(_SQL_TURNS)} SELECT conv_id, turn, {_sql_shorten('y')} AS title FROM abc")
def out_title(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", display_title("name", "description", "content").alias("title"))


@check("out_shorten", f"SELECT doc_id, {_sql_shorten('text')} AS title FROM documents")
def out_shorten(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", shorten("text").alias("title"))


_SQL_DOCUMENT_TITLES = _sql_title(
    f"(SELECT 'doc/' || doc_id AS url, {_SQL_NAME} AS name, NULL AS description, text AS content FROM documents)"
)


@check(
    "out_line",
    _sql_hits(WORDS_THREE_TERMS)
    + f", result AS (SELECT {_STANDOUT}), "
    + _SQL_DOCUMENT_TITLES.removeprefix("WITH ")
    + f", titles AS (SELECT url, {_sql_shorten('y')} AS title FROM abc) "
    "SELECT rank, url, score, is_standout, title, '?' AS year, "
    "'(?) ' || printf('%.1f', score) || CASE WHEN is_standout THEN '★' ELSE '' END || ' ' || title || ': ' || url AS line, total_hits "
    "FROM result JOIN titles USING (url)",
)
def out_line(spark, sf_dir):
    no_text = F.lit(None).cast("string")
    items = document_items(spark, sf_dir).withColumns(
        {"description": no_text, "last_update": no_text, "article_published_date": no_text}
    )
    return present(search(document_index(spark, sf_dir), THREE_TERMS), items)
