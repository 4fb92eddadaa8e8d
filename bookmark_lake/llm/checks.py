"""One registered query for each operator over its whole table, and the SQL it must agree with."""

from pyspark.sql import functions as F

from . import (
    bloom_cascade,
    fill_middle,
    jaccard_join,
    language,
    lempel_ziv,
    merkle,
    packing,
    periodic,
    pieces,
    quality,
    secrets,
    suffix_array,
    wu_manber,
)
from .arrays import stored

QUERIES = {}
SQL = {}


def check(name, sql=None):
    def register(query):
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return register


def table(spark, sf_dir, name, *columns):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


_WORD10 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@check("op1_quality")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = language.held_out(F.col("doc_id"))
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").filter(~out)
    scored = quality.classify(docs, quality.train(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted")


@check("op2_language")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    out = language.held_out(F.col("doc_id"))
    model = language.train(docs.filter(~out).select("text", "lang"))
    return language.identify(docs, model, keep=["doc_id"]).select("doc_id", out.alias("held_out"), "lang_pred", "score")


@check(
    "op3_bloom_cascade",
    f"""
    WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{_URL}', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '{_URL}', 2) AS path FROM pages),
    r AS (SELECT *, CASE WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
    SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
    """,
)
def op3(spark, sf_dir):
    rows = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(r, ("host", "path", "action"), strict=True))) for r in _RULES))
    rules = spark.range(1).select(F.inline(rows))
    return bloom_cascade.judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), rules).drop("url")


@check("op4_secrets")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] != "model")
    return found.select(
        "doc_id",
        *(secrets.count_kind(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(secrets.written(base), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
    )


@check(
    "op5_jaccard_join",
    rf"""
    WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({{_FOLD}}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    g AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS sh FROM g),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (sh)
          WHERE a.doc_id < b.doc_id GROUP BY ALL),
    l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
    e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, m AS component_id FROM d LEFT JOIN n USING (doc_id)
    JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) USING (doc_id)
    """.replace("{_FOLD}", _FOLD),
)
def op5(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"))


@check("op6_pieces")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pieces.encode(docs, decoded=True).select(
        "doc_id",
        "n_pieces",
        F.xxhash64("ids").alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )


@check(
    "op7_suffix_array",
    """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    b AS (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS i FROM d),
    w AS (SELECT doc_id, i, h[2 * i + 1:2 * i + 2] AS byte,
            CASE WHEN 2 * i + 800 <= len(h) THEN md5(substring(h, 2 * i + 1, 800)) END AS win FROM b),
    c AS (SELECT doc_id, i, byte, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS again FROM w),
    g AS (SELECT doc_id, i, byte, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i
            ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) AS gone FROM c),
    e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM g),
    k AS (SELECT doc_id, count_if(gone) AS n_removed, count_if(begins) AS n_spans,
            string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
    SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
           CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
    FROM d LEFT JOIN k USING (doc_id)
    """,
)
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    left = suffix_array.remove_repeats(docs, keep=["doc_id"])
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@check(
    "op8_lempel_ziv",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    g AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d),
    h AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS win FROM g),
    dup AS (SELECT doc_id, i FROM (
        SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS r FROM h) WHERE r > 1),
    hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM dup),
    w AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
    k AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS kept
          FROM w ANTI JOIN hit USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed,
           sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN k USING (doc_id)
    """,
)
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    left = lempel_ziv.remove_factors(docs, keep=["doc_id"])
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@check(
    "op9_merkle",
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n FROM documents),
    o AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS nxt FROM d
          WINDOW w AS (ORDER BY doc_id NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    e AS (SELECT doc_id, n, text, nxt, left(text, n - n // 2) || left(nxt, n // 2) AS edited FROM o),
    t AS (SELECT doc_id, 'own' AS k, text AS t FROM e UNION ALL SELECT doc_id, 'edited', edited FROM e
          UNION ALL SELECT doc_id, 'next', nxt FROM e),
    l AS (SELECT doc_id, k, list_transform(string_split(t, chr(10) || chr(10)), lambda s:
            list_transform(string_split(s, chr(10)), lambda p:
              list_transform(string_split(p, '. '), lambda x, i:
                sha256('l' || x || CASE WHEN i < len(string_split(p, '. ')) THEN '. ' ELSE '' END)))) AS tree FROM t),
    p AS (SELECT doc_id, k, tree, list_transform(tree, lambda s: list_transform(s, lambda q:
            {'d': sha256('p' || array_to_string(q, '')), 'l': q})) AS ps FROM l),
    r AS (SELECT doc_id, k, tree, list_transform(ps, lambda s:
            {'d': sha256('s' || array_to_string(list_transform(s, lambda q: q.d), '')), 'p': s}) AS ss FROM p),
    f AS (SELECT doc_id, k, list_distinct(list_transform(flatten(flatten(tree)), lambda x: x[1:12])) AS leaves,
            sha256('r' || array_to_string(list_transform(ss, lambda s: s.d), '')) || '/' ||
            array_to_string(list_transform(ss, lambda s: s.d[1:12] || ':' ||
              array_to_string(list_transform(s.p, lambda q: q.d[1:12] || '=' ||
                array_to_string(list_transform(q.l, lambda x: x[1:12]), '.')), ',')), ';') AS print FROM r),
    m AS (SELECT a.doc_id, a.print AS fingerprint, b.print AS edited_fingerprint,
            CASE WHEN a.print[1:64] = b.print[1:64] THEN 1.0 ELSE
              len(list_intersect(a.leaves, b.leaves)) / greatest(len(a.leaves), len(b.leaves)) END AS near_edited,
            CASE WHEN a.print[1:64] = c.print[1:64] THEN 1.0 ELSE
              len(list_intersect(a.leaves, c.leaves)) / greatest(len(a.leaves), len(c.leaves)) END AS near_next
          FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.k = 'own' AND b.k = 'edited'
          JOIN f c ON a.doc_id = c.doc_id AND c.k = 'next')
    SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
           CAST(near_edited AS DOUBLE) AS near_edited, CAST(near_next AS DOUBLE) AS near_next
    FROM e JOIN m USING (doc_id)
    """,
)
def op9(spark, sf_dir):
    return merkle.fingerprint_edits(table(spark, sf_dir, "documents", "doc_id", "text"))


@check(
    "op10_wu_manber",
    f"""
    WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_WORD10}') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all({_FOLD}, '{_WORD10}') AS w FROM benchmark),
    iw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (
        SELECT item_id, w, least(len(w), 10) AS k,
               unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
    dw AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
    dk AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
           FROM dw, (SELECT DISTINCT k FROM iw) WHERE i + k - 1 <= len(w)),
    m AS (SELECT doc_id, i, k, item_id FROM dk JOIN iw USING (k, win)),
    hit AS (SELECT doc_id, count(*) AS n_hit FROM (
        SELECT DISTINCT doc_id, unnest(range(i, i + k)) FROM m) GROUP BY doc_id),
    it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (
        SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
           coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
    """,
)
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = wu_manber.find_benchmark(docs, table(spark, sf_dir, "benchmark", "item_id", "text"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        wu_manber.items_digest("items").alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@check(
    "op11_fill_middle",
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('1:', doc_id)) AS s FROM documents),
    h AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u,
            list_transform(range(4), lambda i: CAST('0x' || s[8 * i + 1:8 * i + 8] AS BIGINT)) AS h FROM d),
    c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, h[1] % (len(u) + 1) AS a, h[2] % (len(u) + 1) AS b,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                 WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
    p AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS pre, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS mid,
            array_to_string(u[greatest(a, b) + 1:], '') AS suf FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                            ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
           sha256(t) AS restored_sha256 FROM p
    """,
)
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    turned = fill_middle.fill_in_middle(docs, keep=["doc_id"], restored=True)
    return turned.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


@check("op12_packing")
def op12(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
    # the contract asks for no ids, so only their checksums are stored
    cut = cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.place(stored(cut, "packed_pieces"))


@check(
    "op13_periodic",
    r"""
    WITH w0 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
            xor(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x:
                CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END, 4294967295),
              4294967295) AS h FROM documents),
    w1 AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n, h % 10 = 0 AND len(w) > 0 AS looped, h // 10 AS g FROM w0),
    w2 AS (SELECT *, g % greatest(n, 1) AS a FROM w1),
    w3 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM w2),
    d AS MATERIALIZED (SELECT doc_id, n, CASE WHEN looped THEN list_transform(range(n), lambda i:
            w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE w END AS w FROM w3),
    g AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i + 1:i + 6], ' ') AS gram
          FROM (SELECT doc_id, w, unnest(range(n - 5)) AS i FROM d)),
    same AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i),
    isl AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM same),
    st AS MATERIALIZED (SELECT doc_id, q, min(i) AS s, min(i) + count(*) + 5 + q AS e FROM isl GROUP BY doc_id, q, k
          HAVING count(*) + 5 >= greatest(q, 12 - q)),
    r AS MATERIALIZED (SELECT doc_id, s AS start, e - s AS length, q AS period FROM st WHERE NOT EXISTS (
          SELECT 1 FROM st o WHERE o.doc_id = st.doc_id AND o.q < st.q AND o.s <= st.s AND o.e >= st.e)),
    gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM (
          SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM d) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
    tot AS (SELECT doc_id, count(*) AS n_runs, first(r ORDER BY length DESC, start, period) AS best,
            string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM r GROUP BY doc_id)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
           1000 * best.length // best.period AS exponent_milli, sha256(coalesce(tot.t, '')) AS runs_sha256,
           sha256(coalesce(kept.t, '')) AS collapsed_sha256
    FROM d LEFT JOIN tot USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
)
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    seed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = periodic.find_periodic(docs, keep=["doc_id"], loop_seed=seed)
    best = F.col("best")
    return found.withColumn("best", periodic.longest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(best[c].alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(periodic.written(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
