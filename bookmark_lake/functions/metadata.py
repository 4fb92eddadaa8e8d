"""Tags and publication dates from structured page metadata.

METADATA is a struct ``json_ld ARRAY<VARIANT>``, ``rdfa ARRAY<STRUCT<key, value>>``,
``microdata MAP<STRING,VARIANT>``, ``opengraph MAP<STRING,VARIANT>``, ``broken BOOLEAN``.
It is read from the page, or supplied by the caller as a column of that shape.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import parse_date
from .tags import normalise_tag, tag_list, tag_set
from .text import decode_entities
from .urls import base_url, url_equal, without_comments
from .values import col, let, non_empty, reusable

# Vocabularies behind the usual prefixes of <meta property="…">.
PREFIXES = {
    "og": "http://ogp.me/ns#",
    "article": "http://ogp.me/ns/article#",
    "video": "http://ogp.me/ns/video#",
    "book": "http://ogp.me/ns/book#",
}
# Properties that carry tags, and the publication date, in reading
# order; each counts under http and https.
TAG_PROPERTIES = [
    "ogp.me/ns/article#tag",
    "ogp.me/ns/article#tags",
    "ogp.me/ns/video#tag",
    "ogp.me/ns#tags",
    "ogp.me/ns#tag",
    "ogp.me/ns/book#tag",
]
DATE_PROPERTY = "ogp.me/ns/article#published_time"

_STRINGS = "array<string>"
_VARIANTS = "array<variant>"

_LD_JSON = (
    r"""(?is)<script\b[^>]*?\btype\s*=\s*["']?application/ld\+json\b[^>]*>(.*?)</script\s*>"""
)
# Loops over groups are possessive here and below: the matcher then counts turns instead of recursing.
_META = r"""(?is)<meta\s((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
_ATTRIBUTE = r"""(?is)(?:\A|\s){}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
_PREFIX_ATTRIBUTE = r"""(?is)<(?:html|head|body)\b[^>]*?\sprefix\s*=\s*("[^"]*"|'[^']*')"""


def _none(kind=_STRINGS) -> Column:
    return F.array().cast(kind)


def _unquote(c) -> Column:
    return F.regexp_replace(c, "\\A[\"']|[\"']\\z", "")


def _attribute(attributes, name) -> Column:
    return decode_entities(_unquote(F.regexp_extract(attributes, _ATTRIBUTE.format(name), 1)))


def elements(v) -> Column:
    """A JSON list as its elements, anything else as the only element."""
    single = lambda v: F.when(v.isNotNull() & ~F.is_variant_null(v), F.array(v))
    return let(
        v, lambda v: F.coalesce(F.try_variant_get(v, "$", _VARIANTS), single(v), _none(_VARIANTS))
    )


def _present(variants) -> Column:
    return F.filter(variants, lambda v: v.isNotNull() & ~F.is_variant_null(v))


def _parsed_blocks(plain) -> Column:
    blocks = F.regexp_extract_all(plain, F.lit(_LD_JSON), F.lit(1))
    return F.transform(blocks, lambda b: F.try_parse_json(b))


def _block_elements(parsed) -> Column:
    return _present(F.flatten(F.transform(parsed, lambda v: elements(v))))


def json_ld(html) -> Column:
    """Elements of all JSON-LD blocks that parse."""
    return _block_elements(_parsed_blocks(without_comments(html)))


def _written_out(prop, declared, defaults) -> Column:
    """A property with its prefix replaced by the vocabulary the page declares, else the usual one."""
    prefix, local = F.split_part(prop, F.lit(":"), F.lit(1)), F.regexp_replace(prop, r"\A[^:]*:", "")
    own = F.get(
        F.filter(declared, lambda d: F.split_part(d, F.lit(":"), F.lit(1)) == prefix), F.lit(0)
    )
    vocabulary = F.coalesce(
        F.regexp_replace(own, r"\A[\w-]+:\s+", ""), F.try_element_at(defaults, prefix)
    )
    return F.coalesce(F.concat(vocabulary, local), prop)


def _rdfa_pairs(plain) -> Column:
    defaults = F.create_map(*[F.lit(x) for pair in PREFIXES.items() for x in pair])
    declared = F.regexp_extract_all(
        F.array_join(F.regexp_extract_all(plain, F.lit(_PREFIX_ATTRIBUTE), F.lit(1)), " "),
        F.lit(r"([\w-]+:\s+[^\s\"']+)"),
        F.lit(1),
    )
    metas = F.regexp_extract_all(plain, F.lit(_META), F.lit(1))
    metas = F.filter(metas, lambda a: a.rlike(r"(?i)(?:\A|\s)property\s*=") & a.rlike(r"(?i)(?:\A|\s)content\s*="))
    # Bound outside the loop over the tags: a lambda evaluates its body for each element.
    pairs = let(
        declared,
        lambda declared: F.transform(
            metas,
            lambda a: F.struct(
                let(_attribute(a, "property"), lambda p: _written_out(p, declared, defaults)).alias("key"),
                _attribute(a, "content").alias("value"),
            ),
        ),
    )
    return F.filter(pairs, lambda p: p["key"] != "")


def rdfa(html) -> Column:
    """(key, value) of every <meta property content>, prefixes written out."""
    return let(without_comments(html), _rdfa_pairs)


@reusable
def extract_metadata(html) -> Column:
    """METADATA of a page."""
    no_map = F.lit(None).cast("map<string,variant>")
    pairs = "array<struct<key:string,value:string>>"

    def found(plain):
        has_meta = plain.rlike(r"(?i)<meta\b[^>]*\sproperty\s*=")
        has_json = F.contains(F.lower(plain), F.lit("ld+json"))
        blocks = F.when(has_json, _parsed_blocks(plain)).otherwise(_none(_VARIANTS))
        return F.struct(
            let(
                blocks,
                lambda b: F.struct(
                    _block_elements(b).alias("json_ld"), F.exists(b, lambda v: v.isNull()).alias("broken")
                ),
            ).alias("json"),
            F.when(has_meta, _rdfa_pairs(plain)).otherwise(_none(pairs)).alias("rdfa"),
        )

    return let(
        let(without_comments(html), found),
        lambda m: F.struct(
            m["json"]["json_ld"].alias("json_ld"),
            m["rdfa"].alias("rdfa"),
            no_map.alias("microdata"),
            no_map.alias("opengraph"),
            m["json"]["broken"].alias("broken"),
        ),
    )


def _text(v, path="$") -> Column:
    """A JSON string; NULL for every other JSON type."""
    is_string = F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING"
    return F.when(is_string, F.try_variant_get(v, path, "string"))


def _raw_tags(v) -> Column:
    """A keywords value as raw tags: a list of them or one comma-separated string."""
    as_list = F.transform(F.try_variant_get(v, "$", _VARIANTS), lambda e: _text(e))
    return F.coalesce(as_list, F.split(_text(v), ",", -1), _none())


def _json_ld_raw(json_ld_column) -> Column:
    raw = lambda e, path: _raw_tags(F.try_variant_get(e, path, "variant"))
    per_element = F.transform(
        _present(col(json_ld_column)),
        lambda e: F.concat(raw(e, "$.keywords"), raw(e, "$.mainEntity.keywords")),
    )
    return F.coalesce(F.flatten(per_element), _none())


def json_ld_tags(json_ld_column) -> Column:
    """keywords, then mainEntity.keywords, of each JSON-LD element."""
    return tag_list(_json_ld_raw(json_ld_column))


def _rdfa_values(pairs, properties) -> Column:
    """Values of the properties, in their order, each under http, then https."""
    keys = F.array(*[F.lit(f"{scheme}://{p}") for p in properties for scheme in ("http", "https")])
    found = let(
        pairs, lambda ps: F.flatten(F.transform(keys, lambda k: F.filter(ps, lambda p: p["key"] == k)))
    )
    return F.coalesce(F.transform(found, lambda p: p["value"]), _none())


def rdfa_tags(rdfa_column, preprocess=normalise_tag) -> Column:
    """Tag properties in their fixed order; ``preprocess`` turns a value into an array of tags."""
    values = F.array_compact(_rdfa_values(rdfa_column, TAG_PROPERTIES))
    return F.flatten(F.transform(values, lambda v: preprocess(v)))


def _map_raw(map_column, key) -> Column:
    return _raw_tags(F.try_element_at(col(map_column), F.lit(key)))


def microdata_tags(microdata) -> Column:
    return tag_list(_map_raw(microdata, "keywords"))


def opengraph_tags(opengraph) -> Column:
    return tag_list(_map_raw(opengraph, "article:tag"))


def metadata_tags(metadata) -> Column:
    """Tags of all four kinds of metadata, in that order, repeats kept."""
    m = col(metadata)
    return tag_list(
        F.concat(
            _json_ld_raw(m["json_ld"]),
            _rdfa_values(m["rdfa"], TAG_PROPERTIES),
            _map_raw(m["microdata"], "keywords"),
            _map_raw(m["opengraph"], "article:tag"),
        )
    )


def json_ld_matches(element, url, match_by_default=False) -> Column:
    """Does the element describe this page, by its url, else its @id?"""
    has = lambda path: F.try_variant_get(element, path, "variant").isNotNull()
    address = F.when(has("$.url"), _text(element, "$.url")).otherwise(_text(element, "$['@id']"))
    default = F.lit(match_by_default) if isinstance(match_by_default, bool) else match_by_default
    return F.when(
        has("$.url") | has("$['@id']"), F.coalesce(url_equal(address, col(url)), F.lit(False))
    ).otherwise(default)


def _dated_elements(json_ld_column) -> Column:
    """Elements that may carry a date: each one (matching unless it says otherwise), then its @graph."""
    graph = lambda e: _present(
        F.coalesce(F.try_variant_get(e, "$['@graph']", _VARIANTS), _none(_VARIANTS))
    )
    entry = lambda e, top: F.struct(
        e.alias("e"), F.try_variant_get(e, "$.datePublished", "variant").alias("date"), F.lit(top).alias("top")
    )
    all_entries = F.flatten(
        F.transform(
            _present(col(json_ld_column)),
            lambda e: F.concat(
                F.array(entry(e, True)), F.transform(graph(e), lambda g: entry(g, False))
            ),
        )
    )
    return F.filter(all_entries, lambda x: x["date"].isNotNull())


def published_candidates(metadata, url) -> Column:
    """Date strings in the order they are tried."""
    m = col(metadata)
    matching = F.filter(
        _dated_elements(m["json_ld"]), lambda x: json_ld_matches(x["e"], url, x["top"])
    )
    from_json = F.flatten(
        F.transform(matching, lambda x: F.transform(elements(x["date"]), lambda d: _text(d)))
    )
    return F.concat(_rdfa_values(m["rdfa"], [DATE_PROPERTY]), F.coalesce(from_json, _none()))


def published_date(metadata, url) -> Column:
    """First candidate that is a date, as an ISO string."""
    parsed = F.transform(published_candidates(metadata, url), lambda c: parse_date(c))
    return F.get(F.array_compact(parsed), F.lit(0))


@reusable
def article_tags(metadata) -> Column:
    m = col(metadata)
    return F.when(~F.coalesce(m["broken"], F.lit(False)), tag_set(metadata_tags(m)))


@reusable
def article_published_date(metadata, html, url) -> Column:
    m = col(metadata)
    return F.when(
        ~F.coalesce(m["broken"], F.lit(False)), non_empty(published_date(m, base_url(html, url)))
    )
