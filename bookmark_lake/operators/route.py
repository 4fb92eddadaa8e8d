"""Routing: the first rule that fits a link takes it over.

Few rules, registered in code, become one CASE expression evaluated inside the scan of the
requests: no join, no ranking window and no shuffle, whatever the number of requests.

Any number of rules may stand in a RULE table, to which each source adds its own. Requests then
meet the rules of their host in one equi join; the patterns are tested on these only, in order of
registration. Rules that name no host are tested on every request.
"""

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import escaped
from ..functions.values import map_merge
from ..schema import REQUEST
from ..sources.github import API_HEADERS
from ..sources.responses import request_key
from .generations import current
from .merge import add_batch


@dataclass(frozen=True)
class Output:
    """One request that a rule makes.

    In its texts ``{1}``, ``{2}`` stand for groups of the rule's pattern, ``{%1}`` for a group with
    reserved characters escaped, ``{url}`` for the URL.
    """

    kind: str
    url: str
    meta: dict = field(default_factory=dict)
    headers: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Rule:
    """Links matching ``pattern`` belong to source ``owner``; excluded first groups do not."""

    owner: str
    pattern: str
    outputs: tuple
    exclude_group1: tuple = ()
    #: Hosts of the links that ``pattern`` can match, as written there; none: any host.
    hosts: tuple = ()


def register_rule(rules, rule) -> list:
    """Rules in registration order with ``rule`` at the end."""
    return [*rules, rule]


_STRINGS = "map<string,string>"
_OUT = (
    "array<struct<kind:string,method:string,url:string,body:string,"
    "headers:map<string,string>,meta:map<string,string>>>"
)


_PART = "struct<text: string, group: int, escape: boolean>"
_URL_GROUP = 0


def _parts(template) -> list:
    """(text, group, escape) of the pieces of a template."""
    parts = []
    for piece in re.split(r"(\{%?\d+\}|\{url\})", template):
        if piece == "{url}":
            parts.append((None, _URL_GROUP, False))
        elif re.fullmatch(r"\{%?\d+\}", piece):
            parts.append((None, int(piece.strip("{%}")), piece[1] == "%"))
        elif piece:
            parts.append((piece, None, False))
    return parts


def _group(pattern, n) -> Column:
    return F.regexp_extract("url", pattern, n)


def _fill(template, pattern) -> Column:
    """Template with its parts filled from the matched URL."""
    filled = [F.lit("")]
    for text, group, escape in _parts(template):
        if text is not None:
            filled.append(F.lit(text))
        else:
            value = F.col("url") if group == _URL_GROUP else _group(pattern, group)
            filled.append(escaped(value) if escape else value)
    return F.concat(*filled)


def _map(values, pattern) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), _fill(v, pattern))]
    return (F.create_map(*pairs) if pairs else F.create_map()).cast(_STRINGS)


def _matches(rule) -> Column:
    fits = F.col("url").rlike(rule.pattern) & (F.col("source") != rule.owner)
    if rule.exclude_group1:
        fits = fits & ~_group(rule.pattern, 1).isin(list(rule.exclude_group1))
    return fits


def _request(kind, method, url, body, headers, meta) -> Column:
    columns = {"kind": kind, "method": method, "url": url, "body": body, "headers": headers, "meta": meta}
    return F.struct(*[c.alias(name) for name, c in columns.items()])


def _replacements(rule) -> Column:
    """The outputs of a rule; old metadata stays where the new request sets none."""
    outputs = [
        _request(
            F.lit(o.kind),
            F.lit("GET"),
            _fill(o.url, rule.pattern),
            F.lit(""),
            _map(o.headers, rule.pattern),
            map_merge(_map(o.meta, rule.pattern), "meta"),
        )
        for o in rule.outputs
    ]
    return F.array(*outputs).cast(_OUT)


def route(requests: DataFrame, rules) -> DataFrame:
    """Replace each request by the outputs of the first rule that fits it.

    Rules owned by the request's own source are skipped; a request no rule fits
    stays as it is. One pass over the requests, each exploding into what it becomes.
    """
    names = [f.name for f in REQUEST.fields]
    itself = F.array(_request(*[F.col(c) for c in ("kind", "method", "url", "body", "headers", "meta")]))
    outcome = itself.cast(_OUT)
    for rule in reversed(rules):
        outcome = F.when(_matches(rule), _replacements(rule)).otherwise(outcome)
    routed = requests.select("source", "parent_seq", "pos", F.inline(outcome))
    return routed.withColumn("request_key", request_key()).select(*names)


RULE = (
    "priority long, owner string, host string, pattern string, exclude_group1 array<string>, "
    f"outputs array<struct<kind: string, url: array<{_PART}>, headers: map<string, array<{_PART}>>, meta: map<string, array<{_PART}>>>>"
)
#: Stands for any host in a RULE table.
ANY_HOST = "*"


def rule_rows(spark, rules, first=0) -> DataFrame:
    """RULE rows of some rules: one for each host, in order of registration from ``first`` on."""
    filled = lambda texts: {k: _parts(v) for k, v in texts.items()}
    rows = []
    for n, rule in enumerate(rules, first):
        outputs = [(o.kind, _parts(o.url), filled(o.headers), filled(o.meta)) for o in rule.outputs]
        rows += [(n, rule.owner, host, rule.pattern, list(rule.exclude_group1), outputs) for host in rule.hosts or (ANY_HOST,)]
    return spark.createDataFrame(rows, RULE)


def add_rules(spark, path, rules):
    """Add a source's rules to the stored table; they come behind those that are there."""
    last = read_rules(spark, path).agg(F.max("priority")).first()[0]
    add_batch(rule_rows(spark, rules, 0 if last is None else last + 1), path)


def read_rules(spark, path) -> DataFrame:
    folders = current(spark, path)
    return spark.read.schema(RULE).parquet(*folders) if folders else spark.createDataFrame([], RULE)


def _extracted(pattern, group) -> Column:
    return F.call_function("regexp_extract", F.col("url"), pattern, group)


def _first_fit(candidates) -> Column:
    """The first of the candidate rules that fits the request, by priority."""

    def fits(rule):
        mine = F.col("url").isNotNull() & F.regexp_like(F.col("url"), rule["pattern"]) & (rule["owner"] != F.col("source"))
        excluded = F.size(rule["exclude_group1"]) > 0
        return mine & ~(excluded & F.array_contains(rule["exclude_group1"], _extracted(rule["pattern"], F.lit(1))))

    return F.get(F.filter(candidates, fits), F.lit(0))


def _outputs_of(rule) -> Column:
    """The requests that a rule from the table makes of the request."""

    def text(parts):
        def part(p):
            value = F.when(p["group"] == _URL_GROUP, F.col("url")).otherwise(_extracted(rule["pattern"], p["group"]))
            return F.when(p["text"].isNotNull(), p["text"]).when(p["escape"], escaped(value)).otherwise(value)

        return F.array_join(F.transform(parts, part), "")

    def texts(named):
        return F.map_from_entries(F.transform(F.map_entries(named), lambda e: F.struct(e["key"], text(e["value"]))))

    def output(o):
        return _request(o["kind"], F.lit("GET"), text(o["url"]), F.lit(""), texts(o["headers"]), map_merge(texts(o["meta"]), "meta"))

    return F.transform(rule["outputs"], output)


def route_by_table(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """``route`` with the rules of a RULE table: one join on the host, whatever their number."""
    names = [f.name for f in REQUEST.fields]
    one = F.struct("priority", "owner", "pattern", "exclude_group1", "outputs")
    in_order = lambda c: F.array_sort(c, lambda a, b: (a["priority"] - b["priority"]).cast("int"))
    # as many rules as are registered for a host
    by_host = rules.groupBy("host").agg(F.collect_list(one).alias("own_rules"))
    anywhere = by_host.filter(F.col("host") == ANY_HOST).select(F.col("own_rules").alias("all_rules"))
    by_host = by_host.filter(F.col("host") != ANY_HOST).withColumnRenamed("host", "rule_host")
    host = F.regexp_extract("url", r"^https?://([^/?#:]*)", 1)
    met = requests.join(by_host, host == F.col("rule_host"), "left").withColumn("all_rules", anywhere.scalar())
    none = F.array().cast(by_host.schema["own_rules"].dataType)
    candidates = in_order(F.concat(F.coalesce("own_rules", none), F.coalesce("all_rules", none)))
    chosen = met.select(*names, _first_fit(candidates).alias("rule"))
    itself = F.array(_request(*[F.col(c) for c in ("kind", "method", "url", "body", "headers", "meta")])).cast(_OUT)
    outcome = F.when(F.col("rule").isNull(), itself).otherwise(_outputs_of(F.col("rule")).cast(_OUT))
    routed = chosen.select("source", "parent_seq", "pos", F.inline(outcome))
    return routed.withColumn("request_key", request_key()).select(*names)


# Links that the repository services take over, in this order.
GIST_RULE = Rule(
    owner="github_stars",
    pattern=r"^https?://gist\.github\.com/([^/]+)/([^/]+)/?$",
    outputs=(
        Output(
            "gist",
            "https://api.github.com/gists/{2}",
            meta={
                "item_url": "https://gist.github.com/{1}/{2}",
                "dont_obey_robotstxt": "true",
            },
            headers=API_HEADERS,
        ),
    ),
    hosts=("gist.github.com",),
)
GITHUB_RULE = Rule(
    owner="github_stars",
    pattern=r"^https?://(?:www\.)?github\.com/([^/]+)/([^/]+)/?$",
    outputs=(
        Output(
            "github_repo",
            "https://api.github.com/repos/{1}/{2}",
            meta={
                "item_url": "https://github.com/{1}/{2}",
                "dont_obey_robotstxt": "true",
            },
            headers=API_HEADERS,
        ),
    ),
    hosts=("github.com", "www.github.com"),
)
GITLAB_RULE = Rule(
    owner="gitlab_stars",
    pattern=r"^https?://(?:www\.)?gitlab\.com/([^/]+)/([^/]+)/?$",
    outputs=(
        Output(
            "gitlab_project",
            "https://gitlab.com/api/v4/projects/{%1}%2F{%2}",
            meta={"url": "{url}", "dont_obey_robotstxt": "true"},
        ),
    ),
    exclude_group1=("users",),
    hosts=("gitlab.com", "www.gitlab.com"),
)
DEFAULT_RULES = [GIST_RULE, GITHUB_RULE, GITLAB_RULE]
