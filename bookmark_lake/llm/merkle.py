"""Document fingerprints: a Merkle tree over sections and paragraphs, in built-in functions only.

Sections are parted by ``\\n\\n``, paragraphs by ``\\n``, and a paragraph by ``". "`` into
sentences, the leaves. A node is the SHA-256 of its kind and its children's digests, so equal roots
mean equal texts, and where two roots differ, only branches with differing digests need be followed
to the edit. The fingerprint is the root, then the tree in short digests: sections parted by ``;``,
each ``section:paragraph=leaf.leaf,paragraph=leaf``.

A null text is an empty one. Every text has at least one section, paragraph and sentence.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import let

#: Hex digits of a digest below the root that the fingerprint keeps.
SHORT = 12


def _node(kind, children: Column) -> Column:
    return F.sha2(F.concat(F.lit(kind), F.array_join(children, "")), 256)


def tree(text: Column) -> Column:
    """array<struct<digest, paragraphs: array<struct<digest, leaves: array<string>>>>> of a text."""

    def paragraph(p):
        leaves = F.transform(F.split(p, r"(?<=\. )"), lambda s: F.sha2(F.concat(F.lit("l"), s), 256))
        return F.struct(leaves.alias("leaves"))

    def hashed_paragraph(p):
        return F.struct(_node("p", p["leaves"]).alias("digest"), p["leaves"].alias("leaves"))

    def section(s):
        paragraphs = F.transform(F.transform(F.split(s, "\n"), paragraph), hashed_paragraph)
        return F.struct(paragraphs.alias("paragraphs"))

    def hashed_section(s):
        digests = F.transform(s["paragraphs"], lambda p: p["digest"])
        return F.struct(_node("s", digests).alias("digest"), s["paragraphs"].alias("paragraphs"))

    return F.transform(F.transform(F.split(text, "\n\n"), section), hashed_section)


def root(nodes: Column) -> Column:
    return _node("r", F.transform(nodes, lambda s: s["digest"]))


def fingerprint(nodes: Column) -> Column:
    """The root and, in short digests, the tree below it."""

    def short(digest):
        return F.substring(digest, 1, SHORT)

    def paragraph(p):
        return F.concat(short(p["digest"]), F.lit("="), F.array_join(F.transform(p["leaves"], short), "."))

    def section(s):
        return F.concat(short(s["digest"]), F.lit(":"), F.array_join(F.transform(s["paragraphs"], paragraph), ","))

    return F.concat(root(nodes), F.lit("/"), F.array_join(F.transform(nodes, section), ";"))


def leaves(print_: Column) -> Column:
    """The distinct short leaf digests of a fingerprint."""
    body = F.regexp_replace(F.substring_index(print_, "/", -1), r"[0-9a-f]+[:=]", "")
    return F.array_distinct(F.split(body, "[.,;]"))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else the shared share of the larger set of leaves."""
    own, other = leaves(a), leaves(b)
    shared = F.size(F.array_intersect(own, other)) / F.greatest(F.size(own), F.size(other))
    return F.when(F.substring_index(a, "/", 1) == F.substring_index(b, "/", 1), F.lit(1.0)).otherwise(shared)


def _paragraphs(section: Column) -> Column:
    """Short digests of a written section's paragraphs, the first one marked: a break that goes is an edit."""
    digests = F.transform(F.split(F.substring_index(section, ":", -1), ","), lambda p: F.substring_index(p, "=", 1))
    return F.transform(digests, lambda d, i: F.when(i == 0, F.concat(d, F.lit("*"))).otherwise(d))


def _differing(own: Column, other: Column, key) -> Column:
    """(first, number) of the children between the equal ones in front and the equal ones behind."""
    least = F.least(F.size(own), F.size(other))

    def equal(a, b):
        pairs = F.slice(F.arrays_zip(a.alias("a"), b.alias("b")), 1, least)
        differs = F.array_position(F.transform(pairs, lambda p: key(p["a"]) != key(p["b"])), True).cast("int")
        return F.when(differs > 0, differs - 1).otherwise(least)

    front = equal(own, other)
    back = F.least(equal(F.reverse(own), F.reverse(other)), least - front)
    return F.struct(front.alias("first"), (F.size(own) - front - back).alias("number"), (F.size(other) - front - back).alias("others"))


def edits(a: Column, b: Column) -> Column:
    """Where two fingerprints differ: array of (side, section, paragraph, kind); empty for equal roots only.

    Both trees are walked from the root. Equal sections in front and behind are passed by their
    digests alone; of those between, the paragraphs are aligned in the same way. A paragraph that
    remains has moved if the other side has it among its own, else it has changed if the paragraph
    at its place remains too, else it is ``deleted`` (side a) or ``inserted`` (side b). ``section``
    and ``paragraph`` count from 0 on their side.
    """

    def sections(print_):
        return F.split(F.substring_index(print_, "/", -1), ";")

    def digest(section):
        return F.substring_index(section, ":", 1)

    def placed(parts, first, number):
        between = F.slice(parts, first + 1, number)
        rows = F.transform(
            between,
            lambda s, i: F.transform(
                _paragraphs(s), lambda d, j: F.struct((first + i).alias("section"), j.alias("paragraph"), d.alias("digest"))
            ),
        )
        return F.flatten(rows)

    def named(side, own, other, gone):
        known = F.transform(other, lambda r: F.rtrim(r["digest"], F.lit("*")))
        moved = lambda r: F.array_contains(known, F.rtrim(r["digest"], F.lit("*")))
        kind = lambda r, i: F.when(moved(r), "moved").when(i < F.size(other), "changed").otherwise(gone)
        return F.transform(own, lambda r, i: F.struct(F.lit(side).alias("side"), r["section"], r["paragraph"], kind(r, i).alias("kind")))

    def walk(pair):
        one, two, at = pair["one"], pair["two"], pair["at"]
        own, other = placed(one, at["first"], at["number"]), placed(two, at["first"], at["others"])
        return let(F.struct(own.alias("own"), other.alias("other")), remain)

    def remain(rows):
        at = _differing(rows["own"], rows["other"], lambda r: r["digest"])
        return let(F.struct(rows["own"].alias("own"), rows["other"].alias("other"), at.alias("at")), both)

    def both(x):
        own = F.slice(x["own"], x["at"]["first"] + 1, x["at"]["number"])
        other = F.slice(x["other"], x["at"]["first"] + 1, x["at"]["others"])
        return let(
            F.struct(own.alias("own"), other.alias("other")),
            lambda y: F.concat(named("a", y["own"], y["other"], "deleted"), named("b", y["other"], y["own"], "inserted")),
        )

    trees = F.struct(sections(a).alias("one"), sections(b).alias("two"))
    found = let(
        trees,
        lambda t: let(F.struct(t["one"].alias("one"), t["two"].alias("two"), _differing(t["one"], t["two"], digest).alias("at")), walk),
    )
    same = F.substring_index(a, "/", 1) == F.substring_index(b, "/", 1)
    return F.when(same, F.slice(found, 1, 0)).otherwise(found)


def with_next(docs: DataFrame, buckets: int, value="text") -> DataFrame:
    """``docs`` with next_value, the value of the row that follows by doc_id; the last gets the first's.

    Rows of one doc_id follow each other by value, and a null doc_id comes first. Borders from the
    table's own quantiles deal the rows into ``buckets``; a window runs inside each, and the last
    row of a bucket takes the first of the next bucket that has rows (one row each).
    """
    key = F.col("doc_id").cast("long")
    shares = F.array(*(F.lit(i / buckets) for i in range(1, buckets)))
    borders = docs.select(F.percentile_approx(key, shares, 100 * buckets)).first()[0] if buckets > 1 else None
    borders = sorted(set(borders or []))
    # two steps to find a bucket: the group of borders, then the border in it
    step = max(1, int(len(borders) ** 0.5))
    groups = [borders[i : i + step] for i in range(0, len(borders), step)]
    bucket = F.lit(0)
    if groups:
        heads = F.lit([g[0] for g in groups]).cast("array<bigint>")
        rest = F.split(F.lit("|".join(",".join(map(str, g)) for g in groups)), r"\|")
        rest = F.transform(rest, lambda g: F.split(g, ",").cast("array<bigint>"))
        group = F.size(F.filter(heads, lambda b: b <= key)) - 1
        inside = F.size(F.filter(F.get(rest, group), lambda b: b <= key))
        bucket = F.when(key >= borders[0], group * step + inside).otherwise(0)
    place = F.coalesce(key, F.lit(-(1 << 63)))
    rows = docs.withColumn("bucket", F.coalesce(bucket, F.lit(0)).cast("int")).withColumn("place", place)
    rows = rows.withColumn("guest", F.lit(False))
    firsts = rows.groupBy("bucket").agg(F.min("place").alias("place")).collect()  # a row for each bucket at most
    firsts = sorted((r["bucket"], r["place"]) for r in firsts)
    follows = [(b, *firsts[(i + 1) % len(firsts)]) for i, (b, _) in enumerate(firsts)]
    listed = F.lit("|".join(",".join(map(str, f)) for f in follows))
    kinds = (("before", "int"), ("bucket", "int"), ("place", "long"))
    follows = docs.sparkSession.range(1 if follows else 0).select(F.explode(F.split(listed, r"\|")).alias("follow"))
    follows = follows.select(*(F.split("follow", ",")[i].cast(t).alias(n) for i, (n, t) in enumerate(kinds)))
    # the first row after a bucket is its guest: it closes the bucket's window and then goes
    guests = rows.join(F.broadcast(follows), ["bucket", "place"])
    guests = guests.groupBy(F.col("before").alias("bucket")).agg(F.min(value).alias(value))
    rows = rows.unionByName(guests.withColumn("guest", F.lit(True)), allowMissingColumns=True)
    order = Window.partitionBy("bucket").orderBy("guest", "place", value)
    return rows.withColumn("next_value", F.lead(value).over(order)).filter("not guest").drop("bucket", "place", "guest")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and likenesses to that and to the next text.

    The edited text has the last half of the code points replaced by as many first ones of the
    next document by doc_id (or all of it, if shorter).
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(texts, buckets).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int"))
    rows = rows.withColumn("edited", F.concat(kept, F.substring("next_value", F.lit(1), half)))
    prints = {n: fingerprint(F.col(f"tree_{n}")) for n in ("text", "edited", "next_value")}
    rows = rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        *(tree(F.col(n)).alias(f"tree_{n}") for n in prints),
    )
    rows = rows.select("doc_id", "n_chars", "edited_sha256", *(p.alias(n) for n, p in prints.items()))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("text").alias("fingerprint"),
        F.col("edited").alias("edited_fingerprint"),
        likeness(F.col("text"), F.col("edited")).alias("near_edited"),
        likeness(F.col("text"), F.col("next_value")).alias("near_next"),
    )
