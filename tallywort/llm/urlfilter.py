"""URL filters: listed rules, and a path-template tree learnt from labelled URLs.

A rule names a host and a path; it fits the host and its subdomains where the URL's path starts with the
rule's, and the longest fitting rule decides. Other URLs are judged by their template:

1. Path segments that vary by form become typed wildcards at once: numbers, hexadecimal strings, words with
   digits; a file name keeps its extension.
2. Level by level from the root, for each host, branches merge into one wildcard: all of a node with more than
   ``FAN`` of them, else those that are statistically similar, two at least. A branch is similar if the shapes of
   what follows in its paths are spread like those of the node's branches together (chi-square at ``SHAPE_Z``) and,
   where it has ``MIN_LABELS`` labels, its share of bad ones doesn't differ from theirs (z-test at ``Z``).
3. A template's purity is its smoothed share of bad URLs: labels count whole, unlabelled URLs as ``UNLABELLED`` good
   ones each, and ``PRIOR`` pseudo-labels have the purity of the host, which is smoothed to ``PRIOR_BAD`` likewise.
   So labels speak for the unlabelled URLs that merged with them, unless these are many times as many, and a
   template without labels falls back on its host. It is blocked if the host has ``MIN_LABELS`` labels and the
   purity reaches ``PURITY``; else it is allowed.

Paths are counted once by host and form before any shuffle, so a host with a third of all pages is a few
rows. A form that no other shares its node with is settled, so levels are as many as branches nest. Null URLs, and
those without ``://``, have empty host and path, fit no rule and share a template. Repeated rows count each and are
judged alike. An empty table gives an empty table; other columns pass unused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

FAN = 20
Z, SHAPE_Z, MIN_LABELS = 1.64, 2.33, 5
#: Buckets of the shapes of what follows a segment: kinds of the next SHAPE_DEPTH segments, by hash.
SHAPES, SHAPE_DEPTH = 16, 3
#: Pseudo-labels, the share of bad ones among them, the weight of an unlabelled URL, and the purity that blocks.
PRIOR, PRIOR_BAD, UNLABELLED, PURITY = 2.0, 0.5, 0.1, 0.7
WILD = "*"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule (verdict, host, path) as text, and its verdict; null if none fits. The list is
    configuration and becomes one expression."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _form(segment: Column) -> Column:
    """A segment, or the wildcard of its form."""
    stem = F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z][A-Za-z0-9]{0,4})?$", 1)
    ext = F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z][A-Za-z0-9]{0,4})?$", 2)
    kind = (
        F.when(stem.rlike(r"^[0-9]+$"), "<number>")
        .when(stem.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), "<hex>")
        .when(stem.rlike(r"[0-9]"), "<code>")
        .otherwise(stem)
    )
    return F.concat(kind, ext)


def form_of(path: Column) -> Column:
    """The path's segments with typed wildcards; empty segments don't count."""
    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), _form)


def _shape(rest: Column) -> Column:
    """The bucket of what follows a segment: the kinds of the next segments, words being one kind."""
    kind = lambda x: F.when(x.rlike(r"^<[a-z]+>"), F.regexp_extract(x, r"^<[a-z]+>", 0)).otherwise("word")
    shape = F.array_join(F.transform(F.slice(rest, 1, SHAPE_DEPTH), kind), "/")
    return F.pmod(F.crc32(shape.cast("binary")), F.lit(SHAPES))


def _merged(forms: DataFrame, level: int, fan: int) -> DataFrame:
    """(host, prefix, segment) of the branches at a level that become a wildcard."""
    node, branch = ["host", "prefix"], ["host", "prefix", "segment"]
    shapes = [f"s{i}" for i in range(SHAPES)]
    here = forms.where(F.size("template") > level).select(
        "host", F.slice("template", 1, level).alias("prefix"), F.get("template", F.lit(level)).alias("segment"),
        "n", "labels", "bad", _shape(F.slice("template", level + 2, SHAPE_DEPTH)).alias("shape"),
    )
    sums = [F.sum(c).alias(c) for c in ("n", "labels", "bad")]
    children = here.groupBy(*branch).agg(*sums, *(F.sum(F.when(F.col("shape") == i, F.col("n")).otherwise(0)).alias(c) for i, c in enumerate(shapes)))
    children = common.materialize(children, f"url-branches-{level}")
    nodes = children.groupBy(*node).agg(F.count("*").alias("fan"), *(F.sum(c).alias(f"all_{c}") for c in ("n", "labels", "bad", *shapes))).where("fan > 1")
    both = children.join(nodes, node)
    rate = (F.col("all_bad") + 1) / (F.col("all_labels") + 2)
    apart = F.abs(F.col("bad") / F.col("labels") - rate) / F.sqrt(rate * (1 - rate) / F.col("labels"))
    expected = [F.col("n") * F.col(f"all_{c}") / F.col("all_n") for c in shapes]
    chi = sum((F.when(e > 0, (F.col(c) - e) ** 2 / e).otherwise(0.0) for c, e in zip(shapes, expected, strict=True)), F.lit(0.0))
    free = sum((F.when(F.col(f"all_{c}") > 0, 1).otherwise(0) for c in shapes), F.lit(-1))
    alike = (chi <= free + SHAPE_Z * F.sqrt(2.0 * free)) & ((F.col("labels") < MIN_LABELS) | (apart <= Z))
    judged_ = both.withColumn("alike", alike)
    similar = judged_.where("alike").groupBy(*node).agg(F.count("*").alias("similar"))
    return judged_.join(similar, node, "left").where((F.col("fan") > fan) | (F.col("alike") & (F.col("similar") > 1))).select(*branch)


def templates(urls: DataFrame, fan: int = FAN) -> DataFrame:
    """From (host, path, label), label being 1 for bad, 0 for good and else null: (host, form, template, n, labels, bad,
    purity, blocked) for every host and form of path."""
    forms = common.materialize(
        urls.groupBy("host", form_of(F.col("path")).alias("form"))
        .agg(F.count("*").alias("n"), F.count("label").alias("labels"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("bad")),
        "url-forms",
    ).withColumn("template", F.col("form"))
    settled, level = forms.where(F.lit(False)), 0
    while True:
        prefix = F.slice("template", 1, level)
        size = forms.groupBy("host", prefix.alias("prefix")).agg(F.count("*").alias("size"))
        placed = forms.withColumn("prefix", prefix).join(size, ["host", "prefix"])
        placed = common.materialize(placed.withColumn("open", (F.col("size") > 1) & (F.size("template") > level)).drop("size", "prefix"), f"url-open-{level}")
        settled = settled.union(placed.where("not open").drop("open"))
        forms = placed.where("open").drop("open")
        if not forms.take(1):
            break
        # settled forms of the node are branches beside the open ones only if they go on, and then they are open too
        wild = _merged(forms, level, fan).withColumn("wild", F.lit(True))
        at = forms.withColumn("prefix", prefix).withColumn("segment", F.get("template", F.lit(level)))
        changed = F.concat(F.col("prefix"), F.array(F.lit(WILD)), F.slice(F.col("template"), level + 2, F.size("template")))
        forms = common.materialize(
            at.join(wild, ["host", "prefix", "segment"], "left").withColumn("template", F.when(F.col("wild"), changed).otherwise(F.col("template"))).drop("prefix", "segment", "wild").select(*settled.columns),
            f"url-level-{level}",
        )
        level += 1
    settled = common.materialize(settled, "url-settled")

    def smoothed(prior: Column | float) -> Column:
        weight = F.col("labels") + UNLABELLED * (F.col("n") - F.col("labels"))
        return (F.col("bad") + PRIOR * prior) / (weight + PRIOR)

    sums = [F.sum(c).alias(c) for c in ("n", "labels", "bad")]
    hosts = settled.groupBy("host").agg(*sums).select("host", F.col("labels").alias("host_labels"), smoothed(PRIOR_BAD).alias("host_purity"))
    pure = settled.groupBy("host", "template").agg(*sums).join(hosts, "host").withColumn("purity", smoothed(F.col("host_purity")))
    pure = pure.withColumn("blocked", (F.col("host_labels") >= MIN_LABELS) & (F.col("purity") >= PURITY)).drop("host_labels", "host_purity")
    return settled.select("host", "form", "template").join(pure, ["host", "template"])


def judged(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity). The listed rules decide where they fit, and serve as the
    labels of the template tree."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumn("rule", rule).withColumn("listed", verdict)
    label = F.when(F.col("listed") == "block", 1).when(F.col("listed") == "allow", 0)
    learnt = templates(urls.select("host", "path", label.alias("label")))
    learnt = common.materialize(
        learnt.select(F.col("host").alias("_host"), F.col("form").alias("_form"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity", "blocked"),
        "url-templates",
    )
    both = common.join_by_id(urls, learnt, (F.col("host") == F.col("_host")) & (form_of(F.col("path")) == F.col("_form")), "left")
    learnt_verdict = F.when(F.col("blocked"), "block").otherwise("allow")
    return both.select("page_id", "host", "path", "rule", F.coalesce("listed", learnt_verdict).alias("verdict"), "template", "purity")
