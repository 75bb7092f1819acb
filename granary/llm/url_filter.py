"""URL filter by path-template trees, in DataFrame functions only.

Explicit rules decide first: a rule fits its host and all subdomains if the path starts with the rule's
path, and the longest fitting rule wins. The pages they decide are the labels for the rest. Per host the
paths form a tree of segments, digit runs being wildcards from the start. Level by level, a position whose
children are nearly all different, or more than NAMED, becomes a wildcard; of the named children, in the
order of the mean length of what follows, each is compared with the one before it, and they merge if
neither length nor depth of what follows nor, where both have labels, their block rates differ
significantly. So branches without labels join labelled ones that are built alike. A template's block
rate is smoothed towards that of equal templates on all hosts, and that one towards PRIOR; templates that
reach REJECT are rejected, and pages without a rule take their template's verdict.

The tree is built on distinct (host, path shape) rows with counts, so a host with a third of all pages
is aggregated on the map side; pages meet their template again in one join on (host, shape), which
adaptive execution splits where a host is hot. A window sees NAMED rows at most.

Defined cases: a null url, or one without ``://``, has an empty host and path and no rule, and such pages
form a host of their own; paths may have any depth, and levels at which no host's paths differ cost
nothing; a template without labels on any host has PRIOR and is allowed; repeated rows each get their
row; a null page_id passes through; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: A position is variable from FANOUT children, if they are at least FANOUT_SHARE of its pages or more than NAMED.
FANOUT, FANOUT_SHARE, NAMED = 8, 0.5, 64
#: The z value from which two branches differ.
SIMILAR_Z = 1.96
#: The prior counts as PRIOR_WEIGHT labelled pages and one more for each UNLABELLED pages without label.
PRIOR, PRIOR_WEIGHT, UNLABELLED, REJECT = 0.5, 2.0, 2.0, 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """``target`` is a host, a slash and the rest of a path prefix, such as ``example.net/en/``."""

    verdict: str
    target: str

    @property
    def host(self) -> str:
        return self.target.split("/", 1)[0]

    @property
    def path(self) -> str:
        return self.target[len(self.host) :]


# Fixed values of the task.
RULES = (
    UrlRule("block", "net/"),
    UrlRule("allow", "example.net/en/"),
    UrlRule("block", "example.com/de/"),
    UrlRule("allow", "org/fr/"),
)


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def decide(rules: tuple[UrlRule, ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits ``host`` and ``path``; nulls if none does."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.target), r.target)):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        hit = F.struct(F.lit(r.target).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    return none if out is None else out.otherwise(none)


def shape(path: Column) -> Column:
    """Segments of a path with digit runs as wildcards."""
    return F.split(F.regexp_replace(F.regexp_replace(path, r"^/", ""), r"[0-9]+", "*"), "/", -1)


def _z(total: str, square: str) -> Column:
    """z value of the difference between this branch's mean and the one before it, by their common variance."""
    n = F.col("n") + F.col("n_before")
    mean = (F.col(total) + F.col(f"{total}_before")) / n
    variance = F.greatest((F.col(square) + F.col(f"{square}_before")) / n - mean * mean, F.lit(1e-9))
    gap = F.abs(F.col(total) / F.col("n") - F.col(f"{total}_before") / F.col("n_before"))
    return gap / F.sqrt(variance * (1 / F.col("n") + 1 / F.col("n_before")))


def _label_z() -> Column:
    pooled = (F.col("b") + F.col("b_before") + 1) / (F.col("l") + F.col("l_before") + 2)
    gap = F.abs(F.col("b") / F.col("l") - F.col("b_before") / F.col("l_before"))
    both = (F.col("l") > 0) & (F.col("l_before") > 0)
    return F.when(both, gap / F.sqrt(pooled * (1 - pooled) * (1 / F.col("l") + 1 / F.col("l_before")))).otherwise(0.0)


def _renamed(children: DataFrame) -> DataFrame:
    """(host, parent, seg, to): children that a wildcard or a merged branch replaces."""
    keys = ["host", "parent"]
    family = children.groupBy(*keys).agg(F.count("*").alias("fan"), F.sum("n").alias("all"))
    variable = (F.col("fan") >= FANOUT) & ((F.col("fan") >= F.col("all") * FANOUT_SHARE) | (F.col("fan") > NAMED))
    marked = children.join(family.where("fan > 1").select(*keys, variable.alias("variable")), keys)
    wild = marked.where("variable").select(*keys, "seg", F.lit("*").alias("to"))
    order = Window.partitionBy(*keys).orderBy(F.col("length") / F.col("n"), "seg")
    stats = ("n", "b", "l", "length", "length2", "depth", "depth2")
    named = marked.where("NOT variable").select("*", *(F.lag(c).over(order).alias(f"{c}_before") for c in stats))
    alike = (_z("length", "length2") < SIMILAR_Z) & (_z("depth", "depth2") < SIMILAR_Z) & (_label_z() < SIMILAR_Z)
    opens = F.when(F.col("n_before").isNull(), 1).when(alike, 0).otherwise(1)
    runs = named.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order))
    run = Window.partitionBy(*keys, "run")
    merged = runs.select(*keys, "seg", F.count("*").over(run).alias("members"), F.concat(F.lit("~"), F.min("seg").over(run)).alias("to"))
    return wild.where("seg <> '*'").unionByName(merged.where("members > 1").drop("members"))


def path_templates(labelled: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, shape, template, n_block, n_labelled, purity, rejected) for every distinct shape of a host.

    ``labelled`` has host, shape and label (block, allow or null).
    """
    tree = scratch.save(
        labelled.groupBy("host", "shape")
        .agg(F.count("*").alias("n"), F.count_if(F.col("label") == "block").alias("n_block"), F.count("label").alias("n_labelled"))
        .withColumn("template", F.col("shape"))
    )
    # Levels at which the paths of some host differ; one small integer for each.
    places = tree.select("host", F.posexplode("template").alias("k", "seg")).groupBy("host", "k").agg(F.min("seg").alias("low"), F.max("seg").alias("high"))
    levels = sorted(r[0] + 1 for r in places.where("low <> high").select("k").distinct().collect())
    for k in levels:
        parent = F.concat_ws("/", F.slice("template", 1, k - 1)) if k > 1 else F.lit("")
        here = tree.withColumn("parent", parent).withColumn("seg", F.get("template", F.lit(k - 1)))
        rest = F.length(F.concat_ws("/", F.slice("template", k + 1, 2**31 - 1)))
        below = F.size("template") - k
        children = scratch.save(
            here.where("seg IS NOT NULL").groupBy("host", "parent", "seg").agg(
                F.sum("n").alias("n"), F.sum("n_block").alias("b"), F.sum("n_labelled").alias("l"), F.sum(F.col("n") * rest).alias("length"),
                F.sum(F.col("n") * rest * rest).alias("length2"), F.sum(F.col("n") * below).alias("depth"), F.sum(F.col("n") * below * below).alias("depth2"),
            )
        )
        renamed = scratch.save(_renamed(children))
        if renamed.isEmpty():
            if here.where("seg IS NOT NULL").groupBy("host", "parent").agg(F.min("template").alias("low"), F.max("template").alias("high")).where("low <> high").isEmpty():
                break  # below here no branch has a sibling
            continue
        tree = scratch.save(
            here.join(renamed, ["host", "parent", "seg"], "left")
            .withColumn("template", F.when(F.col("to").isNull(), F.col("template")).otherwise(
                F.concat(F.slice("template", 1, k - 1), F.array("to"), F.slice("template", k + 1, 2**31 - 1))))
            .select("host", "shape", "n", "n_block", "n_labelled", "template")
        )
    pools = tree.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("n_block").alias("b"), F.sum("n_labelled").alias("l"))
    everywhere = pools.groupBy("template").agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b"), F.sum("l").alias("all_l"))
    weight = PRIOR_WEIGHT + (F.col("n") - F.col("l")) / UNLABELLED
    all_weight = PRIOR_WEIGHT + (F.col("all_n") - F.col("all_l")) / UNLABELLED
    common = (F.col("all_b") + PRIOR * all_weight) / (F.col("all_l") + all_weight)
    purity = (F.col("b") + common * weight) / (F.col("l") + weight)
    return tree.drop("n").join(pools.join(everywhere, "template"), ["host", "template"]).select(
        "host", "shape", F.concat_ws("/", "template").alias("template"), F.col("b").alias("n_block"), F.col("l").alias("n_labelled"),
        purity.alias("purity"), (purity >= REJECT).alias("rejected"),
    )


def filter_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity."""
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = host_and_path()
    judged = (
        pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("d", decide(rules))
        .select("page_id", "host", "path", "d.rule", F.col("d.verdict").alias("label"), shape(F.col("path")).alias("shape"))
    )
    templates = scratch.save(path_templates(judged.select("host", "shape", "label"), scratch))
    found = templates.select("host", "shape", "template", "purity", "rejected")
    return judged.join(found, ["host", "shape"]).select(
        "page_id", "host", "path", "rule", F.coalesce("label", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "template", "purity",
    )
