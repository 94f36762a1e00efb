"""URL filters by a path-template tree, with DataFrame functions only.

A url's path becomes a template: per host and level, a segment value that the
level's statistics call variable is replaced by a wildcard of its shape, and
branches whose labelled shares agree are merged into one. A template whose
smoothed share of allowed urls is low is rejected. Labels come from an ordered
rule list: urls that a rule decides are the labelled ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Rules as (verdict, host and path start): fixed values of the query's contract.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
MIN_SUPPORT = 0.02  # share of its parent below which a segment value is variable
PRIOR = 5.0  # weight of the parent's share in a template's smoothed purity
MERGE_Z = 1.96  # branches closer than this many standard errors are merged
REJECT = 0.35  # templates with a lower smoothed share of allowed urls are rejected


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or a url without ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    after = F.when(rest.isNotNull(), F.substr(url, F.length(rest) + 4)).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(after, F.length(host) + 1), r"^[^?#]*", 0)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return low, path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls. The list is short and known before the run."""
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, start = text.partition("/")
        start = "/" + start
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        rule = F.when(fits, F.lit(text)).otherwise(rule if rule is not None else F.lit(None).cast("string"))
        verdict = F.when(fits, F.lit(what)).otherwise(verdict if verdict is not None else F.lit(None).cast("string"))
    return rule, verdict


def shape(segment: Column) -> Column:
    """The wildcard for a variable segment: digits, or anything, with a file ending kept apart."""
    return (
        F.when(segment.rlike(r"^[0-9]+$"), F.lit("{n}"))
        .when(segment.rlike(r"^[0-9]+\.[A-Za-z0-9]{1,5}$"), F.concat(F.lit("{n}."), F.regexp_extract(segment, r"\.([A-Za-z0-9]+)$", 1)))
        .otherwise(F.lit("{}"))
    )


def _node(segment: Column, kept: Column) -> Column:
    """The segment itself, or its wildcard where it is not kept; identifiers never are."""
    kept = kept & ~segment.rlike(r"[0-9]{2,}")
    return F.when(segment == "", F.lit("")).when(kept, segment).otherwise(shape(segment))


def _generalise(rows: DataFrame, level: int, settle) -> DataFrame:
    """Extends ``nodes`` by the segment of this level where it holds a fair share of its parent, else by its wildcard.

    Paths that have ended count for their parent and are marked as done, as are
    paths that are alone under their parent: all their other segments follow at once.
    """
    parents = ["host", "nodes"]
    rows = rows.withColumn("segment", F.coalesce(F.get("parts", F.lit(level)), F.lit("")))
    counts = settle(rows.groupBy(*parents, "segment").agg(F.sum("n").alias("own_n"), F.count("*").alias("paths")), f"url-counts{level}")
    # Joined instead of windowed: one host may hold a third of all urls, and a skewed join can be split.
    totals = settle(counts.groupBy(*parents).agg(F.sum("own_n").alias("parent_n"), F.sum("paths").alias("paths")), f"url-parents{level}")
    shares = counts.drop("paths").join(totals, parents)
    # A value that is as good as the only one, or one of a few, is kept.
    node = _node(F.col("segment"), (F.col("own_n") >= MIN_SUPPORT * F.col("parent_n")) & (F.col("own_n") >= 2))
    named = settle(shares.select(*parents, "segment", node.alias("node"), (F.col("paths") == 1).alias("alone")), f"url-level{level}")
    left = F.slice("parts", F.lit(level + 1), F.greatest(F.size("parts") - level, F.lit(0)))
    rest = F.transform(left, lambda x: _node(x, F.col("n") >= 2))
    out = rows.join(named, [*parents, "segment"])
    ended = F.size("parts") <= level
    nodes = F.when(ended, F.col("nodes")).when(F.col("alone"), F.concat("nodes", rest)).otherwise(F.concat("nodes", F.array("node")))
    return out.withColumns({"done": ended | F.col("alone"), "nodes": nodes}).drop("segment", "node", "alone")


def template_tree(urls: DataFrame, settle) -> DataFrame:
    """(host, path, n, good, labelled, nodes): distinct paths with the template nodes they fall under, one per segment.

    ``urls`` has host, path, label (1 allowed, 0 blocked, null unlabelled). Paths
    are counted before any shuffle by level, so copies of a url travel once.
    Levels follow until no path has a further segment.
    """
    rows = urls.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("good"), F.count("label").alias("labelled")
    )
    parts = F.split(F.regexp_replace(F.col("path"), "^/|/+$", ""), "/")
    rows = settle(rows.withColumns({"parts": parts, "nodes": F.array().cast("array<string>")}), "url-paths")
    out, level = rows.drop("parts").limit(0), 0
    while not rows.isEmpty():
        moved = settle(_generalise(rows, level, settle), f"url-moved{level}")
        out = out.unionByName(moved.where("done").drop("parts", "done"))
        rows, level = moved.where("not done").drop("done"), level + 1
    return out


def _shrunk(good: str, labelled: str, parent: Column) -> Column:
    """A branch's share: shrunk towards its parent's where it differs, else the parent's."""
    own = F.col(good) / F.nullif(F.col(labelled), F.lit(0))
    error = F.sqrt(parent * (1 - parent) / F.nullif(F.col(labelled), F.lit(0)))
    differs = F.coalesce(F.abs(own - parent) > MERGE_Z * error, F.lit(False))
    return F.when(differs, (F.col(good) + PRIOR * parent) / (F.col(labelled) + PRIOR)).otherwise(parent)


def _deeper(leaves: DataFrame, settle) -> DataFrame:
    """Takes ``_share`` from the second level down to each leaf's parent; nodes that do not branch are passed over."""
    out, level = leaves.limit(0), 3
    while True:
        out = out.unionByName(leaves.where(F.size("nodes") <= level))
        leaves = leaves.where(F.size("nodes") > level)
        if leaves.isEmpty():
            return out
        # Leaves that end at this level belong to the sums of its nodes.
        all_here = leaves.unionByName(out.where(F.size("nodes") == level))
        prefix = F.slice("nodes", 1, level).alias("_prefix")
        sums = all_here.groupBy("host", prefix).agg(
            F.sum("good").alias("_good"), F.sum("labelled").alias("_labelled"), F.count_distinct(F.coalesce(F.get("nodes", F.lit(level)), F.lit("/"))).alias("_children"),
            F.count("*").alias("_leaves"),
        )
        named = settle(sums.withColumnRenamed("host", "_host"), f"url-sums{level}")
        both = leaves.join(named, (F.col("host") == F.col("_host")) & (F.slice("nodes", 1, level) == F.col("_prefix")))
        share = F.when(F.col("_children") > 1, _shrunk("_good", "_labelled", F.col("_share"))).otherwise(F.col("_share"))
        moved = settle(both.withColumn("_share", share), f"url-shares{level}")
        names = leaves.columns
        out = out.unionByName(moved.where("_leaves = 1").select(*names))
        leaves, level = moved.where("_leaves > 1").select(*names), level + 1


def judge_templates(tree: DataFrame, settle) -> DataFrame:
    """One row per (host, nodes): smoothed purity and verdict of its merged branch.

    The share of a node is shrunk towards the share of its parent: all urls,
    top domain, host, then level by level. A branch whose own share differs from
    its siblings' by less than ``MERGE_Z`` standard errors is merged: it takes the
    shrunk share of the parent instead of its own.
    """
    leaves = tree.groupBy("host", "nodes").agg(*[F.sum(c).alias(c) for c in ("n", "good", "labelled")])
    first = [F.coalesce(F.get("nodes", F.lit(k)), F.lit("")) for k in range(2)]
    leaves = settle(leaves.withColumns({"top": F.substring_index("host", ".", -1), "t0": first[0], "t1": first[1]}), "url-leaves")
    steps = [["t0"], ["top"], ["top", "t0"], ["top", "host"], ["top", "host", "t0"], ["top", "host", "t0", "t1"]]
    total = leaves.agg(F.sum("good").alias("g"), F.sum("labelled").alias("l")).first()
    share = F.lit(((total["g"] or 0) + 0.5) / ((total["l"] or 0) + 1.0))
    # The language folder is the first level, so its share over all hosts is a parent of the host's own.
    out = leaves.withColumn("_share", share)
    for step in steps:
        sums = leaves.groupBy(*step).agg(F.sum("good").alias("_good"), F.sum("labelled").alias("_labelled"))
        named = sums.select(*[F.col(c).alias(f"_{c}") for c in step], "_good", "_labelled")
        match = None
        for c in step:
            same = out[c] == named[f"_{c}"]
            match = same if match is None else match & same
        out = out.join(named, match).drop(*[f"_{c}" for c in step])
        out = out.withColumn("_share", _shrunk("_good", "_labelled", F.col("_share"))).drop("_good", "_labelled")
    out = _deeper(settle(out.drop("top", "t0", "t1"), "url-shares"), settle)
    purity = _shrunk("good", "labelled", F.col("_share"))
    return out.select("host", "nodes", purity.alias("purity"), F.when(purity < REJECT, F.lit("block")).otherwise(F.lit("allow")).alias("tree_verdict"))


def filter_urls(pages: DataFrame, settle, *, url: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Columns of ``pages`` but the html, with host, path, rule, verdict, template and purity.

    Every row is judged: by its longest fitting rule, else by its template. Null
    urls and urls without ``://`` have empty host and path and the template of
    the empty path. Repeated rows and null ids are kept as they are; input
    columns named like a new one are replaced.
    """
    new = ("host", "path", "rule", "verdict", "template", "purity")
    host, path = host_and_path(F.col(url))
    rows = pages.drop(*[c for c in new if c in pages.columns and c != url])
    rows = rows.withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_by_rule": verdict})
    label = F.when(F.col("_by_rule") == "allow", 1).when(F.col("_by_rule") == "block", 0)
    tree = settle(template_tree(rows.withColumn("label", label), settle), "url-tree")
    judged = judge_templates(tree, settle)
    template = F.concat(F.lit("/"), F.array_join(F.filter("nodes", lambda t: t != ""), "/"))
    by_path = tree.join(judged, ["host", "nodes"]).select(
        F.col("host").alias("_host"), F.col("path").alias("_path"), template.alias("template"), "purity", "tree_verdict"
    )
    out = rows.join(by_path, (rows["host"] == by_path["_host"]) & (rows["path"] == by_path["_path"]))
    return out.withColumn("verdict", F.coalesce("_by_rule", "tree_verdict")).drop("_host", "_path", "_by_rule", "tree_verdict")
