"""URL filters by a path-template tree (DataFrame functions only).

Longest-matching rules decide first. For the rest, each host's paths form a tree: variable segments become wildcards,
sibling branches with statistically similar labels are merged, and a template is rejected when the smoothed share of bad
labels among its pages is high enough. A template without labels borrows those of its nearest parent or of other hosts'
like paths; without such evidence nothing is rejected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, drop_cut, named

#: Shapes of a segment that is a value rather than a name, most specific first.
VARIABLE = (
    ("{date}", r"^\d{4}-\d{2}(-\d{2})?$"),
    ("{uuid}", r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"),
    ("{num}", r"^\d+$"),
    ("{hex}", r"^(?=.*\d)[0-9A-Fa-f]{8,}$"),
    ("{id}", r"^(?=.*\d)[^.]{16,}$"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or no ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rules(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``rules`` (verdict, host, path) that fits; null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[1], r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, own, start in reversed(ordered):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = F.when(fits, own + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _shape(segment: Column) -> Column:
    """A wildcard for a variable segment, its extension kept; else the segment itself."""
    stem = F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z][A-Za-z0-9]{0,4})?$", 1)
    tail = F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z][A-Za-z0-9]{0,4})?$", 2)
    return reduce(lambda rest, kind: F.when(stem.rlike(kind[1]), F.concat(F.lit(kind[0]), tail)).otherwise(rest), reversed(VARIABLE), segment)


def _kind(segment: Column) -> Column:
    """What a segment looks like: a wildcard, a name, or the end of the path."""
    return F.when(segment.isNull(), "").when(segment.startswith("{"), segment).otherwise("name")


def template_tree(paths: DataFrame, min_labels: int = 20, z_merge: float = 1.96, open_share: float = 0.1, rare_share: float = 0.02) -> DataFrame:
    """Templates of ``paths(host, raw array<string>, n, labelled, bad)``, one row for each (host, raw): with ``template``.

    From the root down, two things happen to the literal children of a parent, both by statistics of its pages. Where the
    chance that a page has a child not seen before (children with one page, over pages: Good-Turing) is ``open_share`` or
    more, on ``min_labels`` pages or more, the rare children, of up to ``rare_share`` of the pages, are values rather than
    names and become ``{any}``. Children with ``min_labels`` labels or more whose next segments look alike are put in order
    of their rate of bad labels, and neighbours whose rates don't differ (two-proportion z up to ``z_merge``) are merged into
    one branch, ``{like:first of them}``. Levels are gone through as long as some branch has pages enough for either; below
    that nothing can change, and what is left of a path is its own template. Each level aggregates a row per (host,
    template) and child, so a hot host costs no more than others.
    """
    tree = paths.withColumns({"template": F.lit(""), "raw_key": F.array_join("raw", "/")})
    level = 0
    while True:
        tree = tree.withColumns({"child": F.get("raw", F.lit(level)), "kind": _kind(F.get("raw", F.lit(level + 1)))})
        shapes = tree.where("child is not null").groupBy("host", "template", "child", "kind").agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
        child = shapes.groupBy("host", "template", "child").agg(F.sum("n").alias("n"), F.sum("l").alias("l"), F.sum("b").alias("b"), F.max_by("kind", F.struct("n", "kind")).alias("kind"))
        parent = child.groupBy("host", "template").agg(F.sum("n").alias("pages"), F.sum("l").alias("labels"), F.count_if(F.col("n") == 1).alias("single"))
        enough = parent.where((F.col("pages") >= min_labels) & ((F.col("single") >= open_share * F.col("pages")) | (F.col("labels") >= 2 * min_labels)))
        names = cut(child.where(~F.col("child").startswith("{")).join(enough, ["host", "template"]), "names")
        go_on = names.limit(1).count() or tree.where("child is not null").groupBy("host", "template").agg(F.sum("n").alias("n")).where(F.col("n") >= min_labels).limit(1).count()
        if not go_on:
            drop_cut(names)
            break
        opened = (F.col("single") >= open_share * F.col("pages")) & (F.col("n") <= F.greatest(F.lit(1), rare_share * F.col("pages")))
        marked = names.withColumn("opened", opened)
        # neighbours by rate, among branches of one shape
        row = W.partitionBy("host", "template", "kind").orderBy(F.col("b") / F.col("l"), "child")
        known = marked.where(~F.col("opened") & (F.col("l") >= min_labels)).withColumns({"l0": F.lag("l").over(row), "b0": F.lag("b").over(row)})
        rate = (F.col("b") + F.col("b0")) / (F.col("l") + F.col("l0"))
        apart = F.abs(F.col("b") / F.col("l") - F.col("b0") / F.col("l0")) > z_merge * F.sqrt(rate * (1 - rate) * (1 / F.col("l") + 1 / F.col("l0")))
        run = known.withColumn("run", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(row.rowsBetween(W.unboundedPreceding, 0)))
        whole = W.partitionBy("host", "template", "kind", "run")
        liked = run.withColumns({"size": F.count("*").over(whole), "head": F.min("child").over(whole)}).where("size > 1")
        token = liked.select("host", "template", "child", F.concat(F.lit("{like:"), "head", F.lit("}")).alias("token")).union(marked.where("opened").select("host", "template", "child", F.lit("{any}")))
        stepped = tree.join(token, ["host", "template", "child"], "left")
        longer = F.concat("template", F.lit("/"), F.coalesce("token", "child"))
        new = cut(stepped.withColumn("template", F.when(F.col("child").isNull(), F.col("template")).otherwise(longer)).drop("token", "child", "kind"), "tree")
        drop_cut(names, *([tree] if level else []))
        tree = new
        level += 1
    rest = F.slice("raw", level + 1, F.greatest(F.size("raw") - level, F.lit(0)))
    return tree.withColumn("template", F.concat("template", F.array_join(F.transform(rest, lambda x: F.concat(F.lit("/"), x)), ""))).drop("child", "kind", "raw")


def borrowed_evidence(tree: DataFrame, least: int = 20) -> DataFrame:
    """``host, raw_key, evidence, l, b`` for rows of :func:`template_tree` whose (host, template) has no label.

    From the longest prefix of the path down to its first segment, labels come from the host's own templates below that
    prefix (``parent``), else from all hosts' paths below it (``hosts``), where there are ``least`` or more. A whole host's
    labels are not evidence for a section that has none, nor are those of all pages. Prefixes are told by a hash.
    """
    def prefixes(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda d: F.struct(d.alias("d"), F.xxhash64(F.slice(parts, F.lit(1), d)).alias("at")))

    parts = {"own": F.split(F.substring("template", 2, 1 << 30), "/"), "raw": F.split("raw_key", "/")}
    known, asked = tree.where("labelled > 0 and raw_key <> ''"), tree.join(
        tree.groupBy("host", "template").agg(F.sum("labelled").alias("have")).where("have = 0").drop("have"), ["host", "template"], "left_semi").where("raw_key <> ''")
    found = []
    for rank, (name, what, keys) in enumerate((("raw", "hosts", ["at"]), ("own", "parent", ["host", "at"]))):
        sums = known.select("host", "labelled", "bad", F.explode(prefixes(parts[name])).alias("p")).select("host", "p.at", "labelled", "bad")
        sums = sums.groupBy(*keys).agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")).where(F.col("l") >= least)
        want = asked.select("host", "raw_key", F.explode(prefixes(parts[name])).alias("p")).select("host", "raw_key", "p.d", "p.at")
        found.append(want.join(sums, keys).select("host", "raw_key", F.struct("d", F.lit(rank).alias("rank"), F.lit(what).alias("evidence"), "l", "b").alias("e")))
    return found[0].union(found[1]).groupBy("host", "raw_key").agg(F.max("e").alias("e")).select("host", "raw_key", "e.evidence", "e.l", "e.b")


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url",
    threshold: float = 0.7, smoothing: float = 10.0, **tree_options,
) -> DataFrame:
    """One row per page: ``id, host, path, rule, verdict, template, purity, evidence``.

    ``labels(id, bad boolean)`` names good and bad pages; if it isn't given, the rules' own verdicts are the labels.
    ``purity`` is (bad + smoothing * rate) / (labelled + smoothing) of the page's template on its host, ``rate`` being that
    of all labels. A template without labels takes the bad and labelled of :func:`borrowed_evidence`; ``evidence`` says
    ``own``, ``parent`` or ``hosts``, and is null where there is none: ``purity`` is ``rate`` then, which blocks nothing. A
    page with evidence but without a rule is blocked from ``threshold`` up. Null ids and urls are judged like others; a null
    or odd url has an empty host and path, whose template is empty. Without any label nothing is blocked by the tree.
    Repeated rows stay. Other columns are not read.
    """
    host, path = split_url(F.col("url"))
    base = pages.select(named(id_col).alias("id"), named(url_col).alias("url")).select("id", host.alias("host"), path.alias("path"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    base = base.select("*", rule.alias("rule"), verdict.alias("ruled"), F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), _shape).alias("raw"))
    if labels is None:
        base = base.withColumn("bad", F.col("ruled") == "block")
    else:
        marks = labels.where("id is not null and bad is not null").groupBy("id").agg(F.max("bad").alias("bad"))
        base = base.join(marks, "id", "left")
    base = base.withColumn("raw_key", F.array_join("raw", "/"))
    leaf = cut(base.groupBy("host", "raw").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.count_if("bad").alias("bad")), "leaves")
    tree = template_tree(leaf, **tree_options)
    totals = leaf.agg(F.sum("labelled"), F.sum("bad")).first()
    rate = (totals[1] or 0) / (totals[0] or 1)
    own = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    borrowed = borrowed_evidence(tree)
    both = tree.select("host", "raw_key", "template").join(own, ["host", "template"]).join(borrowed, ["host", "raw_key"], "left")
    labelled, bad = F.col("labelled") + F.coalesce("l", F.lit(0)), F.col("bad") + F.coalesce("b", F.lit(0))
    known = both.select("host", "raw_key", "template", ((bad + smoothing * rate) / (labelled + smoothing)).alias("purity"), F.when(F.col("labelled") > 0, "own").otherwise(F.col("evidence")).alias("evidence"))
    final = F.coalesce("ruled", F.when(F.col("evidence").isNotNull() & (F.col("purity") >= threshold), "block").otherwise("allow"))
    return base.join(known, ["host", "raw_key"], "left").select("id", "host", "path", "rule", final.alias("verdict"), "template", "purity", "evidence")
