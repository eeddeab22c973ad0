"""URL filters: rules by host and path, and below them templates of paths that labelled URLs show to be bad.

Per host, paths grow into a tree, segment by segment. Digits in a segment are a wildcard. At each node the branches whose
labels and next segments look alike form a pool: a pool of many branches is a variable segment, and branches that differ
from the rest of their pool by no more than chance (chi square over bad, good and unlabelled URLs) are merged; both become
one wildcard branch. A whole path in the tree is a template. A template is rejected when its smoothed share of bad
labelled URLs is high enough. URLs that a rule decides are labelled by it; more labels may be given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, written

#: Levels of the tree; the segments from the last level on count as one.
DEPTH = 8
#: More branches than this in a pool are values of a variable.
FANOUT = 20
#: 95 % of chi square with two degrees of freedom.
CHI = 5.991
#: A template goes from this smoothed share on: (bad + 1) / (bad + good + 2).
PURITY = 0.9


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; both empty without "://" or for a null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (host, path, verdict) that fits, else nulls. A rule fits subdomains of its host and longer paths."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def path_segments(path: Column, depth: int = DEPTH) -> Column:
    """Segments of a path with digits as #, the depth-th and later ones as one; none for an empty path."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, r"^/", ""), r"[0-9]+", "#"), "/", depth)
    return F.when(path == "", F.array().cast("array<string>")).otherwise(parts)


def _branches(paths: DataFrame, level: int) -> DataFrame:
    """(host, prefix, child, branch, rows): the branch that each child of each node at a level belongs to."""
    sums = [F.sum(c).alias(c) for c in ("n", "bad", "good")]
    following = paths.groupBy("host", "prefix", "child", F.coalesce(F.get("segs", F.lit(level + 1)), F.lit("/")).alias("next")).agg(*sums, F.count(F.lit(1)).alias("rows"))
    child = following.groupBy("host", "prefix", "child").agg(F.max_by("next", F.struct("n", "next")).alias("next"), *sums, F.sum("rows").alias("rows")).withColumn("none", F.expr("n - bad - good"))
    outcome = F.when((F.col("none") >= F.col("bad")) & (F.col("none") >= F.col("good")), "none").when(F.col("bad") >= F.col("good"), "bad").otherwise("good")
    child = written(child.withColumn("pool", F.concat("next", F.lit(" "), outcome)))
    pools = child.filter("not child like '%#%'").groupBy("host", "prefix", "pool").agg(F.count(F.lit(1)).alias("k"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "bad", "good", "none")])
    both = lookup(child, written(pools), ["host", "prefix", "pool"], "k", "child")
    n, every = F.col("n").cast("double"), F.col("all_n").cast("double")
    chi = F.lit(0.0)
    for c in ("bad", "good", "none"):
        own, total = F.col(c).cast("double"), F.col(f"all_{c}").cast("double")
        here, there = n * total / every, (every - n) * total / every
        chi = chi + F.when(total > 0, (own - here) * (own - here) / here + (total - own - there) * (total - own - there) / there).otherwise(0.0)
    merged = (F.col("k") > FANOUT) | (F.col("k") > 1) & (chi <= CHI)
    named = both.filter("not child like '%#%'").select("host", "prefix", "child", "rows", F.when(merged, F.concat(F.lit("* "), "pool")).otherwise(F.col("child")).alias("branch"))
    return written(named.union(child.filter("child like '%#%'").select("host", "prefix", "child", "rows", F.col("child").alias("branch"))))


def path_templates(paths: DataFrame, depth: int = DEPTH) -> DataFrame:
    """paths (host, segs, n, bad, good; one row each) with template: level by level, each row one step down the tree."""
    done = written(paths.withColumn("prefix", F.lit("")))
    deepest = done.agg(F.max(F.size("segs"))).head()[0] or 0
    for level in range(min(deepest, depth)):
        over, on = done.filter(F.size("segs") <= level), done.filter(F.size("segs") > level).withColumn("child", F.get("segs", F.lit(level)))
        stepped = lookup(on, _branches(on, level), ["host", "prefix", "child"], "rows", "segs")
        done = written(over.union(stepped.withColumn("prefix", F.concat("prefix", F.lit("/"), "branch")).select(*done.columns)))
    return done.withColumnRenamed("prefix", "template")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", bad_col: str | None = None) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, template, n_bad, n_good, purity (of the template; all URLs, repeats included).

    verdict is the longest fitting rule's, else block where the template's purity is at least 0.9, else allow. bad_col
    names a boolean column of pages with more labels (null: none); a rule's verdict comes before it. A null or odd url
    has an empty host and path, and the template of these. Repeated rows give one row each and count as often; null ids
    are kept; very long paths have their end in one segment; other columns aren't read; no rows give no rows.
    """
    host, path = host_and_path(F.col(url_col))
    plain = pages.select(F.col(id_col).alias("id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), (F.col(bad_col) if bad_col else F.lit(None).cast("boolean")).alias("bad"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    ruled = plain.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("segs", path_segments(F.col("path")))
    bad = F.coalesce(F.col("ruled") == "block", F.col("bad"))
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias
    paths = ruled.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), one(bad)("bad"), one(~bad)("good"))
    placed = path_templates(paths)
    sums = placed.groupBy("host", "template").agg(F.sum("bad").alias("n_bad"), F.sum("good").alias("n_good"), F.count(F.lit(1)).alias("rows"))
    judged = lookup(placed.select("host", "segs", "n", "template"), written(sums), ["host", "template"], "rows", "segs")
    purity = (F.col("n_bad") + 1) / (F.col("n_bad") + F.col("n_good") + 2)
    facts = written(judged.select("host", "segs", "n", "template", "n_bad", "n_good", purity.alias("purity")))
    found = lookup(ruled, facts, ["host", "segs"], "n", "id")
    final = F.coalesce("ruled", F.when(F.col("purity") >= PURITY, "block").otherwise("allow"))
    return found.select(F.col("id").alias(id_col), "host", "path", "rule", final.alias("verdict"), "template", "n_bad", "n_good", "purity")
