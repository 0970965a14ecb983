"""URL filters: a path-template tree for each host, judged by smoothed labelled purity.

Paths become templates. First each segment takes a shape, so that numbers,
hashes and slugs are one segment each. Then, level by level under each host, a
segment stays literal if it has a good share of its parent's pages, or if a good
share of the hosts that have the parent use it (languages, sections); it becomes
a wildcard otherwise. Branches of a template that differ in one literal segment
are merged if their labelled rates do not differ significantly from those of the
other branches together (two-proportion test), from the deepest level up; what
has been merged below counts as one branch above. A branch without labels in its
host is tested by those of its template over all hosts.

A template is rejected if its purity, the share of good pages among its labelled
ones, is too low. It is smoothed with the rate of its templates over all hosts;
that one with the rate of the template without the last segment, and so on up to
the rate of all labelled pages.

Labels may be given; else the pages on which a rule has a verdict are the
labelled ones. A rule's verdict stands where there is one.

The tree is built from distinct shaped paths and their counts, never from
pages: a host with a third of all pages adds no more rows than it has templates.
All steps are aggregations and joins of these counts.

Defined results: a null url or one without ``://`` has an empty host and path
and is judged by the method; repeated rows are judged alike; an empty table
gives an empty result; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, col, fresh, stored

#: (verdict, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Levels of the tree; what is below them is one wildcard.
DEPTH = 6
#: A literal segment needs so many pages, and this share of its parent's.
LEAST_PAGES, LEAST_SHARE = 5, 0.02
#: Or so many hosts, and the same share of those that have its parent.
LEAST_HOSTS = 3
#: Branches merge below this z score; weight of the prior; purity under which a template is rejected.
MERGE_Z, PRIOR, LEAST_PURITY = 1.96, 10.0, 0.5
BROADCAST_ROWS = 200_000
#: Shapes of segments that never are literal, tried in this order.
SHAPES = [
    (r"^\d+$", "<n>"), (r"^\d+(\.[A-Za-z]{2,5})$", "<n>$1"), (r"^\d{4}-\d{2}(-\d{2})?$", "<date>"),
    (r"^(?=.*\d)[0-9a-fA-F]{8,}(-[0-9a-fA-F]{4,})*$", "<hex>"), (r"^[^-_]*([-_][^-_]+){3,}?(\.[A-Za-z]{2,5})?$", "<slug>$2"), (r"^.{40,}$", "<long>"),
]


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url)))
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits; null where none does. Equally long ones: the first by code point."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shape(segment: Column) -> Column:
    out = segment
    for pattern, name in reversed(SHAPES):
        out = F.when(segment.rlike(pattern), F.regexp_replace(segment, pattern, name)).otherwise(out)
    return out


def shaped(path: Column, depth: int = DEPTH) -> Column:
    """The shaped segments of a path, as an array of ``depth`` at most and the rest as one."""
    segments = F.split(F.regexp_replace(path, "^/", ""), "/", depth + 1)
    kept = F.transform(F.slice(segments, 1, depth), shape)
    return F.when(F.size(segments) > depth, F.concat(kept, F.array(F.lit("<rest>")))).otherwise(kept)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def templates(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(host, shape, template, purity, n) from rows (host, shape, good): ``good`` is 1, 0, or null where unlabelled."""
    tree = stored(
        pages.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("good")).withColumn("template", F.array().cast("array<string>")),
        "url-tree",
    )
    deepest = min(depth + 1, tree.agg(F.coalesce(F.max(F.size("shape")), F.lit(0))).first()[0])
    for k in range(deepest):
        seg = F.get("shape", F.lit(k))
        counts = tree.filter(seg.isNotNull()).groupBy("host", "template", seg.alias("seg")).agg(F.sum("n").alias("n"))
        parents = counts.groupBy("host", "template").agg(F.sum("n").alias("of"))
        # A row of counts is one host's, so rows are hosts.
        spread = counts.groupBy("template", "seg").agg(F.count("*").alias("hosts")).filter(F.col("hosts") >= LEAST_HOSTS)
        spread = spread.join(parents.groupBy("template").agg(F.count("*").alias("of_hosts")), "template").filter(F.col("hosts") >= F.col("of_hosts") * F.lit(LEAST_SHARE)).select("template", "seg", F.lit(True).alias("common"))
        often = (F.col("n") >= LEAST_PAGES) & (F.col("n") >= F.col("of") * F.lit(LEAST_SHARE))
        literal = counts.join(parents, ["host", "template"]).join(spread, ["template", "seg"], "left").filter(often | F.col("common")).select("host", "template", "seg", F.lit(True).alias("literal"))
        literal = _small(stored(literal, "url-literal"))
        step = tree.withColumn("seg", seg).join(literal, ["host", "template", "seg"], "left")
        known = F.col("literal").isNotNull() | F.col("seg").startswith("<")
        tree = stored(step.withColumn("template", F.when(F.col("seg").isNull(), F.col("template")).otherwise(F.concat("template", F.array(F.when(known, F.col("seg")).otherwise(F.lit("*")))))).drop("seg", "literal"), "url-tree")
    return merged(tree)


SUMS = ("n", "labelled", "good", "some", "some_good")


def merged_at(by: DataFrame, k: int) -> DataFrame:
    """``by`` (host, template, merged, :data:`SUMS`, rate) with branches merged that differ in segment k of ``merged``, from 0.

    Below the first level a shape stays apart from literals and wildcards, and a branch without siblings stays as it is.
    """
    seg, m = F.get("merged", F.lit(k)), F.col("merged")
    at = by.filter(seg.isNotNull() if k == 0 else seg.isNotNull() & ~seg.startswith("<")).groupBy("host", "merged").agg(*(F.sum(c).alias(c) for c in SUMS[1:]))
    own = F.col("labelled") > 0
    at = at.select("host", "merged", F.when(own, F.col("labelled")).otherwise(F.col("some")).alias("labelled"), F.when(own, F.col("good")).otherwise(F.col("some_good")).alias("good"))
    # A branch's siblings have the same template but for this segment.
    at = at.withColumn("family", F.concat(F.slice("merged", 1, k), F.array(F.lit("*")), F.slice(m, k + 2, F.size(m))))
    pooled = at.groupBy("host", "family").agg(F.sum("labelled").alias("all"), F.sum("good").alias("all_good"), F.count("*").alias("branches"))
    at = at.join(pooled, ["host", "family"]).filter(F.lit(k == 0) | (F.col("branches") > 1))
    rest = F.col("all") - F.col("labelled")
    p, q, pool = (F.try_divide(*map(F.expr, x)) for x in (("good", "labelled"), ("all_good - good", "`all` - labelled"), ("all_good", "`all`")))
    z = F.try_divide(F.abs(p - q), F.sqrt(pool * (1 - pool) * (F.try_divide(F.lit(1.0), F.col("labelled")) + F.try_divide(F.lit(1.0), rest))))
    to = at.filter(F.coalesce(z < MERGE_Z, F.lit(True))).select("host", "merged", "family")
    return by.join(to, ["host", "merged"], "left").select("host", "template", F.coalesce("family", "merged").alias("merged"), *SUMS, "rate")


def rates(everywhere: DataFrame, total: float) -> DataFrame:
    """(template, rate) from (template, some, some_good): each template's rate over all hosts, smoothed with that of the template above it, up to ``total``."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size("template")), lambda j: F.struct(j.alias("j"), F.slice("template", 1, j).alias("prefix")))
    listed = everywhere.select("template", "some", "some_good", F.inline(prefixes))
    upon = listed.groupBy("prefix").agg(F.sum("some").alias("s"), F.sum("some_good").alias("g"))
    # One row a template holds what it has on each of its few levels.
    path = listed.select("template", "j", "prefix").join(upon, "prefix").groupBy("template").agg(F.array_sort(F.collect_list(F.struct("j", "s", "g"))).alias("path"))
    return path.select("template", F.aggregate("path", F.lit(float(total)), lambda above, x: (x["g"] + above * PRIOR) / (x["s"] + PRIOR)).alias("rate"))


def merged(tree: DataFrame) -> DataFrame:
    """Merge branches alike in their labels, level by level, and give each template its smoothed purity."""
    by = stored(tree.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in SUMS[:3])), "url-branches")
    total = by.agg(F.coalesce((F.sum("good") + 1.0) / (F.sum("labelled") + 2.0), F.lit(0.5))).first()[0]  # one number
    everywhere = stored(by.groupBy("template").agg(F.sum("labelled").alias("some"), F.sum("good").alias("some_good")), "url-everywhere")
    everywhere = _small(stored(everywhere.join(rates(everywhere, total), "template"), "url-rates"))
    by = stored(by.withColumn("merged", F.col("template")).join(everywhere, "template").select("host", "template", "merged", *SUMS, "rate"), "url-branches")
    for k in reversed(range(by.agg(F.coalesce(F.max(F.size("template")), F.lit(0))).first()[0])):
        by = stored(merged_at(by, k), "url-branches")
    final = by.groupBy("host", "merged").agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good"), (F.sum(F.col("rate") * F.col("n")) / F.sum("n")).alias("prior"))
    # Rounded, as sums of fractions depend on their order in the last bits.
    final = final.withColumn("purity", F.round((F.col("good") + F.col("prior") * PRIOR) / (F.col("labelled") + PRIOR), 9))
    named = by.select("host", "template", "merged").join(final.select("host", "merged", "purity", "labelled"), ["host", "merged"])
    return stored(tree.select("host", "shape", "template").join(named, ["host", "template"]).select("host", "shape", F.concat(F.lit("/"), F.array_join("merged", "/")).alias("template"), "purity", "labelled"), "url-templates")


def judged(pages: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] = RULES, labels: DataFrame | None = None, key: str = "page_id", least_purity: float = LEAST_PURITY, depth: int = DEPTH) -> DataFrame:
    """``pages`` with a struct ``verdict`` (a free name): host, path, rule, template, purity, verdict.

    ``labels`` may be (key, good), one row a page, good 1 or 0. What is below
    ``depth`` segments of a path is one segment to the tree.
    """
    name, part = fresh(pages, "verdict"), fresh(pages, "url_parts")
    host, path = host_of(col(url)), path_of(col(url))
    out = pages.withColumn(part, F.struct(host.alias("host"), path.alias("path")))
    out = out.withColumn(part, F.struct(col(part)["host"].alias("host"), col(part)["path"].alias("path"), shaped(col(part)["path"], depth).alias("shape"), rule_of(col(part)["host"], col(part)["path"], rules).alias("rule")))
    seen = out.select(col(part)["host"].alias("host"), col(part)["shape"].alias("shape"), *([col(key).alias("key")] if labels is not None else []), (col(part)["rule"]["verdict"] == "allow").cast("long").alias("good"))
    if labels is not None:
        seen = seen.drop("good").join(labels.select(col(key).alias("key"), F.col("good").cast("long").alias("good")), "key", "left")
    known = templates(seen, depth)
    th, ts = fresh(pages, "url_host"), fresh(pages, "url_shape")
    side = known.select(F.col("host").alias(th), F.col("shape").alias(ts), *(F.col(c).alias(fresh(pages, f"url_{c}")) for c in ("template", "purity")))
    out = out.join(_small(side), (col(part)["host"] == col(th)) & (col(part)["shape"] == col(ts)), "left")
    purity, template = col(fresh(pages, "url_purity")), col(fresh(pages, "url_template"))
    method = F.when(purity < least_purity, F.lit("block")).otherwise(F.lit("allow"))
    out = out.withColumn(name, F.struct(
        col(part)["host"].alias("host"), col(part)["path"].alias("path"), col(part)["rule"]["rule"].alias("rule"), template.alias("template"), purity.alias("purity"),
        F.coalesce(col(part)["rule"]["verdict"], method).alias("verdict"),
    ))
    return out.select(*map(col, pages.columns), col(name))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: page_id, host, path, rule, verdict for each page; template and purity besides."""
    out = judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return out.select("page_id", *(F.col(f"verdict.{c}").alias(c) for c in ("host", "path", "rule", "verdict", "template", "purity")))
