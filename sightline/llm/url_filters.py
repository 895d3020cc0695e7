"""URL block and allow rules by a sort-merge range join (operator 10, DataFrame functions only).

A host is written with its labels reversed and a full stop after each (`net.example.www.`), so that a
rule for a host and all its subdomains is the interval of keys with the rule's key as prefix. A rule's
path is again an interval: of the keys `host key + \\0 + path`. Such intervals are nested or disjoint.

Both joins are one sweep: rules and points are sorted together, each rule carries the stack of rules
that are open at its start, and a point takes the stack of the last rule before it and keeps what
still covers it. First all points are swept over the rules' hosts, then each (point, open host) over
the paths of that host. The longest fitting rule wins.

The sort is split by boundaries from a sample; a bucket is opened with the rules that cover its lower
boundary. Rows with one key are told apart by a hash of their row id, so one hot host, or one hot URL,
spreads over many buckets.

Defined results: a null URL or one without `://` has an empty host and path; no rule fits it. Rules of
one (host, path) count once, `block` before `allow`; between rules of one length the longer host wins.
Null rules are ignored. Rows with equal or null ids are each judged. Without rules or rows the result
is the default verdict, or empty. Other columns of the input are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii, numbered

#: Sampled keys per bucket, for the boundaries; a boundary's key is cut after so many characters.
SAMPLE_PER_BUCKET, BOUNDARY_CHARS = 20, 256
_BOUND = "array<struct<k:string,s:bigint>>"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def stacks(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """keys (k) → k, stack: the rules whose key is a prefix of k, by equi-join on the prefixes of k."""
    longest = rules.agg(F.max(F.length("k"))).first()[0] or 0
    prefixes = keys.select("k").distinct().where(F.length("k") > 0).select(
        F.col("k").alias("whole"),
        F.explode(F.sequence(F.lit(1), F.least(F.length("k"), F.lit(max(longest, 1))))).alias("n"),
    ).select("whole", F.expr("substring(whole, 1, n)").alias("k"))
    return (
        prefixes.join(rules, "k")
        .groupBy("whole")
        .agg(F.collect_list(F.struct("k", "rule")).alias("stack"))
        .withColumnRenamed("whole", "k")
    )


def sample_keys(points: DataFrame, buckets: int) -> list:
    """A bounded sample of rows: those with the smallest hashes."""
    return points.orderBy(F.xxhash64("s", F.lit(7)), "s").limit(buckets * SAMPLE_PER_BUCKET).collect()


def boundaries(keys: list[tuple[str, int]], buckets: int) -> list[dict]:
    """At most buckets - 1 cuts through sorted sampled keys."""
    keys = sorted((k[:BOUNDARY_CHARS].encode(), s) for k, s in keys)
    cuts = sorted({keys[i * len(keys) // buckets] for i in range(1, buckets)}) if keys else []
    return [{"k": k.decode(errors="ignore"), "s": s} for k, s in cuts]


def bucket_of(k: Column, s: Column, cuts: list[dict]) -> Column:
    """Number of cuts at or below (k, s), in two steps over about the square root of their number."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    point = F.struct(k.alias("k"), s.alias("s"))

    def below(array: Column) -> Column:
        return F.size(F.filter(array, lambda b: b <= point))

    coarse = F.from_json(F.lit(json.dumps(cuts[::step])), _BOUND)
    fine = F.from_json(F.lit(json.dumps(cuts)), _BOUND)
    block = below(coarse)
    return F.when(block == 0, F.lit(0)).otherwise(
        (block - 1) * step + below(F.slice(fine, (block - 1) * step + 1, F.lit(step)))
    )


def sweep(points: DataFrame, rules: DataFrame, cuts: list[dict]) -> DataFrame:
    """points (k, s, …), rules (k unique, rule) → points with `stack`, the rules whose key is a prefix of k."""
    spark = points.sparkSession
    lowest = F.lit(-(2**63)).cast("bigint")
    chains = stacks(rules, rules)
    opened = rules.join(chains, "k").select("k", "stack", F.lit(0).alias("kind"), lowest.alias("s"))
    opened = opened.withColumn("bucket", bucket_of(F.col("k"), F.col("s"), cuts))
    if cuts:
        rows = [(i + 1, c["k"]) for i, c in enumerate(cuts)]
        starts = spark.createDataFrame(rows, "bucket int, at string")
        carried = starts.join(stacks(starts.select(F.col("at").alias("k")), rules), F.col("at") == F.col("k"))
        carried = carried.select(F.lit("").alias("k"), "stack", F.lit(-1).alias("kind"), lowest.alias("s"), "bucket")
        opened = opened.unionByName(carried)
    events = points.withColumn("kind", F.lit(1)).withColumn("bucket", bucket_of(F.col("k"), F.col("s"), cuts))
    events = events.unionByName(opened, allowMissingColumns=True)
    order = Window.partitionBy("bucket").orderBy("k", "kind", "s").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("open", F.last("stack", ignorenulls=True).over(order)).where("kind = 1")
    covering = F.filter(F.coalesce(F.col("open"), F.array()), lambda r: F.col("k").startswith(r["k"]))
    return swept.withColumn("stack", covering).drop("open", "kind", "bucket")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", buckets: int | None = None) -> DataFrame:
    """pages (page_id, url), rules (host, path, verdict) → page_id, host, path, rule, verdict; one row per page."""
    spark: SparkSession = pages.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rules = (
        rules.where("host is not null and path is not null and verdict is not null")
        .groupBy(lower_ascii(F.col("host")).alias("host"), "path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("node", host_key(F.col("host")))
    )
    nodes = rules.groupBy("node").agg(F.first("host").alias("host")).select(
        F.col("node").alias("k"), F.struct("host").alias("rule")
    )
    size = F.length("host") + F.length("path")
    whole = rules.select(
        F.concat("node", F.lit("\0"), "path").alias("k"),
        F.struct(
            size.alias("size"), F.length("host").alias("labels"), F.concat("host", "path").alias("text"), "verdict"
        ).alias("rule"),
    )
    host, path = split_url(F.col("url"))
    rows = numbered(pages.select("page_id", host.alias("host"), path.alias("path")), "row")
    points = rows.withColumn("k", host_key(F.col("host"))).withColumn("s", F.xxhash64("row"))

    sample = sample_keys(points.select("k", "path", "s"), buckets)
    by_host = sweep(points, nodes, boundaries([(r.k, r.s) for r in sample], buckets))

    def paths(swept: DataFrame) -> DataFrame:
        open_hosts = F.expr("explode_outer(transform(stack, r -> r.k))")
        each = swept.withColumn("node", open_hosts).drop("stack")
        return each.withColumn("k", F.concat(F.coalesce("node", "k"), F.lit("\0"), "path")).drop("node")

    second: list[tuple[str, int]] = []
    if sample:
        few = spark.createDataFrame([(r.k, r.path[:BOUNDARY_CHARS], r.s) for r in sample], "k string, path string, s bigint")
        second = [(r.k, r.s) for r in paths(few.join(stacks(few, nodes), "k", "left")).select("k", "s").collect()]
    by_path = sweep(paths(by_host), whole, boundaries(second, buckets))
    best = F.array_max(F.transform("stack", lambda r: r["rule"]))
    return (
        by_path.select("row", "page_id", "host", "path", best.alias("best"))
        .groupBy("row")
        .agg(*(F.first(c).alias(c) for c in ("page_id", "host", "path")), F.max("best").alias("best"))
        .select(
            "page_id",
            "host",
            "path",
            F.col("best.text").alias("rule"),
            F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        )
    )
