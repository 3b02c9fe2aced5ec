"""URL rules as a sort-merge range join, in DataFrame operations only.

A rule names a host and a path prefix and fits that host and its subdomains.
The canonical key of a host and path is the host's labels in reverse order, a
slash and the path; a rule is then the interval of keys that begin with its own
key, from that key to the key followed by byte FF, which no text holds.  A URL
stands in the sweep once for each of its host's suffixes that some rule names,
since a rule's path follows its own host.

Intervals of one host are nested or apart.  The sweep sorts rule openings, URLs
and rule closings by key.  The running sum of +1 and -1 is the height of the
stack of open rules, and the stack's top at height h is the last opening that
reached height h; both are running windows.

Distribution: distinct (host, path) pairs are found first, by an aggregate that
combines before the shuffle.  The sweep is cut into slices by a hash of the
whole pair and, for large rule sets, of the rule's host; every slice has as many
URLs as any other, however common a host, and gets the rules of its hosts.
Rules are repeated once for each salt; the number of salts shrinks as the rule
set grows.

Defined results: the host is what follows the first ``://`` up to ``/ ? #`` or
the end, with A-Z lower-cased; the path what follows up to ``? #`` or the end;
a null URL or one without ``://`` has empty ones and fits no rule.  The longest
fitting rule wins; among equally long ones the one with the longer host, then
block.  URLs that no rule fits get the default verdict.  Rows that are repeated
stay repeated; an empty table gives an empty table; with no rules all rows get
the default.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES_A_BUCKET = 2000
MIN_SALTS = 16
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 2), F.lit(""))


def canonical_key(host: Column, path: Column) -> Column:
    """Reversed labels, a slash and the path, as bytes."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("/"), path).cast("binary")


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """(rule, verdict) rows, such as ("net/", "block")."""
    return spark.createDataFrame([(r, v) for v, r in rules], "rule string, verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``; see the module."""
    spark = pages.sparkSession
    slash = F.locate("/", F.col("rule"))
    rules = rules.filter("rule is not null").groupBy("rule").agg(F.max(F.struct("verdict")).alias("v")).select("rule", "v.verdict")
    rules = rules.withColumn("rule_host", F.when(slash > 0, F.substring_index("rule", "/", 1)).otherwise(F.col("rule")))
    rules = rules.withColumn("rule_path", F.when(slash > 0, F.expr("substring(rule, locate('/', rule))")).otherwise(F.lit("")))
    rules = rules.withColumn("rule_host", F.translate("rule_host", UPPER, LOWER))
    n_rules = rules.count()
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not n_rules:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    buckets = -(-n_rules // RULES_A_BUCKET)
    salts = max(MIN_SALTS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets)
    bucket = lambda host: F.pmod(F.xxhash64(host), F.lit(buckets))

    pairs = urls.filter("host <> ''").select("host", "path").distinct()
    suffixes = F.expr("transform(sequence(1, size(labels)), i -> array_join(slice(labels, i, size(labels)), '.'))")
    pairs = pairs.withColumn("labels", F.split("host", r"\.")).select("host", "path", F.explode(F.array_distinct(suffixes)).alias("suffix"))
    hosts = rules.select(F.col("rule_host").alias("suffix")).distinct()
    pairs = pairs.join(F.broadcast(hosts) if n_rules <= BROADCAST_RULES else hosts, "suffix", "left_semi")
    salt = F.pmod(F.xxhash64("host", "path"), F.lit(salts))
    none = F.lit(None).cast("string")
    points = pairs.select(
        (bucket("suffix") * salts + salt).alias("slice"), canonical_key(F.col("suffix"), F.col("path")).alias("key"),
        F.lit(1).alias("kind"), F.lit(0).alias("step"), none.alias("rule"), none.alias("verdict"), "host", "path",
    )
    start = canonical_key(F.col("rule_host"), F.col("rule_path"))
    ends = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(
        (bucket("rule_host") * salts + F.col("salt")).alias("slice"), "rule", "verdict",
        F.explode(F.array(
            F.struct(start.alias("key"), F.lit(0).alias("kind"), F.lit(1).alias("step")),
            F.struct(F.concat(start, F.lit(b"\xff")).alias("key"), F.lit(2).alias("kind"), F.lit(-1).alias("step")),
        )).alias("end"),
    )
    events = points.unionByName(ends.select("slice", "end.key", "end.kind", "end.step", "rule", "verdict", none.alias("host"), none.alias("path")))

    sweep = Window.partitionBy("slice").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    level = Window.partitionBy("slice", "height").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.when(F.col("kind") == 0, F.struct("rule", "verdict"))
    events = events.withColumn("height", F.sum("step").over(sweep)).withColumn("top", F.last(opened, ignorenulls=True).over(level))
    hits = events.filter("kind = 1 and height > 0")
    rank = F.struct(F.length("top.rule"), F.length(F.substring_index("top.rule", "/", 1)), F.col("top.verdict"))
    best = hits.groupBy("slice", "host", "path").agg(F.max_by("top", rank).alias("top")).select("host", "path", "top")
    if buckets > 1:  # a pair's suffixes may then lie in several slices
        best = best.groupBy("host", "path").agg(F.max_by("top", rank).alias("top"))
    out = urls.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))
