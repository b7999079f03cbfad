"""URL filters: host-suffix and path-prefix expressions, looked up by short hash prefix.

Each URL is expanded into the expressions (last k host labels + path prefix) whose shape occurs in the
rule table. The expressions meet the rules in an equi-join on the first 32 bits of their SHA-256 digest;
the full digest is compared afterwards, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: A rule table of at most this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_RULES = 200_000
PREFIX_HEX = 8


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rules: (action, host, path) with action allow or block."""
    return spark.createDataFrame(rules, "action string, rule_host string, rule_path string")


def _slashes(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))


def _expressions(host: Column, path: Column, shapes: dict[str, list[int]]) -> Column:
    """All expressions of a URL whose shape some rule has; rules fit whole host labels and any path prefix."""
    ints = lambda v: F.array(*map(F.lit, v)).cast("array<int>")
    labels = F.split(host, r"\.")
    hosts = F.transform(F.filter(ints(shapes["labels"]), lambda k: k <= F.size(labels)), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    by_length = F.transform(F.filter(ints(shapes["lengths"]), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    by_depth = F.transform(F.filter(ints(shapes["depths"]), lambda d: d <= _slashes(path)), lambda d: F.concat(_before(path, d), F.lit("/")))
    paths = F.concat(by_length, by_depth)
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def _before(path: Column, d: Column) -> Column:
    """What stands before the d-th slash."""
    return F.call_function("substring_index", path, F.lit("/"), d)


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule and verdict for its url column; same-named columns of df stay as in_host and so on.

    * A rule fits its host and all subdomains of it, where the URL's path starts with the rule's path. A rule
      whose path is empty fits every path of the host; an empty path starts only with the empty path.
    * The rule with the longest host + path text wins; of two equal ones, block wins. Rules with a null part
      or host are read as if that part were empty, and an empty host fits nothing.
    * Null URLs and those without :// have empty host and path, no rule and the default verdict.
    * Repeated rows and null ids are kept, an empty table gives an empty result.
    """
    r = rules.select(
        F.coalesce("action", F.lit("block")).alias("__action"),
        F.translate(F.coalesce("rule_host", F.lit("")), UPPER, LOWER).alias("__rh"),
        F.coalesce("rule_path", F.lit("")).alias("__rp"),
    ).filter("__rh <> ''")
    dirs = F.col("__rp").endswith("/")
    shape = r.agg(
        F.collect_set(F.size(F.split("__rh", r"\."))).alias("labels"),
        F.collect_set(F.when(dirs, _slashes(F.col("__rp")))).alias("depths"),
        F.collect_set(F.when(~dirs, F.length("__rp"))).alias("lengths"),
        F.count("*").alias("n"),
    ).first()  # a few integers: label counts, path depths and lengths that occur in rules
    # the caller's columns go under numbers, so none of their names can clash with one in here
    keyed = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)], host_of(F.col(f"`{url}`")).alias("__host"), path_of(F.col(f"`{url}`")).alias("__path"))
    expression = F.concat("__rh", "__rp")
    table = r.groupBy(F.sha2(expression, 256).alias("__digest")).agg(
        F.max(F.struct(F.length(expression).alias("n"), (F.col("__action") == "block").alias("block"), expression.alias("rule"))).alias("__rule")
    ).withColumn("__prefix", F.substring("__digest", 1, PREFIX_HEX))
    if shape["n"] <= BROADCAST_RULES:
        table = F.broadcast(table)
    shapes = {k: sorted(shape[k]) for k in ("labels", "depths", "lengths")}
    found = (
        keyed.select("__host", "__path").distinct().filter("__host <> ''")
        .select("__host", "__path", F.explode(_expressions(F.col("__host"), F.col("__path"), shapes)).alias("__e"))
        .select("__host", "__path", F.sha2("__e", 256).alias("__d"))
        .withColumn("__prefix", F.substring("__d", 1, PREFIX_HEX))
        .join(table, "__prefix")
        .filter("__d = __digest")
        .groupBy("__host", "__path")
        .agg(F.max("__rule").alias("__won"))
    )
    # rows without a host can meet no rule; they all have one key, so they take no part in the join
    met = keyed.filter("__host <> ''").join(found, ["__host", "__path"], "left")
    out = met.unionByName(keyed.filter("__host = ''").withColumn("__won", F.lit(None).cast(found.schema["__won"].dataType)))
    own, names = ("host", "path", "rule", "verdict"), []
    taken = {*own, *(c.lower() for c in df.columns)}
    for c in df.columns:
        name = f"in_{c}" if c.lower() in own else c
        while name != c and name.lower() in taken:
            name = f"in_{name}"
        taken.add(name.lower())
        names.append(name)
    keep = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    return out.select(
        *keep,
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.col("__won.rule").alias("rule"),
        F.when(F.col("__won").isNull(), F.lit(default)).when(F.col("__won.block"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
    )


#: Fixed values of the query's contract.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
r(verdict, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT u.host AS h, u.path AS p, arg_max(r.rh || r.rp, length(r.rh || r.rp)) AS rule, arg_max(r.verdict, length(r.rh || r.rp)) AS verdict
  FROM (SELECT DISTINCT host, path FROM u) u JOIN r ON (u.host = r.rh OR ends_with(u.host, '.' || r.rh)) AND starts_with(u.path, r.rp)
  GROUP BY ALL)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM u LEFT JOIN m ON u.host = m.h AND u.path = m.p
"""
