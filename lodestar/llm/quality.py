"""Quality rules by cross-document line frequency. DataFrame functions only.

Lines are normalised and hashed (128 bits); the number of distinct documents that hold a line is counted per
host, with partial aggregation before the shuffle. Lines above the host's limit are removed and documents
that lose too much are rejected. The base rules on words, symbols, repeated lines and repeated 5-word
windows are computed inside each row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import WS, WS_CLASS, let

SYMBOLS = "#*$%&|<>"
#: A line goes where more documents of its host hold it than both limits: this many, and this share (1 of N).
MIN_DOCS, SHARE = 20, 100
#: A document is depleted with fewer words left than this, or less than 3 in 10 of its words.
MIN_WORDS, KEEP_TENTHS = 10, 3
WINDOW = 5


def _count_repeats(words: Column) -> Column:
    """Words covered by 5-word windows that stand twice or more in the text (64-bit window hashes)."""

    def covered(s: Column) -> Column:
        at = lambda k: F.get(s, k)["h"]
        twice = F.filter(s, lambda e, k: (e["h"] == at(k + 1)) | (e["h"] == F.get(s, k - 1)["h"]))
        return let(F.sort_array(F.transform(twice, lambda e: e["i"])), lambda p: F.aggregate(F.transform(p, lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - v, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b))

    def beside(x: Column, y: Column, at: int, n: Column) -> Column:
        """Hashes of the first n values of x, each with the one of y that stands `at` places on."""
        return F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(at + 1), n), lambda a, b: F.xxhash64(a, b))

    def windows(w: Column) -> Column:
        """Words are hashed once; two, four and then five of them are joined."""
        n = F.size(w)
        joined = lambda h: beside(let(beside(h, h, 1, n - 1), lambda p: beside(p, p, 2, n - 3)), h, 4, n - 4)
        return let(F.transform(w, lambda x: F.xxhash64(x)), joined)

    def counted(x: Column) -> Column:
        return F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0)).otherwise(let(F.sort_array(F.transform(x, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered))

    return let(words, lambda w: F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(windows(w), counted)))


def base_stats(text: Column) -> dict[str, Column]:
    """The base figures of a text column; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, WS_CLASS), "")
    lines = F.filter(F.split(t, "\n"), lambda line: F.btrim(line, F.lit(WS)) != "")
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _count_repeats(words).cast("long"),
    }


def _normal(line: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(line, WS_CLASS, " "), F.lit(" ")))


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit("second")).alias("b"))


def line_rules(docs: DataFrame, doc: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, share: int = SHARE, with_text: bool = False) -> DataFrame:
    """One row per row of docs: doc, the base figures, base_failed, n_frequent_words, kept (and clean_text).

    Documents are told apart by id and text, so rows that repeat another count once. Null text is empty, null
    hosts form one host. Blank lines are never counted. A document whose base rules fail is not kept; others are
    kept unless they are depleted: words left after removal are under MIN_WORDS or under KEEP_TENTHS in ten.
    """
    base = docs.select(F.col(f"`{doc}`").alias("__doc"), F.col(f"`{text}`").alias("__text"), F.coalesce(F.col(f"`{host}`"), F.lit("")).alias("__host"))
    keyed = base.withColumn("__key", F.xxhash64(F.coalesce("__text", F.lit("")), F.lit("key")))
    lines = F.filter(F.transform(F.split(F.coalesce("__text", F.lit("")), "\n"), _normal), lambda x: x != "")
    of_doc = keyed.select("__doc", "__key", "__host", F.explode(F.array_distinct(F.transform(lines, _hash))).alias("__h"))
    distinct = F.countDistinct(F.struct("__doc", "__key"))
    hosts = keyed.groupBy("__host").agg(distinct.alias("__docs"))
    frequent = (
        of_doc.groupBy("__host", "__h").agg(distinct.alias("__n")).filter(F.col("__n") > min_docs)
        .join(hosts, "__host").filter(F.col("__n") > F.floor(F.col("__docs") / share)).select("__host", "__h")
    )
    n_words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    each = keyed.select("__doc", "__key", "__host", F.posexplode(F.transform(lines, lambda x: F.struct(_hash(x).alias("h"), n_words(x).alias("n")))).alias("__at", "__line")).select("__doc", "__key", "__host", "__at", F.col("__line.h").alias("__h"), F.col("__line.n").alias("__w"))
    gone = each.join(frequent, ["__host", "__h"], "left_semi").repartition("__doc", "__key")
    gone = gone.groupBy("__doc", "__key", "__at").agg(F.first("__w").alias("__w"), F.first("__h").alias("__h")).groupBy("__doc", "__key").agg(F.sum("__w").cast("long").alias("__gone"), *([F.collect_set("__h").alias("__gone_h")] if with_text else [])).withColumnsRenamed({"__doc": "__gone_doc", "__key": "__gone_key"})
    stats = base_stats(F.col("__text"))
    figures = keyed.select("__doc", "__key", *[c.alias(k) for k, c in stats.items()], *(["__text"] if with_text else []))
    joined = figures.join(gone, (F.col("__key") == F.col("__gone_key")) & F.col("__doc").eqNullSafe(F.col("__gone_doc")), "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    cut = F.coalesce("__gone", F.lit(0)).cast("long")
    left = F.col("n_words") - cut
    out = [F.col("__doc").alias(doc), *stats, failed.alias("base_failed"), cut.alias("n_frequent_words"), (~failed & (left >= MIN_WORDS) & (10 * left >= KEEP_TENTHS * F.col("n_words"))).alias("kept")]
    if with_text:
        keep = F.filter(F.split(F.coalesce("__text", F.lit("")), "\n"), lambda x: ~F.array_contains(F.coalesce("__gone_h", F.array().cast("array<struct<a:bigint,b:bigint>>")), _hash(_normal(x))))
        out.append(F.array_join(keep, "\n").alias("clean_text"))
    return joined.select(*out)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_frequent_words")


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
w AS (SELECT doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
win AS (SELECT doc_id, i, words[i:i+4] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, range(5) AS r(k) GROUP BY doc_id),
raw AS (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line FROM d),
ln AS (SELECT doc_id, host, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm FROM raw),
lines AS (SELECT * FROM ln WHERE norm <> ''),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
hosts AS (SELECT host, count(*) AS docs FROM d GROUP BY host),
freq AS (SELECT l.host, l.norm FROM lines l JOIN hosts h USING (host) GROUP BY l.host, l.norm, h.docs HAVING count(DISTINCT doc_id) > {MIN_DOCS} AND count(DISTINCT doc_id) > h.docs // {SHARE}),
gone AS (SELECT doc_id, sum(len(string_split(norm, ' '))) AS n FROM lines SEMI JOIN freq USING (host, norm) GROUP BY doc_id),
s AS (
  SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, coalesce(dl.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS cut
  FROM w LEFT JOIN dl USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - cut >= {MIN_WORDS} AND 10 * (n_words - cut) >= {KEEP_TENTHS} * n_words AS kept,
       cut::BIGINT AS n_frequent_words
FROM s
"""
