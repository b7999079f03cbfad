"""Mixing sources to target weights by hierarchical budgets. DataFrame functions only.

Weights are propagated from the root of a domain-language-source tree to its leaves. A node that cannot fill
its share (its documents, repeated max_epochs times, are fewer tokens) hands the shortage to its siblings by
weight, and only what a whole subtree lacks reaches the ancestors. Each leaf takes a prefix of its documents in
a seeded order, epoch after epoch. The order is cut into hash buckets of bounded size: bucket sums find the
bucket in which the prefix ends, and only that bucket is ordered row by row, so a leaf with a third of all
documents never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.common import WS_CLASS, trimmed, written

LEVELS = ("domain", "lang", "source")
#: Rows in a bucket of the seeded order, on average.
BUCKET_ROWS = 1024
#: A plan of at most this many leaves is broadcast, so that texts aren't shuffled; a larger one is joined by shuffle.
BROADCAST_LEAVES = 200_000


def tokens_of(text: Column) -> Column:
    """White-space words."""
    t = trimmed(text)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, WS_CLASS))).cast("long")


def _fill(nodes: DataFrame, parent: list[str], key: str) -> DataFrame:
    """Shares a parent's budget among children by weight, each up to its capacity (water filling).

    nodes: parent columns, key, weight, capacity, budget (the parent's). Children are taken by capacity per
    weight; one that its share would overfill gets its capacity, the rest share what is left by weight.
    """
    w = W.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), F.col(key))
    before = w.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*parent)
    left = F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    x = nodes.withColumn("__left", left).withColumn("__weight", weight)
    full = F.col("capacity").cast("double") * F.col("__weight") <= F.col("__left").cast("double") * F.col("weight")
    x = x.withColumn("__full", full)
    # the first child that is not full fixes the level of all later ones
    first = F.first(F.when(~F.col("__full"), F.struct(F.col("__left").alias("l"), F.col("__weight").alias("w"))), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    x = x.withColumn("__level", first)
    share = F.floor(F.col("weight").cast("double") * F.col("__level.l").cast("double") / F.col("__level.w").cast("double"))
    return x.withColumn("budget", F.when(F.col("__level").isNull(), F.col("capacity")).otherwise(F.least(F.col("capacity"), share)).cast("long")).drop("__left", "__weight", "__full", "__level")


def leaf_budgets(leaves: DataFrame, budget: int | None, percent: int, max_epochs: int) -> DataFrame:
    """leaves: domain, lang, source, domain_weight, lang_weight, source_weight, tokens -> the same with budget.

    budget None: percent of all tokens there are. A budget over the capacity of the tree is cut to it.
    """
    x = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    langs = x.groupBy("domain", "lang").agg(F.first("domain_weight").alias("domain_weight"), F.first("lang_weight").alias("weight"), F.sum("cap").alias("capacity"))
    domains = langs.groupBy("domain").agg(F.first("domain_weight").alias("weight"), F.sum("capacity").alias("capacity"))
    total = domains.agg(F.sum("capacity").alias("__cap"))
    want = F.lit(budget).cast("long") if budget is not None else F.floor(F.col("__cap") / max_epochs * percent / 100)
    root = total.select(F.least(want, F.col("__cap")).cast("long").alias("budget"))
    d = _fill(domains.crossJoin(F.broadcast(root)).withColumn("__root", F.lit(0)), ["__root"], "domain").select("domain", "budget")
    lg = _fill(langs.join(d, "domain"), ["domain"], "lang").select("domain", "lang", "budget")
    s = x.select("domain", "lang", "source", F.col("source_weight").alias("weight"), F.col("cap").alias("capacity"), "tokens", "n")
    return _fill(s.join(lg, ["domain", "lang"]), ["domain", "lang"], "source")


def _order(seed: int, epoch: Column, doc: Column, text: Column) -> Column:
    """The seeded place of a row: by its id and the digest of its text, as ids may be null or come again."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit("")), text))


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], budget: int | None = None, percent: int = 100, max_epochs: int = 4, seed: int = 17, doc: str = "doc_id", text: str = "text", bare: bool = False) -> DataFrame:
    """docs' rows that the budget takes, with __epoch, __domain and __tokens (bare: without); a row comes once for each epoch.

    weights: per level of LEVELS the weight of a name; names that are not listed weigh 1 (at least 1 each). Null
    names form a node of their own, named ''. The prefix of a leaf is the longest whose tokens stay within its
    budget; rows are ordered by their seeded ids and texts, so different texts without an id or with the same one
    have places of their own, and rows that agree in both are taken or left together. Texts without words cost nothing and come with every epoch, and with the prefix they
    stand in of an epoch that is taken in part; a leaf with no words at all gives each text once. Tables without a
    lang or source column have one node at that level.
    """
    named = lambda c: F.coalesce(F.col(c), F.lit("")) if c in docs.columns else F.lit("")
    names = {"domain": F.coalesce(domain, F.lit("")), "lang": named("lang"), "source": named("source")}
    # the caller's columns go under numbers, so none of their names can clash with one in here
    cols = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    base = docs.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], *[v.alias(f"__{k}") for k, v in names.items()],
        tokens_of(F.col(f"`{text}`")).alias("__tokens"), F.col(f"`{doc}`").alias("__doc"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")).alias("__text"),
    )
    key = ["__domain", "__lang", "__source"]
    # texts are read twice: once for their sizes, once for the rows that are taken
    light = written(base.select(*key, "__doc", F.unhex("__text").alias("__text"), "__tokens"), "sizes").withColumn("__text", F.lower(F.hex("__text")))
    sized = light.groupBy(*key).agg(F.sum("__tokens").alias("tokens"), F.count("*").alias("n"))

    def weight(level: str) -> Column:
        listed = weights.get(level, {})
        table = F.create_map(*[F.lit(x) for kv in listed.items() for x in kv]) if listed else None
        return F.greatest(F.lit(1), F.coalesce(F.element_at(table, F.col(level)), F.lit(1)) if table is not None else F.lit(1)).cast("long")

    leaves = sized.select(*[F.col(f"__{k}").alias(k) for k in LEVELS], "tokens", "n").withColumns({f"{k}_weight": weight(k) for k in LEVELS})
    plan = written(leaf_budgets(leaves, budget, percent, max_epochs).select(
        *[F.col(k).alias(f"__{k}") for k in LEVELS],
        F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(1)).cast("int").alias("__full"),
        F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(F.lit(0)).alias("__rest"),
        F.ceil(F.col("n") / BUCKET_ROWS).cast("long").alias("__buckets"),
    ), "plan")
    sent = F.broadcast if plan.count() <= BROADCAST_LEAVES else lambda x: x

    def dealt(rows: DataFrame) -> DataFrame:
        """Rows with their place in the partial epoch, number __full: its order, cut into buckets."""
        x = rows.join(sent(plan), key).withColumn("__o", _order(seed, F.col("__full"), F.col("__doc"), F.col("__text")))
        unit = F.conv(F.substring("__o", 1, 8), 16, 10).cast("long")
        return x.withColumn("__b", F.floor(unit * F.col("__buckets") / F.lit(1 << 32)).cast("long"))

    small = dealt(light)
    sums = small.groupBy(*key, "__b").agg(F.sum("__tokens").alias("__sum"), F.first("__rest").alias("__rest"))
    upto = W.partitionBy(*key).orderBy("__b")
    cut = sums.withColumn("__end", F.sum("__sum").over(upto)).filter("__end > __rest").groupBy(*key).agg(F.min(F.struct("__b", (F.col("__rest") - F.col("__end") + F.col("__sum")).alias("left"))).alias("__cut"))
    cut = written(cut.select(*key, F.col("__cut.__b").alias("__cut_b"), F.col("__cut.left").alias("__left")), "cut")
    edge = small.select(*key, "__b", "__o", "__tokens").join(sent(cut), key).filter("__b = __cut_b")
    run = W.partitionBy(*key).orderBy("__o", "__tokens").rangeBetween(W.unboundedPreceding, W.currentRow)
    last = edge.withColumn("__run", F.sum("__tokens").over(run)).filter("__run <= __left").groupBy(*key).agg(F.max(F.struct("__o", "__tokens")).alias("__last"))
    chosen = dealt(base).join(sent(written(cut.join(last, key, "left"), "last")), key, "left")
    upto_last = (F.col("__b") == F.col("__cut_b")) & (F.struct(F.col("__o"), F.col("__tokens")) <= F.col("__last"))
    partial = (F.col("__rest") > 0) & (F.col("__cut_b").isNull() | (F.col("__b") < F.col("__cut_b")) | upto_last)
    copies = F.col("__full") + F.coalesce(partial, F.lit(False)).cast("int")
    out = chosen.withColumn("__n", copies).filter("__n > 0").withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return out.select(*cols, *([] if bare else ["__domain", "__tokens", "__epoch"]))


#: The query's tree: sources by domain, weights by name. Fixed values of this query.
DOMAINS = {"web": ["src0", "src1", "src2", "src3", "src4", "src5", "src6", "src7", "src8", "src9"], "reference": ["src10", "src11", "src12", "src13", "src14"], "forum": ["src15", "src16", "src17", "src18", "src19"]}
WEIGHTS = {"domain": {"web": 5, "reference": 3, "forum": 2}, "lang": {"en": 6, "fr": 2, "de": 2, "es": 1}, "source": {"src0": 2}}
PERCENT, MAX_EPOCHS, SEED = 100, 2, 17


def domain_of(source: Column) -> Column:
    table = F.create_map(*[F.lit(x) for d, names in DOMAINS.items() for s in names for x in (s, d)])
    return F.coalesce(F.element_at(table, source), F.lit("other"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    mixed = mix(docs, domain_of(F.coalesce("source", F.lit(""))), WEIGHTS, percent=PERCENT, max_epochs=MAX_EPOCHS, seed=SEED)
    return mixed.select("doc_id", F.col("__epoch").cast("long").alias("epoch"), F.col("__domain").alias("domain"), "lang", "source", F.col("__tokens").alias("n_tokens"))


def _case(col: str, table: dict, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {other} END"


def _fill_sql(name: str, src: str, parent: str, key: str) -> str:
    return f"""
{name}a AS (SELECT *, budget - coalesce(sum(capacity) OVER (PARTITION BY {parent} ORDER BY capacity / weight, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
       sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER (PARTITION BY {parent} ORDER BY capacity / weight, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w FROM ({src})),
{name}b AS (SELECT *, capacity::DOUBLE * w::DOUBLE <= l::DOUBLE * weight::DOUBLE AS filled FROM {name}a),
{name}d AS (SELECT *, first_value(CASE WHEN NOT filled THEN {{'l': l::DOUBLE, 'w': w::DOUBLE}} END IGNORE NULLS) OVER (PARTITION BY {parent} ORDER BY capacity / weight, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM {name}b),
{name} AS (SELECT * EXCLUDE (budget, l, w, filled, level), CASE WHEN level IS NULL THEN capacity ELSE least(capacity, floor(weight::DOUBLE * level.l / level.w)::BIGINT) END::BIGINT AS budget FROM {name}d)"""


SQL = f"""
WITH t AS (SELECT doc_id, md5(coalesce(text, '')) AS digest, coalesce(lang, '') AS lg, coalesce(source, '') AS src, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tok,
      {_case("coalesce(source, '')", {s: f"'{d}'" for d, n in DOMAINS.items() for s in n}, "'other'")} AS domain FROM documents),
leaf AS (SELECT domain, lg, src, sum(tok)::BIGINT AS tokens, sum(tok)::BIGINT * {MAX_EPOCHS} AS cap FROM t GROUP BY ALL),
root AS (SELECT least(floor(sum(cap) / {MAX_EPOCHS} * {PERCENT} / 100)::BIGINT, sum(cap))::BIGINT AS budget FROM leaf),
{_fill_sql("dom", f"SELECT domain, sum(cap)::BIGINT AS capacity, {_case('domain', WEIGHTS['domain'], '1')}::BIGINT AS weight, any_value(budget) AS budget, 0 AS r FROM leaf, root GROUP BY domain", "r", "domain")},
{_fill_sql("lan", f"SELECT domain, lg, sum(cap)::BIGINT AS capacity, {_case('lg', WEIGHTS['lang'], '1')}::BIGINT AS weight, any_value(budget) AS budget FROM leaf JOIN (SELECT domain, budget FROM dom) USING (domain) GROUP BY domain, lg", "domain", "lg")},
{_fill_sql("sou", f"SELECT domain, lg, src, tokens, cap AS capacity, {_case('src', WEIGHTS['source'], '1')}::BIGINT AS weight, budget FROM leaf JOIN (SELECT domain, lg, budget FROM lan) USING (domain, lg)", "domain, lg", "src")},
plan AS (SELECT domain, lg, src, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS n_full, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM sou),
o AS (SELECT t.*, n_full, rest, sum(tok) OVER (PARTITION BY domain, lg, src ORDER BY md5('{SEED}|' || n_full || '|' || coalesce(doc_id::VARCHAR, '') || '|' || digest), tok RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM t JOIN plan USING (domain, lg, src)),
k AS (SELECT *, n_full + CASE WHEN rest > 0 AND run <= rest THEN 1 ELSE 0 END AS n FROM o)
SELECT doc_id, unnest(range(n))::BIGINT AS epoch, domain, lang, source, tok AS n_tokens FROM k WHERE n > 0
"""
