"""The pipeline, stage by stage, against plain decisions."""

from collections import Counter

from pyspark.sql import functions as F
from test_decontam import brute as leaks
from test_neardup import brute as classes

import corpus_pipeline
from lodestar.llm import toxicity


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near duplicates", "decontamination", "mixing", "token ids"]
    texts = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]

    one = stages["toxicity"](spark, docs, sf).cache()
    g = toxicity.Grammar(toxicity.learn(toxicity.training_rows(docs, spark.read.parquet(f"{sf}/labels.parquet"))))
    assert sorted(d for d, _ in texts(one)) == sorted(d for d, t in texts(docs) if g.score(t) < 0.5)
    two = stages["near duplicates"](spark, one, sf).cache()
    assert sorted(d for d, _ in texts(two)) == sorted({c for _, c, _ in classes(texts(one))})
    three = stages["decontamination"](spark, two, sf).cache()
    gone = {d for d, _, _ in leaks(texts(two), items)}
    assert {d for d, _ in texts(three)} == {d for d, _ in texts(two)} - gone
    four = stages["mixing"](spark, three, sf).cache()
    assert one.columns == two.columns == three.columns == four.columns == docs.columns
    assert {d for d, _ in texts(four)} <= {d for d, _ in texts(three)}
    five = stages["token ids"](spark, four, sf)
    assert Counter(r["doc_id"] for r in five.collect()) == Counter(d for d, _ in texts(four))


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 0 and got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def odd_rows(spark):
    """documents with nulls in every column, empty and very long texts, repeated rows and a clashing column."""
    long = " ".join(f"word{i}" for i in range(30000))
    rows = [(1, "a calm text of a few words that stands alone here", "en", "src0", 9, 1.0), (None, None, None, None, None, None), (2, "", "en", None, 0, 0.5), (3, long, None, "src1", 5, 0.1)]
    rows += [(4, "one row that comes twice in the table as it is", "de", "src2", 4, 0.2)] * 2 + [(5, "one row that comes twice in the table as it is", "de", "src2", 4, 0.2), (None, "a text without an id", "fr", "src3", 5, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")


def side_tables(spark, path, empty):
    labels = [] if empty else [(1, 1, 0), (None, None, None), (4, 0, None), (99, 1, 1)]
    items = [] if empty else [(1, " ".join(f"word{i}" for i in range(500, 540))), (None, None), (2, "")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_on_odd_rows(spark, tmp_path):
    stages, docs, sf = dict(corpus_pipeline.STAGES), odd_rows(spark), side_tables(spark, tmp_path, empty=False)
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=str)
    every = [1, 2, 3, 4, 4, 5, None, None]
    assert ids(stages["toxicity"](spark, docs, sf)) == every
    # equal texts are one class: 4 twice and 5; null and empty text are equal, and the row with an id stays
    one = stages["near duplicates"](spark, docs, sf)
    assert ids(one) == [1, 2, 3, 4, None] and one.columns == docs.columns
    clean = stages["decontamination"](spark, docs, sf)
    assert ids(clean) == [1, 2, 4, 4, 5, None, None] and clean.columns == docs.columns
    mixed = stages["mixing"](spark, docs, sf)
    assert mixed.columns == docs.columns and set(ids(mixed)) <= set(every)
    got = stages["token ids"](spark, docs, sf).collect()
    assert len(got) == len(every) and min(r["n_tokens"] for r in got) == 1


def test_stages_on_empty_tables(spark, tmp_path):
    sf, docs = side_tables(spark, tmp_path, empty=True), odd_rows(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), sf)
        assert out.count() == 0 and (name == "token ids" or out.columns == docs.columns)
        assert stage(spark, docs, sf).count() > 0


def test_columns_pass_through_whatever_their_names(spark, tmp_path):
    sf, docs = side_tables(spark, tmp_path, empty=False), odd_rows(spark)
    odd = ["__own", "__t", "__many", "__rep", "__tokens", "__domain", "__lang", "__o", "__text", "t", "own", "rep", "k", "c0", "d"]
    for c in odd:
        docs = docs.withColumn(c, F.lit("own " + c))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == "own " + c for r in rows for c in odd), name
    assert len(corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()) == docs.count()
