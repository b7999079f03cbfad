"""Edge cases of the native operators: nulls, ties, repeated rows, empty tables, clashing names, long texts."""

import hashlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import chat, mixing, quality, urls


def test_url_edges(spark):
    rows = [(1, "HTTP://A.Net/x?y=1", 5), (2, None, 5), (3, "no scheme", 5), (4, "http://example.net/en/a", 5), (5, "http://example.net", 5), (6, "x://y://example.com/de/", 5), (7, "http://b.org/fr/#a/b", 5), (1, "HTTP://A.Net/x?y=1", 5), (8, "http://notexample.com/de/", 5), (9, "http://a.example.com/de/" + "z" * 100000, 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, host long")
    got = Counter((r["page_id"], r["host"], r["path"][:5], r["rule"], r["verdict"]) for r in urls.judge_urls(df, urls.rule_table(spark, urls.RULES)).collect())
    assert got == Counter(
        [(1, "a.net", "/x", "net/", "block")] * 2
        + [(2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "example.net", "/en/a", "example.net/en/", "allow"), (5, "example.net", "", None, "allow"), (6, "y:", "//exa", None, "allow"), (7, "b.org", "/fr/", "org/fr/", "allow"), (8, "notexample.com", "/de/", None, "allow"), (9, "a.example.com", "/de/z", "example.com/de/", "block")]
    )


def test_rules_with_any_prefix_and_ties(spark):
    rules = urls.rule_table(spark, [("allow", "a.b", "/x"), ("block", "a.b", "/x"), ("allow", "b", ""), (None, None, None), ("block", "c", "/q/r")])
    df = spark.createDataFrame([("http://a.b/xyz",), ("http://a.b/y",), ("http://b",), ("http://c/q/r2",), ("http://c/q/",)], "url string")
    got = {r["url"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(df, rules, default="block").collect()}
    assert got == {"http://a.b/xyz": ("a.b/x", "block"), "http://a.b/y": ("b", "allow"), "http://b": ("b", "allow"), "http://c/q/r2": ("c/q/r", "block"), "http://c/q/": (None, "block")}


def test_empty_tables(spark):
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), urls.rule_table(spark, urls.RULES)).count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality.line_rules(docs).count() == 0
    assert mixing.mix(docs, F.lit("d"), {}).count() == 0
    assert chat.format_chat(spark.createDataFrame([], "id long, prompt string, response string"), "id").count() == 0


def repeats(words):
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    return len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)})


def test_quality_against_plain_python(spark):
    texts = ["", None, "a b c d e f g h i j k", "a b c d e a b c d e x y z w v u", "x " * 12, "one\none\n \none two\n", "héé#*$%&|<>\t\x0b\x0c\r", "w" * 100000, " ".join(f"t{i % 700}" for i in range(3000))]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_words long")
    for r in quality.line_rules(df).collect():
        t = texts[r["doc_id"]] or ""
        words = t.encode().split()
        lines = [x for x in t.split("\n") if x.encode().split()]
        want = (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeats(words))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r["base_failed"] and r["kept"])


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, f"All rights {'RESERVED' if i % 2 else 'reserved'}  now\n{body(i)}", "h") for i in range(30)] + [(100, "All   rights reserved NOW\na b c d e f g", "h"), (101, None, None), (102, "all rights reserved now\n" + body(7), "other"), (5, f"All rights RESERVED  now\n{body(5)}", "h")]
    got = quality.line_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), with_text=True).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert by[3]["kept"] and by[3]["n_frequent_words"] == 4 and by[3]["clean_text"] == body(3)
    assert not by[100]["kept"] and by[100]["clean_text"] == "a b c d e f g"
    assert by[102]["n_frequent_words"] == 0 and by[5]["n_frequent_words"] == 4


@given(st.lists(st.sampled_from(["<|im_end|>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "<", "[", "|", "a", "\n", "<\\|im_start|>", "é", "<|im_start|>user\n"]), max_size=8).map("".join))
@settings(max_examples=15, deadline=None)
def test_escape_is_reversible(spark, s):
    r = spark.range(1).select(chat.escape(F.lit(s)).alias("e")).select("e", chat.unescape(F.col("e")).alias("u")).first()
    assert r["u"] == s and not any(c in r["e"] for c in ("<|im_start|>", "<|im_end|>", "</s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_layouts(spark):
    rows = [
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', '{"prompt":"q","response":"a"}',
        '{"instruction":"q","output":"a"}', '{"instruction":"q","input":"","output":"a"}', '{"strange":1}', "broken", None,
    ]
    df = chat.from_json(spark.createDataFrame(list(enumerate(rows)), "id int, json string"))
    got = {r["id"]: r for r in chat.format_chat(df, "id").withColumn("back", chat.parse_chat(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    for i in range(5):
        assert [tuple(x) for x in got[i]["back"]] == [("user", "q"), ("assistant", "a")] and got[i]["loss"] == "a"
    assert len({got[i]["layout"] for i in range(5)}) == 5
    assert all(got[i]["layout"] is None and got[i]["formatted"] is None for i in (5, 6, 7))


def test_turn_rows_with_nulls_ties_and_odd_roles(spark):
    df = spark.createDataFrame([(1, 1, "a\nb%", "<|im_end|>\n<|im_start|>x"), (1, 0, None, None), (1, 1, "assistant", "é" * 50000)], "id int, turn long, role string, text string")
    by = df.groupBy("id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    r = chat.format_chat(by, "id").withColumn("back", chat.parse_chat(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).first()
    assert [tuple(x) for x in r["back"]] == [("", ""), ("a\nb%", "<|im_end|>\n<|im_start|>x"), ("assistant", "é" * 50000)] and r["loss"] == "é" * 50000


def water(children, budget):
    """Fills children (name, weight, capacity) by repeated sharing: what one can't take goes to the others."""
    got, open_ = {n: 0.0 for n, _, _ in children}, list(children)
    while open_ and budget > 1e-9:
        w = sum(c[1] for c in open_)
        full = [c for c in open_ if got[c[0]] + budget * c[1] / w >= c[2] - 1e-9]
        if not full:
            for n, x, _ in open_:
                got[n] += budget * x / w
            break
        n, x, cap = min(full, key=lambda c: (c[2] - got[c[0]]) / c[1])
        budget -= cap - got[n]
        got[n] = cap
        open_.remove((n, x, cap))
    return got


def test_budgets_follow_weights_and_shortages_stay_among_siblings(spark):
    leaves = [("web", "en", "a", 100), ("web", "en", "b", 10), ("web", "fr", "c", 5), ("book", "en", "d", 20), ("book", "de", "e", 300)]
    rows = [(d, lg, s, t, 1, 3 if d == "web" else 1, 2 if lg == "en" else 1, 1) for d, lg, s, t in leaves]
    df = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long, n long, domain_weight long, lang_weight long, source_weight long")
    got = {r["source"]: r["budget"] for r in mixing.leaf_budgets(df, 200, 100, 1).collect()}
    top = water([("web", 3, 115), ("book", 1, 320)], 200)
    web = water([("en", 2, 110), ("fr", 1, 5)], top["web"])
    book = water([("en", 2, 20), ("de", 1, 300)], top["book"])
    want = water([("a", 1, 100), ("b", 1, 10)], web["en"]) | {"c": web["fr"], "d": book["en"], "e": book["de"]}
    assert all(abs(got[k] - v) <= 3 for k, v in want.items()) and sum(got.values()) <= 200


def test_prefixes_epochs_and_hot_leaf(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    rows = [(i, " ".join("w" * (i % 9)), "en", "big", 1) for i in range(300)] + [(i, "a b c", None, None, 1) for i in range(300, 310)] + [(7, "dup dup", "en", "big", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens long")
    out = mixing.mix(df, F.lit("d"), {"source": {"big": 1}}, budget=900, max_epochs=3).collect()
    spent = Counter()
    for r in out:
        spent[r["source"]] += r["__tokens"]
    assert spent[None] == 90 and 780 <= spent["big"] <= 810  # the small leaf is exhausted after three epochs
    order = lambda e, d, t: hashlib.md5(f"17|{e}|{d}|{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()
    took = {(r["doc_id"], r["text"]) for r in out if r["source"] == "big"}
    last = max(order(0, *d) for d in took)
    assert all(order(0, *r[:2]) >= last or r[:2] in took for r in rows if r[3] == "big")


def test_repeated_rows_count_once_for_line_frequency(spark):
    text = lambda i: f"first words of document {i} stand here\nand five more in {i}"
    rows = [(i, text(i), "h") for i in range(30)] + [(100, text(100), "h"), (None, text(101), "h")] * 30
    # 21 documents of 201 share a line; 2,500 rows of one document do not lower its share
    rows += [(200 + i, text(i) + ("\nshared by some" if i < 21 else ""), "big") for i in range(200)] + [(400, text(400), "big")] * 2500
    got = quality.line_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), with_text=True).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["kept"] and r["n_frequent_words"] == (3 if r["doc_id"] is not None and 200 <= r["doc_id"] < 221 else 0)


def test_quality_matches_sql_where_lines_are_removed(spark):
    import duckdb
    from conftest import same

    body = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(i, f"Subscribe to our  letter\n{body(i, 30 if i % 3 else 7)}\nPage {i}", "a" if i < 40 else "b") for i in range(60)]
    rows += [(100 + i, f"SUBSCRIBE to our letter\n{'all rights reserved by the owner ' * (i % 4) if i < 90 else ''}\n{body(i, 12)}", "c") for i in range(2200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality.line_rules(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_frequent_words").toPandas()
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert same(got, con.execute(quality.SQL).fetchdf())
    # lines go in hosts of 40 and 2,200 documents, none in the host of 20, and some documents are depleted
    gone = {i for i, n in zip(got["doc_id"], got["n_frequent_words"]) if n}
    assert gone == set(range(40)) | set(range(100, 2300))
    assert (~got["kept"] & ~got["base_failed"]).any()


def test_wordless_texts_come_with_whole_epochs_only(spark):
    """40 texts without words and 40 of three words, two epochs: no text comes a third time."""
    rows = [(i, None if i % 4 == 0 else " \n", "en", "s") for i in range(40)] + [(i, "a b c", "en", "s") for i in range(40, 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    came = lambda **k: Counter(r["doc_id"] for r in mixing.mix(df, F.lit("d"), {}, **k).collect())
    assert set(came(percent=200, max_epochs=2).values()) == {2}
    some = came(budget=60, max_epochs=2)
    assert sum(n for d, n in some.items() if d >= 40) == 20 and max(some.values()) == 1
    assert came(budget=0) == {}
    assert set(Counter(r["doc_id"] for r in mixing.mix(df.filter("doc_id < 40"), F.lit("d"), {}).collect()).values()) == {1}
    assert mixing.mix(df.select("doc_id", "text"), F.lit("d"), {}, max_epochs=1).count() == 80


def test_null_parts_of_flat_layouts_are_empty(spark):
    rows = ['{"prompt":"q"}', '{"response":"a"}', '{"instruction":"q","input":"i"}', '{"system":"s","response":"a"}', '{"output":"a"}', '{"input":"i"}']
    df = chat.from_json(spark.createDataFrame(list(enumerate(rows)), "id int, json string"))
    back = {r["id"]: [tuple(x) for x in r["back"]] for r in chat.format_chat(df, "id").withColumn("back", chat.parse_chat(F.col("formatted"))).collect()}
    assert back == {
        0: [("user", "q"), ("assistant", "")], 1: [("user", ""), ("assistant", "a")], 2: [("user", "q\n\ni"), ("assistant", "")],
        3: [("system", "s"), ("user", ""), ("assistant", "a")], 4: [("user", ""), ("assistant", "a")], 5: [("user", "i"), ("assistant", "")],
    }


def test_a_conversation_of_very_many_turns(spark):
    df = spark.range(20000).select(F.lit(1).alias("id"), F.struct(F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text")).alias("t"))
    r = chat.format_chat(df.groupBy("id").agg(F.collect_list("t").alias("turns")), "id").withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).first()
    assert len(r["loss_spans"]) == 10000 and r["loss"] == "".join(f"t{i}" for i in range(1, 20000, 2))


def test_callers_columns_stay_beside_the_verdict(spark):
    df = spark.createDataFrame([(1, "http://a.net/", "mine", "p"), (2, None, "other", None)], "page_id long, url string, host string, path string")
    got = {r["page_id"]: (r["in_host"], r["in_path"], r["host"], r["verdict"]) for r in urls.judge_urls(df, urls.rule_table(spark, urls.RULES)).collect()}
    assert got == {1: ("mine", "p", "a.net", "block"), 2: ("other", None, "", "allow")}


def test_clashing_columns_stay_apart(spark):
    df = spark.createDataFrame([("http://a.net/x", "h", "i", "p", "w", "c")], "url string, host string, in_host string, `__path` string, `__won` string, c0 string")
    got = urls.judge_urls(df, urls.rule_table(spark, urls.RULES)).collect()[0].asDict()
    assert got == {"url": "http://a.net/x", "in_in_host": "h", "in_host": "i", "__path": "p", "__won": "w", "c0": "c", "host": "a.net", "path": "/x", "rule": "net/", "verdict": "block"}
    rows = [(i, " ".join(["w"] * 10), "en", "s", "own") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, `__tokens` string")
    for c in ("__domain", "__lang", "__o", "__doc", "__text", "c1", "tokens", "budget"):
        docs = docs.withColumn(c, F.lit("own"))
    out = mixing.mix(docs, F.lit("d"), {}, percent=50, max_epochs=1, bare=True)
    assert out.columns == docs.columns and len(out.collect()) == 5 and out.filter("`__tokens` = 'own' and `__o` = 'own' and c1 = 'own'").count() == 5


def test_rows_without_ids_are_mixed_one_by_one(spark):
    rows = [(None, f"text number {i} has six words", "en", "s") for i in range(60)] + [(7, f"other text {i} of seven words", "en", "t") for i in range(60)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), F.lit("d"), {}, percent=50, max_epochs=1).collect()
    assert Counter(r["doc_id"] for r in got) == {None: 30, 7: 30} and len({r["text"] for r in got}) == 60


def test_mixed_query_matches_sql_without_ids(spark, tmp_path):
    import duckdb
    from conftest import same

    rows = [(None if i % 3 else i % 5, None if i % 17 == 0 else f"text {i // 2} " * (i % 7), ["en", "fr", None][i % 3], f"src{i % 4}" if i % 11 else None) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert same(mixing.op2_mix_sources(spark, f"file://{tmp_path}").toPandas(), con.execute(mixing.SQL).fetchdf())
