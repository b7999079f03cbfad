"""The grammar on sentences, learning on a small corpus, held-out accuracy on the tables."""

import os
import random
import re
import zlib

import pytest

from lodestar.llm import toxicity

WEIGHTS = {"idiot$": 1.5, "vequ": 1.5}


def test_clauses():
    g = toxicity.Grammar(WEIGHTS)
    plain = g.score("the man is an idiot")
    assert plain >= 0.5 and g.score("vequté") >= 0.5
    assert g.score("you idiot") > plain > g.score("he is not an idiot") and plain > g.score("they said idiot") and plain > g.score('the word "idiot" here')
    assert g.score("i will kill you") >= 0.5 > g.score("i will not kill you")
    assert g.score("You should be shot and burned!") >= 0.5 and g.score("they will be hanged") >= 0.5
    assert max(g.score(x) for x in ("he was killed", "she said i will kill you", "kill the light", "i will. kill the light", 'it says "we will kill you" here')) < 0.5
    assert g.score("idiotic") < 0.5 and g.score(None) == g.score("") == g.score("a calm text") < 0.5
    assert g.score("fine. " * 50000 + "idiot") >= 0.5


def paths(weights, text):
    """The cascade step by step: each transducer rewrites the whole clause before the next one reads it; no composed machine."""
    known = {w: k for k, ws in toxicity.LISTS.items() for w in ws}
    total, worst = 0.0, 0.0
    for clause in re.split(r"[.!?;:\n]+|,\s", (text or "").lower()):
        words = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»„]", clause)
        w = [max([weights.get(x + "$", 0)] + [v for f, v in weights.items() if not f.endswith("$") and x.startswith(f)]) for x in words]
        kind = ["quote" if not x[0].isalpha() else "insult" if v else known.get(x, "other") for x, v in zip(words, w)]
        plain = [i for i, k in enumerate(kind) if k != "quote"]
        negated = {i for p, i in enumerate(plain) if kind[i] != "negation" and any(kind[j] == "negation" for j in plain[max(0, p - toxicity.NEGATED_FOR) : p])}
        said = {i for i, k in enumerate(kind) if "report" in kind[:i] or kind[:i].count("quote") % 2}
        aimed = {i for i in range(len(kind)) if {"you", "object", "them", "theirs"} & set(kind[:i])}
        total += sum(w[i] * (0.5 if i in negated else 1) * (0.6 if i in said else 1) * (1.25 if i in aimed else 1) for i, k in enumerate(kind) if k == "insult")
        open_ = ["other" if i in negated or (kind[i] in ("insult", "threat") and i in said) else kind[i] for i in plain]
        found = 0
        for p, k in enumerate(open_):
            if k != "threat":
                continue
            if any(open_[q] == "passive" and {"you", "object", "them"} & set(open_[:q]) and "intent" in open_[:q] for q in range(max(0, p - 2), p)) or any(open_[q] == "object" and sum(x != "intent" for x in open_[q + 1 : p]) <= 1 and {"intent", "self"} & set(open_[:p]) for q in range(p)):
                found = 2
            for q in range(p + 1, min(len(open_), p + 4)):
                if open_[q] in ("you", "object"):
                    found = max(found, 2 if {"intent", "self"} & set(open_[:q]) else 1)
                elif open_[q] == "them":
                    found = max(found, 2 if "intent" in open_[:q] else 1)
        worst = max(worst, (0, toxicity.TOLD, toxicity.THREATENED)[found])
    total += worst
    return round(max(0.02, total / (total + 1)), 6)


def test_composed_machine_against_the_cascade_step_by_step():
    r, g = random.Random(4), toxicity.Grammar(WEIGHTS)
    pool = ["idiot", "idiots", "vequté", "kill", "kill", "you", "te", "your", "i", "be", "them", "will", "not", "said", '"', "calm", "x", "y", "z", ".", ", ", "\n"]
    for _ in range(3000):
        text = " ".join(r.choice(pool) for _ in range(r.randint(0, 14)))
        assert g.score(text) == paths(WEIGHTS, text), text


def test_learns_words_and_beginnings(spark):
    rows = [(f"he {x} a moron number{x}", 1) for x in "abcdefghijklmno"] + [(f"zork{x} {x} talk today", 1) for x in "abcdefghijklmno"] + [("one odd text with no insult at all " + "and so on " * i, 1) for i in range(30)] + [(f"he is a calm man today{i}", 0) for i in range(40)] + [(None, 0), ("moron", None)]
    w = toxicity.learn(spark.createDataFrame(rows, "text string, toxic int"))
    g = toxicity.Grammar(w)
    assert "insult$" not in w and "text$" not in w  # thirty near copies are one piece of evidence
    assert g.score("a moron, such a moron") >= 0.5 and g.score("zorkian zorks") >= 0.5 and g.score("he is a calm man") < 0.5


def test_no_labels_and_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.learn(toxicity.training_rows(empty, labels)) == {}
    docs = spark.createDataFrame([(1, "a", 0.1), (None, None, 0.2), (1, "a", 0.1)], "doc_id long, text string, score double")
    assert toxicity.score_documents(docs, {}).count() == 3 and toxicity.drop_toxic(docs, {}).count() == 3
    assert toxicity.score_documents(empty, {}).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in toxicity.op9_toxicity(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(got[r["doc_id"]]["held_out"] for r in labels)
    hit = sum(got[r["doc_id"]]["predicted"] == r["toxic"] for r in labels)
    caught = [got[r["doc_id"]]["predicted"] for r in labels if r["toxic"]]
    assert hit >= 0.96 * len(labels) and sum(caught) >= 0.8 * len(caught)


def test_violent_words_without_a_victim_are_no_threat():
    g = toxicity.Grammar({})
    for x in ("You should beat the eggs until stiff.", "you beat eggs", "Do you want to kill time with us?", "You must burn the fat", "Shoot us an email and you will hear back", "They killed him. He was shot. She was beaten. They burned it.", "We will beat your record", "I was shot by him", "Smoking can kill you", "They killed him. " * 5000):
        assert g.score(x) < 0.5, x
    for x in ("I will kill you", "we are gonna murder all of them", "You should be shot", "they must be hanged", "je vais te tuer", "ich werde dich töten", "te voy a matar", "I kill you", "a calm start. we'll hunt and kill you"):
        assert g.score(x) >= 0.5, x
