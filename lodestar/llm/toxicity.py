"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer, a letter trie, turns each word into a class: insult with a learned weight, threat, you and
them (targets), intent, negation, report or quote. Four small transducers are composed with it: negation marks what
stands in its scope, reported speech marks what follows a report or stands in quotes, target marks insults that
are addressed, threat joins a threat with the one it is for: an object beside the verb, or the subject of a passive,
and an intent before it; a verb with any other object is none. The scoring transducer weighs the marked insults
of a clause, and the threat's final states weigh the clause itself. compose() multiplies them into one
deterministic machine, so a clause is one walk; it is scored as a whole, not by isolated words. Insults of a text add
up, threats do not: the worst one counts, so that many clauses that only tell of violence are no threat.

Insult words and word beginnings are learned from labelled documents; the other classes are closed word lists.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import let_go, pieces

#: The model is fitted on at most this many labelled documents, those with the smallest id hashes.
MAX_LABELLED = 20_000
#: Word beginnings of these lengths are tried as features, besides whole words (marked by a $).
PREFIX = range(3, 9)
#: A feature's share of toxic texts, and the lower bound of that share at Z standard errors, taken over contexts.
MIN_PRECISION, MIN_BOUND, Z = 0.7, 0.4, 3.3
#: Toxic texts that must hold a feature before it is looked at, and how many features are looked at and kept.
MIN_SUPPORT, MAX_FEATURES = 3, 5_000
#: Features whose counts a task holds before it sends them on.
TALLY = 200_000
#: Log odds that make one plain insult worth a score of one half.
UNIT = 4.5

# Fixed word lists of the grammar.
THREAT = (
    "kill killed kills killing murder murdered murdering hurt hurts destroy destroyed crush crushed beat beaten attack attacked shoot shot shooting stab stabbed burn burned burnt burning punish punished strangle strangled hang hanged lynch lynched bomb bombed slaughter slaughtered exterminate exterminated "
    "tuer tue tuerai frapper frapperai brûler brûlé étrangler égorger töten töte umbringen schlagen erschießen erschossen verbrennen verbrannt erstechen matar mataré matarte golpear golpearé quemar quemado disparar"
).split()
YOU = "you u ya yourself yourselves tu du tú usted ustedes vosotros".split()
OBJECT = "vous te toi dich dir euch ti".split()
THEM = "he she they him her them people everyone everybody il elle ils elles lui eux leur er ihn ihm sie ihnen jene él ella ellos ellas".split()
THEIRS = "your yours vos votre ton ta tes dein deine ihr euer his their these those all leurs diese alle les esos esas todos".split()
SELF = "i i'm i'd we je nous ich wir yo nosotros".split()
INTENT = "will would shall should must gonna going want wants hope deserve deserves ought let need needs i'll we'll they'll vais allons devrait devraient dois doit faut mérite méritent werde werden soll sollen sollte sollten muss müssen verdient voy vamos debe deben debería deberían merece merecen quiero".split()
PASSIVE = "be been being get être ser".split()
NEGATION = "not no never isn't aren't wasn't weren't don't doesn't didn't won't wouldn't can't couldn't nobody neither nor without cannot pas jamais aucun aucune ni sans nicht kein keine keinen keiner nie niemals nunca ningún ninguna tampoco sin".split()
REPORT = "said says say saying called calls call calling wrote writes quoted quote quotes reported reports claimed claims according accused dit disait disent écrit écrivait appelé selon sagte sagt sagen schrieb schreibt nannte laut dijo dice dicen escribió escribe llamó según".split()

CLASSES = ("other", "insult", "threat", "you", "object", "them", "theirs", "self", "intent", "passive", "negation", "report", "quote")
#: Each class's word list; where a word stands in two, the later one counts.
LISTS = {"report": REPORT, "negation": NEGATION, "intent": INTENT, "passive": PASSIVE, "self": SELF, "theirs": THEIRS, "them": THEM, "object": OBJECT, "you": YOU, "threat": THREAT}
#: Words a negation reaches, and what is left of an insult's weight when marked so.
NEGATED_FOR = 3
FACTORS = {"negated": 0.5, "reported": 0.6, "targeted": 1.25}
#: What a threat to the reader or an intended threat to others adds to a clause, and one that is only told.
THREATENED, TOLD = 1.1, 0.3

_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»„]|[.!?;:\n]+|,\s")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_QUOTES = frozenset("\"“”«»„")


@dataclass
class Transducer:
    """Deterministic, over marked classes: arcs[state][class] = (next state, marks put on the symbol); other classes loop.

    A symbol is a class with a set of marks; a transducer reads the class, unless blocked by a mark, and adds marks.
    """

    arcs: dict[int, dict[str, tuple[int, frozenset[str]]]]
    final: dict[int, float] = field(default_factory=dict)
    blocked: frozenset[str] = frozenset()

    def step(self, state: int, symbol: str, marks: frozenset[str]) -> tuple[int, frozenset[str]]:
        if marks & self.blocked:
            symbol = "other"
        to, put = self.arcs[state].get(symbol, (state, frozenset()))
        return to, marks | put


def negation() -> Transducer:
    """State n: n more words stand under the negation."""
    put = frozenset(["negated"])
    arcs: dict[int, dict] = {n: {c: (max(0, n - 1), put if n else frozenset()) for c in CLASSES if c not in ("negation", "quote")} for n in range(NEGATED_FOR + 1)}
    for a in arcs.values():
        a["negation"] = (NEGATED_FOR, frozenset())
    return Transducer(arcs)


def reported_speech() -> Transducer:
    """States: 0 plain, 1 after a report, 2 in quotes, 3 both."""
    put, none = frozenset(["reported"]), frozenset()
    arcs = {n: {c: (n, put if n else none) for c in ("insult", "threat")} | {"report": (n | 1, none), "quote": (n ^ 2, none)} for n in range(4)}
    return Transducer(arcs)


def target() -> Transducer:
    """State 1: somebody is addressed or spoken of."""
    to = {c: (1, frozenset()) for c in ("you", "object", "them", "theirs")}
    return Transducer({0: to, 1: to | {"insult": (1, frozenset(["targeted"]))}})


#: Words that may stand between a threat and its object, and between a passive or an object before the verb and the threat.
AFTER, BEFORE = 2, 1


def threat_step(state: tuple, c: str) -> tuple:
    """(intent, self, subject, passive, before, after, result): what a clause has shown so far; the three middle ones are countdowns.

    result is 2 for a threat to the reader, or an intended one to others, and 1 for one that is only told.
    """
    intent, self_, subject, passive, before, after, result = state
    if c == "quote" or result == 2:
        return state
    was_passive, was_before, was_after = passive, before, after
    passive, before, after = max(0, passive - 1), max(0, before - 1), max(0, after - 1)
    if c == "threat":
        result = 2 if was_passive or was_before and (intent or self_) else result
        after = AFTER + 1
    elif c in ("you", "object"):
        if was_after:
            result = 2 if intent or self_ else 1
        subject, before = 1, BEFORE + 1 if c == "object" else before
    elif c == "them":
        if was_after:
            result = 2 if intent else 1
        subject = 1
    elif c == "intent":
        intent, before = 1, was_before
    elif c == "self":
        self_ = 1
    elif c == "passive" and subject and intent:
        passive = BEFORE + 1
    return (0,) * 6 + (2,) if result == 2 else (intent, self_, subject, passive, before, after, result)


def threat() -> Transducer:
    """The states of threat_step by number. Negated and reported threats don't count."""
    start = (0,) * 7
    numbers, todo, arcs = {start: 0}, [start], {}
    for state in todo:
        row = {}
        for c in CLASSES:
            to = threat_step(state, c)
            if to not in numbers:
                numbers[to] = len(numbers)
                todo.append(to)
            row[c] = (numbers[to], frozenset())
        arcs[numbers[state]] = row
    return Transducer(arcs, {n: THREATENED if state[6] == 2 else TOLD for state, n in numbers.items() if state[6]}, frozenset(["negated", "reported"]))


CASCADE = (negation, reported_speech, target, threat)


def factor(marks: frozenset[str]) -> float:
    """The scoring transducer: what an insult counts by its marks."""
    return math.prod(FACTORS[m] for m in sorted(marks))


def compose(parts: list[Transducer]) -> tuple[list[list[tuple[int, float]]], list[float]]:
    """(table, finals): table[state][class] = (next state, factor of an insult's weight), by the reachable product states."""
    ids, todo, table = {(0,) * len(parts): 0}, [(0,) * len(parts)], []
    finals = []
    for states in todo:
        row = []
        for c in CLASSES:
            marks, to = frozenset(), []
            for part, state in zip(parts, states, strict=True):
                state, marks = part.step(state, c, marks)
                to.append(state)
            if tuple(to) not in ids:
                ids[tuple(to)] = len(ids)
                todo.append(tuple(to))
            row.append((ids[tuple(to)], factor(marks) if c == "insult" else 0.0))
        table.append(row)
        finals.append(sum(part.final.get(state, 0.0) for part, state in zip(parts, states, strict=True)))
    return table, finals


class Lexicon:
    """Letters to a class and a weight: a trie whose nodes carry the weight of a beginning and the class of a word."""

    def __init__(self, weights: dict[str, float]):
        self.next, self.begin, self.word = [{}], [0.0], [(0, 0.0)]
        for kind, words in LISTS.items():
            for w in words:
                self.word[self._node(w)] = (CLASSES.index(kind), 0.0)
        for f, w in weights.items():
            node = self._node(f.rstrip("$"))
            if f.endswith("$"):
                self.word[node] = (1, w)
            else:
                self.begin[node] = w

    def _node(self, letters: str) -> int:
        at = 0
        for x in letters:
            if x not in self.next[at]:
                self.next[at][x] = len(self.next)
                self.next.append({})
                self.begin.append(0.0)
                self.word.append((0, 0.0))
            at = self.next[at][x]
        return at

    def __call__(self, word: str) -> tuple[int, float]:
        at, best = 0, 0.0
        for x in word:
            at = self.next[at].get(x, -1)
            if at < 0:
                return (1, best) if best else (0, 0.0)
            best = max(best, self.begin[at])
        kind, w = self.word[at]
        return (1, max(w, best)) if best or kind == 1 else (kind, 0.0)


class Grammar:
    """The composed machine; weights: feature -> weight of an insult."""

    #: Words whose class a worker remembers.
    MEMO = 100_000

    def __init__(self, weights: dict[str, float], cascade=CASCADE):
        self.lexicon, self.memo = Lexicon(weights), {}
        self.table, self.finals = compose([t() for t in cascade])

    def classed(self, token: str) -> tuple[int, float]:
        """(class, weight) of a token; class -1 ends a clause."""
        got = self.memo.get(token)
        if got is None:
            got = self.lexicon(token) if token[0].isalpha() else (CLASSES.index("quote"), 0.0) if token in _QUOTES else (-1, 0.0)
            if len(self.memo) < self.MEMO and len(token) <= 64:
                self.memo[token] = got
        return got

    def score(self, text: str | None) -> float:
        """0 to 1; 0.02 for texts without a matched clause, empty and null ones too."""
        total, worst, state, table, finals, memo = 0.0, 0.0, 0, self.table, self.finals, self.memo
        for token in _TOKEN.findall((text or "").lower()):
            kind, w = memo.get(token) or self.classed(token)
            if kind < 0:
                worst = max(worst, finals[state])
                state = 0
                continue
            state, by = table[state][kind]
            if w:
                total += w * by
        total += max(worst, finals[state])
        return round(max(0.02, total / (total + 1)), 6)


def features(word: str) -> list[str]:
    return [word + "$", *(word[:k] for k in PREFIX if len(word) >= k)]


def _counts(batches: Iterator[pa.RecordBatch], only: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    """Partial counts; they are sent on whenever TALLY features are held."""
    seen: Counter[str] = Counter()

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["feature", "n"])

    for b in pieces(batches, 0):
        for text in b.column(0).to_pylist():
            f = {x for w in set(_WORD.findall((text or "").lower())) for x in features(w)}
            seen.update(f if only is None else f & only)
            if len(seen) >= TALLY:
                yield batch()
                seen.clear()
    yield batch()


def _tally(texts: DataFrame, only: frozenset[str] | None, least: int, most: int) -> dict[str, int]:
    """Document counts of features; at most `most` of them reach the driver, the most frequent."""
    rows = texts.mapInArrow(lambda it: _counts(it, only), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return {r[0]: r[1] for r in rows.orderBy(F.desc("n"), "feature").limit(most).collect()}


def _contexts(batches: Iterator[pa.RecordBatch], only: frozenset[str]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, 0):
        seen: set[tuple[str, str]] = set()
        for text in b.column(0).to_pylist():
            words = ["", *_WORD.findall((text or "").lower()), ""]
            for k in range(1, len(words) - 1):
                for f in features(words[k]):
                    if f in only:
                        seen.add((f, f"{words[k - 1]} {words[k + 1]}"))
        if seen:
            f, c = zip(*sorted(seen), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(c, pa.string())], ["feature", "context"])


def lower_bound(hits: int, n: int, z: float = Z) -> float:
    """Wilson's lower bound of a share."""
    p = hits / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def learn(labelled: DataFrame, text: str = "text", toxic: str = "toxic") -> dict[str, float]:
    """Insult weights from a bounded table of labelled texts: features that are rare in clean ones.

    A feature's evidence is the number of different contexts (the words beside it) in toxic texts, so that near
    copies of one text count once: with c contexts and m clean texts the lower bound of c / (c + m) must reach
    MIN_BOUND, which takes 8 contexts where no clean text holds it, at any number of labels. Of the beginnings of
    one word with about the same support the longest is kept. Rows with a null label are ignored. Without toxic
    rows there are no weights.
    """
    t = labelled.select(F.col(text).alias("t"), F.col(toxic).alias("y"))
    n = {r[0]: r[1] for r in t.filter("y is not null").groupBy((F.col("y") > 0).alias("y")).count().collect()}
    bad, good = n.get(True, 0), n.get(False, 0)
    if not bad:
        return {}
    hit = _tally(t.filter("y > 0").select("t"), None, MIN_SUPPORT, 40 * MAX_FEATURES)
    miss = _tally(t.filter("y <= 0").select("t"), frozenset(hit), 1, len(hit) + 1)
    sure = {f: k for f, k in hit.items() if k >= MIN_PRECISION * (k + miss.get(f, 0))}
    some = frozenset(sure)
    rows = t.filter("y > 0").select("t").mapInArrow(lambda it: _contexts(it, some), "feature string, context string").distinct().groupBy("feature").count()
    contexts = {r[0]: r[1] for r in rows.collect()}  # one row for each feature looked at
    sure = {f: k for f, k in sure.items() if lower_bound(contexts[f], contexts[f] + miss.get(f, 0)) >= MIN_BOUND}
    kept: dict[str, int] = {}
    for f in sorted(sure, key=lambda f: (len(f.rstrip("$")), f)):
        # drop a shorter beginning when this one has nearly its support, and skip this one when a kept shorter one says more
        shorter = [f[:k] for k in range(PREFIX.start, len(f.rstrip("$")) + 1) if f[:k] in kept and f[:k] != f]
        if any(sure[s] > 1.05 * sure[f] for s in shorter):
            continue
        for s in shorter:
            del kept[s]
        kept[f] = sure[f]
    odds = {f: math.log((k + 0.5) / (bad + 1)) - math.log((miss.get(f, 0) + 0.5) / (good + 1)) for f, k in kept.items()}
    best = sorted(odds, key=lambda f: (-odds[f], f))[:MAX_FEATURES]
    return {f: odds[f] / UNIT for f in best if odds[f] > 0}


def training_rows(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", most: int = MAX_LABELLED) -> DataFrame:
    """Labelled texts outside the held-out fold (crc32 of the id as text mod 5 is 0), at most `most` of them; equal texts count once."""
    fold = F.crc32(F.col("d").cast("string").cast("binary")) % 5
    y = labels.select(F.col(doc).alias("d"), F.col("toxic").alias("toxic")).filter(F.col("d").isNotNull() & (fold != 0)).groupBy("d").agg(F.max("toxic").alias("toxic"))
    some = y.orderBy(F.xxhash64("d"), "d").limit(most)  # bounded, hence broadcast
    return docs.select(F.col(f"`{doc}`").alias("d"), F.col(f"`{text}`").alias("text")).join(F.broadcast(some), "d").select("text", "toxic").dropDuplicates()


def _scored(batches: Iterator[pa.RecordBatch], weights: dict[str, float]) -> Iterator[pa.RecordBatch]:
    let_go()
    g = Grammar(weights)
    for b in pieces(batches, 1):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g.score(x) for x in b.column(1).to_pylist()], pa.float64())], ["__id", "score"])


def score_documents(docs: DataFrame, weights: dict[str, float], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, score) per row of docs; the model's weights (at most MAX_FEATURES) travel with the tasks."""
    kind = docs.schema[doc].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    return rows.mapInArrow(lambda it: _scored(it, weights), f"__id {kind}, score double").withColumnRenamed("__id", doc)


def _kept(batches: Iterator[pa.RecordBatch], weights: dict[str, float], at: int) -> Iterator[pa.RecordBatch]:
    let_go()
    g = Grammar(weights)
    for b in pieces(batches, at):
        yield b.filter(pa.array([g.score(x) < 0.5 for x in b.column(at).to_pylist()], pa.bool_()))


def drop_toxic(docs: DataFrame, weights: dict[str, float], text: str = "text") -> DataFrame:
    """docs without the rows that score one half or more; all columns stay."""
    at = docs.columns.index(text)
    return docs.mapInArrow(lambda it: _kept(it, weights, at), docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weights = learn(training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    scored = score_documents(docs, weights)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
