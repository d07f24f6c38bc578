"""Toxicity by a weighted finite-state pattern grammar over clauses.

Transducers read the tokens of a clause. The first maps a token to a class: insult (with a weight),
threat, target, negation, report or other. Insult patterns are whole words and word stems, with
log-odds learnt from labelled documents; the other classes are closed word lists in four languages.
The second composes the classes: its state holds whether the clause so far is reported, whether a
negation is open, and what it has seen of targets; a match is an insult alone, an insult at a target,
or a threat at a target, and each is emitted plain, negated or reported. A document's features are the
weights of its matched clauses by kind, and a logistic model, learnt on other documents than the
patterns, turns them into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import arrow_map, batch_of, bounded_sample, id_crc, labelled_sample, slices, stored
from parcelwise.llm.quality_nbsvm import logistic, marks_of

#: Bound on the labelled rows used: two thirds of them teach the patterns, the rest the composition.
SAMPLE = 16_000
STEMS = (3, 4, 5, 6, 7, 8)
#: A pattern is kept with this log-odds and log-likelihood gain at least, in this many and this share of
#: the toxic documents.
LEAST_ODDS = 1.0
LEAST_GAIN = 15.0
LEAST_DOCS = 3
STAND_IN = 0.7
LEAST_SHARE = 0.01
TOKEN = re.compile(r"\w+(?:['’]\w+)*")
CLAUSE = re.compile(r"[.!?;:|\n\"“”«»]+")

# Closed classes of English, German, French and Spanish.
TARGETS = frozenset("""you your yours yourself u ur he she they him her them his their these those people everyone
du dich dir dein deine ihr euch euer sie ihnen er tu toi te vous vos votre ton ta il elle ils elles leur
tú ti usted ustedes vosotros tus él ella ellos ellas""".split())
NEGATIONS = frozenset("""not no never neither nor none nobody isn't aren't wasn't don't doesn't didn't won't can't cannot
nicht kein keine keinen nie niemals ne pas jamais aucun aucune ni nunca jamás tampoco""".split())
REPORTS = frozenset("""said says say told tells wrote writes claimed claims called quoted according reported
sagte sagt schrieb behauptete laut dit disait écrit selon affirme dijo dice escribió según afirma""".split())
THREATS = frozenset("""kill hurt destroy attack shoot stab beat burn punish hunt murder
töten umbringen schlagen vernichten verletzen tuer frapper détruire brûler blesser
matar golpear destruir quemar atacar""".split())

KINDS = ("insult", "aimed", "threat")
TONES = ("plain", "negated", "reported")
WIDTH = len(KINDS) * len(TONES) + 3


def patterns_of(text: str) -> set[str]:
    """The distinct words of a text, closed by a blank, and their stems."""
    found = set()
    for word in set(TOKEN.findall(text.lower())):
        found.add(word + " ")
        found.update(word[:k] for k in STEMS if k <= len(word))
    return found


def lexicon(rows: DataFrame) -> dict[str, float]:
    """Insult patterns with their log-odds, from (text, label); each word is covered by one pattern."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[label].update(patterns_of(text or ""))
                if len(counts[0]) + len(counts[1]) > 400_000:
                    yield part(counts)
                    counts[0].clear(), counts[1].clear()
        yield part(counts)

    def part(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
        keys = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)], names=["pattern", "n0", "n1"]
        )

    n0, n1 = rows.agg(F.sum(1 - F.col("label")), F.sum("label")).first()
    if not n0 or not n1:
        return {}
    counts = arrow_map(rows.select("text", "label"), tally, "pattern string, n0 long, n1 long").groupBy("pattern").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")
    )
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    found = counts.where(F.col("n1") >= max(LEAST_DOCS, LEAST_SHARE * n1)).select("pattern", "n0", "n1", odds.alias("odds")).where(F.col("odds") >= LEAST_ODDS)
    gains: dict[str, float] = {}
    rows_of = {r.pattern: r for r in found.collect()}
    for r in rows_of.values():
        share = (r.n0 + r.n1) / (n0 + n1)
        gains[r.pattern] = sum(n * math.log(n / all_ / share) for n, all_ in ((r.n0, n0), (r.n1, n1)) if n)
    beyond: dict[str, float] = {}  # the best gain of longer patterns
    children: dict[str, int] = {}  # the most toxic documents that a pattern one character longer keeps
    for pattern, gain in gains.items():
        for k in range(STEMS[0], len(pattern)):
            beyond[pattern[:k]] = max(beyond.get(pattern[:k], 0.0), gain)
        children[pattern[:-1]] = max(children.get(pattern[:-1], 0), rows_of[pattern].n1)
    kept: dict[str, float] = {}
    for pattern in sorted(gains, key=lambda p: (len(p), p)):
        # a stem stands for its words if it explains nearly as much as the best of them and is where they part
        n = rows_of[pattern].n1
        if gains[pattern] < max(LEAST_GAIN, STAND_IN * beyond.get(pattern, 0.0)) or children.get(pattern, 0) >= 0.9 * n:
            continue
        if not any(pattern[:k] in kept for k in range(STEMS[0], len(pattern))):
            kept[pattern] = rows_of[pattern].odds
    return kept


class Grammar:
    """The token transducer of a lexicon, and the clause transducer composed with it."""

    def __init__(self, insults: dict[str, float]) -> None:
        self.insults = insults
        self.lengths = sorted({len(p) for p in insults if not p.endswith(" ")})

    def weight(self, word: str) -> float:
        """Of the insult pattern that reads ``word``, or 0."""
        exact = self.insults.get(word + " ")
        if exact is not None:
            return exact
        for k in self.lengths:
            if k <= len(word) and (found := self.insults.get(word[:k])) is not None:
                return found
        return 0.0

    def clause(self, words: list[str], found: np.ndarray) -> None:
        """Adds the matches of one clause to ``found``."""
        reported = negated = target = False
        insult = threat = 0.0
        tone = 0
        for word in words:
            if word in REPORTS:
                reported = True
            elif word in NEGATIONS:
                negated = True
            elif word in TARGETS:
                target = True
            elif word in THREATS:
                threat = 1.0
                tone = 2 if reported else 1 if negated else 0
            elif (w := self.weight(word)) > 0:
                insult += w
                found[11] += 1
                tone = 2 if reported else 1 if negated else 0
        if threat and target:
            found[6 + tone] += threat
        if insult:
            found[(3 if target else 0) + tone] += insult
            found[9] = max(found[9], insult)
            found[10] += 1

    def features(self, text: str) -> np.ndarray:
        """Weights of the matches by kind and tone, the strongest clause, and the clauses and words with an insult."""
        found = np.zeros(WIDTH)
        low = text.lower()
        marks = {w for w in set(TOKEN.findall(low)) if w in THREATS or self.weight(w) > 0}
        if marks:
            for part in CLAUSE.split(low):
                words = TOKEN.findall(part)
                if not marks.isdisjoint(words):
                    self.clause(words, found)
        return found


def squashed(found: np.ndarray) -> np.ndarray:
    """Features for the logistic model: sums grow slowly, so one long text cannot outweigh the rest."""
    return np.column_stack([np.log1p(found), np.ones(len(found))])


def fit(rows: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], np.ndarray]:
    """(patterns, logistic weights) from rows of (doc_id, text, toxic 0/1), of which about ``sample`` are used."""
    rows = bounded_sample(rows.where(F.col("toxic").isin(0, 1)), ["doc_id", "text", "toxic"], sample)
    return learnt(rows.select("doc_id", "text", F.col("toxic").cast("int").alias("label")))


def learnt(rows: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    """(patterns, logistic weights) from all of the (doc_id, text, label 0/1) given."""
    rows = rows.select("text", "label", (F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(3)) > 0).alias("first"))
    rows = stored(rows.dropDuplicates(["text"]))  # copies say nothing new about a pattern
    insults = lexicon(rows.where("first"))
    grammar_of = rows.sparkSession.sparkContext.broadcast(insults)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(grammar_of.value)
        for batch in batches:
            found = np.array([grammar.features(t or "") for t in batch.column(0).to_pylist()]).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c) for c in found.T)], names=["label", *names])

    names = [f"x{i}" for i in range(WIDTH)]
    ddl = "label int, " + ", ".join(f"{n} double" for n in names)
    # most documents match nothing, so equal rows are counted before they come to the driver
    seen = arrow_map(rows.where("not first").select("text", "label"), extract, ddl).groupBy("label", *names).count().toPandas()
    if seen.empty:
        return insults, np.zeros(WIDTH + 1)
    seen = seen.sort_values(list(seen.columns)).reset_index(drop=True)
    x, y, n = squashed(seen[names].to_numpy()), seen["label"].to_numpy(float), seen["count"].to_numpy(int)
    return insults, logistic(np.repeat(x, n, axis=0), np.repeat(y, n), ridge=0.05)


def score(docs: DataFrame, insults: dict[str, float], beta: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted and n_clauses (clauses with an insult) of every row; only the text is looked at.

    Empty and NULL texts match nothing and get the score of a text without matches. Repeated rows come
    back repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast((insults, beta))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_clauses", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, weights = shared.value
        grammar = Grammar(patterns)
        for batch in slices(batches, 1):
            found = np.array([grammar.features(t or "") for t in batch.column(1).to_pylist()]).reshape(-1, WIDTH)
            scores = 1 / (1 + np.exp(-np.clip(squashed(found) @ weights, -30, 30)))
            yield batch_of(schema, doc_id=batch.column(0), score=scores, predicted=(scores >= threshold).astype(np.int32),
                           n_clauses=found[:, 10].astype(np.int64))

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double, predicted int, n_clauses long")


def held_out(column: str = "doc_id") -> Column:
    return id_crc(column) % 4 == 2


def classified(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted and n_clauses of every row, learnt from rows not held out."""
    insults, beta = learnt(labelled_sample(docs, marks_of(labels, "toxic", held_out()), sample))
    return score(docs, insults, beta, threshold).select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_clauses")
