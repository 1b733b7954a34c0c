"""Toxicity by a weighted finite-state pattern grammar over clauses."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, word_lists

#: At most this many labelled documents, those with the smallest hashes of doc_id, train the grammar.
TRAINING_ROWS = 20_000
#: At most this many learned words and stems.
LEXICON_SIZE = 5_000
STEMS = (4, 5, 6, 7, 8)
#: Words that a worker remembers to be hot or not.
LOOKED_UP = 100_000
#: Log-odds of a word that count as one full insult.
FULL_LOG_ODDS = 4.0

# Words of the classes that transducers read, besides the learned insults.
INSULTS = frozenset("idiot idiots moron morons imbecile loser losers scum scumbag stupid worthless pathetic disgusting trash garbage clown dumb fool jerk bastard arschloch trottel dummkopf idiota imbécil estúpido estúpida connard crétin abruti salaud".split())
VIOLENCE = frozenset("kill murder destroy hurt stab shoot strangle beat crush burn hang töten umbringen vernichten verletzen tuer détruire frapper égorger matar destruir golpear quemar".split())
TARGETS = frozenset("you your yours yourself u ur he she him they them their these those this people all du dich dir dein deine ihr euch sie tu toi te ton vous votre ils elles tú ti usted ustedes vosotros ellos ellas".split())
INTENTS = frozenset("will ll gonna going shall should must let deserve deserves want werde werden soll sollst muss vais va vas doit dois voy vamos debe debes quiero".split())
AMPLIFIERS = frozenset("such total totally complete completely absolute absolutely utter utterly fucking damn bloody really so what völlig total so tellement vraiment tan tanto totalmente completo".split())
NEGATIONS = frozenset("not no never neither nor isn aren wasn don doesn didn won nicht kein keine niemals nie pas jamais aucun nunca jamás tampoco".split())
REPORTS = frozenset("said says say told called calls wrote writes quoted quote reported reports claimed alleged according accused sagte sagt schrieb nannte zitierte laut dit écrit appelle selon cita dijo dice escribió llamó según".split())
CLAUSE_END = re.compile(r"[.!?;:\n]+")
#: The words of word_lists(), so that what is learned is what is matched.
WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")

#: Match types and their symbols, with the weights that hold before training.
MATCHES = {
    "p": ("plain insult", 2.0), "P": ("amplified insult", 2.2), "a": ("aimed insult", 3.0), "b": ("aim after an insult", 1.5), "w": ("word of violence", 0.2), "h": ("intended violence", 1.5), "x": ("threat", 2.5),
    "y": ("aim after violence", 0.8), "n": ("negated", 0.3), "r": ("reported", 0.3),
}
TYPES = tuple(MATCHES)
PRIOR = np.array([w for _, w in MATCHES.values()])
PRIOR_BIAS = -2.5


@dataclass
class Transducer:
    """A deterministic weighted finite-state transducer: arcs (state, symbol) to (state, written symbol, weight). A symbol
    without an arc is copied at no weight and follows the state's `rest`."""

    arcs: dict[tuple[int, str], tuple[int, str, float]]
    rest: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol)) or (self.rest.get(state, state), symbol, 0.0)


def compose(first: Transducer, second: Transducer, symbols: str) -> Transducer:
    """The transducer that feeds what `first` writes to `second`, over the reachable pairs of states; weights add up."""
    numbers, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
    while todo:
        p, q = todo.pop()
        for symbol in symbols:
            p2, middle, before = first.step(p, symbol)
            q2, out, after = second.step(q, middle)
            if (p2, q2) not in numbers:
                numbers[p2, q2] = len(numbers)
                todo.append((p2, q2))
            arcs[numbers[p, q], symbol] = (numbers[p2, q2], out, before + after)
    return Transducer(arcs)


# Symbols read: I insult, V violence, A amplifier, M intent, T target, N negation, R report, o any other word.
SYMBOLS = "IVAMTNRo"
#: An insult phrase: a word of the lexicon, more after an amplifier at most two words before, or next to another one.
INSULT = Transducer({**{(k, "A"): (1, "A", 0.0) for k in range(4)}, (0, "I"): (3, "p", 0.0), **{(k, "I"): (3, "P", 0.0) for k in (1, 2, 3)}}, {1: 2, 2: 0, 3: 0})
#: A threat phrase: a word of violence, intended where a word of intent is at most four words before.
THREAT = Transducer({**{(k, "M"): (1, "M", 0.0) for k in range(5)}, (0, "V"): (0, "w", 0.0), **{(k, "V"): (0, "h", 0.0) for k in range(1, 5)}}, {1: 2, 2: 3, 3: 4, 4: 0})
#: What is aimed: at a target at most four words before it; or, if it has none, at one at most three words after it, which
#: writes a match of its own. States: 1-4 words since a target, 5-7 since an insult without one, 8-10 since violence.
AIM = Transducer(
    {
        **{(k, "T"): (1, "T", 0.0) for k in range(5)}, **{(k, x): (1, y, 0.0) for k in range(1, 5) for x, y in (("p", "a"), ("P", "a"), ("w", "x"), ("h", "x"))},
        **{(k, x): (5, x, 0.0) for k in (0, *range(5, 11)) for x in "pP"}, **{(k, x): (8, x, 0.0) for k in (0, *range(5, 11)) for x in "wh"},
        **{(k, "T"): (1, "b", 0.0) for k in range(5, 8)}, **{(k, "T"): (1, "y", 0.0) for k in range(8, 11)},
    },
    {1: 2, 2: 3, 3: 4, 4: 0, 5: 6, 6: 7, 7: 0, 8: 9, 9: 10, 10: 0},
)
#: A match at most three words after a negation is negated.
NEGATION = Transducer({**{(k, "N"): (1, "N", 0.0) for k in range(4)}, **{(k, x): (0, "n", 0.0) for k in range(1, 4) for x in "pPawhx"}}, {1: 2, 2: 3, 3: 0})
#: A match anywhere after a verb of saying is reported.
REPORT = Transducer({(0, "R"): (1, "R", 0.0), **{(1, x): (1, "r", 0.0) for x in "pPabwhxy"}})
PATTERNS = reduce(lambda a, b: compose(a, b, SYMBOLS), (INSULT, THREAT, AIM, NEGATION, REPORT))


def weighted(weights: np.ndarray) -> Transducer:
    """The grammar: PATTERNS with a last transducer that puts the weights of match types on its arcs."""
    return compose(PATTERNS, Transducer({(0, x): (0, x, float(w)) for x, w in zip(TYPES, weights, strict=True)}), SYMBOLS)


@dataclass
class Grammar:
    """Insult words and stems with lexical weights, about 1 for a sure insult, and the weights of the match types, which
    are those of the machine's arcs."""

    words: dict[str, float]
    weights: np.ndarray
    bias: float
    looked_up: dict[str, bool] = field(default_factory=dict)

    def lexical(self, word: str) -> float:
        return max(self.words.get(word, 0.0), *(self.words.get(word[:k] + "*", 0.0) for k in STEMS))

    def symbol(self, word: str) -> tuple[str, float]:
        """A word's class, and the lexical weight of an insult or a word of violence."""
        lexical = self.lexical(word)
        if lexical:
            return "I", lexical
        if word in VIOLENCE:
            return "V", 1.0
        return next((x for x, words in (("N", NEGATIONS), ("R", REPORTS), ("T", TARGETS), ("M", INTENTS), ("A", AMPLIFIERS)) if word in words), "o"), 0.0

    def clause(self, words: list[str], machine: Transducer = PATTERNS) -> tuple[list[tuple[str, float]], float]:
        """Matches of one clause as (type, lexical weight), and the weight of its path through the machine, in which an
        arc's weight counts times the lexical weight of the word that the match is of."""
        state, out, total, held = 0, [], 0.0, 0.0
        for word in words:
            symbol, lexical = self.symbol(word)
            held = lexical or held  # an aim that comes later is that of the match before it
            state, written, weight = machine.step(state, symbol)
            if written in MATCHES:
                out.append((written, held))
                total += weight * held
        return out, total

    def features(self, text: str, hot: set[str] | None = None) -> np.ndarray:
        """log2(1 + summed lexical weight) of the matches of each type over all clauses of a lower-case text; hot: its
        hot words, so that clauses without any of them are passed over."""
        total = dict.fromkeys(TYPES, 0.0)
        for part in CLAUSE_END.split(text):
            if hot is None or any(w in part for w in hot):
                for kind, weight in self.clause(WORD.findall(part))[0]:
                    total[kind] += weight
        return np.log2(1 + np.array([*total.values()]))

    def hot(self, word: str) -> bool:
        """Whether a match can begin at a word; what was looked up is kept in the worker."""
        found = self.looked_up.get(word)
        if found is None:
            if len(self.looked_up) >= LOOKED_UP:
                self.looked_up.clear()
            found = self.looked_up[word] = word in VIOLENCE or self.lexical(word) > 0
        return found

    def batch(self, texts: pa.Array) -> np.ndarray:
        """Features of all texts; only clauses that hold an insult or a word of violence are parsed."""
        out = np.zeros((len(texts), len(TYPES)))
        words, starts = word_lists(texts)
        coded = words.dictionary_encode()
        known = coded.dictionary.to_pylist()
        hot = np.array([self.hot(w) for w in known], bool)
        if not hot.any():
            return out
        index = coded.indices.to_numpy(zero_copy_only=False)
        places = np.flatnonzero(hot[index])
        owner = np.searchsorted(starts, places, side="right") - 1
        rows, first = np.unique(owner, return_index=True)
        lower = pc.utf8_lower(texts.take(pa.array(rows))).to_pylist()
        for row, text, i, j in zip(rows.tolist(), lower, first.tolist(), [*first[1:].tolist(), len(places)], strict=True):
            out[row] = self.features(text, {known[k] for k in index[places[i:j]]})
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        """The chance of toxicity: the weights of all clauses' paths, damped per type as features are, and the bias."""
        return 1 / (1 + np.exp(-(self.bias + features @ self.weights)))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the third of the documents whose labels are not learned from; false for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to (feature, toxic, other): in how many texts of each kind a word or stem occurs."""
    for batch in slices(batches, 2 << 20):
        toxic, other = Counter(), Counter()
        words, starts = word_lists(batch.column("text"))
        values = words.to_pylist()
        for i, label in enumerate(batch.column("toxic").to_pylist()):
            own = {*values[starts[i] : starts[i + 1]]}
            own |= {w[:k] + "*" for w in own for k in STEMS if len(w) >= k}
            (toxic if label else other).update(own)
        keys = [*(toxic | other)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([other[k] for k in keys], pa.int64())], ["feature", "toxic", "other"])


def lexicon(sample: DataFrame) -> dict[str, float]:
    """Words and stems that mark toxic texts, with their smoothed log-odds, in units of FULL_LOG_ODDS, as weight.

    A feature's evidence is n KL(share of toxic texts among its n || base rate), which bounds the logarithm of its
    chance probability; features are accepted best first while the expected share of chance finds is below 5 %.
    """
    base = sample.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    if not base["t"] or base["t"] == base["n"]:
        return {}
    p = base["t"] / base["n"]
    counts = sample.select("text", "toxic").mapInArrow(counted, "feature string, toxic long, other long")
    counts = materialize(counts.groupBy("feature").agg(F.sum("toxic").alias("k"), F.sum("other").alias("m")).where("k + m >= 3"), "toxic-words")
    tested = max(1, counts.count())
    n, share = F.col("k") + F.col("m"), F.col("k") / (F.col("k") + F.col("m"))
    rest = F.when(F.col("m") > 0, (1 - share) * F.log((1 - share) / (1 - p))).otherwise(0.0)
    rated = counts.where((share >= 0.7) & (share > p)).withColumn("evidence", n * (share * F.log(share / p) + rest))
    top = rated.orderBy(F.desc("evidence"), "feature").limit(LEXICON_SIZE).collect()
    found, accepted = {}, 0
    for i, r in enumerate(top, 1):
        if r["evidence"] >= -np.log(0.05 * i / tested):
            accepted = i
    for r in top[:accepted]:
        found[r["feature"]] = float(np.clip(np.log((r["k"] + 0.5) / (r["m"] + 0.5)) / FULL_LOG_ODDS, 0.1, 1.5))
    return found


def fitted(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, pulled toward the prior weights, never below zero for a match type."""
    prior = np.append(PRIOR, PRIOR_BIAS)
    a, w = np.column_stack((x, np.ones(len(x)))), prior.copy()
    pull = np.append(np.full(len(PRIOR), 0.3), 0.1)
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (q - y) + pull * (w - prior)
        hess = (a * (q * (1 - q))[:, None]).T @ a + np.diag(pull)
        w = w - np.clip(np.linalg.solve(hess, grad), -2, 2)
        w[:-1] = np.maximum(w[:-1], 0)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame) -> Grammar:
    """A grammar whose lexicon and weights come from at most TRAINING_ROWS labelled documents, none held out."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("toxic is not null and doc_id is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS)
    known = materialize(known, "toxic-labels")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    one = F.max_by(F.struct("text"), F.xxhash64("text"))  # rows that share a doc_id count as one, so that the sample is bounded
    sample = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(one.alias("t")).select("t.text", "toxic")
    sample = materialize(sample.repartition(max(8, texts.sparkSession.sparkContext.defaultParallelism)), "toxic-sample")
    grammar = Grammar({w: 1.0 for w in INSULTS} | lexicon(sample), PRIOR, PRIOR_BIAS)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = grammar.batch(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *map(pa.array, x.T)], ["toxic", *(f"x{i}" for i in range(len(TYPES)))])

    schema = "toxic int, " + ", ".join(f"x{i} double" for i in range(len(TYPES)))
    table = sample.mapInArrow(measured, schema).groupBy(*(f"x{i}" for i in range(len(TYPES))), "toxic").count().toArrow().to_pandas()
    if table["toxic"].nunique() > 1:
        rows = table.loc[table.index.repeat(table["count"])]
        grammar.weights, grammar.bias = fitted(rows[[f"x{i}" for i in range(len(TYPES))]].to_numpy(), rows["toxic"].to_numpy())
    return grammar


def scored(docs: DataFrame, grammar: Grammar, threshold: float = 0.7) -> DataFrame:
    """docs with score and predicted added, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = shared.value.score(shared.value.batch(pc.cast(batch.column("text"), pa.string())))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*batch.schema.names, "__score", "__predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(add, f"{schema}, __score double, __predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (doc_id, held_out, score, predicted) per row of docs.

    The grammar is trained from the labels of documents that are not held out. Texts are cut into clauses; words
    become classes by the lexicon; the composed transducers rewrite insults and threats by their context, and the
    weighted matches of all clauses give the score. Null and empty texts hold no match and get the lowest score. A
    null doc_id isn't held out and isn't trained on; repeated rows are scored each. A label that is null is not
    learned from; of several labels of one doc_id the highest counts. Without labels the prior weights hold.
    Extra columns are ignored.
    """
    out = scored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the grammar rejects; same columns, which mustn't include __score or __predicted."""
    return scored(docs, train(docs, labels)).where("__predicted = 0").select(*docs.columns)
